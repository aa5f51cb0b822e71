"""Inverse of the standard normal distribution as a Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# AS241 (PPND16), Wichura 1988, Applied Statistics 37:477, ascending powers.
A = (3.3871328727966608, 133.14166789178438, 1971.5909503065514, 13731.693765509461, 45921.95393154987, 67265.7709270087, 33430.57558358813, 2509.0809287301227)
B = (1.0, 42.31333070160091, 687.1870074920579, 5394.196021424751, 21213.794301586597, 39307.89580009271, 28729.085735721943, 5226.495278852855)
C = (1.4234371107496835, 4.630337846156546, 5.769497221460691, 3.6478483247632045, 1.2704582524523684, 0.2417807251774506, 0.022723844989269184, 0.0007745450142783414)
D = (1.0, 2.053191626637759, 1.6763848301838038, 0.6897673349851, 0.14810397642748008, 0.015198666563616457, 0.0005475938084995345, 1.0507500716444169e-09)


def _polynomial(x: Column, powers: tuple[float, ...]) -> Column:
    return reduce(lambda sum_, c: sum_ * x + F.lit(c), reversed(powers[:-1]), F.lit(powers[-1]))


def norm_ppf(p: Column) -> Column:
    """z with P(Z <= z) = p, for 1.4e-11 <= p <= 1 - 1.4e-11; null stays null."""
    q = p - F.lit(0.5)
    centre = F.lit(0.180625) - q * q
    tail = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p))) - F.lit(1.6)
    near = q * _polynomial(centre, A) / _polynomial(centre, B)
    far = F.signum(q) * _polynomial(tail, C) / _polynomial(tail, D)
    return F.when(p.isNotNull(), F.when(F.abs(q) <= 0.425, near).otherwise(far))


def norm_ppf_sql(p: str) -> str:
    """The same formula as SQL text over an expression."""

    def polynomial(x: str, powers: tuple[float, ...]) -> str:
        return reduce(lambda sum_, c: f"({sum_} * {x} + {c!r}::DOUBLE)", reversed(powers[:-1]), f"{powers[-1]!r}::DOUBLE")

    q = f"({p} - 0.5::DOUBLE)"
    centre = f"(0.180625::DOUBLE - {q} * {q})"
    tail = f"(sqrt(-ln(least({p}, 1.0::DOUBLE - {p}))) - 1.6::DOUBLE)"
    return (
        f"CASE WHEN {p} IS NULL THEN NULL WHEN abs({q}) <= 0.425 THEN {q} * {polynomial(centre, A)} / {polynomial(centre, B)} "
        f"ELSE sign({q}) * {polynomial(tail, C)} / {polynomial(tail, D)} END"
    )
