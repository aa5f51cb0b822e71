"""Lookups by a key of which a few values may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000


def skewed_lookup(left: DataFrame, right: DataFrame, key: str | list[str], size_col: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key and the key's number of left rows.

    Keys with more than one thousandth of all ``total`` rows can't number a thousand, so they are broadcast and their
    rows stay where they are; all other rows are joined by a shuffle that no key can dominate.
    """
    many = total / HOT_KEYS
    hot = F.broadcast(right.filter(F.col(size_col) > many))
    cold = right.filter(F.col(size_col) <= many)
    keys = [key] if isinstance(key, str) else key
    rest = left.join(hot.select(keys), key, "left_anti").join(cold, key)
    return left.join(hot, key).unionByName(rest)


def skewed_left(left: DataFrame, right: DataFrame, key: list[str], size_col: str, total: int) -> DataFrame:
    """Left join like :func:`skewed_lookup`; rows without a match, and those with a null key, stay with nulls."""
    many, size = total / HOT_KEYS, F.col(size_col)
    if not key:
        return left.crossJoin(F.broadcast(right))  # one row
    hot = F.broadcast(right.filter(size > many))
    rest = left.join(F.broadcast(right.filter(size > many).select(key)), key, "left_anti").join(right.filter(size <= many), key, "left")
    return left.join(hot, key).unionByName(rest)
