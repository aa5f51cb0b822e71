"""Hourly reference evapotranspiration (FAO-56 Penman-Monteith) as a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIND_UNITS = {"m/s": 1.0, "km/h": 1 / 3.6}


def known(x: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(x), x)


def et0_fao56(temp: Column, rel_hum: Column, wind_10m: Column, shortwave: Column, elevation: float | Column = 50.0, wind_unit: str = "m/s") -> Column:
    """mm/h from degrees Celsius, percent, wind at 10 m and W/m2 (taken as net radiation); null if any input is missing.

    A literal elevation is folded before execution. Negative results become 0.
    """
    t, rh, u10, sw = (known(c.cast("double")) for c in (temp, rel_hum, wind_10m, shortwave))
    z = F.lit(float(elevation)) if isinstance(elevation, (int, float)) else elevation.cast("double")
    pressure = 101.3 * F.pow((293 - 0.0065 * z) / 293, F.lit(5.26))
    gamma = 1.013e-3 * pressure / (0.622 * 2.45)
    es = 0.6108 * F.exp(17.27 * t / (t + 237.3))
    ea = es * rh / 100
    delta = 4098 * es / F.pow(t + 237.3, F.lit(2.0))
    u2 = u10 * WIND_UNITS[wind_unit] * (4.87 / F.ln(F.lit(67.8 * 10 - 5.42)))
    rn = sw * 3600 / 1e6
    ground = F.when(rn > 0, 0.1 * rn).otherwise(0.5 * rn)
    rate = (0.408 * delta * (rn - ground) + gamma * (37 / (t + 273)) * u2 * (es - ea)) / (delta + gamma * (1 + 0.34 * u2))
    return F.when(rate.isNotNull(), F.greatest(rate, F.lit(0.0)))


def et0_sql(t: str, rh: str, u10: str, sw: str, elevation: float = 50.0) -> str:
    """The same formula as SQL text."""
    gamma = f"(1.013e-3 * 101.3 * pow((293 - 0.0065 * {elevation}) / 293, 5.26) / (0.622 * 2.45))"
    es = f"(0.6108 * exp(17.27 * {t} / ({t} + 237.3)))"
    delta = f"(4098 * {es} / pow({t} + 237.3, 2))"
    u2 = f"({u10} * (4.87 / ln(67.8 * 10 - 5.42)))"
    rn = f"({sw} * 3600 / 1e6)"
    net = f"({rn} - CASE WHEN {rn} > 0 THEN 0.1 * {rn} ELSE 0.5 * {rn} END)"
    rate = f"((0.408 * {delta} * {net} + {gamma} * (37 / ({t} + 273)) * {u2} * ({es} - {es} * {rh} / 100)) / ({delta} + {gamma} * (1 + 0.34 * {u2})))"
    return f"CASE WHEN {rate} IS NOT NULL THEN greatest({rate}, 0) END"
