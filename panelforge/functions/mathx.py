"""Column builders that Spark lacks, and the same expressions as SQL text."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's double-precision rational approximation of the normal distribution.
_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_SPLIT = 7.07106781186547
ROOT_2PI = 2.506628274631000502

TRADING_DAYS = 252


def quantile_of_normal(p: float) -> float:
    """The standard normal quantile of a constant."""
    return NormalDist().inv_cdf(p)


def _horner(z, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * z + c
    return out


def norm_cdf(x: Column) -> Column:
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    near = e * _horner(z, tuple(map(F.lit, _P))) / _horner(z, tuple(map(F.lit, _Q)))
    far = z + 0.65
    for k in (4, 3, 2, 1):
        far = z + F.lit(float(k)) / far
    tail = F.when(z > 37, F.lit(0.0)).when(z < _SPLIT, near).otherwise(e / far / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / ROOT_2PI


def norm_cdf_sql(x: str) -> str:
    z = f"abs({x})"

    def poly(cs):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * {z} + {c!r})"
        return out

    far = f"({z} + 0.65)"
    for k in (4, 3, 2, 1):
        far = f"({z} + {k}.0 / {far})"
    tail = f"(CASE WHEN {z} > 37 THEN 0.0 WHEN {z} < {_SPLIT} THEN exp(-{z} * {z} / 2) * {poly(_P)} / {poly(_Q)} ELSE exp(-{z} * {z} / 2) / {far} / 2.506628274631 END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def norm_pdf_sql(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2) / {ROOT_2PI!r})"


def weekday_offset(day: Column, back: int) -> Column:
    """The date ``back`` weekdays (Monday to Friday) before a day; a weekend day counts from the Friday before, as its next step."""
    dow = F.weekday(day)  # Monday 0
    start = F.when(dow >= 5, F.date_sub(day, (dow - 4).cast("int"))).otherwise(day)
    left = F.lit(back) - F.when(dow >= 5, 1).otherwise(0)
    weeks, rest = F.floor(left / 5), left % 5
    base = F.date_sub(start, (weeks * 7).cast("int"))
    d = F.weekday(base)
    return F.date_sub(base, (rest + F.when(rest > d, 2).otherwise(0)).cast("int"))


def clean(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero, NaN as null."""
    return F.nanvl(F.round(x, digits) + F.lit(0.0), F.lit(None).cast("double"))


def sqrt_periods(periods: int) -> float:
    return math.sqrt(periods)
