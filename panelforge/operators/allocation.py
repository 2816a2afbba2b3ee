"""Capital across sleeves and assets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.panel import over, rolling


def inverse_vol(sleeves: DataFrame, lookback: int = 63, least: int = 20) -> DataFrame:
    """date, sleeve, a: shares inverse to trailing volatility of the rows before; 0 while a sleeve warms up."""
    at = sleeves.withColumn("_v", rolling(F.stddev_samp, F.col("ret"), lookback, "sleeve", least=least))
    at = at.withColumn("_v", F.lag("_v").over(over("sleeve"))).withColumn("_i", F.when(F.col("_v") > 0, 1 / F.col("_v")))
    share = F.try_divide(F.col("_i"), F.sum("_i").over(Window.partitionBy("date")))
    return at.select("date", "sleeve", F.coalesce(share, F.lit(0.0)).alias("a"))


def unallocated(weights: DataFrame, alloc: DataFrame) -> DataFrame:
    """The sleeves of weights that no allocation names: must be empty before combining."""
    return weights.select("sleeve").distinct().join(alloc.select("sleeve").distinct(), "sleeve", "left_anti")


def combine(weights: DataFrame, alloc: DataFrame) -> DataFrame:
    """date, ticker, w: the sleeves' weights (sleeve, date, ticker, w) by their allocation, over all tickers of any sleeve."""
    at = alloc.join(weights, ["date", "sleeve"])
    return at.groupBy("date", "ticker").agg(F.sum(F.coalesce(F.col("w"), F.lit(0.0)) * F.col("a")).alias("w"))


def blend(sleeves: DataFrame, alloc: DataFrame) -> DataFrame:
    """date, ret: the allocation-weighted sum of sleeve returns, nulls 0."""
    at = sleeves.join(alloc, ["date", "sleeve"], "left")
    return at.groupBy("date").agg(F.sum(F.coalesce(F.col("ret"), F.lit(0.0)) * F.coalesce(F.col("a"), F.lit(0.0))).alias("ret"))


#: Names and days of a block of returns.
NAMES, DAYS = 64, 512


def tiles(rows: DataFrame, *keys: str, names: int = NAMES, days: int = DAYS) -> DataFrame:
    """keys, b, n, days and the packed returns of each (block of names, block of days) of rows (keys, date, name, r), NaN where there is none.

    Names are numbered in order within the keys (a row a name); ``labels`` holds a block's names.
    """
    x = rows.where("r IS NOT NULL").select(*keys, "date", "name", F.col("r").cast("double").alias("r"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("name")) - 1
    numbered = x.select(*keys, "name").distinct().withColumn("_i", number)
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    at = x.join(numbered, [*keys, "name"]).select(*keys, F.floor(F.col("_i") / names).alias("b"), F.floor(day / days).alias("t"), "name", (F.col("_i") % names).alias("i"), F.pmod(day, F.lit(days)).alias("d"), "r")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        tile, labels = np.full((names, days), np.nan), [None] * names
        i = pdf["i"].to_numpy()
        tile[i, pdf["d"].to_numpy()] = pdf["r"].to_numpy()
        for k, n in zip(i, pdf["name"], strict=True):
            labels[k] = n
        used = np.flatnonzero(~np.isnan(tile).all(0))  # weekly dates leave most days empty
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in (*keys, "b", "t")), labels, used.tolist(), tile[:, used].tobytes()]], columns=[*keys, "b", "t", "labels", "used", "r"])

    kinds = dict(x.dtypes)
    own = "".join(f"{k} {kinds[k]}, " for k in keys)
    return at.groupBy(*keys, "b", "t").applyInPandas(pack, f"{own}b long, t long, labels array<{kinds['name']}>, used array<int>, r binary")


def _block(pdf: pd.DataFrame, b: int, grid: dict, names: int) -> tuple[np.ndarray, list]:
    """The returns of a block of names over all days of the grid, and the names."""
    out, labels = np.full((names, len(grid)), np.nan), [None] * names
    for t, own, used, r in zip(*(pdf.loc[pdf["b"] == b, c] for c in ("t", "labels", "used", "r")), strict=True):
        out[:, [grid[t, d] for d in used]] = np.frombuffer(r).reshape(names, len(used))
        labels = [x if y is None else y for x, y in zip(labels, own, strict=True)]
    return out, labels


def _moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, cov and corr of each row of x with each row of y over the days on which both are known: products of values and of masks."""

    def shifted(v):
        on = ~np.isnan(v)
        mean = np.divide(np.where(on, v, 0).sum(1), on.sum(1), out=np.zeros(len(v)), where=on.any(1))
        return np.where(on, v - mean[:, None], 0.0), on.astype(float)

    (u, m), (v, k) = shifted(x), shifted(y)
    n = m @ k.T
    su, sv, uu, vv, uv = u @ k.T, m @ v.T, (u * u) @ k.T, m @ (v * v).T, u @ v.T
    with np.errstate(divide="ignore", invalid="ignore"):
        cuv, cu, cv = uv - su * sv / n, uu - su * su / n, vv - sv * sv / n
        flat = (cu <= 1e-14 * uu) | (cv <= 1e-14 * vv) | (n < 2)
        return n, np.where(n > 1, cuv / (n - 1), np.nan), np.where(flat, np.nan, np.clip(cuv / np.sqrt(cu * cv), -1, 1))


def correlations(rows: DataFrame, *keys: str, names: int = NAMES, days: int = DAYS) -> DataFrame:
    """keys, i, j, corr, cov, distance of every pair of names (i, j) with common dates of rows (keys, date, name, r).

    Returns are packed into (block of names, block of days) tiles, and each pair of name blocks is a group whose moments are
    numpy products: what is shuffled is each tile once for each block of names, not a row a pair and date.
    """
    packed = tiles(rows, *keys, names=names, days=days)
    blocks = packed.groupBy(*keys).agg((F.max("b") + 1).alias("_blocks"))
    both = packed.join(blocks, list(keys)) if keys else packed.join(blocks, F.lit(True))  # a row a key
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    both = both.withColumn("_o", other).withColumn("lo", F.least("b", "_o")).withColumn("hi", F.greatest("b", "_o")).drop("_o", "_blocks")

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        grid = {td: c for c, td in enumerate(sorted({(t, d) for t, used in zip(pdf["t"], pdf["used"], strict=True) for d in used}))}
        x, a = _block(pdf, lo, grid, names)
        y, b = (x, a) if lo == hi else _block(pdf, hi, grid, names)
        n, cov, corr = _moments(x, y)
        i, j = np.nonzero(n)
        left, right = np.array(a, object)[i], np.array(b, object)[j]
        out = pd.DataFrame({"i": left, "j": right, "corr": corr[i, j], "cov": cov[i, j]})
        if lo != hi:
            out = pd.concat([out, out.rename(columns={"i": "j", "j": "i"})], ignore_index=True)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    kinds = dict(rows.dtypes)
    own = "".join(f", {k} {kinds[k]}" for k in keys)
    out = both.groupBy(*keys, "lo", "hi").applyInPandas(products, f"i {kinds['name']}, j {kinds['name']}, corr double, cov double{own}")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    out = out.select(*keys, "i", "j", known("corr").alias("corr"), known("cov").alias("cov"))
    distance = F.when(F.col("i") == F.col("j"), 0.0).when(F.col("corr").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 0.5 * (1 - F.col("corr")))))
    return out.withColumn("distance", distance)


def inverse_variance(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, name, w: shares inverse to the variance of r."""
    v = rows.where("r IS NOT NULL").groupBy(*keys, "name").agg(F.var_samp("r").alias("v"))
    inverse = F.try_divide(F.lit(1.0), F.col("v"))
    return v.select(*keys, "name", (inverse / F.sum(inverse).over(Window.partitionBy(*keys))).alias("w"))


def refit_windows(calendar: DataFrame, lookback: int = 252, every: int = 21, least: int | None = None) -> DataFrame:
    """refit, fit_date, first, last: each refit's position and date, and the positions it learns from (before its own)."""
    least = least or lookback
    at = calendar.where((F.col("pos") >= least) & ((F.col("pos") - least) % every == 0))
    return at.select(F.col("pos").alias("refit"), F.col("date").alias("fit_date"), F.greatest(F.lit(0), F.col("pos") - lookback).alias("first"), (F.col("pos") - 1).alias("last"))


def concentration(weights: DataFrame, *keys: str) -> DataFrame:
    """keys, herfindahl, effective_n of each date's weights, then on average."""
    keys = keys or ("book",)
    daily = weights.groupBy(*keys, "date").agg(F.sum(F.col("w") * F.col("w")).alias("h")).where("h > 0")
    return daily.groupBy(*keys).agg(F.avg("h").alias("herfindahl"), F.avg(1 / F.col("h")).alias("effective_n"))


def common_dates(daily: DataFrame) -> DataFrame:
    """The rows of dates on which every book has a return."""
    at = daily.where("ret IS NOT NULL")
    books = at.agg(F.count_distinct("book").alias("k"))
    shared = at.groupBy("date").agg(F.count_distinct("book").alias("n")).join(books, F.lit(True)).where("n = k").select("date")
    return at.join(shared, "date", "left_semi")


def sharpe(daily: DataFrame, periods: int = 252, *keys: str) -> DataFrame:
    keys = keys or ("book",)
    return daily.groupBy(*keys).agg((F.try_divide(F.avg("ret"), F.nullif(F.stddev_samp("ret"), F.lit(0.0))) * math.sqrt(periods)).alias("sharpe"), F.count("ret").alias("days"))
