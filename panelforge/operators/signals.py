"""Signals to target weights. Rows of a panel are (date, ticker, close, volume, r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.mathx import weekday_offset
from panelforge.operators.panel import back, filled, folded, over, rolling

FEATURES = ("mom_5", "mom_10", "mom_21", "zscore_21", "vol_21", "volume_ratio", "rsi_14", "dist_52w_high")


def clip(x: Column, low, high) -> Column:
    """x between two bounds; null stays null."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def formation(panel: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    """mom: the return from ``lookback`` to ``skip`` rows ago."""
    w = over("ticker")
    return panel.withColumn("mom", F.try_divide(F.lag("close", skip).over(w), F.lag("close", lookback).over(w)) - 1)


def cross_sectional_momentum(panel: DataFrame, lookback: int = 252, skip: int = 21, quantile: float = 0.2, rebalance: int = 21, ord_: str = "ticker", least: int = 5) -> DataFrame:
    """date, ticker, w: long the top and short the bottom by formation return, held between rebalances.

    Each leg sums to 0.5. Ties go by ``ord_``; a name in both legs is short; a rebalance with
    fewer than ``least`` names is skipped.
    """
    at = formation(panel, lookback, skip).withColumn("pos", F.row_number().over(over("ticker")) - 1)
    day = Window.partitionBy("date")
    due = (F.col("pos") >= lookback) & ((F.col("pos") - lookback) % rebalance == 0)
    at = at.withColumn("n", F.count("mom").over(day))
    leg = F.greatest(F.lit(1.0), F.bround(F.col("n") * quantile, 0))
    up = F.row_number().over(day.orderBy(F.col("mom").desc_nulls_last(), ord_))
    down = F.row_number().over(day.orderBy(F.col("mom").asc_nulls_last(), ord_))
    has = F.col("mom").isNotNull()
    w = F.when(due & (F.col("n") >= least), F.when(has & (down <= leg), -0.5 / leg).when(has & (up <= leg), 0.5 / leg).otherwise(0.0))
    return at.withColumn("w", w).select("date", "ticker", F.coalesce(filled(F.col("w"), "ticker"), F.lit(0.0)).alias("w"))


def gross_to_one(df: DataFrame, w: str = "w") -> DataFrame:
    """Each date's weights scaled so that their gross is at most 1; nulls become 0."""
    gross = F.sum(F.abs(w)).over(Window.partitionBy("date"))
    scale = F.least(F.lit(1.0), F.try_divide(F.lit(1.0), gross))
    return df.withColumn(w, F.coalesce(F.col(w) * scale, F.lit(0.0)))


def time_series_momentum(panel: DataFrame, lookback: int = 252, skip: int = 21, vol_lookback: int = 63, target: float = 0.004, max_weight: float = 0.10) -> DataFrame:
    """date, ticker, w: the sign of the formation return, sized by inverse volatility."""
    at = formation(panel, lookback, skip)
    vol = rolling(F.stddev_samp, F.col("r"), vol_lookback, "ticker", least=vol_lookback // 2)
    size = F.least(F.lit(max_weight / 0.5), F.try_divide(F.lit(target), vol))
    raw = F.signum("mom") * F.when(vol.isNotNull(), size)
    return gross_to_one(at.withColumn("w", clip(raw, -max_weight, max_weight)).select("date", "ticker", "w"))


def single_asset_reversion(panel: DataFrame, lookback: int = 21, max_weight: float = 0.10) -> DataFrame:
    """date, ticker, w: against the z-score of the close."""
    c = F.col("close")
    z = F.try_divide(c - rolling(F.avg, c, lookback, "ticker"), rolling(F.stddev_samp, c, lookback, "ticker"))
    return gross_to_one(panel.withColumn("w", clip(-z, -max_weight, max_weight)).select("date", "ticker", "w"))


def pair_table(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, date, la, lb: log closes of each pair (a, b) on every date."""
    x = panel.select("date", F.col("ticker").alias("a"), F.ln("close").alias("la"))
    y = panel.select("date", F.col("ticker").alias("b"), F.ln("close").alias("lb"))
    return pairs.select("a", "b").join(x, "a").join(y, ["b", "date"]).select("a", "b", "date", "la", "lb")


def pair_spread(table: DataFrame, window: int = 252, zscore: int = 60) -> DataFrame:
    """table with beta (rolling hedge ratio, lagged a row), spread and z."""
    w = back(window, "a", "b")
    both = F.count(F.col("la") + F.col("lb")).over(w) >= window
    ratio = F.when(both, F.try_divide(F.covar_samp("la", "lb").over(w), F.var_samp("lb").over(w)))
    at = table.withColumn("_beta", ratio).withColumn("beta", F.lag("_beta").over(over("a", "b"))).drop("_beta")
    at = at.withColumn("spread", F.col("la") - F.col("beta") * F.col("lb"))
    s = F.col("spread")
    return at.withColumn("z", F.try_divide(s - rolling(F.avg, s, zscore, "a", "b"), rolling(F.stddev_samp, s, zscore, "a", "b")))


def pair_positions(spreads: DataFrame, entry: float = 2.0, exit_: float = 0.0, p_max: float = 0.10) -> DataFrame:
    """spreads (a, b, date, z, beta, p) with position: the ordered fold of entry, exit and break rules."""

    def step(before: int, z: float | None, beta: float | None, p: float | None) -> tuple[int, int]:
        sound = None not in (z, beta, p) and z == z and p <= p_max and beta > 0
        if not sound:
            now = 0
        elif before == 0:
            now = -1 if z > entry else 1 if z < -entry else 0
        else:
            now = 0 if (z >= -exit_ if before == 1 else z <= exit_) else before
        return now, now

    return folded(spreads, ("a", "b"), ("z", "beta", "p"), step, 0, "position", T.IntegerType())


def pair_weights(positions: DataFrame) -> DataFrame:
    """date, a, b, ticker, w: hedge-ratio weights of gross 1."""
    size = 1 + F.col("beta")
    on = (F.col("position") != 0) & (F.col("beta") > 0)
    legs = F.array(F.struct(F.col("a").alias("ticker"), F.when(on, F.col("position") / size).otherwise(0.0).alias("w")), F.struct(F.col("b").alias("ticker"), F.when(on, -F.col("position") * F.col("beta") / size).otherwise(0.0).alias("w")))
    return positions.select("date", "a", "b", F.explode(legs).alias("x")).select("date", "a", "b", "x.ticker", "x.w")


def features(panel: DataFrame, spans: tuple = (5, 10, 21), vol: int = 21, rsi: int = 14, high: int = 252) -> DataFrame:
    """date, ticker, r and the eight features of each row, from that row and earlier ones."""
    w, c, v = over("ticker"), F.col("close"), F.col("volume")
    change = c - F.lag("close").over(w)
    at = panel.withColumn("_gain", F.when(change.isNotNull(), F.greatest(change, F.lit(0.0)))).withColumn("_loss", F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))))
    loss = rolling(F.avg, F.col("_loss"), rsi, "ticker")
    rs = F.try_divide(rolling(F.avg, F.col("_gain"), rsi, "ticker"), F.nullif(loss, F.lit(0.0)))
    made = [
        *(F.try_divide(c, F.lag("close", n).over(w)) - 1 for n in spans),
        F.try_divide(c - rolling(F.avg, c, vol, "ticker"), rolling(F.stddev_samp, c, vol, "ticker")),
        rolling(F.stddev_samp, F.col("r"), vol, "ticker"),
        F.try_divide(v, rolling(F.avg, v, vol, "ticker")),
        100 - F.try_divide(F.lit(100.0), 1 + rs),
        F.try_divide(c, rolling(F.max, c, high, "ticker")) - 1,
    ]
    return at.select("date", "ticker", "r", *(x.alias(n) for x, n in zip(made, FEATURES, strict=True)))


def labelled(feats: DataFrame) -> DataFrame:
    """feats with t1 (the next row's date) and y (1.0 if its return is above 0, null if unknown)."""
    w = over("ticker")
    ahead = F.lead("r").over(w)
    return feats.withColumn("t1", F.lead("date").over(w)).withColumn("y", F.when(ahead.isNotNull(), (ahead > 0).cast("double")))


def training_rows(feats: DataFrame, folds: DataFrame, window: int = 504) -> DataFrame:
    """fold, ticker, date, t1, features, y: complete rows in [fit_end - window weekdays, fit_end)."""
    whole = labelled(feats).dropna(subset=[*FEATURES, "y"])
    span = folds.select("fold", "fit_end", weekday_offset(F.col("fit_end"), window).alias("start"))
    at = whole.join(F.broadcast(span), (F.col("date") >= F.col("start")) & (F.col("date") < F.col("fit_end")))  # a row a fold
    return at.select("fold", "ticker", "date", "t1", *FEATURES, "y")


def uniqueness_weights(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with u: 1 / rows that share the label date, of mean 1 within the keys."""
    own = 1 / F.count("*").over(Window.partitionBy(*keys, "date"))
    at = rows.withColumn("_u", own)
    mean = at.groupBy(*keys).agg(F.avg("_u").alias("_mean"))  # a row a key
    at = at.join(mean, list(keys)) if keys else at.join(mean, F.lit(True))
    return at.withColumn("u", F.col("_u") / F.col("_mean")).drop("_u", "_mean")


def neutral_book(proba: DataFrame, deadband: float = 0.05, max_weight: float = 0.10, p: str = "p", keys: tuple = ()) -> DataFrame:
    """proba with w: a market-neutral book of gross 1 from P(up), each date (of each key) scaled to the cap."""
    s = F.col(p) - 0.5
    return _neutral(proba.withColumn("w", F.when(s.isNotNull(), F.when(F.abs(s) >= deadband, s).otherwise(0.0))), max_weight, keys)


def _neutral(at: DataFrame, max_weight: float, keys: tuple = ()) -> DataFrame:
    day = Window.partitionBy(*keys, "date")
    at = at.withColumn("w", F.col("w") - F.avg("w").over(day))
    at = at.withColumn("w", F.try_divide(F.col("w"), F.sum(F.abs("w")).over(day)))
    scale = F.least(F.lit(1.0), F.try_divide(F.lit(max_weight), F.max(F.abs("w")).over(day)))
    return at.withColumn("w", F.coalesce(F.col("w") * scale, F.lit(0.0)))


def primary_side(p: Column, deadband: float = 0.05) -> Column:
    """1, -1 or 0 by P(up) outside a dead-band."""
    s = p - 0.5
    return F.when(s.isNotNull(), F.when(F.abs(s) >= deadband, F.signum(s)).otherwise(0.0))


def meta_labels(rows: DataFrame, side: str = "side", keys: tuple = ("ticker",)) -> DataFrame:
    """rows with meta: whether a side pays on the next row (null without a side or a return)."""
    ahead = F.lead("r").over(over(*keys))
    return rows.withColumn("meta", F.when((F.col(side) != 0) & ahead.isNotNull(), (F.col(side) * ahead > 0).cast("double")))


def meta_book(rows: DataFrame, least: float = 0.5, max_weight: float = 0.10, keys: tuple = ()) -> DataFrame:
    """rows (date, ticker, side, meta_p) with w: sides sized by the meta probability above ``least``."""
    return _neutral(rows.withColumn("w", F.col("side") * F.greatest(F.col("meta_p") - least, F.lit(0.0))), max_weight, keys)
