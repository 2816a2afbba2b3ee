"""Regimes, sizing, limits and risk measures, keyed by market or book."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.mathx import TRADING_DAYS, quantile_of_normal
from panelforge.operators.panel import filled, folded, over, rolling
from panelforge.operators.signals import clip


def market_proxy(panel: DataFrame, benchmark: str | None = None) -> DataFrame:
    """date, r: a benchmark's return, or the mean of the names that have one."""
    if benchmark:
        return panel.where(F.col("ticker") == benchmark).select("date", "r")
    return panel.groupBy("date").agg(F.avg("r").alias("r"))


def vol_ratio_regime(market: DataFrame, fast: int = 21, slow: int = 252, ratio: float = 1.30, *keys: str) -> DataFrame:
    """market (.., date, r) with label: 1 where fast volatility runs hot against slow, of the row before."""
    keys = keys or ("market",)
    at = market if "market" in market.columns or keys != ("market",) else market.withColumn("market", F.lit("all"))
    quick = rolling(F.stddev_samp, F.col("r"), fast, *keys, least=fast // 2)
    base = rolling(F.stddev_samp, F.col("r"), slow, *keys, least=slow // 2)
    at = at.withColumn("_hot", (F.try_divide(quick, base) > ratio).cast("int"))
    return at.withColumn("label", F.lag("_hot").over(over(*keys))).drop("_hot")


def median_ratio_regime(vols: DataFrame, window: int = 252, ratio: float = 1.30, *keys: str) -> DataFrame:
    """vols (.., date, vol: forecasts) with label: 1 where a forecast exceeds ``ratio`` times its trailing median. Not lagged: a forecast is."""
    keys = keys or ("series",)
    base = rolling(lambda x: F.percentile(x, F.lit(0.5)), F.col("vol"), window, *keys, least=window // 4)
    return vols.withColumn("label", (F.try_divide(F.col("vol"), base) > ratio).cast("int"))


def regime_sized(weights: DataFrame, regime: DataFrame, scale: float = 0.5) -> DataFrame:
    """weights (book, date, ticker, w) scaled on dates of label 1; the last label holds, none is 0."""
    days = weights.select("date").distinct().join(regime.select("date", "label"), "date", "left").withColumn("market", F.lit("all"))
    days = days.select("date", F.coalesce(filled(F.col("label"), "market"), F.lit(0)).alias("label"))
    return weights.join(days, "date").withColumn("w", F.when(F.col("label") == 1, F.col("w") * scale).otherwise(F.col("w"))).drop("label")


def switched(weights: DataFrame, regime: DataFrame, by_label: dict[int, str]) -> DataFrame:
    """date, ticker, w of the book that each date's label calls for; a date without a label is flat."""
    labels = F.create_map(*(F.lit(x) for k, b in by_label.items() for x in (k, b)))
    days = regime.select("date", F.try_element_at(labels, F.col("label")).alias("chosen"))
    at = weights.join(days, "date", "left")
    return at.groupBy("date", "ticker").agg(F.coalesce(F.max(F.when(F.col("book") == F.col("chosen"), F.col("w"))), F.lit(0.0)).alias("w"))


def fixed_fraction(w: Column, fraction: float) -> Column:
    return w * fraction


def vol_target(weights: DataFrame, panel: DataFrame, target: float = 0.10, lookback: int = 252, most: float = 3.0, periods: int = TRADING_DAYS) -> DataFrame:
    """weights scaled so that the trailing volatility of today's book meets a target; the scale is of the row before."""
    r = weights.join(panel.select("date", "ticker", "r"), ["date", "ticker"], "left")
    daily = r.groupBy("book", "date").agg(F.coalesce(F.sum(F.col("w") * F.col("r")), F.lit(0.0)).alias("x"))
    vol = rolling(F.stddev_samp, F.col("x"), lookback, "book", least=lookback // 4) * math.sqrt(periods)
    daily = daily.withColumn("_s", F.when(vol.isNotNull(), F.least(F.lit(most), F.try_divide(F.lit(target), vol))))
    daily = daily.withColumn("scale", F.lag("_s").over(over("book"))).select("book", "date", "scale")
    return weights.join(daily, ["book", "date"]).withColumn("w", F.col("w") * F.col("scale"))


def stream_vol_target(daily: DataFrame, target: float = 0.10, lookback: int = 252, most: float = 3.0, periods: int = TRADING_DAYS, r: str = "ret") -> DataFrame:
    """daily (book, date, ret) with scaled: the stream at its volatility target; null before the window warms up."""
    vol = rolling(F.stddev_samp, F.col(r), lookback, "book", least=lookback // 4) * math.sqrt(periods)
    at = daily.withColumn("_s", F.when(vol.isNotNull(), F.least(F.lit(most), F.try_divide(F.lit(target), vol))))
    return at.withColumn("scaled", F.col(r) * F.lag("_s").over(over("book"))).drop("_s")


def drawdown_stop(daily: DataFrame, limit: float = 0.20, cooldown: int = 21, r: str = "ret") -> DataFrame:
    """daily (book, date, ret) with stopped: flat for ``cooldown`` rows after a breach, then a fresh peak. A null return is 0."""

    def step(state: tuple[float, float, int], x: float | None) -> tuple[tuple[float, float, int], float]:
        equity, peak, left = state
        if left:
            return (equity, equity if left == 1 else peak, left - 1), 0.0
        x = x or 0.0
        equity *= 1 + x
        peak = max(peak, equity)
        return (equity, peak, cooldown if equity / peak - 1 <= -limit else 0), x

    return folded(daily, ("book",), (r,), step, (1.0, 1.0, 0), "stopped")


def capped(w: Column, most: float = 0.10) -> Column:
    return clip(w, -most, most)


def limit_report(weights: DataFrame, max_weight: float = 0.10, max_gross: float = 2.0) -> DataFrame:
    """book, worst_name_weight, worst_gross_exposure and whether they breach."""
    daily = weights.groupBy("book", "date").agg(F.max(F.abs("w")).alias("top"), F.sum(F.abs("w")).alias("gross"))
    at = daily.groupBy("book").agg(F.max("top").alias("worst_name_weight"), F.max("gross").alias("worst_gross_exposure"))
    return at.withColumn("name_limit_breached", F.col("worst_name_weight") > max_weight + 1e-9).withColumn("gross_limit_breached", F.col("worst_gross_exposure") > max_gross + 1e-9)


def tail_report(daily: DataFrame, level: float = 0.95, r: str = "ret") -> DataFrame:
    """book, var, cvar (historical), parametric_var, cornish_fisher_var: losses as positive shares."""
    x, z = F.col(r), quantile_of_normal(1 - level)
    cut = daily.where(x.isNotNull()).groupBy("book").agg(F.percentile(x, F.lit(1 - level)).alias("q"), F.avg(x).alias("mu"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("s"), F.kurtosis(x).alias("k"), F.count(x).alias("n"))
    tail = daily.join(cut.select("book", "q"), "book").where(x <= F.col("q")).groupBy("book").agg(F.avg(x).alias("t"))
    skewed = F.lit(z) + (z**2 - 1) / 6 * F.col("s") + (z**3 - 3 * z) / 24 * F.col("k") - (2 * z**3 - 5 * z) / 36 * F.col("s") * F.col("s")
    at = cut.join(tail, "book", "left")
    return at.select("book", (-F.col("q")).alias("var"), (-F.coalesce("t", "q")).alias("cvar"), (-(F.col("mu") + z * F.col("sd"))).alias("parametric_var"), F.when(F.col("n") >= 3, -(F.col("mu") + skewed * F.col("sd"))).alias("cornish_fisher_var"))


def drawdowns(daily: DataFrame, *keys: str, r: str = "ret") -> DataFrame:
    """daily with dd: equity against its peak so far, which starts at the first equity."""
    keys = keys or ("book",)
    w = over(*keys).rowsBetween(Window.unboundedPreceding, 0)
    at = daily.withColumn("_e", F.exp(F.sum(F.ln(1 + F.coalesce(F.col(r), F.lit(0.0)))).over(w)))
    return at.withColumn("dd", F.col("_e") / F.max("_e").over(w) - 1).drop("_e")


def drawdown_report(daily: DataFrame, *keys: str, r: str = "ret", noise: float = 1e-12) -> DataFrame:
    """keys, max_drawdown, max_dd_duration (the longest run of rows below the peak)."""
    keys = keys or ("book",)
    w = over(*keys)
    at = drawdowns(daily, *keys, r=r).withColumn("_u", (F.col("dd") < -noise).cast("int"))
    at = at.withColumn("_g", F.sum(1 - F.col("_u")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = at.groupBy(*keys, "_g").agg(F.min("dd").alias("dd"), F.sum("_u").alias("n"))
    return runs.groupBy(*keys).agg(F.min("dd").alias("max_drawdown"), F.max("n").alias("max_dd_duration"))


def beta(joined: DataFrame, r: str = "ret", b: str = "b", *keys: str) -> DataFrame:
    """keys, beta of r to b over rows that have both; null where b does not vary."""
    keys = keys or ("book",)
    at = joined.where(F.col(r).isNotNull() & F.col(b).isNotNull())
    return at.groupBy(*keys).agg(F.try_divide(F.covar_samp(r, b), F.nullif(F.var_samp(b), F.lit(0.0))).alias("beta"))


def worst_moves(market: DataFrame, windows: tuple = (1, 5, 21), *keys: str) -> DataFrame:
    """keys, window, market_move: the worst compound return over each window of rows."""
    keys = keys or ("market",)
    at = market.where("r IS NOT NULL")
    moves = [F.struct(F.lit(n).alias("window"), (F.exp(rolling(F.sum, F.ln(1 + F.col("r")), n, *keys)) - 1).alias("move")) for n in windows]
    at = at.select(*keys, "date", F.array(*moves).alias("m"))
    at = at.select(*keys, F.explode("m").alias("m"))
    return at.groupBy(*keys, F.col("m.window").alias("window")).agg(F.min("m.move").alias("market_move"))


def stress(daily: DataFrame, market: DataFrame, windows: tuple = (1, 5, 21), custom: dict[str, float] | None = None) -> DataFrame:
    """book, scenario, market_move, beta, est_pnl: worst observed and custom market moves through each book's beta."""
    betas = beta(daily.join(market.select("date", F.col("r").alias("b")), "date"))
    seen = worst_moves(market.withColumn("market", F.lit("all")), windows).select(F.format_string("Worst %dd", "window").alias("scenario"), "market_move")
    if custom:
        seen = seen.unionByName(daily.sparkSession.createDataFrame(list(custom.items()), "scenario string, market_move double"))
    at = betas.join(F.broadcast(seen), F.lit(True))  # a row a scenario
    return at.select("book", "scenario", "market_move", "beta", (F.col("beta") * F.col("market_move")).alias("est_pnl"))
