"""Performance, significance, bootstrap, factor and multiple-testing tables. Rows are (book, date, ret)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.mathx import TRADING_DAYS, norm_cdf, quantile_of_normal
from panelforge.operators.panel import back, over, rolling
from panelforge.operators.risk import drawdown_report

EULER = 0.5772156649015329


def annual_return(r: Column, periods: int) -> Column:
    growth = F.product(1 + r)
    return F.when(growth > 0, F.pow(growth, F.lit(float(periods)) / F.count(r)) - 1)


def sharpe_of(r: Column, periods: int, rf: float = 0.0) -> Column:
    x = r - rf / periods
    return F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0))) * math.sqrt(periods)


def sortino_of(r: Column, periods: int, rf: float = 0.0) -> Column:
    x = r - rf / periods
    return F.try_divide(F.avg(x), F.nullif(F.sqrt(F.avg(F.when(x < 0, x * x))), F.lit(0.0))) * math.sqrt(periods)


def metrics(daily: DataFrame, rf: float = 0.0, periods: int = TRADING_DAYS) -> DataFrame:
    """The 13 metrics of each book. A profit factor without losses is null."""
    r = F.col("ret")
    turnover = F.avg("turnover") * periods if "turnover" in daily.columns else F.lit(None).cast("double")
    x = daily.where(r.isNotNull())
    one = x.groupBy("book").agg(
        F.count(r).alias("n_periods"), annual_return(r, periods).alias("ann_return"), (F.stddev_samp(r) * math.sqrt(periods)).alias("ann_vol"), sharpe_of(r, periods, rf).alias("sharpe"), sortino_of(r, periods, rf).alias("sortino"),
        F.avg(F.when(r != 0, (r > 0).cast("double"))).alias("hit_rate"), F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r < 0, r)).alias("avg_loss"),
        F.try_divide(F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.nullif(-F.sum(F.when(r < 0, r)), F.lit(0.0))).alias("profit_factor"), turnover.alias("ann_turnover"),
    )
    at = one.join(drawdown_report(x), "book", "left")
    return at.withColumn("calmar", F.try_divide(F.col("ann_return"), F.nullif(F.abs("max_drawdown"), F.lit(0.0))))


def rolling_sharpe(daily: DataFrame, window: int = 126, periods: int = TRADING_DAYS, rf: float = 0.0) -> DataFrame:
    r = F.col("ret")
    mean, vol = rolling(F.avg, r - rf / periods, window, "book"), rolling(F.stddev_samp, r, window, "book")
    w = back(window, "book")
    flat = F.max(r).over(w) == F.min(r).over(w)  # a window of equal returns has no Sharpe, whatever rounding leaves of its deviation
    return daily.withColumn("rolling_sharpe", F.when(~flat, F.try_divide(mean, F.nullif(vol, F.lit(0.0))) * math.sqrt(periods)))


def rolling_beta(daily: DataFrame, market: DataFrame, window: int = 126) -> DataFrame:
    """daily with rolling_beta to market (date, r), over the rows that have both."""
    at = daily.join(market.select("date", F.col("r").alias("_b")), "date").where("ret IS NOT NULL AND _b IS NOT NULL")
    w = back(window, "book")
    value = F.when(F.count("_b").over(w) >= window, F.try_divide(F.covar_samp("ret", "_b").over(w), F.nullif(F.var_samp("_b").over(w), F.lit(0.0))))
    return daily.join(at.select("book", "date", value.alias("rolling_beta")), ["book", "date"], "left")


def per_year(daily: DataFrame, periods: int = TRADING_DAYS, rf: float = 0.0) -> DataFrame:
    """book, year, compound, vol, sharpe, max_drawdown, days. Drawdowns start anew each year."""
    x = daily.where("ret IS NOT NULL").withColumn("year", F.year("date"))
    r = F.col("ret")
    one = x.groupBy("book", "year").agg((F.product(1 + r) - 1).alias("compound"), (F.stddev_samp(r) * math.sqrt(periods)).alias("vol"), sharpe_of(r, periods, rf).alias("sharpe"), F.count(r).alias("days"))
    return one.join(drawdown_report(x, "book", "year").drop("max_dd_duration"), ["book", "year"])


def sharpe_moments(daily: DataFrame, rf: float = 0.0, periods: int = TRADING_DAYS) -> DataFrame:
    """book, n, sr (per period), skew and kurtosis (unbiased; normal is 3)."""
    x = F.col("ret") - rf / periods
    p = daily.groupBy("book").agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6) + 3)
    fine = (n >= 3) & (F.col("s") > 0)
    return p.select("book", "n", F.when(fine, F.col("m") / F.col("s")).alias("sr"), F.when(fine, skew).otherwise(0.0).alias("skew"), F.when(fine, kurt).otherwise(3.0).alias("kurtosis"))


def _spread() -> Column:
    """1 - skew * sr + (kurtosis - 1) / 4 * sr^2, at least 1e-12."""
    sr = F.col("sr")
    return F.greatest(F.lit(1e-12), 1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr)


def probabilistic_sharpe(moments: DataFrame, benchmark: float = 0.0, periods: int = TRADING_DAYS) -> DataFrame:
    """moments with psr: P(true Sharpe > benchmark)."""
    se = F.sqrt(_spread() / F.greatest(F.col("n") - 1, F.lit(1)))
    return moments.withColumn("psr", norm_cdf((F.col("sr") - benchmark / math.sqrt(periods)) / se))


def expected_max_sharpe(variance: Column, trials: int) -> Column:
    if trials <= 1:
        return F.lit(0.0)
    term = (1 - EULER) * quantile_of_normal(1 - 1 / trials) + EULER * quantile_of_normal(1 - 1 / (trials * math.e))
    return F.when(variance > 0, F.sqrt(variance) * term).otherwise(0.0)


def deflated_sharpe(moments: DataFrame, trials: int, across_books: bool = False, periods: int = TRADING_DAYS) -> DataFrame:
    """moments with sr_star_annual and dsr: the Sharpe against the best expected of ``trials``."""
    own = _spread() / F.greatest(F.col("n") - 1, F.lit(1))
    if across_books:
        moments = moments.join(moments.agg(F.var_samp("sr").alias("_v")), F.lit(True))
    star = expected_max_sharpe(F.col("_v") if across_books else own, trials)
    out = moments.withColumn("sr_star_annual", star * math.sqrt(periods)).withColumn("dsr", norm_cdf((F.col("sr") - star) / F.sqrt(own)))
    return out.drop("_v")


def min_track_record(moments: DataFrame, benchmark: float = 0.0, confidence: float = 0.95, periods: int = TRADING_DAYS) -> DataFrame:
    """moments with min_periods, min_years (null if never), significant_now."""
    gap = F.col("sr") - benchmark / math.sqrt(periods)
    spread = 1 - F.col("skew") * F.col("sr") + (F.col("kurtosis") - 1) / 4 * F.col("sr") * F.col("sr")
    z = quantile_of_normal(confidence)
    out = moments.withColumn("min_periods", F.when(gap > 0, 1 + spread * F.pow(z / gap, F.lit(2.0))))
    return out.withColumn("min_years", F.col("min_periods") / periods).withColumn("significant_now", F.coalesce(F.col("n") >= F.col("min_periods"), F.lit(False)))


def draw(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / 4294967296.0


def bootstrap_rows(daily: DataFrame, draws: int = 200, block: int = 10, seed: int = 7, least: int = 20) -> DataFrame:
    """book, b, t, ret: stationary-bootstrap resamples. No step depends on the one before:
    a row's block starts at the last restart, so its index is that start's plus the distance, circularly."""
    x = daily.where("ret IS NOT NULL").withColumn("t", F.row_number().over(over("book")) - 1)
    n = x.groupBy("book").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    grid = n.select("book", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).select("book", "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("t"))
    again = (F.col("t") == 0) | (draw(F.lit(seed), F.lit("r"), F.col("b"), F.col("t")) < 1.0 / max(block, 1))
    start = F.when(again, F.struct(F.col("t").alias("t0"), F.floor(draw(F.lit(seed), F.lit("f"), F.col("b"), F.col("t")) * F.col("n")).alias("f")))
    w = over("book", "b", order="t").rowsBetween(Window.unboundedPreceding, 0)
    at = grid.withColumn("_s", F.last(start, ignorenulls=True).over(w)).withColumn("i", (F.col("_s.f") + F.col("t") - F.col("_s.t0")) % F.col("n"))
    return at.join(x.select("book", F.col("t").cast("long").alias("i"), "ret"), ["book", "i"]).select("book", "b", "t", "ret")


def bootstrap_report(daily: DataFrame, level: float = 0.95, draws: int = 200, block: int = 10, seed: int = 7, periods: int = TRADING_DAYS) -> DataFrame:
    """book, sharpe and cagr intervals, p_positive (share of resamples with a positive Sharpe)."""
    r, a = F.col("ret"), (1 - level) / 2
    each = bootstrap_rows(daily, draws, block, seed).groupBy("book", "b").agg(sharpe_of(r, periods).alias("s"), annual_return(r, periods).alias("c"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    return each.groupBy("book").agg(q("s", a).alias("sharpe_low"), q("s", 1 - a).alias("sharpe_high"), q("c", a).alias("cagr_low"), q("c", 1 - a).alias("cagr_high"), F.avg(F.coalesce((F.col("s") > 0).cast("double"), F.lit(0.0))).alias("p_positive"))


def factor_returns(panel: DataFrame, roles: dict[str, str], rf: float = 0.0) -> DataFrame:
    """date, mkt, smb, hml from the returns of four tickers in the roles market, small, value and growth."""
    at = panel.where(F.col("ticker").isin(list(roles.values()))).groupBy("date").agg(*(F.max(F.when(F.col("ticker") == t, F.col("r"))).alias(k) for k, t in roles.items()))
    return at.select("date", (F.col("market") - rf).alias("mkt"), (F.col("small") - F.col("market")).alias("smb"), (F.col("value") - F.col("growth")).alias("hml"))


_X = ("one", "mkt", "smb", "hml")


def _regression_rows(daily: DataFrame, factors: DataFrame, rf: float) -> DataFrame:
    at = daily.join(factors, "date").withColumn("y", F.col("ret") - rf).withColumn("one", F.lit(1.0))
    return at.dropna(subset=["y", *_X]).select("book", "date", "y", *_X)


def _solve(pdf):
    """Least squares from one book's sums of products."""
    import numpy as np
    import pandas as pd

    r, k = pdf.iloc[0], len(_X)
    xx = np.array([[r[f"x{min(i, j)}{max(i, j)}"] for j in range(k)] for i in range(k)])
    beta = np.linalg.pinv(xx) @ np.array([r[f"y{i}"] for i in range(k)])
    return pd.DataFrame([[r["book"], int(r["n"]), *beta]], columns=["book", "n", *(f"b{i}" for i in range(k))])


def factor_decomposition(daily: DataFrame, factors: DataFrame, rf: float = 0.0, lags: int = 5, least: int = 30, periods: int = TRADING_DAYS) -> DataFrame:
    """book, alpha_annual, alpha_t, alpha_p, betas, t values, r_squared, n: least squares with Newey-West errors.

    Spark sums the cross-products and then the lagged products of residuals; only 4 x 4 algebra per book is done in Python.
    """
    rows = _regression_rows(daily, factors, rf / periods)
    k = len(_X)
    sums = [F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"x{i}{j}") for i in range(k) for j in range(i, k)]
    moments = rows.groupBy("book").agg(F.count("*").alias("n"), *sums, *(F.sum(F.col("y") * F.col(x)).alias(f"y{i}") for i, x in enumerate(_X))).where(F.col("n") >= least)
    betas = moments.groupBy("book").applyInPandas(_solve, "book string, n long, " + ", ".join(f"b{i} double" for i in range(k)))
    at = rows.join(betas, "book")
    fitted = F.lit(0.0)
    for i, x in enumerate(_X):
        fitted = fitted + F.col(f"b{i}") * F.col(x)
    at = at.withColumn("e", F.col("y") - fitted)
    w = over("book")
    scores = [F.col(x) * F.col("e") for x in _X]
    at = at.select("book", "y", "e", *(s.alias(f"s{i}") for i, s in enumerate(scores)), *(F.lag(s, h).over(w).alias(f"l{h}_{i}") for h in range(1, lags + 1) for i, s in enumerate(scores)))
    meat = [F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m0_{i}{j}") for i in range(k) for j in range(k)]
    meat += [F.sum(F.col(f"s{i}") * F.col(f"l{h}_{j}")).alias(f"m{h}_{i}{j}") for h in range(1, lags + 1) for i in range(k) for j in range(k)]
    second = at.groupBy("book").agg(F.sum(F.col("e") * F.col("e")).alias("sse"), (F.var_pop("y") * F.count("y")).alias("sst"), *meat)

    def finish(pdf):
        import numpy as np
        import pandas as pd

        r = pdf.iloc[0]
        xx = np.array([[r[f"x{min(i, j)}{max(i, j)}"] for j in range(k)] for i in range(k)])
        s = np.array([[r[f"m0_{i}{j}"] for j in range(k)] for i in range(k)])
        for h in range(1, lags + 1):
            g = np.nan_to_num(np.array([[r[f"m{h}_{i}{j}"] for j in range(k)] for i in range(k)]))
            s = s + (1 - h / (lags + 1)) * (g + g.T)
        inverse = np.linalg.pinv(xx)
        se = np.sqrt(np.maximum(np.diag(inverse @ s @ inverse), 0))
        b = np.array([r[f"b{i}"] for i in range(k)])
        t = np.divide(b, se, out=np.full(k, np.nan), where=se > 0)
        p = math.erfc(abs(t[0]) / math.sqrt(2)) if np.isfinite(t[0]) else None
        r2 = 1 - r["sse"] / r["sst"] if r["sst"] > 0 else None
        return pd.DataFrame([[r["book"], b[0] * periods, t[0], p, *b[1:], *t[1:], r2, int(r["n"])]], columns=names)

    names = ["book", "alpha_annual", "alpha_t", "alpha_p", "beta_mkt", "beta_smb", "beta_hml", "t_mkt", "t_smb", "t_hml", "r_squared", "n"]
    both = moments.join(betas.drop("n"), "book").join(second, "book")
    return both.groupBy("book").applyInPandas(finish, ", ".join(f"{c} {'string' if c == 'book' else 'long' if c == 'n' else 'double'}" for c in names))


def fdr(trials: DataFrame, alpha: float = 0.10) -> DataFrame:
    """trials (family, name, p) with q (Benjamini-Hochberg) and keep; a null p never survives."""
    valid = F.col("p").isNotNull() & ~F.isnan("p")
    by = Window.partitionBy("family")
    at = trials.withColumn("_ok", valid).withColumn("_m", F.sum(F.col("_ok").cast("int")).over(by))
    at = at.withColumn("_k", F.when(F.col("_ok"), F.row_number().over(Window.partitionBy("family", "_ok").orderBy("p", "name"))))
    ahead = Window.partitionBy("family", "_ok").orderBy("_k").rowsBetween(0, Window.unboundedFollowing)
    q = F.when(F.col("_ok"), F.least(F.lit(1.0), F.min(F.col("p") * F.col("_m") / F.col("_k")).over(ahead)))
    top = F.max(F.when(F.col("p") <= alpha * F.col("_k") / F.col("_m"), F.col("_k"))).over(by)
    return at.withColumn("q", q).withColumn("keep", F.coalesce(F.col("_ok") & (F.col("_k") <= top), F.lit(False))).drop("_ok", "_m", "_k")


def histogram(values: DataFrame, x: str, bins: int = 40, *keys: str) -> DataFrame:
    """keys, bin (from 0), count of values in equal bins between each key's least and largest."""
    at = values.where(F.col(x).isNotNull())
    span = at.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    at = at.join(span, list(keys)) if keys else at.join(span, F.lit(True))
    place = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(x) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * bins))
    return at.groupBy(*keys, place.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def spans(labels: DataFrame, label: str = "label", *keys: str) -> DataFrame:
    """keys, label, start, end, days: runs of equal labels."""
    keys = keys or ("market",)
    w = over(*keys)
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int")
    at = labels.withColumn("_n", new)
    at = at.withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy(*keys, "_g", label).agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days")).drop("_g")
