"""Per-group fits: many small problems side by side, each one key's rows in numpy.

Spark brings a group's rows (one pair's window, one slice's points, one series' history:
bounded by the window or the history of one key) to a task; keys run in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import allocation
from panelforge.operators.panel import folded

# MacKinnon's response surface for two cointegrated series with a constant.
_TAU_STAR, _TAU_MIN, _TAU_MAX = -2.62, -18.86, 0.92
_SMALL_P = (2.9200, 1.5012, 0.039796)
_LARGE_P = (2.1945, 0.64695, -0.29198, -0.042377)


def mackinnon_p(tau: float) -> float:
    """The p-value of a cointegration statistic of two series."""
    if not math.isfinite(tau):
        return 1.0
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    c = _SMALL_P if tau <= _TAU_STAR else _LARGE_P
    return 0.5 * math.erfc(-sum(v * tau**i for i, v in enumerate(c)) / math.sqrt(2))


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    return beta, e, float(e @ e)


def engle_granger(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(tau, p): residuals of a on b and a constant, tested for a unit root, lags by the least AIC."""
    n = len(a)
    _, e, _ = _ols(np.column_stack([b, np.ones(n)]), a)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    de = np.diff(e)

    def design(lags: int, start: int):
        y = de[start:]
        return np.column_stack([e[start:-1], *(de[start - i : len(de) - i] for i in range(1, lags + 1))]), y

    best, pick = math.inf, 0
    for lags in range(most + 1):
        x, y = design(lags, most)
        _, _, ss = _ols(x, y)
        m = len(y)
        aic = m * (math.log(2 * math.pi * max(ss, 1e-300) / m) + 1) + 2 * x.shape[1]
        if aic < best:
            best, pick = aic, lags
    x, y = design(pick, pick)
    beta, _, ss = _ols(x, y)
    cov = ss / max(1, len(y) - x.shape[1]) * np.linalg.pinv(x.T @ x)
    tau = float(beta[0] / math.sqrt(cov[0, 0])) if cov[0, 0] > 0 else math.nan
    return tau, mackinnon_p(tau)


def cointegration(table: DataFrame, *keys: str, least: int = 252) -> DataFrame:
    """keys, n, tau, p of groups of (la, lb) in the order of date; a failed fit has p 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf.dropna(subset=["la", "lb"]).sort_values("date")
        head = [pdf.iloc[0][k] for k in keys]
        if len(at) < least:
            return pd.DataFrame([], columns=[*keys, "n", "tau", "p"])
        try:
            tau, p = engle_granger(at["la"].to_numpy(float), at["lb"].to_numpy(float))
        except np.linalg.LinAlgError:
            tau, p = math.nan, 1.0
        return pd.DataFrame([[*head, len(at), tau, p]], columns=[*keys, "n", "tau", "p"])

    kinds = dict(table.dtypes)
    return table.select(*keys, "date", "la", "lb").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + (", " if keys else "") + "n long, tau double, p double")


def rolling_cointegration(table: DataFrame, window: int = 252, every: int = 21) -> DataFrame:
    """a, b, date, p at every ``every``-th row, from the ``window`` rows before it."""
    from panelforge.operators import cointegration as windows

    return windows.rolling(table, window, every).select("a", "b", "date", "p")


#: Refits of one series that a task makes side by side.
REFITS = 64


def garch_forecasts(series: DataFrame, every: int = 21, least: int = 252, refits: int = REFITS) -> DataFrame:
    """series, date, vol: GARCH(1,1) one-step forecasts, refitted every ``every`` rows on what came before; the forecast holds between refits.

    A group is ``refits`` refits of one series and the rows up to its last: they walk the history side by side. A fit that fails keeps the previous one.
    """
    at = series.where("r IS NOT NULL").select("series", "date", F.col("r").cast("double").alias("r"))
    w = Window.partitionBy("series").orderBy("date")  # one series' history
    at = at.withColumn("pos", F.row_number().over(w) - 1)
    n = at.groupBy("series").agg(F.count("*").alias("n"))
    chunks = n.where(F.col("n") > least).select("series", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - least - 1) / (every * refits)))).alias("chunk"))
    last = F.lit(least) + (F.col("chunk") + 1) * refits * every - every  # the last refit's position: it knows the rows before
    known = at.join(chunks, "series").where(F.col("pos") <= last)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x, chunk = pdf["r"].to_numpy(float) * 100, int(pdf["chunk"].iloc[0])
        first = least + chunk * refits * every
        ends = np.arange(first, min(first + refits * every, len(x)), every)
        params, ahead = garch_fits(x, ends)
        vol = np.where(np.isfinite(params).all(1), np.sqrt(np.maximum(ahead, 0.0)) / 100, np.nan)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "pos": ends, "fitted": vol})

    fits = known.groupBy("series", "chunk").applyInPandas(run, "series string, pos long, fitted double").withColumn("fitted", F.nanvl("fitted", F.lit(None).cast("double")))
    return at.join(fits, ["series", "pos"], "left").select("series", "date", F.last("fitted", ignorenulls=True).over(w).alias("vol"))


def garch_losses(x: np.ndarray, ends: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative log-likelihoods of x[:end] under each row (mu, omega, alpha, beta) of p, and the variances after them. ends descend."""
    mu, omega, alpha, beta = p.T
    v, loss = np.array([x[:e].var() or 1e-8 for e in ends]), np.zeros(len(ends))
    live = np.searchsorted(-ends, -np.arange(len(x)), "left")  # of each time, how many series are longer
    for t, k in enumerate(live.tolist()):
        if not k:
            break
        e2 = (x[t] - mu[:k]) ** 2
        safe = np.maximum(v[:k], 1e-12)
        loss[:k] += np.log(safe) + e2 / safe
        v[:k] = omega[:k] + alpha[:k] * e2 + beta[:k] * v[:k]
    return 0.5 * loss, v


def _garch_params(q: np.ndarray) -> np.ndarray:
    """(mu, omega, alpha, beta) from unbounded numbers: omega > 0, alpha < 0.5, alpha + beta < 1."""
    with np.errstate(over="ignore"):
        a, b = 0.5 / (1 + np.exp(-q[:, 2])), 1 / (1 + np.exp(-q[:, 3]))
    return np.stack([q[:, 0], np.exp(np.minimum(20, q[:, 1])), a, b * (1 - a) * 0.999], 1)


def garch_fits(x: np.ndarray, ends: np.ndarray, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Of each end, the parameters of the largest normal likelihood of x[:end] (NaN where there is none) and the variance ahead; all side by side."""
    order = np.argsort(-ends, kind="stable")
    e = ends[order]
    var = np.array([x[:k].var() for k in e])
    fit = var > 0
    start = np.stack([[x[:k].mean() for k in e], np.log(np.where(fit, var, 1.0) * 0.1), np.full(len(e), -1.5), np.full(len(e), 1.5)], 1)

    def f(q: np.ndarray, on: np.ndarray) -> np.ndarray:
        loss = garch_losses(x, e[on], _garch_params(q))[0]
        return np.where(np.isfinite(loss), loss, 1e300)

    q = downhill(f, start, steps)
    params = _garch_params(q)
    params[~fit] = np.nan
    ahead = garch_losses(x, e, np.nan_to_num(params))[1]
    out, after = np.empty_like(params), np.empty(len(e))
    out[order], after[order] = params, ahead
    return out, after


def downhill(f, start: np.ndarray, steps: int = 400, scale: float = 0.1, tolerance: float = 1e-10) -> np.ndarray:
    """Points of small f by the downhill simplex, one for each row of start. f(points, rows) gives the values of some rows, in ascending order."""
    m, n = start.shape
    every = np.arange(m)
    s = np.repeat(start[:, None, :], n + 1, 1)
    for i in range(n):
        s[:, i + 1, i] += scale * np.maximum(1.0, np.abs(start[:, i]))
    y = np.stack([f(s[:, i], every) for i in range(n + 1)], 1)
    for _ in range(steps):
        o = np.argsort(y, 1, kind="stable")
        s, y = np.take_along_axis(s, o[:, :, None], 1), np.take_along_axis(y, o, 1)
        on = np.flatnonzero(~((y[:, -1] - y[:, 0] < tolerance * (1 + np.abs(y[:, 0]))) & (np.abs(s - s[:, :1]).max((1, 2)) < 1e-9)))
        if not len(on):
            break
        worst, best, second = s[on, -1], y[on, 0], y[on, -2]
        c = s[on, :-1].mean(1)
        r = 2 * c - worst
        fr = f(r, on)
        far, near = fr < best, fr >= second
        inside = c + 0.5 * (np.where((fr < y[on, -1])[:, None], r, worst) - c)
        other = np.where(far[:, None], c + 2 * (c - worst), inside)
        fo = np.where(far | near, f(other, on), np.inf)
        take = np.where(far, fo < fr, near & (fo < np.minimum(fr, y[on, -1])))
        shrink = near & ~take
        new, value = np.where(take[:, None], other, r), np.where(take, fo, fr)
        moved = on[~shrink]
        s[moved, -1], y[moved, -1] = new[~shrink], value[~shrink]
        small = on[shrink]
        if len(small):
            s[small, 1:] = s[small, :1] + 0.5 * (s[small, 1:] - s[small, :1])
            for i in range(1, n + 1):
                y[small, i] = f(s[small, i], small)
    return s[every, np.argmin(y, 1)]


def garch_path(series: DataFrame, mu: float, omega: float, alpha: float, beta: float, start: float) -> DataFrame:
    """series (series, date, r) with v, the variance ahead of each row, for given parameters: an ordered fold, streamed by series."""

    def step(v: float, r: float | None) -> tuple[float, float]:
        return (v, v) if r is None else (omega + alpha * (r - mu) ** 2 + beta * v, v)

    return folded(series, ("series",), ("r",), step, start, "v")


def garch_vol_target(daily: DataFrame, target: float = 0.10, most: float = 3.0, every: int = 21, least: int = 252, periods: int = 252) -> DataFrame:
    """daily (book, date, ret) with vol (the GARCH forecast of the row, null before the first fit) and scaled.

    A forecast is known before its row's return, so the scale, at most ``most``, is not lagged again.
    """
    vol = garch_forecasts(daily.select(F.col("book").alias("series"), "date", F.col("ret").alias("r")), every, least)
    at = daily.join(vol.withColumnRenamed("series", "book"), ["book", "date"], "left")
    scale = F.least(F.lit(most), F.try_divide(F.lit(target), F.nullif(F.col("vol"), F.lit(0.0)) * math.sqrt(periods)))
    return at.withColumn("scaled", F.when(F.col("vol").isNotNull(), F.col("ret") * scale))


def nelder_mead(f, x0: np.ndarray, steps: int = 400, scale: float = 0.1, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """A point of small f by the downhill simplex."""
    n = len(x0)
    s = np.vstack([x0, *(x0 + scale * max(1.0, abs(x0[i])) * np.eye(n)[i] for i in range(n))])
    y = np.array([f(p) for p in s])
    for _ in range(steps):
        o = np.argsort(y, kind="stable")
        s, y = s[o], y[o]
        if y[-1] - y[0] < tolerance * (1 + abs(y[0])) and np.abs(s - s[0]).max() < 1e-9:
            break
        c = s[:-1].mean(0)
        r = c + (c - s[-1])
        fr = f(r)
        if fr < y[0]:
            e = c + 2 * (c - s[-1])
            fe = f(e)
            s[-1], y[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < y[-2]:
            s[-1], y[-1] = r, fr
        else:
            k = c + 0.5 * ((r if fr < y[-1] else s[-1]) - c)
            fk = f(k)
            if fk < min(fr, y[-1]):
                s[-1], y[-1] = k, fk
            else:
                s[1:] = s[0] + 0.5 * (s[1:] - s[0])
                y[1:] = [f(p) for p in s[1:]]
    k = int(np.argmin(y))
    return s[k], float(y[k])


def evt_tails(daily: DataFrame, level: float = 0.99, threshold: float = 0.90, least: int = 10) -> DataFrame:
    """book, threshold, n_exceedances, xi, var, es: a generalised Pareto tail beyond a high quantile of losses; xi, var and es are null with fewer than ``least`` exceedances."""
    if level <= threshold:
        raise ValueError("level must exceed the threshold's quantile")
    x = daily.where("ret IS NOT NULL").select("book", (-F.col("ret")).alias("loss"))
    cut = x.groupBy("book").agg(F.percentile("loss", F.lit(threshold)).alias("threshold"), F.count("*").alias("n"))
    over_ = x.join(cut, "book").where("loss > threshold").select("book", (F.col("loss") - F.col("threshold")).alias("x"))
    counts = over_.groupBy("book").agg(F.count("*").alias("n_exceedances"))
    at = cut.join(counts, "book").join(tail_fits(over_, least), "book", "left")
    xi, beta, ratio = F.col("xi"), F.col("beta"), F.col("n") / F.col("n_exceedances") * (1 - level)
    at = at.withColumn("var", F.when(F.abs(xi) < 1e-8, F.col("threshold") - beta * F.ln(ratio)).otherwise(F.col("threshold") + beta / xi * (F.pow(ratio, -xi) - 1)))
    es = F.when(xi < 1, F.try_divide(F.col("var") + beta - xi * F.col("threshold"), 1 - xi))
    return at.select("book", "threshold", "n_exceedances", "xi", "var", es.alias("es"))


def tail_fits(over_: DataFrame, least: int = 10, rounds: int = 5, points: int = 32) -> DataFrame:
    """book, xi, beta of exceedances (book, x): the largest likelihood of a generalised Pareto tail.

    With t = xi / beta the likelihood has one unknown: xi is the mean of ln(1 + t x), and what is left is a function of t. It is summed over a grid of t
    for all books at once, and again over a finer grid around each book's best: no book's exceedances are gathered. Shapes stay above -0.5: beyond, the
    likelihood has no regular maximum and grows without bound as the end of the tail nears the largest exceedance.
    """
    stats = over_.groupBy("book").agg(F.count("*").alias("k"), F.max("x").alias("top"), F.avg("x").alias("mean")).where((F.col("k") >= least) & (F.col("top") > 0))
    low = F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: (i - points - 1) / (points + 1.0) / F.col("top"))
    high = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.exp(math.log(1e-3) + i * (math.log(30 / 1e-3) / (points - 1))) / F.col("mean"))
    grid = stats.select("book", "mean", F.concat(low, high).alias("grid"))
    for last in (*[False] * (rounds - 1), True):
        i = F.col("i")
        at = over_.join(grid, "book").select("book", "x", "mean", "grid", F.posexplode("grid").alias("i", "t"))
        # each cell carries its neighbours: the next grid needs no join with this one, which would double the plan a round
        at = at.select("book", "x", "mean", "i", "t", F.get("grid", F.greatest(F.lit(0), i - 1)).alias("a"), F.get("grid", F.least(F.size("grid") - 1, i + 1)).alias("b"))
        sums = at.groupBy("book", "mean", "i", "t", "a", "b").agg(F.avg(F.log1p(F.col("t") * F.col("x"))).alias("xi"))
        sums = sums.where("xi > -0.5").withColumn("like", -(F.ln(F.col("xi") / F.col("t")) + F.col("xi") + 1))
        best = sums.groupBy("book").agg(F.max_by(F.struct("i", "t", "xi", "a", "b", "mean"), "like").alias("b"))
        if last:
            return best.select("book", F.col("b.xi").alias("xi"), (F.col("b.xi") / F.col("b.t")).alias("beta"))
        tiny = 1e-9 / F.col("mean")
        finer = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda j: F.col("a") + (F.col("b") - F.col("a")) * (j / float(points)))
        grid = best.select("book", "b.mean", "b.a", "b.b").select("book", "mean", F.transform(finer, lambda t: F.when(F.abs(t) < tiny, tiny).otherwise(t)).alias("grid"))  # noqa: B023


def gpd_fit(e: np.ndarray) -> tuple[float, float]:
    """(xi, beta) of the largest likelihood."""

    def loss(q):
        xi, b = q[0], math.exp(min(50.0, q[1]))
        z = 1 + xi * e / b
        if (z <= 0).any():
            return 1e12
        return len(e) * math.log(b) + (np.sum(e) / b if abs(xi) < 1e-9 else (1 + 1 / xi) * np.sum(np.log(z)))

    q, _ = nelder_mead(loss, np.array([0.1, math.log(e.mean())]))
    return float(q[0]), math.exp(q[1])


def kelly(moments: DataFrame, fraction: float = 0.5, most: float = 0.10, *keys: str) -> DataFrame:
    """keys, name, w: clipped fractional Kelly weights of rows (keys, i, j, cov, mu): each i's mean and covariances."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["i"].unique())
        cov = pdf.pivot(index="i", columns="j", values="cov").reindex(index=names, columns=names).to_numpy(float)
        mu = pdf.drop_duplicates("i").set_index("i")["mu"].reindex(names).to_numpy(float)
        w = np.clip(fraction * np.linalg.pinv(cov) @ mu, -most, most)
        out = pd.DataFrame({"name": names, "w": w})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    kinds = dict(moments.dtypes)
    schema = "name string, w double" + "".join(f", {k} {kinds[k]}" for k in keys)
    return (moments.groupBy(*keys) if keys else moments.withColumn("_all", F.lit(0)).groupBy("_all")).applyInPandas(run, schema)


def rolling_allocation(rows: DataFrame, calendar: DataFrame, rule: str = "hrp", lookback: int = 252, every: int = 21) -> DataFrame:
    """date, name, w: weights by ``rule`` (hrp, inverse_variance, equal) at every ``every``-th date from the ``lookback`` dates before it, held until the next.

    rows are (date, name, r); names not observed throughout a window (but for its first row) are left out of it. Windows are rows, joined by range.
    """
    fits = allocation.refit_windows(calendar, lookback, every)
    spread = rows.join(calendar, "date").join(F.broadcast(fits), F.col("pos").between(F.col("first"), F.col("last")))  # a row a refit
    whole = spread.groupBy("refit", "name").agg(F.count("r").alias("n"), F.count("*").alias("k")).where("n >= k - 1").select("refit", "name")
    own = spread.join(whole, ["refit", "name"], "left_semi").select("refit", "date", "name", "r")
    if rule == "hrp":
        w = hrp_weights(allocation.correlations(own, "refit"), "refit")
    elif rule == "inverse_variance":
        w = allocation.inverse_variance(own, "refit")
    elif rule == "equal":
        w = whole.withColumn("w", 1 / F.count("*").over(Window.partitionBy("refit")))
    else:
        raise ValueError(f"unknown rule: {rule!r}")
    of = F.lit(lookback) + F.floor((F.col("pos") - lookback) / every) * every
    days = calendar.where(F.col("pos") >= lookback).select("date", of.cast("long").alias("refit"))
    return days.join(w.withColumn("refit", F.col("refit").cast("long")), "refit").select("date", "name", "w")


def cluster_order(d: np.ndarray) -> list[int]:
    """The leaves of single linkage, left to right."""
    groups = {i: [i] for i in range(len(d))}
    dist = d.astype(float).copy()
    np.fill_diagonal(dist, np.inf)
    while len(groups) > 1:
        keys = sorted(groups)
        sub = dist[np.ix_(keys, keys)]
        a, b = np.unravel_index(np.argmin(sub), sub.shape)
        a, b = sorted((keys[a], keys[b]))
        groups[a] = groups[a] + groups.pop(b)
        dist[a] = np.minimum(dist[a], dist[b])
        dist[:, a] = dist[a]
        dist[a, a] = np.inf
    return next(iter(groups.values()), [])


def hrp(cov: np.ndarray, corr: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity weights: recursive bisection of the cluster order by inverse-variance cluster risk."""
    order = cluster_order(np.sqrt(np.maximum(0.0, 0.5 * (1 - corr))))
    w = np.ones(len(cov))

    def risk(part):
        c = cov[np.ix_(part, part)]
        iv = 1 / np.diag(c)
        iv /= iv.sum()
        return float(iv @ c @ iv)

    stack = [order]
    while stack:
        part = stack.pop()
        if len(part) < 2:
            continue
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        a, b = risk(left), risk(right)
        share = 1 - a / (a + b) if a + b > 0 else 0.5
        w[left] *= share
        w[right] *= 1 - share
        stack += [left, right]
    return w


def hrp_weights(pairs: DataFrame, *keys: str) -> DataFrame:
    """keys, name, w from the covariances and correlations (keys, i, j, cov, corr) that Spark has aggregated."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["i"].unique())
        cov, corr = (pdf.pivot(index="i", columns="j", values=v).reindex(index=names, columns=names).to_numpy(float) for v in ("cov", "corr"))
        out = pd.DataFrame({"name": names, "w": hrp(cov, corr)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    kinds = dict(pairs.dtypes)
    schema = "name string, w double" + "".join(f", {k} {kinds[k]}" for k in keys)
    return (pairs.groupBy(*keys) if keys else pairs.withColumn("_all", F.lit(0)).groupBy("_all")).applyInPandas(run, schema)
