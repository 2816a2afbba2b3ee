"""Cointegration of pairs over many windows, from running sums of cross-products.

A pair's history is one group (a row a date). The products of the two series at all lags are summed once along it; every window's
normal equations, those of the hedge regression and of the unit-root test on its residuals with any number of lags,
are differences of these sums, so no date is copied into the windows that hold it. Lags are nested: one Cholesky factor gives the
squared residuals of every number of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.solvers import mackinnon_p


def most_lags(n: int) -> int:
    return min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)


class Sums:
    """Running sums of a, b and of their products at lags 0 to ``lags``: entry t holds the rows before t."""

    def __init__(self, a: np.ndarray, b: np.ndarray, lags: int):
        x = np.stack([a, b])
        x = x - x[:, :1]  # the test has a constant, so only the sums' accuracy rests on this; a later row changes nothing
        self.one = np.concatenate([np.zeros((2, 1)), x.cumsum(1)], 1)
        n = x.shape[1]
        self.two = np.zeros((lags + 1, 2, 2, n + 1))
        for k in range(min(lags, n - 1) + 1):
            self.two[k, :, :, k + 1 :] = (x[:, None, k:] * x[None, :, : n - k]).cumsum(2)
            # products that begin before row k are never asked for

    def single(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.one[:, hi] - self.one[:, lo]

    def product(self, i: int, j: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """(2, 2, windows): sums over t in [lo, hi) of x[t - i] y[t - j]."""
        k = abs(j - i)
        near = min(i, j)
        s = self.two[k][:, :, hi - near] - self.two[k][:, :, lo - near]
        return s if i <= j else s.transpose(1, 0, 2)


def _residual_products(sums: Sums, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """(windows, size, size): sums over t in [first, hi) of e[t - i] e[t - j], e the residuals of a on b and a constant over [lo, hi)."""
    n = (hi - lo).astype(float)
    (sa, sb), p = sums.single(lo, hi), sums.product(0, 0, lo, hi)
    spread = p[1, 1] - sb * sb / n
    with np.errstate(divide="ignore", invalid="ignore"):
        beta = np.where(spread > 0, (p[0, 1] - sa * sb / n) / spread, 0.0)
    alpha = (sa - beta * sb) / n
    m = (hi - first).astype(float)
    plain = [sums.single(first - i, hi - i) for i in range(size)]
    e = [v[0] - beta * v[1] for v in plain]  # without the constant
    out = np.empty((len(lo), size, size))
    for i in range(size):
        for j in range(i, size):
            p = sums.product(i, j, first, hi)
            out[:, i, j] = out[:, j, i] = p[0, 0] - beta * (p[0, 1] + p[1, 0]) + beta**2 * p[1, 1] - alpha * (e[i] + e[j]) + alpha**2 * m
    return out


def _equations(sums: Sums, lo: np.ndarray, hi: np.ndarray, lags: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """X'X, X'y, y'y and rows of the change of e on e a row before and ``lags`` changes, from the change number ``start`` on."""
    e = _residual_products(sums, lo, hi, lo + 1 + start, lags + 2)
    t = np.zeros((lags + 2, lags + 2))
    t[0, 1] = 1.0  # e a row before
    for k in range(1, lags + 1):
        t[k, k], t[k, k + 1] = 1.0, -1.0  # changes
    t[lags + 1, 0], t[lags + 1, 1] = 1.0, -1.0  # the change itself
    g = t @ e @ t.T
    return g[:, :-1, :-1], g[:, :-1, -1], g[:, -1, -1], hi - lo - 1 - start


def _factors(xx: np.ndarray) -> np.ndarray:
    """Cholesky factors; NaN where there is none."""
    try:
        return np.linalg.cholesky(xx)
    except np.linalg.LinAlgError:
        out = np.full_like(xx, np.nan)
        for k, m in enumerate(xx):
            try:
                out[k] = np.linalg.cholesky(m)
            except np.linalg.LinAlgError:
                continue
        return out


def _forward(factor: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.empty_like(v)
    for k in range(v.shape[1]):
        out[:, k] = (v[:, k] - (factor[:, k, :k] * out[:, :k]).sum(1)) / factor[:, k, k]
    return out


def _tau(sums: Sums, lo: np.ndarray, hi: np.ndarray, lags: int) -> np.ndarray:
    xx, xy, yy, rows = _equations(sums, lo, hi, lags, lags)
    factor = _factors(xx)
    c = _forward(factor, xy)
    unit = np.zeros_like(xy)
    unit[:, 0] = 1.0
    u = _forward(factor, unit)  # inverse's first column, before the second substitution
    with np.errstate(divide="ignore", invalid="ignore"):
        left = (yy - (c * c).sum(1)) / np.maximum(1, rows - lags - 1)
        return (u * c).sum(1) / np.sqrt(left * (u * u).sum(1))


def taus(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, lags: int | None = None) -> np.ndarray:
    """The statistic of each window [lo, hi) of rows; ``lags`` None: those of the least AIC on the rows that all numbers of lags share."""
    out = np.full(len(lo), math.nan)
    most = np.array([most_lags(n) if lags is None else lags for n in hi - lo])
    if not len(lo):
        return out
    sums = Sums(a, b, int(most.max()) + 1)
    for top in np.unique(most[most >= 0]):
        at = np.flatnonzero(most == top)
        pick = np.full(len(at), top)
        if lags is None:
            xx, xy, yy, rows = _equations(sums, lo[at], hi[at], int(top), int(top))
            c = _forward(_factors(xx), xy)
            ss = yy[:, None] - np.cumsum(c * c, 1)
            aic = rows[:, None] * (np.log(2 * math.pi * np.maximum(ss, 1e-300) / rows[:, None]) + 1) + 2 * np.arange(1, top + 2)
            pick = np.argmin(np.where(np.isnan(aic), np.inf, aic), 1)
        for k in np.unique(pick):
            on = at[pick == k]
            out[on] = _tau(sums, lo[on], hi[on], int(k))
    return out


def over_windows(table: DataFrame, ends: DataFrame, *keys: str, least: int = 252, lags: int | None = None) -> DataFrame:
    """a, b, keys, n, tau, p of the windows (a, b, keys, lo, hi) of row numbers of table (a, b, pos, la, lb); windows of fewer than ``least`` known rows go."""
    kinds = dict(ends.dtypes)
    columns = ["a", "b", *keys, "n", "tau", "p"]

    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        a, b, pos = (rows[c].to_numpy(float) for c in ("la", "lb", "pos"))
        known = ~(np.isnan(a) | np.isnan(b))
        a, b, pos = a[known], b[known], pos[known]
        lo, hi = (np.searchsorted(pos, own[c].to_numpy()) for c in ("lo", "hi"))
        enough = hi - lo >= least
        own, lo, hi = own[enough], lo[enough], hi[enough]
        tau = taus(a, b, lo, hi, lags)
        return pd.DataFrame({"a": own["_a"], "b": own["_b"], **{k: own[k] for k in keys}, "n": hi - lo, "tau": tau, "p": [mackinnon_p(t) for t in tau]}, columns=columns)

    schema = "a string, b string, " + "".join(f"{k} {kinds[k]}, " for k in keys) + "n long, tau double, p double"
    asked = ends.select(F.col("a").alias("_a"), F.col("b").alias("_b"), *keys, "lo", "hi")
    return table.select("a", "b", "pos", "la", "lb").groupBy("a", "b").cogroup(asked.groupBy("_a", "_b")).applyInPandas(run, schema)


def numbered(table: DataFrame) -> DataFrame:
    return table.withColumn("pos", F.row_number().over(Window.partitionBy("a", "b").orderBy("date")) - 1)


def rolling(table: DataFrame, window: int = 252, every: int = 21, lags: int | None = None) -> DataFrame:
    """a, b, date, n, tau, p at every ``every``-th row, from the ``window`` rows before it."""
    at = numbered(table)
    ends = at.where((F.col("pos") >= window) & ((F.col("pos") - window) % every == 0))
    ends = ends.select("a", "b", "date", (F.col("pos") - window).alias("lo"), F.col("pos").alias("hi"))
    return over_windows(at, ends, "date", least=window, lags=lags)


def by_fold(table: DataFrame, folds: DataFrame, least: int = 252) -> DataFrame:
    """fold, a, b, n, tau, p of each pair by what is known at each fold's end."""
    at = numbered(table)
    known = at.select("a", "b", "date", "pos").join(F.broadcast(folds.select("fold", "fit_end")), F.col("date") <= F.col("fit_end"))  # a row a fold
    ends = known.groupBy("a", "b", "fold").agg((F.max("pos") + 1).alias("hi")).withColumn("lo", F.lit(0))
    return over_windows(at, ends, "fold", least=least)


def best_pairs(found: DataFrame, alpha: float = 0.10, *keys: str) -> DataFrame:
    """keys, a, b, p, q: of each key's scan the pair of the least p that survives false-discovery control over the whole scan and is at most ``alpha``."""
    from panelforge.operators.performance import fdr

    family = F.concat_ws("|", F.lit("scan"), *(F.col(k).cast("string") for k in keys))
    at = fdr(found.withColumn("family", family).withColumn("name", F.concat_ws("|", "a", "b")), alpha).where(F.col("keep") & (F.col("p") <= alpha))
    best = at.groupBy(*keys).agg(F.min_by(F.struct("a", "b", "p", "q"), F.struct("p", "name")).alias("x"), F.count("*").alias("_n"))
    return best.where("_n > 0").select(*keys, "x.*")
