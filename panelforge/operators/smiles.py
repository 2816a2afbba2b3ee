"""Smile fits: raw SVI and SSVI, slices and surfaces, many at once.

Spark gathers a slice (or a surface) into one row, bounded by its strikes; a task fits its
rows side by side in numpy: one damped Gauss-Newton iteration moves all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SURFACE = ("underlying", "as_of")
SLICE = (*SURFACE, "expiry")
TOGETHER = 256

# Bounds, penalty and margin of the fits, the least points of a slice, the pad of the butterfly grid.
PENALTY, MARGIN, LEAST, PAD, GRID = 1e4, 1e-3, 5, 0.5, 200
SVI_LOW, SVI_HIGH = (-np.inf, 0.0, -0.999, -np.inf, 1e-6), (np.inf, np.inf, 0.999, np.inf, np.inf)
SSVI_LOW, SSVI_HIGH = (1e-8, -0.999, 1e-6), (np.inf, 0.999, np.inf)


def least_squares(residual: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 80, tolerance: float = 1e-12) -> np.ndarray:
    """Rows of parameters within bounds that make each row's sum of squares small.

    ``residual(x, at)`` gives the residuals of the rows ``at``. Each row has a damping of its own; rows that have settled leave the iteration.
    """
    x = np.clip(x.astype(float), low, high)
    at = np.arange(len(x))
    r = residual(x, at)
    loss, damp = (r * r).sum(1), np.full(len(x), 1e-2)
    calm = np.zeros(len(x), int)
    for _ in range(steps):
        if not len(at):
            break
        own = x[at]
        h = 1e-7 * np.maximum(1e-2, np.abs(own))
        h = np.where(own + h > high, -h, h)
        jac = np.empty((len(at), r.shape[1], x.shape[1]))
        for p in range(x.shape[1]):
            moved = own.copy()
            moved[:, p] += h[:, p]
            jac[:, :, p] = (residual(moved, at) - r) / h[:, p, None]
        grad = np.einsum("srp,sr->sp", jac, r)
        stuck = ((own <= low) & (grad > 0)) | ((own >= high) & (grad < 0))  # a bound that holds a parameter takes it out of the step
        jac = np.where(stuck[:, None, :], 0.0, jac)
        grad = np.where(stuck, 0.0, grad)
        normal = np.einsum("srp,srq->spq", jac, jac)
        scale = np.maximum(np.einsum("spp->sp", normal), 1e-12)
        normal[:, np.arange(x.shape[1]), np.arange(x.shape[1])] += damp[at, None] * scale
        new = np.clip(own - np.linalg.solve(normal, grad[:, :, None])[:, :, 0], low, high)
        r_new = residual(new, at)
        loss_new = (r_new * r_new).sum(1)
        better = loss_new < loss[at]
        gained = np.where(better, loss[at] - loss_new, 0.0) > tolerance * loss[at] + 1e-18
        x[at[better]], loss[at[better]] = new[better], loss_new[better]
        r = np.where(better[:, None], r_new, r)
        damp[at] = np.where(better, damp[at] * 0.3, np.minimum(damp[at] * 5, 1e10))
        calm[at] = np.where(gained, 0, calm[at] + 1)
        on = calm[at] < 6
        at, r = at[on], r[on]
    return x


def svi(k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Total variance of rows of (a, b, rho, m, sigma) at rows of log-moneyness."""
    a, b, rho, m, sigma = (p[:, i, None] for i in range(5))
    return a + b * (rho * (k - m) + np.sqrt((k - m) ** 2 + sigma**2))


def svi_g(k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The density factor g, negative where a slice admits a butterfly."""
    _, b, rho, m, sigma = (p[:, i, None] for i in range(5))
    c = k - m
    root = np.sqrt(c * c + sigma * sigma)
    w = np.maximum(svi(k, p), 1e-12)
    w1, w2 = b * (rho + c / root), b * sigma * sigma / root**3
    return (1 - k * w1 / (2 * w)) ** 2 - w1 * w1 / 4 * (1 / w + 0.25) + w2 / 2


def _svi_start(k: np.ndarray, w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """For given m and sigma a slice is linear in three parameters: the best of a grid of (m, sigma)."""
    on = s > 0
    lo, hi = np.where(on, k, np.inf).min(1), np.where(on, k, -np.inf).max(1)
    best, out = np.full(len(k), np.inf), np.zeros((len(k), 5))
    for share in np.linspace(0, 1, 9):
        m = lo + share * (hi - lo)
        for sigma in (0.02, 0.05, 0.1, 0.2, 0.4, 0.8):
            c = k - m[:, None]
            x = np.stack([np.ones_like(k), c, np.sqrt(c * c + sigma * sigma)], 2) * s[:, :, None]
            n = np.einsum("snp,snq->spq", x, x) + 1e-12 * np.eye(3)
            a, tilt, b = np.moveaxis(np.linalg.solve(n, np.einsum("snp,sn->sp", x, w * s)[:, :, None])[:, :, 0], 1, 0)
            b = np.maximum(b, 1e-6)
            p = np.stack([a, b, np.clip(tilt / b, -0.99, 0.99), m, np.full(len(k), sigma)], 1)
            loss = (((svi(k, p) - w) * s) ** 2).sum(1)
            hit = loss < best
            best, out[hit] = np.where(hit, loss, best), p[hit]
    return out


def svi_fit(k: np.ndarray, w: np.ndarray, s: np.ndarray, no_butterfly: bool = False) -> np.ndarray:
    """Rows of (a, b, rho, m, sigma). s is the square root of each point's weight, 0 for a pad. With ``no_butterfly`` g below a margin on a padded grid is penalised."""
    low, high = np.array(SVI_LOW), np.array(SVI_HIGH)
    p = least_squares(lambda x, at: (svi(k[at], x) - w[at]) * s[at], _svi_start(k, w, s), low, high)
    if not no_butterfly:
        return p
    lo, hi = np.where(s > 0, k, np.inf).min(1) - PAD, np.where(s > 0, k, -np.inf).max(1) + PAD
    grid = lo[:, None] + (hi - lo)[:, None] * np.linspace(0, 1, GRID)
    bad = np.flatnonzero((svi_g(grid, p) < MARGIN).any(1))
    if len(bad):
        kk, ww, ss, gg = k[bad], w[bad], s[bad], grid[bad]

        def residual(x, at):
            return np.concatenate([(svi(kk[at], x) - ww[at]) * ss[at], np.sqrt(PENALTY) * np.maximum(MARGIN - svi_g(gg[at], x), 0.0)], 1)

        p[bad] = least_squares(residual, p[bad], low, high)
    return p


def ssvi(k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Total variance of rows of (theta, rho, psi)."""
    theta, rho, psi = (p[:, i, None] for i in range(3))
    u = psi * k
    return theta / 2 * (1 + rho * u + np.sqrt((u + rho) ** 2 + 1 - rho * rho))


def _at_money(k: np.ndarray, w: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Each row's total variance at the forward, linear between points; the least one where all lie on one side."""
    out = np.empty(len(k))
    for i in range(len(k)):
        x, y = k[i, on[i]], w[i, on[i]]
        o = np.argsort(x)
        out[i] = np.interp(0.0, x[o], y[o]) if x.min() <= 0 <= x.max() else y.min()
    return out


def _over(theta: np.ndarray, rho: np.ndarray, psi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the two sufficient conditions against butterflies are exceeded."""
    factor = theta * (1 + np.abs(rho))
    return np.maximum(factor * psi - (4 - MARGIN), 0.0), np.maximum(factor * psi**2 - (4 - MARGIN), 0.0)


def ssvi_fit(k: np.ndarray, w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Rows of (theta, rho, psi), kept within the conditions against butterflies by a penalty."""

    def residual(x, at):
        c1, c2 = _over(x[:, 0], x[:, 1], x[:, 2])
        return np.concatenate([(ssvi(k[at], x) - w[at]) * s[at], np.sqrt(PENALTY) * np.stack([c1, c2], 1)], 1)

    start = np.stack([np.maximum(_at_money(k, w, s > 0), 1e-4), np.full(len(k), -0.3), np.ones(len(k))], 1)
    return least_squares(residual, start, np.array(SSVI_LOW), np.array(SSVI_HIGH))


def surface_fit(k: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rho, eta, gamma, thetas) of surfaces with equally many maturities: k, w, s are (surface, maturity, point).

    One skew and one power law psi = eta * theta ** -gamma for all maturities. theta is a base and steps
    of 0 or more, so it does not fall in time; butterflies and the bound of d(theta psi)/dtheta are penalised.
    """
    n, m, q = k.shape
    flat = lambda x: x.reshape(-1, q)
    atm = np.maximum(_at_money(flat(k), flat(w), flat(s) > 0).reshape(n, m), 1e-4)
    start = np.concatenate([np.tile([-0.3, 1.0, 0.5], (n, 1)), atm[:, :1], np.maximum(np.diff(atm, axis=1), 1e-6)], 1)
    low = np.array([-0.999, 1e-6, 1e-3, 1e-8, *[0.0] * (m - 1)])
    high = np.array([0.999, np.inf, 1.0, np.inf, *[np.inf] * (m - 1)])

    def residual(x, at):
        rho, eta, gamma = (x[:, i, None] for i in range(3))
        theta = np.cumsum(x[:, 3:], axis=1)
        psi = eta * theta**-gamma
        p = np.stack([theta, np.broadcast_to(rho, theta.shape), psi], 2).reshape(-1, 3)
        gap = ((ssvi(flat(k[at]), p).reshape(len(at), m, q) - w[at]) * s[at]).reshape(len(at), -1)
        c1, c2 = _over(theta, rho, psi)
        square = np.maximum(rho * rho, 1e-12)
        steep = np.maximum(eta * (1 - gamma) * theta**-gamma - (1 + np.sqrt(1 - rho * rho)) / square, 0.0)
        return np.concatenate([gap, np.sqrt(PENALTY) * c1, np.sqrt(PENALTY) * c2, np.sqrt(PENALTY) * steep], 1)

    x = least_squares(residual, start, low, high, 120)
    return x[:, 0], x[:, 1], x[:, 2], np.cumsum(x[:, 3:], axis=1)


def _padded(rows: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k, w and the square root of 1 / spread of rows of points, 0 in pads."""
    k, w, s = np.zeros((len(rows), width)), np.zeros((len(rows), width)), np.zeros((len(rows), width))
    for i, points in enumerate(rows):
        for j, x in enumerate(points):
            k[i, j], w[i, j] = x["log_moneyness"], x["total_variance"]
            spread = x["spread"]
            s[i, j] = np.sqrt(1 / spread) if spread is not None and spread > 0 else 1.0
    return k, w, s


def _slices(points: DataFrame, least: int) -> DataFrame:
    """A row a slice with its points in order: bounded by the strikes of one expiry."""
    x = F.struct(*(F.col(c).cast("double").alias(c) for c in ("log_moneyness", "total_variance", "spread")))
    at = points.where("log_moneyness IS NOT NULL AND total_variance IS NOT NULL").groupBy(*SLICE).agg(F.array_sort(F.collect_list(x)).alias("points"), F.min("tte").alias("tte"))
    return at.where(F.size("points") >= least)


def _once(rows: DataFrame, shape: str, run: Callable, schema: str, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what ``run`` gives for their ``shape``: equal shapes are fitted once. ``kept`` may write the fits, so that Spark knows their size before it joins."""
    shapes = rows.select(shape).distinct().repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, shape)  # small rows, long work a row
    return rows.join(kept(shapes.mapInPandas(run, schema)), shape).drop(shape)


def _as_it_is(made: DataFrame) -> DataFrame:
    return made


def _fitted(points: DataFrame, names: tuple[str, ...], fit: Callable, model: Callable, least: int, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """SLICE, tte, the parameters, rmse and n of each slice."""
    rows = _slices(points, least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[lo : lo + TOGETHER]
                n = part["points"].map(len).to_numpy()
                k, w, s = _padded(part["points"].tolist(), int(n.max()))
                p = fit(k, w, s)
                gap = np.where(s > 0, model(k, p) - w, 0.0)
                out = part[["points"]].copy()
                for i, c in enumerate(names):
                    out[c] = p[:, i]
                out["rmse"], out["n"] = np.sqrt((gap * gap).sum(1) / n), n
                yield out

    schema = f"points {dict(rows.dtypes)['points']}" + "".join(f", {c} double" for c in (*names, "rmse")) + ", n long"
    return _once(rows, "points", run, schema, kept).select(*SLICE, "tte", *names, "rmse", "n")


def svi_slices(points: DataFrame, no_butterfly: bool = False, least: int = LEAST, kept: Callable[[DataFrame], DataFrame] = _as_it_is) -> DataFrame:
    """SLICE, tte, a, b, rho, m, sigma, rmse, n of each slice of ``least`` points or more, weighed by 1 / spread."""
    return _fitted(points, ("a", "b", "rho", "m", "sigma"), lambda k, w, s: svi_fit(k, w, s, no_butterfly), svi, least, kept)


def ssvi_slices(points: DataFrame, least: int = LEAST, kept: Callable[[DataFrame], DataFrame] = _as_it_is) -> DataFrame:
    """SLICE, tte, theta, rho, psi, rmse, n of each slice."""
    return _fitted(points, ("theta", "rho", "psi"), ssvi_fit, ssvi, least, kept)


def ssvi_surfaces(points: DataFrame, least: int = LEAST, kept: Callable[[DataFrame], DataFrame] = _as_it_is) -> DataFrame:
    """SURFACE, tte, rho, eta, gamma, theta, psi, rmse, n: one surface a key, a row a maturity. Keys with fewer than two maturities of ``least`` points have none."""
    one = _slices(points, least).groupBy(*SURFACE).agg(F.array_sort(F.collect_list(F.struct("tte", "points"))).alias("mats")).where(F.size("mats") >= 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for m, group in pdf.groupby(pdf["mats"].map(len)):
                for lo in range(0, len(group), TOGETHER):
                    part = group.iloc[lo : lo + TOGETHER]
                    mats = part["mats"].tolist()
                    width = max(len(x["points"]) for row in mats for x in row)
                    k, w, s = (x.reshape(len(part), m, width) for x in _padded([x["points"] for row in mats for x in row], width))
                    rho, eta, gamma, theta = surface_fit(k, w, s)
                    psi = eta[:, None] * theta ** -gamma[:, None]
                    p = np.stack([theta, np.broadcast_to(rho[:, None], theta.shape), psi], 2).reshape(-1, 3)
                    gap = np.where(s > 0, ssvi(k.reshape(-1, width), p).reshape(k.shape) - w, 0.0)
                    n = (s > 0).sum(2)
                    rmse = np.sqrt((gap * gap).sum(2) / n)
                    values = np.stack([np.broadcast_to(x, theta.shape) for x in ([[y["tte"] for y in row] for row in mats], rho[:, None], eta[:, None], gamma[:, None], theta, psi, rmse)], 2)
                    out = part[["mats"]].copy()
                    out["fits"] = [[(*map(float, v), int(c)) for v, c in zip(*row, strict=True)] for row in zip(values, n, strict=True)]
                    yield out

    names = ("tte", "rho", "eta", "gamma", "theta", "psi", "rmse")
    schema = f"mats {dict(one.dtypes)['mats']}, fits array<struct<{', '.join(f'{c}: double' for c in names)}, n: long>>"
    return _once(one, "mats", run, schema, kept).select(*SURFACE, F.explode("fits").alias("x")).select(*SURFACE, "x.*")


def butterfly_free(theta: Column, rho: Column, psi: Column, tolerance: float = 1e-9) -> Column:
    """Whether a slice meets the sufficient conditions against butterflies."""
    factor = theta * (1 + F.abs(rho))
    return (theta > 0) & (psi > 0) & (F.abs(rho) < 1) & (factor * psi < 4 + tolerance) & (factor * psi * psi <= 4 + tolerance)


def surface_checks(surfaces: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """SURFACE, butterfly_free, calendar_free by the sufficient conditions, of rows (SURFACE, tte, theta, rho, eta, gamma, psi).

    Calendar: theta does not fall, and d(theta psi)/dtheta lies between 0 and (1 + sqrt(1 - rho^2)) / rho^2.
    """
    before = F.lag("theta").over(Window.partitionBy(*SURFACE).orderBy("tte"))
    rho = F.col("rho")
    slope = F.col("eta") * (1 - F.col("gamma")) * F.pow("theta", -F.col("gamma"))
    most = F.try_divide(1 + F.sqrt(1 - rho * rho), rho * rho)
    fine = F.coalesce(F.col("theta") - before >= -tolerance, F.lit(True)) & (slope >= -tolerance) & F.coalesce(slope <= most + tolerance, F.lit(True))
    at = surfaces.withColumn("_c", fine).withColumn("_b", butterfly_free(F.col("theta"), rho, F.col("psi")))
    return at.groupBy(*SURFACE).agg(F.bool_and("_b").alias("butterfly_free"), F.bool_and("_c").alias("calendar_free"))


def pointwise_calendar(surfaces: DataFrame, points: int = 101, edge: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    """SURFACE, worst (the largest fall of total variance to the next maturity on a grid of log-moneyness; null with one maturity) and calendar_free."""
    w = Window.partitionBy(*SURFACE).orderBy("tte")
    cols = ("theta", "rho", "psi")
    at = surfaces.select(*SURFACE, *cols, *(F.lag(c).over(w).alias(f"{c}0") for c in cols))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: -edge + i * (2 * edge / (points - 1))))
    at = at.withColumn("k", grid)

    def total(theta, rho, psi):
        u = psi * F.col("k")
        return theta / 2 * (1 + rho * u + F.sqrt((u + rho) * (u + rho) + 1 - rho * rho))

    fall = total(*(F.col(f"{c}0") for c in cols)) - total(*map(F.col, cols))
    return at.groupBy(*SURFACE).agg(F.max(fall).alias("worst")).withColumn("calendar_free", F.coalesce(F.col("worst") <= tolerance, F.lit(True)))


def to_svi(slices: DataFrame) -> DataFrame:
    """The raw SVI parameters a, b, m, sigma (rho is its own) of rows (theta, rho, psi): an exact map."""
    t, r, p = F.col("theta"), F.col("rho"), F.col("psi")
    return slices.withColumns({"a": t / 2 * (1 - r * r), "b": t * p / 2, "m": -r / p, "sigma": F.sqrt(1 - r * r) / p})
