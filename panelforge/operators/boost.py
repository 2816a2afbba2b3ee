"""Gradient-boosted trees on histograms: many models (folds, blocks, thirds) fitted in one job.

A model's rows are one group: at most about ``SAMPLE`` of them (a hash of the row chooses), cut into at most ``BINS`` bins
a feature, so a group is bounded whatever the panel's size. A level of a tree is one sum of gradients by (node, feature, bin);
leaves are -G / (H + L2) times the rate. Groups run in parallel; a fitted model is some 20 KB,
which the driver holds and sends to the tasks that score.

A row with a null feature is neither learnt from nor scored; a group of one class has no model, and its rows no score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TREES, DEPTH, RATE, L2, BINS, LEAST, SAMPLE = 300, 3, 0.05, 1.0, 255, 20, 200_000


class Model(NamedTuple):
    """Scores before the first tree; of each tree, the inner nodes' features and thresholds (x <= threshold goes left) and the leaves; a calibration's knots."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    knots: np.ndarray | None = None


def edges(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts between bins: between neighbouring values where they are few, else at quantiles."""
    seen = np.unique(x)
    if len(seen) <= bins:
        return (seen[1:] + seen[:-1]) / 2
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def grow(codes: np.ndarray, bins: int, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, l2: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """feature, threshold of the inner nodes, leaf values (not yet times the rate) and the rows' leaves. An inner node without a gain keeps its rows on the left."""
    n, width = codes.shape
    node = np.zeros(n, np.int64)
    feature, threshold = np.zeros((1 << depth) - 1, np.int16), np.full((1 << depth) - 1, np.inf)
    flat = codes + np.arange(width) * bins
    for level in range(depth):
        size = 1 << level
        at = ((node * width * bins)[:, None] + flat).ravel()
        total = size * width * bins
        sums = [np.bincount(at, np.repeat(v, width), total).reshape(size, width, bins).cumsum(2) for v in (g, h)]
        count = np.bincount(at, minlength=total).reshape(size, width, bins).cumsum(2)
        gl, hl = sums
        gt, ht, ct = gl[:, :, -1:], hl[:, :, -1:], count[:, :, -1:]
        gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
        gain = np.where((count >= least) & (ct - count >= least), gain, 0.0).reshape(size, -1)
        best = gain.argmax(1)
        f, cut = best // bins, best % bins
        split = gain[np.arange(size), best] > 1e-12
        first = size - 1
        feature[first : first + size] = f
        threshold[first : first + size] = [cuts[a][c] if s else np.inf for a, c, s in zip(f, cut, split, strict=True)]
        right = split[node] & (codes[np.arange(n), f[node]] > cut[node])
        node = node * 2 + right
    gs, hs = (np.bincount(node, v, 1 << depth) for v in (g, h))
    return feature, threshold, -gs / (hs + l2), node


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, l2: float = L2, bins: int = BINS, least: int = LEAST) -> Model | None:
    """A model of P(y = 1), or None if the labels have one class."""
    w = np.ones(len(y)) if w is None else w
    mean = float(np.average(y, weights=w)) if len(y) and w.sum() > 0 else 0.0
    if not 0 < mean < 1:
        return None
    cuts = [edges(c, bins) for c in x.T]
    codes = np.stack([np.searchsorted(e, c) for e, c in zip(cuts, x.T, strict=True)], 1)
    width = max(2, max(len(e) for e in cuts) + 1)
    cuts = [np.append(e, np.full(width - len(e), np.inf)) for e in cuts]
    base = float(np.log(mean / (1 - mean)))
    raw, made = np.full(len(y), base), []
    for _ in range(trees):
        p = _sigmoid(raw)
        f, t, leaf, node = grow(codes, width, w * (p - y), w * p * (1 - p), cuts, depth, l2, least)
        made.append((f, t, leaf * rate))
        raw += leaf[node] * rate
    f, t, leaf = (np.stack(v) for v in zip(*made, strict=True))
    return Model(base, f, t, leaf)


def raw_scores(model: Model, x: np.ndarray, block: int = 8192) -> np.ndarray:
    out = np.full(len(x), model.base)
    depth = model.leaf.shape[1].bit_length() - 1
    for lo in range(0, len(x), block):
        part = x[lo : lo + block]
        rows = np.arange(len(part))
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = np.zeros(len(part), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[rows, f[node]] > t[node])
            out[lo : lo + block] += leaf[node - ((1 << depth) - 1)]
    return out


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    """P(y = 1), calibrated where the model has knots: (raw, P) pairs, or two parameters of a logistic."""
    raw = raw_scores(model, x)
    if model.knots is None:
        return _sigmoid(raw)
    if model.knots.ndim == 1:
        return _sigmoid(model.knots[0] * raw + model.knots[1])
    return np.interp(raw, *model.knots)


def isotonic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Knots of the non-decreasing step means of y in the order of x (pools of adjacent violators)."""
    seen, at = np.unique(x, return_inverse=True)
    size, total = np.bincount(at).astype(float), np.bincount(at, y)
    pools: list[list[float]] = []
    for k in range(len(seen)):
        pools.append([seen[k], seen[k], total[k], size[k]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, hi, s, n = pools.pop()
            pools[-1][1:] = [hi, pools[-1][2] + s, pools[-1][3] + n]
    xs = np.array([v for lo, hi, _, _ in pools for v in (lo, hi)])
    ys = np.array([s / n for _, _, s, n in pools for _ in range(2)])
    return np.stack([xs, ys])


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Slope and intercept of P(y = 1) by Newton's steps, with the two classes' targets drawn in a little, as by one more case of each."""
    up = y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (len(y) - up + 2))
    q, design = np.zeros(2), np.stack([x, np.ones(len(x))], 1)
    for _ in range(steps):
        p = _sigmoid(design @ q)
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (p - target))
        q = q - step
        if np.abs(step).max() < 1e-10:
            break
    return q


def bounded(rows: DataFrame, keys: Sequence[str], features: Sequence[str], sample: int) -> DataFrame:
    """About ``sample`` rows of each key at most, chosen by a hash of the row: all of fewer."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    turn = F.pmod(F.xxhash64(*keys, *features), F.lit(1 << 30))
    return rows.join(n, list(keys)).where((F.col("_n") <= sample) | (turn < F.lit(float(1 << 30)) * sample / F.col("_n"))).drop("_n")


def fit_all(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "y", weight: str | None = None, held: str | None = None, calibrate: str | None = None, sample: int = SAMPLE, **params) -> dict[tuple, Model]:
    """A model of each key. Rows for which ``held`` is true aren't learnt from: with ``calibrate`` (isotonic, sigmoid) they calibrate the model."""
    if calibrate not in (None, "isotonic", "sigmoid"):
        raise ValueError(f"unknown calibration: {calibrate!r}")
    at = rows.dropna(subset=[*features, label, *([weight] if weight else [])])
    extra = {"_w": F.col(weight).cast("double") if weight else F.lit(1.0), "_held": F.col(held) if held else F.lit(False)}
    at = at.select(*keys, *(F.col(c).cast("double").alias(c) for c in features), F.col(label).cast("double").alias("_y"), *(v.alias(k) for k, v in extra.items()))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*features, "_y"], kind="stable")  # however Spark has dealt the rows
        learn, rest = pdf[~pdf["_held"].astype(bool)], pdf[pdf["_held"].astype(bool)]
        model = fit(learn[list(features)].to_numpy(float), learn["_y"].to_numpy(float), learn["_w"].to_numpy(float), **params)
        if model is None or (calibrate and not len(rest)):
            return pd.DataFrame([], columns=columns)
        knots = b""
        if calibrate:
            raw, y = raw_scores(model, rest[list(features)].to_numpy(float)), rest["_y"].to_numpy(float)
            knots = (isotonic(raw, y) if calibrate == "isotonic" else logistic(raw, y)).tobytes()
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), model.base, model.feature.tobytes(), model.threshold.tobytes(), model.leaf.tobytes(), knots]], columns=columns)

    columns = [*keys, "base", "feature", "threshold", "leaf", "knots"]
    kinds = dict(rows.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "base double, feature binary, threshold binary, leaf binary, knots binary"
    trees, depth = params.get("trees", TREES), params.get("depth", DEPTH)
    shape = lambda b, n, kind=float: np.frombuffer(b, kind).reshape(trees, n)
    out = {}
    for r in bounded(at, keys, [*features, "_y"], sample).groupBy(*keys).applyInPandas(run, schema).toLocalIterator():  # a model a key
        knots = np.frombuffer(r.knots) if r.knots else None
        knots = knots.reshape(2, -1) if calibrate == "isotonic" else knots
        out[tuple(r[k] for k in keys)] = Model(r.base, shape(r.feature, (1 << depth) - 1, np.int16), shape(r.threshold, (1 << depth) - 1), shape(r.leaf, 1 << depth), knots)
    return out


def score_all(models: dict[tuple, Model], rows: DataFrame, keys: Sequence[str], features: Sequence[str], out: str = "p") -> DataFrame:
    """The rows whose key has a model and whose features are known, with P(y = 1) by that model."""
    sent = rows.sparkSession.sparkContext.broadcast(models)  # some 20 KB a key
    at = rows.drop(out).dropna(subset=list(features))
    schema = T.StructType([*at.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            x = np.stack([col(f).to_numpy(zero_copy_only=False).astype(float) for f in features], 1)
            own = list(zip(*(col(k).to_pylist() for k in keys), strict=True)) if keys else [()] * b.num_rows
            p, known = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            number: dict[tuple, int] = {}
            of = np.array([number.setdefault(k, len(number)) for k in own], np.int64)
            for k, i in number.items():
                if k in sent.value:
                    on = of == i
                    p[on], known[on] = probability(sent.value[k], x[on]), True
            yield pa.record_batch([*b.columns, pa.array(p)], [*b.schema.names, out]).filter(pa.array(known))

    return at.mapInArrow(run, schema)
