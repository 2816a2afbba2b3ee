"""Operator 2: quality by hashed word n-grams, a logistic regression fitted with
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot products.

Features of a text are the relative frequencies of its word unigrams and
bigrams and of the unigrams and bigrams of its word shapes (letters and digits
reduced to their kind, so that unseen words share features), each hashed into
``2 ** BITS`` slots. A score reads the text alone.

Fitting uses at most about ``SAMPLE`` labelled documents (a hash of the id
chooses). They are dealt over ``SHARDS`` tasks; each runs FTRL over its own and
returns its non-zero weights, and the mean over the shards that had rows is the model. L1 keeps it
sparse; at worst it holds ``2 ** BITS`` numbers, whatever the input's size, which
bounds the broadcast.

Edge cases: null and empty texts have no features and get the score of the bias
alone; without any settled training label every score is 0.5; repeated rows get
equal scores; documents with contradictory labels are not learnt from; a very long text
counts whole (its n-grams' relative frequencies), in memory in proportion to it; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_sample, mixed, settled_labels, sliced, word_hashes

BITS = 20
SAMPLE = 16_000
SHARDS = 8
EPOCHS = 4
SCALE = 16.0
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.5, 0.1

_KIND = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"A{2,}|a{2,}|0{2,}")
_SHAPES: dict[bytes, int] = {}


def _shape_hashes(shapes: list[bytes]) -> np.ndarray:
    new = set(shapes) - _SHAPES.keys()
    if len(_SHAPES) + len(new) > 200_000:
        _SHAPES.clear()
        new = set(shapes)
    if new:
        names = list(new)
        _SHAPES.update(zip(names, word_hashes(names).tolist(), strict=True))
    return np.fromiter(map(_SHAPES.__getitem__, shapes), np.uint64, len(shapes))


def slots(text: str | None, bits: int = BITS) -> np.ndarray:
    """The slot of every n-gram of a text, repeats included."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.int64)
    shapes = _RUNS.sub(lambda m: m.group()[:2], raw.translate(_KIND)).split()
    w, s = word_hashes(words), _shape_hashes(shapes)
    same = np.where(w[1:] == w[:-1], np.uint64(1), np.uint64(2))
    grams = [mixed(w), mixed(w[1:], w[:-1]), mixed(s, s ^ np.uint64(5)), mixed(s[1:], s[:-1], same), mixed(same)]
    return (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int) -> np.ndarray:
    """Weights after FTRL-proximal passes; the last slot is the bias."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for (at, x), label in zip(rows, y, strict=True):
            w = weights(at)
            g = (_sigmoid(w @ x) - label) * x
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    return weights(np.arange(size + 1))


def _fit_shard(bits: int, epochs: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "doc_id"], kind="stable")
        rows = []
        for text in pdf["text"]:
            at, counts = np.unique(slots(text, bits), return_counts=True)
            x = counts / max(1, counts.sum()) * SCALE
            rows.append((np.append(at, 1 << bits), np.append(x, 1.0)))
        w = ftrl(rows, pdf["label"].to_numpy(float), 1 << bits, epochs)
        at = np.append(np.flatnonzero(w[:-1]), 1 << bits)
        return pd.DataFrame({"slot": at.astype(np.int64), "w": w[at], "rows": (at == 1 << bits).astype(np.int32)})

    return fit


def fit(documents: DataFrame, labels: DataFrame, column: str = "quality", bits: int = BITS, sample: int = SAMPLE, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """The mean of the shards' weights. ``labels`` holds training rows only."""
    chosen = bounded_sample(settled_labels(labels, column), sample)
    rows = (
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most about ``sample`` rows of 12 bytes
        .withColumn("turn", F.xxhash64("doc_id", F.lit(3)))
        .withColumn("shard", F.pmod("turn", F.lit(shards)))
    )
    models = rows.groupBy("shard").applyInPandas(_fit_shard(bits, epochs), "slot long, w double, rows int")
    models = models.groupBy("slot").agg(F.sum("w").alias("w"), F.sum("rows").alias("rows")).toPandas()  # a bounded model
    w = np.zeros((1 << bits) + 1)
    w[models["slot"]] = models["w"] / max(1, int(models["rows"].sum()))  # one row of a shard's counts it
    return w


def score(documents: DataFrame, weights: np.ndarray, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""
    at = np.flatnonzero(weights)
    model = documents.sparkSession.sparkContext.broadcast((at, weights[at].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, val = model.value
        w = np.zeros((1 << bits) + 1, np.float32)
        w[idx] = val
        for b in sliced(batches):
            out = np.empty(b.num_rows)
            for i, text in enumerate(b.column(1)):
                at = slots(text.as_py(), bits)
                out[i] = float(w[-1]) + (float(w[at].sum(dtype=np.float64)) / len(at) * SCALE if len(at) else 0.0)
            p = _sigmoid(out)
            yield pa.record_batch([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
