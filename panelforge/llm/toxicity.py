"""Operator 7: toxicity by a factorization machine over hashed terms.

A text is the set of its terms: runs of letters (bytes above 127 count as
letters), lower-cased, and the first ``STEMS`` bytes of each, which inflected and compound
words share; all hashed to 32 bits. The score is the logistic of

    b + sum w_j + 1/2 sum_f ((sum v_jf)^2 - sum v_jf^2),

so pairs such as insult and group mention have weights of their own.
Fitting uses at most about ``SAMPLE`` labelled documents (a hash of the id
chooses). Their terms are hashed where the texts are, and one task fits the model on the term sets of the sample, which
bound it: document frequencies count over the whole sample, and how rows are dealt changes nothing. A term found in
``MIN_DOCS`` documents has a linear weight, fitted by FTRL with L1, and
factors, fitted by adaptive gradient steps after a first pass for the linear part. A step
moves a document's own logit by its error at most: long texts, whose terms all move at once,
would overshoot otherwise. Factors start from a hash of the term.

Edge cases: null and empty texts get the score of the bias; without any settled
training label every score is 0.5, and ``keep`` rejects nothing; labels of one class teach a bias towards it; repeated rows
get equal scores; very long texts count as the set of their terms; documents with contradictory labels are not learnt from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_sample, settled_labels, sliced, word_hashes

SAMPLE = 12_000
MIN_DOCS = 5
EPOCHS = 8
FACTORS = 4
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.5
V_RATE, V_L2 = 0.2, 0.002
STEMS = (4, 5, 6, 7, 8)

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> np.ndarray:
    """The 32-bit hashes of a text's terms, each once, in order."""
    words = set((text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    stems = {b"^" + w[:n] for w in words for n in STEMS if len(w) >= n}
    return np.unique((word_hashes([*words, *stems]) >> np.uint64(32)).astype(np.uint32))


def _start(ids: np.ndarray, factors: int, width: float) -> np.ndarray:
    """Factors within +-width that depend on the term alone."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64)[:, None] + np.arange(1, factors + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B9)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h >> np.uint64(40)).astype(float) / (1 << 24) - 0.5) * 2 * width


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def logit(at: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float) -> float:
    """The score before the logistic of a document whose terms are the rows ``at`` of w and v."""
    total = v[at].sum(0)
    return float(bias + w[at].sum() + 0.5 * (total @ total - (v[at] ** 2).sum()))


def train(rows: list[np.ndarray], y: np.ndarray, size: int, ids: np.ndarray, epochs: int, factors: int) -> tuple[np.ndarray, np.ndarray]:
    """w (the last is the bias) and V. rows hold indexes into ids."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    width = 0.5 / np.sqrt(max(1.0, np.mean([len(r) for r in rows]))) if rows else 0.0  # a text's chance pairs add little, whatever its length
    v, seen = _start(ids, factors, width), np.full((size, factors), 1e-3)
    penalty = np.append(np.full(size, L1), 0.0)

    def weights(at):
        zz, p = z[at], penalty[at]
        return np.where(np.abs(zz) <= p, 0.0, -(zz - np.sign(zz) * p) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for epoch in range(epochs):
        for r, label in zip(rows, y, strict=True):
            at = np.append(r, size)
            w, vv = weights(at), v[r]
            total = vv.sum(0)
            g = float(_sigmoid(w.sum() + 0.5 * (total @ total - (vv * vv).sum())) - label)
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
            if epoch and len(r):
                gap = total - vv
                gv = g * gap + V_L2 * vv
                seen[r] += gv * gv
                step = gv / np.sqrt(seen[r])
                reach = abs(float((step * gap).sum()))
                v[r] = vv - min(V_RATE, abs(g) / max(reach, 1e-12)) * step
    return weights(np.arange(size + 1)), v


def _places(found: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where the known ones of a text's terms stand in ids."""
    at = np.searchsorted(ids, found)
    return at[ids[np.minimum(at, len(ids) - 1)] == found].astype(np.int32) if len(ids) else np.empty(0, np.int32)


def _term_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a batch: the documents' turns, labels, numbers of terms and terms."""
    for b in sliced(batches):
        found = [terms(x.as_py()) for x in b.column(1)]
        if found:
            turn, label = (b.column(k).to_numpy().astype(np.int64).tobytes() for k in (0, 2))
            parts = (turn, label, np.array([len(f) for f in found], np.int64).tobytes(), np.concatenate(found).tobytes())
            yield pa.record_batch([pa.array([0])] + [pa.array([x], pa.binary()) for x in parts], ["one", "turn", "label", "size", "terms"])


def _fit_all(epochs: int, factors: int, min_docs: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        turn, label, size = (np.concatenate([np.frombuffer(x, np.int64) for x in pdf[c]]) for c in ("turn", "label", "size"))
        found = np.split(np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["terms"]]), np.cumsum(size)[:-1])
        order = np.argsort(turn, kind="stable")
        ids, counts = np.unique(np.concatenate(found), return_counts=True)
        ids = ids[counts >= min_docs]
        w, v = train([_places(found[k], ids) for k in order], label[order].astype(float), len(ids), ids, epochs, factors)
        return pd.DataFrame({"term": np.append(ids.astype(np.int64), -1), "w": w, "v": [*v.tolist(), [0.0] * factors]})

    return fit


def fit(documents: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE, epochs: int = EPOCHS, factors: int = FACTORS, min_docs: int = MIN_DOCS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Terms in order, their weights and factors, the bias. ``labels`` holds training rows only."""
    chosen = bounded_sample(settled_labels(labels, column), sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most about ``sample`` rows of 12 bytes
    rows = rows.select(F.xxhash64("doc_id", F.lit(5)).alias("turn"), "text", "label")
    sets = rows.mapInArrow(_term_sets, "one long, turn binary, label binary, size binary, terms binary")
    model = sets.groupBy("one").applyInPandas(_fit_all(epochs, factors, min_docs), "term long, w double, v array<double>").toPandas()  # bounded by the sample
    if model.empty:
        return np.empty(0, np.uint32), np.empty(0), np.empty((0, factors)), 0.0
    model = model.sort_values("term")
    bias, model = float(model["w"].iloc[0]), model.iloc[1:]
    return model["term"].to_numpy(np.uint32), model["w"].to_numpy(), np.array(model["v"].tolist()).reshape(-1, factors), bias


def _logits(texts, model: tuple) -> np.ndarray:
    ids, w, v, bias = model
    out = np.full(len(texts), float(bias))
    for i, text in enumerate(texts if len(ids) else ()):
        out[i] = logit(_places(terms(text.as_py()), ids), w, v, bias)
    return out


def score(documents: DataFrame, model: tuple, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            p = _sigmoid(_logits(b.column(1), sent.value))
            yield pa.record_batch([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep(documents: DataFrame, model: tuple, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, unchanged, that score below the threshold: no join. A model that has learnt nothing rejects nothing."""
    if not len(model[0]) and model[3] == 0.0:
        return documents
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield b.filter(pa.array(_sigmoid(_logits(b.column(at), sent.value)) < threshold))

    return documents.mapInArrow(run, documents.schema)
