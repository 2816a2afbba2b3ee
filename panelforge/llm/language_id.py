"""Operator 4: language by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds all languages: its slot s is a mask whose bit l
says that some n-gram of language l hashes to s. The AND of an n-gram's slots
names every language that holds it, in one lookup. Per-language popcounts over a
text's n-grams, corrected for the filter's own false positives (known from how
full each language's slice is), decide.

N-grams are runs of ``SIZES`` bytes of the lower-cased text with all but letters
made blanks. A language learns the n-grams that make up at least ``SHARE`` of
its own, whoever else has them: the filter says who does, and the counts decide. Counts come from at
most about ``SAMPLE`` labelled documents (a hash of the id chooses), aggregated by
Spark; the filter has ``2 ** BITS`` slots of 64 bits, whatever the input's size.

A very long text is handled whole, its n-grams in pieces that overlap.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; where
nothing can be learnt every text is ``und``; of equal counts the language first in
code-point order wins; null languages teach nothing; more than 64 languages raise
ValueError; other columns are ignored; repeated rows get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_sample, sliced

SIZES = (3, 4)
BITS = 18
SAMPLE = 20_000
SHARE = 2e-5
PIECE = 1 << 20

_LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def pieces(text: str, sizes: tuple[int, ...] = SIZES, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Every n-gram of a text, once, as a number: its bytes and its length. Runs of blanks count as one. The n-grams
    that begin in one piece of ``piece`` bytes come together, which bounds what a very long text takes."""
    raw = _LETTERS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    blank = raw == 32
    raw = raw[~(blank & np.append(False, blank[:-1]))]
    for lo in range(0, len(raw), piece):
        out = []
        for n in sizes:
            part = raw[lo : lo + piece + n - 1].astype(np.int64)
            g = np.full(max(0, len(part) - n + 1), n, np.int64)
            for i in range(n):
                g = (g << 8) | part[i : len(part) - n + 1 + i]
            out.append(g)
        yield np.concatenate(out)


def grams(text: str, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    return np.concatenate(list(pieces(text, sizes)))


def _places(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h2 = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h >> np.uint64(64 - bits), h2 >> np.uint64(64 - bits)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            by.setdefault(lang, []).append(grams(text.as_py() or ""))
        for lang, parts in by.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Filter:
    """Languages in order, the slots' masks, and each language's rate of false positives."""

    def __init__(self, langs: list[str], masks: np.ndarray):
        self.langs, self.masks = langs, masks
        fill = np.array([np.count_nonzero(masks & np.uint64(1 << k)) / len(masks) for k in range(len(langs))])
        self.false = np.minimum(fill * fill, 0.99)

    def hits(self, text: str) -> np.ndarray:
        """Corrected number of n-grams that each language holds."""
        bits = len(self.masks).bit_length() - 1
        total, n = np.zeros(len(self.langs)), 0
        for g in pieces(text):
            a, b = _places(g, bits)
            found = self.masks[a] & self.masks[b]
            if len(self.langs) <= 8:
                seen = np.bincount(found.astype(np.uint8), minlength=256)
                total += [int(seen[(np.arange(256) >> k) & 1 == 1].sum()) for k in range(len(self.langs))]
            else:
                total += [np.count_nonzero(found & np.uint64(1 << k)) for k in range(len(self.langs))]
            n += len(found)
        return np.maximum(0.0, (total - n * self.false) / (1.0 - self.false))


def fit(documents: DataFrame, sample: int = SAMPLE, bits: int = BITS, share: float = SHARE) -> Filter:
    """A filter learnt from the rows' text and non-null lang."""
    known = documents.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    chosen = bounded_sample(known.select("doc_id", "lang", "text"), sample)
    counts = chosen.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r.lang for r in totals.select("lang").limit(65).collect())
    if len(langs) > 64:
        raise ValueError("the masks hold 64 languages at most")
    rates = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))  # totals: a row a language
    kept = rates.where(F.col("rate") >= share).select("lang", "gram")
    masks = np.zeros(1 << bits, np.uint64)
    rows = kept.toPandas()  # at most 1 / share n-grams a language
    for k, lang in enumerate(langs):
        for at in _places(rows.loc[rows["lang"] == lang, "gram"].to_numpy(np.int64), bits):
            masks[at] |= np.uint64(1 << k)
    return Filter(langs, masks)


def predict(documents: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in sliced(batches):
            langs, scores = [], []
            for text, letter in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                if not letter or not m.langs:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                hits = m.hits(text.as_py())
                best = int(hits.argmax())
                langs.append(m.langs[best])
                scores.append(float(hits[best] / hits.sum()) if hits[best] else 0.0)
            yield pa.record_batch([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
