"""Operator 10: quality rules as a short-circuit cascade.

Each rule has a cost and a rejection rate, both estimated on a sample; rules run
in the order of rejections per cost, and a document that one rejects sees none of
the rest. The order changes the work alone, never the verdict: a document is kept
if the base rules and every rule of the cascade pass.

Base statistics of a whole text (all documents get them): n_words, word_chars
(code points in words), n_symbols (of ``#*$%&|<>``), n_dup_lines (lines with a
word that equal an earlier line), n_repeat_words (words in five-word windows that
occur twice or more, the first included).

Edge cases: a null or empty text has all statistics 0 and fails the base rules; a
very long text is handled whole, in one task's memory (about 60 bytes a word);
repeated rows get equal answers; an empty table gives an empty result and keeps
the order in which the rules are listed; other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_sample, sliced, windows, word_hashes

SAMPLE = 400
MIN_WORDS, MAX_REPEAT_PERCENT, SPAN = 10, 20, 5
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(c for c in range(256) if c not in _SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))


class Text:
    """A text and what the rules share of it, computed when first asked for and kept."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass")
        self.words = self.raw.split()

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).translate(None, _CONTINUED))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw.translate(None, _NOT_SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        seen, again = set(), 0
        for line in self.raw.split(b"\n"):
            if line in seen:
                again += 1
            elif line.split(None, 1):
                seen.add(line)
        return again

    def n_repeat_words(self, span: int = SPAN) -> int:
        grams = windows(word_hashes(self.words), span)
        if not len(grams):
            return 0
        order = np.argsort(grams, kind="stable")
        s = grams[order]
        same = s[1:] == s[:-1]
        hit = np.zeros(len(grams), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        edge = np.zeros(len(self.words) + 1, np.int32)
        edge[np.flatnonzero(hit)] += 1
        np.subtract.at(edge, np.flatnonzero(hit) + span, 1)
        return int(np.count_nonzero(np.cumsum(edge[:-1])))


def symbols(t: Text) -> bool:
    """More than one symbol in four words."""
    return 4 * t.n_symbols > len(t.words)


def shouting(t: Text) -> bool:
    """More than 40% of the letters A-Z, a-z are capitals (of 50 letters or more)."""
    small = len(t.raw) - len(t.raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    large = len(t.raw) - len(t.raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return small + large >= 50 and 5 * large > 2 * (small + large)


def repeated_lines(t: Text) -> bool:
    """More than 30% of the lines with a word (of 5 or more) repeat an earlier one."""
    lines = sum(1 for x in t.raw.split(b"\n") if x.split(None, 1))
    return lines >= 5 and 10 * t.n_dup_lines > 3 * lines


def word_length(t: Text) -> bool:
    """Words of fewer than 2 or more than 14 characters on average."""
    chars, n = t.word_chars, len(t.words)
    return chars < 2 * n or chars > 14 * n


def same_word(t: Text) -> bool:
    """More than 20% of the words equal the word before."""
    return 5 * sum(map(bytes.__eq__, t.words, t.words[1:])) > len(t.words)


#: The rules of the cascade, each true for a text that it rejects.
RULES: tuple[Callable[[Text], bool], ...] = (symbols, shouting, repeated_lines, word_length, same_word)


def plan(documents: DataFrame, rules: tuple = RULES, sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) in the order to run them, from about ``sample`` documents."""
    names = [r.__name__ for r in rules]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [x.as_py() for x in b.column(0)]
            for k, rule in enumerate(rules):
                fresh = [Text(x) for x in texts]
                for t in fresh:  # the base statistics are there before the cascade
                    _ = t.word_chars, t.n_symbols, t.n_dup_lines
                began = time.perf_counter()
                out = sum(map(rule, fresh))
                yield pa.record_batch([pa.array([k]), pa.array([time.perf_counter() - began]), pa.array([out]), pa.array([len(fresh)])], ["k", "s", "out", "n"])

    seen = bounded_sample(documents.select("doc_id", "text"), sample).select("text").mapInArrow(measure, "k long, s double, out long, n long")
    rows = {r.k: (r.s / r.n, r.out / r.n) for r in seen.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("s", "out", "n"))).collect()}  # a row a rule
    found = [(name, *rows.get(k, (1.0, 0.0))) for k, name in enumerate(names)]
    return sorted(found, key=lambda x: -x[2] / max(x[1], 1e-9))


def apply(documents: DataFrame, order: list[str] | None = None, rules: tuple = RULES) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, rejected_by and rules_run of every row."""
    named = {r.__name__: r for r in rules}
    chain = [named[x] for x in (order or [x[0] for x in plan(documents, rules)])]
    kind = dict(documents.dtypes)["doc_id"]
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            stats, failed, by, ran = [], [], [], []
            for x in b.column(1):
                t = Text(x.as_py())
                row = (len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words())
                stats.append(row)
                failed.append(row[0] < MIN_WORDS or 100 * row[4] > MAX_REPEAT_PERCENT * row[0])
                who, n = None, 0
                if not failed[-1]:
                    for rule in chain:
                        n += 1
                        if rule(t):
                            who = rule.__name__
                            break
                by.append(who)
                ran.append(n)
            kept = [not f and w is None for f, w in zip(failed, by, strict=True)]
            cols = [pa.array(c, pa.int64()) for c in (zip(*stats, strict=True) if stats else [[]] * 5)]
            yield pa.record_batch([b.column(0), *cols, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(by, pa.string()), pa.array(ran, pa.int32())], ["doc_id", *counts, "base_failed", "kept", "rejected_by", "rules_run"])

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, kept boolean, rejected_by string, rules_run int"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) AS w FROM t WHERE len(ws) >= 5
), hit AS (
  SELECT g.doc_id, g.i FROM g JOIN (SELECT doc_id, w FROM g GROUP BY 1, 2 HAVING count(*) > 1) h ON h.doc_id = g.doc_id AND h.w = g.w
), rep AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM hit CROSS JOIN (SELECT unnest(range(0, 5)) AS k) x) GROUP BY 1
), dup AS (
  SELECT doc_id, sum(n - 1) AS n, sum(n) AS lines FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) > 0 GROUP BY 1, 2) GROUP BY 1
), stats AS (
  SELECT t.doc_id, CAST(len(ws)AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(ws) AS base_failed,
    coalesce(dup.lines, 0) AS lines, len(regexp_extract_all(text, '[a-z]')) AS small, len(regexp_extract_all(text, '[A-Z]')) AS large, len(list_filter(range(1, len(ws)), lambda k: ws[k] = ws[k + 1])) AS same
  FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id LEFT JOIN dup ON dup.doc_id = t.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR (small + large >= 50 AND 5 * large > 2 * (small + large)) OR (lines >= 5 AND 10 * n_dup_lines > 3 * lines)
    OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 5 * same > n_words) AS kept
FROM stats
"""
