"""Operator 5: line dedup by a deletion-neighbourhood join.

A line (cut at ``\\n``, ASCII blanks trimmed, not empty) goes if an earlier line of the
corpus, in the order of (doc_id, text hash, line number), is equal to it or, where both have
``EDIT_CHARS`` characters or more, within one edit of it: one character inserted, deleted or
replaced. So the earliest of each neighbourhood stays. Lines of fewer characters have an edit
bound of 0 (one edit makes another word of them); blank lines always stay.

Two lines within one edit share a variant with one character deleted:
* one of them less a character is the other (insertion), or
* both less the character at the same place are equal (replacement).
Equal hashed variants are joined and the edit distance of each pair found is
verified on the texts. A bucket needs no pairs of all its members: in a
replacement bucket any two are one edit apart, so the earliest decides for all; in an
insertion bucket the shorter line is one edit from every other. Rows made are
therefore linear in the variants, whatever a bucket's size.

A line of n characters has n variants, nearly all of which meet none. So the
neighbourhood is walked in two steps, without loss: first the variants with one of
``BLOCKS`` blocks of characters deleted (an edit lies in one block, so lines within
one edit share the variant without it), then, for lines that share such a variant, those with
one character of that block deleted.

Edge cases: rows with a null doc_id or text pass unchanged and take no part; an
empty text stays empty; a text all of whose lines go becomes empty, and its row stays;
rows equal in doc_id and text count as one document and get equal results, rows of one doc_id
with different texts are told apart by a hash of the text; ids may be of any type that has an
order; a very long line is handled whole, in memory in proportion to it; an empty table gives an
empty result; other columns are kept, but for ``n_lines`` and ``n_removed``, which the result's replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import fresh, mixed, sliced, written

EDIT_CHARS = 20
BLOCKS = 2
BATCH = 1 << 16

_BLANKS = " \t\r\x0b\x0c"
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_AT = ("doc", "th", "pos")


def _block_keys(line: Column, n: Column, blocks: int) -> Column:
    """The line less each block, as one of length m = n, then of m = n - 1 (with one character more)."""
    keys = []
    for less in (0, 1):
        m = n - less
        for j in range(blocks):
            a, b = F.floor(m * j / blocks).cast("int"), F.floor(m * (j + 1) / blocks).cast("int")
            tail = m - b
            key = F.xxhash64(m, F.lit(j), F.substring(line, F.lit(1), a), F.substring(line, n - tail + 1, tail))
            keys.append(key)
    return F.array(*keys)


def lines(documents: DataFrame) -> DataFrame:
    """doc, th (the text's hash), pos and line of every line that takes part."""
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.withColumn("line", F.btrim("line", F.lit(_BLANKS))).where("line <> ''")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(_BASE))), dtype=np.uint64)
        down = np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(_INVERSE))), dtype=np.uint64)
    return up, down


def variants(line: str, block: int, less: int, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, roles) of a line with one character of a block deleted. Roles: 0 replacement, 1 the shorter line itself, 2 the longer line less a character."""
    c = mixed(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    n = len(c)
    m = n - less
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(c * up[:n], dtype=np.uint64))
        at = np.arange(m * block // blocks, m * (block + 1) // blocks + less)
        without = sums[at] + (sums[n] - sums[at + 1]) * down[1]  # what follows moves down by one place
    size = np.full(len(at), np.uint64(m))
    if less:
        return mixed(without, size, np.full(len(at), np.uint64(1 << 40))), np.full(len(at), 2, np.int8)
    keys = np.append(mixed(without, size, at.astype(np.uint64)), mixed(sums[n:], np.array([m], np.uint64), np.array([1 << 40], np.uint64)))
    return keys, np.append(np.zeros(len(at), np.int8), np.int8(1))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, role and place of every variant of (doc, th, pos, line, blocks)."""
    for b in sliced(batches):
        keys, roles, sizes, held, began = [], [], [], 0, 0
        for i in range(b.num_rows):
            line, n = b.column(3)[i].as_py(), 0
            for block in b.column(4)[i].as_py():
                k, r = variants(line, block % BLOCKS, block // BLOCKS)
                keys.append(k)
                roles.append(r)
                n += len(k)
            sizes.append(n)
            held += n
            if held >= BATCH or i == b.num_rows - 1:
                of = pa.array(np.repeat(np.arange(began, i + 1), sizes))
                cols = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(roles)), *(b.column(c).take(of) for c in range(3))]
                yield pa.record_batch(cols, ["key", "role", *_AT])
                keys, roles, sizes, held, began = [], [], [], 0, i + 1


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each text that its list of (pos, blocks) names."""
    for b in sliced(batches):
        for i in range(b.num_rows):
            parts, want = b.column(2)[i].as_py().split("\n"), b.column(3)[i].as_py()
            of = pa.array(np.full(len(want), i))
            places = [w["pos"] for w in want]
            blocks = pa.array([w["blocks"] for w in want], pa.list_(pa.int32()))
            cols = [b.column(0).take(of), b.column(1).take(of), pa.array(places, pa.int32()), pa.array([parts[p].strip(_BLANKS) for p in places], pa.string()), blocks]
            yield pa.record_batch(cols, [*_AT, "line", "blocks"])


def first_lines(documents: DataFrame, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """Number, doc, th and pos of each different line's first occurrence, with its block keys."""
    n = F.length("line")
    keys = F.when(n >= edit_chars, _block_keys(F.col("line"), n, BLOCKS)).otherwise(F.expr("array()").cast("array<bigint>"))
    rows = lines(documents).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.struct(*_AT).alias("at"), keys.alias("keys"))
    firsts = rows.groupBy("h1", "h2").agg(F.min_by("keys", "at").alias("keys"), F.min("at").alias("at"))
    return firsts.select(F.monotonically_increasing_id().alias("nr"), *(f"at.{c}" for c in _AT), "keys")


def near_pairs(documents: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc, th, pos of the first lines that have an earlier line one edit away.

    A different line has each of its block keys once, so a key counted twice is one of two lines.
    Spark sizes variants by the lines they are made of, and lines and lists by their compressed files, all far too low:
    joins with them are hinted to merge, else the driver collects them for a broadcast.
    """
    shared = firsts.select(F.explode("keys").alias("bk")).groupBy("bk").count().where("count > 1").select("bk")
    spread = firsts.select("nr", F.posexplode("keys").alias("block", "bk"))
    hot = spread.join(shared, "bk", "left_semi").groupBy("nr").agg(F.collect_list("block").alias("blocks"))  # 2 * BLOCKS at most
    places = hot.join(firsts.select("nr", *_AT), "nr")
    wanted = written(places.groupBy("doc", "th").agg(F.collect_list(F.struct("pos", "blocks")).alias("want")), "line-wanted")  # the lines of one document
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), "text")
    found = texts.join(wanted.hint("merge"), ["doc", "th"]).select("doc", "th", "text", "want")
    kind = dict(firsts.dtypes)["doc"]
    candidates = found.mapInArrow(_wanted, f"doc {kind}, th long, pos int, line string, blocks array<int>").dropDuplicates(list(_AT))
    candidates = written(candidates, "line-candidates")
    emitted = candidates.select(*_AT, "line", "blocks").mapInArrow(_emit, f"key long, role byte, doc {kind}, th long, pos int")
    at = F.struct(*_AT)
    least = [F.min(F.when(F.col("role") == r, at)).alias(f"m{r}") for r in (0, 1, 2)]
    several = F.max(at) != F.min(at)
    met = emitted.groupBy("key").agg(*least, several.alias("several")).where("several").drop("several")
    partner = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = emitted.join(met.hint("merge"), "key").select(*_AT, partner.alias("other")).where(F.col("other") < at).distinct()
    pairs = pairs.select(*_AT, *(F.col(f"other.{c}").alias(f"o_{c}") for c in _AT))
    text = candidates.select(*_AT, "line")
    other = text.select(*(F.col(c).alias(f"o_{c}") for c in _AT), F.col("line").alias("o_line"))
    seen = pairs.join(text.hint("merge"), list(_AT)).join(other.hint("merge"), [f"o_{c}" for c in _AT])
    return seen.where(F.levenshtein("line", "o_line", 1) >= 0).select(*_AT).distinct()


def dedup(documents: DataFrame, edit_chars: int = EDIT_CHARS, counts: bool = True) -> DataFrame:
    """documents with the repeated lines taken out of ``text``, and (``counts``) n_lines, n_removed."""
    firsts = written(first_lines(documents, edit_chars), "line-firsts")
    near = written(near_pairs(documents, firsts), "line-near")
    mark = fresh(documents, "kept_places")
    kept = firsts.select(*_AT).join(near, list(_AT), "left_anti").groupBy("doc", "th").agg(F.collect_list("pos").alias(mark))
    base = documents.drop("n_lines", "n_removed") if counts else documents
    names = base.columns
    both = base.join(kept, (base["doc_id"] == kept["doc"]) & (F.xxhash64(base["text"]) == kept["th"]), "left").select(*(base[c] for c in names), kept[mark])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, t, k = names.index("doc_id"), names.index("text"), len(names)
        for b in sliced(batches):
            texts, totals, gone = [], [], []
            for doc, text, keep in zip(b.column(i), b.column(t), b.column(k), strict=True):
                text = text.as_py()
                if text is None or not doc.is_valid:
                    texts.append(text)
                    totals.append(len(text.split("\n")) if text else 0)
                    gone.append(0)
                    continue
                parts = text.split("\n")
                first = set(keep.as_py() or ())
                left = [x for i, x in enumerate(parts) if i in first or not x.strip(_BLANKS)]
                texts.append("\n".join(left))
                totals.append(len(parts) if text else 0)
                gone.append(len(parts) - len(left))
            cols = [b.column(c) for c in range(k)]
            cols[t] = pa.array(texts, pa.string())
            more = [pa.array(totals, pa.int64()), pa.array(gone, pa.int64())] if counts else []
            yield pa.record_batch([*cols, *more], [*names, *(("n_lines", "n_removed") if counts else ())])

    schema = ", ".join(f"`{n}` {k}" for n, k in base.dtypes)
    return both.mapInArrow(rebuild, schema + (", n_lines long, n_removed long" if counts else ""))
