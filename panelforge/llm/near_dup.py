"""Operator 8: MinHash near-dedup by a multi-index Hamming join.

A document's set holds its distinct ``SPAN``-word shingles (A-Z lower-cased; with
fewer words the whole sequence is one). Documents link where the sets' Jaccard
similarity is ``PERCENT`` % or more, confirmed on the full sets.

1. Equal sets form a class; its smallest doc_id stands for it.
2. A class has a signature of ``CHUNKS * WIDTH`` symbols of b = 16 bits, each from one
   minimum-wise hash. By the pigeonhole principle two signatures that differ in at most
   ``2 * CHUNKS - 1`` symbols differ in at most one symbol of some chunk, so the join
   keys are each chunk less each one of its symbols: no pair within that
   distance is missed. At similarity 0.8 the expected distance is 14.4 of 72 symbols and
   a pair misses all keys with probability 3e-6.
3. Each key's bucket has a head, the class with the most shared keys, and every
   member meets its heads first, exactly. What links to a head is done with it.
4. The members of a head's buckets that do not link to it, its outsiders, meet all of its
   other members: numpy compares the outsiders of a cell with its members and emits
   links alone. A pair is compared exactly if it shares a key, if sizes allow it and if
   the distances to the head do (Jaccard distance is a metric: a pair within 0.2 has
   distances to the head that differ by 0.2 at most). Two classes that share a key share its
   head, so every pair of every bucket is linked, compared or ruled out: no cap.

A head's set is sent once for ``DEAL`` of its members, which are dealt over tasks; outsiders and
members of one head form a grid of cells of about ``CELL`` each, a group of its own each. So a hot
group is spread over tasks, each of bounded memory.

Edge cases: a null or empty text has an empty set and links with nothing; rows with a
null doc_id link with nothing and have a null component; rows of one doc_id with different
texts count as linked, each with its own set; a very long text is handled whole, in memory in
proportion to it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import mixed, sliced, windows, word_hashes, written
from panelforge.llm.components import components

SPAN, PERCENT = 5, 80
CHUNKS, WIDTH = 12, 6
DEAL, CELL = 64, 1024
BATCH = 1 << 18

_SYMBOLS = CHUNKS * WIDTH
_ODD = np.random.default_rng(20240229).integers(1, 1 << 63, _SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, span: int = SPAN) -> np.ndarray:
    """The sorted 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(h) >= span:
        return np.unique(windows(h, span))
    return mixed(*(h[i : i + 1] for i in range(len(h))), np.array([len(h)], np.uint64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit symbols for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), _SYMBOLS), np.uint16)
    with np.errstate(over="ignore"):
        for k, a in enumerate(_ODD):
            low = np.minimum.reduceat(flat * a, starts)
            out[:, k] = (mixed(low) >> np.uint64(48)).astype(np.uint16)
    return out


def _sign(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets, size, at = [], 0, 0
            for i, x in enumerate(b.column(2)):
                sets.append(shingles(x.as_py(), span))
                size += len(sets[-1])
                if size >= BATCH or i == b.num_rows - 1:
                    yield made(b.slice(at, len(sets)), sets)
                    sets, size, at = [], 0, i + 1

    def made(rows: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], np.int64)
        full = [s for s in sets if len(s)]
        h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        sigs = [b""] * len(sets)
        if full:
            on = np.flatnonzero(n)
            flat, starts = np.concatenate(full), np.cumsum([0, *(len(s) for s in full[:-1])])
            with np.errstate(over="ignore"):
                h1[on] = np.add.reduceat(mixed(flat), starts)
                h2[on] = np.add.reduceat(mixed(flat, flat), starts)
            for k, s in zip(on, signatures(full), strict=True):
                sigs[k] = s.tobytes()
        made = [pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(sigs, pa.binary())]
        return pa.record_batch([rows.column(0), rows.column(1), *made], ["doc_id", "th", "n", "h1", "h2", "sig"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """72 keys a class: each chunk less one symbol."""
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            part = b.slice(lo, 1024)
            s = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
            keys = []
            for c in range(CHUNKS):
                for j in range(WIDTH):
                    rest = [s[:, c, i] for i in range(WIDTH) if i != j]
                    first = rest[0] | (rest[1] << np.uint64(16)) | (rest[2] << np.uint64(32)) | (rest[3] << np.uint64(48))
                    keys.append(mixed(first, rest[4] | np.uint64((c * WIDTH + j) << 16)))
            key = np.stack(keys, 1).ravel().view(np.int64)
            yield pa.record_batch([pa.array(key), pa.array(np.repeat(part.column(0).to_numpy(), _SYMBOLS))], ["key", "id"])


def _sets(span: int):
    """id, n, sig and the full set of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                found = [shingles(x.as_py(), span) for x in part.column(1)]
                on = [i for i, x in enumerate(found) if len(x)]
                if on:
                    sigs = signatures([found[i] for i in on])
                    yield pa.record_batch([part.column(0).take(pa.array(on)), pa.array([s.tobytes() for s in sigs], pa.binary()), pa.array([found[i].tobytes() for i in on], pa.binary())], ["id", "sig", "set"])

    return run


def _alike(n: np.ndarray, m: np.ndarray, both: np.ndarray) -> np.ndarray:
    return 100 * both >= PERCENT * (n + m - both)


def _runs(keys: list[np.ndarray]) -> list[tuple[int, int]]:
    """Where rows of equal keys begin and end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True))


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, id, distance, linked of each member and its head. Rows come by (h, salt, role), the head (role 0) before its members."""
    head = np.empty(0, np.uint64)
    for b in sliced(batches):
        role, d, on = b.column(2).to_numpy(), np.empty(b.num_rows), np.empty(b.num_rows, bool)
        for i in range(b.num_rows):
            x = np.frombuffer(b.column(3)[i].as_buffer(), np.uint64)
            if role[i] == 0:
                head = x.copy()
                continue
            both = len(np.intersect1d(x, head, assume_unique=True))
            d[i], on[i] = 1 - both / (len(x) + len(head) - both), _alike(len(x), len(head), both)
        keep = pa.array(role == 1)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(d), pa.array(on)], ["h", "id", "d", "linked"]).filter(keep)


def _block(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """ids, distances, sizes, signatures, sets, whether outsiders of rows (id, d, linked, sig, set)."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("set")]
    sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH)
    out = ~b.column("linked").to_numpy(zero_copy_only=False)
    return b.column("id").to_numpy(), b.column("d").to_numpy(), np.array([len(s) for s in sets], np.int64), sig, np.concatenate(sets), out


def block_links(x: tuple, y: tuple) -> list[tuple[int, int]]:
    """The links between a block of outsiders and a block of members of one head; of two outsiders, the one of the larger id is the member."""
    xi, xd, xn, xs, xset, _ = x
    yi, yd, yn, ys, yset, y_out = y
    ends, starts = np.cumsum(xn), np.cumsum(yn) - yn
    out = []
    for k in range(len(xi)):
        near = (np.abs(yd - xd[k]) <= 1 - PERCENT / 100 + 1e-9) & (100 * np.minimum(yn, xn[k]) >= PERCENT * np.maximum(yn, xn[k]))
        near &= ~y_out | (yi > xi[k])
        at = np.flatnonzero(near)
        if len(at):  # a common key: some chunk with one error at most
            at = at[((ys[at] != xs[k]).sum(2) <= 1).any(1)]
        if not len(at):
            continue
        own = xset[ends[k] - xn[k] : ends[k]]
        rows = np.concatenate([np.arange(starts[j], starts[j] + yn[j]) for j in at])
        values = yset[rows]
        hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(yn[at]) - yn[at])
        out.extend((int(xi[k]), int(yi[j])) for j in at[_alike(xn[k], yn[at], both)])
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each cell. Rows come by (h, s, t, role), the outsiders (role 0) before the members that they meet."""
    cell, held = None, []
    for b in sliced(batches, 256):
        keys = [b.column(k).to_numpy() for k in range(4)]
        for lo, hi in _runs(keys):
            here, role = tuple(int(k[lo]) for k in keys[:3]), keys[3][lo]
            if here != cell:
                cell, held = here, []
            part = _block(b.slice(lo, hi - lo))
            if role == 0:
                held.append(part)
                continue
            found = [pair for x in held for pair in block_links(x, part)]
            if found:
                u, v = zip(*found, strict=True)
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _links(live: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links enough to connect all that is similar."""
    weight = live.groupBy("id").agg(F.count("*").alias("shared"))
    weighed = live.join(weight, "id")
    heads = weighed.groupBy("key").agg(F.min(F.struct(-F.col("shared"), F.col("id"))).alias("best")).select("key", F.col("best.id").alias("h"))
    members = written(live.join(heads, "key").where("id <> h").select("h", "id").distinct(), "near-members")
    dealt = members.groupBy("h").agg(F.ceil(F.count("*") / DEAL).alias("parts"))
    rows = members.join(dealt, "h").select("h", "id", F.pmod(F.xxhash64("id"), "parts").alias("salt"), F.lit(1).alias("role"))
    rows = rows.unionByName(dealt.select("h", F.col("h").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("role")))
    rows = rows.join(sets.select("id", "set"), "id").repartition("h", "salt").sortWithinPartitions("h", "salt", "role")
    star = written(rows.select("h", "id", "role", "set").mapInArrow(_star, "h long, id long, d double, linked boolean"), "near-star")
    groups = star.groupBy("h").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("o")).where("o > 0 AND n > 1")
    groups = groups.select("h", F.ceil(F.col("o") / CELL).alias("ss"), F.ceil(F.col("n") / CELL).alias("ts"))
    full = star.join(groups, "h").join(sets, "id")
    cols = ["h", "s", "t", "role", "id", "d", "linked", "sig", "set"]
    number = lambda salt, of: F.pmod(F.xxhash64("id", F.lit(salt)), of)
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    outsiders = full.where("NOT linked").withColumn("s", number(1, "ss")).withColumn("t", every("ts")).withColumn("role", F.lit(0)).select(*cols)
    met = full.withColumn("t", number(2, "ts")).withColumn("s", every("ss")).withColumn("role", F.lit(1)).select(*cols)
    cells = outsiders.unionByName(met).repartition("h", "s", "t").sortWithinPartitions("h", "s", "t", "role")
    return star.where("linked").select(F.col("h").alias("u"), F.col("id").alias("v")).unionByName(cells.mapInArrow(_cells, "u long, v long"))


def near_duplicates(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    signed = written(texts.mapInArrow(_sign(span), "doc_id long, th long, n long, h1 long, h2 long, sig binary"), "near-signed")
    takes_part = "n > 0 AND doc_id IS NOT NULL"
    alive = signed.where(takes_part)
    classes = alive.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "th")).alias("of"), F.min("sig").alias("sig"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("nr"), F.col("of.doc_id").alias("id"), "of.th", "h1", "h2", "n", "sig"), "near-classes")
    emitted = classes.select("nr", "sig").mapInArrow(_keys, "key long, id long")
    shared = emitted.groupBy("key").count().where("count > 1").select("key")  # a class has each of its keys once
    live = written(emitted.join(shared.hint("merge"), "key", "left_semi").select("key", "id"), "near-live")  # Spark sizes 72 keys a class as less than a class
    asked = classes.join(live.select(F.col("id").alias("nr")).distinct(), "nr", "left_semi").select(F.col("id").alias("doc_id"), "th", "nr")
    sets = texts.join(asked, ["doc_id", "th"]).select("nr", "text").mapInArrow(_sets(span), "id long, sig binary, set binary")
    several = alive.groupBy("doc_id").agg(F.count("*").alias("c"), F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("c > 1")
    repeated, differing = several.agg(F.count("*"), F.count_if(F.col("lo") != F.col("hi"))).first()
    if repeated:  # rows equal in doc_id and text
        sets = sets.dropDuplicates(["id"])
    number = classes.select("nr", "id")
    links = written(_links(live, written(sets, "near-sets")), "near-links")
    links = links.join(number.toDF("u", "a"), "u").join(number.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if differing:  # rows of one doc_id with different texts
        own = alive.join(several.where("lo <> hi").select("doc_id"), "doc_id", "left_semi").join(classes.select("h1", "h2", "n", "id"), ["h1", "h2", "n"])
        links = links.unionByName(own.select(F.col("doc_id").alias("u"), F.col("id").alias("v")))
    comp = components(links).withColumnRenamed("label", "comp")
    of = classes.join(comp, "id", "left").select("h1", "h2", "n", F.coalesce("comp", "id").alias("component_id"))
    rows = alive.join(of, ["h1", "h2", "n"], "left").select("doc_id", "n", "component_id")
    rest = signed.where(f"NOT ({takes_part})").select("doc_id", "n", F.col("doc_id").alias("component_id"))  # not joined: an empty set is no key
    return rows.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON y.g = x.g AND y.doc_id > x.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (
  SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT u AS id, u AS z FROM e UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.z
), m AS (
  SELECT id, min(z) AS component FROM r GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, coalesce(m.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id
"""
