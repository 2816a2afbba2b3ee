"""Operator 13: hard negatives by Four-Russians scoring.

Vectors become integers (floor(``SCALE`` * x)), so scores are exact. Every row is an
index entry once: its components' two's-complement bits are cut into planes, and a plane
packs eight dimensions into a byte. An anchor has, for each group of eight dimensions,
the sums of its components over all 256 subsets; a plane's byte looks up the plane's
share of the inner product, and the planes are shifted and added up (the highest
one, the sign, is subtracted) to the full score of every pair.

Anchors come in blocks of ``ANCHORS``, index entries in blocks of ``BLOCK``. A block of anchors is
held by a task while the ``RUN`` index blocks of a part go past it, and keeps only each anchor's best, so what a
task emits doesn't grow with the part. First the ``positives`` best of the anchor's own
label, then, for each of these, the ``negatives`` best of other labels whose scores lie
between ``low`` and ``high`` percent of the positive's. Ties go to the smaller id. Nothing is broadcast,
nothing is gathered by label, so a label may hold any share of the rows.

Edge cases: rows with a null id, a null label, a null vector or any null or non-finite
component take no part; of rows with one id the least (vector, label) counts; shorter
vectors are padded with zeros; an anchor without another row of its label gives no rows, nor does a
positive of negative score (no score lies in its range); fewer rows than asked for are
all returned; very long vectors make more groups of eight; an empty table gives an
empty result; other columns are ignored. Components and scores beyond 64 bits become the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import written
from panelforge.llm.top_k import _longs, _matrix, integers

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
EVERY, SCALE = 100, 256
ANCHORS, BLOCK, RUN = 1024, 8192, 32
SIDE, DEEP = 64, 1024


def planes_of(low: int, high: int) -> int:
    """Bits of two's complement that hold all integers from low to high."""
    return max(int(high).bit_length() if high >= 0 else 0, int(-low - 1).bit_length() if low < 0 else 0) + 1


def pack(x: np.ndarray, planes: int) -> np.ndarray:
    """(planes, groups of eight dimensions, rows) bytes."""
    u = x.astype(np.int64).view(np.uint64)
    bits = [np.packbits(((u >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").T for p in range(planes)]
    return np.ascontiguousarray(np.stack(bits))


def subset_sums(a: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sums of each anchor's components over each subset of a group of eight."""
    n, d = a.shape
    groups = -(-d // 8)
    wide = np.zeros((groups * 8, n), a.dtype)
    wide[:d] = a.T
    out = np.zeros((groups, 256, n), a.dtype)
    for g in range(groups):
        for i in range(8):
            out[g, 1 << i : 2 << i] = out[g, : 1 << i] + wide[8 * g + i]
    return out


def width(a: np.ndarray, planes: int) -> type:
    """What holds every partial sum of scores with these anchors."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * max(1, a.shape[1]) * 2.0**planes
    return np.int32 if most < 2.0**30 else np.int64 if most < 2.0**61 else object


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): the exact inner products, plane by plane from the sign down."""
    out = np.empty((planes.shape[2], tables.shape[2]), tables.dtype)
    for lo in range(0, len(out), DEEP):
        part = planes[:, :, lo : lo + DEEP]
        total, got = out[lo : lo + DEEP], None
        for p in range(len(planes) - 1, -1, -1):
            share = np.zeros(total.shape, tables.dtype)
            for g, table in enumerate(tables):
                got = np.take(table, part[p, g], axis=0)
                share += got
            if p == len(planes) - 1:
                total[:] = -share
            else:
                total += total
                total += share
    return out


def _cut(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties to the smaller id."""
    at = np.array(sorted(range(len(ids)), key=lambda p: (-s[p], ids[p]))[:k], np.int64) if s.dtype == object else np.lexsort((ids, -s.astype(np.int64)))[:k]
    return s[at], ids[at]


class _Best:
    """The best of each slot so far."""

    def __init__(self, slots: int, k: int):
        self.k, self.held, self.floor = k, [None] * slots, [None] * slots

    def meet(self, slot: int, s: np.ndarray, ids: np.ndarray) -> None:
        if self.floor[slot] is not None:
            on = s >= self.floor[slot]
            s, ids = s[on], ids[on]
        if not len(s):
            return
        if self.held[slot] is not None:
            s, ids = np.concatenate([self.held[slot][0], s]), np.concatenate([self.held[slot][1], ids])
        self.held[slot] = _cut(s, ids, self.k)
        if len(self.held[slot][0]) == self.k:
            self.floor[slot] = self.held[slot][0][-1]


def _index(d: int, planes: int, kind: str):
    """Blocks of packed planes of each part's rows, or of plain rows (planes 0) of each block of anchors. Rows come by nr."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nr, rows = [], None, 0

        def block() -> pa.RecordBatch:
            x = np.concatenate([_matrix(b.column(2), d) for b in held])
            ids, labels = (np.concatenate([b.column(k).to_numpy() for b in held]).astype(np.int64).tobytes() for k in (1, 3))
            body = pack(x, planes).tobytes() if planes else x.tobytes()
            extra = [pa.array([v], pa.binary()) for v in ([np.concatenate([_matrix(b.column(c), int(kind)) for b in held]).tobytes() for c in (4, 5)] if kind else [b"", b""])]
            counts = np.concatenate([np.diff(b.column(4).offsets.to_numpy()) for b in held]).astype(np.int64).tobytes() if kind else b""
            return pa.record_batch([pa.array([nr]), pa.array([body], pa.binary()), pa.array([ids], pa.binary()), pa.array([labels], pa.binary()), *extra, pa.array([counts], pa.binary())], ["nr", "x", "ids", "labels", "pids", "pscores", "pcounts"])

        for b in batches:
            key = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(key)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                at = lo
                while at < hi:
                    if held and (key[at] != nr or rows >= BLOCK):
                        yield block()
                        held, rows = [], 0
                    nr = int(key[at])
                    part = b.slice(at, min(hi - at, BLOCK - rows))
                    held.append(part)
                    rows, at = rows + part.num_rows, at + part.num_rows
        if held:
            yield block()

    return run


_BLOCK_ROWS = "nr long, x binary, ids binary, labels binary, pids binary, pscores binary, pcounts binary"
_FOUND = "anchor_id long, positive_id long, positive_score long, found_id long, found_score long"


def _mine(d: int, planes: int, k: int, most: int, low: int, high: int):
    """Each (block of anchors, part) group's best. Rows come by (slice, part, role), the anchors (role 0) first. ``most`` 0: positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, anchors, best = None, None, None
        for b in batches:
            sl, part, role = (b.column(i).to_numpy() for i in range(3))
            for i in range(b.num_rows):
                if (sl[i], part[i]) != group:
                    yield from done(anchors, best)
                    group, anchors, best = (sl[i], part[i]), None, None
                x, ids, labels = b.column(3)[i].as_py(), np.frombuffer(b.column(4)[i].as_py(), np.int64), np.frombuffer(b.column(5)[i].as_py(), np.int64)
                if role[i] == 0:
                    a = np.frombuffer(x, np.int64).reshape(len(ids), d)
                    wants = []
                    if most:
                        pid, ps = (np.frombuffer(b.column(c)[i].as_py(), np.int64).reshape(len(ids), most) for c in (6, 7))
                        wants = [[(int(p), int(s)) for p, s in zip(pid[r, :n], ps[r, :n], strict=True)] for r, n in enumerate(np.frombuffer(b.column(8)[i].as_py(), np.int64))]
                    if anchors is not None:  # a block in two rows
                        a, ids, labels, wants = (*(np.concatenate([p, q]) for p, q in zip(anchors[:3], (a, ids, labels), strict=True)), anchors[3] + wants)
                    anchors, best = (a, ids, labels, wants), _Best(len(ids) * max(1, most), k)
                elif anchors is not None:
                    meet(anchors, best, np.frombuffer(x, np.uint8).reshape(planes, -1, len(ids)), ids, labels)
        yield from done(anchors, best)

    def meet(anchors, best, packed, ids, labels) -> None:
        a, own, label, wants = anchors
        kind = width(a, planes)
        for lo in range(0, len(a), SIDE):
            side = np.ascontiguousarray(scores(subset_sums(a[lo : lo + SIDE].astype(kind)), packed).T)
            for r, s in enumerate(side, lo):
                if not most:
                    on = np.flatnonzero((labels == label[r]) & (ids != own[r]))
                    best.meet(r, s[on], ids[on])
                    continue
                other = labels != label[r]
                for j, (_, ps) in enumerate(wants[r]):
                    least, last = -((-low * ps) // 100), (high * ps) // 100
                    if least <= last:
                        floor = best.floor[r * most + j]
                        on = np.flatnonzero((s >= (least if floor is None else max(least, floor))) & (s <= last) & other)
                        best.meet(r * most + j, s[on], ids[on])

    def done(anchors, best) -> Iterator[pa.RecordBatch]:
        slots = [] if best is None else [(i, h) for i, h in enumerate(best.held) if h is not None]
        if not slots:
            return
        _, own, _, wants = anchors
        sizes = [len(h[1]) for _, h in slots]
        who = [own[i // max(1, most)] for i, _ in slots]
        of = [wants[i // most][i % most] if most else (None, None) for i, _ in slots]
        spread = lambda v: [x for x, n in zip(v, sizes, strict=True) for _ in range(n)]
        cols = [pa.array(spread(who), pa.int64()), pa.array(spread([p for p, _ in of]), pa.int64()), pa.array(spread([s for _, s in of]), pa.int64())]
        yield pa.record_batch([*cols, pa.array(np.concatenate([h[1] for _, h in slots])), pa.array(np.concatenate([_longs(h[0]) for _, h in slots]).astype(np.int64))], ["anchor_id", "positive_id", "positive_score", "found_id", "found_score"])

    return run


def mine(rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every row for which ``anchors`` holds."""
    label = F.col(label) if isinstance(label, str) else label
    base = rows.select(F.col(vec_id).cast("long").alias("id"), integers(vector, scale).alias("q"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    base = base.where("id IS NOT NULL AND q IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.min(F.struct("q", "label")).alias("of"), F.bool_or("asks").alias("asks"))
    base = written(base.select("id", "of.q", "of.label", "asks"), "mine-rows")
    n, d, asks, least, most = base.agg(F.count("*"), F.max(F.size("q")), F.count_if("asks"), F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    if not asks:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    d, planes = max(1, d), planes_of(least or 0, most or 0)
    slices, parts = -(-asks // ANCHORS), -(-n // (BLOCK * RUN))
    deal = lambda of, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(of))
    # Rows are dealt by blocks, so that a part's blocks are packed by as many tasks; the last block of each is smaller.
    blocks = base.select(deal(-(-n // BLOCK), 1).alias("nr"), "id", "q", "label").repartition("nr").sortWithinPartitions("nr")
    index = written(blocks.mapInArrow(_index(d, planes, ""), _BLOCK_ROWS).withColumn("part", F.pmod("nr", F.lit(parts))), "mine-index")
    asking = base.where("asks").select(deal(slices, 2).alias("nr"), "id", "q", "label")

    def met(some: DataFrame, kind: str, k: int, upto: int) -> DataFrame:
        """The bests of these anchors over the whole index."""
        held = some.repartition("nr").sortWithinPartitions("nr").mapInArrow(_index(d, 0, kind), _BLOCK_ROWS)
        held = held.withColumnRenamed("nr", "slice")
        cols = ["slice", "part", "role", "x", "ids", "labels", "pids", "pscores", "pcounts"]
        number = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
        first = held.withColumn("part", number(parts)).withColumn("role", F.lit(0)).select(*cols)
        past = index.withColumn("slice", number(slices)).withColumn("role", F.lit(1)).select(*cols)
        dealt = first.unionByName(past).repartition("slice", "part").sortWithinPartitions("slice", "part", "role")
        return dealt.mapInArrow(_mine(d, planes, k, upto, low, high), _FOUND)

    by = Window.partitionBy("anchor_id").orderBy(F.col("found_score").desc(), "found_id")
    own = met(asking.withColumn("pids", F.array().cast("array<long>")).withColumn("pscores", F.array().cast("array<long>")), "", positives, 0)
    own = own.withColumn("place", F.row_number().over(by)).where(F.col("place") <= positives)
    lists = own.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "found_id", "found_score"))).alias("of"))  # of ``positives`` at most
    lists = written(lists.select(F.col("anchor_id").alias("id"), F.col("of.found_id").alias("pids"), F.col("of.found_score").alias("pscores")), "mine-positives")
    found = met(asking.join(lists, "id").select("nr", "id", "q", "label", "pids", "pscores"), str(positives), negatives, positives)
    by = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("found_score").desc(), "found_id")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("found_score").alias("negative_score"))


def shifted(vec_id: str = "vec_id", label: str = "label") -> Column:
    """The label of the query's contract: rows whose id is divisible by 7 move on to the next of ten."""
    return F.when(F.col(vec_id) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))


SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN {LOW} * p.score AND {HIGH} * p.score WHERE p.place <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
