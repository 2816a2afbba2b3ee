"""Operator 1: exact top-k inner-product search.

Vectors become integers (floor(``SCALE`` * x)), so scores are exact. They are rotated
onto the principal axes of their second moments (an SVD; the moments are summed
by Spark, a d x d result), sorted by descending length and packed into blocks of up to
``BLOCK`` rows and ``BLOCK_BYTES``. Queries, a stated set of rows, are packed into smaller blocks of their
own, which are sent to every block of vectors that can matter, in one equi-join on that block's
number (a block of vectors is sent once):

* the block of the longest vectors gives each query a first k-th best score;
* a block whose longest vector times the query's length stays below that is skipped;
* within a block, inner products over the first ``HEAD`` rotated axes plus the product of the
  residual lengths (Cauchy-Schwarz) bound each score; only pairs whose bound reaches
  the query's k-th best so far are scored in full, in integers.

Each (query, block) pair keeps its k best, and a window per query ends it; ties go to the
smaller id. Broadcast are the d x d rotation and one block of vectors, of ``BLOCK_BYTES`` at most.
Numbers are held as narrow as the largest component allows; products that could pass 53 or 63 bits are taken in
64-bit or unbounded integers.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do
rows with a null id; of rows with one id the least vector counts; shorter vectors are padded
with zeros; zero vectors and negative scores are ranked like others; a query with
fewer than k candidates returns all of them; an empty table gives an empty result;
other columns are ignored. What a long can't hold (a component or a score beyond 64 bits) becomes
the nearest long, and ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import written

K, SCALE, BLOCK, HEAD, EVERY = 5, 256, 8192, 16, 50
BLOCK_BYTES = 32 << 20
_LONG = (1 << 63) - 1


def integers(vec: str, scale: int = SCALE) -> Column:
    """The vector in integers; null if a component is null or not finite."""
    whole = F.transform(vec, lambda v: F.floor(v.cast("double") * scale))
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    return F.when(fine, whole)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column, padded to d."""
    out = np.zeros((len(column), d), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _moments(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                x = _matrix(b.column(0).slice(lo, 4096), d).astype(float)
                total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(d, dtype=np.int32)), pa.array([x.tobytes() for x in total], pa.binary())], ["i", "s"])

    return run


def _sum_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row of the moments: a row a partition of the vectors."""
    return pd.DataFrame({"i": pdf["i"].iloc[:1], "s": [np.sum([np.frombuffer(x) for x in pdf["s"]], axis=0).tobytes()]})


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """The principal axes, largest first: d x d, whatever the number of vectors. Only the speed rests on it, not the result."""
    sums = vectors.select("q").mapInArrow(_moments(d), "i int, s binary").groupBy("i").applyInPandas(_sum_rows, "i int, s binary").toPandas()
    m = np.zeros((d, d))
    for i, s in zip(sums["i"], sums["s"], strict=True):
        m[i] = np.frombuffer(s)
    return np.linalg.eigh(m)[1][:, ::-1].copy()


def _pack(d: int, size: int, kind: str):
    """Blocks of one partition's rows, longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, ids, held = [], [], 0
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                left.append(_matrix(part.column(1), d))
                ids.append(part.column(0).to_numpy())
                held += part.num_rows
                if held >= size:
                    x, i = np.concatenate(left), np.concatenate(ids)
                    yield block(x[:size], i[:size])
                    left, ids, held = [x[size:]], [i[size:]], held - size
        if held:
            yield block(np.concatenate(left), np.concatenate(ids))

    def block(x: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        norms = np.sqrt((x.astype(float) ** 2).sum(1))
        part = TaskContext.get().partitionId()
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([int(i[0])]), pa.array([float(norms.max())]), pa.array([x.astype(kind).tobytes()], pa.binary()), pa.array([i.astype(np.int64).tobytes()], pa.binary())], ["part", "first", "longest", "x", "ids"])

    return run


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda p: (-scores[p], ids[p]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    kind = _exact(q, x)
    return (q.astype(kind) @ x.astype(kind).T).astype(np.int64 if kind is float else kind)


def _exact(q: np.ndarray, x: np.ndarray) -> type:
    """What holds every sum of products of rows of q and x exactly."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * q.shape[1]
    return float if most < 2.0**53 else np.int64 if most < 2.0**62 else object


def _longs(scores: np.ndarray) -> np.ndarray:
    return scores.astype(np.int64) if scores.dtype != object else np.array([max(-_LONG - 1, min(_LONG, s)) for s in scores], np.int64)


def search_block(q: np.ndarray, qi: np.ndarray, floor: np.ndarray, x: np.ndarray, xi: np.ndarray, turn: np.ndarray, k: int, head: int = HEAD, step: int = 1024):
    """(query place, id, score) of each query's k best in a block, of scores not below its floor."""
    qr, xr = q @ turn, x @ turn
    q_rest, x_rest = (np.sqrt(np.maximum(0.0, (r[:, head:] ** 2).sum(1))) for r in (qr, xr))
    slack = 1e-9 * (1.0 + np.sqrt((qr**2).sum(1)))
    x_norm = np.sqrt((xr**2).sum(1))
    floor = floor.astype(float).copy()
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
    q_norm = np.sqrt((qr**2).sum(1))
    for lo in range(0, len(x), step):
        s = slice(lo, lo + step)
        on = np.flatnonzero(q_norm * x_norm[s].max() + slack * (1.0 + x_norm[s].max()) >= floor)
        if not len(on):
            break  # rows come by descending length
        bound = qr[on, :head] @ xr[s, :head].T + q_rest[on, None] * x_rest[None, s] + slack[on, None] * (1.0 + x_norm[None, s])
        a, b = np.nonzero(bound >= floor[on, None])
        if not len(a):
            continue
        same = on[a]
        if len(a) * 4 > bound.size:
            scores = _dots(q[on], x[s])[a, b]
        else:
            kind = _exact(q, x[s])
            scores = np.concatenate([(q[same[p : p + 8192]].astype(kind) * x[s][b[p : p + 8192]].astype(kind)).sum(1) for p in range(0, len(a), 8192)])
            scores = scores.astype(np.int64) if kind is float else scores
        ids = xi[s][b]
        other = ids != qi[same]
        same, ids, scores = same[other], ids[other], scores[other]
        cut = np.flatnonzero(np.diff(same, prepend=-1))
        for p, e in zip(cut, np.append(cut[1:], len(same)), strict=True):
            r = same[p]
            all_s, all_i = np.append(held[r][0], scores[p:e]), np.append(held[r][1], ids[p:e])
            top = _best(all_s, all_i, k)
            held[r] = (all_s[top], all_i[top])
            if len(top) == k:
                floor[r] = max(floor[r], float(all_s[top[-1]]))
    return held


def _unpacked(x: bytes, ids: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return np.frombuffer(x, kind).reshape(len(i), -1).astype(np.int64), i


def search(rows: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """query_id, rank, vec_id, score: the k best others of every row for which ``queries`` holds."""
    spark = rows.sparkSession
    base = rows.select(F.col(vec_id).cast("long").alias("id"), integers(vector).alias("q"), F.coalesce(queries, F.lit(False)).alias("asks"))
    base = base.where("id IS NOT NULL AND q IS NOT NULL").groupBy("id").agg(F.min("q").alias("q"), F.bool_or("asks").alias("asks"))
    base = written(base, "vectors")
    n, d, asks, low, high = base.agg(F.count("*"), F.max(F.size("q")), F.count_if("asks"), F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not asks or not d:
        return empty
    kind = next(t.str for t in map(np.dtype, ("i2", "i4", "i8")) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    block = max(1, min(block, BLOCK_BYTES // (8 * d)))
    turn = rotation(base, d)
    length = F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))

    def packed(some: DataFrame, count: int, size: int, name: str) -> DataFrame:
        sorted_ = some.select("id", "q", length.alias("len")).repartitionByRange(max(1, -(-count // size)), F.col("len").desc(), "id").sortWithinPartitions(F.col("len").desc(), "id")
        made = sorted_.select("id", "q").mapInArrow(_pack(d, size, kind), "part int, first long, longest double, x binary, ids binary")
        return written(made, name)

    blocks, asked = packed(base, n, block, "blocks"), packed(base.where("asks"), asks, min(1024, block), "queries")
    top = blocks.select("longest", "first", "x", "ids").orderBy(F.col("longest").desc(), "first").limit(1).first()
    sent = spark.sparkContext.broadcast((turn, top.x, top.ids))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's k-th best within the block of the longest vectors."""
        r, x, i = sent.value
        x, i = _unpacked(x, i, kind)
        for b in batches:
            floors, weakest = [], []
            for qx, qids in zip(b.column(1), b.column(2), strict=True):
                q, qi = _unpacked(qx.as_py(), qids.as_py(), kind)
                held = search_block(q, qi, np.full(len(q), -np.inf), x, i, r, k, head)
                f = np.array([h[0][-1] if len(h[0]) == k else -np.inf for h in held], float)
                floors.append(f.tobytes())
                norm = np.sqrt((q.astype(float) ** 2).sum(1))
                weakest.append(float(np.min(np.divide(f, norm, out=np.full(len(f), -np.inf), where=norm > 0))))
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(floors, pa.binary()), pa.array(weakest)], ["qb", "qx", "qids", "floors", "weakest"])

    asked = written(asked.select(F.col("first").alias("qb"), F.col("x").alias("qx"), F.col("ids").alias("qids")).mapInArrow(first, "qb long, qx binary, qids binary, floors binary, weakest double"), "query-floors")
    # A query's floor over its length is the least length that can still matter. Each query block meets
    # each part of the vectors by number; the queries of the pairs that remain go to the vectors' blocks.
    parts = max(1, -(-n // block))
    need = asked.select("qb", "weakest", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    pairs = need.join(blocks.select("part", F.col("first").alias("vb"), "longest"), "part").where(F.col("longest") * (1 + 1e-9) >= F.col("weakest")).select("qb", "vb")
    met = pairs.join(asked, "qb").join(blocks.select(F.col("first").alias("vb"), "x", "ids"), "vb").select("qx", "qids", "floors", "x", "ids")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value[0]
        for b in batches:
            for qx, qids, floors, x, ids in zip(*b.columns, strict=True):
                q, qi = _unpacked(qx.as_py(), qids.as_py(), kind)
                v, vi = _unpacked(x.as_py(), ids.as_py(), kind)
                held = search_block(q, qi, np.frombuffer(floors.as_py(), float), v, vi, r, k, head)
                sizes = [len(h[0]) for h in held]
                yield pa.record_batch([pa.array(np.repeat(qi, sizes)), pa.array(np.concatenate([h[1] for h in held])), pa.array(np.concatenate([_longs(h[0]) for h in held]))], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(score, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every(vec_id: str = "vec_id", step: int = EVERY) -> Column:
    return F.col(vec_id) % step == 0


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
