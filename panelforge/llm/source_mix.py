"""Operator 6: mixing sources to target weights by Pareto order sampling.

Sizes are words. The sources, in code-point order with null last, weigh
``WEIGHTS`` in turn and share the corpus' total size by weight; a target stops at
``CAP`` times its source's size, and what is over is shared again by weight until
none is above. That fixed point is a water level: target = min(cap, level * weight).

A document's expected copies are its source's target over its size, tilted by length: with lean =
1 / (1 + size / ``LONG``) and t = ``TILT`` (less where the cap of copies is near), they are share * (1 + t * (lean - mean)), so short texts are
drawn more often than long ones; the mean is weighed by size, so a source's expected words are its target. (With a
weight of a document's own they are in proportion to it, up to the cap.) The whole part is certain. The rest is its inclusion
probability p in a Pareto sample: with u uniform from a hash of the id, documents rank by
(u / (1 - u)) / (p / (1 - p)), and each source takes the head of its ranking that fits what remains of its target.
A text too long for what then remains is passed over: the rest of the ranking is gone through
again for texts that fit, ``ROUNDS`` times in all, so one long text at the cut doesn't leave its source short.

Nothing gathers a source in one place: ranks are counted in ``BINS`` bins of about even
size (a rank times the source's mean odds is about u / (1 - u)), only the
bin in which a head ends is ordered, and each source's cuts (a row a source) then
decide every document by themselves. DataFrame functions only.

Edge cases: null and empty texts have size 0, take nothing and are drawn like others;
a null source is a source; rows of one doc_id share u, and rows equal in u, id and
size are all taken or none; a very long text is counted whole, drawn less often, and passed over where it doesn't fit; a source of size 0 has target 0; an empty table gives
an empty result; columns of the input named as the result's are replaced, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import WORD, written

WEIGHTS = (1, 2, 3)
CAP = 3.0
SEED = 17
BINS = 1 << 14
TILT, LONG, ROUNDS = 0.5, 1000, 4


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 of seed and id."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, target: a row a source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    s = sources.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * cap).alias("_cap"))
    full = Window.orderBy(F.try_divide("_cap", "_w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(full.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_level", (F.sum("source_size").over(everything) - before) / left)
    s = s.withColumn("_level", F.max("_level").over(everything))
    return s.select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def lean(size: str = "size") -> Column:
    """1 for empty texts, falling with length."""
    return 1 / (1 + F.col(size) / F.lit(float(LONG)))


def _drawn(rows: DataFrame, weight: str | None, cap: float) -> DataFrame:
    """rows of (doc_id, source, size, source_size, target, _lean or weight and _weighted) with _whole, _p and _rank."""
    share = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    if weight:
        share = F.least(F.lit(cap), share * F.coalesce(F.try_divide(F.col(weight) * F.col("source_size"), F.col("_weighted")), F.lit(0.0)))
    else:
        tilt = F.least(F.lit(TILT), F.coalesce(F.try_divide(F.lit(cap) - share, share), F.lit(0.0)))
        share = share * (1 + tilt * (lean() - F.coalesce("_lean", F.lit(0.0))))
    rows = rows.withColumn("_e", share).withColumn("_whole", F.floor("_e")).withColumn("_p", F.col("_e") - F.col("_whole"))
    u = uniform()
    return rows.withColumn("_rank", F.when(F.col("_p") > 0, u / (1 - u) * ((1 - F.col("_p")) / F.col("_p"))))


def _bin() -> Column:
    """The bin of a rank; it grows with the rank within a source."""
    odds = F.col("_rank") * F.col("_odds")
    return F.least(F.lit(BINS - 1), F.floor(odds / (1 + odds) * BINS))


_KEY = ("_rank", "doc_id", "size")


def _head(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """source, _cut (the last (rank, id, size) of the longest head of rows whose words fit _rest; null: none) and _left, what then remains."""
    by, key = Window.partitionBy("source"), F.struct(*_KEY)
    bins = rows.groupBy("source", "_bin").agg(F.sum("size").alias("_n"), F.max(key).alias("_top"), F.first("_rest").alias("_rest"))
    bins = bins.withColumn("_end", F.sum("_n").over(by.orderBy("_bin")))
    fits = F.col("_end") <= F.col("_rest")
    edge = bins.groupBy("source").agg(F.max(F.when(fits, F.col("_top"))).alias("_low"), F.coalesce(F.max(F.when(fits, F.col("_end"))), F.lit(0)).alias("_start"), F.min(F.when(~fits, F.col("_bin"))).alias("_edge"))
    edge = written(edge.withColumnRenamed("source", "_s"), "mix-edges")
    same = F.col("source").eqNullSafe(F.col("_s"))
    inside = rows.join(edge, same & (F.col("_bin") == F.col("_edge"))).drop("_s")
    inside = inside.withColumn("_sum", F.col("_start") + F.sum("size").over(by.orderBy(*_KEY))).where(F.col("_sum") <= F.col("_rest"))  # ties are all in or out
    last = inside.groupBy("source").agg(F.max(key).alias("_in"), F.max("_sum").alias("_sum")).withColumnRenamed("source", "_t")
    out = rest.join(edge, same, "left").join(last, F.col("source").eqNullSafe(F.col("_t")), "left")
    return out.select("source", F.coalesce("_in", "_low").alias("_cut"), (F.col("_rest") - F.coalesce("_sum", "_start", F.lit(0))).alias("_left"))


def cuts(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, weight: str | None = None) -> DataFrame:
    """source, source_size, target and, of each round, _rest and _cut: a row a source."""
    goal = targets(sizes, weights, cap)
    extra = F.sum(F.col(weight) * F.col("size")).alias("_weighted") if weight else F.round(F.try_divide(F.sum(lean() * F.col("size")), F.sum("size")), 9).alias("_lean")
    goal = written(_with(goal, sizes.groupBy("source").agg(extra)), "mix-goal")  # unwritten, Spark sizes it above the rows, and broadcasts them
    drawn = _drawn(_beside(sizes, goal), weight, cap)
    mean = drawn.groupBy("source").agg(F.avg("_p").alias("_mean"), F.sum(F.col("_whole") * F.col("size")).alias("_certain"))
    goal = _with(goal, mean)
    odds = F.greatest(F.lit(1e-12), F.coalesce("_mean", F.lit(0.0)))
    goal = goal.withColumn("_odds", odds / F.greatest(F.lit(1e-12), 1 - odds)).withColumn("_rest1", F.col("target") - F.col("_certain")).drop("_mean", "_certain")
    goal = written(goal, "mix-targets")
    left = _drawn(_beside(sizes, goal), weight, cap).where("_rank IS NOT NULL").withColumn("_bin", _bin())
    left = written(left.select("source", "_bin", *_KEY), "mix-ranks")
    for k in range(1, ROUNDS + 1):
        rest = goal.select("source", F.col(f"_rest{k}").alias("_rest"))
        left = _beside(left, rest).where(F.col("size") <= F.col("_rest"))
        head = _head(left, rest)
        goal = written(_with(goal, head.select("source", F.col("_cut").alias(f"_cut{k}"), F.col("_left").alias(f"_rest{k + 1}"))), "mix-cuts")
        done = goal.select("source", F.col(f"_cut{k}").alias("_cut"))
        left = _beside(left.drop("_rest"), done).where(F.col("_cut").isNull() | (F.struct(*_KEY) > F.col("_cut"))).drop("_cut")
    return goal


def _with(per_source: DataFrame, more: DataFrame) -> DataFrame:
    """Two tables of a row a source beside each other."""
    other = more.withColumnRenamed("source", "_of")
    return per_source.join(other, per_source["source"].eqNullSafe(other["_of"]), "left").drop("_of")


def _beside(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """A row a source joined to every row. Spark broadcasts it where its files are small, and splits a hot source where not."""
    kept = rows.drop(*(c for c in per_source.columns if c != "source"))
    other = per_source.withColumnRenamed("source", "_of")
    return kept.join(other, kept["source"].eqNullSafe(other["_of"])).drop("_of")


def attach(rows: DataFrame, per_source: DataFrame, cap: float = CAP, weight: str | None = None) -> DataFrame:
    """rows (doc_id, source, size, ...) with source_size, target, copies and taken."""
    at = _drawn(_beside(rows, per_source), weight, cap)
    chosen = F.lit(False)
    for k in range(1, ROUNDS + 1):  # a row is tried in a round if it fits and no earlier round's head holds it
        chosen = chosen | F.coalesce((F.col("size") <= F.col(f"_rest{k}")) & (F.struct(*_KEY) <= F.col(f"_cut{k}")), F.lit(False))
    at = at.withColumn("copies", (F.col("_whole") + F.when(chosen & F.col("_rank").isNotNull(), 1).otherwise(0)).cast("int"))
    at = at.withColumn("taken", F.col("copies") * F.col("size"))
    return at.drop("_e", "_whole", "_p", "_rank", "_weighted", "_lean", "_odds", *(f"_cut{k}" for k in range(1, ROUNDS + 1)), *(f"_rest{k}" for k in range(1, ROUNDS + 2)))


def mix(documents: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, weight: str | None = None) -> DataFrame:
    """Every row of documents with size, source_size, target, copies and taken."""
    rows = documents.withColumn("size", size_of())
    sizes = written(rows.select("doc_id", "source", "size", *([weight] if weight else [])), "mix-sizes")
    return attach(rows, cuts(sizes, weights, cap, weight), cap, weight)


def digest(documents: DataFrame) -> DataFrame:
    """What mix() decides, without the texts: the sizes are counted once."""
    sizes = written(documents.select("doc_id", "source", size_of().alias("size")), "mix-sizes")
    return attach(sizes, cuts(sizes)).select("doc_id", "size", "source_size", "target", "taken", "copies")


_ROUNDS = "".join(
    f""", round{k} AS (
  SELECT doc_id, size, source, source_size, target, e, r, rest - coalesce(max(CASE WHEN fits THEN total END) OVER (PARTITION BY source), 0) AS rest, chosen OR coalesce(fits, false) AS chosen FROM (
    SELECT *, tried AND total <= rest AS fits FROM (SELECT *, sum(CASE WHEN tried THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY r NULLS LAST, doc_id, size) AS total FROM (
      SELECT *, r IS NOT NULL AND NOT chosen AND size <= rest AS tried FROM round{k - 1})))
)"""
    for k in range(1, ROUNDS + 1)
)
SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM sizes GROUP BY source
), levels AS (
  SELECT *, {CAP} * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum({CAP} * source_size) OVER (ORDER BY {CAP} * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY {CAP} * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), targets AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM levels) * w) AS target FROM levels
), leaning AS (
  SELECT s.source, round(sum(1 / (1 + size / {float(LONG)}) * size) / nullif(sum(size), 0), 9) AS lean FROM sizes s GROUP BY s.source
), shared AS (
  SELECT t.*, coalesce(t.target / nullif(t.source_size, 0), 0) AS share, coalesce(l.lean, 0) AS lean FROM targets t JOIN leaning l ON l.source IS NOT DISTINCT FROM t.source
), expected AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.share * (1 + least({TILT}, coalesce(({CAP} - t.share) / nullif(t.share, 0), 0)) * (1 / (1 + s.size / {float(LONG)}) - t.lean)) AS e,
    (CAST(('0x' || substr(md5('{SEED}|' || CAST(s.doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM sizes s JOIN shared t ON s.source IS NOT DISTINCT FROM t.source
), round0 AS (
  SELECT *, CASE WHEN e > floor(e) THEN u / (1 - u) * ((1 - (e - floor(e))) / (e - floor(e))) END AS r, target - sum(floor(e) * size) OVER (PARTITION BY source) AS rest, false AS chosen FROM expected
){_ROUNDS}
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target, CAST(size * (floor(e) + CASE WHEN chosen THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM round{ROUNDS}
"""
