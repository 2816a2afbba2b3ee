"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import put, removed, written

#: Tasks over which the links of one hub are dealt.
SALTS = 8


def _linked(e: DataFrame) -> DataFrame:
    return e.where("u <> v").distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Each link (u, v), u > v, as u and the least neighbour of v: v is looked up by its links, dealt over SALTS."""
    both = e.select("u", "v", F.lit(False).alias("hub")).unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(True).alias("hub")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.max("hub").alias("hub")).where("hub")
    low = low.select(F.col("u").alias("v"), "m", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))).alias("salt"))
    dealt = e.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
    return _linked(dealt.join(low.hint("merge"), ["v", "salt"]).select("u", F.col("m").alias("v")))  # Spark sizes the exploded rows as one of them


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u")
    return _linked(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v"))))


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, label) of every end of a link: label is the smallest id that can be reached.

    Each step's result is written, so that the lineage stays short, and the step before it deleted. Null
    ends link nothing; an empty table gives an empty result. A step that changes nothing ends it;
    steps are compared by exact, order-free sums, which differ only with the links.
    """
    spark = links.sparkSession
    e = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    e, path = put(_linked(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "cc")
    before = None
    while True:
        after, now_at = put(_small_star(_large_star(e)), "cc")
        removed(spark, path)
        e, path = after, now_at
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == before:
            break
        before = now
    found = e.select(F.col("u").alias("id"), F.col("v").alias("label"))
    found = written(found.unionByName(found.select(F.col("label").alias("id"), "label").distinct()), "components")
    removed(spark, path)
    return found
