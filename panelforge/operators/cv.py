"""Cross-validation splits and scores over pooled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def purged_folds(rows: DataFrame, k: int = 5, embargo: int = 5) -> DataFrame:
    """rows (date, t1, ...) for each of k blocks of dates, with side: test, purged, embargoed or train.

    Rows of one date share a side. A row is purged if [date, t1] meets the test block's labels, and
    embargoed if it starts within ``embargo`` dates after them. Windows run over the table of dates, a row a date.
    """
    if k < 2:
        raise ValueError("at least two blocks are needed")
    days = rows.groupBy("date").agg(F.max("t1").alias("t1")).withColumn("block", F.ntile(k).over(Window.orderBy("date")) - 1).withColumn("n", F.row_number().over(Window.orderBy("date")))
    blocks = days.groupBy("block").agg(F.min("date").alias("s"), F.max("date").alias("e"), F.max("t1").alias("t"))
    last = blocks.join(days.select("date", "n"), F.col("date") <= F.col("t")).groupBy("block").agg(F.max("n").alias("n"))
    ahead = last.select("block", F.col("n").alias("n0")).join(days.select("date", "n"), (F.col("n") > F.col("n0")) & (F.col("n") <= F.col("n0") + embargo))
    blocks = blocks.join(ahead.groupBy("block").agg(F.max("date").alias("h")), "block", "left").withColumn("h", F.coalesce("h", "t"))
    at = rows.join(F.broadcast(blocks), F.lit(True))  # k rows
    d = F.col("date")
    side = F.when(d.between(F.col("s"), F.col("e")), "test").when((d <= F.col("t")) & (F.col("t1") >= F.col("s")), "purged").when((d > F.col("t")) & (d <= F.col("h")), "embargoed").otherwise("train")
    return at.withColumn("side", side).drop("s", "e", "t", "h")


#: Ranges that a key's rows are cut into before they are ordered.
RANGES = 64


def turn(*parts: Column) -> Column:
    """52 bits of an MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def places(rows: DataFrame, hashed: str, tie: str, *keys: str, ranges: int = RANGES) -> DataFrame:
    """rows with place, from 1 in the order of a 52-bit hash within the keys.

    Two levels: rows are counted by range of the hash, each range ordered by itself, and the ranges before it added.
    """
    at = rows.withColumn("_range", F.floor(F.col(hashed) / F.lit(2.0**52) * ranges))
    before = _before(at.groupBy(*keys, "_range").agg(F.count("*").alias("_n")), *keys)
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(hashed, tie))
    return at.withColumn("place", own).join(before, [*keys, "_range"]).withColumn("place", F.col("place") + F.col("_before")).drop("_range", "_before")


def _before(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, _range, _before: the rows in the ranges before each one. A row a range."""
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def auc(scored: DataFrame, *keys: str, p: str = "p", y: str = "y", ranges: int = RANGES) -> DataFrame:
    """keys, auc, accuracy by exact rank sums; tied scores share their mean rank.

    Scores lie in [0, 1]; they are counted by range, ordered within ranges, and the ranges before are added, so no key is ordered in one task.
    """
    counts = scored.groupBy(*keys, p).agg(F.count("*").alias("n"), F.sum(y).alias("pos"), F.sum(((F.col(p) >= 0.5).cast("double") == F.col(y)).cast("int")).alias("hit"))
    counts = counts.withColumn("_range", F.floor(F.col(p) * ranges))
    before = _before(counts.groupBy(*keys, "_range").agg(F.sum("n").alias("_n")), *keys)
    w = Window.partitionBy(*keys, "_range").orderBy(p)
    at = counts.withColumn("_end", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(before, [*keys, "_range"])
    at = at.withColumn("rank", F.col("_before") + F.col("_end") - (F.col("n") - 1) / 2)
    one = at.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("a"), F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    a, b = F.col("a"), F.col("n") - F.col("a")
    return one.select(*keys, F.try_divide(F.col("s") - a * (a + 1) / 2, a * b).alias("auc"), (F.col("hit") / F.col("n")).alias("accuracy"))
