"""A training corpus from ``documents``: toxicity, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
one's result as Parquet to the shared folder and reads it again as the next one's
docs. All but the last return the columns of documents.

No stage but the first reads labels, and that to learn alone. Null, empty and repeated
rows have the result that the operators' docstrings state; a document that a stage
leaves without words is dropped by the mix, which has nothing to take from it.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import line_dedup, near_dup, pieces, source_mix, toxicity
from panelforge.llm.common import BATCH_SETTING, fold, put, removed, scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that op7 predicts toxic, at the operator's own threshold."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    model = toxicity.fit(docs, labels)
    return toxicity.keep(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier line repeats, up to one edit; n_chars, where it is there, follows the text."""
    out = line_dedup.dedup(docs, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles), that of the smallest doc_id; rows of one doc_id are one document."""
    gone = near_dup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to target weights: a document comes as often as the mix takes it."""
    out = source_mix.mix(docs).where("taken > 0")
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    coded = pieces.decode(pieces.encode(docs.select("doc_id", "source", "text")))
    return coded.select("doc_id", "source", "ids", F.size("ids").alias("n_pieces"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


def _bounded(stage):
    """The stage in a session whose Arrow batches are small: its result is lazy, and a task holds several batches of whole texts."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, "4m")
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _bounded(f)) for name, f in (("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near_copies), ("source_mix", mix), ("pieces", encode))]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way, and the stage before it, go when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = put(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            removed(spark, before)
        before = path
    return docs
