"""The queries of this subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import hard_negatives, language_id, line_dedup, near_dup, periodic_runs, pieces, quality_classifier, quality_rules, source_mix, suffix_dedup, top_k, toxicity, warc
from panelforge.llm.common import fold, table


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"), top_k.every())


def _classified(spark, sf_dir, operator, of: int, out: int) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", of) != out)
    scored = operator.score(documents, operator.fit(documents, labels))
    return scored.select("doc_id", (fold("doc_id", of) == out).alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality_classifier, 5, 0)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.fit(documents.where(fold("doc_id", 3) != 1))
    found = language_id.predict(documents, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity, 4, 2)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("text_digest"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.digest(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), span=4)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = F.sha2(F.col("decoded"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_digest"), digest.alias("decoded_digest"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality_rules.apply(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(table(spark, sf_dir, "documents"), periodic_runs.planted))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives.mine(rows, top_k.every(step=hard_negatives.EVERY), label=hard_negatives.shifted())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_top_k, op2_quality, op3_warc, op4_language, op5_line_dedup, op6_source_mix, op7_toxicity, op8_near_dup, op9_pieces, op10_quality_rules, op11_periodic_runs, op12_suffix_dedup, op13_hard_negatives, pipeline)}
SQL = {"op1_top_k": top_k.SQL, "op3_warc": warc.SQL, "op6_source_mix": source_mix.SQL, "op8_near_dup": near_dup.SQL, "op10_quality_rules": quality_rules.SQL, "op11_periodic_runs": periodic_runs.SQL, "op12_suffix_dedup": suffix_dedup.SQL, "op13_hard_negatives": hard_negatives.SQL}
