import math
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import toxicity
from tests.llm.test_operators import words


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(3)
    text = {i: "\n".join(words(rng, 15) for _ in range(4)) for i in range(120)}
    for i in range(0, 120, 6):
        text[i] = text[i].replace(" ", " zzinsult ", 1)
    text[7] = text[8]
    text[13] = " ".join(text[14].split()[:-1] + ["changed"])
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in text.items()] + [(500, None, None, None, 0), (501, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i % 6 == 0)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], str(tmp_path)).cache()
        assert out.columns == docs.columns, name
        kept.append(out)
    lines = {r.doc_id: r.text for r in kept[2].collect()}
    assert lines[8] == "" and lines[7] != "" and lines[500] is None  # 8 repeats 7, which comes first
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.where(~F.col("round_trip")).count() == 0 and final.count() == kept[-1].count()
    assert final.where("doc_id IN (500, 501)").count() == 0


def test_toxicity_stage_drops_what_op7_predicts(spark, tmp_path, monkeypatch):
    texts = {0: "nothing here", 1: "a zzmild word", 2: "a zzharsh word"}
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], schema)
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    logit = {t: math.log(p / (1 - p)) + 3.0 for t, p in (("zzmild", 0.4), ("zzharsh", 0.9))}
    w = {int(toxicity.terms(t)[0]): x for t, x in logit.items()}
    ids = np.array(sorted(w))
    model = (ids, np.array([w[i] for i in ids]), np.zeros((2, 4)), -3.0)
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: model)
    predicted = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert predicted == {0: 0, 1: 1, 2: 1}  # document 1 scores 0.4
    kept = {r.doc_id for r in corpus_pipeline.toxic(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i, p in predicted.items() if not p}


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, empty, long and repeated texts, clashing names, no n_chars, an empty table: at every stage."""
    rng = random.Random(5)
    long = "\n".join(words(rng, 30) for _ in range(400))
    texts = [(1, None), (2, ""), (3, " \n "), (4, long), (4, long), (None, "no id, but some words in a line"), (5, "short\nshort"), (6, "x" * 30_000)]
    kinds = "doc_id long, text string, lang string, source string, n_lines int, n_removed string, kept string, size string, taken string, copies int, ids string, th string, component_id string"
    rows = [(i, t, "en", "s", 7, "r", "k", "z", "t", 9, "i", "h", "c") for i, t in texts]
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(9, 1, 0)], labels).write.parquet(str(tmp_path / "labels.parquet"))
    for some in (rows, []):
        docs = spark.createDataFrame(some, kinds)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            found = out.collect()
            if name == "pieces":
                assert out.columns == ["doc_id", "source", "ids", "n_pieces", "round_trip"] and all(r.round_trip for r in found)
                continue
            assert out.columns == docs.columns, name
            want = {"toxicity": 8, "line_dedup": 8, "near_dedup": 8}.get(name)
            if some and want:
                assert len(found) == want, name
                assert all((r.n_lines, r.n_removed, r.kept, r["size"], r.th) == (7, "r", "k", "z", "h") for r in found), name
            if not some:
                assert not found, name
            if some and name == "line_dedup":
                by = {(r.doc_id, (r.text or "")[:5]) for r in found}
                assert (5, "short") in by and {r.text for r in found if r.doc_id == 5} == {"short"} and {r.text for r in found if r.doc_id == 4} == {long}
