"""Source targets with long texts, a toxicity model that doesn't hang on how rows are dealt, scores of quality, pushed WARC predicates."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import quality_classifier, source_mix, toxicity, warc
from tests.llm.test_operators import documents, words


def test_mix_meets_targets_beside_a_long_text(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randint(20, 40)), "en", f"s{i % 8}") for i in range(1600)]
    rows += [(5000 + 37 * k, words(rng, 1500), "en", f"s{k}") for k in range(8)]  # a fifth of each source
    got = source_mix.mix(documents(spark, rows)).select("doc_id", "source", "size", "target", "source_size", "copies", "taken").toPandas()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by["taken"] - by["target"]) <= 0.005 * by["target"]).all()
    assert (got["copies"] <= 3).all() and (got["taken"] == got["copies"] * got["size"]).all()


def test_mix_draws_short_texts_more_often(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * (2000 if i % 2 else rng.randint(5, 50))), "en", "ab"[i // 600 % 2]) for i in range(1200)]
    got = source_mix.mix(documents(spark, rows), weights=(1, 3)).where("source = 'a'")  # half of it is taken
    rate = {r.long: r.x for r in got.groupBy((F.col("size") > 100).alias("long")).agg(F.avg("copies").alias("x")).collect()}
    assert 0.3 < rate[True] < 0.55 and rate[False] > rate[True] + 0.1


def test_toxicity_model_is_the_same_however_rows_are_dealt(spark):
    rng = random.Random(4)
    group, insult = ["zzfolk", "zzkin"], ["zzbad", "zzvile"]
    rows, labels = [], []
    for i in range(700):
        own = words(rng, rng.randint(5, 60)).split()
        kind = rng.randrange(4)
        own += ([rng.choice(group)] if kind & 1 else []) + ([rng.choice(insult)] if kind & 2 else [])
        rng.shuffle(own)
        rows.append((i, " ".join(own), "en", "s"))
        labels.append((i, int(kind == 3)))
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    learn = marks.where("doc_id % 4 > 0")
    models = [toxicity.fit(docs.repartition(n, "doc_id"), learn) for n in (1, 4, 12)]
    for m in models[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(m[:3], models[0][:3], strict=True)) and m[3] == models[0][3]
    held = toxicity.score(docs, models[0]).where("doc_id % 4 = 0").join(marks, "doc_id").collect()
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.05 * len(clean)


def test_quality_scores_equal_a_plain_sum(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(0, 40)), "en", "s") for i in range(30)] + [(40, None, "en", "s"), (41, "", "en", "s"), (42, "Long text. " * 5000, "en", "s")]
    weights = np.zeros((1 << 12) + 1)
    at = np.random.default_rng(0).integers(0, 1 << 12, 900)
    weights[at] = np.random.default_rng(1).normal(size=900)
    weights[-1] = -0.3
    got = {r.doc_id: (r.score, r.predicted) for r in quality_classifier.score(documents(spark, rows), weights, bits=12).collect()}
    for i, text, _, _ in rows:
        total, found = 0.0, quality_classifier.slots(text, 12).tolist()
        for slot in found:
            total += float(weights[slot]) / len(found) * quality_classifier.SCALE
        want = 1 / (1 + np.exp(-(total + weights[-1])))
        assert abs(got[i][0] - want) < 1e-5 and got[i][1] == int(got[i][0] >= quality_classifier.THRESHOLD)


def test_warc_predicates_keep_payloads_deflated(spark, tmp_path):
    """A record whose payload is damaged is read past when a pushed predicate rules it out, and raises when it is wanted."""
    body = [bytes(random.Random(i).choices(b"0123456789abcdef", k=600_000)) for i in range(3)]
    members = [warc.member(warc.record("response", f"<urn:page:{i}>", f"u{i}", "d", b, len(b))) for i, b in enumerate(body)]
    broken = bytearray(members[1])
    broken[200_000:200_400] = b"\xff" * 400
    (tmp_path / "a.warc.gz").write_bytes(members[0] + bytes(broken) + members[2])
    warc.register(spark)
    rows = warc.read(spark, f"file://{tmp_path}")
    assert {bytes(r.payload) for r in rows.where("target_uri = 'u2' AND warc_type = 'response'").collect()} == {body[2]}
    assert {r.target_uri for r in warc.read(spark, f"file://{tmp_path}", payload=False).collect()} == {"u0", "u1", "u2"}
    with pytest.raises(Exception, match=r"(?i)error"):
        rows.where("target_uri = 'u1'").collect()
