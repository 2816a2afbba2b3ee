"""Joins whose sides Spark sizes far too low: at any size they are merged, and nothing is collected for a broadcast."""

import random

from panelforge.llm import components, line_dedup, near_dup, source_mix
from tests.llm.test_operators import documents, words


def _planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _one_edit(a: str, b: str) -> bool:
    """Whether one character inserted makes one of the other, both of EDIT_CHARS or more."""
    a, b = sorted((a, b), key=len)
    return len(a) >= line_dedup.EDIT_CHARS and len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_variants_and_texts_are_not_broadcast(spark):
    rng = random.Random(3)
    own = [words(rng, 12) for _ in range(30)]
    rows = [(i, "\n".join([own[i], own[i] + "s", own[i - 1][1:]]), "en", "s") for i in range(30)]
    docs = documents(spark, rows)
    firsts = line_dedup.written(line_dedup.first_lines(docs), "line-firsts")
    near = line_dedup.near_pairs(docs, firsts)
    plan = _planned(near)
    assert "MapInArrow" in plan and "Broadcast" not in plan
    lines = [x.strip() for _, text, _, _ in rows for x in text.split("\n")]
    first = list(dict.fromkeys(lines))
    want = {(lines.index(y) // 3, lines.index(y) % 3) for k, y in enumerate(first) if any(_one_edit(x, y) for x in first[:k])}
    assert len(want) > 50 and {(r.doc, r.pos) for r in near.collect()} == want


def test_keys_and_dealt_links_of_near_copies_are_not_broadcast(spark, monkeypatch):
    rng, plans = random.Random(5), {}

    def written(df, name):
        plans[name] = _planned(df)
        return line_dedup.written(df, name)

    monkeypatch.setattr(near_dup, "written", written)
    text = words(rng, 60)
    rows = [(i, text + " " + "abcd"[i % 4], "en", "s") for i in range(8)] + [(i, words(rng, 60), "en", "s") for i in range(10, 20)]
    got = near_dup.near_duplicates(documents(spark, rows)).where("NOT kept").collect()
    assert {r.doc_id for r in got} == set(range(1, 8))
    assert "MapInArrow" in plans["near-live"] and "Broadcast" not in plans["near-live"]
    star = components._large_star(spark.createDataFrame([(k, 0) for k in range(1, 9)] + [(20, 8)], "u long, v long"))
    assert "explode" in _planned(star) and "Broadcast" not in _planned(star)
    assert {(r.u, r.v) for r in star.collect()} == {(k, 0) for k in range(1, 9)} | {(20, 0)}


def test_mix_broadcasts_sources_not_rows(spark, monkeypatch):
    rng, plans, drawn = random.Random(7), [], source_mix._drawn

    def seen(rows, *rest):
        plans.append(_planned(rows))
        return drawn(rows, *rest)

    monkeypatch.setattr(source_mix, "_drawn", seen)
    rows = [(i, words(rng, rng.randint(5, 30)), "en", f"s{i % 3}") for i in range(400)]
    assert source_mix.mix(documents(spark, rows)).count() == 400
    assert len(plans) == 3 and not any("BuildLeft" in p for p in plans)
