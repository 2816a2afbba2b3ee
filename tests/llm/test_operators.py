"""Each operator on small tables: against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import components, language_id, line_dedup, near_dup, pieces, quality_classifier, quality_rules, source_mix, top_k, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars int, score double, size string, component_id string, ids string, key string"


def documents(spark, rows):
    full = [(i, t, lang, src, len(t or ""), 0.5, "size", "c", "x", "k") for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng, n):
    return " ".join("".join(rng.choices(string.ascii_lowercase[:8], k=rng.randint(1, 5))) for _ in range(n))


def odd_rows():
    """Nulls, empties, a long text, repeated rows."""
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "x" * 30_000, "en", "b"), (5, "Alpha beta. " * 3_000, "en", "b"), (6, "same text here for all of us", "en", "a"), (6, "same text here for all of us", "en", "a"), (None, "no id at all", "fr", "z"), (7, "123 456 !!", "de", None)]


# --- 1 ---------------------------------------------------------------------------------------


def test_top_k_wide_components_ragged_and_ties(spark):
    """Components beyond 32 bits, scores beyond 53 and 64 bits, ragged and empty vectors, equal rows in different blocks."""
    kind = "vec_id long, embedding array<double>"
    for scale in (1.0, 2.0**20):
        rows = [(i, [((i * 7) % 5 - 2) * scale, ((i * 3) % 7 - 3) * scale, 0.5][: 1 + i % 3]) for i in range(40)] + [(60, []), (70, [3 * scale, scale]), (71, [3 * scale, scale])]
        exact = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
        want = []
        for i in exact:
            if i % 10 == 0:
                scored = sorted((-sum(a * b for a, b in zip(exact[i], exact[j], strict=False)), j) for j in exact if j != i)[:5]
                want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
        for block in (3, 8192):
            got = top_k.search(spark.createDataFrame(rows, kind), top_k.every(step=10), block=block)
            assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    wide = spark.createDataFrame([(0, [0.5, 1.0]), (1, [2.0**40, 3.0]), (2, [2.0**40, 1.0]), (3, [-(2.0**40), 1.0])], kind)
    assert [tuple(r)[2:] for r in top_k.search(wide, top_k.every()).orderBy("rank").collect()] == [(1, 2**55 + 3 * 2**16), (2, 2**55 + 2**16), (3, 2**16 - 2**55)]
    far = spark.createDataFrame([(0, [2.0**60]), (1, [2.0**50]), (2, [-(2.0**60)])], kind)
    assert [tuple(r)[2:] for r in top_k.search(far, top_k.every()).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]


def brute_top(vectors, k, every):
    good = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        good[i] = min(good.get(i, q), q)
    out = []
    for i in good:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(good[i], good[j], strict=False)), j) for j in good if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 8192])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=12) * rng.choice([0.1, 1, 5])]) for i in range(120)]
    rows += [(200, rows[50][1]), (201, rows[50][1]), (300, None), (301, [1.0, None]), (302, [float("nan")] * 12), (400, [0.0] * 12), (250, [-1.0] * 12), (None, [1.0] * 12), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = sorted(tuple(r) for r in top_k.search(df, top_k.every(), block=block).collect())
    assert got == brute_top(rows, 5, 50)


def test_top_k_few_rows_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], kind)
    assert [tuple(r) for r in top_k.search(one, top_k.every()).collect()] == [(0, 1, 1, 256 * 256 * 3)]
    assert top_k.search(spark.createDataFrame([], kind), top_k.every()).count() == 0


# --- 2, 7, 4 ---------------------------------------------------------------------------------


def labelled(rng, n, bad, good):
    rows = []
    for i in range(n):
        y = i % 3 == 0
        t = words(rng, 40).split()
        t.insert(rng.randint(0, 39), bad if y else good)
        rows.append((i, " ".join(t), int(y)))
    return rows


@pytest.mark.parametrize("operator", [quality_classifier, toxicity])
def test_classifiers_learn_and_hold_edges(spark, operator):
    rng = random.Random(5)
    if operator is quality_classifier:
        rows = [(i, (words(rng, 40).upper() + "!!" if i % 3 == 0 else words(rng, 40)), int(i % 3 != 0)) for i in range(300)]
        column = "quality"
    else:
        rows, column = labelled(rng, 400, "zzinsult", "qqpraise"), "toxic"
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows if i % 5] + [(1, 1, "x"), (1, 0, "x"), (None, 1, "x")], f"doc_id long, {column} int, score string")
    docs = documents(spark, [(i, t, "en", "s") for i, t, _ in rows] + [(1000 + k, *r[1:]) for k, r in enumerate(odd_rows())])
    got = operator.score(docs, operator.fit(docs, labels)).collect()
    assert len(got) == len(rows) + len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [(truth[r.doc_id], r.score) for r in got if r.doc_id < 1000 and r.doc_id % 5 == 0]
    high = np.mean([s for y, s in held if y]) - np.mean([s for y, s in held if not y])
    assert high > 0.5
    none = operator.score(docs.limit(3), operator.fit(docs, labels.where("false"))).collect()
    assert all(abs(r.score - 0.5) < 1e-9 for r in none)
    assert operator.score(docs.where("false"), operator.fit(docs, labels)).count() == 0


def test_factorization_machine_learns_a_pair():
    ids = np.arange(4)
    rows, y = [], []
    for _ in range(200):
        for r, label in (([0, 1], 1.0), ([0, 2], 0.0), ([1, 3], 0.0), ([2, 3], 1.0)):
            rows.append(np.array(r))
            y.append(label)
    w, v = toxicity.train(rows, np.array(y), 4, ids * 7919 + 1, 40, 4)
    score = [w[r].sum() + w[-1] + 0.5 * (v[r].sum(0) @ v[r].sum(0) - (v[r] ** 2).sum()) for r in rows[:4]]
    assert min(score[0], score[3]) > max(score[1], score[2])


@pytest.mark.parametrize("filler", [0, 30])
def test_factorization_machine_learns_rare_pairs(filler):
    """Two pairs of terms are toxic, the same terms crosswise are not: each is harmless alone, each in 4 % of the texts."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for k in range(4000):
        r = set((4 + rng.choice(500, filler, replace=False)).tolist()) if filler else {4 + k % 7}
        kind = k % 50
        if kind < 4:
            r |= set(((0, 1), (0, 2), (1, 3), (2, 3))[kind])
        rows.append(np.array(sorted(r)))
        y.append(1.0 if kind in (0, 3) else 0.0)
    size = 504
    w, v = toxicity.train(rows, np.array(y), size, np.arange(size) * 7919 + 1, toxicity.EPOCHS, toxicity.FACTORS)
    p = [float(toxicity._sigmoid(toxicity.logit(r, w[:-1], v, w[-1]))) for r in rows]
    toxic = [x for x, label in zip(p, y, strict=True) if label]
    clean = [x for x, label in zip(p, y, strict=True) if not label]
    assert np.mean(np.array(toxic) >= toxicity.THRESHOLD) > 0.9 and np.mean(np.array(clean) >= toxicity.THRESHOLD) < 0.02
    assert (v != 0).all()


def test_factorization_machine_equals_double_loop(spark):
    """Scores of the query's path against the sum over all pairs."""
    texts = ["Insult the group", "the group", "insulting groups, twice insulting", "", None, "unknown words alone"]
    known = np.unique(np.concatenate([toxicity.terms(t) for t in texts[:3]]))
    rng = np.random.default_rng(2)
    w, v, bias = rng.normal(size=len(known)), rng.normal(size=(len(known), 4)), -0.3
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r.score for r in toxicity.score(docs, (known, w, v, bias)).collect()}
    for i, t in enumerate(texts):
        at = [int(np.flatnonzero(known == x)[0]) for x in toxicity.terms(t) if x in known]
        x = bias + sum(w[a] for a in at) + sum(float(v[a] @ v[b]) for k, a in enumerate(at) for b in at[k + 1 :])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-x)))


@pytest.mark.parametrize("operator", [quality_classifier, toxicity])
def test_classifiers_one_class_and_null_texts(spark, operator):
    column = "quality" if operator is quality_classifier else "toxic"
    docs = documents(spark, [(i, None if i < 20 else "only some words here", "en", "s") for i in range(40)])
    labels = spark.createDataFrame([(i, 1) for i in range(40)], f"doc_id long, {column} int")
    for some in (labels, labels.where("doc_id < 20"), labels.where("doc_id = 3")):
        got = operator.score(docs, operator.fit(docs, some)).collect()
        assert len(got) == 40 and all(r.score > 0.5 for r in got)


def test_ftrl_equals_plain_updates():
    """Against FTRL-proximal written for one weight at a time."""
    rng = np.random.default_rng(4)
    rows = [(np.append(np.sort(rng.choice(20, 5, replace=False)), 20), np.append(rng.random(5) * 16, 1.0)) for _ in range(60)]
    y = (rng.random(60) < 0.5).astype(float)
    z, n = [0.0] * 21, [0.0] * 21
    alpha, beta, l1, l2 = quality_classifier.ALPHA, quality_classifier.BETA, quality_classifier.L1, quality_classifier.L2

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(3):
        for (at, x), label in zip(rows, y, strict=True):
            w = [weight(i) for i in at]
            p = 1 / (1 + np.exp(-np.clip(sum(a * b for a, b in zip(w, x, strict=True)), -35, 35)))
            for i, wi, xi in zip(at, w, x, strict=True):
                g = (p - label) * xi
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * wi
                n[i] += g * g
    assert np.allclose(quality_classifier.ftrl(rows, y, 20, 3), [weight(i) for i in range(21)])


def test_language_equals_sets(spark):
    """The filter's answers against plain sets of n-grams; a text over one piece, repeated rows, ties, an empty table."""
    rng = random.Random(6)
    make = {"aa": "abcdef", "bb": "defghi", "cc": "ghijka"}  # shared letters: some n-grams are in two languages
    rows = [(i, " ".join("".join(rng.choices(make[k], k=4)) for _ in range(30)), k, "s") for i, k in enumerate(list(make) * 40)]
    docs = documents(spark, rows + rows[:1])
    model = language_id.fit(docs.where("doc_id < 90"), bits=20)
    sets = {k: set() for k in make}
    counts = {k: Counter() for k in make}
    for _, t, k, _ in (r for r in rows + rows[:1] if r[0] < 90):
        counts[k].update(language_id.grams(t).tolist())
    for k, c in counts.items():
        sets[k] = {g for g, n in c.items() if n / c.total() >= language_id.SHARE}
    got = {}
    for r in language_id.predict(docs, model).collect():
        assert got.setdefault(r.doc_id, (r.lang_pred, r.score)) == (r.lang_pred, r.score)
    for i, t, _, _ in rows:
        hits = {k: sum(g in s for g in language_id.grams(t).tolist()) for k, s in sets.items()}
        assert got[i][0] == max(sorted(hits), key=hits.get)
        assert got[i][1] == pytest.approx(max(hits.values()) / sum(hits.values()), abs=0.02)
    assert language_id.predict(docs.where("false"), model).count() == 0
    tie = language_id.fit(documents(spark, [(1, "abc abc", "x", "s"), (2, "abc abc", "b", "s")]))
    assert language_id.predict(documents(spark, [(9, "abc", None, None)]), tie).first().lang_pred == "b"
    text = "".join(rng.choices("abc de", k=1000))
    assert np.array_equal(np.sort(language_id.grams(text)), np.sort(np.concatenate(list(language_id.pieces(text, piece=64)))))


def test_language_filter(spark):
    rng = random.Random(2)
    make = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rows = [(i, " ".join("".join(rng.choices(make[k], k=4)) for _ in range(30)), k, "s") for i, k in enumerate(list(make) * 30)]
    docs = documents(spark, rows)
    model = language_id.fit(docs.where("doc_id % 3 <> 99 AND doc_id < 60"))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k, _ in rows)
    edge = {r.doc_id: r for r in language_id.predict(documents(spark, [(1, None, "aa", "s"), (2, "", "aa", "s"), (3, "12 !!", "aa", "s"), (4, "abc " * 9000, None, None)]), model).collect()}
    assert [edge[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "aa"]
    nothing = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs.limit(3), nothing).collect()} == {"und"}


# --- 3 ---------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é" + "y" * 50_000
    rows = [(5, "u5", "a" * 100), (3, "u3", "a" * 100), (9, None, "a" * 100), (1, "u\n1", None), (2, "u2", ""), (4, "u4", "short"), (6, "u6", "short"), (7, "u7", long), (8, "u8", long), (7, "u7", long), (11, "u11", "WARC/1.1\r\n\r\nnot a record")]
    df = spark.createDataFrame([(i, u, h, "t") for i, u, h in rows], "page_id long, url string, html string, warc_type string").repartition(3)
    got = sorted(tuple(r) for r in warc.round_trip(df).collect())
    low = {}
    for i, _, h in rows:
        low[h or ""] = min(low.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i != low[h or ""]
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", low[h or ""] if again else None))
    assert got == sorted(want, key=lambda r: r[:4])
    assert warc.round_trip(df.where("false")).count() == 0
    nulls = spark.createDataFrame([(None, "a", "n" * 200), (None, "b", "n" * 200), (None, "c", "m" * 200), (4, "d", "m" * 200)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(nulls).collect()), key=str)
    assert got == sorted([(None, "response", None), (None, "response", None), (None, "revisit", 4), (4, "response", None)], key=str)
    warc.write(df, str(tmp_path / "w"))
    back = warc.read(spark, f"file://{tmp_path}/w").where("target_uri = 'u7' AND warc_type = 'response'")
    assert {bytes(r.payload) for r in back.collect()} == {long.encode()}
    plan = back._jdf.queryExecution().toString()
    assert "PushedFilters" in plan or "BatchScan" in plan


def test_warc_reads_members_without_sizes(spark, tmp_path):
    import gzip

    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc.record("response", f"<urn:page:{i}>", f"u{i}", "d", b"p" * (70_000 + i), 70_000 + i)) for i in range(3)))
    got = warc.read(spark, f"file://{tmp_path}").collect()
    assert [len(r.payload) for r in got] == [70_000, 70_001, 70_002]
    assert warc.read(spark, f"file://{tmp_path}", payload=False).where("record_id = '<urn:page:1>'").count() == 1


def test_warc_members_too_large_for_their_field(spark, tmp_path):
    data = [warc.record("response", f"<urn:page:{i}>", f"u{i}", "d", b"p" * (5000 * i), 5000 * i) for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.member(x, most=6000) for x in data))
    assert [len(r.payload) for r in warc.read(spark, f"file://{tmp_path}").collect()] == [0, 5000, 10000]


# --- 5 ---------------------------------------------------------------------------------------


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def brute_lines(rows, least):
    blanks = " \t\r\x0b\x0c"
    at = sorted({(i, p, x.strip(blanks)) for i, t in rows if i is not None and t is not None for p, x in enumerate(t.split("\n")) if x.strip(blanks)})
    gone = {(i, p) for k, (i, p, x) in enumerate(at) if any(x == y or min(len(x), len(y)) >= least and within_one(x, y) for _, _, y in at[:k])}
    return {(i, t): (t if t is None or i is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)) for i, t in rows}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    pool = [words(rng, 8) for _ in range(12)]

    def edited(s):
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(s))
            s = rng.choice([s[:k] + s[k + 1 :], s[:k] + "é" + s[k:], s[:k] + "q" + s[k + 1 :]])
        return s

    rows = [(i, "\n".join(rng.choice(["", "short", "shor", "x" * 19, "x" * 20, " " + edited(rng.choice(pool)) + " "]) for _ in range(6))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, pool[0]), (102, "z" * 20_000), (103, "z" * 20_001), (104, "z" * 20_002), (0, rows[0][1])]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    out = line_dedup.dedup(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    want = brute_lines(rows, line_dedup.EDIT_CHARS)
    assert got == Counter((i, want[i, t]) for i, t in rows)
    assert line_dedup.dedup(docs.where("false")).count() == 0


def test_line_dedup_ids_and_names(spark):
    """Two texts under one id, ids that are no numbers, columns named as the result's."""
    line = "a line of more than twenty characters"
    rows = [("b", f"{line}\nonly in the first text", 1), ("b", f"one\ntwo\nthree\n{line}", 2), ("a", line[:-1], 3), ("b", f"one\ntwo\nthree\n{line}", 4)]
    docs = spark.createDataFrame([(i, t, k, 9, "k") for i, t, k in rows], "doc_id string, text string, doc int, n_lines int, kept_places string")
    out = line_dedup.dedup(docs)
    assert set(out.columns) == {"doc_id", "text", "doc", "n_lines", "n_removed", "kept_places"}
    got = {r.doc: (r.text, r.n_lines, r.n_removed, r.kept_places) for r in out.collect()}
    assert got[3] == (line[:-1], 1, 0, "k") and got[1] == ("only in the first text", 2, 1, "k")
    assert got[2] == got[4] == ("one\ntwo\nthree", 4, 1, "k")
    assert line_dedup.dedup(docs, counts=False).columns == docs.columns


# --- 6 ---------------------------------------------------------------------------------------


def test_mix_targets_and_takes(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(0, 60)), "en", rng.choice(["a", "b", "b", "b", "b", "é", None])) for i in range(600)]
    rows += [(900, None, "en", "a"), (901, "", None, None), (3, rows[3][1], "en", rows[3][3])]
    docs = documents(spark, rows)
    got = source_mix.mix(docs).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    taken = Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * int(r["size"]) and r.taken == r.copies * int(r["size"])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 61 for s in order)
    again = source_mix.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    assert source_mix.mix(docs.where("false")).count() == 0
    nulls = source_mix.mix(documents(spark, [(None, "one two three", "en", "a"), (None, "one two three", "en", "a"), (1, "four five", "en", "b")])).collect()
    assert len(nulls) == 3 and len({r.taken for r in nulls if r.doc_id is None}) == 1
    heavier = source_mix.mix(docs.withColumn("w", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)), weight="w")
    even = heavier.groupBy((F.col("doc_id") % 2 == 0).alias("e")).agg((F.sum("taken") / F.sum("size")).alias("x")).collect()
    rate = {r.e: r.x for r in even}
    assert rate[True] > rate[False]


# --- 8 ---------------------------------------------------------------------------------------


def brute_groups(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    rows, i = [], 0
    for _ in range(10):
        base = words(rng, 60).split()
        for _ in range(rng.randint(1, 30)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = words(rng, 1)
            rows.append((i, " ".join(t)))
            i += 1
    rows += [(500, None), (501, ""), (502, "one two"), (503, "ONE  two"), (504, "two one"), (505, words(rng, 20_000)), (None, rows[0][1]), (0, rows[0][1])]
    docs = documents(spark, [(k, t, "en", "s") for k, t in rows])
    got = near_dup.near_duplicates(docs, span=4).collect()
    assert len(got) == len(rows)
    want = brute_groups(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_dup.near_duplicates(docs.where("false")).count() == 0


def test_near_duplicates_two_texts_under_one_id(spark):
    """A document with two texts links through either; a head with many outsiders fills several cells."""
    rng = random.Random(12)
    a, b = words(rng, 40), words(rng, 40)
    rows = [(1, a), (2, b), (5, a + " more"), (5, b + " more"), (9, words(rng, 40))]
    docs = documents(spark, [(k, t, "en", "s") for k, t in rows])
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, span=4).collect())
    assert got == Counter({(1, 1, True): 1, (2, 1, False): 1, (5, 1, False): 2, (9, 9, True): 1})


def test_near_duplicates_in_cells(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "DEAL", 4)
    monkeypatch.setattr(near_dup, "CELL", 4)
    rng = random.Random(14)
    base = words(rng, 60).split()
    rows = []
    for i in range(60):
        t = list(base)
        for k in range(i % 12):
            t[5 * k] = words(rng, 1)
        rows.append((i, " ".join(t)))
    docs = documents(spark, [(k, t, "en", "s") for k, t in rows])
    want = brute_groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, span=4).collect()} == want


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (10, 11), (11, 12), (12, 10), (7, 7), (None, 3), (2, 1), (20, 19)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10, 19: 19, 20: 19}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 9 ---------------------------------------------------------------------------------------


def test_pieces_are_best_and_round_trip(spark):
    model = pieces.read_model()
    coder = pieces.Coder(model)
    known = {p: (s, i) for i, (p, s, on) in enumerate(model) if on}

    def best(s):
        x = [0.0]
        for p in range(1, len(s) + 1):
            x.append(max([x[p - 1] + coder.unknown, *(x[p - k] + known[s[p - k : p]][0] for k in range(1, min(p, 24) + 1) if s[p - k : p] in known)]))
        return x[-1]

    texts = ["Hello world", " two  blanks ", "a▁b", "日本 😀 x", "tabs\tand\nlines", "q" * 300, "", "▁", "É" * 40 + "word"]
    for t in texts:
        ids = np.frombuffer(coder.encode(t), np.int32).tolist()
        assert coder.decode(ids) == t
        if t and "▁" not in t and all(i not in coder.byte_id.values() for i in ids):
            assert sum(model[i][1] for i in ids) == pytest.approx(best("▁" + t.replace(" ", "▁")))
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)] + [(99, None, None, None), (1, texts[1], "en", "s"), (98, "word " * 40_000, "en", "s")])
    plain = pieces.Coder([("<unk>", 0.0, False), ("▁a", -1.0, True), ("b", -2.0, True)])
    assert np.frombuffer(plain.encode("ab?"), np.int32).tolist() == [1, 2, 0] and plain.decode([1, 2, 0]) == "ab"
    coded = pieces.encode(docs)
    assert dict(coded.dtypes)["ids"] == "array<int>" and set(coded.columns) == set(docs.columns)
    back = pieces.decode(coded).collect()
    assert all(r.decoded == r.text for r in back) and [r for r in back if r.doc_id == 99][0].ids is None
    assert pieces.decode(pieces.encode(docs.where("false"))).count() == 0


# --- 10 --------------------------------------------------------------------------------------


def brute_stats(t):
    import re

    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed


def test_quality_rules(spark):
    rng = random.Random(9)
    rows = [(k, t, "en", "s") for k, (_, t, _, _) in enumerate(odd_rows())]
    rows += [(50 + k, "\n".join(words(rng, rng.randint(0, 12)) + rng.choice(["", " é|#"]) for _ in range(8)), "en", "s") for k in range(40)]
    rows += [(200, "a b c d e f g\n" * 5, "en", "s"), (201, words(rng, 100).upper(), "en", "s"), (202, "a b c d e x a b c d e " + words(rng, 80), "en", "s"), (200, "a b c d e f g\n" * 5, "en", "s")]
    docs = documents(spark, rows)
    order = [x[0] for x in quality_rules.plan(docs)]
    assert sorted(order) == sorted(r.__name__ for r in quality_rules.RULES)
    got = quality_rules.apply(docs, order).collect()
    texts = {k: t for k, t, _, _ in rows}
    for r in got:
        *stats, failed = brute_stats(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == stats and r.base_failed == failed
        t = quality_rules.Text(texts[r.doc_id])
        assert r.kept == (not failed and not any(rule(t) for rule in quality_rules.RULES))
    other = {(r.doc_id, r.kept) for r in quality_rules.apply(docs, order[::-1]).collect()}
    assert other == {(r.doc_id, r.kept) for r in got}
    assert quality_rules.apply(docs.where("false")).count() == 0
