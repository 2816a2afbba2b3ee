"""Operators 11 to 13: against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random

import numpy as np
import pytest

from panelforge.llm import hard_negatives, periodic_runs, suffix_dedup, top_k

TEXTS = "doc_id long, text string, start long, length string, runs string, block string, kept string"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, 7, "l", "r", "b", "k") for i, t in rows], TEXTS)


# --- 11 --------------------------------------------------------------------------------------


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(12, 2 * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


def random_words(rng):
    k, n = rng.choice([1, 2, 3, 9]), rng.choice([0, 1, 5, 12, 30, 80, 150])
    w = [rng.choice("abcdefghi"[:k]) for _ in range(n)]
    if n > 20 and rng.random() < 0.6:
        p, a = rng.randint(1, 20), rng.randrange(n)
        for i in range(a + p, n):
            w[i] = w[i - p]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(n)] = "x"
    return w


def test_runs_equal_brute_force():
    rng = random.Random(7)
    for _ in range(150):
        docs = [random_words(rng) for _ in range(rng.randint(1, 6))]
        number = {}
        w = np.array([number.setdefault(x, len(number)) for d in docs for x in d], np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        first = np.cumsum([0] + [len(d) for d in docs])
        start, end, period = periodic_runs.runs(w, doc)
        got = sorted((int(doc[s]), int(s - first[doc[s]]), int(e - s), int(q)) for s, e, q in zip(start, end, period, strict=True))
        assert got == sorted((k, *r) for k, d in enumerate(docs) for r in brute_runs(d))


def test_grammar_derives_the_text():
    rng = random.Random(2)
    w = np.array([rng.randrange(3) for _ in range(300)], np.int64)
    seq, at, left, right, place = periodic_runs.repair(w, np.zeros(300, np.int64))
    first = int(w.max()) + 1

    def spell(x):
        return [x] if x < first else spell(left[x - first]) + spell(right[x - first])

    assert [y for x in seq for y in spell(x)] == w.tolist() and len(seq) < 150
    for r, p in enumerate(place):
        body = spell(first + r)
        assert w[p : p + len(body)].tolist() == body
    lo, mid, hi, _, _ = periodic_runs.nodes(w, np.zeros(300, np.int64))
    assert (lo < mid).all() and (mid < hi).all()


def test_periodic_runs_of_odd_rows(spark):
    again = " ".join(["la", "li"] * 6)
    long = " ".join(["tick"] * 20_000)
    line = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \n "), (4, again), (4, again), (None, "a " + again + " b"), (5, long), (6, f"{line} {line} {line}"), (7, "une autre\nphrase à dire"), (8, "x " * 11)]
    found = periodic_runs.find(texts(spark, rows)).collect()
    by = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed) for r in found}
    assert len(found) == len(rows)
    assert by[1, 0] == by[2, 0] == by[3, 0] == ([], "")
    assert by[4, 12] == ([(0, 12, 2)], "la li") and by[None, 14] == ([(1, 12, 2)], "a la li b")
    assert by[5, 20_000] == ([(0, 20_000, 1)], "tick") and by[6, 120] == ([(0, 120, 40)], line)
    assert by[7, 5][1] == "une autre phrase à dire" and by[8, 11] == ([], " ".join("x" * 11))
    empty = periodic_runs.digest(periodic_runs.find(texts(spark, [])))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    row = periodic_runs.digest(periodic_runs.find(texts(spark, [(9, again + " " + again)]))).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 24, 2, 12000)
    assert row.runs_sha256 == hashlib.sha256(b"0,24,2\n").hexdigest() and row.collapsed_sha256 == hashlib.sha256(b"la li").hexdigest()


# --- 12 --------------------------------------------------------------------------------------


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for trial in range(60):
        n = rng.randint(1, 300)
        t = bytes(rng.choice([0, 1, 97, 98] if trial % 2 else [97]) for _ in range(n))
        x = np.frombuffer(t, np.uint8)
        sa = suffix_dedup.suffix_array(x)
        want = sorted(range(n), key=lambda i: t[i:])
        assert sa.tolist() == want

        def shared(a, b):
            k = 0
            while k < 50 and max(a, b) + k < n and t[a + k] == t[b + k]:
                k += 1
            return k

        assert suffix_dedup.common_prefixes(x, sa, 50, lanes=rng.choice([1, 3, 8])).tolist() == [0] + [shared(want[r], want[r - 1]) for r in range(1, n)]


def brute_cut(rows, length):
    first = {}
    for i, b in rows:
        if i is not None:
            for at in range(len(b) - length + 1):
                s = b[at : at + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, b in rows:
        gone = [False] * (len(b) + 1)
        if i is not None:
            for at in range(len(b) - length + 1):
                if first[b[at : at + length]] < i:
                    gone[at : at + length] = [True] * length
        spans = [k for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((i, len(b), sum(gone), len(spans), bytes(c for c, g in zip(b, gone, strict=False) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [{}, {"block_bytes": 700, "shard_bytes": 300, "hot": 3, "bucket_bytes": 900}, {"block_bytes": 1, "shard_bytes": 1, "bucket_bytes": 1 << 20}])
def test_suffix_dedup_equals_brute_force(spark, small):
    rng = random.Random(4)
    phrase = "a passage of quite some length that a number of documents share, word for word"
    line = "License: all of the rights reserved by nobody"
    rows = []
    for i in range(60):
        body = " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(rng.randint(0, 30)))
        if i % 5 == 0:
            body = body[:40] + phrase[rng.randint(0, 9) :] + body[40:]
        if i % 3 == 0:
            body += "\n" + line + " " + body[:15]
        rows.append((100 - i, body))
    rows += [(3, rows[5][1]), (3, rows[5][1]), (200, rows[7][1]), (200, rows[8][1] + rows[7][1]), (4, "ab" * 400), (5, "ab" * 300), (6, "\0" * 120), (7, "\0" * 80 + "x")]
    rows += [(None, phrase * 2), (None, rows[6][1]), (1, None), (2, ""), (8, "short"), (9, "x" * 49), (10, "x" * 50), (11, "x" * 51)]
    got = suffix_dedup.dedup(texts(spark, rows), **small).collect()
    got = sorted(((r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), bytes(r.kept)) for r in got), key=repr)
    assert got == brute_cut([(i, (t or "").encode()) for i, t in rows], 50)


def test_suffix_dedup_lengths_and_empty(spark):
    rows = [(1, "the quick brown fox"), (2, "a quick brown dog"), (3, "zzzzzzzz"), (4, "zzzz")]
    for length in (4, 9, 20):
        got = suffix_dedup.dedup(texts(spark, rows), length=length).collect()
        assert sorted(((r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), bytes(r.kept)) for r in got), key=repr) == brute_cut([(i, t.encode()) for i, t in rows], length)
    assert suffix_dedup.dedup(texts(spark, [])).count() == 0
    long = "".join(random.Random(1).choices("abcdefgh ", k=300_000))
    got = {r.doc_id: (r.n_bytes, len(r.kept)) for r in suffix_dedup.dedup(texts(spark, [(1, long), (2, long[1000:] + "new")]), block_bytes=100_000).collect()}
    assert got == {1: (300_000, 300_000), 2: (299_003, 3)}


# --- 13 --------------------------------------------------------------------------------------


def brute_negatives(rows, every, positives=5, negatives=10):
    good = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            entry = ([int(np.floor(256 * x)) for x in v], label)
            good[i] = min(good.get(i, entry), entry)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (q, label) in good.items():
        if a % every:
            continue
        scored = sorted((-dot(q, w), i) for i, (w, _) in good.items() if i != a)
        for ps, p in [x for x in scored if good[x[1]][1] == label][:positives]:
            fits = [x for x in scored if good[x[1]][1] != label and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:negatives]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("block", [5, 8192])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", max(2, block // 4))
    monkeypatch.setattr(hard_negatives, "RUN", 2 if block < 100 else 32)
    rng = np.random.default_rng(8)
    kind = "vec_id long, embedding array<double>, label int, rank string, positive_id int"
    for scale in (1.0, 2.0**14, 2.0**19):
        base = rng.normal(size=(3, 11))
        rows = [(int(i), [float(x) for x in (base[i % 3] + 0.5 * rng.normal(size=11 - i % 2)[: 11 - i % 2].tolist()[0]) * scale][: 11 - i % 2], int(rng.integers(0, 3))) for i in range(90)]
        rows += [(200, rows[10][1], 0), (201, rows[10][1], 0), (202, rows[10][1], 1), (10, rows[11][1], 2), (300, None, 1), (301, [1.0, None], 1), (302, [float("inf")], 1), (310, rows[3][1], None), (None, [1.0], 1), (400, [0.0] * 11, 1), (410, [], 2), (420, [-x for x in rows[1][1]], 0), (500, [1.0, 2.0], 77)]
        df = spark.createDataFrame([(i, v, x, "r", 1) for i, v, x in rows], kind)
        got = sorted(tuple(r) for r in hard_negatives.mine(df, top_k.every(step=10)).collect())
        assert got == brute_negatives(rows, 10) and got


def test_hard_negatives_none(spark):
    kind = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [1.0], 2)], [(100, None, 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (1, [2.0], 2)]):
        assert hard_negatives.mine(spark.createDataFrame(rows, kind), top_k.every(step=100)).count() == 0


def test_subset_tables_score_exactly():
    rng = np.random.default_rng(0)
    a, x = rng.integers(-300, 300, (7, 13)), rng.integers(-900, 900, (50, 13))
    planes = hard_negatives.planes_of(int(x.min()), int(x.max()))
    for kind in (np.int32, np.int64, object):
        assert (hard_negatives.scores(hard_negatives.subset_sums(a.astype(kind)), hard_negatives.pack(x, planes)) == x @ a.T).all()
    assert hard_negatives.width(a, planes) is np.int32 and hard_negatives.width(a * 2**30, planes) is np.int64 and hard_negatives.width(a * 2**50, planes) is object


def test_registered(spark):
    import __spark_entry__ as entry

    assert {"op11_periodic_runs", "op12_suffix_dedup", "op13_hard_negatives"} <= set(entry.queries()) & set(entry.oracle_sql())
    shifted = spark.createDataFrame([(7, 9), (8, 9), (14, None)], "vec_id long, label int").select(hard_negatives.shifted().alias("x")).collect()
    assert [r.x for r in shifted] == [0, 9, None]
