"""Boosted trees against a plain loop, calibration, ranks and permutations without a window over a whole key."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import boost, cv, ml, signals

DAY0 = dt.date(2020, 1, 1)


def sample(n=240, seed=1, width=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))).astype(float)
    return x, y


def plain_scores(x, y, w, trees, depth, rate, l2, least):
    """Each node tries every cut between neighbouring values of every feature, one by one."""
    base = np.log(np.average(y, weights=w) / (1 - np.average(y, weights=w)))
    raw = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p)
        step = np.zeros(len(y))

        def node(rows, level, g=g, h=h, step=step):
            best = (1e-12, None)
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
            if level < depth:
                for f in range(x.shape[1]):
                    for a, b in zip(np.unique(x[:, f]), np.unique(x[:, f])[1:], strict=False):
                        left, right = rows[x[rows, f] <= (a + b) / 2], rows[x[rows, f] > (a + b) / 2]
                        if len(left) >= least and len(right) >= least:
                            gain = score(left) + score(right) - score(rows)
                            if gain > best[0] + 1e-12:
                                best = (gain, (left, right))
            if best[1] is None:
                step[rows] = -g[rows].sum() / (h[rows].sum() + l2) * rate
            else:
                for part in best[1]:
                    node(part, level + 1)

        node(np.arange(len(y)), 0)
        raw = raw + step
    return raw


def test_boosting_equals_a_plain_loop():
    x, y = sample()
    w = np.random.default_rng(2).uniform(0.5, 2, len(y))
    model = boost.fit(x, y, w, trees=6, depth=3, rate=0.3, l2=1.0, least=15)
    assert boost.raw_scores(model, x, block=50) == pytest.approx(plain_scores(x, y, w, 6, 3, 0.3, 1.0, 15), abs=1e-9)
    assert boost.fit(x, np.ones(len(y))) is None and boost.fit(x[:0], y[:0]) is None


def test_few_bins_and_many_trees():
    x, y = sample(3000, 3)
    model = boost.fit(x + np.random.default_rng(0).normal(0, 1e-3, x.shape), y, bins=16)
    p = boost.probability(model, x)
    assert model.leaf.shape == (300, 8) and all(len(e) <= 15 for e in [boost.edges(np.random.default_rng(1).normal(size=999), 16)])
    assert np.mean((p >= 0.5) == y) > 0.75


def test_all_folds_at_once_equal_each_alone(spark):
    rows, want = [], {}
    for fold in range(3):
        x, y = sample(120, 10 + fold)
        want[fold] = boost.fit(x[np.lexsort((y, *x.T[::-1]))], y[np.lexsort((y, *x.T[::-1]))], trees=4)
        rows += [(fold, *map(float, v), float(t)) for v, t in zip(x, y, strict=True)]
    rows += [(9, 0.0, 0.0, 0.0, 1.0), (0, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, y double")
    got = boost.fit_all(df.repartition(7), ("fold",), "abc", trees=4)
    assert set(got) == {(0,), (1,), (2,)}  # fold 9 has one class
    for fold, m in want.items():
        assert all(np.allclose(u, v) for u, v in zip(got[fold,][:4], m[:4], strict=True))
    scored = boost.score_all(got, df, ("fold",), "abc").collect()
    assert len(scored) == 360
    r = scored[100]
    assert r.p == pytest.approx(boost.probability(got[r.fold,], np.array([[r.a, r.b, r.c]]))[0])


def test_the_sample_bounds_a_group(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("fold"), F.rand(1).alias("x"), (F.col("id") % 3 == 0).cast("double").alias("y"))
    n = boost.bounded(df, ("fold",), ("x",), 500).groupBy("fold").count().collect()
    assert all(400 < r["count"] < 600 for r in n) and boost.bounded(df, ("fold",), ("x",), 2000).count() == 4000


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration_is_the_mean_of_three(spark, method):
    rng = np.random.default_rng(4)
    x, y = sample(600, 5, len(signals.FEATURES))
    cols = ", ".join(f"{c} double" for c in signals.FEATURES)
    rows = [(k % 2, DAY0 + dt.timedelta(days=k // 4), f"t{k % 4}", *map(float, v), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, f"fold int, date date, ticker string, {cols}, y double")
    got = ml.fold_scores(df, df, calibrate=method, trees=20)
    p = got.toPandas()
    assert len(p) == 600 and p["p"].between(0, 1).all() and p["p"].mean() == pytest.approx(y.mean(), abs=0.06)
    assert p[p["y"] == 1]["p"].mean() > p[p["y"] == 0]["p"].mean() + 0.1
    knots = boost.isotonic(rng.normal(size=50), (rng.random(50) > 0.5).astype(float))
    assert (np.diff(knots[1]) >= 0).all() and (np.diff(knots[0]) >= 0).all()
    with pytest.raises(ValueError, match="unknown calibration"):
        boost.fit_all(df, ("fold",), signals.FEATURES, calibrate="other")


def test_places_and_permutations(spark):
    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("id"), F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), (F.col("id") % 2).cast("double").alias("y"))
    at = cv.places(rows.withColumn("_h", cv.turn(F.lit("s"), F.col("id"))), "_h", "id", "y", ranges=5).toPandas()
    for _, part in at.groupby("y"):
        assert sorted(part["place"]) == list(range(1, 251)) and part.sort_values("_h")["place"].is_monotonic_increasing
    dealt = ml.permuted(rows, ["a", "b"], 3).toPandas()
    assert len(dealt) == 3000
    orders = set()
    for (feature, repeat), part in dealt.groupby(["feature", "repeat"]):
        part = part.sort_values("id")
        changed, other = ("a", "b") if feature == "a" else ("b", "a")
        whole = rows.toPandas().sort_values("id")
        assert sorted(part[changed]) == sorted(whole[changed]) and (part[other].to_numpy() == whole[other].to_numpy()).all()
        orders.add(tuple(part[changed] / (1 if feature == "a" else 2)))
    assert len(orders) == 6  # each repeat and feature deals anew


def test_auc_of_ranges_equals_pairs(spark):
    rng = np.random.default_rng(6)
    p, y, k = np.round(rng.random(300), 2), (rng.random(300) > 0.4).astype(float), rng.integers(0, 2, 300)
    got = {r.k: r.auc for r in cv.auc(spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(k, p, y, strict=True)], "k int, p double, y double"), "k", ranges=7).collect()}
    for key in (0, 1):
        a, b = p[(k == key) & (y == 1)], p[(k == key) & (y == 0)]
        assert got[key] == pytest.approx(((a[:, None] > b) + 0.5 * (a[:, None] == b)).mean())


def test_importance_measures_what_was_not_learnt_from(spark):
    learn, rest = ml.held_out(spark.range(400).select("id"))
    assert learn.join(rest, "id").count() == 0 and 60 < rest.count() < 140
