"""Block Gram matrices of returns."""

import datetime as dt

import numpy as np
import pytest

from panelforge.operators import allocation

DAY0 = dt.date(2020, 1, 1)


def rows_of(x, keep=None):
    return [(DAY0 + dt.timedelta(days=7 * i), f"n{j:04d}", float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if keep is None or keep[i, j]]


def test_moments_with_gaps_equal_pairwise_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.02, (90, 9)) + 5
    keep = rng.random((90, 9)) > 0.3
    keep[:, 8] = False
    keep[3, 8] = True  # one date only
    x[:, 7] = 0.25  # no variance
    df = spark.createDataFrame(rows_of(x, keep) + [(DAY0, "n0001", None)], "date date, name string, r double")
    got = {(r.i, r.j): (r["corr"], r.cov, r.distance) for r in allocation.correlations(df, names=4, days=100).collect()}
    for i in range(9):
        for j in range(9):
            on = keep[:, i] & keep[:, j]
            pair = (f"n{i:04d}", f"n{j:04d}")
            if not on.any():
                assert pair not in got
                continue
            corr, cov, distance = got[pair]
            if on.sum() < 2:
                assert corr is None and cov is None
                continue
            assert cov == pytest.approx(np.cov(x[on, i], x[on, j])[0, 1], abs=1e-12)
            assert corr is None if 7 in (i, j) else corr == pytest.approx(np.corrcoef(x[on, i], x[on, j])[0, 1])
            assert distance == (0.0 if i == j else None if corr is None else pytest.approx(np.sqrt(max(0, 0.5 * (1 - corr)))))


def test_keys_are_apart_and_empty_is_empty(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=(30, 5))
    rows = [("x", *r) for r in rows_of(x)] + [("y", *r) for r in rows_of(y)]
    df = spark.createDataFrame(rows, "book string, date date, name string, r double")
    got = {(r.book, r.i, r.j): r["corr"] for r in allocation.correlations(df, "book", names=2).collect()}
    assert len(got) == 9 + 25
    assert all(got["y", f"n{i:04d}", f"n{j:04d}"] == pytest.approx(np.corrcoef(y.T)[i, j]) for i in range(5) for j in range(5))
    assert allocation.correlations(df.where("false"), "book").count() == 0 and allocation.correlations(df.where("false")).count() == 0


def test_two_thousand_names(spark):
    """Tiles go to each block of names once: 32 x 32 tiles for 2,000 names, where a self-join on dates makes 2,000 x 2,000 x dates rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.02, (12, 2000))
    df = spark.createDataFrame(rows_of(x), "date date, name string, r double")
    assert allocation.tiles(df).count() == 32
    got = allocation.correlations(df)
    assert "Join" not in str(got._jdf.queryExecution().executedPlan().toString()).split("FlatMapGroupsInPandas")[0]
    some = {(r.i, r.j): r.cov for r in got.where("i IN ('n0000', 'n1999') AND j IN ('n0063', 'n0064', 'n1000')").collect()}
    assert len(some) == 6
    for (i, j), c in some.items():
        assert c == pytest.approx(np.cov(x[:, int(i[1:])], x[:, int(j[1:])])[0, 1], abs=1e-15)
