"""Tail fits over a grid summed by Spark, against the simplex on each book's exceedances."""

import datetime as dt

import numpy as np
import pytest

from panelforge.operators import solvers


def test_grid_equals_the_simplex(spark):
    rng = np.random.default_rng(3)
    planted = {"heavy": (0.4, 2.0), "light": (-0.3, 0.5), "plain": (1e-9, 1.0), "small": (0.1, 1e-4)}
    x = {b: s / k * ((1 - rng.random(800)) ** -k - 1) if abs(k) > 1e-6 else rng.exponential(s, 800) for b, (k, s) in planted.items()}
    x["few"] = np.ones(5)
    df = spark.createDataFrame([(b, float(v)) for b, e in x.items() for v in e], "book string, x double")
    got = {r.book: (r.xi, r.beta) for r in solvers.tail_fits(df).collect()}
    assert set(got) == set(planted)
    for b, (xi, beta) in got.items():
        want = solvers.gpd_fit(x[b])
        assert xi == pytest.approx(want[0], abs=2e-3) and beta == pytest.approx(want[1], rel=2e-3)
        assert xi == pytest.approx(planted[b][0], abs=0.12) and beta == pytest.approx(planted[b][1], rel=0.15)


def test_tails_of_books(spark):
    rng = np.random.default_rng(1)
    ret = -rng.standard_t(4, 1500) / 100
    rows = [("b", dt.date(2015, 1, 1) + dt.timedelta(days=i), float(r)) for i, r in enumerate(ret)] + [("short", dt.date(2015, 1, 1) + dt.timedelta(days=i), 0.01 * i) for i in range(20)] + [("b", dt.date(2030, 1, 1), None)]
    got = {r.book: r for r in solvers.evt_tails(spark.createDataFrame(rows, "book string, date date, ret double")).collect()}
    loss = -ret
    u = np.quantile(loss, 0.9)
    xi, beta = solvers.gpd_fit(loss[loss > u] - u)
    ratio = len(loss) / (loss > u).sum() * 0.01
    var = u + beta / xi * (ratio**-xi - 1)
    assert got["b"].threshold == pytest.approx(u) and got["b"].n_exceedances == 150
    assert got["b"].var == pytest.approx(var, rel=1e-3) and got["b"].es == pytest.approx((var + beta - xi * u) / (1 - xi), rel=1e-2)
    assert got["short"].n_exceedances == 2 and got["short"].xi is None and got["short"].es is None


def test_a_round_adds_to_the_plan_of_a_tail_fit_and_does_not_double_it(spark):
    from panelforge.operators import solvers

    x = spark.createDataFrame([("a", float(k)) for k in range(1, 40)], "book string, x double")
    joins = lambda n: solvers.tail_fits(x, 10, n)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(5) - joins(4) == joins(2) - joins(1)
