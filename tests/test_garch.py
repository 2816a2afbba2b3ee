"""Refits side by side."""

import datetime as dt
import math

import numpy as np
import pytest

from panelforge.operators import solvers

DAY0 = dt.date(2015, 1, 1)


def planted(n, omega, alpha, beta, seed):
    rng = np.random.default_rng(seed)
    v, out = omega / (1 - alpha - beta), []
    for _ in range(n):
        r = math.sqrt(v) * rng.normal()
        out.append(r)
        v = omega + alpha * r * r + beta * v
    return np.array(out)


def test_planted_parameters_come_back():
    x = planted(6000, 0.05, 0.10, 0.85, 3)
    got, _ = solvers.garch_fits(x, np.array([6000]))
    mu, omega, alpha, beta = got[0]
    assert abs(mu) < 0.05 and omega == pytest.approx(0.05, abs=0.03) and alpha == pytest.approx(0.10, abs=0.03) and beta == pytest.approx(0.85, abs=0.05)


def test_batch_equals_one_by_one():
    x = planted(420, 0.05, 0.1, 0.8, 5)
    ends = np.array([150, 300, 200, 420])
    both, ahead = solvers.garch_fits(x, ends)
    for e, p, v in zip(ends, both, ahead, strict=True):
        alone, one = solvers.garch_fits(x, np.array([e]))
        assert p == pytest.approx(alone[0]) and v == pytest.approx(one[0])
        path = [x[:e].var()]
        for r in x[:e]:
            path.append(p[1] + p[2] * (r - p[0]) ** 2 + p[3] * path[-1])
        assert v == pytest.approx(path[-1])


def test_flat_histories_have_no_fit(spark):
    got, _ = solvers.garch_fits(np.concatenate([np.zeros(100), planted(100, 0.1, 0.1, 0.8, 1)]), np.array([60, 200]))
    assert np.isnan(got[0]).all() and np.isfinite(got[1]).all()
    rows = [("s", DAY0 + dt.timedelta(days=i), float(r)) for i, r in enumerate(planted(300, 0.05, 0.1, 0.8, 2) / 100)]
    df = spark.createDataFrame([*rows, ("short", DAY0, 0.1), ("s", dt.date(2030, 1, 1), None)], "series string, date date, r double")
    few, many = (solvers.garch_forecasts(df, 10, 120, k).orderBy("series", "date").collect() for k in (3, 64))
    assert [(r.series, r.date, r.vol) for r in few] == [(r.series, r.date, r.vol) for r in many] and len(many) == 301
    assert all(r.vol is None for r in many[:120]) and all(r.vol > 0 for r in many[120:300]) and len({r.vol for r in many[120:300]}) == 18


def test_the_simplex_finds_minima():
    goal = np.array([[1.0, -2.0], [3.0, 0.5], [0.0, 0.0]])
    got = solvers.downhill(lambda q, on: ((q - goal[on]) ** 2).sum(1), np.zeros((3, 2)))
    assert got == pytest.approx(goal, abs=1e-4)


def test_the_path_of_given_parameters(spark):
    rows = [("a", DAY0 + dt.timedelta(days=i), r) for i, r in enumerate([0.01, None, -0.02, 0.0])]
    got = solvers.garch_path(spark.createDataFrame(rows, "series string, date date, r double"), 0.0, 1e-6, 0.1, 0.8, 1e-4).orderBy("date").collect()
    second = 1e-6 + 0.1 * 1e-4 + 0.8 * 1e-4
    third = 1e-6 + 0.1 * 4e-4 + 0.8 * second
    assert [r.v for r in got] == pytest.approx([1e-4, second, second, third])
