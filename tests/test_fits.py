"""Fits without SQL: planted parameters must come back, and solves must equal a plain computation."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import account, allocation, ml, options, panel, performance, signals, smiles, solvers

DAY0 = dt.date(2020, 1, 1)


def dates(n):
    return [DAY0 + dt.timedelta(days=i) for i in range(n)]


def test_svi_recovers_planted_slices():
    rng = np.random.default_rng(0)
    n = 60
    k = np.tile(np.linspace(-0.4, 0.4, 9), (n, 1))
    planted = np.stack([rng.uniform(0.01, 0.05, n), rng.uniform(0.05, 0.3, n), rng.uniform(-0.7, 0.4, n), rng.uniform(-0.1, 0.1, n), rng.uniform(0.08, 0.3, n)], 1)
    w = smiles.svi(k, planted)
    pad = lambda x: np.concatenate([x, np.zeros((n, 2))], 1)
    got = smiles.svi_fit(pad(k), pad(w), pad(np.full_like(w, 10.0)))
    assert np.median(np.abs(got - planted)) < 1e-6 and np.abs(smiles.svi(k, got) - w).max() < 1e-3
    assert (got[:, 1] >= 0).all() and (np.abs(got[:, 2]) <= 0.999).all() and (got[:, 4] > 0).all()


def test_svi_penalty_keeps_butterflies_out():
    k = np.linspace(-0.4, 0.4, 9)[None]
    w = smiles.svi(k, np.array([[0.005, 0.6, -0.9, 0.1, 0.02]]))
    s = np.full_like(w, 1.0)
    grid = np.linspace(-0.9, 0.9, smiles.GRID)[None]
    free, kept = smiles.svi_fit(k, w, s), smiles.svi_fit(k, w, s, no_butterfly=True)
    assert smiles.svi_g(grid, free).min() < 0 and smiles.svi_g(grid, kept).min() > -1e-3
    rmse = lambda p: float(np.sqrt(((smiles.svi(k, p) - w) ** 2).mean()))
    assert rmse(free) < rmse(kept)


def test_surface_recovers_and_never_falls_in_time(spark):
    k = np.linspace(-0.3, 0.3, 8)
    rows = []
    for u, thetas in ((1, (0.01, 0.02, 0.04)), (2, (0.02, 0.015, 0.03)), (3, (0.02,))):
        for t, theta in zip((0.25, 0.5, 1.0), thetas, strict=False):
            w = smiles.ssvi(k[None], np.array([[theta, -0.4, 0.8 * theta**-0.4]]))[0]
            rows += [(u, DAY0, DAY0 + dt.timedelta(days=int(365 * t)), t, float(x), float(y), 0.01) for x, y in zip(k, w, strict=True)]
    rows += [(1, DAY0, DAY0 + dt.timedelta(days=700), 2.0, 0.0, 0.05, 0.01)]  # too few points for a slice
    pts = spark.createDataFrame(rows, "underlying int, as_of date, expiry date, tte double, log_moneyness double, total_variance double, spread double")
    got = smiles.ssvi_surfaces(pts).orderBy("underlying", "tte").collect()
    assert [r.underlying for r in got] == [1] * 3 + [2] * 3  # one maturity makes no surface
    assert [r.theta for r in got[:3]] == pytest.approx([0.01, 0.02, 0.04], abs=1e-5)
    assert got[0].rho == pytest.approx(-0.4, abs=1e-3) and got[0].psi == pytest.approx(0.8 * 0.01**-0.4, rel=1e-2)
    assert all(b.theta >= a.theta for a, b in zip(got[3:], got[4:], strict=False))
    fitted = smiles.ssvi_surfaces(pts)
    assert all(r.calendar_free for r in smiles.pointwise_calendar(fitted).collect())
    assert all(r.butterfly_free for r in smiles.surface_checks(fitted).collect())
    assert smiles.svi_slices(pts.where("false")).count() == 0 and smiles.ssvi_surfaces(pts.where("false")).count() == 0


def test_garch_forecast_holds_between_refits(spark):
    rng = np.random.default_rng(2)
    v, x = 1e-4, []
    for _ in range(300):
        r = math.sqrt(v) * rng.normal()
        x.append(r)
        v = 5e-6 + 0.1 * r * r + 0.85 * v
    df = spark.createDataFrame([("b", d, float(r)) for d, r in zip(dates(300), x, strict=True)], "book string, date date, ret double")
    got = solvers.garch_vol_target(df, 0.10, 3.0, 50, 150).orderBy("date").collect()
    assert all(r.vol is None and r.scaled is None for r in got[:150])
    assert len({r.vol for r in got[150:200]}) == 1 and len({r.vol for r in got[150:]}) == 3
    assert 0.3 < got[299].vol / np.std(x) < 3
    for r in got[150:]:
        assert r.scaled == pytest.approx(r.ret * min(3.0, 0.10 / (r.vol * math.sqrt(252))))


def test_rolling_rules_hold_between_refits(spark):
    rng = np.random.default_rng(3)
    rows = [(d, n, float(rng.normal(0, s))) for d in dates(60) for n, s in (("a", 0.01), ("b", 0.02), ("c", 0.03))]
    df = spark.createDataFrame(rows, "date date, name string, r double")
    cal = panel.calendar(df)
    for rule in ("inverse_variance", "hrp", "equal"):
        got = solvers.rolling_allocation(df, cal, rule, 20, 10)
        by = {}
        for r in got.collect():
            by.setdefault(r.date, {})[r.name] = r.w
        assert len(by) == 40 and all(sum(w.values()) == pytest.approx(1) for w in by.values())
        assert by[DAY0 + dt.timedelta(days=20)] == by[DAY0 + dt.timedelta(days=29)]
        x = {n: np.var([v for d, m, v in rows if m == n and DAY0 + dt.timedelta(days=10) <= d < DAY0 + dt.timedelta(days=30)], ddof=1) for n in "abc"}
        if rule == "inverse_variance":
            assert by[DAY0 + dt.timedelta(days=35)] == pytest.approx({n: (1 / v) / sum(1 / y for y in x.values()) for n, v in x.items()})
    with pytest.raises(ValueError):
        solvers.rolling_allocation(df, cal, "best", 20, 10)


def test_kelly_and_hrp_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.02, (80, 4)) + rng.normal(0, 0.01, (80, 1))
    names = spark.createDataFrame([(d, f"n{j}", float(x[i, j])) for i, d in enumerate(dates(80)) for j in range(4)], "date date, name string, r double")
    mu = names.groupBy(F.col("name").alias("i")).agg(F.avg("r").alias("mu"))
    got = {r.name: r.w for r in solvers.kelly(allocation.correlations(names).join(mu, "i").select("i", "j", "cov", "mu")).collect()}
    want = np.clip(0.5 * np.linalg.solve(np.cov(x.T), x.mean(0)), -0.1, 0.1)
    assert [got[f"n{j}"] for j in range(4)] == pytest.approx(want.tolist())
    w = {r.name: r.w for r in solvers.hrp_weights(allocation.correlations(names)).collect()}
    assert sum(w.values()) == pytest.approx(1) and min(w.values()) > 0
    assert [w[f"n{j}"] for j in range(4)] == pytest.approx(solvers.hrp(np.cov(x.T), np.corrcoef(x.T)).tolist())


def test_factor_regression_equals_numpy(spark):
    rng = np.random.default_rng(5)
    n, lags = 200, 5
    f = rng.normal(0, 0.01, (n, 3))
    y = 0.0003 + f @ [1.2, -0.4, 0.3] + rng.normal(0, 0.005, n)
    daily = spark.createDataFrame([("b", d, float(v)) for d, v in zip(dates(n), y, strict=True)], "book string, date date, ret double")
    fac = spark.createDataFrame([(d, *map(float, v)) for d, v in zip(dates(n), f, strict=True)], "date date, mkt double, smb double, hml double")
    r = performance.factor_decomposition(daily, fac, 0.0, lags, 30, 252).first()
    x = np.column_stack([np.ones(n), f])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = (y - x @ b)[:, None] * x
    s = e.T @ e
    for h in range(1, lags + 1):
        g = e[h:].T @ e[:-h]
        s += (1 - h / (lags + 1)) * (g + g.T)
    inv = np.linalg.inv(x.T @ x)
    t = b / np.sqrt(np.diag(inv @ s @ inv))
    assert [r.alpha_annual, r.beta_mkt, r.beta_smb, r.beta_hml] == pytest.approx([b[0] * 252, *b[1:]])
    assert [r.alpha_t, r.t_mkt, r.t_smb, r.t_hml] == pytest.approx(t.tolist())
    assert performance.factor_decomposition(daily.limit(20), fac, 0.0, lags, 30, 252).count() == 0


def test_callback_sees_no_later_row(spark):
    rng = np.random.default_rng(6)
    rows = [(d, t, float(rng.normal(0, 0.01))) for d in dates(60) for t in ("x", "y")]
    m = spark.createDataFrame([(d, t, 100.0, 100.0, 1e6, r) for d, t, r in rows], "date date, ticker string, close double, open double, volume double, r double")
    spans = account.folds(panel.calendar(m), 30, 10)
    asked = []

    def make(p, fit_end):
        asked.append(fit_end)
        x = float(len(asked))
        return p.where("ticker = 'x'").select("date", "ticker", F.lit(x).alias("w"))  # weights that differ by fold

    got = account.walk_forward_with(make, "b", m, spans).orderBy("date").collect()
    assert len(asked) == 3 and [r.fold for r in got] == [0] * 10 + [1] * 10 + [2] * 10
    own = {d: r for d, t, r in rows if t == "x"}
    assert [r.ret for r in got] == pytest.approx([(r.fold + 1) * own[r.date] for r in got])


def test_american_greeks_by_bumps(spark):
    q = spark.createDataFrame([(1, 100.0, 110.0, 0.5, 0.25, "put"), (2, 100.0, 90.0, 0.5, 0.25, "call")], "id int, spot double, strike double, tte double, vol double, option_type string")
    american = {r.id: r for r in options.american_greeks(q, 0.05, steps=120).collect()}
    closed = {r.id: r for r in options.bumped_greeks(q, options.closed_form, rate=0.05).collect()}
    assert american[2].fd_delta == pytest.approx(closed[2].fd_delta, abs=2e-2)  # a call without dividends is not exercised early
    assert american[1].fd_delta < closed[1].fd_delta < 0 < american[1].fd_vega
    exact = {r.id: r for r in options.with_greeks(q, 0.05).collect()}
    for i in (1, 2):
        assert closed[i].fd_delta == pytest.approx(exact[i].delta, abs=1e-5) and closed[i].fd_vega == pytest.approx(exact[i].vega, rel=1e-5) and closed[i].fd_rho == pytest.approx(exact[i].rho, rel=1e-4)


def test_rolling_cointegration_looks_back_only(spark):
    rng = np.random.default_rng(7)
    b = np.cumsum(rng.normal(size=160))
    a = 0.8 * b + rng.normal(size=160)
    table = lambda x: spark.createDataFrame([("p", "q", d, float(u), float(v)) for d, u, v in zip(dates(160), x, b, strict=True)], "a string, b string, date date, la double, lb double")
    one = {r.date: r.p for r in solvers.rolling_cointegration(table(a), 100, 20).collect()}
    later = np.concatenate([a[:120], rng.normal(0, 50, 40)])
    two = {r.date: r.p for r in solvers.rolling_cointegration(table(later), 100, 20).collect()}
    assert sorted(one) == [DAY0 + dt.timedelta(days=k) for k in (100, 120, 140)]
    assert one[DAY0 + dt.timedelta(days=100)] == two[DAY0 + dt.timedelta(days=100)] == pytest.approx(solvers.engle_granger(a[:100], b[:100])[1])
    assert one[DAY0 + dt.timedelta(days=120)] == two[DAY0 + dt.timedelta(days=120)] < 0.05


def test_boosted_model_orders_scores(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(float(a), float(b), float(a > 0)) for a, b in rng.normal(size=(200, 2))], "good double, noise double, y double")
    model = ml.fit_boosted(rows, ("good", "noise"), trees=3)
    got = ml.scored(model, rows, ("good", "noise")).collect()
    assert min(r.p for r in got if r.good > 0.2) > max(r.p for r in got if r.good < -0.2)
    assert ml.fit_boosted(rows.where("y = 1"), ("good", "noise")) is None


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration_keeps_the_order_and_meets_the_rate(spark, method):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2))
    up = (rng.random(300) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    rows = spark.createDataFrame([(d, float(a), float(b), float(y)) for d, (a, b), y in zip(dates(300), x, up, strict=True)], "date date, good double, noise double, y double")
    names = ("good", "noise")
    raw = ml.scored(ml.fit_boosted(rows, names, trees=1), rows, names)
    got = ml.calibrated(rows, names, method, trees=1)(raw.withColumn("raw", F.col("p"))).orderBy("raw").collect()
    p = [r.p for r in got]
    assert all(u <= v + 1e-12 for u, v in zip(p, p[1:], strict=False)) and 0 <= p[0] < p[-1] <= 1
    assert np.mean(p) == pytest.approx(up.mean(), abs=0.1)
    one = ml.calibrated(rows.where("y = 1"), names, method, trees=1)(raw)  # nothing to learn: as they are
    assert sorted(r.p for r in one.collect()) == sorted(r.p for r in raw.collect())


def test_unknown_calibration(spark):
    rows = spark.createDataFrame([(d, float(k % 2), float(k % 2)) for k, d in enumerate(dates(30))], "date date, good double, y double")
    with pytest.raises(ValueError, match="unknown calibration"):
        ml.calibrated(rows, ("good",), "other", trees=1)


def test_meta_labels_and_book(spark):
    rows = spark.createDataFrame(
        [("A", DAY0 + dt.timedelta(days=i), s, r) for i, (s, r) in enumerate([(1, 0.0), (-1, 0.02), (0, -0.01), (1, 0.03), (1, None)])], "ticker string, date date, side int, r double"
    )
    got = signals.meta_labels(rows).orderBy("date").collect()
    assert [x.meta for x in got] == [1.0, 1.0, None, None, None]  # what the next row pays; null without a side or a return


def test_equal_slices_and_surfaces_are_fitted_once(spark):
    from panelforge.operators import smiles

    smile = [(t, k, (0.2 + 0.1 * k * k - 0.05 * k) ** 2 * t, 0.1) for t in (0.25, 1.0) for k in (-0.3, -0.2, -0.1, 0.0, 0.1, 0.2)]
    pts = spark.createDataFrame([(u, "d", str(t), t, k, w, s) for u in range(5) for t, k, w, s in smile], "underlying int, as_of string, expiry string, tte double, log_moneyness double, total_variance double, spread double")
    for fit, n, rows in ((smiles.svi_slices, 2, 10), (smiles.ssvi_slices, 2, 10), (smiles.ssvi_surfaces, 1, 10)):
        fits = []

        def kept(made, fits=fits):
            fits.append(made.count())
            return made

        got = [tuple(r) for r in fit(pts, kept=kept).collect()]
        assert fits == [n] and len(got) == rows and len({r[2:] for r in got}) <= 4 and len({r[0] for r in got}) == 5
