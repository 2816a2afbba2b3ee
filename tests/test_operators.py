"""Hand tables, planted defects, and tampering with the future for windowed operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import mathx
from panelforge.operators import account, allocation, cv, options, panel, performance, risk, signals, solvers

DAY0 = dt.date(2020, 1, 1)


def bars(spark, closes, opens=None):
    rows = [(t, DAY0 + dt.timedelta(days=i), None if c is None else float(c), None if opens is None else float(opens[t][i]), 1e6) for t, cs in closes.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "ticker string, date date, close double, open double, volume double")


def ramp(spark):
    return panel.returns(bars(spark, {"X": [100, 110, 121, 133.1, 146.41]}))


def book(spark, values, ticker="X", name="b"):
    return spark.createDataFrame([(name, DAY0 + dt.timedelta(days=i), ticker, v) for i, v in enumerate(values) if v is not None], "book string, date date, ticker string, w double")


def series(df, column, order="date"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_lagged_pnl(spark):
    got = account.account(book(spark, [1.0] * 5), ramp(spark))
    assert series(got, "ret") == pytest.approx([0, 0.1, 0.1, 0.1, 0.1])
    assert series(got, "equity")[-1] == pytest.approx(1.1**4)
    assert set(series(got, "cost")) == {0.0}


def test_next_open(spark):
    m = panel.returns(bars(spark, {"A": [10, 11, 12, 13]}, {"A": [10, 11, 12, 13]}))
    assert series(account.account(book(spark, [1.0] * 4, "A"), m, fill="next_open"), "ret") == pytest.approx([0, 12 / 11 - 1, 13 / 12 - 1, 0])


def test_capped_chase(spark):
    rows = spark.createDataFrame([("b", "X", DAY0 + dt.timedelta(days=i), float(i > 0), 0.25) for i in range(6)], "book string, ticker string, date date, target double, cap double")
    assert series(account.chased(rows), "held") == pytest.approx([0, 0.25, 0.5, 0.75, 1, 1])


def test_fold_runs_in_order_within_groups_and_across_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(k, DAY0 + dt.timedelta(days=i), None if rng.random() < 0.1 else float(rng.normal()), "old") for k in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "key string, date date, x double, out string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = panel.folded(df, ("key",), ("x",), lambda s, x: (s + (x or 0.0), s + (x or 0.0)), 0.0, "out").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, total = {}, {}
    for k, d, x, _ in rows:
        total[k] = want[k, d] = total.get(k, 0.0) + (x or 0.0)
    assert len(got) == len(rows) and {(r.key, r.date): r.out for r in got} == pytest.approx(want)
    empty = panel.folded(df.where("false"), ("key",), ("x",), lambda s, x: (s, s), 0.0, "out")
    assert empty.count() == 0 and empty.dtypes == [("key", "string"), ("date", "date"), ("x", "double"), ("out", "double")]


def test_pair_positions_follow_the_rules_day_by_day(spark):
    z = [0.5, 2.5, 1.0, -0.1, -2.5, None, -2.5, -1.0, 0.2, 3.0, 3.0, 3.0, 2.2]
    beta = [1.0] * 9 + [1.0, -0.5, 1.0, 1.0]
    p = [0.01] * 11 + [0.2, None]
    rows = [("x", "y", DAY0 + dt.timedelta(days=i), *v) for i, v in enumerate(zip(z, beta, p, strict=True))]
    df = spark.createDataFrame(rows, "a string, b string, date date, z double, beta double, p double")
    # opened above 2, closed at 0; opened below -2, broken by a null z; opened again, closed; broken by beta and by p
    assert series(signals.pair_positions(df), "position") == [0, -1, -1, 0, 1, 0, 1, 1, 0, -1, 0, 0, 0]
    both = df.unionByName(df.withColumn("a", F.lit("w")).withColumn("z", -F.col("z")))
    got = signals.pair_positions(both)
    assert series(got.where("a = 'w'"), "position") == [-x for x in series(got.where("a = 'x'"), "position")]


def test_chase_without_cap_or_target(spark):
    rows = [("b", "X", DAY0 + dt.timedelta(days=i), t, c) for i, (t, c) in enumerate([(1.0, 0.5), (None, 0.5), (1.0, None), (-1.0, 0.25)])]
    df = spark.createDataFrame(rows, "book string, ticker string, date date, target double, cap double")
    assert series(account.chased(df), "held") == [0.5, 0.5, 1.0, 0.75]


def test_gaps_fill_forward_three_rows_at_most(spark):
    got = panel.align(bars(spark, {"A": [1, None, None, None, None, 6], "B": [1, 2, 3, 4, 5, 6], "C": [None] * 6}))
    assert series(got.where("ticker = 'A'"), "close") == [1, 1, 1, 1, None, 6]
    assert {r.ticker for r in got.collect()} == {"A", "B"}
    assert all(r.open is None for r in got.collect())


def test_lookahead_guard(spark):
    m = ramp(spark)
    bad = book(spark, [1.0], "Y").unionByName(book(spark, [1.0, 1.0])).unionByName(book(spark, [1.0]))
    assert {r.problem for r in account.problems(bad, m).collect()} == {"unknown ticker", "given twice"}
    assert account.problems(book(spark, [1.0]), m).count() == 0


def walk(seed, n=140, names=6):
    rng = np.random.default_rng(seed)
    return {f"T{k}": list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))) for k in range(names)}


@pytest.mark.parametrize("make", [
    lambda m: signals.cross_sectional_momentum(m, 40, 5, 0.2, 5),
    lambda m: signals.time_series_momentum(m, 40, 5, 20),
    lambda m: signals.single_asset_reversion(m, 20),
    lambda m: signals.features(m, high=40).select("date", "ticker", F.col("rsi_14").alias("w")),
    lambda m: account.with_liquidity(m, account.Costs()).select("date", "ticker", F.col("sigma").alias("w")),
    lambda m: risk.vol_ratio_regime(risk.market_proxy(m), 5, 30).select("date", F.lit("m").alias("ticker"), F.col("label").cast("double").alias("w")),
])
def test_the_future_changes_nothing_before_it(spark, make):
    a, cut = walk(1), 110
    b = {t: v[:cut] + [x * 3 for x in v[cut:]] for t, v in a.items()}
    day = DAY0 + dt.timedelta(days=cut)
    one, two = ({(r.date, r.ticker): r.w for r in make(panel.returns(bars(spark, x))).where(F.col("date") < F.lit(day)).collect()} for x in (a, b))
    assert one == two and any(v for v in one.values())


def test_drawdown_stop_and_report(spark):
    daily = spark.createDataFrame([("b", DAY0 + dt.timedelta(days=i), -0.01) for i in range(200)], "book string, date date, ret double")
    got = series(risk.drawdown_stop(daily, 0.10, 20), "stopped")
    equity, peak, left, want = 1.0, 1.0, 0, []
    for _ in range(200):
        if left == 0:
            want.append(-0.01)
            equity *= 0.99
            peak = max(peak, equity)
            left = 20 if equity / peak - 1 <= -0.10 else 0
        else:
            want.append(0.0)
            left -= 1
            peak = equity if left == 0 else peak
    assert got == pytest.approx(want)
    r = risk.drawdown_report(daily).first()
    assert r.max_drawdown == pytest.approx(0.99**199 - 1) and r.max_dd_duration == 199


def test_hygiene_owns_each_row_once(spark):
    rows = [(1.0, 1.1, 0.5), (0.0, 1.0, 0.5), (2.0, 1.0, 0.5), (0.1, 1.0, 0.5), (1.0, 1.1, -0.1), (None, 1.0, 0.5)]
    q = spark.createDataFrame([("u", b, a, t) for b, a, t in rows], "underlying string, bid double, ask double, tte double")
    got = [r.reason for r in options.flagged(q).collect()]
    assert got == [None, "zero_or_low_bid", "crossed_or_locked", "spread_too_wide", "expired", "non_finite"]


def test_black_scholes_point_and_round_trip(spark):
    q = spark.createDataFrame([(100.0, 100.0, 1.0, 0.2, k) for k in ("call", "put")], "spot double, strike double, tte double, vol double, option_type string")
    got = options.with_greeks(q, 0.05).orderBy("option_type").collect()
    assert got[0].price == pytest.approx(10.4506, abs=1e-3) and got[1].price == pytest.approx(5.5735, abs=1e-3)
    assert got[0].delta - got[1].delta == pytest.approx(1.0) and got[0].gamma == pytest.approx(got[1].gamma)
    vols, why = options.solve_vols(np.array([r.price for r in got]), *(np.full(2, x) for x in (100.0, 100.0, 1.0, 0.05)), np.array([True, False]))
    assert vols == pytest.approx([0.2, 0.2], abs=1e-7) and list(why) == ["ok", "ok"]
    trees = options.early_exercise(q, 300, 0.05).orderBy("option_type").collect()
    assert trees[0].european == pytest.approx(10.4506, abs=2e-2) and trees[1].premium > 0.3 and abs(trees[0].premium) < 1e-9


def test_implied_vol_reasons():
    rng = np.random.default_rng(3)
    n = 4000
    s, k, t, v, call = np.full(n, 100.0), 100 * np.exp(rng.normal(0, 0.3, n)), rng.uniform(0.02, 3, n), rng.uniform(0.03, 1.5, n), rng.random(n) < 0.5
    d1 = (np.log(s / k) + (0.03 + v * v / 2) * t) / (v * np.sqrt(t))
    d2 = d1 - v * np.sqrt(t)
    price = np.where(call, s * options._cdf(d1) - k * np.exp(-0.03 * t) * options._cdf(d2), k * np.exp(-0.03 * t) * options._cdf(-d2) - s * options._cdf(-d1))
    got, why = options.solve_vols(price, s, k, t, np.full(n, 0.03), call)
    itm = np.maximum(0, np.where(call, s - k * np.exp(-0.03 * t), k * np.exp(-0.03 * t) - s))
    clear = price - itm > 1e-6  # a time value that rounding leaves
    assert (why[clear] == "ok").all() and np.abs(got - v)[clear].max() < 1e-5 and not set(why) & {"solver_failed", "no_bracket_found"}
    f = lambda *x: options.solve_vols(*(np.array([v]) for v in x[:5]), np.array([x[5]]))[1][0]
    assert f(5.0, 100.0, 100.0, 0.0, 0.0, True) == "expired_or_zero_time"
    assert f(150.0, 100.0, 100.0, 1.0, 0.0, True) == "price_above_no_arb_max"
    assert f(1.0, 100.0, 50.0, 1.0, 0.0, True) == "price_below_intrinsic"
    assert f(50.0, 100.0, 50.0, 1.0, 0.0, True) == "price_at_intrinsic"


def test_every_clean_quote_has_an_american_price(spark, tmp_path):
    from panelforge.plans import quotes

    spark.createDataFrame([(1, 901.0), (6, 906.0)], "p_partkey long, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    clean = options.clean(quotes.views.quotes(spark, str(tmp_path)))
    got = quotes.QUERIES["o4_american"](spark, str(tmp_path)).collect()
    assert len(got) == clean.count() and len({str(r.expiry) for r in got}) == 4
    one = next(r for r in clean.where("option_type = 'put' AND expiry = (SELECT max(x) FROM VALUES (DATE'1999-01-02') t(x))").collect() if r.strike > r.spot)
    price = options._tree(*(np.array([x]) for x in (one.spot, one.strike, one.tte, one.true_vol, quotes.RATE, False)), True, 500, 0.0)[0]
    same = next(r for r in got if (r.underlying, r.expiry, r.strike, r.option_type) == (one.underlying, one.expiry, round(one.strike, 4), "put"))
    assert same.american == pytest.approx(price, abs=1e-3)


def test_fdr(spark):
    p = [("f", "a", 0.001), ("f", "b", 0.5), ("f", "c", None), ("f", "d", 0.04), ("f", "e", float("nan"))]
    got = {r.name: r for r in performance.fdr(spark.createDataFrame(p, "family string, name string, p double"), 0.10).collect()}
    assert [n for n in sorted(got) if got[n].keep] == ["a", "d"]
    assert got["d"].q == pytest.approx(0.06) and got["c"].q is None


def test_significance_can_keep_a_feature(spark):
    import inspect

    from panelforge.operators import ml

    for f in (ml.permutation_importance, ml.feature_significance):
        repeats = inspect.signature(f).parameters["repeats"].default
        assert 1 / (repeats + 1) <= 0.10 / len(signals.FEATURES)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 2))
    rows = spark.createDataFrame([(i, float(a), float(b), float(a > 0)) for i, (a, b) in enumerate(x)], "id long, good double, noise double, y double").persist()
    got = {r.feature: r for r in ml.feature_significance(rows, ("good", "noise"), trees=3).collect()}
    assert got["good"].keep and got["good"].p == pytest.approx(1 / 200) and not got["noise"].keep


def test_purged_folds(spark):
    rows = [(f"T{k}", DAY0 + dt.timedelta(days=i), DAY0 + dt.timedelta(days=i + 1)) for i in range(100) for k in range(3)]
    got = cv.purged_folds(spark.createDataFrame(rows, "ticker string, date date, t1 date"), 5, 5)
    n = {(r.block, r.side): r["count"] for r in got.groupBy("block", "side").count().collect()}
    assert all(n[b, "test"] == 60 for b in range(5)) and n[0, "embargoed"] == 15 and n[4, "purged"] == 3
    with pytest.raises(ValueError):
        cv.purged_folds(got, 1)


def test_stress_and_allocation(spark):
    b = [0.001 * (-1) ** i for i in range(60)]
    b[30] = -0.09
    market = spark.createDataFrame([(DAY0 + dt.timedelta(days=i), x) for i, x in enumerate(b)], "date date, r double")
    daily = market.select(F.lit("b").alias("book"), "date", (1.5 * F.col("r")).alias("ret"))
    got = {r.scenario: r for r in risk.stress(daily, market, custom={"crash": -0.2}).collect()}
    assert got["Worst 1d"].market_move == pytest.approx(-0.09) and got["crash"].est_pnl == pytest.approx(-0.3)
    assert solvers.hrp(np.diag([4.0, 1.0]), np.eye(2)) == pytest.approx([0.2, 0.8])
    w = allocation.inverse_variance(spark.createDataFrame([("A", 2.0), ("A", -2.0), ("B", 1.0), ("B", -1.0)], "name string, r double")).collect()
    assert {r.name: r.w for r in w} == pytest.approx({"A": 0.2, "B": 0.8})


def test_normal_and_weekdays(spark):
    xs = [-9.0, -3.0, -0.5, 0.0, 0.5, 3.0, 9.0]
    got = [r.c for r in spark.createDataFrame([(x,) for x in xs], "x double").select(mathx.norm_cdf(F.col("x")).alias("c")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], abs=1e-15)
    days = [DAY0 + dt.timedelta(days=i) for i in range(14)]
    rows = spark.createDataFrame([(d, n) for d in days for n in (0, 1, 3, 5, 12)], "d date, n int")
    for n in (1, 3, 5, 12):
        for r in rows.where(F.col("n") == n).select("d", mathx.weekday_offset(F.col("d"), n).alias("o")).collect():
            assert r.o == np.busday_offset(r.d, -n, roll="forward").astype(dt.date), (r.d, n)


def test_fits_recover_parameters(spark):
    k = np.linspace(-0.4, 0.4, 15)
    rng = np.random.default_rng(0)
    b = np.cumsum(rng.normal(size=400))
    assert solvers.engle_granger(0.7 * b + rng.normal(size=400), b)[1] < 0.01 < solvers.engle_granger(np.cumsum(rng.normal(size=400)), b)[1]
    xi, beta = solvers.gpd_fit(rng.exponential(0.5, 3000))
    assert abs(xi) < 0.1 and beta == pytest.approx(0.5, rel=0.1)


def test_settlement(spark):
    rows = [("a", DAY0, 100.0, "call", -2.0), ("a", DAY0, 100.0, "put", 1.0), ("a", DAY0, 120.0, "put", -1.0)]
    pos = spark.createDataFrame(rows, "account string, expiry date, strike double, option_type string, qty double")
    spots = spark.createDataFrame([(DAY0 - dt.timedelta(days=1), 1.0), (DAY0 + dt.timedelta(days=1), 110.0)], "date date, spot double")
    got = {(r.strike, r.option_type): (r.outcome, r.cash_delta, r.share_delta) for r in options.settlements(pos, spots).collect()}
    assert got == {(100.0, "call"): ("assigned", 20_000.0, -200.0), (100.0, "put"): ("worthless", 0.0, 0.0), (120.0, "put"): ("assigned", -12_000.0, 100.0)}


def surface_points(spark, seed=5):
    """Slices of 0 to 6 points, equal maturities and queries on, between and beyond them; a surface of one maturity, and maturities and moneyness that are missing."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(12):
        for t in sorted(rng.choice([0.1, 0.2, 0.5, 1.0, 1.5], 1 if u == 3 else 4, replace=False)):
            xs = sorted(rng.choice(np.arange(-8, 9), rng.integers(1, 7), replace=False) / 10)
            rows += [(u, DAY0, DAY0 + dt.timedelta(days=int(365 * t)), float(t), float(x), float(rng.uniform(0.01, 0.3))) for x in xs]
    rows += [(4, DAY0, None, None, 0.1, 0.5), (5, DAY0, rows[0][2], 0.1, None, 0.5)]
    return rows, spark.createDataFrame(rows, "underlying int, as_of date, expiry date, tte double, log_moneyness double, total_variance double")


def line(points, x):
    return np.interp(x, *zip(*sorted(points), strict=True))


def plan_of(df, operator):
    return df._jdf.queryExecution().executedPlan().toString().count(operator)


def test_surface_is_shuffled_once_and_sorted_twice_and_equals_a_plain_loop(spark):
    rows, pts = surface_points(spark)
    asked = [(u, DAY0, x, t, f"q{t}") for u in range(13) for x in (-0.9, -0.35, 0.0, 0.1, 0.4, 0.9) for t in (0.05, 0.1, 0.15, 0.2, 0.7, 1.5, 2.0)]
    asked += asked[:5] + [(0, DAY0, 0.0, None, "no maturity")]
    got = options.surface_at(spark.createDataFrame(asked, "underlying int, as_of date, log_moneyness double, tte double, note string"), pts)
    assert plan_of(got, "Exchange") == 1 and plan_of(got, "Sort [") == 2
    want = {}
    for u, _, x, t, note in asked[:-1]:
        by = {}
        for v, _, _, m, k, y in rows:
            if v == u and m is not None and k is not None:
                by.setdefault(m, []).append((k, y))
        if by:
            mats = sorted(by)
            want[u, x, note] = np.interp(t, mats, [line(by[m], x) for m in mats])
    found = got.collect()
    assert len(found) == len([q for q in asked if (q[0], q[2], q[4]) in want]) and {r.underlying for r in found} == set(range(12))
    for r in found:
        assert r.total_variance == pytest.approx(want[r.underlying, r.log_moneyness, r.note], rel=1e-12)
        assert r.implied_vol == pytest.approx(math.sqrt(r.total_variance / r.tte))


def test_a_large_slice_is_interpolated_in_linear_time(spark):
    n = 60_000
    at = spark.range(n).select(F.lit(1).alias("underlying"), F.lit(DAY0).alias("as_of"), (F.col("id") / n).alias("log_moneyness"))
    pts = at.select("*", F.lit(0.5).alias("tte"), (F.col("log_moneyness") * 2).alias("total_variance"))
    asked = at.select("underlying", "as_of", F.col("log_moneyness") + 0.3 / n, F.lit(0.5).alias("tte")).toDF("underlying", "as_of", "log_moneyness", "tte")
    got = options.surface_at(asked, pts).where("log_moneyness < 0.9").agg(F.count("*"), F.max(F.abs(F.col("total_variance") - 2 * F.col("log_moneyness")))).first()
    assert got[0] == 54_000 and got[1] < 1e-9


def test_atm_term_structure_is_one_aggregate_and_equals_the_surface(spark):
    _, pts = surface_points(spark)
    got = options.atm_term_structure(pts)
    assert plan_of(got, "Exchange") == 1 and plan_of(got, "Sort [") == 0 and plan_of(got, "SortAggregate") == 0
    asked = pts.select("underlying", "as_of", "tte").distinct().withColumn("log_moneyness", F.lit(0.0))
    want = {(r.underlying, r.tte): r.implied_vol for r in options.surface_at(asked, pts).collect()}
    found = {(r.underlying, r.tte): r.atm_vol for r in got.collect()}
    assert len(found) == got.count() > 40 and found == pytest.approx(want, rel=1e-12)


def test_calendar_is_shuffled_once_and_sorted_twice_and_equals_a_plain_loop(spark):
    rows, pts = surface_points(spark)
    rows, pts = rows[:-2], pts.where("tte IS NOT NULL AND log_moneyness IS NOT NULL")
    got = options.calendar_violations(pts)
    assert plan_of(got, "Exchange") == 1 and plan_of(got, "Sort [") == 2
    want = {}
    for u in range(12):
        by = {}
        for v, _, e, _, x, y in rows:
            if v == u:
                by.setdefault(e, []).append((x, y))
        order = sorted(by)
        for e0, e1 in zip(order, order[1:], strict=False):
            low, high = (f(g(x for x, _ in by[e]) for e in (e0, e1)) for f, g in ((max, min), (min, max)))
            for x, y in by[e1]:
                if low < high and low <= x <= high and line(by[e0], x) - y > 1e-6:
                    want[u, e1, x] = line(by[e0], x) - y
    found = {(r.underlying, r.expiry, r.log_moneyness): r.severity for r in got.collect()}
    assert len(found) == got.count() > 10 and found == pytest.approx(want, rel=1e-9)
    only = pts.where("underlying = 0").withColumn("expiry", F.to_date(F.lit("2021-01-01")))
    gap = only.unionByName(only.withColumn("expiry", F.to_date(F.lit("2021-02-01"))).withColumn("log_moneyness", F.lit(None).cast("double")))
    assert options.calendar_violations(gap.unionByName(only.withColumn("expiry", F.to_date(F.lit("2021-03-01"))).withColumn("total_variance", F.lit(-1.0)))).count() == 0
