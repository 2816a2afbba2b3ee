"""Queries over bars and books: panels, signals, accounting, regimes, risk, allocation, performance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.mathx import norm_cdf_sql, quantile_of_normal
from panelforge.operators import account, allocation, panel, performance, risk, signals
from panelforge.plans import views
from panelforge.plans.sql import T, bars, rolling, rounded, trade_cost, window, with_
from panelforge.plans.views import COSTS, LOOKBACK, PERIODS, SKIP, VOL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, columns: str, source: str | None = None, digits: int = 6, into: tuple[dict, dict] | None = None, **own: str):
    """Registers a query and its SQL. columns: ``name:kind`` (k as it is, f double, i count)."""
    queries, sql = into or (QUERIES, SQL)

    def add(f):
        kinds = dict(c.split(":") for c in columns.split())
        queries[name] = lambda spark, sf_dir: views.rounded(f(spark, sf_dir).select(*kinds), digits)
        if source is not None:
            sql[name] = with_(rounded(kinds, source, digits), **own)
        return f

    return add


# --- panels ---------------------------------------------------------------------------------


@query("s3_coverage", "ticker:k reason:k", "SELECT ticker, CASE WHEN a > CAST('1992-02-01' AS DATE) THEN 'starts late' WHEN b < CAST('2001-10-01' AS DATE) THEN 'ends early' END AS reason FROM (SELECT ticker, min(date) AS a, max(date) AS b FROM bars GROUP BY 1) WHERE a > CAST('1992-02-01' AS DATE) OR b < CAST('2001-10-01' AS DATE)")
def s3(spark, d):
    b = views.bars(spark, d)
    return panel.coverage(b, b.select("ticker"), "1992-02-01", "2001-10-01")


@query("s4_universe", "ticker:k date:k close:f ord:i", "SELECT b.ticker, b.date, b.close, u.ord FROM bars b JOIN (SELECT p_brand AS ticker, min(p_size) AS ord FROM part WHERE p_size <= 5 GROUP BY 1) u ON u.ticker = b.ticker")
def s4(spark, d):
    u = views.table(spark, d, "part").where("p_size <= 5").select(F.lit("small").alias("universe"), F.col("p_brand").alias("ticker"), F.col("p_size").alias("ord"))
    return panel.in_universe(views.bars(spark, d), u, "small")


@query("s5_align_daily", "date:k ticker:k close:f volume:f", "SELECT * FROM panel", bars=bars("day"))
def s5(spark, d):
    return panel.align(views.bars(spark, d, "day"))


@query("s6_open_gate", "date:k ticker:k open:f", "SELECT date, ticker, CASE WHEN (SELECT bool_and(o > 0) FROM (SELECT count(open) AS o FROM bars GROUP BY ticker)) THEN open END AS open FROM panel")
def s6(spark, d):
    return panel.align(views.bars(spark, d))


@query("s7_returns", "date:k ticker:k r:f lr:f", f"SELECT *, ln(close) - ln(lag(close) OVER ({T})) AS lr FROM rets")
def s7(spark, d):
    return panel.returns(views.market(spark, d), "log", "lr")


@query("s11_expiry_sample", "underlying:k expiry:k n:i", "SELECT underlying, expiry, count(*) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY underlying ORDER BY expiry) - 1 AS k FROM quotes0) WHERE k IN (0, 1, 3) GROUP BY 1, 2")
def s11(spark, d):
    q = views.quotes(spark, d)
    return panel.spread_sample(q, "expiry", 3, ("underlying",)).groupBy("underlying", "expiry").agg(F.count("*").alias("n"))


# --- signals --------------------------------------------------------------------------------


@query("g1_formation", "date:k ticker:k mom:f", "SELECT * FROM formed WHERE mom IS NOT NULL")
def g1(spark, d):
    return signals.formation(views.market(spark, d), LOOKBACK, SKIP).where("mom IS NOT NULL")


@query("g2_momentum", "date:k ticker:k w:f", "SELECT * FROM w_mom")
def g2(spark, d):
    return signals.cross_sectional_momentum(views.market(spark, d), LOOKBACK, SKIP, 0.2, views.REBALANCE)


@query("g3_time_series_momentum", "date:k ticker:k w:f", "SELECT * FROM w_tsm")
def g3(spark, d):
    return signals.time_series_momentum(views.market(spark, d), LOOKBACK, SKIP, VOL, 0.004, 0.10)


@query("g4_reversion", "date:k ticker:k w:f", "SELECT * FROM w_rev")
def g4(spark, d):
    return signals.single_asset_reversion(views.market(spark, d), VOL)


PAIRS = (("Brand#11", "Brand#12"), ("Brand#21", "Brand#22"), ("Brand#3", "Brand#14"), ("Brand#5", "Brand#25"))
_PAIRED = f"SELECT p.a, p.b, x.date, ln(x.close) AS la, ln(y.close) AS lb FROM (SELECT unnest({[a for a, _ in PAIRS]}) AS a, unnest({[b for _, b in PAIRS]}) AS b) p JOIN panel x ON x.ticker = p.a JOIN panel y ON y.ticker = p.b AND y.date = x.date"
_BY = "PARTITION BY a, b ORDER BY date"
_RATIO = f"SELECT *, CASE WHEN count(la + lb) OVER {window(26, 'a, b')} >= 26 THEN covar_samp(la, lb) OVER {window(26, 'a, b')} / nullif(var_samp(lb) OVER {window(26, 'a, b')}, 0) END AS ratio FROM paired"
_HEDGED = f"SELECT *, la - beta * lb AS spread FROM (SELECT *, lag(ratio) OVER ({_BY}) AS beta FROM ratios)"
_ZED = f"SELECT *, (spread - {rolling('avg', 'spread', VOL, 'a, b')}) / nullif({rolling('stddev_samp', 'spread', VOL, 'a, b')}, 0) AS z FROM hedged"
_PAIR_CTE = {"paired": _PAIRED, "ratios": _RATIO, "hedged": _HEDGED, "zed": _ZED}


def pair_rows(spark, d) -> DataFrame:
    pairs = spark.createDataFrame(list(PAIRS), "a string, b string")
    return signals.pair_spread(signals.pair_table(views.market(spark, d), pairs), 26, VOL)


@query("g7_hedge_ratio", "a:k b:k date:k beta:f", "SELECT * FROM zed WHERE beta IS NOT NULL", **_PAIR_CTE)
def g7(spark, d):
    return pair_rows(spark, d).where("beta IS NOT NULL")


@query("g9_spread", "a:k b:k date:k spread:f z:f", "SELECT * FROM zed WHERE z IS NOT NULL", **_PAIR_CTE)
def g9(spark, d):
    return pair_rows(spark, d).where("z IS NOT NULL")


@query(
    "g10_pair_positions", "a:k b:k date:k position:i",
    """SELECT a, b, date, position FROM steps""",
)
def g10(spark, d):
    rows = pair_rows(spark, d).withColumn("beta", F.abs("beta")).withColumn("p", (F.dayofyear("date") % 100) / 600.0)
    return signals.pair_positions(rows, 1.0, 0.0, 0.15)


SQL["g10_pair_positions"] = "WITH RECURSIVE " + with_(
    """, seen AS (SELECT a, b, date, z, abs(beta) AS beta, (dayofyear(date) % 100) / 600.0 AS p, row_number() OVER (PARTITION BY a, b ORDER BY date) AS k FROM zed),
steps AS (
  SELECT a, b, date, k, CASE WHEN p > 0.15 OR beta IS NULL OR beta <= 0 OR z IS NULL THEN 0 WHEN z > 1 THEN -1 WHEN z < -1 THEN 1 ELSE 0 END AS position FROM seen WHERE k = 1
  UNION ALL
  SELECT s.a, s.b, s.date, s.k, CASE WHEN s.p > 0.15 OR s.beta IS NULL OR s.beta <= 0 OR s.z IS NULL THEN 0
    WHEN t.position = 0 THEN CASE WHEN s.z > 1 THEN -1 WHEN s.z < -1 THEN 1 ELSE 0 END
    WHEN t.position = 1 AND s.z >= 0 THEN 0 WHEN t.position = -1 AND s.z <= 0 THEN 0 ELSE t.position END AS position
  FROM steps t JOIN seen s ON s.a = t.a AND s.b = t.b AND s.k = t.k + 1
)
SELECT a, b, date, CAST(position AS BIGINT) AS position FROM steps""",
    **_PAIR_CTE,
).removeprefix("WITH ").replace("\n, seen AS", ", seen AS")


_CHANGE = f"close - lag(close) OVER ({T})"
_FEATURES = f"""SELECT date, ticker, r, close / lag(close, 5) OVER ({T}) - 1 AS mom_5, close / lag(close, 10) OVER ({T}) - 1 AS mom_10, close / lag(close, 21) OVER ({T}) - 1 AS mom_21,
  (close - {rolling('avg', 'close', 21)}) / nullif({rolling('stddev_samp', 'close', 21)}, 0) AS zscore_21, {rolling('stddev_samp', 'r', 21)} AS vol_21,
  volume / nullif({rolling('avg', 'volume', 21)}, 0) AS volume_ratio, 100 - 100.0 / (1 + {rolling('avg', 'gain', 14)} / nullif({rolling('avg', 'loss', 14)}, 0)) AS rsi_14,
  close / {rolling('max', 'close', 52)} - 1 AS dist_52w_high
FROM (SELECT *, CASE WHEN ch IS NOT NULL THEN greatest(ch, 0) END AS gain, CASE WHEN ch IS NOT NULL THEN greatest(-ch, 0) END AS loss FROM (SELECT *, {_CHANGE} AS ch FROM rets))"""
_FEATURE_LIST = " ".join(f"{c}:f" for c in signals.FEATURES)


def feature_rows(spark, d) -> DataFrame:
    return signals.features(views.market(spark, d), high=52)


@query("g12_features", "date:k ticker:k " + _FEATURE_LIST, "SELECT * FROM feats", feats=_FEATURES)
def g12(spark, d):
    return feature_rows(spark, d)


_FOLD_ENDS = ("1997-06-02", "1999-07-05")
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in signals.FEATURES)
_LABELLED = f"SELECT *, lead(date) OVER ({T}) AS t1, CASE WHEN lead(r) OVER ({T}) IS NOT NULL THEN CASE WHEN lead(r) OVER ({T}) > 0 THEN 1.0 ELSE 0.0 END END AS y FROM feats"
# 504 weekdays are 100 weeks and 4 days: from a Monday that many back is a Tuesday, 101 weeks less a day.
_TRAINING = f"SELECT f.fold, l.ticker, l.date, l.t1, l.y, l.mom_5 FROM labelled l JOIN (SELECT unnest([0, 1]) AS fold, CAST(unnest(['{_FOLD_ENDS[0]}', '{_FOLD_ENDS[1]}']) AS DATE) AS fit_end) f ON l.date >= f.fit_end - 706 AND l.date < f.fit_end WHERE {_WHOLE} AND y IS NOT NULL"


def fold_ends(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_FOLD_ENDS)), "fold int, fit_end string").withColumn("fit_end", F.to_date("fit_end"))


@query("g13_training_rows", "fold:i ticker:k date:k t1:k y:f mom_5:f", _TRAINING, feats=_FEATURES, labelled=_LABELLED)
def g13(spark, d):
    return signals.training_rows(feature_rows(spark, d), fold_ends(spark), 504)


@query("g16_uniqueness", "fold:i ticker:k date:k u:f", "SELECT fold, ticker, date, u / avg(u) OVER (PARTITION BY fold) AS u FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY fold, date) AS u FROM training)", feats=_FEATURES, labelled=_LABELLED, training=_TRAINING)
def g16(spark, d):
    return signals.uniqueness_weights(signals.training_rows(feature_rows(spark, d), fold_ends(spark), 504), "fold")


def proba_rows(spark, d) -> DataFrame:
    """A stand-in probability for the book operators: the logistic of a feature."""
    return feature_rows(spark, d).select("date", "ticker", "r", (1 / (1 + F.exp(-F.col("zscore_21")))).alias("p"))


_PROBA = "SELECT date, ticker, r, 1 / (1 + exp(-zscore_21)) AS p FROM feats"
_NEUTRAL = "SELECT date, ticker, coalesce(w * least(1.0, 0.1 / nullif(max(abs(w)) OVER (PARTITION BY date), 0)), 0) AS w FROM (SELECT date, ticker, w / nullif(sum(abs(w)) OVER (PARTITION BY date), 0) AS w FROM (SELECT date, ticker, w - avg(w) OVER (PARTITION BY date) AS w FROM {}))"


@query("g18_neutral_book", "date:k ticker:k w:f", _NEUTRAL.format("(SELECT date, ticker, CASE WHEN p IS NOT NULL THEN CASE WHEN abs(p - 0.5) >= 0.05 THEN p - 0.5 ELSE 0 END END AS w FROM proba)"), feats=_FEATURES, proba=_PROBA)
def g18(spark, d):
    return signals.neutral_book(proba_rows(spark, d))


_SIDES = "SELECT *, CASE WHEN p IS NOT NULL THEN CASE WHEN abs(p - 0.5) >= 0.05 THEN sign(p - 0.5) ELSE 0 END END AS side FROM proba"


def side_rows(spark, d) -> DataFrame:
    return proba_rows(spark, d).withColumn("side", signals.primary_side(F.col("p")))


@query("g20_primary_side", "date:k ticker:k side:f", "SELECT * FROM sides WHERE side IS NOT NULL", feats=_FEATURES, proba=_PROBA, sides=_SIDES)
def g20(spark, d):
    return side_rows(spark, d).where("side IS NOT NULL")


@query("g21_meta_labels", "date:k ticker:k side:f meta:f", f"SELECT * FROM (SELECT *, CASE WHEN side <> 0 AND lead(r) OVER ({T}) IS NOT NULL THEN CASE WHEN side * lead(r) OVER ({T}) > 0 THEN 1.0 ELSE 0.0 END END AS meta FROM sides) WHERE meta IS NOT NULL", feats=_FEATURES, proba=_PROBA, sides=_SIDES)
def g21(spark, d):
    return signals.meta_labels(side_rows(spark, d)).where("meta IS NOT NULL")


@query("g23_meta_book", "date:k ticker:k w:f", _NEUTRAL.format("(SELECT date, ticker, side * greatest(0.5 + abs(p - 0.5) - 0.55, 0) AS w FROM sides)"), feats=_FEATURES, proba=_PROBA, sides=_SIDES)
def g23(spark, d):
    return signals.meta_book(side_rows(spark, d).withColumn("meta_p", 0.5 + F.abs(F.col("p") - 0.5)), 0.55)


# --- accounting -----------------------------------------------------------------------------


@query("b1_lookahead_guard", "book:k date:k ticker:k problem:k", "SELECT 'mom' AS book, date, ticker, 'unknown ticker' AS problem FROM (SELECT date, 'Brand#00' AS ticker FROM w_mom WHERE ticker = 'Brand#11' AND date >= CAST('1998-01-01' AS DATE))")
def b1(spark, d):
    m = views.market(spark, d)
    w = signals.cross_sectional_momentum(m, LOOKBACK, SKIP, 0.2, views.REBALANCE).withColumn("book", F.lit("mom"))
    bad = w.where("ticker = 'Brand#11' AND date >= DATE'1998-01-01'").withColumn("ticker", F.lit("Brand#00"))
    return account.problems(w.unionByName(bad), m)


@query("b2_lagged_pnl", "book:k date:k ret:f", "SELECT * FROM daily")
def b2(spark, d):
    return views.daily(spark, d)


@query("b3_next_open", "book:k date:k ret:f", "SELECT book, date, coalesce(sum(target * (nxt / open - 1)), 0) AS ret FROM (SELECT *, lead(open) OVER (PARTITION BY book, ticker ORDER BY date) AS nxt FROM aimed) GROUP BY 1, 2")
def b3(spark, d):
    m = views.market(spark, d)
    return account.account(views.weights(spark, d), m, fill="next_open")


@query("b4_liquidity", "date:k ticker:k adv:f sigma:f", "SELECT * FROM liq")
def b4(spark, d):
    return account.with_liquidity(views.market(spark, d), COSTS)


@query("b5_participation_cap", "date:k ticker:k cap:f", f"SELECT date, ticker, CASE WHEN 0.05 * adv * close / {COSTS.capital!r} > 0 THEN 0.05 * adv * close / {COSTS.capital!r} END AS cap FROM liq", digits=9)
def b5(spark, d):
    return account.with_liquidity(views.market(spark, d), COSTS).withColumn("cap", account.participation_cap(F.col("close"), F.col("adv"), COSTS.capital, 0.05))


_CAP = 0.002
_CHASED = f"""WITH RECURSIVE {{}}, keyed AS (SELECT book, ticker, date, target, CASE WHEN {_CAP} * adv * close / {COSTS.capital!r} > 0 THEN {_CAP} * adv * close / {COSTS.capital!r} END AS cap, row_number() OVER (PARTITION BY book, ticker ORDER BY date) AS k FROM aimed),
chase AS (
  SELECT book, ticker, date, k, target, CASE WHEN cap IS NULL THEN target ELSE greatest(-cap, least(cap, target)) END AS held FROM keyed WHERE k = 1
  UNION ALL
  SELECT s.book, s.ticker, s.date, s.k, s.target, t.held + CASE WHEN s.cap IS NULL THEN s.target - t.held ELSE greatest(-s.cap, least(s.cap, s.target - t.held)) END FROM chase t JOIN keyed s ON s.book = t.book AND s.ticker = t.ticker AND s.k = t.k + 1
)
"""


def _recursive(head: str, select: str) -> str:
    base = with_("SELECT * FROM aimed").removeprefix("WITH ").removesuffix("\nSELECT * FROM aimed")
    return head.format(base) + select


def capped_positions(spark, d) -> DataFrame:
    m = views.market(spark, d)
    return account.positions(views.weights(spark, d), m, COSTS, max_participation=_CAP)


def capped_targets(spark, d) -> DataFrame:
    """book, ticker, date, target, cap: what capped execution is given."""
    at = account.held(views.weights(spark, d), account.with_liquidity(views.market(spark, d), COSTS))
    return at.withColumn("cap", account.participation_cap(F.col("close"), F.col("adv"), COSTS.capital, _CAP))


@query("b6_capped_holdings", "book:k ticker:k date:k held:f")
def b6(spark, d):
    return capped_positions(spark, d)


SQL["b6_capped_holdings"] = _recursive(_CHASED, "SELECT book, ticker, date, round(held, 6) + 0.0 AS held FROM chase")


@query("b7_fill_gap", "book:k date:k fill_gap:f")
def b7(spark, d):
    return capped_positions(spark, d).groupBy("book", "date").agg(F.sum(F.abs(F.col("target") - F.col("held"))).alias("fill_gap"))


SQL["b7_fill_gap"] = _recursive(_CHASED, "SELECT book, date, round(sum(abs(target - held)), 6) + 0.0 AS fill_gap FROM chase GROUP BY 1, 2")


@query("b8_turnover", "book:k date:k turnover:f", "SELECT * FROM daily")
def b8(spark, d):
    return views.daily(spark, d)


@query("b9_half_spread", "book:k date:k spread_cost:f", f"SELECT book, date, turnover * {COSTS.half_spread_bps} / 1e4 AS spread_cost FROM daily", digits=9)
def b9(spark, d):
    return views.daily(spark, d).withColumn("spread_cost", account.half_spread(F.col("turnover"), COSTS.half_spread_bps))


@query("b10_impact", "book:k date:k ticker:k impact:f", f"SELECT book, date, ticker, {COSTS.impact_eta} * coalesce(sigma, 0) * sqrt(greatest(0, abs(trade) * 1e6 / close / nullif(adv, 0))) AS impact FROM traded WHERE abs(trade) > 0")
def b10(spark, d):
    m = views.market(spark, d)
    at = account.positions(views.weights(spark, d), m, COSTS).where("abs(trade) > 0")
    return at.withColumn("impact", account.square_root_impact(F.try_divide(F.abs("trade") * 1e6 / F.col("close"), F.col("adv")), F.col("sigma"), COSTS.impact_eta))


@query("b11_costs", "book:k date:k cost:f", "SELECT * FROM costed", digits=8)
def b11(spark, d):
    m = views.market(spark, d)
    return account.account(views.weights(spark, d), m, COSTS)


@query("b12_account", "book:k date:k gross:f cost:f ret:f turnover:f equity:f", "SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS equity FROM (SELECT *, gross - cost AS ret FROM costed)")
def b12(spark, d):
    m = views.market(spark, d)
    return account.account(views.weights(spark, d), m, COSTS)


IN, OUT = 104, 26
_FOLDS = f"SELECT CAST((s - {IN}) / {OUT} AS INTEGER) AS fold, a.date AS train_start, b.date AS fit_end, c.date AS oos_start, e.date AS oos_end FROM (SELECT unnest(range({IN}, 5000, {OUT})) AS s) x JOIN cal a ON a.pos = 0 JOIN cal b ON b.pos = s - 1 JOIN cal c ON c.pos = s JOIN cal e ON e.pos = s + {OUT - 1}"


def fold_table(spark, d) -> DataFrame:
    return account.folds(panel.calendar(views.market(spark, d)), IN, OUT)


@query("b13_folds", "fold:i train_start:k fit_end:k oos_start:k oos_end:k", "SELECT * FROM folds", folds=_FOLDS)
def b13(spark, d):
    return fold_table(spark, d)


_STITCHED = "SELECT d.book, f.fold, d.date, d.ret, d.turnover FROM daily d JOIN folds f ON d.date BETWEEN f.oos_start AND f.oos_end"


def stitched(spark, d) -> DataFrame:
    return account.walk_forward(views.daily(spark, d), fold_table(spark, d))


@query("b14_walk_forward", "book:k fold:i date:k ret:f equity:f", "SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS equity FROM stitched", folds=_FOLDS, stitched=_STITCHED)
def b14(spark, d):
    return stitched(spark, d)


@query("b15_fold_report", "book:k fold:i days:i sharpe:f compound:f", f"SELECT book, fold, count(*) AS days, avg(ret) / nullif(stddev_samp(ret), 0) * {math.sqrt(PERIODS)!r} AS sharpe, exp(sum(ln(1 + ret))) - 1 AS compound FROM stitched GROUP BY 1, 2", folds=_FOLDS, stitched=_STITCHED)
def b15(spark, d):
    return account.fold_report(stitched(spark, d), PERIODS)


CAPITALS = (1e5, 1e6, 1e7, 1e8, 1e9)
_SWEPT = f"SELECT t.book, c.capital, t.date, coalesce(sum(target * r), 0) AS gross, coalesce(sum({trade_cost('trade', 'c.capital')}), 0) AS cost FROM traded t CROSS JOIN (SELECT CAST(unnest({list(CAPITALS)}) AS DOUBLE) AS capital) c GROUP BY 1, 2, 3"


def _ann(x: str) -> str:
    return f"(pow(exp(sum(ln(1 + {x}))), {float(PERIODS)} / count(*)) - 1)"


def _shp(x: str) -> str:
    return f"(avg({x}) / nullif(stddev_samp({x}), 0) * {math.sqrt(PERIODS)!r})"


_SWEEP = f"SELECT book, capital, {_ann('(gross - cost)')} AS net_ann_return, {_shp('(gross - cost)')} AS net_sharpe, {_ann('gross')} - {_ann('(gross - cost)')} AS cost_drag_ann, sum(cost) * {PERIODS} / count(*) AS ann_cost, {_shp('gross')} AS gross_sharpe FROM swept GROUP BY 1, 2"


def sweep(spark, d) -> DataFrame:
    m = views.market(spark, d)
    return account.capital_sweep(views.weights(spark, d), m, COSTS, CAPITALS, PERIODS)


@query("b16_capital_sweep", "book:k capital:f net_ann_return:f net_sharpe:f cost_drag_ann:f ann_cost:f", "SELECT * FROM sweep", swept=_SWEPT, sweep=_SWEEP)
def b16(spark, d):
    return sweep(spark, d)


@query(
    "b17_capacity", "book:k gross_sharpe:f threshold:f capacity:f note:k",
    """SELECT book, gs AS gross_sharpe, CASE WHEN gs > 0 THEN th END AS threshold,
  CASE WHEN gs IS NULL OR gs <= 0 OR c IS NULL THEN NULL WHEN x0 IS NULL THEN c ELSE pow(10, log10(x0) + coalesce((th - y0) / nullif(y1 - y0, 0), 0) * (log10(c) - log10(x0))) END AS capacity,
  CASE WHEN gs IS NULL OR gs <= 0 THEN 'frictionless Sharpe not positive' WHEN c IS NULL THEN 'above the threshold throughout' WHEN x0 IS NULL THEN 'below the threshold from the first' ELSE '' END AS note
FROM (SELECT b.book, any_value(b.gs) AS gs, any_value(b.gs) * 0.5 AS th, min(s.capital) AS c, nullif(min_by(coalesce(s.x0, -1), s.capital), -1) AS x0, min_by(coalesce(s.y0, 0), s.capital) AS y0, min_by(s.net_sharpe, s.capital) AS y1
  FROM (SELECT book, any_value(gross_sharpe) AS gs FROM sweep GROUP BY 1) b LEFT JOIN (SELECT *, lag(capital) OVER (PARTITION BY book ORDER BY capital) AS x0, lag(net_sharpe) OVER (PARTITION BY book ORDER BY capital) AS y0 FROM sweep) s ON s.book = b.book AND s.net_sharpe < 0.5 * b.gs GROUP BY 1)""",
    digits=4, swept=_SWEPT, sweep=_SWEEP,
)
def b17(spark, d):
    return account.capacity(sweep(spark, d))


# --- regime and risk ------------------------------------------------------------------------

_LABELS = f"SELECT date, lag(hot) OVER (ORDER BY date) AS label FROM (SELECT date, CASE WHEN q / nullif(s, 0) > 1.1 THEN 1 WHEN q IS NOT NULL AND s IS NOT NULL AND s <> 0 THEN 0 END AS hot FROM (SELECT date, {rolling('stddev_samp', 'r', 8, 'm', 4)} AS q, {rolling('stddev_samp', 'r', 52, 'm', 26)} AS s FROM (SELECT *, 1 AS m FROM proxy)))"


def regime(spark, d) -> DataFrame:
    return risk.vol_ratio_regime(views.proxy(spark, d), 8, 52, 1.1)


@query("r1_market_proxy", "date:k r:f", "SELECT * FROM proxy")
def r1(spark, d):
    return views.proxy(spark, d)


@query("r2_vol_regime", "date:k label:i", "SELECT * FROM labels", labels=_LABELS)
def r2(spark, d):
    return regime(spark, d)


_HELD_LABELS = "SELECT date, coalesce(last_value(label IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS label FROM labels"


@query("r3_regime_sizing", "book:k date:k ticker:k w:f", "SELECT book, w.date, ticker, CASE WHEN label = 1 THEN w * 0.5 ELSE w END AS w FROM weights w JOIN held_labels l ON l.date = w.date", labels=_LABELS, held_labels=_HELD_LABELS)
def r3(spark, d):
    return risk.regime_sized(views.weights(spark, d), regime(spark, d))


@query("r4_switch", "date:k ticker:k w:f", "SELECT w.date, ticker, coalesce(max(CASE WHEN (label = 0 AND book = 'mom') OR (label = 1 AND book = 'rev') THEN w END), 0) AS w FROM weights w LEFT JOIN labels l ON l.date = w.date GROUP BY 1, 2", labels=_LABELS)
def r4(spark, d):
    return risk.switched(views.weights(spark, d), regime(spark, d), {0: "mom", 1: "rev"})


@query("r6_median_regime", "date:k label:i", f"SELECT date, CASE WHEN vol / nullif(CASE WHEN count(vol) OVER {window(52, 'm')} >= 13 THEN quantile_cont(vol, 0.5) OVER {window(52, 'm')} END, 0) > 1.1 THEN 1 WHEN vol IS NOT NULL AND count(vol) OVER {window(52, 'm')} >= 13 AND quantile_cont(vol, 0.5) OVER {window(52, 'm')} <> 0 THEN 0 END AS label FROM (SELECT date, 1 AS m, {rolling('stddev_samp', 'r', 8, 'm', 8)} AS vol FROM (SELECT *, 1 AS m FROM proxy))")
def r6(spark, d):
    p = views.proxy(spark, d).withColumn("series", F.lit("all"))
    return risk.median_ratio_regime(p.withColumn("vol", panel.rolling(F.stddev_samp, F.col("r"), 8, "series")), 52, 1.1)


@query("r8_fixed_fraction", "book:k date:k ticker:k w:f", "SELECT book, date, ticker, w * 0.25 AS w FROM weights")
def r8(spark, d):
    return views.weights(spark, d).withColumn("w", risk.fixed_fraction(F.col("w"), 0.25))


_SCALED = {
    "gains": "SELECT w.book, w.date, coalesce(sum(w.w * r.r), 0) AS x FROM weights w JOIN rets r ON r.date = w.date AND r.ticker = w.ticker GROUP BY 1, 2",
    "vols": f"SELECT book, date, {rolling('stddev_samp', 'x', 52, 'book', 13)} * {math.sqrt(PERIODS)!r} AS v FROM gains",
    "scales": "SELECT book, date, CASE WHEN v = 0 THEN 3.0 WHEN v IS NOT NULL THEN least(3.0, 0.1 / v) END AS s FROM vols",
    "known_scales": "SELECT book, date, lag(s) OVER (PARTITION BY book ORDER BY date) AS s FROM scales",
}


@query("r9_vol_target", "book:k date:k ticker:k w:f", "SELECT w.book, w.date, w.ticker, w.w * k.s AS w FROM weights w JOIN known_scales k ON k.book = w.book AND k.date = w.date", **_SCALED)
def r9(spark, d):
    m = views.market(spark, d)
    return risk.vol_target(views.weights(spark, d), m, 0.10, 52, 3.0, PERIODS)


_STOP = (0.01, 8)


@query("r11_drawdown_stop", "book:k date:k stopped:f")
def r11(spark, d):
    return risk.drawdown_stop(views.daily(spark, d), *_STOP)


SQL["r11_drawdown_stop"] = (
    "WITH RECURSIVE "
    + with_("SELECT * FROM daily").removeprefix("WITH ").removesuffix("\nSELECT * FROM daily")
    + f""", seq AS (SELECT book, date, coalesce(ret, 0) AS r, row_number() OVER (PARTITION BY book ORDER BY date) AS k FROM daily),
fold AS (
  SELECT book, date, k, r AS stopped, 1 + r AS e, greatest(1.0, 1 + r) AS p, CASE WHEN (1 + r) / greatest(1.0, 1 + r) - 1 <= -{_STOP[0]} THEN {_STOP[1]} ELSE 0 END AS c FROM seq WHERE k = 1
  UNION ALL
  SELECT s.book, s.date, s.k, CASE WHEN f.c = 0 THEN s.r ELSE 0 END, CASE WHEN f.c = 0 THEN f.e * (1 + s.r) ELSE f.e END,
    CASE WHEN f.c = 0 THEN greatest(f.p, f.e * (1 + s.r)) WHEN f.c = 1 THEN f.e ELSE f.p END,
    CASE WHEN f.c = 0 THEN CASE WHEN f.e * (1 + s.r) / greatest(f.p, f.e * (1 + s.r)) - 1 <= -{_STOP[0]} THEN {_STOP[1]} ELSE 0 END ELSE f.c - 1 END
  FROM fold f JOIN seq s ON s.book = f.book AND s.k = f.k + 1
)
SELECT book, date, round(stopped, 6) + 0.0 AS stopped FROM fold"""
)


@query("r12_capped", "book:k date:k ticker:k w:f", "SELECT book, date, ticker, greatest(-0.05, least(0.05, w)) AS w FROM weights")
def r12(spark, d):
    return views.weights(spark, d).withColumn("w", risk.capped(F.col("w"), 0.05))


@query("r13_limits", "book:k worst_name_weight:f worst_gross_exposure:f name_limit_breached:k gross_limit_breached:k", "SELECT book, max(t) AS worst_name_weight, max(g) AS worst_gross_exposure, max(t) > 0.1 + 1e-9 AS name_limit_breached, max(g) > 2.0 + 1e-9 AS gross_limit_breached FROM (SELECT book, date, max(abs(w)) AS t, sum(abs(w)) AS g FROM weights GROUP BY 1, 2) GROUP BY 1")
def r13(spark, d):
    return risk.limit_report(views.weights(spark, d))


_Z = quantile_of_normal(0.05)
_TAIL = f"""SELECT a.book, -q AS var, -(SELECT avg(ret) FROM daily x WHERE x.book = a.book AND x.ret <= q) AS cvar, -(mu + {_Z!r} * sd) AS parametric_var,
  -(mu + ({_Z!r} + ({_Z!r} * {_Z!r} - 1) / 6 * s + (pow({_Z!r}, 3) - 3 * {_Z!r}) / 24 * k - (2 * pow({_Z!r}, 3) - 5 * {_Z!r}) / 36 * s * s) * sd) AS cornish_fisher_var
FROM (SELECT d.book, any_value(q) AS q, any_value(mu) AS mu, any_value(sd) AS sd, avg(pow(ret - mu, 3)) / pow(avg(pow(ret - mu, 2)), 1.5) AS s, avg(pow(ret - mu, 4)) / pow(avg(pow(ret - mu, 2)), 2) - 3 AS k
  FROM daily d JOIN (SELECT book, quantile_cont(ret, 0.05) AS q, avg(ret) AS mu, stddev_samp(ret) AS sd FROM daily GROUP BY 1) p ON p.book = d.book GROUP BY 1) a"""


@query("r14_historical_tail", "book:k var:f cvar:f", _TAIL)
def r14(spark, d):
    return risk.tail_report(views.daily(spark, d))


@query("r15_model_tail", "book:k parametric_var:f cornish_fisher_var:f", _TAIL)
def r15(spark, d):
    return risk.tail_report(views.daily(spark, d))


@query("r17_drawdown", "book:k max_drawdown:f max_dd_duration:i", "SELECT * FROM falls")
def r17(spark, d):
    return risk.drawdown_report(views.daily(spark, d))


_BETA = "SELECT d.book, covar_samp(d.ret, p.r) / nullif(var_samp(p.r), 0) AS beta FROM daily d JOIN proxy p ON p.date = d.date WHERE p.r IS NOT NULL GROUP BY 1"


@query("r18_beta", "book:k beta:f", _BETA)
def r18(spark, d):
    return risk.beta(views.daily(spark, d).join(views.proxy(spark, d).withColumnRenamed("r", "b"), "date"))


_WORST = "SELECT n AS window_rows, min(exp(x) - 1) AS market_move FROM (" + " UNION ALL ".join(f"SELECT {n} AS n, {rolling('sum', 'ln(1 + r)', n, 'm')} AS x FROM (SELECT *, 1 AS m FROM proxy WHERE r IS NOT NULL)" for n in (1, 5, 21)) + ") GROUP BY 1"


@query("r19_worst_moves", "window_rows:i market_move:f", "SELECT * FROM worst", worst=_WORST)
def r19(spark, d):
    return risk.worst_moves(views.proxy(spark, d).withColumn("market", F.lit("all"))).withColumnRenamed("window", "window_rows")


@query("r20_stress", "book:k scenario:k market_move:f beta:f est_pnl:f", "SELECT book, scenario, market_move, beta, beta * market_move AS est_pnl FROM betas CROSS JOIN (SELECT 'Worst ' || window_rows || 'd' AS scenario, market_move FROM worst UNION ALL SELECT 'crash', -0.2)", worst=_WORST, betas=_BETA)
def r20(spark, d):
    return risk.stress(views.daily(spark, d), views.proxy(spark, d), custom={"crash": -0.2})


# --- allocation -----------------------------------------------------------------------------

_ALLOC = f"SELECT date, book AS sleeve, coalesce(i / nullif(sum(i) OVER (PARTITION BY date), 0), 0) AS a FROM (SELECT *, CASE WHEN v > 0 THEN 1 / v END AS i FROM (SELECT date, book, lag(v) OVER (PARTITION BY book ORDER BY date) AS v FROM (SELECT *, {rolling('stddev_samp', 'ret', 26, 'book', 13)} AS v FROM daily)))"


def sleeves(spark, d) -> DataFrame:
    return views.daily(spark, d).withColumnRenamed("book", "sleeve")


def alloc(spark, d) -> DataFrame:
    return allocation.inverse_vol(sleeves(spark, d), 26, 13)


@query("a1_combine", "date:k ticker:k w:f", "SELECT a.date, w.ticker, sum(w.w * a.a) AS w FROM alloc a JOIN weights w ON w.date = a.date AND w.book = a.sleeve GROUP BY 1, 2", alloc=_ALLOC)
def a1(spark, d):
    return allocation.combine(views.weights(spark, d).withColumnRenamed("book", "sleeve"), alloc(spark, d))


@query("a2_inverse_vol", "date:k sleeve:k a:f", "SELECT * FROM alloc", alloc=_ALLOC)
def a2(spark, d):
    return alloc(spark, d)


@query("a3_blend", "date:k ret:f", "SELECT d.date, sum(coalesce(ret, 0) * coalesce(a, 0)) AS ret FROM daily d LEFT JOIN alloc a ON a.date = d.date AND a.sleeve = d.book GROUP BY 1", alloc=_ALLOC)
def a3(spark, d):
    return allocation.blend(sleeves(spark, d), alloc(spark, d))


@query("a4_stream_vol_target", "book:k date:k scaled:f", f"SELECT book, date, ret * lag(s) OVER (PARTITION BY book ORDER BY date) AS scaled FROM (SELECT *, CASE WHEN v IS NOT NULL THEN CASE WHEN v = 0 THEN 3.0 ELSE least(3.0, 0.1 / v) END END AS s FROM (SELECT *, {rolling('stddev_samp', 'ret', 52, 'book', 13)} * {math.sqrt(PERIODS)!r} AS v FROM daily))")
def a4(spark, d):
    return risk.stream_vol_target(views.daily(spark, d), 0.10, 52, 3.0, PERIODS)


_CORR = "SELECT x.ticker AS i, y.ticker AS j, corr(x.r, y.r) AS corr, covar_samp(x.r, y.r) AS cov FROM rets x JOIN rets y ON y.date = x.date WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2"


def named(spark, d) -> DataFrame:
    return views.market(spark, d).select("date", F.col("ticker").alias("name"), "r")


@query("a5_correlation_distance", "i:k j:k corr:f distance:f", "SELECT *, CASE WHEN i = j THEN 0 ELSE sqrt(greatest(0, 0.5 * (1 - corr))) END AS distance FROM corrs", corrs=_CORR)
def a5(spark, d):
    return allocation.correlations(named(spark, d))


@query("a6_inverse_variance", "name:k w:f", "SELECT ticker AS name, (1 / v) / sum(1 / v) OVER () AS w FROM (SELECT ticker, var_samp(r) AS v FROM rets GROUP BY 1)")
def a6(spark, d):
    return allocation.inverse_variance(named(spark, d))


@query("a9_concentration", "book:k herfindahl:f effective_n:f", "SELECT book, avg(h) AS herfindahl, avg(1 / h) AS effective_n FROM (SELECT book, date, sum(w * w) AS h FROM weights GROUP BY 1, 2) WHERE h > 0 GROUP BY 1")
def a9(spark, d):
    return allocation.concentration(views.weights(spark, d))


@query("a10_common_window", "book:k sharpe:f days:i", f"SELECT book, {_shp('ret')} AS sharpe, count(*) AS days FROM live WHERE date IN (SELECT date FROM live GROUP BY 1 HAVING count(DISTINCT book) = (SELECT count(DISTINCT book) FROM live)) GROUP BY 1", live="SELECT * FROM daily WHERE ret <> 0")
def a10(spark, d):
    return allocation.sharpe(allocation.common_dates(views.daily(spark, d).where("ret <> 0")), PERIODS)


# --- performance ----------------------------------------------------------------------------

_METRICS = f"""SELECT d.book, count(*) AS n_periods, CASE WHEN exp(sum(ln(1 + ret))) > 0 THEN {_ann('ret')} END AS ann_return, stddev_samp(ret) * {math.sqrt(PERIODS)!r} AS ann_vol, {_shp('ret')} AS sharpe,
  avg(ret) / nullif(sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)), 0) * {math.sqrt(PERIODS)!r} AS sortino, {_ann('ret')} / nullif(abs(any_value(f.max_drawdown)), 0) AS calmar, any_value(f.max_drawdown) AS max_drawdown, any_value(f.max_dd_duration) AS max_dd_duration,
  avg(CASE WHEN ret <> 0 THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END) AS hit_rate, avg(CASE WHEN ret > 0 THEN ret END) AS avg_win, avg(CASE WHEN ret < 0 THEN ret END) AS avg_loss,
  coalesce(sum(CASE WHEN ret > 0 THEN ret END), 0) / nullif(-sum(CASE WHEN ret < 0 THEN ret END), 0) AS profit_factor, avg(turnover) * {PERIODS} AS ann_turnover
FROM daily d JOIN falls f ON f.book = d.book GROUP BY 1"""

for _name, _cols in {
    "p1_annual_return": "ann_return:f",
    "p2_annual_vol": "ann_vol:f",
    "p3_sharpe": "sharpe:f",
    "p4_sortino": "sortino:f",
    "p5_calmar": "calmar:f",
    "p6_hit_rate": "hit_rate:f",
    "p7_win_loss": "avg_win:f avg_loss:f profit_factor:f",
    "p8_turnover": "ann_turnover:f",
    "p9_metrics": "n_periods:i ann_return:f ann_vol:f sharpe:f sortino:f calmar:f max_drawdown:f max_dd_duration:i hit_rate:f avg_win:f avg_loss:f profit_factor:f ann_turnover:f",
}.items():
    query(_name, "book:k " + _cols, _METRICS, digits=5)(lambda spark, d: performance.metrics(views.daily(spark, d), 0.0, PERIODS))


@query("p10_rolling_sharpe", "book:k date:k rolling_sharpe:f", f"SELECT book, date, CASE WHEN max(ret) OVER {window(26, 'book')} > min(ret) OVER {window(26, 'book')} THEN {rolling('avg', 'ret', 26, 'book')} / nullif({rolling('stddev_samp', 'ret', 26, 'book')}, 0) * {math.sqrt(PERIODS)!r} END AS rolling_sharpe FROM daily", digits=4)
def p10(spark, d):
    return performance.rolling_sharpe(views.daily(spark, d), 26, PERIODS)


@query("p11_rolling_beta", "book:k date:k rolling_beta:f", f"SELECT d.book, d.date, b AS rolling_beta FROM daily d LEFT JOIN (SELECT book, date, CASE WHEN count(*) OVER {window(26, 'book')} >= 26 THEN covar_samp(ret, r) OVER {window(26, 'book')} / nullif(var_samp(r) OVER {window(26, 'book')}, 0) END AS b FROM (SELECT d.book, d.date, d.ret, p.r FROM daily d JOIN proxy p ON p.date = d.date WHERE p.r IS NOT NULL)) x ON x.book = d.book AND x.date = d.date")
def p11(spark, d):
    return performance.rolling_beta(views.daily(spark, d), views.proxy(spark, d), 26)


@query(
    "p12_per_year", "book:k year:i compound:f vol:f sharpe:f max_drawdown:f days:i",
    f"""SELECT book, y AS year, exp(sum(ln(1 + ret))) - 1 AS compound, stddev_samp(ret) * {math.sqrt(PERIODS)!r} AS vol, {_shp('ret')} AS sharpe, min(e / p - 1) AS max_drawdown, count(*) AS days FROM (
  SELECT *, max(e) OVER (PARTITION BY book, y ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM (
    SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY book, y ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS e FROM (SELECT *, year(date) AS y FROM daily))) GROUP BY 1, 2""",
    digits=4,
)
def p12(spark, d):
    return performance.per_year(views.daily(spark, d), PERIODS)


def moments(spark, d) -> DataFrame:
    return performance.sharpe_moments(views.daily(spark, d), 0.0, PERIODS)


@query("p13_sharpe_moments", "book:k n:i sr:f skew:f kurtosis:f", "SELECT * FROM moments", digits=5)
def p13(spark, d):
    return moments(spark, d)


_VAR = "(greatest(1e-12, 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) / greatest(n - 1, 1))"
_TERM = (1 - performance.EULER) * quantile_of_normal(1 - 1 / 45) + performance.EULER * quantile_of_normal(1 - 1 / (45 * math.e))


@query("p14_probabilistic_sharpe", "book:k psr:f", f"SELECT book, {norm_cdf_sql('x')} AS psr FROM (SELECT book, (sr - {0.5 / math.sqrt(PERIODS)!r}) / sqrt({_VAR}) AS x FROM moments)")
def p14(spark, d):
    return performance.probabilistic_sharpe(moments(spark, d), 0.5, PERIODS)


@query("p15_deflated_sharpe", "book:k sr_star_annual:f dsr:f", f"SELECT book, star * {math.sqrt(PERIODS)!r} AS sr_star_annual, {norm_cdf_sql('x')} AS dsr FROM (SELECT book, star, (sr - star) / sqrt(v) AS x FROM (SELECT *, sqrt(v) * {_TERM!r} AS star FROM (SELECT *, {_VAR} AS v FROM moments)))")
def p15(spark, d):
    return performance.deflated_sharpe(moments(spark, d), 45, False, PERIODS)


@query("p15_deflated_sharpe_trials", "book:k sr_star_annual:f dsr:f", f"SELECT book, star * {math.sqrt(PERIODS)!r} AS sr_star_annual, {norm_cdf_sql('x')} AS dsr FROM (SELECT book, star, (sr - star) / sqrt(v) AS x FROM (SELECT *, sqrt((SELECT var_samp(sr) FROM moments)) * {_TERM!r} AS star, {_VAR} AS v FROM moments))")
def p15b(spark, d):
    return performance.deflated_sharpe(moments(spark, d), 45, True, PERIODS)


@query("p16_min_track_record", "book:k min_periods:f significant_now:k", f"SELECT book, m AS min_periods, coalesce(n >= m, false) AS significant_now FROM (SELECT *, CASE WHEN sr > 0 THEN 1 + (1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) * pow({quantile_of_normal(0.95)!r} / sr, 2) END AS m FROM moments)", digits=2)
def p16(spark, d):
    return performance.min_track_record(moments(spark, d), 0.0, 0.95, PERIODS)


def _draw(kind: str) -> str:
    return f"(CAST(('0x' || substr(md5('7|{kind}|' || b || '|' || t), 1, 8)) AS BIGINT) / 4294967296.0)"


DRAWS = 1000
_BOOT = f"""SELECT book, b, t, ret FROM (
  SELECT g.book, g.b, g.t, CAST((last_value(CASE WHEN again THEN fresh END IGNORE NULLS) OVER w + g.t - last_value(CASE WHEN again THEN g.t END IGNORE NULLS) OVER w) % g.n AS BIGINT) AS i FROM (
    SELECT book, n, b, t, t = 0 OR {_draw('r')} < 0.1 AS again, floor({_draw('f')} * n) AS fresh FROM (SELECT book, count(*) AS n FROM daily GROUP BY 1) c CROSS JOIN (SELECT unnest(range(0, {DRAWS})) AS b) bb JOIN (SELECT book AS book2, row_number() OVER (PARTITION BY book ORDER BY date) - 1 AS t FROM daily) tt ON tt.book2 = c.book) g
  WINDOW w AS (PARTITION BY g.book, g.b ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x JOIN (SELECT book AS book3, ret, row_number() OVER (PARTITION BY book ORDER BY date) - 1 AS k FROM daily) y ON y.book3 = x.book AND y.k = x.i"""


@query("p17_bootstrap_rows", "book:k b:i t:i ret:f", "SELECT * FROM boot", boot=_BOOT)
def p17(spark, d):
    return performance.bootstrap_rows(views.daily(spark, d), DRAWS, 10, 7)


@query(
    "p18_bootstrap", "book:k sharpe_low:f sharpe_high:f cagr_low:f cagr_high:f p_positive:f",
    f"SELECT book, quantile_cont(s, 0.025) AS sharpe_low, quantile_cont(s, 0.975) AS sharpe_high, quantile_cont(c, 0.025) AS cagr_low, quantile_cont(c, 0.975) AS cagr_high, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS p_positive FROM (SELECT book, b, {_shp('ret')} AS s, {_ann('ret')} AS c FROM boot GROUP BY 1, 2) GROUP BY 1",
    digits=4, boot=_BOOT,
)
def p18(spark, d):
    return performance.bootstrap_report(views.daily(spark, d), 0.95, DRAWS, 10, 7, PERIODS)


ROLES = {"market": "Brand#11", "small": "Brand#23", "value": "Brand#4", "growth": "Brand#15"}
_FACTORS = "SELECT date, m AS mkt, s - m AS smb, v - g AS hml FROM (SELECT date, " + ", ".join(f"max(CASE WHEN ticker = '{t}' THEN r END) AS {k[0]}" for k, t in ROLES.items()) + " FROM rets GROUP BY 1)"


def factors(spark, d) -> DataFrame:
    return performance.factor_returns(views.market(spark, d), ROLES)


@query("p19_factor_returns", "date:k mkt:f smb:f hml:f", _FACTORS)
def p19(spark, d):
    return factors(spark, d)


@query("p20_factor_decomposition", "book:k alpha_annual:f alpha_t:f alpha_p:f beta_mkt:f beta_smb:f beta_hml:f t_mkt:f t_smb:f t_hml:f r_squared:f n:i")
def p20(spark, d):
    return performance.factor_decomposition(views.daily(spark, d), factors(spark, d), 0.0, 5, 30, PERIODS)


_TRIALS = f"SELECT 'books' AS family, ticker AS name, 2 * {norm_cdf_sql('(-abs(x))')} AS p FROM (SELECT ticker, avg(r) / (stddev_samp(r) / sqrt(count(r))) AS x FROM rets GROUP BY 1)"
_FDR = "SELECT family, name, p, least(1.0, min(p * m / k) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q, coalesce(k <= (max(CASE WHEN p <= 0.10 * k / m THEN k END) OVER (PARTITION BY family)), false) AS keep FROM (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, name) AS k FROM trials)"


def trials(spark, d) -> DataFrame:
    from panelforge.functions.mathx import norm_cdf

    t = views.market(spark, d).groupBy("ticker").agg((F.avg("r") / (F.stddev_samp("r") / F.sqrt(F.count("r")))).alias("x"))
    return t.select(F.lit("books").alias("family"), F.col("ticker").alias("name"), (2 * norm_cdf(-F.abs("x"))).alias("p"))


@query("p21_fdr", "family:k name:k p:f q:f keep:k", _FDR, trials=_TRIALS)
def p21(spark, d):
    return performance.fdr(trials(spark, d), 0.10)


@query("p22_fdr_report", "family:k tested:i kept:i best_q:f", "SELECT family, count(*) AS tested, sum(CASE WHEN keep THEN 1 ELSE 0 END) AS kept, min(q) AS best_q FROM fdr GROUP BY 1", trials=_TRIALS, fdr=_FDR)
def p22(spark, d):
    return performance.fdr(trials(spark, d), 0.10).groupBy("family").agg(F.count("*").alias("tested"), F.count_if("keep").alias("kept"), F.min("q").alias("best_q"))


@query("p23_tearsheet", "book:k n_periods:i sharpe:f max_drawdown:f var:f cvar:f cornish_fisher_var:f psr:f", f"SELECT m.*, t.var, t.cvar, t.cornish_fisher_var, p.psr FROM metrics m JOIN tail t ON t.book = m.book JOIN (SELECT book, {norm_cdf_sql('x')} AS psr FROM (SELECT book, sr / sqrt({_VAR}) AS x FROM moments)) p ON p.book = m.book", digits=5, metrics=_METRICS, tail=_TAIL)
def p23(spark, d):
    at = views.daily(spark, d)
    return performance.metrics(at, 0.0, PERIODS).join(risk.tail_report(at), "book").join(performance.probabilistic_sharpe(moments(spark, d), 0.0, PERIODS).select("book", "psr"), "book")


@query("p24_histogram", "book:k bin:i count:i", "SELECT book, least(9, floor(coalesce((ret - lo) / nullif(hi - lo, 0), 0) * 10)) AS bin, count(*) AS count FROM (SELECT d.book, d.ret, x.lo, x.hi FROM daily d JOIN (SELECT book, min(ret) AS lo, max(ret) AS hi FROM daily GROUP BY 1) x ON x.book = d.book) GROUP BY 1, 2")
def p24(spark, d):
    return performance.histogram(views.daily(spark, d), "ret", 10, "book")


@query("p24_regime_spans", "label:i start:k end_date:k days:i", "SELECT label, min(date) AS start, max(date) AS end_date, count(*) AS days FROM (SELECT *, sum(n) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER (ORDER BY date) AND lag(date) OVER (ORDER BY date) IS NOT NULL THEN 0 ELSE 1 END AS n FROM labels)) GROUP BY g, label", labels=_LABELS)
def p24b(spark, d):
    return performance.spans(regime(spark, d)).withColumnRenamed("end", "end_date")


K = 5
_CV = f"""SELECT b.block, l.ticker, l.date, CASE WHEN l.date BETWEEN b.s AND b.e THEN 'test' WHEN l.date <= b.t AND l.t1 >= b.s THEN 'purged' WHEN l.date > b.t AND l.date <= b.h THEN 'embargoed' ELSE 'train' END AS side
FROM rows_ l CROSS JOIN (SELECT x.block, x.s, x.e, x.t, coalesce(max(CASE WHEN z.k <= x.n + 5 THEN z.date END), x.t) AS h FROM (SELECT block, min(s) AS s, max(e) AS e, max(t) AS t, max(n) AS n FROM (SELECT bl.block, bl.s, bl.e, bl.t, (SELECT count(*) FROM dated q WHERE q.date <= bl.t) AS n FROM (SELECT d.block, min(d.date) AS s, max(d.date) AS e, max(r.t1) AS t FROM (SELECT date, ntile({K}) OVER (ORDER BY date) - 1 AS block FROM dated) d JOIN rows_ r ON r.date = d.date GROUP BY 1) bl) GROUP BY 1) x LEFT JOIN dated z ON z.date > x.t GROUP BY 1, 2, 3, 4) b"""
_ROWS = f"SELECT ticker, date, t1 FROM labelled WHERE {_WHOLE} AND y IS NOT NULL"


@query("g24_purged_folds", "block:i ticker:k date:k side:k", _CV, feats=_FEATURES, labelled=_LABELLED, rows_=_ROWS, dated="SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM rows_)")
def g24(spark, d):
    from panelforge.operators import cv

    rows = signals.labelled(feature_rows(spark, d)).dropna(subset=[*signals.FEATURES, "y"])
    return cv.purged_folds(rows, K, 5)
