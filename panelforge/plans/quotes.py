"""Queries over option quotes, orders on them and their ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.mathx import norm_cdf_sql, norm_pdf_sql
from panelforge.operators import options
from panelforge.plans import views
from panelforge.plans.store import stored
from panelforge.plans.sql import rounded, with_
from panelforge.plans.views import RATE

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, columns: str, source: str | None = None, digits: int = 6, **own: str):
    def add(f):
        kinds = dict(c.split(":") for c in columns.split())
        QUERIES[name] = lambda spark, sf_dir: views.rounded(f(spark, sf_dir).select(*kinds), digits)
        if source is not None:
            SQL[name] = with_(rounded(kinds, source, digits), **own)
        return f

    return add



def true_points(spark, d) -> DataFrame:
    """Surface points from the known volatility, straight from the parts: a part's quotes are made in one task, so neither the quotes are written nor a row of them shuffled."""

    def build() -> DataFrame:
        otm = options.with_forward(options.clean(views.priced_quotes(spark, d)), RATE)
        return options.points(otm, RATE, vol="true_vol")

    return stored(spark, d, "points", build)


@query("o1_hygiene", "underlying:k expiry:k strike:f option_type:k reason:k", "SELECT * FROM flagged WHERE reason IS NOT NULL", digits=4)
def o1(spark, d):
    return options.flagged(views.quotes(spark, d)).where("reason IS NOT NULL")


@query("o1_dropped", "reason:k n:i", "SELECT reason, count(*) AS n FROM flagged WHERE reason IS NOT NULL GROUP BY 1")
def o1b(spark, d):
    return options.dropped(views.quotes(spark, d))


@query("o2_price", "underlying:k expiry:k strike:f option_type:k price:f", "SELECT underlying, expiry, strike, option_type, fair AS price FROM quotes", digits=4)
def o2(spark, d):
    q = views.quotes(spark, d)
    priced = lambda terms: options.with_price(terms, F.col("spot"), F.col("strike"), F.col("tte"), F.col("true_vol"), F.col("option_type") == "call", RATE)
    return views.once(spark, d, "prices", q, priced)


_D = f"SELECT *, d1 - true_vol * sqrt(tte) AS d2 FROM (SELECT *, (ln(spot / strike) + ({RATE} + true_vol * true_vol / 2) * tte) / (true_vol * sqrt(tte)) AS d1 FROM flagged WHERE reason IS NULL)"
_C = "option_type = 'call'"


@query(
    "o3_greeks", "underlying:k expiry:k strike:f option_type:k delta:f gamma:f vega:f theta:f rho:f",
    f"""SELECT underlying, expiry, strike, option_type, CASE WHEN {_C} THEN {norm_cdf_sql('d1')} ELSE -{norm_cdf_sql('(-d1)')} END AS delta, {norm_pdf_sql('d1')} / (spot * true_vol * sqrt(tte)) AS gamma,
  spot * {norm_pdf_sql('d1')} * sqrt(tte) / 100 AS vega,
  (-spot * {norm_pdf_sql('d1')} * true_vol / (2 * sqrt(tte)) + CASE WHEN {_C} THEN -{RATE} * strike * exp(-{RATE} * tte) * {norm_cdf_sql('d2')} ELSE {RATE} * strike * exp(-{RATE} * tte) * {norm_cdf_sql('(-d2)')} END) / 365 AS theta,
  CASE WHEN {_C} THEN strike * tte * exp(-{RATE} * tte) * {norm_cdf_sql('d2')} ELSE -strike * tte * exp(-{RATE} * tte) * {norm_cdf_sql('(-d2)')} END / 100 AS rho FROM dd""",
    digits=5, dd=_D,
)
def o3(spark, d):
    return options.trader_units(greeks(spark, d))


def greeks(spark, d) -> DataFrame:
    return views.once(spark, d, "greeks", options.clean(views.quotes(spark, d)), lambda terms: options.with_greeks(terms, RATE, vol="true_vol"))


@query("o4_american", "underlying:k expiry:k strike:f option_type:k american:f european:f premium:f", digits=4)
def o4(spark, d):
    return views.once(spark, d, "american", options.clean(views.quotes(spark, d)), lambda terms: options.early_exercise(terms, rate=RATE, vol="true_vol"))


@query("o5_american_greeks", "underlying:k expiry:k strike:f option_type:k price:f fd_delta:f fd_gamma:f fd_theta:f fd_vega:f fd_rho:f", digits=4)
def o5_american(spark, d):
    return american_greeks(spark, d, options.clean(views.quotes(spark, d)))


def american_greeks(spark, d, quoted: DataFrame) -> DataFrame:
    return views.once(spark, d, "american-greeks", quoted, lambda terms: options.american_greeks(terms, RATE, vol="true_vol"))


@query("o5_american_calls", "underlying:k expiry:k strike:f price:k delta:k gamma:k vega:k rho:k", "SELECT underlying, expiry, strike, true AS price, true AS delta, true AS gamma, true AS vega, true AS rho FROM flagged WHERE reason IS NULL AND option_type = 'call'", digits=4)
def o5_calls(spark, d):
    """Calls without dividends, which early exercise gains nothing: whether the tree's figures are the closed form's, to the tree's own error."""
    quoted = options.clean(views.quotes(spark, d))
    calls = american_greeks(spark, d, quoted).where("option_type = 'call'")
    at = options.with_greeks(calls.withColumnRenamed("price", "tree"), RATE, vol="true_vol")
    at = options.with_price(at, *(F.col(c) for c in ("spot", "strike", "tte", "true_vol")), F.lit(True), RATE, out="fair")
    near = lambda a, b, e: F.abs(F.col(a) - F.col(b)) <= e
    spot = F.col("spot")
    return at.select("underlying", "expiry", "strike", near("tree", "fair", 5e-4 * spot).alias("price"), near("fd_delta", "delta", F.lit(0.01)).alias("delta"), (F.abs(F.col("fd_gamma") - F.col("gamma")) * spot <= 0.5).alias("gamma"), near("fd_vega", "vega", 0.02 * spot).alias("vega"), near("fd_rho", "rho", 0.02 * spot).alias("rho"))


@query("o6_bounds", "underlying:k expiry:k strike:f option_type:k lower:f upper:f", f"SELECT underlying, expiry, strike, option_type, greatest(0, CASE WHEN {_C} THEN spot - strike * exp(-{RATE} * tte) ELSE strike * exp(-{RATE} * tte) - spot END) AS lower, CASE WHEN {_C} THEN spot ELSE strike * exp(-{RATE} * tte) END AS upper FROM quotes", digits=4)
def o6(spark, d):
    return options.bounds(views.quotes(spark, d), RATE)


@query("o7_implied_vol", "underlying:k expiry:k strike:f option_type:k implied_vol:f reason:k", "SELECT underlying, expiry, strike, option_type, true_vol AS implied_vol, 'ok' AS reason FROM otm", digits=4)
def o7(spark, d):
    return implied(spark, d)


def implied(spark, d) -> DataFrame:
    otm = options.with_forward(options.clean(views.quotes(spark, d)), RATE)
    return views.once(spark, d, "implied", otm, lambda terms: options.implied_vols(terms, RATE), ("mid", "spot", "strike", "tte", "option_type"))


@query("o8_forward", "underlying:k expiry:k strike:f option_type:k forward:f log_moneyness:f", "SELECT * FROM otm", digits=4)
def o8(spark, d):
    return options.with_forward(options.clean(views.quotes(spark, d)), RATE)


@query("o9_points", "underlying:k expiry:k strike:f option_type:k implied_vol:f total_variance:f call_price:f", "SELECT * FROM points", digits=4)
def o9(spark, d):
    return options.points(implied(spark, d), RATE)


_SEG = """SELECT underlying, as_of, tte AS t, log_moneyness AS x0, total_variance AS y0, lead(log_moneyness) OVER w AS x1, lead(total_variance) OVER w AS y1, row_number() OVER w AS r FROM points WINDOW w AS (PARTITION BY underlying, as_of, tte ORDER BY log_moneyness)"""
_MATS = """SELECT underlying, as_of, tte AS t0, lead(tte) OVER w AS t1, row_number() OVER w AS r FROM (SELECT DISTINCT underlying, as_of, tte FROM points) WINDOW w AS (PARTITION BY underlying, as_of ORDER BY tte)"""
_LINEAR = "y0 + CASE WHEN log_moneyness > x0 AND x1 IS NOT NULL THEN (log_moneyness - x0) / (x1 - x0) ELSE 0 END * (coalesce(y1, y0) - y0)"
_INSIDE = "((log_moneyness >= x0 AND (x1 IS NULL OR log_moneyness < x1)) OR (s.r = 1 AND log_moneyness < x0))"
_AT = f"""SELECT a.underlying, a.as_of, a.log_moneyness, a.tte, a.w0 + CASE WHEN a.tte > a.t0 AND a.t1 IS NOT NULL THEN (a.tte - a.t0) / (a.t1 - a.t0) ELSE 0 END * (b.w1 - a.w0) AS total_variance FROM
  (SELECT q.*, m.t0, m.t1, {_LINEAR} AS w0 FROM asked q JOIN mats m ON m.underlying = q.underlying AND m.as_of = q.as_of AND ((q.tte >= m.t0 AND (m.t1 IS NULL OR q.tte < m.t1)) OR (m.r = 1 AND q.tte < m.t0)) JOIN segs s ON s.underlying = q.underlying AND s.as_of = q.as_of AND s.t = m.t0 AND {_INSIDE}) a
  JOIN (SELECT q.underlying, q.as_of, q.log_moneyness, q.tte, {_LINEAR} AS w1 FROM asked q JOIN mats m ON m.underlying = q.underlying AND m.as_of = q.as_of AND ((q.tte >= m.t0 AND (m.t1 IS NULL OR q.tte < m.t1)) OR (m.r = 1 AND q.tte < m.t0)) JOIN segs s ON s.underlying = q.underlying AND s.as_of = q.as_of AND s.t = coalesce(m.t1, m.t0) AND {_INSIDE}) b
  ON b.underlying = a.underlying AND b.as_of = a.as_of AND b.log_moneyness = a.log_moneyness AND b.tte = a.tte"""
_ASKED = "SELECT DISTINCT underlying, as_of, k.log_moneyness, t.tte FROM points CROSS JOIN (SELECT unnest([CAST(-0.5 AS DOUBLE), -0.07, 0.0, 0.03, 0.5]) AS log_moneyness) k CROSS JOIN (SELECT unnest([CAST(0.02 AS DOUBLE), 0.15, 0.4, 0.9, 2.0]) AS tte) t"


@query("o10_surface_at", "underlying:k log_moneyness:f tte:f total_variance:f implied_vol:f", "SELECT *, sqrt(greatest(0, total_variance) / tte) AS implied_vol FROM at_", asked=_ASKED, segs=_SEG, mats=_MATS, at_=_AT)
def o10(spark, d):
    p = true_points(spark, d)
    ks, ts = F.explode(F.array(*map(F.lit, (-0.5, -0.07, 0.0, 0.03, 0.5)))), F.explode(F.array(*map(F.lit, (0.02, 0.15, 0.4, 0.9, 2.0))))
    asked = p.select("underlying", "as_of").distinct().withColumn("log_moneyness", ks).withColumn("tte", ts)
    return options.surface_at(asked, p)


@query("o11_atm_term_structure", "underlying:k tte:f atm_vol:f", "SELECT underlying, tte, sqrt(greatest(0, total_variance) / tte) AS atm_vol FROM at_", asked="SELECT DISTINCT underlying, as_of, CAST(0 AS DOUBLE) AS log_moneyness, tte FROM points", segs=_SEG, mats=_MATS, at_=_AT)
def o11(spark, d):
    return options.atm_term_structure(true_points(spark, d))


_W = "(PARTITION BY underlying, as_of, expiry ORDER BY strike)"
_TRIPLES = f"SELECT *, lag(call_price) OVER {_W} AS c0, lag(strike) OVER {_W} AS k0, lead(call_price) OVER {_W} AS c2, lead(strike) OVER {_W} AS k2, greatest(lag(spread) OVER {_W}, spread, lead(spread) OVER {_W}) AS loc FROM points"
_FLY = """SELECT underlying, as_of, expiry, 'monotonicity' AS kind, strike, call_price - c0 AS severity, CAST(NULL AS BOOLEAN) AS within_spread FROM triples WHERE call_price - c0 > 1e-6
UNION ALL SELECT underlying, as_of, expiry, 'butterfly', strike, -cost, -cost < loc FROM (SELECT *, (k2 - strike) / (k2 - k0) * c0 + (strike - k0) / (k2 - k0) * c2 - call_price AS cost FROM triples WHERE k0 IS NOT NULL AND k2 > k0) WHERE cost < -1e-6"""


@query("o12_monotonicity", "underlying:k expiry:k strike:f severity:f", "SELECT * FROM fly WHERE kind = 'monotonicity'", digits=4, triples=_TRIPLES, fly=_FLY)
def o12(spark, d):
    return options.butterfly_violations(true_points(spark, d)).where("kind = 'monotonicity'")


@query("o13_butterfly", "underlying:k expiry:k kind:k strike:f severity:f within_spread:k", "SELECT * FROM fly", digits=4, triples=_TRIPLES, fly=_FLY)
def o13(spark, d):
    return options.butterfly_violations(true_points(spark, d))


_RANKED = "SELECT *, dense_rank() OVER (PARTITION BY underlying, as_of ORDER BY expiry) AS k, min(log_moneyness) OVER (PARTITION BY underlying, as_of, expiry) AS lo, max(log_moneyness) OVER (PARTITION BY underlying, as_of, expiry) AS hi FROM points"
_NEAR = "SELECT underlying, as_of, k, lo, hi, log_moneyness AS x0, total_variance AS y0, lead(log_moneyness) OVER w AS x1, lead(total_variance) OVER w AS y1, row_number() OVER w AS r FROM ranks WINDOW w AS (PARTITION BY underlying, as_of, expiry ORDER BY log_moneyness)"
_CAL = f"""SELECT * FROM (SELECT f.underlying, f.as_of, f.expiry, 'calendar' AS kind, f.log_moneyness, {_LINEAR} - f.total_variance AS severity FROM ranks f JOIN near s ON s.underlying = f.underlying AND s.as_of = f.as_of AND s.k = f.k - 1
  AND least(f.hi, s.hi) > greatest(f.lo, s.lo) AND f.log_moneyness BETWEEN greatest(f.lo, s.lo) AND least(f.hi, s.hi) AND {_INSIDE}) WHERE severity > 1e-6"""


@query("o14_calendar", "underlying:k expiry:k log_moneyness:f severity:f", "SELECT * FROM calv", ranks=_RANKED, near=_NEAR, calv=_CAL)
def o14(spark, d):
    return options.calendar_violations(true_points(spark, d))


@query(
    "o15_report", "underlying:k kind:k n:i worst:f n_outside_spread:i checks:i",
    """SELECT v.underlying, v.kind, count(*) AS n, max(severity) AS worst, sum(CASE WHEN coalesce(within_spread, false) THEN 0 ELSE 1 END) AS n_outside_spread, any_value(c.checks) AS checks
FROM (SELECT underlying, as_of, kind, severity, within_spread FROM fly UNION ALL SELECT underlying, as_of, kind, severity, NULL FROM calv) v
JOIN (SELECT underlying, as_of, sum(greatest(n - 2, 0) + greatest(n - 1, 0)) AS checks FROM (SELECT underlying, as_of, expiry, count(*) AS n FROM points GROUP BY 1, 2, 3) GROUP BY 1, 2) c ON c.underlying = v.underlying AND c.as_of = v.as_of GROUP BY 1, 2""",
    digits=4, triples=_TRIPLES, fly=_FLY, ranks=_RANKED, near=_NEAR, calv=_CAL,
)
def o15(spark, d):
    return options.arbitrage_report(true_points(spark, d))


#: Literal slice shapes, shifted by the part, of which some admit butterflies.
_SVI = "SELECT underlying, 0.02 + 0.001 * (underlying % 7) AS a, 0.1 + 0.2 * (underlying % 9) AS b, -0.6 + 0.1 * (underlying % 5) AS rho, 0.01 * (underlying % 3) AS m, 0.05 + 0.05 * (underlying % 4) AS sigma FROM (SELECT p_partkey AS underlying FROM part)"


def svi_slices(spark, d) -> DataFrame:
    u = F.col("p_partkey")
    return views.table(spark, d, "part").select(u.alias("underlying"), (0.02 + 0.001 * (u % 7)).alias("a"), (0.1 + 0.2 * (u % 9)).alias("b"), (-0.6 + 0.1 * (u % 5)).alias("rho"), (0.01 * (u % 3)).alias("m"), (0.05 + 0.05 * (u % 4)).alias("sigma"))


@query(
    "o18_svi_report", "underlying:k min_g:f min_w:f butterfly_free:k",
    """SELECT underlying, min(g) AS min_g, min(w) AS min_w, min(w) > 0 AND min(g) >= -1e-8 AS butterfly_free FROM (
  SELECT underlying, w, pow(1 - k * w1 / nullif(2 * w, 0), 2) - w1 * w1 / 4 * (1 / nullif(w, 0) + 0.25) + w2 / 2 AS g FROM (
    SELECT underlying, k, a + b * (rho * (k - m) + root) AS w, b * (rho + (k - m) / root) AS w1, b * sigma * sigma / (root * root * root) AS w2 FROM (
      SELECT s.*, x.k, sqrt((x.k - m) * (x.k - m) + sigma * sigma) AS root FROM svi s CROSS JOIN (SELECT -2.0 + i * 0.01 AS k FROM (SELECT unnest(range(0, 401)) AS i)) x))) GROUP BY 1""",
    svi=_SVI,
)
def o18(spark, d):
    return options.svi_report(svi_slices(spark, d), "underlying")


_VENDOR = "SELECT *, true_vol AS implied_vol, true_vol * (1 + 0.01 * (underlying % 5)) AS vendor_iv FROM otm"


def vendor_rows(spark, d) -> DataFrame:
    at = options.with_forward(options.clean(views.quotes(spark, d)), RATE)
    return at.withColumn("implied_vol", F.col("true_vol")).withColumn("vendor_iv", F.col("true_vol") * (1 + 0.01 * (F.col("underlying") % 5)))


@query(
    "o22_vendor_gaps", "moneyness:k d0_30:f d30_90:f d90_365:f d365:f",
    """SELECT moneyness, quantile_cont(CASE WHEN dte < 30 THEN gap END, 0.5) AS d0_30, quantile_cont(CASE WHEN dte >= 30 AND dte < 90 THEN gap END, 0.5) AS d30_90, quantile_cont(CASE WHEN dte >= 90 AND dte < 365 THEN gap END, 0.5) AS d90_365, quantile_cont(CASE WHEN dte >= 365 THEN gap END, 0.5) AS d365
FROM (SELECT CASE WHEN log_moneyness < -0.1 THEN 'put wing' WHEN log_moneyness < 0.1 THEN 'near the money' ELSE 'call wing' END AS moneyness, tte * 365 AS dte, abs(implied_vol - vendor_iv) * 100 AS gap FROM vendor) GROUP BY 1""",
    vendor=_VENDOR,
)
def o22(spark, d):
    return options.vendor_gaps(vendor_rows(spark, d))


_CURVE = "SELECT underlying, as_of, expiry, tte, strike, option_type, implied_vol FROM (SELECT *, row_number() OVER (PARTITION BY underlying, as_of, expiry ORDER BY abs(log_moneyness), strike, option_type) AS r FROM vendor) WHERE r = 1"


@query("o23_atm_curve", "underlying:k expiry:k strike:f option_type:k implied_vol:f", "SELECT * FROM curve", vendor=_VENDOR, curve=_CURVE)
def o23(spark, d):
    return options.atm_curve(vendor_rows(spark, d))


@query("o23_atm_30_days", "underlying:k atm_vol:f", "SELECT underlying, CASE WHEN x0 >= 30 OR x1 IS NULL THEN y0 ELSE y0 + (30 - x0) / (x1 - x0) * (y1 - y0) END AS atm_vol FROM (SELECT underlying, tte * 365 AS x0, implied_vol AS y0, lead(tte * 365) OVER w AS x1, lead(implied_vol) OVER w AS y1, row_number() OVER w AS r FROM curve WINDOW w AS (PARTITION BY underlying, as_of ORDER BY tte)) WHERE (x0 <= 30 AND (x1 IS NULL OR 30 < x1)) OR (r = 1 AND x0 > 30)", vendor=_VENDOR, curve=_CURVE)
def o23b(spark, d):
    return options.atm_at(options.atm_curve(vendor_rows(spark, d)), 30.0)


@query("o24_pick_contracts", "id:k underlying:k expiry:k strike:f option_type:k", f"""SELECT id, underlying, expiry, strike, option_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(abs(vendor_delta) - 0.3), strike) AS r FROM (SELECT *, underlying || '|' || option_type AS id, dense_rank() OVER (PARTITION BY underlying, option_type ORDER BY abs(tte * 365 - 120), expiry) AS e FROM deltas) WHERE e = 1) WHERE r = 1""", digits=4, dd=_D, deltas=f"SELECT *, CASE WHEN {_C} THEN {norm_cdf_sql('d1')} ELSE -{norm_cdf_sql('(-d1)')} END AS vendor_delta FROM dd")
def o24(spark, d):
    q = greeks(spark, d).withColumnRenamed("delta", "vendor_delta")
    targets = q.select("underlying", "as_of", "option_type").distinct().select(F.concat_ws("|", "underlying", "option_type").alias("id"), "*", F.lit(120.0).alias("days"), F.lit(0.3).alias("delta"))
    return options.pick_contracts(targets, q)


# --- ledgers: orders of customers on contracts of one underlying, quoted every week ----------

_DAYS = "SELECT date, 100 * (1 + 0.02 * sin(date_diff('day', CAST('1992-01-01' AS DATE), date) / 40.0)) AS spot FROM (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS date FROM orders)"
_MARKS = "SELECT date, e.expiry, k.strike, o.option_type, spot, greatest(0, CASE WHEN o.option_type = 'call' THEN spot - k.strike ELSE k.strike - spot END) + 1 AS mid FROM days_ CROSS JOIN (SELECT CAST(unnest(['1994-06-30', '1996-06-30']) AS DATE) AS expiry) e CROSS JOIN (SELECT CAST(unnest([95, 100, 105]) AS DOUBLE) AS strike) k CROSS JOIN (SELECT unnest(['call', 'put']) AS option_type) o WHERE date <= e.expiry"
_TOUCH = "SELECT *, mid - 0.1 AS bid, CASE WHEN strike = 105 AND extract('month' FROM date) = 3 THEN mid - 0.2 ELSE mid + 0.1 END AS ask FROM marks"
_ORDERS = "SELECT o_custkey % 20 AS account, o_orderkey AS id, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, CAST(CASE WHEN o_orderkey % 2 = 0 THEN '1994-06-30' ELSE '1996-06-30' END AS DATE) AS expiry, CAST(95 + 5 * (o_orderkey % 3) AS DOUBLE) AS strike, CASE WHEN o_custkey % 2 = 0 THEN 'call' ELSE 'put' END AS option_type, CAST(o_orderkey % 7 - 3 AS DOUBLE) AS qty FROM orders"
_FILLS = """SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN qty > 0 THEN ask ELSE bid END END AS price FROM (
  SELECT o.*, n.fill_date, t.bid, t.ask, CASE WHEN qty = 0 THEN 'zero quantity' WHEN n.fill_date IS NULL THEN 'no later date' WHEN t.bid IS NULL OR t.ask IS NULL THEN 'missing market' WHEN t.ask < t.bid THEN 'crossed market' END AS reason
  FROM asks o LEFT JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS fill_date FROM (SELECT DISTINCT date FROM touch)) n ON n.date = o.date LEFT JOIN touch t ON t.date = n.fill_date AND t.expiry = o.expiry AND t.strike = o.strike AND t.option_type = o.option_type)"""
_LEDGER_CTE = {"days_": _DAYS, "marks": _MARKS, "touch": _TOUCH, "asks": _ORDERS, "fills": _FILLS}


def days(spark, d) -> DataFrame:
    at = views.table(spark, d, "orders").select(F.date_trunc("week", "o_orderdate").cast("date").alias("date")).distinct()
    return at.withColumn("spot", 100 * (1 + 0.02 * F.sin(F.datediff("date", F.lit("1992-01-01").cast("date")) / 40.0)))


def marks(spark, d) -> DataFrame:
    ex = F.explode(F.array(*(F.lit(x).cast("date") for x in ("1994-06-30", "1996-06-30"))))
    at = days(spark, d).withColumn("expiry", ex).withColumn("strike", F.explode(F.array(*(F.lit(x) for x in (95.0, 100.0, 105.0))))).withColumn("option_type", F.explode(F.array(F.lit("call"), F.lit("put"))))
    at = at.where("date <= expiry")
    return at.withColumn("mid", F.greatest(F.lit(0.0), F.when(F.col("option_type") == "call", F.col("spot") - F.col("strike")).otherwise(F.col("strike") - F.col("spot"))) + 1)


def touch(spark, d) -> DataFrame:
    bad = (F.col("strike") == 105) & (F.month("date") == 3)
    return marks(spark, d).withColumn("bid", F.col("mid") - 0.1).withColumn("ask", F.when(bad, F.col("mid") - 0.2).otherwise(F.col("mid") + 0.1))


def asks(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return views.table(spark, d, "orders").select(
        (F.col("o_custkey") % 20).alias("account"), k.alias("id"), F.date_trunc("week", "o_orderdate").cast("date").alias("date"), F.when(k % 2 == 0, "1994-06-30").otherwise("1996-06-30").cast("date").alias("expiry"),
        (95 + 5 * (k % 3)).cast("double").alias("strike"), F.when(F.col("o_custkey") % 2 == 0, "call").otherwise("put").alias("option_type"), (k % 7 - 3).cast("double").alias("qty"),
    )


def filled(spark, d) -> DataFrame:
    return options.fills(asks(spark, d), touch(spark, d))


@query("o25_fills", "account:k id:k fill_date:k price:f cash_delta:f spread_cost:f reason:k", "SELECT *, -price * qty * 100 AS cash_delta, abs(price - (bid + ask) / 2) * abs(qty) * 100 AS spread_cost FROM fills", digits=4, **_LEDGER_CTE)
def o25(spark, d):
    return filled(spark, d)


_BOOKED = "SELECT account, expiry, strike, option_type, sum(qty) AS qty FROM fills WHERE price IS NOT NULL GROUP BY 1, 2, 3, 4"
_SETTLED = """SELECT p.*, CASE WHEN v <= 0 THEN 'worthless' WHEN qty < 0 THEN 'assigned' ELSE 'exercised' END AS outcome, CASE WHEN v > 0 THEN -sh * strike ELSE 0 END AS cash_delta, CASE WHEN v > 0 THEN sh ELSE 0 END AS share_delta FROM (
  SELECT b.*, x.settle_date, x.spot, greatest(0, CASE WHEN option_type = 'call' THEN x.spot - strike ELSE strike - x.spot END) AS v, CASE WHEN option_type = 'call' THEN qty ELSE -qty END * 100 AS sh FROM booked b JOIN (SELECT e.expiry, min(date) AS settle_date, min_by(spot, date) AS spot FROM (SELECT DISTINCT expiry FROM booked) e JOIN days_ ON date >= e.expiry GROUP BY 1) x ON x.expiry = b.expiry WHERE abs(qty) > 1e-12) p"""


def booked(spark, d) -> DataFrame:
    return filled(spark, d).where("price IS NOT NULL").groupBy("account", *options.CONTRACT).agg(F.sum("qty").alias("qty"))


@query("o28_settlement", "account:k expiry:k strike:f option_type:k qty:f settle_date:k outcome:k cash_delta:f share_delta:f", "SELECT * FROM settled", digits=4, booked=_BOOKED, settled=_SETTLED, **_LEDGER_CTE)
def o28(spark, d):
    return options.settlements(booked(spark, d), days(spark, d))


_BOOK = "SELECT account, fill_date AS date, expiry, strike, option_type, -price * qty * 100 AS cash_delta, 0.0 AS share_delta, qty AS qty_delta FROM fills WHERE price IS NOT NULL UNION ALL SELECT account, settle_date, expiry, strike, option_type, cash_delta, share_delta, -qty FROM settled"
_EQUITY = """SELECT s.account, s.date, s.cash, s.shares, coalesce(v.v, 0) AS options, coalesce(v.missing, 0) AS missing, CASE WHEN coalesce(v.missing, 0) = 0 THEN s.cash + s.shares * s.spot + coalesce(v.v, 0) END AS equity FROM (
  SELECT g.account, g.date, g.spot, coalesce(sum(m.c) OVER w, 0) AS cash, coalesce(sum(m.s) OVER w, 0) AS shares FROM (SELECT a.account, d.date, d.spot FROM (SELECT DISTINCT account FROM book) a CROSS JOIN days_ d) g LEFT JOIN (SELECT account, date, sum(cash_delta) AS c, sum(share_delta) AS s FROM book GROUP BY 1, 2) m ON m.account = g.account AND m.date = g.date WINDOW w AS (PARTITION BY g.account ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) s
LEFT JOIN (SELECT h.account, h.date, sum(k.mid * h.qty * 100) AS v, sum(CASE WHEN k.mid IS NULL THEN 1 ELSE 0 END) AS missing FROM (
  SELECT c.account, c.expiry, c.strike, c.option_type, d.date, sum(b.q) OVER (PARTITION BY c.account, c.expiry, c.strike, c.option_type ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS qty FROM (SELECT DISTINCT account, expiry, strike, option_type FROM book) c CROSS JOIN days_ d LEFT JOIN (SELECT account, expiry, strike, option_type, date, sum(qty_delta) AS q FROM book GROUP BY 1, 2, 3, 4, 5) b ON b.account = c.account AND b.expiry = c.expiry AND b.strike = c.strike AND b.option_type = c.option_type AND b.date = d.date) h
  LEFT JOIN marks k ON k.date = h.date AND k.expiry = h.expiry AND k.strike = h.strike AND k.option_type = h.option_type WHERE abs(h.qty) > 1e-12 GROUP BY 1, 2) v ON v.account = s.account AND v.date = s.date"""


@query("o26_equity", "account:k date:k cash:f shares:f options:f equity:f missing:i", "SELECT * FROM eq", digits=4, booked=_BOOKED, settled=_SETTLED, book=_BOOK, eq=_EQUITY, **_LEDGER_CTE)
def o26(spark, d):
    f = filled(spark, d).where("price IS NOT NULL").select("account", F.col("fill_date").alias("date"), *options.CONTRACT, "cash_delta", F.lit(0.0).alias("share_delta"), F.col("qty").alias("qty_delta"))
    s = options.settlements(booked(spark, d), days(spark, d)).select("account", F.col("settle_date").alias("date"), *options.CONTRACT, "cash_delta", "share_delta", (-F.col("qty")).alias("qty_delta"))
    return options.equity(f.unionByName(s), marks(spark, d), days(spark, d))


@query(
    "o27_position_greeks", "account:k date:k delta:f gamma:f vega:f",
    f"""SELECT account, CAST('1994-01-03' AS DATE) AS date, sum({norm_cdf_sql('d1')} * qty * 100 - CASE WHEN {_C} THEN 0 ELSE qty * 100 END) AS delta, sum({norm_pdf_sql('d1')} / (100.0 * 0.2 * sqrt(tte)) * qty * 100) AS gamma, sum(100.0 * {norm_pdf_sql('d1')} * sqrt(tte) * qty * 100) AS vega
FROM (SELECT *, (ln(100.0 / strike) + ({RATE} + 0.02) * tte) / (0.2 * sqrt(tte)) AS d1 FROM (SELECT *, date_diff('day', CAST('1994-01-03' AS DATE), expiry) / 365.0 AS tte FROM booked WHERE abs(qty) > 1e-12)) GROUP BY 1""",
    digits=3, booked=_BOOKED, **_LEDGER_CTE,
)
def o27(spark, d):
    at = booked(spark, d).withColumn("date", F.lit("1994-01-03").cast("date")).withColumn("spot", F.lit(100.0)).withColumn("vol", F.lit(0.2))
    at = at.withColumn("tte", F.datediff("expiry", "date") / 365.0)
    return options.position_greeks(at, at.select("account", "date").distinct().withColumn("shares", F.lit(0.0)), RATE)
