"""Fits and solves whose answer has a closed form: of two names, of planted smiles, of given scores and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.mathx import norm_cdf_sql
from panelforge.operators import account, allocation, cv, options, panel, performance, signals, smiles, solvers
from panelforge.plans import views
from panelforge.plans.market import _CORR, _FACTORS, _FEATURES, _FOLDS, _LABELLED, _PROBA, IN, OUT, factors, feature_rows, fold_table, named, query
from panelforge.plans.quotes import _SVI, svi_slices
from panelforge.plans.sql import rounded, with_
from panelforge.plans.views import PERIODS, RATE

QUERIES: dict = {}
SQL: dict[str, str] = {}


def closed(name: str, columns: str, source: str, digits: int = 6, **own: str):
    return query(name, columns, source, digits, into=(QUERIES, SQL), **own)


# --- two names -------------------------------------------------------------------------------

_TWO = "SELECT c.i AS a, c.j AS b, c.cov, x.cov AS va, y.cov AS vb, p.mu AS ma, q.mu AS mb FROM corrs c JOIN corrs x ON x.i = c.i AND x.j = c.i JOIN corrs y ON y.i = c.j AND y.j = c.j JOIN means p ON p.name = c.i JOIN means q ON q.name = c.j WHERE c.i < c.j"
_MEANS = "SELECT ticker AS name, avg(r) AS mu FROM rets GROUP BY 1"


def two_names(spark, d) -> DataFrame:
    """a, b and the rows (i, j, cov, corr, mu) of each pair of names: a group a pair."""
    names = named(spark, d)
    c = allocation.correlations(names)
    own = c.where("i = j").select("i", "cov").join(names.groupBy(F.col("name").alias("i")).agg(F.avg("r").alias("mu")), "i")
    at = c.where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"), "cov", "corr")
    at = at.join(own.select(F.col("i").alias("a"), F.col("cov").alias("va"), F.col("mu").alias("ma")), "a").join(own.select(F.col("i").alias("b"), F.col("cov").alias("vb"), F.col("mu").alias("mb")), "b")
    cell = lambda i, j, cov, corr, mu: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(cov).alias("cov"), corr.alias("corr"), F.col(mu).alias("mu"))
    one, r = F.lit(1.0), F.col("corr")
    return at.select("a", "b", F.explode(F.array(cell("a", "a", "va", one, "ma"), cell("a", "b", "cov", r, "ma"), cell("b", "a", "cov", r, "mb"), cell("b", "b", "vb", one, "mb"))).alias("x")).select("a", "b", "x.*")


_LIMIT = "greatest(-0.1, least(0.1, 0.5 * {}))"


@closed("r10_kelly_pairs", "a:k b:k name:k w:f", f"SELECT a, b, a AS name, {_LIMIT.format('(vb * ma - cov * mb) / (va * vb - cov * cov)')} AS w FROM two UNION ALL SELECT a, b, b, {_LIMIT.format('(va * mb - cov * ma) / (va * vb - cov * cov)')} FROM two", corrs=_CORR, means=_MEANS, two=_TWO)
def r10(spark, d):
    return solvers.kelly(two_names(spark, d), 0.5, 0.1, "a", "b")


@closed("a7_hrp_pairs", "a:k b:k name:k w:f", "SELECT a, b, a AS name, vb / (va + vb) AS w FROM two UNION ALL SELECT a, b, b, va / (va + vb) FROM two", corrs=_CORR, means=_MEANS, two=_TWO)
def a7(spark, d):
    return solvers.hrp_weights(two_names(spark, d), "a", "b")


# --- rolling allocations, held between refits --------------------------------------------------

_REFITS = "SELECT pos AS refit, date AS fit_date FROM cal WHERE pos >= 104 AND (pos - 104) % 26 = 0"
_IN_WINDOW = "SELECT f.refit, r.ticker AS name, count(r.r) AS n, count(*) AS k, var_samp(r.r) AS v FROM refits f JOIN cal c ON c.pos BETWEEN f.refit - 104 AND f.refit - 1 JOIN rets r ON r.date = c.date GROUP BY 1, 2"
_HELD = "SELECT c.date, s.name, s.w FROM cal c JOIN ({}) s ON s.refit = 104 + CAST(floor((c.pos - 104) / 26.0) AS BIGINT) * 26 WHERE c.pos >= 104"
_ROLLED = {"refits": _REFITS, "seen": _IN_WINDOW}


def rolled(spark, d, rule: str) -> DataFrame:
    return solvers.rolling_allocation(named(spark, d), panel.calendar(views.market(spark, d)), rule, 104, 26)


@closed("a8_rolling_inverse_variance", "date:k name:k w:f", _HELD.format("SELECT refit, name, (1 / v) / sum(1 / v) OVER (PARTITION BY refit) AS w FROM seen WHERE n >= k - 1"), **_ROLLED)
def a8a(spark, d):
    return rolled(spark, d, "inverse_variance")


@closed("a8_rolling_equal", "date:k name:k w:f", _HELD.format("SELECT refit, name, 1.0 / count(*) OVER (PARTITION BY refit) AS w FROM seen WHERE n >= k - 1"), **_ROLLED)
def a8b(spark, d):
    return rolled(spark, d, "equal")


# --- weights per fold --------------------------------------------------------------------------

_PER_FOLD = f"""SELECT f.fold, c.date, sum(i.w * r.r) AS ret FROM folds f JOIN (
  SELECT f.fold, r.ticker, (1 / var_samp(r.r)) / sum(1 / var_samp(r.r)) OVER (PARTITION BY f.fold) AS w FROM folds f JOIN rets r ON r.date <= f.fit_end GROUP BY 1, 2) i ON i.fold = f.fold
  JOIN rets r ON r.ticker = i.ticker JOIN cal c ON c.date = r.date AND c.date BETWEEN f.oos_start AND f.oos_end AND f.fold >= 0 AND {IN} > {OUT} GROUP BY 1, 2"""


@closed("b14_weights_per_fold", "book:k fold:i date:k ret:f", "SELECT 'inverse' AS book, fold, date, coalesce(ret, 0) AS ret FROM per_fold", folds=_FOLDS, per_fold=_PER_FOLD)
def b14(spark, d):
    """A callback that learns from what a fold knows at its end: inverse-variance weights, held."""
    m = views.market(spark, d)

    def make(rows: DataFrame, fit_end) -> DataFrame:
        own = allocation.inverse_variance(rows.where(F.col("date") <= F.lit(fit_end)).select(F.col("ticker").alias("name"), "r"))
        return rows.select("date", "ticker").join(own.withColumnRenamed("name", "ticker"), "ticker").select("date", "ticker", "w")

    return account.walk_forward_with(make, "inverse", m, fold_table(spark, d))


# --- scores ------------------------------------------------------------------------------------

_RANKED = "SELECT year(date) AS year, y, p, rank() OVER (PARTITION BY year(date) ORDER BY p) + (count(*) OVER (PARTITION BY year(date), p) - 1) / 2.0 AS k FROM scores"
_SCORES = "SELECT l.date, l.y, round(p.p, 9) AS p FROM labelled l JOIN proba p ON p.date = l.date AND p.ticker = l.ticker WHERE l.y IS NOT NULL AND p.p IS NOT NULL"


@closed("g25_auc_of_scores", "year:i auc:f accuracy:f", "SELECT year, (sum(k * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM ranked_scores GROUP BY 1", feats=_FEATURES, labelled=_LABELLED, proba=_PROBA, scores=_SCORES, ranked_scores=_RANKED)
def g25(spark, d):
    at = signals.labelled(feature_rows(spark, d)).withColumn("p", F.round(1 / (1 + F.exp(-F.col("zscore_21"))), 9)).where("y IS NOT NULL AND p IS NOT NULL")
    return cv.auc(at.withColumn("year", F.year("date")), "year")


# --- regression and tails ----------------------------------------------------------------------

_SUMS = "SELECT d.book, count(*) AS n, avg(ret) AS my, avg(mkt) AS m1, avg(smb) AS m2, avg(hml) AS m3, covar_pop(mkt, mkt) AS a, covar_pop(mkt, smb) AS b, covar_pop(mkt, hml) AS c, covar_pop(smb, smb) AS e, covar_pop(smb, hml) AS f, covar_pop(hml, hml) AS h, covar_pop(ret, mkt) AS y1, covar_pop(ret, smb) AS y2, covar_pop(ret, hml) AS y3, var_pop(ret) AS yy FROM daily d JOIN factors x ON x.date = d.date WHERE mkt IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL AND ret IS NOT NULL GROUP BY 1"
_CRAMER = """SELECT *, (y1 * (e * h - f * f) - b * (y2 * h - f * y3) + c * (y2 * f - e * y3)) / det AS b1, (a * (y2 * h - f * y3) - y1 * (b * h - f * c) + c * (b * y3 - y2 * c)) / det AS b2, (a * (e * y3 - y2 * f) - b * (b * y3 - y2 * c) + y1 * (b * f - e * c)) / det AS b3
FROM (SELECT *, a * (e * h - f * f) - b * (b * h - f * c) + c * (b * f - e * c) AS det FROM sums)"""


@closed("p20_factor_betas", "book:k alpha_annual:f beta_mkt:f beta_smb:f beta_hml:f r_squared:f n:i", f"SELECT book, (my - b1 * m1 - b2 * m2 - b3 * m3) * {PERIODS} AS alpha_annual, b1 AS beta_mkt, b2 AS beta_smb, b3 AS beta_hml, (b1 * y1 + b2 * y2 + b3 * y3) / yy AS r_squared, n FROM solved", factors=_FACTORS, sums=_SUMS, solved=_CRAMER)
def p20(spark, d):
    return performance.factor_decomposition(views.daily(spark, d), factors(spark, d), 0.0, 5, 30, PERIODS)


# Rows of (X'X)^-1 X' by residuals of each factor on the other two; the constant's row follows from the means. Five lags, weights 1 - h / 6.
_SLOPES = """SELECT *, (b * h - c * f) / (e * h - f * f) AS p1, (c * e - b * f) / (e * h - f * f) AS p2, (b * h - f * c) / (a * h - c * c) AS q1, (f * a - b * c) / (a * h - c * c) AS q2, (c * e - f * b) / (a * e - b * b) AS r1, (f * a - c * b) / (a * e - b * b) AS r2 FROM solved"""
_ROWS_OF = """SELECT *, 1.0 / n - m1 * z1 - m2 * z2 - m3 * z3 AS z0 FROM (
  SELECT d.book, d.date, s.n, s.m1, s.m2, s.m3, d.ret - s.my - s.b1 * (x.mkt - s.m1) - s.b2 * (x.smb - s.m2) - s.b3 * (x.hml - s.m3) AS e,
    ((x.mkt - s.m1) - s.p1 * (x.smb - s.m2) - s.p2 * (x.hml - s.m3)) / (s.n * (s.a - s.p1 * s.b - s.p2 * s.c)) AS z1,
    ((x.smb - s.m2) - s.q1 * (x.mkt - s.m1) - s.q2 * (x.hml - s.m3)) / (s.n * (s.e - s.q1 * s.b - s.q2 * s.f)) AS z2,
    ((x.hml - s.m3) - s.r1 * (x.mkt - s.m1) - s.r2 * (x.smb - s.m2)) / (s.n * (s.h - s.r1 * s.c - s.r2 * s.f)) AS z3
  FROM daily d JOIN factors x ON x.date = d.date JOIN slopes s ON s.book = d.book WHERE x.mkt IS NOT NULL AND x.smb IS NOT NULL AND x.hml IS NOT NULL AND d.ret IS NOT NULL)"""
_LONG = " UNION ALL ".join(f"SELECT book, date, {k} AS k, e * z{k} AS u FROM rows_of" for k in range(4))
_HAC = "SELECT book, k, sqrt(greatest(0, sum(u * u) + 2 * (" + " + ".join(f"{1 - h / 6!r} * coalesce(sum(u * u{h}), 0)" for h in range(1, 6)) + "))) AS se FROM (SELECT *, " + ", ".join(f"lag(u, {h}) OVER (PARTITION BY book, k ORDER BY date) AS u{h}" for h in range(1, 6)) + " FROM long_rows) GROUP BY 1, 2"
_SE = "SELECT book, " + ", ".join(f"max(CASE WHEN k = {k} THEN se END) AS se{k}" for k in range(4)) + " FROM hac GROUP BY 1"
_DECOMPOSED = f"""SELECT *, 2 * (1 - {norm_cdf_sql('abs(alpha_t)')}) AS alpha_p FROM (
  SELECT s.book, (my - b1 * m1 - b2 * m2 - b3 * m3) * {PERIODS} AS alpha_annual, (my - b1 * m1 - b2 * m2 - b3 * m3) / se0 AS alpha_t, b1 AS beta_mkt, b2 AS beta_smb, b3 AS beta_hml, b1 / se1 AS t_mkt, b2 / se2 AS t_smb, b3 / se3 AS t_hml, (b1 * y1 + b2 * y2 + b3 * y3) / yy AS r_squared, n
  FROM solved s JOIN errors z ON z.book = s.book)"""
_KINDS = {c: "k" if c == "book" else "i" if c == "n" else "f" for c in ("book", "alpha_annual", "alpha_t", "alpha_p", "beta_mkt", "beta_smb", "beta_hml", "t_mkt", "t_smb", "t_hml", "r_squared", "n")}
SQL["p20_factor_decomposition"] = with_(rounded(_KINDS, _DECOMPOSED), factors=_FACTORS, sums=_SUMS, solved=_CRAMER, slopes=_SLOPES, rows_of=_ROWS_OF, long_rows=_LONG, hac=_HAC, errors=_SE)


@closed("r16_exceedances", "book:k threshold:f n_exceedances:i", "SELECT u.book, any_value(u.u) AS threshold, sum(CASE WHEN -d.ret > u.u THEN 1 ELSE 0 END) AS n_exceedances FROM daily d JOIN (SELECT book, quantile_cont(-ret, 0.9) AS u FROM daily GROUP BY 1) u ON u.book = d.book GROUP BY 1")
def r16(spark, d):
    return solvers.evt_tails(views.daily(spark, d))


# --- planted smiles: a fit must give back what a part's key planted ----------------------------

_SSVI = "SELECT p_partkey AS underlying, 0.02 + 0.01 * (p_partkey % 6) AS theta, -0.5 + 0.1 * (p_partkey % 5) AS rho, 0.6 + 0.2 * (p_partkey % 5) AS psi FROM part"
_SURFACES = """SELECT underlying, rho, eta, gamma, tte, theta, eta * pow(theta, -gamma) AS psi FROM (SELECT p_partkey AS underlying, -0.5 + 0.1 * (p_partkey % 5) AS rho, 0.5 + 0.1 * (p_partkey % 4) AS eta, 0.3 + 0.05 * (p_partkey % 3) AS gamma, t.tte, (0.01 + 0.002 * (p_partkey % 7)) * t.f * CASE WHEN p_partkey % 11 = 0 AND t.tte = 1.0 THEN {0} ELSE 1 END AS theta
  FROM part CROSS JOIN (SELECT unnest([CAST(0.25 AS DOUBLE), 0.5, 1.0]) AS tte, unnest([1, 2, 3]) AS f) t)"""


def _smile(rows: DataFrame, w) -> DataFrame:
    """Points of planted slices on nine strikes."""
    k = F.explode(F.array(*(F.lit(x / 10) for x in range(-4, 5))))
    at = rows.withColumn("log_moneyness", k).withColumn("as_of", F.lit("1998-01-02").cast("date")).withColumn("spread", F.lit(0.01))
    at = at if "tte" in rows.columns else at.withColumn("tte", F.lit(1.0))
    return at.withColumn("expiry", F.date_add("as_of", (F.col("tte") * 364).cast("int"))).withColumn("total_variance", w(F.col("log_moneyness")))


def _ssvi(k):
    t, r, u = F.col("theta"), F.col("rho"), F.col("psi") * k
    return t / 2 * (1 + r * u + F.sqrt((u + r) * (u + r) + 1 - r * r))


def ssvi_rows(spark, d) -> DataFrame:
    u = F.col("p_partkey")
    return views.table(spark, d, "part").select(u.alias("underlying"), (0.02 + 0.01 * (u % 6)).alias("theta"), (-0.5 + 0.1 * (u % 5)).alias("rho"), (0.6 + 0.2 * (u % 5)).alias("psi"))


def surface_rows(spark, d, falls: float = 1.0) -> DataFrame:
    """Surfaces of three maturities; of every eleventh part the last theta is ``falls`` times what it would be."""
    u = F.col("p_partkey")
    at = views.table(spark, d, "part").select(u.alias("underlying"), (-0.5 + 0.1 * (u % 5)).alias("rho"), (0.5 + 0.1 * (u % 4)).alias("eta"), (0.3 + 0.05 * (u % 3)).alias("gamma"), (0.01 + 0.002 * (u % 7)).alias("base"))
    at = at.select("*", F.explode(F.array(*(F.struct(F.lit(t).alias("tte"), F.lit(f).alias("f")) for t, f in ((0.25, 1), (0.5, 2), (1.0, 3))))).alias("x")).select("*", "x.*")
    at = at.withColumn("theta", F.col("base") * F.col("f") * F.when((F.col("underlying") % 11 == 0) & (F.col("tte") == 1.0), falls).otherwise(1.0))
    return at.withColumn("psi", F.col("eta") * F.pow("theta", -F.col("gamma"))).withColumn("as_of", F.lit("1998-01-02").cast("date"))


@closed("o16_svi_recovered", "underlying:k a:f b:f rho:f m:f sigma:f", "SELECT * FROM svi", digits=4, svi=_SVI)
def o16(spark, d):
    root = lambda k: F.sqrt((k - F.col("m")) * (k - F.col("m")) + F.col("sigma") * F.col("sigma"))
    pts = _smile(svi_slices(spark, d), lambda k: F.col("a") + F.col("b") * (F.col("rho") * (k - F.col("m")) + root(k)))
    return smiles.svi_slices(pts.repartition("underlying"), kept=views.kept(spark, d, "svi-planted"))


@closed("o19_ssvi_recovered", "underlying:k theta:f rho:f psi:f", "SELECT * FROM planted", digits=4, planted=_SSVI)
def o19(spark, d):
    return smiles.ssvi_slices(_smile(ssvi_rows(spark, d), _ssvi).repartition("underlying"), kept=views.kept(spark, d, "ssvi-planted"))


@closed("o19_ssvi_as_svi", "underlying:k a:f b:f rho:f m:f sigma:f", "SELECT underlying, theta / 2 * (1 - rho * rho) AS a, theta * psi / 2 AS b, rho, -rho / psi AS m, sqrt(1 - rho * rho) / psi AS sigma FROM planted", planted=_SSVI)
def o19b(spark, d):
    return smiles.to_svi(ssvi_rows(spark, d))


@closed("o20_surface_recovered", "underlying:k tte:f rho:f eta:f gamma:f theta:f psi:f", "SELECT * FROM planted", digits=3, planted=_SURFACES.format("1.0"))
def o20(spark, d):
    return smiles.ssvi_surfaces(_smile(surface_rows(spark, d).drop("as_of"), _ssvi).repartition("underlying"), kept=views.kept(spark, d, "surface-planted"))


_RULES = """SELECT underlying, bool_and(theta * (1 + abs(rho)) * psi < 4 AND theta * (1 + abs(rho)) * psi * psi <= 4) AS butterfly_free, bool_and(coalesce(theta >= before - 1e-6, true) AND coalesce(slope >= -1e-6 AND slope <= (1 + sqrt(1 - rho * rho)) / nullif(rho * rho, 0) + 1e-6, slope >= -1e-6)) AS calendar_free
FROM (SELECT *, lag(theta) OVER (PARTITION BY underlying ORDER BY tte) AS before, eta * (1 - gamma) * pow(theta, -gamma) AS slope FROM planted) GROUP BY 1"""
_TOTAL = "theta{0} / 2 * (1 + rho * psi{0} * k + sqrt(pow(psi{0} * k + rho, 2) + 1 - rho * rho))"


@closed("o21_surface_rules", "underlying:k butterfly_free:k calendar_free:k", _RULES, planted=_SURFACES.format("0.5"))
def o21(spark, d):
    return smiles.surface_checks(surface_rows(spark, d, 0.5))


@closed("o21_pointwise_calendar", "underlying:k worst:f calendar_free:k", f"SELECT underlying, max(fall) AS worst, max(fall) <= 1e-9 AS calendar_free FROM (SELECT underlying, {_TOTAL.format('0')} - ({_TOTAL.format('')}) AS fall FROM (SELECT *, lag(theta) OVER (PARTITION BY underlying ORDER BY tte) AS theta0, lag(psi) OVER (PARTITION BY underlying ORDER BY tte) AS psi0 FROM planted) CROSS JOIN (SELECT -1.0 + i * 0.02 AS k FROM (SELECT unnest(range(0, 101)) AS i)) g) GROUP BY 1", planted=_SURFACES.format("0.5"))
def o21b(spark, d):
    return smiles.pointwise_calendar(surface_rows(spark, d, 0.5))


# --- bumped Greeks of the closed form ----------------------------------------------------------

_BUMPS = "SELECT unnest(['0', 's+', 's-', 'v+', 'v-', 't+', 't-', 'r+', 'r-']) AS bump, unnest([0, 1, -1, 0, 0, 0, 0, 0, 0]) AS ds, unnest([0, 0, 0, 1, -1, 0, 0, 0, 0]) AS dv, unnest([0, 0, 0, 0, 0, 1, -1, 0, 0]) AS dt, unnest([0, 0, 0, 0, 0, 0, 0, 1, -1]) AS dr"
_BUMPED = f"SELECT *, d1 - v * sqrt(t) AS d2 FROM (SELECT *, (ln(s / strike) + (r + v * v / 2) * t) / (v * sqrt(t)) AS d1 FROM (SELECT q.underlying, q.expiry, q.strike, q.option_type, q.spot, b.bump, q.spot * (1 + b.ds * 1e-3) AS s, q.true_vol + b.dv * 1e-4 AS v, q.tte + b.dt * 1e-5 AS t, {RATE} + b.dr * 1e-5 AS r FROM flagged q CROSS JOIN bumps b WHERE q.reason IS NULL))"
_REPRICED = f"SELECT underlying, expiry, strike, option_type, spot, bump, CASE WHEN option_type = 'call' THEN s * {norm_cdf_sql('d1')} - strike * exp(-r * t) * {norm_cdf_sql('d2')} ELSE strike * exp(-r * t) * (1 - {norm_cdf_sql('d2')}) - s * (1 - {norm_cdf_sql('d1')}) END AS price FROM bumped"
_FD = ("fd_delta", "fd_gamma", "fd_vega", "fd_theta", "fd_rho")
_P = lambda b: f"max(CASE WHEN bump = '{b}' THEN price END)"


@closed(
    "o5_bumped_greeks", "underlying:k expiry:k strike:f option_type:k fd_delta:f fd_gamma:f fd_vega:f fd_theta:f fd_rho:f",
    "SELECT underlying, expiry, strike, option_type, " + ", ".join(f"round({c}, 3) AS {c}" for c in _FD) + f" FROM (SELECT underlying, expiry, strike, option_type, ({_P('s+')} - {_P('s-')}) / (2e-3 * any_value(spot)) AS fd_delta, ({_P('s+')} - 2 * {_P('0')} + {_P('s-')}) / pow(1e-3 * any_value(spot), 2) AS fd_gamma, ({_P('v+')} - {_P('v-')}) / 2e-4 AS fd_vega, -({_P('t+')} - {_P('t-')}) / 2e-5 AS fd_theta, ({_P('r+')} - {_P('r-')}) / 2e-5 AS fd_rho FROM repriced GROUP BY 1, 2, 3, 4)",
    digits=4, bumps=_BUMPS, bumped=_BUMPED, repriced=_REPRICED,
)
def o5(spark, d):
    bumped = lambda terms: options.bumped_greeks(terms.withColumn("id", F.struct(*views.TERMS)), options.closed_form, rate=RATE, vol="true_vol").drop("id")
    at = views.once(spark, d, "bumped", options.clean(views.quotes(spark, d)), bumped)
    return at.withColumns({c: F.round(c, 3) for c in _FD})
