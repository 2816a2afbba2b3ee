"""Fits, trees and models over the same views, and alert tables: most of them without SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import allocation, boost, cointegration, ml, panel, performance, risk, signals, smiles, solvers
from panelforge.plans import market, views
from panelforge.plans.quotes import true_points
from panelforge.plans.sql import rounded, with_
from panelforge.streaming import alerts


def _pairs(spark, d) -> DataFrame:
    pairs = spark.createDataFrame(list(market.PAIRS), "a string, b string")
    return signals.pair_table(views.market(spark, d), pairs)


def g5_pair_scan(spark: SparkSession, d: str) -> DataFrame:
    return solvers.cointegration(_pairs(spark, d), "a", "b", least=104)


def g6_best_pair(spark: SparkSession, d: str) -> DataFrame:
    """The pair of the least p, if it survives false-discovery control over the scan at 0.10."""
    return cointegration.best_pairs(g5_pair_scan(spark, d), 0.10)


def g8_rolling_cointegration(spark: SparkSession, d: str) -> DataFrame:
    return solvers.rolling_cointegration(_pairs(spark, d), 104, 26)


def g8_fixed_lag(spark: SparkSession, d: str) -> DataFrame:
    """The statistic of each window with one lag, which SQL can follow."""
    return views.rounded(cointegration.rolling(_pairs(spark, d), 104, 26, lags=1).select("a", "b", "date", "n", "tau"))


def g11_causal_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each fold's best pair by what was known at its end, and its weights after."""
    folds = market.fold_table(spark, d).select("fold", "fit_end", "oos_start", "oos_end")
    table = _pairs(spark, d)
    best = cointegration.best_pairs(cointegration.by_fold(table, folds, 104), 0.10, "fold")
    rolled = solvers.rolling_cointegration(table, 104, 26)
    spreads = signals.pair_spread(table, 52, 13).join(rolled, ["a", "b", "date"], "left").withColumn("p", panel.filled(F.col("p"), "a", "b"))
    w = signals.pair_weights(signals.pair_positions(spreads, 1.0, 0.0, 0.10))
    return w.join(best.drop("p", "q"), ["a", "b"]).join(folds, "fold").where(F.col("date").between(F.col("oos_start"), F.col("oos_end"))).select("fold", "date", "ticker", "w")


def _training(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    feats = market.feature_rows(spark, d)
    folds = market.fold_ends(spark)
    return feats, folds, signals.training_rows(feats, folds, 504)


def g14_model_books(spark: SparkSession, d: str) -> DataFrame:
    feats, folds, rows = _training(spark, d)
    return ml.fold_books(signals.uniqueness_weights(rows, "fold"), feats, folds, weight="u")


def g15_calibrated_books(spark: SparkSession, d: str) -> DataFrame:
    feats, folds, rows = _training(spark, d)
    return ml.fold_books(rows, feats, folds, calibrate="isotonic")


def _with_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", F.xxhash64("fold", "ticker", "date"))


def g22_meta_model(spark: SparkSession, d: str) -> DataFrame:
    """Each fold's primary model gives sides; a second one, fitted on what the fold knows, says which of them pay."""
    feats, folds, rows = _training(spark, d)
    return ml.meta_books(rows, feats, folds)


def g25_cv_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = signals.labelled(market.feature_rows(spark, d)).dropna(subset=[*signals.FEATURES, "y"])
    return ml.cv_scores(rows, 3, 5)


def g17_first_split(spark: SparkSession, d: str) -> DataFrame:
    """The first tree's one split of each fold, on two features in few steps, with its leaves."""
    _, _, rows = _training(spark, d)
    names = ("rsi", "mom")
    at = rows.select("fold", "y", F.floor(F.col("rsi_14") / 10).cast("double").alias("rsi"), F.floor(F.col("mom_5") * 100).cast("double").alias("mom"))
    models = boost.fit_all(at, ("fold",), names, trees=1, depth=1, rate=1.0)
    found = [(k[0], names[m.feature[0, 0]], float(m.threshold[0, 0]), float(m.base), *map(float, m.leaf[0])) for k, m in models.items()]  # a row a fold
    return views.rounded(spark.createDataFrame(found, "fold long, feature string, threshold double, base double, low double, high double"))


def g28_losses(spark: SparkSession, d: str) -> DataFrame:
    """What AUC loses when a feature or the labels are dealt anew, with a fixed function of the features as the model."""
    _, _, rows = _training(spark, d)
    own = rows.where("fold = 0").withColumn("id", F.concat_ws("|", "ticker", F.col("date").cast("string")))
    score = lambda df: df.withColumn("p", F.round(1 / (1 + F.exp(-(0.5 * F.col("zscore_21") + 4 * F.col("mom_5") - F.col("rsi_14") / 100))), 9))
    return views.rounded(ml.permutation_losses(score, own.select("id", "y", *signals.FEATURES), ("zscore_21", "mom_5", "vol_21"), 4))


def g26_permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    _, _, rows = _training(spark, d)
    learn, rest = ml.held_out(_with_id(rows))
    return ml.permutation_importance(ml.fit_boosted(learn), rest)


def g27_feature_significance(spark: SparkSession, d: str) -> DataFrame:
    _, _, rows = _training(spark, d)
    return ml.feature_significance(_with_id(rows))


def g29_sleeves(spark: SparkSession, d: str) -> DataFrame:
    """The three standard sleeves: momentum and model books, halved in the hot regime, and causal pairs."""
    m, hot = views.market(spark, d), market.regime(spark, d)
    mom = signals.cross_sectional_momentum(m, views.LOOKBACK, views.SKIP, 0.2, views.REBALANCE).withColumn("book", F.lit("momentum"))
    feats, folds, rows = _training(spark, d)
    ahead = folds.select(F.col("fold").alias("f"), "fit_end", F.lead("fit_end").over(Window.orderBy("fold")).alias("next"))  # a row a fold
    model = ml.fold_books(rows, feats, folds).join(F.broadcast(ahead), F.col("fold") == F.col("f"))
    model = model.where(F.col("next").isNull() | (F.col("date") < F.col("next"))).withColumn("book", F.lit("ml"))
    cols = ["book", "date", "ticker", "w"]
    sized = risk.regime_sized(mom.select(*cols).unionByName(model.select(*cols)), hot)
    pairs = g11_causal_pairs(spark, d).withColumn("book", F.lit("pairs"))
    return sized.select(*cols).unionByName(pairs.select(*cols)).withColumnRenamed("book", "sleeve")


def r5_garch_vol(spark: SparkSession, d: str) -> DataFrame:
    series = views.proxy(spark, d).withColumn("series", F.lit("proxy"))
    return solvers.garch_forecasts(series, 52, 104)


def r6_garch_regime(spark: SparkSession, d: str) -> DataFrame:
    return risk.median_ratio_regime(r5_garch_vol(spark, d), 52, 1.1)


def r7_garch_vol_target(spark: SparkSession, d: str) -> DataFrame:
    return solvers.garch_vol_target(views.daily(spark, d), 0.10, 3.0, 26, 104, views.PERIODS).select("book", "date", "vol", "scaled")


def r7_garch_path(spark: SparkSession, d: str) -> DataFrame:
    """The variance path and the scaled stream of each book under given parameters."""
    at = views.daily(spark, d).select(F.col("book").alias("series"), "date", F.col("ret").alias("r"))
    path = solvers.garch_path(at, 0.0, 2e-6, 0.1, 0.85, 1e-4)
    scale = F.least(F.lit(3.0), 0.10 / (F.sqrt("v") * math.sqrt(views.PERIODS)))
    return views.rounded(path.select(F.col("series").alias("book"), "date", (F.col("v") * 1e4).alias("v"), (F.col("r") * scale).alias("scaled")))


def r10_kelly(spark: SparkSession, d: str) -> DataFrame:
    names = market.named(spark, d)
    mu = names.groupBy(F.col("name").alias("i")).agg(F.avg("r").alias("mu"))
    return solvers.kelly(allocation.correlations(names).join(mu, "i").select("i", "j", "cov", "mu"))


def r16_evt_tail(spark: SparkSession, d: str) -> DataFrame:
    return solvers.evt_tails(views.daily(spark, d))


def r16_planted_tails(spark: SparkSession, d: str) -> DataFrame:
    """Whether the tail fit gives back the shape and the scale of exceedances planted at even quantiles, as many a brand as it has parts."""
    w = Window.partitionBy("p_brand")
    parts = views.table(spark, d, "part").select(F.col("p_brand").alias("book"), F.row_number().over(w.orderBy("p_partkey")).alias("k"), F.count("*").over(w).alias("n"))
    at = parts.withColumn("shape", 0.1 + 0.05 * F.right("book", F.lit(1)).cast("int")).withColumn("scale", 0.5 + 0.1 * F.length("book"))
    at = at.withColumn("x", F.col("scale") / F.col("shape") * (F.pow(1 - (F.col("k") - 0.5) / F.col("n"), -F.col("shape")) - 1))
    known = at.groupBy("book").agg(F.first("shape").alias("shape"), F.first("scale").alias("scale"))
    got = solvers.tail_fits(at.select("book", "x"), 40).join(known, "book")
    return got.select("book", (F.abs(F.col("xi") - F.col("shape")) <= 0.1).alias("shape_back"), (F.abs(F.col("beta") / F.col("scale") - 1) <= 0.1).alias("scale_back"))


def a7_hrp(spark: SparkSession, d: str) -> DataFrame:
    return solvers.hrp_weights(allocation.correlations(market.named(spark, d)))


def a8_rolling_hrp(spark: SparkSession, d: str) -> DataFrame:
    return solvers.rolling_allocation(market.named(spark, d), panel.calendar(views.market(spark, d)), "hrp", 104, 26)


def p23_full_tearsheet(spark: SparkSession, d: str) -> DataFrame:
    """A row a book: metrics, tails (EVT too), significance, bootstrap intervals, factors."""
    at = views.daily(spark, d)
    significant = performance.deflated_sharpe(performance.probabilistic_sharpe(performance.sharpe_moments(at, 0.0, views.PERIODS), 0.0, views.PERIODS), 45, False, views.PERIODS)
    evt = solvers.evt_tails(at).select("book", "xi", F.col("var").alias("evt_var"), F.col("es").alias("evt_es"))
    parts = (risk.tail_report(at), evt, significant.select("book", "psr", "sr_star_annual", "dsr"), performance.bootstrap_report(at, 0.95, market.DRAWS, 10, 7, views.PERIODS), performance.factor_decomposition(at, market.factors(spark, d), 0.0, 5, 30, views.PERIODS).drop("n"))
    out = performance.metrics(at, 0.0, views.PERIODS)
    for part in parts:
        out = out.join(part, "book", "left")
    return out


def o16_svi_fits(spark: SparkSession, d: str) -> DataFrame:
    return smiles.svi_slices(true_points(spark, d), kept=views.kept(spark, d, "svi-fits"))


def o17_butterfly_free(spark: SparkSession, d: str) -> DataFrame:
    """Of every fitted slice, whether the density that its smile implies stays above -0.001 of the normal one over a grid of log-moneyness."""
    at = o17_svi_no_butterfly(spark, d)

    def g(k):
        x = k - F.col("m")
        root = F.sqrt(x * x + F.col("sigma") * F.col("sigma"))
        w = F.col("a") + F.col("b") * (F.col("rho") * x + root)
        first, second = F.col("b") * (F.col("rho") + x / root), F.col("b") * F.col("sigma") * F.col("sigma") / (root * root * root)
        return F.pow(1 - k * first / (2 * w), F.lit(2.0)) - first * first / 4 * (1 / w + 0.25) + second / 2

    grid = F.transform(F.sequence(F.lit(-36), F.lit(36)), lambda i: i / 40.0)
    checked = views.once(spark, d, "svi-free", at, lambda fits: fits.withColumn("free", F.forall(grid, lambda k: g(k) >= -1e-3)), ("a", "b", "rho", "m", "sigma"))
    return checked.select("underlying", "as_of", "expiry", "free")


def o17_svi_no_butterfly(spark: SparkSession, d: str) -> DataFrame:
    return smiles.svi_slices(true_points(spark, d), no_butterfly=True, kept=views.kept(spark, d, "svi-fits-free"))


def o19_ssvi_slices(spark: SparkSession, d: str) -> DataFrame:
    return smiles.ssvi_slices(true_points(spark, d), kept=views.kept(spark, d, "ssvi-fits"))


def o20_ssvi_surfaces(spark: SparkSession, d: str) -> DataFrame:
    return smiles.ssvi_surfaces(true_points(spark, d), kept=views.kept(spark, d, "surface-fits"))


def o21_ssvi_checks(spark: SparkSession, d: str) -> DataFrame:
    """The rules' verdict and the pointwise one on fitted surfaces."""
    at = smiles.ssvi_surfaces(true_points(spark, d), kept=views.kept(spark, d, "surface-fits"))
    return smiles.surface_checks(at).withColumnRenamed("calendar_free", "calendar_by_rule").join(smiles.pointwise_calendar(at), ["underlying", "as_of"])


def t1_filing_alerts(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").select(F.col("event_id").alias("accession"), F.col("event_type").alias("form"), F.col("ts").alias("filing_ts"))
    return alerts.filing_alerts(e, ("purchase", "signup"))


QUERIES = {
    f.__name__: f
    for f in (
        g5_pair_scan, g6_best_pair, g8_rolling_cointegration, g8_fixed_lag, g11_causal_pairs, g14_model_books, g15_calibrated_books, g17_first_split, g22_meta_model, g25_cv_scores,
        g26_permutation_importance, g27_feature_significance, g28_losses, g29_sleeves, r5_garch_vol, r6_garch_regime, r7_garch_vol_target, r7_garch_path, r10_kelly, r16_evt_tail, r16_planted_tails,
        a7_hrp, a8_rolling_hrp, p23_full_tearsheet, o16_svi_fits, o17_svi_no_butterfly, o17_butterfly_free, o19_ssvi_slices, o20_ssvi_surfaces, o21_ssvi_checks, t1_filing_alerts,
    )
}
_STEPS = "SELECT fold, y, floor(rsi_14 / 10) AS rsi, floor(mom_5 * 100) AS mom FROM training"
_SPLIT = f"""SELECT fold, feature, threshold, ln(mean / (1 - mean)) AS base, -gl / (hl + 1) AS low, -(g - gl) / (h - hl + 1) AS high FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1), 9) DESC, place, threshold) AS k FROM (
    SELECT s.fold, s.place, s.feature, (s.x + lead(s.x) OVER w) / 2 AS threshold, t.mean, t.n, t.g, t.h,
      sum(s.n * t.mean - s.up) OVER (w ROWS UNBOUNDED PRECEDING) AS gl, sum(s.n * t.mean * (1 - t.mean)) OVER (w ROWS UNBOUNDED PRECEDING) AS hl, sum(s.n) OVER (w ROWS UNBOUNDED PRECEDING) AS nl
    FROM (SELECT fold, 0 AS place, 'rsi' AS feature, rsi AS x, count(*) AS n, sum(y) AS up FROM steps GROUP BY 1, 2, 3, 4 UNION ALL SELECT fold, 1, 'mom', mom, count(*), sum(y) FROM steps GROUP BY 1, 2, 3, 4) s
    JOIN (SELECT fold, avg(y) AS mean, count(*) AS n, sum(avg(y)) OVER (PARTITION BY fold) * 0 AS g, count(*) * avg(y) * (1 - avg(y)) AS h FROM steps GROUP BY fold) t ON t.fold = s.fold
    WINDOW w AS (PARTITION BY s.fold, s.feature ORDER BY s.x)) WHERE threshold IS NOT NULL AND nl >= 20 AND n - nl >= 20) WHERE k = 1"""
_NAMES = ("zscore_21", "mom_5", "vol_21")
_TURN = "CAST(('0x' || substr(md5({} || '|' || feature || '|' || repeat || '|' || id), 1, 13)) AS BIGINT)"
_DEAL = "SELECT a.feature, a.repeat, a.id, b.id AS source FROM (SELECT *, row_number() OVER (PARTITION BY feature, repeat ORDER BY {}, id) AS k FROM {}) a JOIN (SELECT *, row_number() OVER (PARTITION BY feature, repeat ORDER BY {}, id) AS k FROM {}) b ON b.feature = a.feature AND b.repeat = a.repeat AND b.k = a.k"
_AUC = "SELECT feature, repeat, kind, (sum(k * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM (SELECT *, rank() OVER (PARTITION BY feature, repeat, kind ORDER BY p) + (count(*) OVER (PARTITION BY feature, repeat, kind, p) - 1) / 2.0 AS k FROM ({})) GROUP BY 1, 2, 3"
_LOSSES = {
    "own": f"SELECT ticker || '|' || CAST(date AS VARCHAR) AS id, y, {', '.join(_NAMES)}, rsi_14 FROM training WHERE fold = 0",
    "span": "SELECT id, f.feature, r.repeat FROM own CROSS JOIN (SELECT unnest(['" + "', '".join(_NAMES) + "']) AS feature) f CROSS JOIN (SELECT unnest(range(4)) AS repeat) r",
    "label_span": "SELECT id, 'y' AS feature, r.repeat FROM own CROSS JOIN (SELECT unnest(range(4)) AS repeat) r",
    "deal": _DEAL.format(_TURN.format("7"), "span", _TURN.format("8"), "span"),
    "label_deal": _DEAL.format(_TURN.format("9"), "label_span", _TURN.format("10"), "label_span"),
    "null_labels": "SELECT d.repeat, d.id, o.y FROM label_deal d JOIN own o ON o.id = d.source",
    "dealt": "SELECT d.feature, d.repeat, d.id, o.y, round(1 / (1 + exp(-(0.5 * CASE WHEN d.feature = 'zscore_21' THEN v.zscore_21 ELSE o.zscore_21 END + 4 * CASE WHEN d.feature = 'mom_5' THEN v.mom_5 ELSE o.mom_5 END - o.rsi_14 / 100))), 9) AS p FROM deal d JOIN own o ON o.id = d.id JOIN own v ON v.id = d.source",
    "base": "SELECT id, y, round(1 / (1 + exp(-(0.5 * zscore_21 + 4 * mom_5 - rsi_14 / 100))), 9) AS p FROM own",
    "areas": _AUC.format("SELECT feature, repeat, 'own' AS kind, p, y FROM dealt UNION ALL SELECT d.feature, d.repeat, 'null', d.p, n.y FROM dealt d JOIN null_labels n ON n.repeat = d.repeat AND n.id = d.id UNION ALL SELECT 'all', n.repeat, 'null', b.p, n.y FROM base b JOIN null_labels n ON n.id = b.id UNION ALL SELECT 'all', 0, 'own', p, y FROM base"),
}
_LOST = "SELECT a.feature, a.repeat, (SELECT auc FROM areas WHERE feature = 'all' AND kind = 'own') - a.auc AS loss, z.auc - n.auc AS null_loss FROM areas a JOIN areas n ON n.feature = a.feature AND n.repeat = a.repeat AND n.kind = 'null' JOIN areas z ON z.feature = 'all' AND z.repeat = a.repeat AND z.kind = 'null' WHERE a.kind = 'own' AND a.feature <> 'all'"
_ALL_TRAINING = market._TRAINING.replace("l.mom_5", ", ".join(f"l.{c}" for c in signals.FEATURES))
_ROWS = {"feats": market._FEATURES, "labelled": market._LABELLED, "training": _ALL_TRAINING}


_TAU = f"""SELECT a, b, date, 104 AS n, (s22 * s1y - s12 * s2y) / d / sqrt((syy - (s22 * s1y - s12 * s2y) / d * s1y - (s11 * s2y - s12 * s1y) / d * s2y) / (m - 2) * s22 / d) AS tau FROM (
  SELECT a, b, date, count(*) AS m, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y, sum(y * y) AS syy, sum(x1 * x1) * sum(x2 * x2) - sum(x1 * x2) * sum(x1 * x2) AS d FROM (
    SELECT *, lag(y) OVER (PARTITION BY a, b, date ORDER BY pos) AS x2 FROM (SELECT *, lag(e) OVER (PARTITION BY a, b, date ORDER BY pos) AS x1, e - lag(e) OVER (PARTITION BY a, b, date ORDER BY pos) AS y FROM residuals)) WHERE x2 IS NOT NULL GROUP BY 1, 2, 3)"""
_WINDOWS = {
    "placed": "SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY date) - 1 AS pos FROM paired",
    "windows": "SELECT e.a, e.b, e.date, r.pos, r.la, r.lb FROM placed e JOIN placed r ON r.a = e.a AND r.b = e.b AND r.pos BETWEEN e.pos - 104 AND e.pos - 1 WHERE e.pos >= 104 AND (e.pos - 104) % 26 = 0 AND r.la + r.lb IS NOT NULL",
    "hedges": "SELECT a, b, date, covar_pop(la, lb) / var_pop(lb) AS beta, avg(la) AS ma, avg(lb) AS mb FROM windows GROUP BY 1, 2, 3 HAVING count(*) = 104",
    "residuals": "SELECT w.a, w.b, w.date, w.pos, w.la - h.ma - h.beta * (w.lb - h.mb) AS e FROM windows w JOIN hedges h ON h.a = w.a AND h.b = w.b AND h.date = w.date",
}
_PATH = """WITH RECURSIVE {views}, numbered AS MATERIALIZED (SELECT book, date, ret, row_number() OVER (PARTITION BY book ORDER BY date) AS k FROM daily), walked AS (
  SELECT book, date, ret, k, CAST(1e-4 AS DOUBLE) AS v FROM numbered WHERE k = 1
  UNION ALL SELECT n.book, n.date, n.ret, n.k, CASE WHEN w.ret IS NULL THEN w.v ELSE 2e-6 + 0.1 * w.ret * w.ret + 0.85 * w.v END FROM walked w JOIN numbered n ON n.book = w.book AND n.k = w.k + 1
) {select}"""
_WALKED = rounded({"book": "k", "date": "k", "v": "f", "scaled": "f"}, f"SELECT book, date, v * 1e4 AS v, ret * least(3.0, 0.10 / (sqrt(v) * sqrt({views.PERIODS}))) AS scaled FROM walked")
SQL = {
    "o17_butterfly_free": with_(f"SELECT underlying, as_of, expiry, true AS free FROM points GROUP BY 1, 2, 3 HAVING count(*) >= {smiles.LEAST}"),
    "r16_planted_tails": "SELECT p_brand AS book, true AS shape_back, true AS scale_back FROM part GROUP BY 1 HAVING count(*) >= 40",
    "r7_garch_path": _PATH.format(views=with_("SELECT * FROM daily").removeprefix("WITH ").rsplit("\n", 1)[0], select=_WALKED),
    "g8_fixed_lag": with_(rounded({"a": "k", "b": "k", "date": "k", "n": "i", "tau": "f"}, _TAU), paired=market._PAIRED, **_WINDOWS),
    "g17_first_split": with_(rounded({"fold": "i", "feature": "k", "threshold": "f", "base": "f", "low": "f", "high": "f"}, _SPLIT), **_ROWS, steps=_STEPS),
    "g28_losses": with_(rounded({"feature": "k", "repeat": "i", "loss": "f", "null_loss": "f"}, _LOST), **_ROWS, **_LOSSES),
    "t1_filing_alerts": "SELECT event_id AS accession, any_value(event_type) AS form, any_value(ts) AS filing_ts FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1",
}
