"""Model sleeves: pooled classifiers per fold, their scores and their books."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import boost, cv
from panelforge.operators.performance import fdr
from panelforge.operators.signals import FEATURES, meta_book, meta_labels, neutral_book, primary_side


def fit_boosted(rows: DataFrame, features=FEATURES, weight: str | None = None, trees: int = boost.TREES, depth: int = boost.DEPTH, **params):
    """A gradient-boosted direction model of all rows; None if the labels have one class."""
    one = boost.fit_all(rows.withColumn("_one", F.lit(0)), ("_one",), features, weight=weight, trees=trees, depth=depth, **params)
    return one.get((0,))


def scored(model, rows: DataFrame, features=FEATURES, out: str = "p") -> DataFrame:
    """rows with all features, with P(up)."""
    return boost.score_all({(): model}, rows, (), features, out)


def calibrated(rows: DataFrame, features=FEATURES, method: str = "isotonic", folds: int = 3, **fit):
    """A function that calibrates a model's scores, learnt on scores of held-out thirds of the dates."""
    if method not in ("isotonic", "sigmoid"):
        raise ValueError(f"unknown calibration: {method!r}")
    at = _thirds(rows, (), folds)
    models = boost.fit_all(_copies(at, folds).where("_k <> _copy"), ("_copy",), features, **fit)
    if not models:
        return lambda df: df
    parts = boost.score_all(models, at.withColumn("_copy", F.col("_k")), ("_copy",), features).select("p", "y")
    if method == "isotonic":
        iso = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="_c").fit(parts)
        return lambda df: iso.transform(df).withColumn("p", F.col("_c")).drop("_c")
    one = VectorAssembler(inputCols=["p"], outputCol="_v")
    lr = LogisticRegression(featuresCol="_v", labelCol="y").fit(one.transform(parts))
    return lambda df: lr.transform(one.transform(df)).withColumn("p", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")


def _thirds(rows: DataFrame, keys: tuple, folds: int) -> DataFrame:
    """rows with _k, the part of its key's dates that a row's date is in (a row a date is ordered)."""
    part = F.ntile(folds).over(Window.partitionBy(*keys).orderBy("date")) - 1
    return rows.join(rows.select(*keys, "date").distinct().withColumn("_k", part), [*keys, "date"])


def _copies(rows: DataFrame, folds: int) -> DataFrame:
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))


def fold_scores(training: DataFrame, ahead: DataFrame, features=FEATURES, weight: str | None = None, calibrate: str | None = None, parts: int = 3, **fit) -> DataFrame:
    """ahead (fold, date, ticker, ...) with p by its fold's model, fitted on the fold's own training rows: all folds in one job.

    With ``calibrate``, p is the mean of ``parts`` models, each fitted without one part of the fold's dates and calibrated on that part.
    """
    if not calibrate:
        return boost.score_all(boost.fit_all(training, ("fold",), features, weight=weight, **fit), ahead, ("fold",), features)
    at = _copies(_thirds(training, ("fold",), parts), parts).withColumn("_held", F.col("_k") == F.col("_copy"))
    models = boost.fit_all(at, ("fold", "_copy"), features, weight=weight, held="_held", calibrate=calibrate, **fit)
    each = boost.score_all(models, _copies(ahead, parts), ("fold", "_copy"), features)
    mean = each.groupBy("fold", "date", "ticker").agg(F.avg("p").alias("p"))
    return ahead.drop("p").join(mean, ["fold", "date", "ticker"])


def ahead_of(feats: DataFrame, folds: DataFrame) -> DataFrame:
    """fold, fit_end and the rows of feats from each fold's end on."""
    return feats.join(F.broadcast(folds.select("fold", "fit_end")), F.col("date") >= F.col("fit_end"))  # a row a fold


def fold_books(training: DataFrame, feats: DataFrame, folds: DataFrame, deadband: float = 0.05, max_weight: float = 0.10, weight: str | None = None, calibrate: str | None = None, **fit) -> DataFrame:
    """fold, date, ticker, p, w: each fold's model, fitted on its own training rows, scored after them."""
    p = fold_scores(training, ahead_of(feats, folds), weight=weight, calibrate=calibrate, **fit).select("fold", "date", "ticker", "p")
    return neutral_book(p, deadband, max_weight, keys=("fold",)).select("fold", "date", "ticker", "p", "w")


def meta_books(training: DataFrame, feats: DataFrame, folds: DataFrame, deadband: float = 0.01, least: float = 0.5, **fit) -> DataFrame:
    """fold, date, ticker, w: the sides of each fold's primary model, sized by a second one that is fitted on which sides paid before the fold's end."""
    names = [*FEATURES, "side"]
    every = feats.dropna(subset=list(FEATURES)).join(F.broadcast(folds.select("fold", "fit_end")), F.lit(True))  # a row a fold
    sided = fold_scores(training, every, **fit).withColumn("side", primary_side(F.col("p"), deadband))
    meta = meta_labels(sided, keys=("fold", "ticker")).where("meta IS NOT NULL AND date < fit_end")
    models = boost.fit_all(meta, ("fold",), names, label="meta", **fit)
    later = sided.where("date >= fit_end")
    sized = meta_book(boost.score_all(models, later, ("fold",), names, "meta_p"), least, keys=("fold",)).select("fold", "date", "ticker", "w")
    without = [k[0] for k in models]
    plain = neutral_book(later.where(~F.col("fold").isin(without)) if without else later, keys=("fold",)).select("fold", "date", "ticker", "w")
    return sized.unionByName(plain)


def cv_scores(rows: DataFrame, k: int = 5, embargo: int = 5, **fit) -> DataFrame:
    """block, auc, accuracy of a model fitted outside each purged block; all blocks in one job."""
    sides = cv.purged_folds(rows, k, embargo)
    models = boost.fit_all(sides.where("side = 'train'"), ("block",), FEATURES, **fit)
    return cv.auc(boost.score_all(models, sides.where("side = 'test'"), ("block",), FEATURES), "block")


def permuted(rows: DataFrame, columns, repeats: int, seed: int = 7) -> DataFrame:
    """rows (id, ..) for each (repeat, column), that column's values dealt anew: two orders of the ids by hash, joined on their places."""
    span = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"), F.explode(F.array(*(F.lit(c) for c in columns))).alias("feature"))
    place = lambda s: cv.places(span.withColumn("_h", cv.turn(F.lit(s), F.col("feature"), F.col("repeat"), F.col("id"))), "_h", "id", "repeat", "feature").drop("_h")
    taken = place(seed).join(place(seed + 1).withColumnRenamed("id", "_from"), ["repeat", "feature", "place"]).drop("place")
    values = rows.select(F.col("id").alias("_from"), F.map_from_arrays(F.array(*(F.lit(c) for c in columns)), F.array(*(F.col(c).cast("double") for c in columns))).alias("_all"))
    dealt = taken.join(values, "_from").select("id", "repeat", "feature", F.col("_all")[F.col("feature")].alias("_v"))
    at = rows.join(dealt, "id")
    return at.select(*(F.when(F.col("feature") == c, F.col("_v")).otherwise(F.col(c).cast("double")).alias(c) if c in columns else F.col(c) for c in rows.columns), "repeat", "feature")


def permutation_losses(score, rows: DataFrame, features=FEATURES, repeats: int = 199, seed: int = 7) -> DataFrame:
    """feature, repeat, loss, null_loss: AUC lost when the feature is dealt anew, under the labels and under labels dealt anew in each repeat.

    ``score`` gives rows their p. Every row is scored once, and each (repeat, feature) once more: its scores serve both sets of labels.
    """
    base = score(rows).select("id", "y", "p")
    null = permuted(base.select("id", "y"), ["y"], repeats, seed + 2).select("id", "repeat", F.col("y").alias("null_y"))
    dealt = score(permuted(rows, list(features), repeats, seed)).select("feature", "repeat", "id", "y", "p").join(null, ["id", "repeat"])
    label = lambda kind, y: F.struct(F.lit(kind).alias("kind"), F.col(y).alias("y"))
    dealt = dealt.select("feature", "repeat", "p", F.explode(F.array(label("own", "y"), label("null", "null_y"))).alias("_l")).select("feature", "repeat", "p", "_l.*")
    areas = cv.auc(dealt, "feature", "repeat", "kind").groupBy("feature", "repeat").agg(*(F.max(F.when(F.col("kind") == k, F.col("auc"))).alias(k) for k in ("own", "null")))
    whole = cv.auc(base.withColumn("_one", F.lit(0)), "_one").select(F.col("auc").alias("base"))
    null_base = cv.auc(null.join(base.select("id", "p"), "id"), "repeat", y="null_y").select("repeat", F.col("auc").alias("null_base"))
    each = areas.join(null_base, "repeat").join(F.broadcast(whole), F.lit(True))  # one row
    return each.select("feature", "repeat", (F.col("base") - F.col("own")).alias("loss"), (F.col("null_base") - F.col("null")).alias("null_loss"))


def importance(losses: DataFrame) -> DataFrame:
    """feature, importance (the mean loss) and p: (1 + null losses as large) / (repeats + 1)."""
    mean = losses.withColumn("importance", F.avg("loss").over(Window.partitionBy("feature")))  # repeats of a feature
    one = mean.groupBy("feature").agg(F.first("importance").alias("importance"), F.count_if(F.col("null_loss") >= F.col("importance")).alias("k"), F.count("*").alias("n"))
    return one.select("feature", "importance", ((1 + F.col("k")) / (F.col("n") + 1)).alias("p"))


def permutation_importance(model, rows: DataFrame, features=FEATURES, repeats: int = 199, seed: int = 7) -> DataFrame:
    """feature, importance, p of a fitted model over rows (id, features, y) that it has not learnt from."""
    return importance(permutation_losses(lambda df: scored(model, df, features), rows, features, repeats, seed))


def held_out(rows: DataFrame, parts: int = 4, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The rows to learn from and one part of the ids (by hash) to measure on."""
    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(parts))
    return rows.where(part > 0), rows.where(part == 0)


def feature_significance(rows: DataFrame, features=FEATURES, repeats: int = 199, alpha: float = 0.10, seed: int = 7, **fit) -> DataFrame:
    """feature, importance, p, q, keep: fitted on three quarters of the ids, measured on the rest, with false discoveries controlled."""
    learn, rest = held_out(rows, seed=seed)
    got = permutation_importance(fit_boosted(learn, features, **fit), rest, features, repeats, seed)
    out = fdr(got.select(F.lit("features").alias("family"), F.col("feature").alias("name"), "p"), alpha)
    return got.drop("p").join(out.select(F.col("name").alias("feature"), "p", "q", "keep"), "feature")
