"""Queries: learned baselines.

Fitted models have no SQL, and tests bound their scores. The planted queries
learn a rule of a column with few values, which the trees find exactly, so SQL
knows every prediction.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidegauge.catalog.registry import query
from tidegauge.operators import learned as M
from tidegauge.operators.metrics import class_report, confusion_matrix, macro_f1
from tidegauge.operators.ranking import top_n
from tidegauge.operators.rows import is_unconfounded
from tidegauge.operators.splits import holdout_split, stratified_folds
from tidegauge.plans import learned_reports as R
from tidegauge.schemas import DELTA_HORIZONS, HORIZON_US, IMPACT_HORIZONS

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "p_size", "p_retailprice"]
FLAGS = ["A", "N", "R"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def rows(v):
    """Line items with part features and a repeatable fit / holdout mark."""
    items = v.table("lineitem").select(*KEYS, "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag",
                                       "l_linestatus", (F.col("l_suppkey") % 4 == 0).alias("confound_flag"))
    parts = v.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    return holdout_split(items.join(parts, "l_partkey"), KEYS)


def folded(v, folds: int):
    return stratified_folds(rows(v), "l_returnflag", KEYS, folds=folds)


@query("ml_multiclass")
def ml_multiclass(v):
    data = M.prepared(rows(v), FEATURES)
    model = M.fit_multiclass(data.where("part = 'fit'"), FEATURES, "l_returnflag", FLAGS)
    return M.predict_classes(model, data.where("part = 'holdout'"), FEATURES, FLAGS).select(
        *KEYS, F.col("l_returnflag").alias("gold_label"), "pred_label", "confidence", "scores")


@query("ml_binary")
def ml_binary(v):
    data = M.prepared(rows(v).withColumn("target", F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)), FEATURES)
    model = M.fit_binary(data.where("part = 'fit'"), FEATURES, "target")
    predicted = M.predict_value(model, data.where("part = 'holdout'"), FEATURES)
    counts = confusion_matrix(predicted, "target", "pred")
    return class_report(counts, [0.0, 1.0])


@query("ml_regression")
def ml_regression(v):
    """One regression per tier and horizon."""
    data = rows(v).withColumns({"delta_30m": F.col("l_quantity") * F.col("p_retailprice") / 1000,
                                "delta_2h": F.col("l_extendedprice") / 1000,
                                "delta_6h": F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000})
    data = M.assemble(data, FEATURES).select("features", "part", "confound_flag", *[f"delta_{h}" for h in DELTA_HORIZONS])
    data = M.prepared(data, FEATURES)
    return R.tiered_regression(data.where("part = 'fit'"), data.where("part = 'holdout'"),
                               {"all": F.lit(True), "non_confounded": is_unconfounded("confound_flag")}, FEATURES,
                               [f"delta_{h}" for h in DELTA_HORIZONS], KEYS)


@query("ml_oof_regression")
def ml_oof_regression(v):
    data = M.assemble(folded(v, 5), FEATURES).select("features", "l_extendedprice", "fold")
    predicted, _ = M.out_of_fold_regression(data, FEATURES, "l_extendedprice")
    long = predicted.select(F.lit("l_extendedprice").alias("horizon"), F.col("l_extendedprice").alias("gold"), "pred")
    return R.horizon_scores(long)


@query("ml_oof_classification")
def ml_oof_classification(v):
    predicted, _ = M.out_of_fold_classes(folded(v, 5), FEATURES, "l_returnflag", FLAGS)
    return R.class_scores_of(predicted, "l_returnflag", FLAGS)


@query("ml_tune")
def ml_tune(v):
    data = M.assemble(folded(v, 5), FEATURES)
    learner = GBTRegressor(featuresCol="features", labelCol="l_extendedprice", seed=42)
    space = {"maxDepth": [2, 3, 4], "maxIter": [10, 20], "stepSize": [0.1, 0.3]}
    return M.search(data, learner, space, "spearman", "l_extendedprice")


@query("ml_tune_classes")
def ml_tune_classes(v):
    data = M.assemble(M.index_labels(folded(v, 5), "l_returnflag", FLAGS), FEATURES)
    learner = RandomForestClassifier(featuresCol="features", labelCol="label_index", seed=42)
    space = {"maxDepth": [2, 4, 6], "numTrees": [10, 20]}
    return M.search(data, learner, space, "macro_f1", "label_index", trials=20)


@query("ml_early_stop")
def ml_early_stop(v):
    data = rows(v).withColumns({"target": F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0),
                                "stop_on": F.col("part") == "holdout"})
    data = M.prepared(data, FEATURES)
    model = M.fit_binary(data, FEATURES, "target", rounds=500, stop_on="stop_on")
    predicted = M.predict_value(model, data.where("stop_on"), FEATURES)
    counts = confusion_matrix(predicted, "target", "pred")
    return macro_f1(counts, [0.0, 1.0]).withColumn("rounds", F.lit(model.getNumTrees))


@query("top_importances")
def top_importances(v):
    _, models = M.out_of_fold_regression(folded(v, 5), FEATURES, "l_extendedprice")
    return top_n(M.importances(models, FEATURES), [F.desc("importance"), F.col("feature")], 5)


@query("ml_t5_summary")
def ml_t5_summary(v):
    """All ten targets, price impact and volume multiplier at five horizons, and the class."""
    values = {"price_impact": F.col("l_extendedprice") / 1e5, "volume_multiplier": F.col("l_quantity") * (1 + F.col("l_tax"))}
    made = {f"{m}_{h}": value * HORIZON_US[h] / HORIZON_US["6h"] for m, value in values.items() for h in IMPACT_HORIZONS}
    metrics = {m: [f"{m}_{h}" for h in IMPACT_HORIZONS] for m in values}
    return R.impact_summary(folded(v, 5).withColumns(made), FEATURES, metrics, "l_returnflag", FLAGS)


# --------------------------------------------------------------------------- planted rules

_IDS = ["l_orderkey", "l_linenumber", "l_partkey"]
_HELD = """h AS (SELECT *, l_suppkey % 4 = 0 AS confound_flag FROM lineitem WHERE CAST(concat('0x', substr(md5(concat('42|',
  l_orderkey, '|', l_linenumber, '|', l_partkey)), 1, 8)) AS BIGINT) < CAST(round(0.2 * 4294967296) AS BIGINT))"""
_RULE = "CASE WHEN l_linenumber <= 2 THEN 'A' WHEN l_linenumber <= 4 THEN 'N' ELSE 'R' END"
_SMALL = ["l_linenumber", "l_discount", "l_tax"]


def planted(v):
    n = F.col("l_linenumber")
    items = v.table("lineitem").select(*_IDS, "l_discount", "l_tax", (F.col("l_suppkey") % 4 == 0).alias("confound_flag"))
    items = items.withColumns({
        "rule": F.when(n <= 2, "A").when(n <= 4, "N").otherwise("R"),
        **{f"delta_{h}": n * k for h, k in (("30m", 1.0), ("2h", 2.0), ("6h", -3.0))}})
    return holdout_split(items, _IDS)


@query("ml_planted_classes", f"WITH {_HELD} SELECT l_orderkey, l_linenumber, l_partkey, {_RULE} AS pred_label FROM h")
def ml_planted_classes(v):
    """Boosted classes with early stopping."""
    data = M.prepared(planted(v).withColumn("stop_on", F.col("part") == "holdout"), _SMALL)
    model = M.fit_boosted_classes(data, _SMALL, "rule", FLAGS, rounds=500, stop_on="stop_on")
    return M.predict_classes(model, data.where("stop_on"), _SMALL, FLAGS).select(*_IDS, "pred_label")


@query("ml_planted_regression", f"""
WITH {_HELD}, t AS (SELECT tier, unnest(['delta_30m', 'delta_2h', 'delta_6h', 'all']) AS horizon,
  unnest([1, 1, 1, 3]) AS k FROM h, (VALUES ('all'), ('non_confounded')) x(tier) WHERE tier = 'all' OR NOT confound_flag)
SELECT tier, horizon, CAST(sum(k) AS BIGINT) AS n, 0.0::DOUBLE AS mae, 1.0::DOUBLE AS spearman FROM t GROUP BY ALL""")
def ml_planted_regression(v):
    """One regression per tier and horizon."""
    data = M.prepared(planted(v), _SMALL)
    scores = R.tiered_regression(data.where("part = 'fit'"), data.where("part = 'holdout'"),
                                 {"all": F.lit(True), "non_confounded": ~F.col("confound_flag")}, _SMALL,
                                 [f"delta_{h}" for h in DELTA_HORIZONS], _IDS)
    return scores.select("tier", "horizon", "n", F.abs(F.round("mae", 6)).alias("mae"), F.round("spearman", 6).alias("spearman"))


@query("ml_planted_search", f"""
WITH {_HELD} SELECT l_orderkey, l_linenumber, l_partkey, {_RULE} AS pred_label FROM h""")
def ml_planted_search(v):
    """The best of the trials, fitted on all learning rows, scores the rest."""
    data = planted(v)
    fit = M.assemble(M.index_labels(stratified_folds(data.where("part = 'fit'"), "rule", _IDS, folds=5), "rule", FLAGS), _SMALL)
    learner = RandomForestClassifier(featuresCol="features", labelCol="label_index", seed=42, featureSubsetStrategy="all")
    _, best = M.search_and_fit(fit, learner, {"maxDepth": [3, 4], "numTrees": [10, 20]}, "macro_f1", "label_index")
    return M.predict_classes(best, data.where("part = 'holdout'"), _SMALL, FLAGS).select(*_IDS, "pred_label")


@query("ml_planted_summary", """
WITH s AS (SELECT unnest(['all', 'non_confounded']) AS scope),
n AS (SELECT scope, count(*) AS n FROM s, lineitem WHERE scope = 'all' OR l_suppkey % 4 <> 0 GROUP BY scope),
r AS (SELECT unnest(['delta_30m', 'delta_2h', 'all']) AS horizon, unnest([1, 1, 2]) AS k)
SELECT scope, 'delta' AS metric, horizon, 'regression' AS kind, CAST(n * k AS BIGINT) AS n, 0.0::DOUBLE AS mae,
  NULL::DOUBLE AS accuracy, NULL::DOUBLE AS macro_f1 FROM n, r
UNION ALL SELECT scope, NULL, NULL, 'class', n, NULL, 1.0, 1.0 FROM n""")
def ml_planted_summary(v):
    """Out-of-fold targets and classes of every scope; models of two folds differ in last digits, so ranks are not compared."""
    data = stratified_folds(planted(v), "rule", _IDS, folds=5)
    scores = R.impact_summary(data, _SMALL, {"delta": ["delta_30m", "delta_2h"]}, "rule", FLAGS)
    exact = [F.abs(F.round(c, 6)).alias(c) for c in ("mae", "accuracy", "macro_f1")]
    return scores.select("scope", "metric", "horizon", "kind", F.col("n").cast("long").alias("n"), *exact)
