"""Hand-worked and degenerate metric cases."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import labels as L
from tidegauge.operators import baselines as B
from tidegauge.operators import metrics as M
from tidegauge.operators import ranking as R
from tidegauge.operators import rows as W


def pairs(spark, rows, kind="string"):
    return spark.createDataFrame(rows, f"gold {kind}, pred {kind}")


def numbers(spark, rows):
    return spark.createDataFrame(rows, "x double, y double")


def confusion(spark, rows, kind="string"):
    return M.confusion_matrix(pairs(spark, rows, kind), "gold", "pred")


def test_macro_f1_counts_absent_class_as_zero(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b")]
    value = M.macro_f1(confusion(spark, rows), ["a", "b", "c"]).first()["macro_f1"]
    assert math.isclose(value, (2 / 3 + 2 / 3 + 0) / 3)
    seen = M.macro_f1(confusion(spark, rows)).first()["macro_f1"]
    assert math.isclose(seen, 2 / 3)


def test_class_metrics_of_empty_input(spark):
    empty = confusion(spark, [])
    assert M.macro_f1(empty, ["a"]).first()["macro_f1"] == 0.0
    assert M.accuracy(empty).first().asDict() == {"n": 0, "accuracy": 0.0}
    report = M.class_report(empty, ["a", "b"]).first()
    assert (report["n"], report["accuracy"], report["macro_f1"]) == (0, 0.0, 0.0)


def test_null_prediction_is_a_miss(spark):
    report = M.class_report(confusion(spark, [("a", None), ("a", "a")]), ["a"]).first()
    assert report["n"] == 2 and report["accuracy"] == 0.5


@pytest.mark.parametrize("rows,want", [
    ([], 0.0), ([(3, 3), (3, 3)], 1.0), ([(0, 0), (5, 5), (2, 2)], 1.0), ([(0, 5), (5, 0)], -1.0)])
def test_kappa_edges(spark, rows, want):
    assert math.isclose(M.quadratic_kappa(confusion(spark, rows, "int")).first()["qwk"], want)


@pytest.mark.parametrize("rows", [[], [(1.0, 2.0)], [(1.0, 1.0), (1.0, 2.0)], [(1.0, 3.0), (2.0, 3.0)]])
def test_degenerate_correlation(spark, rows):
    for function, name in ((M.spearman, "spearman"), (M.pearson, "pearson")):
        assert function(numbers(spark, rows), "x", "y").first()[name] is None
        assert function(numbers(spark, rows), "x", "y", degenerate=0.0).first()[name] == 0.0


def test_spearman_ignores_null_and_nan_and_equals_pandas(spark):
    rng = random.Random(7)
    rows = [(float(rng.randint(0, 9)), rng.choice([rng.random(), 0.5])) for _ in range(500)]
    bad = [(None, 1.0), (float("nan"), 2.0), (3.0, None)]
    got = M.spearman(numbers(spark, rows + bad), "x", "y").first()
    frame = pd.DataFrame(rows, columns=["x", "y"])
    assert got["n"] == 500
    assert math.isclose(got["spearman"], frame.x.rank().corr(frame.y.rank()), abs_tol=1e-12)


def test_spearman_is_unchanged_by_monotone_maps_and_buckets(spark):
    rng = random.Random(1)
    rows = numbers(spark, [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(300)])
    base = M.spearman(rows, "x", "y").first()["spearman"]
    mapped = M.spearman(rows.withColumn("x", F.exp("x")), "x", "y").first()["spearman"]
    assert math.isclose(base, mapped, abs_tol=1e-12)


@pytest.mark.parametrize("buckets", [2, 3, 8, 37])
def test_rank_with_a_hot_value_in_any_bucket_count(spark, buckets):
    """One value holds a third of all rows; ranks stay exact for any bucket count."""
    rng = random.Random(buckets)
    values = [5.0] * 400 + [rng.random() * 10 for _ in range(800)]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "v double, s int")
    got = R.cumulative_counts(df, "v", ["s"], buckets=buckets).toPandas()
    frame = pd.DataFrame({"v": values, "s": [i % 2 for i in range(len(values))]})
    want = frame.assign(r=frame.groupby("s").v.rank(method="max")).drop_duplicates(["s", "v"])
    both = got.merge(want, on=["s", "v"])
    assert len(both) == len(want) == len(got)
    assert (both.n_upto == both.r).all()
    assert got.groupby("s").n.sum().equals(got.groupby("s").n_total.max())


def test_exact_quantiles_equal_pandas(spark):
    rng = random.Random(3)
    frame = pd.DataFrame({"g": [rng.choice("ab") for _ in range(301)], "v": [rng.random() for _ in range(301)]})
    got = R.exact_quantiles(spark.createDataFrame(frame), "v", {"q40": 0.4, "med": 0.5}, ["g"]).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        assert math.isclose(got.loc[g, "q40"], part.v.quantile(0.4))
        assert math.isclose(got.loc[g, "med"], part.v.median())
    small = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert R.exact_quantiles(small, "v", {"m": 0.5}).first()["m"] == 2.5


def test_ranked_list_metrics(spark):
    rows = spark.createDataFrame([(["a", "b"], "a"), (["a", "b"], "b"), (["a", "b"], "z"), ([], "a")],
                                 "ranked array<string>, gold string")
    assert M.accuracy_at_1(rows, "ranked", "gold").first()["acc_at_1"] == 0.25
    assert M.mean_reciprocal_rank(rows, "ranked", "gold").first()["mrr"] == pytest.approx(1.5 / 4)
    k = M.mean_reciprocal_rank(rows, "ranked", "gold", "k_plus_1", 2).first()["mrr"]
    assert k == pytest.approx((1 + 0.5 + 1 / 3 + 1 / 3) / 4)


def test_majority_tie_takes_smaller_label(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "label string")
    best = B.majority(rows, "label").first()
    assert (best["majority_label"], best["n"], best["accuracy"]) == ("a", 4, 0.5)
    assert best["macro_f1"] == pytest.approx(2 * 0.5 / 1.5 / 2)


def test_label_rules_at_the_edges(spark):
    rows = spark.createDataFrame([(0.05,), (0.02,), (-0.02,), (0.08,), (-0.0800001,), (None,)], "d double")
    got = [tuple(r) for r in rows.select(L.direction(F.col("d")), L.magnitude(F.col("d")),
                                         L.sign_direction(F.col("d"))).collect()]
    assert got == [("up", "medium", "up"), ("flat", "small", "up"), ("flat", "small", "down"),
                   ("up", "medium", "up"), ("down", "large", "down"), (None, None, None)]
    decay = spark.createDataFrame([(0.05, 0.005), (0.03, 0.06), (0.06, -0.04), (0.05, 0.03), (0.05, -0.01)],
                                  "a double, b double")
    assert [r[0] for r in decay.select(L.decay_class(F.col("a"), F.col("b"))).collect()] == [
        "transient", "sustained", "reversal", None, "transient"]


def test_confounded_null_rule(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, confound_flag boolean")
    assert [r.id for r in W.non_confounded(rows).collect()] == [2]
    assert [r.id for r in W.non_confounded(rows, null_as=False).orderBy("id").collect()] == [2, 3]


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="missing columns"):
        W.require_columns(spark.range(1), ["id", "close"])


def test_absent_class_and_silent_scope_score_zero(spark):
    from tidegauge.operators import metrics as M

    counts = spark.createDataFrame([("s", "a", "a", 3), ("t", "a", "b", 2)], "scope string, gold string, pred string, n bigint")
    f1 = {r.scope: (r.support, r.predicted, r.f1) for r in M.class_f1(counts, "z", ["scope"]).collect()}
    assert f1 == {"s": (0, 0, 0.0), "t": (0, 0, 0.0)}
    precision = {r.scope: (r.predicted, r.class_precision) for r in M.class_precision(counts, "b", ["scope"]).collect()}
    assert precision == {"s": (0, 0.0), "t": (2, 0.0)}


def test_null_group_is_not_the_total(spark):
    from tidegauge.operators import metrics as M

    rows = spark.createDataFrame([("a", 1.0, 2.0), (None, 1.0, 4.0)], "g string, x double, y double")
    got = {r.g: (r.n, r.mae) for r in M.regression_error(rows, "x", "y", "g").collect()}
    assert got == {"a": (1, 1.0), None: (1, 3.0), "all": (2, 2.0)}


def test_null_labels_are_never_drawn(spark):
    from tidegauge.operators.baselines import random_prior_draws

    rows = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(40)], "k int, label string")
    assert random_prior_draws(rows, "label", ["k"]).where("pred is null or pred <> 'a'").count() == 0


def test_counts_stay_integers_in_json(spark):
    from tidegauge.plans.evaluate import metrics_json

    rows = spark.createDataFrame([("t", "n", 15000.0), ("t", "n_x", 2.0), ("t", "f1", 1.0), ("t", "rho", None)],
                                 "task string, metric string, value double")
    assert metrics_json(rows).first().record == '{"f1":1.0,"n":15000,"n_x":2,"rho":null}'


def test_whole_number_keys_join_as_numbers(spark):
    """Keys come out as text, a side dealt out by its key is not dealt out again, and gold is checked whole."""
    from tidegauge.operators.joins import join_pred_gold

    preds = spark.range(40).selectExpr("id % 9 as k", "id as v").groupBy("k").agg(F.max("v").alias("guess"))
    gold = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (7, 1, "c"), (70, 1, "d"), (None, 1, "e")], "k long, at int, label string")
    joined = join_pred_gold(preds.withColumn("k", F.col("k").cast("int")), gold, ["k"], "at")
    assert dict(joined.dtypes)["k"] == "string" and joined.columns == ["k", "guess", "gold_label"]
    assert sorted(map(tuple, joined.collect())) == [("1", 37, "b"), ("7", 34, "c")]
    text = join_pred_gold(preds.withColumn("k", F.col("k").cast("string")), gold, ["k"], "at")
    assert sorted(map(tuple, text.collect())) == sorted(map(tuple, joined.collect()))

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join_pred_gold(preds, gold, ["k"], "at")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the group of the predictions, and gold
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

    with pytest.raises(Exception, match="repeated key"):  # also where no prediction can have that key
        join_pred_gold(preds.where("k % 9 <> 1"), gold.where("k = 1 or k = 7"), ["k"]).collect()


def test_impact_joins_numbers(spark, monkeypatch):
    from tidegauge.plans import evaluate as E

    kinds, join = [], E.join_pred_gold

    def watched(preds, gold, keys, order, columns):
        kinds.extend(dict(gold.dtypes)[c] for c in columns)
        return join(preds, gold, keys, order, columns)

    monkeypatch.setattr(E, "join_pred_gold", watched)
    gold = spark.createDataFrame([(1, 1, '{"2h": 3}', "{}"), (2, 1, '{"6h": 3}', "bad"), (3, 1, '{"2h": 5}', '{"2h": null}'),
                                  (4, 1, None, '{"2h": 2}')],
                                 "tweet_id long, condition_id long, price_impact_json string, volume_multiplier_json string")
    preds = spark.createDataFrame([(1, 1, 2.0, 1.0), (2, 1, 1.0, 1.0), (3, 1, 3.0, 1.0), (4, 1, 9.0, 2.0)],
                                  "tweet_id long, condition_id long, price_impact double, volume_multiplier double")
    found = E.evaluate_impact(preds, gold).first()
    assert kinds == ["double", "double"]
    assert (found["n_price_impact"], found["n_volume_multiplier"]) == (3, 2)
    assert math.isclose(found["spearman_rho_price_impact"], 1) and math.isclose(found["spearman_rho_volume_multiplier"], 1)


def test_evaluators_without_a_weight(spark):
    from tidegauge.operators import learned

    rows = spark.createDataFrame([(0.0, 0.0, 3), (1.0, 1.0, 1), (1.0, 0.0, 1)], "label double, prediction double, w long")
    for kind, plain, weighted in (("accuracy", 2 / 3, 0.8), ("macro_f1", 2 / 3, (6 / 7 + 2 / 3) / 2)):
        assert math.isclose(learned.objective(kind, "label").evaluate(rows), plain)
        assert math.isclose(learned.objective(kind, "label", "w").evaluate(rows), weighted)
