"""Prompts, answers, retrieval and learned baselines."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import inference as I
from tidegauge.operators import learned as M
from tidegauge.operators import retrieval as X
from tidegauge.plans import evaluate as E
from tidegauge.plans import learned_reports as R

import __spark_entry__ as entry


def answers(spark, *raw):
    return spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")


def test_grades(spark):
    rows = answers(spark, '{"grade": 4}', "Grade: 3 of 5", "no idea", '{"grade": 9}', "15", "", None)
    got = [(r.grade, r.parse_error) for r in I.parsed_grade(rows, "raw").orderBy("i").collect()]
    assert got == [(4, False), (3, False), (2, True), (2, True), (2, True), (2, True), (2, True)]


def test_labels(spark):
    rows = answers(spark, '{"decay_class": " Sustained"}', "a reversal, not transient", "??", '{"decay_class": "odd"}')
    parsed = I.parsed_label(rows, "raw", "decay_class", ["transient", "sustained", "reversal"], "transient")
    assert [(r.label, r.parse_error) for r in parsed.orderBy("i").collect()] == [
        ("sustained", False), ("transient", False), ("transient", True), ("transient", True)]


def test_rankings(spark):
    rows = answers(spark, "3,1,2", "2, 2, 9", "none")
    got = I.parsed_ranking(rows, "raw", F.lit(3)).orderBy("i").collect()
    assert [r.ranking for r in got] == [[3, 1, 2], [2, 1, 3], [1, 2, 3]]
    assert [r.parse_error for r in got] == [False, False, True]


def test_deltas_are_clamped_and_incomplete_is_an_error(spark):
    rows = answers(spark, 'ok {"delta_30m": 0.9, "delta_2h": -0.9, "delta_6h": 0.1} ok', '{"delta_30m": 0.1}')
    got = I.parsed_deltas(rows.withColumn("price", F.lit(0.4)), "raw", "price").orderBy("i").collect()
    assert [got[0].delta_30m, got[0].delta_2h, got[0].delta_6h] == pytest.approx([0.6, -0.4, 0.1])
    assert got[1].parse_error and got[1].delta_30m is None


def test_inner_product_equals_numpy_for_any_blocking(spark, monkeypatch):
    monkeypatch.setattr(X, "QUERY_BLOCK_ROWS", 4)
    monkeypatch.setattr(X, "CANDIDATE_BLOCK_ROWS", 5)
    rng = np.random.default_rng(0)
    q, d = rng.random((11, 6)), rng.random((57, 6))
    make = lambda a, n: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(a)], f"{n} bigint, vec array<double>")
    got = X.topk_inner_product(make(q, "query_id"), make(d, "doc_id"), 4).orderBy("query_id", "rn").collect()
    want = [int(j) for row in q @ d.T for j in np.argsort(-row, kind="stable")[:4]]
    assert [r.doc_id for r in got] == want


def test_block_grid_copies_the_smaller_side():
    copies = lambda q, d, nq, nd: nq * d + nd * q
    for nq, nd, cores in [(9_000_000, 40_000, 4000), (200, 10**9, 4000), (10**8, 10**8, 4000), (50_000, 3000, 800)]:
        q, d = X.block_grid(nq, nd, 4096, 16384, cores)
        assert q * 4096 >= nq and d * 16384 >= nd and q * d >= min(cores, max(nq, nd) // X.LEAST_BLOCK_ROWS)
        assert copies(q, d, nq, nd) <= min(copies(math.ceil(nq / 4096), max(cores, math.ceil(nd / 16384)), nq, nd),
                                           copies(max(cores, math.ceil(nq / 4096)), math.ceil(nd / 16384), nq, nd))
    assert X.block_grid(9_000_000, 40_000, 4096, 16384, 4000)[1] == 3  # not one copy of a query per core
    assert X.block_grid(200, 1800, 4096, 16384, 8) == (1, 8)
    assert X.block_grid(0, 0, 4096, 16384, 8) == (1, 1) and X.block_grid(5, 9, 4096, 16384, 64) == (1, 1)


def test_bm25_in_many_blocks_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 30) if x < 200)
    queries = spark.createDataFrame([(i, text()) for i in range(23)], "query_id bigint, text string")
    docs = spark.createDataFrame([(i, text()) for i in range(150)], "doc_id bigint, text string")
    run = lambda: [(r.query_id, r.doc_id, round(r.score, 9)) for r in X.bm25_topk(queries, docs, 5).orderBy("query_id", "rn").collect()]
    whole = run()
    monkeypatch.setattr(X, "TEXT_QUERY_BLOCK_ROWS", 7)
    monkeypatch.setattr(X, "TEXT_BLOCK_ROWS", 40)
    assert run() == whole and len(whole) > 100


def test_bm25_equals_the_formula(spark):
    docs = ["the cat sat on the mat", "The dog ate the cat!", "birds", "", "cat cat cat dog"]
    queries = ["cat dog", "the", "zebra"]
    got = {(r.query_id, r.doc_id): r.score for r in X.bm25_topk(
        spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string"),
        spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), 3).collect()}
    bags = [Counter(re.findall("[a-z0-9]+", d.lower())) for d in docs]
    mean = sum(map(lambda b: sum(b.values()), bags)) / len(bags)
    want = {}
    for qi, query in enumerate(queries):
        scores = []
        for di, bag in enumerate(bags):
            score = 0.0
            for term in set(query.split()):
                df = sum(term in b for b in bags)
                if bag[term]:
                    score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * bag[term] * 2.2 / (
                        bag[term] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))
            if score > 0:
                scores.append((-round(score, 6), di))
        want.update({(qi, di): -s for s, di in sorted(scores)[:3]})
    assert got == pytest.approx(want)


def test_impact_evaluation_needs_two_pairs(spark):
    gold = spark.createDataFrame([(1, "c", {"2h": 0.5}, {})], "tweet_id bigint, condition_id string, "
                                 "price_impact_json map<string,double>, volume_multiplier_json map<string,double>")
    preds = spark.createDataFrame([(1, "c", 0.4, 2.0)], "tweet_id bigint, condition_id string, price_impact double, volume_multiplier double")
    row = E.evaluate_impact(preds, gold).first()
    assert (row.n_price_impact, row.n_volume_multiplier) == (1, 0)
    assert row.spearman_rho_price_impact is None and row.spearman_rho_volume_multiplier is None


def test_evaluators_on_no_overlap(spark):
    gold = spark.createDataFrame([(1, "transient")], "tweet_id bigint, label string")
    preds = spark.createDataFrame([(2, "transient")], "tweet_id bigint, label string")
    assert E.evaluate_propagation(preds, gold).first().asDict() == {"n": 0, "macro_f1": 0.0}


@pytest.fixture(scope="module")
def learnable(spark):
    rows = [(i, float(i % 10), float((i * 7) % 13), ["low", "mid", "high"][min(2, (i % 10) // 4)], i % 3) for i in range(600)]
    return spark.createDataFrame(rows, "k int, a double, b double, label string, fold int")


def test_multiclass_learns_a_simple_rule(learnable):
    labels = ["low", "mid", "high"]
    predicted, models = M.out_of_fold_classes(learnable, ["a", "b"], "label", labels, folds=3, trees=8)
    rows = predicted.collect()
    assert len(rows) == 600 and sum(r.label == r.pred_label for r in rows) > 560
    assert all(abs(sum(r.scores.values()) - 1) < 1e-9 for r in rows)
    top = M.importances(models, ["a", "b"]).orderBy(F.desc("importance")).first()
    assert top.feature == "a"


def test_regression_and_search(learnable):
    predicted, _ = M.out_of_fold_regression(learnable, ["a", "b"], "a", folds=3, rounds=5)
    rows = predicted.collect()
    assert len(rows) == 600 and sum(abs(r.a - r.pred) for r in rows) / 600 < 0.5
    learner = M.GBTRegressor(featuresCol="features", labelCol="a", seed=1)
    trials = M.search(M.assemble(learnable, ["a", "b"]), learner, {"maxDepth": [1, 3], "maxIter": [2, 4]},
                      "spearman", "a", trials=2, folds=3)
    assert all(r.score > 0.8 for r in trials.collect())


def test_dense_blocks_hold_one_slice_of_scores(monkeypatch):
    """Scores of a block are formed for a slice of its queries at a time, with the same best rows."""
    rng = np.random.default_rng(3)
    q, d = rng.integers(-3, 4, (50, 8)).astype(float), rng.integers(-3, 4, (200, 8)).astype(float)
    seen = []
    best = X._best_of_block
    monkeypatch.setattr(X, "_best_of_block", lambda scores, *a: seen.append(scores.size) or best(scores, *a))
    whole = X._best_of_products(q, d, np.arange(50), np.arange(200), 4, 8)
    assert seen == [50 * 200]
    monkeypatch.setattr(X, "SCORES_AT_ONCE", 1500)
    sliced = X._best_of_products(q, d, np.arange(50), np.arange(200), 4, 8)
    assert max(seen[1:]) <= 1500 and whole.equals(sliced)


@pytest.mark.parametrize("name", ["ml_multiclass", "ml_binary", "ml_early_stop", "ml_regression", "top_importances"])
def test_model_queries_return_sane_rows(name, spark, data):
    rows = entry.queries()[name](spark, data).collect()
    assert rows
    for row in rows:
        values = row.asDict()
        for key in ("accuracy", "macro_f1", "confidence"):
            if key in values:
                assert 0 <= values[key] <= 1


def test_model_queries_do_the_whole_job(spark, data, monkeypatch):
    fits, searches = [], []

    def fit(df, features, target, *args, **options):
        fits.append((target, options))
        return None

    def search(df, learner, space, kind, label, trials=10, folds=5, **options):
        searches.append((kind, trials, folds))
        return df, None

    monkeypatch.setattr(M, "fit_regression", fit)
    monkeypatch.setattr(M, "predict_value", lambda model, rows, features: rows.withColumn("pred", F.lit(0.0)))
    monkeypatch.setattr(M, "fit_multiclass", lambda *args, **options: None)
    monkeypatch.setattr(M, "predict_classes", lambda model, rows, features, labels: rows.withColumn("pred_label", F.lit("A")))
    monkeypatch.setattr(M, "search_and_fit", search)
    summary = entry.queries()["ml_t5_summary"](spark, data).where("kind = 'regression'").collect()
    targets = {f"{m}_{h}" for m in ("price_impact", "volume_multiplier") for h in ("15m", "30m", "1h", "2h", "6h")}
    assert len(fits) == 2 * 10 * 5 and all(o == {} for _, o in fits)  # scopes, targets, folds
    assert {r.horizon for r in summary} == targets | {"all"}
    assert all(r.metric in r.horizon or r.horizon == "all" for r in summary) and len(summary) == 2 * 2 * 6
    fits.clear()
    rows = entry.queries()["ml_regression"](spark, data).collect()
    horizons = ("delta_30m", "delta_2h", "delta_6h")
    assert sorted(fits, key=str) == sorted([(h, {}) for h in horizons] * 2, key=str)
    assert {(r.tier, r.horizon) for r in rows} >= {(t, h) for t in ("all", "non_confounded") for h in horizons}
    for name in ("ml_tune", "ml_tune_classes"):
        entry.queries()[name](spark, data)
    assert searches == [("spearman", 10, 5), ("macro_f1", 20, 5)]


def test_summary_of_planted_targets(spark):
    """Every target and class is a rule that trees find, so each score is known; nothing is replaced."""
    rows = spark.range(360).selectExpr("cast(id % 6 + 1 as double) as x", "cast(id % 5 as int) as fold", "id % 4 = 0 as confound_flag",
                                       "cast(id % 6 + 1 as double) as a", "cast(2 * (id % 6) + 3 as double) as b",
                                       "if(id % 6 < 3, 'lo', 'hi') as label")
    rows = rows.withColumn("b", F.when(F.rand(1) < 2, F.col("b")))  # nullable
    found = {(r.scope, r.metric, r.horizon): r for r in R.impact_summary(
        rows, ["x"], {"one": ["a", "b"], "two": ["b"]}, "label", ["hi", "lo"], trees=5).collect()}
    assert len(found) == 2 * (3 + 2 + 1)
    for (scope, metric, horizon), r in found.items():
        n = 360 if scope == "all" else 270
        if metric is None:
            assert r.accuracy == r.macro_f1 == 1 and r.n == n
        else:
            assert r.mae < 1e-9 and r.n == n * (2 if (metric, horizon) == ("one", "all") else 1)
            assert r.spearman > 0.95  # last digits differ between folds


def test_first_failure_ends_the_fits(spark):
    def fail():
        raise ValueError("no fit")

    assert M.run_together(spark, [lambda i=i: spark.range(i).count() for i in range(12)]) == list(range(12))
    with pytest.raises(ValueError, match="no fit"):
        M.run_together(spark, [fail, *[lambda: spark.range(10).count()] * 6], at_once=2)


def test_cells_of_many_equal_vectors_are_fitted_as_one_row(spark):
    """The same trees and scores from a weight per cell; a feature of more values than bins is cut, with its order kept."""
    rows = spark.range(6000).selectExpr("cast(id % 6 as double) as x", "cast(id % 4 as double) as z", "cast(id % 5 as int) as fold",
                                        "id % 7 = 0 as stop_on", "cast(id % 6 * 2 + id % 7 as double) as y",
                                        "if(id % 6 < 3, 'lo', 'hi') as label", "cast(id as double) as long_one")
    features = ["x", "z"]
    table = M.prepared(rows, features)
    cells = M.condensed(table, ["fold"], ["y"], size=5)
    assert M.weight_of(cells) == "__rows" and cells.count() == 60 and cells.agg(F.sum("__rows")).first()[0] == 6000
    assert M.weight_of(M.condensed(M.assemble(rows, features))) is None
    plain, short = (M.fit_regression(t, features, "y") for t in (M.assemble(rows, features), table))
    got = [M.predict_value(m, rows.dropDuplicates(["x", "z"]), features).orderBy("x", "z").collect() for m in (plain, short)]
    assert all(abs(a.pred - b.pred) < 1e-9 for a, b in zip(*got))
    classes = M.fit_boosted_classes(table, features, "label", ["hi", "lo"], rounds=30, stop_on="stop_on")
    assert M.predict_classes(classes, table, features, ["hi", "lo"]).where("label <> pred_label").isEmpty()
    cut = M.prepared(rows, ["long_one"])
    pairs = cut.select("long_one", M.vector_to_array("features")[0].alias("b")).orderBy("long_one").collect()
    assert len({r.b for r in pairs}) <= M.BINS and [r.b for r in pairs] == sorted(r.b for r in pairs)
    assert not cut.schema["features"].metadata["ml_attr"].get("attrs", {}).get("nominal")


def test_trials_of_equal_parameters_are_fitted_once(spark, monkeypatch):
    rows = spark.range(400).selectExpr("cast(id % 8 as double) as x", "cast(id % 5 as int) as fold", "cast(id % 8 > 3 as double) as y")
    fits = []
    monkeypatch.setattr(M, "_fit", lambda learner, rows, fit=M._fit: fits.append(1) or fit(learner, rows))
    learner = M.RandomForestClassifier(featuresCol="features", labelCol="y", seed=1, numTrees=3)
    found = M.search(M.assemble(rows, ["x"]), learner, {"maxDepth": [2, 3]}, "macro_f1", "y", trials=7, folds=5)
    trials = found.collect()
    assert len(trials) == 7 and len(fits) == 2 * 5 + 1
    assert all(len({t.score for t in trials if t.maxDepth == d}) == 1 for d in ("2", "3"))
