"""Boosted trees of many fits at once, held against Spark's learner."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidegauge.operators import boosting as B
from tidegauge.operators import learned as M

FEATURES = ["a", "b", "c"]


def table(spark, n):
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 50, n).astype(float), rng.random(n) * 100, rng.integers(-2, 3, n).astype(float)
    y = a * 3 + np.where(b > 40, 20, -5) * c + rng.normal(0, 4, n)
    rows = [(i % 5, *map(float, r)) for i, r in enumerate(zip(a, b, c, y, 1 + rng.integers(0, 4, n)))]
    return M.assemble(spark.createDataFrame(rows, "fold int, a double, b double, c double, y double, w double"), FEATURES).repartition(3).cache()


def spark_says(rows, weight=None, **options):
    learner = GBTRegressor(featuresCol="features", labelCol="y", **options)
    model = (learner.setWeightCol(weight) if weight else learner).fit(rows)
    return model, np.array([r.prediction for r in model.transform(rows).select("prediction").collect()])


@pytest.mark.parametrize("n", [20, 3000, 14000])  # fewer rows than bins, all rows as candidates, a sample of them
def test_the_trees_are_those_of_sparks_learner(spark, n):
    rows = table(spark, n)
    models = [B.BoostedRegression(B.Part(rows, F.col("fold") != i), "y", rounds, depth, step)
              for i, rounds, depth, step in ((0, 4, 4, 0.1), (0, 2, 4, 0.1), (1, 3, 2, 0.3), (2, 2, 6, 0.1))]
    B.fit_all(models)
    for m in models:
        learning = m.part.rows()
        own = np.array([r.prediction for r in m.transform(learning).select("prediction").collect()])
        model, want = spark_says(learning, maxIter=m.rounds, maxDepth=m.depth, stepSize=m.step, seed=42)
        assert m.getNumTrees == m.rounds and np.allclose(own, want, rtol=1e-9, atol=1e-9)
        if n > 20:  # features that part a few rows equally well are taken in either order
            assert np.allclose(m.featureImportances, model.featureImportances.toArray(), atol=1e-9)


def test_weights_count(spark):
    rows = table(spark, 2000)
    model = B.BoostedRegression(B.Part(rows), "y", 3, 3, weight="w")
    B.fit_all([model])
    own = np.array([r.prediction for r in model.transform(rows).select("prediction").collect()])
    assert np.allclose(own, spark_says(rows, "w", maxIter=3, maxDepth=3, seed=42)[1], rtol=1e-9)


def test_fits_of_a_table_share_its_jobs_and_keep_no_rows(spark, monkeypatch):
    """One job per level of a round whatever the number of fits; sums beyond the driver's are added by tasks."""
    rows, jobs = table(spark, 1500), []
    monkeypatch.setattr(B, "_sums", lambda *a, f=B._sums: jobs.append(1) or f(*a))
    models = [M.fit_regression(B.Part(rows, F.col("fold") != i), FEATURES, "y", 3, 2) for i in range(5)]
    assert not any(m.trees for m in models)
    rows.count()
    kept = set(spark.sparkContext._jsc.getPersistentRDDs())
    B.fit_all(models)
    assert len(jobs) == 3 * 2 and set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept
    monkeypatch.setattr(B, "DRIVER_BYTES", 0)
    again = [M.fit_regression(B.Part(rows, F.col("fold") != i), FEATURES, "y", 3, 2) for i in range(5)]
    B.fit_all(again)
    for one, two in zip(models, again):
        assert all(np.array_equal(s.feature, t.feature) and np.allclose(s.value, t.value) for s, t in zip(one.trees, two.trees))


def test_each_fold_is_scored_by_its_own_model(spark):
    rows = table(spark, 900)
    models = [M.fit_regression(B.Part(rows, F.col("fold") != i), FEATURES, "y", 2, 2) for i in range(5)]
    B.fit_all(models)
    got = {(r.fold, r.a, r.b): r.prediction for r in B.OutOfFold(models, "fold").transform(rows).collect()}
    for i, m in enumerate(models):
        for r in m.transform(rows.where(F.col("fold") == i)).collect():
            assert got[r.fold, r.a, r.b] == r.prediction


def test_rows_no_learner_takes_raise(spark):
    rows = table(spark, 300)
    holes = rows.withColumn("y", F.when(F.col("fold") > 0, F.col("y")))
    with pytest.raises(ValueError, match="targets must be"):
        M.fit_regression(holes, FEATURES, "y")
    assert M.fit_regression(holes.where("fold > 0"), FEATURES, "y", 1, 1).getNumTrees == 1
    with pytest.raises(ValueError, match="no rows"):
        M.fit_regression(rows.where("fold > 9"), FEATURES, "y")


def forest_rows(spark, n):
    rng = np.random.default_rng(8)
    rows = [(i % 5, float(rng.integers(0, 40)), float(rng.random() * 9), float(rng.integers(0, 3))) for i in range(n)]
    kinds = "fold int, a double, b double, c double"
    df = spark.createDataFrame(rows, kinds).withColumn("y", F.when(F.col("a") < 12, 0.0).when(F.col("b") > 5, 1.0).otherwise(2.0))
    return M.assemble(df, FEATURES).repartition(3).cache()


def test_forests_learn_as_sparks_do_and_small_ones_are_parts_of_large_ones(spark, monkeypatch):
    rows, jobs = forest_rows(spark, 6000), []
    monkeypatch.setattr(B, "_sums", lambda *a, f=B._sums: jobs.append(1) or f(*a))
    part = B.Part(rows, F.col("fold") != 0)
    small, large, deep = (B.Forest(part, "y", 3, n, d) for n, d in ((5, 2), (12, 4), (12, 6)))
    B.fit_forests([small, large, deep])
    assert len(jobs) == 6
    alone = B.Forest(B.Part(rows, F.col("fold") != 0), "y", 3, 5, 2)
    B.fit_forests([alone])
    for one, two in zip(alone.trees, small.trees):
        assert np.array_equal(one.feature, two.feature) and np.allclose(one.sums, two.sums)
    held = rows.where("fold = 0")
    for m in (small, large, deep):
        learner = M.RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=m.count, maxDepth=m.depth, seed=42)
        right = [d.where("prediction = y").count() / held.count() for d in (m.transform(held), learner.fit(part.rows()).transform(held))]
        assert right[0] > right[1] - 0.12 and (m.depth == 2 or right[0] > 0.95)
    assert abs(sum(deep.featureImportances) - 1) < 1e-9 and np.argmin(deep.featureImportances) == 2
    shares = deep.transform(held).select("__shares", "prediction").collect()
    assert all(abs(sum(r[0]) - 1) < 1e-9 and r[0][int(r[1])] == max(r[0]) for r in shares)


def test_a_tree_alone_is_sparks_tree(spark):
    """Without draws and with all features nothing is random; class weights count."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    rows = forest_rows(spark, 4000).drop("features").withColumns({"a": F.col("a") % 30, "b": F.floor("b").cast("double")})
    rows = M.assemble(rows, FEATURES).withColumn("w", F.element_at(F.array(F.lit(1.0), F.lit(3.0), F.lit(0.5)), (F.col("y") + 1).cast("int")))
    model = B.Forest(B.Part(rows), "y", 3, 1, 3, "all", bootstrap=False, class_weights=[1.0, 3.0, 0.5])
    B.fit_forests([model])
    want = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=1, maxDepth=3, featureSubsetStrategy="all",
                                  bootstrap=False, weightCol="w", seed=42).fit(rows).transform(rows)
    want = [r[0] for r in want.select(vector_to_array("probability")).collect()]
    got = [r[0] for r in model.transform(rows).select("__shares").collect()]
    assert np.allclose(got, want)
