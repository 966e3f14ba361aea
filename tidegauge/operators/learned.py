"""Learned baselines on Spark ML.

The tree learner is Spark's own (distributed histograms), so scores differ from
other libraries; the jobs - fit, out-of-fold prediction, search, early stop,
importances - are the same.
"""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import partial, reduce
from math import prod

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol, HasWeightCol
from pyspark.ml.regression import GBTRegressor, Regressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.operators.boosting import DEEPEST, BoostedRegression, Forest, OutOfFold, Part, fit_all, fit_forests, out_of_fold_predictions
from tidegauge.operators.metrics import confusion_matrix, macro_f1, spearman
from tidegauge.operators.ranking import cumulative_counts
from tidegauge.operators.rows import balanced_weights, index_labels
from tidegauge.sources.tables import materialize


#: Fits that run at the same time; their tasks share the cluster.
FITS_AT_ONCE = 8
#: Rows of all fits that run at the same time; a fit keeps about 170 bytes of each row in the executors.
ROWS_AT_ONCE = 64_000_000
#: Rows of a prepared table per task of a fit, so that small tables are not cut into tiny tasks, and the most
#: of them, so that no task of a large one holds much.
ROWS_PER_TASK, MOST_ROWS_PER_TASK = 50_000, 500_000
#: Rows of a prepared table from which forests are grown together, over blocks; on smaller ones Spark's learner fits each.
FOREST_ROWS = 200_000
#: Values of a feature that a tree tells apart: the bins of Spark's learners.
BINS = 32
#: Rows per cell that can exist from which a table is condensed, and the parts of a cell that a forest draws.
ROWS_PER_CELL, PARTS = 2, 64


def run_together(spark: SparkSession, jobs: Sequence[Callable], at_once: int = FITS_AT_ONCE) -> list:
    """Results of functions that run Spark jobs, ``at_once`` at a time, in their order.

    The threads inherit the caller's job properties. The first failure cancels
    the jobs of all others and is raised.
    """
    context, tag = spark.sparkContext, f"fits-{uuid.uuid4().hex}"

    def tagged(job: Callable):
        context.addJobTag(tag)
        try:
            return job()
        finally:
            context.removeJobTag(tag)

    with ThreadPoolExecutor(at_once) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(partial(tagged, job))) for job in jobs]
        failed = [r for r in wait(running, return_when=FIRST_EXCEPTION).done if r.exception()]
        if failed:
            for r in running:
                r.cancel()
            context.cancelJobsWithTag(tag)
            raise failed[0].exception()
        return [r.result() for r in running]


def prepared(df: DataFrame, features: Sequence[str], merge: bool = False) -> DataFrame:
    """The table with its ``features`` vector, written once for many fits.

    The metadata of the vector names its ``rows`` and, where they are few for
    these, the ``cells``: the vectors that can exist, the product of the values
    of each feature, at most ``BINS`` of them. Equal rows of such a table are
    fitted as one with a weight (``condensed``). Features with more values than
    bins are cut into quantile bins first, so models of such a table score its own rows.
    With ``merge`` small parts are merged first, after a count: shuffled tables have many.
    """
    wide = assemble(df, features)
    table = materialize(wide.coalesce(max(1, -(-df.count() // ROWS_PER_TASK))) if merge else wide)
    values = vector_to_array("features")
    width = len(features)
    found = table.agg(F.count(F.lit(1)), *[F.approx_count_distinct(values[i]) for i in range(width)]).first()
    rows, different = found[0], found[1:]
    known = {"rows": rows}
    cells = prod(min(max(n, 1), BINS) for n in different)
    if cells * ROWS_PER_CELL <= rows:
        known["cells"] = cells
        many = [i for i, n in enumerate(different) if n > BINS]
        if many:
            table = materialize(_binned(table, width, many))
    sized = table.withMetadata("features", {**table.schema["features"].metadata, **known})
    tasks = table.rdd.getNumPartitions()
    if rows > tasks * MOST_ROWS_PER_TASK:
        return sized.repartition(-(-rows // MOST_ROWS_PER_TASK))
    return sized


def _binned(table: DataFrame, width: int, many: Sequence[int]) -> DataFrame:
    """The table with the features of these places replaced by the numbers of their quantile bins; NaN is the last."""
    values = vector_to_array("features")
    wide = table.withColumns({f"__f{i}": values[i] for i in range(width)})
    names = [f"__f{i}" for i in many]
    known = wide.select(*[F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names])
    cuts = known.approxQuantile(names, [i / (BINS - 1) for i in range(1, BINS - 1)], 1e-3)
    edges = [[-float("inf"), *sorted(set(c)), float("inf")] for c in cuts]
    bins = Bucketizer(splitsArray=edges, inputCols=names, outputCols=[f"{n}b" for n in names], handleInvalid="keep")
    cut = bins.transform(wide.drop("features"))
    cut = cut.withColumns({n: F.col(f"{n}b").alias(n, metadata={}) for n in names})  # ordered, not categories
    inputs = [f"__f{i}" for i in range(width)]
    return assemble(cut, inputs).drop(*inputs, *[f"{n}b" for n in names])


def condensed(train: DataFrame, keys: Sequence[str] = (), means: Sequence[str] = (), weight: str | None = None,
              size: int = 1, forest: bool = False, seed: int = 42) -> DataFrame:
    """Rows of a prepared table with equal vectors and ``keys`` as one; the metadata of the vector names their weight.

    ``means`` are averaged. A learner that sees a row through its bins, and its
    target through weighted sums, fits the same trees. ``size`` is the number of
    different ``keys``. A forest also draws rows: there a cell is dealt to up to
    ``PARTS`` rows, which are drawn one by one. Tables with many cells stay as they are.
    """
    known = train.schema["features"].metadata
    room = known["rows"] // (known["cells"] * size * ROWS_PER_CELL) if "cells" in known and "weight" not in known else 0
    if not room:
        return train
    values, names = vector_to_array("features"), [f"__f{i}" for i in range(known["ml_attr"]["num_attrs"])]
    wide = train.select(*keys, *means, *([weight] if weight else []), values.alias("__v")).select(
        "*", *[F.col("__v")[i].alias(n) for i, n in enumerate(names)]).drop("__v")
    groups = [*names, *keys]
    if forest:
        wide, groups = wide.withColumn("__deal", F.floor(F.rand(seed) * min(room, PARTS))), [*groups, "__deal"]
    total = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)
    cells = materialize(assemble(wide.groupBy(*groups).agg(
        total.alias("__rows"), *[F.avg(m).alias(m) for m in means]), names).drop(*names))
    cells = cells.withMetadata("features", {**known, "weight": "__rows"})
    most = known["cells"] * size
    return cells if most <= MOST_ROWS_PER_TASK else cells.repartition(-(-most // MOST_ROWS_PER_TASK))


def large(table: DataFrame) -> bool:
    """Whether a prepared table is one whose forests are grown together."""
    known = table.schema["features"].metadata
    return "cells" not in known and known.get("rows", 0) >= FOREST_ROWS


def weight_of(rows: DataFrame) -> str | None:
    """The column that says for how much a row of a condensed table stands."""
    return rows.schema["features"].metadata.get("weight")


def fits_at_once(df: DataFrame) -> int:
    """Fits of a prepared table that run together: as many as the memory of executors holds rows for."""
    known = df.schema["features"].metadata
    if "cells" in known or "rows" not in known:
        return FITS_AT_ONCE
    return max(1, min(FITS_AT_ONCE, ROWS_AT_ONCE // max(1, known["rows"])))


def _fit(learner, rows: DataFrame) -> Model:
    weight = weight_of(rows)
    return learner.fit(rows, {learner.weightCol: weight} if weight else None)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the ``features`` vector, unless the table is ``prepared``."""
    if "features" in df.columns:
        return df
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def _feature_names(df: DataFrame) -> list[str]:
    """Names of the entries of the ``features`` vector."""
    attributes = df.schema["features"].metadata["ml_attr"]
    groups = attributes.get("attrs", {})
    named = {a["idx"]: a.get("name") for group in groups.values() for a in group}
    return [named.get(i) or str(i) for i in range(attributes["num_attrs"])]


def label_name(index: Column, labels: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in labels]), index.cast("int"))


def fit_multiclass(train: DataFrame, features: Sequence[str], label: str, labels: Sequence[str],
                   weight: str | None = None, trees: int = 20, depth: int = 5, seed: int = 42) -> Model:
    learner = RandomForestClassifier(featuresCol="features", labelCol="label_index", numTrees=trees,
                                     maxDepth=depth, seed=seed)
    rows = index_labels(assemble(train, features), label, labels)
    rows = condensed(rows, ["label_index"], weight=weight, size=len(labels), forest=True, seed=seed)
    return _fit(learner.setWeightCol(weight) if weight else learner, rows)


@dataclass
class BoostedClasses:
    """One boosted binary model per class; scores are the normalised probabilities."""

    models: list[Model]

    def transform(self, df: DataFrame) -> DataFrame:
        names = [f"__p{i}" for i in range(len(self.models))]
        for name, model in zip(names, self.models):
            df = model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop(
                "rawPrediction", "probability", "prediction")
        total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
        shares = F.array(*[F.coalesce(F.try_divide(F.col(n), total), F.lit(1.0 / len(names))) for n in names])
        return df.withColumn("__shares", shares).withColumn(
            "prediction", F.array_position("__shares", F.array_max("__shares")) - 1).drop(*names)


def fit_boosted_classes(train: DataFrame, features: Sequence[str], label: str, labels: Sequence[str],
                        rounds: int = 20, depth: int = 4, seed: int = 42, stop_on: str | None = None) -> BoostedClasses:
    """Boosted trees for several classes, one against the rest; ``stop_on`` marks hold-out rows for early stopping.

    The classes are fitted together.
    """
    known = condensed(assemble(train.where(F.col(label).isin(list(labels))), features),
                      [label, *([stop_on] if stop_on else [])], size=2 * len(labels))
    return BoostedClasses(run_together(train.sparkSession, [
        partial(fit_binary, known.withColumn("__is", F.when(F.col(label) == name, 1.0).otherwise(0.0)), features, "__is",
                rounds, depth, seed, stop_on) for name in labels], fits_at_once(known)))


def balanced_forests(table: DataFrame, parts: Sequence[Part], label: str, labels: Sequence[str], trees: int = 20,
                     depth: int = 5, seed: int = 42) -> list[Forest]:
    """Forests with balanced class weights of parts of a large prepared table, grown together."""
    counts = table.groupBy(label).agg(*[F.count_if(p.keep).alias(f"n{i}") for i, p in enumerate(parts)]).collect()
    rows = index_labels(table, label, labels)
    models = []
    for i, part in enumerate(parts):
        seen = {r[label]: r[f"n{i}"] for r in counts if r[f"n{i}"]}
        weights = [sum(seen.values()) / (len(seen) * seen[name]) if name in seen else 0.0 for name in labels]
        models.append(Forest(Part(rows, part.keep), "label_index", len(labels), trees, depth, seed=seed, class_weights=weights))
    fit_forests(models)
    return models


def predict_classes(model: Model | BoostedClasses, rows: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Attach ``pred_label``, ``confidence`` and the per-class ``scores`` map."""
    scored = model.transform(assemble(rows, features))
    probs = F.col("__shares") if isinstance(model, (BoostedClasses, Forest)) else vector_to_array("probability")
    scores = F.map_from_arrays(F.array(*[F.lit(n) for n in labels]), F.slice(probs, 1, len(labels)))
    return scored.withColumns({"pred_label": label_name(F.col("prediction"), labels),
                               "confidence": F.array_max(probs), "scores": scores}).drop(
        "features", "rawPrediction", "probability", "prediction", "__shares")


def fit_binary(train: DataFrame, features: Sequence[str], target: str, rounds: int = 10, depth: int = 4,
               seed: int = 42, stop_on: str | None = None) -> Model:
    """Boosted trees for a 0/1 target; ``stop_on`` marks hold-out rows for early stopping."""
    learner = GBTClassifier(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)
    if stop_on:
        learner = learner.setValidationIndicatorCol(stop_on)
    keys = [target, stop_on] if stop_on else [target]
    return _fit(learner, condensed(assemble(train, features), keys, size=2 ** len(keys)))


def fit_regression(train: DataFrame | Part, features: Sequence[str], target: str, rounds: int = 10, depth: int = 4,
                   seed: int = 42) -> BoostedRegression | Model:
    """Boosted trees for a number. The model of a ``Part`` is fitted by ``fit_all``, together with others of its table."""
    part = train if isinstance(train, Part) else Part(condensed(assemble(train, features), means=[target]))
    if depth > DEEPEST:
        learner = GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)
        return _fit(learner, part.rows())
    model = BoostedRegression(part, target, rounds, depth, seed=seed, weight=weight_of(part.table))
    if part is not train:
        fit_all([model])
    return model


def learning_part(table: DataFrame, keep: Column, means: Sequence[str]) -> Part:
    """The rows of a prepared table that a fit learns from, condensed where their vectors are few."""
    cells = condensed(table.where(keep), means=means)
    return Part(table, keep) if weight_of(cells) is None else Part(cells)


def predict_value(model: Model, rows: DataFrame, features: Sequence[str], out: str = "pred") -> DataFrame:
    return model.transform(assemble(rows, features)).withColumnRenamed("prediction", out).drop(
        "features", "rawPrediction", "probability")


def regress_horizons(train: DataFrame, test: DataFrame, features: Sequence[str], targets: Sequence[str],
                     ids: Sequence[str], **options) -> DataFrame:
    """One regression per horizon, fitted together; long rows ``ids, horizon, gold, pred``."""
    return regress_tiers(train, test, {"": F.lit(True)}, features, targets, ids, **options)[""]


def regress_tiers(train: DataFrame, test: DataFrame, tiers: Mapping[str, Column], features: Sequence[str],
                  targets: Sequence[str], ids: Sequence[str], **options) -> dict[str, DataFrame]:
    """One regression per tier and horizon, all fitted together; per tier the long rows ``ids, horizon, gold, pred``."""
    train, test = assemble(train, features), assemble(test, features)
    parts = run_together(train.sparkSession, [
        partial(learning_part, train, rows & F.col(t).isNotNull(), [t]) for rows in tiers.values() for t in targets])
    named = [(name, t) for name in tiers for t in targets]
    models = [fit_regression(part, features, t, **options) for part, (_, t) in zip(parts, named)]
    fit_all(models)
    found = {n: predict_value(model, test.where(tiers[n[0]]), features).select(
        *ids, F.lit(n[1]).alias("horizon"), F.col(n[1]).alias("gold"), "pred") for n, model in zip(named, models)}
    return {name: reduce(DataFrame.unionByName, [found[name, t] for t in targets]) for name in tiers}


def out_of_fold_regression(df: DataFrame, features: Sequence[str], target: str, folds: int = 5,
                           fold: str = "fold", log_target: bool = True, **options) -> tuple[DataFrame, list[Model]]:
    """Each fold is predicted by a model fitted on the others, on the log1p scale; the folds are fitted together."""
    usable = df.where(F.col(target) > -1) if log_target else df
    scaled = prepared(usable.withColumn("__y", F.log1p(target) if log_target else F.col(target)), features, merge=True)
    train = condensed(scaled, [fold], ["__y"], size=folds)
    models = [fit_regression(Part(train, F.col(fold) != i), features, "__y", **options) for i in range(folds)]
    fit_all(models)
    raw = predict_value(OutOfFold(models, fold), scaled.where(F.col(fold).isin(list(range(folds)))), features)
    return raw.withColumn("pred", F.expm1("pred") if log_target else F.col("pred")).drop("__y"), models


def out_of_fold_classes(df: DataFrame, features: Sequence[str], label: str, labels: Sequence[str],
                        folds: int = 5, fold: str = "fold", **options) -> tuple[DataFrame, list[Model]]:
    """Out-of-fold class predictions with balanced class weights; the folds are fitted together."""
    df = prepared(df, features, merge=True)
    if large(df):
        models = balanced_forests(df, [Part(df, F.col(fold) != i) for i in range(folds)], label, labels, **options)
        parts = [predict_classes(m, df.where(F.col(fold) == i), features, labels) for i, m in enumerate(models)]
        return reduce(DataFrame.unionByName, parts), models

    def one(i: int) -> tuple[DataFrame, Model]:
        train = balanced_weights(df.where(F.col(fold) != i), label)
        model = fit_multiclass(train, features, label, labels, weight="weight", **options)
        return predict_classes(model, df.where(F.col(fold) == i), features, labels), model

    parts, models = zip(*run_together(df.sparkSession, [partial(one, i) for i in range(folds)], fits_at_once(df)))
    return reduce(DataFrame.unionByName, parts), list(models)


def importances(models: Sequence[Model], features: Sequence[str]) -> DataFrame:
    """Gain importances averaged over the fold models (a few fitted numbers)."""
    mean = [sum(float(m.featureImportances[i]) for m in models) / len(models) for i in range(len(features))]
    return SparkSession.active().createDataFrame(list(zip(features, mean)), "feature string, importance double")


class SpearmanEvaluator(Evaluator, HasLabelCol, HasPredictionCol):
    """Model selection by rank correlation; no variance scores 0."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        row = spearman(dataset, self.getLabelCol(), self.getPredictionCol(), degenerate=0.0).first()
        return float(row["spearman"] or 0.0) if row else 0.0


class MacroF1Evaluator(Evaluator, HasLabelCol, HasPredictionCol, HasWeightCol):
    """Model selection by the mean F1 of the classes seen; with a weight a row stands for that many."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction", weightCol: str | None = None):
        super().__init__()
        self._set(labelCol=labelCol, predictionCol=predictionCol, **({"weightCol": weightCol} if weightCol else {}))

    def _evaluate(self, dataset: DataFrame) -> float:
        pair = (F.col(self.getLabelCol()).cast("double").alias("gold"), F.col(self.getPredictionCol()).alias("pred"))
        if self.isDefined(self.weightCol):
            counts = dataset.groupBy(*pair).agg(F.sum(self.getWeightCol()).cast("bigint").alias("n"))
        else:
            counts = confusion_matrix(dataset.select(*pair), "gold", "pred")
        return float(macro_f1(counts).first()["macro_f1"])


def objective(kind: str, label: str, weight: str | None = None) -> Evaluator:
    """``macro_f1``, ``accuracy``, ``mae`` or ``spearman``."""
    if kind == "spearman":
        return SpearmanEvaluator(labelCol=label)
    if kind == "mae":
        return RegressionEvaluator(labelCol=label, metricName="mae")
    if kind == "macro_f1":
        return MacroF1Evaluator(labelCol=label, weightCol=weight)
    return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy", **({"weightCol": weight} if weight else {}))


def random_grid(learner, space: dict[str, Sequence], trials: int, seed: int = 42) -> list[dict]:
    """Seeded random parameter maps over value lists."""
    rng = random.Random(seed)
    return [{learner.getParam(n): rng.choice(list(v)) for n, v in space.items()} for _ in range(trials)]


def _plain(learner, known: Sequence[str]) -> bool:
    """Whether all other parameters of a learner have Spark's defaults."""
    known = {*known, "featuresCol", "labelCol", "predictionCol", "seed", "weightCol"}
    return all(p.name in known or not learner.hasDefault(p) or learner.getOrDefault(p) == learner._defaultParamMap[p]
               for p in learner.params) and learner.getOrDefault("maxDepth") in range(1, DEEPEST + 1) and not any(
        learner.isSet(p) for p in learner.params if p.name in ("validationIndicatorCol", "thresholds", "weightCol"))


def _together(train: DataFrame, learners: Sequence, parts: Sequence[Part], label: str) -> list[list] | None:
    """Models of each learner for each part, fitted together, where the learners are boosted regressions or large forests."""
    if all(isinstance(x, GBTRegressor) and _plain(x, ["maxIter", "maxDepth", "stepSize"]) for x in learners):
        models = [[BoostedRegression(p, label, x.getMaxIter(), x.getMaxDepth(), x.getStepSize(), x.getSeed(), weight_of(train))
                   for p in parts] for x in learners]
        fit_all([m for some in models for m in some])
        return models
    if large(train) and all(isinstance(x, RandomForestClassifier) and _plain(x, [
            "numTrees", "maxDepth", "bootstrap", "featureSubsetStrategy"]) and x.getFeatureSubsetStrategy() in (
            "auto", "sqrt", "all") for x in learners):
        classes = int(train.agg(F.max(label)).first()[0]) + 1
        models = [[Forest(p, label, classes, x.getNumTrees(), x.getMaxDepth(), x.getFeatureSubsetStrategy(), x.getBootstrap(), x.getSeed())
                   for p in parts] for x in learners]
        fit_forests([m for some in models for m in some])
        return models
    return None


def spearman_of_predictions(df: DataFrame, gold: str, preds: Sequence[str], fold: str) -> dict[tuple[str, int], float]:
    """Spearman of ``gold`` with each column of predictions, by fold; without variance it is left out.

    Gold is ranked once. A prediction needs the sums of these ranks by its distinct values alone, which tasks
    add up before they are shuffled.
    """
    counts = cumulative_counts(df, gold, [fold])
    ranks = materialize(counts.select(fold, gold, "n", ((F.col("n_below") + F.col("n_upto") - F.col("n_total")) / 2).alias("__r")))
    ranked = materialize(df.join(ranks.drop("n"), [fold, gold]).select(fold, "__r", *preds))
    spread = {r[fold]: r["s"] for r in ranks.groupBy(fold).agg(F.sum(F.col("n") * F.col("__r") * F.col("__r")).alias("s")).collect()}

    def one(name: str) -> list:
        sums = materialize(ranked.groupBy(fold, name).agg(F.count(F.lit(1)).alias("__w"), F.sum("__r").alias("__s")))
        places = cumulative_counts(sums, name, [fold], weight="__w")
        own = places.join(sums.select(fold, name, "__s"), [fold, name]).withColumn(
            "__q", (F.col("n_below") + F.col("n_upto") - F.col("n_total")) / 2)
        return own.groupBy(fold).agg(F.sum(F.col("__q") * F.col("__s")).alias("both"),
                                     F.sum(F.col("n") * F.col("__q") * F.col("__q")).alias("s")).collect()

    found = run_together(df.sparkSession, [partial(one, n) for n in preds])
    return {(n, r[fold]): r["both"] / (math.sqrt(spread[r[fold]]) * math.sqrt(r["s"]))
            for n, rows in zip(preds, found) for r in rows if spread[r[fold]] and r["s"]}


def _scored_folds(rows: DataFrame, models: Sequence[Sequence], kind: str, label: str, fold: str, weight: str | None) -> list[float]:
    """The objective of every model on its fold, model by model; all predictions are made in one pass and written."""
    folds = range(len(models[0]))
    names = [f"__p{k}" for k in range(len(models))]
    scores = out_of_fold_predictions([[some[i] for some in models] for i in folds], fold)
    said = rows.where(F.col(fold).isin(list(folds))).withColumn("__p", scores)
    said = said.select(label, fold, *([weight] if weight else []), *[F.col("__p")[k].alias(n) for k, n in enumerate(names)])
    if kind == "spearman" and not weight:
        found = spearman_of_predictions(said, label, names, fold)
        return [found.get((n, i), 0.0) for n in names for i in folds]
    said = materialize(said)
    judge = lambda n, i: objective(kind, label, weight).evaluate(
        said.where(F.col(fold) == i).withColumnRenamed(n, "prediction"))
    return run_together(rows.sparkSession, [partial(judge, n, i) for n in names for i in folds])


def search(df: DataFrame, learner, space: dict[str, Sequence], kind: str, label: str, **options) -> DataFrame:
    """Cross-validated random search over a fixed fold column: one row per trial."""
    return search_and_fit(df, learner, space, kind, label, **options)[0]


def search_and_fit(df: DataFrame, learner, space: dict[str, Sequence], kind: str, label: str, trials: int = 10,
                   folds: int = 5, fold: str = "fold", seed: int = 42) -> tuple[DataFrame, Model]:
    """The trials, and the model fitted on all rows with the best parameters.

    Trials that drew the same parameters have the same models, which are fitted once.
    """
    df = prepared(df.select(label, fold, "features"), _feature_names(df))
    grid = random_grid(learner, space, trials, seed)
    different = list({tuple(sorted((p.name, v) for p, v in g.items())): g for g in grid}.values())
    if isinstance(learner, Regressor):
        how = {"means": [label]}
    else:
        how = {"keys": [label], "size": max(1, df.agg(F.count_distinct(label)).first()[0])}

    how["size"] = how.get("size", 1) * folds
    train = condensed(df, [fold, *how.pop("keys", [])], **how, forest=learner.hasParam("numTrees"), seed=seed)
    scored = df if isinstance(learner, Regressor) else train  # a mean target is no row to score
    parts = [Part(train, F.col(fold) != i) for i in range(folds)]
    together = _together(train, [learner.copy(g) for g in different], parts, label)
    if together:
        found = _scored_folds(scored, together, kind, label, fold, weight_of(scored))
    else:
        def one(params: dict, i: int) -> float:
            model = _fit(learner.copy(params), train.where(F.col(fold) != i))
            return objective(kind, label, weight_of(scored)).evaluate(model.transform(scored.where(F.col(fold) == i)))

        jobs = [partial(one, g, i) for g in different for i in range(folds)]
        found = run_together(df.sparkSession, jobs, fits_at_once(df))
    mean = [sum(found[k:k + folds]) / folds for k in range(0, len(found), folds)]
    scores = [mean[different.index(g)] for g in grid]
    best = max if objective(kind, label).isLargerBetter() else min
    chosen = learner.copy(grid[scores.index(best(scores))])
    whole = _together(train, [chosen], [Part(train)], label)
    fitted = whole[0][0] if whole else _fit(chosen, train)
    names = sorted(space)
    rows = [(i, float(score), *[str(grid[i][learner.getParam(n)]) for n in names])
            for i, score in enumerate(scores)]
    columns = "trial int, score double, " + ", ".join(f"{n} string" for n in names)
    return df.sparkSession.createDataFrame(rows, columns), fitted
