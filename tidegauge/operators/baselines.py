"""Majority, random-prior and momentum baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions.hashing import hash_key, hash_uniform
from tidegauge.operators.metrics import class_distribution, class_report, weighted_spearman
from tidegauge.operators.ranking import valid_number
from tidegauge.operators.rows import expand_tiers, flatten_horizons
from tidegauge.schemas import MOMENTUM_SCALES, PRIOR_SEEDS
from tidegauge.sources.tables import materialize


def majority(df: DataFrame, label: str, scope: Sequence[str] = (), k: int | Column | None = None,
             weight: str | None = None) -> DataFrame:
    """Most frequent label with its accuracy ``p`` and macro-F1 ``2p / (1 + p) / k``.

    ``k`` is the number of classes scored, the observed ones by default. A tie
    goes to the smaller label.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(label).isNotNull()).groupBy(*scope, label).agg(size.alias("n"))
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("n"), label))
    everything = Window.partitionBy(*scope)
    best = counts.select(*scope, F.col(label).alias("majority_label"), place.alias("__rn"),
                         F.sum("n").over(everything).alias("n"),
                         F.count(F.lit(1)).over(everything).alias("__k"),
                         (F.col("n") / F.sum("n").over(everything)).alias("accuracy")).where("__rn = 1")
    classes = F.col("__k") if k is None else F.lit(k) if isinstance(k, int) else k
    p = F.col("accuracy")
    return best.select(*scope, "majority_label", "n", "accuracy",
                       (2 * p / (1 + p) / classes).alias("macro_f1"))


def majority_on_test(train: DataFrame, test: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    """Predict the train majority for every test row and score it."""
    guess = majority(train, label).select("majority_label").scalar()
    confusion = (test.groupBy(F.col(label).alias("gold")).agg(F.count(F.lit(1)).alias("n"))
                 .withColumn("pred", guess))
    report = class_report(confusion, labels).select("n", "accuracy", "macro_f1")
    return report.withColumn("majority_label", guess)


def random_prior_expected(df: DataFrame, label: str, scope: Sequence[str] = (),
                          weight: str | None = None) -> DataFrame:
    """Expected accuracy ``sum p^2`` and macro-F1 ``mean p`` of prior sampling."""
    shares = class_distribution(df.where(F.col(label).isNotNull()), label, scope, weight)
    return shares.groupBy(*scope).agg(
        F.sum("n").alias("n"), F.sum(F.col("share") * F.col("share")).alias("expected_accuracy"),
        F.avg("share").alias("expected_macro_f1"))


def random_prior_draws(df: DataFrame, label: str, keys: Sequence[str], scope: Sequence[str] = (),
                       seeds: Sequence[int] = tuple(PRIOR_SEEDS), out: str = "pred") -> DataFrame:
    """Draw a label per (seed, row) from the class shares.

    The uniform comes from a hash of seed and key, so a rerun draws the same
    labels. The cumulative shares are one small array per scope; null labels are
    not drawn.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(*scope, label).agg(F.count(F.lit(1)).alias("n"))
    by_label = Window.partitionBy(*scope).orderBy(label)
    upto = F.sum("n").over(by_label.rowsBetween(Window.unboundedPreceding, 0))
    shares = counts.select(*scope, F.struct((upto / F.sum("n").over(Window.partitionBy(*scope)))
                                            .alias("upto"), F.col(label).alias("label")).alias("s"))
    table = shares.groupBy(*scope).agg(F.array_sort(F.collect_list("s")).alias("__prior"))
    rows = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    if scope:
        rows = rows.join(table, list(scope))  # one row per scope, all labels in it
    else:
        rows = rows.withColumn("__prior", table.scalar())
    uniform = hash_uniform(hash_key(F.col("seed"), *[F.col(k) for k in keys]))
    rows = rows.withColumn("__u", uniform)
    hit = F.filter("__prior", lambda s: s["upto"] > F.col("__u"))
    return rows.withColumn(out, F.get(hit, F.lit(0))["label"]).drop("__prior", "__u")


def momentum_forecasts(df: DataFrame, pre_delta: str = "pre_delta",
                       scales: Mapping[str, float] = MOMENTUM_SCALES, ids: Sequence[str] = ()) -> DataFrame:
    """One row per horizon with the scaled pre-move as forecast of the real delta."""
    flat = flatten_horizons(df, [*ids, pre_delta], {h: f"delta_{h}" for h in scales})
    scale = F.create_map(*[F.lit(x) for pair in scales.items() for x in pair])
    return flat.withColumn("forecast", F.col(pre_delta) * F.try_element_at(scale, F.col("horizon")))


def momentum_spearman(df: DataFrame, tiers: Mapping[str, Column], pre_delta: str = "pre_delta",
                      scales: Mapping[str, float] = MOMENTUM_SCALES) -> DataFrame:
    """Rank correlation of momentum forecasts per tier, per horizon and flattened (``all``).

    Rows are reduced to counts of distinct pairs with a count per tier, so the
    overlapping tiers share their ranks and no row is repeated per tier.
    """
    complete = df.where(valid_number(df, pre_delta, "direction_label", *[f"delta_{h}" for h in scales]))
    weights = {name: f"__w{i}" for i, name in enumerate(tiers)}
    marked = complete.withColumns({weights[name]: F.coalesce(condition.cast("bigint"), F.lit(0)) for name, condition in tiers.items()})
    flat = momentum_forecasts(marked, pre_delta, scales, ids=list(weights.values()))
    counted = [F.sum(w).alias(w) for w in weights.values()]
    pairs = materialize(flat.groupBy("horizon", "forecast", "delta").agg(*counted))
    pooled = materialize(pairs.groupBy("forecast", "delta").agg(*counted))
    each = weighted_spearman(pairs, "forecast", "delta", weights, ["horizon"])
    every = weighted_spearman(pooled, "forecast", "delta", weights).withColumn("horizon", F.lit("all"))
    return each.unionByName(every)


def zero_drift(df: DataFrame, tiers: Mapping[str, Column]) -> DataFrame:
    """Predict flat / small / 0.0 for every row: accuracy, magnitude F1, no correlation."""
    # Count first, then repeat the few count rows per tier.
    counts = df.groupBy("confound_flag", "direction_label", "magnitude_bucket").agg(
        F.count(F.lit(1)).alias("w"))
    counts = expand_tiers(counts, tiers)
    n = F.sum("w")
    small = F.coalesce(F.sum(F.when(F.col("magnitude_bucket") == "small", F.col("w"))), F.lit(0))
    flat = F.coalesce(F.sum(F.when(F.col("direction_label") == "flat", F.col("w"))), F.lit(0))
    return counts.groupBy("tier").agg(
        n.alias("n"), (flat / n).alias("direction_accuracy"),
        (2 * small / (small + n) / 3).alias("magnitude_macro_f1"),
        F.lit(None).cast("double").alias("spearman"))

