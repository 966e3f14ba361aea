"""Task evaluators: join predictions with gold, then one aggregate per metric family.

The join runs once: where its counts are read more than once they are written
to the shared folder first. Each evaluator returns one row; ``evaluate_all``
turns the rows of many tasks into one long table ``(task, metric, value)``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidegauge.functions.labels import direction, magnitude
from tidegauge.functions.maps import horizon_map, map_value
from tidegauge.operators.joins import join_pred_gold
from tidegauge.operators.metrics import (class_report, confusion_matrix, quadratic_kappa, reciprocal_rank,
                                         small_spearman, spearman)
from tidegauge.schemas import DECAY_LABELS, INTEREST_LABELS, MAGNITUDE_LABELS, PROPAGATION_LABELS
from tidegauge.sources.tables import materialize


def _classes(preds: DataFrame, gold: DataFrame, keys: list[str], order: str | None, column: str,
             labels: list[str]) -> DataFrame:
    joined = join_pred_gold(preds, gold, keys, order, [column])
    return class_report(confusion_matrix(joined, f"gold_{column}", "label"), labels)


def evaluate_interest(preds: DataFrame, gold: DataFrame, order: str | None = None,
                      labels: list[str] = INTEREST_LABELS, column: str = "interest_label") -> DataFrame:
    return _classes(preds, gold, ["condition_id"], order, column, labels).select("n", "macro_f1", "accuracy")


def evaluate_linking(preds: DataFrame, gold: DataFrame, order: str | None = None) -> DataFrame:
    """Acc@1 and MRR of ranked market lists.

    Where rows of a post carry a flag (``gold`` or ``is_gold``), it picks the gold
    row; a post without any flag keeps its last row by ``order``.
    """
    flags = [F.col(c) for c in ("gold", "is_gold") if c in gold.columns]
    if flags:
        flag = F.coalesce(*flags)
        gold = gold.where(F.coalesce(flag, F.lit(True)))
        if order:
            gold, order = gold.withColumn("__order", F.struct(flag.isNotNull(), order)), "__order"
    joined = join_pred_gold(preds, gold, ["tweet_id"], order, ["market_id"])
    ranked, right = F.col("ranked_market_ids"), F.col("gold_market_id").cast("string")
    first = F.when(F.get(ranked, F.lit(0)) == right, 1.0).otherwise(0.0)
    return joined.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(first), F.lit(0.0)).alias("acc_at_1"),
                      F.coalesce(F.avg(reciprocal_rank(ranked, right)), F.lit(0.0)).alias("mrr"))


def evaluate_grades(preds: DataFrame, gold: DataFrame, order: str | None = None) -> DataFrame:
    """Spearman and kappa of ordinal grades, both from the one confusion table."""
    joined = join_pred_gold(preds, gold, ["tweet_id", "condition_id"], order, ["final_grade"])
    counts = confusion_matrix(joined, "gold_final_grade", "predicted_grade")
    rho = small_spearman(counts, "gold", "pred", "n", degenerate=0.0).select("spearman").scalar()
    return quadratic_kappa(counts).withColumn("spearman_rho", rho)


def evaluate_movement(preds: DataFrame, gold: DataFrame, order: str | None = None,
                      keys: list[str] | None = None) -> DataFrame:
    """Direction accuracy, magnitude macro-F1 and Spearman, both labels derived from the delta."""
    keys = keys or ["tweet_id", *(["condition_id"] if "condition_id" in preds.columns else [])]
    joined = join_pred_gold(preds, gold, keys, order, ["delta_2h"])
    pairs = joined.groupBy(F.col("gold_delta_2h").alias("g"), F.col("delta_2h").alias("p")).agg(
        F.count(F.lit(1)).alias("w"))
    return movement_scores(materialize(pairs))


def movement_scores(pairs: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """All three movement metrics from counts ``w`` of distinct (gold, predicted) deltas.

    The counts are read several times, so a caller whose counts come from a
    costly join writes them first.
    """
    hit = direction(F.col("g")) == direction(F.col("p"))
    acc = pairs.groupBy(*scope).agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("n"),
        F.coalesce(F.try_divide(F.sum(F.when(hit, F.col("w")).otherwise(0)), F.sum("w")), F.lit(0.0))
        .alias("direction_accuracy"))
    sizes = pairs.groupBy(*scope, magnitude(F.col("g")).alias("gold"), magnitude(F.col("p")).alias("pred")).agg(
        F.sum("w").alias("n"))
    f1 = class_report(sizes, MAGNITUDE_LABELS, scope).select(*scope, F.col("macro_f1").alias("magnitude_macro_f1"))
    rho = spearman(pairs, "g", "p", scope, degenerate=0.0, out="spearman_rho", weight="w").drop("n")
    if scope:
        return acc.join(f1, list(scope)).join(rho, list(scope), "left")
    return acc.withColumns({"magnitude_macro_f1": f1.scalar(), "spearman_rho": rho.scalar()})


def evaluate_impact(preds: DataFrame, gold: DataFrame, order: str | None = None,
                    horizon: str = "2h") -> DataFrame:
    """Spearman of impact and volume at one horizon, both sides in one rank pass.

    A side is skipped where its prediction is null or its gold map is empty; a
    map without the horizon counts as 0. Fewer than two pairs give null.
    """
    sides = ["price_impact", "volume_multiplier"]
    values = {}
    for side in sides:  # numbers, not maps, are joined; a map is parsed once
        source = F.col(f"{side}_json")
        mapping = horizon_map(source) if dict(gold.dtypes)[f"{side}_json"] == "string" else source
        values[f"__{side}"] = F.transform(F.array(mapping), lambda m: F.when(F.size(m) > 0, map_value(m, horizon, 0.0)))[0]
    joined = join_pred_gold(preds, gold.withColumns(values), ["tweet_id", "condition_id"], order, list(values))
    parts = [F.struct(F.lit(side).alias("side"), F.col(f"gold___{side}").cast("double").alias("real"),
                      F.col(side).cast("double").alias("forecast")) for side in sides]
    long = joined.select(F.inline(F.array(*parts))).where("real IS NOT NULL AND forecast IS NOT NULL")
    rho = spearman(long, "real", "forecast", ["side"], degenerate=0.0, cut=True)
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    out = []
    for side in sides:
        out.append(F.coalesce(pick(side, "n"), F.lit(0)).alias(f"n_{side}"))
        out.append(pick(side, "checked").alias(f"spearman_rho_{side}"))
    return rho.withColumn("checked", F.when(F.col("n") >= 2, F.col("spearman"))).agg(*out)


def evaluate_propagation(preds: DataFrame, gold: DataFrame, order: str | None = None,
                         labels: list[str] = PROPAGATION_LABELS) -> DataFrame:
    keys = ["tweet_id", *(c for c in ("primary_condition_id",) if c in preds.columns)]
    return _classes(preds, gold, keys, order, "label", labels).select("n", "macro_f1")


def evaluate_decay(preds: DataFrame, gold: DataFrame, order: str | None = None,
                   labels: list[str] = DECAY_LABELS) -> DataFrame:
    return _classes(preds, gold, ["tweet_id", "condition_id"], order, "decay_class", labels).select("n", "macro_f1")


EVALUATORS: dict[str, Callable[..., DataFrame]] = {
    "t1": evaluate_interest, "t2": evaluate_linking, "t3": evaluate_grades, "t4": evaluate_movement,
    "t5": evaluate_impact, "t6": evaluate_propagation, "t7": evaluate_decay,
}


def long_metrics(row: DataFrame, task: str) -> DataFrame:
    names = row.columns
    doubles = row.select(*[F.col(n).cast("double").alias(n) for n in names])
    return doubles.unpivot([], names, "metric", "value").select(F.lit(task).alias("task"), "metric", "value")


def evaluate_all(pairs: Mapping[str, tuple[DataFrame | None, DataFrame]],
                 **options: dict) -> DataFrame:
    """Every task that has predictions, as one long table."""
    done = [long_metrics(EVALUATORS[task](preds, gold, **options.get(task, {})), task)
            for task, (preds, gold) in pairs.items() if preds is not None]
    return reduce(DataFrame.unionByName, done)


def metrics_json(long: DataFrame) -> DataFrame:
    """One JSON record per task: counts (``n``, ``n_...``) as integers, scores rounded to 4 places, null kept."""
    is_count = F.col("metric").eqNullSafe("n") | F.startswith("metric", F.lit("n_"))
    number = F.when(is_count, F.col("value").cast("bigint").cast("string")).otherwise(F.round("value", 4).cast("string"))
    entry = F.concat(F.lit('"'), "metric", F.lit('":'), F.coalesce(number, F.lit("null")))
    entries = F.array_sort(F.collect_list(entry))
    return long.groupBy("task").agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("record"))
