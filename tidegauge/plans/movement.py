"""Movement task: momentum rows, label building and tier reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.labels import decay_class, direction, magnitude, sign_direction
from tidegauge.operators.baselines import majority, random_prior_expected
from tidegauge.operators.metrics import class_report, spearman
from tidegauge.operators.rows import expand_tiers, is_unconfounded, movement_tiers
from tidegauge.operators.temporal import AsOf, Span, farthest_move, series_at
from tidegauge.plans.evaluate import movement_scores
from tidegauge.schemas import (DAY_US, DELTA_HORIZONS, DIRECTION_LABELS, HORIZON_US, IMPACT_HORIZONS,
                               MAGNITUDE_LABELS, MINUTE_US)


def horizon_deltas(posts: DataFrame, ticks: DataFrame, horizons: Mapping[str, int] | None = None,
                   **names) -> DataFrame:
    """Price at the post and its change at each horizon, all from one pass."""
    horizons = horizons or {h: HORIZON_US[h] for h in DELTA_HORIZONS}
    points = [AsOf("price_t0", 0), *[AsOf(f"__p_{h}", us) for h, us in horizons.items()]]
    priced = series_at(posts, ticks, asof=points, block_us=DAY_US, **names)
    deltas = {f"delta_{h}": F.col(f"__p_{h}") - F.col("price_t0") for h in horizons}
    return priced.withColumns(deltas).drop(*[f"__p_{h}" for h in horizons])


def momentum_rows(posts: DataFrame, ticks: DataFrame, **names) -> DataFrame:
    """Posts with the move of the 30 minutes before them and the labels after them.

    Rows without a price at the post, 30 minutes before it or at a horizon are
    dropped.
    """
    points = {"__pre": -30 * MINUTE_US, "price_t0": 0, **{f"__p_{h}": HORIZON_US[h] for h in DELTA_HORIZONS}}
    priced = series_at(posts, ticks, asof=[AsOf(n, us) for n, us in points.items()],
                       block_us=DAY_US, **names).dropna(subset=list(points))
    made = {"pre_delta": F.col("price_t0") - F.col("__pre"),
            **{f"delta_{h}": F.col(f"__p_{h}") - F.col("price_t0") for h in DELTA_HORIZONS}}
    rows = priced.withColumns(made).drop("__pre", *[f"__p_{h}" for h in DELTA_HORIZONS])
    return rows.withColumns({"direction_label": direction(F.col("delta_2h")),
                             "magnitude_bucket": magnitude(F.col("delta_2h"))})


def impact_rows(posts: DataFrame, ticks: DataFrame, scale_baseline: bool = False, **names) -> DataFrame:
    """Price impact and volume multiplier per horizon, and the decay class.

    The volume baseline is the sum of the 24 hours before the post; with
    ``scale_baseline`` it is scaled down to the horizon's length.
    """
    spans = [Span(f"__w{h}", 0, HORIZON_US[h]) for h in IMPACT_HORIZONS]
    base = Span("__day", -DAY_US, 0, left_closed=True)
    points = [AsOf("p0", 0), AsOf("__p15m", HORIZON_US["15m"]), AsOf("__p2h", HORIZON_US["2h"])]
    rows = series_at(posts, ticks, asof=points, spans=[*spans, base], **names)
    made: dict[str, Column] = {}
    for h in IMPACT_HORIZONS:
        share = HORIZON_US[h] / DAY_US if scale_baseline else 1.0
        made[f"price_impact_{h}"] = farthest_move(f"__w{h}", F.col("p0"))
        made[f"volume_multiplier_{h}"] = F.try_divide(F.col(f"__w{h}_vol"), F.col("__day_vol") * share)
    made["decay_class"] = decay_class(F.col("__p15m") - F.col("p0"), F.col("__p2h") - F.col("p0"))
    return rows.select(*posts.columns, "p0", *[c.alias(n) for n, c in made.items()])


def momentum_report(rows: DataFrame) -> DataFrame:
    """Direction accuracy, magnitude macro-F1 and n of the momentum rule per tier.

    The active tier scores direction over rows that moved and magnitude over
    rows whose true bucket is medium or large. All tiers and both targets come
    from one aggregate.
    """
    clean = is_unconfounded()
    pre = F.col("pre_delta")
    targets = F.array(
        F.struct(F.lit("direction").alias("target"), F.col("direction_label").alias("gold"),
                 sign_direction(pre).alias("pred")),
        F.struct(F.lit("magnitude").alias("target"), F.col("magnitude_bucket").alias("gold"),
                 magnitude(pre).alias("pred")))
    long = (rows.select(clean.alias("clean"), F.inline(targets)).where("gold IS NOT NULL")
            .groupBy("clean", "target", "gold", "pred").agg(F.count(F.lit(1)).alias("n")))
    active = F.col("clean") & ~F.col("gold").isin("flat", "small")
    tiers = {"tier1_all": F.lit(True), "tier2_non_confounded": F.col("clean"), "tier3_active": active}
    scope = ["tier", "target"]
    counts = expand_tiers(long, tiers)  # the count rows are repeated, not the posts
    direct = class_report(counts.where("target = 'direction'"), DIRECTION_LABELS, scope)
    size = counts.where("target = 'magnitude'")
    whole = class_report(size.where("tier <> 'tier3_active'"), MAGNITUDE_LABELS, scope)
    moved = class_report(size.where("tier = 'tier3_active'"), ["medium", "large"], scope)
    return (direct.unionByName(whole).unionByName(moved)
            .select("tier", "target", "n", "accuracy", "macro_f1"))


def tier_report(rows: DataFrame, gold: str = "delta_2h", pred: str = "pred_delta",
                horizons: Mapping[str, str] | None = None) -> DataFrame:
    """Per tier: direction accuracy, magnitude macro-F1 and Spearman of predicted deltas.

    With ``horizons`` (gold column to forecast column) ``spearman_all`` ranks
    the pairs of all horizons together; the tier still follows ``gold``.
    """
    pairs = rows.groupBy("confound_flag", F.col(gold).alias("g"), F.col(pred).alias("p")).agg(
        F.count(F.lit(1)).alias("w")).withColumn("moved", direction(F.col("g")))
    tiered = expand_tiers(pairs, movement_tiers(label="moved")).select("tier", "g", "p", "w")
    scores = movement_scores(tiered, ["tier"])
    scores = scores.withColumnRenamed("spearman_rho", "spearman")
    if not horizons:
        return scores
    each = F.inline(F.array(*[F.struct(F.col(g).alias("g"), F.col(p).alias("p")) for g, p in horizons.items()]))
    flat = (rows.select("confound_flag", direction(F.col(gold)).alias("moved"), each).where("g IS NOT NULL AND p IS NOT NULL")
            .groupBy("confound_flag", "moved", "g", "p").agg(F.count(F.lit(1)).alias("w")))
    flat = expand_tiers(flat, movement_tiers(label="moved")).select("tier", "g", "p", "w")
    return scores.join(spearman(flat, "g", "p", ["tier"], out="spearman_all", weight="w").drop("n"), "tier", "left")


def prior_report(rows: DataFrame) -> DataFrame:
    """Majority and random-prior scores of both targets in each tier, one scan."""
    counts = rows.groupBy("confound_flag", "direction_label", "magnitude_bucket").agg(
        F.count(F.lit(1)).alias("w"))
    tiered = expand_tiers(counts, movement_tiers())
    targets = F.inline(F.array(
        F.struct(F.lit("direction").alias("target"), F.col("direction_label").alias("label")),
        F.struct(F.lit("magnitude").alias("target"), F.col("magnitude_bucket").alias("label"))))
    long = tiered.select("tier", "w", targets)
    scope = ["tier", "target"]
    # The active tier has no flat direction: two classes there, three elsewhere.
    k = F.when((F.col("tier") == "tier3_active") & (F.col("target") == "direction"), 2).otherwise(3)
    best = majority(long, "label", scope, k, weight="w")
    prior = random_prior_expected(long, "label", scope, weight="w").drop("n")
    return best.join(prior, scope)
