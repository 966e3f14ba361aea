"""Post-cluster features of an event group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.functions.text import micros
from tidegauge.operators.ranking import exact_quantiles
from tidegauge.schemas import HOUR_US

HIGH_FOLLOWERS = 100_000


def cluster_features(posts: DataFrame, group: str, user: str = "user_id", time: str = "post_time",
                     followers: str = "followers", high: float = HIGH_FOLLOWERS) -> DataFrame:
    """Post count, distinct authors, burst length and follower statistics per group.

    Authors are counted by grouping on (group, author) first and the exact
    median comes from the histogram, so a hot group is never held by one task.
    """
    us = micros(F.col(time))
    value = F.col(followers).cast("double")
    by_author = posts.groupBy(group, user).agg(
        F.count(F.lit(1)).alias("posts"), F.min(us).alias("lo"), F.max(us).alias("hi"),
        F.max(value).alias("top"), F.sum(value).alias("total"), F.count(value).alias("known"),
        F.count_if(value > high).alias("high"))
    stats = by_author.groupBy(group).agg(
        F.sum("posts").alias("tweet_count"), F.count(user).alias("unique_user_count"),
        ((F.max("hi") - F.min("lo")) / F.lit(float(HOUR_US))).alias("burst_duration_hours"),
        F.max("top").alias("max_author_followers"),
        F.try_divide(F.sum("total"), F.sum("known")).alias("mean_author_followers"),
        F.sum("high").alias("high_follower_author_count"))
    medians = exact_quantiles(posts.select(group, value.alias("v")), "v",
                              {"median_author_followers": 0.5}, [group])
    return stats.join(medians, group, "left")


def interest_labels(volumes: DataFrame, volume: str = "volume") -> DataFrame:
    """Interest class of each market from the 40th and 80th volume percentiles."""
    from tidegauge.functions.labels import interest_class

    cuts = exact_quantiles(volumes, volume, {"low": 0.4, "high": 0.8})
    both = volumes.withColumn("__cuts", cuts.select(F.struct("low", "high")).scalar())
    label = interest_class(F.col(volume), F.col("__cuts")["low"], F.col("__cuts")["high"])
    return both.withColumn("interest_label", label).drop("__cuts")
