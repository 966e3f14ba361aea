"""Equi-, semi-, anti- and enrichment joins.

No side is broadcast by hint: the adaptive planner broadcasts a side only after
it has seen its size, and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tidegauge.functions.text import epoch_ms_to_timestamp, normalized_id, text_to_timestamp, try_double
from tidegauge.operators.ranking import first_per_key, last_per_key


def join_pred_gold(preds: DataFrame, gold: DataFrame, keys: Sequence[str], order: str | None = None,
                   gold_columns: Sequence[str] = ("label",)) -> DataFrame:
    """Inner join of predictions with gold on key text; the keys come out as text.

    Whole numbers are equal where their texts are, so a key of them on both
    sides is joined as ``bigint``, which sorts faster and keeps how a side was dealt out before.
    Gold is reduced to its last row per key by ``order``; without one its keys
    must be unique, and a repeated key fails the query. Every prediction row counts. Gold value columns come out as ``gold_<name>``.
    """
    whole = [k for k in keys if all(isinstance(df.schema[k].dataType, T.IntegralType) for df in (preds, gold))]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({k: F.col(k).cast("bigint" if k in whole else "string") for k in keys})

    extra = [order] if order and order not in gold_columns else []
    labels = keyed(gold.select(*keys, *gold_columns, *extra))
    if order:
        labels = last_per_key(labels, keys, order)
    else:
        labels = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in gold_columns])
        labels = labels.where(F.assert_true(F.col("__n") == 1, F.lit("gold has a repeated key; name an order")).isNull())
        # by way of text, so that filters of the predictions' keys are not moved before the check of gold
        preds = preds.withColumns({k: F.col(k).cast("string") for k in whole})
    labels = labels.select(*keys, *[F.col(c).alias(f"gold_{c}") for c in gold_columns])
    return keyed(preds).join(labels, list(keys)).withColumns({k: F.col(k).cast("string") for k in whole})


def wanted_posts(posts: DataFrame, wanted: DataFrame, key: str = "tweet_id") -> DataFrame:
    return posts.join(wanted.select(key).distinct(), key, "left_semi")


def post_times(posts: DataFrame, wanted: DataFrame, order: str) -> DataFrame:
    """Post time per wanted ID: first row per ID, bad times dropped.

    Only ID, time text and order column leave the scan; the ID filter comes
    before the per-ID choice.
    """
    hits = wanted_posts(posts.select("tweet_id", "created_at", *({order} - {"tweet_id", "created_at"})),
                        wanted)
    first = first_per_key(hits, ["tweet_id"], [F.col(order)])
    return (first.select("tweet_id", text_to_timestamp(F.col("created_at")).alias("post_time"))
            .where("post_time IS NOT NULL"))


def yes_ticks(ticks: DataFrame, volume: str = "volume", order: str = "seq") -> DataFrame:
    """Ticks of the ``yes`` side with a UTC time and a numeric close.

    Where the table has them, ``volume`` and the ``order`` of ticks of one
    instant come along; they may be null.
    """
    more = ([try_double(F.col(volume).cast("string")).alias("volume")] if volume in ticks.columns else []) + (
        [F.col(order)] if order in ticks.columns else [])
    return (ticks.where(F.lower(F.trim("side")) == "yes")
            .select("condition_id", epoch_ms_to_timestamp(F.col("timestamp")).alias("ts"),
                    try_double(F.col("close").cast("string")).alias("close_price"), *more)
            .dropna(subset=["condition_id", "ts", "close_price"]))


def with_post_time(labels: DataFrame, times: DataFrame, fallback: str = "created_at",
                   key: str = "tweet_id") -> DataFrame:
    """Post time from the posts table, else the label's own time."""
    return (labels.join(times.select(key, F.col("post_time").alias("__known")), key, "left")
            .withColumn("post_time", F.coalesce("__known", F.col(fallback).try_cast("timestamp")))
            .drop("__known"))


def attach_split(df: DataFrame, train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mark rows whose key is in train or test; test overrides, neither is ''."""
    def members(part: DataFrame, name: str) -> DataFrame:
        return part.select(F.lit(name).alias("__part"), *[normalized_id(F.col(k)).alias(f"__k{i}")
                                                          for i, k in enumerate(keys)])

    names = [f"__k{i}" for i in range(len(keys))]
    known = members(train, "train").unionByName(members(test, "test"))
    # One row per key; "train" sorts after "test", so the minimum lets test win.
    known = known.groupBy(*names).agg(F.min("__part").alias("split"))
    tagged = df.withColumns({n: normalized_id(F.col(k)) for n, k in zip(names, keys)})
    return (tagged.join(known, names, "left")
            .withColumn("split", F.coalesce("split", F.lit(""))).drop(*names))


def enrich(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str,
           columns: Sequence[str]) -> DataFrame:
    """Left join of extra columns; right reduced to its first row per key, left value wins."""
    unique = first_per_key(right, keys, [F.col(order)])
    renamed = unique.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = left.join(renamed, list(keys), "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"__new_{c}")) if c in left.columns else F.col(f"__new_{c}")
              for c in columns}
    return joined.withColumns(filled).drop(*[f"__new_{c}" for c in columns])


def pending_rows(rows: DataFrame, done: DataFrame, keys: Sequence[str], error: str | None = None,
                 retry_errors: bool = True) -> DataFrame:
    """Rows without a finished result; a failed result counts as unfinished."""
    finished = done.where(F.col(error).isNull()) if error and retry_errors else done
    return rows.join(finished.select(*keys).distinct(), list(keys), "left_anti")
