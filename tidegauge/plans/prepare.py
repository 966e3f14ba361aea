"""Preparation job: read raw labels, split, write train / test and a manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.operators.rows import normalize_label
from tidegauge.operators.splits import stratified_split
from tidegauge.schemas import TASK_SCHEMAS
from tidegauge.sources.tables import RAW_LAYOUT, load_task, read_records

# Label column and keys each task is split on.
SPLIT_LABELS = {"t4": "direction_label", "t5": "decay_class", "t6": "label", "t7": "decay_class"}
REPORT_LABELS = {"t1": "interest_label", "t2": None, "t3": "final_grade", **SPLIT_LABELS}
TASK_KEYS = {"t1": ["condition_id"], "t2": ["tweet_id", "market_id"], "t3": ["tweet_id", "condition_id"],
             "t4": ["tweet_id", "condition_id"], "t5": ["tweet_id", "condition_id"],
             "t6": ["tweet_id", "primary_condition_id"], "t7": ["tweet_id", "condition_id"]}


def prepare_task(raw: DataFrame, task: str, label: str | None = None, keys: Sequence[str] = (),
                 seed: int = 42, test_fraction: float = 0.2) -> DataFrame:
    """Attach ``split``: stratified for the label tasks, all ``test`` for the others."""
    label = label or SPLIT_LABELS.get(task)
    if label is None:
        return raw.withColumn("split", F.lit("test"))
    if dict(raw.dtypes)[label] == "string":
        raw = raw.withColumn(label, normalize_label(F.col(label)))
    return stratified_split(raw, label, list(keys) or TASK_KEYS[task], seed, test_fraction)


def manifest(df: DataFrame, task: str, label: str | None = None) -> DataFrame:
    """Rows per split with the label counts as a sorted JSON record."""
    name = F.lit("all") if label is None else F.coalesce(F.col(label).cast("string"), F.lit("null"))
    counts = df.groupBy("split", name.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("label", "n")))
    return counts.groupBy("split").agg(
        F.lit(task).alias("task"), F.sum("n").alias("n"),
        F.to_json(F.map_from_entries(entries)).alias("labels")).select("task", "split", "n", "labels")


def write_task(df: DataFrame, root: str, task: str) -> None:
    """Write ``<root>/<task>/split=.../`` as JSON lines."""
    df.write.mode("overwrite").partitionBy("split").json(f"{root}/{task}")


def prepare_all(spark: SparkSession, raw_root: str, out_root: str,
                tasks: Sequence[str] = tuple(TASK_SCHEMAS),
                layout: Mapping[str, Mapping[str, str]] = RAW_LAYOUT) -> DataFrame:
    """Prepare the named tasks from ``raw_root`` and return the manifest.

    A task with files of its own per split keeps them; a full file is split
    anew. The impact table serves two tasks, so the persistence task is written from it.
    """
    records = []
    for task in tasks:
        full = layout[task].get("full")
        prepared = (prepare_task(read_records(spark, f"{raw_root}/{full}", TASK_SCHEMAS[task]), task) if full
                    else load_task(spark, raw_root, task, split_mode="positional", layout=layout))
        write_task(prepared, out_root, task)
        written = load_task(spark, out_root, task)
        records.append(manifest(written, task, REPORT_LABELS[task]))
    out = records[0]
    for record in records[1:]:
        out = out.unionByName(record)
    return out
