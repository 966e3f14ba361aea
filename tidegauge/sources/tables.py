"""Readers and writers for task tables, posts, markets and ticks."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidegauge.schemas import TASK_SCHEMAS
from tidegauge.session import shared_folder
from tidegauge.sources.json_documents import read_records_in_parts


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per line with a declared schema; blank lines skipped, a bad line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As ``read_jsonl``, but a path that does not exist yet is an empty table."""
    return read_jsonl(spark, path, schema) if path_exists(spark, path) else spark.createDataFrame([], schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType, keyed: bool = False) -> DataFrame:
    """A whole-file JSON array of records, or with ``keyed`` an object of records; one file is read by many tasks."""
    return read_records_in_parts(spark, path, schema, keyed)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_bucketed_parquet(df: DataFrame, path: str, key: str, time: str, buckets: int = 256,
                           salts: int = 1) -> None:
    """One-off conversion of a JSON table to Parquet, clustered by key and time.

    Rows are grouped by a hash bucket of the key and sorted by key and time, so
    row-group statistics prune scans. With ``salts`` a hot key is written by
    several tasks.
    """
    salt = F.pmod(F.xxhash64(time), F.lit(salts))
    (df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
     .repartition("bucket", salt).sortWithinPartitions("bucket", key, time)
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def read_bucketed_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


#: Raw files of each task below the root: own train and test files, test only, or one full file split by position.
RAW_LAYOUT: dict[str, dict[str, str]] = {
    "t1": {"train": "t1_train.jsonl", "test": "t1_test.jsonl"},
    "t2": {"test": "t2.jsonl"},
    "t3": {"test": "t3.json"},
    "t4": {"full": "t4.jsonl"},
    "t5": {"full": "t5.jsonl"},
    "t6": {"full": "t6.jsonl"},
    "t7": {"full": "t5.jsonl"},
}


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON-lines file or, by the ending ``.json``, an array; maps may be objects or JSON text.

    The JSON reader hands an object to a text column as its source, so both
    forms reach ``from_json`` as text.
    """
    maps = {f.name: f.dataType for f in schema if isinstance(f.dataType, T.MapType)}
    flat = T.StructType([T.StructField(f.name, T.StringType() if f.name in maps else f.dataType) for f in schema])
    rows = read_json_document(spark, path, flat) if path.endswith(".json") else read_jsonl(spark, path, flat)
    return rows.withColumns({n: F.from_json(n, kind) for n, kind in maps.items()}) if maps else rows


def load_task(spark: SparkSession, root: str, task: str, split: str | None = None,
              order: Sequence[str] = (), split_mode: str = "auto",
              layout: Mapping[str, Mapping[str, str]] = RAW_LAYOUT) -> DataFrame:
    """Task table with a ``split`` column.

    A prepared layout has ``<root>/<task>/split=train|test``. In a raw
    ``layout`` a task has its own ``train`` and ``test`` files, only ``test``, or
    one ``full`` file, which is split by position on the order columns. A split
    that the task does not have raises. ``split_mode='positional'`` skips the prepared layout.
    """
    from tidegauge.operators.splits import positional_split

    name = task.strip().lower()
    if name not in TASK_SCHEMAS:
        raise ValueError(f"unknown task {task!r}; known: {sorted(TASK_SCHEMAS)}")
    schema, files = TASK_SCHEMAS[name], layout[name]
    prepared = f"{root}/{name}"
    if split_mode == "auto" and path_exists(spark, f"{prepared}/split=test"):
        with_split = T.StructType([*schema.fields, T.StructField("split", T.StringType())])
        table = read_records(spark, prepared, with_split)
        has_train = "full" in files or "train" in files
    elif "full" in files:
        if not order:
            raise ValueError("a raw table needs an order column for its split")
        table, has_train = positional_split(read_records(spark, f"{root}/{files['full']}", schema), order), True
    else:
        parts = [read_records(spark, f"{root}/{path}", schema).withColumn("split", F.lit(part))
                 for part, path in files.items()]
        table, has_train = reduce(DataFrame.unionByName, parts), "train" in files
    if split not in (None, "test", *(["train"] if has_train else [])):
        raise ValueError(f"task {name} has no split {split!r}")
    return table if split is None else table.where(F.col("split") == split)


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that is read many times to the shared folder and read it back.

    The copy survives the loss of executors and cuts the lineage.
    """
    path = f"{shared_folder(df.sparkSession)}/tidegauge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
