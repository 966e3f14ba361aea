"""Resumable result tables.

Results arrive batch by batch and a rerun must skip what is done. A batch
append with an anti-join does it for tables; for files that keep arriving, a
file stream with a checkpoint does it without rereading old files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidegauge.operators.joins import pending_rows
from tidegauge.sources.tables import read_jsonl_or_empty


def append_results(df: DataFrame, path: str) -> None:
    """Add one batch of results to a JSON-lines folder."""
    df.write.mode("append").json(path)


def resume_and_append(rows: DataFrame, path: str, schema: T.StructType | str, keys: Sequence[str],
                      error: str | None = None) -> None:
    """Append only the rows that have no finished result in the folder yet."""
    done = read_jsonl_or_empty(rows.sparkSession, path, schema)
    append_results(pending_rows(rows, done, keys, error), path)


def ingest_new_files(spark: SparkSession, source: str, schema: T.StructType, target: str,
                     checkpoint: str) -> None:
    """Append every JSON-lines file not seen before, exactly once, then stop."""
    stream = spark.readStream.schema(schema).option("mode", "FAILFAST").json(source)
    query = (stream.writeStream.format("json").option("path", target)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()
