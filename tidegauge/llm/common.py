"""Small helpers the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.session import shared_folder, ship_package

BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

#: Words are maximal runs of anything but space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    An array used inside a lambda would otherwise be computed anew for each
    element once the optimizer merges two projections.
    """
    return F.transform(F.array(value), body)[0]


def whole_text(column: str | Column = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def id_crc32(key: Column) -> Column:
    """CRC-32 of the id written as decimal text; the fold of a row, null for a null id."""
    return F.crc32(key.cast("string").cast("binary"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write a table that later steps read several times and read it back.

    The files live in the shared folder, so they outlast executors and cut the
    lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` or, if the table has that column, the name with underscores in front."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def free_names(df: DataFrame, *names: str) -> list[str]:
    return [free_name(df, name) for name in names]


def on_workers(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python tasks, and keep their batches small.

    Texts can be long, so a batch holds at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark
