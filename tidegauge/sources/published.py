"""Tables whose readers see whole writes only: checked tables and numbered batches.

Data are written to a folder that nobody reads yet. One atomic step, which at
most one writer can win, then makes them visible: a rename for a whole table, a
new log entry for a batch. A lost executor, a killed driver or a repeated job
leaves at most an unread folder.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from tidegauge.sources.tables import path_exists

_ENTRY = "version long, batch string, folder string"


class ContractError(ValueError):
    """A table was refused; ``violations`` holds the count of each broken rule."""

    def __init__(self, path: str, violations: Mapping[str, int]):
        super().__init__(f"{path} not published: {dict(violations)}")
        self.violations = dict(violations)


def write_validated(df: DataFrame, path: str, rules: Mapping[str, Column]) -> dict[str, int]:
    """Write a Parquet table and publish it if no row breaks a rule; gives the number of ``rows``.

    A rule is true for a row that breaks it; null is no breach. The counts
    come from the write itself, so the input is read once. A table that breaks a
    rule raises ``ContractError`` with all counts and never appears at ``path``;
    neither does a second table, as ``path`` must be new.
    """
    if path_exists(df.sparkSession, path):
        raise FileExistsError(path)
    seen, staged = Observation(), f"{path}.{uuid.uuid4().hex}"
    names = {f"rule_{i}": name for i, name in enumerate(rules)}
    counts = [F.count_if(F.coalesce(rule, F.lit(False))).alias(c) for c, rule in zip(names, rules.values())]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.parquet(staged)
    found = seen.get
    broken = {name: found[c] for c, name in names.items() if found[c]}
    if broken:
        _discard(df.sparkSession, staged)
        raise ContractError(path, broken)
    if not _move(df.sparkSession, staged, path):
        _discard(df.sparkSession, staged)
        raise FileExistsError(path)
    return {"rows": found["rows"]}


def append_batch(df: DataFrame, table: str, batch: str) -> bool:
    """Add a batch to a table once, however often and by however many writers it is sent.

    False if the batch is there already; its rows are then those of the writer
    that came first. Writers that meet take turns: the next version number
    can be created by one of them only, the others look again.
    """
    spark = df.sparkSession
    if batch in {e["batch"] for e in _entries(spark, table)}:
        return False
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{folder}")
    return publish(spark, table, batch, folder)


def publish(spark: SparkSession, table: str, batch: str, folder: str) -> bool:
    """Enter a written folder into the log unless the batch has an entry."""
    while True:
        entries = _entries(spark, table)
        if batch in {e["batch"] for e in entries}:
            return False
        version = len(entries)
        if _create(spark, f"{table}/log", f"{version:012d}.json", {"version": version, "batch": batch, "folder": folder}):
            return True


def read_batches(spark: SparkSession, table: str, schema: T.StructType | str, version: int | None = None) -> DataFrame:
    """All published batches, or those up to a version; a table without any is empty."""
    folders = [f"{table}/{e['folder']}" for e in _entries(spark, table) if version is None or e["version"] <= version]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def published_batches(spark: SparkSession, table: str) -> list[str]:
    """Names of the batches in the order of their versions."""
    return [e["batch"] for e in _entries(spark, table)]


def _entries(spark: SparkSession, table: str) -> list:
    """The log, a row per batch."""
    if not path_exists(spark, f"{table}/log"):
        return []
    try:
        rows = spark.read.schema(_ENTRY).option("mode", "FAILFAST").json(f"{table}/log").collect()
    except AnalysisException as failed:  # made by a writer that has not entered anything yet
        if failed.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(rows, key=lambda e: e["version"])


def _create(spark: SparkSession, folder: str, name: str, entry: dict) -> bool:
    """Make a small file appear whole, or not at all if its name is taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    parent = hadoop.Path(folder)
    system = parent.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(parent)
    draft = hadoop.Path(parent, f"_{uuid.uuid4().hex}")  # readers skip names with an underscore in front
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    won = _move(spark, draft.toString(), f"{folder}/{name}")
    if not won:
        system.delete(draft, False)
    return won


def _move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename to a new name; false if the name is taken.

    Hadoop's rename without overwrite is one step on a distributed file system.
    On a local disk it looks first and renames then, so a file gets a second
    name by a link instead, which fails if the name exists.
    """
    jvm = spark._jvm
    here, there = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    system = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file" and system.getFileStatus(here).isFile():
        paths = [system.makeQualified(p).toUri().getPath() for p in (here, there)]
        try:
            os.link(*paths)
        except FileExistsError:
            return False
        system.delete(here, False)
        return True
    none = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(here.toUri(), spark._jsc.hadoopConfiguration()) \
        if here.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = none
    try:
        context.rename(here, there, options)
    except Exception as failed:
        if "FileAlreadyExistsException" in str(failed):
            return False
        raise
    return True


def _discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that this write made and nobody has seen."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
