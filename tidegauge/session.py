"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators need on an existing session.

    All time arithmetic is done in UTC, so that a ``timestamp_ntz`` column and
    an epoch column mean the same instant.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Needed by the few operators that run pandas code in tasks when the package
    is not installed on the workers.
    """
    context = spark.sparkContext
    if getattr(context, "_tidegauge_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tidegauge-code-"), "tidegauge.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    context.addPyFile(archive)
    context._tidegauge_shipped = True


def build_session(app: str = "tidegauge", master: str | None = None,
                  shuffle_partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """Build a session; on a cluster the submit command supplies master and memory."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return configure(builder.getOrCreate())


@contextmanager
def settings(spark: SparkSession, held: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only on a local master, where the one process sees every path, a temporary
    folder stands in for an absent setting; it goes when the process ends. On a
    cluster the absence raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    master = context.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    if not getattr(context, "_tidegauge_folder", None):
        context._tidegauge_folder = tempfile.mkdtemp(prefix="tidegauge-")
        atexit.register(shutil.rmtree, context._tidegauge_folder, ignore_errors=True)
    return context._tidegauge_folder
