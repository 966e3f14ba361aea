"""Checked writes and numbered batches: whole, once, or not at all."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import published as PUB

SCHEMA = "k long, batch string"


def rows_of(spark, n, batch):
    return spark.range(n).select(F.col("id").alias("k"), F.lit(batch).alias("batch"))


def content(spark, table):
    return sorted((r["batch"], r["k"]) for r in PUB.read_batches(spark, table, SCHEMA).collect())


def test_a_good_table_is_published_with_one_job(spark, tmp_path):
    path = f"{tmp_path}/good"
    spark.sparkContext.setJobGroup("validated", "one write")
    found = PUB.write_validated(rows_of(spark, 50, "a").repartition(4), path, {"null key": F.col("k").isNull(), "odd 'name'": F.lit(None)})
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("validated")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {"rows": 50} and spark.read.parquet(path).count() == 50
    # the shuffle is a job of its own under adaptive execution, the write another; no job counts
    assert len(jobs) <= 2
    with pytest.raises(FileExistsError):
        PUB.write_validated(rows_of(spark, 1, "b"), path, {})
    assert spark.read.parquet(path).count() == 50


def test_a_bad_table_never_appears(spark, tmp_path):
    rules = {"odd": F.col("k") % 2 == 1, "large": F.col("k") > 90, "never": F.col("k") < 0}
    with pytest.raises(PUB.ContractError) as refused:
        PUB.write_validated(rows_of(spark, 100, "a"), f"{tmp_path}/bad", rules)
    assert refused.value.violations == {"odd": 50, "large": 9}
    assert os.listdir(tmp_path) == []
    assert PUB.write_validated(rows_of(spark, 0, "a"), f"{tmp_path}/empty", rules) == {"rows": 0}


def test_repeated_and_killed_batches_count_once(spark, tmp_path):
    table = f"{tmp_path}/t"
    assert content(spark, table) == [] and PUB.published_batches(spark, table) == []
    assert PUB.append_batch(rows_of(spark, 3, "a"), table, "a")
    rows_of(spark, 9, "lost").write.parquet(f"{table}/data/killed")  # died before its entry
    assert not PUB.append_batch(rows_of(spark, 7, "a"), table, "a")
    assert PUB.append_batch(rows_of(spark, 2, "b"), table, "b")
    assert not PUB.publish(spark, table, "b", "data/killed")
    assert content(spark, table) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert PUB.published_batches(spark, table) == ["a", "b"]
    assert PUB.read_batches(spark, table, SCHEMA, version=0).count() == 3


def test_writers_at_once_lose_and_repeat_nothing(spark, tmp_path):
    table = f"{tmp_path}/t"
    names = [f"b{i % 6}" for i in range(12)]  # each batch by two writers
    with ThreadPoolExecutor(12) as pool:
        won = list(pool.map(lambda name: PUB.append_batch(rows_of(spark, 4, name), table, name), names))
    assert sum(won) == 6 and sorted(PUB.published_batches(spark, table)) == sorted(set(names))
    assert content(spark, table) == sorted((name, k) for name in set(names) for k in range(4))


def test_failed_write_leaves_the_table_as_it_was(spark, tmp_path):
    table = f"{tmp_path}/t"
    PUB.append_batch(rows_of(spark, 2, "a"), table, "a")
    broken = rows_of(spark, 5, "b").withColumn("k", F.expr("if(k = 4, cast(raise_error('no') as bigint), k)"))
    with pytest.raises(Exception, match="no"):
        PUB.append_batch(broken, table, "b")
    assert PUB.published_batches(spark, table) == ["a"]
    assert PUB.append_batch(rows_of(spark, 5, "b"), table, "b") and len(content(spark, table)) == 7
