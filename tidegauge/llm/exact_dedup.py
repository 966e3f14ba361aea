"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after lower-casing A to Z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.common import free_names, whole_text, write_once

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 128


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_sha256(text: Column) -> Column:
    return F.sha2(folded(whole_text(text)).cast("binary"), 256)


def _length(text: Column) -> Column:
    return F.octet_length(whole_text(text))


def _prefix(text: Column) -> Column:
    return F.xxhash64(folded(F.substring(whole_text(text), 1, PREFIX)))


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Lengths and prefixes that several rows share, and one row per text that occurs more than once.

    Columns of the first: ``n``, ``prefix``; of the second: ``sha`` (hex),
    ``keep_id`` (the largest key; null if all are null), ``group_size`` and
    ``top_rows``, how many rows have that key.

    Each round counts a finer key on the rows that share the coarser one and
    writes the shared keys to the shared folder. Their size is then known, so
    the planner broadcasts them to the scan while they are small and shuffles
    both sides beyond its threshold. Counts are combined before each shuffle,
    so a hot length or text is one row per task.
    """
    t = F.col(text)
    rows = docs.select(F.col(key).alias("key"), t.alias("text"), _length(t).alias("n"))
    lengths = write_once(rows.groupBy("n").count().where("count > 1").select("n"), "lengths")
    same_length = rows.join(lengths, "n", "left_semi").withColumn("prefix", _prefix(F.col("text")))
    prefixes = write_once(
        same_length.groupBy("n", "prefix").count().where("count > 1").select("n", "prefix"), "prefixes")
    full = same_length.join(prefixes, ["n", "prefix"], "left_semi").select("key", text_sha256(F.col("text")).alias("sha"))
    per_key = full.groupBy("sha", "key").agg(F.count(F.lit(1)).alias("rows"))
    # a null key is the smallest
    top = F.max(F.struct(F.col("key").isNotNull(), F.col("key").alias("key"), F.col("rows").alias("rows")))
    return prefixes, write_once(
        per_key.groupBy("sha").agg(top.alias("top"), F.sum("rows").alias("group_size")).where("group_size > 1")
        .select("sha", F.col("top.key").alias("keep_id"), "group_size", F.col("top.rows").alias("top_rows")), "groups")


def mark_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` to every row.

    The row with the largest key of equal texts stays. Rows that repeat that key
    with an equal text are one document and are all marked kept;
    ``distinct_documents`` leaves one of them. Null counts as the empty text; a
    null key loses to any other. Columns of these names are replaced. A hot text
    is a skewed key of a left join, which the adaptive planner splits.
    """
    sha, keep, size = free_names(docs, "__sha", "__keep", "__size")
    groups = duplicate_groups(docs, key, text)[1].withColumnsRenamed(
        {"sha": sha, "keep_id": keep, "group_size": size}).drop("top_rows")
    joined = docs.withColumn("text_sha256", text_sha256(F.col(text))).join(
        groups, F.col("text_sha256") == F.col(sha), "left")
    alone = F.col(sha).isNull()
    kept = alone | F.col(key).eqNullSafe(F.col(keep))
    return (joined.withColumns({
        "keep_id": F.when(alone, F.col(key)).otherwise(F.col(keep)),
        "group_size": F.coalesce(size, F.lit(1)).cast("long"), "kept": kept})
        .drop(sha, keep, size))


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of the input; one row of each text.

    Rows that share neither length nor prefix with another pass as they are. The
    rest are hashed in full, and only they meet the groups in a join.
    """
    prefixes, groups = duplicate_groups(docs, key, text)
    n, prefix, sha, found, keep, size, rows = free_names(docs, "__n", "__prefix", "__sha", "__s", "__keep", "__size", "__rows")
    same = prefixes.withColumnsRenamed({"n": n, "prefix": prefix})
    marked = docs.withColumns({n: _length(F.col(text)), prefix: _prefix(F.col(text))})
    alone = marked.join(same, [n, prefix], "left_anti")
    joined = marked.join(same, [n, prefix], "left_semi").withColumn(sha, text_sha256(F.col(text))).join(
        groups.withColumnsRenamed({"sha": found, "keep_id": keep, "group_size": size, "top_rows": rows}),
        F.col(sha) == F.col(found), "left")
    stays = joined.where(F.col(found).isNull() | F.col(key).eqNullSafe(F.col(keep)))
    kept = alone.select(*docs.columns).unionByName(stays.where(F.coalesce(rows, F.lit(1)) == 1).select(*docs.columns))
    if groups.where("top_rows > 1").isEmpty():
        return kept
    # partial aggregation, so a hot row is one per task
    repeated = stays.where(F.col(rows) > 1).dropDuplicates([sha])
    return kept.unionByName(repeated.select(*docs.columns))
