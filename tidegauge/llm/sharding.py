"""Shards by fixed virtual slots and a versioned slot-to-shard map.

Native: column functions, joins and windows only. A record's slot never changes;
only the map from slots to shards does, so rebalancing edits a few thousand rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm.common import free_names, let, scratch_path, whole_text

SLOTS = 4096


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus one for its end."""
    return (F.octet_length(whole_text(text)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(whole_text(text).cast("binary"))


def slot_of(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a record from its key, size and checksum."""
    return F.pmod(F.xxhash64(key, record_size(text), text_crc32(text)), F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame, slot: str, size: str) -> DataFrame:
    """Bytes and rows per slot; at most ``SLOTS`` rows."""
    return records.groupBy(F.col(slot).alias("slot")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 0: slots dealt round robin."""
    return sizes.select(F.lit(0).alias("version"), "slot", (F.col("slot") % shards).alias("shard"), "bytes", "rows")


def rebalanced(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, with sizes near equal.

    Slots are taken from the largest down. A slot stays where it is while that
    keeps its shard at or under the mean; else it moves to the least filled
    shard. The map is one bounded array, so one fold over it settles all.
    """
    versions = current.agg((F.max("version") + 1).alias("v"))
    known = sizes.join(current.select("slot", "shard"), "slot", "left").withColumn(
        "shard", F.coalesce("shard", F.col("slot") % shards))
    packed = known.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "slot", "shard", "rows")))
                       .alias("all"), F.sum("bytes").alias("total"))

    def step(a: Column, x: Column, mean: Column) -> Column:
        least = (F.array_position(a["loads"], F.array_min(a["loads"])) - 1).cast("int")
        stays = (x["shard"] < shards) & (F.get(a["loads"], x["shard"]) - x["b"] <= mean)
        return let(F.when(stays, x["shard"]).otherwise(least), lambda goes: F.struct(
            F.transform(a["loads"], lambda v, j: F.when(j == goes, v - x["b"]).otherwise(v)).alias("loads"),
            F.concat(a["owners"], F.array(goes)).alias("owners")))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
                     F.array().cast("array<int>").alias("owners"))
    owners = F.aggregate("all", start, lambda a, x: step(a, x, F.ceil(F.col("total") / shards)))["owners"]
    zipped = packed.withColumn("owners", owners).select(F.explode(F.arrays_zip("all", "owners")).alias("x"))
    return zipped.select("x.all.slot", F.col("x.owners").alias("shard"), (-F.col("x.all.b")).alias("bytes"),
                         F.col("x.all.rows").alias("rows")).withColumn("version", versions.scalar())


def store(table: DataFrame, folder: str) -> DataFrame:
    """Append one version of the map to the store and read it back."""
    table.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)


def latest(stored: DataFrame) -> DataFrame:
    return stored.join(stored.agg(F.max("version").alias("version")), "version")


def shard_records(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", slots: int = SLOTS,
                  folder: str | None = None) -> DataFrame:
    """Put every row into a shard; sizes are near equal.

    Added: ``size``, ``text_crc32``, ``virtual_slot``, ``shard``, ``map_version``
    and ``slot``, the row's place in its shard, without gaps from 0. Places follow
    virtual slot, then key; only rows that are equal in key, size and checksum
    can swap. Columns of these names are replaced. A null text has size 1 and
    checksum 0; a null key is hashed by size and checksum. The map is stored in ``folder`` (by default a new
    one in the shared folder), one version per edit. No group is larger than a
    slot, and the map is broadcast, as it has at most ``slots`` rows.
    """
    spark = docs.sparkSession
    t = F.col(text)
    order, of_slot, first_place, place = free_names(docs, "__key", "__slot", "__first", "__place")
    rows = docs.withColumns({"size": record_size(t), "text_crc32": text_crc32(t), "virtual_slot": slot_of(F.col(key), t, slots),
                             order: F.col(key)})
    sizes = slot_sizes(docs.select(slot_of(F.col(key), t, slots).alias("virtual_slot"), record_size(t).alias("size")),
                       "virtual_slot", "size")
    folder = folder or scratch_path(spark, "slot-map")
    first = store(first_map(sizes, shards), folder)
    table = latest(store(rebalanced(first, first.select("slot", "bytes", "rows"), shards), folder))
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = table.select(F.col("slot").alias(of_slot), F.col("shard").cast("int").alias("shard"),
                          F.col("version").alias("map_version"),
                          F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(first_place))
    within = Window.partitionBy("virtual_slot").orderBy(order, "size", "text_crc32")
    return (rows.drop("shard", "map_version", "slot")
            .withColumn(place, F.row_number().over(within) - 1)
            .join(F.broadcast(placed), F.col("virtual_slot") == F.col(of_slot))
            .withColumn("slot", F.col(first_place) + F.col(place))
            .drop(of_slot, first_place, place, order))
