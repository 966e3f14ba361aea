"""Near duplicates: circulant MinHash, banding, exact Jaccard verification.

Shingles are numbered by a 32-bit hash, a circle of ``2 ** 32`` places. Two
permutations of the circle give all coordinates of a signature: the first,
``sigma``, scatters the shingles; coordinate ``k`` is the least value of the
second, ``pi``, shifted by ``k`` places. Bands of ``ROWS`` coordinates are keys.
A pair at the threshold of 0.8 misses all bands with probability
``(1 - 0.8 ** 5) ** 40``, about 1.3e-7; more similar pairs miss far more rarely.

Documents that share a key are compared first by parities: the set is dealt
into as many buckets as two to four times its size, with one bit per bucket for an odd
count. Buckets whose bits differ are at most as many as shingles that one set has and
the other lacks, so the test never drops a link, and it passes few
pairs below 0.78. The whole sets of 64-bit shingle hashes confirm the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.common import on_workers, whole_text, write_once
from tidegauge.llm.components import components

SHINGLE, PERCENT = 2, 80
BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_CHUNK = 512
_WORDS = 1 << 20
_WORDS_AT_LEAST = 4
_ARROW = "mark long, node binary, n long, bands array<long>, parity array<long>"


class WordHashes(dict):
    """64-bit hashes of words, computed once; emptied when it holds ``_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= _WORDS:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _B
    x = (x ^ x >> _U(27)) * _C
    return x ^ x >> _U(31)


def shingle_set(text: str | None, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    take = min(size, len(words))
    out = np.full(len(words) - take + 1, take, np.uint64)
    for i in range(take):
        out = _mixed(out * _A + h[i:len(words) - take + 1 + i])
    return np.unique(out)


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Coordinates of a set that is not empty: ``min pi(sigma(x) - k)`` for each shift ``k``."""
    sigma = (shingles * _A >> _U(32)).astype(np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(sigma), _CHUNK):
        v = sigma[None, i:i + _CHUNK] - shifts
        v ^= v >> np.uint32(16)
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        v *= np.uint32(0xC2B2AE35)
        v ^= v >> np.uint32(16)
        np.minimum(out, v.min(axis=1), out=out)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, the band's number included."""
    rows = coordinates.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _mixed(key * _A + rows[:, i])
    return key.view(np.int64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """One bit per bucket, set for an odd number of shingles, as longs; 2 ** i buckets, 256 at least, two to four times the set's size."""
    buckets = max(64 * _WORDS_AT_LEAST, 2 << int(len(shingles) - 1).bit_length())
    odd = (np.bincount((shingles & _U(buckets - 1)).astype(np.int64), minlength=buckets) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _lists(rows: list[np.ndarray], kind=pa.int64()) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64) if len(flat) else [], kind))


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``mark`` (hash of the text), ``node`` (128-bit hash of the set, null if empty), ``n``, ``bands``, ``parity``."""
    def run(batches):
        from xxhash import xxh3_128_digest

        known, none = WordHashes(), np.zeros(0, np.int64)
        for b in batches:
            nodes, sizes, bands, parities = [], [], [], []
            for t in b.column(1):
                found = shingle_set(t.as_py(), known)
                some = len(found) > 0
                nodes.append(xxh3_128_digest(found.tobytes()) if some else None)
                sizes.append(len(found))
                bands.append(band_keys(signature(found)) if some else none)
                parities.append(parity(found) if some else none)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), _lists(bands), _lists(parities)],
                names=["doc_id", "mark", "node", "n", "bands", "parity"])

    on_workers(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(whole_text(text)).alias("mark"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, {_ARROW}")


def _alike(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Whether sizes and parities allow the similarity; true for every pair that has it.

    Of sets so alike in size one has at most twice the other's buckets; its
    halves are folded together.
    """
    common = F.least(F.size(p1), F.size(p2))

    def folded(p: Column, i: Column) -> Column:
        return F.get(p, i).bitwiseXOR(F.when(F.size(p) > common, F.get(p, i + common)).otherwise(F.lit(0)))

    differ = F.aggregate(F.sequence(F.lit(0), common - 1), F.lit(0), lambda total, i: total + F.bit_count(
        folded(p1, i).bitwiseXOR(folded(p2, i))))
    sizes = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    return F.when(sizes, differ * (100 + percent) <= (n1 + n2) * (100 - percent)).otherwise(F.lit(False))


def _coarse(p: Column) -> list[Column]:
    """The parities folded to the smallest number of buckets."""
    return [F.aggregate(F.sequence(F.lit(i), F.size(p) - 1, F.lit(_WORDS_AT_LEAST)), F.lit(0).cast("long"),
                        lambda x, j: x.bitwiseXOR(F.get(p, j))).alias(f"p{i}") for i in range(_WORDS_AT_LEAST)]


def _likely(pairs: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` (nodes) whose sizes and parities allow a link; other columns stay."""
    def side(name: str) -> DataFrame:
        return prints.select(F.col("node").alias(name), F.struct("n", "parity").alias(f"_{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_alike(F.col("_a.n"), F.col("_a.parity"), F.col("_b.n"), F.col("_b.parity"), percent)).select(*pairs.columns)


def _perhaps_in(rows: DataFrame, name: str, table: DataFrame, other: str) -> DataFrame:
    """The ``rows`` whose hash ``name`` may be in the column ``other``, so that a join need not shuffle the rest.

    A bitmap of 2 ** 16 to 2 ** 27 bits (16 MB), by the number of hashes, is
    broadcast; where more hashes fill it, fewer rows are spared.
    """
    spark = rows.sparkSession
    power = min(27, max(16, 5 + table.count().bit_length()))
    bit = F.col(other).bitwiseAND(F.lit((1 << power) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = table.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    bitmap = np.zeros(1 << (power - 6), np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    @F.pandas_udf("boolean")
    def there(hashes: pd.Series) -> pd.Series:
        at = hashes.to_numpy(np.int64).view(np.uint64) & _U((1 << power) - 1)
        return pd.Series((shared.value[at >> _U(6)] >> (at & _U(63)) & _U(1)).astype(bool))

    return rows.where(there(F.col(name)))


def _verified(docs: DataFrame, prints: DataFrame, pairs: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """The written ``pairs`` whose whole sets have the similarity.

    Sets are read again from one document of each node in a pair, so those of
    other texts are never stored; they are shuffled once for both sides.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    picks = write_once(prints.join(wanted, "node").select(
        F.col("pick.doc_id").alias("_id"), F.col("pick.mark").alias("_mark"), F.col("node").alias("_node")), "picks")

    def run(batches):
        known = WordHashes()
        for b in batches:
            found = [shingle_set(t.as_py(), known) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(found)], names=["node", "shingles"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(whole_text(text)).alias("_m"))
    rows = _perhaps_in(rows, "_m", picks, "_mark")
    chosen = rows.join(picks, (F.col("_m") == F.col("_mark")) & F.col("_key").eqNullSafe(F.col("_id"))).select("_node", "_text")
    sets = (chosen.mapInArrow(run, "node binary, shingles array<long>")
            .groupBy("node").agg(F.first("shingles").alias("shingles")))  # rows may repeat
    left, right = sets.withColumnsRenamed({"node": "a", "shingles": "sa"}), sets.withColumnsRenamed({"node": "b", "shingles": "sb"})
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(right, "b").join(left, "a").where(
        common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")


def _rooted(rows: DataFrame, roots: DataFrame, name: str, root: str) -> DataFrame:
    """Add the root of the node in column ``name``; a node without a row is its own."""
    return (rows.join(roots.withColumnsRenamed({"node": "_n", "root": "_r"}), F.col(name) == F.col("_n"), "left")
            .withColumn(root, F.coalesce("_r", name)).drop("_n", "_r"))


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The roots after more ``edges`` (``a``, ``b``) between nodes."""
    ends = _rooted(_rooted(edges, roots, "a", "x"), roots, "b", "y")
    merged = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    fresh = merged.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    return write_once(_rooted(roots.union(fresh).withColumnRenamed("root", "_old"), merged, "_old", "root").select("node", "root"), "roots")


def linked_sets(docs: DataFrame, prints: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components (``node``, ``root``) of distinct sets under links of at least ``percent``; only linked nodes have a row.

    Links between members of a key are looked for in three steps, each only
    across the components of the last. First every node is confirmed against
    that smallest or largest member of its keys with which it shares most keys; this joins
    dense groups at one pair per node. Then against the smallest and largest members of all its
    keys. Then keys that still hold several components are joined with
    themselves: members outside the key's largest component against all,
    below the conditions on size and parity. So no link of two members of a
    key is lost, no key is cut, and members of one component are not compared.
    """
    keys = prints.select(F.explode("bands").alias("key"), "node")
    shared = write_once(keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("rows"))
                        .where("rows > 1"), "keys")
    members = write_once(keys.join(shared.where("rows > 2").drop("rows"), "key"), "members")
    stars = (shared.select("lo", "hi").union(members.select("lo", "node")).union(members.select("hi", "node"))
             .toDF("a", "b").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys")))
    pairs = write_once(_likely(stars, prints, percent), "pairs")
    best = pairs.groupBy(F.col("b").alias("node")).agg(F.max(F.struct("keys", "a"))["a"].alias("a"))
    first = write_once(best.select("a", F.col("node").alias("b")), "best-pairs")
    roots = components(_verified(docs, prints, first, percent, key, text))
    more = _rooted(_rooted(pairs.join(first, ["a", "b"], "left_anti"), roots, "a", "x"), roots, "b", "y").where("x <> y")
    more = write_once(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "more-pairs")
    roots = _joined(roots, _verified(docs, prints, more, percent, key, text))

    held = _rooted(members.select("key", "node"), roots, "node", "root")
    per_root = held.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
    mixed = write_once(per_root.groupBy("key").agg(F.max(F.struct("rows", "root"))["root"].alias("major"), F.count(F.lit(1)).alias("roots"))
                       .where("roots > 1").drop("roots"), "mixed-keys")
    facts = prints.select("node", "n", "parity", *_coarse(F.col("parity")), "bands")
    open_ = write_once(held.join(mixed, "key").join(facts, "node").withColumn("bands", F.expr(
        "slice(bands, 1, cast(array_position(bands, key) as int) - 1)")), "mixed")
    minor = open_.where("root <> major").withColumnsRenamed({c: f"{c}2" for c in open_.columns})
    apart = (F.col("key") == F.col("key2")) & ((F.col("root") == F.col("major")) | (F.col("root") < F.col("root2")))
    # the coarse test is a bound as well, and cheap
    differ = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"p{i}2"))) for i in range(_WORDS_AT_LEAST)), F.lit(0))
    apart &= differ * (100 + percent) <= (F.col("n") + F.col("n2")) * (100 - percent)
    # an earlier key that both have has met them already; a key of two was a pair above
    met = F.exists(F.zip_with("bands", "bands2", lambda x, y: x.eqNullSafe(y)), lambda same: same)
    alike = _alike(F.col("n"), F.col("parity"), F.col("n2"), F.col("parity2"), percent)
    across = open_.join(minor, apart & F.when(alike, ~met).otherwise(F.lit(False)))
    across = write_once(across.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct(), "across")
    return _joined(roots, _verified(docs, prints, across, percent, key, text))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the smallest key reachable by links) and ``kept`` of every row.

    Texts with equal sets are one node. Null, empty and blank texts have the
    empty set and are linked with nothing, each its own component. Null keys name
    a component only if it has no other; such a row is kept if its component has
    no key. Repeated rows each get their row. Other columns are not read, so
    their names cannot clash. An empty table gives an empty one.
    """
    marked = write_once(signatures(docs, key, text), "signatures")
    prints = write_once(marked.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "mark")).alias("pick"), F.first("n").alias("n"),
        F.first("bands").alias("bands"), F.first("parity").alias("parity")), "prints")
    roots = linked_sets(docs, prints, percent, key, text).withColumnRenamed("node", "_n")
    rooted = prints.join(roots, F.col("node") == F.col("_n"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select(F.col("node").alias("_n"), "component_id")
    out = marked.select("doc_id", "node", "n").join(named, F.col("node") == F.col("_n"), "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
