"""Near duplicates: 64-bit SimHash, candidates by Golay-code fuzzy hashing.

A fingerprint is cut into two segments of 23 bits, A and B, and one of 18, C.
The binary Golay code of length 23 is perfect: each 23-bit word has one codeword
within distance 3, and six or one within distance 4. Two words that differ in at
most two bits share a codeword within distance 4 of both (the one that decodes
the word between them), so the indices of those codewords are keys that stand two
errors. For four errors or fewer the pigeonhole gives these cases, each met by a key:

    C exact                    A or B has two at most      (key A, C) (key B, C)
    C not, A exact             B two at most, else C one   (A, key B) (A, two thirds of C)
    C not, B exact             likewise                    (B, key A) (B, two thirds of C)
    none exact                 A, B two at most, C too     (key A, key B, one third of C)
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import free_names, on_workers, whole_text, write_once
from tidegauge.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
BITMAP = 24
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_MASK = (1 << 23) - 1
_CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles, repeats included; zero without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    ends = ends[-n:]
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        part = [xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[i:min(n, i + _CHUNK)].tolist(), ends[i:i + _CHUNK].tolist())]
        hashes = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text) and ``fp`` (signed long) of every row, repeated rows included."""
    def run(batches):
        for b in batches:
            values = np.fromiter(map(fingerprint, b["text"]), np.uint64, len(b)).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "mark": b["mark"], "fp": values})

    on_workers(docs.sparkSession)
    # as text, since pandas turns whole numbers with nulls into floats
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"),
                       F.xxhash64(whole_text(text)).alias("mark"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, "doc_id string, mark long, fp long").withColumn("doc_id", F.col("doc_id").cast(kind))


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high half of a word, and the patterns of up to four bits per syndrome.

    Short lists of patterns repeat their first.
    """
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= _GENERATOR << (bit - 11)
        return word

    single = [remainder(1 << bit) for bit in range(23)]
    low = np.array([reduce(lambda a, b: a ^ single[b], (b for b in range(12) if i >> b & 1), 0) for i in range(1 << 12)])
    high = np.array([reduce(lambda a, b: a ^ single[12 + b], (b for b in range(11) if i >> b & 1), 0)
                     for i in range(1 << 11)])
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            at = reduce(lambda a, b: a ^ single[b], bits, 0)
            found[at].append(sum(1 << b for b in bits))
    patterns = np.array([(f + f[:1] * 6)[:6] if len(f) < 6 else f[:6] for f in found])
    return low, high, patterns


def fuzzy_keys(segment: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance 4 of each 23-bit word: n x 6, the first repeated if alone."""
    low, high, patterns = golay()
    syndrome = low[segment & 0xFFF] ^ high[segment >> 12]
    return (segment[:, None] ^ patterns[syndrome]) >> 11


def candidate_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the positions of their fingerprints; equal keys of one fingerprint come once."""
    u = fp.view(np.uint64)
    a, b, c = (u & np.uint64(_MASK)).astype(np.int64), (u >> np.uint64(23) & np.uint64(_MASK)).astype(np.int64), (
        u >> np.uint64(46)).astype(np.int64)
    thirds = [c & 63, c >> 6 & 63, c >> 12]
    ga, gb = fuzzy_keys(a), fuzzy_keys(b)
    one_a, one_b = ga[:, 1] == ga[:, 0], gb[:, 1] == gb[:, 0]  # six keys or one
    keep_a = np.ones((len(fp), 6), bool)
    keep_a[one_a, 1:] = False
    keep_b = np.ones((len(fp), 6), bool)
    keep_b[one_b, 1:] = False
    rows = np.arange(len(fp))
    keys, at = [], []

    def add(tag: int, values: np.ndarray, kept: np.ndarray | None = None) -> None:
        values = values.reshape(len(fp), -1)
        index = np.broadcast_to(rows[:, None], values.shape)
        kept = np.ones(values.shape, bool) if kept is None else kept.reshape(values.shape)
        keys.append((np.int64(tag) << 56 | values)[kept])
        at.append(index[kept])

    add(0, ga << 18 | c[:, None], keep_a)
    add(1, gb << 18 | c[:, None], keep_b)
    add(2, a[:, None] << 12 | gb, keep_b)
    add(3, b[:, None] << 12 | ga, keep_a)
    for i, (p, q) in enumerate(combinations(thirds, 2)):
        add(4 + i, a << 12 | p << 6 | q)
        add(7 + i, b << 12 | p << 6 | q)
    both, kept = ga[:, :, None] << 12 | gb[:, None, :], keep_a[:, :, None] & keep_b[:, None, :]
    for i, third in enumerate(thirds):
        add(10 + i, both << 6 | third[:, None, None], kept)
    return np.concatenate(keys), np.concatenate(at)


def _exploded(prints: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """Keys of each fingerprint; with a bitmap, only those whose bit is set.

    One row becomes about a hundred, so rows are dealt out before that.
    """
    def run(batches):
        for b in batches:
            values = b["fp"].to_numpy()
            for i in range(0, len(values), 4096):
                part = values[i:i + 4096]
                keys, at = candidate_keys(part)
                if wanted is not None:
                    u = keys.view(np.uint64)
                    bit = (u ^ u >> np.uint64(24) ^ u >> np.uint64(48)) & np.uint64((1 << BITMAP) - 1)
                    kept = (wanted[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                    keys, at = keys[kept], at[kept]
                yield pd.DataFrame({"key": keys, "fp": part[at]})

    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prints.select("fp").repartition(tasks).mapInPandas(run, "key long, fp long")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit per folded key: ``2 ** BITMAP`` bits whatever the number of keys.

    It only spares the shuffle of keys that are not there; the join decides.
    """
    k = F.col("key")
    bit = k.bitwiseXOR(F.shiftrightunsigned(k, 24)).bitwiseXOR(F.shiftrightunsigned(k, 48)).bitwiseAND(
        F.lit((1 << BITMAP) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    out = np.zeros(1 << (BITMAP - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _near(x: str, y: str):
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= DISTANCE


def linked_fingerprints(prints: DataFrame) -> DataFrame:
    """Components of distinct fingerprints (column ``fp``) under links of up to ``DISTANCE`` bits.

    Only fingerprints with a link get a row (``node``, ``root``). A key of two
    fingerprints is verified as it stands. Of larger keys every member is
    verified against the smallest and the largest one, which joins dense groups
    without listing their pairs. Then only keys that still hold members of
    different components are joined with themselves, and only across
    components, so no link is lost and no key is cut.
    """
    spark = on_workers(prints.sparkSession)
    keys = _exploded(prints)
    shared = write_once(keys.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count(F.lit(1)).alias("n"))
                        .where("n > 1"), "keys")
    larger = write_once(shared.where("n > 2").drop("n"), "large-keys")
    members = write_once(_exploded(prints, _bitmap(larger)).join(larger, "key"), "members")
    edges = (shared.where(_near("lo", "hi")).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
             .union(members.where(_near("fp", "lo")).select("lo", "fp"))
             .union(members.where(_near("fp", "hi")).select("fp", "hi")))
    first = components(edges)
    rooted = members.select("key", "fp").join(first, F.col("fp") == F.col("node"), "left").select(
        "key", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = write_once(rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
                       .select("key"), "mixed-keys")
    open_ = write_once(rooted.join(mixed, "key", "left_semi"), "mixed")
    other = open_.withColumnsRenamed({"key": "key2", "fp": "fp2", "root": "root2"})
    across = open_.join(other, (F.col("key") == F.col("key2")) & (F.col("root") < F.col("root2")) & _near("fp", "fp2"))
    second = components(across.select(F.col("root").alias("a"), F.col("root2").alias("b")))
    all_nodes = first.union(second.join(first, "node", "left_anti").select("node", F.col("node").alias("root")))
    return (all_nodes.join(second.withColumnsRenamed({"node": "n2", "root": "r2"}), F.col("root") == F.col("n2"), "left")
            .select("node", F.coalesce("r2", "root").alias("root")))


def _rooted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id``, ``mark``, ``fp``, ``component_id`` and ``root``, the fingerprint that stands for the component."""
    marked = write_once(fingerprints(docs, key, text), "fingerprints")
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = linked_fingerprints(prints)
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select(F.col("fp").alias("p"), "root", "component_id")
    return marked.join(named, F.col("fp") == F.col("p")).drop("p")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest key reachable by links, of every row.

    Null and empty texts have fingerprint zero and are linked like any other.
    Null keys name a component only if it has no other; repeated rows each get
    their row. Extra columns are not read. An empty table gives an empty one.
    """
    return _rooted(docs, key, text).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay: of each component the one with the smallest key, columns as they came.

    Rows are told apart by key and text; of several rows equal in both, one stays.
    """
    same_id, same_mark, mark = free_names(docs, "__id", "__m", "__mark")
    rows = write_once(_rooted(docs, key, text).groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("rows")), "members")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    best = rows.groupBy("root").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # The lists hold what goes and what comes twice, so they are short where duplicates are few.
    goes = write_once(rows.join(best, "root").where(place != F.col("best")).select(
        F.col("doc_id").alias(same_id), F.col("mark").alias(same_mark)), "dropped")
    twice = write_once(rows.where("rows > 1").select(F.col("doc_id").alias(same_id), F.col("mark").alias(same_mark)), "repeated")

    def listed(table: DataFrame):
        return F.col(key).eqNullSafe(table[same_id]) & (F.col(mark) == table[same_mark])

    stays = docs.withColumn(mark, F.xxhash64(whole_text(text))).join(goes, listed(goes), "left_anti")
    if twice.isEmpty():
        return stays.select(*docs.columns)
    again = stays.join(twice, listed(twice), "left_semi").dropDuplicates([key, mark])
    return stays.join(twice, listed(twice), "left_anti").unionByName(again).select(*docs.columns)
