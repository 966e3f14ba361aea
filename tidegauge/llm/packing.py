"""Packing by cutting stock: column generation over the histogram of piece lengths.

Texts become token ids; ids beyond a sequence are cut off in whole sequences, so
only remainders need packing. Pieces of one short length are bundled so that a
bundle fills whole units or nearly so; bundles and other pieces, rounded up to a unit, make a
histogram of bounded size, whatever the number of documents. Its cutting-stock
linear program is solved on the driver, and the rounded patterns are handed to
documents by their rank within a length.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm.common import on_workers, scratch_path

CAPACITY = 4096
UNIT = 8
END_ID = 2
TOKENIZER = "word_bpe_49k.json"

_CACHED = 500_000
_MARKS = ".,;:!?&%$#*|"
_LETTERS = "abcdefghijklm nopqrstuvwxyz s t re ve m ll d i"
_PART_BYTES = 1 << 22
_GROUP_ROWS = 100_000


class Encoder:
    """Token ids as little-endian 32-bit bytes, with a bounded memory of encoded words.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its pieces between spaces and line feeds. It also parts
    letters from marks, so new words of plain small letters are encoded together
    as one text and told apart by the ids that end a word; others one by one.
    Where the tokenizer leaves words of small ASCII letters as they are, these go to its model at once.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to other tasks
        self._tokenizer = self._bare = Tokenizer.from_str(tokenizer_json)
        normal, parted = self._tokenizer.normalizer, self._tokenizer.pre_tokenizer
        text = normal.normalize_str(_LETTERS) if normal else _LETTERS
        if text == _LETTERS and parted and [w for w, _ in parted.pre_tokenize_str(text)] == _LETTERS.split():
            self._bare = Tokenizer.from_str(tokenizer_json)
            self._bare.normalizer, self._bare.pre_tokenizer = None, WhitespaceSplit()
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._known: dict[str, bytes] = {"": b""}
        self._older: dict[str, bytes] = {}

    def _one_by_one(self, words: list[str]) -> None:
        for word, e in zip(words, self._tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self._known[word] = np.array(e.ids, "<u4").tobytes()

    def _together(self, tokenizer, words: list[str]) -> None:
        for i in range(0, len(words), 2000):
            some = words[i:i + 2000]
            e, = tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(some):
                self._one_by_one(some)
                continue
            flat, at = ids.tobytes(), 0
            for word, end in zip(some, (4 * ends).tolist()):
                self._known[word] = flat[at:end]
                at = end

    def _learn(self, words: list[str]) -> None:
        self._together(self._bare, [w for w in words if w.isascii() and w.islower() and w.isalpha()])
        plain, built, other = set(), [], []
        for word in words:
            if word in self._known:
                continue
            base = word.rstrip(_MARKS)
            small = base.lower() if base.isascii() else base
            if small.isalpha() and small.islower() and (small.isascii() or is_normalized("NFC", small)):
                plain.add(small)
                if small != word:
                    built.append((word, small, word[len(base):]))
            else:
                other.append(word)
        marks = {m for _, _, m in built}
        self._one_by_one([w for w in other + list(marks) if w not in self._known])
        self._together(self._tokenizer, [w for w in plain if w not in self._known])
        for word, small, mark in built:
            self._known[word] = self._known[small] + self._known[mark]

    def _look_up(self, words: list[str]) -> list[bytes]:
        if len(self._known) > _CACHED:
            self._known, self._older = {"": b""}, self._known
        found = list(map(self._known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for word in map(words.__getitem__, missing):
            ids = self._older.get(word)
            if ids is None:
                new.append(word)
            else:
                self._known[word] = ids
        if new:
            self._learn(new)
        for i in missing:
            found[i] = self._known[words[i]]
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text.

        Arrow parts the texts and numbers their words. Of each distinct word of
        ASCII letters and marks after them, small letters and marks are looked up apart, of others the whole.
        """
        parts = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        words = parts.flatten().dictionary_encode()
        whole = words.dictionary
        base = pc.utf8_rtrim(whole, _MARKS)
        plain = pc.and_(pc.string_is_ascii(base), pc.ascii_is_alpha(base))
        keys = pc.if_else(plain, pc.ascii_lower(base), whole).dictionary_encode()
        marked = np.flatnonzero(pc.and_(plain, pc.less(pc.binary_length(base), pc.binary_length(whole))).to_numpy(False))
        lengths = pc.binary_length(base).to_numpy()[marked].tolist()
        marks = [word[n:] for word, n in zip(whole.take(pa.array(marked)).to_numpy(False), lengths)]
        kinds = {m: i for i, m in enumerate(dict.fromkeys(marks))}

        first = self._look_up(keys.dictionary.to_numpy(False).tolist())
        ids = first + self._look_up(list(kinds)) + [b""]
        # a word is two runs of ids: of its letters, and of its marks or the empty one at the end
        runs = np.full((len(whole), 2), len(ids) - 1)
        runs[:, 0] = keys.indices.to_numpy()
        runs[marked, 1] = [len(first) + kinds[m] for m in marks]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, _ = _gather(np.frombuffer(b"".join(ids), "<u4"), sizes, runs.reshape(-1))
        raw, ends = _gather(flat, sizes[runs].sum(axis=1), words.indices.to_numpy())
        raw, ends = raw.tobytes(), (4 * ends[parts.offsets.to_numpy()]).tolist()
        return [raw[i:j] for i, j in zip(ends, ends[1:])]


def _gather(values: np.ndarray, sizes: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values``, which has them one after the other with these sizes, in the order picked; and where they end, from 0."""
    counts = sizes[picked]
    ends = np.append(0, np.cumsum(counts))
    places = np.repeat((np.cumsum(sizes) - sizes)[picked] - ends[:-1], counts)
    places += np.arange(len(places))
    return values[places], ends


_encoders: dict[int, Encoder] = {}


def encoder_of(shared) -> Encoder:
    """One encoder per worker process and broadcast."""
    if shared not in _encoders:
        _encoders.clear()
        _encoders[shared] = Encoder(shared.value)
    return _encoders[shared]


def _batched(texts: pa.Array):
    """Runs of texts of about ``_PART_BYTES``."""
    first, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > _PART_BYTES:
            yield first, texts[first:i]
            first, size = i, 0
        size += n
    if len(texts):
        yield first, texts[first:]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, key: str = "doc_id",
                 text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every row: key, start, length, ids_crc32, doc_tokens and, if asked, ids.

    The end id follows the ids of each text; a null text counts as empty.
    """
    spark = on_workers(docs.sparkSession)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    with open(tokenizer, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encoder = encoder_of(shared)
        for b in batches:
            for first, part in _batched(pc.fill_null(b.column(1), "")):
                rows, ids = [], []
                for i, raw in enumerate(encoder.encode(part), first):
                    raw += end
                    n = len(raw) // 4
                    for start in range(0, n, capacity):
                        cut = raw[4 * start:4 * (start + capacity)]
                        rows.append((i, start, len(cut) // 4, zlib.crc32(cut), n))
                        if with_ids:
                            ids.append(np.frombuffer(cut, "<u4").astype(np.int64))
                at, *numbers = (pa.array(c, pa.int64()) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), *numbers, *[pa.array(ids, pa.list_(pa.int64()))] * with_ids],
                                                 names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def bundle_of(length: int, room: int, unit: int = UNIT) -> int:
    """How many pieces of one length make an item, so that a sequence of such items holds most ids.

    An item of several takes at most an eighth of the room (in units), so that
    items still combine; of equal choices the smallest counts.
    """
    def held(each: int) -> int:
        return room // -(-each * length // unit) * each

    return max(range(1, max(1, room // 8 * unit // length) + 1), key=lambda each: (held(each), -each))


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most valuable pattern that fits: unbounded knapsack by dynamic programming over the room."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    worth = values > 1e-12
    items, gains = np.flatnonzero(worth), values[worth]
    widths = sizes[worth]
    order = np.argsort(widths)
    items, gains, widths = items[order], gains[order], widths[order]
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        k = np.searchsorted(widths, c, side="right")
        if k:
            got = gains[:k] + best[c - widths[:k]]
            j = got.argmax()
            if got[j] > best[c] + 1e-12:
                best[c], took[c] = got[j], items[j]
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[room]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3,
                  most: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, so that every item of ``demand`` is in exactly one.

    Revised simplex on the patterns found so far; the knapsack prices a new one
    until it proves the program within ``gap`` of its optimum, or ``most``
    columns were tried (which costs padding, not items). Fractions are rounded
    down and what is left is packed first fit, largest first.
    """
    m = len(sizes)
    patterns = np.diag(room // sizes).astype(float)  # columns are patterns
    amounts = demand / np.diag(patterns)
    inverse = np.diag(1 / np.diag(patterns))
    for turn in range(most):
        dual = inverse.sum(axis=0)
        value, pattern = price(dual, sizes, room)
        if value <= 1 + gap:
            break
        direction = (inverse * pattern).sum(axis=1)
        steps = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(steps.argmin())
        amounts = amounts - steps[out] * direction
        amounts[out] = steps[out]
        np.maximum(amounts, 0, out=amounts)
        patterns[:, out] = pattern
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        if turn % 200 == 199:  # one Newton step takes out what rounding has added
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, np.einsum("ij,jk->ik", patterns, inverse))
            amounts = np.maximum((inverse * demand).sum(axis=1), 0)
    used = [(patterns[:, j].astype(np.int64), int(np.floor(amounts[j] + 1e-9))) for j in range(m)]
    left = demand.astype(np.int64) - sum((p * n for p, n in used), np.zeros(m, np.int64))
    for j, (p, n) in enumerate(used):  # rounding noise of the simplex
        while n and (left < 0)[p > 0].any():
            left, n = left + p, n - 1
        used[j] = (p, n)
    used = [(p, n) for p, n in used if n]
    while left.any():
        p, free = np.zeros(m, np.int64), room
        for i in np.argsort(-sizes):
            k = min(left[i], free // sizes[i])
            p[i], free = k, free - k * sizes[i]
        n = int((left[p > 0] // p[p > 0]).min())
        left = left - p * n
        used.append((p, n))
    return used


def pack(docs: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, tokenizer: str | None = None, key: str = "doc_id",
         text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every id of every row in one piece, every piece in one sequence of at most ``capacity`` ids.

    Columns: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` (without gaps from 0), ``offset`` and, if asked, ``ids``.
    Null and empty texts give a piece of the end id alone; repeated rows and
    null keys are packed like others; extra columns are not read; an empty table
    gives an empty one.

    Pieces are written once to the shared folder, each with a number of its own. The driver sees
    counts per length (``capacity`` of them at most). Ranks within a length come from
    counts of hashed groups of about a hundred thousand rows, so neither a hot length nor
    a row that repeats is one task; a sequence holds at most ``capacity`` pieces.
    Pieces left over from bundles, fewer than a bundle for each length, are items of their own.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    made = token_pieces(docs, tokenizer, capacity, key, text, with_ids).withColumn("number", F.monotonically_increasing_id())
    made.write.parquet(path)
    pieces = spark.read.schema(made.schema).parquet(path)
    room, items, lengths = capacity // unit, Counter(), []
    for length, n in sorted((r["length"], r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()):
        each = bundle_of(length, room, unit)
        wide, narrow, whole = -(-each * length // unit), -(-length // unit), n // each
        first = items[wide]
        items[wide] += whole
        lengths.append((length, -(-n // _GROUP_ROWS), each, whole, wide, first, narrow, items[narrow]))
        items[narrow] += n - whole * each
    counts = sorted((u, n) for u, n in items.items() if n)
    sizes, demand = np.array([u for u, _ in counts], np.int64), np.array([n for _, n in counts], np.int64)
    plan = cutting_stock(sizes, demand, room) if counts else []

    rule = spark.createDataFrame(lengths, "length long, parts long, each_item long, whole long, wide int, wide_first long, "
                                          "narrow int, narrow_first long")
    grouped = pieces.join(F.broadcast(rule), "length").withColumn(  # a row per length
        "part", F.pmod(F.xxhash64("doc_id", "number"), F.col("parts")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (grouped.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
              .select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "number")
    placing = grouped.withColumn("place", F.row_number().over(within) - 1).join(firsts, ["length", "part"]).withColumn(
        "nth", F.col("before") + F.col("place"))
    bundled = F.col("nth") < F.col("whole") * F.col("each_item")
    ranked = placing.withColumns({
        "units": F.when(bundled, F.col("wide")).otherwise(F.col("narrow")),
        "rank": F.when(bundled, F.col("wide_first") + F.floor(F.col("nth") / F.col("each_item"))).otherwise(
            F.col("narrow_first") + F.col("nth") - F.col("whole") * F.col("each_item"))})

    shares: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in sizes}
    taken, base = dict.fromkeys(shares, 0), 0
    for pattern, times in plan:
        for size, each in zip(sizes.tolist(), pattern.tolist()):
            if each:
                shares[size].append((taken[size], each, base))
                taken[size] += each * times
        base += times
    table = spark.createDataFrame(list(shares.items()), "units int, shares array<struct<first:long,each:long,base:long>>")
    mine = F.element_at(F.filter("shares", lambda s: s["first"] <= F.col("rank")), -1)
    placed = (ranked.join(F.broadcast(table), "units").withColumn("mine", mine)  # a row per length unit
              .withColumn("sequence_id", F.col("mine.base") + F.floor((F.col("rank") - F.col("mine.first")) / F.col("mine.each"))))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("units"), "rank", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
