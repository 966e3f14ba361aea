"""Read one large JSON array or object of records in many tasks.

The text reader cuts a file at every closing brace, so its blocks are read in
parallel however the file is laid out. Where a block starts, a brace may be
structure or part of a string. A first pass sums up each block as a function of its
start: whether it turns strings inside out, and how it moves the depth if it
starts outside or inside a string. Composing these in file order gives every
block its start. A second pass then knows which closing braces end a record.
A record that runs over the end of a block is joined from its pieces, at most
two per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidegauge.session import ship_package

_QUOTE, _ESCAPE = ord('"'), ord("\\")
_MOVES = {ord("{"): 1, ord("["): 1, ord("]"): -1}  # a closing brace ends each fragment
# What may stand between records: separators, and in an object the key of the next one.
_ARRAY_GAP, _OBJECT_GAP = r"^[\s\[,]*", r'^\s*[{,]\s*"(?:[^"\\]|\\.)*+"\s*:\s*'


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Text between closing braces, in order, with the file and the start of its block."""
    return spark.read.option("lineSep", "}").text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


@dataclass
class Marks:
    """For each fragment of one block: quotes up to its end, and its moves of depth outside and inside strings."""

    quotes: np.ndarray
    outside: np.ndarray
    inside: np.ndarray

    def __init__(self, values: pa.Array):
        ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        places = np.arange(len(data))
        plain = np.maximum.accumulate(np.where(data != _ESCAPE, places, -1)) if len(data) else places
        escapes = np.zeros(len(data), np.int64)  # escapes right before a byte
        escapes[1:] = places[:-1] - plain[:-1]
        quote = (data == _QUOTE) & (escapes % 2 == 0)
        before = np.concatenate([[0], np.cumsum(quote)])
        move = np.zeros(len(data), np.int64)
        for byte, step in _MOVES.items():
            move[data == byte] = step
        odd = before[:-1] % 2 == 1
        out, in_ = (np.concatenate([[0], np.cumsum(np.where(odd == side, move, 0))]) for side in (False, True))
        self.quotes = before[ends[1:]]
        closes = self.quotes % 2 == 1
        self.outside = out[ends[1:]] - np.cumsum(~closes)
        self.inside = in_[ends[1:]] - np.cumsum(closes)

    def after(self, quoted: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether a string is open at each fragment's end, and the depth there, from the block's start."""
        return (self.quotes + quoted) % 2 == 1, depth + (self.inside if quoted else self.outside)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """Parts of the batches that lie in one block of one file."""
    for b in batches:
        file, start = b.column(1).to_numpy(), b.column(2).to_numpy()
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(file)]
        for i, j in zip(bounds, bounds[1:]):
            if j > i:
                yield (int(file[i]), int(start[i])), b.column(0).slice(i, j - i)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: first character, parity of its quotes, moves of depth and the depths at ends of fragments for either start."""
    blocks: dict[tuple[int, int], list] = {}
    for block, values in _runs(batches):
        own = blocks.setdefault(block, ["", False, [0, 0], [set(), set()]])
        if not own[0]:
            own[0] = next((c for v in values for c in v.as_py().lstrip()[:1]), "")
        marks = Marks(values)
        moved = list(own[2])
        for side in (0, 1):
            quoted = bool(side) != own[1]
            open_, depth = marks.after(quoted, moved[side])
            own[3][side].update(np.unique(depth[~open_]).tolist())
            own[2][side] = int(depth[-1])
        own[1] ^= bool(marks.quotes[-1] % 2)
    rows = list(blocks.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k, _ in rows], pa.int64()), pa.array([k[1] for k, _ in rows], pa.int64()),
         pa.array([v[0] for _, v in rows], pa.string()), pa.array([v[1] for _, v in rows], pa.bool_()),
         *(pa.array([v[2][s] for _, v in rows], pa.int64()) for s in (0, 1)),
         *(pa.array([sorted(v[3][s]) for _, v in rows], pa.list_(pa.int64())) for s in (0, 1))],
        names=["file", "start", "first", "turns", "out", "in_", "out_ends", "in_ends"])


_SUMMARY = "file long, start long, first string, turns boolean, out long, in_ long, out_ends array<long>, in_ends array<long>"


@dataclass
class Start:
    """Where a block starts: in a string or not, its depth, the depth between records, the record that is open, its place."""

    quoted: bool
    depth: int
    base: int
    record: int
    place: int


def _starts(summaries: list, keyed: bool) -> dict[tuple[int, int], Start]:
    """The composed starts of all blocks; a few numbers per block. A file that does not close raises."""
    starts: dict[tuple[int, int], Start] = {}
    record, state = 0, {}
    for place, row in enumerate(sorted(summaries, key=lambda r: (r["file"], r["start"]))):
        if row["file"] not in state:
            record += 1
            state = {row["file"]: (False, 0, 1 if keyed or row["first"] == "[" else 0)}
            if keyed and row["first"] not in ("{", ""):
                raise ValueError("not an object of records")
        quoted, depth, base = state[row["file"]]
        starts[row["file"], row["start"]] = Start(quoted, depth, base, record, place)
        if base - depth in row["in_ends" if quoted else "out_ends"]:
            record += 1  # some record ends here, so what is open at the end is another one
        state[row["file"]] = (quoted != row["turns"], depth + row["in_" if quoted else "out"], base)
        last = {row["file"]: state[row["file"]]}
        starts[row["file"], -1] = Start(*last[row["file"]], 0, 0)
    for (_, start), end in starts.items():
        # the text after the last closing brace counts as closed by one more
        if start == -1 and (end.quoted or end.depth not in (0, -1)):
            raise ValueError("malformed JSON document: it ends inside a string or a record")
    return starts


def _cut(batches: Iterator[pa.RecordBatch], starts: dict[tuple[int, int], Start]) -> Iterator[tuple]:
    """``record``, ``place``, ``ended``, ``text``; ``record`` is null where the whole record lies in the block."""
    block, held, at, lead = None, [], None, True
    for now, values in _runs(batches):
        if now != block:
            if held:
                yield at.record + (not lead), at.place, False, "}".join(held)
            block, held, lead, at = now, [], True, starts[now]
            quoted, depth = at.quoted, at.depth
        marks = Marks(values)
        open_, depths = marks.after(quoted, depth)
        ends = np.flatnonzero(~open_ & (depths == at.base))
        texts, done = values.to_pylist(), 0
        for e in ends.tolist():
            text = "}".join([*held, *texts[done:e + 1], ""])
            yield (at.record if lead else None), at.place, True, text
            held, done, lead = [], e + 1, False
        held += texts[done:]
        quoted, depth = bool(open_[-1]), int(depths[-1])
    if held:
        yield at.record + (not lead), at.place, False, "}".join(held)


def read_records_in_parts(spark: SparkSession, path: str, schema: T.StructType, keyed: bool = False) -> DataFrame:
    """Records of JSON arrays, of concatenated objects, or with ``keyed`` of objects of records, of files of any size.

    Records must be objects. A record whose pieces lie in several blocks is
    joined by a shuffle of those pieces alone. A malformed document or record
    raises. The driver holds a few numbers per block.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    fragments = _fragments(spark, path)
    shared = spark.sparkContext.broadcast(_starts(fragments.mapInArrow(_summaries, _SUMMARY).collect(), keyed))

    def cut(whole: bool):
        def run(batches):
            rows: list[tuple] = []
            size = 0
            for row in _cut(batches, shared.value):
                if (row[0] is None) == whole:
                    rows.append(row)
                    size += len(row[3])
                if size >= 4 << 20:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

        def made(rows):
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                              names=["record", "place", "ended", "text"])

        return fragments.mapInArrow(run, "record long, place long, ended boolean, text string")

    # a piece that does not end its record was followed by a closing brace
    piece = F.when(F.col("ended"), F.col("text")).otherwise(F.concat("text", F.lit("}")))
    joined = cut(False).groupBy("record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", piece.alias("text")))), lambda p: p["text"]), "")
        .alias("text"), F.max("ended").alias("ended")).where("ended")
    texts = cut(True).select("text").union(joined.select("text"))
    return texts.select(_record(F.col("text"), schema, keyed).alias("r")).select("r.*")


def _record(text: Column, schema: T.StructType, keyed: bool) -> Column:
    bare = F.regexp_replace(text, _OBJECT_GAP if keyed else _ARRAY_GAP, "")
    checked = F.when(F.startswith(bare, F.lit("{")), bare).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.left(bare, F.lit(80)))))
    return F.from_json(checked, schema, {"mode": "FAILFAST"})
