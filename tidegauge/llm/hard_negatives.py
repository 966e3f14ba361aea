"""Hard negatives: threshold joins of anchors with all rows, in the manner of L2AP.

Dimensions are taken in one order, the heaviest first, in blocks. Of each batch
of rows an inverted index is made: a block's posting list holds the rows whose
rest from that block on could still matter. By Cauchy and Schwarz a rest adds at
most the product of its norm and the anchor's, so blocks whose rest stays below
the least threshold are left out of the index. Partial scores are accumulated
block by block, and a pair goes once its score and the product of the remaining
norms stay below the anchor's threshold. What is left out of the index is added
for the pairs that remain, so scores are exact.

Thresholds start high and are lowered, for the anchors whose windows are not
full yet, until each window has its rows or has reached its end. A task raises
them again for itself as its own windows fill.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm.common import on_workers, scratch_path, write_once

#: Anchors go to the tasks in blocks of at most so many bytes.
ANCHOR_BYTES = 16 << 20
#: Thresholds of the rounds: shares of the largest possible score, and of a positive's score.
POSITIVE_SHARES = (0.5, 0.25, None)
NEGATIVE_SHARES = (0.97, 0.9, None)
_BLOCK, _ANCHORS = 16, 512
_EXACT = 2.0 ** 53


def whole_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                  scale: int = 256) -> DataFrame:
    """Rows that take part: ``id``, ``label`` and ``v``, components times ``scale`` rounded down.

    Null keys, labels and vectors and vectors with a null, NaN or infinite
    component take no part.
    """
    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    fit = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, odd)
    return table.where(fit).select(F.col(key).alias("id"), F.col(label).alias("label"), F.transform(
        vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(vectors: pa.Array, order: np.ndarray) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros, dimensions in ``order``."""
    ends = vectors.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), len(order)), np.int64)
    if sizes.size and (sizes == len(order)).all():
        out[:] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(out.shape)
    else:
        rows = np.repeat(np.arange(len(sizes)), sizes)
        out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out[:, order]


def _rests(m: np.ndarray) -> np.ndarray:
    """Norm of each row from each block on, rounded up a little; the last column is zero."""
    squares = m.astype(np.float64) ** 2
    parts = np.stack([squares[:, i:i + _BLOCK].sum(axis=1) for i in range(0, max(m.shape[1], 1), _BLOCK)], axis=1)
    rests = np.cumsum(parts[:, ::-1], axis=1)[:, ::-1]
    return np.concatenate([np.sqrt(rests) * (1 + 1e-9), np.zeros((len(m), 1))], axis=1)


def reach(anchors: np.ndarray, anchor_rests: np.ndarray, rows: np.ndarray, tau: np.ndarray,
          allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row, score) with ``allowed`` and a score of at least the anchor's ``tau``."""
    rests, n, blocks = _rests(rows), len(rows), anchor_rests.shape[1] - 1
    # The index of a row ends where no anchor's rest could lift a sum of nothing to its threshold.
    needed = rests[:, :-1] * anchor_rests[:, :-1].max(axis=0) >= tau.min()
    ends = blocks - np.argmax(needed[:, ::-1], axis=1)
    ends[~needed.any(axis=1)] = 0
    bound = np.abs(anchors).max(initial=0) * float(np.abs(rows).max(initial=0)) * max(rows.shape[1], 1)
    kind = np.float64 if bound < _EXACT else np.int64  # floats are exact below that, and much faster
    a, x = anchors.astype(kind), rows.astype(kind)
    part = [slice(g * _BLOCK, (g + 1) * _BLOCK) for g in range(blocks)]
    scores, alive, live = np.zeros((len(a), n), kind), allowed.copy(), np.arange(n)
    for g in range(blocks):
        listed = live[ends[live] > g]
        scores[:, listed] += a[:, part[g]] @ x[listed, part[g]].T
        upto = np.minimum(g + 1, ends[live])
        alive[:, live] &= scores[:, live] + anchor_rests[:, upto] * rests[live, upto] >= tau[:, None]
        live = live[alive[:, live].any(axis=0)]
        if not len(live):
            break
    at, of = np.nonzero(alive[:, live])
    of = live[of]
    found = scores[at, of]
    for g in range(blocks):
        rest = np.flatnonzero(ends[of] <= g)
        found[rest] += np.einsum("ij,ij->i", a[at[rest], part[g]], x[of[rest], part[g]])
    kept = found >= tau[at]
    return at[kept], of[kept], found[kept].astype(np.int64)


@dataclass
class Block:
    """Anchors and, per anchor, windows of scores: ``low`` to ``high``, infinite where there is none."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    names: np.ndarray  # the positive's id and score per window
    scores: np.ndarray
    same: bool
    need: int
    order: np.ndarray


def _first(window: np.ndarray, score: np.ndarray, key: np.ndarray, need: int) -> np.ndarray:
    """Places of the first ``need`` rows of each window: highest scores, then smallest keys."""
    order = np.lexsort((key, -score, window))
    w = window[order]
    starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
    place = np.arange(len(w)) - np.repeat(starts, np.diff(np.r_[starts, len(w)]))
    return order[place < need]


def _search(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first rows of each window among those of one task."""
    low, rests, many = block.low.copy(), _rests(block.vectors), block.low.shape[1]
    window, score, key = (np.zeros(0, np.int64) for _ in range(3))
    for b in batches:
        rows, ids = _matrix(b.column(2), block.order), b.column(0).to_numpy(zero_copy_only=False)
        labels = b.column(1).to_numpy(zero_copy_only=False)
        for i in range(0, len(block.ids), _ANCHORS):
            part = slice(i, i + _ANCHORS)
            allowed = (block.labels[part, None] == labels[None]) == block.same
            if block.same:
                allowed &= block.ids[part, None] != ids[None]
            at, of, found = reach(block.vectors[part], rests[part], rows, low[part].min(axis=1), allowed)
            at = at + i
            for w in range(many):
                inside = (found >= low[at, w]) & (found <= block.high[at, w])
                window = np.r_[window, at[inside] * many + w]
                score, key = np.r_[score, found[inside]], np.r_[key, ids[of[inside]]]
        kept = _first(window, score, key, block.need)
        window, score, key = window[kept], score[kept], key[kept]
        full = np.flatnonzero(np.bincount(window, minlength=low.size) == block.need)
        least = np.full(low.size, np.inf)
        np.minimum.at(least, window, score)
        flat = low.reshape(-1)
        flat[full] = np.maximum(flat[full], least[full])
    at = window // many if many else window
    columns = [window, block.ids[at], block.names.reshape(-1)[window], block.scores.reshape(-1)[window], key, score]
    for i in range(0, len(window), 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array(c[i:i + (1 << 14)].astype(np.int64)) for c in columns],
                                         names=["window", "anchor_id", "positive_id", "positive_score", "id", "score"])


def _round(rows: DataFrame, block: Block) -> DataFrame:
    """First rows of every window of the block over all rows, ``rank`` from 1, ``full`` where the window has all it needs; written once."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        yield from _search(shared.value, batches)

    found = rows.mapInArrow(run, "window long, anchor_id long, positive_id long, positive_score long, id long, score long")
    place = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "id"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= block.need)
    count = F.count(F.lit(1)).over(Window.partitionBy("window"))
    return write_once(ranked.withColumn("full", count == block.need), "negatives-round")


def _spread(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Order of the dimensions, the heaviest first, and the largest norm."""
    def run(batches):
        total, most = np.zeros(0), 0.0
        for b in batches:
            sizes = np.diff(b.column(0).offsets.to_numpy())
            squares = _matrix(b.column(0), np.arange(sizes.max(initial=0))).astype(np.float64) ** 2
            most = max(most, squares.sum(axis=1).max(initial=0))
            if len(total) < squares.shape[1]:
                total = np.r_[total, np.zeros(squares.shape[1] - len(total))]
            total[:squares.shape[1]] += squares.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), most))],
                                         names=["dim", "total", "most"])

    got = (rows.select("v").mapInArrow(run, "dim long, total double, most double")
           .groupBy("dim").agg(F.sum("total").alias("total"), F.max("most").alias("most")).orderBy(F.desc("total"), "dim").collect())
    return np.array([r["dim"] for r in got], np.int64), max([r["most"] for r in got], default=0.0) ** 0.5


def _without_copies(rows: DataFrame, most: int) -> DataFrame:
    """Of equal vectors of one label only the ``most`` smallest ids: the others cannot come first in any window.

    Hashes are counted first, so only vectors that are there more often are shuffled.
    """
    hashed = rows.withColumn("_h", F.xxhash64("v"))
    often = write_once(hashed.groupBy("_h", "label").count().where(F.col("count") > most).select("_h", "label"), "often")
    few = hashed.join(often, ["_h", "label"], "left_anti").select(*rows.columns)
    first = F.row_number().over(Window.partitionBy("v", "label").orderBy("id"))
    many = hashed.join(often, ["_h", "label"], "left_semi").withColumn("_n", first).where(F.col("_n") <= most)
    return few.unionByName(many.select(*rows.columns))


def _blocks(anchors: DataFrame, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of the anchors, ``ANCHOR_BYTES`` at a time; the driver holds one block."""
    most = max(1, ANCHOR_BYTES // (8 * max(len(order), 1)))
    held: list = []

    def made():
        vectors = _matrix(pa.array([r["v"] for r in held], pa.list_(pa.int64())), order)
        return np.array([r["id"] for r in held], np.int64), np.array([r["label"] for r in held], np.int64), vectors

    for row in anchors.toLocalIterator():
        held.append(row)
        if len(held) == most:
            yield made()
            held = []
    if held:
        yield made()


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of each anchor and positive.

    ``rows`` has ``id`` (long), ``label`` and ``v`` (array of longs), as
    ``whole_vectors`` gives them; ``anchor`` is a condition on ``id``. An anchor's
    positives are its first ``positives`` other rows of the same label by inner
    product, ties by smaller id. For each of them come the first ``negatives``
    rows of other labels whose score is ``low`` to ``high`` per cent of the
    positive's. Columns: ``anchor_id``, ``positive_id``, ``rank``,
    ``negative_id``, ``positive_score``, ``negative_score``.

    Rows equal in id, label and vector count once. Missing components of shorter
    vectors are zero. Rows that share the anchor's id are not its positives.
    Positives with a score below zero have no negatives. An empty table gives
    an empty one. Columns other than the three are not read.

    All rows meet the anchors in blocks; a task returns at most
    ``negatives`` rows of a window. The driver holds one block of anchors, their
    positives, and which windows are full.
    """
    spark = on_workers(rows.sparkSession)
    keyed = rows.select(F.col("id").cast("long").alias("id"), F.xxhash64("label").alias("label"), "v")
    taken = write_once(keyed, "vectors")
    anchors = taken.where(anchor).dropDuplicates(["id", "label", "v"])
    order, norm = _spread(taken)
    single = taken.dropDuplicates(["id", "label", "v"]) if _repeats(taken) else taken
    pool = write_once(_without_copies(single, max(positives, negatives) + 1), "pool")
    out = scratch_path(spark, "hard-negatives")
    written = False
    for ids, labels, vectors in _blocks(anchors, order):
        blank = np.zeros((len(ids), 1), np.int64)
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        best: dict[int, list[tuple[int, int]]] = {}
        for share in POSITIVE_SHARES:
            open_ = np.array([i not in best for i in range(len(ids))])
            if not open_.any():
                break
            least = np.where(open_, -np.inf if share is None else share * lengths * norm, np.inf)[:, None]
            block = Block(ids, labels, vectors, least, np.full((len(ids), 1), np.inf), blank, blank, True, positives, order)
            got: dict[int, list[tuple[int, int]]] = {}
            for r in _round(pool, block).where(F.lit(share is None) | F.col("full")).orderBy("window", "rank").collect():
                got.setdefault(r["window"], []).append((r["id"], r["score"]))
            best |= got
        names, scores = (np.zeros((len(ids), positives), np.int64) for _ in range(2))
        there = np.zeros((len(ids), positives), bool)
        for i, found in best.items():
            for w, (name, score) in enumerate(found):
                names[i, w], scores[i, w], there[i, w] = name, score, score >= 0
        least, most = -(-low * scores // 100), high * scores // 100
        for share in NEGATIVE_SHARES:
            if not there.any():
                break
            bar = least if share is None else np.maximum(least, np.floor(share * scores))
            block = Block(ids, labels, vectors, np.where(there, bar, np.inf), np.where(there, most, -np.inf), names, scores, False,
                          negatives, order)
            found = _round(pool, block)
            done = found if share is None else found.where("full")
            done.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score")).write.mode("append").parquet(out)
            written = True
            for r in found.where("full").select("window").distinct().collect():
                there.reshape(-1)[r["window"]] = False
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(kind).parquet(out) if written else spark.createDataFrame([], kind)


def _repeats(rows: DataFrame) -> bool:
    """Whether some id is there twice."""
    return not rows.groupBy("id").count().where("count > 1").isEmpty()
