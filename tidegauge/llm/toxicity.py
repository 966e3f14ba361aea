"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm.common import free_name, id_crc32, on_workers, write_once
from tidegauge.llm.labelled import training_rows

#: Learning rows; their n-grams stay in the shared folder, the driver sees sums per bucket.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.7
SIZES = (3, 4, 5, 6)
BITS = 20
#: Tasks of a round of the fit; each gives one sum per bucket (4 MB), added up in parts before the driver sees them.
TASKS, PARTS = 24, 24
#: During the fit: packed tables are large rows, and the shuffle files of a round go as soon as the driver has its sums.
_SETTINGS = {"spark.sql.parquet.columnarReaderBatchSize": "64", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_TEXTS, _CELLS = 4096, 1 << 15
_STEP, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None) -> np.ndarray:
    """Buckets of all character n-grams of the whole text, repeats included, lower case, runs of space as one."""
    c = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode("utf-32-le", "surrogatepass"),
                      np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(c) < n:
            break
        h = h[:len(c) - n + 1] * _STEP + c[n - 1:]
        if n in SIZES:
            out.append(((h + np.uint64(n)) * _MIX >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


class Distinct:
    """Buckets of a text, once each. Holds the place where a bucket was seen last, so nothing is sorted."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        found = grams(text)
        places = np.arange(len(found), dtype=np.int32)
        self.last[found] = places
        return found[self.last[found] == places]


@dataclass
class Linear:
    weight: np.ndarray  # per bucket, the log-count ratio included
    bias: float

    def score(self, texts) -> np.ndarray:
        distinct = Distinct()
        z = np.array([self.weight[distinct(t)].sum(dtype=np.float64) for t in texts], float) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, smooth: float = 1.0) -> np.ndarray:
    """Log-count ratio of each bucket, from the number of texts of either class that have it."""
    return np.log((pos + smooth) / (n_pos + 2 * smooth)) - np.log((neg + smooth) / (n_neg + 2 * smooth))


def minimise(value, start: np.ndarray, step: float, rounds: int = 40, memory: int = 5, enough: float = 2e-3) -> np.ndarray:
    """L-BFGS with halved steps, until a step gains no more than ``enough``.

    ``value`` gives a loss and its gradient; ``step`` scales the first move.
    """
    x = start
    loss, slope = value(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    calls = 1
    while calls < rounds:
        d, factors = slope.copy(), []
        for s, y in reversed(moves):
            factors.append((s @ d) / (s @ y))
            d -= factors[-1] * y
        d *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else step
        for (s, y), f in zip(moves, reversed(factors)):
            d += (f - (y @ d) / (s @ y)) * s
        share, down = 1.0, float(slope @ d)
        while calls < rounds:
            after, new = value(x - np.float32(share) * d)
            calls += 1
            if after <= loss - 1e-4 * share * down:
                break
            share /= 2
        else:
            break
        s, y = np.float32(-share) * d, new - slope
        gained = loss - after
        x, loss, slope = x + s, after, new
        if s @ y > 1e-10 * (y @ y):
            moves = [*moves, (s, y)][-memory:]
        if gained <= enough:
            break
    return x


def _packed(found: list[np.ndarray], y: list[int]) -> tuple[bytes, ...]:
    """Texts as one table by bucket: classes, distinct buckets, texts per bucket, and the texts of each in turn.

    Tables are small, so that the executors handle no large objects. In this order sums per bucket run along memory, and sums per text fall in a small array.
    """
    at = np.concatenate(found)
    order = np.argsort(at, kind="stable")
    buckets, starts = np.unique(at[order], return_index=True)
    counts = np.diff(np.append(starts, len(at))).astype(np.uint16)
    texts = np.repeat(np.arange(len(found), dtype=np.uint16), [len(f) for f in found])[order]
    gaps = np.diff(buckets, prepend=0).astype(np.int32)  # small numbers, which compress well
    return np.array(y, np.uint8).tobytes(), gaps.tobytes(), counts.tobytes(), texts.tobytes()


def _gathered(cells: DataFrame, body, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all tasks: ``body`` turns a packed table into two scalars and adds to ``width`` sums per bucket."""
    def run(batches):
        scalars, sums = np.zeros(2), np.zeros((width, 1 << BITS))
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                y, gaps, counts, texts = (np.frombuffer(x, k) for x, k in zip(row, (np.uint8, np.int32, np.uint16, np.uint16)))
                scalars += body(y, np.cumsum(gaps), counts.astype(np.int64), texts, sums)
        chunks = np.array_split(sums.astype(np.float32).reshape(-1), PARTS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(PARTS), pa.int32()), *(pa.array([x] + [0.0] * (PARTS - 1)) for x in scalars),
             pa.array([c.tobytes() for c in chunks])], names=["part", "a", "b", "sums"])

    def add(key, table):
        total = np.sum([np.frombuffer(x, np.float32) for x in table["sums"].to_pylist()], axis=0, dtype=np.float32)
        scalars = [pa.array([float(np.sum(table[n].to_numpy()))]) for n in ("a", "b")]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), *scalars, pa.array([total.tobytes()])],
                                    names=["part", "a", "b", "sums"])

    kind = "part int, a double, b double, sums binary"
    parts = cells.coalesce(TASKS).mapInArrow(run, kind).groupBy("part").applyInArrow(add, kind)
    total, found = np.zeros(2), {}
    for r in parts.collect():  # PARTS rows; a local iterator would leave its shuffle files behind
        total += r["a"], r["b"]
        found[r["part"]] = np.frombuffer(r["sums"], np.float32)
    if not found:
        return total, np.zeros((width, 1 << BITS), np.float32)
    return total, np.concatenate([found[i] for i in range(PARTS)]).reshape(width, -1)


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]):
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1,
          max_rows: int = MAX_TRAINING_ROWS, ridge: float = 1e-4, key: str = "doc_id", text: str = "text") -> Linear:
    """Fit on labelled rows outside the held-out fold, ``max_rows`` of them at most, with every bucket of the n-grams.

    Logistic regression on presence times log-count ratio. Both classes weigh
    the same in total, so the rare one is not talked down. The buckets of the
    learning texts are packed and written to the shared folder once; a round of the fit
    sums the gradient over them in ``TASKS`` tasks and adds these up in ``PARTS``, and the driver
    holds a few arrays of one number per bucket.
    """
    spark = on_workers(docs.sparkSession)
    rows = training_rows(docs, labels, label, folds, held_out, max_rows, key, text)
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:  # nothing to tell apart
        share = np.clip(n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.5, 1e-3, 0.999)
        return Linear(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))

    def shorten(batches):
        distinct, found, y, cells = Distinct(), [], [], 0
        names = ["y", "buckets", "counts", "texts"]
        for b in batches:
            for text, mark in zip(b.column(0), b.column(1)):
                found.append(distinct(text.as_py()))
                y.append(mark.as_py())
                cells += len(found[-1])
                if cells >= _CELLS or len(y) == _TEXTS:
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in _packed(found, y)], names=names)
                    found, y, cells = [], [], 0
        if y:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in _packed(found, y)], names=names)

    cells = write_once(rows.select("text", "y").coalesce(TASKS).mapInArrow(
        shorten, "y binary, buckets binary, counts binary, texts binary"), "buckets")

    def count(y, buckets, counts, texts, sums):
        starts = np.cumsum(counts) - counts
        ones = np.add.reduceat(y[texts].astype(np.int32), starts) if len(texts) else counts
        sums[0, buckets] += ones
        sums[1, buckets] += counts - ones
        return 0.0, 0.0

    with _set(spark, _SETTINGS):
        pos, neg = _gathered(cells, count, 2)[1]
        ratio = log_ratios(pos, neg, n_pos, n_neg).astype(np.float32)
        shares = 0.5 / n_neg, 0.5 / n_pos
        curvature = 0.25 * float((ratio.astype(float) ** 2 * (pos * shares[1] + neg * shares[0])).sum() + 1) + ridge

        def value(point: np.ndarray) -> tuple[float, np.ndarray]:
            shared = spark.sparkContext.broadcast((point[:-1] * ratio, float(point[-1])))

            def slope(y, buckets, counts, texts, sums):
                weight, bias = shared.value
                z = np.bincount(texts, np.repeat(weight[buckets], counts), len(y)) + bias
                share = np.where(y > 0, shares[1], shares[0])
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
                if len(texts):
                    sums[0, buckets] += np.add.reduceat(e[texts], np.cumsum(counts) - counts)
                return share @ (np.logaddexp(0, z) - y * z), e.sum()

            (loss, last), sums = _gathered(cells, slope, 1)
            shared.destroy()
            out = np.append(sums[0] * ratio + np.float32(ridge) * point[:-1], np.float32(last))
            return loss + ridge / 2 * float(point[:-1] @ point[:-1]), out

        found = minimise(value, np.zeros((1 << BITS) + 1, np.float32), 1 / curvature)
    return Linear(found[:-1] * ratio, float(found[-1]))


def score_documents(docs: DataFrame, model: Linear, folds: int = 3, held_out: int = 1, key: str = "doc_id",
                    text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``held_out``, ``score`` and ``predicted`` to every row; columns of these names are replaced.

    A null text counts as empty; a null key is not held out. Repeated rows score
    alike; an empty table gives an empty one. Only the row is looked at, and the
    model is broadcast: its size is fixed by ``BITS``.
    """
    spark = on_workers(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts))

    hidden = free_name(docs, "__fold")
    return (docs.withColumn(hidden, F.coalesce(F.pmod(id_crc32(F.col(key)), F.lit(folds)) == held_out, F.lit(False)))
            .withColumn("score", scored(F.col(text)))
            .withColumns({"held_out": F.col(hidden), "predicted": (F.col("score") >= threshold).cast("int")}).drop(hidden))
