"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on the driver from a bounded sample of statistics, flattened
into arrays, and walked for whole batches at once in Spark tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import free_name, id_crc32, on_workers
from tidegauge.llm.labelled import training_rows

#: Learning rows; their statistics (200 bytes each) are all that reaches the driver.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.7

_SPACES, _DIGITS = [9, 10, 11, 12, 13, 32], list(range(48, 58))
_UPPER, _LOWER = list(range(65, 91)), list(range(97, 123))
_SYMBOLS = list(b"#*$%&|<>@\\^_`{}~=+/")
_MARKS, _SHOUTS = list(b".,;:"), list(b"!?")

STATISTICS = ("log_chars", "log_words", "log_lines", "word_length", "longest_word", "distinct_words", "top_word",
              "repeated_neighbours", "distinct_pairs", "upper", "digits", "symbols", "marks", "shouts", "bars", "other",
              "spaces", "marked_lines", "repeated_lines", "short_lines", "words_per_line", "wordlike", "entropy",
              "compression", "words_per_stop")


def statistics(text: str | None) -> list[float]:
    """Shares and sizes of a whole text; zeros for an empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw.strip():
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words = len(raw), text.split()
    w = len(words) or 1
    lines = [x for x in text.split("\n") if x.strip()]
    seen = Counter(words)
    letters = counts[_UPPER].sum() + counts[_LOWER].sum() + counts[128:].sum()
    share = counts[counts > 0] / n
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / w, max(map(len, words), default=0),
        len(seen) / w, max(seen.values(), default=0) / w, sum(map(str.__eq__, words, words[1:])) / w,
        len(set(zip(words, words[1:]))) / w, counts[_UPPER].sum() / max(letters, 1), counts[_DIGITS].sum() / n,
        counts[_SYMBOLS].sum() / w, counts[_MARKS].sum() / w, counts[_SHOUTS].sum() / w, counts[124] / w,
        counts[128:].sum() / n, counts[_SPACES].sum() / n, sum(x.rstrip()[-1] in ".!?…" for x in lines) / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1), sum(len(x) < 30 for x in lines) / max(len(lines), 1),
        w / max(len(lines), 1), sum(map(str.isalpha, words)) / w, float(-(share * np.log2(share)).sum()),
        len(zlib.compress(raw, 1)) / n, w / (1 + counts[46])]


@dataclass
class Forest:
    """Complete trees as arrays: node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        inner = self.feature.shape[1] if len(self.feature) else 0
        while len(self.feature) and at.size and at[0, 0] < inner:
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
        return self.start + (self.value[trees, at - inner].sum(axis=1) if len(self.feature) else np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64,
        ridge: float = 1.0, least: int = 10) -> Forest:
    """Boost logistic loss; without two classes the score is the share of ones, or a half."""
    n, inner, leaves = len(y), 2 ** depth - 1, 2 ** depth
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    start = float(np.log(share / (1 - share)))
    empty = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    if n == 0 or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-6)
            spot = at - first
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = spot * bins + binned[:, f]
                sums = [np.bincount(cell, v, width * bins).reshape(width, bins).cumsum(axis=1) for v in (g, h, np.ones(n))]
                gl, hl, nl = (s[:, :len(c)] for s in sums)
                gt, ht, nt = (s[:, -1:] for s in sums)
                gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
                gain[(nl < least) | (nt - nl < least)] = -1
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                feature[first:first + width][better] = f
                cut[first:first + width][better] = c[top[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[leaf]
        features.append(feature), thresholds.append(cut), values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), start)


def _matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2,
          max_rows: int = MAX_TRAINING_ROWS, key: str = "doc_id", text: str = "text") -> Forest:
    """Fit on labelled rows outside the held-out fold, ``max_rows`` of them at most."""
    def measure(batches):
        for b in batches:
            yield pd.DataFrame({"x": list(_matrix(b["text"])), "y": b["y"]})

    on_workers(docs.sparkSession)
    rows = training_rows(docs, labels, label, folds, held_out, max_rows, key, text)
    got = rows.mapInPandas(measure, "x array<double>, y int").orderBy("y", "x").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(STATISTICS))
    return fit(x, got["y"].to_numpy(float))


def score_documents(docs: DataFrame, model: Forest, folds: int = 4, held_out: int = 2, key: str = "doc_id",
                    text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``held_out``, ``score`` and ``predicted`` to every row; columns of these names are replaced.

    A null text counts as empty and is scored as such; a null key is not held
    out. Repeated rows score alike; an empty table gives an empty one. Only the
    row is looked at.
    """
    on_workers(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts)))

    hidden = free_name(docs, "__fold")
    return (docs.withColumn(hidden, F.coalesce(F.pmod(id_crc32(F.col(key)), F.lit(folds)) == held_out, F.lit(False)))
            .withColumn("score", scored(F.col(text)))
            .withColumns({"held_out": F.col(hidden), "predicted": (F.col("score") >= threshold).cast("int")}).drop(hidden))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier accepts, columns as they came."""
    hidden = free_name(docs, "__verdict")
    scored = score_documents(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(hidden), "doc_id", "text"),
                             learn(docs, labels))
    return scored.where("predicted = 1").select(f"{hidden}.*")
