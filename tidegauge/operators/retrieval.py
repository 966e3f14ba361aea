"""Dense and lexical top-k retrieval without forming all query-document rows.

Both sides are cut into blocks of bounded size by a hash of the ID. A task gets
one query block and one document block, scores them with matrix products and
keeps the best ``k`` per query, a slice of the queries at a time; only those rows leave the task. Top-k of top-k
is exact. The number of blocks follows the sizes of the two sides; only a grid
with fewer cells than the cluster has cores is cut finer (``block_grid``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.operators.ranking import last_per_key, top_k

QUERY_BLOCK_ROWS = 4096
CANDIDATE_BLOCK_ROWS = 16384
TEXT_QUERY_BLOCK_ROWS = 1024
TEXT_BLOCK_ROWS = 4096
# A block is not cut below this many rows to keep more cores busy.
LEAST_BLOCK_ROWS = 64
# Scores of a dense block that a task holds at a time; its sort takes five arrays of that many numbers.
SCORES_AT_ONCE = 1 << 21

# The usual BM25 parameters.
BM25_K1 = 1.2
BM25_B = 0.75


def retrieval_sets(pairs: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(posts with their gold market, distinct markets); the last row wins per key."""
    gold = F.coalesce("gold", F.lit(False)) | F.coalesce("is_gold", F.lit(False))
    golden = last_per_key(pairs.where(gold).select("tweet_id", "market_id", order), ["tweet_id"], order)
    texts = last_per_key(pairs.select("tweet_id", "tweet_text", order), ["tweet_id"], order)
    queries = texts.drop(order).join(golden.select("tweet_id", F.col("market_id").alias("gold_market")),
                                     "tweet_id")
    markets = last_per_key(pairs.select("market_id", "market_question", order), ["market_id"], order)
    return queries, markets.drop(order)


def block_grid(queries: int, docs: int, query_rows: int, doc_rows: int, cores: int) -> tuple[int, int]:
    """Numbers of query and document blocks.

    Every query goes to each document block and every document to each query
    block, so ``queries * d + docs * q`` rows are shuffled. Blocks are as large
    as a task may hold. If these give fewer cells than ``cores``, the side is
    cut finer whose cut copies fewer rows: the queries are copied per document
    block only while they are the smaller side.
    """
    q, d = max(1, math.ceil(queries / query_rows)), max(1, math.ceil(docs / doc_rows))
    if queries * d <= docs * q:
        return q, max(d, min(math.ceil(cores / q), docs // LEAST_BLOCK_ROWS))
    return max(q, min(math.ceil(cores / d), queries // LEAST_BLOCK_ROWS)), d


def _grid(queries: DataFrame, docs: DataFrame, query_rows: int, doc_rows: int) -> tuple[int, int]:
    """Block grid for two tables; their rows are counted in one job."""
    sides = queries.select(F.lit(0).alias("side")).unionAll(docs.select(F.lit(1).alias("side")))
    sizes = dict(sides.groupBy("side").count().collect())
    return block_grid(sizes.get(0, 0), sizes.get(1, 0), query_rows, doc_rows,
                      queries.sparkSession.sparkContext.defaultParallelism)


def _block(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _best_of_block(scores: np.ndarray, q_ids: np.ndarray, d_ids: np.ndarray, k: int,
                   positive_only: bool) -> pd.DataFrame:
    """Best ``k`` columns per row of a score matrix; ties go to the smaller ID."""
    by_id = np.argsort(d_ids, kind="stable")
    scores, d_ids = scores[:, by_id], d_ids[by_id]
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    best = np.take_along_axis(scores, order, axis=1)
    rows = np.repeat(np.arange(len(q_ids)), order.shape[1])
    out = pd.DataFrame({"query_id": q_ids[rows], "doc_id": d_ids[order.ravel()], "score": best.ravel()})
    return out[out["score"] > 0] if positive_only else out


def _best_of_products(left: np.ndarray, right: np.ndarray, q_ids: np.ndarray, d_ids: np.ndarray, k: int,
                      digits: int | None) -> pd.DataFrame:
    """Best ``k`` inner products per row of ``left``, for a slice of these rows at a time."""
    step = max(1, SCORES_AT_ONCE // len(right))
    found = []
    for at in range(0, len(left), step):
        product = left[at:at + step] @ right.T
        if digits is not None:
            np.round(product, digits, out=product)
        found.append(_best_of_block(product, q_ids[at:at + step], d_ids, k, False))
    return pd.concat(found, ignore_index=True)


def _blocked_top_k(queries: DataFrame, docs: DataFrame, score: Callable, k: int,
                   q_blocks: int, d_blocks: int, digits: int | None) -> DataFrame:
    """Send each query block to each document block, score, merge the best rows."""
    left = (queries.withColumn("qb", _block("query_id", q_blocks))
            .withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(d_blocks - 1)))))
    right = (docs.withColumn("db", _block("doc_id", d_blocks))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    partial = (left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db"))
               .applyInPandas(score, "query_id bigint, doc_id bigint, score double"))
    if digits is not None:
        partial = partial.withColumn("score", F.round("score", digits))
    return top_k(partial, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def topk_inner_product(queries: DataFrame, candidates: DataFrame, k: int = 10,
                       digits: int | None = None) -> DataFrame:
    """Exact top-k by inner product: ``query_id, doc_id, score, rn``.

    Inputs are ``(query_id, vec)`` and ``(doc_id, vec)`` with unique IDs.
    """
    q_blocks, d_blocks = _grid(queries, candidates, QUERY_BLOCK_ROWS, CANDIDATE_BLOCK_ROWS)

    def score(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        left = np.stack(q["vec"].to_numpy()).astype(np.float64)
        right = np.stack(d["vec"].to_numpy()).astype(np.float64)
        return _best_of_products(left, right, q["query_id"].to_numpy(), d["doc_id"].to_numpy(), k, digits)

    return _blocked_top_k(queries, candidates, score, k, q_blocks, d_blocks, digits)


def ranked_lists(top: DataFrame) -> DataFrame:
    """Top-k rows to one ranked ID list per query (at most k entries each)."""
    pairs = F.array_sort(F.collect_list(F.struct("rn", "doc_id")))
    return top.groupBy("query_id").agg(F.transform(pairs, lambda p: p["doc_id"]).alias("ranked"))


def retrieval_scores(top: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Acc@1 and MRR where a query hits if any of its ``k`` rows is gold.

    ``gold`` holds ``(query_id, doc_id)``; a query without hit counts as rank k + 1.
    """
    hits = (top.join(gold.withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left")
            .groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rn"))).alias("place")))
    place = F.coalesce("place", F.lit(k + 1))
    return hits.agg(F.count(F.lit(1)).alias("n"),
                    F.avg(F.when(place == 1, 1.0).otherwise(0.0)).alias("acc_at_1"),
                    F.avg(F.lit(1.0) / place).alias("mrr"))


def words(text: str) -> Column:
    """Lower-case runs of letters a-z and digits."""
    return F.array_remove(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), "")


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """Exact BM25 top-k over whole texts: ``query_id, doc_id, score, rn``.

    Inputs are ``(query_id, text)`` and ``(doc_id, text)``. Only document terms
    that occur in some query are weighted. Frequent terms are kept: a block
    product adds them in place, so they make no extra rows.
    """
    q_terms = queries.select("query_id", F.explode(words("text")).alias("term")).distinct()
    lengths = docs.select("doc_id", words("text").alias("words")).select(
        "doc_id", "words", F.size("words").alias("len"))
    size = lengths.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))).scalar()

    counts = (lengths.select("doc_id", "len", F.explode("words").alias("term"))
              .join(q_terms.select("term").distinct(), "term", "left_semi")
              .groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")))
    # Reading tf here too keeps both uses of the counts equal, so they are shared.
    df = counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    weighted = counts.join(df, "term").withColumn("size", size)
    n, avg_len = F.col("size")["n"], F.col("size")["avg_len"]
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(BM25_K1) * (1 - BM25_B + BM25_B * F.col("len") / avg_len)
    weight = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + norm)
    vectors = (weighted.withColumn("w", weight).groupBy("doc_id")
               .agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights")))
    bags = q_terms.groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))

    q_blocks, d_blocks = _grid(queries, docs, TEXT_QUERY_BLOCK_ROWS, TEXT_BLOCK_ROWS)

    def score(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        vocabulary = {t: i for i, t in enumerate(sorted({t for bag in q["terms"] for t in bag}))}
        scores = np.zeros((len(q), len(d)))
        # Posting lists of the block, each a (columns, weights) pair per term.
        columns, entries, values = [], [], []
        for col, (names, weights) in enumerate(zip(d["terms"], d["weights"])):
            ids = np.fromiter((vocabulary.get(t, -1) for t in names), dtype=np.int64, count=len(names))
            keep = ids >= 0
            entries.append(ids[keep])
            values.append(np.asarray(weights, dtype=np.float64)[keep])
            columns.append(np.full(int(keep.sum()), col))
        entry, value, column = np.concatenate(entries), np.concatenate(values), np.concatenate(columns)
        order = np.argsort(entry, kind="stable")
        entry, value, column = entry[order], value[order], column[order]
        for row, bag in enumerate(q["terms"]):
            for term in bag:
                lo, hi = np.searchsorted(entry, [vocabulary[term], vocabulary[term] + 1])
                scores[row, column[lo:hi]] += value[lo:hi]
        return _best_of_block(scores, q["query_id"].to_numpy(),
                              d["doc_id"].to_numpy(), k, True)

    return _blocked_top_k(bags, vectors, score, k, q_blocks, d_blocks, None)


