"""Hard negatives against all scores."""

import math

import numpy as np
import pytest
from compare import connect, differences

import __spark_entry__ as entry
from tidegauge.llm import hard_negatives

NAME = "op12_hard_negatives"


def brute(rows):
    kept = []
    for i, vector, label in dict.fromkeys((i, None if v is None else tuple(v), x) for i, v, x in rows):
        if None in (i, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for a, label, v in kept:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own) for i, own, w in kept)
        for p, positive in [(-s, i) for s, i, own in scored if own == label and i != a][:5]:
            near = [(i, -s) for s, i, own in scored if own != label and 80 * p <= -100 * s <= 100 * p][:5]
            out += [(a, positive, k, i, p, s) for k, (i, s) in enumerate(near, 1)]
    return sorted(out)


def vectors(n, seed, dims=20):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=dims).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]


HOT = [(1000 + i, [0.5] * 20, i % 4) for i in range(60)] + [(1100, [0.5] * 20, 2), (1200, [0.25] * 20, 1)]
ODD = [(None, [1.0] * 20, 1), (2000, None, 1), (2100, [1.0, None], 1), (2200, [float("nan")] * 20, 1), (2300, [float("inf")], 1),
       (2400, [1.0] * 20, None), (2500, [], 1), (2600, [0.5, 0.5], 1), (2600, [0.5, 0.5], 1), (2700, [0.0] * 20, 9), (2701, [0.0] * 20, 3)]


@pytest.mark.parametrize("rows", [vectors(400, 1) + HOT + ODD, vectors(150, 2)[::-1] + ODD, vectors(101, 5, 33), HOT, ODD, []])
def test_windows_equal_all_scores(spark, rows, tmp_path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "1 as id", "2 as v", "3 as score", "4 as window").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = entry.queries()[NAME](spark, str(tmp_path)).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(tuple(r) for r in found) == brute(rows)


def test_query_equals_sql(spark, data):
    assert not differences(entry.queries()[NAME](spark, data), connect(data), entry.oracle_sql()[NAME])


def test_pruned_pairs_equal_the_product():
    rng = np.random.default_rng(7)
    a, x = (rng.integers(-200, 200, (n, 40)) * (rng.random((n, 40)) < 0.3) for n in (30, 90))
    product = a @ x.T
    allowed = rng.random(product.shape) < 0.5
    for tau in (-np.inf, -1e5, 0.0, 2e4, 1e9):
        at, of, score = hard_negatives.reach(a, hard_negatives._rests(a), x, np.full(30, tau), allowed)
        want = {(i, j): product[i, j] for i, j in zip(*np.nonzero(allowed & (product >= tau)))}
        assert {(i, j): s for i, j, s in zip(at, of, score)} == want
