"""Circulant MinHash against exact Jaccard links."""

import random
import re

import numpy as np
import pytest
from compare import connect, differences
from test_duplicates import roots_of

import __spark_entry__ as entry
from tidegauge.llm import minhash


def plain_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i:i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    roots = roots_of(range(len(rows)), links)
    least = {}
    for i, r in roots.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted(((d, len(sets[i]), least.get(roots[i]), d == least.get(roots[i])) for i, (d, _) in enumerate(rows)), key=str)


def families():
    """Texts with a share of their words replaced, so that similarities lie on both sides of the threshold."""
    rng = random.Random(4)
    rows, n = [], 0
    for family in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(25):
            words = [w if rng.random() > rng.choice([0.01, 0.05, 0.1]) else f"x{rng.randrange(10 ** 6)}" for w in base]
            rows.append((n, " ".join(words)))
            n += 1
    odd = [(None, None), (900, ""), (901, " \n"), (902, "One"), (903, "oNE"), (904, "two"), (905, "a b"), (906, "b a"), (906, "b a"),
           (907, "x " * 3000), (908, "x x"), (None, "a b"), (None, "only null"), (909, "É a"), (910, "é a")]
    return rows + odd


@pytest.mark.parametrize("rows", [families(), families()[150:], []])
def test_components_equal_exact_links(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as n", "3 as bands", "4 as mark")
    found = minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = [(d, n, c, (d is None and c is None) or kept) for d, n, c, kept in brute(rows)]
    assert sorted((tuple(r) for r in found), key=str) == sorted(want, key=str)


def test_query_equals_sql(spark, data):
    assert not differences(entry.queries()["op13_minhash"](spark, data), connect(data), entry.oracle_sql()["op13_minhash"])


def test_signature_is_circulant_and_unbiased():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in (800, 100, 100))
    x, y = (minhash.signature(np.unique(np.r_[both, part]), 2000) for part in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.04
    # shifting every place by one moves the coordinates by one
    sigma = np.array([5, 77, 123456], np.uint64) << np.uint64(32)
    scale = pow(int(minhash._A), -1, 2 ** 64)
    at = lambda s: minhash.signature(np.array([int(v) * scale % 2 ** 64 for v in s], np.uint64), 50)
    assert (at(sigma)[:-1] == at(sigma + (np.uint64(1) << np.uint64(32)))[1:]).all()


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 3, 100, 127, 128, 129, 1000, 5000):
        x = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        y = np.unique(np.r_[x[: n - n // 10], rng.integers(0, 2 ** 63, n // 5).astype(np.uint64)])
        p, q = minhash.parity(x), minhash.parity(y)
        m = min(len(p), len(q))
        p, q = (np.bitwise_xor.reduce(v.reshape(-1, m), axis=0) for v in (p, q))
        assert sum(int(v).bit_count() for v in (p ^ q).view(np.uint64)) <= len(np.setxor1d(x, y))
