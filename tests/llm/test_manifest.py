"""The Merkle manifest against SQL and a plain tree."""

import hashlib
import zlib

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidegauge.llm import merkle

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Digest of the last node, and per leaf its (left, right) siblings level by level."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [(nodes[i:i + 8], at[i:i + 8]) for i in range(0, len(nodes), 8)]
        for run, members in runs:
            for k, leaves in enumerate(members):
                for leaf in leaves:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1:])))
        nodes, at = [sha("".join(run)) for run, _ in runs], [sum(members, []) for _, members in runs]
    return nodes[0], paths


def brute(rows):
    if not rows:
        return []
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((mine, *climb([plain_leaf(r) for r in mine])))
    root, above = climb([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), high in zip(trees, above):
        for r, path in zip(mine, paths):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if tampered else r[4]
            h = plain_leaf((*r[:4], text))
            for left, right in path + high:
                h = sha(left + h + right)
            out.append((r[0], plain_leaf(r), subroot, root, sha("".join(a + b for a, b in path + high)), h, h == root))
    return out


ROWS = ([(i, f"s{i % 3}", "a", i * 2, f"Text {i}") for i in range(75)] + [(i, None, "b", None, f"Só {i}") for i in range(8)]
        + [(500, "s", "lone", 1, "One"), (3, "s", "", 0, ""), (None, "s", None, 5, None), (None, "s", None, 5, "Two"),
           (7, "x", "c", 1, "Same"), (7, "x", "c", 1, "Same"), (7, "x", "c", 1, "Other"), (6, None, "c", None, None)])


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[75:84], ROWS[84:], ROWS[:9], ROWS[:64], []])
def test_manifest_equals_a_plain_tree(spark, rows, tmp_path):
    spark.createDataFrame(rows, KIND).selectExpr("*", "1 as lo", "2 as tree", "3 as hash", "4 as run").write.parquet(
        f"{tmp_path}/documents.parquet")
    found = entry.queries()["op11_merkle_manifest"](spark, str(tmp_path))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    order = lambda r: tuple((v is not None, v) for v in r)
    got = sorted((tuple(r) for r in found.select(*names).collect()), key=order)
    assert got == sorted(brute(rows), key=order)


def test_query_equals_sql(spark, data):
    name = "op11_merkle_manifest"
    assert not differences(entry.queries()[name](spark, data), connect(data), entry.oracle_sql()[name])


def test_intervals_nest(spark):
    leaves = spark.range(100).select(F.lit("").alias("tree"), F.col("id").alias("key"), F.unhex(F.sha2(F.col("id").cast("string").cast(
        "binary"), 256)).alias("hash"))
    forest = merkle.grow(leaves)
    nodes = [tuple(r) for r in forest.nodes().select("level", "lo", "hi").collect()]
    for level, lo, hi in nodes:
        assert lo % 8 ** level == 0 and hi == min(100, lo + 8 ** level)
    assert [sum(n[0] == k for n in nodes) for k in (1, 2, 3)] == [13, 2, 1] and forest.tops().count() == 1
