"""Exact and near duplicates and components against brute force."""

import re
import zlib

import numpy as np
import pytest
from compare import connect, differences
from xxhash import xxh64_intdigest

import __spark_entry__ as entry
from tidegauge.llm import exact_dedup, sharding, simhash
from tidegauge.llm.components import components


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: pairs (doc_id, fingerprint)."""
    distinct = np.array(sorted({f for _, f in prints}), np.uint64)
    links = []
    for i, f in enumerate(distinct):
        near = np.flatnonzero(np.bitwise_count(distinct[i + 1:] ^ f) <= 4) + i + 1
        links += [(int(f), int(distinct[j])) for j in near]
    root = roots_of([int(f) for f in distinct], links)
    first = {}
    for d, f in prints:
        if d is not None:
            first[root[f]] = min(d, first.get(root[f], d))
    return sorted(((d, f"{f:016x}", first.get(root[f])) for d, f in prints), key=str)


def test_simhash_of_the_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in docs])
    got = sorted(map(tuple, entry.queries()["op9_simhash"](spark, data).collect()), key=str)
    assert got == want


def test_codewords_and_keys():
    low, high, patterns = simhash.golay()
    assert patterns.shape == (2048, 6)
    words = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    near = simhash.fuzzy_keys(words)
    flips = words ^ (1 << np.random.default_rng(2).integers(0, 23, 3000)) ^ (1 << np.random.default_rng(3).integers(0, 23, 3000))
    assert all(set(a) & set(b) for a, b in zip(near.tolist(), simhash.fuzzy_keys(flips).tolist()))


@pytest.mark.parametrize("bits", range(5))
def test_every_link_shares_a_key(bits):
    rng = np.random.default_rng(bits)
    one = rng.integers(0, 1 << 64, 2000, dtype=np.uint64, endpoint=False)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in one], np.uint64)

    def sets(u):
        keys, at = simhash.candidate_keys(u.view(np.int64))
        out = [set() for _ in u]
        for k, i in zip(keys.tolist(), at.tolist()):
            assert k not in out[i]
            out[i].add(k)
        return out

    assert all(a & b for a, b in zip(sets(one), sets(one ^ flips)))


def test_dense_group_and_chain(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 63))
    dense = {base ^ sum(1 << int(b) for b in rng.choice(40, int(rng.integers(0, 5)), replace=False)) for _ in range(400)}
    chain, x = [], int(rng.integers(0, 1 << 62))
    for i in range(12):
        chain.append(x)
        x ^= 0b1111 << (4 * i)
    values = sorted(dense) + chain + [0] + rng.integers(0, 1 << 63, 50).tolist()
    df = spark.createDataFrame([(int(v),) for v in values], "fp long")
    got = {r["node"]: r["root"] for r in simhash.linked_fingerprints(df).collect()}
    want = brute_components(list(zip(values, values)))
    groups = {}
    for d, _, c in want:
        groups.setdefault(c, set()).add(d)
    for members in groups.values():
        assert len({got.get(m, m) for m in members}) == 1
    assert len({got.get(int(v), int(v)) for v in values}) == len(groups)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots_of({n for e in links for n in e}, links)
    assert got.keys() == {n for e in links if e[0] != e[1] for n in e}
    assert len({(got[n], want[n]) for n in got}) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ROWS = [(1, "Same Text here"), (2, "same text HERE"), (3, None), (4, ""), (9, "alone"), (None, "alone too"), (7, "x" * 300 + "a"),
        (8, "x" * 300 + "b"), (2, "same text here"), (2, "same text HERE"), (None, "ÄÖ same"), (None, "ÄÖ SAME"), (5, "äö same")]


def test_exact_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as keep_id", "'k' as kept", "2 as n")
    rows = {(r["doc_id"], r["text"]): r for r in exact_dedup.mark_duplicates(df).collect()}
    assert rows[1, "Same Text here"]["keep_id"] == 2 and not rows[1, "Same Text here"]["kept"]
    assert rows[2, "same text HERE"]["group_size"] == 4 and rows[2, "same text HERE"]["kept"]
    assert rows[3, None]["keep_id"] == 4 and rows[9, "alone"]["kept"] and rows[9, "alone"]["n"] == 2
    assert rows[None, "ÄÖ same"]["group_size"] == 2 and rows[None, "ÄÖ same"]["keep_id"] is None
    assert rows[7, "x" * 300 + "a"]["group_size"] == 1 and rows[5, "äö same"]["group_size"] == 1
    left = exact_dedup.distinct_documents(df)
    assert left.columns == df.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in left.collect()) == sorted(
        [("2", "same text here"), ("4", ""), ("9", "alone"), ("None", "alone too"), ("7", "x" * 300 + "a"),
         ("8", "x" * 300 + "b"), ("None", "äö same"), ("5", "äö same")])
    assert exact_dedup.mark_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as fp", "'k' as mark", "2 as root")
    rows = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    want = brute_components([(d, brute_fingerprint(t)) for d, t in ROWS])
    assert sorted(((d, f"{f % 2 ** 64:016x}", c) for d, f, c in rows), key=str) == want
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.count() == len({brute_fingerprint(t) for _, t in ROWS})
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_shards_are_near_equal_and_gapless(spark, data):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = entry.queries()["op7_sharding"](spark, data).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    loads, places, owner = {}, {}, {}
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
        assert owner.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
    assert set(loads) == set(range(8))
    assert max(loads.values()) - min(loads.values()) < 0.05 * max(loads.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_rebalancing_edits_the_map(spark, tmp_path):
    sizes = spark.createDataFrame([(i, 100 + i % 7, 1) for i in range(512)], "slot int, bytes long, rows long")
    folder = str(tmp_path / "map")
    first = sharding.store(sharding.first_map(sizes, 4), folder)
    grown = sharding.latest(sharding.store(sharding.rebalanced(first, sizes, 5), folder))
    before = {r["slot"]: r["shard"] for r in first.where("version = 0").collect()}
    after = {r["slot"]: r["shard"] for r in grown.collect()}
    moved = [s for s in before if before[s] != after[s]]
    assert {r["version"] for r in grown.collect()} == {1} and len(after) == 512
    assert sum(after[s] == 4 for s in moved) >= 0.95 * len(moved) and 90 <= len(moved) <= 115


def test_shards_of_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as slot", "'k' as shard")
    rows = sharding.shard_records(df, shards=3).collect()
    assert len(rows) == len(ROWS) and all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    assert sharding.shard_records(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_quality_rules", "op6_exact_dedup"])
def test_same_as_sql(spark, data, name):
    assert not differences(entry.queries()[name](spark, data), connect(data), entry.oracle_sql()[name])
