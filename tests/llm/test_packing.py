"""Packing against the tokenizer itself and the bounds of a sequence."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tidegauge.llm import packing

ODD = ["", None, " \t\n ", "It's I'm they'll", "ÉCOLE é  x y\x85z", "<|endoftext|> a<|startoftext|>b ",
       "ΣΑΣ ß İ ǅ", "no\x1cbreak\x00end", "́ a\ńb", "漢字かな交じり文 🙂🙂 ‍", "1234 5.6", "a" * 3000, "#$%&|" * 50]


def whole_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return [e.ids + [2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_rows(rows, ids, capacity=4096):
    cover, inside = defaultdict(list), defaultdict(list)
    for r in rows:
        mine = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(mine)
        assert r["ids_crc32"] == crc(mine[r["start"]:r["start"] + r["length"]])
        cover[r["doc_id"]].append((r["start"], r["length"]))
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, whole in ((cover, {k: len(v) for k, v in ids.items()}), (inside, dict.fromkeys(inside))):
        assert spans.keys() == whole.keys()
        for k, parts in spans.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at and length > 0
                at += length
            assert at == whole[k] if whole[k] is not None else at <= capacity
    assert sorted(inside) == list(range(len(inside)))
    return sum(n for v in inside.values() for _, n in v) / (capacity * len(inside))


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([r["doc_id"] for r in docs], whole_ids([r["text"] for r in docs])))
    filled = check_rows(entry.queries()["op10_packing"](spark, data).collect(), ids)
    assert filled > 0.95


def test_odd_texts_and_small_sequences(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").selectExpr("*", "1 as units", "2 as length")
    ids = dict(enumerate(whole_ids(ODD)))
    rows = packing.pack(df, capacity=64, unit=1, with_ids=True).collect()
    check_rows(rows, ids, 64)
    assert all(r["ids"] == ids[r["doc_id"]][r["start"]:r["start"] + r["length"]] for r in rows)
    assert packing.pack(df.limit(0)).count() == 0


def test_case_and_marks_are_no_new_words():
    """A word of ASCII letters is learned once; ids equal the tokenizer's whatever surrounds it."""
    with open(public_tokenizers.path(packing.TOKENIZER), encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    words = [a + b + "qu" for a in ("ba", "zor", "Ie") for b in ("xi", "LLO", "t")]
    texts = [" ".join(f(w) + m for f in (str.lower, str.upper, str.title) for m in ("", ".", "!!")) for w in words]
    odd = ["it's a.b, x\"., é. É!! éa|", "w  w\n\nW.\tw", "|<|endoftext|>| 5. a5.", "K. ſ ﬁ.", ""]
    assert encoder.encode(pa.array(texts * 3)) == [np.array(i[:-1], "<u4").tobytes() for i in whole_ids(texts)] * 3
    assert len(encoder._known) <= len(words) + 3  # the marks and the empty word
    for part in (odd, odd[:0], odd[::-1] + texts):
        assert encoder.encode(pa.array(part, pa.string())) == [np.array(i[:-1], "<u4").tobytes() for i in whole_ids(part)]


def test_null_keys_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c"), (1, None)], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert len(rows) == 5 and sorted(r["offset"] for r in rows)[0] == 0 and len({r["offset"] for r in rows}) == 5


@pytest.mark.parametrize("seed", range(6))
def test_cutting_stock_is_exact_and_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    room = 128
    sizes = np.sort(rng.choice(np.arange(1, room + 1), 50, replace=False))
    demand = rng.integers(1, 4000, 50)
    plan = packing.cutting_stock(sizes, demand, room)
    assert (sum(p * n for p, n in plan) == demand).all()
    assert all(p @ sizes <= room and p.sum() and n > 0 for p, n in plan)
    used = sum(n for _, n in plan)
    assert -(-int(sizes @ demand) // room) <= used <= first_fit(sizes, demand, room)


def first_fit(sizes, demand, room):
    left, used = demand.copy(), 0
    while left.any():
        p, free = np.zeros(len(sizes), int), room
        for i in np.argsort(-sizes):
            p[i] = min(left[i], free // sizes[i])
            free -= p[i] * sizes[i]
        n = (left[p > 0] // p[p > 0]).min()
        left, used = left - p * n, used + n
    return used


def test_price_is_the_best_pattern():
    rng = np.random.default_rng(3)
    sizes, values = np.array([3, 5, 7, 11]), rng.random(4)
    value, pattern = packing.price(values, sizes, 30)
    best = max(a * values[0] + b * values[1] + c * values[2] + d * values[3]
               for a in range(11) for b in range(7) for c in range(5) for d in range(3) if 3 * a + 5 * b + 7 * c + 11 * d <= 30)
    assert abs(value - best) < 1e-9 and abs(pattern @ values - best) < 1e-9 and pattern @ sizes <= 30


@pytest.mark.parametrize("text", ["", "a b c d", "the river ran on and the rain fell " * 4])
def test_short_texts_fill_their_sequences(spark, text):
    n = len(whole_ids([text])[0])
    count = 20 * 4096 // n
    df = spark.range(count, numPartitions=4).selectExpr("id as doc_id", f"'{text}' as text")
    rows = packing.pack(df).collect()
    ids = dict.fromkeys(range(count), whole_ids([text])[0])
    assert check_rows(rows, ids) >= 0.93  # 20 sequences at best, 21 with the last one begun
    assert len({r["sequence_id"] for r in rows}) <= 21


@pytest.mark.parametrize("room", [512, 64])
def test_bundles_are_never_worse_than_single_pieces(room):
    for length in range(1, room * packing.UNIT + 1):
        each = packing.bundle_of(length, room)
        units = -(-each * length // packing.UNIT)
        assert units <= room and (each == 1 or units <= room // 8)
        alone = room // -(-length // packing.UNIT)
        assert room // units * each >= alone
        if room == 512 and length <= 64:
            assert room // units * each * length >= 0.96 * room * packing.UNIT
