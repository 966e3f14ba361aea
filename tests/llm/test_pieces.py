"""Encoding against a plain dynamic program over all pieces, decoding against the text."""

import random

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
from tidegauge.llm import pieces as sp


@pytest.fixture(scope="module")
def model():
    return sp.Pieces(*sp.read_model(public_tokenizers.path(sp.MODEL)))


def brute(model, table, text):
    """Score and length of the best segmentation, no automaton, no word split."""
    marked = model.marked(text)
    best = [(0.0, 0)] + [None] * len(marked)
    for p in range(1, len(marked) + 1):
        options = [(best[q][0] + table[marked[q:p]], q) for q in range(max(0, p - 24), p) if marked[q:p] in table]
        if marked[p - 1] not in table:
            options.append((best[p - 1][0] + model.unknown_score, p - 1))
        best[p] = max(options, key=lambda o: (o[0], -o[1]))
    return best[-1][0]


ODD = ["", None, " ", "  a  b\n", "\n\n\t", "漢字🙂 ß", "é é", "\x00a", "a" * 3000, "the " * 500, " trailing ", "ſ▁x",
       "".join(chr(i) for i in range(32, 700))]


def scores_of(model):
    texts, scores, kinds = sp.read_model(public_tokenizers.path(sp.MODEL))
    return {t: s for t, s, k in zip(texts, scores, kinds) if k == "normal"}


def test_best_scores_and_round_trip(model):
    table = scores_of(model)
    rng = random.Random(4)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("the anison é\n 12") for _ in range(rng.randrange(60))) for _ in range(200)]
    for t in texts:
        ids, score, _ = model.encode(t)
        assert score == brute(model, table, t), t[:40]
        back = model.decode(ids)
        assert back == t.replace(sp.SPACE_MARK, " ")


def test_crossing_pieces_are_not_split_by_words():
    texts, kinds = ["<unk>", "a", "b", sp.SPACE_MARK, "a" + sp.SPACE_MARK + "b"], ["unknown"] + ["normal"] * 4
    model = sp.Pieces(texts, [0.0, -1.0, -1.0, -1.0, -0.5], kinds, add_prefix=False)
    assert not model.separable and model.encode("a b")[0].tolist() == [4]
    assert model.encode("az")[0].tolist() == [1, 0]
    assert sp.Pieces([], [], []).encode("")[0].tolist() == []


def test_whole_table(spark, data, model):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = entry.queries()["op4_sentencepiece"](spark, data).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    assert all(r["round_trip"] for r in rows)
    table = scores_of(model)
    for r in rows[::10]:
        if len(docs[r["doc_id"]]) < 20_000:
            assert r["score"] == brute(model, table, docs[r["doc_id"]])


def test_odd_rows(spark):
    df = spark.createDataFrame([*enumerate(ODD), (None, "a b"), (None, "a b")], "doc_id long, text string").selectExpr("*", "1 as ids")
    rows = sp.encode_documents(df, with_ids=True).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = "a b" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        assert r["round_trip"] == (sp.SPACE_MARK not in text) and len(r["ids"]) == r["n_tokens"]
    assert sp.encode_documents(df.limit(0)).count() == 0
