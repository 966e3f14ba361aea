"""Classifiers: held-out accuracy, array trees against plain walking, odd rows."""

import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from tidegauge.llm import quality_model, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, folds, fold, least", [
    ("op2_quality_classifier", "quality", 4, 2, 0.96), ("op8_toxicity", "toxic", 3, 1, 0.92)])
def test_held_out_accuracy(spark, name, label, folds, fold, least):
    rows = {r["doc_id"]: r for r in entry.queries()[name](spark, DATA).collect()}
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % folds == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    held = [(rows[x["doc_id"]]["predicted"], x[label]) for x in labels if rows[x["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= least * len(held)


def test_array_trees_walk_like_plain_ones():
    rng = np.random.default_rng(2)
    x = rng.random((600, 5))
    y = ((x[:, 1] > 0.4) ^ (x[:, 3] > 0.7)).astype(float)
    forest = quality_model.fit(x, y, rounds=30, depth=3)

    def walk(row):
        total = forest.start
        for feature, cut, value in zip(forest.feature, forest.cut, forest.value):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + int(row[feature[at]] > cut[at])
            total += value[at - len(feature)]
        return total

    assert np.allclose(forest.margin(x), [walk(r) for r in x])
    assert ((forest.score(x) >= 0.5) == (y == 1)).mean() > 0.99
    assert forest.margin(x[:0]).shape == (0,)


def test_fit_without_two_classes():
    x = np.zeros((4, 3))
    assert np.allclose(quality_model.fit(x[:0], np.zeros(0)).score(x), 0.5)
    assert (quality_model.fit(x, np.ones(4)).score(x) > 0.99).all()


def test_grams_cover_the_whole_text():
    long = "clean words here " * 60_000
    distinct = toxicity.Distinct()
    ends = toxicity.grams(" zqxjw ")[-1]
    assert ends not in distinct(long) and ends in distinct(long + "zqxjw")
    assert sorted(distinct(long)) == sorted(set(toxicity.grams(long)))
    # every size from every place, repeats included
    text = " ab cd "
    assert len(toxicity.grams("Ab \n cD")) == sum(len(text) - n + 1 for n in toxicity.SIZES)
    assert sorted(toxicity.grams("Ab \n cD")) == sorted(toxicity.grams("ab CD"))
    assert len(toxicity.grams(None)) == 0


def plain_grams(text):
    """Character n-grams of a text as a set of buckets, one at a time."""
    c = " " + " ".join((text or "").lower().split()) + " "
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(c) - n + 1):
            h = 0
            for x in c[i:i + n]:
                h = (h * 1_000_003 + ord(x)) % 2 ** 64
            out.add((h + n) * 0x9E3779B97F4A7C15 % 2 ** 64 >> 64 - toxicity.BITS)
    return out


def test_scores_equal_a_plain_scorer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    for r in toxicity.score_documents(docs, model).limit(60).collect():
        z = model.bias + sum(float(model.weight[b]) for b in plain_grams(r["text"]))
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6


def test_fit_uses_every_bucket(spark):
    texts = [(i, f"word{i % 7} plain rest" + (f" vile{i}x" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(80)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, toxic int"))
    seen = [t for t in texts if zlib.crc32(str(t[0]).encode()) % 3 != 1]
    pos, neg = (sum(y == c for *_, y in seen) for c in (1, 0))
    counts = {}
    for _, text, y in seen:
        for b in plain_grams(text):
            counts.setdefault(b, [0, 0])[y] += 1
    ratio = {b: np.log((p + 1) / (pos + 2)) - np.log((n + 1) / (neg + 2)) for b, (n, p) in counts.items()}
    assert {int(b) for b in np.flatnonzero(model.weight)} <= set(counts)
    # buckets of one text alone have a weight as well, with the sign of their ratio
    once = [b for b, c in counts.items() if sum(c) == 1]
    assert once and all(model.weight[b] * ratio[b] > 0 for b in once)


def test_rounds_leave_no_shuffle_files(spark, monkeypatch):
    """The disk a fit takes does not depend on the number of its rounds."""
    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    found, descend = [], toxicity.minimise

    def watched(value, *rest):
        def counted(x):
            out = value(x)
            found.append(files())
            return out
        return descend(counted, *rest)

    monkeypatch.setattr(toxicity, "minimise", watched)
    docs = spark.createDataFrame([(i, f"word{i % 7} rest" + " vile" * (i % 4 == 0)) for i in range(80)], "doc_id long, text string")
    toxicity.learn(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int"))
    assert len(found) > 3 and max(found) <= found[0]
    assert all(spark.conf.get(k, None) != v for k, v in toxicity._SETTINGS.items())


def test_descent_and_ratios():
    a = np.diag([1.0, 10.0, 100.0]).astype(np.float32)
    goal = np.array([3, -2, 1], np.float32)
    found = toxicity.minimise(lambda x: (float((x - goal) @ a @ (x - goal)) / 2, a @ (x - goal)), np.zeros(3, np.float32), 0.01,
                              enough=1e-9)
    assert np.allclose(found, goal, atol=1e-2)
    ratio = toxicity.log_ratios(np.array([9.0, 5.0]), np.array([0.0, 5.0]), 10, 10)
    assert np.isclose(ratio[0], np.log((10 / 12) / (1 / 12))) and ratio[1] == 0


DOCS = [(1, None, "a"), (2, "", "b"), (3, "good words in a row here", None), (3, "good words in a row here", None),
        (None, "no key at all", "c"), (4, "###", "d"), (5, "bad bad bad", "e")]
LABELS = [(3, 1, 0), (3, 1, None), (5, 0, 1), (None, 1, 1), (4, None, None), (77, 0, 1)]


@pytest.mark.parametrize("module, label", [(quality_model, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, module, label):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string").selectExpr(
        "*", "9 as score", "8 as __fold", "7 as y", "6 as k")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as y")
    for marks in (labels, labels.limit(0)):
        model = module.learn(docs, marks, label)
        rows = module.score_documents(docs, model).collect()
        assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
        assert all(r["__fold"] == 8 and r["y"] == 7 and r["k"] == 6 for r in rows)
        assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert module.score_documents(docs.limit(0), module.learn(docs.limit(0), labels, label)).count() == 0


def test_good_documents_keep_their_columns(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string").selectExpr("*", "9 as score", "1 as predicted")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = quality_model.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(DOCS)  # one class: all is good
    assert {r["score"] for r in kept.collect()} == {9}


def test_bound_on_learning_rows(spark):
    from tidegauge.llm.labelled import training_rows

    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    n = training_rows(docs, labels, "quality", 4, 2, 200).count()
    assert 140 <= n <= 260
    again = docs.union(docs)
    assert training_rows(again, labels, "quality", 4, 2, 10_000).count() == labels.selectExpr(
        "crc32(cast(cast(doc_id as string) as binary)) % 4 as f").where("f <> 2").count()
