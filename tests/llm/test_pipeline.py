"""Every stage of the pipeline against brute force on its own input."""

import re
import zlib

import corpus_pipeline
from test_duplicates import brute_components, brute_fingerprint
from test_native import brute_spans
from test_packing import check_rows, whole_ids

from tidegauge.llm import quality_model


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        rows = docs.collect()
        if name == "packing":
            ids = dict(zip(before, whole_ids([r["text"] for r in before.values()])))
            check_rows(rows, ids)
            continue
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in rows}
        assert len(after) == len(rows)
        if name == "quality":
            learnt = [d for d in labels if zlib.crc32(str(d).encode()) % 4 != 2]
            assert sum((d in after) == (labels[d] == 1) for d in learnt) >= 0.97 * len(learnt)
        elif name == "exact_dedup":
            best = {}
            for d, r in before.items():
                best[folded(r["text"])] = max(d, best.get(folded(r["text"]), d))
            assert set(after) == set(best.values())
        elif name == "near_dedup":
            found = brute_components([(d, brute_fingerprint(r["text"])) for d, r in before.items()])
            assert set(after) == {c for _, _, c in found}
        elif name == "pii":
            assert set(after) == set(before)
            for d, r in after.items():
                assert not brute_spans(r["text"]) and r["n_chars"] == len(r["text"])
                if not brute_spans(before[d]["text"]):
                    assert r["text"] == before[d]["text"]
        if name != "pii":
            assert all(after[d] == before[d] for d in after)
        before = after


def test_run_gives_the_last_stage(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_hard_rows(spark, tmp_path):
    rows = [(1, None, None, "s", 0), (1, None, "en", "s", 0), (None, "a b c", "en", None, 5), (2, "", "de", "s", None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for count, table in enumerate((documents, documents.limit(0))):
        folder = f"{tmp_path}/{count}"
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(
            f"{folder}/labels.parquet")
        assert corpus_pipeline.run(spark, folder).count() == 0  # nothing is known to be good


def test_quality_rejects_nothing_clean(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = quality_model.good_documents(docs, labels).select("doc_id").join(labels, "doc_id").where("quality = 1").count()
    assert kept >= 0.99 * docs.join(labels, "doc_id").where("quality = 1").count()
