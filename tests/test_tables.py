"""Sources, sinks, splits, joins and row operators."""

import json

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import joins as J
from tidegauge.operators import rows as R
from tidegauge.operators import splits as S
from tidegauge.plans import prepare as P
from tidegauge.schemas import TASK_SCHEMAS, struct_of
from tidegauge.sources import tables as IO
from tidegauge.streaming import results as OUT

PAIR = struct_of("k: bigint, v: str")


def keyed(spark, n, labels=("a", "b", "b")):
    return spark.createDataFrame([(i, labels[i % len(labels)]) for i in range(n)], "k int, label string")


def test_jsonl_skips_blank_lines_and_raises_on_bad_ones(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"k": 9007199254740993, "v": "é"}\n\n   \n{"k": 2}\n', encoding="utf-8")
    rows = IO.read_jsonl(spark, str(good), PAIR).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(2, None), (9007199254740993, "é")]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"k": 1}\n{oops\n')
    with pytest.raises(Exception):
        IO.read_jsonl(spark, str(bad), PAIR).collect()
    assert IO.read_jsonl_or_empty(spark, str(tmp_path / "none"), PAIR).count() == 0


def test_json_documents(spark, tmp_path):
    records = [{"k": i, "v": str(i)} for i in range(3)]
    (tmp_path / "array.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "object.json").write_text(json.dumps({str(r["k"]): r for r in records}))
    for name, is_keyed in (("array", False), ("object", True)):
        rows = IO.read_json_document(spark, str(tmp_path / f"{name}.json"), PAIR, is_keyed).orderBy("k").collect()
        assert [tuple(r) for r in rows] == [(0, "0"), (1, "1"), (2, "2")]


def test_bucketed_parquet_keeps_rows_with_a_hot_key(spark, tmp_path):
    rows = spark.createDataFrame([("hot" if i % 3 else f"m{i}", i) for i in range(90)], "m string, ts int")
    IO.write_bucketed_parquet(rows, str(tmp_path / "t"), "m", "ts", buckets=4, salts=3)
    back = IO.read_bucketed_parquet(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.select("m", "ts").collect())) == sorted(map(tuple, rows.collect()))


def test_prepare_all_and_load(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    for task in ("t5", "t6"):
        names = TASK_SCHEMAS[task].names
        lines = [{**{n: None for n in names}, "tweet_id": i, "decay_class": ["transient", "sustained"][i % 2],
                  "label": ["no_effect", "primary_mover"][i % 2], "condition_id": f"c{i}",
                  "primary_condition_id": f"c{i}"} for i in range(50)]
        (raw / f"{task}.jsonl").write_text("\n".join(json.dumps({k: r[k] for k in names}) for r in lines))
    report = {(r.task, r.split): (r.n, json.loads(r.labels))
              for r in P.prepare_all(spark, str(raw), str(out), ["t5", "t6", "t7"]).collect()}
    assert report["t6", "test"] == (10, {"no_cross_market_effect": 5, "primary_mover": 5})
    assert report["t7", "train"][0] == 40 and report["t5", "test"] == report["t7", "test"]
    assert IO.load_task(spark, str(out), "T7 ", split="test").count() == 10
    with pytest.raises(ValueError, match="unknown task"):
        IO.load_task(spark, str(out), "t9")
    with pytest.raises(ValueError, match="order column"):
        IO.load_task(spark, str(raw), "t6")


def test_resume_skips_finished_and_retries_errors(spark, tmp_path):
    schema = struct_of("k: int, error: str")
    path = str(tmp_path / "out")
    first = spark.createDataFrame([(1, None), (2, "timeout")], schema)
    OUT.resume_and_append(first, path, schema, ["k"], "error")
    again = spark.createDataFrame([(1, None), (2, None), (3, None)], schema)
    OUT.resume_and_append(again, path, schema, ["k"], "error")
    rows = [tuple(r) for r in IO.read_jsonl(spark, path, schema).collect()]
    assert sorted(rows, key=str) == sorted([(1, None), (2, "timeout"), (2, None), (3, None)], key=str)


@pytest.mark.parametrize("n", [1, 7, 100, 1003])
def test_stratified_split_is_a_partition_with_exact_size(spark, n):
    rows = keyed(spark, n)
    split = S.stratified_split(rows, "label", ["k"])
    got = split.collect()
    assert sorted(r.k for r in got) == list(range(n))
    assert sum(r.split == "test" for r in got) == -(-n // 5)
    again = {r.k: r.split for r in S.stratified_split(rows.orderBy(F.rand()), "label", ["k"]).collect()}
    assert again == {r.k: r.split for r in got}


def test_folds_and_positional_split(spark):
    folds = S.stratified_folds(keyed(spark, 203), "label", ["k"]).groupBy("label", "fold").count().collect()
    for label in ("a", "b"):
        sizes = [r["count"] for r in folds if r.label == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    plain = S.stratified_folds(keyed(spark, 20), None, ["k"]).groupBy("fold").count().collect()
    assert [r["count"] for r in plain] == [4] * 5
    parts = S.positional_split(keyed(spark, 11), "k").collect()
    assert all((r.split == "train") == (r.k < 8) for r in parts)
    assert S.positional_split(keyed(spark, 1), "k").first().split == "test"


def test_unlabelled_rows_are_kept(spark):
    rows = keyed(spark, 30, ("a", None, "b"))
    assert S.stratified_split(rows, "label", ["k"]).count() == 30
    assert S.stratified_folds(rows, "label", ["k"]).count() == 30


def test_duplicate_gold_last_wins_and_every_prediction_counts(spark):
    gold = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 0)], "k int, label string, seq int")
    preds = spark.createDataFrame([(1, "b"), (1, "b"), (3, "a")], "k int, label string")
    rows = J.join_pred_gold(preds, gold, ["k"], "seq").collect()
    assert [(r.gold_label, r.label) for r in rows] == [("b", "b"), ("b", "b")]


def test_large_ids_survive_key_joins(spark):
    gold = spark.createDataFrame([(2**53 + 1, "a")], "k bigint, label string")
    preds = spark.createDataFrame([(2**53, "a"), (2**53 + 1, "a")], "k bigint, label string")
    assert J.join_pred_gold(preds, gold, ["k"]).count() == 1


def test_attach_split_test_overrides(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "tweet_id string")
    got = J.attach_split(ids("1", "2", "3"), ids("1 ", "2"), ids(" 2"), ["tweet_id"]).collect()
    assert {r.tweet_id: r.split for r in got} == {"1": "train", "2": "test", "3": ""}


def test_validation_counts(spark):
    rows = spark.createDataFrame([(1, 6), (1, 3), (2, -1), (3, None)], "k int, grade int")
    got = {r.rule: r.violations for r in R.validate_table(
        rows, {"grade_range": ~F.col("grade").between(0, 5), "no_grade": F.col("grade").isNull()}, ["k"]).collect()}
    assert got == {"grade_range": 2, "no_grade": 1, "duplicate_key": 1}


def test_complete_cases_below_minimum_is_empty(spark):
    rows = spark.createDataFrame([("a", 1.0)] * 9 + [("b", 1.0)] * 10 + [("b", None)], "s string, x double")
    assert R.complete_cases(rows, ["x"], ["s"], 10).count() == 10
    assert R.complete_cases(rows, ["x"], min_rows=20).count() == 0


def test_absent_columns_are_added_as_null(spark):
    rows = R.with_declared_columns(spark.createDataFrame([(1, "c", "x")], "tweet_id bigint, primary_condition_id string, label string"),
                                   TASK_SCHEMAS["t6"])
    assert set(TASK_SCHEMAS["t6"].names) == set(rows.columns) and rows.first().sibling_count is None


def test_horizon_columns_flat_value_wins(spark):
    rows = spark.createDataFrame([('{"2h": 1, "15m": 2}', "7", {"2h": 3.0}), ("bad", "x", None)],
                                 "price_impact_json string, price_impact_2h string, volume_multiplier_json map<string,double>")
    got = R.horizon_columns(rows, horizons=["15m", "2h"]).collect()
    assert (got[0].price_impact_15m, got[0].price_impact_2h, got[0].volume_multiplier_2h) == (2.0, 7.0, 3.0)
    assert (got[1].price_impact_15m, got[1].price_impact_2h, got[1].volume_multiplier_2h) == (None, None, None)


def test_many_labels_split_and_weigh(spark):
    """More labels than any broadcast bound would like."""
    rows = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 20_000).cast("string").alias("label"))
    split = S.stratified_split(rows, "label", ["k"])
    assert split.where("split = 'test'").count() == 8000 and split.count() == 40_000
    weights = R.balanced_weights(rows, "label")
    assert weights.count() == 40_000 and weights.where("abs(weight - 1) > 1e-12").count() == 0


def test_positional_split_uses_every_order_column(spark):
    rows = spark.createDataFrame([(i // 5, f"c{i % 5}") for i in range(10)], "tweet_id bigint, condition_id string")
    got = S.positional_split(rows.repartition(4), ["tweet_id", "condition_id"])
    assert sorted((r.tweet_id, r.condition_id) for r in got.where("split = 'test'").collect()) == [(1, "c3"), (1, "c4")]
    assert S.positional_split(rows, ["condition_id", "tweet_id"]).where("split = 'test'").count() == 2
    text = S.positional_split(rows.where("tweet_id = 1"), "condition_id").where("split = 'test'").collect()
    assert [r.condition_id for r in text] == ["c4"]


def test_repeated_gold_without_order_fails(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b")], "k int, label string")
    preds = spark.createDataFrame([(1, "b")], "k int, label string")
    with pytest.raises(Exception, match="repeated key"):
        J.join_pred_gold(preds, gold, ["k"]).collect()


def test_null_sufficiency_flag_keeps_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, True), (3, False)], "k int, insufficient_data_flag boolean")
    assert sorted(r.k for r in R.sufficient_data(rows).collect()) == [1, 3]
    assert [r.k for r in R.sufficient_data(rows, null_as=True).collect()] == [3]


def test_null_and_shifted_keys_hash_apart(spark):
    from tidegauge.functions.hashing import hash_key

    rows = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert rows.select(hash_key(1, F.col("x"), F.col("y"))).distinct().count() == 2


def test_linking_gold_without_flags(spark):
    from tidegauge.plans.evaluate import evaluate_linking

    schema = "tweet_id bigint, market_id string, gold boolean, is_gold boolean, seq int"
    preds = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "tweet_id bigint, ranked_market_ids array<string>")
    for rows in ([(1, "a", None, None, 2), (1, "b", None, None, 1), (2, "d", None, None, 1)],
                 [(1, "a", None, True, 1), (1, "b", None, None, 2), (2, "c", None, False, 3), (2, "d", None, None, 1)]):
        got = evaluate_linking(preds, spark.createDataFrame(rows, schema), "seq").first()
        assert (got.n, got.acc_at_1, got.mrr) == (2, 0.5, 0.5)


def test_yes_ticks_carry_volume_and_order(spark):
    ticks = spark.createDataFrame([("c", "YES", 1000, 0.5, None, 7), ("c", "no", 1000, 0.5, 1.0, 8)],
                                  "condition_id string, side string, timestamp bigint, close double, volume double, seq int")
    row, = J.yes_ticks(ticks).collect()
    assert (row.close_price, row.volume, row.seq) == (0.5, None, 7)


def test_splits_that_a_task_lacks_raise(spark, tmp_path):
    (tmp_path / "t2.jsonl").write_text('{"tweet_id": 1, "market_id": "m"}\n')
    assert IO.load_task(spark, str(tmp_path), "t2", split="test").count() == 1
    with pytest.raises(ValueError, match="no split"):
        IO.load_task(spark, str(tmp_path), "t2", split="train")


def test_clusters_need_a_shared_folder():
    from types import SimpleNamespace

    from tidegauge.session import shared_folder

    conf = SimpleNamespace(get=lambda name, default=None: default)
    for master, fails in (("spark://host:7077", True), ("yarn", True), ("local-cluster[2,1,1024]", True), ("local[4]", False)):
        session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
        if fails:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                shared_folder(session)
        else:
            assert shared_folder(session)
