"""Queries: sources, sinks, row operators, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.registry import query
from tidegauge.functions import labels as L
from tidegauge.functions import maps as M
from tidegauge.functions import text as T
from tidegauge.operators import joins as J
from tidegauge.operators import rows as R
from tidegauge.operators import splits as S
from tidegauge.plans import prepare as P
from tidegauge.plans.evaluate import evaluate_linking, evaluate_propagation, long_metrics, metrics_json
from tidegauge.plans.reports import propagation_report
from tidegauge.schemas import struct_of, PROPAGATION_LABELS
from tidegauge.sources import published as PUB
from tidegauge.sources import tables as IO
from tidegauge.streaming import results as OUT

# --------------------------------------------------------------------------- sources and sinks

_EVENTS = struct_of("event_id user_id: bigint, event_type: str, value: double, props: str")


@query("scan_jsonl", "SELECT event_id, user_id, event_type, value, props FROM events")
def scan_jsonl(v):
    path = v.scratch()
    IO.write_jsonl(v.table("events").select(*_EVENTS.names), path)
    return IO.read_jsonl(v.spark, path, _EVENTS)


_PART = struct_of("p_partkey: bigint, p_name p_brand p_type: str, p_size: int, p_retailprice: double")
_PART_SQL = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


def _documents(v, keyed: bool) -> str:
    """Write the part table as many JSON documents of up to 1000 records each."""
    record = F.struct(*_PART.names)
    body = (F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), record)))
            if keyed else F.collect_list(record))
    docs = v.table("part").groupBy(F.floor(F.col("p_partkey") / 1000).alias("doc")).agg(
        F.to_json(body).alias("value"))
    path = v.scratch()
    docs.write.partitionBy("doc").text(path)
    return path


@query("scan_json_document", _PART_SQL)
def scan_json_document(v):
    return IO.read_json_document(v.spark, _documents(v, False), _PART).select(*_PART.names)


@query("scan_json_keyed_document", _PART_SQL)
def scan_json_keyed_document(v):
    return IO.read_json_document(v.spark, _documents(v, True), _PART, keyed=True)


@query("post_times", """
SELECT tweet_id, epoch_us(post_time) AS post_us FROM (
  SELECT user_id AS tweet_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS post_time,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
  FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase'))
WHERE rn = 1 AND post_time IS NOT NULL""")
def post_times(v):
    events = v.table("events")
    posts = events.select(F.col("user_id").alias("tweet_id"), "event_id", F.when(
        F.col("event_id") % 13 == 0, "bad time").otherwise(F.col("ts").cast("string")).alias("created_at"))
    wanted = events.where("event_type = 'purchase'").select(F.col("user_id").alias("tweet_id"))
    return J.post_times(posts, wanted, "event_id").select("tweet_id", T.micros(F.col("post_time")).alias("post_us"))


@query("yes_ticks", """
SELECT event_type AS condition_id, epoch_us(ts) // 1000 AS ts_ms, value AS close_price FROM events
WHERE event_id % 3 <> 0 AND event_id % 17 <> 0""")
def yes_ticks(v):
    raw = v.table("events").select(
        F.col("event_type").alias("condition_id"),
        F.when(F.col("event_id") % 3 == 0, "No").otherwise("Yes").alias("side"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(F.col("event_id") % 17 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("close"))
    ticks = J.yes_ticks(raw)
    return ticks.select("condition_id", F.unix_millis("ts").alias("ts_ms"), "close_price")


_SPLIT_SPREAD = """
h AS (SELECT *, md5(concat('42|', tweet_id, '|', primary_condition_id)) AS h FROM (
  SELECT * REPLACE (CASE label WHEN 'no_effect' THEN 'no_cross_market_effect' ELSE label END AS label)
  FROM v_spread)),
c AS (SELECT label, count(*) AS n FROM h GROUP BY label),
f AS (SELECT label, floor(n * 0.2 + 1e-9) AS base, round(n * 0.2 - floor(n * 0.2 + 1e-9), 9) AS rest,
        ceil((SELECT sum(n) FROM c) * 0.2 - 1e-9) AS total FROM c),
q AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
        <= total - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS quota FROM f),
s AS (SELECT h.*, CASE WHEN row_number() OVER (PARTITION BY h.label ORDER BY h.h) <= q.quota
        THEN 'test' ELSE 'train' END AS split FROM h JOIN q ON h.label = q.label)"""


@query("load_task", """
SELECT tweet_id, primary_condition_id, label, confound_flag, insufficient_data_flag,
  CASE WHEN row_number() OVER (ORDER BY tweet_id) <= floor(count(*) OVER () * 0.8)
       THEN 'train' ELSE 'test' END AS split FROM v_spread""")
def load_task(v):
    root = v.scratch()
    IO.write_jsonl(v.spread(), f"{root}/t6.jsonl")
    return IO.load_task(v.spark, root, " T6 ", order=["tweet_id"]).select(
        "tweet_id", "primary_condition_id", "label", "confound_flag", "insufficient_data_flag", "split")


@query("prepare_all", """
WITH t AS (SELECT 't1' AS task, CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, c_mktsegment AS label
  FROM customer UNION ALL SELECT 't3', 'test', CAST(final_grade AS VARCHAR) FROM v_grades),
c AS (SELECT task, split, label, count(*) AS n FROM t GROUP BY ALL)
SELECT task, split, CAST(sum(n) AS BIGINT) AS n,
  concat('{', string_agg(concat('"', label, '":', n), ',' ORDER BY label), '}') AS labels FROM c GROUP BY ALL""")
def prepare_all(v):
    """Tasks that bring their own parts, one of them as arrays, with the manifest of what was written."""
    root = v.scratch()
    _write_t1(v, root)
    _write_t3(v, root)
    return P.prepare_all(v.spark, root, v.scratch(), ["t1", "t3"])


def _write_t1(v, root: str) -> None:
    rows = v.table("customer").select(F.col("c_custkey").alias("condition_id"), F.col("c_mktsegment").alias("interest_label"),
                                      F.col("c_acctbal").alias("score"))
    IO.write_jsonl(rows.where("condition_id % 3 = 0"), f"{root}/t1_test.jsonl")
    IO.write_jsonl(rows.where("condition_id % 3 <> 0"), f"{root}/t1_train.jsonl")


def _write_t3(v, root: str) -> None:
    """A JSON array per thousand grades."""
    rows = v.grades().select(F.struct(F.col("k").alias("tweet_id"), (F.col("k") % 7).cast("string").alias("condition_id"),
                                      "final_grade").alias("r"))
    arrays = rows.groupBy(F.floor(F.col("r.tweet_id") / 1000).alias("part")).agg(F.to_json(F.collect_list("r")).alias("value"))
    arrays.write.partitionBy("part").text(f"{root}/t3.json")


@query("load_task_t1", """
SELECT CAST(c_custkey AS VARCHAR) AS condition_id, c_mktsegment AS interest_label, c_acctbal AS score,
  CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM customer""")
def load_task_t1(v):
    root = v.scratch()
    _write_t1(v, root)
    return IO.load_task(v.spark, root, "t1").select("condition_id", "interest_label", "score", "split")


@query("load_task_t2", "SELECT tweet_id, CAST(market_id AS VARCHAR) AS market_id, 'test' AS split FROM v_links")
def load_task_t2(v):
    root = v.scratch()
    IO.write_jsonl(v.links().select("tweet_id", "market_id"), f"{root}/t2.jsonl")
    return IO.load_task(v.spark, root, "t2").select("tweet_id", "market_id", "split")


@query("load_task_t3", """
SELECT k AS tweet_id, CAST(k % 7 AS VARCHAR) AS condition_id, CAST(final_grade AS INT) AS final_grade, 'test' AS split
FROM v_grades""")
def load_task_t3(v):
    root = v.scratch()
    _write_t3(v, root)
    return IO.load_task(v.spark, root, "t3").select("tweet_id", "condition_id", "final_grade", "split")


_IMPACT = """SELECT tweet_id, CAST(condition_id AS VARCHAR) AS condition_id,
  TRY_CAST(json_extract(TRY_CAST(price_impact_json AS JSON), '$."2h"') AS DOUBLE) AS impact_2h,
  CASE WHEN row_number() OVER (ORDER BY tweet_id, CAST(condition_id AS VARCHAR)) <= floor(count(*) OVER () * 0.8)
       THEN 'train' ELSE 'test' END AS split FROM v_horizons"""


def _impact_task(v, task: str, as_text: bool):
    """The impact file with maps as JSON text or as objects."""
    root = v.scratch()
    rows = v.horizons().withColumn("condition_id", F.col("condition_id").cast("string"))
    if not as_text:
        rows = rows.withColumn("price_impact_json", F.from_json("price_impact_json", "map<string,double>"))
    IO.write_jsonl(rows, f"{root}/t5.jsonl")
    return IO.load_task(v.spark, root, task, order=["tweet_id", "condition_id"]).select(
        "tweet_id", "condition_id", F.try_element_at("price_impact_json", F.lit("2h")).alias("impact_2h"), "split")


@query("load_task_t5", _IMPACT)
def load_task_t5(v):
    return _impact_task(v, "t5", True)


@query("load_task_t7", _IMPACT)
def load_task_t7(v):
    return _impact_task(v, "t7", False)


@query("eval_t2_loaded", """
WITH g AS (SELECT tweet_id, arg_max(market_id, (gold, seq)) AS gold_id FROM v_links GROUP BY 1 HAVING bool_or(gold)),
p AS (SELECT tweet_id, min(market_id) AS first_id FROM v_links GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN gold_id = first_id THEN 1.0 ELSE 0 END), 8) AS acc_at_1,
  round(avg(CASE WHEN gold_id = first_id THEN 1.0 ELSE 0 END), 8) AS mrr FROM g JOIN p USING (tweet_id)""")
def eval_t2_loaded(v):
    """Gold read from its file, where only one of the two flags is filled, then scored."""
    root = v.scratch()
    IO.write_jsonl(v.links().select("tweet_id", "market_id", F.col("gold").alias("is_gold"),
                                    F.col("seq").alias("embedding_score")), f"{root}/t2.jsonl")
    gold = IO.load_task(v.spark, root, "t2", split="test")
    preds = v.links().groupBy("tweet_id").agg(F.array(F.min("market_id").cast("string")).alias("ranked_market_ids"))
    return evaluate_linking(preds, gold, "embedding_score").withColumns({c: F.round(c, 8) for c in ("acc_at_1", "mrr")})


@query("t6_report_loaded", """
WITH o AS (SELECT CASE label WHEN 'no_effect' THEN 'no_cross_market_effect' ELSE label END AS label FROM v_spread
  WHERE confound_flag = false)
SELECT 'majority' AS baseline, (SELECT count(*) FROM o) AS n, round(2 * share / (1 + share) / 3, 8) AS macro_f1
FROM (SELECT max(n) / sum(n) AS share FROM (SELECT count(*) AS n FROM o GROUP BY label))""")
def t6_report_loaded(v):
    """The report over a file that lacks the optional flag: no row is short of data."""
    root = v.scratch()
    IO.write_jsonl(v.spread().drop("insufficient_data_flag"), f"{root}/t6.jsonl")
    rows = IO.load_task(v.spark, root, "t6", order=["tweet_id"])
    rows = rows.withColumn("label", R.normalize_label(F.col("label")))
    return propagation_report(rows, PROPAGATION_LABELS, ["tweet_id"]).where("baseline = 'majority'").withColumn(
        "macro_f1", F.round("macro_f1", 8))


@query("load_prepared_task", f"""
WITH {_SPLIT_SPREAD}
SELECT tweet_id, primary_condition_id, label, confound_flag FROM s WHERE split = 'test'""")
def load_prepared_task(v):
    root = v.scratch()
    P.write_task(P.prepare_task(v.spread(), "t6"), root, "t6")
    return IO.load_task(v.spark, root, "t6", split="test").select(
        "tweet_id", "primary_condition_id", "label", "confound_flag")


@query("prepare_task", f"""
WITH {_SPLIT_SPREAD}
SELECT tweet_id, primary_condition_id, label, split FROM s""")
def prepare_task(v):
    return P.prepare_task(v.spread(), "t6").select("tweet_id", "primary_condition_id", "label", "split")


@query("prepare_manifest", f"""
WITH {_SPLIT_SPREAD},
m AS (SELECT split, label, count(*) AS n FROM s GROUP BY ALL)
SELECT 't6' AS task, split, CAST(sum(n) AS BIGINT) AS n,
  concat('{{', string_agg(concat('"', label, '":', n), ',' ORDER BY label), '}}') AS labels
FROM m GROUP BY split""")
def prepare_manifest(v):
    return P.manifest(P.prepare_task(v.spread(), "t6"), "t6", "label")


@query("load_markets", _PART_SQL)
def load_markets(v):
    path = v.scratch()
    IO.write_bucketed_parquet(v.table("part"), path, "p_partkey", "p_size", buckets=8)
    return IO.read_bucketed_parquet(v.spark, path).select(*_PART.names)


@query("write_jsonl", "SELECT k, label, score FROM v_pred3")
def write_jsonl(v):
    path = v.scratch()
    IO.write_jsonl(v.pred3(), path)
    return IO.read_jsonl(v.spark, path, struct_of("k: bigint, label: str, score: double"))


@query("append_results", """
SELECT c_custkey, c_mktsegment, 1 AS pass FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, c_mktsegment, 2 FROM customer WHERE c_custkey % 2 <> 0""")
def append_results(v):
    schema = struct_of("c_custkey: bigint, c_mktsegment: str, pass: int")
    rows = v.table("customer").select("c_custkey", "c_mktsegment")
    path = v.scratch()
    OUT.append_results(rows.where("c_custkey % 2 = 0").withColumn("pass", F.lit(1)), path)
    OUT.resume_and_append(rows.withColumn("pass", F.lit(2)), path, schema, ["c_custkey"])
    return IO.read_jsonl(v.spark, path, schema)


@query("append_batches", "SELECT c_custkey, c_mktsegment FROM customer")
def append_batches(v):
    """A batch per segment, each sent twice, next to the folder of a writer that never finished."""
    schema = struct_of("c_custkey: bigint, c_mktsegment: str")
    rows = v.table("customer").select("c_custkey", "c_mktsegment")
    table = v.scratch()
    rows.write.parquet(f"{table}/data/unfinished")
    for part in (0, 1, 2, 1, 0):
        PUB.append_batch(rows.where(F.coalesce(F.pmod("c_custkey", F.lit(3)), F.lit(0)) == part), table, f"part-{part}")
    return PUB.read_batches(v.spark, table, schema)


@query("write_validated", """
SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS refused_for
FROM customer WHERE c_acctbal >= 0""")
def write_validated(v):
    """The table that meets its rules, with the violations that refused the whole one."""
    rows = v.table("customer").select("c_custkey", "c_acctbal")
    rules = {"null_key": F.col("c_custkey").isNull(), "negative_balance": F.col("c_acctbal") < 0}
    path, refused = v.scratch(), {}
    try:
        PUB.write_validated(rows, path, rules)
    except PUB.ContractError as failed:
        refused = failed.violations
    good = v.scratch()
    PUB.write_validated(rows.where("c_acctbal >= 0"), good, rules)
    return v.spark.read.schema(rows.schema).parquet(good).withColumn(
        "refused_for", F.lit(refused.get("negative_balance", 0)).cast("long"))


@query("ingest_new_files", "SELECT c_custkey, c_mktsegment FROM customer")
def ingest_new_files(v):
    schema = struct_of("c_custkey: bigint, c_mktsegment: str")
    rows = v.table("customer").select("c_custkey", "c_mktsegment")
    source, target, mark = v.scratch(), v.scratch(), v.scratch()
    for part in (rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 2 <> 0")):
        OUT.append_results(part, source)
        OUT.ingest_new_files(v.spark, source, schema, target, mark)
    return IO.read_jsonl(v.spark, target, schema)


@query("metrics_json", """
WITH j AS (SELECT CASE label WHEN 'no_effect' THEN 'no_cross_market_effect' ELSE label END AS gold FROM v_spread),
t AS (SELECT count(*) AS n, count(*) FILTER (gold = 'primary_mover') AS tp FROM j)
SELECT 't6' AS task, concat('{"macro_f1":', round(2.0 * tp / (tp + n) / 3, 4), ',"n":', n, '}')
  AS record FROM t""")
def metrics_json_query(v):
    preds = v.spread().select("tweet_id", F.lit("primary_mover").alias("label"))
    report = evaluate_propagation(preds, v.spread(), "primary_condition_id")
    return metrics_json(long_metrics(report, "t6"))


# --------------------------------------------------------------------------- row operators


@query("validate_table", """
SELECT 'null_key' AS rule, count(*) FILTER (condition_id IS NULL) AS violations FROM v_messy
UNION ALL SELECT 'bad_number', count(*) FILTER (follower_count IS NOT NULL
  AND TRY_CAST(follower_count AS DOUBLE) IS NULL) FROM v_messy
UNION ALL SELECT 'missing_price', count(*) FILTER (price_t0 IS NULL) FROM v_messy
UNION ALL SELECT 'duplicate_key', count(*) - count(DISTINCT tweet_id) FROM v_messy""")
def validate_table(v):
    number = T.try_double(F.col("follower_count"))
    return R.validate_table(R.require_columns(v.messy(), ["tweet_id", "condition_id"]), {
        "null_key": F.col("condition_id").isNull(),
        "bad_number": F.col("follower_count").isNotNull() & number.isNull(),
        "missing_price": F.col("price_t0").isNull()}, ["tweet_id"])


@query("filter_non_confounded", "SELECT tweet_id, label FROM v_spread WHERE confound_flag = false")
def filter_non_confounded(v):
    return R.non_confounded(v.spread()).select("tweet_id", "label")


@query("filter_valid_labels", "SELECT tweet_id, label FROM v_spread WHERE label IN ('no_effect', 'primary_mover')")
def filter_valid_labels(v):
    return R.valid_labels(v.spread(), "label", ["no_effect", "primary_mover"]).select("tweet_id", "label")


@query("filter_sufficient", """
SELECT tweet_id, label FROM v_spread WHERE NOT insufficient_data_flag AND label <> 'propagated_signal'""")
def filter_sufficient(v):
    return R.sufficient_data(v.spread(), label="label", drop_label="propagated_signal").select("tweet_id", "label")


@query("filter_active", """
SELECT tweet_id, delta_2h FROM v_moves WHERE confound_flag = false AND direction_label IS DISTINCT FROM 'flat'""")
def filter_active(v):
    return R.active_rows(v.moves()).select("tweet_id", "delta_2h")


@query("tier_expand", """
SELECT tweet_id, tier FROM v_moves, (VALUES ('tier1_all'), ('tier2_non_confounded'), ('tier3_active')) t(tier)
WHERE tier = 'tier1_all' OR (confound_flag = false
  AND (tier = 'tier2_non_confounded' OR direction_label IS DISTINCT FROM 'flat'))""")
def tier_expand(v):
    return R.expand_tiers(v.moves(), R.movement_tiers()).select("tweet_id", "tier")


@query("coerce_numeric", "SELECT tweet_id, TRY_CAST(follower_count AS DOUBLE) AS follower_count FROM v_messy")
def coerce_numeric(v):
    return R.coerce_numeric(v.messy(), ["follower_count"]).select("tweet_id", "follower_count")


@query("complete_cases", """
WITH k AS (SELECT tweet_id, follower_count, price_t0 FROM v_messy
  WHERE follower_count IS NOT NULL AND price_t0 IS NOT NULL)
SELECT * FROM k WHERE (SELECT count(*) FROM k) >= 30""")
def complete_cases(v):
    return R.complete_cases(v.messy(), ["follower_count", "price_t0"], min_rows=30).drop("condition_id")


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("feature_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, count(DISTINCT {c}) AS n_distinct, "
    f"round(avg({c}), 8) AS mean, round(stddev_samp({c}), 8) AS sd FROM lineitem" for c in _NUMERIC))
def feature_profile(v):
    blocked = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return R.feature_profile(v.table("lineitem"), blocked=blocked).withColumns(
        {c: F.round(c, 8) for c in ("mean", "sd")})


@query("fill_zero", "SELECT tweet_id, coalesce(price_t0, 0.0) AS price_t0 FROM v_messy")
def fill_zero(v):
    return R.fill_constant(v.messy(), ["price_t0"]).select("tweet_id", "price_t0")


@query("impute_median", """
SELECT tweet_id, round(coalesce(price_t0, (SELECT quantile_cont(price_t0, 0.5) FROM v_messy
  WHERE tweet_id % 2 = 0)), 6) AS price_t0 FROM v_messy""")
def impute_median(v):
    messy = v.messy()
    filled = R.impute_median(messy.where("tweet_id % 2 = 0"), messy, ["price_t0"])
    return filled.select("tweet_id", F.round("price_t0", 6).alias("price_t0"))


@query("label_index", """
SELECT tweet_id, CASE label WHEN 'primary_mover' THEN 0 ELSE 1 END AS label_index FROM v_spread
WHERE label IN ('primary_mover', 'propagated_signal')""")
def label_index(v):
    return R.index_labels(v.spread(), "label", ["primary_mover", "propagated_signal"]).select(
        "tweet_id", "label_index")


@query("normalize_label", """
SELECT tweet_id, CASE label WHEN 'no_effect' THEN 'no_cross_market_effect' ELSE label END AS label FROM v_spread""")
def normalize_label(v):
    return v.spread().select("tweet_id", R.normalize_label(F.col("label")).alias("label"))


@query("normalize_keys", """
SELECT CAST(tweet_id AS VARCHAR) AS tweet_id, trim(condition_id) AS condition_id,
  coalesce(trim(follower_count), '') AS follower_count FROM v_messy""")
def normalize_keys(v):
    names = ["tweet_id", "condition_id", "follower_count"]
    return R.normalize_keys(v.messy(), names).select(*names)


@query("flatten_horizons", """
SELECT * FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, '30m' AS horizon, l_discount AS delta FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, '2h', l_tax FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, '6h',
    CASE WHEN l_quantity > 25 THEN l_quantity END FROM lineitem) WHERE delta IS NOT NULL""")
def flatten_horizons(v):
    rows = v.table("lineitem").withColumn("late", F.when(F.col("l_quantity") > 25, F.col("l_quantity")))
    return R.flatten_horizons(rows, ["l_orderkey", "l_linenumber", "l_partkey"],
                              {"30m": "l_discount", "2h": "l_tax", "6h": "late"})


@query("horizon_targets", """
SELECT tweet_id, condition_id, """ + ", ".join(
    f"TRY_CAST(json_extract(TRY_CAST({source} AS JSON), '$.\"{h}\"') AS DOUBLE) AS {metric}_{h}"
    for metric, source in (("price_impact", "price_impact_json"), ("volume_multiplier", "volume_json"))
    for h in ("15m", "30m", "1h", "2h", "6h")) + """
FROM (SELECT *, concat('{"30m":', condition_id + 0.5, ',"1h":', condition_id, ',"6h":', condition_id * 2, '}') AS volume_json
  FROM v_horizons)""")
def horizon_targets(v):
    n = F.col("condition_id")
    volume = F.concat(F.lit('{"30m":'), (n + 0.5).cast("string"), F.lit(',"1h":'), n.cast("string"), F.lit(',"6h":'),
                      (n * 2).cast("string"), F.lit("}"))
    return R.horizon_columns(v.horizons().withColumn("volume_multiplier_json", volume)).drop(
        "price_impact_json", "volume_multiplier_json")


@query("seeded_sample", """
SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5(concat('42|', o_orderkey)), o_orderkey LIMIT 480""")
def seeded_sample(v):
    return S.seeded_sample(v.table("orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 480)


@query("union_splits", """
SELECT tweet_id, label, NULL AS extra FROM v_spread WHERE tweet_id % 5 <> 0
UNION ALL SELECT tweet_id, label, 'x' FROM v_spread WHERE tweet_id % 5 = 0""")
def union_splits(v):
    rows = v.spread().select("tweet_id", "label")
    return R.union_splits(rows.where("tweet_id % 5 <> 0"),
                          rows.where("tweet_id % 5 = 0").withColumn("extra", F.lit("x")))


# --------------------------------------------------------------------------- scalar functions


@query("fmt_value", r"""
SELECT p_partkey, regexp_replace(printf('%.4f', p_retailprice / 7), '\.?0+$', '') AS price,
  regexp_replace(printf('%.4f', CAST(p_size AS DOUBLE)), '\.?0+$', '') AS size,
  CASE WHEN p_size % 3 = 0 THEN 'null' ELSE trim(regexp_replace(p_name, '\s+', ' ', 'g')) END AS name FROM part""")
def fmt_value(v):
    return v.table("part").select(
        "p_partkey", T.format_number(F.col("p_retailprice") / 7).alias("price"),
        T.format_number(F.col("p_size")).alias("size"),
        T.format_text(F.when(F.col("p_size") % 3 != 0, F.col("p_name"))).alias("name"))


@query("trim_text", """
SELECT doc_id, CASE WHEN length(text) <= 1200 THEN text ELSE concat(rtrim(substr(text, 1, 1197)), '...') END AS t
FROM documents""")
def trim_text(v):
    return v.table("documents").select("doc_id", T.trim_text(F.col("text")).alias("t"))


@query("parse_times", """
SELECT event_id, epoch_us(ts) // 1000 AS from_ms, CASE WHEN event_id % 7 = 0 THEN NULL ELSE epoch_us(ts) END AS from_text
FROM events""")
def parse_times(v):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    text = F.when(F.col("event_id") % 7 == 0, "soon").otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return v.table("events").select(
        "event_id", F.unix_millis(T.epoch_ms_to_timestamp(ms)).alias("from_ms"),
        F.unix_micros(T.text_to_timestamp(text)).alias("from_text"))


@query("log_target", """
SELECT c_custkey, round(CASE WHEN c_acctbal / 1000 > -1 THEN ln(1 + c_acctbal / 1000) END, 6) AS y,
  round(CASE WHEN c_acctbal / 1000 > -1 THEN c_acctbal / 1000 END, 6) AS back FROM customer""")
def log_target(v):
    x = F.col("c_acctbal") / 1000
    y = F.when(x > -1, F.log1p(x))
    return v.table("customer").select("c_custkey", F.round(y, 6).alias("y"), F.round(F.expm1(y), 6).alias("back"))


@query("map_get_default", """
SELECT tweet_id, condition_id, CASE WHEN price_impact_json = 'bad' THEN NULL ELSE
  coalesce(TRY_CAST(json_extract(TRY_CAST(price_impact_json AS JSON), '$."2h"') AS DOUBLE), 0) END AS at_2h,
  CASE WHEN price_impact_json = 'bad' THEN NULL ELSE 0.0::DOUBLE END AS at_6h FROM v_horizons""")
def map_get_default(v):
    mapping = M.horizon_map(F.col("price_impact_json"))
    filled = F.size(mapping) > 0
    return v.horizons().select("tweet_id", "condition_id",
                               F.when(filled, M.map_value(mapping, "2h", 0.0)).alias("at_2h"),
                               F.when(filled, M.map_value(mapping, "6h", 0.0)).alias("at_6h"))


_SCORES = """s AS (SELECT c_custkey, greatest(0.0, c_acctbal) AS a, greatest(0.0, 3000 - c_acctbal) AS b,
  greatest(0.0, c_nationkey - 20) AS c, c_mktsegment FROM customer)"""


@query("normalize_scores", f"""
WITH {_SCORES}
SELECT c_custkey, round(CASE WHEN a + c > 0 THEN a / (a + c) WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END, 6) AS up,
  round(CASE WHEN a + c > 0 THEN c / (a + c) WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, 6) AS down FROM s""")
def normalize_scores(v):
    raw = F.create_map(F.lit("up"), F.col("c_acctbal"), F.lit("down"), (F.col("c_nationkey") - 20).cast("double"))
    label = F.when(F.col("c_mktsegment") == "BUILDING", "up").otherwise("down")
    scores = M.normalized_scores(raw, label, ["up", "down"])
    return v.table("customer").select("c_custkey", *[F.round(scores[n], 6).alias(n) for n in ("up", "down")])


@query("argmax_label", f"""
WITH {_SCORES}
SELECT c_custkey, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS label,
  round(greatest(a, b, c), 6) AS confidence FROM s""")
def argmax_label(v):
    low = F.lit(0.0)
    scores = [("a", F.greatest(low, F.col("c_acctbal"))), ("b", F.greatest(low, 3000 - F.col("c_acctbal"))),
              ("c", F.greatest(low, (F.col("c_nationkey") - 20).cast("double")))]
    label, top = M.best_label(scores)
    return v.table("customer").select("c_custkey", label.alias("label"), F.round(top, 6).alias("confidence"))


@query("inner_product", """
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm
FROM embeddings""")
def inner_product(v):
    return v.table("embeddings").select(
        "vec_id", F.round(M.inner_product(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


@query("category_onehot", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS category_BUILDING,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS category_MACHINERY FROM customer""")
def category_onehot(v):
    return R.category_onehot(v.table("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment",
                             ["BUILDING", "MACHINERY"]).drop("c_mktsegment")


@query("direction_magnitude", """
SELECT tweet_id, gold_delta,
  CASE WHEN gold_delta > 0.02 THEN 'up' WHEN gold_delta < -0.02 THEN 'down' ELSE 'flat' END AS direction,
  CASE WHEN abs(gold_delta) <= 0.02 THEN 'small' WHEN abs(gold_delta) <= 0.08 THEN 'medium' ELSE 'large' END AS magnitude
FROM v_deltas""")
def direction_magnitude(v):
    delta = F.col("gold_delta")
    return v.deltas().select("tweet_id", "gold_delta", L.direction(delta).alias("direction"),
                             L.magnitude(delta).alias("magnitude"))


@query("momentum_direction", """
SELECT tweet_id, n, CASE WHEN pred_delta > 0 THEN 'up' WHEN pred_delta < 0 THEN 'down' ELSE 'flat' END AS direction
FROM v_deltas""")
def momentum_direction(v):
    return v.deltas().select("tweet_id", "n", L.sign_direction(F.col("pred_delta")).alias("direction"))


@query("clamp_delta", """
SELECT l_orderkey, l_linenumber, round(greatest(-l_discount, least(1 - l_discount, l_quantity / 25 - 1)), 6) AS delta
FROM lineitem""")
def clamp_delta(v):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", F.round(
        L.clamp_delta(F.col("l_discount"), F.col("l_quantity") / 25 - 1), 6).alias("delta"))


