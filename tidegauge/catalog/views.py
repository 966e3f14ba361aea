"""The operators' inputs, derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.session import shared_folder

GROUPS = {"view": "g1", "click": "g1", "signup": "g2", "purchase": "g2", "error": "g3"}

SQL_VIEWS = {
    "v_ticks": """SELECT event_type AS condition_id, ts, least(value / 500.0, 1.0) AS close_price,
  value AS volume, event_id AS seq FROM events WHERE user_id % 10 <> 0""",
    "v_rawticks": """SELECT condition_id, date_trunc('millisecond', ts) AS ts, arg_max(close_price, seq) AS close_price
  FROM v_ticks GROUP BY ALL""",
    "v_rawposts": """SELECT * REPLACE (date_trunc('millisecond', post_time) AS post_time) FROM v_posts""",
    "v_posts": """SELECT event_id AS tweet_id, event_type AS condition_id, ts AS post_time,
  event_id % 4 = 0 AS confound_flag FROM events WHERE user_id % 10 = 0""",
    "v_groups": """SELECT DISTINCT event_type AS condition_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'g1'
       WHEN event_type IN ('signup', 'purchase') THEN 'g2' ELSE 'g3' END AS event_group_id FROM events""",
    "v_gold3": "SELECT o_orderkey AS k, o_orderstatus AS label FROM orders",
    "v_pred3": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus
    WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS label, o_totalprice AS score
  FROM orders WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT o_orderkey, 'F', o_totalprice FROM orders WHERE o_orderkey % 50 = 1""",
    "v_both3": """SELECT p.k, g.label AS gold, p.label AS pred, p.score
  FROM v_pred3 p JOIN v_gold3 g ON p.k = g.k""",
    "v_grades": """SELECT p_partkey AS k, p_size % 6 AS final_grade,
  least(5, greatest(0, p_size % 6 + p_partkey % 3 - 1)) AS predicted_grade FROM part""",
    "v_deltas": """SELECT l_orderkey AS tweet_id, l_linenumber AS n, l_discount - 0.05 AS gold_delta,
  l_tax - 0.04 AS pred_delta, l_returnflag AS scope FROM lineitem""",
    "v_horizons": """SELECT l_orderkey AS tweet_id, l_linenumber AS condition_id,
  CASE WHEN l_orderkey % 20 = 0 THEN 'bad' ELSE concat('{"15m":', CAST(l_linenumber AS VARCHAR),
    ',"2h":', CAST(CAST(l_quantity AS INT) AS VARCHAR), '}') END AS price_impact_json FROM lineitem""",
    "v_answers": """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '{"grade": 3}' WHEN 1 THEN 'I think 4.'
    WHEN 2 THEN 'no idea' WHEN 3 THEN '{"grade": 9}' ELSE 'sure: {"grade": 1} ok' END AS raw
  FROM conversations""",
    "v_volume": "SELECT o_custkey AS condition_id, sum(o_totalprice) AS volume FROM orders GROUP BY o_custkey",
    "v_messy": """SELECT c_custkey AS tweet_id, concat(' ', c_name, ' ') AS condition_id,
  CASE WHEN c_custkey % 7 = 0 THEN 'n/a' WHEN c_custkey % 11 = 0 THEN NULL
       ELSE CAST(c_nationkey AS VARCHAR) END AS follower_count,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS price_t0 FROM customer""",
    "v_spread": """SELECT o_orderkey AS tweet_id, CAST(o_custkey AS VARCHAR) AS primary_condition_id,
  CASE o_orderstatus WHEN 'F' THEN 'no_effect' WHEN 'O' THEN 'primary_mover'
       ELSE 'propagated_signal' END AS label,
  CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey % 4 = 0 END AS confound_flag,
  o_custkey % 13 = 0 AS insufficient_data_flag FROM orders""",
    "v_links": """SELECT l_orderkey AS tweet_id, l_partkey AS market_id, l_extendedprice AS seq,
  concat('post ', CAST(l_orderkey AS VARCHAR)) AS tweet_text,
  concat('Will part ', CAST(l_partkey AS VARCHAR), ' sell?') AS market_question,
  l_discount AS embedding_score, l_linenumber = 2 AS gold FROM lineitem""",
    "v_moves": """SELECT l_orderkey * 10 + l_linenumber AS tweet_id, l_discount - 0.05 AS delta_2h,
  l_tax - 0.04 AS pred_delta, l_tax - 0.05 AS delta_30m, l_discount - 0.03 AS pred_30m,
  l_quantity / 100.0 AS delta_6h, l_discount - 0.02 AS pred_6h,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_suppkey % 4 = 0 END AS confound_flag,
  CASE WHEN l_discount - 0.05 > 0.02 THEN 'up' WHEN l_discount - 0.05 < -0.02 THEN 'down'
       ELSE 'flat' END AS direction_label,
  CASE WHEN abs(l_discount - 0.05) <= 0.02 THEN 'small' WHEN abs(l_discount - 0.05) <= 0.08 THEN 'medium'
       ELSE 'large' END AS magnitude_bucket FROM lineitem""",
}


class Views:
    """Lazy views over one table folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self) -> str:
        """A new path in the shared folder for a write-and-read-back query."""
        return f"{shared_folder(self.spark)}/tidegauge-{uuid.uuid4().hex}"

    def ticks(self) -> DataFrame:
        return self.table("events").where("user_id % 10 <> 0").select(
            F.col("event_type").alias("condition_id"), "ts",
            F.least(F.col("value") / 500.0, F.lit(1.0)).alias("close_price"),
            F.col("value").alias("volume"), F.col("event_id").alias("seq"))

    def posts(self) -> DataFrame:
        return self.table("events").where("user_id % 10 = 0").select(
            F.col("event_id").alias("tweet_id"), F.col("event_type").alias("condition_id"),
            F.col("ts").alias("post_time"), (F.col("event_id") % 4 == 0).alias("confound_flag"))

    def groups(self) -> DataFrame:
        group = F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])
        return self.table("events").select("event_type").distinct().select(
            F.col("event_type").alias("condition_id"),
            F.coalesce(F.try_element_at(group, F.col("event_type")), F.lit("g3")).alias("event_group_id"))

    def gold3(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("label"))

    def pred3(self) -> DataFrame:
        orders = self.table("orders")
        guess = (F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
                 .when(F.col("o_custkey") % 2 == 0, "F").otherwise("O"))
        base = orders.where("o_orderkey % 10 <> 0").select(
            F.col("o_orderkey").alias("k"), guess.alias("label"), F.col("o_totalprice").alias("score"))
        again = orders.where("o_orderkey % 50 = 1").select(
            F.col("o_orderkey").alias("k"), F.lit("F").alias("label"), F.col("o_totalprice").alias("score"))
        return base.unionByName(again)

    def grades(self) -> DataFrame:
        guess = F.col("p_size") % 6 + F.col("p_partkey") % 3 - 1
        return self.table("part").select(
            F.col("p_partkey").alias("k"), (F.col("p_size") % 6).alias("final_grade"),
            F.least(F.lit(5), F.greatest(F.lit(0), guess)).alias("predicted_grade"))

    def deltas(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("tweet_id"), F.col("l_linenumber").alias("n"),
            (F.col("l_discount") - 0.05).alias("gold_delta"), (F.col("l_tax") - 0.04).alias("pred_delta"),
            F.col("l_returnflag").alias("scope"))

    def horizons(self) -> DataFrame:
        text = F.concat(F.lit('{"15m":'), F.col("l_linenumber").cast("string"), F.lit(',"2h":'),
                        F.col("l_quantity").cast("int").cast("string"), F.lit("}"))
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("tweet_id"), F.col("l_linenumber").alias("condition_id"),
            F.when(F.col("l_orderkey") % 20 == 0, "bad").otherwise(text).alias("price_impact_json"))

    def answers(self) -> DataFrame:
        turn = F.col("turn") % 5
        raw = (F.when(turn == 0, '{"grade": 3}').when(turn == 1, "I think 4.").when(turn == 2, "no idea")
               .when(turn == 3, '{"grade": 9}').otherwise('sure: {"grade": 1} ok'))
        return self.table("conversations").select("conv_id", "turn", raw.alias("raw"))

    def volume(self) -> DataFrame:
        return self.table("orders").groupBy(F.col("o_custkey").alias("condition_id")).agg(
            F.sum("o_totalprice").alias("volume"))

    def messy(self) -> DataFrame:
        followers = (F.when(F.col("c_custkey") % 7 == 0, "n/a").when(F.col("c_custkey") % 11 == 0, None)
                     .otherwise(F.col("c_nationkey").cast("string")))
        return self.table("customer").select(
            F.col("c_custkey").alias("tweet_id"),
            F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("condition_id"),
            followers.alias("follower_count"),
            F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("price_t0"))

    def spread(self) -> DataFrame:
        label = (F.when(F.col("o_orderstatus") == "F", "no_effect")
                 .when(F.col("o_orderstatus") == "O", "primary_mover").otherwise("propagated_signal"))
        return self.table("orders").select(
            F.col("o_orderkey").alias("tweet_id"),
            F.col("o_custkey").cast("string").alias("primary_condition_id"), label.alias("label"),
            F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey") % 4 == 0).alias("confound_flag"),
            (F.col("o_custkey") % 13 == 0).alias("insufficient_data_flag"))

    def links(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("tweet_id"), F.col("l_partkey").alias("market_id"),
            F.col("l_extendedprice").alias("seq"),
            F.concat(F.lit("post "), F.col("l_orderkey").cast("string")).alias("tweet_text"),
            F.concat(F.lit("Will part "), F.col("l_partkey").cast("string"), F.lit(" sell?"))
            .alias("market_question"),
            F.col("l_discount").alias("embedding_score"), (F.col("l_linenumber") == 2).alias("gold"))

    def moves(self) -> DataFrame:
        from tidegauge.functions.labels import direction, magnitude

        delta = F.col("l_discount") - 0.05
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tweet_id"), delta.alias("delta_2h"),
            (F.col("l_tax") - 0.04).alias("pred_delta"), (F.col("l_tax") - 0.05).alias("delta_30m"),
            (F.col("l_discount") - 0.03).alias("pred_30m"), (F.col("l_quantity") / 100.0).alias("delta_6h"),
            (F.col("l_discount") - 0.02).alias("pred_6h"),
            F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey") % 4 == 0).alias("confound_flag"),
            direction(delta).alias("direction_label"), magnitude(delta).alias("magnitude_bucket"))
