"""Queries: joins, metrics, ranks, splits and class baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.registry import query
from tidegauge.operators import baselines as B
from tidegauge.operators import joins as J
from tidegauge.operators import metrics as M
from tidegauge.operators import ranking as K
from tidegauge.operators import rows as R
from tidegauge.operators import splits as S
from tidegauge.plans import clusters as C
from tidegauge.plans import reports as P
from tidegauge.schemas import MOMENTUM_SCALES

STATUS = ["F", "O", "P"]

# --------------------------------------------------------------------------- joins


def both3(v):
    """Predictions joined with gold: k, gold, pred, score."""
    joined = J.join_pred_gold(v.pred3(), v.gold3(), ["k"])
    return joined.select(F.col("k").cast("bigint").alias("k"), F.col("gold_label").alias("gold"),
                         F.col("label").alias("pred"), "score")


@query("join_pred_gold", """
SELECT p.k, g.label AS gold_label, p.label, p.score FROM v_pred3 p JOIN (
  SELECT k, label FROM (SELECT o_custkey AS k, o_orderstatus AS label,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) g ON p.k = g.k""")
def join_pred_gold(v):
    gold = v.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("label"), "o_orderkey")
    joined = J.join_pred_gold(v.pred3(), gold, ["k"], "o_orderkey")
    return joined.select(F.col("k").cast("bigint").alias("k"), "gold_label", "label", "score")


@query("post_time_fallback", """
SELECT o.o_orderkey AS tweet_id, epoch_us(coalesce(e.ts, o.o_orderdate)) AS post_us
FROM orders o LEFT JOIN events e ON o.o_orderkey = e.event_id""")
def post_time_fallback(v):
    labels = v.table("orders").select(F.col("o_orderkey").alias("tweet_id"), F.col("o_orderdate").alias("created_at"))
    times = v.table("events").select(F.col("event_id").alias("tweet_id"),
                                     F.col("ts").cast("timestamp").alias("post_time"))
    return J.with_post_time(labels, times).select("tweet_id", F.unix_micros("post_time").alias("post_us"))


@query("semi_wanted_posts", """
SELECT event_id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def semi_wanted_posts(v):
    wanted = v.table("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return J.wanted_posts(v.table("events"), wanted, "user_id").select("event_id", "event_type")


@query("attach_split", """
SELECT o_orderkey, o_custkey, CASE
  WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'test'
  WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000) THEN 'train' ELSE '' END AS split
FROM orders""")
def attach_split(v):
    keys = v.table("customer").withColumn("o_custkey", F.concat(F.lit(" "), F.col("c_custkey").cast("string")))
    return J.attach_split(v.table("orders").select("o_orderkey", "o_custkey"),
                          keys.where("c_acctbal > 2000"), keys.where("c_mktsegment = 'BUILDING'"), ["o_custkey"])


@query("enrich_features", """
SELECT m.tweet_id, coalesce(m.price_t0, o.o_totalprice) AS price_t0, o.o_orderstatus FROM v_messy m LEFT JOIN (
  SELECT o_custkey, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
  FROM orders) o ON m.tweet_id = o.o_custkey AND o.rn = 1""")
def enrich_features(v):
    right = v.table("orders").select(F.col("o_custkey").alias("tweet_id"), "o_orderkey",
                                     F.col("o_totalprice").alias("price_t0"), "o_orderstatus")
    return J.enrich(v.messy(), right, ["tweet_id"], "o_orderkey", ["price_t0", "o_orderstatus"]).select(
        "tweet_id", "price_t0", "o_orderstatus")


@query("resume_anti", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def resume_anti(v):
    done = v.table("orders").select(F.col("o_custkey").alias("c_custkey"),
                                    F.when(F.col("o_orderstatus") != "F", "timeout").alias("error"))
    return J.pending_rows(v.table("customer").select("c_custkey"), done, ["c_custkey"], "error")


# --------------------------------------------------------------------------- class metrics

_CLASS = """c AS (SELECT gold, pred, count(*) AS n FROM v_both3 GROUP BY ALL),
l AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE gold = label AND pred = label), 0) AS tp,
  coalesce((SELECT sum(n) FROM c WHERE gold = label), 0) AS support,
  coalesce((SELECT sum(n) FROM c WHERE pred = label), 0) AS predicted FROM (VALUES ('F'), ('O'), ('P'), ('X')) t(label)),
f AS (SELECT *, CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0 * tp / (support + predicted) END AS f1 FROM l)"""


def counts3(v):
    return M.confusion_matrix(both3(v), "gold", "pred")


@query("class_distribution", """
SELECT o_orderstatus AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 8) AS share
FROM orders GROUP BY 1""")
def class_distribution(v):
    return M.class_distribution(v.gold3(), "label").withColumn("share", F.round("share", 8))


@query("confusion_matrix", "SELECT gold, pred, count(*) AS n FROM v_both3 GROUP BY gold, pred")
def confusion_matrix(v):
    return counts3(v)


@query("macro_f1", f"WITH {_CLASS} SELECT round(avg(f1), 8) AS macro_f1 FROM f")
def macro_f1(v):
    return M.macro_f1(counts3(v), [*STATUS, "X"]).select(F.round("macro_f1", 8).alias("macro_f1"))


@query("weighted_f1", f"WITH {_CLASS} SELECT round(sum(f1 * support) / sum(support), 8) AS weighted_f1 FROM f")
def weighted_f1(v):
    return M.weighted_f1(counts3(v)).select(F.round("weighted_f1", 8).alias("weighted_f1"))


@query("accuracy", "SELECT count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0 END), 8) AS accuracy FROM v_both3")
def accuracy(v):
    return M.accuracy(counts3(v)).withColumn("accuracy", F.round("accuracy", 8))


@query("qwk", """
WITH o AS (SELECT final_grade AS g, predicted_grade AS p, count(*) AS n FROM v_grades GROUP BY ALL),
r AS (SELECT final_grade AS g, count(*) AS n FROM v_grades GROUP BY 1),
s AS (SELECT predicted_grade AS p, count(*) AS n FROM v_grades GROUP BY 1)
SELECT (SELECT count(*) FROM v_grades) AS n, round(1 - (SELECT sum((g - p) * (g - p) * n) FROM o)
  / (SELECT sum((r.g - s.p) * (r.g - s.p) * r.n * s.n) / (SELECT count(*) FROM v_grades) FROM r, s), 8) AS qwk""")
def qwk(v):
    counts = M.confusion_matrix(v.grades(), "final_grade", "predicted_grade")
    return M.quadratic_kappa(counts).withColumn("qwk", F.round("qwk", 8))


@query("class_precision", """
SELECT count(*) AS predicted, round(avg(CASE WHEN final_grade = 5 THEN 1.0 ELSE 0 END), 8) AS class_precision
FROM v_grades WHERE predicted_grade = 5""")
def class_precision(v):
    counts = M.confusion_matrix(v.grades(), "final_grade", "predicted_grade")
    return M.class_precision(counts, 5).withColumn("class_precision", F.round("class_precision", 8))


@query("none_f1", f"""
WITH {_CLASS}
SELECT label, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp,
  round(f1, 8) AS f1 FROM f WHERE label = 'P'""")
def none_f1(v):
    return M.class_f1(counts3(v), "P").withColumn("f1", F.round("f1", 8))


# --------------------------------------------------------------------------- correlation and error

_RANKS = """r AS (SELECT scope, rank() OVER (PARTITION BY scope ORDER BY gold_delta)
    + (count(*) OVER (PARTITION BY scope, gold_delta) - 1) / 2.0 AS rg,
  rank() OVER (PARTITION BY scope ORDER BY pred_delta)
    + (count(*) OVER (PARTITION BY scope, pred_delta) - 1) / 2.0 AS rp FROM {src})"""


@query("pearson", "SELECT scope, count(*) AS n, round(corr(gold_delta, pred_delta), 8) AS pearson FROM v_deltas GROUP BY scope")
def pearson(v):
    return M.pearson(v.deltas(), "gold_delta", "pred_delta", ["scope"]).withColumn("pearson", F.round("pearson", 8))


@query("spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS b FROM lineitem)
SELECT count(*) AS n, round(corr(a, b), 8) AS spearman FROM r""")
def spearman(v):
    return M.spearman(v.table("lineitem"), "l_extendedprice", "l_quantity").withColumn(
        "spearman", F.round("spearman", 8))


@query("spearman_by_horizon", f"""
WITH {_RANKS.format(src='v_deltas')}
SELECT scope, count(*) AS n, round(corr(rg, rp), 8) AS spearman FROM r GROUP BY scope""")
def spearman_by_horizon(v):
    return M.spearman(v.deltas(), "gold_delta", "pred_delta", ["scope"]).withColumn("spearman", F.round("spearman", 8))


@query("mae_rmse", """
SELECT coalesce(scope, 'all') AS scope, count(*) AS n, round(avg(abs(gold_delta - pred_delta)), 8) AS mae,
  round(sqrt(avg((gold_delta - pred_delta) * (gold_delta - pred_delta))), 8) AS rmse
FROM v_deltas GROUP BY ROLLUP (scope)""")
def mae_rmse(v):
    return M.regression_error(v.deltas(), "gold_delta", "pred_delta", "scope").withColumns(
        {c: F.round(c, 8) for c in ("mae", "rmse")})


_LISTS = """t AS (SELECT l_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey)[1:10] AS ranked,
  max(l_partkey) FILTER (l_linenumber = 2) AS gold FROM lineitem GROUP BY 1),
w AS (SELECT *, coalesce(list_position(ranked, coalesce(gold, -1)), 0) AS place FROM t)"""


def ranked_parts(v):
    """Per order a ranked list of its first ten parts and one gold part (absent for some orders)."""
    items = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    best = K.top_k(items.select("l_orderkey", "l_partkey").distinct(), ["l_orderkey"], [F.col("l_partkey")], 10)
    ranked = best.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("ranked"))
    gold = items.groupBy("l_orderkey").agg(
        F.coalesce(F.max(F.when(F.col("l_linenumber") == 2, F.col("l_partkey"))), F.lit(-1)).alias("gold"))
    return ranked.join(gold, "l_orderkey")


@query("acc_at_1", f"WITH {_LISTS} SELECT count(*) AS n, round(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0 END), 8) AS acc_at_1 FROM w")
def acc_at_1(v):
    return M.accuracy_at_1(ranked_parts(v), "ranked", "gold").withColumn("acc_at_1", F.round("acc_at_1", 8))


@query("mrr_zero", f"WITH {_LISTS} SELECT count(*) AS n, round(avg(CASE WHEN place > 0 THEN 1.0 / place ELSE 0 END), 8) AS mrr FROM w")
def mrr_zero(v):
    return M.mean_reciprocal_rank(ranked_parts(v), "ranked", "gold").withColumn("mrr", F.round("mrr", 8))


@query("mrr_kplus1", f"WITH {_LISTS} SELECT count(*) AS n, round(avg(CASE WHEN place > 0 THEN 1.0 / place ELSE 1.0 / 11 END), 8) AS mrr FROM w")
def mrr_kplus1(v):
    return M.mean_reciprocal_rank(ranked_parts(v), "ranked", "gold", "k_plus_1", 10).withColumn(
        "mrr", F.round("mrr", 8))


@query("gold_rank", f"WITH {_LISTS} SELECT l_orderkey, CASE WHEN place > 0 THEN place ELSE 11 END::BIGINT AS gold_rank FROM w")
def gold_rank(v):
    return ranked_parts(v).select("l_orderkey", K.gold_rank(F.col("ranked"), F.col("gold"), 10).alias("gold_rank"))


@query("precision_at_k", """
SELECT count(*) AS k, avg(hit) AS precision_at_k FROM (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM orders
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)""")
def precision_at_k(v):
    return M.precision_at_k(v.table("orders"), "o_totalprice", F.col("o_orderstatus") == "F", "o_orderkey", 10)


# --------------------------------------------------------------------------- class baselines


@query("majority_baseline", """
WITH c AS (SELECT o_orderpriority AS scope, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, label) AS rn,
  sum(n) OVER (PARTITION BY scope) AS total, count(*) OVER (PARTITION BY scope) AS k FROM c)
SELECT scope, label AS majority_label, CAST(total AS BIGINT) AS n, round(n / total, 8) AS accuracy,
  round(2 * (n / total) / (1 + n / total) / k, 8) AS macro_f1 FROM m WHERE rn = 1""")
def majority_baseline(v):
    rows = v.table("orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_orderstatus").alias("label"))
    return B.majority(rows, "label", ["scope"]).withColumns(
        {c: F.round(c, 8) for c in ("accuracy", "macro_f1")})


@query("majority_on_test", """
WITH t AS (SELECT o_orderstatus AS label FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1
  ORDER BY count(*) DESC, 1 LIMIT 1),
x AS (SELECT o_orderstatus AS gold, (SELECT label FROM t) AS pred FROM orders WHERE o_orderkey % 5 = 0)
SELECT (SELECT label FROM t) AS majority_label, count(*) AS n,
  round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0 END), 8) AS accuracy,
  round(2.0 * count(*) FILTER (gold = pred) / (count(*) + count(*) FILTER (gold = pred)) / 3, 8) AS macro_f1 FROM x""")
def majority_on_test(v):
    rows = v.table("orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    return B.majority_on_test(rows.where("o_orderkey % 5 <> 0"), rows.where("o_orderkey % 5 = 0"), "label",
                              STATUS).withColumns({c: F.round(c, 8) for c in ("accuracy", "macro_f1")})


@query("random_prior_expected", """
WITH c AS (SELECT o_orderpriority AS scope, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY scope) AS share FROM c)
SELECT scope, CAST(sum(n) AS BIGINT) AS n, round(sum(share * share), 8) AS expected_accuracy,
  round(avg(share), 8) AS expected_macro_f1 FROM p GROUP BY scope""")
def random_prior_expected(v):
    rows = v.table("orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_orderstatus").alias("label"))
    return B.random_prior_expected(rows, "label", ["scope"]).withColumns(
        {c: F.round(c, 8) for c in ("expected_accuracy", "expected_macro_f1")})


_DRAWS = """p AS (SELECT o_orderstatus AS label, sum(count(*)) OVER (ORDER BY o_orderstatus)
    / sum(count(*)) OVER () AS upto FROM orders GROUP BY 1),
d AS (SELECT s.seed, o.o_orderstatus AS gold, (SELECT min(label) FROM p WHERE upto >
    CAST(concat('0x', substr(md5(concat(s.seed, '|', o.o_orderkey)), 1, 8)) AS BIGINT) / 4294967296.0) AS pred
  FROM orders o, (VALUES (13), (42), (123)) s(seed)),
q AS (SELECT seed, gold, pred, count(*) AS n FROM d GROUP BY ALL),
l AS (SELECT s.seed, t.label, sum(n) FILTER (gold = label AND pred = label) AS tp,
  sum(n) FILTER (gold = label) AS support, sum(n) FILTER (pred = label) AS predicted
  FROM (VALUES (13), (42), (123)) s(seed), (VALUES ('F'), ('O'), ('P')) t(label) JOIN q ON true
  WHERE q.seed = s.seed GROUP BY ALL)"""


@query("random_prior_sampled", f"""
WITH {_DRAWS}
SELECT seed, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 8) AS accuracy,
  round(avg(2.0 * tp / (support + predicted)), 8) AS macro_f1 FROM l GROUP BY seed""")
def random_prior_sampled(v):
    return P.sampled_prior(v.table("orders"), "o_orderstatus", STATUS, ["o_orderkey"]).withColumns(
        {c: F.round(c, 8) for c in ("accuracy", "macro_f1")})


@query("random_prior_grades", """
WITH p AS (SELECT final_grade AS label, sum(count(*)) OVER (ORDER BY final_grade) / sum(count(*)) OVER () AS upto
  FROM v_grades GROUP BY 1),
d AS (SELECT s.seed, o.final_grade AS g, (SELECT min(label) FROM p WHERE upto >
    CAST(concat('0x', substr(md5(concat(s.seed, '|', o.k)), 1, 8)) AS BIGINT) / 4294967296.0) AS p
  FROM v_grades o, (VALUES (13), (42), (123)) s(seed)),
r AS (SELECT *, rank() OVER (PARTITION BY seed ORDER BY g) + (count(*) OVER (PARTITION BY seed, g) - 1) / 2.0 AS rg,
  rank() OVER (PARTITION BY seed ORDER BY p) + (count(*) OVER (PARTITION BY seed, p) - 1) / 2.0 AS rp FROM d)
SELECT seed, count(*) AS n, round(corr(rg, rp), 8) AS spearman, round(1 - sum((g - p) * (g - p))
  / (sum(g * g) + sum(p * p) - 2.0 * sum(g) * sum(p) / count(*)), 8) AS qwk FROM r GROUP BY seed""")
def random_prior_grades(v):
    return P.sampled_prior_grades(v.grades(), "final_grade", ["k"]).withColumns(
        {c: F.round(c, 8) for c in ("spearman", "qwk")})


@query("balanced_weights", """
WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * c.n), 8) AS weight
FROM orders JOIN c USING (o_orderstatus)""")
def balanced_weights(v):
    return R.balanced_weights(v.table("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").select(
        "o_orderkey", F.round("weight", 8).alias("weight"))


@query("cluster_features", """
SELECT event_type || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS cluster, count(*) AS tweet_count,
  count(DISTINCT user_id) AS unique_user_count,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0, 6) AS burst_duration_hours,
  max(value) AS max_author_followers, round(avg(value), 6) AS mean_author_followers,
  round(quantile_cont(value, 0.5), 6) AS median_author_followers,
  count(*) FILTER (value > 100) AS high_follower_author_count FROM events GROUP BY 1""")
def cluster_features(v):
    posts = v.table("events").select(
        F.concat_ws("/", "event_type", F.to_date("ts").cast("string")).alias("cluster"), "user_id",
        F.col("ts").alias("post_time"), F.col("value").alias("followers"))
    return C.cluster_features(posts, "cluster", high=100.0).withColumns(
        {c: F.round(c, 6) for c in ("burst_duration_hours", "mean_author_followers", "median_author_followers")})


# --------------------------------------------------------------------------- ranks and top-k


@query("average_rank", """
SELECT l_orderkey, l_linenumber, l_extendedprice, rank() OVER (ORDER BY l_extendedprice)
  + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS "rank" FROM lineitem""")
def average_rank(v):
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return K.average_rank(rows, "l_extendedprice")


@query("topk_candidates", """
SELECT tweet_id, market_id, embedding_score, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tweet_id
  ORDER BY embedding_score DESC, market_id) AS INT) AS rn FROM v_links) WHERE rn <= 3""")
def topk_candidates(v):
    return K.top_k(v.links(), ["tweet_id"], [F.desc("embedding_score"), F.col("market_id")], 3).select(
        "tweet_id", "market_id", "embedding_score", "rn")


@query("dedup_first", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
  FROM events) WHERE rn = 1""")
def dedup_first(v):
    return K.first_per_key(v.table("events").select("user_id", "event_id", "event_type"), ["user_id"],
                           [F.col("event_id")])


@query("dedup_last", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
  FROM events) WHERE rn = 1""")
def dedup_last(v):
    return K.last_per_key(v.table("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("label_union", "SELECT DISTINCT label FROM (SELECT gold AS label FROM v_both3 UNION SELECT pred FROM v_both3)")
def label_union(v):
    return K.distinct_sorted(both3(v), "gold", "pred")


@query("few_shot_per_class", """
SELECT k, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k) AS rn FROM v_gold3
  WHERE label IN ('F', 'O')) WHERE rn <= 3""")
def few_shot_per_class(v):
    return S.few_shot_per_class(v.gold3(), "label", ["F", "O"], [F.col("k")], 3).select("k", "label")


@query("few_shot_filtered", """
SELECT k, label FROM v_gold3 WHERE label <> 'P' AND k % 5 <> 0 ORDER BY k LIMIT 3""")
def few_shot_filtered(v):
    return S.few_shot_filtered(v.gold3().where("k % 5 <> 0"), F.col("label") != "P", [F.col("k")], 3)


# --------------------------------------------------------------------------- splits

_QUOTA = """c AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1),
f AS (SELECT p, floor(n * 0.2 + 1e-9) AS base, round(n * 0.2 - floor(n * 0.2 + 1e-9), 9) AS rest,
  ceil((SELECT sum(n) FROM c) * 0.2 - 1e-9) AS total FROM c),
q AS (SELECT p, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, p) <= total - (SELECT sum(base) FROM f)
  THEN 1 ELSE 0 END AS quota FROM f),
h AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY md5(concat('42|', o_orderkey))) AS rn FROM orders)"""


@query("stratified_split", f"""
WITH {_QUOTA}
SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split
FROM h JOIN q ON h.o_orderpriority = q.p""")
def stratified_split(v):
    return S.stratified_split(v.table("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority",
                              ["o_orderkey"])


@query("holdout_split", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'holdout' WHEN CAST(concat('0x',
  substr(md5(concat('42|', o_orderkey)), 1, 8)) AS BIGINT) < CAST(round(0.15 * 4294967296) AS BIGINT)
  THEN 'holdout' ELSE 'fit' END AS part FROM orders""")
def holdout_split(v):
    rows = v.table("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "test").alias("official"))
    return S.holdout_split(rows, ["o_orderkey"], fraction=0.15, official="official").drop("official")


@query("positional_split", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor(count(*) OVER () * 0.8)
  THEN 'train' ELSE 'test' END AS split FROM orders""")
def positional_split(v):
    return S.positional_split(v.table("orders").select("o_orderkey"), "o_orderkey")


@query("stratified_folds", """
SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY md5(concat('42|', o_orderkey))) - 1) % 5 AS INT) AS fold FROM orders""")
def stratified_folds(v):
    return S.stratified_folds(v.table("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])


@query("interest_label", """
WITH q AS (SELECT quantile_cont(volume, 0.4) AS lo, quantile_cont(volume, 0.8) AS hi FROM v_volume)
SELECT condition_id, CASE WHEN volume > hi THEN 'high_interest' WHEN volume < lo THEN 'low_interest'
  ELSE 'moderate_interest' END AS interest_label FROM v_volume, q""")
def interest_label(v):
    return C.interest_labels(v.volume()).select("condition_id", "interest_label")


# --------------------------------------------------------------------------- forecasts

_TIERED = """m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_tax - 0.04 AS pre, l_discount - 0.05 AS d30,
    l_quantity - 25 AS d2, l_extendedprice AS d6,
    CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_suppkey % 4 = 0 END AS confound_flag,
    CASE WHEN l_quantity - 25 > 0.02 THEN 'up' WHEN l_quantity - 25 < -0.02 THEN 'down' ELSE 'flat' END AS dir
  FROM lineitem),
t AS (SELECT m.*, tier FROM m, (VALUES ('tier1_all'), ('tier2_non_confounded'), ('tier3_active')) x(tier)
  WHERE tier = 'tier1_all' OR (confound_flag = false AND (tier = 'tier2_non_confounded' OR dir <> 'flat'))),
u AS (SELECT tier, '30m' AS horizon, pre AS f, d30 AS d FROM t UNION ALL SELECT tier, '2h', 4 * pre, d2 FROM t
  UNION ALL SELECT tier, '6h', 12 * pre, d6 FROM t),
a AS (SELECT * FROM u UNION ALL SELECT tier, 'all', f, d FROM u),
k AS (SELECT tier, horizon, rank() OVER (PARTITION BY tier, horizon ORDER BY f)
    + (count(*) OVER (PARTITION BY tier, horizon, f) - 1) / 2.0 AS rf,
  rank() OVER (PARTITION BY tier, horizon ORDER BY d)
    + (count(*) OVER (PARTITION BY tier, horizon, d) - 1) / 2.0 AS rd FROM a)"""


@query("momentum_spearman", f"""
WITH {_TIERED}
SELECT tier, horizon, count(*) AS n, round(corr(rf, rd), 8) AS spearman FROM k GROUP BY ALL""")
def momentum_spearman(v):
    rows = v.table("lineitem").select(
        (F.col("l_tax") - 0.04).alias("pre_delta"), (F.col("l_discount") - 0.05).alias("delta_30m"),
        (F.col("l_quantity") - 25).alias("delta_2h"), F.col("l_extendedprice").alias("delta_6h"),
        F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey") % 4 == 0).alias("confound_flag"),
        F.when(F.col("l_quantity") > 25.02, "up").when(F.col("l_quantity") < 24.98, "down").otherwise("flat")
        .alias("direction_label"))
    return B.momentum_spearman(rows, R.movement_tiers(), scales=MOMENTUM_SCALES).withColumn(
        "spearman", F.round("spearman", 8))


@query("zero_drift", """
WITH t AS (SELECT m.*, tier FROM v_moves m, (VALUES ('tier1_all'), ('tier2_non_confounded'), ('tier3_active')) x(tier)
  WHERE tier = 'tier1_all' OR (confound_flag = false
    AND (tier = 'tier2_non_confounded' OR direction_label <> 'flat')))
SELECT tier, count(*) AS n, round(avg(CASE WHEN direction_label = 'flat' THEN 1.0 ELSE 0 END), 8) AS direction_accuracy,
  round(2.0 * count(*) FILTER (magnitude_bucket = 'small')
    / (count(*) FILTER (magnitude_bucket = 'small') + count(*)) / 3, 8) AS magnitude_macro_f1,
  CAST(NULL AS DOUBLE) AS spearman FROM t GROUP BY tier""")
def zero_drift(v):
    return B.zero_drift(v.moves(), R.movement_tiers()).withColumns(
        {c: F.round(c, 8) for c in ("direction_accuracy", "magnitude_macro_f1")})
