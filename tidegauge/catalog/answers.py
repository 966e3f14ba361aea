"""Queries: prompt tables, answer parsing, retrieval and task evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.registry import query
from tidegauge.operators import inference as I
from tidegauge.operators import retrieval as X
from tidegauge.operators import splits as S
from tidegauge.operators.ranking import top_k
from tidegauge.plans import evaluate as E
from tidegauge.plans import reports as P
from tidegauge.schemas import PROPAGATION_LABELS

_NUM = r"regexp_replace(printf('%.4f', CAST({c} AS DOUBLE)), '\.?0+$', '')"


# --------------------------------------------------------------------------- prompts

_BLOCK = f"""concat_ws(chr(10), concat('- name: ', p_name), concat('- type: ', coalesce(p_type, 'null')),
  '- structured_features:', concat('    size: ', {_NUM.format(c='p_size')}),
  concat('    price: ', {_NUM.format(c='p_retailprice')}))"""


def _part_block():
    return I.feature_block({"name": F.col("p_name"), "type": F.col("p_type")},
                           {"size": F.col("p_size"), "price": F.col("p_retailprice")})


@query("prompt_features", f"""
WITH b AS (SELECT p_partkey, p_type, {_BLOCK} AS block FROM part),
e AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rn FROM b
  WHERE p_type IN ('PROMO', 'SMALL') AND p_partkey % 5 <> 0),
s AS (SELECT string_agg(concat('Example ', i, ':', chr(10), block, chr(10), '- label: ', p_type), chr(10) ORDER BY i)
  AS shots FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS i FROM e WHERE rn <= 2))
SELECT p_partkey, concat_ws(chr(10), 'Task: choose the part type.', 'Labeled examples:', (SELECT shots FROM s),
  'Target:', block, 'Return strict JSON only.') AS prompt FROM b""")
def prompt_features(v):
    parts = v.table("part").withColumn("block", _part_block())
    chosen = S.few_shot_per_class(parts.where("p_partkey % 5 <> 0"), "p_type", ["PROMO", "SMALL"],
                                  [F.col("p_partkey")], 2)
    shots = I.example_block(chosen, "block", "p_type", ["p_partkey"])
    return I.feature_prompts(parts, F.col("block"), "Task: choose the part type.", "Return strict JSON only.",
                             shots).select("p_partkey", "prompt")


@query("prompt_candidates", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY embedding_score DESC, market_id) AS rn
  FROM v_links)
SELECT tweet_id, CAST(count(*) AS INT) AS k, list(market_id ORDER BY rn) AS market_ids,
  concat_ws(chr(10), 'Rank all markets.', concat('Post: ', min(tweet_text)), 'Candidate markets:',
    string_agg(concat(rn, '. ', market_question), chr(10) ORDER BY rn), 'Ranking:') AS prompt
FROM t WHERE rn <= 5 GROUP BY tweet_id""")
def prompt_candidates(v):
    return I.candidate_prompts(v.links(), 5, "Rank all markets.", "Ranking:")


@query("prompt_row", f"""
SELECT tweet_id, concat_ws(chr(10), 'Grade the post.', 'Examples:', 'a -> 1', concat('- condition_id: ', trim(condition_id)),
  '- followers: ' || follower_count, CASE WHEN price_t0 IS NOT NULL
    THEN '- price: ' || {_NUM.format(c='price_t0')} END, 'JSON only.') AS prompt
FROM v_messy""")
def prompt_row(v):
    from tidegauge.functions.text import format_number

    price = F.when(F.col("price_t0").isNotNull(), format_number(F.col("price_t0")))
    fields = {"condition_id": F.trim("condition_id"), "followers": F.col("follower_count"), "price": price}
    return I.row_prompts(v.messy(), "Grade the post.", fields, "JSON only.", ["a -> 1"]).select("tweet_id", "prompt")


# --------------------------------------------------------------------------- answers

_INNER = r"regexp_extract(raw, '(?s)(\{.*\})', 1)"


@query("parse_json_answer", f"""
SELECT conv_id, turn, CAST(json_extract(TRY_CAST({_INNER} AS JSON), '$.grade') AS INT) AS grade FROM v_answers""")
def parse_json_answer(v):
    answer = I.json_answer(F.col("raw"), "grade int")
    return v.answers().select("conv_id", "turn", answer["grade"].alias("grade"))


@query("parse_grade", r"""
WITH a AS (SELECT conv_id, turn, raw, TRY_CAST(json_extract(TRY_CAST(raw AS JSON), '$.grade') AS INT) AS j,
  TRY_CAST(regexp_extract(raw, '\b([0-5])\b', 1) AS INT) AS d FROM v_answers),
g AS (SELECT *, coalesce(CASE WHEN j BETWEEN 0 AND 5 THEN j END, d) AS f FROM a)
SELECT conv_id, turn, coalesce(f, 2) AS grade, f IS NULL AS parse_error FROM g""")
def parse_grade(v):
    return I.parsed_grade(v.answers(), "raw").select("conv_id", "turn", "grade", "parse_error")


_LABEL_RAW = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '{"label": " Sustained "}'
  WHEN doc_id % 4 = 1 THEN concat('I say REVERSAL because ', text) WHEN doc_id % 4 = 2 THEN '{"label": "other"}'
  ELSE text END AS raw FROM documents"""


@query("parse_label", f"""
WITH r AS ({_LABEL_RAW}),
f AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'sustained' WHEN lower(raw) LIKE '%transient%' THEN 'transient'
  WHEN lower(raw) LIKE '%sustained%' THEN 'sustained' WHEN lower(raw) LIKE '%reversal%' THEN 'reversal' END AS l FROM r)
SELECT doc_id, coalesce(l, 'transient') AS label, l IS NULL AS parse_error FROM f""")
def parse_label(v):
    kind = F.col("doc_id") % 4
    raw = (F.when(kind == 0, '{"label": " Sustained "}')
           .when(kind == 1, F.concat(F.lit("I say REVERSAL because "), "text"))
           .when(kind == 2, '{"label": "other"}').otherwise(F.col("text")))
    rows = v.table("documents").select("doc_id", raw.alias("raw"))
    return I.parsed_label(rows, "raw", "label", ["transient", "sustained", "reversal"], "transient").drop("raw")


@query("parse_deltas", """
SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 <> 0 THEN greatest(-0.4, least(0.6, o_custkey / 1000.0 - 0.5)) END, 6)
    AS delta_30m, round(CASE WHEN o_orderkey % 3 <> 0 THEN 0.25::DOUBLE END, 6) AS delta_2h,
  round(CASE WHEN o_orderkey % 3 <> 0 THEN -0.4::DOUBLE END, 6) AS delta_6h, o_orderkey % 3 = 0 AS parse_error FROM orders""")
def parse_deltas(v):
    first = (F.col("o_custkey") / 1000.0 - 0.5).cast("string")
    full = F.concat(F.lit('Sure: {"delta_30m": '), first, F.lit(', "delta_2h": 0.25, "delta_6h": -0.9} done'))
    raw = F.when(F.col("o_orderkey") % 3 == 0, '{"delta_30m": 0.1}').otherwise(full)
    rows = v.table("orders").select("o_orderkey", raw.alias("raw"), F.lit(0.4).alias("price"))
    return I.parsed_deltas(rows, "raw", "price").select(
        "o_orderkey", *[F.round(c, 6).alias(c) for c in ("delta_30m", "delta_2h", "delta_6h")], "parse_error")


@query("parse_ranking", r"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey,
    [n FOR n IN [CAST(l_quantity AS INT) % 10, l_linenumber, 99, l_partkey % 10, l_linenumber] IF n BETWEEN 1 AND 6] AS named
  FROM lineitem),
f AS (SELECT *, list_concat(named, [1, 2, 3, 4, 5, 6]) AS x FROM r)
SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(list_filter(x, lambda e, i: list_position(x, e) = i) AS INT[]) AS ranking, len(named) = 0 AS parse_error FROM f""")
def parse_ranking(v):
    raw = F.concat_ws(", ", (F.col("l_quantity").cast("int") % 10).cast("string"),
                      F.col("l_linenumber").cast("string"), F.lit("market 99"),
                      (F.col("l_partkey") % 10).cast("string"), F.col("l_linenumber").cast("string"))
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return I.parsed_ranking(rows, "raw", F.lit(6)).drop("raw")


@query("parse_error_rate", """
SELECT turn % 5 AS kind, count(*) AS n, count(*) FILTER (turn % 5 = 2 OR turn % 5 = 3) AS parse_errors,
  round(avg(CASE WHEN turn % 5 = 2 OR turn % 5 = 3 THEN 1.0 ELSE 0 END), 8) AS error_rate
FROM conversations GROUP BY 1""")
def parse_error_rate(v):
    parsed = I.parsed_grade(v.answers(), "raw").withColumn("kind", F.col("turn") % 5)
    return I.parse_error_rate(parsed, ["kind"]).withColumn("error_rate", F.round("error_rate", 8))


@query("adapt_predictions", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'direct' WHEN o_orderkey % 3 = 1 THEN 'nested' END AS label FROM orders""")
def adapt_predictions(v):
    kind = F.col("o_orderkey") % 3
    rows = v.table("orders").select("o_orderkey", F.when(kind == 0, "direct").alias("pred_label"),
                                    F.struct(F.when(kind == 1, "nested").alias("label")).alias("prediction"))
    return I.adapt_predictions(rows, ["o_orderkey"])


# --------------------------------------------------------------------------- retrieval

_TOP = """q AS (SELECT vec_id AS query_id, embedding AS v, label FROM embeddings WHERE vec_id % 10 = 0),
c AS (SELECT vec_id AS doc_id, embedding AS v, label FROM embeddings WHERE vec_id % 10 <> 0),
p AS (SELECT query_id, doc_id, q.label = c.label AS hit, round(list_sum(list_transform(list_zip(q.v, c.v),
    lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 8) AS score FROM q, c),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rn FROM p)"""


def _vectors(v):
    rows = v.table("embeddings")
    return (rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), "label"),
            rows.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label"))


@query("topk_inner_product", f"WITH {_TOP} SELECT query_id, doc_id, score, rn FROM t WHERE rn <= 10")
def topk_inner_product(v):
    queries, docs = _vectors(v)
    return X.topk_inner_product(queries.drop("label"), docs.drop("label"), 10, digits=8)


@query("dense_retrieval_eval", f"""
WITH {_TOP}, r AS (SELECT query_id, coalesce(min(rn) FILTER (hit AND rn <= 10), 11) AS place FROM t GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0 END), 8) AS acc_at_1,
  round(avg(1.0 / place), 8) AS mrr FROM r""")
def dense_retrieval_eval(v):
    """A retrieved vector is right when it carries the query's label.

    Labels are joined onto the k retrieved rows, so gold pairs are never listed.
    """
    queries, docs = _vectors(v)
    top = X.topk_inner_product(queries.drop("label"), docs.drop("label"), 10, digits=8)
    labelled = (top.join(queries.select("query_id", F.col("label").alias("want")), "query_id")
                .join(docs.select("doc_id", "label"), "doc_id"))
    hits = labelled.where("label = want").select("query_id", "doc_id")
    return X.retrieval_scores(top, hits, 10).withColumns({c: F.round(c, 8) for c in ("acc_at_1", "mrr")})


@query("retrieval_sets", """
SELECT g.tweet_id, concat('post ', CAST(g.tweet_id AS VARCHAR)) AS tweet_text, market_id AS gold_market FROM (
  SELECT tweet_id, market_id, row_number() OVER (PARTITION BY tweet_id ORDER BY seq DESC) AS rn
  FROM v_links WHERE gold) g WHERE rn = 1""")
def retrieval_sets(v):
    links = v.links().withColumn("is_gold", F.lit(None).cast("boolean"))
    return X.retrieval_sets(links, "seq")[0]


@query("retrieval_markets", """
SELECT market_id, max(market_question) AS market_question FROM v_links GROUP BY market_id""")
def retrieval_markets(v):
    links = v.links().withColumn("is_gold", F.lit(None).cast("boolean"))
    return X.retrieval_sets(links, "seq")[1]


@query("bm25_topk", """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
t AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d),
f AS (SELECT doc_id, len, term, count(*) AS tf FROM t GROUP BY ALL),
g AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
z AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM d),
s AS (SELECT q.query_id, f.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (1 - 0.75 + 0.75 * f.len / avg_len)) ORDER BY q.term) AS score
  FROM q JOIN f ON q.term = f.term JOIN g ON g.term = q.term, z GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM s) WHERE rn <= 10""")
def bm25_topk(v):
    queries = v.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return X.bm25_topk(queries, v.table("documents").select("doc_id", "text"), 10).withColumn("score", F.round("score", 6))


# --------------------------------------------------------------------------- evaluators

_F1 = """c AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold = label) AS support,
  count(*) FILTER (pred = label) AS predicted FROM j, (VALUES ('F'), ('O'), ('P')) l(label) GROUP BY label),
m AS (SELECT sum(CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0 * tp / (support + predicted) END) / {k} AS f1 FROM c)"""


def _as_task(rows, key):
    return rows.withColumnRenamed("k", key)


@query("eval_t1", f"""
WITH j AS (SELECT gold, pred FROM v_both3), {_F1.format(k=4)}
SELECT count(*) AS n, round((SELECT f1 FROM m), 8) AS macro_f1,
  round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0 END), 8) AS accuracy FROM j""")
def eval_t1(v):
    gold = _as_task(v.gold3(), "condition_id").withColumnRenamed("label", "interest_label")
    out = E.evaluate_interest(_as_task(v.pred3(), "condition_id"), gold, labels=["F", "O", "P", "X"])
    return out.withColumns({c: F.round(c, 8) for c in ("macro_f1", "accuracy")})


_T2 = """g AS (SELECT tweet_id, market_id FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY seq DESC) AS rn
  FROM v_links WHERE gold) WHERE rn = 1),
p AS (SELECT tweet_id, list(DISTINCT market_id ORDER BY market_id)[1:10] AS ranked FROM v_links GROUP BY 1),
j AS (SELECT p.*, g.market_id, coalesce(list_position(ranked, g.market_id), 0) AS place FROM p JOIN g USING (tweet_id))"""


def _ranked_links(v):
    best = top_k(v.links().select("tweet_id", "market_id").distinct(), ["tweet_id"], [F.col("market_id")], 10)
    ranked = F.transform(F.sort_array(F.collect_list("market_id")), lambda m: m.cast("string"))
    return best.groupBy("tweet_id").agg(ranked.alias("ranked_market_ids"))


@query("eval_t2", f"""
WITH {_T2} SELECT count(*) AS n, round(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0 END), 8) AS acc_at_1,
  round(avg(CASE WHEN place > 0 THEN 1.0 / place ELSE 0 END), 8) AS mrr FROM j""")
def eval_t2(v):
    return E.evaluate_linking(_ranked_links(v), v.links(), "seq").withColumns({c: F.round(c, 8) for c in ("acc_at_1", "mrr")})


@query("eval_t3", """
WITH j AS (SELECT final_grade AS g, predicted_grade AS p FROM v_grades),
r AS (SELECT g, p, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0 AS rg,
  rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM j)
SELECT count(*) AS n, round(corr(rg, rp), 8) AS spearman_rho, round(1 - sum((g - p) * (g - p))
  / (sum(g * g) + sum(p * p) - 2.0 * sum(g) * sum(p) / count(*)), 8) AS qwk FROM r""")
def eval_t3(v):
    rows = v.grades().select(F.col("k").alias("tweet_id"), (F.col("k") % 7).alias("condition_id"),
                             "final_grade", "predicted_grade")
    out = E.evaluate_grades(rows.drop("final_grade"), rows.drop("predicted_grade"))
    return out.withColumns({c: F.round(c, 8) for c in ("spearman_rho", "qwk")})


_T4 = """g AS (SELECT tweet_id, g FROM (SELECT l_orderkey AS tweet_id, l_discount - 0.05 AS g,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1),
t AS (SELECT 'all' AS tier, g.g, p.l_tax - 0.04 AS p FROM lineitem p JOIN g ON p.l_orderkey = g.tweet_id)"""


@query("eval_t4", f"""
WITH {_T4},
k AS (SELECT *, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0 AS rg,
  rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp,
  CASE WHEN g > 0.02 THEN 'up' WHEN g < -0.02 THEN 'down' ELSE 'flat' END AS gd,
  CASE WHEN p > 0.02 THEN 'up' WHEN p < -0.02 THEN 'down' ELSE 'flat' END AS pd,
  CASE WHEN abs(g) <= 0.02 THEN 'small' WHEN abs(g) <= 0.08 THEN 'medium' ELSE 'large' END AS gm,
  CASE WHEN abs(p) <= 0.02 THEN 'small' WHEN abs(p) <= 0.08 THEN 'medium' ELSE 'large' END AS pm FROM t),
c AS (SELECT label, count(*) FILTER (gm = label AND pm = label) AS tp, count(*) FILTER (gm = label) AS support,
  count(*) FILTER (pm = label) AS predicted FROM k, (VALUES ('small'), ('medium'), ('large')) l(label) GROUP BY label)
SELECT count(*) AS n, round(avg(CASE WHEN gd = pd THEN 1.0 ELSE 0 END), 8) AS direction_accuracy,
  round((SELECT avg(CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0 * tp / (support + predicted) END) FROM c), 8)
    AS magnitude_macro_f1, round(corr(rg, rp), 8) AS spearman_rho FROM k""")
def eval_t4(v):
    rows = v.table("lineitem")
    gold = rows.select(F.col("l_orderkey").alias("tweet_id"), (F.col("l_discount") - 0.05).alias("delta_2h"),
                       F.col("l_extendedprice").alias("seq"))
    preds = rows.select(F.col("l_orderkey").alias("tweet_id"), (F.col("l_tax") - 0.04).alias("delta_2h"))
    names = ("direction_accuracy", "magnitude_macro_f1", "spearman_rho")
    return E.evaluate_movement(preds, gold, "seq").withColumns({c: F.round(c, 8) for c in names})


def _t5(v):
    """Orders stand for posts: one gold map and one forecast each, some missing."""
    key = F.col("o_orderkey")
    impact = F.when(key % 20 == 0, "bad").otherwise(F.concat(
        F.lit('{"15m":1,"'), F.when(key % 7 == 0, "6h").otherwise("2h"), F.lit('":'),
        (F.col("o_custkey") % 100).cast("string"), F.lit("}")))
    volume = F.when(key % 9 == 0, "{}").otherwise(F.concat(F.lit('{"2h":'), F.col("o_totalprice").cast("string"), F.lit("}")))
    gold = v.table("orders").select(key.alias("tweet_id"), F.col("o_custkey").alias("condition_id"),
                                    impact.alias("price_impact_json"), volume.alias("volume_multiplier_json"))
    preds = v.table("orders").select(
        key.alias("tweet_id"), F.col("o_custkey").alias("condition_id"),
        F.when(key % 3 != 0, F.col("o_totalprice")).alias("price_impact"),
        F.when(key % 4 != 0, (F.col("o_custkey") % 10).cast("double")).alias("volume_multiplier"))
    return preds, gold


_T5_PAIRS = """a AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_custkey % 100 END AS g, o_totalprice AS p FROM orders
  WHERE o_orderkey % 20 <> 0 AND o_orderkey % 3 <> 0),
b AS (SELECT o_totalprice AS g, o_custkey % 10 AS p FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 4 <> 0),
ra AS (SELECT rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0 AS x,
  rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS y FROM a),
rb AS (SELECT rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0 AS x,
  rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS y FROM b)"""


@query("eval_t4_many_markets", """
WITH j AS (SELECT CASE WHEN l_discount - 0.05 > 0.02 THEN 'up' WHEN l_discount - 0.05 < -0.02 THEN 'down' ELSE 'flat' END AS g,
  CASE WHEN l_tax - 0.04 > 0.02 THEN 'up' WHEN l_tax - 0.04 < -0.02 THEN 'down' ELSE 'flat' END AS p FROM lineitem)
SELECT count(*) AS n, round(avg(CASE WHEN g = p THEN 1.0 ELSE 0 END), 8) AS direction_accuracy FROM j""")
def eval_t4_many_markets(v):
    """Posts with several markets: both keys join, no row is multiplied."""
    keys = [F.col("l_orderkey").alias("tweet_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
            .alias("condition_id")]
    rows = v.table("lineitem").withColumn("seq", F.col("l_extendedprice"))
    gold = rows.select(*keys, (F.col("l_discount") - 0.05).alias("delta_2h"))
    preds = rows.select(*keys, (F.col("l_tax") - 0.04).alias("delta_2h"))
    return E.evaluate_movement(preds, gold).select("n", F.round("direction_accuracy", 8).alias("direction_accuracy"))


@query("eval_t5", f"""
WITH {_T5_PAIRS}
SELECT (SELECT count(*) FROM a) AS n_price_impact, (SELECT round(corr(x, y), 8) FROM ra) AS spearman_rho_price_impact,
  (SELECT count(*) FROM b) AS n_volume_multiplier, (SELECT round(corr(x, y), 8) FROM rb) AS spearman_rho_volume_multiplier""")
def eval_t5(v):
    preds, gold = _t5(v)
    names = ("spearman_rho_price_impact", "spearman_rho_volume_multiplier")
    return E.evaluate_impact(preds, gold).withColumns({c: F.round(c, 8) for c in names})


@query("eval_t6", f"""
WITH j AS (SELECT gold, pred FROM v_both3), {_F1.format(k=3)}
SELECT count(*) AS n, round((SELECT f1 FROM m), 8) AS macro_f1 FROM j""")
def eval_t6(v):
    out = E.evaluate_propagation(_as_task(v.pred3(), "tweet_id"), _as_task(v.gold3(), "tweet_id"), labels=["F", "O", "P"])
    return out.withColumn("macro_f1", F.round("macro_f1", 8))


def _t7(v):
    parity = F.when(F.col("k") % 2 == 0, "even").otherwise("odd").alias("condition_id")
    gold = v.gold3().select(F.col("k").alias("tweet_id"), parity, F.col("label").alias("decay_class"))
    return v.pred3().select(F.col("k").alias("tweet_id"), parity, "label"), gold


@query("eval_t7", f"""
WITH j AS (SELECT gold, pred FROM v_both3), {_F1.format(k=3)}
SELECT count(*) AS n, round((SELECT f1 FROM m), 8) AS macro_f1 FROM j""")
def eval_t7(v):
    preds, gold = _t7(v)
    return E.evaluate_decay(preds, gold, labels=["F", "O", "P"]).withColumn("macro_f1", F.round("macro_f1", 8))


@query("eval_all", f"""
WITH {_T5_PAIRS}, j AS (SELECT gold, pred FROM v_both3), {_F1.format(k=3)}, {_T2.replace("j AS", "j2 AS")},
j3 AS (SELECT final_grade AS g, predicted_grade AS p FROM v_grades),
r3 AS (SELECT g, p, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0 AS rg,
  rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM j3),
j4 AS (SELECT delta_2h AS g, pred_delta AS p FROM (SELECT tweet_id, arg_max(delta_2h, n) AS delta_2h, any_value(pred_delta) AS pred_delta
  FROM (SELECT l_orderkey AS tweet_id, l_discount - 0.05 AS delta_2h, l_extendedprice AS n,
    max(l_tax) OVER (PARTITION BY l_orderkey) - 0.04 AS pred_delta FROM lineitem) GROUP BY 1)),
r4 AS (SELECT *, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0 AS rg,
  rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp,
  CASE WHEN g > 0.02 THEN 'up' WHEN g < -0.02 THEN 'down' ELSE 'flat' END AS gd,
  CASE WHEN p > 0.02 THEN 'up' WHEN p < -0.02 THEN 'down' ELSE 'flat' END AS pd,
  CASE WHEN abs(g) <= 0.02 THEN 'small' WHEN abs(g) <= 0.08 THEN 'medium' ELSE 'large' END AS gm,
  CASE WHEN abs(p) <= 0.02 THEN 'small' WHEN abs(p) <= 0.08 THEN 'medium' ELSE 'large' END AS pm FROM j4),
c4 AS (SELECT label, count(*) FILTER (gm = label AND pm = label) AS tp, count(*) FILTER (gm = label) AS support,
  count(*) FILTER (pm = label) AS predicted FROM r4, (VALUES ('small'), ('medium'), ('large')) l(label) GROUP BY label)
SELECT 't1' AS task, 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM j
UNION ALL SELECT 't1', 'macro_f1', round(f1, 8) FROM m
UNION ALL SELECT 't1', 'accuracy', round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0 END), 8) FROM j
UNION ALL SELECT 't2', 'n', count(*) FROM j2
UNION ALL SELECT 't2', 'acc_at_1', round(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0 END), 8) FROM j2
UNION ALL SELECT 't2', 'mrr', round(avg(CASE WHEN place > 0 THEN 1.0 / place ELSE 0 END), 8) FROM j2
UNION ALL SELECT 't3', 'n', count(*) FROM r3
UNION ALL SELECT 't3', 'spearman_rho', round(corr(rg, rp), 8) FROM r3
UNION ALL SELECT 't3', 'qwk', round(1 - sum((g - p) * (g - p)) / (sum(g * g) + sum(p * p) - 2.0 * sum(g) * sum(p) / count(*)), 8) FROM r3
UNION ALL SELECT 't4', 'n', count(*) FROM r4
UNION ALL SELECT 't4', 'direction_accuracy', round(avg(CASE WHEN gd = pd THEN 1.0 ELSE 0 END), 8) FROM r4
UNION ALL SELECT 't4', 'magnitude_macro_f1', round(avg(CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0 * tp / (support + predicted) END), 8) FROM c4
UNION ALL SELECT 't4', 'spearman_rho', round(corr(rg, rp), 8) FROM r4
UNION ALL SELECT 't7', 'n', count(*) FROM j UNION ALL SELECT 't7', 'macro_f1', round(f1, 8) FROM m
UNION ALL SELECT 't6' AS task, 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM j
UNION ALL SELECT 't6', 'macro_f1', round(f1, 8) FROM m
UNION ALL SELECT 't5', 'n_price_impact', count(*) FROM a UNION ALL SELECT 't5', 'n_volume_multiplier', count(*) FROM b
UNION ALL SELECT 't5', 'spearman_rho_price_impact', round(corr(x, y), 8) FROM ra
UNION ALL SELECT 't5', 'spearman_rho_volume_multiplier', round(corr(x, y), 8) FROM rb""")
def eval_all(v):
    """All seven tasks as one table of metrics."""
    items, three = v.table("lineitem"), {"labels": ["F", "O", "P"]}
    gold4 = items.select(F.col("l_orderkey").alias("tweet_id"), (F.col("l_discount") - 0.05).alias("delta_2h"),
                         F.col("l_extendedprice").alias("seq"))
    preds4 = items.groupBy(F.col("l_orderkey").alias("tweet_id")).agg((F.max("l_tax") - 0.04).alias("delta_2h"))
    grades = v.grades().select(F.col("k").alias("tweet_id"), (F.col("k") % 7).alias("condition_id"), "final_grade",
                               "predicted_grade")
    gold1 = _as_task(v.gold3(), "condition_id").withColumnRenamed("label", "interest_label")
    out = E.evaluate_all(
        {"t1": (_as_task(v.pred3(), "condition_id"), gold1), "t2": (_ranked_links(v), v.links()),
         "t3": (grades.drop("final_grade"), grades.drop("predicted_grade")), "t4": (preds4, gold4), "t5": _t5(v),
         "t6": (_as_task(v.pred3(), "tweet_id"), _as_task(v.gold3(), "tweet_id")), "t7": _t7(v)},
        t1=three, t2={"order": "seq"}, t4={"order": "seq"}, t6=three, t7=three)
    return out.withColumn("value", F.round("value", 8))


@query("t5_prior_report", """
WITH t AS (SELECT label, scope FROM v_spread, (VALUES ('all'), ('non_confounded')) s(scope)
  WHERE label <> 'propagated_signal' AND (scope = 'all' OR confound_flag = false)),
c AS (SELECT *, n / sum(n) OVER (PARTITION BY scope) AS share, row_number() OVER (PARTITION BY scope ORDER BY n DESC, label) AS rn
  FROM (SELECT scope, label, count(*) AS n FROM t GROUP BY ALL))
SELECT scope, max(label) FILTER (rn = 1) AS majority_label, CAST(sum(n) AS BIGINT) AS n,
  round(100 * max(share), 6) AS accuracy, round(100 * 2 * max(share) / (1 + max(share)) / count(*), 6) AS macro_f1,
  round(100 * sum(share * share), 6) AS expected_accuracy, round(100 * avg(share), 6) AS expected_macro_f1,
  concat('{', string_agg(concat('"', label, '":', n), ',' ORDER BY label), '}') AS classes FROM c GROUP BY scope""")
def t5_prior_report(v):
    names = ("accuracy", "macro_f1", "expected_accuracy", "expected_macro_f1")
    return P.scope_report(v.spread(), "label", ["no_effect", "primary_mover"]).withColumns(
        {c: F.round(c, 6) for c in names})


@query("t6_prior_report", """
WITH o AS (SELECT tweet_id, CASE label WHEN 'no_effect' THEN 'no_cross_market_effect' ELSE label END AS label FROM v_spread
  WHERE confound_flag = false AND NOT insufficient_data_flag),
p AS (SELECT label, sum(count(*)) OVER (ORDER BY label) / sum(count(*)) OVER () AS upto FROM o GROUP BY 1),
d AS (SELECT s.seed, o.label AS gold, (SELECT min(label) FROM p WHERE upto >
    CAST(concat('0x', substr(md5(concat(s.seed, '|', o.tweet_id)), 1, 8)) AS BIGINT) / 4294967296.0) AS pred
  FROM o, (VALUES (13), (42), (123)) s(seed)),
l AS (SELECT seed, label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold = label) AS support,
  count(*) FILTER (pred = label) AS predicted
  FROM d, (VALUES ('no_cross_market_effect'), ('primary_mover'), ('propagated_signal')) t(label) GROUP BY ALL),
s AS (SELECT seed, avg(2.0 * tp / (support + predicted)) AS f1 FROM l GROUP BY seed),
m AS (SELECT max(n) / sum(n) AS share FROM (SELECT count(*) AS n FROM o GROUP BY label))
SELECT 'majority' AS baseline, (SELECT count(*) FROM o) AS n, round(2 * share / (1 + share) / 3, 8) AS macro_f1 FROM m
UNION ALL SELECT 'random_prior', (SELECT count(*) FROM o), round(avg(f1), 8) FROM s""")
def t6_prior_report(v):
    from tidegauge.operators.rows import normalize_label

    rows = v.spread().withColumn("label", normalize_label(F.col("label")))
    return P.propagation_report(rows, PROPAGATION_LABELS, ["tweet_id"]).withColumn("macro_f1", F.round("macro_f1", 8))
