"""Queries: as-of joins, window statistics, movement labels and propagation."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T_

from tidegauge.catalog.registry import query
from tidegauge.functions import labels as L
from tidegauge.operators import siblings as G
from tidegauge.operators import temporal as T
from tidegauge.operators.metrics import regression_error
from tidegauge.plans import movement as M
from tidegauge.operators.joins import post_times, yes_ticks
from tidegauge.schemas import HOUR_US, MINUTE_US, POST_SCHEMA, TICK_SCHEMA
from tidegauge.sources.tables import read_jsonl, write_jsonl

DAY_US = 24 * HOUR_US


def _asof(alias: str, time: str) -> str:
    return f"ASOF LEFT JOIN v_ticks {alias} ON p.condition_id = {alias}.condition_id AND {time} >= {alias}.ts"


@query("asof_backward", f"""
SELECT p.tweet_id, p.condition_id, a.close_price AS price_pre_30m
FROM v_posts p {_asof('a', "p.post_time - INTERVAL 30 MINUTE")}""")
def asof_backward(v):
    return T.asof_backward(v.posts(), v.ticks(), time="post_time", out="price_pre_30m",
                           offset_us=-30 * MINUTE_US).select("tweet_id", "condition_id", "price_pre_30m")


@query("pre30_delta", f"""
SELECT p.tweet_id, round(z.close_price - a.close_price, 8) AS pre_delta
FROM v_posts p {_asof('a', "p.post_time - INTERVAL 30 MINUTE")} {_asof('z', 'p.post_time')}
WHERE a.close_price IS NOT NULL""")
def pre30_delta(v):
    rows = T.series_at(v.posts(), v.ticks(), asof=[T.AsOf("p0", 0), T.AsOf("pre", -30 * MINUTE_US)],
                       block_us=DAY_US).where("pre IS NOT NULL")
    return rows.select("tweet_id", F.round(F.col("p0") - F.col("pre"), 8).alias("pre_delta"))


_DELTAS = f"""SELECT p.tweet_id, z.close_price AS price_t0, a.close_price - z.close_price AS delta_30m,
  b.close_price - z.close_price AS delta_2h, c.close_price - z.close_price AS delta_6h
FROM v_posts p {_asof('z', 'p.post_time')} {_asof('a', "p.post_time + INTERVAL 30 MINUTE")}
{_asof('b', "p.post_time + INTERVAL 2 HOUR")} {_asof('c', "p.post_time + INTERVAL 6 HOUR")}"""


@query("horizon_deltas", f"""
SELECT tweet_id, price_t0, round(delta_30m, 8) AS delta_30m, round(delta_2h, 8) AS delta_2h,
  round(delta_6h, 8) AS delta_6h FROM ({_DELTAS})""")
def horizon_deltas(v):
    rows = M.horizon_deltas(v.posts(), v.ticks())
    return rows.select("tweet_id", "price_t0", *[F.round(f"delta_{h}", 8).alias(f"delta_{h}")
                                                 for h in ("30m", "2h", "6h")])


_IN = """(SELECT {f} FROM v_ticks t WHERE t.condition_id = p.condition_id AND t.ts {a} AND t.ts {b})"""


def _after(f: str, minutes: int) -> str:
    return _IN.format(f=f, a="> p.post_time", b=f"<= p.post_time + INTERVAL {minutes} MINUTE")


def _before(f: str) -> str:
    return _IN.format(f=f, a=">= p.post_time - INTERVAL 24 HOUR", b="< p.post_time")


@query("interval_ticks", f"""
SELECT p.tweet_id, {_after('count(*)', 120)} AS n_after, {_before('count(*)')} AS n_before,
  {_after('min(close_price)', 120)} AS lo_after, {_after('max(close_price)', 120)} AS hi_after,
  round({_before('sum(volume)')}, 6) AS vol_before FROM v_posts p""")
def interval_ticks(v):
    """Statistics of the ticks in an interval around each post, without pairing them."""
    rows = T.series_at(v.posts(), v.ticks(), volume="volume",
                       spans=[T.Span("after", 0, 2 * HOUR_US), T.Span("before", -DAY_US, 0, left_closed=True)])
    zero = F.lit(0).cast("bigint")
    return rows.select("tweet_id", F.coalesce("after_n", zero).alias("n_after"),
                       F.coalesce("before_n", zero).alias("n_before"), F.col("after_lo").alias("lo_after"),
                       F.col("after_hi").alias("hi_after"), F.round("before_vol", 6).alias("vol_before"))


@query("rolling_sigma", f"""
SELECT p.tweet_id, round({_before('stddev_samp(close_price)')}, 6) AS sigma FROM v_posts p""")
def rolling_sigma(v):
    rows = T.series_at(v.posts(), v.ticks(), spans=[T.Span("day", -DAY_US, 0, left_closed=True)],
                       block_us=HOUR_US)
    return rows.select("tweet_id", F.round(T.sigma("day"), 6).alias("sigma"))


_MINUTES = {"15m": 15, "30m": 30, "1h": 60, "2h": 120, "6h": 360}


@query("price_impact", f"""
SELECT p.tweet_id, {', '.join(f"round({_after('max(abs(t.close_price - z.close_price))', m)}, 8) AS price_impact_{h}"
                              for h, m in _MINUTES.items())}
FROM v_posts p {_asof('z', 'p.post_time')}""")
def price_impact(v):
    rows = M.impact_rows(v.posts(), v.ticks(), volume="volume")
    return rows.select("tweet_id", *[F.round(f"price_impact_{h}", 8).alias(f"price_impact_{h}") for h in _MINUTES])


@query("volume_multiplier", f"""
SELECT p.tweet_id, {', '.join(f"round({_after('sum(volume)', m)} / {_before('sum(volume)')}, 6) AS volume_multiplier_{h}"
                              for h, m in _MINUTES.items())} FROM v_posts p""")
def volume_multiplier(v):
    rows = M.impact_rows(v.posts(), v.ticks(), volume="volume")
    return rows.select("tweet_id", *[F.round(f"volume_multiplier_{h}", 6).alias(f"volume_multiplier_{h}")
                                     for h in _MINUTES])


@query("decay_class", f"""
WITH d AS (SELECT p.tweet_id, a.close_price - z.close_price AS d15, b.close_price - z.close_price AS d2
  FROM v_posts p {_asof('z', 'p.post_time')} {_asof('a', "p.post_time + INTERVAL 15 MINUTE")}
  {_asof('b', "p.post_time + INTERVAL 2 HOUR")})
SELECT tweet_id, CASE WHEN abs(d2) < 0.3 * abs(d15) THEN 'transient'
  WHEN d15 * d2 > 0 AND abs(d2) > abs(d15) THEN 'sustained' WHEN d15 * d2 < 0 THEN 'reversal' END AS decay_class FROM d""")
def decay_class(v):
    points = [T.AsOf("p0", 0), T.AsOf("p15m", 15 * MINUTE_US), T.AsOf("p2h", 2 * HOUR_US)]
    rows = T.series_at(v.posts(), v.ticks(), asof=points, block_us=DAY_US)
    label = L.decay_class(F.col("p15m") - F.col("p0"), F.col("p2h") - F.col("p0"))
    return rows.select("tweet_id", label.alias("decay_class"))


# --------------------------------------------------------------------------- propagation


@query("sibling_counts", """
SELECT condition_id, event_group_id, count(*) OVER (PARTITION BY event_group_id) - 1 AS sibling_count FROM v_groups""")
def sibling_counts(v):
    return G.sibling_counts(v.groups())


_STATES = f"""p AS (SELECT p.tweet_id, p.condition_id AS primary_id, p.post_time, g.event_group_id
  FROM v_posts p JOIN v_groups g ON p.condition_id = g.condition_id),
m AS (SELECT p.tweet_id, p.primary_id, p.post_time, g.condition_id FROM p
  JOIN v_groups g ON p.event_group_id = g.event_group_id),
b AS (SELECT p.*, z.close_price AS p0 FROM m p {_asof('z', 'p.post_time')}),
s AS (SELECT p.*, 1.5 * {_before('CASE WHEN min(close_price) = max(close_price) AND count(*) > 1 THEN 0 ELSE stddev_samp(close_price) END')} AS band FROM b p),
x AS (SELECT p.*, (SELECT min(epoch_us(t.ts)) FROM v_ticks t WHERE t.condition_id = p.condition_id
    AND t.ts > p.post_time AND t.ts <= p.post_time + INTERVAL 2 HOUR
    AND abs(t.close_price - p.p0) > p.band) AS onset FROM s p),
r AS (SELECT tweet_id, primary_id, count(*) - 1 AS sibling_count,
  count(onset) FILTER (condition_id <> primary_id) AS moved_sibling_count,
  min(onset) FILTER (condition_id = primary_id) AS primary_onset,
  min(onset) FILTER (condition_id <> primary_id) AS sibling_onset FROM x GROUP BY ALL)"""


@query("sibling_moves", f"WITH {_STATES} SELECT tweet_id, sibling_count, moved_sibling_count FROM r")
def sibling_moves(v):
    return G.sibling_moves(v.posts(), v.ticks(), v.groups()).select(
        "tweet_id", "sibling_count", "moved_sibling_count")


@query("propagation_label", f"""
WITH {_STATES}
SELECT tweet_id, CASE WHEN sibling_onset IS NULL THEN 'no_cross_market_effect'
  WHEN primary_onset <= sibling_onset THEN 'primary_mover' ELSE 'propagated_signal' END AS label,
  round((sibling_onset - primary_onset) / 60000000.0, 6) AS onset_lag_minutes FROM r""")
def propagation_label(v):
    return G.propagation(v.posts(), v.ticks(), v.groups()).select(
        "tweet_id", "label", F.round("onset_lag_minutes", 6).alias("onset_lag_minutes"))


@query("onset_mae", f"""
WITH {_STATES}
SELECT count(*) AS n, round(avg(abs((sibling_onset - primary_onset) / 60000000.0 - 10)), 6) AS mae,
  round(sqrt(avg(((sibling_onset - primary_onset) / 60000000.0 - 10) ** 2)), 6) AS rmse
FROM r WHERE sibling_onset IS NOT NULL AND primary_onset IS NOT NULL""")
def onset_mae(v):
    """Error in minutes of a constant ten-minute lag forecast."""
    rows = G.propagation(v.posts(), v.ticks(), v.groups()).withColumn("guess", F.lit(10.0))
    return regression_error(rows, "onset_lag_minutes", "guess").withColumns(
        {c: F.round(c, 6) for c in ("mae", "rmse")})


# --------------------------------------------------------------------------- movement reports

_MOMENTUM = f"""m AS (SELECT p.tweet_id, p.confound_flag, z.close_price - w.close_price AS pre_delta,
    a.close_price - z.close_price AS delta_30m, b.close_price - z.close_price AS delta_2h,
    c.close_price - z.close_price AS delta_6h
  FROM v_posts p {_asof('w', "p.post_time - INTERVAL 30 MINUTE")} {_asof('z', 'p.post_time')}
  {_asof('a', "p.post_time + INTERVAL 30 MINUTE")} {_asof('b', "p.post_time + INTERVAL 2 HOUR")}
  {_asof('c', "p.post_time + INTERVAL 6 HOUR")}
  WHERE w.close_price IS NOT NULL AND z.close_price IS NOT NULL),
d AS (SELECT *, CASE WHEN delta_2h > 0.02 THEN 'up' WHEN delta_2h < -0.02 THEN 'down' ELSE 'flat' END AS dir,
  CASE WHEN pre_delta > 0 THEN 'up' WHEN pre_delta < 0 THEN 'down' ELSE 'flat' END AS pdir,
  CASE WHEN abs(delta_2h) <= 0.02 THEN 'small' WHEN abs(delta_2h) <= 0.08 THEN 'medium' ELSE 'large' END AS mag,
  CASE WHEN abs(pre_delta) <= 0.02 THEN 'small' WHEN abs(pre_delta) <= 0.08 THEN 'medium' ELSE 'large' END AS pmag
  FROM m)"""

_REPORT = """u AS (SELECT 'direction' AS target, confound_flag, dir AS gold, pdir AS pred FROM d
  UNION ALL SELECT 'magnitude', confound_flag, mag, pmag FROM d),
t AS (SELECT u.*, tier FROM u, (VALUES ('tier1_all'), ('tier2_non_confounded'), ('tier3_active')) x(tier)
  WHERE tier = 'tier1_all' OR (confound_flag = false
    AND (tier = 'tier2_non_confounded' OR gold NOT IN ('flat', 'small')))),
c AS (SELECT tier, target, label, count(*) FILTER (gold = label AND pred = label) AS tp,
  count(*) FILTER (gold = label) AS support, count(*) FILTER (pred = label) AS predicted
  FROM t, (VALUES ('up', 'direction'), ('down', 'direction'), ('flat', 'direction'), ('small', 'magnitude'),
    ('medium', 'magnitude'), ('large', 'magnitude')) l(label, kind)
  WHERE kind = target AND NOT (tier = 'tier3_active' AND label = 'small') GROUP BY ALL),
f AS (SELECT tier, target, avg(CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0 * tp / (support + predicted) END) AS f1
  FROM c GROUP BY ALL)
SELECT t.tier, t.target, count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0 END), 8) AS accuracy,
  round(max(f1), 8) AS macro_f1 FROM t JOIN f ON t.tier = f.tier AND t.target = f.target GROUP BY t.tier, t.target"""


@query("t4_momentum_report", f"WITH {_MOMENTUM}, {_REPORT}")
def t4_momentum_report(v):
    """The flagship: 30-minute momentum against the direction and size of the next two hours."""
    report = M.momentum_report(M.momentum_rows(v.posts(), v.ticks()))
    return report.withColumns({c: F.round(c, 8) for c in ("accuracy", "macro_f1")})


@query("momentum_from_raw", "WITH " + f"{_MOMENTUM}, {_REPORT}".replace("v_ticks", "v_rawticks").replace("v_posts", "v_rawposts"))
def momentum_from_raw(v):
    """The flagship from raw files: scan, yes side, post times, as-of prices, report."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    ticks, posts, root = v.ticks(), v.posts(), v.scratch()
    raw = ticks.select("condition_id", F.lit(" Yes").alias("side"), ms("ts").alias("timestamp"),
                       F.col("close_price").alias("close"), "volume", "seq")
    other = raw.withColumns({"side": F.lit("no"), "close": 1 - F.col("close")})
    write_jsonl(raw.unionByName(other), f"{root}/ticks")
    write_jsonl(posts.select("tweet_id", F.timestamp_millis(ms("post_time")).cast("string").alias("created_at"),
                             F.lit("text").alias("text")), f"{root}/posts")
    schema = T_.StructType([*TICK_SCHEMA.fields, T_.StructField("seq", T_.LongType())])
    labels = posts.select("tweet_id", "condition_id", "confound_flag")
    times = post_times(read_jsonl(v.spark, f"{root}/posts", POST_SCHEMA), labels, "created_at")
    report = M.momentum_report(M.momentum_rows(labels.join(times, "tweet_id"),
                                               yes_ticks(read_jsonl(v.spark, f"{root}/ticks", schema))))
    return report.withColumns({c: F.round(c, 8) for c in ("accuracy", "macro_f1")})


_RANKED = """t AS (SELECT {cols}, tier FROM {src}, (VALUES ('tier1_all'), ('tier2_non_confounded'), ('tier3_active')) x(tier)
  WHERE tier = 'tier1_all' OR (confound_flag = false AND (tier = 'tier2_non_confounded' OR abs(g) > 0.02))),
k AS (SELECT *, rank() OVER (PARTITION BY tier ORDER BY g) + (count(*) OVER (PARTITION BY tier, g) - 1) / 2.0 AS rg,
  rank() OVER (PARTITION BY tier ORDER BY p) + (count(*) OVER (PARTITION BY tier, p) - 1) / 2.0 AS rp,
  CASE WHEN g > 0.02 THEN 'up' WHEN g < -0.02 THEN 'down' ELSE 'flat' END AS gd,
  CASE WHEN p > 0.02 THEN 'up' WHEN p < -0.02 THEN 'down' ELSE 'flat' END AS pd,
  CASE WHEN abs(g) <= 0.02 THEN 'small' WHEN abs(g) <= 0.08 THEN 'medium' ELSE 'large' END AS gm,
  CASE WHEN abs(p) <= 0.02 THEN 'small' WHEN abs(p) <= 0.08 THEN 'medium' ELSE 'large' END AS pm FROM t),
c AS (SELECT tier, label, count(*) FILTER (gm = label AND pm = label) AS tp, count(*) FILTER (gm = label) AS support,
  count(*) FILTER (pm = label) AS predicted FROM k, (VALUES ('small'), ('medium'), ('large')) l(label) GROUP BY ALL),
f AS (SELECT tier, avg(CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0 * tp / (support + predicted) END) AS f1
  FROM c GROUP BY tier)
SELECT k.tier, count(*) AS n, round(avg(CASE WHEN gd = pd THEN 1.0 ELSE 0 END), 8) AS direction_accuracy,
  round(max(f1), 8) AS magnitude_macro_f1, round(corr(rg, rp), 8) AS spearman
FROM k JOIN f ON k.tier = f.tier GROUP BY k.tier"""


@query("t4_tier_report", "WITH " + _RANKED.format(cols="confound_flag, delta_2h AS g, pred_delta AS p",
                                                  src="v_moves"))
def t4_tier_report(v):
    names = ("direction_accuracy", "magnitude_macro_f1", "spearman")
    return M.tier_report(v.moves()).withColumns({c: F.round(c, 8) for c in names})


@query("t4_tier_report_flat", """
WITH a AS (SELECT confound_flag, delta_2h AS m, unnest([{'g': delta_30m, 'p': pred_30m}, {'g': delta_2h, 'p': pred_delta},
  {'g': delta_6h, 'p': pred_6h}]) AS x FROM v_moves),
t AS (SELECT tier, x.g AS g, x.p AS p FROM a, (VALUES ('tier1_all'), ('tier2_non_confounded'), ('tier3_active')) y(tier)
  WHERE tier = 'tier1_all' OR (confound_flag = false AND (tier = 'tier2_non_confounded' OR abs(m) > 0.02))),
k AS (SELECT tier, rank() OVER (PARTITION BY tier ORDER BY g) + (count(*) OVER (PARTITION BY tier, g) - 1) / 2.0 AS rg,
  rank() OVER (PARTITION BY tier ORDER BY p) + (count(*) OVER (PARTITION BY tier, p) - 1) / 2.0 AS rp FROM t)
SELECT tier, CAST(count(*) // 3 AS BIGINT) AS n, round(corr(rg, rp), 8) AS spearman_all FROM k GROUP BY tier""")
def t4_tier_report_flat(v):
    """Spearman over the forecasts of three horizons together."""
    report = M.tier_report(v.moves(), horizons={"delta_30m": "pred_30m", "delta_2h": "pred_delta", "delta_6h": "pred_6h"})
    return report.select("tier", "n", F.round("spearman_all", 8).alias("spearman_all"))


@query("t4_prior_report", """
WITH t AS (SELECT m.*, tier FROM v_moves m, (VALUES ('tier1_all'), ('tier2_non_confounded'), ('tier3_active')) x(tier)
  WHERE tier = 'tier1_all' OR (confound_flag = false
    AND (tier = 'tier2_non_confounded' OR direction_label <> 'flat'))),
u AS (SELECT tier, 'direction' AS target, direction_label AS label FROM t
  UNION ALL SELECT tier, 'magnitude', magnitude_bucket FROM t),
c AS (SELECT *, row_number() OVER (PARTITION BY tier, target ORDER BY n DESC, label) AS rn,
  n / sum(n) OVER (PARTITION BY tier, target) AS share FROM (
    SELECT tier, target, label, count(*) AS n FROM u GROUP BY ALL))
SELECT tier, target, max(label) FILTER (rn = 1) AS majority_label, CAST(sum(n) AS BIGINT) AS n,
  round(max(share), 8) AS accuracy, round(2 * max(share) / (1 + max(share))
    / CASE WHEN tier = 'tier3_active' AND target = 'direction' THEN 2 ELSE 3 END, 8) AS macro_f1,
  round(sum(share * share), 8) AS expected_accuracy, round(avg(share), 8) AS expected_macro_f1
FROM c GROUP BY tier, target""")
def t4_prior_report(v):
    names = ("accuracy", "macro_f1", "expected_accuracy", "expected_macro_f1")
    return M.prior_report(v.moves()).withColumns({c: F.round(c, 8) for c in names})
