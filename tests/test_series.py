"""As-of and window statistics against brute force, with ties and hot groups."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import siblings as S
from tidegauge.operators import temporal as T
from tidegauge.plans.movement import impact_rows

START = dt.datetime(2024, 1, 1)
HOUR = 3600 * 1_000_000


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def series(seed, n_ticks, n_posts, hot):
    """Random ticks and posts on a coarse clock, so ties and exact matches are common.

    A third of all rows falls on one market and one instant.
    """
    rng = random.Random(seed)
    clock = lambda: rng.randrange(0, 3 * 86400, 300)
    ticks, posts = [], []
    for i in range(n_ticks):
        m, t = (("m0", 86400) if hot and i % 3 == 0 else (rng.choice(["m0", "m1", "m2"]), clock()))
        ticks.append((m, at(t), round(rng.random(), 3), float(rng.randint(1, 9)), i))
    for i in range(n_posts):
        m, t = (("m0", 86400) if hot and i % 3 == 0 else (rng.choice(["m0", "m1", "m2", "none"]), clock()))
        posts.append((i, m, at(t)))
    return ticks, posts


def frames(spark, ticks, posts):
    return (spark.createDataFrame(ticks, "condition_id string, ts timestamp_ntz, close_price double, volume double, seq int"),
            spark.createDataFrame(posts, "tweet_id int, condition_id string, post_time timestamp_ntz"))


@pytest.mark.parametrize("seed,hot,block", [(1, False, 15), (2, True, 15), (3, True, 60), (4, False, 60)])
def test_series_equals_brute_force(spark, seed, hot, block):
    ticks, posts = series(seed, 400, 120, hot)
    tick_df, post_df = frames(spark, ticks, posts)
    got = T.series_at(
        post_df, tick_df, volume="volume", block_us=block * 60 * 1_000_000,
        asof=[T.AsOf("now", 0), T.AsOf("later", 2 * HOUR)],
        spans=[T.Span("h1", 0, HOUR), T.Span("h6", 0, 6 * HOUR), T.Span("day", -24 * HOUR, 0, left_closed=True)],
    ).withColumn("sd", T.sigma("day")).toPandas().set_index("tweet_id")
    assert len(got) == len(posts)
    all_ticks = pd.DataFrame(ticks, columns=["m", "ts", "p", "v", "seq"])
    for tweet, market, t0 in posts:
        mine = all_ticks[all_ticks.m == market].sort_values(["ts", "seq"])
        row = got.loc[tweet]
        for name, when in (("now", t0), ("later", t0 + dt.timedelta(hours=2))):
            before = mine[mine.ts <= when]
            if before.empty:
                assert pd.isna(row[name])
            else:
                assert row[name] == before.p.iloc[-1]
        for name, lo, hi in (("h1", 0, 1), ("h6", 0, 6), ("day", -24, 0)):
            a, b = t0 + dt.timedelta(hours=lo), t0 + dt.timedelta(hours=hi)
            part = mine[(mine.ts >= a) & (mine.ts < b)] if name == "day" else mine[(mine.ts > a) & (mine.ts <= b)]
            n = 0 if pd.isna(row[f"{name}_n"]) else row[f"{name}_n"]
            assert n == len(part)
            if len(part):
                assert row[f"{name}_lo"] == part.p.min() and row[f"{name}_hi"] == part.p.max()
                assert row[f"{name}_vol"] == pytest.approx(part.v.sum())
                assert row[f"{name}_s1"] == pytest.approx(part.p.sum())
            if name == "day" and len(part) > 1:
                assert row["sd"] == pytest.approx(part.p.std(ddof=1), abs=1e-9)


def test_constant_prices_have_zero_sigma(spark):
    ticks = [("m", at(i * 60), 0.1, 1.0, i) for i in range(100)]
    tick_df, post_df = frames(spark, ticks, [(1, "m", at(6000))])
    row = T.series_at(post_df, tick_df, spans=[T.Span("d", -24 * HOUR, 0, True)]).select(T.sigma("d").alias("s")).first()
    assert row["s"] == 0.0


def test_null_time_and_empty_ticks(spark):
    tick_df, post_df = frames(spark, [], [(1, "m", at(0)), (2, "m", None)])
    rows = T.asof_backward(post_df, tick_df, time="post_time", out="p").collect()
    assert sorted(r.tweet_id for r in rows) == [1, 2] and all(r.p is None for r in rows)


def test_span_must_fit_blocks(spark):
    tick_df, post_df = frames(spark, [], [])
    with pytest.raises(ValueError, match="multiple"):
        T.series_at(post_df, tick_df, spans=[T.Span("x", 0, 7)])


def test_scaled_volume_baseline(spark):
    ticks = [("m", at(i * 600), 0.5, 1.0, i) for i in range(288)]
    tick_df, post_df = frames(spark, ticks, [(1, "m", at(86400))])
    plain = impact_rows(post_df, tick_df, volume="volume").first()["volume_multiplier_1h"]
    scaled = impact_rows(post_df, tick_df, volume="volume", scale_baseline=True).first()["volume_multiplier_1h"]
    assert plain == pytest.approx(6 / 144) and scaled == pytest.approx(1.0)


@pytest.mark.parametrize("n,seed", [(0, 0), (1, 1), (7, 2), (64, 3), (1000, 4)])
def test_first_outside_equals_scan(n, seed, monkeypatch):
    monkeypatch.setattr(S, "_CHUNK", 16)
    rng = np.random.default_rng(seed)
    code, price = np.sort(rng.integers(0, 500, n)), rng.random(n)
    start = rng.integers(-5, 505, 60)
    end = start + rng.integers(0, 300, 60)
    lower = rng.random(60) * 0.2
    upper = 1 - rng.random(60) * 0.2
    got = S.first_outside(code, price, start, end, lower, upper)
    for i in range(60):
        hits = [j for j in range(n) if start[i] < code[j] <= end[i] and not lower[i] <= price[j] <= upper[i]]
        assert got[i] == (hits[0] if hits else -1)


@pytest.mark.parametrize("seed,hot", [(11, False), (12, True)])
def test_propagation_equals_brute_force(spark, seed, hot):
    ticks, posts = series(seed, 600, 80, hot)
    tick_df, post_df = frames(spark, ticks, posts)
    groups = {"m0": "g1", "m1": "g1", "m2": "g1", "lonely": "g2"}
    group_df = spark.createDataFrame(list(groups.items()), "condition_id string, event_group_id string")
    got = S.propagation(post_df, tick_df, group_df).toPandas().set_index("tweet_id")
    counts = S.sibling_moves(post_df, tick_df, group_df).toPandas().set_index("tweet_id")
    frame = pd.DataFrame(ticks, columns=["m", "ts", "p", "v", "seq"]).sort_values(["ts", "seq"])

    def onset(market, t0):
        mine = frame[frame.m == market]
        before, day = mine[mine.ts <= t0], mine[(mine.ts < t0) & (mine.ts >= t0 - dt.timedelta(hours=24))]
        if before.empty or len(day) < 2:
            return None
        band = 1.5 * day.p.std(ddof=1)
        after = mine[(mine.ts > t0) & (mine.ts <= t0 + dt.timedelta(hours=2))]
        out = after[(after.p - before.p.iloc[-1]).abs() > band]
        return None if out.empty else out.ts.iloc[0]

    for tweet, market, t0 in posts:
        own = onset(market, t0)
        others = [onset(m, t0) for m in groups if m != market and groups.get(market) == groups[m]]
        moved = [o for o in others if o is not None]
        first = min(moved) if moved else None
        want = ("no_cross_market_effect" if first is None else
                "primary_mover" if own is not None and own <= first else "propagated_signal")
        assert got.loc[tweet, "label"] == want
        assert counts.loc[tweet, "moved_sibling_count"] == len(moved)
        assert counts.loc[tweet, "sibling_count"] == len(others)


def test_crossing_task_joins_batches(spark):
    """Groups that straddle Arrow batches are searched whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        ticks, posts = series(21, 120, 30, True)
        tick_df, post_df = frames(spark, ticks, posts)
        anchors = post_df.select(F.col("condition_id").alias("key"), F.unix_micros(F.col("post_time").cast("timestamp")).alias("t0"),
                                 F.lit(0.3).alias("lower"), F.lit(0.7).alias("upper")).distinct()
        got = {(r.key, r.t0): r.onset_us for r in S.first_crossings(anchors, tick_df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    micro = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    for _, market, t0 in posts:
        hits = [micro(t) for m, t, p, _, _ in ticks
                if m == market and t0 < t <= t0 + dt.timedelta(hours=2) and not 0.3 <= p <= 0.7]
        assert got.get((market, micro(t0))) == (min(hits) if hits else None)


def test_market_in_two_groups_and_nan_ticks(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 2)
    posts = spark.createDataFrame([(1, "a", t0)], "tweet_id int, condition_id string, post_time timestamp_ntz")
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("a", "h"), ("c", "h")], "condition_id string, event_group_id string")
    flat = [(m, t0 + dt.timedelta(minutes=i), 0.5, i) for m in "abc" for i in range(-60, 60)]
    ticks = spark.createDataFrame([*flat, ("b", t0 + dt.timedelta(minutes=5), float("nan"), 999)],
                                  "condition_id string, ts timestamp_ntz, close_price double, seq int")
    rows = S.sibling_moves(posts, ticks, groups).collect()
    assert sorted((r.event_group_id, r.sibling_count, r.moved_sibling_count) for r in rows) == [("g", 1, 0), ("h", 1, 0)]
