"""Cross-market propagation: which markets of an event group moved, and when first.

A market *moved* after ``t0`` if its price left the band ``p0 +- 1.5 sigma``
within two hours, with sigma the stdev of its prices in the 24 hours before.
Each (market, instant) is judged once, however many posts share the instant;
posts then read one summary row per (group, instant). Post and sibling rows are
never paired.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions.text import micros
from tidegauge.operators.temporal import AsOf, Span, farthest_move, series_at, sigma
from tidegauge.schemas import HOUR_US, MINUTE_US
from tidegauge.sources.tables import materialize

# The move rule.
SIGMA_FACTOR = 1.5
MOVE_WINDOW_US = 2 * HOUR_US
SIGMA_WINDOW_US = 24 * HOUR_US

_CHUNK = 1 << 16
_SALTED_INSTANTS = 50_000


def sibling_counts(groups: DataFrame, key: str = "condition_id", group: str = "event_group_id") -> DataFrame:
    """Siblings of each market: the other markets in its event group.

    Only the count is kept. Listing the pairs would square a hot group, and the
    label tables carry counts alone.
    """
    members = groups.select(key, group).distinct()
    sizes = members.groupBy(group).agg((F.count(F.lit(1)) - 1).alias("sibling_count"))
    return members.join(sizes, group).select(key, group, "sibling_count")


def first_outside(code: np.ndarray, price: np.ndarray, start: np.ndarray, end: np.ndarray,
                  lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """For each probe the place of the first tick in (start, end] outside its band, or -1.

    ``code`` are the sorted tick instants. Ticks are read in chunks. In a chunk,
    tables of range maxima and minima over power-of-two lengths let all probes
    skip forward together, so a probe costs a few steps and never visits every
    tick.
    """
    pos, stop = np.searchsorted(code, start, "right"), np.searchsorted(code, end, "right")
    found = np.full(len(start), -1, dtype=np.int64)
    for base in range(0, len(code), _CHUNK):
        top = min(base + _CHUNK, len(code))
        live = np.flatnonzero((found < 0) & (pos >= base) & (pos < np.minimum(stop, top)))
        if not len(live):
            continue
        highs, lows = [price[base:top]], [price[base:top]]
        while 2 << (len(highs) - 1) <= top - base:
            half = 1 << (len(highs) - 1)
            highs.append(np.maximum(highs[-1][:-half], highs[-1][half:]))
            lows.append(np.minimum(lows[-1][:-half], lows[-1][half:]))
        at, limit = pos[live] - base, np.minimum(stop[live], top) - base
        for level in range(len(highs) - 1, -1, -1):
            room = at + (1 << level) <= limit
            probe = np.where(room, at, 0)
            quiet = room & (highs[level][probe] <= upper[live]) & (lows[level][probe] >= lower[live])
            at = at + np.where(quiet, 1 << level, 0)
        hit = at < limit
        found[live[hit]] = base + at[hit]
        pos[live[~hit]] = base + at[~hit]
    return found


def _search_groups(rows: pd.DataFrame, group: np.ndarray, block_us: int) -> pd.DataFrame:
    """Search all (market, block) groups of a batch at once.

    An instant becomes ``group * width + place in block``, so one sorted array
    holds the ticks of every group.
    """
    width = block_us + 2
    start_of_block = rows["block"].to_numpy() * block_us
    is_tick = rows["price"].notna().to_numpy()

    def code(us: pd.Series, mask: np.ndarray) -> np.ndarray:
        inside = np.clip(us.to_numpy()[mask].astype(np.int64) - start_of_block[mask], -1, block_us - 1)
        return group[mask] * width + inside + 1

    ticks, probes = rows[is_tick], rows[~is_tick]
    tick_us = ticks["us"].to_numpy()
    place = first_outside(code(rows["us"], is_tick), ticks["price"].to_numpy(),
                          code(rows["us"], ~is_tick), code(rows["end_us"], ~is_tick),
                          probes["lower"].to_numpy(), probes["upper"].to_numpy())
    hit = place >= 0
    return pd.DataFrame({"key": probes["key"].to_numpy()[hit], "t0": probes["us"].to_numpy()[hit],
                         "onset_us": tick_us[place[hit]]})


def _crossing_task(block_us: int):
    """Task function over sorted rows: whole groups are searched, the open one is held back."""

    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            if held:
                last = held[-1].iloc[-1]
                same = (batch["key"].iloc[-1] == last["key"]) and (batch["block"].iloc[-1] == last["block"])
                if same:
                    held.append(batch)
                    continue
            rows = pd.concat([*held, batch], ignore_index=True)
            new = (rows["key"] != rows["key"].shift()) | (rows["block"] != rows["block"].shift())
            group = new.cumsum().to_numpy(dtype=np.int64)
            complete = group < group[-1]
            if complete.any():
                yield _search_groups(rows[complete], group[complete], block_us)
            held = [rows[~complete]]
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield _search_groups(rows, np.ones(len(rows), dtype=np.int64), block_us)

    return run


def first_crossings(anchors: DataFrame, ticks: DataFrame, window_us: int = MOVE_WINDOW_US,
                    block_us: int = HOUR_US, price: str = "close_price") -> DataFrame:
    """First tick outside the band of each anchor ``(key, t0, lower, upper)``.

    An anchor is sent to the few blocks its window touches; the earliest block
    with a hit decides. Rows are hashed and sorted by market and block, and a
    task streams over them in Arrow batches. It holds one batch and one open
    group: at most two tick rows per clock instant of a block.
    """
    last_block = F.floor((F.col("t0") + window_us) / block_us)
    probes = (anchors.withColumn("block", F.explode(F.sequence(F.floor(F.col("t0") / block_us), last_block)))
              .select("key", "block", F.col("t0").alias("us"), (F.col("t0") + window_us).alias("end_us"),
                      "lower", "upper"))
    # Several ticks of one instant: the lowest and the highest price both count.
    us = micros(F.col("ts"))
    instants = (ticks.where(F.col(price).isNotNull() & ~F.isnan(F.col(price).cast("double")))
                .groupBy(F.col("condition_id").alias("key"), us.alias("us"))
                .agg(F.min(price).alias("lo"), F.max(price).alias("hi"))
                .select("key", F.floor(F.col("us") / block_us).alias("block"), "us",
                        F.explode(F.array_distinct(F.array("lo", "hi"))).alias("price")))
    both = instants.unionByName(probes, allowMissingColumns=True)
    placed = both.repartition("key", "block").sortWithinPartitions("key", "block", "us")
    hits = placed.mapInPandas(_crossing_task(block_us), "key string, t0 bigint, onset_us bigint")
    return hits.groupBy("key", "t0").agg(F.min("onset_us").alias("onset_us"))


def market_states(instants: DataFrame, members: DataFrame, ticks: DataFrame) -> DataFrame:
    """Per (group, market, instant): base price, sigma and whether the market moved.

    A group gets a salt per ``_SALTED_INSTANTS`` of its instants, and its few
    members are repeated over them, so a hot group is spread over as many tasks
    as it needs and a small one is not repeated.
    """
    salts = instants.groupBy("event_group_id").agg(
        F.ceil(F.count(F.lit(1)) / _SALTED_INSTANTS).cast("int").alias("salts"))
    salted = members.join(salts, "event_group_id").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    spread = instants.join(salts, "event_group_id")
    anchors = (spread.withColumn("salt", F.pmod(F.xxhash64("post_time"), F.col("salts")).cast("int")).drop("salts")
               .join(salted, ["event_group_id", "salt"]).drop("salt"))
    state = series_at(anchors, ticks, anchor_time="post_time", asof=[AsOf("p0", 0)],
                      spans=[Span("after", 0, MOVE_WINDOW_US),
                             Span("before", -SIGMA_WINDOW_US, 0, left_closed=True)])
    band = F.lit(SIGMA_FACTOR) * sigma("before")
    moved = F.coalesce(farthest_move("after", F.col("p0")) > band, F.lit(False))
    return state.select("event_group_id", "condition_id", "post_time", "p0",
                        band.alias("band"), moved.alias("moved"))


def _grouped_posts(posts: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    members = groups.select("condition_id", "event_group_id").distinct()
    tagged = posts.join(members, "condition_id", "left")
    instants = tagged.where("event_group_id IS NOT NULL").select("event_group_id", "post_time").distinct()
    return tagged, instants, members


def sibling_moves(posts: DataFrame, ticks: DataFrame, groups: DataFrame) -> DataFrame:
    """Attach ``sibling_count`` and ``moved_sibling_count`` to posts.

    The group total is counted once per instant; the post's own market is then
    taken out of it.
    """
    tagged, instants, members = _grouped_posts(posts, groups)
    states = market_states(instants, members, ticks)
    totals = states.groupBy("event_group_id", "post_time").agg(
        F.count(F.lit(1)).alias("__markets"), F.count_if("moved").alias("__moved"))
    own = states.select("event_group_id", "condition_id", "post_time", F.col("moved").alias("__own"))
    joined = tagged.join(totals, ["event_group_id", "post_time"], "left").join(
        own, ["event_group_id", "condition_id", "post_time"], "left")
    count = F.coalesce(F.col("__markets") - 1, F.lit(0)).cast("bigint")
    moved = F.coalesce(F.col("__moved") - F.col("__own").cast("bigint"), F.lit(0))
    return joined.withColumns({"sibling_count": count, "moved_sibling_count": moved}).drop(
        "__markets", "__moved", "__own")


def propagation_label(primary: Column, sibling: Column) -> Column:
    """Class from the first-move instants: who moved first decides."""
    return (F.when(sibling.isNull(), "no_cross_market_effect")
            .when(primary.isNotNull() & (primary <= sibling), "primary_mover")
            .otherwise("propagated_signal"))


def propagation(posts: DataFrame, ticks: DataFrame, groups: DataFrame) -> DataFrame:
    """Attach first-move instants, propagation class and onset lag in minutes."""
    tagged, instants, members = _grouped_posts(posts, groups)
    states = market_states(instants, members, ticks)
    movers = states.where("moved").select(
        F.col("condition_id").alias("key"), micros(F.col("post_time")).alias("t0"),
        (F.col("p0") - F.col("band")).alias("lower"), (F.col("p0") + F.col("band")).alias("upper"))
    # Read twice below, so the search is written once and not run again.
    onsets = materialize(first_crossings(movers, ticks).select(
        F.col("key").alias("condition_id"), "t0", "onset_us"))
    grouped = onsets.join(members, "condition_id")
    # The two earliest movers of a group are enough to leave any one market out.
    early = Window.partitionBy("event_group_id", "t0").orderBy("onset_us", "condition_id")
    firsts = (grouped.withColumn("rn", F.row_number().over(early)).where("rn <= 2")
              .groupBy("event_group_id", "t0")
              .agg(F.max(F.when(F.col("rn") == 1, F.col("condition_id"))).alias("__first"),
                   F.max(F.when(F.col("rn") == 1, F.col("onset_us"))).alias("__us1"),
                   F.max(F.when(F.col("rn") == 2, F.col("onset_us"))).alias("__us2")))
    own = onsets.withColumnRenamed("onset_us", "primary_onset_us")
    joined = (tagged.withColumn("t0", micros(F.col("post_time")))
              .join(firsts, ["event_group_id", "t0"], "left").join(own, ["condition_id", "t0"], "left"))
    sibling = F.when(F.col("__first") == F.col("condition_id"), F.col("__us2")).otherwise(F.col("__us1"))
    joined = joined.withColumn("sibling_onset_us", sibling)
    primary, sibling = F.col("primary_onset_us"), F.col("sibling_onset_us")
    return joined.withColumns({
        "label": propagation_label(primary, sibling),
        "onset_lag_minutes": (sibling - primary) / F.lit(float(MINUTE_US)),
    }).drop("t0", "__first", "__us1", "__us2")
