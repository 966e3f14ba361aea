"""As-of prices and window statistics around posts.

A post asks for prices and statistics of one market's ticks around an instant
``t0``. Joining posts with ticks by range would pair every post with every tick
in its window. Here the time axis is cut into blocks instead, and a window is
put together from at most three parts:

* the ticks of the first block after the window's start (a running aggregate
  from the block's end),
* whole blocks in between (one row per market and block),
* the ticks of the last block up to the window's end (a running aggregate from
  the block's start).

No pair of post and tick is ever made, so the work grows with posts + ticks.

Skew: ticks are first reduced to one row per (market, instant) and posts to
distinct (market, t0), both combined before the shuffle. A (market, block) task
then holds at most one tick row per clock instant of the block, however many
rows a hot market or a hot minute has. The per-market table has one row per
block, so its size follows the calendar time covered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions.text import micros
from tidegauge.schemas import MINUTE_US

# Place of a probe among ticks of the same instant.
_BEFORE, _TICK, _AFTER = 0, 1, 2
_SUMS = ("n", "s1", "s2", "vol")
_STATS = (*_SUMS, "lo", "hi")


@dataclass(frozen=True)
class AsOf:
    """Last price at or before ``t0 + offset_us``."""

    name: str
    offset_us: int


@dataclass(frozen=True)
class Span:
    """Statistics of the ticks in a window relative to ``t0``.

    ``(start, end]`` or, with ``left_closed``, ``[start, end)``. Yields
    ``<name>_n, _s1, _s2, _vol, _lo, _hi``: tick count, price sum, sum of
    squared prices, volume sum, lowest and highest price.
    """

    name: str
    start_us: int
    end_us: int
    left_closed: bool = False

    @property
    def place(self) -> int:
        return _BEFORE if self.left_closed else _AFTER


def _merge(kind: str, column: Column) -> Column:
    return F.min(column) if kind == "lo" else F.max(column) if kind == "hi" else F.sum(column)


def instant_ticks(ticks: DataFrame, key: str, time: str, price: str, order: str,
                  volume: str | None, block_us: int) -> DataFrame:
    """One row per (market, instant); at equal time the last tick by ``order`` counts."""
    us, p = F.col("__us"), F.col(price)
    vol = F.col(volume).cast("double") if volume else F.lit(None).cast("double")
    rows = ticks.where(p.isNotNull() & ~F.isnan(p.cast("double")) & F.col(time).isNotNull()).select(
        F.col(key).alias("__key"), micros(F.col(time)).alias("__us"),
        p.cast("double").alias(price), F.col(order).alias("__order"), vol.alias("__volume"))
    return (rows.groupBy("__key", "__us")
            .agg(F.max_by(price, "__order").alias("last"), F.count(p).alias("n"),
                 F.sum(p).alias("s1"), F.sum(p * p).alias("s2"),
                 F.sum("__volume").alias("vol"), F.min(p).alias("lo"), F.max(p).alias("hi"))
            .withColumn("__block", F.floor(us / block_us)))


def series_at(anchors: DataFrame, ticks: DataFrame, *, key: str = "condition_id",
              anchor_time: str = "post_time", tick_time: str = "ts",
              price: str = "close_price", order: str = "seq", volume: str | None = None,
              asof: Sequence[AsOf] = (), spans: Sequence[Span] = (),
              block_us: int = 15 * MINUTE_US) -> DataFrame:
    """Attach as-of prices and window statistics to every anchor row.

    Span lengths must be whole multiples of ``block_us``. Anchors without a
    time or without ticks keep null values.
    """
    for span in spans:
        if (span.end_us - span.start_us) % block_us or span.end_us <= span.start_us:
            raise ValueError(f"span {span.name}: length is no multiple of the block")

    instants = instant_ticks(ticks, key, tick_time, price, order, volume, block_us)
    posts = (anchors.where(F.col(anchor_time).isNotNull())
             .select(F.col(key).alias("__key"), micros(F.col(anchor_time)).alias("__t0"))
             .distinct())
    wanted = sorted({(a.offset_us, _AFTER) for a in asof}
                    | {(o, s.place) for s in spans for o in (s.start_us, s.end_us)})
    offsets = F.array(*[F.struct(F.lit(o).cast("bigint").alias("__off"),
                                 F.lit(p).alias("__place")) for o, p in wanted])
    probes = (posts.select("__key", "__t0", F.inline(offsets))
              .withColumn("__us", F.col("__t0") + F.col("__off"))
              .withColumn("__block", F.floor(F.col("__us") / block_us)))

    timeline = instants.withColumn("__place", F.lit(_TICK)).unionByName(
        probes, allowMissingColumns=True)
    part = Window.partitionBy("__key", "__block")
    running = Window.unboundedPreceding, Window.currentRow
    up = part.orderBy("__us", "__place").rowsBetween(*running)
    down = part.orderBy(F.desc("__us"), F.desc("__place")).rowsBetween(*running)
    made = {"p_last": F.last("last", ignorenulls=True).over(up)}
    if spans:
        made |= {f"p_{c}": _merge(c, F.col(c)).over(up) for c in _STATS}
        made |= {f"s_{c}": _merge(c, F.col(c)).over(down) for c in _STATS}
    seen = timeline.withColumns(made).where(F.col("__place") != _TICK)
    seen = seen.select("__key", "__block", "__t0", "__off", "__place", *made)

    # One row per market and block that holds ticks or probes.
    blocks = (instants.groupBy("__key", "__block")
              .agg(F.max_by("last", "__us").alias("last"),
                   *[_merge(c, F.col(c)).alias(c) for c in _STATS])
              .unionByName(probes.select("__key", "__block").distinct(), allowMissingColumns=True)
              .groupBy("__key", "__block")
              .agg(F.max("last").alias("last"), *[F.max(c).alias(c) for c in _STATS]))
    market = Window.partitionBy("__key").orderBy("__block")
    earlier = market.rowsBetween(Window.unboundedPreceding, -1)
    carried = {"b_last": F.last("last", ignorenulls=True).over(earlier)}
    lengths = sorted({(s.end_us - s.start_us) // block_us for s in spans} - {1})
    for k in lengths:
        inner = market.rangeBetween(1, k - 1)
        carried |= {f"m{k}_{c}": _merge(c, F.col(c)).over(inner) for c in _STATS}
    blocks = blocks.withColumns(carried).select("__key", "__block", *carried)

    parts = seen.join(blocks, ["__key", "__block"])
    out = []
    for a in asof:
        here = (F.col("__off") == a.offset_us) & (F.col("__place") == _AFTER)
        out.append(F.max(F.when(here, F.coalesce("p_last", "b_last"))).alias(a.name))
    for s in spans:
        at_start = (F.col("__off") == s.start_us) & (F.col("__place") == s.place)
        at_end = (F.col("__off") == s.end_us) & (F.col("__place") == s.place)
        k = (s.end_us - s.start_us) // block_us
        for c in _STATS:
            combine = {"lo": F.least, "hi": F.greatest}.get(c)
            first = F.col(f"s_{c}")
            if k > 1 and combine:
                first = combine(first, F.col(f"m{k}_{c}"))
            elif k > 1:
                first = F.when(first.isNotNull() | F.col(f"m{k}_{c}").isNotNull(),
                               F.coalesce(first, F.lit(0)) + F.coalesce(f"m{k}_{c}", F.lit(0)))
            value = F.when(at_start, first).when(at_end, F.col(f"p_{c}"))
            out.append(_merge(c, value).alias(f"{s.name}_{c}"))
    result = parts.groupBy("__key", "__t0").agg(*out)
    result = result.withColumnsRenamed({"__key": key})
    return (anchors.withColumn("__t0", micros(F.col(anchor_time)))
            .join(result, [key, "__t0"], "left").drop("__t0"))


def asof_backward(left: DataFrame, ticks: DataFrame, *, time: str, out: str,
                  offset_us: int = 0, block_us: int = 24 * 60 * MINUTE_US, **names) -> DataFrame:
    """Last tick at or before ``time + offset``; exact match counts, none is null."""
    return series_at(left, ticks, anchor_time=time, asof=[AsOf(out, offset_us)],
                     block_us=block_us, **names)


def sigma(span: str) -> Column:
    """Sample standard deviation of the prices in a span; exactly 0 if all are equal."""
    n, s1, s2 = (F.col(f"{span}_{c}") for c in ("n", "s1", "s2"))
    variance = F.try_divide(s2 - F.try_divide(s1 * s1, n), n - 1)
    flat = F.col(f"{span}_lo") == F.col(f"{span}_hi")
    return F.when(n < 2, None).when(flat, 0.0).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0))))


def farthest_move(span: str, base: Column) -> Column:
    """Largest absolute deviation from ``base`` among the prices in a span."""
    return F.greatest(F.col(f"{span}_hi") - base, base - F.col(f"{span}_lo"))

