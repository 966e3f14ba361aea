"""Ranks, quantiles, top-k and first/last per key.

The base is a histogram of values with cumulative counts. Equal values are
counted before the shuffle, so a value that holds a third of all rows is one
histogram row, and the distinct values are spread over quantile buckets, so no
task orders a whole column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T


def valid_number(df: DataFrame, *names: str, scope: Sequence[str] = ()) -> Column:
    """True where every named column is neither null nor NaN and no scope is null."""
    checks = [F.col(s).isNotNull() for s in scope]
    for name in names:
        col = F.col(name)
        checks.append(col.isNotNull())
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            checks.append(~F.isnan(col))
    return reduce(lambda a, b: a & b, checks)


def not_null(df: DataFrame, name: str) -> Column:
    """The column declared free of nulls; use it only after a null filter.

    Joins and aggregates over it then add no null checks of their own, so that
    several uses of one aggregate have equal plans and Spark computes it once.
    """
    kind = df.schema[name].dataType
    fill = ("" if isinstance(kind, T.StringType) else False if isinstance(kind, T.BooleanType)
            else 0 if isinstance(kind, T.NumericType) else None)
    return F.col(name) if fill is None else F.coalesce(F.col(name), F.lit(fill).cast(kind)).alias(name)


def _bucket(value: Column, cuts: Column, buckets: int) -> Column:
    """Number of cuts below the value: a binary search with halving steps.

    The result is never null, so joins on it push no null check below the
    histogram.
    """
    steps = [1 << i for i in range((buckets - 1).bit_length() - 1, -1, -1)]
    place = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: at + F.when(F.get(cuts, at + step - 1) < value, step).otherwise(0))
    return F.coalesce(place, F.lit(0))


def _bucket_count(df: DataFrame) -> int:
    """As many buckets as shuffle tasks."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cumulative_counts(df: DataFrame, value: str, scope: Sequence[str] = (),
                      weight: str | None = None, buckets: int | None = None,
                      checked: bool = False) -> DataFrame:
    """Distinct values per scope with cumulative counts.

    Returns ``scope..., value, n, n_below, n_upto, n_total``. Null and NaN
    values are left out, and so are null scopes. The bucket bounds come from a one-row approximate
    percentile; they only decide which task orders which values, so the counts
    are exact. ``checked`` input has no null or NaN.
    """
    scope = list(scope)
    buckets = buckets or _bucket_count(df)
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    clean = df if checked else df.where(valid_number(df, value, scope=scope))
    keys = [not_null(df, c) for c in (*scope, value)]
    hist = (clean.select(*keys, *([] if weight is None else [weight]))
            .groupBy(*scope, value).agg(count.alias("n")))
    cuts = [i / buckets for i in range(1, buckets)]
    # Reading n as well keeps this histogram equal to the one below, so that
    # Spark computes the shared part once.
    counted = F.when(F.col("n") > 0, F.col(value))
    bounds = hist.select(F.percentile_approx(counted, cuts, max(2000, 4 * buckets))).scalar()
    hist = (hist.withColumn("__cuts", bounds)
            .withColumn("__b", _bucket(F.col(value), F.col("__cuts"), buckets)).drop("__cuts"))

    totals = hist.groupBy(*scope, "__b").agg(F.sum("n").alias("__m"))
    earlier = (Window.partitionBy(*scope).orderBy("__b")
               .rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(
        *scope, "__b",
        F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__m").over(Window.partitionBy(*scope)).alias("n_total"))

    inside = (Window.partitionBy(*scope, "__b").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, 0))
    local = hist.withColumn("__upto", F.sum("n").over(inside))
    joined = local.join(totals, [*scope, "__b"])
    upto = F.col("__before") + F.col("__upto")
    return joined.select(*scope, value, "n", (upto - F.col("n")).alias("n_below"),
                         upto.alias("n_upto"), "n_total")


def centred_ranks(pairs: DataFrame, value: str, weights: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Average ranks around their mean under several weights at once.

    Returns ``scope..., value`` and ``r_<weight>`` for each weight column: half the
    difference of the weight below and above the value. ``pairs`` has no null or
    NaN. One sort serves all weights, in buckets as in ``cumulative_counts``.
    """
    scope = list(scope)
    buckets = _bucket_count(pairs)
    hist = pairs.groupBy(*scope, value).agg(*[F.sum(w).alias(w) for w in weights])
    first = F.when(F.col(weights[0]) >= 0, F.col(value))  # reads a weight, so that both uses share one plan
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = hist.select(F.percentile_approx(first, cuts, max(2000, 4 * buckets))).scalar()
    hist = (hist.withColumn("__cuts", bounds)
            .withColumn("__b", _bucket(F.col(value), F.col("__cuts"), buckets)).drop("__cuts"))
    earlier = Window.partitionBy(*scope).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*scope)
    totals = hist.groupBy(*scope, "__b").agg(*[F.sum(w).alias(f"__s_{w}") for w in weights])
    totals = totals.select(*scope, "__b", *[
        (2 * F.coalesce(F.sum(f"__s_{w}").over(earlier), F.lit(0)) - F.sum(f"__s_{w}").over(whole)).alias(f"__t_{w}")
        for w in weights])
    inside = Window.partitionBy(*scope, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = hist.withColumns({f"__u_{w}": 2 * F.sum(w).over(inside) - F.col(w) for w in weights})
    return local.join(totals, [*scope, "__b"]).select(
        *scope, value, *[((F.col(f"__t_{w}") + F.col(f"__u_{w}")) / 2).alias(f"r_{w}") for w in weights])


def small_ranks(pairs: DataFrame, value: str, weight: str, scope: Sequence[str] = ()) -> DataFrame:
    """As ``centred_ranks`` for a declared domain of a few values: one window over its counts."""
    hist = pairs.groupBy(*scope, value).agg(F.sum(weight).alias("__w"))
    upto = Window.partitionBy(*scope).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rank = 2 * F.sum("__w").over(upto) - F.col("__w") - F.sum("__w").over(Window.partitionBy(*scope))
    return hist.select(*scope, value, (rank / 2).alias(f"r_{weight}"))


def average_rank(df: DataFrame, value: str, scope: Sequence[str] = (),
                 out: str = "rank") -> DataFrame:
    """Attach the 1-based rank of ``value`` in its scope; ties share the mean."""
    ranks = cumulative_counts(df, value, scope).select(
        *scope, value, (F.col("n_below") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, [*scope, value], "left")


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float],
                    scope: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per name in ``probs``.

    Unlike the built-in exact percentile, no task holds all values.
    """
    counts = cumulative_counts(df, value, scope)
    aggs = []
    for name, p in probs.items():
        position = F.lit(p) * (F.col("n_total") - 1)
        for part, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            aggs.append(F.min(F.when(F.col("n_upto") > index, F.col(value)))
                        .alias(f"__{name}_{part}"))
    found = counts.groupBy(*scope).agg(F.max("n_total").alias("__n"), *aggs)
    out = []
    for name, p in probs.items():
        position = F.lit(p) * (F.col("__n") - 1)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return found.select(*scope, *out)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
          out: str = "rn") -> DataFrame:
    """First ``k`` rows per group.

    Spark keeps at most ``k`` rows per group on the map side (window group
    limit) before it shuffles, so a hot group does not reach one task whole.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_k(df, keys, order, 1, "__rn").drop("__rn")


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the last in the order of one column."""
    return first_per_key(df, keys, [F.col(order).desc()])


def gold_rank(ranked: Column, gold: Column, k: int) -> Column:
    """1-based place of the gold ID in the ranked list, ``k + 1`` if absent."""
    place = F.array_position(ranked, gold)
    return F.when(place > 0, place).otherwise(F.lit(k + 1)).cast("bigint")


def distinct_sorted(df: DataFrame, *names: str) -> DataFrame:
    """Sorted distinct labels seen in any of the named columns."""
    labels = reduce(DataFrame.unionByName, [df.select(F.col(n).alias("label")) for n in names])
    return labels.where("label IS NOT NULL").distinct().orderBy("label")


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
