"""Scores over aligned gold / prediction rows.

Class metrics start from one confusion aggregate (map-side combined); rank
correlation starts from the counts of distinct (x, y) pairs. Each function
returns one row per scope.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.operators.ranking import centred_ranks, cumulative_counts, not_null, small_ranks, valid_number
from tidegauge.sources.tables import materialize


def class_distribution(df: DataFrame, label: str, scope: Sequence[str] = (),
                       weight: str | None = None) -> DataFrame:
    """Rows and share of each class; with ``weight`` a row stands for that many."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*scope, label).agg(size.alias("n"))
    total = F.sum("n").over(Window.partitionBy(*scope))
    return counts.withColumn("share", F.col("n") / total)


def confusion_matrix(df: DataFrame, gold: str, pred: str, scope: Sequence[str] = ()) -> DataFrame:
    """Counts of (gold, pred), the base of all class metrics."""
    return (df.groupBy(*scope, F.col(gold).alias("gold"), F.col(pred).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_scores(confusion: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per class: support, predicted, tp, precision, recall, f1."""
    hit = F.when(F.col("gold").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("gold").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))
    sums = (confusion.select(*scope, F.inline(sides))
            .where("label IS NOT NULL")
            .groupBy(*scope, "label")
            .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                 F.sum("tp").alias("tp")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return (sums
            .withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
            .withColumn("recall", ratio(F.col("tp"), F.col("support")))
            .withColumn("f1", ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))))


def _macro(labels: Sequence | None) -> Column:
    """Mean class F1: over given labels (absent class = 0) or the seen ones."""
    if labels is None:
        return F.coalesce(F.avg("f1"), F.lit(0.0))
    inside = F.sum(F.when(F.col("label").isin(list(labels)), F.col("f1")))
    return F.coalesce(inside, F.lit(0.0)) / F.lit(float(len(labels)))


def macro_f1(confusion: DataFrame, labels: Sequence | None = None,
             scope: Sequence[str] = ()) -> DataFrame:
    return class_scores(confusion, scope).groupBy(*scope).agg(_macro(labels).alias("macro_f1"))


def weighted_f1(confusion: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    weighted = F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support"))
    return class_scores(confusion, scope).groupBy(*scope).agg(
        F.coalesce(weighted, F.lit(0.0)).alias("weighted_f1"))


def class_report(confusion: DataFrame, labels: Sequence | None = None,
                 scope: Sequence[str] = ()) -> DataFrame:
    """``n, accuracy, macro_f1, weighted_f1`` per scope in one pass."""
    n = F.coalesce(F.sum("support"), F.lit(0))
    return class_scores(confusion, scope).groupBy(*scope).agg(
        n.alias("n"),
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        _macro(labels).alias("macro_f1"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")),
                   F.lit(0.0)).alias("weighted_f1"))


def accuracy(confusion: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Share of exact matches; 0.0 for no rows."""
    hits = F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0))
    return confusion.groupBy(*scope).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.try_divide(hits, F.sum("n")), F.lit(0.0)).alias("accuracy"))


def quadratic_kappa(confusion: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Quadratic weighted kappa from the moments of the two marginals.

    The expected disagreement over all grade pairs is
    ``n*sum(g^2) + n*sum(p^2) - 2*sum(g)*sum(p)`` over ``n``, so the grades
    are never paired. No rows give 0.0, no expected disagreement 1.0.
    """
    g, p, n = F.col("gold").cast("double"), F.col("pred").cast("double"), F.col("n")
    sums = confusion.groupBy(*scope).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(n * (g - p) * (g - p)).alias("__seen"),
        F.sum(n * g * g).alias("__gg"), F.sum(n * p * p).alias("__pp"),
        F.sum(n * g).alias("__g"), F.sum(n * p).alias("__p"))
    expected = (F.col("__gg") + F.col("__pp")
                - 2 * F.try_divide(F.col("__g") * F.col("__p"), F.col("n")))
    kappa = F.lit(1.0) - F.try_divide(F.col("__seen"), expected)
    return sums.select(*scope, "n", F.when(F.col("n") == 0, F.lit(0.0))
                       .otherwise(F.coalesce(kappa, F.lit(1.0))).alias("qwk"))


def class_precision(confusion: DataFrame, label, scope: Sequence[str] = ()) -> DataFrame:
    """Precision of one class, e.g. the ``resolving`` grade."""
    chosen = F.when(F.col("pred") == F.lit(label), F.col("n")).otherwise(0)
    hits = F.sum(F.when(F.col("gold") == F.col("pred"), chosen).otherwise(0))
    return confusion.groupBy(*scope).agg(
        F.coalesce(F.sum(chosen), F.lit(0)).alias("predicted"),
        F.coalesce(F.try_divide(hits, F.sum(chosen)), F.lit(0.0)).alias("class_precision"))


def class_f1(confusion: DataFrame, label, scope: Sequence[str] = ()) -> DataFrame:
    """F1 of one class, e.g. ``none`` among top-1 predictions; 0.0 where it never occurs."""
    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    gold, pred = F.col("gold") == F.lit(label), F.col("pred") == F.lit(label)
    sums = confusion.groupBy(*scope).agg(total(gold).alias("support"), total(pred).alias("predicted"),
                                         total(gold & pred).alias("tp"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return sums.select(*scope, F.lit(label).alias("label"), "support", "predicted", "tp", f1.alias("f1"))


def pearson(df: DataFrame, x: str, y: str, scope: Sequence[str] = (),
            degenerate: float | None = None) -> DataFrame:
    """Pearson correlation; without variance the value is ``degenerate``."""
    rows = df.where(valid_number(df, x, y))
    ratio = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    value = ratio if degenerate is None else F.coalesce(ratio, F.lit(degenerate))
    return rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), value.alias("pearson"))


def spearman(df: DataFrame, x: str, y: str, scope: Sequence[str] = (),
             degenerate: float | None = None, out: str = "spearman",
             weight: str | None = None, cut: bool = False) -> DataFrame:
    """Spearman rank correlation with average ranks for ties.

    With ``weight`` a row stands for that many equal pairs. The pair counts are
    read three times; with ``cut`` they are written to the shared folder first,
    which pays when the rows are costly to derive.

    Rows are reduced to counts of distinct pairs first; ranks come from the
    bucketed histogram and are centred on the known mean rank, so large ranks
    do not cancel.
    """
    scope = list(scope)
    keys = [*[not_null(df, s) for s in scope], not_null(df, x).alias("__x"), not_null(df, y).alias("__y")]
    pairs = (df.where(valid_number(df, x, y, scope=scope))
             .select(*keys, *([] if weight is None else [weight]))
             .groupBy(*scope, "__x", "__y")
             .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__w")))
    if cut:
        pairs = materialize(pairs)
        pairs = pairs.select(*[not_null(pairs, c) for c in pairs.columns])

    def centred(side: str) -> DataFrame:
        counts = cumulative_counts(pairs, side, scope, weight="__w", checked=True)
        return counts.select(*scope, side, ((F.col("n_below") + F.col("n_upto") - F.col("n_total"))
                                            / 2).alias(side + "r"))

    ranked = pairs.join(centred("__x"), [*scope, "__x"])
    ranked = ranked.join(centred("__y"), [*scope, "__y"])
    w, rx, ry = F.col("__w"), F.col("__xr"), F.col("__yr")
    spread = F.sqrt(F.sum(w * rx * rx)) * F.sqrt(F.sum(w * ry * ry))
    ratio = F.try_divide(F.sum(w * rx * ry), spread)
    value = ratio if degenerate is None else F.coalesce(ratio, F.lit(degenerate))
    return ranked.groupBy(*scope).agg(F.coalesce(F.sum("__w"), F.lit(0)).alias("n"),
                                      value.alias(out))


def spearman_of_sums(df: DataFrame, x: str, y: str, scope: Sequence[str]) -> DataFrame:
    """As ``spearman``, for a ``y`` with few distinct values, such as the predictions of trees.

    ``y`` is ranked from its counts. ``x`` then needs the sums of these ranks by its distinct values, which tasks
    add up before they are shuffled; pairs are never formed. Both small tables are written.
    """
    scope = list(scope)
    rows = df.where(valid_number(df, x, y, scope=scope)).select(*[not_null(df, c) for c in (*scope, x, y)])
    centred = (F.col("n_below") + F.col("n_upto") - F.col("n_total")) / 2
    of_y = materialize(cumulative_counts(rows, y, scope, checked=True).select(*scope, y, "n", centred.alias("__yr")))
    sums = materialize(rows.join(of_y.select(*scope, y, "__yr"), [*scope, y]).groupBy(*scope, x).agg(
        F.count(F.lit(1)).alias("__w"), F.sum("__yr").alias("__s")))
    of_x = cumulative_counts(sums, x, scope, weight="__w").select(*scope, x, "n", centred.alias("__xr"))
    both = of_x.join(sums.select(*scope, x, "__s"), [*scope, x]).groupBy(*scope).agg(
        F.sum(F.col("__xr") * F.col("__s")).alias("__xy"), F.sum(F.col("n") * F.col("__xr") * F.col("__xr")).alias("__xx"))
    alone = of_y.groupBy(*scope).agg(F.sum(F.col("n") * F.col("__yr") * F.col("__yr")).alias("__yy"))
    spread = F.sqrt("__xx") * F.sqrt("__yy")
    return both.join(alone, scope).select(*scope, F.try_divide(F.col("__xy"), spread).alias("spearman"))


def _correlation(ranked: DataFrame, scope: Sequence[str], weight: str, x: str, y: str) -> list[Column]:
    w, rx, ry = F.col(weight), F.col(x), F.col(y)
    spread = F.sqrt(F.sum(w * rx * rx)) * F.sqrt(F.sum(w * ry * ry))
    return [F.coalesce(F.sum(w), F.lit(0)).alias("n"), F.try_divide(F.sum(w * rx * ry), spread).alias("rho")]


def small_spearman(pairs: DataFrame, x: str, y: str, weight: str, scope: Sequence[str] = (),
                   degenerate: float | None = None, out: str = "spearman") -> DataFrame:
    """Spearman from counts over a declared small domain, such as grades; nulls are left out."""
    scope = list(scope)
    pairs = pairs.where(valid_number(pairs, x, y, scope=scope))
    ranked = (pairs.join(small_ranks(pairs, x, weight, scope).withColumnRenamed(f"r_{weight}", "__rx"), [*scope, x])
              .join(small_ranks(pairs, y, weight, scope).withColumnRenamed(f"r_{weight}", "__ry"), [*scope, y]))
    rho = F.col("rho") if degenerate is None else F.coalesce("rho", F.lit(degenerate))
    return ranked.groupBy(*scope).agg(*_correlation(ranked, scope, weight, "__rx", "__ry")).select(
        *scope, "n", rho.alias(out))


def weighted_spearman(pairs: DataFrame, x: str, y: str, weights: Mapping[str, str], scope: Sequence[str] = (),
                      out: str = "tier") -> DataFrame:
    """Spearman under several weights at once: a row per scope and weight, named in ``out``.

    ``weights`` maps a name to the column that says how many equal pairs a row
    stands for, so overlapping groups of rows share one rank pass.
    """
    scope, columns = list(scope), list(weights.values())
    ranked = pairs
    for side, mark in ((x, "x"), (y, "y")):
        ranks = centred_ranks(pairs, side, columns, scope).withColumnsRenamed({f"r_{c}": f"__{mark}_{c}" for c in columns})
        ranked = ranked.join(ranks, [*scope, side])
    aggs = []
    for name, c in weights.items():
        n, rho = _correlation(ranked, scope, c, f"__x_{c}", f"__y_{c}")
        aggs += [n.alias(f"__n_{c}"), rho.alias(f"__rho_{c}")]
    each = F.inline(F.array(*[F.struct(F.lit(name).alias(out), F.col(f"__n_{c}").alias("n"), F.col(f"__rho_{c}").alias("spearman"))
                              for name, c in weights.items()]))
    return ranked.groupBy(*scope).agg(*aggs).select(*scope, each).where("n > 0")


def accuracy_at_1(df: DataFrame, ranked: str, gold: str, scope: Sequence[str] = ()) -> DataFrame:
    hit = F.when(F.get(F.col(ranked), F.lit(0)) == F.col(gold), 1.0).otherwise(0.0)
    return df.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"),
                                  F.coalesce(F.avg(hit), F.lit(0.0)).alias("acc_at_1"))


def reciprocal_rank(ranked: Column, gold: Column, miss: str = "zero", k: int | None = None) -> Column:
    """1 / place of the gold ID; a miss scores 0 or counts as place ``k + 1``."""
    place = F.coalesce(F.array_position(ranked, gold), F.lit(0))
    missed = F.lit(0.0) if miss == "zero" else F.lit(1.0 / (k + 1))
    return F.when(place > 0, F.lit(1.0) / place).otherwise(missed)


def mean_reciprocal_rank(df: DataFrame, ranked: str, gold: str, miss: str = "zero",
                         k: int | None = None, scope: Sequence[str] = ()) -> DataFrame:
    score = reciprocal_rank(F.col(ranked), F.col(gold), miss, k)
    return df.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"),
                                  F.coalesce(F.avg(score), F.lit(0.0)).alias("mrr"))


def regression_error(df: DataFrame, gold: str, pred: str, by: str | None = None) -> DataFrame:
    """MAE and RMSE, with one extra ``all`` row over every group; a null group keeps its null."""
    error = F.col(gold) - F.col(pred)
    aggs = [F.count(error).alias("n"), F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse")]
    if by is None:
        return df.agg(*aggs)
    totals = df.rollup(by).agg(F.grouping(by).alias("__all"), *aggs)
    return totals.withColumn(by, F.when(F.col("__all") == 1, "all").otherwise(F.col(by).cast("string"))).drop("__all")


def precision_at_k(df: DataFrame, score: str, is_positive: Column, key: str, k: int = 10) -> DataFrame:
    """Share of positives among the ``k`` best scored rows."""
    best = (df.select(F.col(score), F.col(key), is_positive.cast("double").alias("__hit"))
            .orderBy(F.desc(score), key).limit(k))
    return best.agg(F.count(F.lit(1)).alias("k"), F.avg("__hit").alias("precision_at_k"))
