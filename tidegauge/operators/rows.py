"""Row-level operators: contracts, filters, coercion, imputation and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from tidegauge.functions.labels import lookup
from tidegauge.functions.text import normalized_id, try_double
from tidegauge.operators.ranking import exact_quantiles
from tidegauge.schemas import IMPACT_HORIZONS, LABEL_ALIASES
from tidegauge.sources.tables import materialize


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def with_declared_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add absent optional columns as nulls so that operators see one schema."""
    absent = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(absent) if absent else df


def validate_table(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Rows breaking each rule as ``(rule, violations)``.

    A rule is a condition that marks a bad row. With ``keys``, the rule
    ``duplicate_key`` counts the rows beyond the first of each key.
    """
    names = list(rules)
    counted = df.agg(*[F.count_if(rules[n]).alias(n) for n in names])
    report = counted.unpivot([], names, "rule", "violations")
    if keys:
        spare = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
                 .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")))
        report = report.unionByName(spare.select(F.lit("duplicate_key").alias("rule"), "violations"))
    return report


def non_confounded(df: DataFrame, flag: str = "confound_flag", null_as: bool | None = None) -> DataFrame:
    """Keep rows whose flag is false; a null flag is dropped unless ``null_as`` is False."""
    return df.where(is_unconfounded(flag, null_as))


def is_unconfounded(flag: str = "confound_flag", null_as: bool | None = None) -> Column:
    value = F.col(flag) if null_as is None else F.coalesce(F.col(flag), F.lit(null_as))
    return F.coalesce(~value, F.lit(False))


def valid_labels(df: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    return df.where(F.col(label).isin(list(labels)))


def sufficient_data(df: DataFrame, flag: str | None = "insufficient_data_flag",
                    label: str | None = None, drop_label: str = "insufficient_data", null_as: bool = False) -> DataFrame:
    """Drop rows flagged as short of data, and optionally that label; a null flag counts as ``null_as``."""
    if flag and flag in df.columns:
        df = df.where(~F.coalesce(F.col(flag), F.lit(null_as)))
    return df if label is None else df.where(F.col(label) != drop_label)


def active_rows(df: DataFrame, flag: str = "confound_flag", direction: str = "direction_label") -> DataFrame:
    """Unconfounded rows that moved; a null direction is kept."""
    return df.where(is_unconfounded(flag) & ~F.col(direction).eqNullSafe("flat"))


def expand_tiers(df: DataFrame, tiers: Mapping[str, Column], out: str = "tier") -> DataFrame:
    """Repeat each row once per tier it belongs to, in a single scan."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in tiers.items()]))
    return df.withColumn(out, F.explode(names))


def movement_tiers(flag: str = "confound_flag", label: str = "direction_label",
                   quiet: str = "flat") -> dict[str, Column]:
    """The three overlapping tiers of the movement task."""
    clean = is_unconfounded(flag)
    return {"tier1_all": F.lit(True), "tier2_non_confounded": clean,
            "tier3_active": clean & ~F.col(label).eqNullSafe(quiet)}


def coerce_numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: try_double(F.col(n)) for n in names})


def complete_cases(df: DataFrame, names: Sequence[str], scope: Sequence[str] = (),
                   min_rows: int = 0) -> DataFrame:
    """Rows with no null in the named columns; scopes below ``min_rows`` are left out."""
    kept = df.dropna(how="any", subset=list(names))
    if not min_rows:
        return kept
    if not scope:
        enough = kept.agg((F.count(F.lit(1)) >= min_rows).alias("ok")).scalar()
        return kept.where(enough)
    big = kept.groupBy(*scope).count().where(F.col("count") >= min_rows).select(*scope)
    return kept.join(big, list(scope), "left_semi")


def feature_profile(df: DataFrame, listed: Sequence[str] = (), blocked: Sequence[str] = ()) -> DataFrame:
    """Candidate features and their fill: ``feature, n, n_distinct, mean, sd``.

    Features are the listed ones that exist, else every numeric column that is
    not blocked. Distinct counts come from one histogram over all features.
    """
    names = [c for c in listed if c in df.columns] or [
        f.name for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in set(blocked)]
    long = df.select(*[F.col(c).cast("double") for c in names]).unpivot([], names, "feature", "value")
    hist = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("w"))
    w, v = F.col("w"), F.col("value")
    filled = F.when(v.isNotNull(), w)
    n = F.coalesce(F.sum(filled), F.lit(0))
    moments = df.agg(*[a for c in names for a in (F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
                                                   F.stddev_samp(F.col(c).cast("double")).alias(f"s_{c}"))])
    stats = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"),
                                        F.col(f"s_{c}").alias("sd")) for c in names]))
    counts = hist.groupBy("feature").agg(n.alias("n"), F.count(v).alias("n_distinct"))
    return counts.join(moments.select(stats), "feature")


def fill_constant(df: DataFrame, names: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.fillna(value, subset=list(names))


def impute_median(train: DataFrame, rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fill nulls with the exact medians of the train rows."""
    filled = {n: F.coalesce(F.col(n).cast("double"),
                            exact_quantiles(train.select(F.col(n).cast("double")), n, {"m": 0.5}).scalar())
              for n in names}
    return rows.withColumns(filled)


def index_labels(df: DataFrame, label: str, labels: Sequence[str], out: str = "label_index") -> DataFrame:
    """Label to its place in the list; rows with another label are dropped."""
    indexed = df.withColumn(out, lookup(F.col(label), {name: i for i, name in enumerate(labels)}))
    return indexed.where(F.col(out).isNotNull())


def normalize_label(column: Column) -> Column:
    return lookup(column, LABEL_ALIASES, keep_unmapped=True)


def normalize_keys(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: normalized_id(F.col(n)) for n in names})


def flatten_horizons(df: DataFrame, ids: Sequence[str], columns: Mapping[str, str],
                     value: str = "delta") -> DataFrame:
    """One row per horizon; null horizons are dropped."""
    renamed = df.select(*ids, *[F.col(c).cast("double").alias(h) for h, c in columns.items()])
    return renamed.unpivot(list(ids), list(columns), "horizon", value).where(F.col(value).isNotNull())


def horizon_columns(df: DataFrame, metrics: Sequence[str] = ("price_impact", "volume_multiplier"),
                    horizons: Sequence[str] = tuple(IMPACT_HORIZONS)) -> DataFrame:
    """Horizon maps (or their JSON text) to flat columns; a flat column that exists wins."""
    made = {}
    for metric in metrics:
        source = f"{metric}_json"
        if source not in df.columns:
            mapping = F.lit(None).cast("map<string,double>")
        elif isinstance(df.schema[source].dataType, T.MapType):
            mapping = F.col(source)
        else:
            mapping = F.from_json(source, "map<string,double>")
        for h in horizons:
            name = f"{metric}_{h}"
            flat = try_double(F.col(name)) if name in df.columns else None
            made[name] = flat if flat is not None else F.try_element_at(mapping, F.lit(h))
    return df.withColumns(made)


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test, allowMissingColumns=True)


def category_onehot(df: DataFrame, column: str, categories: Sequence[str], prefix: str = "category_") -> DataFrame:
    return df.withColumns({f"{prefix}{c}": F.when(F.col(column) == c, 1.0).otherwise(0.0)
                           for c in categories})


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Class weight ``n / (k * count)`` per row; the class table has one row per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    everything = Window.partitionBy()
    weights = counts.select(label, (F.sum("__c").over(everything)
                                    / (F.count(F.lit(1)).over(everything) * F.col("__c"))).alias(out))
    return df.join(materialize(weights), label)
