"""Class reports of the impact and propagation tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidegauge.operators.baselines import majority, random_prior_draws, random_prior_expected
from tidegauge.operators.metrics import (class_distribution, class_report, confusion_matrix, quadratic_kappa,
                                         small_spearman)
from tidegauge.operators.rows import expand_tiers, is_unconfounded, non_confounded, sufficient_data, valid_labels
from tidegauge.schemas import PRIOR_SEEDS


def scope_report(df: DataFrame, label: str, labels: Sequence[str], flag: str = "confound_flag") -> DataFrame:
    """Per scope (all / non-confounded): class counts, majority and prior scores in percent."""
    known = valid_labels(df, label, labels)
    known = known.groupBy(flag, label).agg(F.count(F.lit(1)).alias("w"))
    scoped = expand_tiers(known, {"all": F.lit(True), "non_confounded": is_unconfounded(flag)}, "scope")
    counts = class_distribution(scoped, label, ["scope"], "w").groupBy("scope").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n"))))).alias("classes"))
    best = majority(scoped, label, ["scope"], weight="w")
    prior = random_prior_expected(scoped, label, ["scope"], "w").drop("n")
    both = best.join(prior, "scope").join(counts, "scope")
    percent = {c: F.col(c) * 100 for c in ("accuracy", "macro_f1", "expected_accuracy", "expected_macro_f1")}
    return both.withColumns(percent)


def propagation_report(df: DataFrame, labels: Sequence[str], keys: Sequence[str],
                       exclude_insufficient: bool = False, flag: str | None = "insufficient_data_flag",
                       seeds: Sequence[int] = tuple(PRIOR_SEEDS)) -> DataFrame:
    """Majority and sampled-prior macro-F1 on clean, sufficient rows: ``(baseline, n, macro_f1)``."""
    clean = valid_labels(non_confounded(sufficient_data(df, flag)), "label", labels)
    if exclude_insufficient:
        clean = clean.where("label <> 'insufficient_data'")
        labels = [name for name in labels if name != "insufficient_data"]
    best = majority(clean, "label", k=len(labels)).select(
        F.lit("majority").alias("baseline"), "n", "macro_f1")
    prior = sampled_prior(clean, "label", labels, keys, seeds).agg(
        F.lit("random_prior").alias("baseline"), F.first("n").alias("n"), F.avg("macro_f1").alias("macro_f1"))
    return best.unionByName(prior)


def sampled_prior(df: DataFrame, label: str, labels: Sequence[str], keys: Sequence[str],
                  seeds: Sequence[int] = tuple(PRIOR_SEEDS)) -> DataFrame:
    """Score of prior draws per seed."""
    drawn = random_prior_draws(df.select(label, *keys), label, keys, seeds=seeds)
    return class_report(confusion_matrix(drawn, label, "pred", ["seed"]), labels, ["seed"]).select(
        "seed", "n", "accuracy", "macro_f1")


def sampled_prior_grades(df: DataFrame, grade: str, keys: Sequence[str],
                         seeds: Sequence[int] = tuple(PRIOR_SEEDS)) -> DataFrame:
    """Spearman and kappa of prior draws of ordinal grades per seed, from one count table."""
    drawn = random_prior_draws(df.select(grade, *keys), grade, keys, seeds=seeds)
    counts = confusion_matrix(drawn, grade, "pred", ["seed"])
    rho = small_spearman(counts, "gold", "pred", "n", ["seed"]).drop("n")
    return quadratic_kappa(counts, ["seed"]).join(rho, "seed", "left")
