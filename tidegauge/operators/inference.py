"""Prompt tables and answer parsing around a bulk inference step.

Prompts are built and answers parsed as column expressions; the model call in
between is not part of this library. Instruction texts are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.labels import clamp_delta
from tidegauge.functions.text import format_number, format_text
from tidegauge.operators.ranking import top_k


def lines(*parts: Column | str) -> Column:
    """Join parts by line breaks; a null part is left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def labelled(name: str, value: Column) -> Column:
    """``- name: value`` or null when the value is null, so the line vanishes."""
    return F.concat(F.lit(f"- {name}: "), value)


def feature_block(texts: Mapping[str, Column], features: Mapping[str, Column]) -> Column:
    """Text fields, then an indented list of numeric features."""
    parts: list[Column | str] = [labelled(n, format_text(c)) for n, c in texts.items()]
    if features:
        parts.append("- structured_features:")
        parts += [F.concat(F.lit(f"    {n}: "), format_number(c)) for n, c in features.items()]
    return lines(*parts)


def example_block(examples: DataFrame, block: str, answer: str, order: Sequence[str]) -> Column:
    """The few chosen examples as one text value, shared by all prompts."""
    row = F.struct(*order, F.concat_ws("\n", F.col(block), F.concat(F.lit("- label: "), F.col(answer)))
                   .alias("text"))
    numbered = F.transform(F.array_sort(F.collect_list(row)), lambda r, i: F.concat(
        F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), r["text"]))
    return examples.agg(F.concat_ws("\n", numbered)).scalar()


def feature_prompts(df: DataFrame, block: Column, task: str, closing: str,
                    examples: Column | None = None, out: str = "prompt") -> DataFrame:
    """One prompt per row: task line, optional examples, the row's own block."""
    parts: list[Column | str] = [task]
    if examples is not None:
        parts += ["Labeled examples:", examples]
    parts += ["Target:", block, closing]
    return df.withColumn(out, lines(*parts))


def candidate_prompts(pairs: DataFrame, k: int, instruction: str, closing: str) -> DataFrame:
    """One prompt per post with its ``k`` best candidate markets, numbered from 1."""
    best = top_k(pairs, ["tweet_id"], [F.desc("embedding_score"), F.col("market_id")], k)
    entry = F.struct("rn", "market_id", "market_question")
    listed = best.groupBy("tweet_id").agg(F.max_by("tweet_text", -F.col("rn")).alias("tweet_text"),
                                          F.array_sort(F.collect_list(entry)).alias("c"))
    numbered = F.transform("c", lambda e: F.concat(e["rn"].cast("string"), F.lit(". "), e["market_question"]))
    prompt = lines(instruction, F.concat(F.lit("Post: "), F.col("tweet_text")), "Candidate markets:",
                   F.concat_ws("\n", numbered), closing)
    return listed.select("tweet_id", F.size("c").alias("k"),
                         F.transform("c", lambda e: e["market_id"]).alias("market_ids"),
                         prompt.alias("prompt"))


def row_prompts(df: DataFrame, instruction: str, fields: Mapping[str, Column], closing: str,
                examples: Sequence[str] = (), out: str = "prompt") -> DataFrame:
    """One prompt per row from named fields; a null field's line is skipped."""
    shots: list[Column | str] = ["Examples:", *examples] if examples else []
    return df.withColumn(out, lines(instruction, *shots,
                                    *[labelled(n, c) for n, c in fields.items()], closing))


def json_answer(raw: Column, schema: str) -> Column:
    """Struct from the whole text, else from the outermost braces; else all null."""
    first = schema.split()[0]
    inner = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), schema)
    whole = F.from_json(F.trim(raw), schema)
    return F.when(whole[first].isNotNull(), whole).otherwise(inner)


def parsed_deltas(df: DataFrame, raw: str, price: str) -> DataFrame:
    """Clamped horizon deltas; a row that lacks any of them is an error row."""
    names = ["delta_30m", "delta_2h", "delta_6h"]
    answer = json_answer(F.col(raw), ", ".join(f"{n} double" for n in names))
    df = df.withColumn("__a", answer)
    missing = F.greatest(*[F.col("__a")[n].isNull() for n in names])
    made = {n: F.when(~missing, clamp_delta(F.col(price), F.col("__a")[n])) for n in names}
    return df.withColumns({**made, "parse_error": missing}).drop("__a")


def parsed_grade(df: DataFrame, raw: str, default: int = 2) -> DataFrame:
    """Grade 0-5 from JSON, else the first stand-alone digit 0-5, else the default."""
    from_json = F.from_json(F.trim(raw), "grade int")["grade"]
    valid = F.when(from_json.between(0, 5), from_json)
    digit = F.regexp_extract(raw, r"\b([0-5])\b", 1).try_cast("int")
    found = F.coalesce(valid, digit)
    return df.withColumns({"grade": F.coalesce(found, F.lit(default)), "parse_error": found.isNull()})


def parsed_label(df: DataFrame, raw: str, field: str, labels: Sequence[str], fallback: str) -> DataFrame:
    """Label from JSON, else the first listed label the text contains, else the fallback."""
    told = F.lower(F.trim(F.from_json(F.trim(raw), f"{field} string")[field]))
    text = F.lower(F.col(raw))
    found = F.coalesce(F.when(told.isin(list(labels)), told),
                       *[F.when(text.contains(name), F.lit(name)) for name in labels])
    return df.withColumns({"label": F.coalesce(found, F.lit(fallback)), "parse_error": found.isNull()})


def parsed_ranking(df: DataFrame, raw: str, k: Column) -> DataFrame:
    """A full ranking 1..k: named numbers in order, then the missing ones; none is identity."""
    numbers = F.transform(F.regexp_extract_all(F.col(raw), F.lit(r"\d+"), F.lit(0)),
                          lambda t: t.try_cast("int"))
    named = F.filter(numbers, lambda x: x.between(F.lit(1), k))
    full = F.array_distinct(F.concat(named, F.sequence(F.lit(1), k)))
    return df.withColumns({"ranking": full, "parse_error": F.size(named) == 0})


def parse_error_rate(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"),
                                  F.count_if("parse_error").alias("parse_errors"),
                                  F.avg(F.col("parse_error").cast("double")).alias("error_rate"))


def adapt_predictions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Any baseline output to ``keys, label``: ``label``, ``pred_label`` or ``prediction.label``."""
    paths = [F.col(c) for c in ("label", "pred_label") if c in df.columns]
    if "prediction" in df.columns:
        paths.append(F.col("prediction.label"))
    return df.select(*keys, F.coalesce(*paths).alias("label"))


