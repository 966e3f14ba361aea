"""Text, number and time formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def format_number(value: Column) -> Column:
    """Four decimals without trailing zeros; null and NaN print as ``null``."""
    text = F.regexp_replace(F.format_string("%.4f", value.cast("double")), r"\.?0+$", "")
    return F.when(value.isNull() | F.isnan(value.cast("double")), F.lit("null")).otherwise(text)


def format_text(value: Column) -> Column:
    """Trimmed text with inner white space collapsed; null prints as ``null``."""
    return F.coalesce(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit("null"))


def trim_text(value: Column, max_chars: int = 1200) -> Column:
    """Text longer than ``max_chars`` ends in ``...`` and fits the limit."""
    head = F.concat(F.rtrim(F.substring(value, 1, max_chars - 3)), F.lit("..."))
    return F.when(F.length(value) <= max_chars, value).otherwise(head)


def try_double(value: Column) -> Column:
    """Number from text; text that is no number becomes null."""
    return value.try_cast("double")


def epoch_ms_to_timestamp(value: Column) -> Column:
    return F.timestamp_millis(value.cast("bigint"))


def text_to_timestamp(value: Column) -> Column:
    """ISO text to a UTC timestamp; bad text becomes null."""
    return value.try_cast("timestamp")


def micros(value: Column) -> Column:
    """Instant as microseconds since the epoch (session zone is UTC)."""
    return F.unix_micros(value.cast("timestamp"))


def normalized_id(value: Column) -> Column:
    """Key text for comparing IDs: trimmed, null as the empty string."""
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))
