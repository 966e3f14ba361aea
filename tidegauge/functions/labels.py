"""Label rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Thresholds of the label rules.
FLAT_BAND = 0.02
LARGE_MOVE = 0.08
TRANSIENT_RATIO = 0.3


def direction(delta: Column, band: float = FLAT_BAND) -> Column:
    """``up`` above the band, ``down`` below it, else ``flat``; null stays null."""
    return (F.when(delta > band, "up").when(delta < -band, "down")
            .when(delta.isNotNull(), "flat"))


def magnitude(delta: Column) -> Column:
    """``small`` up to 0.02, ``medium`` up to 0.08, else ``large`` (absolute value)."""
    size = F.abs(delta)
    return (F.when(size <= FLAT_BAND, "small").when(size <= LARGE_MOVE, "medium")
            .when(size.isNotNull(), "large"))


def sign_direction(delta: Column) -> Column:
    """Direction by sign alone: the momentum rule has no band."""
    return direction(delta, 0.0)


def clamp_delta(price: Column, delta: Column) -> Column:
    """Keep ``price + delta`` inside [0, 1]."""
    return F.greatest(-price, F.least(F.lit(1.0) - price, delta))


def decay_class(early: Column, late: Column) -> Column:
    """Impact persistence from the first (15m) and second (2h) price move.

    A small move with a flipped sign counts as transient (rules apply in
    order); a same-sign move between the two thresholds has no class.
    """
    return (F.when(F.abs(late) < TRANSIENT_RATIO * F.abs(early), "transient")
            .when((early * late > 0) & (F.abs(late) > F.abs(early)), "sustained")
            .when(early * late < 0, "reversal"))


def interest_class(volume: Column, low: Column, high: Column) -> Column:
    """Interest from the final volume and the 40th / 80th percentile values."""
    return (F.when(volume > high, "high_interest").when(volume < low, "low_interest")
            .when(volume.isNotNull(), "moderate_interest"))


def lookup(column: Column, mapping: dict, keep_unmapped: bool = False) -> Column:
    """Value lookup in a small fixed mapping; unmapped is null or kept."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, column)
    return F.coalesce(found, column) if keep_unmapped else found
