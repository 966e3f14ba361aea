"""Map and array helpers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def horizon_map(text: Column) -> Column:
    """JSON text to a horizon map; bad JSON becomes null."""
    return F.from_json(text, "map<string,double>")


def map_value(mapping: Column, key: str, default: float | None = None) -> Column:
    found = F.try_element_at(mapping, F.lit(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def normalized_scores(scores: Column, label: Column, labels: Sequence[str]) -> Column:
    """Class scores clipped at 0 and scaled to sum 1, else one-hot on ``label``."""
    clipped = [F.greatest(F.lit(0.0), map_value(scores, name, 0.0)) for name in labels]
    total = sum(clipped[1:], clipped[0])
    pairs = []
    for name, value in zip(labels, clipped):
        one_hot = F.when(label == name, 1.0).otherwise(0.0)
        pairs += [F.lit(name), F.when(total > 0, F.try_divide(value, total)).otherwise(one_hot)]
    return F.create_map(*pairs)


def best_label(scores: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(label, score) of the largest score; the first wins on a tie."""
    top = F.greatest(*[c for _, c in scores])
    label = F.coalesce(*[F.when(c == top, F.lit(n)) for n, c in scores])
    return label, top


def inner_product(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)
