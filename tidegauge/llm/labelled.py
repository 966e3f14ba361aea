"""Training rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import id_crc32, write_once

_STEPS = 1 << 30


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts and labels to learn from: columns ``text`` and ``y``, about ``bound`` rows at most.

    Rows whose CRC-32 of the key falls in the held-out fold, and null keys or
    labels, are left out. Several labels of one key are averaged and rounded,
    half up. Beyond ``bound`` keys a hash of the key chooses, so reruns agree. The
    chosen keys are broadcast; ``bound`` limits their size. Rows that repeat a
    key give one training row, with the smallest of their texts. The result is written once to the shared folder.
    """
    per_key = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
               .groupBy(F.col(key).alias("k")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
               .where(F.pmod(id_crc32(F.col("k")), F.lit(folds)) != held_out))
    total = per_key.count()
    share = int(_STEPS * min(1.0, bound / max(total, 1)))
    chosen = per_key.where(F.pmod(F.xxhash64("k"), F.lit(_STEPS)) < share)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), "k")
    return write_once(rows.groupBy("k").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y"), "training")
