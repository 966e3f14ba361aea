"""Seeded, repeatable hash order and hash uniforms.

``md5`` text is the same on every engine and every run, so a split or sample
can be recomputed exactly after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PREFIX_CHARS = 3  # 16**3 = 4096 evenly filled hash ranges


def hash_key(seed: int | Column, *keys: Column) -> Column:
    first = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    marked = [F.coalesce(k.cast("string"), F.lit("\0")) for k in keys]  # concat_ws would skip a null
    return F.md5(F.concat_ws("|", first, *marked))


def hash_range(hashed: Column) -> Column:
    """Ordered hash range: lower text prefix means lower hash."""
    return F.substring(hashed, 1, PREFIX_CHARS)


def hash_uniform(hashed: Column) -> Column:
    """Uniform number in [0, 1) from the first 8 hex digits."""
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
