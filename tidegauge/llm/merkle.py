"""Merkle manifest of a data set, by nested-interval labels.

Every node of a tree carries the interval ``[lo, hi)`` of leaf ranks that it
covers. A node of level ``k`` covers at most ``fan ** k`` ranks, so
``lo div fan ** k`` is its bucket of that level: a node and the ancestors that
contain it meet by equality of buckets plus containment of intervals. The
siblings of a node are what is left of its parent's interval without its own,
on either side. Trees (one per partition of the data, then one over their
roots) are built level by level; no level holds a group of more than ``fan``
rows, whatever the size of a tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm.common import write_once

FAN = 8
_STEPS = "array<struct<left:array<binary>,right:array<binary>>>"
_PID_BITS = 33  # monotonically_increasing_id keeps the partition above these


def _sha(text: Column) -> Column:
    """SHA-256 of a string or binary column as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda h: F.lower(F.hex(h))), "")


def field(value: Column) -> Column:
    """A field as it enters a leaf: ``-`` for null, else byte count, colon and value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Digest (binary) of the fields of a record, in order."""
    return _sha(F.concat(*[field(v) for v in values]))


def _step(run: Column, lo: Column, hi: Column) -> Column:
    """Siblings of ``[lo, hi)`` in its parent's run: the parent's interval less its own, left and right."""
    def part(keep) -> Column:
        return F.transform(F.filter(run, keep), lambda n: n["hash"])

    return F.struct(part(lambda n: n["hi"] <= lo).alias("left"), part(lambda n: n["lo"] >= hi).alias("right"))


def proof_digest(steps: Column) -> Column:
    """SHA-256 (hex) of all sibling digests as hex text, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), "")
                  .cast("binary"), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give (binary)."""
    return F.aggregate(steps, leaf, lambda h, s: _sha(F.concat(_hex(s["left"]), F.lower(F.hex(h)), _hex(s["right"]))))


def _ranked(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Add ``lo``, ``hi`` (rank in the tree and rank plus one) and ``n`` (leaves of the tree); also the largest ``n``.

    Rows are dealt out by ranges of (tree, key, hash), so a tree of any size is
    spread over all tasks, and numbered within their range; the ranges' counts,
    a row per tree and range, give the first rank of each. Rows that repeat key
    and hash are told apart by where they were read.
    """
    order = ["tree", "key", "hash", "_read"]
    tasks = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = write_once(
        leaves.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order).drop("_read").withColumn("_at", F.monotonically_increasing_id()), "leaves-placed")
    piece = F.shiftright("_at", _PID_BITS)
    pieces = placed.groupBy(F.col("tree").alias("_tree"), piece.alias("_piece")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_tree").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    spans = write_once(pieces.select(
        "_tree", "_piece", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy("_tree")).alias("n")), "leaf-spans")
    most = spans.agg(F.max("n")).first()[0] or 0
    lo = F.col("_at") + F.col("_shift")
    out = placed.join(spans, (F.col("tree") == F.col("_tree")) & (piece == F.col("_piece"))).select(
        *leaves.columns, lo.alias("lo"), (lo + 1).alias("hi"), "n")
    return out, most


@dataclass
class Forest:
    """Trees by level. ``levels[k - 1]`` has the nodes of level ``k``: ``tree``, ``n``, ``lo``, ``hi``, ``hash`` and
    ``run``, their children in order; those of level 1 are the leaves with what they carry. A tree of one leaf
    has a node of level 1 whose hash is the leaf's."""

    levels: list[DataFrame]
    fan: int

    def tops(self) -> DataFrame:
        """``tree`` and ``hash`` of its last node, one row per tree."""
        found = [nodes.where(F.col("n") <= self.fan ** k).select("tree", "hash")
                 for k, nodes in enumerate(self.levels, 1)]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out

    def nodes(self) -> DataFrame:
        """All inner nodes: ``tree``, ``level``, ``lo``, ``hi``, ``hash``; what a manifest stores."""
        parts = [nodes.select("tree", F.lit(k).alias("level"), "lo", "hi", "hash") for k, nodes in enumerate(self.levels, 1)]
        out = parts[0]
        for more in parts[1:]:
            out = out.union(more)
        return out


def grow(leaves: DataFrame, fan: int = FAN) -> Forest:
    """Trees over ``leaves``: ``tree`` (string, not null), ``key``, ``hash`` (binary) and any more columns, carried along.

    Leaves of a tree stand by key, null first, then by hash. Each level groups
    the last one by bucket, ``fan`` rows to a group, and is written once.
    """
    nodes, most = _ranked(leaves)
    carried = [c for c in leaves.columns if c != "tree"]
    levels, width = [], 1
    while not levels or most > width:
        fields = ["lo", "hi", *(carried if not levels else ["hash"])]
        run = F.sort_array(F.collect_list(F.struct(*fields)))
        joined = _sha(_hex(F.transform("run", lambda c: c["hash"])))
        alone = F.col("n") == 1  # its leaf is the root already; only level 1 meets such trees
        level = (nodes.where(F.lit(not levels) | (F.col("n") > width))
                 .groupBy("tree", "n", F.floor(F.col("lo") / (width * fan)).alias("_bucket")).agg(run.alias("run"))
                 .select("tree", "n", F.col("run")[0]["lo"].alias("lo"), F.element_at("run", -1)["hi"].alias("hi"),
                         F.when(alone, F.col("run")[0]["hash"]).otherwise(joined).alias("hash"), "run"))
        nodes = write_once(level, f"level-{len(levels) + 1}")
        levels.append(nodes)
        width *= fan
    return Forest(levels, fan)


def prove(forest: Forest, above: DataFrame) -> DataFrame:
    """A row per leaf: its carried columns, ``tree``, ``lo`` and the columns of ``above``, with ``steps`` down to the leaf.

    ``above`` has a row per tree: ``tree``, ``steps`` (siblings of the tree's top
    in what lies over it) and any more columns. From the top down every level
    gets the steps of its parents by a join on tree and bucket, confined to
    intervals that contain the node's; each level has a ``fan``-th of the rows
    of the one below, and leaves come out of their parents' runs without a join.
    """
    fan, more = forest.fan, [c for c in above.columns if c not in ("tree", "steps")]
    parents = None
    for k in range(len(forest.levels), 0, -1):
        nodes, width = forest.levels[k - 1], fan ** k
        top = nodes.where(F.col("n") <= width).join(above, "tree")
        if parents is None:
            parents = top
            continue
        bucket = lambda lo: F.floor(F.col(lo) / (width * fan))
        up = parents.select(F.col("tree").alias("_tree"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                            F.col("run").alias("_run"), F.col("steps").alias("_steps"), *more)
        inner = nodes.where(F.col("n") > width).join(
            up, (F.col("tree") == F.col("_tree")) & (bucket("lo") == bucket("_lo"))
            & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
        steps = F.concat(F.array(_step(F.col("_run"), F.col("lo"), F.col("hi"))), F.col("_steps")).alias("steps")
        parents = top.select(*nodes.columns, "steps", *more).unionByName(inner.select(*nodes.columns, steps, *more))
    leaf = F.col("leaf")
    own = F.when(F.col("n") == 1, F.col("steps")).otherwise(
        F.concat(F.array(_step(F.col("run"), leaf["lo"], leaf["hi"])), F.col("steps")))
    carried = [f for f in forest.levels[0].schema["run"].dataType.elementType.fieldNames() if f != "hi"]
    return (parents.withColumn("leaf", F.explode("run"))
            .select("tree", *[leaf[c].alias(c) for c in carried], *more, own.alias("steps")))


def manifest(docs: DataFrame, claimed: Column | None = None, key: str = "doc_id", part: str = "lang",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), fan: int = FAN) -> DataFrame:
    """Leaf, subroot, root and proof of every row; with ``claimed``, a digest over columns of ``docs`` to verify.

    Rows of a partition (column ``part``) make one tree, in the order of ``key``;
    the trees' roots, in the order of ``part`` (null first, bytewise), make the
    tree of the whole. Columns: ``key``, ``part``, ``lo`` (rank of the leaf),
    ``leaf``, ``subroot``, ``root``, ``claimed`` (digests as 32 bytes) and
    ``steps``, the siblings level by level from the leaf to the root.

    Null fields enter the digest as ``-``; a null key comes first in its tree, a
    null partition is a tree of its own. Rows that repeat a key are leaves of
    their own, ordered by digest; equal rows stand side by side. An empty text
    is ``0:``. An empty table gives an empty result. Columns not named are not
    read, so their names cannot clash.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit(""))
    digest = leaf_digest(*[F.col(f) for f in fields])
    leaves = write_once(docs.select(
        tree.alias("tree"), F.col(key).alias("key"), F.col(part).alias("part"), digest.alias("hash"),
        (digest if claimed is None else claimed).alias("claimed")), "leaves")
    trees = grow(leaves, fan)
    tops = write_once(trees.tops().select(F.lit("").alias("tree"), F.col("tree").alias("key"), "hash"), "subroots")
    whole = grow(tops, fan)
    no_steps = F.array().cast(_STEPS)
    roots = prove(whole, whole.tops().select("tree", no_steps.alias("steps"), F.col("hash").alias("root")))
    above = write_once(roots.select(F.col("key").alias("tree"), "steps", F.col("hash").alias("subroot"), "root"), "above")
    return prove(trees, above).select("key", "part", "lo", F.col("hash").alias("leaf"), "subroot", "root", "claimed", "steps")


def verified_manifest(docs: DataFrame, claimed: Column, **names) -> DataFrame:
    """``manifest`` with ``folded_root``, recomputed from the claimed digest and the siblings, and ``verified``."""
    proven = manifest(docs, claimed, **names)
    again = folded(F.col("claimed"), F.col("steps"))
    return proven.withColumn("folded_root", again).withColumn("verified", F.col("folded_root") == F.col("root"))
