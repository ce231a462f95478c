"""Operator 12: a Merkle manifest of a table, its levels computed by lag and lead windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import part_count, written

FAN = 8
STRIDE = 512  # Nodes of a group that one window holds; a multiple of FAN.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROW_BYTES = 200
STEP = "array<struct<before:string,after:string>>"


def hashed(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: of each value ``-`` if null, else its bytes in UTF-8, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return hashed(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with their place ``p`` in their group and its size ``n``, written.

    One sort by range deals a large group to many tasks. Each task's rows of a group are counted,
    and the counts summed over the tasks before it: a table of as many rows as there are
    tasks and groups together.
    """
    parts = part_count(rows, rows.count() * ROW_BYTES)
    tie = F.monotonically_increasing_id().alias("_tie")  # equal rows may be dealt to several tasks
    ranged = rows.select("*", tie).repartitionByRange(parts, group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    placed = written(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    counts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_rows"))
    of_group = Window.partitionBy(group)
    starts = counts.withColumns({
        "_before": F.sum("_rows").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows"), "n": F.sum("_rows").over(of_group),
    })
    joined = placed.join(written(starts.drop("_rows")), [group, "_part"])
    return written(joined.withColumn("p", F.col("_before") + F.col("_at") - F.col("_low")).drop("_part", "_at", "_low", "_before"))


def siblings(nodes: DataFrame, stride: int) -> DataFrame:
    """``nodes(grp, p, n, node)`` with the run's nodes ``before`` and ``after`` each, as text.

    Lag and lead at the offsets 1 to 7 reach all other slots of a run; those beyond its slots or its
    length are masked. A window spans ``stride`` nodes, so a large group is many windows.
    """
    slot, length = F.col("p") % FAN, F.least(F.lit(FAN), F.col("n") - F.col("p") + F.col("p") % FAN)
    by = Window.partitionBy("grp", F.expr(f"p div {stride}")).orderBy("p")
    earlier = [F.when(slot >= k, F.lag("node", k).over(by)) for k in range(FAN - 1, 0, -1)]
    later = [F.when(slot + k < length, F.lead("node", k).over(by)) for k in range(1, FAN)]
    return nodes.withColumns({side: F.concat(*[F.coalesce(x, F.lit("")) for x in columns]) for side, columns in (("before", earlier), ("after", later))})


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels above ``nodes(grp, p, n, node)``, each with its siblings: as many as the largest group needs. A node alone in its group (n = 1) is that group's root and has no parent."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    out, level = [], siblings(nodes, STRIDE)
    while largest > 1:
        first_children = level.where((F.col("n") > 1) & (F.col("p") % FAN == 0))
        parents = first_children.select("grp", F.expr(f"p div {FAN}").alias("p"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), hashed(F.col("node"), F.col("after")).alias("node"))
        level = written(siblings(parents, STRIDE))
        out.append(level)
        largest = -(-largest // FAN)
    return out


def _roots(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(grp, subroot): of every group the node that remains."""
    out = nodes.where("n = 1").select("grp", "node")
    for level in levels:
        out = out.unionByName(level.where("n = 1").select("grp", "node"))
    return out.withColumnRenamed("node", "subroot")


def _step() -> Column:
    return F.array(F.struct("before", "after"))


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, p, path, subroot) for the runs of the lowest nodes: what lies above the run's parent, or above the root of a group of one.

    ``tops(grp, path, subroot)`` is what lies above each group's root. It is joined where the
    group has one node, so no large group meets there; each level below takes its parents' paths.
    """
    paths = None
    for level in reversed(levels):
        own = level.where("n = 1").join(tops, "grp").select("grp", "p", "path", "subroot")
        if paths is not None:
            up = paths.withColumnRenamed("p", "_up")
            below = level.where("n > 1").withColumn("_up", F.expr(f"p div {FAN}")).join(up, ["grp", "_up"])
            own = own.unionByName(below.select("grp", "p", F.concat(_step(), F.col("path")).alias("path"), "subroot"))
        paths = written(own)
    return paths


def _attached(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``nodes(grp, p, n, node, ...)`` with ``path``, the steps (before, after) from each node on, and ``subroot``.

    Each run meets its parent's path in one join by (group, run), of eight rows at most; the same
    partitioning serves the window that adds the lowest siblings.
    """
    runs = nodes.where("n = 1").join(tops, "grp").select("grp", "p", "path", "subroot")
    if levels:
        runs = runs.unionByName(_paths(levels, tops))
    rows = nodes.withColumn("_run", F.expr(f"p div {FAN}")).join(runs.withColumnRenamed("p", "_run"), ["grp", "_run"])
    path = F.when(F.col("n") > 1, F.concat(_step(), F.col("path"))).otherwise(F.col("path"))
    return siblings(rows, FAN).withColumn("path", path).drop("_run", "before", "after")


def folded(node: Column, path: Column) -> Column:
    """The root that a node and the steps of its path give."""
    return F.aggregate(path, node, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the lowest step to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def merkle_manifest(docs: DataFrame, **extra: Column) -> DataFrame:
    """One row per row of ``docs(doc_id, source, lang, n_chars, text)``: doc_id, lang, leaf, subroot, root and ``path``.

    Leaves ascend by doc_id in each lang; runs of eight become their parent until one node is left,
    the subroot. Subroots in order of lang give the root in the same way. ``path`` holds of each level
    the run's other digests before and after the node: ``folded(leaf, path)`` is the root, and with
    another leaf it is not. ``extra`` columns are taken from the scan beside the leaf.

    The texts are read once, for the leaves, and go no further. A large lang is sorted by range
    and cut into windows; each level has an eighth of the rows of the one below. A null in any column
    is part of the leaf; null langs are a group of their own, before all others, and null ids stand first
    in theirs. Rows of one id are ordered by their leaf, so equal rows are leaves of their own in either order.
    An empty text is not a null one; a long one is hashed whole. Other columns are not read. An empty table gives an empty one.
    """
    group = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    leaves = docs.select("doc_id", "lang", group.alias("grp"), leaf_digest(*map(F.col, FIELDS)).alias("node"), *[c.alias(k) for k, c in extra.items()])
    nodes = numbered(leaves, "grp", "doc_id", "node")
    levels = _levels(nodes.select("grp", "p", "n", "node"))
    roots = written(_roots(nodes, levels))
    named = numbered(roots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("subroot").alias("node")), "grp", "of")
    upper = _levels(named.select("grp", "p", "n", "node"))
    top = written(_roots(named, upper).withColumn("path", F.expr(f"cast(array() as {STEP})")))
    tops = written(_attached(named, upper, top).select(F.col("of").alias("grp"), "path", F.col("node").alias("subroot")))
    root = top.select("subroot").first()
    made = _attached(nodes, levels, tops)
    return made.select("doc_id", "lang", F.col("node").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path", *extra)
