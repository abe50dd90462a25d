"""A Merkle manifest of a dataset: one tree a source, and one over the sources' subroots.

Nodes of a level are rows (tree, pos, digest). Every level joins the table with itself on computed sibling
positions: ``pos XOR 1`` for a binary tree, else the slot offsets of a run of ``fan_out`` nodes, asked for by
the run's slot-zero row, which then emits the parent. All keys (tree, pos) are unique, so a source that holds
most rows is no hot key, and no task sees more of a tree than its runs. Runs are written level by level; a lost
executor costs one level. Paths to the root are put together from the top: a run is told its parents' path once,
for all its members, and only the last projection holds a whole path for each row.

Leaves are numbered without a window over a source: rows are sorted in ranges by (source, id, digest, a number
that splits equal rows), and the counts of the ranges are chained.

Order inside a source: ascending id, null first, then digest. A null field hashes as ``-``. A null id counts as
the empty text for the tamper check. Empty tables give no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value; integers as decimals."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_column(columns: dict[str, Column]) -> Column:
    return digest_of(*[field(c) for c in columns.values()])


def numbered(df: DataFrame, group: list[str], order: list[str], pos: str) -> DataFrame:
    """Adds ``pos``: 0, 1, ... in each group, in ``order``; without ``group`` over the whole table.

    The table is cut into ranges of (group, order) and each range is sorted, which numbers its rows; ranges are
    chained by their counts. The last key splits rows that are equal in all others.
    """
    dealt = df.withColumn("tie_", F.monotonically_increasing_id())
    keys = [*group, *order, "tie_"]
    ranged = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.withColumn("at_", F.monotonically_increasing_id()).withColumn("part_", F.spark_partition_id()).drop("tie_"), "ranges")
    counts = ranged.groupBy(*group, "part_").agg(F.count("*").alias("n_"), F.min("at_").alias("low_"))
    earlier = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"{g}_") for g in group], F.col("part_").alias("of_"), "low_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("start_"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in group], F.col("part_") == F.col("of_"))
    placed = ranged.join(starts, same).withColumn(pos, F.col("start_") + F.col("at_") - F.col("low_"))
    return placed.drop("part_", "at_", "of_", "low_", "start_", *[f"{g}_" for g in group])


def level_runs(nodes: DataFrame, fan_out: int) -> DataFrame:
    """(tree, run, members): the digests of each run of siblings in order, found by its slot-zero row.

    ``nodes`` holds (tree, pos, digest, n), n nodes in the tree.
    """
    heads = nodes.where(F.col("pos") % fan_out == 0)
    if fan_out == 2:
        others = nodes.where("pos % 2 = 1").select("tree", F.col("pos").bitwiseXOR(F.lit(1)).alias("pos"), F.col("digest").alias("other"))
        members = F.array_compact(F.array("digest", "other"))
        return heads.join(others, ["tree", "pos"], "left").select("tree", F.expr("pos div 2").alias("run"), members.alias("members"))
    asked = heads.select("tree", F.col("pos").alias("head"), F.explode(F.expr(f"sequence(pos, least(pos + {fan_out}, n) - 1)")).alias("pos"))
    found = asked.join(nodes.select("tree", "pos", "digest"), ["tree", "pos"])
    members = F.sort_array(F.collect_list(F.struct("pos", "digest")))
    return found.groupBy("tree", "head").agg(members.alias("m")).select("tree", F.expr(f"head div {fan_out}").alias("run"), F.col("m.digest").alias("members"))


def build(leaves: DataFrame, fan_out: int) -> tuple[list[DataFrame], DataFrame]:
    """(runs of each level from the leaves up, (tree, digest) of the roots) for (tree, pos, digest, n) rows."""
    levels, roots, nodes = [], [], leaves
    while True:
        roots.append(nodes.where("n = 1").select("tree", "digest"))
        nodes = nodes.where("n > 1")
        if not nodes.take(1):
            return levels, materialize(reduce(DataFrame.union, roots), "roots")
        runs = materialize(level_runs(nodes, fan_out), "runs")
        levels.append(runs)
        parents = runs.select("tree", F.col("run").alias("pos"), digest_of(F.concat_ws("", "members")).alias("digest"))
        sizes = nodes.where("pos = 0").select("tree", F.expr(f"(n + {fan_out - 1}) div {fan_out}").alias("n"))
        nodes = materialize(parents.join(sizes, "tree"), "nodes")


def _step(members: Column, slot: Column) -> Column:
    """The siblings of a member as two texts, those before and those after it."""
    before = F.concat_ws("", F.slice(members, F.lit(1), slot))
    after = F.concat_ws("", F.slice(members, slot + 2, F.size(members)))
    return F.array(F.struct(before.alias("before"), after.alias("after")))


def paths(levels: list[DataFrame], top: DataFrame, fan_out: int) -> DataFrame | None:
    """(tree, run, members, subroot, path) of the lowest level; ``path`` is that of the run's parent, up to the root.

    ``top`` gives (tree, zero, subroot, path) of the trees' own roots, at position zero. Levels are walked from the top, and a run hands
    its path on to all members at once.
    """
    start = top.select("tree", F.col("zero").alias("run"), F.struct("subroot", "path").alias("top"))
    above, runs = None, None
    for level in reversed(levels):
        runs = level.join(start, ["tree", "run"], "left")
        if above is not None:
            runs = runs.join(above, ["tree", "run"], "left").withColumn("top", F.coalesce("above", "top")).drop("above")
        runs = materialize(runs.select("tree", "run", "members", "top.subroot", "top.path"), "paths")
        each = runs.select("*", F.posexplode("members").alias("slot", "digest"))
        path = F.concat(_step(F.col("members"), F.col("slot")), F.col("path"))
        above = each.select("tree", (F.col("run") * fan_out + F.col("slot")).alias("run"), F.struct("subroot", path.alias("path")).alias("above"))
    return runs


def with_paths(nodes: DataFrame, levels: list[DataFrame], top: DataFrame, fan_out: int) -> DataFrame:
    """``nodes`` (tree, pos, ...) with subroot and path: for each level (before, after), the siblings' digests."""
    lone = top.select("tree", F.col("zero").alias("pos"), F.col("subroot").alias("top_subroot"), F.col("path").alias("top_path"))
    joined = nodes.join(lone, ["tree", "pos"], "left")
    runs = paths(levels, top, fan_out)
    if runs is None:
        return joined.withColumnsRenamed({"top_subroot": "subroot", "top_path": "path"})
    slot = (F.col("pos") % fan_out).cast("int")
    joined = joined.withColumn("run", F.expr(f"pos div {fan_out}")).join(runs, ["tree", "run"], "left")
    path = F.coalesce(F.concat(_step(F.col("members"), slot), F.col("path")), F.col("top_path"))
    return joined.withColumn("path", path).withColumn("subroot", F.coalesce("subroot", "top_subroot")).drop("run", "members", "top_subroot", "top_path")


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda digest, step: digest_of(step["before"], digest, step["after"]))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings, level by level and left to right."""
    return digest_of(F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["after"]))))


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, fan_out: int = 16) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, presented) for every row of ``docs``.

    ``fields`` are id, source and the other hashed columns, in order. ``changed`` gives columns as they are found
    later: ``presented`` is the leaf of a row with them in place, ``leaf`` that of the row as it is.
    """
    own = {name: F.col(f"`{name}`") for name in fields}
    rows = docs.select(
        own[fields[0]].alias("id"),
        own[fields[1]].alias("source"),
        leaf_column(own).alias("leaf"),
        leaf_column({**own, **(changed or {})}).alias("presented"),
    )
    placed = numbered(materialize(rows, "leaves"), ["source"], ["id", "leaf"], "pos")
    placed = materialize(placed, "placed")
    sources = materialize(numbered(placed.groupBy("source").agg(F.count("*").alias("n")), [], ["source"], "tree"), "sources")
    named = sources.select(F.col("source").alias("of"), "tree", "n")
    leaves = placed.join(named, F.col("source").eqNullSafe(F.col("of"))).select("tree", "pos", "id", "leaf", "presented", "n")
    leaves = materialize(leaves, "leaves")
    levels, subroots = build(leaves.select("tree", "pos", F.col("leaf").alias("digest"), "n"), fan_out)

    total = subroots.count()
    upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(total).cast("long").alias("n"))
    upper = materialize(upper, "upper")
    upper_levels, roots = build(upper, fan_out)
    root = roots.select("digest").first()
    root = root and root[0]
    nothing = F.array().cast("array<struct<before: string, after: string>>")
    zero = F.lit(0).cast("long").alias("zero")
    summit = roots.select("tree", zero, F.col("digest").alias("subroot"), nothing.alias("path"))
    summit = materialize(summit, "summit")
    top = with_paths(upper, upper_levels, summit, fan_out)
    top = materialize(top.select(F.col("pos").alias("tree"), zero, F.col("digest").alias("subroot"), "path"), "tops")
    found = with_paths(leaves, levels, top, fan_out)
    return found.select(F.col("id").alias(fields[0]), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "path", "presented")
