"""Merkle manifest of a table: a tree for every group of rows, a tree over their roots, and a proof for every row.

A row's leaf is the hash of its fields. The leaves of a group ascend by id, and every ``radix`` consecutive nodes have
their hash as parent until one is left, the subroot; the subroots, by group, have a root in the same way. Positions come
from a range sort and running counts of its partitions, so no group is sorted by one task, and nodes are kept as a table
of runs ``(tree, level, run, digests)``, a run being the children of one parent.

A proof is found by coordinates. From its index and the size of its group a leaf knows which run it needs on each level;
leaves of one run need the same runs above, so a run of leaves explodes these coordinates once. They are joined with the
table of runs, put in order of level and folded. The lower levels have few requests a run; the upper ones, which all
leaves ask for, are together at most ``UPPER`` rows, counted, and are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import materialise

#: Children of a node.
RADIX = 8
#: Rows of the upper levels that are broadcast at most: a run of digests is about 300 bytes.
UPPER = 1 << 16


def leaf_hash(*fields: str | Column) -> Column:
    """SHA-256 (binary) of the fields: each is ``-`` if null, else the bytes of its text in UTF-8, ``:`` and its text."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def _hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


def _parent(digests: Column) -> Column:
    return F.unhex(F.sha2(_hex(digests), 256))


@dataclass
class Manifest:
    """``leaves (tree, run, n, members)``: runs of leaves, a member being (id, leaf, carried columns), n the leaves of the
    tree; ``runs (tree, level, run, digests)`` from level one; ``tops`` and ``top_runs`` the same for the tree of subroots,
    whose members are (tree, group, leaf); ``roots (tree, root)``: one row, none for an empty table; the largest n of each."""

    leaves: DataFrame
    runs: DataFrame
    subroots: DataFrame
    tops: DataFrame
    top_runs: DataFrame
    roots: DataFrame
    most: int
    most_groups: int


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows (tree, ...)`` plus ``idx``, their place in their tree by ``order``, and ``n``, the rows of the tree."""
    parts = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = materialise(parts.withColumn("at", F.monotonically_increasing_id()), "merkle-placed")
    part = F.shiftright("at", 33)
    counts = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("tree")  # a tree has a row a partition here
    counts = counts.withColumns({"before": F.coalesce(F.sum("here").over(before), F.lit(0)), "n": F.sum("here").over(whole)})
    counts = materialise(counts.select("tree", "part", (F.col("before") - F.col("first")).alias("shift"), "n"), "merkle-counts")
    joined = placed.withColumn("part", part).join(_small(counts), ["tree", "part"])
    return joined.select("*", (F.col("at") + F.col("shift")).alias("idx")).drop("at", "part", "shift")


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``UPPER`` rows."""
    return F.broadcast(df) if df.count() <= UPPER else df


def _build(rows: DataFrame, order: list[str], carried: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Runs of leaves, runs of the levels above, the roots of all trees, and the leaves of the largest tree."""
    spark = rows.sparkSession
    member = F.struct("idx", *carried)
    grouped = _ranked(rows, order).groupBy("tree", F.expr(f"idx div {RADIX}").alias("run"))
    leaves = materialise(grouped.agg(F.max("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members")), "merkle-leaves")
    most = leaves.agg(F.max("n")).first()[0] or 0
    runs = spark.createDataFrame([], "tree string, level int, run long, digests array<binary>")
    roots = leaves.where("n = 1").select("tree", F.col("members")[0]["leaf"].alias("digest"))
    level, width, digests = 0, 1, leaves.select("tree", "run", "n", F.transform("members", lambda m: m["leaf"]).alias("digests"))
    while most > width:  # of trees with more than one node on this level the next one has the hashes of its runs
        width, level = width * RADIX, level + 1
        nodes = digests.where(f"n > {width // RADIX}").select("tree", F.col("run").alias("idx"), "n", _parent(F.col("digests")).alias("digest"))
        roots = roots.union(nodes.where(f"n <= {width}").select("tree", "digest"))
        if most > width:
            per = nodes.where(f"n > {width}").groupBy("tree", F.expr(f"idx div {RADIX}").alias("run"))
            per = per.agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("m"))
            digests = materialise(per.select("tree", "run", "n", F.transform("m", lambda m: m["digest"]).alias("digests")), "merkle-runs")
            runs = runs.union(digests.select("tree", F.lit(level).alias("level"), "run", "digests"))
    return leaves, runs, materialise(roots, "merkle-roots"), most


def build(leaves: DataFrame, id_col: str = "id", group_col: str = "group") -> Manifest:
    """The manifest of ``leaves (id_col, group_col, leaf, ...)``; other columns are carried by the members.

    Groups stand by their text in UTF-8, null first; leaves by id, null first, then by hash, so rows that repeat an id are
    leaves of their own. An empty table has no tree and no root.
    """
    more = [c for c in leaves.columns if c not in (id_col, group_col, "leaf")]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null is a group too
    rows = leaves.select(
        tree.alias("tree"), F.col(id_col).alias("id"), "leaf", F.struct(*(F.col(c) for c in more), F.lit(0).alias("__")).alias("more"), F.monotonically_increasing_id().alias("rid")
    )
    rows = materialise(rows, "merkle-rows")
    low, runs, subroots, most = _build(rows, ["id", "leaf", "rid"], ["id", "leaf", "more"])
    top = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("digest").alias("leaf"))
    tops, top_runs, roots, groups = _build(top, ["group"], ["group", "leaf"])
    return Manifest(low, runs, subroots, tops, top_runs, roots.select("tree", F.lower(F.hex("digest")).alias("root")), most, groups)


def _steps(at: Column, digests: Column) -> Column:
    """A step of a proof: hashes left and right of the place ``at`` of a run, as hex text."""
    left, right = F.slice(digests, F.lit(1), at), F.slice(digests, at + 2, F.lit(RADIX))
    return F.struct(_hex(left).alias("left"), _hex(right).alias("right"))


def _paths(leaves: DataFrame, runs: DataFrame, most: int) -> DataFrame:
    """``tree, run, path``: the steps above every run of leaves that has any, in order of level."""
    levels, width = [], RADIX
    while width < most:
        levels.append((len(levels) + 1, width))
        width *= RADIX
    if not levels:
        return leaves.sparkSession.createDataFrame([], "tree string, run long, path array<struct<left: string, right: string>>")
    table = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(w).cast("long").alias("width")) for k, w in levels])
    asked = leaves.select("tree", "run", F.explode(F.filter(table, lambda x: F.col("n") > x["width"])).alias("x"))
    up, at = F.expr("run div x.width"), F.expr(f"cast(run div (x.width div {RADIX}) % {RADIX} as int)")
    asked = asked.select("tree", F.col("run").alias("leaf_run"), F.col("x.level").alias("level"), up.alias("run"), at.alias("at"))
    sizes = {r["level"]: r["count"] for r in runs.groupBy("level").count().collect()}  # a row a level
    cut, upper = levels[-1][0] + 1, 0
    while cut > 1 and upper + sizes.get(cut - 1, 0) <= UPPER:
        cut -= 1
        upper += sizes.get(cut, 0)
    on = ["tree", "level", "run"]
    high = asked.where(f"level >= {cut}").join(F.broadcast(runs.where(f"level >= {cut}")), on)
    low = asked.where(f"level < {cut}").join(runs.where(f"level < {cut}"), on)
    found = high.unionByName(low) if cut > 1 else high
    per = found.groupBy("tree", "leaf_run").agg(F.array_sort(F.collect_list(F.struct("level", "at", "digests"))).alias("p"))
    return per.select("tree", F.col("leaf_run").alias("run"), F.transform("p", lambda s: _steps(s["at"], s["digests"])).alias("path"))


def _with_paths(leaves: DataFrame, paths: DataFrame) -> DataFrame:
    """A row a leaf: ``tree, member, path``, its own run's step first (none in a tree of one leaf)."""
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    rows = leaves.join(paths, ["tree", "run"], "left").withColumn("digests", F.transform("members", lambda m: m["leaf"]))
    rows = rows.select("tree", "n", "digests", F.coalesce("path", none).alias("above"), F.posexplode("members").alias("at", "member"))
    own = F.when(F.col("n") > 1, F.array(_steps(F.col("at"), F.col("digests")))).otherwise(none)
    return rows.select("tree", "member", F.concat(own, "above").alias("path"))


def proofs(m: Manifest, id_col: str = "id") -> DataFrame:
    """A row a leaf: ``id_col, leaf, subroot, root`` (hex), ``path`` (steps from its run to the root) and what was carried."""
    top = _with_paths(m.tops, _paths(m.tops, m.top_runs, m.most_groups))
    top = top.join(F.broadcast(m.roots), "tree")  # one row
    top = top.select(F.col("member.group").alias("tree"), F.lower(F.hex("member.leaf")).alias("subroot"), "root", F.col("path").alias("top"))
    top = materialise(top, "merkle-tops")
    rows = _with_paths(m.leaves, _paths(m.leaves, m.runs, m.most)).join(_small(top), "tree")
    names = [f.name for f in m.leaves.schema["members"].dataType.elementType["more"].dataType if f.name != "__"]
    return rows.select(
        F.col("member.id").alias(id_col), F.lower(F.hex("member.leaf")).alias("leaf"), "subroot", "root", F.concat("path", "top").alias("path"), *[F.col(f"member.more.`{c}`").alias(c) for c in names]
    )


def siblings_hash(path: Column) -> Column:
    """SHA-256 (hex) of all hashes of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) and a proof give."""
    return F.aggregate(path, leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def verify(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), found: Column | None = None, id_col: str = "doc_id", group_col: str = "lang"
) -> DataFrame:
    """Every row against the manifest of ``docs``: ``id_col, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``found`` is the leaf (binary) of a row as it is met now; where it is null, or left out, the row is as it was. Null fields
    have a mark of their own, so null and empty texts differ; rows that repeat are leaves of their own; extra columns are
    ignored; an empty table gives no rows.
    """
    found = F.lit(None).cast("binary") if found is None else found
    leaves = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf_hash(*fields).alias("leaf"), found.alias("found"))
    rows = proofs(build(leaves), id_col)
    now = F.coalesce(F.lower(F.hex("found")), F.col("leaf"))
    rows = rows.select(id_col, "leaf", "subroot", "root", siblings_hash(F.col("path")).alias("proof_sha256"), fold(now, F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
