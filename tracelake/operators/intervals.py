"""Intervals: merging, runs, extraction, overlap and containment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.pieces import pieces


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Closed integer intervals of a key, merged where they meet or adjoin. Islands over the running maximum of ends."""
    ordered = Window.partitionBy(*keys).orderBy(start, end)
    top = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(top.isNull() | (top < F.col(start) - 1), 1).otherwise(0)
    island = F.sum("__new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("__new", new).withColumn("__island", island)
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def merge_array(pairs: Column) -> Column:
    """The same for an ``array<array<int>>`` of one row, without a shuffle; null stays null.

    Work is that of two sorts. Of sorted intervals an island begins where a start lies beyond all ends before it. With the
    starts and the ends sorted apart, that is where the k-th start is beyond the end before it: an island is closed when as
    many intervals have ended as have begun. So its first start and last end stand at the same places of the two arrays.
    """
    some = F.filter(pairs, lambda p: p.isNotNull() & p[0].isNotNull() & p[1].isNotNull() & (p[0] <= p[1]))
    starts = F.array_sort(F.transform(some, lambda p: p[0]))
    ends = F.array_sort(F.transform(some, lambda p: p[1]))
    before = F.concat(F.array(F.lit(None).cast("int")), F.transform(ends, lambda e: e + 1))  # one longer: the last end is in
    first = F.filter(F.arrays_zip(starts.alias("s"), before.alias("b")), lambda x: x["s"].isNotNull() & (x["b"].isNull() | (x["s"] > x["b"])))
    after = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), F.array(F.lit(None).cast("int")))
    last = F.filter(F.arrays_zip(ends.alias("e"), after.alias("n")), lambda x: x["e"].isNotNull() & (x["n"].isNull() | (x["n"] > x["e"] + 1)))
    both = F.arrays_zip(F.transform(first, lambda x: x["s"]).alias("s"), F.transform(last, lambda x: x["e"]).alias("e"))
    return F.transform(both, lambda x: F.array(x["s"], x["e"]))


def consecutive_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive whole numbers of a key; a repeated number counts once."""
    d = df.select(*keys, value).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return (
        d.withColumn("__island", island)
        .groupBy(*keys, "__island")
        .agg(F.min(value).alias("run_start"), F.max(value).alias("run_end"), F.count("*").alias("run_length"))
        .drop("__island")
    )


def extract_from_lines(lines: Column, start: Column, end: Column) -> Column:
    """Numbered, non-blank lines of an inclusive range of a row's own lines: no join."""
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("t")))
    some = F.slice(numbered, F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0)))
    kept = F.filter(some, lambda r: F.concat(r["n"].cast("string"), F.lit(": "), r["t"]).rlike(r"(?U)\S"))
    return F.array_join(F.transform(kept, lambda r: F.concat(r["n"].cast("string"), F.lit(": "), r["t"])), "\n")


#: Lines of a bin of a file.
LINES = 32


def extract_by_join(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """``blocks (file, start, end, ...)`` with the content of their lines, for lines that are a table of their own.

    A line is in one bin of its file and a block in those that it touches, so a block meets its own lines and less than two
    bins of others, however large the file. Equal blocks share one result, so each of them gets its own row; a block without
    lines, or with its ends exchanged, has an empty content.
    """
    keys = ["file", "start", "end"]
    bins = F.sequence(*[F.floor(F.col(c) / LINES).cast("long") for c in ("start", "end")])
    b = blocks.select(*keys).where("start <= end").distinct().withColumn("bin", F.explode(bins)).alias("b")
    n = lines.withColumn("bin", F.floor(F.col("line_no") / LINES).cast("long")).alias("n")
    on = (F.col("b.file") == F.col("n.file")) & (F.col("b.bin") == F.col("n.bin")) & F.col("n.line_no").between(F.col("b.start"), F.col("b.end"))
    got = b.join(n, on).select("b.file", "b.start", "b.end", F.struct("n.line_no", F.concat_ws(": ", "n.line_no", "n.text").alias("t")).alias("l"))
    per = got.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda r: r["t"]), "\n").alias("content"))
    return blocks.join(per, keys, "left").withColumn("content", F.coalesce("content", F.lit(""))).select(*blocks.columns, "content")


#: A range covers at most so many bins of its level; the next level's bins are so many times as wide.
SPREAD = 256


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int, start: str = "start", end: str = "end", levels: int = 3, longest: int | None = None) -> DataFrame:
    """Pairs of half-open ranges of a key that overlap, with the part they share.

    Both sides are cut to bins of ``width`` and meet in an equi-join on (key, level, bin); a pair counts in the bin where
    the later of the two starts. Neither a nested-loop join nor a broadcast; ``width`` near the usual length keeps both
    the copies and the pairs tested few. Longer ranges live on levels of wider bins, so one long range makes no flood of
    rows; what is too long for all ``levels`` is cut by the widest bins. A pair meets on the level of its longer range,
    in one of three roles: both live there, or only the left or only the right one does, so two short ranges never
    meet in a wide bin. Shorter ranges have copies only on levels where the other side has ranges; which these are is
    looked up first, a number or two a side, unless ``longest`` tells that no range is longer: then the levels
    that such ranges use are taken. Empty and null ranges meet nothing.
    """
    if longest is not None:
        levels = 1 + next((k for k in range(levels - 1) if longest <= width * SPREAD ** (k + 1)), levels - 1)
    bins = (F.col(end) - F.col(start)) / F.lit(width)
    own = F.lit(levels - 1)
    for k in reversed(range(levels - 1)):
        own = F.when(bins <= SPREAD ** (k + 1), F.lit(k)).otherwise(own)
    sides = [df.where(F.col(end) > F.col(start)) for df in (left, right)]
    used = [list(range(levels))] * 2
    if longest is None and levels > 1:
        found = sides[0].select(F.lit(0), own).unionAll(sides[1].select(F.lit(1), own)).distinct().collect()  # at most ``levels`` a side
        used = [sorted(r[1] for r in found if r[0] == side) for side in (0, 1)]

    def binned(df: DataFrame, side: str, here: list[int], there: list[int], alone: int, guest: int) -> DataFrame:
        """Copies by (level, role): 0 with ranges of its own level, ``alone`` with shorter ones, ``guest`` with longer ones."""
        cols = [F.col(c).alias(c if c == key else f"{side}_{c}") for c in df.columns]
        places = F.array().cast("array<struct<__level: int, __role: int>>")
        for k in here:
            mine = [(k, 0)] * (k in there) + [(k, alone)] * any(v < k for v in there) + [(v, guest) for v in there if v > k]
            if mine:
                mine = F.array(*[F.struct(F.lit(v).alias("__level"), F.lit(r).alias("__role")) for v, r in mine])
                places = F.when(own == k, mine).otherwise(places)
        if here == there == [0]:  # nothing to choose
            df = df.select(*cols, F.lit(0).alias("__level"), F.lit(0).alias("__role"))
        else:
            df = df.select(*cols, F.explode(places).alias("__at")).select("*", "__at.__level", "__at.__role").drop("__at")
        wide = F.lit(width) * F.pow(F.lit(SPREAD), F.col("__level")).cast("long")
        low, high = (F.floor(c / wide).cast("long") for c in (F.col(f"{side}_{start}"), F.col(f"{side}_{end}") - 1))
        return df.withColumn("__bin", F.explode(F.sequence(low, high)))

    ls, le, rs, re = f"l_{start}", f"l_{end}", f"r_{start}", f"r_{end}"
    both = binned(sides[0], "l", used[0], used[1], 1, 2).join(binned(sides[1], "r", used[1], used[0], 2, 1), [key, "__level", "__role", "__bin"])
    first = F.floor(F.greatest(ls, rs) / (F.lit(width) * F.pow(F.lit(SPREAD), F.col("__level")).cast("long"))).cast("long")
    meet = (F.col(le) > F.col(rs)) & (F.col(ls) < F.col(re)) & (F.col("__bin") == first)
    return both.where(meet).drop("__bin", "__level", "__role").withColumns({"clip_start": F.greatest(ls, rs), "clip_end": F.least(le, re)})


#: Bins of the tree in which points look for ranges have 4 ** level places: their numbers are shifts.
BITS = 2


def _bin(x: Column, level: Column | int) -> Column:
    """The bin of a place, by shifts, which round down below zero too."""
    return F.call_function("shiftright", x, (F.lit(level) if isinstance(level, int) else level) * BITS)


def _top(start: Column, end: Column) -> Column:
    """The level whose bins are wider than a closed range."""
    return F.floor(F.log2(F.greatest(end.cast("long") - start.cast("long") + 1, F.lit(1))) / BITS).cast("int") + 1


def _bins(level: Column, start: Column, end: Column) -> Column:
    """Numbers of the bins of a level that lie in a closed range, but for those that wider bins in it take."""
    low, high = start.cast("long"), end.cast("long") + 1

    def between(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))

    first, last = -_bin(-low, level), _bin(high, level)
    up, down = F.shiftleft(-_bin(-low, level + 1), BITS), F.shiftleft(_bin(high, level + 1), BITS)
    return F.when(up < down, F.concat(between(first, up), between(down, last))).otherwise(between(first, last))


def cover(start: Column, end: Column) -> Column:
    """``ARRAY<STRUCT<level, bin>>``: the fewest bins of 4 ** level places that make up a closed range exactly.

    At most six a level, and no level is wider than the range; none where the ends are exchanged, null where one is.
    """

    def on(level: Column) -> Column:
        return F.transform(_bins(level, start, end), lambda x: F.struct(level.alias("level"), x.alias("bin")))

    return F.flatten(F.transform(F.sequence(F.lit(0), _top(start, end)), on))


def _nodes(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """A row a bin of the ranges: their columns, ``__level, __bin``. As ``cover`` has them, but rows from the first on."""
    s, e = F.col(start), F.col(end)
    rows = ranges.where(s <= e).withColumn("__level", F.explode(F.sequence(F.lit(0), _top(s, e))))
    return rows.withColumn("__bin", F.explode(_bins(F.col("__level"), s, e)))


def _asking(points: DataFrame, point: str, ranges: DataFrame, start: str, end: str) -> DataFrame:
    """A row a point and level that the ranges use; the widest is looked up first, one number."""
    s, e = F.col(start), F.col(end)
    top = ranges.where(s <= e).agg(F.max(_top(s, e))).first()[0]
    if top is None:
        return points.withColumns({"__level": F.lit(0), "__bin": F.lit(0).cast("long")}).limit(0)
    rows = points.withColumn("__level", F.explode(F.array(*[F.lit(v) for v in range(top + 1)])))
    return rows.withColumn("__bin", _bin(F.col(point).cast("long"), F.col("__level")))


def stabbing_join(points: DataFrame, ranges: DataFrame, key: str, point: str, start: str = "start", end: str = "end") -> DataFrame:
    """Every point with every closed range of its key that holds it: columns of the points, then of the ranges as ``r_...``.

    A range is cut to the few bins that make it up, a point asks its one bin of every width in use, and both meet in an
    equi-join. As the bins of a range are disjoint, each pair is met once and no other pair is met at all, so a key with very many
    of both costs what its result does. Ranges with exchanged or null ends hold nothing. Neither side is broadcast: sizes before
    ``explode`` say little of those behind it.
    """
    nodes = _nodes(ranges.select(key, *[F.col(c).alias(f"r_{c}") for c in ranges.columns if c != key]), f"r_{start}", f"r_{end}")
    return _asking(points, point, ranges, start, end).join(nodes.hint("merge"), [key, "__level", "__bin"]).drop("__level", "__bin")


def held(points: DataFrame, ranges: DataFrame, key: str, point: str, start: str = "start", end: str = "end") -> DataFrame:
    """``key, point``, distinct, of the points that any range of their key holds: bins of ranges are merged before they meet."""
    nodes = _nodes(ranges.select(key, start, end), start, end).select(key, "__level", "__bin").distinct()
    asked = _asking(points.select(key, point).distinct(), point, ranges, start, end)
    return asked.join(nodes, [key, "__level", "__bin"], "left_semi").select(key, point).distinct()


#: A key of more blocks than this has them in a tree of bins; up to it a point is compared with each.
MANY = 256


def first_enclosing(points: DataFrame, blocks: DataFrame, key: str, point: str, ordinal: str = "ordinal") -> DataFrame:
    """Every row of ``points``, with all its columns, plus ``block_start, block_end``: the first block of its key, by
    ordinal, that holds it; null where none does. Ordinals tell the blocks of a key apart; those that tie go by start and end,
    and a block without one is none. Points of one place are looked up once and each keep their row.

    Keys of more than ``MANY`` blocks, looked up first, have a tree of bins: a bin keeps its first ordinal only, so a point
    meets at most one block a width however many hold it. In the others a point meets at most ``MANY`` blocks.
    """
    named = blocks.where(F.col(ordinal).isNotNull()).select(key, F.col(ordinal).alias("__o"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    asked = points.select(key, point).distinct()
    holds = F.col(point).between(F.col("__s"), F.col("__e"))
    large = named.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > MANY).select(key)
    few = named
    hits = []
    if not large.isEmpty():
        many, few = named.join(large, key, "left_semi"), named.join(large, key, "left_anti")
        nodes = _nodes(many, "__s", "__e").groupBy(key, "__level", "__bin").agg(F.min("__o").alias("__o"))
        met = _asking(asked.join(large, key, "left_semi"), point, many, "__s", "__e").join(nodes, [key, "__level", "__bin"])
        first = met.groupBy(key, point).agg(F.min("__o").alias("__o"))
        hits.append(first.join(many, [key, "__o"]).where(holds).select(key, point, "__o", "__s", "__e"))
    hits.append(asked.join(few, key).where(holds).select(key, point, "__o", "__s", "__e"))
    hit = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
    best = hit.groupBy(key, point).agg(F.min(F.struct("__o", "__s", "__e")).alias("__m"))
    out = points.join(best, [key, point], "left")
    return out.select(*points.columns, F.col("__m.__s").alias("block_start"), F.col("__m.__e").alias("block_end"))


#: A range goes straight to so many bins behind its first; longer ones look up which bins there are.
NEAR = 8


def segments(ranges: DataFrame, key: str, ident: str, width: int = 1 << 16, start: str = "start", end: str = "end") -> DataFrame:
    """``key, start, end, ids``: the pieces that the ends of all half-open ranges of a key cut it to, each with the distinct
    ids of the ranges that cover it, ascending; pieces that none covers are left out. Empty and null ranges cut nothing. Ends
    are whole numbers.

    Ranges are dealt to the bins of ``width`` positions that they touch, in one shuffle, and each bin is cut by the ends in it,
    so a document of any number of ranges is no single task's; only a row for each bin is put in order by key, to learn where its last
    piece ends. A long range goes only to bins with ends, found by ``stabbing_join``: no more rows than pieces that it covers, and its last bin.
    Nothing is broadcast, as sizes before ``explode`` say little of those behind it.
    """
    kind = ranges.select(F.coalesce(start, end)).schema[0].dataType
    at = lambda c: F.call_function("div", F.col(c) - F.pmod(F.col(c), F.lit(width)), F.lit(width)).cast("long")
    ends = {"__s": F.col(start).cast("long"), "__e": F.col(end).cast("long")}
    some = ranges.where(F.col(key).isNotNull() & (F.col(end) > F.col(start))).select(key, F.col(ident).alias("__id"), *[c.alias(n) for n, c in ends.items()])
    some = some.withColumns({"__from": at("__s"), "__to": at("__e")})
    cuts = some.select(key, F.inline(F.array(*[F.struct(F.col(b).alias("__b"), F.col(c).alias("__x")) for b, c in (("__from", "__s"), ("__to", "__e"))])))
    bins = cuts.groupBy(key, "__b").agg(F.min("__x").alias("__x"))
    bins = bins.select(key, "__b", F.lead("__x").over(Window.partitionBy(key).orderBy("__b")).alias("__next"))

    near = F.col("__to") - F.col("__from") <= NEAR
    columns = [key, "__b", "__id", "__s", "__e"]
    laid = some.where(near).withColumn("__b", F.explode(F.sequence("__from", "__to"))).select(*columns)
    far = stabbing_join(bins.select(key, "__b"), some.where(~near), key, "__b", "__from", "__to")
    laid = laid.unionByName(far.select(key, "__b", *[F.col(f"r_{c}").alias(c) for c in columns[2:]])).unionByName(bins, allowMissingColumns=True)
    ordered = laid.repartition(key, "__b").sortWithinPartitions(key, "__b", "__id")
    shape = some.select(key, F.col("__s").alias("start"), F.col("__e").alias("end"), F.array("__id").alias("ids")).schema
    got = ordered.mapInArrow(pieces(width, shape.names), shape)
    return got.select(key, *[F.col(c).cast(kind) for c in ("start", "end")], "ids")


def overlaps(ranges: Column, start: Column, end: Column, document: Column | None = None) -> Column:
    """Whether any range of an array overlaps a half-open one; by document if one is given."""

    def meets(r: Column) -> Column:
        hit = (r["end"] > start) & (r["start"] < end)
        return hit if document is None else hit & (r["documentId"] == document)

    return F.coalesce(F.exists(ranges, meets), F.lit(False))
