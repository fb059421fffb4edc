"""SimHash near-duplicates through a Gray-order hierarchical index, exact for a radius of two bits.

Two fingerprints that differ in at most two of 64 bits agree in at least two of the four 16-bit segments. For
each pair of segments (a view) fingerprints are therefore grouped by their masked bits: the upper nodes of the
index, factored out once for all members, and with no difference accumulated. Inside a group members are sorted
by Gray rank, and nodes below are the shared prefixes of 4 more bits each. A pair of nodes is followed only while
the differences accumulated on the way down stay within the radius, so whole groups are pruned at once. Groups
that are too large for one task are cut by a third shared part of their remaining bits; what then remains is
bounded by the number of bits left (2**22 members). Each group reports a star of links for every class inside it,
never all its pairs. Classes of all groups are joined by the large-star, small-star algorithm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tracelake.llm.common import materialise, text_of, with_row_id

RADIUS = 2
#: Pairs of the four 16-bit segments, highest bits first.
VIEWS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
#: Parts of the 32 bits that a view leaves, for groups that are cut: (shift, bits).
CUTS = [(21, 11), (10, 11), (0, 10)]
HASH = partial(xxh64_intdigest, seed=42)
CHUNK = 1 << 16


def fingerprint(text: bytes, k: int) -> int:
    """Majority bits of the hashes of k-word shingles, repeats included; shingles are hashed in chunks."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < k:
        return HASH(b" ".join(words))
    n, ones = len(words) - k + 1, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + k - 1]
        grams = map(b" ".join, zip(*(part[j:] for j in range(k))))
        ones += ones_of(np.fromiter(map(HASH, grams), np.uint64, len(part) - k + 1))
    return majority(ones, n)


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes."""
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(x.as_py() or b"", k) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got.view(np.int64))], ["id", "hash", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """``rid, id, hash, fp`` of every row (hash of the text), written once."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("hash"))
    kind = rows.schema["id"].dataType.simpleString()
    return materialise(with_row_id(rows.mapInArrow(_fingerprints(k), f"id {kind}, hash long, fp long")), "simhash")


def _bits(value: Column, shift: int, n: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << n) - 1))


def _views(fps: DataFrame, cut_above: int) -> DataFrame:
    """``view, key, part, sub, rest, fp``: the groups of the index, large ones cut; rest is what the mask leaves."""

    def halves(view: int) -> Column:
        seg = [_bits(F.col("fp"), 48 - 16 * s, 16) for s in range(4)]
        a, b = VIEWS[view]
        c, d = (s for s in range(4) if s not in (a, b))
        return F.struct(
            F.lit(view).alias("view"),
            (seg[a] * 65536 + seg[b]).alias("key"),
            (seg[c] * 65536 + seg[d]).alias("rest"),
        )

    rows = fps.select("fp", F.explode(F.array(*[halves(v) for v in range(len(VIEWS))])).alias("g")).select("fp", "g.*")
    sizes = rows.groupBy("view", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["view", "key"])
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("sub")))
    cut = F.array(
        *[F.struct(F.lit(i + 1).alias("part"), _bits(F.col("rest"), shift, n).alias("sub")) for i, (shift, n) in enumerate(CUTS)]
    )
    return rows.select("view", "key", "rest", "fp", F.explode(F.when(F.col("n") > cut_above, cut).otherwise(whole)).alias("p")).select(
        "view", "key", "p.*", "rest", "fp"
    )


def _gray_rank(value: Column) -> Column:
    for shift in (1, 2, 4, 8, 16):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, shift))
    return value


def _expand(left: np.ndarray, right: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Pairs of children of pairs of nodes, a node with itself once: positions of children."""
    na, nb = end[left] - start[left], end[right] - start[right]
    n = na * nb
    pair = np.repeat(np.arange(len(left)), n)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    a, b = start[left][pair] + at // nb[pair], start[right][pair] + at % nb[pair]
    ok = (left[pair] != right[pair]) | (a <= b)
    return a[ok], b[ok]


def group_links(group: np.ndarray, rest: np.ndarray, radius: int = RADIUS, width: int = 1 << 21) -> np.ndarray:
    """Class label (a position) of every member; ``group`` numbers the groups in order, ``rest`` is in Gray order.

    Walks pairs of nodes from the upper nodes down, ``width`` pairs at a time.
    """
    n = len(rest)
    label = np.arange(n)
    if n < 2:
        return label
    levels = []  # of nodes: first child in the next level, pattern so far
    cuts = [np.flatnonzero(np.r_[True, group[1:] != group[:-1]])]
    for bits in range(4, 33, 4):
        prefix = rest >> np.uint64(32 - bits)
        cuts.append(np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (prefix[1:] != prefix[:-1])]))
        levels.append(prefix[cuts[-1]])
    first = [np.searchsorted(cuts[i + 1], cuts[i]) for i in range(len(levels))]
    last = [np.r_[f[1:], len(cuts[i + 1])] for i, f in enumerate(first)]
    roots = np.arange(len(cuts[0]))
    stack = [(0, roots, roots)]
    while stack:
        depth, a, b = stack.pop()
        if depth == len(levels):
            # Leaves: positions cuts[-1] hold the distinct values.
            _join(label, cuts[-1][a[a != b]], cuts[-1][b[a != b]])
            continue
        fan = (last[depth][a] - first[depth][a]) * (last[depth][b] - first[depth][b])
        if len(a) > 1 and fan.sum() > width:
            half = len(a) // 2
            stack += [(depth, a[:half], b[:half]), (depth, a[half:], b[half:])]
            continue
        if depth:
            # A node of one member has no pair with itself.
            more = (a != b) | (np.diff(cuts[depth], append=n)[a] > 1)
            a, b = a[more], b[more]
        a, b = _expand(a, b, first[depth], last[depth])
        near = np.bitwise_count(levels[depth][a] ^ levels[depth][b]) <= radius
        if near.any():
            stack.append((depth + 1, a[near], b[near]))
    return label


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of linked positions: smallest labels win, then every label is followed to its root."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label[:] = up


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of links of the groups of one partition, which come sorted; a group is handled as soon as it is whole."""

    def stars(t: pa.Table) -> pa.RecordBatch:
        rest, fp = (t.column(c).to_numpy() for c in ("rest", "fp"))
        # The hash only brings a group together; what parts groups are its columns.
        parts = [t.column(c).to_numpy() for c in ("view", "key", "part", "sub")]
        group = np.cumsum(np.r_[False, np.any([x[1:] != x[:-1] for x in parts], axis=0)])
        label = group_links(group, rest.astype(np.uint64))
        far = label != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[label[far]])], ["a", "b"])

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        gid = batch.column(0)
        if kept and kept[0].column(0)[0].as_py() != gid[len(gid) - 1].as_py():
            ids = gid.to_numpy()
            whole = int(np.flatnonzero(ids == ids[-1])[0])
            yield stars(pa.Table.from_batches([*kept, batch.slice(0, whole)]))
            kept = [batch.slice(whole)]
        else:
            kept.append(batch)
    if kept:
        yield stars(pa.Table.from_batches(kept))


def links(fps: DataFrame, cut_above: int = 50_000) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that connect what is within the radius."""
    rows = _views(fps, cut_above).withColumn("gid", F.xxhash64("view", "key", "part", "sub"))
    rows = rows.withColumn("gray", _gray_rank(F.col("rest"))).select("gid", "view", "key", "part", "sub", "rest", "fp", "gray")
    rows = rows.repartition("gid").sortWithinPartitions("gid", "view", "key", "part", "sub", "gray")
    return rows.select("gid", "view", "key", "part", "sub", "rest", "fp").mapInArrow(_links, "a long, b long").where("a <> b").distinct()


def classes(edges: DataFrame, tag: str = "classes") -> DataFrame:
    """``node, root``: the smallest node of the class of every linked node; ``edges (a, b)`` of any order.

    Large-star and small-star rounds, each written to the shared folder, until the links stay the same. A node
    with very many links is a skewed side of an ordinary join, which adaptive execution splits.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        if small:
            pairs = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            low = pairs.groupBy("u").agg(F.min("v").alias("m"))
            out = pairs.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            return out.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        pairs = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = pairs.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("decimal(38,0)"))).first()
        return tuple(r)

    edges = materialise(edges, tag)
    before = mark(edges)
    while before[0]:
        edges = materialise(star(star(edges, False), True), tag)
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, cut_above: int = 50_000
) -> DataFrame:
    """One row per input row: ``rid, id_col, hash, fp, component_id`` (smallest id of the class, null if all are null).

    Null text counts as empty; texts without words have fingerprint zero and link like any other. Repeated rows
    are of one class. An empty table gives no rows; extra columns are ignored.
    """
    rows = fingerprints(docs, id_col, text_col, k)
    distinct = materialise(rows.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-distinct")
    of = classes(links(distinct.select("fp"), cut_above), "simhash-classes")
    fps = distinct.join(of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = fps.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = fps.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("rid", F.col("id").alias(id_col), "hash", "fp", "component_id")
