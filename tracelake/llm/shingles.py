"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and min-hash find candidates, texts decide.

SimHash fingerprints of the shingles within two bits come from the Gray-order index of ``simhash``. Texts of similarity
0.8 differ in up to a dozen bits, which that index cannot carry, so every text has ``BANDS`` keys of ``ROWS`` minima too. Texts of similarity s share a key with probability 1 - (1 - s**ROWS)**BANDS: all
but 5 of 100 million pairs at 0.8, fewer above. Every pair with a common key is decided by its shingles, in two steps, so
that a large class of copies never gives all its pairs: first each text against one star of its group; then, in groups
that are not of one class yet, the pairs across classes, found by their rare shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import simhash
from tracelake.llm.common import byte_slices, materialise, text_of
from tracelake.llm.exact_dedup import _key, one_row_per_key
from tracelake.llm.simhash import HASH, classes

#: Words of a shingle, smallest similarity of near-duplicates.
WORDS, TENTHS = 5, 8
BANDS, ROWS = 32, 4
#: Two sets of {2} and {3} shingles can be similar if at most the smaller of {0} and {1} are in both.
FITS = f"{10 + TENTHS} * least({{0}}, {{1}}) >= {TENTHS} * ({{2}} + {{3}})"
#: Similar sets differ in at most so many shingles; longs of the parity bits.
PARITY = 8
ODD = [f"odd{k}" for k in range(PARITY)]
CLOSE = f"{10 + TENTHS} * ({' + '.join(f'bit_count({c} ^ {c}2)' for c in ODD)}) <= {10 - TENTHS} * (n + n2)"
CHUNK = 1 << 11
_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, (3, BANDS * ROWS), np.uint64)
#: Odd factors and offsets of the min-hash functions, odd factors of the minima in a key.
FACTOR, OFFSET, MIX = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1], _SEEDS[2] * np.uint64(2) + np.uint64(1)


def digest_of(text: Column) -> Column:
    """What a text is known by: half of its SHA-256, so that no two texts of any corpus are one."""
    return F.unhex(F.left(F.sha2(text, 256), F.lit(32)))


class Names:
    """Short names of texts: 64-bit hashes of their digests, and hashes of another kind for digests that share one.

    Such digests are looked for among all and listed; of n texts there are about n * n / 2**64, three in ten thousand million.
    """

    def __init__(self, digests: DataFrame, bits: int = 64):
        self.bits = bits  # fewer of them only make more texts share a name
        shared = digests.groupBy(self._plain(F.col("digest")).alias("node")).agg(F.count("*").alias("c"), F.collect_list("digest").alias("d")).where("c > 1")
        self.listed = [bytes(x) for r in shared.select("d").collect() for x in r["d"]]

    def _plain(self, digest: Column) -> Column:
        return F.shiftright(F.xxhash64(digest), 64 - self.bits)

    def of(self, digest: Column) -> Column:
        plain = self._plain(digest)
        return F.when(digest.isin(self.listed), F.xxhash64(digest, F.lit(1))).otherwise(plain) if self.listed else plain


def shingles(text: bytes, k: int = WORDS) -> set[bytes]:
    """Distinct shingles of k words in lower case; a shorter text is one shingle."""
    words = text.lower().split()
    if len(words) < k:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[j:] for j in range(k)))))


def similar(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity is at least ``TENTHS`` / 10, in whole numbers."""
    both = len(a & b)
    return 10 * both >= TENTHS * (len(a) + len(b) - both)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band, of the hashes of a text's shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK, None] * FACTOR
        part += OFFSET
        np.minimum(least, part.min(axis=0), out=least)
    mixed = (least ^ least >> np.uint64(29)) * MIX
    keys = (mixed ^ mixed >> np.uint64(32)).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, sizes, prints = [], [], []
        for x in b.column(2):
            grams = shingles(x.as_py())
            hashes = np.fromiter(map(HASH, grams), np.uint64, len(grams))
            keys.append(band_keys(hashes))
            sizes.append(len(grams))
            prints.append(simhash.majority(sum(simhash.ones_of(hashes[at : at + CHUNK]) for at in range(0, len(hashes), CHUNK)), len(hashes)))
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, np.int32)), pa.array(flat))
        fps = pa.array(np.array(prints, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), fps, lists], ["id", "digest", "n", "fp", "keys"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, grams = None, set()
    for b in batches:
        ok = []
        for x, y in zip(b.column(2), b.column(3)):
            if (x := x.as_py()) != last:
                last, grams = x, shingles(x)
            ok.append(similar(grams, shingles(y.as_py())))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bits that say which buckets hold an odd number of shingles. Two sets differ in one shingle at least per differing bit."""
    n = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY)
    return np.packbits((n & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for slim in byte_slices(b, 2, 1 << 20):
            grams = [np.fromiter(map(HASH, shingles(x.as_py())), np.uint64) for x in slim.column(2)]
            odd = [pa.array([p[k] for p in map(parity, grams)], pa.int64()) for k in range(PARITY)]
            grams = pa.array([g.view(np.int64) for g in grams], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*slim.columns[:2], grams, *odd], ["node", "label", "grams", *ODD])


def _across(members: DataFrame, docs: DataFrame, text_col: str, names: Names) -> DataFrame:
    """``a, b``: pairs of ``members (node, label)`` of different labels, all that can be similar.

    Shingles of one member only are in no pair. Of the c others a similar text has at least 0.8 * n, so the two
    share one of the first c - 0.8 * n + 1 in any order that is the same for all; rare ones come first. Of the pairs that
    meet so, those go whose sizes or parity bits rule the similarity out.
    """
    rows = _texts(members.select("node"), docs, text_col, names).join(members, "node").select("node", "label", "text")
    rows = rows.mapInArrow(_grams, "node long, label long, grams array<long>, " + ", ".join(f"{c} long" for c in ODD))
    rows = materialise(rows.withColumn("n", F.size("grams")), "shingles-grams")
    odd = rows.drop("grams", "label", "n")
    rows = rows.select("node", "label", "n", F.explode("grams").alias("gram"))
    often = rows.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    rows = rows.join(often, "gram").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    rows = rows.withColumn("c", F.size("g")).withColumn("first", F.expr("c - ceil(n * %d / 10D) + 1" % TENTHS).cast("int")).where("first > 0")
    rows = rows.select("node", "label", "n", "c", F.explode(F.expr("slice(g, 1, first)")).alias("g")).withColumn("gram", F.col("g.gram")).drop("g")
    rows = materialise(rows, "shingles-first")
    mixed = rows.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    rows = rows.join(mixed.select("gram"), "gram", "left_semi").join(odd, "node")
    other = rows.select("gram", *[F.col(c).alias(f"{c}2") for c in ("node", "label", "n", "c", *ODD)])
    pairs = rows.join(other, "gram").where("node < node2 and label <> label2").where(FITS.format("c", "c2", "n", "n2")).where(CLOSE)
    return pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def _texts(nodes: DataFrame, docs: DataFrame, text_col: str, names: Names) -> DataFrame:
    """``node, text`` of the distinct texts that ``nodes (node)`` name."""
    texts = docs.select(names.of(digest_of(text_of(text_col))).alias("node"), text_of(text_col).cast("binary").alias("text"))
    return texts.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _similar_pairs(pairs: DataFrame, docs: DataFrame, text_col: str, names: Names) -> DataFrame:
    """Those of ``pairs (a, b)`` whose texts are similar; only texts that occur in pairs are moved."""
    members = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = materialise(_texts(members, docs, text_col, names), "shingles-texts")
    rows = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    rows = rows.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return rows.select("a", "b", "x", "y").mapInArrow(_decide, "a long, b long")


def _alike(single: DataFrame) -> DataFrame:
    """``a, b``: texts of fingerprints within the radius of the index; each against the first text of its own and of a linked print."""
    prints = materialise(single.groupBy("fp").agg(F.min("node").alias("node")), "shingles-prints")
    own = single.select("fp", F.col("node").alias("a")).join(prints, "fp").select("a", F.col("node").alias("b"))
    linked = simhash.links(prints.select("fp"))
    for side in ("a", "b"):
        linked = linked.join(prints.select(F.col("fp").alias(side), F.col("node").alias(f"{side}_node")), side)
    both = own.union(linked.select("a_node", "b_node")).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, node, root`` of every row: digest and name of the text and the name of its class of similar texts (null where
    it is alone).

    Null text counts as empty; texts without words are similar. Repeated rows are of one class.
    """
    rows = docs.select(F.col(id_col).alias("id"), digest_of(text_of(text_col)).alias("digest"), text_of(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = materialise(rows.mapInArrow(_sketch, f"id {kind}, digest binary, n long, fp long, keys array<long>"), "shingles")
    names = Names(rows.select("digest").distinct())
    rows = rows.withColumn("node", names.of(F.col("digest")))
    single = rows.dropDuplicates(["node"])
    nodes = single.select("node", "n", F.posexplode("keys").alias("band", "key"))
    groups = nodes.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    nodes = materialise(nodes.join(groups, ["band", "key"]), "shingles-groups")
    # The star of a group is the member that meets most others: in a class of copies, the text they were made of.
    met = nodes.join(nodes.groupBy("node").agg(F.sum("size").alias("met")), "node")
    star = met.groupBy("band", "key").agg(F.max(F.struct("met", "node", "n")).alias("m"))
    stars = nodes.join(star, ["band", "key"]).where("node <> m.node").where(FITS.format("n", "m.n", "n", "m.n"))
    stars = stars.select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b"))
    stars = materialise(stars.union(_alike(single)).distinct(), "shingles-pairs")
    links = materialise(_similar_pairs(stars, docs, text_col, names), "shingles-links")
    of = classes(links, "shingles-classes")
    labelled = nodes.join(of, "node", "left").select("node", "band", "key", F.coalesce("root", "node").alias("label"))
    mixed = labelled.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    members = labelled.join(mixed, ["band", "key"], "left_semi").select("node", "label").distinct()
    across = _across(materialise(members, "shingles-mixed"), docs, text_col, names).join(stars, ["a", "b"], "left_anti")
    across = materialise(across, "shingles-pairs")
    if across.count():
        of = classes(links.union(_similar_pairs(across, docs, text_col, names)), "shingles-classes")
    return rows.select("id", "digest", "node").join(of, "node", "left").select("id", "digest", "node", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every class of near-duplicates, that with the smallest id, with the columns of ``docs``.

    A null id loses to any other. Of rows with that id in a class the text of the smallest hash stays, and of those that
    repeat it the row whose columns hash smallest, so reruns agree. Null and empty texts are a class. An empty table gives
    no rows.
    """
    found = near_duplicates(docs, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest"))
    stay = found.groupBy(F.coalesce("root", "node").alias("class")).agg(first.alias("f"))
    stay = stay.select(_key(F.col("f.id")).alias("__id"), F.col("f.digest").alias("__digest"))
    return one_row_per_key(docs, digest_of(text_of(text_col)), stay, id_col)
