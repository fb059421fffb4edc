"""SpotSigs fingerprints: a signature is a common word, the anchor, and the chain of content words that follow it.

The set of signatures of a text is its fingerprint, 64 bits each; texts that are alike share signatures whatever stands
around the shared passages. Sets are compared by Jaccard similarity. For all similar pairs of a corpus, sets are partitioned
by their length, as lengths of similar sets are alike; a set meets those of its own and of the next shorter partition through
its rarest signatures only, and bounds by length prune what is left before sets are compared.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tracelake.llm.common import byte_slices, materialise, text_of, with_row_id
from tracelake.llm.simhash import classes

#: Common words of English, German, French and Spanish. Another set can take their place.
ANCHORS = frozenset(
    "the a an of to in is was and that for on "
    "der die das den dem und von zu ist ein eine mit "
    "le la les un une des de du et est en que "
    "el los las una del y es".split()
)
#: Content words of a chain, and every how many-th content word is one.
CHAIN, SPOT = 2, 1
WORD = re.compile(r"\w+")
ROWS = 200_000


def signatures(text: str, anchors: frozenset[str] = ANCHORS, chain: int = CHAIN, spot: int = SPOT) -> np.ndarray:
    """Sorted distinct signatures of a text (uint64). A text without a whole chain has one signature, that of all its words,
    so no text has none and texts without words are alike."""
    content: list[str] = []
    pending: list[tuple[str, int]] = []
    for w in WORD.findall(text.lower()):
        if w in anchors:
            pending.append((w, len(content)))
        else:
            content.append(w)
    reach = (chain - 1) * spot
    found = {xxh64_intdigest(" ".join((w, *content[k : k + reach + 1 : spot]))) for w, k in pending if k + reach < len(content)}
    if not found:
        found = {xxh64_intdigest("\n" + " ".join(WORD.findall(text.lower())))}
    out = np.fromiter(found, np.uint64, len(found))
    out.sort()
    return out


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two fingerprints; zero without a look at them where their lengths rule ``least`` out."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(prints: np.ndarray) -> str:
    """A fingerprint as text: 16 hex digits a signature, ascending."""
    return prints.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first characters of another, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _texts(column: pa.Array) -> list[str]:
    return [x.as_py().decode("utf-8", "replace") for x in column]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in byte_slices(batch, 2, 1 << 22):
            found = [signatures(t).view(np.int64) for t in _texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(found, pa.list_(pa.int64()))], ["rid", "id", "signatures"])


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a bucket in order, and the first one of the next, to what each has in common with its edited text and with
    the next one. Holds two texts."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    bucket, key, text, prints = None, None, None, None  # the row that waits for its next one
    for batch in batches:
        for b in byte_slices(batch, 3, 1 << 22):
            ids, rows = [], []
            buckets, ahead = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k, now in enumerate(_texts(b.column(3))):
                if ahead[k] and bucket is None:
                    continue  # of equal first ids all rows come, one is enough
                mine = prints if text == now else signatures(now)
                if bucket is not None:
                    other = edited(text, now)
                    changed = prints if other == text else signatures(other)
                    digest = hashlib.sha256(other.encode()).hexdigest()
                    rows.append((len(text), digest, as_text(prints), as_text(changed), likeness(prints, changed), likeness(prints, mine)))
                    ids.append(key)
                bucket, key, text, prints = (None, None, None, None) if ahead[k] else (buckets[k], b.column(2)[k].as_py(), now, mine)
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(2).type), *map(pa.array, cols, types)], names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rid, id_col, signatures`` (64-bit, as longs) of every row. Null counts as empty; extra columns are ignored."""
    rows = with_row_id(docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("rid", "id", "text").mapInArrow(_prints, f"rid long, id {kind}, signatures array<long>")
    return found.withColumnRenamed("id", id_col) if id_col != "id" else found


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = ROWS) -> DataFrame:
    """Every row with its edited text and its next row: ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    Rows ascend by id, null first, rows of one id by the hash of their text; after the last comes the first. Texts move once:
    buckets are ranges of ids, found from the ids alone, and the first row of a bucket goes to the bucket before it too. Null
    counts as empty; texts without words are alike (1.0); one row alone is its own next; an empty table gives no rows; extra
    columns are ignored.
    """
    spark = docs.sparkSession
    ids = materialise(docs.select(F.col(id_col).alias("id")), "spotsigs-ids")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // rows_per_bucket))
    ranges = ids.repartitionByRange(n, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("id"))["id"].alias("id"))
    # One id a bucket: as many as Spark's own range sort takes through the driver.
    firsts = sorted(((r["id"] is not None, r["id"]) for r in ranges.collect()), key=lambda x: (x[0], x[1] if x[0] else 0))
    somewhere, none = [x for ok, x in firsts if ok], sum(not ok for ok, _ in firsts)
    last = len(firsts) - 1

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(values: pa.Array) -> pa.Array:
        """Its bucket; behind it, for a row that opens one, the bucket before, which for the first is the last."""
        out = []
        for v in values.to_pylist():
            k = 0 if v is None else bisect.bisect_right(somewhere, v)
            at = max(0, k + none - 1)
            opens = none > 0 if v is None else k > 0 and somewhere[k - 1] == v
            out.append([at, at - 1 if at else last] if opens else [at])
        return pa.array(out, pa.list_(pa.int32()))

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.select("id", "text", "tie", F.posexplode(places(F.col("id"))).alias("ahead", "bucket")).withColumn("ahead", F.col("ahead") == 1)
    rows = rows.repartitionById(max(1, len(firsts)), F.col("bucket")).sortWithinPartitions("bucket", "ahead", "id", "tie")
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("bucket", "ahead", "id", "text").mapInArrow(
        _in_turn, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def _pairs(rows: DataFrame, least: float) -> DataFrame:
    """``a, b``: pairs of sets that meet in a partition of lengths through a signature of their prefixes, pruned by length.

    ``rows (node, label, n, part, sig, at)``. Of two similar sets the longer is in the partition of the shorter or in the next.
    """
    other = rows.select("sig", F.col("node").alias("node2"), F.col("label").alias("label2"), F.col("n").alias("n2"), F.col("part").alias("part2"), F.col("at").alias("at2"))
    asks = rows.withColumn("part2", F.explode(F.array(F.col("part"), F.col("part") - 1)))
    met = asks.join(other, ["sig", "part2"]).where("label <> label2 and (part <> part2 or node < node2)")
    most = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))  # what can still be shared from here on
    met = met.where(F.least("n", "n2") >= F.lit(least) * F.greatest("n", "n2"))
    met = met.where(most * (1 + least) >= F.lit(least) * (F.col("n") + F.col("n2")) - 1e-6)
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("signatures").alias("x")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("signatures").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return rows.where(both >= F.lit(least) * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """``id_col, class_id`` of every row: the smallest id of the texts that chains of pairs with likeness ``least`` reach.

    Texts of equal signatures are one set, so copies cost nothing. Every other set is first compared with one star of each
    group that shares a prefix signature; pairs across the classes that this leaves are then compared one by one, so a large
    class does not give all its pairs. A null id loses; a class of null ids only has a null ``class_id``; null texts are empty;
    an empty table gives no rows.
    """
    prints = fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    prints = materialise(prints, "spotsigs-prints")
    sets = materialise(prints.groupBy("signatures").agg(F.min("rid").alias("node"), F.min("id").alias("least_id")), "spotsigs-sets")
    rows = sets.select("node", F.size("signatures").alias("n"), F.explode("signatures").alias("sig"))
    often = rows.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    rare = rows.join(often, "sig", "left").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "sig"))).alias("g"))
    first = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    part = F.floor(F.log(F.col("n")) / F.lit(-math.log(least)) + 1e-9).cast("int")
    rare = rare.select("node", "n", part.alias("part"), F.posexplode(F.slice("g", F.lit(1), first.cast("int"))).alias("at", "g")).where("g.df > 1")
    rows = materialise(rare.select("node", "n", "part", F.col("g.sig").alias("sig"), "at"), "spotsigs-prefixes")

    star = rows.groupBy("part", "sig").agg(F.max(F.struct("n", "node")).alias("m"), F.count("*").alias("c")).where("c > 1")
    stars = rows.join(star, ["part", "sig"]).where("node <> m.node").where(F.least("n", "m.n") >= F.lit(least) * F.greatest("n", "m.n"))
    stars = materialise(stars.select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b")).distinct(), "spotsigs-pairs")
    links = materialise(_alike(stars, sets, least), "spotsigs-links")
    of = classes(links, "spotsigs-classes")
    labelled = rows.join(of, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    across = _pairs(labelled, least).join(stars, ["a", "b"], "left_anti")
    of = classes(links.union(_alike(materialise(across, "spotsigs-pairs"), sets, least)), "spotsigs-classes")
    named = sets.join(of, "node", "left").select("signatures", "least_id", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    named = named.join(ids, "root").select("signatures", "class_id")
    return prints.join(named, "signatures").select(F.col("id").alias(id_col), "class_id")
