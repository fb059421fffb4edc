"""Mixing sources to target weights.

Words of each source are packed, document after document, into blocks of a fixed number of words, a smaller one where a
source would have few blocks. Every source
gets a number of slots that meets its target; its slots are drawn to output shards by a multinomial draw, so
each shard holds multinomial source counts whose sums over the shards are the slots of the sources. Slot j of
a source with n blocks reads block ``permutation[j // n](j % n)``: a pseudorandom permutation of the indices
for each epoch, so a block comes back only after all others were read. Slots and blocks are joined by index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import materialise, parts_for, with_row_id

WORD = r"[^\x20\x09-\x0D]+"


#: Sources of a range that one task numbers.
RANGE_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total_ratio: float, most: float) -> DataFrame:
    """``sizes (source, source_size)`` -> plus ``rank, weight, target``; one row per source, however many there are.

    Targets share ``total_ratio`` of all words by weight, none above ``most`` times its source. The excess is
    reshared by weight until none is above, which is the level L with sum(min(cap, L * weight)) = total. From below L
    rises to it: each step caps what the level of the step before is above, until nothing new is capped.
    """
    n = len(weights)
    count, words = sizes.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    # Numbers by range: those of the ranges before, and the place in the range.
    ranged = sizes.repartitionByRange(parts_for(count, RANGE_SOURCES), F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = materialise(ranged, "mix-sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    t = ranged.withColumn("place", place).join(F.broadcast(starts), "range").withColumn("rank", (F.col("start") + F.col("place") - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(n)) + 1).cast("int"))
    t = t.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).select("source", "source_size", "rank", "weight", "cap")
    t = materialise(t, "mix-weights")
    total, level, capped = words * float(total_ratio), 0.0, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        now, used, free = t.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        if now == capped or not free:
            break
        capped, level = now, (total - used) / free
    target = F.when(F.lit(not free), F.col("cap")).otherwise(F.least("cap", F.lit(level) * F.col("weight")))
    return t.select("source", "source_size", "rank", "weight", target.alias("target"))


#: Buckets of a source at least, so that tasks are even on small tables too.
LEAST_BUCKETS = 256


#: A source of fewer words than so many blocks hold is cut to at least so many shorter ones, as far as it has words: in few
#: blocks a small source would miss its target.
FEW_BLOCKS, SMALL_BLOCKS = 10, 64


def _block_length(source_size: Column, block_words: int) -> Column:
    """Words of a block of a source: ``block_words``, or fewer for a small one."""
    small = F.greatest(F.lit(1), F.floor(source_size / SMALL_BLOCKS))
    return F.when(source_size < FEW_BLOCKS * block_words, F.least(F.lit(block_words), small)).otherwise(F.lit(block_words)).cast("long")


def _quota(block_words: int, most: float) -> tuple[Column, Column, Column]:
    """``blocks, slots, limit`` of a source from its ``source_size, target``: its blocks, the slots that it gets, and of how many
    words its last slot is, if that is a part of a block."""
    size, target = F.col("source_size"), F.col("target")
    blocks = F.ceil(size / _block_length(size, block_words)).cast("long")
    full = F.least(F.floor(target * blocks / size + 1e-9), F.floor(blocks * F.lit(float(most)))).cast("long")
    rest = F.round(target - full * size / blocks).cast("long")
    part = (rest > 0) & (full < F.floor(blocks * F.lit(float(most))))
    return blocks, full + F.when(part, 1).otherwise(0), F.when(part, rest)


def offsets(docs: DataFrame, id_col: str, text_col: str, source_col: str, rows_per_bucket: int, rid_col: str | None = None) -> DataFrame:
    """``rid, id, source, size, offset`` of every row; the offset is that of its first word in its source.

    Offsets are running sums in the order of (bucket of the id, id, text hash). A source is cut to buckets, whose
    totals are summed first, so that no source has to pass one task however large it is.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = [
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("hash"),
    ]
    base = docs.select(*cols, F.col(rid_col).alias("rid")) if rid_col else with_row_id(docs.select(*cols))
    base = materialise(base, "mix-sizes")
    buckets = parts_for(base.count(), rows_per_bucket, LEAST_BUCKETS)
    base = base.withColumn("bucket", F.pmod(F.xxhash64("id", "hash"), F.lit(buckets)))
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("id", "hash", "rid")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    rows = base.withColumn("inside", running).alias("b").join(
        starts.alias("s"),
        F.col("b.source").eqNullSafe(F.col("s.source")) & (F.col("b.bucket") == F.col("s.bucket")),
    )
    rows = rows.select("rid", "id", "b.source", "size", (F.col("start") + F.col("inside")).alias("offset"))
    return materialise(rows, "mix-offsets")


def _ranked(rows: DataFrame, targets: DataFrame, block_words: int, most: float) -> DataFrame:
    """``rows`` that have words with the ``rank`` of their source, the length of its blocks, ``per``, its ``last`` slot and the
    ``limit`` of that (null: a whole block)."""
    _, slots, limit = _quota(block_words, most)
    per = _block_length(F.col("source_size"), block_words)
    of = targets.where("source_size > 0").select(F.col("source").alias("of"), "rank", per.alias("per"), (slots - 1).alias("last"), limit.alias("limit"))
    return rows.where("size > 0").join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _spanned() -> Column:
    """Blocks that a row's words lie in, from its ``offset, size, per``."""
    return F.sequence(*[F.floor(x / F.col("per")).cast("long") for x in (F.col("offset"), F.col("offset") + F.col("size") - 1)])


def pack_blocks(rows: DataFrame, targets: DataFrame, block_words: int, most: float = 2.0) -> DataFrame:
    """``rank, source, block, rid, from_word, to_word, at, last, limit``: the pieces of documents that make up the blocks of
    sources, and where in its block a piece begins."""
    pieces = _ranked(rows, targets, block_words, most).withColumn("block", F.explode(_spanned()))
    low = F.col("block") * F.col("per")
    first, last = F.greatest(low - F.col("offset"), F.lit(0)), F.least(low + F.col("per") - F.col("offset"), F.col("size"))
    at = F.greatest(F.col("offset") - low, F.lit(0))
    return pieces.select("rank", "source", "block", "rid", first.alias("from_word"), last.alias("to_word"), at.alias("at"), "last", "limit")


def _shard_counts(shards: int, seed: int):
    """Per source row: its slots drawn to the shards (multinomial), as runs of slot numbers; shards without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rank, blocks, slots in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rng = np.random.default_rng([seed, rank])
                if slots < shards:  # the same draw, slot by slot
                    at, draw = np.unique(rng.integers(0, shards, slots), return_counts=True)
                else:
                    draw = rng.multinomial(slots, np.full(shards, 1 / shards))
                    at = np.flatnonzero(draw)
                    draw = draw[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), rank, np.int32)),
                        pa.array(np.full(len(at), blocks, np.int64)),
                        pa.array(at.astype(np.int32)),
                        pa.array(np.cumsum(draw) - draw),
                        pa.array(draw.astype(np.int64)),
                    ],
                    ["rank", "blocks", "shard", "first", "n"],
                )

    return run


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0 .. n-1, one for each key, takes the index.

    A keyed four-round Feistel network on the next even number of bits, walked until the value is below n.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo, top = index.astype(np.uint64), np.ones(len(index), bool), n.astype(np.uint64)
    while todo.any():
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            mix = (right + key[todo] + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, (left ^ (mix >> np.uint64(31))) & mask[todo]
        out[todo] = (left << half[todo]) | right
        todo &= out >= top
    return out.astype(np.int64)


def _slot_blocks(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, blocks, shard, slot = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            epoch = slot // blocks
            salt = np.uint64(zlib.crc32(str(seed).encode()))
            key = (rank.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (
                (epoch.astype(np.uint64) + salt) * np.uint64(0x165667B19E3779F9)
            )
            block = permuted(slot - epoch * blocks, blocks, key)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(block)], ["rank", "shard", "slot", "block"]
            )

    return run


def draw_slots(targets: DataFrame, block_words: int, most: float, shards: int, seed: int) -> DataFrame:
    """``(rank, shard, slot, block)``: every slot of every shard with the block index that it reads."""
    blocks, wanted, _ = _quota(block_words, most)
    plan = targets.where("source_size > 0").select("rank", blocks.alias("blocks"), wanted.alias("slots"))
    counts = plan.mapInArrow(_shard_counts(shards, seed), "rank int, blocks long, shard int, first long, n long")
    # A run is cut to pieces, and these are dealt out, before it becomes slots: a shard may be long.
    cut = 100_000
    runs = counts.where("n > 0").select(
        "rank", "blocks", "shard", "first", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(cut))).alias("at")
    )
    runs = runs.repartition("rank", "shard", "at")
    slots = runs.select(
        "rank",
        "blocks",
        "shard",
        F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("n"), F.col("at") + cut) - 1)).alias("slot"),
    )
    return slots.mapInArrow(_slot_blocks(seed), "rank int, shard int, slot long, block long")


#: Words of an output shard, about.
SHARD_WORDS = 100_000_000


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    total_ratio: float = 1.5,
    most: float = 2.0,
    block_words: int = 64,
    shards: int | None = None,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_bucket: int = 50_000,
    rid_col: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, targets, slots)`` of a mix: the documents with size and offset, the sources with their targets,
    and the mixed output as ``rank, source, shard, slot, rid, from_word, to_word`` (words of a document).

    Null text has no words; a null source is a source of its own, last in order. Documents without words and
    sources without words take nothing. Repeated rows are rows of their own. An empty table gives empty results.
    Without ``shards`` there are 64, or so many that a shard gets about ``SHARD_WORDS`` words. ``rid_col`` names a key of
    the rows, for those who join the result with texts (see ``mix_text``).
    """
    rows = offsets(docs, id_col, text_col, source_col, rows_per_bucket, rid_col)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, total_ratio, most), "mix-targets")
    if shards is None:
        shards = parts_for(int(targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]), SHARD_WORDS, 64)
    slots = draw_slots(targets, block_words, most, shards, seed)
    # Spark sees only the few rows that slots are made from, so it would broadcast them.
    mixed = slots.hint("merge").join(pack_blocks(rows, targets, block_words, most), ["rank", "block"])
    cut = F.when((F.col("slot") == F.col("last")) & F.col("limit").isNotNull(), F.col("from_word") + F.col("limit") - F.col("at"))
    mixed = mixed.withColumn("to_word", F.least("to_word", cut)).where("to_word > from_word").drop("at", "last", "limit")
    return rows, targets, mixed


def mix_taken(docs: DataFrame, **how) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken`` and its source; see ``mix``."""
    rows, targets, mixed = mix(docs, **how)
    taken = mixed.groupBy("rid").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    named = rows.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    return named.join(taken, "rid", "left").select(
        F.col("id").alias(how.get("id_col", "doc_id")),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.col("r.source").alias("source"),
    )


def mix_text(docs: DataFrame, block_words: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``shard, slot, source, text``: the mix itself, a block of words (the last of a source may be shorter) per slot.

    Words stand joined by one space. Each text is cut once; only the cut pieces meet the slots. See ``mix``.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = materialise(with_row_id(kept), "mix-texts")
    rows, targets, _ = mix(kept, block_words=block_words, id_col="id", text_col="text", source_col="source", rid_col="rid", **how)
    words = _ranked(rows, targets, block_words, how.get("most", 2.0)).join(kept.select("rid", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words")), "rid")

    def piece(block):
        start = F.greatest(block * F.col("per") - F.col("offset"), F.lit(0))
        end = F.least((block + 1) * F.col("per") - F.col("offset"), F.col("size"))
        return F.struct(block.alias("block"), F.array_join(F.slice("words", start.cast("int") + 1, (end - start).cast("int")), " ").alias("piece"))

    cut = words.select("rank", "source", "offset", "last", "limit", F.explode(F.transform(_spanned(), piece)).alias("p")).select("rank", "source", "offset", "last", "limit", "p.*")
    blocks = cut.groupBy("rank", "source", "last", "limit", "block").agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("p"))  # at most block_words pieces
    blocks = blocks.select("rank", "source", "last", "limit", "block", F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text"))
    shards = how.get("shards") or parts_for(int(targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]), SHARD_WORDS, 64)
    slots = draw_slots(targets, block_words, how.get("most", 2.0), shards, how.get("seed", 20))
    part = F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("limit").cast("int")), " ")
    text = F.when((F.col("slot") == F.col("last")) & F.col("limit").isNotNull(), part).otherwise(F.col("text"))
    return slots.hint("merge").join(blocks, ["rank", "block"]).select("shard", "slot", "source", text.alias("text"))
