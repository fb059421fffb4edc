"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of consecutive words of the benchmark items. For patterns of m words and blocks of B
words, the shift table tells how far the search may move when a block stands at its end; blocks of no pattern
move it by m - B + 1. Where the shift is zero, the bucket of the block holds the patterns that end with it, and
direct comparison decides. Items shorter than the window form classes of their own, one for each length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import materialise, set_aside, text_of, with_row_id

WINDOW = 13
BLOCK = 3
#: ASCII letters to lower case, all other ASCII but digits to a space; bytes from 0x80 on belong to words.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Search tables for one length of patterns."""

    def __init__(self, m: int):
        self.m, self.b = m, min(BLOCK, m)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, list[tuple[list, set]]] = {}
        self.known: dict[tuple, set] = {}

    def add(self, words: list[bytes], item: int) -> None:
        key = tuple(words)
        if key in self.known:
            self.known[key].add(item)
            return
        self.known[key] = {item}
        for end in range(self.b, self.m + 1):
            block = key[end - self.b : end]
            self.shift[block] = min(self.shift.get(block, self.m), self.m - end)
        self.buckets.setdefault(key[-self.b :], []).append((words, self.known[key]))

    def search(self, words: list[bytes], spans: list[tuple[int, int]], items: set[int]) -> None:
        m, b, shift, buckets = self.m, self.b, self.shift, self.buckets
        skip, i, n = m - b + 1, m, len(words)
        while i <= n:
            block = tuple(words[i - b : i])
            step = shift.get(block, skip)
            if not step:
                for pattern, of in buckets[block]:
                    if words[i - m : i] == pattern:
                        spans.append((i - m, i))
                        items |= of
                        break  # patterns of a length differ, so no other can stand here
                step = 1
            i += step


def build(items: list[list[bytes]], window: int) -> list[WuManber]:
    """The tables of some items; an item of no words has no pattern."""
    by_length: dict[int, WuManber] = {}
    for k, words in enumerate(items):
        m = min(window, len(words))
        for at in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, WuManber(m)).add(words[at : at + m], k)
    return list(by_length.values())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _search(tables, names, text_col: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, ids = tables.value, names.value
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            n_words, froms, tos, found = [], [], [], []
            for text, f0, t0, i0 in zip(cols[text_col], cols["hit_from"], cols["hit_to"], cols["items"], strict=True):
                words, spans, items = words_of(text.as_py() or b""), list(zip(f0.as_py(), t0.as_py())), set()
                for table in search:
                    table.search(words, spans, items)
                spans = merged(spans)
                n_words.append(len(words))
                froms.append([s for s, _ in spans])
                tos.append([e for _, e in spans])
                found.append(i0.as_py() + [ids[k] for k in sorted(items)])
            cols |= {"n_words": n_words, "hit_from": froms, "hit_to": tos, "items": found}
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c := cols[f.name], pa.Array) and c.type == f.type else pa.array(c if isinstance(c, list) else c.to_pylist(), f.type) for f in schema],
                schema=schema,
            )

    return run


def occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    words_per_block: int = 1_000_000,
) -> DataFrame:
    """``docs`` plus ``n_words, n_hit, items, hit_from, hit_to, contaminated``; hits are merged spans of words.

    The benchmark is searched for in blocks of about ``words_per_block`` words, so what a task holds does not grow
    with it; with several, texts are written once, each block gives the rows that it hits, and these meet at the end. Null text has no words. Items without words or with a
    null id are ignored; rows that repeat an item id count as one item. An empty table on either side gives no
    hits. Columns of ``docs`` whose names clash, whatever their case, are replaced.
    """
    spark = docs.sparkSession
    ours = ["n_words", "n_hit", "items", "hit_from", "hit_to", "contaminated"]
    plain = [c for c in docs.columns if c.lower() not in (*ours, "__bytes", "__rid")]
    empty = F.expr("cast(array() as array<int>)")
    out = docs.select(
        *plain,
        text_of(text_col).cast("binary").alias("__bytes"),
        F.lit(0).cast("long").alias("n_words"),
        empty.alias("hit_from"),
        empty.alias("hit_to"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    schema = _arrow_schema(out)
    bench = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), text_of(item_text_col).cast("binary").alias("text")
    )
    n_bytes = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-n_bytes // (6 * words_per_block)))
    hits = None
    if blocks > 1:  # texts are written once; each block gives but the rows that it hits
        out = materialise(with_row_id(out, "__rid"), "decontam-docs")
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).distinct().orderBy("item", "text").collect()
        names: list[str] = [r["item"] for r in rows]
        tables = build([words_of(bytes(r["text"])) for r in rows], window)
        search = _search(spark.sparkContext.broadcast(tables), spark.sparkContext.broadcast(names), "__bytes", schema)
        if blocks == 1:
            out = out.mapInArrow(search, out.schema)
            break
        mine = out.select("__rid", "__bytes", "n_words", "hit_from", "hit_to", "items")
        search = _search(spark.sparkContext.broadcast(tables), spark.sparkContext.broadcast(names), "__bytes", _arrow_schema(mine))
        mine = mine.mapInArrow(search, mine.schema).where(F.size("items") > 0).select("__rid", "hit_from", "hit_to", "items")
        mine = materialise(mine, "decontam-hits")
        hits = mine if hits is None else hits.unionByName(mine)
    if hits is not None:
        ours_of = ["hit_from", "hit_to", "items"]
        hits = hits.groupBy("__rid").agg(*[F.flatten(F.collect_list(c)).alias(f"__{c}") for c in ours_of])
        out = out.join(hits, "__rid", "left").select(
            *plain, "__bytes", "n_words", *[F.coalesce(f"__{c}", F.col(c)).alias(c) for c in ours_of]
        )
        none = spark.sparkContext.broadcast([])
        out = out.mapInArrow(_search(none, none, "__bytes", schema), out.schema)
    hit = F.aggregate(F.zip_with("hit_to", "hit_from", lambda a, b: (a - b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        *plain,
        "n_words",
        hit.alias("n_hit"),
        F.array_sort(F.array_distinct("items")).alias("items"),
        "hit_from",
        "hit_to",
        ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents that are not contaminated, with the columns of ``docs`` as they are, whatever their names.

    Null and empty texts have no words and stay, as do repeated rows; see ``occurrences``.
    """
    rows, back = set_aside(docs, text_col)
    return occurrences(rows, benchmark, text_col, **how).where("not contaminated").select(*back)


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]))
