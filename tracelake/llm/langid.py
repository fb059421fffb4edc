"""Language identification by prediction by partial matching.

Per language a context tree of order three over bytes is frozen: a symbol in a context of count T with D distinct
symbols has probability n / (T + D), an unseen one escapes with D / (T + D) to the shorter context, and below order
zero all bytes are alike (method C). The code length of a text is exact under these statistics; the language with the
shortest wins. Counts of all orders follow from those of the longest, as every position has one padded context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import byte_slices, set_aside, with_row_id, with_row_id

ORDER = 3
UND = "und"


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(grams, starts)``: for every byte its three predecessors (zero before a text) and itself, in 32 bits."""
    joined = np.frombuffer(b"".join(b"\0\0\0" + t for t in texts), np.uint8).astype(np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    grams = joined.copy()
    for back in range(1, ORDER + 1):
        grams[back:] |= joined[:-back] << np.uint32(8 * back)
    ends = np.cumsum(sizes + ORDER)
    own = np.ones(len(joined), bool)
    for k in range(ORDER):
        own[ends - sizes - ORDER + k] = False
    return grams[own], np.cumsum(sizes) - sizes


@dataclass
class Trees:
    """Frozen statistics of all languages: per order the known grams with log2 probabilities, contexts with log2 escapes."""

    langs: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]

    def code_lengths(self, texts: list[bytes], cells: int = 1 << 22) -> np.ndarray:
        """Bits of every text under every language."""
        grams, starts = grams_of(texts)
        total = np.zeros((len(texts), len(self.langs)))
        doc = np.repeat(np.arange(len(texts)), np.diff(starts, append=len(grams)))
        step = max(1024, cells // max(1, len(self.langs)))
        for at in range(0, len(grams), step):
            bits, of = -self._log2(grams[at : at + step]), doc[at : at + step]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            total[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.float64)
        return total

    def _log2(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        todo = np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            if not len(self.grams[k]):
                continue
            key = grams[todo] & np.uint32((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.grams[k], key), len(self.grams[k]) - 1)
            known = self.grams[k][at] == key
            out[todo[known]] += self.logp[k][at[known]]
            todo, key = todo[~known], key[~known]
            if k and len(todo):  # contexts of some language weigh in although no language knows the gram
                key >>= np.uint32(8)
                at = np.minimum(np.searchsorted(self.contexts[k], key), len(self.contexts[k]) - 1)
                seen = self.contexts[k][at] == key
                out[todo[seen]] += self.escape[k][at[seen]]
        return out


@dataclass
class Forest:
    """Trees of groups of languages; a group shares one table of grams. No gram is left out, however many languages there are."""

    groups: list[Trees]

    @property
    def langs(self) -> list[str]:
        return [x for g in self.groups for x in g.langs]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text under every language."""
        return np.hstack([g.code_lengths(texts) for g in self.groups])


def forest(langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray, most_cells: int) -> Forest:
    """Languages share a table as long as grams times languages are at most ``most_cells``; else each half has its own."""
    if len(langs) > 1 and len(np.unique(gram)) * len(langs) > most_cells:
        half, out = len(langs) // 2, []
        for at, names in ((0, langs[:half]), (half, langs[half:])):
            mine = (lang >= at) & (lang < at + len(names))
            out += forest(names, lang[mine] - at, gram[mine], count[mine], most_cells).groups
        return Forest(out)
    return Forest([freeze(langs, lang, gram, count)])


def freeze(langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Trees:
    """Trees from counts of longest grams."""
    n_langs = len(langs)
    grams, logp, contexts, escape = [], [], [], []
    below = np.full((256, n_langs), -8.0)  # order -1: all bytes alike
    below_keys = np.arange(256, dtype=np.uint32)
    for k in range(ORDER + 1):
        g = gram & np.uint32((1 << 8 * (k + 1)) - 1)
        both, inverse = np.unique(lang.astype(np.uint64) << np.uint64(32) | g, return_inverse=True)
        n = np.bincount(inverse, weights=count)
        l, g = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        # Contexts: total T and distinct D by language.
        ctx = g >> np.uint32(8)
        where, of = np.unique(l.astype(np.uint64) << np.uint64(32) | ctx, return_inverse=True)
        total, distinct = np.bincount(of, weights=n), np.bincount(of)
        ckeys = np.unique(ctx)
        esc = np.zeros((max(1, len(ckeys)), n_langs), np.float32)
        cl, cc = (where >> np.uint64(32)).astype(np.int64), (where & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        esc[np.searchsorted(ckeys, cc), cl] = np.log2(distinct / (total + distinct))
        keys = np.unique(g) if k else np.arange(256, dtype=np.uint32)
        # What a language does not know here comes from the shorter context, after the escape.
        short = keys & np.uint32((1 << 8 * k) - 1 if k else 0xFF)
        table = below[np.searchsorted(below_keys, short)] + esc[np.minimum(np.searchsorted(ckeys, keys >> np.uint32(8)), len(ckeys) - 1)]
        table[np.searchsorted(keys, g), l] = np.log2(n / (total + distinct)[of])
        grams.append(keys)
        logp.append(table.astype(np.float32))
        contexts.append(ckeys)
        escape.append(esc)
        below, below_keys = table, keys
    return Trees(langs, grams, logp, contexts, escape)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in byte_slices(batch, 1, 4 << 20):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                g, _ = grams_of([t for t, x in zip(texts, langs) if x == lang])
                keys, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                )


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_bytes: int = 8 << 20, most_cells: int = 16 << 20) -> Forest | None:
    """Freeze the trees of every non-null language of ``docs``; null without any text.

    The classifier is fitted on a bounded sample: rows are drawn by a hash of row and text at a rate that gives every language an equal
    share of ``sample_bytes``, which bounds the grams and so what is sent to the executors. ``most_cells`` bounds a table
    that languages share; with more, tables are split by language, and nothing is left out.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.lower(text_col).cast("binary").alias("text")
    )
    rows = with_row_id(rows)  # rows are drawn, not texts: copies come one by one, as often as they are in the corpus
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text"))).collect()}
    if not sizes:
        return None
    quota = sample_bytes / len(sizes)
    rates = docs.sparkSession.createDataFrame([(x, min(1.0, quota / n)) for x, n in sizes.items()], "lang string, rate double")
    place = F.pmod(F.xxhash64("rid", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(rates), "lang").where(place < F.col("rate")).select("lang", "text")
    counted = "lang string, gram long, n long"
    got = sample.mapInArrow(_count, counted).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if missing := sorted(set(sizes) - set(got["lang"].to_pylist())):  # their few rows were not drawn: take one
        one = rows.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min_by("text", place).alias("text"))
        more = one.mapInArrow(_count, counted).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        got = pa.concat_tables([got, more])
    langs = sorted(set(got["lang"].to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    lang = np.array([number[x] for x in got["lang"].to_pylist()], np.int64)
    return forest(langs, lang, got["gram"].to_numpy().astype(np.uint32), got["n"].to_numpy(), most_cells)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Forest = shared.value
        for batch in batches:
            for b in byte_slices(batch, batch.num_columns - 2, 2 << 20):
                bits = trees.code_lengths([x or b"" for x in b.column(b.num_columns - 2).to_pylist()])
                best = bits.argmin(axis=1)
                score = 1 / np.exp2(np.maximum(-1000, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
                letter = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                names = [trees.langs[k] if ok else UND for k, ok in zip(best, letter)]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-2], pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(np.where(letter, bits.min(axis=1), 0.0))],
                    [*b.schema.names[:-2], "lang_pred", "score", "bits"],
                )

    return run


#: In no learned language are texts of at least so many bytes that cost more bits a byte under all of them; 8 is chance.
FOREIGN_BYTES, FOREIGN_BITS = 128, 7.0


def keep_known(docs: DataFrame, trees: Forest | None, text_col: str = "text") -> DataFrame:
    """The documents in a learned language, with the columns of ``docs`` as they are, whatever their names.

    Null, empty and letterless texts go, and those that no learned language shortens (``FOREIGN_BYTES``,
    ``FOREIGN_BITS``). Where nothing was learned texts with a letter stay. Repeated rows are rows of their own.
    """
    if trees is None:
        return docs.where(F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)))
    rows, back = set_aside(docs, text_col)
    n = F.octet_length(F.col(text_col))
    known = (n < FOREIGN_BYTES) | (F.col("bits") <= FOREIGN_BITS * n)
    return predict(rows, trees, text_col).where((F.col("lang_pred") != UND) & known).select(*back)


def predict(docs: DataFrame, trees: Forest | None, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred, score`` (posterior of the prediction, languages alike beforehand) and ``bits``.

    ``und`` with score zero where the text is null, empty or without a letter, and everywhere if nothing was learned.
    Clashing columns of ``docs``, whatever their case, are replaced; repeated rows are rows of their own; an empty table gives none.
    """
    plain = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "bits", "__bytes", "__letter")]
    if trees is None:  # nothing to read a text by
        return docs.select(*plain, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
    rows = docs.select(
        *plain,
        F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("__bytes"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letter"),
    )
    out = docs.select(*plain, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits")).schema
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(trees)), out)
