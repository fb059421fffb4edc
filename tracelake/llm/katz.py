"""Katz backoff language model over the corpus: Good-Turing counts, exactly normalised backoff weights.

P(w|h) = d_r r / c(h) for a gram seen r times in training, else alpha(h) P(w|h'), h' without its first word; for words
P(w) = d_c c / N, else the mass left over, which goes to one unknown word. alpha(h) is the mass that the discounts free
over the mass, one order below, of the words never seen after h; an unseen history has weight one. Marks stand before
the first word of a text, an end mark follows its last.

How it runs: texts are cut to units of some MB. For each order a unit asks, for each of its distinct grams once, for the
training count; requests travel packed to the partition of the count table that the key's hash names, so a frequent
gram is one entry a unit and no key is hot. The partitions add up, write the table of keys and counts and the answers
by unit, and let one unit own each gram. Units then know all but the backoff weights: owners send what grams add to
their history, texts ask for the weights that they need, and both meet in the partition of the history, which writes
the table of weights. Texts seen later ask the same tables. All tables lie in the shared folder, partitioned by order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import byte_slices, materialise, parts_for, text_of

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
END, BEGIN = np.uint64(0x9AE16A3B2F90404F), 0xC949D7C7509E6557
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text in a unit, and distinct keys in a partition of a count table.
UNIT_BYTES, PART_KEYS = 12 << 20, 3_000_000
GOOD_TURING = 7


# -- packing --------------------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed: high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, of 64 where one of them needs more."""
    wide = len(values) > 0 and int(values.max()) >> 32 > 0
    return bytes([wide]) + pack(values.astype(np.uint64 if wide else np.uint32, copy=False))


def unpack_counts(data: bytes) -> np.ndarray:
    return unpack(data[1:], np.uint64 if data[0] else np.uint32)


# -- units ----------------------------------------------------------------------------------------------------------


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, lengths)``: 64-bit hash of every word and end mark of the texts, and how many a text has."""
    joined = b" ".join([*(t.lower() for t in texts), b" " * 8])
    data = np.frombuffer(joined, np.uint8)
    space = SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    length = np.flatnonzero(np.r_[~space, False][:-1] & np.r_[space[1:], True]) + 1 - starts
    eight = np.lib.stride_tricks.as_strided(data[: len(data) - 7].view(), (len(data) - 7, 8), (1, 1))
    h = length.astype(np.uint64) * M2
    todo, at = np.arange(len(starts)), 0
    while len(todo):
        left = length[todo] - at
        chunk = np.ascontiguousarray(eight[starts[todo] + at]).view(np.uint64).reshape(-1)
        short = np.minimum(left, 8).astype(np.uint64)
        chunk = chunk & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * short))
        x = (h[todo] ^ chunk) * M1
        h[todo] = x ^ (x >> np.uint64(31))
        at += 8
        todo = todo[left > 8]
    x = h * M2
    h = x ^ (x >> np.uint64(29))
    ends = np.cumsum([len(t) + 1 for t in texts])
    n_words = np.diff(np.searchsorted(starts, ends), prepend=0)
    out = np.full(len(h) + len(texts), END)
    out[np.arange(len(h)) + np.repeat(np.arange(len(texts)), n_words)] = h
    return out, n_words + 1


@dataclass
class Unit:
    """Distinct words of a unit (by falling frequency), its tokens as numbers of words, and how many a text has."""

    words: np.ndarray
    tokens: np.ndarray
    lengths: np.ndarray
    held: np.ndarray

    def token_held(self) -> np.ndarray:
        return np.repeat(self.held, self.lengths)

    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def before(self, values: np.ndarray, begin) -> np.ndarray:
        """What stands one token earlier in the same text; ``begin`` for the first token."""
        out = np.r_[values[:1], values[:-1]]
        out[self.starts()] = begin
        return out

    def grams(self, order: int) -> list[np.ndarray]:
        """For every order from one: the hash of the gram that ends at each token."""
        out = [self.words[self.tokens]]
        for n in range(2, order + 1):
            x = (self.before(out[-1], begin_mark(n - 1)) * M1 + out[0]) * M2
            out.append(x ^ (x >> np.uint64(32)))
        return out


def begin_mark(n: int) -> np.uint64:
    """The hash of n begin marks."""
    return np.uint64(BEGIN * (2 * n - 1) % (1 << 64))


def _units(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in byte_slices(batch, 2, UNIT_BYTES):
                hashes, lengths = word_hashes([t.as_py() for t in b.column(2)])
                words, inverse, n = np.unique(hashes, return_inverse=True, return_counts=True)
                by_count = np.argsort(-n, kind="stable")
                rank = np.empty(len(by_count), np.uint32)
                rank[by_count] = np.arange(len(by_count), dtype=np.uint32)
                unit = Unit(words[by_count], rank[inverse], lengths, b.column(1).to_numpy(zero_copy_only=False))
                sizes = [len(words), *(len(np.unique(g)) for g in unit.grams(order)[1:])]
                ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]), ids, pa.array([pack(unit.held.astype(np.uint8))]), pa.array([pack(lengths.astype(np.int64))]),
                        pa.array([unit.words.tobytes()]), pa.array([pack(unit.tokens)]), pa.array([sizes], pa.list_(pa.int64())),
                    ],
                    ["unit", "ids", "held", "lengths", "words", "tokens", "sizes"],
                )
                number += 1

    return run


def _load(row: dict) -> Unit:
    held, lengths = unpack(row["held"], np.uint8).astype(bool), unpack(row["lengths"], np.int64)
    return Unit(np.frombuffer(row["words"], np.uint64), unpack(row["tokens"], np.uint32), lengths, held)


# -- counts ---------------------------------------------------------------------------------------------------------


def _requests(n: int, bits: int):
    """Per unit and partition: the distinct grams of an order with their training counts in the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                unit = _load(row)
                keys, inverse = np.unique(unit.grams(n)[-1], return_inverse=True)
                count = np.bincount(inverse, weights=~unit.token_held(), minlength=len(keys)).astype(np.uint32)
                part, cuts = _filled(keys, bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part, pa.int32()), pa.array([row["unit"]] * len(part), pa.int64()),
                        pa.array([pack_sorted(keys[c]) for c in cuts], pa.binary()), pa.array([pack_counts(count[c]) for c in cuts], pa.binary()),
                    ],
                    ["part", "unit", "keys", "counts"],
                )

    return run


def _filled(keys: np.ndarray, bits: int) -> tuple[list[int], list[slice]]:
    """The partitions that sorted keys fall into, and where each stands."""
    cuts = _cuts(keys, bits)
    part = [k for k in range(len(cuts) - 1) if cuts[k] < cuts[k + 1]]
    return part, [slice(cuts[k], cuts[k + 1]) for k in part]


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the partitions of sorted keys begin, by their top bits, and the end."""
    if not bits:
        return np.array([0, len(keys)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


#: Of unit ``TABLE``: keys seen in training with their counts, and totals; of units: a count and an owner bit for each key asked.
ANSWERS = "part int, unit long, keys binary, counts binary, owns binary, totals array<long>"
TABLE = -1


def _add_up(table: pa.Table) -> pa.Table:
    """One partition of a count table, from requests with counts and, where it stands already, the table itself."""
    part = table["part"][0].as_py()
    rows = sorted(zip(table["unit"].to_pylist(), table["keys"], table["counts"]), key=lambda r: r[0])
    keys = [unpack_sorted(k.as_py()) for _, k, _ in rows]
    ends = np.cumsum([len(k) for k in keys])
    count = np.concatenate([unpack_counts(c.as_py()) for _, _, c in rows]).astype(np.int64)
    flat = np.concatenate(keys)
    del keys
    order = np.argsort(flat, kind="stable")
    flat, count = flat[order], count[order]
    new = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
    key = np.cumsum(new) - 1
    total = np.add.reduceat(count, np.flatnonzero(new)) if len(flat) else count
    trains = np.flatnonzero(count > 0)
    _, first = np.unique(key[trains], return_index=True)
    answer, owns = np.empty(len(order), np.int64), np.zeros(len(order), np.uint8)
    answer[order] = total[key]
    owns[order[trains[first]]] = 1
    seen = total > 0
    known, total = flat[new][seen], total[seen]
    totals = [int(total.sum()), len(total), *(int((total == r).sum()) for r in range(1, GOOD_TURING + 2))]
    out = [
        (part, unit, None, pack_counts(answer[s]), pack(np.packbits(owns[s])), None)
        for (unit, _, _), s in zip(rows, map(slice, np.r_[0, ends[:-1]], ends))
        if unit != TABLE
    ]
    out.append((part, TABLE, pack_sorted(known), pack_counts(total), None, totals))
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in ANSWERS.split(", ")])


@dataclass
class Discounts:
    """Good-Turing discounts of one order: ``d[r]`` for r up to k, beyond it the absolute discount of k goes on."""

    total: int
    distinct: int
    d: np.ndarray
    flat: float

    def freed(self, r: np.ndarray) -> np.ndarray:
        """(1 - d_r) r: the counts that a discount frees."""
        return np.where(r < len(self.d), (1 - self.d[np.minimum(r, len(self.d) - 1)]) * r, self.flat)


def discounts(totals: list[int]) -> Discounts:
    """Katz's discounts from the counts of counts; k falls until all of them lie between zero and one.

    Counts of counts that allow none (tiny corpora) give the absolute discount 0.5 for every count.
    """
    n = [0, *totals[2:]]
    for k in range(len(n) - 2, 0, -1):
        if not all(n[1 : k + 2]):
            continue
        common = (k + 1) * n[k + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else -1 for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return Discounts(totals[0], totals[1], np.array([1.0, *d]), float(np.clip(k * (1 - d[-1]), 1e-3, 0.75)))
    return Discounts(totals[0], totals[1], np.array([1.0]), 0.5)


@dataclass
class Unigrams:
    """P(w) of a count, count zero being the unknown word; sums to one over all words and the unknown one."""

    by: Discounts
    left: float

    def prob(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (c - self.by.freed(c)) / max(1, self.by.total), self.left)


def unigrams(by: Discounts, totals: list[int]) -> Unigrams:
    few = np.arange(1, len(by.d))
    freed = sum(float(by.freed(np.array([r]))[0]) * totals[1 + r] for r in few)
    freed += by.flat * (totals[1] - sum(totals[1 + r] for r in few))
    return Unigrams(by, freed / totals[0] if totals[0] else 1.0)


# -- evaluation -----------------------------------------------------------------------------------------------------

PARTS = "kind string, n int, part int, unit long, a binary, b binary, c binary"


@dataclass
class Model:
    """A trained model: small numbers here, tables of counts and weights by order in the shared folder.

    ``counts[n]`` has ``part, keys, counts`` and ``weights`` has ``n, part, a (keys), b (log10 weights)``, packed and
    sorted; ``bits[n]`` of a key's hash name its partition.
    """

    order: int
    bits: dict[int, int]
    totals: dict[int, list[int]]
    begin: int
    counts: dict[int, DataFrame] = field(default_factory=dict)
    weights: DataFrame | None = None

    def probabilities(self) -> tuple:
        by = {n: discounts(self.totals[n]) for n in range(1, self.order + 1)}
        return self.order, self.bits, unigrams(by[1], self.totals[1]), by, self.begin

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of texts that the model never saw."""
        return _run(docs, F.lit(True), id_col, text_col, self)[0]


def _evaluate(shared):
    """Per unit, with all its counts: text sums without backoff weights; what its own grams add to histories; questions."""

    def run(unit_rows: pa.Table, answers: pa.Table) -> pa.Table:
        order, bits, words_of, by, begin = shared.value
        row = unit_rows.to_pylist()[0]
        unit = _load(row)
        grams, starts = unit.grams(order), unit.starts()
        r: list[np.ndarray] = []
        own: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, order + 1):
            mine = sorted((p, a, o) for m, p, a, o in zip(*(answers[c].to_pylist() for c in ("n", "part", "counts", "owns"))) if m == n)
            count = np.concatenate([unpack_counts(a) for _, a, _ in mine]).astype(np.int64)
            flags = np.concatenate([np.unpackbits(unpack(o, np.uint8), count=len(unpack_counts(a))) for _, a, o in mine])
            _, first, inverse = np.unique(grams[n - 1], return_index=True, return_inverse=True)
            r.append(count[inverse])
            own.append(first[(flags == 1) & (count > 0)])
        # c[n]: training count of the history; at[n]: its key, both by token.
        c = {n: unit.before(r[n - 2], begin) for n in range(2, order + 1)}
        at = {n: unit.before(grams[n - 2], begin_mark(n - 1)) for n in range(2, order + 1)}

        def probability(n: int) -> np.ndarray:
            """P of every token by order n, the weights of unseen grams left out."""
            if n == 1:
                return words_of.prob(r[0])
            seen = r[n - 1] > 0
            return np.where(seen, (r[n - 1] - by[n].freed(r[n - 1])) / np.maximum(1, c[n]), probability(n - 1))

        total, distinct = by[1].total, by[1].distinct
        base = np.log10((r[0] + 0.5) / (total + 0.5 * (distinct + 1)))
        sums = [np.add.reduceat(x, starts) for x in (np.log10(probability(order)), base, (r[0] > 0).astype(np.float64))]
        out = [("text", 0, 0, row["unit"], pack(np.stack(sums, 1).reshape(-1)), row["held"], row["lengths"])]
        text = np.repeat(np.arange(len(unit.lengths)), unit.lengths)
        for n in range(2, order + 1):
            # What the grams that this unit owns free of their history, and take from its backoff.
            t = own[n - 1]
            keys, inverse = np.unique(at[n][t], return_inverse=True)
            freed = np.bincount(inverse, weights=by[n].freed(r[n - 1][t]) / c[n][t], minlength=len(keys))
            taken = np.bincount(inverse, weights=probability(n - 1)[t], minlength=len(keys))
            out += _by_part("owned", n, row["unit"], keys, bits[n - 1], freed, taken)
            # Unseen grams of a known history need its weight: how often, by text and history.
            lack = np.flatnonzero((r[n - 1] == 0) & (c[n] > 0))
            keys, inverse = np.unique(at[n][lack], return_inverse=True)
            asked, times = np.unique(inverse.astype(np.int64) * len(unit.lengths) + text[lack], return_counts=True)
            out += _by_part(
                "asked", n, row["unit"], keys[asked // len(unit.lengths)], bits[n - 1], (asked % len(unit.lengths)).astype(np.uint32), times.astype(np.uint32)
            )
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        arrays = [pa.array(x, k) for x, k in zip(zip(*out), kinds)]
        ids = [row["ids"], *[None] * (len(out) - 1)]
        return pa.table([*arrays, pa.array(ids, unit_rows.schema.field("ids").type)], names=[*(f.split()[0] for f in PARTS.split(", ")), "ids"])

    return run


def _by_part(kind: str, n: int, unit: int, keys: np.ndarray, bits: int, b: np.ndarray, c: np.ndarray) -> list[tuple]:
    """Rows by partition of sorted keys."""
    return [(kind, n, k, unit, pack_sorted(keys[s]), pack(b[s]), pack(c[s])) for k, s in zip(*_filled(keys, bits))]


WEIGHTS = "kind string, n int, part int, unit long, a binary, b binary"


def _backoff(table: pa.Table) -> pa.Table:
    """One partition of histories: exact weights from all that owners sent, or those of the table; questions answered as sums."""
    rows = table.to_pylist()
    n, part = rows[0]["n"], rows[0]["part"]
    own = [r for r in rows if r["kind"] == "owned"]
    keys = np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(r["a"]) for r in own)])
    known, inverse = np.unique(keys, return_inverse=True)
    freed, taken = (
        np.bincount(inverse, weights=np.concatenate([np.zeros(0), *(unpack(r[x], np.float64) for r in own)]), minlength=len(known)) for x in "bc"
    )
    weight = np.log10(freed / np.maximum(1 - taken, 1e-300))
    for r in rows:
        if r["kind"] == "weight":
            known, weight = unpack_sorted(r["a"]), unpack(r["b"], np.float64)
    out = [("weight", n, part, TABLE, pack_sorted(known), pack(weight))]
    for r in rows:
        if r["kind"] == "asked":
            at = np.searchsorted(known, unpack_sorted(r["a"]))
            text, times = unpack(r["b"], np.uint32), unpack(r["c"], np.uint32)
            sums = np.bincount(text, weights=weight[at] * times)
            some = np.unique(text)
            out.append(("sum", n, part, r["unit"], pack(some), pack(sums[some])))
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in WEIGHTS.split(", ")])


def _finish(total: int):
    def run(texts: pa.Table, sums: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        score, base, known = unpack(row["a"], np.float64).reshape(-1, 3).T
        score = score.copy()
        rows = sorted((n, p, a, b) for n, p, a, b in zip(*(sums[x].to_pylist() for x in ("n", "part", "a", "b"))))
        for _, _, text, part in rows:
            np.add.at(score, unpack(text, np.uint32), unpack(part, np.float64))
        return pa.table(
            {
                "id": texts["ids"].combine_chunks().flatten(),
                "held_out": unpack(row["b"], np.uint8).astype(bool),
                "n_tokens": unpack(row["c"], np.int64),
                "n_known": known.astype(np.int64),
                "train_tokens": np.full(len(score), total, np.int64),
                "base_score": base,
                "score": score,
            }
        )

    return run


def _run(docs: DataFrame, held_out, id_col: str, text_col: str, model: Model | None, order: int = 2) -> tuple[DataFrame, Model]:
    """Scores by ``model``, or by one that the rows not held out give."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_of(text_col).cast("binary").alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    order = model.order if model else order
    units = materialise(
        rows.mapInArrow(_units(order), f"unit long, ids array<{kind}>, held binary, lengths binary, words binary, tokens binary, sizes array<long>"),
        "katz-units",
    )
    # Groups of a step are whole partitions of a table or whole units: so many tasks, whatever the session's setting.
    sizes = units.agg(F.count("*"), *[F.coalesce(F.sum(F.col("sizes")[k]), F.lit(0)) for k in range(order)]).first()
    n_units = max(1, sizes[0])
    bits = model.bits if model else {n: max(2, int(np.ceil(np.log2(max(1, sizes[n] / PART_KEYS))))) for n in range(1, order + 1)}
    counts, answers, totals = {}, None, {}
    for n in range(1, order + 1):  # an order at a time: its requests are gone when the next ones travel
        asked = units.mapInArrow(_requests(n, bits[n]), "part int, unit long, keys binary, counts binary")
        if model:
            asked = asked.unionByName(model.counts[n].select("part", F.lit(TABLE).cast("long").alias("unit"), "keys", "counts"))
        added = asked.repartition(1 << bits[n], "part").groupBy("part").applyInArrow(_add_up, ANSWERS)
        added = materialise(added, f"katz-counts-{n}")
        counts[n] = added.where(f"unit = {TABLE}").select("part", "keys", "counts", "totals")
        mine = added.where(f"unit <> {TABLE}").select("unit", F.lit(n).alias("n"), "part", "counts", "owns")
        answers = mine if answers is None else answers.unionByName(mine)
        totals[n] = [x or 0 for x in counts[n].agg(*[F.sum(F.col("totals")[i]) for i in range(GOOD_TURING + 3)]).first()]
    if not model:
        # Begin marks are a history once for every training text.
        model = Model(order, bits, totals, rows.where("not held_out").count(), counts)
    shared = spark.sparkContext.broadcast(model.probabilities())
    tasks = parts_for(n_units, 1)
    parts = materialise(
        units.drop("sizes").repartition(tasks, "unit").groupBy("unit").cogroup(answers.repartition(tasks, "unit").groupBy("unit")).applyInArrow(
            _evaluate(shared), f"{PARTS}, ids array<{kind}>"
        ),
        "katz-parts",
        "kind",
    )
    histories = parts.where("kind <> 'text'").drop("ids")
    if model.weights is not None:
        table = model.weights.withColumns({"unit": F.lit(TABLE).cast("long"), "c": F.lit(None).cast("binary"), "kind": F.lit("weight")})
        histories = histories.where("kind <> 'owned'").unionByName(table.select(histories.columns))
    groups = max(1, sum(1 << bits[n - 1] for n in range(2, order + 1)))
    weights = materialise(histories.repartition(groups, "n", "part").groupBy("n", "part").applyInArrow(_backoff, WEIGHTS), "katz-weights", "kind")
    if model.weights is None:
        model.weights = weights.where("kind = 'weight'").select("n", "part", "a", "b")
    texts = parts.where("kind = 'text'").select("unit", "a", "b", "c", "ids")
    sums = weights.where("kind = 'sum'").select("unit", "n", "part", "a", "b")
    out = texts.repartition(tasks, "unit").groupBy("unit").cogroup(sums.repartition(tasks, "unit").groupBy("unit")).applyInArrow(
        _finish(model.totals[1][0]), schema
    )
    return out.withColumnRenamed("id", id_col), model


def fit_score(
    docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", order: int = 2
) -> tuple[DataFrame, Model]:
    """``(scores, model)`` of an order: the rows of ``score`` and the model that they were scored by, for later texts."""
    if order < 1:
        raise ValueError("the order is one or more")
    return _run(docs, held_out, id_col, text_col, None, order)


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """One row per input row: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``held_out`` is a boolean column: rows where it is true are scored but not learned from. Null text counts as empty and
    has the end mark only. Words without training count are the unknown word. Repeated rows count and come back as often
    as they stand; without training rows every token has probability one (the unknown word). An empty table gives no rows;
    extra columns are ignored.
    """
    return fit_score(docs, held_out, id_col, text_col, order)[0]
