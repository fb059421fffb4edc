"""Repair of conversations: the cheapest edits that make the roles of a conversation an allowed sequence.

The roles that are allowed, ``(s?(ua)+)?``, have four states: nothing yet, after the system turn, after a user turn, after
an assistant turn (the first and the last may end). Every turn is a 4 x 4 matrix over (min, +) whose element (i, j) is the
cheapest way, and of equally cheap ways the ASCII-least audit, to get from state i before it to state j behind it: keep,
give another role, delete, with any inserts in front (the insert closure). Two audits of equal cost between the same states
never are a prefix of one another, as equal letters cost equally, so products of matrices are associative.

Turns are sorted by range, so a conversation may lie in many partitions. A partition reduces each of its runs by a balanced
tree; runs that may go on in a neighbour are reduced by rounds of ``RADIX`` neighbouring partitions. An element also has the
counts of its run and what its ends need to meet their neighbours. Texts do not take part: they meet the audits once, in
order, in a stream by conversation, where edits are applied and hashed. SHA-256 of one text is sequential, so that last stream of
one conversation is one task, in bounded memory but for the audit, a character a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import materialise

#: What edits cost, roles of inserted turns, pairs of initials that may follow one another.
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Next state by state and initial.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ENDS = (0, 3)
STATES = range(4)
#: A text of nothing but white space, and one that ends a sentence; other line ends than these are characters like any.
BLANK = r"^[\x20\x09-\x0D]*\z"
WHOLE = r"[.!?][\x20\x09-\x0D]*\z"
RADIX = 8
#: Symbols of a run that are remembered with their matrix.
LEAF = 16

Matrix = tuple  # of four rows of four elements (cost, audit) or None


def _plus(a: Matrix, b: Matrix) -> Matrix:
    """The product: first a, then b."""
    out = []
    for row in a:
        best = [None] * 4
        for mid, x in enumerate(row):
            if x is not None:
                for j, y in enumerate(b[mid]):
                    if y is not None:
                        cost = x[0] + y[0]
                        if best[j] is None or cost <= best[j][0]:
                            way = (cost, x[1] + y[1])
                            best[j] = way if best[j] is None else min(best[j], way)
        out.append(tuple(best))
    return tuple(out)


def _closure() -> Matrix:
    """Any inserts: from every state the fewest that reach the other."""
    m = [[None] * 4 for _ in STATES]
    for i in STATES:
        m[i][i] = (0, "")
        at = [(i, 0)]
        for state, n in at:  # breadth first
            for name in NAMES:
                to = STEP.get((state, name))
                if to is not None and m[i][to] is None:
                    m[i][to] = (INSERT * (n + 1), "I" * (n + 1))
                    at.append((to, n + 1))
    return tuple(map(tuple, m))


INSERTS = _closure()
UNIT = tuple(tuple((0, "") if i == j else None for j in STATES) for i in STATES)


@lru_cache(maxsize=64)
def turn(symbol: str) -> Matrix:
    """The matrix of a turn, inserts in front of it. Symbols: ``d`` must go; else its initial (``s u a``, other: ``o``), in
    upper case if it is truncated."""
    kind, more = symbol.lower(), CUT if symbol.isupper() else 0
    m: list[list] = [[None] * 4 for _ in STATES]

    def offer(i: int, j: int | None, cost: int, letter: str) -> None:
        if j is not None and (m[i][j] is None or (cost, letter) < m[i][j]):
            m[i][j] = (cost, letter)

    for i in STATES:
        offer(i, i, DELETE, "D")
        if kind != "d":
            offer(i, STEP.get((i, kind)), more, "K")
            for name in NAMES:
                offer(i, STEP.get((i, name)), RENAME + more, "R")
    return _plus(INSERTS, tuple(map(tuple, m)))


@lru_cache(maxsize=1 << 14)
def _leaf(symbols: str) -> Matrix:
    return reduce(_plus, map(turn, symbols), UNIT)


def span(symbols: str) -> Matrix:
    """The product of the matrices of a run of turns, as a balanced tree."""
    if len(symbols) <= LEAF:
        return _leaf(symbols)
    half = (len(symbols) // LEAF + 1) // 2 * LEAF
    return _plus(span(symbols[:half]), span(symbols[half:]))


def best(m: Matrix) -> tuple[int, str]:
    """Cheapest way from nothing to an allowed end, inserts behind the last turn included."""
    return min(x for x in (_plus(m, INSERTS)[0][j] for j in ENDS) if x is not None)


class Editor:
    """Applies an audit to turns in order; hashes what comes out, as ``role:text`` lines."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines, self.sha = audit, 0, 0, 0, hashlib.sha256()

    def _emit(self, initial: str, role: str, text: str) -> None:
        self.state = STEP[self.state, initial]
        self.sha.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def _next(self) -> str:
        return "a" if self.state == 2 else "u"

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._emit(self._next(), NAMES[self._next()], "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._emit(role[:1], role, text)
        elif letter == "R":
            self._emit(self._next(), NAMES[self._next()], text)


#: An element of the reduction, by conversation: the rows of a run in one partition.
ELEMENT = (
    "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first_turn long, last_turn long, "
    "first_role string, last_role string, cells array<struct<cost: long, audit: string>>"
)
_CELLS = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
_TYPES = [pa.int64()] * 9 + [pa.string()] * 2 + [_CELLS]
_NAMES = [x.split()[0] for x in ELEMENT.split(", ")][:11] + ["cells"]


def _pack(m: Matrix) -> list:
    return [None if x is None else {"cost": x[0], "audit": x[1]} for row in m for x in row]


def _unpack(cells: list) -> Matrix:
    flat = [None if x is None else (x["cost"], x["audit"]) for x in cells]
    return tuple(tuple(flat[4 * i : 4 * i + 4]) for i in STATES)


def _join(a: dict, b: dict) -> dict:
    """Two neighbouring elements as one. Without turns (dropped rows only) an element has no roles."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    for k, pick in (("low", min), ("high", max)):
        out[k] = pick((x for x in (a[k], b[k]) if x is not None), default=None)
    if a["last_turn"] is not None and a["last_turn"] == b["first_turn"]:
        out["turns"] -= 1  # one turn on both sides
    if a["last_role"] is not None and b["first_role"] is not None:
        out["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
    for k in ("turn", "role"):
        out[f"first_{k}"] = a[f"first_{k}"] if a[f"first_{k}"] is not None else b[f"first_{k}"]
        out[f"last_{k}"] = b[f"last_{k}"] if b[f"last_{k}"] is not None else a[f"last_{k}"]
    out["cells"] = _plus(a["cells"], b["cells"])
    return out


class _Run:
    """Rows of one conversation in one partition, as they come."""

    def __init__(self) -> None:
        self.symbols: list[str] = []
        self.parts: list[Matrix] = []
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.ends: list = [None, None, None, None]  # first turn, last turn, first role, last role

    def add(self, turn_no: int | None, initial: str, fault: str, copies: int) -> None:
        if not copies:
            return
        if turn_no is not None and turn_no != self.ends[1]:
            self.n["turns"] += 1
            self.ends[0] = turn_no if self.ends[0] is None else self.ends[0]
            self.ends[1] = turn_no
        if self.ends[3] is not None:
            self.n["illegal"] += self.ends[3] + initial not in LEGAL
        self.n["illegal"] += (copies - 1) * (initial + initial not in LEGAL)
        self.ends[2] = initial if self.ends[2] is None else self.ends[2]
        self.ends[3] = initial
        symbol = initial if initial in ("s", "u", "a") else "o"
        if fault in ("blank", "duplicate"):
            self.n[fault] += copies
            self.symbols += ["d"] * copies
        else:
            self.n["duplicate"] += copies - 1
            self.n["truncated"] += fault == "truncated"
            self.symbols += [symbol.upper() if fault == "truncated" else symbol, *["d"] * (copies - 1)]
        if len(self.symbols) >= 1 << 16:  # a long run goes on with the matrix of what it had
            self.parts.append(span("".join(self.symbols)))
            self.symbols = []

    def element(self) -> dict:
        matrices = [*self.parts, span("".join(self.symbols))]
        while len(matrices) > 1:
            matrices = [reduce(_plus, matrices[k : k + 2]) for k in range(0, len(matrices), 2)]
        first, last, first_role, last_role = self.ends
        return {**self.n, "low": first, "high": last, "first_turn": first, "last_turn": last, "first_role": first_role, "last_role": last_role, "cells": matrices[0]}


def _columns(found: list[dict]) -> list[pa.Array]:
    return [pa.array([_pack(x[c]) if c == "cells" else x[c] for x in found], t) for c, t in zip(_NAMES, _TYPES)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of a partition to an element a conversation; the first and the last may go on elsewhere (``edge``)."""
    run, key, first, any_row = _Run(), None, True, False

    def out(keys: list, runs: list[dict], edges: list[bool], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(edges, pa.bool_()), *_columns(runs)], ["conv", "edge", *_NAMES])

    kind = None
    for b in batches:
        keys, done, edges = [], [], []
        kind = b.schema.field(0).type
        for conv, turn_no, initial, fault, copies in zip(*(c.to_pylist() for c in b.columns)):
            if any_row and conv != key:
                keys.append(key)
                done.append(run.element())
                edges.append(first)
                run, first = _Run(), False
            key, any_row = conv, True
            run.add(turn_no, initial, fault, copies)
        if keys:
            yield out(keys, done, edges, kind)
    if any_row:
        yield out([key], [run.element()], [True], kind)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, part, elements of neighbouring runs in order) to one element each."""
    for b in batches:
        got = [reduce(_join, ({**e, "cells": _unpack(e["cells"])} for e in some)) for some in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:2], *_columns(got)], ["conv", "part", *_NAMES])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    for b in batches:
        cells = [best(_unpack(x)) for x in b.column(b.schema.get_field_index("cells")).to_pylist()]
        get = {c: b.column(b.schema.get_field_index(c)) for c in (*names[2:6], "turns", "low", "high", "conv")}
        gaps = [0 if low is None else high - low + 1 - n for low, high, n in zip(*(get[c].to_pylist() for c in ("low", "high", "turns")))]
        cost, audit = pa.array([c for c, _ in cells], pa.int64()), pa.array([a for _, a in cells], pa.string())
        yield pa.RecordBatch.from_arrays([get["conv"], pa.array(gaps, pa.int64()), *[get[c] for c in names[2:6]], cost, audit], names)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream of rows by conversation, its audit first, to the hash of its repaired text."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    editor, head, kind = None, None, None

    def done() -> tuple:
        editor.inserts()
        return (*head, editor.audit, editor.sha.hexdigest())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for b in batches:
        kind, found = b.schema.field(0).type, []
        counts = b.column(1).to_pylist()
        for conv, n, audit, role, text, copies in zip(b.column(0).to_pylist(), counts, *(b.column(k).to_pylist() for k in range(2, 6))):
            if n is not None:
                if editor:
                    found.append(done())
                editor, head = Editor(audit), (conv, *n)
            else:
                for _ in range(copies):
                    editor.turn(role, text)
        if found:
            yield out(found)
    if editor:
        yield out([done()])


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, copies``: turns with planted faults, by crc32 of ``conversation:turn`` modulo 20.

    0 drops the turn (no copies), 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it the user's. A null
    conversation or turn counts as one space there, a null role or text is one space.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    return turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repair(turns: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, a row a conversation.

    ``turns (conv, turn, role, text, copies)``: a row stands for as many equal turns; one without copies only names its
    conversation. Turns go by number, null first, those of one number by role and then by SHA-256 of the text. A null
    conversation is one too; null roles and texts are one space. An empty table gives no rows; other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    place = ["conv", "turn", "role", "digest"]
    fault = F.when(F.col("text").rlike(BLANK), "blank").when(~F.col("text").rlike(WHOLE), "truncated").otherwise("")
    # Equal turns at one place are one row with a number: no repeated turn makes a conversation heavy.
    small = rows.groupBy(*place, fault.alias("fault")).agg(F.sum("copies").alias("copies"))
    small = materialise(small, "dialogue-turns")
    again = small.where("copies > 0 and fault <> 'blank'").groupBy("conv", "role", "digest")
    again = again.agg(F.count("*").alias("places"), F.min(F.struct("turn")).alias("first")).where("places > 1")
    again = again.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = (F.col("fault") != "blank") & F.col("first").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("first"))
    small = small.join(again, same, "left").withColumn("fault", F.when(later, "duplicate").otherwise(F.col("fault")))
    small = materialise(small.select(*place, F.left("role", F.lit(1)).alias("initial"), "fault", "copies"), "dialogue-faults")

    kind = rows.schema["conv"].dataType.simpleString()
    parts = small.repartitionByRange(*place).sortWithinPartitions(*place).select("conv", "turn", "initial", "fault", "copies")
    runs = parts.mapInArrow(_runs, f"conv {kind}, edge boolean, {ELEMENT}").withColumn("part", F.spark_partition_id().cast("long"))
    runs = materialise(runs, "dialogue-runs")
    whole, open_ = runs.where("not edge"), runs.where("edge").drop("edge")
    top = open_.agg(F.max("part")).first()[0] or 0
    while True:  # neighbours that one conversation reaches across, at most two runs a partition
        per = open_.groupBy("conv", F.expr(f"part div {RADIX}").alias("group"))
        per = per.agg(F.array_sort(F.collect_list(F.struct("part", *_NAMES))).alias("some"))
        open_ = per.select("conv", F.col("group").alias("part"), "some").mapInArrow(_reduce, f"conv {kind}, part long, {ELEMENT}")
        open_ = materialise(open_, "dialogue-reduced")
        top //= RADIX
        if not top:
            break
    elements = whole.drop("edge").unionByName(open_)
    found = elements.mapInArrow(_finish, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return _applied(materialise(found, "dialogue-audits"), rows.where("copies > 0"), kind)


def _applied(found: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """The audits with the hashes of the repaired conversations: texts move once, audits go before their turns."""
    counts = F.array("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    none = F.lit(None)
    heads = found.select("conv", counts.alias("n"), "audit", none.cast("string").alias("role"), none.cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("binary").alias("digest"))
    lines = rows.select("conv", none.cast("array<long>").alias("n"), none.cast("string").alias("audit"), "role", "text", "copies", F.lit(1).alias("kind"), "turn", "digest")
    order = ["conv", "kind", "turn", "role", "digest"]
    both = heads.unionByName(lines).repartition("conv").sortWithinPartitions(*order)
    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return both.select("conv", "n", "audit", "role", "text", "copies").mapInArrow(_hashes, schema)
