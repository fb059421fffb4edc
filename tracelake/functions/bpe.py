"""Token counts of a byte-pair vocabulary that is read from a file: pieces of a text, ranked merges of the bytes of a piece.

A vocabulary has a line a token, its bytes in base64 and its rank. A text is cut to pieces by a column expression; the
neighbours of the lowest rank, the leftmost of equal ones, become one token until no two neighbours are a token. Pieces repeat, so a
worker merges each distinct one once, as long as its memory of them lasts. No vocabulary is trained or kept here.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: how texts are cut to pieces for byte-level vocabularies.
PIECES = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens that a vocabulary has at most: it goes to every task.
MOST = 1 << 20
#: Pieces that a task remembers.
REMEMBERED = 1 << 18


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece. Candidates wait in a heap by rank and place, so a piece of n bytes takes n log n steps."""
    if piece in ranks or len(piece) < 2:
        return [piece] if piece else []
    ends = list(range(1, len(piece) + 1))  # of the token that starts at a place; 0: no token starts there any more
    before = list(range(-1, len(piece) - 1))  # where the token before it starts
    waiting: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        middle = ends[at]
        if middle < len(piece):
            rank = ranks.get(piece[at : ends[middle]])
            if rank is not None:
                heapq.heappush(waiting, (rank, at, ends[middle]))

    for at in range(len(piece) - 1):
        offer(at)
    while waiting:
        _, at, end = heapq.heappop(waiting)
        middle = ends[at]
        if not middle or middle >= len(piece) or ends[middle] != end:
            continue  # one of the two has merged meanwhile
        ends[at], ends[middle] = end, 0
        if end < len(piece):
            before[end] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    out, at = [], 0
    while at < len(piece):
        out.append(piece[at : ends[at]])
        at = ends[at]
    return out


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The vocabulary at a path that Spark reads; lines of another form, and more than ``MOST`` of them, are an error."""
    rows = spark.read.text(path).where("trim(value) <> ''").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} tokens: {path}")
    pairs = (r["value"].split() for r in rows)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def pieces(text: Column) -> Column:
    """``ARRAY<STRING>``: the pieces of a text; none of a null or empty one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0))


#: Of a worker process: counts of pieces by the vocabulary in use, the last one only.
_MEMORY: dict[str, Callable[[str], int]] = {}


def _remembering(key: str, ranks: dict[bytes, int]) -> Callable[[str], int]:
    if key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[key] = lru_cache(REMEMBERED)(lambda piece: len(merged(piece.encode(), ranks)))
    return _MEMORY[key]


def counter(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """A function from an array of texts, such as the lines of a file, to an array of their numbers of tokens."""
    shared, key = spark.sparkContext.broadcast(read_ranks(spark, path)), uuid.uuid4().hex

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def counts(texts: pa.Array) -> pa.Array:
        n = _remembering(key, shared.value)
        return pa.array([None if row is None else [sum(map(n, text)) for text in row] for row in texts.to_pylist()], pa.list_(pa.int32()))

    return lambda texts: counts(F.transform(texts, pieces))


def count(counts: Callable[[Column], Column], text: Column) -> Column:
    """Tokens of one text, by what ``counter`` made."""
    return counts(F.array(F.coalesce(text, F.lit(""))))[0]
