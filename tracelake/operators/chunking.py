"""Token-budget chunks of code that keep functions, classes and namespaces whole.

Packing is greedy and depends on all that was packed before, so it is a small per-file helper; numbering and token
counts are columns, and a file is one row throughout: no shuffle.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions.batches import parts

#: What stands between statements: blanks, comments, preprocessor lines, labels of access.
BETWEEN = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/|\#[^\n]*|\b(?:public|private|protected)\s*:(?!:))+", re.S)
#: Words that open a block of their own, and words before a parenthesis that name no function.
TYPES = set("namespace class struct union enum".split())
CONTROL = set("if else for while do switch catch try return sizeof new delete throw case defined decltype alignas".split())
WORD = re.compile(r"[A-Za-z_~]\w*|\S")


#: What begins the list of a constructor.
LIST = re.compile(r"\)[^:;{}()]*:(?!:)")


def is_member(head: str) -> bool:
    """Whether the name before a brace is a member of a constructor's list, which the braces initialise."""
    named = head.rstrip()
    if not named or not (named[-1] == ">" or named[-1].isalnum() or named[-1] == "_"):
        return False
    m = LIST.search(head)
    return m is not None and m.end() < len(named)


def opens_block(head: str) -> bool:
    """Whether the statement before a brace declares a type, a name space or a function."""
    words = WORD.findall(BETWEEN.sub(" ", head))
    depth, name, before = 0, None, []
    for k, w in enumerate(words):
        if w == "(":
            if depth == 0 and name is None:
                name, before = (words[k - 1] if k else ""), words[: k - 1]
            depth += 1
        elif w == ")":
            depth -= 1
            if depth < 0:
                return False  # the rest of a loop's head
        elif w == "=" and depth == 0 and "operator" not in words:
            return False
    if depth or not words or CONTROL & set(words[: 1 + words.index("(") if "(" in words else None]):
        return False
    if name is None:
        return bool(TYPES & set(words))
    return name[:1].isalpha() or name[:1] in ("_", "~") or "operator" in before


def protected_blocks(code: str) -> list[tuple[int, int]]:
    """Outermost blocks as (first line, last line), from one; unbalanced ones are left out. All braces count, one pass."""
    ends = [m.start() for m in re.finditer("\n", code)]
    blocks, stack, last = [], [], 0
    for m in re.finditer(r"[{};]", code):
        at = m.start()
        if m[0] == "{":
            head = code[last:at]
            skip = BETWEEN.match(head)
            member = is_member(head)
            stack.append((None if member or not opens_block(head) else last + (skip.end() if skip else 0), last if member else None))
        elif m[0] == "}" and stack:
            start, resume = stack.pop()
            if start is not None:
                blocks.append((bisect.bisect_left(ends, start) + 1, bisect.bisect_left(ends, at) + 1))
            if resume is not None:  # the statement goes on
                last = resume
                continue
        last = at + 1
    outer: list[tuple[int, int]] = []
    for start, end in sorted(blocks, key=lambda b: (b[0], -b[1])):
        if not outer or start > outer[-1][1]:
            outer.append((start, end))
    return outer


def pack(counts: list[int], blocks: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Chunks (first line, last line): as many whole lines or blocks as fit; what is larger than the budget stands alone."""
    units, line = [], 1
    for start, end in blocks:
        units += [(k, k) for k in range(line, start)] + [(start, min(end, len(counts)))]
        line = end + 1
    units += [(k, k) for k in range(line, len(counts) + 1)]
    chunks: list[tuple[int, int]] = []
    room = 0
    for start, end in units:
        size = sum(counts[start - 1 : end])
        if chunks and size <= room:
            chunks[-1], room = (chunks[-1][0], end), room - size
        else:
            chunks.append((start, end))
            room = budget - size
    return chunks


def _chunks(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = [
                (file, k, start, end, "".join(f"{n}: {lines[n - 1]}\n" for n in range(start, end + 1)))
                for file, lines, counts in zip(*(b.column(i).to_pylist() for i in range(3)))
                for k, (start, end) in enumerate(pack(counts, protected_blocks("\n".join(lines)), budget))
            ]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)], ["file", "chunk_no", "start_line", "end_line", "content"]
            )

    return run


def token_count(line):
    """Tokens of a line: words and single other characters. A column, so another tokenizer can take its place."""
    return F.size(F.regexp_extract_all(line, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))


def token_budget_chunks(
    files: DataFrame, budget: int = 10_000, file_col: str = "file", content_col: str = "content", tokens=token_count, line_tokens=None
) -> DataFrame:
    """``file, chunk_no, start_line, end_line, content`` of every file. Null and empty contents have no chunk.

    ``tokens`` counts those of a line, by a column expression; ``line_tokens`` instead those of all lines at once, from an
    array to an array, as ``bpe.counter`` does.
    """
    lines, numbered = T.lines(F.col(content_col)), T.numbered(F.col(content_col))
    counts = line_tokens(numbered) if line_tokens else F.transform(numbered, tokens)
    rows = files.select(F.col(file_col).alias("file"), lines.alias("lines"), counts.alias("counts"))
    kind = rows.schema["file"].dataType.simpleString()
    return rows.mapInArrow(_chunks(budget), f"file {kind}, chunk_no int, start_line int, end_line int, content string")
