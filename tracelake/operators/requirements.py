"""Markdown documents to requirement points: text groups, tables, table rows, formulas, with their heading paths.

A document is one row and stays one: its lines are folded in one pass by a small helper, as the heading path of a line
depends on all headings before it. Formulas are found by a column expression, documents never shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions.batches import parts

#: The types of points.
TEXT, TABLE, ROW, FORMULA = "描述文本", "表格", "表格行", "公式"
LINE_END = re.compile(T.LINE_END)
HEADING = re.compile(r" {0,3}(#{1,6})(?!#)\s*(.*?)\s*#*\s*$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)\s*$")
RULE = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")
BAR = re.compile(r"(?<!\\)\|")
#: Inline markup whose end is the next sign of some kind, so that a look for it is short.
AUTOLINK = re.compile(r"<(https?://[^<>\s]*|mailto:[^<>\s]*)>")
TAG, COMMENT = re.compile(r"</?[A-Za-z][^<>]*>"), re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>")
EMPHASIS = re.compile(r"\*(?=\S)([^*]*)\*|(?<!\w)_(?=\S)([^_]*)_(?!\w)")
STRONG = re.compile(r"(\*\*|__)(?=\S)")
CLOSED = {"**": re.compile(r"\S\*\*"), "__": re.compile(r"\S__")}
ESCAPE = re.compile(r"\\([\\`*_{}\[\]()#+.!|-])")
#: Escaped characters stand in private code points until the markup is gone.
PRIVATE = 0xE000
HELD = re.compile("[\ue000-\ue07f]")


def _links(text: str, sign: str, keep: bool) -> str:
    """Without links (or images) that begin with a sign, their texts kept or not. What ends at a bracket that opens no address is none, nor
    is what begins before that, so each place is looked at once."""
    out, at = [], 0
    while (start := text.find(sign, at)) >= 0 and (end := text.find("]", start)) >= 0:
        if text[end + 1 : end + 2] != "(":
            out.append(text[at : end + 1])
            at = end + 1
            continue
        if (close := text.find(")", end)) < 0:
            break
        out += [text[at:start], text[start + len(sign) : end] if keep else ""]
        at = close + 1
    return "".join(out) + text[at:]


def _strong(text: str) -> str:
    """Without signs of strong text. Where nothing closes one, nothing closes a later one of its kind either."""
    out, at, place, dead = [], 0, 0, set()
    while len(dead) < len(CLOSED) and (m := STRONG.search(text, place)):
        sign = m[1]
        close = None if sign in dead else CLOSED[sign].search(text, m.end())
        if close is None:
            dead.add(sign)
            place = m.start() + 1
            continue
        out += [text[at : m.start()], text[m.end() : close.end() - 2]]
        at = place = close.end()
    return "".join(out) + text[at:]


def _untagged(text: str) -> str:
    """Without tags and comments; no comment begins behind the last end of one."""
    last = text.rfind("-->") + 3
    return COMMENT.sub("", text[:last]) + TAG.sub("", text[last:]) if last > 2 else TAG.sub("", text)


def inline(line: str) -> str:
    """The text that a line of Markdown shows: no markup, no tags, character references decoded; code spans as they are."""
    out = []
    for k, piece in enumerate(re.split(r"`([^`]+)`", line)):
        if not k % 2:
            piece = ESCAPE.sub(lambda m: chr(PRIVATE + ord(m[1])), piece)
            piece = _links(_links(piece, "![", False), "[", True)
            piece = EMPHASIS.sub(r"\1\2", _strong(_untagged(AUTOLINK.sub(r"\1", piece))))
            piece = HELD.sub(lambda m: chr(ord(m[0]) - PRIVATE), html.unescape(piece))
        out.append(piece)
    return "".join(out).replace("\u00a0", " ").strip()


def table_cells(line: str) -> list[str]:
    """Texts of the cells of a table line; bars at its ends open none."""
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith(r"\|") else line
    return [inline(c) for c in BAR.split(line)]


def cells(line: Column) -> Column:
    """Raw cells of a table line; bars at its ends open none."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.trim(c))


def _row(row: list[str], tag: str) -> str:
    return "<tr>" + "".join(f"<{tag}>{html.escape(c, quote=False)}</{tag}>" for c in row) + "</tr>"


class Points:
    """Points of one document, in order: (type, id, content, cells, context path)."""

    def __init__(self, text: str, formulas: list[str]):
        self.out: list[tuple] = []
        self.path: list[str] = []
        self.buffer: list[str] = []
        lines = LINE_END.split(text)
        self._fold(lines)
        self._flush()
        for k, f in enumerate(formulas):  # formulas stand after all other points and take the last heading's path
            self.out.append((FORMULA, f"formula_{k}", f, None, self.path[:]))

    def _flush(self) -> None:
        if self.buffer:
            self.out.append((TEXT, f"text_{len(self.out)}", "\n".join(self.buffer), None, self.path[:]))
            self.buffer = []

    def _heading(self, level: int, title: str) -> None:
        self._flush()
        self.path = [*self.path[: level - 1], inline(title)]

    def _table(self, rows: list[list[str]]) -> None:
        self._flush()
        head, body = rows[0], rows[1:]
        ident = f"table_{len(self.out)}"
        markup = "<table>" + _row(head, "th") + "".join(_row(r, "td") for r in body) + "</table>"
        self.out.append((TABLE, ident, markup, None, self.path[:]))
        for k, row in enumerate(body):
            self.out.append((ROW, f"{ident}_row_{k}", None, list(dict(zip(head, row)).items()), [*self.path, ident]))

    def _fold(self, lines: list[str]) -> None:
        at, fresh, listed = 0, True, False  # fresh: a block begins; listed: the block before was a list
        while at < len(lines):
            line, following = lines[at], lines[at + 1] if at + 1 < len(lines) else ""
            at += 1
            if not line.strip():
                fresh = True
            elif m := HEADING.match(line):
                self._heading(len(m[1]), m[2])
                fresh, listed = True, False
            elif "|" in line and "|" in following and RULE.match(following) and not RULE.match(line):
                rows = [table_cells(line)]
                at += 1
                while at < len(lines) and "|" in lines[at] and lines[at].strip():
                    rows.append(table_cells(lines[at]))
                    at += 1
                self._table(rows)
                fresh, listed = True, False
            elif fresh and UNDERLINE.match(following) and not ITEM.match(line):
                self._heading(1 if "=" in following else 2, line)
                at += 1
                listed = False
            elif fresh and not listed and re.match(r" {4}|\t", line):
                continue  # a block of code shows no text of its own
            else:
                item = ITEM.match(line)
                listed = bool(item) or listed and line[:1].isspace()
                if shown := inline(line[item.end() :] if item else line):
                    self.buffer.append(shown)
                fresh = False


POINTS = "seq int, type string, id string, content string, cells map<string,string>, context_path array<string>"


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string())]
    names = ["doc", *(x.split()[0] for x in POINTS.replace("map<string,string>", "map").split(", "))]
    for b in parts(batches):
        docs, rows = [], []
        for k, (text, formulas) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            mine = Points(text or "", formulas or []).out
            rows += [(seq, *p) for seq, p in enumerate(mine)]
            docs += [k] * len(mine)
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(docs, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names
        )


def requirement_points(docs: DataFrame, doc_col: str = "doc", content_col: str = "content") -> DataFrame:
    """``doc, seq, type, id, content, cells, context_path, context`` in document order, formulas last.

    Null and empty documents have no points; rows that repeat a document repeat its points. Short table rows lack the
    cells that they do not have, of equal headers the last cell counts.
    """
    text = F.col(content_col)
    rows = docs.select(F.col(doc_col).alias("doc"), text.alias("text"), T.formulas(F.coalesce(text, F.lit(""))).alias("formulas"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(_points, f"doc {kind}, {POINTS}").withColumn("context", F.array_join("context_path", " > "))


BLOCKS = "block int, kind string, start long, end long, text string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of non-blank lines, headings apart, by character offsets in the text."""
    for b in parts(batches):
        docs, rows = [], []
        for k, text in enumerate(b.column(1).to_pylist()):
            at, spans = 0, []
            for line in (text or "").split("\n"):
                if line.strip():
                    kind = "heading" if HEADING.match(line) else "table" if "|" in line else "item" if ITEM.match(line) else "text"
                    if spans and kind in ("text", "table") and spans[-1][0] == kind and spans[-1][2] == at - 1:
                        spans[-1][2] = at + len(line)
                    else:
                        spans.append([kind, at, at + len(line)])
                at += len(line) + 1
            rows += [(n, kind, s, e, text[s:e]) for n, (kind, s, e) in enumerate(spans)]
            docs += [k] * len(spans)
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(docs, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc", *(x.split()[0] for x in BLOCKS.split(", "))]
        )


def source_blocks(docs: DataFrame, doc_col: str = "doc", content_col: str = "content") -> DataFrame:
    """``doc, block, kind, start, end, text``: the blocks of Markdown that a viewer shows, with the half-open ranges of
    characters that they come from, in a text with Unix line ends. Null and empty documents have none."""
    rows = docs.select(F.col(doc_col).alias("doc"), T.regularize(F.col(content_col), "plain").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(_blocks, f"doc {kind}, {BLOCKS}")


def heading_paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, ordinal, level (0: paragraph), text``: headings and paragraphs of HTML in order, tags taken out.

    A paragraph ends at its end tag or at the next paragraph or heading. Character references stay as they are.
    """
    body = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<(h[1-6]|p)\b[^>]*>((?:(?!</?(?:h[1-6]|p)\b).)*)"), F.lit(0))
    rows = pages.select(F.col(id_col).alias("id"), F.posexplode(found).alias("ordinal", "piece"))
    tag = F.lower(F.regexp_extract("piece", r"(?i)^<(h[1-6]|p)", 1))
    shown = F.trim(F.regexp_replace(F.regexp_replace("piece", r"(?s)<[^>]*>", ""), r"\s+", " "))
    level = F.when(tag == "p", 0).otherwise(F.substring(tag, 2, 1).cast("int"))
    return rows.select("id", "ordinal", level.alias("level"), shown.alias("text"))
