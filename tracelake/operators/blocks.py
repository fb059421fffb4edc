"""Markdown as a tree of blocks: quotes, lists in lists, items, and what stands in them, with offsets in the source.

A line goes down the containers that are open as far as its signs (``>``, the indent of an item) carry, then opens new ones; what is left
of it is a leaf or goes on with one. A document is one row and stays one; the fold is a small helper with a stack.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions.batches import parts

ITEM = re.compile(r"([-+*]|\d{1,9}[.)])(?= |\t|$)")
HEADING = re.compile(r"(#{1,6})(?=\s|$)")
FENCE = re.compile(r"(`{3,}|~{3,})\s*([^\s`]*)[^`]*$")
RULE = re.compile(r"(?:\*\s*){3,}$|(?:-\s*){3,}$|(?:_\s*){3,}$")
UNDERLINE = re.compile(r"(=+|-+)\s*$")
DELIMITER = re.compile(r"\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
SHOWN = re.compile(r"[^ \t]")


def _shown(line: str, col: int) -> int:
    """Where the next character stands that is no blank; the end of the line if none does."""
    m = SHOWN.search(line, col)
    return m.start() if m else len(line)


class Tree:
    """Nodes of a document in the order of their begins: [kind, parent, depth, start, end, info]."""

    def __init__(self, text: str):
        self.nodes: list[list] = []
        #: Open containers: (node, kind, columns that a line of an item is indented by, at least).
        self.open: list[tuple[int, str, int]] = []
        #: The open leaf, if any: node, kind, and for fenced code its fence.
        self.leaf: tuple[int, str, str] | None = None
        at = 0
        for line in text.split("\n"):
            self._line(line, at)
            at += len(line) + 1

    def _add(self, kind: str, start: int, end: int, info: str = "") -> int:
        parent = self.open[-1][0] if self.open else -1
        self.nodes.append([kind, parent, self.nodes[parent][2] + 1 if parent >= 0 else 0, start, end, info])
        return len(self.nodes) - 1

    def _reach(self, end: int) -> None:
        """What is open reaches to here."""
        for node, _, _ in self.open:
            self.nodes[node][4] = end
        if self.leaf:
            self.nodes[self.leaf[0]][4] = end

    def _line(self, line: str, at: int) -> None:
        col, depth, end = 0, 0, at + len(line)
        while depth < len(self.open):  # containers that the line is in
            _, kind, indent = self.open[depth]
            blank = _shown(line, col)
            if kind == "quote":
                if blank - col > 3 or line[blank : blank + 1] != ">":
                    break
                col = blank + 1 + (line[blank + 1 : blank + 2] == " ")
            elif kind == "item":
                if blank < len(line) and blank - col < indent:
                    break
                col = min(col + indent, len(line)) if blank < len(line) else len(line)
            depth += 1
        rest = line[col:]
        whole = depth == len(self.open)
        if self.leaf and self.leaf[1] == "code" and whole and self.leaf[2]:  # fenced code goes on, or ends
            self._reach(end)
            if re.fullmatch(rf"\s{{0,3}}{re.escape(self.leaf[2][0])}{{{len(self.leaf[2])},}}\s*", rest):
                self.leaf = None
            return
        if not rest.strip():
            if self.leaf and self.leaf[1] != "code":
                self.leaf = None
            if not whole and any(k == "quote" for _, k, _ in self.open[depth:]):
                self._close(depth)
            return
        if not whole and self.leaf and self.leaf[1] == "paragraph" and not self._begins(rest):
            self._reach(end)  # a paragraph goes on without the signs of its containers
            return
        if not whole:
            self._close(depth)
        col = self._containers(line, col, at)
        rest = line[col:].strip()
        if rest:
            self._content(line, col, at)
        self._reach(end)

    def _close(self, depth: int) -> None:
        del self.open[depth:]
        self.leaf = None

    @staticmethod
    def _begins(rest: str) -> bool:
        text = rest.strip()
        return bool(text[:1] == ">" or ITEM.match(text) or HEADING.match(text) or FENCE.match(text) or RULE.match(text))

    def _containers(self, line: str, col: int, at: int) -> int:
        """Opens the quotes and items that the rest of a line begins with; where its content begins."""
        signs = len(line.rstrip("-*_ \t"))  # what could be a rule begins behind this
        while True:
            start = _shown(line, col)
            in_list = bool(self.open) and self.open[-1][1] == "list"
            if start - col > 3 or start == len(line):
                break
            m = ITEM.match(line, start)
            if line[start] == ">":
                if in_list:
                    self._close(len(self.open) - 1)
                self.leaf = None
                self.open.append((self._add("quote", at + start, at + len(line)), "quote", 0))
                col = start + 1 + (line[start + 1 : start + 2] == " ")
            elif m and not (start >= signs and RULE.match(line, start)):
                sign = m[1][-1]
                if in_list and self.nodes[self.open[-1][0]][5][-1] != sign:
                    self._close(len(self.open) - 1)
                    in_list = False
                self.leaf = None
                if not in_list:
                    self.open.append((self._add("list", at + start, at + len(line), ("1" if m[1][0].isdigit() else "") + sign), "list", 0))
                after = _shown(line, m.end())
                pad = after - m.end() if after < len(line) and after - m.end() < 5 else 1
                self.open.append((self._add("item", at + start, at + len(line)), "item", start - col + m.end() - start + pad))
                col = min(m.end() + pad, len(line))
            else:
                if in_list:  # the list is over
                    self._close(len(self.open) - 1)
                break
        return col

    def _content(self, line: str, col: int, at: int) -> None:
        start = _shown(line, col)
        text, end = line[start:].rstrip(), at + len(line)
        kind = self.leaf[1] if self.leaf else ""
        if kind == "paragraph" and (m := UNDERLINE.match(text)):
            self.nodes[self.leaf[0]][0], self.nodes[self.leaf[0]][5] = "heading", "1" if m[1][0] == "=" else "2"
            self._reach(end)
            self.leaf = None
        elif kind == "paragraph" and "|" in text and DELIMITER.match(text) and "\n" not in self.nodes[self.leaf[0]][5] and "|" in self.nodes[self.leaf[0]][5]:
            self.nodes[self.leaf[0]][0], self.nodes[self.leaf[0]][5] = "table", ""
            self.leaf = (self.leaf[0], "table", "")
        elif kind == "table" and "|" in text:
            pass
        elif kind == "code" and start - col >= 4:
            pass
        elif start - col >= 4 and kind != "paragraph":
            self.leaf = (self._add("code", at + start, end), "code", "")
        elif m := HEADING.match(text):
            self._add("heading", at + start, end, str(len(m[1])))
            self.leaf = None
        elif m := FENCE.match(text):
            self.leaf = (self._add("code", at + start, end, m[2]), "code", m[1])
        elif RULE.match(text):
            self._add("rule", at + start, end)
            self.leaf = None
        elif kind == "paragraph":
            self.nodes[self.leaf[0]][5] = "\n"  # of several lines: its last cannot be the head of a table
        else:
            self.leaf = (self._add("paragraph", at + start, end, "|" if "|" in text else ""), "paragraph", "")


SCHEMA = "node int, parent int, depth int, kind string, start long, end long, info string"


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    for b in parts(batches):
        docs, rows = [], []
        for k, text in enumerate(b.column(1).to_pylist()):
            nodes = Tree(text or "").nodes
            rows += [(n, None if p < 0 else p, d, kind, s, e, "" if kind == "paragraph" else info) for n, (kind, p, d, s, e, info) in enumerate(nodes)]
            docs += [k] * len(nodes)
        cols = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs, pa.int64())), *map(pa.array, cols, kinds)], ["doc", *(x.split()[0] for x in SCHEMA.split(", "))])


def block_tree(docs: DataFrame, doc_col: str = "doc", content_col: str = "content") -> DataFrame:
    """``doc, node, parent, depth, kind, start, end, info``: the blocks of Markdown in order, with the block that holds each (null
    at the top) and the half-open range of characters that it comes from, in a text with Unix line ends.

    Kinds: heading (info: level), paragraph, quote, list (info: its sign, after a 1 if it is numbered), item, code (info:
    language), table, rule. Null and empty documents have none; rows that repeat a document repeat its blocks.
    """
    rows = docs.select(F.col(doc_col).alias("doc"), T.regularize(F.col(content_col), "plain").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(_trees, f"doc {kind}, {SCHEMA}")
