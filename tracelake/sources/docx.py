"""Word documents to Markdown: headings, paragraphs, bullets, tables.

Reading the package is a small helper that yields a row per block; joining the blocks to Markdown is a Spark job, so a
document of any number of blocks is put together by the engine. Office math becomes LaTeX; embedded equation objects
are listed, not converted (see the README).
"""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions import omml
from tracelake.functions.batches import PART, parts

R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "path string, seq int, kind string, level int, text string, cells array<string>, error string"


def _run(run, media: dict[str, str], escape: bool) -> str:
    out = []
    for part in run:
        if part.tag == f"{W}t":
            text = html.escape(part.text or "", quote=False) if escape else part.text or ""
            out.append(text.replace("\u00a0", "&nbsp;"))
        elif part.tag == f"{W}br" and part.get(f"{W}type") == "page":
            out.append('<div class="page"></div>')
        elif part.tag in (f"{W}br", f"{W}cr"):
            out.append("<br>")
        elif part.tag == f"{W}tab":
            out.append("\t")
        elif part.tag in (f"{W}drawing", f"{W}object", f"{W}pict"):
            ids = [v for x in part.iter() for k, v in x.attrib.items() if k in (f"{R}embed", f"{R}id")]
            out += [f'<img src="{media.get(i, i)}">' for i in ids[:1]]
    return "".join(out)


def _text(node, media: dict[str, str], escape: bool = False) -> str:
    """Runs and formulas of a paragraph, inserted ones included; deleted and hyperlink runs are left out."""
    out = []
    for child in node:
        if child.tag == f"{W}r":
            out.append(_run(child, media, escape))
        elif child.tag in (f"{W}ins", f"{W}smartTag"):
            out += [_run(r, media, escape) for r in child.findall(f"{W}r")]
        elif child.tag == f"{omml.M}oMath":
            out.append(f"${omml.latex(child).strip()}$")
        elif child.tag == f"{omml.M}oMathPara":
            out += [f"$$ {omml.latex(x).strip()} $$" for x in child.findall(f"{omml.M}oMath")]
    return "".join(out)


def _media(z: zipfile.ZipFile) -> dict[str, str]:
    """Relation id to path of a document's images and objects."""
    if "word/_rels/document.xml.rels" not in z.namelist():
        return {}
    return {r.get("Id", ""): r.get("Target", "") for r in ET.fromstring(z.read("word/_rels/document.xml.rels"))}


def _blocks(content: bytes) -> Iterator[tuple]:
    """``(kind, level, text, cells)`` of the body's paragraphs and table rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body, media = ET.fromstring(z.read("word/document.xml")).find(f"{W}body"), _media(z)
    for node in body if body is not None else []:
        if node.tag == f"{W}p":
            style = node.find(f"{W}pPr/{W}pStyle")
            name = style.get(f"{W}val", "") if style is not None else ""
            item = node.find(f"{W}pPr/{W}numPr/{W}ilvl")
            digits = name.removeprefix("Heading")
            if digits.isdigit() and 1 <= int(digits) <= 8:
                yield "heading", int(digits), _text(node, media), None
            elif item is not None:
                yield "item", int(item.get(f"{W}val", "0")), _text(node, media), None
            else:
                yield "text", 0, _text(node, media), None
        elif node.tag == f"{W}tbl":
            for k, row in enumerate(node.findall(f"{W}tr")):
                cells = []
                for cell in row.findall(f"{W}tc"):
                    span = cell.find(f"{W}tcPr/{W}gridSpan")
                    text = " ".join(_text(p, media) for p in cell.iter(f"{W}p")).replace("|", r"\|")
                    cells += [text] + [""] * (int(span.get(f"{W}val", "1")) - 1 if span is not None else 0)
                yield "row", k, None, cells


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        rows = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            try:
                rows += [(path, k, *block, None) for k, block in enumerate(_blocks(content.as_py()))]
            except (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError) as e:
                rows.append((path, 0, "error", 0, None, None, f"{type(e).__name__}: {e}"))
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]
        cols = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "seq", "kind", "level", "text", "cells", "error"])


def blocks(files: DataFrame) -> DataFrame:
    """One row per block of ``files (path, content BINARY)``; a file that is no document gives one error row."""
    return files.select("path", "content").mapInArrow(_read, BLOCKS)


def to_markdown(files: DataFrame) -> DataFrame:
    """``path, markdown, error``; no partial output: a file with an error has none.

    A table's first row is its Markdown header, and merged cells leave empty ones. A formula that runs over paragraphs,
    as an odd number of dollar signs says, stays one paragraph. Images name their path in the document (see ``media``).
    """
    line = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.least("level", F.lit(6))), F.lit(" "), "text"))
        .when(F.col("kind") == "item", F.concat(F.repeat(F.lit("    "), F.col("level")), F.lit("- "), "text"))
        .when(F.col("kind") == "row", F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |")))
        .otherwise(F.col("text"))
    )
    ruled = F.when(
        (F.col("kind") == "row") & (F.col("level") == 0),
        F.concat("line", F.lit("\n|"), F.repeat(F.lit(" --- |"), F.size("cells"))),
    ).otherwise(F.col("line"))
    # Rows of a table adjoin; everything else is parted by an empty line.
    dollars = F.when(F.col("kind") == "text", F.length(F.regexp_replace("text", r"[^$]", ""))).otherwise(0)
    before = F.sum(dollars).over(Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    open_formula = (F.col("kind") == "text") & (F.coalesce(before, F.lit(0)) % 2 == 1)
    gap = F.when(open_formula | (F.col("kind") == "row") & (F.col("level") > 0), F.lit("\n")).otherwise(F.lit("\n\n"))
    rows = blocks(files).withColumn("gap", gap).withColumn("line", line).withColumn("piece", F.concat("gap", ruled))
    per = rows.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("p"), F.max("error").alias("error")
    )
    text = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    clean = F.regexp_replace(F.regexp_replace(text, r"^\n+|\n+$", ""), r"\n{2,}", "\n\n")
    return per.select("path", F.when(F.col("error").isNull(), clean).alias("markdown"), "error")


def pending(files: DataFrame, converted: DataFrame) -> DataFrame:
    """Files whose content was not converted yet, by content hash."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    return hashed.join(converted.select("sha256"), "sha256", "left_anti")


RELATIONS = "path string, id string, kind string, target string, n_bytes long"


def _relations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        rows = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    sizes = {i.filename: i.file_size for i in z.infolist()}
                    for r in ET.fromstring(z.read("word/_rels/document.xml.rels")):
                        target = r.get("Target", "")
                        rows.append((path, r.get("Id"), r.get("Type", "").rpartition("/")[2], target, sizes.get(f"word/{target}")))
            except (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError):
                continue
        cols = list(zip(*rows)) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "id", "kind", "target", "n_bytes"])


def relations(files: DataFrame) -> DataFrame:
    """What documents refer to: images (``media/*``), embedded objects (``embeddings/*.bin``), links."""
    return files.select("path", "content").mapInArrow(_relations, RELATIONS)


def images(files: DataFrame) -> DataFrame:
    return relations(files).where(F.startswith("target", F.lit("media/")))


def embedded_objects(files: DataFrame) -> DataFrame:
    return relations(files).where(F.col("target").rlike(r"^embeddings/.*\.bin$"))


def _media_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], ["path", "target", "content"])

    for b in parts(batches):
        rows, held = [], 0
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        if name.startswith("word/media/") and not name.endswith("/"):
                            rows.append((path, name.removeprefix("word/"), z.read(name)))
                            held += len(rows[-1][2])
                            if held > PART:  # images may be compressed, so many are more than the part they come from
                                yield batch(rows)
                                rows, held = [], 0
            except (zipfile.BadZipFile, TypeError):
                continue
        if rows:
            yield batch(rows)


def media(files: DataFrame) -> DataFrame:
    """``path, target, content``: the images in documents, under the paths that Markdown names; not transcoded."""
    return files.select("path", "content").mapInArrow(_media_bytes, "path string, target string, content binary")


def convert(files: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Write Markdown and media of documents as tables below a folder; returns both as read back."""
    spark = files.sparkSession
    out = []
    for name, df in (("markdown", to_markdown(files)), ("media", media(files))):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        out.append(spark.read.schema(df.schema).parquet(f"{folder}/{name}"))
    return out[0], out[1]


CELLS = "path string, tbl int, row int, cell int, span int, merge string, text string"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        rows = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    body, media = ET.fromstring(z.read("word/document.xml")).find(f"{W}body"), _media(z)
            except (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError):
                continue
            for t, table in enumerate(body.findall(f"{W}tbl") if body is not None else []):
                for r, row in enumerate(table.findall(f"{W}tr")):
                    for c, cell in enumerate(row.findall(f"{W}tc")):
                        span, merge = cell.find(f"{W}tcPr/{W}gridSpan"), cell.find(f"{W}tcPr/{W}vMerge")
                        n = int(span.get(f"{W}val", "1")) if span is not None else 1
                        state = None if merge is None else merge.get(f"{W}val", "continue")
                        rows.append((path, t, r, c, n, state, "<br>".join(_text(p, media, escape=True) for p in cell.findall(f"{W}p"))))
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in CELLS.split(", ")])


def table_cells(files: DataFrame) -> DataFrame:
    """Cells with grid column and row span: a cell that restarts a vertical merge spans the continuing ones below it."""
    cells = files.select("path", "content").mapInArrow(_cells, CELLS)
    before = Window.partitionBy("path", "tbl", "row").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("grid", F.coalesce(F.sum("span").over(before), F.lit(0)).cast("int"))
    down = Window.partitionBy("path", "tbl", "grid").orderBy("row")
    covered = F.coalesce(F.col("merge") == "continue", F.lit(False))
    group = F.sum(F.when(covered, 0).otherwise(1)).over(down.rowsBetween(Window.unboundedPreceding, 0))
    height = F.count("*").over(Window.partitionBy("path", "tbl", "grid", "__g"))
    return cells.withColumn("covered", covered).withColumn("__g", group).withColumn("rows", height.cast("int")).drop("__g")


def html_tables(files: DataFrame) -> DataFrame:
    """``path, tbl, html``: tables with column and row spans."""

    def attribute(name: str, n) -> Column:
        return F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise(F.lit(""))

    cells = table_cells(files).where("not covered")
    td = F.concat(F.lit("<td"), attribute("colspan", F.col("span")), attribute("rowspan", F.col("rows")), F.lit(">"), "text", F.lit("</td>"))
    rows = cells.withColumn("td", td).groupBy("path", "tbl", "row").agg(F.array_sort(F.collect_list(F.struct("cell", "td"))).alias("c"))
    line = F.concat(F.lit("<tr>"), F.array_join(F.transform("c", lambda x: x["td"]), ""), F.lit("</tr>"))
    per = rows.withColumn("tr", line).groupBy("path", "tbl").agg(F.array_sort(F.collect_list(F.struct("row", "tr"))).alias("r"))
    return per.select("path", "tbl", F.concat(F.lit("<table>"), F.array_join(F.transform("r", lambda x: x["tr"]), ""), F.lit("</table>")).alias("html"))
