"""Queries of Word documents that are built from tables, of files in other encodings, of model calls by a stub, and of exports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tracelake.functions import replies
from tracelake.functions.batches import parts
from tracelake.functions.text import regularize
from tracelake.operators import align, annotations
from tracelake.sources import docx, json_files, repo, scratch

SPACES = (
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
)


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word packages from (path, markup of the body, relations, image); a null body is a file that is none."""
    for part in parts(batches):
        out = []
        for b, r, i in zip(*(part.column(k).to_pylist() for k in (1, 2, 3))):
            data = io.BytesIO()
            if b is not None:
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr("word/document.xml", f"<w:document {SPACES}><w:body>{b}</w:body></w:document>")
                    z.writestr("word/_rels/document.xml.rels", f"<Relationships>{r}</Relationships>")
                    z.writestr("word/media/i.png", i)
            out.append(data.getvalue() if b is not None else b"no package")
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["path", "content"])


def _p(*runs, style=""):
    return F.concat(F.lit(f"<w:p><w:pPr>{style}</w:pPr>"), *[F.lit(r) if isinstance(r, str) else r for r in runs], F.lit("</w:p>"))


def _r(*text):
    return F.concat(F.lit("<w:r><w:t>"), *[F.lit(x) if isinstance(x, str) else x for x in text], F.lit("</w:t></w:r>"))


def _tc(text, props=""):
    return F.concat(F.lit(f"<w:tc><w:tcPr>{props}</w:tcPr>"), _p(_r(text)), F.lit("</w:tc>"))


def _documents(spark, sf_dir):
    """A Word document for each customer: every kind of paragraph, formulas, an image, a table of orders with merged cells; a
    tenth are broken files."""
    k = F.col("c_custkey").cast("string")
    orders = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    c = _t(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    row = lambda x: F.concat(
        F.lit("<w:tr>"), _tc(x["o_orderkey"].cast("string")), _tc(F.concat(x["o_orderstatus"], F.lit("|x"))), _tc("", "<w:vMerge/>"), F.lit("</w:tr>")
    )
    rows = F.coalesce(F.array_join(F.transform("o", row), ""), F.lit(""))
    head = F.concat(F.lit("<w:tr>"), _tc("order", '<w:gridSpan w:val="2"/>'), _tc(F.concat(F.lit("of "), k), '<w:vMerge w:val="restart"/>'), F.lit("</w:tr>"))
    math = F.concat(F.lit("<m:oMath><m:f><m:num><m:r><m:t>"), k, F.lit("</m:t></m:r></m:num><m:den><m:r><m:t>α</m:t></m:r></m:den></m:f></m:oMath>"))
    body = F.concat(
        _p(_r(F.col("c_name")), style='<w:pStyle w:val="Heading2"/>'),
        _p(F.lit("<w:bookmarkStart/>"), _r("Segment ", F.col("c_mktsegment")), "<w:r><w:br/><w:t>of</w:t><w:tab/></w:r><w:ins>", _r(k), "</w:ins><w:del>", _r("gone"), "</w:del>"),
        _p(), _p(), _p(_r("$a_", k)), _p(_r("b$")), _p(_r("point"), style='<w:numPr><w:ilvl w:val="1"/></w:numPr>'),
        _p(_r("is "), math, "<w:r><w:drawing><a r:embed=\"r1\"/></w:drawing></w:r>"), _p(F.lit("<m:oMathPara>"), math, F.lit("</m:oMathPara>")),
        F.lit("<w:tbl>"), head, rows, F.lit("</w:tbl><w:sectPr/>"),
    )
    rel = '<Relationship Id="{}" Type="http://t/{}" Target="{}"/>'
    links = F.concat(
        F.lit(rel.format("r1", "image", "media/i.png") + rel.format("r2", "oleObject", "embeddings/o.bin")), F.lit('<Relationship Id="r3" Type="http://t/hyperlink" Target="http://x/'), k, F.lit('"/>')
    )
    path, image = F.concat(F.lit("d"), k, F.lit(".docx")), F.concat(F.lit("image "), k)
    made = c.select(path.alias("path"), F.when(F.col("c_custkey") % 10 != 9, body).alias("body"), links.alias("links"), image.alias("image"))
    return made.mapInArrow(_packages, "path string, content binary")


def docx_markdown(spark, sf_dir):
    return docx.to_markdown(_documents(spark, sf_dir))


def docx_html_tables(spark, sf_dir):
    return docx.html_tables(_documents(spark, sf_dir))


def docx_table_cells(spark, sf_dir):
    """Grid columns and row spans of all cells."""
    return docx.table_cells(_documents(spark, sf_dir)).select("path", "row", "cell", "grid", "rows", "covered")


def docx_relations(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    marks = docx.images(docs).select("path", "id", F.lit("image").alias("found")).unionByName(docx.embedded_objects(docs).select("path", "id", F.lit("object").alias("found")))
    return docx.relations(docs).join(marks, ["path", "id"], "left")


def docx_media(spark, sf_dir):
    return docx.media(_documents(spark, sf_dir)).select("path", "target", F.sha2("content", 256).alias("sha256"))


def docx_converted(spark, sf_dir):
    """Markdown and media written as tables and read back: how many of each a document has."""
    markdown, media = docx.convert(_documents(spark, sf_dir), scratch.folder(spark, "converted"))
    n = media.groupBy("path").agg(F.count("*").alias("n_media"))
    return markdown.join(n, "path", "left").select("path", F.length("markdown").cast("long").alias("n_chars"), F.coalesce("n_media", F.lit(0)).cast("long").alias("n_media"))


def decoded_files(spark, sf_dir):
    """Texts as files, a third of them in another encoding than UTF-8, read back."""
    docs = _t(spark, sf_dir, "documents")
    odd = (F.col("doc_id") % 3 == 0) & F.col("text").rlike(r"^[\x00-\xFF]*$")
    data = F.when(odd, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return repo.read_text(docs.select(F.col("doc_id").cast("string").alias("path"), data.alias("content")), "latin-1")


def resolved_documents(spark, sf_dir):
    """Names of documents to their Markdown: itself, or what a Word document was converted to."""
    d = _t(spark, sf_dir, "documents")
    texts = d.select(F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), regularize(F.col("text")).alias("content"))
    names = d.select(F.concat(F.lit("n"), (F.col("doc_id") * 2).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".docx")).alias("name"))
    return repo.resolve_documents(names, texts).select("name", F.sha2("content", 256).alias("sha256"))


def valid_projects(spark, sf_dir):
    """Whether the tables' folders make a project: pages are its code, documents its documents, nations its metadata."""
    code = _t(spark, sf_dir, "pages").select(F.concat(F.lit("code_repo/"), "page_id").alias("path"))
    docs = _t(spark, sf_dir, "documents").select(F.concat(F.lit("doc_repo/"), "doc_id").alias("path"))
    return repo.valid_project(code.unionByName(docs), _t(spark, sf_dir, "nation").select(F.col("n_name").alias("project_name")))


def history_file(spark, sf_dir):
    """Histories written as JSON files, fifty of them, and read back; one that is not there, and records that are not, are empty."""
    ev = _t(spark, sf_dir, "events")
    entry = F.struct(F.concat(F.lit("e"), "event_id").alias("name"), F.concat(F.lit("/p/"), "event_id").alias("path"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("last_opened"))
    per = ev.groupBy((F.col("user_id") % 50).alias("of")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    folder = scratch.folder(spark, "history")
    per.repartition("of").write.mode("overwrite").partitionBy("of").text(folder)
    none = json_files.read_or_empty(spark, f"{folder}-absent", "projects").select(F.col("project_name").alias("name"), F.col("project_location").alias("path"), F.col("create_time").alias("last_opened"))
    return json_files.history(spark, folder).unionByName(json_files.history(spark, f"{folder}-absent")).unionByName(none)


def upload_totals(spark, sf_dir):
    """Files and non-blank lines after an upload that replaces half of the pages."""
    pages = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), "page_id").alias("path"), "html")
    cur = pages.select("path", F.col("html").alias("content"))
    new = pages.where("page_id % 2 = 0").select("path", F.concat("html", F.lit("\nmore\n\nlines")).alias("content"), F.col("page_id").alias("ordinal"))
    return annotations.upload_totals(annotations.upload(cur, new, "code", "/p"))


def _points(spark, sf_dir):
    """A point for each order: its customer's words as requirement, its lines as related code."""
    line = F.struct(F.col("l_linenumber"), F.concat(F.lit("f"), "l_partkey").alias("filename"), F.concat(F.lit("x = "), F.col("l_suppkey").cast("string")).alias("content"))
    code = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("relatedCode"))
    return code.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("need {"), "l_orderkey", F.lit("}")).alias("requirement"), "relatedCode")


def prompts(spark, sf_dir):
    """Prompts of reviews, as hashes, and the code that they quote."""
    made = align.prompt(align.REVIEW, requirement=F.col("requirement"), code=align.code_context(F.col("relatedCode")))
    return _points(spark, sf_dir).select("id", align.code_context(F.col("relatedCode")).alias("context"), align.prompt_key(made).alias("prompt"))


def _stub():
    """A client that quotes the length of its prompt; it answers nothing to some, and wraps its answer as a review."""
    return lambda texts: [None if len(t) % 10 == 3 else f" length {len(t)}\n{replies.END_OF_REVIEW}\n 在[f]处 {len(t)} " for t in texts]


def review_with_stub(spark, sf_dir):
    return align.review(_points(spark, sf_dir), _stub).select("id", "review_process", "issues")


def generate_with_stub(spark, sf_dir):
    return align.generate(_points(spark, sf_dir), _stub).select("id", "generatedRequirement")


def exported_records(spark, sf_dir):
    """Orders exported as JSON text with their lines."""
    line = F.struct(F.col("l_linenumber").alias("start"), F.col("l_returnflag").alias("flag"))
    per = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("ranges"))
    return json_files.export(per)


QUERIES = [
    docx_markdown, docx_html_tables, docx_table_cells, docx_relations, docx_media, docx_converted, decoded_files, resolved_documents, valid_projects, history_file,
    upload_totals, prompts, review_with_stub, generate_with_stub, exported_records,
]

ORDERS = "SELECT o_custkey AS k, o_orderkey AS o, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders"
GOOD = "SELECT *, c_custkey AS k, 'd' || c_custkey || '.docx' AS path FROM customer WHERE c_custkey % 10 <> 9"
MARKDOWN = f"""
    SELECT path, '## ' || c_name || chr(10) || chr(10) || 'Segment&nbsp;' || c_mktsegment || '<br>of' || chr(9) || c.k || chr(10) || chr(10) || '$a_' || c.k || chr(10) || 'b$' || chr(10) || chr(10)
           || '    - point' || chr(10) || chr(10) || 'is $\\frac{{' || c.k || '}}{{\\alpha }}$<img src="media/i.png">' || chr(10) || chr(10) || '$$ \\frac{{' || c.k || '}}{{\\alpha }} $$' || chr(10) || chr(10)
           || '| order |  | of ' || c.k || ' |' || chr(10) || '| --- | --- | --- |' || coalesce(t, '') AS markdown, CAST(NULL AS VARCHAR) AS error
    FROM ({GOOD}) c LEFT JOIN (SELECT k, string_agg(chr(10) || '| ' || o || ' | ' || s || '\\|x |  |', '' ORDER BY n) AS t FROM ({ORDERS}) GROUP BY k) t ON t.k = c.k
    UNION ALL SELECT 'd' || c_custkey || '.docx', NULL, 'BadZipFile: File is not a zip file' FROM customer WHERE c_custkey % 10 = 9"""
CODE = "SELECT l_orderkey AS id, string_agg('所属文件: f' || l_partkey || chr(10) || '代码:' || chr(10) || 'x = ' || l_suppkey, chr(10) || chr(10) ORDER BY l_linenumber, 'f' || l_partkey, 'x = ' || l_suppkey) AS code FROM lineitem GROUP BY 1"


def _sql(template: str, **parts: str) -> str:
    """A prompt as SQL text."""
    text = template.replace("'", "''").replace("\n", "' || chr(10) || '")
    for name, value in parts.items():
        text = text.replace("{" + name + "}", f"' || {value} || '")
    return f"('{text}')"


REVIEWED = _sql(align.REVIEW, requirement="'need {' || id || '}'", code="code")
GENERATED = _sql(align.GENERATE, code="code")
ORACLE_SQL = {
    "docx_markdown": MARKDOWN,
    "docx_html_tables": f"""
        SELECT path, CAST(0 AS INTEGER) AS tbl, '<table><tr><td colspan="2">order</td><td' || CASE WHEN m > 0 THEN ' rowspan="' || (m + 1) || '"' ELSE '' END || '>of ' || c.k || '</td></tr>' || coalesce(t, '') || '</table>' AS html
        FROM ({GOOD}) c LEFT JOIN (SELECT k, max(m) AS m, string_agg('<tr><td>' || o || '</td><td>' || s || '|x</td></tr>', '' ORDER BY n) AS t FROM ({ORDERS}) GROUP BY k) t ON t.k = c.k""",
    "docx_table_cells": f"""
        WITH c AS (SELECT path, k, coalesce(m, 0) AS m FROM ({GOOD}) LEFT JOIN (SELECT DISTINCT k, m FROM ({ORDERS})) USING (k)),
        x AS (SELECT path, 0 AS r, 0 AS cell, 0 AS grid, CASE WHEN m > 0 THEN 1 ELSE 1 END AS h, false AS covered FROM c
              UNION ALL SELECT path, 0, 1, 2, m + 1, false FROM c
              UNION ALL SELECT path, n, cell, cell, CASE WHEN cell = 2 THEN c.m + 1 ELSE 1 END, cell = 2 FROM ({ORDERS}) o JOIN c USING (k), (SELECT unnest([0, 1, 2]) AS cell))
        SELECT path, CAST(r AS INTEGER) AS row, CAST(cell AS INTEGER) AS cell, CAST(grid AS INTEGER) AS grid, CAST(h AS INTEGER) AS rows, covered FROM x""",
    "docx_relations": f"""
        SELECT path, 'r1' AS id, 'image' AS kind, 'media/i.png' AS target, CAST(length('image ' || k) AS BIGINT) AS n_bytes, 'image' AS found FROM ({GOOD})
        UNION ALL SELECT path, 'r2', 'oleObject', 'embeddings/o.bin', NULL, 'object' FROM ({GOOD}) UNION ALL SELECT path, 'r3', 'hyperlink', 'http://x/' || k, NULL, NULL FROM ({GOOD})""",
    "docx_media": f"SELECT path, 'media/i.png' AS target, sha256('image ' || k) AS sha256 FROM ({GOOD})",
    "docx_converted": f"SELECT path, length(markdown) AS n_chars, CAST(CASE WHEN error IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_media FROM ({MARKDOWN})",
    "decoded_files": """
        SELECT CAST(doc_id AS VARCHAR) AS path, replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(8203), '') AS content FROM documents""",
    "resolved_documents": """
        SELECT 'n' || (a.doc_id * 2) || CASE WHEN a.doc_id % 2 = 0 THEN '.md' ELSE '.docx' END AS name,
               sha256(replace(replace(replace(b.text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(8203), '')) AS sha256
        FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id * 2""",
    "valid_projects": "SELECT count(*) > 0 AND (SELECT count(*) > 0 FROM documents) AND (SELECT count(*) > 0 FROM nation) AS valid FROM pages",
    "history_file": "SELECT 'e' || event_id AS name, '/p/' || event_id AS path, date_trunc('second', ts) AS last_opened FROM events",
    "upload_totals": """
        WITH f AS (SELECT CASE WHEN page_id % 2 = 0 THEN html || chr(10) || 'more' || chr(10) || chr(10) || 'lines' ELSE html END AS t FROM pages)
        SELECT count(*) AS n_files, CAST(sum(len(list_filter(string_split(replace(replace(coalesce(t, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_matches(x, '\\S')))) AS BIGINT) AS code_scale FROM f""",
    "prompts": f"SELECT id, code AS context, sha256({REVIEWED}) AS prompt FROM ({CODE})",
    "review_with_stub": f"""
        SELECT id, CASE WHEN n % 10 <> 3 THEN 'length ' || n END AS review_process, CASE WHEN n % 10 <> 3 THEN '在[f]处 ' || n END AS issues
        FROM (SELECT id, length({REVIEWED}) AS n FROM ({CODE}))""",
    "generate_with_stub": f"""
        SELECT id, CASE WHEN n % 10 <> 3 THEN ' length ' || n || chr(10) || '{replies.END_OF_REVIEW}' || chr(10) || ' 在[f]处 ' || n || ' ' END AS "generatedRequirement"
        FROM (SELECT id, length({GENERATED}) AS n FROM ({CODE}))""",
    "exported_records": """
        SELECT '{"id":' || l_orderkey || ',"ranges":[' || string_agg('{"start":' || l_linenumber || ',"flag":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_returnflag) || ']}' AS json FROM lineitem GROUP BY l_orderkey""",
}
