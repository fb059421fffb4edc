"""Queries of lines, text functions, replies and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import replies
from tracelake.functions import text as T
from tracelake.operators import annotations, blocks, chunking, lines, requirements, stats

UNIX = "replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
LINES = f"""
    SELECT doc_id, source, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l
    FROM (SELECT doc_id, source, string_split({UNIX}, chr(10)) AS l FROM documents)
"""
NUMBERED = f"SELECT doc_id, source, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM ({LINES})"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def nonblank_line_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.nonblank_count(F.col("text")).alias("n_lines"))


def code_scale_by_source(spark, sf_dir):
    per = _docs(spark, sf_dir).select("source", T.nonblank_count(F.col("text")).alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("code_scale"), F.count("*").alias("n_files"))


def numbered_lines(spark, sf_dir):
    n = lines.code_lines(_docs(spark, sf_dir), "doc_id", "text")
    return n.select(F.col("file").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.concat_ws(": ", "line_no", "text").alias("numbered"))


def padded_lines(spark, sf_dir):
    n = lines.code_lines(_docs(spark, sf_dir), "doc_id", "text")
    return n.select(F.col("file").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.concat(T.padded_number(F.col("line_no")), "text").alias("line"))


def fixed_line_chunks(spark, sf_dir):
    got = lines.fixed_chunks(_docs(spark, sf_dir), 10, "doc_id", "text")
    return got.select(F.col("file").alias("doc_id"), *[F.col(c).cast("long").alias(c) for c in ("chunk_no", "start_line", "end_line")], "content")


def line_offsets(spark, sf_dir):
    got = lines.line_offsets(_docs(spark, sf_dir), "doc_id", "text")
    return got.select(F.col("file").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "start_off", "end_off")


def split_lines(spark, sf_dir):
    kept = _docs(spark, sf_dir).select("doc_id", T.split_lines(F.col("text")).alias("l"))
    return kept.select("doc_id", F.size("l").cast("long").alias("n"), F.array_join("l", "").alias("joined"))


def token_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", chunking.token_count(F.coalesce("text", F.lit(""))).cast("long").alias("n_tokens"))


def token_budget_chunks(spark, sf_dir):
    got = chunking.token_budget_chunks(_docs(spark, sf_dir), 200, "doc_id", "text")
    return got.withColumnRenamed("file", "doc_id")


def parse_related_code_json(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    reply = F.format_string('{"related_code": [[%d, %d], [%d, %d]],}', "l_linenumber", F.col("l_linenumber") + 2, F.lit(50), F.col("l_linenumber") + 50)
    fenced = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), reply, F.lit("\n```"))).otherwise(reply)
    parsed = li.select("l_orderkey", "l_linenumber", F.explode(replies.related_intervals(fenced)).alias("p"))
    return parsed.select("l_orderkey", "l_linenumber", F.col("p")[0].alias("start"), F.col("p")[1].alias("end"))


def parse_related_code_fallback_ints(spark, sf_dir):
    got = _docs(spark, sf_dir).select("doc_id", F.posexplode(replies.integers(F.coalesce("text", F.lit("")))).alias("pos", "value"))
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), "value")


def _reviews(spark, sf_dir):
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    issue = "在[a.c]的[f]处，程序实现是甲，而需求是乙，实现与需求不一致，原因是丙。"
    kinds = [
        F.concat("text", F.lit("\n" + replies.END_OF_REVIEW + "\n问题单\n"), F.lit(issue)),
        F.concat(F.lit("审查分析过程\n"), "text", F.lit("\n问题单\n"), F.lit(issue)),
        F.concat("text", F.lit(issue)),
        F.col("text"),
    ]
    pick = F.element_at(F.array(*kinds), (F.col("turn") % 4 + 1).cast("int"))
    return conv.withColumn("reply", pick)


def review_output_split(spark, sf_dir):
    return _reviews(spark, sf_dir).select("conv_id", "turn", replies.review(F.col("reply")).alias("v")).select("conv_id", "turn", "v.*")


def formula_extract(spark, sf_dir):
    got = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.formulas(F.col("text"), compat=True)).alias("k", "formula"))
    return got.select("doc_id", F.col("k").cast("long").alias("k"), "formula")


def regularize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.regularize(F.col("text"), "code").alias("content"))


def _built(spark, sf_dir):
    """A Markdown document for each customer: headings of both kinds, inline markup, a table of its orders, an item, formulas."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o")
    )
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = F.array_join(F.transform("o", lambda x: F.concat(F.lit("| **"), x["o_orderkey"], F.lit("** | `"), x["o_orderstatus"], F.lit("` |\n"))), "")
    text = F.concat(
        F.lit("# Customer "), "c_custkey", F.lit("\n\nSegment **"), "c_mktsegment", F.lit("** of [nation](n/1) "), "c_nationkey",
        F.lit(".\r\nCalled _"), "c_name", F.lit("_ &amp; *co*<br>.\n\n    code, no text\n\n## Orders ##\n\n| key | state |\n|:---|---:|\n"),
        F.coalesce(rows, F.lit("")), F.lit("\n- 5 \\* 3, see $t_{"), "c_custkey", F.lit("}$\n\nTotals\n------\n$$ "), "c_custkey", F.lit(" + 1 $$\n"),
    )
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left").select(F.col("c_custkey").alias("doc"), text.alias("content"))


def requirement_points(spark, sf_dir):
    got = requirements.requirement_points(_built(spark, sf_dir))
    return got.select("doc", "seq", "type", "id", "content", F.to_json("cells").alias("cells"), "context")


def point_counts(spark, sf_dir):
    got = requirements.requirement_points(_built(spark, sf_dir))
    return got.groupBy("doc", "type").agg(F.count("*").alias("n_points"), F.max("seq").alias("last_seq"))


def document_points(spark, sf_dir):
    got = requirements.requirement_points(_docs(spark, sf_dir), "doc_id", "text")
    return got.select(F.col("doc").alias("doc_id"), "seq", "type", "id", "content", F.to_json("cells").alias("cells"), "context")


def source_blocks(spark, sf_dir):
    return requirements.source_blocks(_docs(spark, sf_dir), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def _outlines(spark, sf_dir):
    """A Markdown document for each customer: a list of its orders with lists in its items, a quote, fenced code."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    item = lambda x: F.concat(F.lit("- order "), x["o_orderkey"], F.lit("\n  - state\n    "), x["o_orderstatus"], F.lit("\n  - more\n"))
    items = F.array_join(F.transform("o", item), "")
    text = F.concat(
        F.lit("# Customer "), "c_custkey", F.lit("\r\n\nSegment "), "c_mktsegment", F.lit("\n\n"), F.coalesce(items, F.lit("")),
        F.lit("\n> called "), "c_name", F.lit("\nand so on\n\n```py\nx = "), "c_custkey", F.lit("\n\n- no item\n```\n"),
    )
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left").select(F.col("c_custkey").alias("doc"), text.alias("content"))


def block_tree(spark, sf_dir):
    return blocks.block_tree(_outlines(spark, sf_dir))


def document_blocks(spark, sf_dir):
    """Blocks of all documents by kind: how many a document has, how deep they lie."""
    got = blocks.block_tree(_docs(spark, sf_dir), "doc_id", "text")
    return got.groupBy(F.col("doc").alias("doc_id"), "kind").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.max("end").alias("last"))


def _page_files(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_replace("url", "^https?://", "").alias("path"), F.length("html").alias("size"))


def folder_totals(spark, sf_dir):
    return stats.folder_totals(_page_files(spark, sf_dir)).withColumn("depth", F.col("depth").cast("long"))


def nested_tree(spark, sf_dir):
    return stats.nested_tree(_page_files(spark, sf_dir))


def heading_paragraphs(spark, sf_dir):
    got = requirements.heading_paragraphs(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.select(F.col("id").alias("page_id"), F.col("ordinal").cast("long").alias("ordinal"), "level", "text")


def protected_chunks(spark, sf_dir):
    """Code of every customer: a function for each third order, a statement for the others; functions stay whole."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = F.when(
        F.col("o_orderkey") % 3 == 0,
        F.concat(F.lit("int f"), "o_orderkey", F.lit("(int a)\n{\n    return a + "), "o_custkey", F.lit(";\n}\n")),
    ).otherwise(F.concat(F.lit("int v"), "o_orderkey", F.lit(" = "), "o_custkey", F.lit(";\n")))
    code = o.groupBy(F.col("o_custkey").alias("file")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("t")))).alias("l"))
    code = code.select("file", F.array_join(F.transform("l", lambda x: x["t"]), "").alias("content"))
    return chunking.token_budget_chunks(code, 40)


def formula_extract_display(spark, sf_dir):
    got = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.formulas(F.concat(F.lit("$$ a $$ $b$ "), F.coalesce("text", F.lit(""))))).alias("k", "formula"))
    return got.select("doc_id", F.col("k").cast("long").alias("k"), "formula")


def slice_ranges(spark, sf_dir):
    r = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((3, 9), (0, 5), (3, 9), (20, 40))])
    return _docs(spark, sf_dir).select("doc_id", T.slice_ranges(F.coalesce("text", F.lit("")), r).alias("slices"))


def clean_latex(spark, sf_dir):
    text = F.concat(F.lit("\\kern-\\nulldelimiterspace \\begin{array}{*{3}{c}}"), F.coalesce("text", F.lit("")), F.lit("kern{2pt}\n\n\n\\end{array} "))
    return _docs(spark, sf_dir).select("doc_id", T.clean_latex(text).alias("latex"))


def locate_in_turn(spark, sf_dir):
    pieces = F.array(F.lit("a"), F.lit("e "), F.lit("qzq"), F.lit("n"))
    docs = _docs(spark, sf_dir).select("doc_id", F.posexplode(annotations.locate_in_turn(F.coalesce("text", F.lit("")), pieces)).alias("k", "r"))
    return docs.select("doc_id", F.col("k").cast("long").alias("k"), F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))


def table_row_map(spark, sf_dir):
    docs = _docs(spark, sf_dir).where(F.col("text").contains("|"))
    rows = lines.code_lines(docs, "doc_id", "text").where(F.col("text").contains("|"))
    named = rows.select(F.col("file").alias("doc_id"), "line_no", T.row_map(F.array(F.lit("a"), F.lit("b"), F.lit("a")), requirements.cells(F.col("text"))).alias("m"))
    return named.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.try_element_at("m", F.lit("a")).alias("a"), F.try_element_at("m", F.lit("b")).alias("b"))


def relative_time(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    return ev.select("event_id", T.relative_time(F.col("ts"), now).alias("age"))


def path_tree(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return stats.path_tree(pages.select(F.regexp_replace("url", "^https?://", "").alias("path"))).withColumn("depth", F.col("depth").cast("long"))


def stems(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    name = F.element_at(F.split("url", "/"), -1)
    return pages.select("page_id", T.stem_first_dot(name).alias("first_dot"), T.stem_last_dot(name).alias("last_dot"), T.folder_name(F.col("url")).alias("folder"))


def normalized_paths(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("/"), F.lit("\\"))).otherwise(F.col("url"))
    return pages.select("page_id", T.normalize_path(odd).alias("path"))


QUERIES = [
    nonblank_line_count, code_scale_by_source, numbered_lines, padded_lines, fixed_line_chunks, line_offsets, split_lines,
    token_counts, token_budget_chunks, parse_related_code_json, parse_related_code_fallback_ints, review_output_split, formula_extract,
    regularize_text, requirement_points, point_counts, document_points, source_blocks, block_tree, document_blocks, folder_totals, nested_tree, heading_paragraphs, protected_chunks, formula_extract_display,
    slice_ranges, clean_latex, locate_in_turn, table_row_map, relative_time, path_tree, stems, normalized_paths,
]

#: The points of the built documents, from the tables that they were built from.
POINTS = """
    WITH i AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus) - 1 AS n, CAST(o_orderkey AS VARCHAR) AS p, o_orderstatus AS q FROM orders),
    t AS (SELECT k, count(*) AS m, string_agg('<tr><td>' || p || '</td><td>' || q || '</td></tr>', '' ORDER BY n) AS body FROM i GROUP BY k),
    c AS (SELECT c_custkey AS k, c_mktsegment AS s, c_nationkey AS nk, c_name AS name, coalesce(m, 0) AS m, coalesce(body, '') AS body, 'Customer ' || c_custkey AS h
          FROM customer LEFT JOIN t ON k = c_custkey)
    SELECT k AS doc, 0 AS seq, '描述文本' AS type, 'text_0' AS id, 'Segment ' || s || ' of nation ' || nk || '.' || chr(10) || 'Called ' || name || ' & co.' AS content,
           CAST(NULL AS VARCHAR) AS cells, h AS context FROM c
    UNION ALL SELECT k, 1, '表格', 'table_1', '<table><tr><th>key</th><th>state</th></tr>' || body || '</table>', NULL, h || ' > Orders' FROM c
    UNION ALL SELECT i.k, n + 2, '表格行', 'table_1_row_' || n, NULL, '{"key":"' || p || '","state":"' || q || '"}', h || ' > Orders > table_1' FROM i JOIN c ON c.k = i.k
    UNION ALL SELECT k, m + 2, '描述文本', 'text_' || (m + 2), '5 * 3, see $t_{' || k || '}$', NULL, h || ' > Orders' FROM c
    UNION ALL SELECT k, m + 3, '描述文本', 'text_' || (m + 3), '$$ ' || k || ' + 1 $$', NULL, h || ' > Totals' FROM c
    UNION ALL SELECT k, m + 4, '公式', 'formula_0', '$t_{' || k || '}$', NULL, h || ' > Totals' FROM c
    UNION ALL SELECT k, m + 5, '公式', 'formula_1', '$$ ' || k || ' + 1 $$', NULL, h || ' > Totals' FROM c"""

#: Paths of up to so many names.
DEEP = 6


def _level(d: int) -> str:
    """Records of depth d, from those of the next depth."""
    head = """'{"label":"' || parts[len(parts)] || '","path":"' || array_to_string(parts, '/') || '","type":"'"""
    file = f"SELECT parts, CAST(1 AS BIGINT) AS n, size, {head} || 'file\",\"n_files\":1,\"size\":' || size || '}}' AS tree FROM files WHERE len(parts) = {d}"
    if d == DEEP:
        return file
    per = f"SELECT parts[1:{d}] AS parts, sum(n) AS n, sum(size) AS size, string_agg(tree, ',' ORDER BY parts[{d + 1}], tree) AS c FROM l{d + 1} GROUP BY 1"
    return f"SELECT parts, CAST(n AS BIGINT) AS n, CAST(size AS BIGINT) AS size, {head} || 'directory\",\"n_files\":' || n || ',\"size\":' || size || ',\"children\":[' || c || ']}}' AS tree FROM ({per}) UNION ALL {file}"


NESTED = (
    "WITH files AS (SELECT list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '') AS parts, max(length(html)) AS size FROM pages GROUP BY 1), "
    + ", ".join(f"l{d} AS ({_level(d)})" for d in range(DEEP, 0, -1))
    + " SELECT array_to_string(parts, '/') AS path, tree FROM l1"
)

ORACLE_SQL = {
    "nonblank_line_count": f"SELECT doc_id, CAST(len(list_filter(l, lambda x: regexp_matches(x, '\\S'))) AS BIGINT) AS n_lines FROM ({LINES})",
    "code_scale_by_source": f"""
        SELECT source, CAST(sum(len(list_filter(l, lambda x: regexp_matches(x, '\\S')))) AS BIGINT) AS code_scale, count(*) AS n_files
        FROM ({LINES}) GROUP BY source""",
    "numbered_lines": f"SELECT doc_id, line_no, line_no || ': ' || line AS numbered FROM ({NUMBERED})",
    "padded_lines": f"""
        SELECT doc_id, line_no,
               CASE WHEN line_no < 1000 THEN rpad(line_no || ':', 5, ' ') ELSE line_no || ':' END || line AS line
        FROM ({NUMBERED})""",
    "fixed_line_chunks": f"""
        SELECT doc_id, (line_no - 1) // 10 AS chunk_no, min(line_no) AS start_line, max(line_no) AS end_line,
               string_agg(line_no || ': ' || line, chr(10) ORDER BY line_no) AS content
        FROM ({NUMBERED}) GROUP BY ALL""",
    "line_offsets": f"""
        SELECT doc_id, line_no, start_off, start_off + length(line) AS end_off
        FROM (SELECT doc_id, line_no, line,
                     CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_off
              FROM ({NUMBERED}))""",
    "split_lines": """
        SELECT doc_id, CAST(len(string_split(text, chr(10))) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS BIGINT) AS n, text AS joined
        FROM documents WHERE NOT contains(text, chr(13))
        UNION ALL
        SELECT doc_id, CAST(len(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) -
                       CASE WHEN text LIKE '%' || chr(10) OR text LIKE '%' || chr(13) THEN 1 ELSE 0 END AS BIGINT), text
        FROM documents WHERE contains(text, chr(13))""",
    "token_counts": "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+|[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]')) AS BIGINT) AS n_tokens FROM documents",
    "token_budget_chunks": f"""
        WITH RECURSIVE tok AS (
            SELECT doc_id, line_no, line_no || ': ' || line AS t,
                   len(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]')) AS c
            FROM ({NUMBERED})),
        packed AS (
            SELECT doc_id, line_no, t, 0 AS chunk_no, 200 - c AS room FROM tok WHERE line_no = 1
            UNION ALL
            SELECT n.doc_id, n.line_no, n.t, p.chunk_no + CASE WHEN n.c <= p.room THEN 0 ELSE 1 END,
                   CASE WHEN n.c <= p.room THEN p.room ELSE 200 END - n.c
            FROM packed p JOIN tok n ON n.doc_id = p.doc_id AND n.line_no = p.line_no + 1)
        SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(min(line_no) AS INTEGER) AS start_line,
               CAST(max(line_no) AS INTEGER) AS end_line, string_agg(t || chr(10), '' ORDER BY line_no) AS content
        FROM packed GROUP BY doc_id, chunk_no""",
    "parse_related_code_json": """
        SELECT l_orderkey, l_linenumber, l_linenumber AS start, l_linenumber + 2 AS "end" FROM lineitem
        UNION ALL SELECT l_orderkey, l_linenumber, 50, l_linenumber + 50 FROM lineitem""",
    "parse_related_code_fallback_ints": """
        SELECT doc_id, CAST(unnest(range(len(v))) AS BIGINT) AS pos, TRY_CAST(unnest(v) AS BIGINT) AS value
        FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: x) AS w,
                     list_filter(w, lambda x: regexp_full_match(x, '\\d+')) AS v FROM documents)""",
    "review_output_split": """
        WITH t AS (SELECT conv_id, turn, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s,
                   '在[a.c]的[f]处，程序实现是甲，而需求是乙，实现与需求不一致，原因是丙。' AS i FROM conversations)
        SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN text ELSE s END AS review_process,
               CASE WHEN turn % 4 = 3 THEN '未能解析出问题单' ELSE i END AS issues FROM t""",
    "formula_extract": """
        SELECT doc_id, unnest(range(len(a))) AS k,
               unnest(list_transform(list_zip(a, b), lambda p: CASE WHEN p[1] <> '' THEN '$' || regexp_replace(p[1], '^\\s+|\\s+$', '', 'g') || '$'
                      ELSE '$$ ' || regexp_replace(coalesce(p[2], ''), '^\\s+|\\s+$', '', 'g') || ' $$' END)) AS formula
        FROM (SELECT doc_id, regexp_extract_all(text, '(?s)\\$(.*?)\\$|\\$\\$(.*?)\\$\\$', 1) AS a,
                     regexp_extract_all(text, '(?s)\\$(.*?)\\$|\\$\\$(.*?)\\$\\$', 2) AS b FROM documents)""",
    "regularize_text": "SELECT doc_id, replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(8203), '') AS content FROM documents",
    "requirement_points": f"SELECT doc, CAST(seq AS INTEGER) AS seq, type, id, content, cells, context FROM ({POINTS})",
    "point_counts": f"SELECT doc, type, count(*) AS n_points, CAST(max(seq) AS INTEGER) AS last_seq FROM ({POINTS}) GROUP BY ALL",
    "source_blocks": """
        WITH t AS (SELECT doc_id, string_split(replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(8203), ''), chr(10)) AS l FROM documents),
        n AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS k FROM t),
        o AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos,
                     CASE WHEN NOT regexp_matches(line, '\\S') THEN '' WHEN regexp_matches(line, '^ {0,3}#{1,6}([^#]|$)') THEN 'heading' WHEN contains(line, '|') THEN 'table'
                          WHEN regexp_matches(line, '^\\s*([-*+]|\\d+[.)])\\s+') THEN 'item' ELSE 'text' END AS kind FROM n),
        f AS (SELECT *, CASE WHEN kind IN ('text', 'table') AND lag(kind) OVER (PARTITION BY doc_id ORDER BY k) = kind THEN 0 ELSE 1 END AS new FROM o),
        g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS grp FROM f)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS INTEGER) AS block, any_value(kind) AS kind, min(pos) AS start,
               max(pos + length(line)) AS "end", string_agg(line, chr(10) ORDER BY k) AS text
        FROM g WHERE kind <> '' GROUP BY doc_id, grp""",
    "block_tree": """
        WITH i AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus) - 1 AS n, length('- order ' || o_orderkey) AS a FROM orders),
        s AS (SELECT k, n, a, coalesce(sum(a + 26) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i),
        t AS (SELECT k, count(*) AS m, sum(a + 26) AS whole FROM i GROUP BY k),
        c AS (SELECT c_custkey AS k, length('# Customer ' || c_custkey) AS h, length('Segment ' || c_mktsegment) AS g, coalesce(m, 0) AS m, coalesce(whole, 0) AS whole,
                     length('> called ' || c_name || chr(10) || 'and so on') AS q, length('```py' || chr(10) || 'x = ' || c_custkey || chr(10) || chr(10) || '- no item' || chr(10) || '```') AS f
              FROM customer LEFT JOIN t ON k = c_custkey),
        d AS (SELECT *, h + 2 + g + 2 AS base, h + 2 + g + 2 + whole + 1 AS quote, CASE WHEN m > 0 THEN 3 + 7 * m ELSE 2 END AS nq FROM c),
        o AS (SELECT d.k, 3 + 7 * n AS node, base + before AS p, a FROM s JOIN d USING (k)),
        x AS (
            SELECT k AS doc, 0 AS node, NULL AS parent, 0 AS depth, 'heading' AS kind, 0 AS s, h AS e, '1' AS info FROM d
            UNION ALL SELECT k, 1, NULL, 0, 'paragraph', h + 2, h + 2 + g, '' FROM d
            UNION ALL SELECT k, 2, NULL, 0, 'list', base, base + whole - 1, '-' FROM d WHERE m > 0
            UNION ALL SELECT k, node, 2, 1, 'item', p, p + a + 25, '' FROM o
            UNION ALL SELECT k, node + 1, node, 2, 'paragraph', p + 2, p + a, '' FROM o
            UNION ALL SELECT k, node + 2, node, 2, 'list', p + a + 3, p + a + 25, '-' FROM o
            UNION ALL SELECT k, node + 3, node + 2, 3, 'item', p + a + 3, p + a + 16, '' FROM o
            UNION ALL SELECT k, node + 4, node + 3, 4, 'paragraph', p + a + 5, p + a + 16, '' FROM o
            UNION ALL SELECT k, node + 5, node + 2, 3, 'item', p + a + 19, p + a + 25, '' FROM o
            UNION ALL SELECT k, node + 6, node + 5, 4, 'paragraph', p + a + 21, p + a + 25, '' FROM o
            UNION ALL SELECT k, nq, NULL, 0, 'quote', quote, quote + q, '' FROM d
            UNION ALL SELECT k, nq + 1, nq, 1, 'paragraph', quote + 2, quote + q, '' FROM d
            UNION ALL SELECT k, nq + 2, NULL, 0, 'code', quote + q + 2, quote + q + 2 + f, 'py' FROM d)
        SELECT doc, CAST(node AS INTEGER) AS node, CAST(parent AS INTEGER) AS parent, CAST(depth AS INTEGER) AS depth, kind, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", info FROM x""",
    "folder_totals": """
        WITH p AS (SELECT list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '') AS parts, length(html) AS size FROM pages),
        n AS (SELECT parts, size, unnest(range(len(parts))) AS depth FROM p)
        SELECT array_to_string(parts[1:depth], '/') AS folder, depth, count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS size FROM n GROUP BY 1, 2""",
    "nested_tree": NESTED,
    "heading_paragraphs": """
        WITH b AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g') AS h FROM pages),
        m AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<(h[1-6]|p)\\b[^>]*>', chr(1) || '\\1' || chr(2), 'g'), '(?i)</(h[1-6]|p)\\b', chr(3), 'g') AS h FROM b),
        s AS (SELECT page_id, string_split(h, chr(1))[2:] AS p FROM m),
        u AS (SELECT page_id, unnest(p) AS p, unnest(range(len(p))) AS ordinal FROM s)
        SELECT page_id, ordinal, CASE WHEN lower(p[1]) = 'p' THEN 0 ELSE CAST(p[2] AS INTEGER) END AS level,
               trim(regexp_replace(regexp_replace(split_part(split_part(p, chr(2), 2), chr(3), 1), '(?s)<[^>]*>', '', 'g'), '\\s+', ' ', 'g'), ' ') AS text
        FROM u""",
    "protected_chunks": """
        WITH RECURSIVE u AS (
            SELECT o_custkey AS file, row_number() OVER w AS k, o_orderkey % 3 = 0 AS whole, o_orderkey AS ok,
                   coalesce(sum(CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
        v AS (SELECT file, k, CAST(before + 1 AS INTEGER) AS s, CAST(before + CASE WHEN whole THEN 4 ELSE 1 END AS INTEGER) AS e, CASE WHEN whole THEN 21 ELSE 7 END AS c,
                     CASE WHEN whole THEN (before + 1) || ': int f' || ok || '(int a)' || chr(10) || (before + 2) || ': {' || chr(10) || (before + 3) || ':     return a + ' || file
                          || ';' || chr(10) || (before + 4) || ': }' || chr(10) ELSE (before + 1) || ': int v' || ok || ' = ' || file || ';' || chr(10) END AS t FROM u),
        packed AS (
            SELECT file, k, s, e, t, 0 AS chunk_no, 40 - c AS room FROM v WHERE k = 1
            UNION ALL
            SELECT n.file, n.k, n.s, n.e, n.t, p.chunk_no + CASE WHEN n.c <= p.room THEN 0 ELSE 1 END, CASE WHEN n.c <= p.room THEN p.room ELSE 40 END - n.c
            FROM packed p JOIN v n ON n.file = p.file AND n.k = p.k + 1)
        SELECT file, CAST(chunk_no AS INTEGER) AS chunk_no, min(s) AS start_line, max(e) AS end_line, string_agg(t, '' ORDER BY k) AS content
        FROM packed GROUP BY file, chunk_no""",
    "formula_extract_display": """
        SELECT doc_id, unnest(range(len(a))) AS k,
               unnest(list_transform(list_zip(a, b), lambda p: CASE WHEN coalesce(p[2], '') <> '' THEN '$' || regexp_replace(p[2], '^\\s+|\\s+$', '', 'g') || '$'
                      ELSE '$$ ' || regexp_replace(coalesce(p[1], ''), '^\\s+|\\s+$', '', 'g') || ' $$' END)) AS formula
        FROM (SELECT doc_id, regexp_extract_all('$$ a $$ $b$ ' || coalesce(text, ''), '(?s)\\$\\$(.*?)\\$\\$|\\$(.*?)\\$', 1) AS a,
                     regexp_extract_all('$$ a $$ $b$ ' || coalesce(text, ''), '(?s)\\$\\$(.*?)\\$\\$|\\$(.*?)\\$', 2) AS b FROM documents)""",
    "slice_ranges": """
        SELECT doc_id, substr(t, 1, 5) || chr(10) || substr(t, 4, 6) || chr(10) || substr(t, 21, 20) AS slices FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "clean_latex": """
        SELECT doc_id, trim(regexp_replace(' ' || chr(92) || 'begin{array}{ccc}' || coalesce(text, '') || chr(10) || chr(10) || chr(10) || chr(92) || 'end{array} ',
               '\\n{2,}', chr(10) || chr(10), 'g'), ' ') AS latex FROM documents""",
    "locate_in_turn": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        a AS (SELECT *, strpos(t, 'a') AS p, CASE WHEN strpos(t, 'a') > 0 THEN strpos(t, 'a') ELSE 0 END AS after1 FROM t),
        b AS (SELECT *, strpos(substr(t, after1 + 1), 'e ') AS q0, after1 + strpos(substr(t, after1 + 1), 'e ') AS q FROM a),
        c AS (SELECT *, CASE WHEN q0 > 0 THEN q + 1 ELSE after1 END AS after2 FROM b),
        d AS (SELECT *, strpos(substr(t, after2 + 1), 'qzq') AS r0, after2 + strpos(substr(t, after2 + 1), 'qzq') AS r FROM c),
        e AS (SELECT *, CASE WHEN r0 > 0 THEN r + 2 ELSE after2 END AS after3 FROM d),
        f AS (SELECT *, strpos(substr(t, after3 + 1), 'n') AS s0, after3 + strpos(substr(t, after3 + 1), 'n') AS s FROM e)
        SELECT doc_id, CAST(0 AS BIGINT) AS k, CASE WHEN p > 0 THEN p - 1 END AS start, CASE WHEN p > 0 THEN p END AS "end" FROM f
        UNION ALL SELECT doc_id, 1, CASE WHEN q0 > 0 THEN q - 1 END, CASE WHEN q0 > 0 THEN q + 1 END FROM f
        UNION ALL SELECT doc_id, 2, CASE WHEN r0 > 0 THEN r - 1 END, CASE WHEN r0 > 0 THEN r + 2 END FROM f
        UNION ALL SELECT doc_id, 3, CASE WHEN s0 > 0 THEN s - 1 END, CASE WHEN s0 > 0 THEN s END FROM f""",
    "table_row_map": f"""
        SELECT doc_id, line_no, CASE WHEN len(c) >= 3 THEN trim(c[3], ' ') ELSE trim(c[1], ' ') END AS a, trim(c[2], ' ') AS b
        FROM (SELECT doc_id, line_no, string_split(regexp_replace(regexp_replace(trim(line, ' '), '^[|]', ''), '[|]$', ''), '|') AS c
              FROM ({NUMBERED}) WHERE contains(line, '|'))""",
    "relative_time": """
        SELECT event_id, CASE WHEN s < 60 THEN '刚刚' WHEN s < 3600 THEN (s // 60) || '分钟前' WHEN s < 86400 THEN (s // 3600) || '小时前'
               WHEN d = 1 THEN '昨天' WHEN d < 30 THEN d || '天前' WHEN d // 30 < 12 THEN (d // 30) || '个月前'
               ELSE (d // 30 // 12) || '年前' END AS age
        FROM (SELECT event_id, s, CAST(floor(s / 86400) AS BIGINT) AS d
              FROM (SELECT event_id, 1709251200 - CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events))""",
    "path_tree": """
        WITH p AS (SELECT list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '') AS parts FROM pages),
        n AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM p)
        SELECT array_to_string(parts[1:i], '/') AS node, array_to_string(parts[1:i - 1], '/') AS parent, parts[i] AS label,
               CAST(i AS BIGINT) AS depth, bool_and(i = len(parts)) AS is_leaf
        FROM n GROUP BY ALL""",
    "stems": """
        SELECT page_id, string_split(n, '.')[1] AS first_dot,
               CASE WHEN strpos(n[2:], '.') > 0 AND NOT regexp_matches(n, '^[.]*[.][^.]*$') THEN regexp_replace(n, '[.][^.]*$', '') ELSE n END AS last_dot,
               regexp_extract(url, '([^/]*)/*$', 1) AS folder
        FROM (SELECT page_id, url, string_split(url, '/')[-1] AS n FROM pages)""",
    "normalized_paths": """
        SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(regexp_replace(p, '/$', '') || '/', '/', chr(92)) ELSE regexp_replace(p, '/$', '') || '/' END AS path
        FROM (SELECT page_id, regexp_replace(url, '/+', '/', 'g') AS p FROM pages)""",
}
