import io
import zipfile

from tracelake.operators import align, requirements, store
from tracelake.sources import docx, json_files, repo
from tracelake.streaming import ingest

MD = """intro **bold**

# A

para one
para two

### Deep

- item [link](u)

| h1 | h2 |
| --- | --- |
| a | b |
| c |

# B
tail $x$ and $$y$$
"""


def test_requirement_points(spark):
    df = spark.createDataFrame([("d", MD), ("empty", ""), ("null", None)], "doc string, content string")
    got = [(r["seq"], r["id"], r["content"], r["cells"], r["context"]) for r in requirements.requirement_points(df).orderBy("doc", "seq").collect()]
    assert got == [
        (0, "text_0", "intro bold", None, ""),
        (1, "text_1", "para one\npara two", None, "A"),
        (2, "text_2", "item link", None, "A > Deep"),
        (3, "table_3", "<table><tr><th>h1</th><th>h2</th></tr><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", None, "A > Deep"),
        (4, "table_3_row_0", None, {"h1": "a", "h2": "b"}, "A > Deep > table_3"),
        (5, "table_3_row_1", None, {"h1": "c"}, "A > Deep > table_3"),
        (6, "text_6", "tail $x$ and $$y$$", None, "B"),
        (7, "formula_0", "$x$", None, "B"),
        (8, "formula_1", "$$ y $$", None, "B"),
    ]


def word(body):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def par(text, style="", item=None):
    props = f'<w:pStyle w:val="{style}"/>' * bool(style) + (f'<w:numPr><w:ilvl w:val="{item}"/></w:numPr>' if item is not None else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx_to_markdown(spark):
    cell = lambda t, span=1: f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/></w:tcPr>{par(t)}</w:tc>'
    table = f"<w:tbl><w:tr>{cell('h', 2)}</w:tr><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>"
    body = par("Title", "2") + par("text") + par("point", "a3", 1) + table
    files = spark.createDataFrame([("a.docx", word(body)), ("b.docx", b"no zip"), ("c.docx", word(""))], "path string, content binary")
    got = {r["path"]: r for r in docx.to_markdown(files).collect()}
    assert got["a.docx"]["markdown"] == "## Title\n\ntext\n\n    - point\n\n| h |  |\n| --- | --- |\n| a | b |"
    assert got["b.docx"]["markdown"] is None and "BadZipFile" in got["b.docx"]["error"]


MATH = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def math(inner):
    from xml.etree import ElementTree as ET

    from tracelake.functions import omml

    return omml.latex(ET.fromstring(f"<m:oMath {MATH}>{inner}</m:oMath>")).strip()


def run_of(t):
    return f"<m:r><m:t>{t}</m:t></m:r>"


def test_office_math():
    e, x, y = (lambda t: f"<m:e>{run_of(t)}</m:e>"), run_of("x"), run_of("y")
    assert math(f"<m:f><m:num>{x}</m:num><m:den>{run_of('α')}</m:den></m:f>") == r"\frac{x}{\alpha }"
    assert math(f"<m:rad><m:deg/>{e('x')}</m:rad>") == r"\sqrt{x}"
    assert math(f"<m:sSubSup>{e('x')}<m:sub>{y}</m:sub><m:sup>{run_of('2')}</m:sup></m:sSubSup>") == "x_{y}^{2}"
    assert math(f'<m:d><m:dPr><m:begChr m:val="["/><m:endChr m:val="]"/></m:dPr>{e("x")}</m:d>') == r"\left[x\right]"
    assert math(f'<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub>{x}</m:sub><m:sup/>{e("y")}</m:nary>') == r"\sum_{x}{y}"
    assert math(f'<m:acc><m:accPr><m:chr m:val="\u0303"/></m:accPr>{e("x")}</m:acc>') == r"\tilde{x}"
    assert math(f"<m:m><m:mr>{e('a')}{e('b')}</m:mr><m:mr>{e('c')}{e('d')}</m:mr></m:m>") == r"\begin{matrix}a&b\\c&d\end{matrix}"
    assert math(f"<m:func><m:fName>{run_of('sin')}</m:fName>{e('x')}</m:func>") == r"\sin{x}"
    assert math(f"<m:limLow>{e('lim')}<m:lim>{run_of('x→∞')}</m:lim></m:limLow>") == r"\lim_{x\to \infty }"
    assert math(f"<m:bar>{e('x')}</m:bar><m:unknown>{y}</m:unknown>") == r"\underline{x}y"


def test_docx_math_tables_and_relations(spark):
    def cell(t, span=1, merge=None):
        m = "" if merge is None else "<w:vMerge/>" if merge == "continue" else f'<w:vMerge w:val="{merge}"/>'
        return f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/>{m}</w:tcPr>{par(t)}</w:tc>'

    table = f"<w:tbl><w:tr>{cell('h', 2)}{cell('v', 1, 'restart')}</w:tr><w:tr>{cell('a')}{cell('b')}{cell('', 1, 'continue')}</w:tr></w:tbl>"
    body = f"<w:p><w:r><w:t>x = </w:t></w:r><m:oMath {MATH}>{run_of('β')}</m:oMath></w:p>" + table
    data = io.BytesIO(word(body))
    with zipfile.ZipFile(data, "a") as z:
        rel = '<Relationship Id="{}" Type="http://t/{}" Target="{}"/>'
        rels = rel.format("r1", "image", "media/i.png") + rel.format("r2", "oleObject", "embeddings/o.bin") + rel.format("r3", "hyperlink", "http://x")
        z.writestr("word/_rels/document.xml.rels", f"<Relationships>{rels}</Relationships>")
        z.writestr("word/media/i.png", b"1234")
    files = spark.createDataFrame([("a", data.getvalue()), ("b", b"")], "path string, content binary")
    assert docx.to_markdown(files).where("path = 'a'").first()["markdown"].startswith(r"x = $\beta$")
    html = docx.html_tables(files).first()["html"]
    assert html == '<table><tr><td colspan="2">h</td><td rowspan="2">v</td></tr><tr><td>a</td><td>b</td></tr></table>'
    assert [(r["id"], r["n_bytes"]) for r in docx.images(files).collect()] == [("r1", 4)]
    assert [r["id"] for r in docx.embedded_objects(files).collect()] == ["r2"]


def test_repository_scan(spark, tmp_path):
    for name, text in {"code_repo/a.py": "x\n\ny\n", "code_repo/s/b.cpp": "z", "code_repo/c.PY": "no", "doc_repo/d.md": "# d"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "code_repo/bad.c").write_bytes(b"\xff\xfe\n")
    from pyspark.sql import functions as F

    p = repo.project(spark, "p", str(tmp_path), F.lit("2024-01-01").cast("timestamp")).first()
    assert (p["code_files"], p["doc_files"], p["code_scale"]) == (["a.py", "bad.c", "s/b.cpp"], ["d.md"], 3)
    names = spark.createDataFrame([("d.md",), ("x.docx",)], "name string")
    texts = repo.read_text(repo.scan(spark, f"{tmp_path}/doc_repo", "doc"))
    assert {r["name"]: r["content"] for r in repo.resolve_documents(names, texts).collect()} == {"d.md": "# d", "x.docx": None}


def test_json_records(spark, tmp_path):
    rows = [("m", '{"i": {"id": "i", "name": "n"}}'), ("l", '[{"id": "a"}, {"id": "b"}]'), ("bad", "x"), ("none", None)]
    files = spark.createDataFrame(rows, "path string, content string")
    got = sorted((r["path"], r["ordinal"], r["id"]) for r in json_files.records(files, "alignments").collect())
    assert got == [("l", 0, "a"), ("l", 1, "b"), ("m", 0, "i")]
    assert json_files.read_or_empty(spark, f"{tmp_path}/nothing", "issues").count() == 0


def test_align_review_generate(spark):
    req = spark.createDataFrame([("p", "r", "handles overflow"), ("p", "s", "nothing like it")], "project string, requirement_id string, requirement string")
    chunks = spark.createDataFrame(
        [("p", "f", 1, 2, "1: int overflow;\n2: x"), ("p", "f", 3, 3, "3: overflow")], "project string, file string, start_line int, end_line int, content string"
    )
    lines = spark.createDataFrame([("p", "f", ["int overflow;", "x", "overflow"])], "project string, file string, lines array<string>")
    got = sorted((r["requirement_id"], r["start"], r["end"], r["content"]) for r in align.align(req, chunks, lines, align.overlap_stub).collect())
    assert got == [("r", 1, 1, "1: int overflow;"), ("r", 3, 3, "3: overflow")]

    def failing():
        def call(prompts):
            raise OSError("down")

        return call

    points = spark.createDataFrame([("q", [("f", "c")])], "requirement string, relatedCode array<struct<filename: string, content: string>>")
    r = align.review(points, failing).first()
    assert r["review_process"] is None and r["issues"] is None
    assert align.generate(points, lambda: lambda ps: ["G:" + str("所属文件: f" in p) for p in ps]).first()["generatedRequirement"] == "G:True"


def test_malformed_reply_loses_only_its_own_blocks(spark):
    rows = [("r", "f", ["a", "b"], "[[1, 1]]"), ("r", "g", ["a"], "oops 1 2")]
    df = spark.createDataFrame(rows, "requirement_id string, file string, lines array<string>, reply string")
    assert align.related_code(df).count() == 1
    assert align.related_code(df, strict=True).count() == 0


def test_ranges_of_annotations(spark):
    r = "array<struct<documentId: string, start: int, end: int, content: string>>"
    notes = spark.createDataFrame([("a", [("d", 0, 1, "x")], []), ("b", [("d", 0, 1, "x")], [("c", 0, 1, "y")])], f"id string, docRanges {r}, codeRanges {r}")
    from pyspark.sql import functions as F

    assert [x["id"] for x in store.remove_range(notes, F.lit(0), "docRanges").collect()] == ["b"]
    more = spark.createDataFrame([("a", ("e", 2, 3, "z"), 1)], "id string, range struct<documentId: string, start: int, end: int, content: string>, at int")
    got = {x["id"]: [y["documentId"] for y in x["docRanges"]] for x in store.add_range(notes, more, "docRanges").collect()}
    assert got == {"a": ["d", "e"], "b": ["d"]}
    name = spark.createDataFrame([(" ", "0123456789"), ("n", "0123456789")], "n string, i string")
    assert [x[0] for x in name.select(store.default_name(F.col("n"), F.col("i"))).collect()] == ["需求点_01234567", "n"]


def test_streaming_upsert(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "t")
    src.mkdir()

    def run():
        ingest.upsert_batches(ingest.alignment_stream(spark, str(src)), table, str(tmp_path / "c")).awaitTermination(60)

    (src / "1.json").write_text('{"project": "p", "doc": "d", "id": "1", "name": "old"}\n{"project": "p", "doc": "d", "id": "2", "name": "two"}\n')
    run()
    (src / "2.json").write_text('{"project": "p", "doc": "d", "id": "1", "name": "new"}\n')
    run()
    assert {r["id"]: r["name"] for r in spark.read.parquet(f"{table}/v=1").collect()} == {"1": "new", "2": "two"}
