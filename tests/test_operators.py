"""Cases that the tables do not hold: repeated rows, ties, refused input, failing clients, broken documents."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.operators import align, annotations, chunking, intervals, requirements, retrieve, store
from tracelake.sources import docx, json_files, repo


def rows(df, *cols):
    return sorted(map(repr, (tuple(r) for r in (df.select(*cols) if cols else df).collect())))


def test_equal_blocks_keep_their_rows(spark):
    blocks = spark.createDataFrame([("f", 1, 1, "a"), ("f", 1, 1, "a"), ("f", 1, 1, "b"), ("g", 1, 2, "c")], "file string, start int, end int, tag string")
    lines = spark.createDataFrame([("f", 1, "t")], "file string, line_no int, text string")
    assert rows(intervals.extract_by_join(blocks, lines)) == sorted(
        map(repr, [("f", 1, 1, "a", "1: t"), ("f", 1, 1, "a", "1: t"), ("f", 1, 1, "b", "1: t"), ("g", 1, 2, "c", "")])
    )


def test_points_of_one_line_keep_their_rows_and_columns(spark):
    points = spark.createDataFrame([("k", 3, "p1"), ("k", 3, "p2"), ("k", 9, "p3")], "k string, line int, name string")
    blocks = spark.createDataFrame([("k", 2, 1, 5), ("k", 1, 3, 4)], "k string, ordinal int, start int, end int")
    got = intervals.first_enclosing(points, blocks, "k", "line")
    assert rows(got) == sorted(map(repr, [("k", 3, "p1", 3, 4), ("k", 3, "p2", 3, 4), ("k", 9, "p3", None, None)]))


def test_several_changes_of_an_issue_touch_one_record(spark):
    issues = spark.createDataFrame([("a", 1, "new"), ("a", 2, "new"), ("b", 1, "new")], "id string, n int, status string")
    changes = spark.createDataFrame([("a", "old", 1), ("a", "late", 2), ("z", "x", 1)], "id string, new string, at int")
    assert rows(store.update_first(issues, changes, "id", "n", "status")) == sorted(map(repr, [("a", 1, "late"), ("a", 2, "new"), ("b", 1, "new")]))
    assert store.update_first(issues, changes.drop("at"), "id", "n", "status").count() == 3


def test_issue_append_checks_its_columns(spark):
    issues = spark.createDataFrame([("a", "s")], "id string, status string")
    assert store.append_issues(issues, spark.createDataFrame([("a",)], "id string")).count() == 2
    with pytest.raises(ValueError):
        store.append_issues(issues, spark.createDataFrame([("a", 1)], "id string, colour int"))


def test_projects_are_created_once(spark):
    have = spark.createDataFrame([("p", "/a")], "project_name string, project_location string")
    new = spark.createDataFrame([("q", "/a"), ("s", "/b"), ("r", "/b")], have.schema)
    assert rows(store.create_project(have, new)) == sorted(map(repr, [("p", "/a"), ("r", "/b")]))
    assert rows(store.refused_projects(have, new)) == [repr(("q", "/a"))]


def test_upload_keeps_the_last_of_a_name(spark):
    cur = spark.createDataFrame([("d/a.md", "old")], "path string, content string")
    new = spark.createDataFrame([("x/a.md", "1", 1), ("y/a.md", "2", 2), ("b.exe", "3", 3)], "path string, content string, ordinal int")
    assert rows(annotations.upload(cur, new, "doc", "/p")) == sorted(map(repr, [("d/a.md", "old"), ("a.md", "2")]))
    with pytest.raises(ValueError):
        annotations.upload(cur, new, "image", "/p")
    assert tuple(annotations.upload_totals(cur).first()) == (1, 1)


def test_short_and_failing_clients(spark):
    df = spark.createDataFrame([(k, f"p{k % 3}", "stale") for k in range(6)], "k int, prompt string, reply string")
    short = align.ask(df, "prompt", lambda: lambda ps: ["ok"][: len(ps)], per_call=8)
    assert short.columns == ["k", "prompt", "reply"] and short.count() == 6
    assert {r["reply"] for r in short.collect()} <= {"ok", None}
    calls = spark.sparkContext.accumulator(0)

    def once_down():
        state = {"n": 0}

        def call(prompts):
            calls.add(len(prompts))
            state["n"] += 1
            if state["n"] == 1:
                raise OSError("down")
            return [p.upper() for p in prompts]

        return call

    assert {r["reply"] for r in align.ask(df, "prompt", once_down).collect()} == {"P0", "P1", "P2"}
    cache = spark.createDataFrame([("p0",), ("p1",)], "p string").select(align.prompt_key(F.col("p")).alias("prompt_key"), F.lit("cached").alias("reply"))
    got = {r["prompt"]: r["reply"] for r in align.ask(df, "prompt", lambda: lambda ps: ["asked"] * len(ps), cache=cache).collect()}
    assert got == {"p0": "cached", "p1": "cached", "p2": "asked"}


def test_intervals_are_clipped_to_their_chunk_and_merged_by_file(spark):
    req = spark.createDataFrame([("p", "r", "x"), ("p", "s", "x")], "project string, requirement_id string, requirement string")
    chunks = spark.createDataFrame([("p", "f", 1, 2, "c0"), ("p", "f", 3, 4, "c1")], "project string, file string, start_line int, end_line int, content string")
    lines = spark.createDataFrame([("p", "f", list("abcd"))], "project string, file string, lines array<string>")
    asked = spark.sparkContext.accumulator(0)

    def client():
        def call(prompts):
            asked.add(len(prompts))
            return ["[[1, 9]]" if "c0" in p else "[[2, 3]]" for p in prompts]

        return call

    got = align.align(req, chunks, lines, client)
    want = "1: a\n2: b\n3: c"
    assert rows(got) == sorted(map(repr, [("r", "f", want, 1, 3), ("s", "f", want, 1, 3)]))
    assert asked.value == 2  # two requirements of one text
    bad = lambda: lambda ps: ["[[1, 1]]" if "c0" in p else "no" for p in ps]
    assert align.align(req, chunks, lines, bad).count() == 2
    assert align.align(req, chunks, lines, bad, strict=True).count() == 0


def test_selections_and_places(spark):
    spans = spark.createDataFrame([("d", 0, 5), ("d", 5, 9), ("d", 5, 9), ("d", 20, 30)], "doc string, start int, end int")
    picked = spark.createDataFrame([("d", 1, 4, 6), ("d", 2, 10, 12)], "doc string, selection int, start int, end int")
    got = annotations.selected_spans(picked, spans, "doc", 4).first()
    assert (got["selection"], [tuple(s) for s in got["spans"]], got["start"], got["end"]) == (1, [(0, 5), (5, 9)], 0, 9)
    df = spark.createDataFrame([("a b a b", ["a", "a", "x", "b"])], "t string, p array<string>")
    found = df.select(annotations.locate_in_turn(F.col("t"), F.col("p")).alias("r")).first()["r"]
    assert [tuple(x) if x else None for x in found] == [(0, 1), (4, 5), None, (6, 7)]


def test_long_ranges_make_no_flood_of_bins(spark):
    left = spark.createDataFrame([("k", 1, 0, 10_000_000), ("k", 2, 5, 6), ("k", 3, 700, 1300)], "k string, i int, start long, end long")
    right = spark.createDataFrame([("k", 1, 9_999_999, 20_000_000), ("k", 2, 0, 6), ("k", 3, 1299, 1301), ("j", 4, 0, 9)], "k string, i int, start long, end long")
    got = intervals.overlap_join(left, right, "k", 1)
    want = [(1, 1, 9_999_999, 10_000_000), (1, 2, 0, 6), (1, 3, 1299, 1301), (2, 2, 5, 6), (3, 3, 1299, 1300)]
    assert rows(got, "l_i", "r_i", "clip_start", "clip_end") == sorted(map(repr, want))


def test_statement_heads():
    code = """#include <x>
// class in a comment {
}
template <class T>
std::vector<T> Foo<T>::bar(int a, T (*f)(int)) const noexcept
{
    if (a) {
    } else if (f) {
    }
    for (int i = 0; i < 2; i++) {
    }
    auto g = [](int x) { return x; };
}
int a[] = {1, 2};
Foo::Foo(int a) : b(a), c{} {
}
struct S : public B {
};
enum class E { A, B };
"""
    assert chunking.protected_blocks(code) == [(4, 13), (15, 16), (17, 18), (19, 19)]
    assert not any(map(chunking.opens_block, ["if (x)", "else", "do", "x = f(1)", "return g(2)", "i++)", "switch (a)", ""]))
    assert all(map(chunking.opens_block, ["int f()", "~A()", "operator int()", "namespace", "union U", "void f(int a) const"]))
    assert chunking.protected_blocks("int f() {\n" * 20_000) == []


def test_markdown_of_every_kind():
    got = requirements.Points("Title\n=====\n\na &amp; b<br>c <img src=\"x\"> ![alt](x) \\*s\\* `*k*`\n\n    code\n\nSub\n---\n1. one\n    - two\n#x\n| a |\n|---|\n| &lt; |", []).out
    assert [(p[0], p[2], p[4]) for p in got] == [
        (requirements.TEXT, "a & bc   *s* *k*", ["Title"]),
        (requirements.TEXT, "one\ntwo", ["Title", "Sub"]),
        (requirements.TABLE, "<table><tr><th>a</th></tr><tr><td>&lt;</td></tr></table>", ["x"]),
        (requirements.ROW, None, ["x", "table_2"]),
    ]
    assert requirements.Points("", []).out == []


def word(body, rels="", media=b""):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        if rels:
            z.writestr("word/_rels/document.xml.rels", f"<Relationships>{rels}</Relationships>")
            z.writestr("word/media/i.png", media)
    return out.getvalue()


def test_images_and_formulas_over_paragraphs(spark, tmp_path):
    par = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    image = '<w:p><w:r><w:drawing><x r:embed="r1"/></w:drawing></w:r></w:p>'
    rel = '<Relationship Id="r1" Type="http://t/image" Target="media/i.png"/>'
    cell = f"<w:tbl><w:tr><w:tc>{par('a &lt; b')}</w:tc></w:tr></w:tbl>"
    data = word(par("$ a +") + par("b $") + par("after") + image + cell, rel, b"png")
    files = spark.createDataFrame([("a.docx", data), ("bad", b"x")], "path string, content binary")
    markdown, media = docx.convert(files, f"file://{tmp_path}/out")
    text = markdown.where("path = 'a.docx'").first()["markdown"]
    assert text.startswith('$ a +\nb $\n\nafter\n\n<img src="media/i.png">')
    assert [tuple(r) for r in media.collect()] == [("a.docx", "media/i.png", b"png")]
    assert docx.html_tables(files).first()["html"] == "<table><tr><td>a &lt; b</td></tr></table>"


def test_text_in_other_encodings(spark):
    files = spark.createDataFrame([("u", "é\r\n".encode()), ("g", "中文".encode("gbk")), ("n", None), ("x", b"\xff\xff\xff")], "path string, content binary")
    assert {r["path"]: r["content"] for r in repo.read_text(files, "gbk").collect()} == {"u": "é\n", "g": "中文", "n": None, "x": None}
    assert {r["path"]: r["content"] for r in repo.read_text(files).collect()}["g"] is None


def test_projects_and_history(spark, tmp_path):
    files = spark.createDataFrame([("code_repo/a.c",), ("doc_repo/b.md",)], "path string")
    named, blank = (spark.createDataFrame([(x,)], "project_name string") for x in ("p", ""))
    assert repo.valid_project(files, named).first()["valid"] and not repo.valid_project(files, blank).first()["valid"]
    assert not repo.valid_project(files.limit(0), named).first()["valid"]
    (tmp_path / "h.json").write_text('[{"name": "a", "path": "/a", "last_opened": "2024-01-01T00:00:00"}, {"name": "b", "path": "/b", "last_opened": "2024-02-01T00:00:00"}]')
    (tmp_path / "bad.json").write_text("not json")
    assert [r["name"] for r in json_files.history(spark, f"{tmp_path}/h.json").collect()] == ["b", "a"]
    assert json_files.history(spark, f"{tmp_path}/bad.json").count() == 0 == json_files.history(spark, f"{tmp_path}/none.json").count()


def test_latex_and_offsets(spark):
    df = spark.createDataFrame([(r"\begin{array}{*{3}{c}}x\begin{array}{*{2}{r}} ",), (None,)], "t string")
    assert [r[0] for r in df.select(T.clean_latex(F.col("t"))).collect()] == [r"\begin{array}{ccc}x\begin{array}{rr}", None]
    from tracelake.operators import lines

    docs = spark.createDataFrame([("a", "é\nbc\r\n"), ("b", None), ("c", ""), ("d", "\n\nx")], "file string, content string")
    assert rows(lines.line_offsets(docs)) == sorted(map(repr, [("a", 1, 0, 1), ("a", 2, 2, 4), ("d", 1, 0, 0), ("d", 2, 1, 1), ("d", 3, 2, 3)]))


def test_candidates_look_up_asked_words_only(spark):
    """Words that no requirement has never reach a shuffle; weights are those of the whole index."""
    chunks = spark.createDataFrame([("p", k, 1, f"common alpha{k % 3} own{k} " + " ".join(f"w{k}x{j}" for j in range(50))) for k in range(40)], "project string, file int, start_line int, content string")
    asked = spark.createDataFrame([("p", "alpha1"), ("p", "own7"), ("q", "own8")], "project string, word string")
    rows = lambda df: sorted(tuple(r) for r in df.select("project", "word", "file", "start_line", "weight").collect())
    want = [r for r in rows(retrieve.index(chunks, 0.5)) if r[1] in ("alpha1", "own7")]
    assert len(want) == 14 and rows(retrieve.index(chunks, 0.5, asked)) == want


def test_prompts_about_a_chunk_follow_one_another(spark):
    """A client sees the prompts about one chunk together, so that what it makes of the code can serve them all."""
    reqs = spark.createDataFrame([("p", str(k), f"word{k:04d} of it") for k in range(30)], "project string, requirement_id string, requirement string")
    chunks = spark.createDataFrame([("p", f"f{k}", 1, 1, f"1: word{k:04d} {k}") for k in range(40)], "project string, file string, start_line int, end_line int, content string")
    code = chunks.selectExpr("project", "file", "array(concat('word', lpad(substr(file, 2), 4, '0'))) as lines")

    def client():
        turns = []

        def ask(prompts):
            for p in prompts:
                turns.append(p.partition("Numbered code:\n")[2])
            changes = sum(a != b for a, b in zip(turns, turns[1:])) + 1
            return ['{"related_code": [[1, 1]]}' if changes == len(set(turns)) else "{}" for _ in prompts]

        return ask

    got = align.align(reqs, chunks, code, client)
    assert got.count() == 30 * 40
    named = align.align(reqs, chunks, code, align.overlap_stub).select("requirement_id", "filename").collect()
    assert sorted((int(r[0]), r[1]) for r in named) == [(k, f"f{k}") for k in range(30)]


def _shuffled(spark) -> int:
    """Rows that stages of the session have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_that_name_nothing_are_not_shuffled(spark):
    """Chunks and requirements are, and what is found: their product is larger by far."""
    reqs = spark.createDataFrame([("p", str(k), f"word{k:04d} of it") for k in range(90)], "project string, requirement_id string, requirement string")
    chunks = spark.range(300).selectExpr("'p' as project", "concat('f', id) as file", "1 as start_line", "1 as end_line", "concat('1: word', lpad(id, 4, '0')) as content")
    code = chunks.selectExpr("project", "file", "array(substr(content, 4)) as lines")
    before = _shuffled(spark)
    got = {(r[0], r[1]) for r in align.align(reqs, chunks, code, align.overlap_stub).select("requirement_id", "filename").collect()}
    assert got == {(str(k), f"f{k}") for k in range(90)}
    assert _shuffled(spark) - before < 90 * 300 / 5


def test_every_pair_of_texts_is_asked_once(spark):
    """Copies in a project and across projects, a project of many shares and lots, chunks without text, project or file."""
    word = lambda k: f"word{k % 23:04d}"
    reqs = [("p", f"r{k}", f"{word(k)} {k}") for k in range(70)] + [("p", "again", f"{word(3)} 3"), ("q", "s0", f"{word(5)} 5"), ("q", "s1", f"{word(6)} own"), ("q", "s2", None), (None, "t", word(1))]
    chunks = [("p", f"f{k}", 1, 1, f"1: {word(k)} {k % 290}") for k in range(600)] + [("p", "two", 2, 2, f"2: {word(5)}"), ("p", "two", 1, 1, f"1: {word(6)}")]
    chunks += [("q", f"g{k}", 1, 1, f"1: {word(k)} {k}") for k in range(8)] + [("q", "h", 1, 1, None), (None, "f1", 1, 1, f"1: {word(1)}"), ("none", "f1", 1, 1, f"1: {word(1)}"), ("q", None, 1, 1, f"1: {word(6)}")]
    code = {}
    for p, f, n, _, text in chunks:
        code.setdefault((p, f), {})[n] = (text or ": ").partition(": ")[2]
    lines = [(p, f, [v[n] for n in sorted(v)]) for (p, f), v in code.items()]
    asked = spark.sparkContext.accumulator(0)

    def client():
        stub = align.overlap_stub()

        def call(prompts):
            asked.add(len(prompts))
            return stub(prompts)

        return call

    df = spark.createDataFrame
    tables = [df(reqs, "project string, requirement_id string, requirement string"), df(chunks, "project string, file string, start_line int, end_line int, content string"), df(lines, "project string, file string, lines array<string>")]
    got = sorted((r.requirement_id, r.filename, r.content, r.start, r.end) for r in align.align(*tables, client).collect())
    own = lambda text: set((text or "").replace(":", "").split())
    pairs = [(r, c) for r in reqs for c in chunks if r[0] and r[0] == c[0] and c[1]]
    want = [(r[1], c[1], c[4], c[2], c[3]) for r, c in pairs if {w for w in own(r[2]) & own(c[4]) if len(w) > 4}]
    both = {(r, f) for r, f, *_ in want if sum(x[:2] == (r, f) for x in want) > 1}
    assert not both and got == sorted(want)
    assert asked.value == len({(r[2], c[4]) for r, c in pairs})
