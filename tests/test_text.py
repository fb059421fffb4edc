import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tracelake.functions import replies
from tracelake.functions import text as T
from tracelake.operators import chunking, intervals


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], TY.StructType([TY.StructField("x", TY._parse_datatype_string(kind))]))
    got = df.select(fn(F.col("x")).alias("y")).first()["y"]
    return got.asDict(True) if hasattr(got, "asDict") else got


@pytest.mark.parametrize(
    "reply, want",
    [
        ('{"related_code": [[5, 10]]}', [[5, 10]]),
        ("[[5, 10]]", [[5, 10]]),
        ('Here:\n```json\n{"related_code": [[5, 10]]}\n```', [[5, 10]]),
        ('{"related_code": []}', []),
        ("lines 5 to 10", None),
        ('{"related_code": [[5, 10]],}', [[5, 10]]),
        ('{"related_code": [[5, 10, 12]]}', None),
        ('{"related_code": [[5, null]]}', None),
        ("", None),
        (None, None),
    ],
)
def test_reply_intervals(spark, reply, want):
    assert one(spark, reply, replies.related_intervals) == want


def test_strict_reply_rejects_trailing_comma(spark):
    assert one(spark, '{"related_code": [[5, 10]],}', lambda x: replies.related_intervals(x, tolerant=False)) is None


@pytest.mark.parametrize(
    "pairs, want",
    [([[4, 6], [1, 3], [8, 9]], [[1, 6], [8, 9]]), ([[1, 10], [2, 3], [12, 12]], [[1, 10], [12, 12]]), ([], []), (None, None), ([[2, 2], [2, 2]], [[2, 2]])],
)
def test_merge(spark, pairs, want):
    assert one(spark, pairs, intervals.merge_array, "array<array<int>>") == want


ISSUE = "在[a]的[b]处，程序实现是甲，而需求是乙，实现与需求不一致，原因是丙。"


@pytest.mark.parametrize(
    "reply, process, issues",
    [
        (f"x\n{replies.END_OF_REVIEW}\n问题单\ny", "x", "y"),
        (f"x {replies.END_OF_REVIEW} y", "x", "y"),
        ("审查分析过程\nx\n问题单\ny", "x", "y"),
        ("问题单 y 审查分析过程 x", " x", ""),
        (f"x\n{ISSUE}z{ISSUE}", "x", f"{ISSUE}\n{ISSUE}"),
        ("nothing", "nothing", replies.NO_ISSUES),
        ("", "", replies.NO_ISSUES),
    ],
)
def test_review(spark, reply, process, issues):
    assert one(spark, reply, replies.review) == {"review_process": process, "issues": issues}


@pytest.mark.parametrize(
    "text, want",
    [("a\nb", ["a", "b"]), ("a\r\nb\rc\n", ["a", "b", "c"]), ("", []), (None, []), ("\n", [""]), ("a\n\n", ["a", ""]), ("\u00a0", ["\u00a0"])],
)
def test_lines(spark, text, want):
    assert one(spark, text, T.lines) == want


def test_blank_lines_do_not_count(spark):
    assert one(spark, "a\n \t\n\u00a0\n\nb", T.nonblank_count) == 2


@pytest.mark.parametrize(
    "fn, value, want",
    [
        (T.stem_last_dot, "a.b.md", "a.b"), (T.stem_last_dot, ".hidden", ".hidden"), (T.stem_first_dot, "a.b.md", "a"),
        (T.normalize_path, "a//b/", "a/b/"), (T.normalize_path, "c:\\x\\\\y", "c:\\x\\y\\"), (T.normalize_path, "", ""),
        (T.folder_name, "/a/b/", "b"), (lambda x: T.regularize(x, "doc"), "a$x$$y$\u200b\r\n", "a$x$ $y$\n"),
        (T.formulas, "$a$ $$b$$", ["$a$", "$$ b $$"]), (lambda x: T.formulas(x, True), "$a$ $$b$$", ["$a$", "$$  $$", "$$  $$"]),
        (lambda x: T.inside(x, F.lit("/r")), "/r/../etc", False), (lambda x: T.inside(x, F.lit("/r")), "/root", False),
        (lambda x: T.inside(x, F.lit("/r")), "/r/a", True),
    ],
)
def test_functions(spark, fn, value, want):
    assert one(spark, value, fn) == want


CODE = """namespace n {
int f(int a) {
  if (a) { return "}"; }
  else if (a > 1) { return 2; }
}
}
int g = 1;
class C {
};
int broken() {
"""


def test_protected_blocks():
    # The brace in the string closes f's inner block early, as braces are counted wherever they stand.
    assert chunking.protected_blocks("int f() {\n}\nint x;\nstruct S {\n};\n") == [(1, 2), (4, 5)]
    assert chunking.protected_blocks("int f() {\n") == []
    assert chunking.protected_blocks("namespace n {\nint f() {\n}\n}\n") == [(1, 4)]


@pytest.mark.parametrize("budget", [1, 5, 1000])
def test_chunks_cover_every_line_once(budget):
    counts = [3] * 11
    chunks = chunking.pack(counts, chunking.protected_blocks(CODE), budget)
    covered = [n for s, e in chunks for n in range(s, e + 1)]
    assert covered == list(range(1, 12))
    for s, e in chunks:
        assert sum(counts[s - 1 : e]) <= budget or (s, e) in chunking.protected_blocks(CODE) or s == e
