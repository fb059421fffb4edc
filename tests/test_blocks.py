"""Trees of blocks and of folders, and helpers whose work grows with the line."""

import json
import random
import time

from tracelake.operators import blocks, chunking, requirements, stats

TEXT = """# T

Intro | a
more

- one
  cont
  - two
    lazy
  - three

    para
- four
lazy line

1. n
2) m

> q1
> > q2
lazy
>
> - x
>   ```py
>   code

```
fence
# no
```

| a | b |
|---|---|
| 1 | 2 |

    ind
    more
T2
--
***
"""


def test_tree(spark):
    got = blocks.block_tree(spark.createDataFrame([(1, TEXT.replace("\n", "\r\n")), (2, None), (3, "")], "doc int, content string")).orderBy("node").collect()
    seen = [(r.kind, r.parent, r.depth, r.info, TEXT[r.start : r.end].split("\n")[0]) for r in got]
    assert {r.doc for r in got} == {1} and [r.node for r in got] == list(range(len(got)))
    assert seen == [
        ("heading", None, 0, "1", "# T"), ("paragraph", None, 0, "", "Intro | a"), ("list", None, 0, "-", "- one"), ("item", 2, 1, "", "- one"),
        ("paragraph", 3, 2, "", "one"), ("list", 3, 2, "-", "- two"), ("item", 5, 3, "", "- two"), ("paragraph", 6, 4, "", "two"), ("item", 5, 3, "", "- three"),
        ("paragraph", 8, 4, "", "three"), ("paragraph", 8, 4, "", "para"), ("item", 2, 1, "", "- four"), ("paragraph", 11, 2, "", "four"),
        ("list", None, 0, "1.", "1. n"), ("item", 13, 1, "", "1. n"), ("paragraph", 14, 2, "", "n"), ("list", None, 0, "1)", "2) m"), ("item", 16, 1, "", "2) m"),
        ("paragraph", 17, 2, "", "m"), ("quote", None, 0, "", "> q1"), ("paragraph", 19, 1, "", "q1"), ("quote", 19, 1, "", "> q2"), ("paragraph", 21, 2, "", "q2"),
        ("list", 19, 1, "-", "- x"), ("item", 23, 2, "", "- x"), ("paragraph", 24, 3, "", "x"), ("code", 24, 3, "py", "```py"), ("code", None, 0, "", "```"),
        ("table", None, 0, "", "| a | b |"), ("code", None, 0, "", "ind"), ("heading", None, 0, "2", "T2"), ("rule", None, 0, "", "***"),
    ]
    ends = {r.node: TEXT[r.start : r.end] for r in got}
    assert ends[2].endswith("lazy line") and ends[21] == "> q2\nlazy" and ends[19].endswith("code") and ends[28].endswith("| 1 | 2 |")


def test_ranges_nest():
    """On random texts a block lies in its parent, and siblings do not overlap."""
    rnd = random.Random(3)
    signs = ["- ", "> ", "1. ", "  ", "    ", "# ", "```", "|", "---", "***", "a", "b c", "\n", "\n\n", "* "]
    for _ in range(4000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 40)))
        last: dict[int, int] = {}
        for kind, parent, depth, start, end, _ in blocks.Tree(text).nodes:
            assert 0 <= start <= end <= len(text) and kind
            if parent >= 0:
                p = blocks.Tree(text).nodes[parent]
                assert p[3] <= start and end <= p[4] and depth == p[2] + 1 and p[0] in ("quote", "list", "item"), text
            assert last.get(parent, 0) <= start, text
            last[parent] = end


def test_helpers_grow_with_the_line():
    def seconds(f, n):
        began = time.perf_counter()
        f(n)
        return time.perf_counter() - began

    probes = [lambda n, u=u: requirements.inline(u * n) for u in ("<!-- ", "[", "![", "[x](", "**a ", "__a **b ")]
    probes += [lambda n, u=u: blocks.Tree(u * n + "x") for u in ("> ", "- ", "* a\n", "1. ", "| a ")]
    probes += [lambda n: chunking.protected_blocks("def f(x):\n    return x\n" * n + "{")]
    for f in probes:
        assert seconds(f, 40_000) < 2  # with square growth minutes


def test_inline_markup_as_before():
    cases = {
        "a [b](c) ![d](e) <http://f> <i>g</i> **h** *i* _j_ `**k**`": "a b  http://f g h i j **k**",
        "[a [b](c)": "a [b", "[a] (b)": "[a] (b)", "[a](b": "[a](b", "x <!-- y --> z <!-- w": "x  z <!-- w", "**a __b__ c**": "a __b__ c",
    }
    assert {t: requirements.inline(t) for t in cases} == cases


def test_folders(spark):
    files = spark.createDataFrame([("b/x.py", 5), ("b/c/y.py", 7), ("b\\c//z.py", 1), ("a.md", 2), ("a.md", 3), ("", 9), ('q"/k', None)], "path string, size long")
    totals = {r.folder: (r.depth, r.n_files, r.size) for r in stats.folder_totals(files).collect()}
    assert totals == {"": (0, 6, 18), "b": (1, 3, 13), "b/c": (2, 2, 8), 'q"': (1, 1, 0)}
    trees = {r.path: json.loads(r.tree) for r in stats.nested_tree(files).collect()}
    assert set(trees) == {"b", "a.md", 'q"'} and trees["a.md"] == {"label": "a.md", "path": "a.md", "type": "file", "n_files": 1, "size": 3}
    b = trees["b"]
    assert (b["type"], b["n_files"], b["size"]) == ("directory", 3, 13) and [c["label"] for c in b["children"]] == ["c", "x.py"]
    assert [c["path"] for c in b["children"][0]["children"]] == ["b/c/y.py", "b/c/z.py"]
    assert {r.path for r in stats.nested_tree(files, top=2).collect()} == {"b/c", "b/x.py", 'q"/k'}
    assert stats.nested_tree(files.limit(0)).collect() == []
