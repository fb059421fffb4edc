import re

from tracelake.llm import secrets

SCHEMA = "doc_id long, text string, lang string, source string, spans string"
LIVE = "Zx9kQ2mLpR7vT4wYbN8c"
COPIED = "Ab1Cd2Ef3Gh4Ij5Kl6Mn"


def brute(text):
    spans = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_base_spans_and_ownership(spark):
    texts = [
        None, "", "no secret here", "é😀 PassWord: 'abcdefghijkl' tail", "token=short token: secret=abcdefghijklmnop",
        "token=secret: abcdefghijklmnop", "api_key = 0123456789abcdef0 APIKEY:\"x.y-z/=+_12\"", "AKIAABCDEFGHIJKLMN AKIAAKIA AKIA0123456789012",
        "deadbeef" * 3 + "g" + "0" * 15, "ſecret=abcdefghijkl", f"bare {LIVE} here", f"again {LIVE}", *[f"doc {COPIED} {k}" for k in range(5)],
        " ".join(f"passwd={k:014d}" for k in range(900)), "token" + " " * 5000 + "= abcdefghijklm",
    ]
    rows = [(i, t, "en", f"s{i % 5}" if i else None, "clash") for i, t in enumerate(texts)] + [(None, texts[3], None, "s1", "x")] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    got = secrets.scan(df, few_owners=2).select("doc_id", secrets.span_text("spans").alias("all"), "spans").collect()
    assert len(got) == len(rows)
    for r in got:
        text = (texts[r["doc_id"]] if r["doc_id"] is not None else texts[3]) or ""
        base = ",".join(x for x in r["all"].split(",") if x and not x.startswith("owned"))
        assert base == brute(text)
        for s in r["spans"]:
            assert s["value"] in text[s["start"] : s["end"]]
    owned = {r["doc_id"] for r in got if "owned" in r["all"]}
    assert owned == {10, 11}  # few owners: live-looking; the copied example has five


KEY40 = "wJalrXUtnFEMI/K7MDENG/bPxRfiCY1a2b3c4d5e"
UUID = "550e8400-e29b-41d4-a716-446655440000"


def test_wide_tokens_and_the_verdict(spark):
    placeholder, spread = "Pl4c3H0ld3rPl4c3H0ld3r", "Sp1r2e3a4d5Sp1r2e3a4d5"
    texts = [f"key {KEY40} here", f"id {UUID}=", "see /blog/2024/05/12/some-long-title-of-words and some-very-long-hyphenated-words-1234"]
    rows = [(k, t, "en", "s0", "") for k, t in enumerate(texts)]
    rows += [(100 + k, f"{placeholder} text {k}", "en", "s0", "") for k in range(60)]  # one owner, many texts
    rows += [(300 + k, f"the same {LIVE}", "en", "s0", "") for k in range(90)]  # one text, many copies
    rows += [(500 + k, f"{spread} {k}", f"l{k % 4}", f"s{k % 2}", "") for k in range(4)]  # two owners, four repositories
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    values = {k: [s["value"] for s in r["spans"]] for k, r in got.items()}
    assert values[0] == [KEY40] and values[1] == [UUID + "="] and values[2] == []
    assert values[100] == [] and values[500] == []
    assert values[300] == [LIVE] and (got[300]["spans"][0]["n_texts"], got[300]["spans"][0]["n_repos"]) == (1, 1)


def test_very_many_matches(spark):
    text = " ".join(f"passwd={k:014d}" for k in range(70_000))
    got = secrets.scan(spark.createDataFrame([(1, text, "en", "s", "")], SCHEMA)).select(secrets.span_text("spans").alias("all")).first()
    assert got["all"] == brute(text)


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_bare_tokens_among_base_spans(spark):
    """Twice the tokens take about twice the time, and the tokens apart from base spans are those of a plain search."""
    import time

    def seconds(n):
        text = " ".join(f"passwd=abcdefghijkl{k:06d}x token ZZ{k:08d}abcdEFGH{k:04d}" for k in range(n))
        began = time.perf_counter()
        got = secrets.scan(spark.createDataFrame([(1, text, "s", "l")], "doc_id long, text string, source string, lang string")).first()
        return time.perf_counter() - began, got["spans"], text

    seconds(10)
    (few, _, _), (many, spans, text) = seconds(8000), seconds(16_000)
    assert many < 2.5 * few + 2
    base = [(s.start, s.end) for s in spans if s.kind < 3]
    owned = [(s.start, s.end) for s in spans if s.kind == 3]
    assert len(base) >= 16_000 and len(owned) == 16_000
    taken = set()
    for a, b in base:
        taken.update(range(a, b))
    assert all(a not in taken and b - 1 not in taken and text[a:b].startswith("ZZ") for a, b in owned)
