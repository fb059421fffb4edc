import random
import re

import pytest

from tracelake.llm import decontam

SCHEMA = "doc_id long, text string, n_hit string, extra int"


def words(t):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        if item is None or not p:
            continue
        m = min(13, len(p))
        windows = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)}
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def corpus():
    rnd = random.Random(4)
    vocabulary = ["a", "b", "c", "d", "é", "42", "über"]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.choice([3, 5, 13, 14, 30])))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "!!"), (None, items[0][1]), items[1], (200, items[1][1])]
    docs = []
    for k in range(60):
        t = rnd.choices(vocabulary + ["zz", "yy"], k=rnd.randrange(0, 200))
        if k % 3 == 0:
            at = rnd.randrange(len(t) + 1)
            t[at:at] = [rnd.choice(items[:25])[1].upper().replace(" ", "--")]
        docs.append((k, "\n".join(t), "clash", 1))
    docs += [(None, None, "x", None), (60, "", "x", 1), docs[0], (61, items[4][1] * 1 + " q" * 50_000, "x", 1)]
    return docs, items


@pytest.mark.parametrize("per_block", [1_000_000, 20])
def test_against_brute_force(spark, per_block):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.occurrences(spark.createDataFrame(docs, SCHEMA), bench, words_per_block=per_block).collect()
    assert len(got) == len(docs)
    by_id = {d[0]: d[1] for d in docs}
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == brute(by_id[r["doc_id"]], items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontam.occurrences(docs, items).count() == 0
    one = decontam.occurrences(spark.createDataFrame([(1, "a b", "x", 1)], SCHEMA), items).first()
    assert (one["n_words"], one["n_hit"], one["items"], one["contaminated"]) == (2, 0, [], False)


def test_clashes_of_case(spark):
    """``Items`` or ``N_HIT`` in the input are replaced like ``items``."""
    docs = spark.createDataFrame([(1, "one two three", "x", 5)], "doc_id long, text string, Items string, N_HIT int")
    bench = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    got = decontam.occurrences(docs, bench).select("items", "n_hit").first()
    assert list(got["items"]) == ["7"] and got["n_hit"] == 3
