"""SpotSigs: fingerprints of texts and of edited texts, and near-duplicates, against plain sets."""

import hashlib
import itertools
import random
import re

import pytest

from tracelake.llm import spotsigs

SCHEMA = "doc_id long, text string"


def spots(text):
    words, found = re.findall(r"\w+", (text or "").lower()), set()
    for k, w in enumerate(words):
        rest = (words[j] for j in range(k + 1, len(words)) if words[j] not in spotsigs.ANCHORS)
        chain = list(itertools.islice(rest, 2))
        if w in spotsigs.ANCHORS and len(chain) == 2:
            found.add((w, *chain))
    return frozenset(found) or frozenset([("all", *words)])


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(rows):
    texts = [(i, t or "") for i, t in rows]
    for k, (i, t) in enumerate(texts):
        follows = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        now = t[: len(t) - half] + follows[:half]
        yield i, len(t), hashlib.sha256(now.encode()).hexdigest(), jaccard(spots(t), spots(now)), jaccard(spots(t), spots(follows))


def text(rnd, n):
    return " ".join(rnd.choice(["the", "of", "der", "la", *(f"w{k}" for k in range(30))]) + rnd.choice(["", ",", ".", "\n"]) for _ in range(n))


def made(seed, n):
    rnd = random.Random(seed)
    rows = [(k * 3, rnd.choice([None, "", "the the", "solo", "ÉÀ 😀 of x y", text(rnd, rnd.randrange(60)), text(rnd, 400)])) for k in range(n)]
    rows[n // 2] = (n // 2 * 3, "The long one of many " * 20_000)
    return rows


@pytest.mark.parametrize("n, parts", [(1, 4), (2, 4), (120, 4), (300, 37)])
def test_next_and_edited(spark, n, parts):
    rows = made(n, n)
    order = rows[:]
    random.Random(9).shuffle(order)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted(spotsigs.with_next(spark.createDataFrame(order, SCHEMA)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got] == list(brute(rows))
    seen = {}
    for r, (_, t) in zip(got, rows):
        assert len(r.fingerprint) == 16 * len(spots(t))
        assert seen.setdefault(r.fingerprint, spots(t)) == spots(t)


def test_nulls_repeats_names_and_no_rows(spark):
    names = SCHEMA + ", bucket int, ahead boolean, id string, tie int, signatures string"
    rows = [(None, "the a b"), (None, "of c d"), (5, "x"), (5, "x"), (5, "y of w1 w2"), (9, None), (9, "")]
    got = spotsigs.with_next(spark.createDataFrame([(*r, 1, True, "i", 2, "s") for r in rows], names)).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(i) for i, _ in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert spotsigs.with_next(spark.createDataFrame([], names)).collect() == []
    assert spotsigs.near_duplicates(spark.createDataFrame([], names)).collect() == []


def test_large_ids_and_text_ids(spark):
    big = 2**62
    got = spotsigs.with_next(spark.createDataFrame([(big + 1, "a of b c"), (big, "d of e f"), (None, "g")], SCHEMA)).collect()
    assert {r.doc_id for r in got} == {big, big + 1, None}
    got = spotsigs.with_next(spark.createDataFrame([("b", "x y"), ("a", "p q"), ("é", "z")], "doc_id string, text string")).collect()
    assert {r.doc_id: r.edited_sha256 for r in got}["é"] == hashlib.sha256(b"z").hexdigest()


def test_near_duplicates(spark):
    rnd = random.Random(4)
    rows, n = [(900_000, None), (900_001, ""), (900_002, "the")], 0
    for k in range(60):
        words = text(rnd, rnd.randrange(5, 200)).split()
        for _ in range(rnd.choice([1, 1, 2, 6])):
            copy = [rnd.choice(["w1", "of", "zz"]) if rnd.random() < 0.02 else w for w in words]
            rows.append((n := n + 1, " ".join(copy)))
    got = {r.doc_id: r.class_id for r in spotsigs.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    root = {i: i for i, _ in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    sets = [(i, spots(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if jaccard(a, b) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root}
    assert len(set(got.values())) < len(got) - 20


def test_likeness_is_pruned_by_length():
    a, b = spotsigs.signatures("the a1 b1 of c1 d1 the e1 f1"), spotsigs.signatures("the a1 b1")
    assert spotsigs.likeness(a, b) == pytest.approx(1 / 3) and spotsigs.likeness(a, b, 0.5) == 0.0
