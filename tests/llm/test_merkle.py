"""Merkle manifests and proofs against trees built in one process."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tracelake.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in FIELDS))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def path(tree, k):
    for level in tree[:-1]:
        first = k // 8 * 8
        yield level[first:k], level[k + 1 : first + 8]
        k //= 8


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = [*path(trees[g], i), *path(top, k)]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            now = leaf({**r, "text": lowered(r["text"])} if hit else r)
            for left, right in steps:
                now = h(*left, now, *right)
            proof = h(*(x for left, right in steps for x in left + right))
            yield r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], proof, now, now == top[-1][0]


def verified(df):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = F.when(hit, merkle.leaf_hash("doc_id", "source", "lang", "n_chars", lower))
    return sorted(map(repr, (tuple(r) for r in merkle.verify(df, FIELDS, found).collect())))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65, 700])
def test_sizes(spark, n):
    rows = [{"doc_id": k * 7 % 1009, "text": f"Text {k} É", "lang": "en", "source": "s", "n_chars": k} for k in range(n)]
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    assert verified(df) == sorted(map(repr, brute(rows)))


def test_many_groups_nulls_repeats_and_names(spark):
    rows = []
    for k in range(900):
        lang = None if k % 50 == 0 else f"l{k % 83}" if k % 3 else "hot"
        rows.append({"doc_id": None if k % 97 == 0 else k // 2, "text": (None, "", "ABC", f"Über {k}" * (k % 9))[k % 4], "lang": lang, "source": None if k % 5 else "", "n_chars": k if k % 7 else None})
    rows += rows[:20]  # whole rows again
    rows[3]["text"] = "Long " * 50_000
    extra = ", leaf string, tree int, run long, `more` string"
    df = spark.createDataFrame([(*(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")), "x", 1, 2, "y") for r in rows], SCHEMA + extra)
    assert verified(df) == sorted(map(repr, brute(rows)))


def test_lower_levels_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "UPPER", 3)
    rows = [{"doc_id": k, "text": f"T{k}", "lang": f"l{k % 9}", "source": "s", "n_chars": k} for k in range(1500)]
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    assert verified(df) == sorted(map(repr, brute(rows)))


def test_manifest_tables_and_carried_columns(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], f"t{k}", k * 10) for k in range(100)], "id long, group string, text string, extra long")
    m = merkle.build(df.select("id", "group", merkle.leaf_hash("text").alias("leaf"), "extra"))
    assert m.roots.count() == 1 and m.subroots.count() == 2 and m.most == 50
    got = merkle.proofs(m).select("id", "extra", "leaf", "root", merkle.fold(F.col("leaf"), F.col("path")).alias("folded")).collect()
    assert len(got) == 100 and all(r["extra"] == r["id"] * 10 and r["folded"] == r["root"] for r in got)
    assert {r["id"]: r["leaf"] for r in got}[7] == h("2:t7")
