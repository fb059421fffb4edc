import re

import numpy as np
import pytest

from tracelake.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def targets(sizes, weights=(5, 2, 1), ratio=1.5, most=2.0):
    """Reshare the excess again and again, as the contract says it."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, out, free = ratio * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {**out, **share}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


def corpus():
    rows = [(i, "w " * (i * 37 % 300), f"s{i % 6}" if i % 11 else None, "clash") for i in range(300)]
    rows += [(1000 + k, "hot word\t" * 200, "s0", "c") for k in range(150)]
    return rows + [(None, None, "s1", "c"), (2000, "", "only-empty", "c"), rows[5], rows[5], (3000, "x " * 100_000, "s2", "c")]


def test_targets_and_limits(spark):
    rows = corpus()
    got = mixing.mix_taken(spark.createDataFrame(rows, SCHEMA), rows_per_bucket=50)
    out = got.collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(0.02 * want[s], 130)
    again = mixing.mix_taken(spark.createDataFrame(rows, SCHEMA).repartition(7), rows_per_bucket=50).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_mixed_blocks_hold_the_words(spark):
    rows, _, mixed = mixing.mix(spark.createDataFrame(corpus(), SCHEMA), block_words=50, shards=4)
    slots = mixed.groupBy("rank", "slot").agg({"block": "count"}).count()
    assert slots == mixed.select("rank", "slot").distinct().count()
    per = {(r["rank"], r["slot"]): 0 for r in mixed.collect()}
    for r in mixed.collect():
        per[r["rank"], r["slot"]] += r["to_word"] - r["from_word"]
    assert max(per.values()) == 50
    assert {r["shard"] for r in mixed.select("shard").distinct().collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64))
    assert sorted(out) == list(range(n))


def test_empty_table(spark):
    assert mixing.mix_taken(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mix_as_text(spark):
    docs = [(i, "\t".join(f"d{i}w{j}" for j in range(i * 13 % 90)), f"s{i % 4}" if i % 7 else None, "c") for i in range(60)] + [(None, None, "s1", "c")]
    df = spark.createDataFrame(docs, SCHEMA)
    got = mixing.mix_text(df, block_words=20, shards=3).collect()
    taken = mixing.mix_taken(df, block_words=20, shards=3).collect()
    assert sum(len(r["text"].split(" ")) for r in got) == sum(r["taken"] for r in taken)
    source_of = {i: s for i, _, s, _ in docs}
    whole = {i: len((t or "").split()) for i, t, _, _ in docs}
    for r in got:
        words = [tuple(map(int, w[1:].split("w"))) for w in r["text"].split(" ")]
        assert 0 < len(words) <= 20 and {source_of[d] for d, _ in words} == {r["source"]}
        for (d, j), (e, k) in zip(words, words[1:]):  # words of a text in order, then the next text from its first word
            assert (e, k) == (d, j + 1) or (j == whole[d] - 1 and k == 0)
    assert mixing.mix_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_targets_of_many_sources(spark):
    sizes = {f"s{i:05d}": (i * 7919) % 1000 + (1 if i % 3 else 100_000) for i in range(700)} | {None: 5, "none": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df, (5, 2, 1), 1.5, 2.0).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_few_slots_over_many_shards(spark):
    df = spark.createDataFrame([("a", 640, 0, 5.0, 960.0)], "source string, source_size long, rank int, weight double, target double")
    slots = mixing.draw_slots(df, 64, 2.0, 1000, 3).collect()
    assert len(slots) == 15 and sorted(r["slot"] for r in slots) == list(range(15)) and len({r["shard"] for r in slots}) > 5


def test_small_sources_meet_their_targets(spark):
    """Thirty sources of a few words each: none misses its target by more than a word or a twentieth."""
    rows = [(k, " ".join(["w"] * (5 + k * 7 % 90)), f"s{k:02}") for k in range(30)]
    taken, target = {}, {}
    for r in mixing.mix_taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        taken[r["source"]], target[r["source"]] = taken.get(r["source"], 0) + r["taken"], r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= max(1, 0.05 * target[s]) for s in target)
