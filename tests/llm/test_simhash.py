import random

import numpy as np
import pytest
import xxhash

from tracelake.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return out


def brute_classes(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("cut_above", [50_000, 3])
def test_links_connect_what_is_near(spark, cut_above):
    rnd = random.Random(3)
    seeds = [rnd.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = set(seeds)
    for s in seeds:
        for _ in range(25):
            for _ in range(rnd.choice([1, 2, 3])):
                s ^= 1 << rnd.randrange(64)
            fps.add(s)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), cut_above)
    got = {r["node"]: r["root"] for r in simhash.classes(edges).collect()}
    want = brute_classes(signed, fps)
    classes = {}
    for f, w in zip(signed, want):
        classes.setdefault(w, set()).add(f)
    mine = {}
    for f in signed:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_operator_against_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = ["alpha", "Beta", "c", "dé", "épsilon", "x" * 50]
    texts = [None, "", "  \t\n", "one", "ONE", "one two", "a b c", "A  b\tC"]
    texts += [" ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 60))) for _ in range(30)]
    long = " ".join(rnd.choices(vocabulary, k=simhash.CHUNK + 4000))
    texts += [long, long + " tail", texts[10], texts[10]]
    ids = [None if i == 9 else 7 * (len(texts) - i) for i in range(len(texts))]
    ids[-1] = ids[-2]
    df = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts)], SCHEMA)
    got = simhash.near_duplicates(df).collect()
    fps = brute(texts, 3)
    want = sorted(map(repr, zip(ids, fps, brute_classes(ids, fps))))
    assert sorted(repr((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"])) for r in got) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
