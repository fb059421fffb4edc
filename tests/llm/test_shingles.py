import random

import numpy as np

import corpus_pipeline
from tracelake.llm import shingles, simhash

SCHEMA = "doc_id long, text string, extra string"


def brute_grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_kept(rows):
    """Ids left where texts with a Jaccard similarity of 0.8 or more are linked and the smallest id of a class stays."""
    grams = [brute_grams(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                root = [root[j] if x == root[i] else x for x in root]
    first = {}
    for x, (d, _) in zip(root, rows):
        if x not in first or first[x] is None or (d is not None and d < first[x]):
            first[x] = d
    return sorted(map(str, first.values()))


def corpus():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \t", "one two", "ONE  two", "one two three"]
    for _ in range(25):
        base = rnd.choices(words, k=rnd.randrange(40, 300))
        texts.append(" ".join(base))
        for changed in (1, 2, 3, 5, 8, 13):
            copy = base[:]
            for _ in range(changed):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    chain = rnd.choices(words, k=200)  # neighbours are similar, the ends are not
    for k in range(8):
        texts.append(" ".join(chain[10 * k : 10 * k + 130]))
    texts += [texts[7], texts[7]]
    ids = rnd.sample(range(1000), len(texts))
    rows = [*zip(ids, texts)]
    return rows + [(None, "alone " + " ".join(words[:30])), (None, texts[7])]


def test_stage_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == brute_kept(rows)


def test_similar_texts_beyond_two_bits(spark):
    rows = corpus()
    grams = [shingles.shingles((t or "").encode()) for _, t in rows]
    prints = [simhash.fingerprint((t or "").encode(), 3) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if shingles.similar(grams[i], grams[j])]
    assert sum((prints[i] ^ prints[j]).bit_count() > 2 for i, j in near) > 20


def test_a_band_in_common():
    rows = corpus()
    grams = [shingles.shingles((t or "").encode()) for _, t in rows]
    keys = [shingles.band_keys(np.fromiter(map(simhash.HASH, g), np.uint64)) for g in grams]
    for i in range(len(rows)):
        for j in range(i):
            if shingles.similar(grams[i], grams[j]):
                assert (keys[i] == keys[j]).any()
            elif not grams[i] & grams[j]:
                assert (keys[i] != keys[j]).all()


def test_empty_table(spark):
    assert shingles.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_that_share_a_hash_have_names_of_their_own(spark):
    """With six bits a hash hundreds of texts share one; all their names differ."""
    docs = spark.range(500).selectExpr("concat('text ', id % 400) AS text")
    digests = docs.select(shingles.digest_of(docs["text"]).alias("digest"))
    names = shingles.Names(digests.distinct(), bits=6)
    assert len(names.listed) > 300
    named = digests.withColumn("node", names.of(digests["digest"]))
    assert named.select("node").distinct().count() == named.distinct().count() == 400
    assert shingles.Names(digests.distinct()).listed == []
