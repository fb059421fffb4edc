import random

import numpy as np

from tracelake.llm import toxicity

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"
BAD = ["snarf", "grolm", "vexitude", "vexor"]


def corpus(n=500):
    rnd = random.Random(3)
    vocabulary = [f"word{i}x" for i in range(150)] + ["Über", "été"]
    docs, labels = [], []
    for i in range(n):
        w = rnd.choices(vocabulary, k=rnd.randrange(5, 80))
        toxic = i % 6 == 0
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(BAD).upper() if i % 12 else rnd.choice(BAD)
        docs.append((i, " ".join(w), "clash"))
        if i % 10 != 9:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_quality(spark):
    docs, labels = corpus()
    odd = [(None, None, "x"), (9000, "", "x"), (9001, "word " * 200_000 + "snarf", "x"), docs[0]]
    df, known = spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + [(3, None, None), labels[0]], LABELS)
    model = toxicity.train(df, toxicity.learnable(known))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [i for i, *_ in docs if toxicity_held(i)]
    assert all(got[i] >= 0.7 for i in held if i % 6 == 0)
    assert all(got[i] < 0.7 for i in held if i % 6)
    assert got[None] < 0.5 and got[9000] == got[None] and got[9001] >= 0.7


def toxicity_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3 == 1


def test_one_class_or_none(spark):
    docs = spark.createDataFrame(corpus(20)[0], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, toxicity.train(docs, none)).collect())
    all_bad = spark.createDataFrame([(i, 1, 1) for i in range(20)], LABELS)
    assert all(r["score"] > 0.99 for r in toxicity.score(docs, toxicity.train(docs, all_bad)).collect())
    assert toxicity.score(docs.limit(0), toxicity.Model(0.0, {})).count() == 0


def brute_em(votes, weight, first, parent, rounds):
    """EM of the label model by its definition, row by row."""
    n, m = len(votes), len(votes[0])

    def tables(p):
        out = {}
        for j in range(m):
            for y in (0, 1):
                for u in range(3):
                    count = [toxicity.SMOOTH] * 3
                    for i in range(n):
                        if (votes[i][parent[j]] if parent[j] >= 0 else 0) == u:
                            count[votes[i][j]] += weight[i] * (p[i] if y else 1 - p[i])
                    for v in range(3):
                        out[j, y, u, v] = count[v] / sum(count)
        return out

    def believe(p):
        t = tables(p)
        prior = sum(w * x for w, x in zip(weight, p)) / sum(weight)
        new = []
        for row in votes:
            both = [1 - prior, prior]
            for y in (0, 1):
                for j in range(m):
                    both[y] *= t[j, y, row[parent[j]] if parent[j] >= 0 else 0, row[j]]
            new.append(both[1] / sum(both))
        return new

    p = list(first)
    for _ in range(rounds):
        p = believe(p)
    return p


def planted(n=4000, seed=1):
    """Votes of four voters of their own, three that copy one another, and their truth; voters abstain and err both ways."""
    rnd = np.random.default_rng(seed)
    truth = rnd.random(n) < 0.3
    def voter(right):
        said = np.where(rnd.random(n) < right, truth, ~truth).astype(np.int8)
        return np.where(rnd.random(n) < 0.4, toxicity.ABSTAIN, said).astype(np.int8)
    own = [voter(a) for a in (0.9, 0.85, 0.8, 0.75)]
    copied = voter(0.7)
    copies = [np.where(rnd.random(n) < 0.95, copied, voter(0.7)) for _ in range(3)]
    return np.stack([*own, *copies], 1), truth


def test_em_against_brute_force():
    votes, truth = planted(150)
    votes = votes[:, :5]
    weight = np.random.default_rng(2).random(150) + 0.5
    first = np.where(truth, 0.8, 0.3)
    for parent in ([-1] * 5, [-1, 0, 0, 1, -1]):
        p = first
        for _ in range(7):
            p = toxicity.maximise(votes, p, weight, np.array(parent)).posterior(votes)
        assert np.allclose(p, brute_em(votes.tolist(), weight.tolist(), first.tolist(), parent, 7), rtol=1e-9, atol=1e-12)


def test_accuracies_and_correlations_are_estimated_from_votes():
    votes, truth = planted()
    few = np.where(np.arange(len(truth)) < 60, np.where(truth, 0.9, 0.1), np.nan)  # labels of 60 rows tell the classes apart
    model = toxicity.label_model(votes, np.ones(len(truth)), few)
    linked = {frozenset((j, int(k))) for j, k in enumerate(model.parent) if k >= 0}
    assert len(linked & {frozenset(x) for x in ((4, 5), (4, 6), (5, 6))}) == 2
    assert not any(min(x) < 4 for x in linked)
    got = model.accuracies(votes, np.ones(len(truth)))
    assert np.allclose(got[:4], [0.9, 0.85, 0.8, 0.75], atol=0.05)
    # Copies of a voter say little more than once: better than votes that count each of them.
    count = (votes == toxicity.TOXIC).sum(axis=1) - (votes == toxicity.CLEAN).sum(axis=1)
    p = model.posterior(votes)
    assert ((p > 0.5) == truth).mean() > ((count > 0) == truth).mean() + 0.02


def test_voters_abstain_and_vote_both_ways():
    v = toxicity.Voters({b"snarf": 0, b"grol*": 1}, {b"kindly": 0}, 2)
    assert v.votes(b"nothing here") == [2] * 4 + [2] * 4 + [2] * 4 + [0]
    assert v.votes(b"GROLM you MORON, f**k licence kindly") == [2, 1, 0, 2, 1, 2, 2, 2, 1, 1, 2, 0, 2]


def test_with_and_without_gold_voter(spark):
    """Clean votes tell the classes apart without gold labels in the fit too."""
    docs, labels = corpus()
    df, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    for gold in (False, True):
        model = toxicity.train(df, toxicity.learnable(known), gold=gold)
        assert model.check > 0.97
        got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
        assert all((got[i] >= 0.7) == (i % 6 == 0) for i, *_ in docs if toxicity_held(i))
