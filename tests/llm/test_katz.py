import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import katz

SCHEMA = "doc_id long, text string, held boolean, score string"


def words(text):
    w, out = "", []
    for c in (text or ""):
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c == " " or 9 <= ord(c) <= 13:
            if w:
                out.append(w)
            w = ""
        else:
            w += c
    return out + [w] * bool(w) + ["</s>"]


class Brute:
    """Katz's model by its definition, of any order."""

    def __init__(self, texts, order=2):
        self.order, self.count, self.begin = order, {n: Counter() for n in range(1, order + 1)}, len(texts)
        for t in texts:
            padded = ["<s>"] * (order - 1) + words(t)
            for i in range(order - 1, len(padded)):
                for n in self.count:
                    self.count[n][tuple(padded[i - n + 1 : i + 1])] += 1
        self.uni = {w: c for (w,), c in self.count[1].items()}
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.hist = {n: Counter() for n in range(2, order + 1)}
        for n in self.hist:
            for g, c in self.count[n].items():
                self.hist[n][g[:-1]] += c
        self.d = {
            n: katz.discounts([sum(c.values()), len(c), *(sum(x == r for x in c.values()) for r in range(1, katz.GOOD_TURING + 2))])
            for n, c in self.count.items()
        }
        self.unk = sum(self.f(1, c) for c in self.uni.values()) / self.n if self.n else 1.0

    def f(self, n, r):
        return float(self.d[n].freed(np.array([r]))[0])

    def p(self, h, w):
        n = len(h) + 1
        if n == 1:
            c = self.uni.get(w, 0)
            return (c - self.f(1, c)) / self.n if c else self.unk
        c = self.hist[n][h]
        if not c:
            return self.p(h[1:], w)
        r = self.count[n][*h, w]
        if r:
            return (r - self.f(n, r)) / c
        after = [g[-1] for g in self.count[n] if g[:-1] == h]
        freed = sum(self.f(n, self.count[n][*h, x]) for x in after) / c
        return freed / (1 - sum(self.p(h[1:], x) for x in after)) * self.p(h[1:], w)

    def log10(self, text):
        padded = ["<s>"] * (self.order - 1) + words(text)
        k = self.order - 1
        return sum(math.log10(self.p(tuple(padded[i - k : i]), padded[i])) for i in range(k, len(padded)))

    def base(self, text):
        return sum(math.log10((self.uni.get(w, 0) + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in words(text))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "averyveryverylongword" * 3, "12345678", "123456789"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(0, 40))) for _ in range(60)]
    texts += [None, "", "\t\n", "W0 w0\tw1\nUNSEEN-word", texts[3], texts[3], "x" * 5000]
    return [(i if i != 5 else None, t, i % 5 == 1 or i == 63, "clash") for i, t in enumerate(texts)]


def check(got, model, rows):
    assert len(got) == len(rows)
    want = {i: (held, len(words(t)), sum(w in model.uni for w in words(t)), model.n, model.base(t), model.log10(t)) for i, t, held, _ in rows}
    for r in got:
        assert list(r)[1:5] == list(want[r["doc_id"]][:4])
        assert list(r)[5:] == pytest.approx(want[r["doc_id"]][4:], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, corpus, monkeypatch, order):
    monkeypatch.setattr(katz, "UNIT_BYTES", 700)  # many units
    monkeypatch.setattr(katz, "PART_KEYS", 40)  # many partitions
    rows, model = katz.fit_score(spark.createDataFrame(corpus, SCHEMA).repartition(3), F.col("held"), order=order)
    brute = Brute([t for _, t, held, _ in corpus if not held], order)
    check(rows.collect(), brute, corpus)
    # Texts that the model never saw, from its tables alone.
    later = [(1, "w0 w1 new words w2 w0", True, ""), (2, None, True, ""), (3, corpus[3][1], True, ""), (4, "w0 " * 300, True, "")]
    check(model.score(spark.createDataFrame(later, SCHEMA)).collect(), brute, later)
    # The tables hold every gram seen in training, once.
    for n, table in model.counts.items():
        found = Counter()
        for r in table.collect():
            keys, counts = katz.unpack_sorted(r["keys"]), katz.unpack_counts(r["counts"])
            assert len(keys) == len(set(keys.tolist())) and (not len(keys) or set((keys >> np.uint64(64 - model.bits[n])).tolist()) == {r["part"]})
            found.update(counts.tolist())
        assert found == Counter(brute.count[n].values())


def test_weights_are_exactly_normalised(corpus):
    model = Brute([t for _, t, held, _ in corpus if not held], 3)
    every = [*model.uni, "never-seen"]
    for h in [(), ("<s>",), ("w0",), ("w1",), ("other",), ("<s>", "<s>"), ("<s>", "w0"), ("w0", "w1"), ("w1", "w0"), ("no", "w0")]:
        assert sum(model.p(h, w) for w in every) == pytest.approx(1)


def test_nothing_to_learn_and_nothing_to_score(spark):
    one = katz.score(spark.createDataFrame([(1, "a b", True, "")], SCHEMA), F.col("held")).first()
    assert (one["n_tokens"], one["n_known"], one["train_tokens"], one["score"]) == (3, 0, 0, 0.0)
    assert katz.score(spark.createDataFrame([], SCHEMA), F.col("held")).count() == 0


def test_counts_beyond_31_and_32_bits():
    for big in ((1 << 31) - 1, 1 << 31, 1 << 32):
        keys = [np.array([5, 9], np.uint64), np.array([9], np.uint64), np.array([5], np.uint64)]
        counts = [np.array([3, big], np.uint64), np.array([1], np.uint64), np.array([4], np.uint64)]
        table = pa.table(
            {"part": [0] * 3, "unit": [0, 1, 2], "keys": [katz.pack_sorted(k) for k in keys], "counts": [katz.pack_counts(c) for c in counts]}
        )
        rows = katz._add_up(table).to_pylist()
        assert [katz.unpack_counts(r["counts"]).tolist() for r in rows] == [[7, big + 1], [big + 1], [7], [7, big + 1]]
        assert [np.unpackbits(katz.unpack(r["owns"], np.uint8), count=2).tolist() for r in rows[:3]] == [[1, 1], [0, 0], [0, 0]]
        assert katz.unpack_sorted(rows[3]["keys"]).tolist() == [5, 9] and rows[3]["totals"][:2] == [big + 8, 2]
