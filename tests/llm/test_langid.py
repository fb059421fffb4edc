import math
import random

import numpy as np
import pytest

from tracelake.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ö"], "bb": ["the", "ing", "st", "er", "ou"], "": ["ß", "sch", "ei", "en"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randrange(1, 4))) for _ in range(n))


class Brute:
    """Counts of every order by dictionary, escape method C, one text at a time."""

    def __init__(self, texts):
        self.n = {}
        for t in texts:
            t = b"\0\0\0" + t
            for i in range(3, len(t)):
                for k in range(4):
                    c = self.n.setdefault(t[i - k : i], {})
                    c[t[i]] = c.get(t[i], 0) + 1

    def bits(self, t):
        t, out = b"\0\0\0" + t, 0.0
        for i in range(3, len(t)):
            for k in (3, 2, 1, 0, -1):
                if k < 0:
                    out += 8
                    break
                c = self.n.get(t[i - k : i])
                if not c:
                    continue
                total, distinct = sum(c.values()), len(c)
                if t[i] in c:
                    out -= math.log2(c[t[i]] / (total + distinct))
                    break
                out -= math.log2(distinct / (total + distinct))
        return out


def test_code_lengths_are_exact():
    rnd = random.Random(1)
    train = {x: [text(rnd, x, 30).encode() for _ in range(5)] for x in SYLLABLES}
    langs = sorted(train)
    counts = [(k, *langid.grams_of(train[x])) for k, x in enumerate(langs)]
    lang = np.concatenate([np.full(len(g), k) for k, g, _ in counts])
    gram = np.concatenate([g for _, g, _ in counts])
    trees = langid.freeze(langs, lang, gram, np.ones(len(gram)))
    texts = [text(rnd, x, 20).encode() for x in SYLLABLES] + [b"", b"k", b"\xff\x00 unseen ZZ", b"x" * 3000]
    got = trees.code_lengths(texts, cells=2000)
    for k, x in enumerate(langs):
        model = Brute(train[x])
        assert got[:, k] == pytest.approx([model.bits(t) for t in texts], rel=1e-4)
    # Tables split by language give the same lengths: nothing is left out.
    split = langid.forest(langs, lang, gram, np.ones(len(gram)), 1)
    assert len(split.groups) == len(langs) and split.langs == langs
    assert split.code_lengths(texts) == pytest.approx(got, rel=1e-6)


def test_held_out_accuracy_and_defined_cases(spark):
    rnd = random.Random(2)
    rows = [(i, text(rnd, x, rnd.randrange(5, 60)), x, "clash") for i in range(200) for x in SYLLABLES]
    odd = [(None, None, "aa", "x"), (1, "", "aa", "x"), (2, "123 !? 45", "aa", "x"), (3, "ka", None, "x"), rows[0], (4, text(rnd, "bb", 60_000), None, "x")]
    df = spark.createDataFrame(rows[:450] + odd, SCHEMA)
    trees = langid.train(df)
    assert trees.langs == ["", "aa", "bb"]
    test = langid.predict(spark.createDataFrame(rows[450:], SCHEMA), trees).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in test) / len(test) > 0.98
    got = {(r["doc_id"], r["text"]): r for r in langid.predict(spark.createDataFrame(odd, SCHEMA), trees).collect()}
    for key in [(None, None), (1, ""), (2, "123 !? 45")]:
        assert (got[key]["lang_pred"], got[key]["score"]) == ("und", 0.0)
    assert got[odd[-1][:2]]["lang_pred"] == "bb" and all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.train(empty) is None
    assert langid.predict(empty, None).count() == 0
    one = langid.predict(spark.createDataFrame([(1, "abc", None, "x")], SCHEMA), None).first()
    assert (one["lang_pred"], one["score"]) == ("und", 0.0)
