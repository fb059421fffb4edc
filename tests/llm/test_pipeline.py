import re

import pytest

import corpus_pipeline
from tracelake.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(k, n=60):
    return " ".join(f"{w}{(k * 7 + i * i) % 97}" for i, w in enumerate(["alpha", "beta", "gamma", "delta"] * (n // 4)))


def corpus():
    texts = [prose(k) for k in range(20)]
    item = " ".join(f"bench{i}" for i in range(20))
    texts += [texts[0], texts[0], None, "", "12345 !!", item + " tail", prose(30, 2000) + " " + item, "X" + texts[1][0:], texts[2].upper()]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    # A copy with one word in sixty changed, and one with a fifth changed.
    near, far = texts[5].split(), texts[6].split()
    near[30], far[::5] = "changed", ["changed"] * 12
    rows += [(100, " ".join(near), "en", "s1", 1), (101, " ".join(far), "en", "s1", 1)]
    rows += [(102, " ".join(chr(0x4E00 + (k * k) % 20000) * 3 for k in range(80)), None, "s2", 1)]  # no learned language
    return rows + [rows[3], (None, texts[4], "en", None, 5)], item


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def jaccard(a, b):
    def grams(text):
        w = lower(text).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def brute(rows, item):
    """Ids that reach the mix, by the rules of the stages."""
    kept = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1]) and r[0] != 102]
    by_text = {}
    for r in kept:
        old = by_text.get(r[1])
        if old is None or (r[0] is not None and (old[0] is None or r[0] > old[0])):
            by_text[r[1]] = r
    kept = list(by_text.values())
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if jaccard(kept[i][1], kept[j][1]) >= 0.8:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    first = {}
    for x, r in zip(root, kept):
        if x not in first or (r[0] is not None and (first[x][0] is None or r[0] < first[x][0])):
            first[x] = r

    def words(text):
        return re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(text))

    windows = {tuple(words(item)[i : i + 13]) for i in range(8)}
    out = []
    for r in first.values():
        w = words(r[1])
        hit = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for j in range(i, i + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r[0])
    return sorted(map(str, out))


def test_stages_against_brute_force(spark, tmp_path):
    rows, item = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    want = brute(rows, item)
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == want
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in mixed) == want
    assert sum(r["taken"] for r in mixed) > 0


def test_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_duplicates", "near_duplicates", "decontaminate", "mix"]


CLASH = "lang_pred string, score double, bits double, n_words string, n_hit double, items string, contaminated string, rid long, id string, node long"
MINE = ("mine", 0.25, -1.0, "many", 0.5, "mine", "maybe", 7, "x", 3)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns_whatever_their_names(spark, tmp_path, name, stage):
    rows, item = corpus()
    rows = [(*r, *MINE) for r in rows] + [(*[None] * 5, *[None] * 10)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, {CLASH}")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, df, str(tmp_path))
    assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
    got = [tuple(r) for r in out.collect()]
    assert got and set(got) <= set(rows)
    again = [tuple(r) for r in stage(spark, df.repartition(3), str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nothing_learned_keeps_texts_with_a_letter(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "123", None), (3, None, None), (4, "", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in langid.keep_known(df, langid.train(df)).collect()] == [1]
