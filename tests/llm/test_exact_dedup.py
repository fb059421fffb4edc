import hashlib
import random

import pytest

from tracelake.llm import exact_dedup

SCHEMA = "doc_id long, text string, kept string, node string"


def corpus():
    rnd = random.Random(1)
    texts = ["hot"] * 40 + [None, "", "Hot", "hot ", "é", "x" * 100_000, "x" * 100_000] + [f"t{rnd.randrange(30)}" for _ in range(60)]
    rows = [(i if i % 17 else None, t, "k", "n") for i, t in enumerate(texts)]
    return rows + rows[:3] + [(900, "twice", "k", "n")] * 2 + [(None, "nobody", "k", "n")] * 2


@pytest.mark.parametrize("keep, pick", [("smallest", min), ("largest", max)])
def test_against_brute_force(spark, keep, pick):
    rows = corpus()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA), keep=keep, radix=2, rows_per_leaf=10).collect()
    assert len(got) == len(rows)
    digests = {hashlib.sha256(t.encode()).hexdigest(): (t, ids) for t, ids in groups.items()}
    kept = {}
    for r in got:
        text, ids = digests[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["keep_id"] == (pick(known) if known else None)
        assert r["group_size"] == len(ids)
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[text] = kept.get(text, 0) + 1
    assert kept == dict.fromkeys(groups, 1)


def test_keep_one_and_empty(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.keep_one(df, keep="largest")
    assert got.columns == df.columns
    assert sorted(r["text"] or "" for r in got.collect()) == sorted({t or "" for _, t, *_ in rows})
    nothing = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.keep_one(nothing).count() == 0


def test_keep_is_checked(spark):
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA), keep="first")


def test_columns_of_any_name_keep_their_values(spark):
    """Names that the dedup uses itself come out as they went in."""
    from tracelake.llm import shingles

    names = "doc_id long, text string, __id string, __digest string, __tie int, __nth int, __row string, c0 string"
    rows = [(1, "a b", "mine", "d", 7, 9, "r", "c"), (2, "a b", "yours", "e", 8, 3, "q", "x"), (3, "z", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, names)
    assert sorted(map(tuple, exact_dedup.keep_one(df).collect())) == [rows[0], rows[2]]
    got = shingles.keep_one(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
