"""Properties of interval merging, chunking and stores on generated inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.operators import chunking, intervals, store

SPANS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60), st.integers(0, 12)), min_size=1, max_size=40)
FEW = settings(max_examples=8, deadline=None)


def covered(rows):
    out = {}
    for k, s, e in rows:
        out.setdefault(k, set()).update(range(s, e + 1))
    return out


@FEW
@given(SPANS)
def test_merged_intervals_cover_the_same_with_gaps(spark, spans):
    rows = [(k, s, s + n) for k, s, n in spans]
    df = spark.createDataFrame(rows, "k int, start int, end int")
    merged = intervals.merge_intervals(df, ["k"])
    got = sorted(tuple(r) for r in merged.select("k", "start", "end").collect())
    assert covered(got) == covered(rows)
    for (k, _, e), (k2, s2, _) in zip(got, got[1:]):
        assert k != k2 or s2 >= e + 2
    again = sorted(tuple(r) for r in intervals.merge_intervals(merged, ["k"]).select("k", "start", "end").collect())
    assert again == got


@FEW
@given(SPANS, SPANS, st.integers(1, 30))
def test_overlap_join_is_the_theta_join(spark, left, right, width):
    a = [(k, i, s, s + n) for i, (k, s, n) in enumerate(left)]
    b = [(k, i, s, s + n) for i, (k, s, n) in enumerate(right)]
    dfs = [spark.createDataFrame(x, "k int, i int, start int, end int") for x in (a, b)]
    got = sorted((r["k"], r["l_i"], r["r_i"], r["clip_start"], r["clip_end"]) for r in intervals.overlap_join(*dfs, "k", width).collect())
    want = sorted(
        (k, i, j, max(s, s2), min(e, e2)) for k, i, s, e in a for k2, j, s2, e2 in b if k == k2 and s < e and s2 < e2 and e > s2 and s < e2
    )
    assert got == want


@FEW
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1), st.integers(0, 100)), min_size=1, max_size=30))
def test_upsert_keeps_one_row_per_key_and_the_last(spark, rows):
    numbered = [(k, side, v, n) for n, (k, side, v) in enumerate(rows)]
    df = spark.createDataFrame(numbered, "k int, side int, v int, n int")
    cur = store.latest(df.where("side = 0").drop("side"), ["k"], ["n"])
    got = {r["k"]: r["v"] for r in store.upsert(cur, df.where("side = 1").drop("side"), ["k"], ["n"]).collect()}
    want = {}
    for side in (0, 1):
        want |= {k: v for k, s, v, _ in numbered if s == side}
    assert got == want


@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.lists(st.tuples(st.integers(1, 60), st.integers(0, 9)), max_size=5), st.integers(1, 30))
def test_chunks_are_whole_and_ordered(counts, raw, budget):
    blocks, last = [], 0
    for s, n in sorted(raw):
        if s > last and s + n <= len(counts):
            blocks.append((s, s + n))
            last = s + n
    chunks = chunking.pack(counts, blocks, budget)
    assert [n for s, e in chunks for n in range(s, e + 1)] == list(range(1, len(counts) + 1))
    for s, e in blocks:
        assert any(a <= s and e <= b for a, b in chunks)
