"""Intervals against loops: covers, stabbing, segments, merges; and work that grows with the input, not with its square."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.functions import pieces
from tracelake.operators import annotations, intervals

RANGES = "k string, id int, start long, end long"


def made(seed, n=150, lengths=(0, -2, 1, 7, 60, 900, 20_000)):
    rnd = random.Random(seed)
    return [(rnd.choice("ab"), k, a, a + rnd.choice(lengths)) for k, a in enumerate(rnd.randrange(-500, 1000) for _ in range(n))]


def test_cover_is_exact(spark):
    rnd = random.Random(2)
    rows = [(a, a + rnd.choice([-3, 0, 1, 5, 50, 3000, 10**6])) for a in (rnd.randrange(-5000, 5000) for _ in range(200))]
    rows += [(2**60, 2**60 + 9)]
    for r in spark.createDataFrame(rows, "a long, b long").withColumn("c", intervals.cover(F.col("a"), F.col("b"))).collect():
        bins = sorted((x.bin * 4**x.level, (x.bin + 1) * 4**x.level) for x in r.c or [])
        assert sum(e - s for s, e in bins) == max(0, r.b - r.a + 1)
        assert not bins or (bins[0][0], bins[-1][1]) == (r.a, r.b + 1)
        assert all(x[1] == y[0] for x, y in zip(bins, bins[1:]))


def test_stabbing_join(spark):
    ranges, rnd = made(1), random.Random(3)
    points = [(rnd.choice("abz"), rnd.randrange(-600, 2500)) for _ in range(300)]
    got = intervals.stabbing_join(spark.createDataFrame(points, "k string, p int"), spark.createDataFrame(ranges, RANGES), "k", "p")
    want = sorted((k, p, i, s, e) for k, p in points for j, i, s, e in ranges if j == k and s <= p <= e)
    assert sorted((r.k, r.p, r.r_id, r.r_start, r.r_end) for r in got.collect()) == want
    held = intervals.held(spark.createDataFrame(points, "k string, p int"), spark.createDataFrame(ranges, RANGES), "k", "p")
    assert sorted(map(tuple, held.collect())) == sorted({x[:2] for x in want})
    none = spark.createDataFrame([], RANGES)
    assert intervals.stabbing_join(spark.createDataFrame(points, "k string, p int"), none, "k", "p").count() == 0


@pytest.mark.parametrize("width", [8, 1 << 16])
def test_segments(spark, width):
    ranges = made(4) + [("a", None, 3, 9), ("b", 1, None, 5), (None, 7, 0, 4), (None, 8, 2, 6)]
    got = intervals.segments(spark.createDataFrame(ranges, RANGES), "k", "id", width)
    want = []
    for k in ("a", "b"):
        own = [r for r in ranges if r[0] == k and r[2] is not None and r[3] > r[2]]
        cuts = sorted({x for r in own for x in r[2:]})
        for s, e in zip(cuts, cuts[1:]):
            ids = sorted({r[1] for r in own if r[2] <= s and r[3] >= e} - {None})
            if any(r[2] <= s and r[3] >= e for r in own):
                want.append((k, s, e, ids))
    assert sorted((r.k, r.start, r.end, r.ids) for r in got.where("k is not null").collect()) == want


def test_ranges_that_explode_are_not_broadcast(spark):
    """Spark takes what is behind an explode for as small as what is before it; the driver would hold it whole."""
    ranges = spark.createDataFrame(made(4), RANGES)
    for got in (intervals.segments(ranges, "k", "id"), intervals.stabbing_join(ranges.selectExpr("k", "start as at"), ranges, "k", "at")):
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_segments_of_many_ranges_at_one_place(spark):
    """Three thousand ranges that begin at one place and end at five hundred; ids repeat."""
    rows = [("a", k % 1000, 7, 8 + k % 500) for k in range(3000)]
    got = {r.start: (r.end, r.ids) for r in intervals.segments(spark.createDataFrame(rows, RANGES), "k", "id", 64).collect()}
    assert got == {s: (s + 1 if s > 7 else 8, sorted({k % 1000 for k in range(3000) if 8 + k % 500 > s})) for s in range(7, 507)}


@pytest.mark.parametrize("levels, longest", [(1, None), (2, None), (3, None), (3, 20_000)])
def test_overlap_join(spark, levels, longest):
    left, right = made(5), made(6, lengths=(0, 1, 7, 60, 900))
    got = intervals.overlap_join(spark.createDataFrame(left, RANGES), spark.createDataFrame(right, RANGES), "k", 2, levels=levels, longest=longest)
    want = [(a[1], b[1], max(a[2], b[2]), min(a[3], b[3])) for a in left for b in right if a[0] == b[0] and a[2] < a[3] and b[2] < b[3] and a[3] > b[2] and a[2] < b[3]]
    assert sorted((r.l_id, r.r_id, r.clip_start, r.clip_end) for r in got.collect()) == sorted(want)


def test_short_ranges_never_meet_in_wide_bins(spark):
    """Forty thousand ranges a side of one key: the pairs that are tested are those of neighbouring bins."""

    def side(shift, long):
        some = spark.range(40_000).selectExpr("'k' AS k", "int(id) AS id", f"id * 200 + {shift} AS start", f"id * 200 + {shift + 90} AS end")
        return some.union(spark.createDataFrame([("k", -1, 0, 10**7)], RANGES)) if long else some

    began = time.perf_counter()
    assert intervals.overlap_join(side(0, False), side(50, False), "k", 100).count() == 40_000
    assert intervals.overlap_join(side(0, True), side(50, False), "k", 100).count() == 80_000
    assert time.perf_counter() - began < 12


@pytest.mark.parametrize("many", [5, 256])
def test_first_enclosing_takes_the_first_by_ordinal(spark, monkeypatch, many):
    monkeypatch.setattr(intervals, "MANY", many)
    rnd = random.Random(8)
    blocks = [("f", rnd.randrange(9), s, s + rnd.randrange(-2, 40)) for s in (rnd.randrange(60) for _ in range(60))]
    blocks += [("g", k, k, k + 1) for k in range(3)]  # a key of few blocks beside one of many
    points = [(k, p) for k in "fg" for p in range(-3, 110)]
    got = intervals.first_enclosing(spark.createDataFrame(points, "k string, line int"), spark.createDataFrame(blocks, "k string, ordinal int, start int, end int"), "k", "line")
    for r in got.collect():
        want = min(((o, s, e) for k, o, s, e in blocks if k == r.k and s <= r.line <= e), default=(None, None, None))
        assert (r.block_start, r.block_end) == want[1:]


def test_exchanged_ends_mark_nothing(spark):
    lines = spark.createDataFrame([("f", n) for n in range(1, 8)], "file string, line_no int")
    blocks = spark.createDataFrame([("f", 5, 3), ("f", 6, 6)], "file string, start int, end int")
    got = {r.line_no: (r.is_current, r.is_previous) for r in annotations.highlight_flags(lines, blocks, blocks.limit(0)).collect()}
    assert got == {n: (n == 6, False) for n in range(1, 8)}


def test_blocks_meet_their_own_lines(spark):
    lines = spark.createDataFrame([("f", n, f"t{n}") for n in range(1, 200)], "file string, line_no int, text string")
    blocks = spark.createDataFrame([("f", 31, 33), ("f", 1, 199), ("f", 9, 8), ("f", 500, 600)], "file string, start int, end int")
    got = {(r.start, r.end): r.content for r in intervals.extract_by_join(blocks, lines).collect()}
    assert got[31, 33] == "31: t31\n32: t32\n33: t33" and got[9, 8] == got[500, 600] == "" and got[1, 199].count("\n") == 198


def test_merge_of_a_row(spark):
    rnd = random.Random(7)
    cases = [[[s, s + rnd.randrange(9)] for s in (rnd.randrange(-5, 60) for _ in range(rnd.randrange(14)))] for _ in range(300)]

    def merged(pairs):
        out = []
        for s, e in sorted(pairs):
            if out and out[-1][1] >= s - 1:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return out

    df = spark.createDataFrame(list(enumerate(cases)), "k int, p array<array<int>>").select("k", intervals.merge_array(F.col("p")).alias("m"))
    assert all(r.m == merged(cases[r.k]) for r in df.collect())
    assert spark.sql("select cast(null as array<array<int>>) p").select(intervals.merge_array(F.col("p")).alias("m")).first().m is None

    def seconds(n):
        began = time.perf_counter()
        many = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.array(x * 3, x * 3 + 1))
        assert spark.range(1).select(F.size(intervals.merge_array(many)).alias("n")).first().n == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(64_000) < 10


def test_segments_shuffle_little(spark):
    """Ranges are shuffled to their bins, long ones to their bins of bins before; all else that moves is a row a bin."""
    got = intervals.segments(spark.createDataFrame(made(4), RANGES), "k", "id", 64)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 7 and "collect_list" not in plan


def test_segments_of_long_ranges_over_empty_bins(spark):
    """A range over 10 ** 15 places: it meets the bins in which ranges end, not those between."""
    rows = [("a", 1, 0, 10**15), ("a", 2, -(10**15), 5), ("a", 3, 10**9, 10**9 + 3), ("a", 1, 4, 10**9 + 1)]
    got = intervals.segments(spark.createDataFrame(rows, RANGES), "k", "id", 10)
    cuts = sorted({x for r in rows for x in r[2:]})
    want = [(s, e, sorted({r[1] for r in rows if r[2] <= s and r[3] >= e})) for s, e in zip(cuts, cuts[1:])]
    assert sorted((r.start, r.end, r.ids) for r in got.collect()) == want


@pytest.mark.parametrize("ids", [1, 7, 1 << 19])
@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_pieces_of_any_batches(monkeypatch, size, ids):
    """Bins that reach over batches, ids that are given back a few at a time, repeated and null ids."""
    monkeypatch.setattr(pieces, "IDS", ids)
    rnd = random.Random(9)
    ranges = [(k, rnd.choice([None, "x", "y", "z", "w"]), a, a + rnd.randrange(1, 30)) for k in "ab" for a in (rnd.randrange(-40, 60) for _ in range(25))]
    rows, want = [], []
    for k in "ab":
        own = [r for r in ranges if r[0] == k]
        cuts = sorted({x for r in own for x in r[2:]})
        want += [(k, s, e, sorted({r[1] for r in own if r[2] <= s and r[3] >= e} - {None})) for s, e in zip(cuts, cuts[1:]) if any(r[2] <= s and r[3] >= e for r in own)]
        places = sorted({x // 8 for x in cuts})
        rows += [(k, b, None, None, None, min((x for x in cuts if x // 8 > b), default=None)) for b in places]
        rows += [(k, b, i, s, e, None) for _, i, s, e in own for b in range(s // 8, e // 8 + 1)]
    rows.sort(key=lambda r: (r[0], r[1], r[2] or "", rnd.random()))
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + size]), types)], names=list("kbisen")) for at in range(0, len(rows), size)]
    got = [tuple(r.values()) for b in pieces.pieces(8, ["k", "start", "end", "ids"])(iter(batches)) for r in b.to_pylist()]
    assert got == want
