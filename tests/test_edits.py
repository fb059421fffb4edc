"""Edit logs against a plain fold, exports read back, and verbs of issues."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import edits, store
from tracelake.sources import json_files

ANNOTATIONS = "id long, name string, docRanges array<struct<s: int>>, codeRanges array<struct<s: int>>"
LOG = "id long, seq long, verb string, side string, ordinal int, name string, range struct<s: int>"


def folded(have, log):
    records = {i: [n, [r[0] for r in d or []], [r[0] for r in c or []], None] for i, n, d, c in have}
    for i, seq, verb, side, at, name, item in log:
        r = records.get(i)
        ranges = None if r is None else r[1] if side == "docRanges" else r[2] if side == "codeRanges" else None
        if verb == "create" and r is None:
            records[i] = [name if (name or "").strip() else None, [item[0]] if side == "docRanges" else [], [item[0]] if side == "codeRanges" else [], seq]
        elif verb == "add" and ranges is not None:
            ranges.append(item[0])
            r[3] = seq
        elif verb == "rename" and r is not None and (name or "").strip():
            r[0], r[3] = name, seq
        elif verb == "remove" and ranges is not None and at is not None and 0 <= at < len(ranges):
            ranges.pop(at)
            r[3] = seq
            if not r[1] and not r[2]:
                del records[i]
        elif verb == "delete" and r is not None:
            del records[i]
    return records


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay(spark, seed):
    rnd = random.Random(seed)
    ids = [None, 1, 2, 3, 4, 5, 6, 7]
    have = [(i, f"n{i}", [(1,), (2,)], None if i == 2 else []) for i in (None, 1, 2, 3)]
    log = [
        (rnd.choice(ids), k, rnd.choice([*edits.VERBS, "add", "add", "paint", None]), rnd.choice(["docRanges", "codeRanges", "codeRanges", "x", None]), rnd.choice([0, 1, 2, -1, None]), rnd.choice(["a", "b", " ", None]), (k,))
        for k in range(400)
    ]
    want = folded(have, log)
    rnd.shuffle(log)
    got = edits.replay(spark.createDataFrame(have, ANNOTATIONS), spark.createDataFrame(log, LOG)).collect()
    assert len(got) == len(want)
    assert {r.id: [r.name, [x.s for x in r.docRanges], [x.s for x in r.codeRanges], r.last_seq] for r in got} == want


def test_one_record_with_a_long_log(spark):
    """Two hundred thousand edits of one record: its log is streamed, never held."""
    log = spark.range(200_000).selectExpr("1L AS id", "id AS seq", "CASE WHEN id = 0 THEN 'create' WHEN id % 2 = 1 THEN 'add' ELSE 'remove' END AS verb", "'docRanges' AS side", "0 AS ordinal", "'n' AS name", "named_struct('s', int(id)) AS range")
    got = edits.replay(spark.createDataFrame([], ANNOTATIONS), log).collect()
    assert len(got) == 1 and [x.s for x in got[0].docRanges] == [199_997, 199_999] and got[0].last_seq == 199_999
    assert edits.replay(spark.createDataFrame([], ANNOTATIONS), log.limit(0)).collect() == []


def test_ignored_issues_go_and_confirmed_ones_stay(spark):
    issues = spark.createDataFrame([("a", 1, "new"), ("a", 2, "new"), ("b", 1, "new")], "id string, createdDate int, status string")
    ids = spark.createDataFrame([("a",), ("z",)], "id string")
    assert sorted(map(tuple, store.ignore(issues, ids).collect())) == [("a", 2, "new"), ("b", 1, "new")]
    assert sorted(map(tuple, store.confirm(issues, ids).collect())) == [("a", 1, "confirmed"), ("a", 2, "new"), ("b", 1, "new")]


def test_latest_of_equal_orders_is_one_and_the_same(spark):
    rows = [("k", 1, f"v{n}") for n in range(20)]
    picked = set()
    for shift in range(3):
        df = spark.createDataFrame(rows[shift * 5 :] + rows[: shift * 5], "k string, n int, v string").repartition(3 + shift)
        picked.add(store.latest(df, ["k"], ["n"]).first().v)
    assert len(picked) == 1


def test_exports_read_back(spark, tmp_path):
    """Points and annotations written as JSON and read by the imports."""
    notes = spark.createDataFrame([("a", "n1", [("d", 1, 2, "x")], [])], "id string, name string, docRanges array<struct<documentId: string, start: int, end: int, content: string>>, codeRanges array<string>")
    text = json_files.export(notes).first().json
    assert text == '{"id":"a","name":"n1","docRanges":[{"documentId":"d","start":1,"end":2,"content":"x"}],"codeRanges":[]}'
    whole = notes.groupBy().agg(F.collect_list(F.struct("id", "name")).alias("annotations")).select("annotations", F.array().cast("array<struct<id: string, name: string, localPath: string>>").alias("docFiles"))
    whole = json_files.export(whole.withColumn("codeFiles", F.col("docFiles")), "content").withColumn("path", F.lit("p"))
    item = "array<struct<id: string, name: string, localPath: string>>"
    got = store.valid_annotations(whole, f"annotations array<struct<id: string, name: string>>, docFiles {item}, codeFiles {item}").first()
    assert [tuple(x) for x in got.annotations] == [("a", "n1")]
    points = spark.createDataFrame([([("p1", "t")],)], "requirementPoints array<struct<id: string, text: string>>")
    made = json_files.export(points, "content").withColumn("path", F.lit("p"))
    got = store.valid_requirement_points(made, "requirementPoints array<struct<id: string, text: string>>").first()
    assert (got.id, got.text) == ("p1", "t")
