"""Stores by buckets, replies that outlive a failed run, uploads by deltas, guards, and candidates for alignment."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from tracelake.operators import align, ingest, retrieve, store
from tracelake.sources import repo
from tracelake.sources.buckets import Buckets
from tracelake.streaming import ingest as streaming

ROWS = "k string, n int, v string"


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    first = spark.createDataFrame([(f"k{i}", 1, "a") for i in range(200)], ROWS)
    table = Buckets(spark, str(tmp_path / "t"), ["k"], first.schema, 8)
    assert table.read().collect() == [] and table.versions() == []
    assert table.upsert(first, ["n"]) == 0
    files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/t/data/**/*.parquet", recursive=True)}
    before = table.manifest()
    assert table.upsert(spark.createDataFrame([("k3", 2, "b"), ("k3", 3, "c"), ("new", 1, "d")], ROWS), ["n"]) == 1
    after = table.manifest()
    moved = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(moved) <= 2 and all(os.stat(f).st_mtime_ns == t for f, t in files.items())
    got = {r.k: (r.n, r.v) for r in table.read().collect()}
    assert len(got) == 201 and got["k3"] == (3, "c") and got["new"] == (1, "d")
    assert {r.k: r.v for r in table.read(0).collect()}["k3"] == "a"  # the version before still reads
    assert table.delete(spark.createDataFrame([("k3",), ("absent",)], "k string")) == 2
    assert table.read().count() == 200 and sum(n for _, n in table.manifest().values()) == 200
    with pytest.raises(ValueError):
        table.read(9)


def test_a_version_that_runs_again_is_the_same(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), ["k"], spark.createDataFrame([], ROWS).schema, 4)
    table.upsert(spark.createDataFrame([("a", 1, "x")], ROWS), ["n"], version=0)
    for _ in range(2):
        table.upsert(spark.createDataFrame([("a", 2, "y"), (None, 1, "z")], ROWS), ["n"], version=1)
        assert sorted(map(repr, table.read().collect())) == sorted(map(repr, spark.createDataFrame([("a", 2, "y"), (None, 1, "z")], ROWS).collect()))
    assert table.versions() == [0, 1]
    table.upsert(spark.createDataFrame([], ROWS), ["n"])  # nothing new: the same folders
    assert table.manifest(2) == table.manifest(1)
    table.delete(spark.createDataFrame([("a",)], "k string"))
    assert [r.k for r in table.read().collect()] == [None]


def test_stream_to_buckets(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "t")
    src.mkdir()
    stream = lambda: streaming.alignment_stream(spark, str(src))
    (src / "1.json").write_text('{"project": "p", "doc": "d", "id": "1", "name": "old"}\n{"project": "p", "doc": "d", "id": "2", "name": "two"}\n')
    streaming.upsert_bucket_batches(stream(), table, str(tmp_path / "c"), 4).awaitTermination(60)
    (src / "2.json").write_text('{"project": "p", "doc": "d", "id": "1", "name": "new"}\n')
    streaming.upsert_bucket_batches(stream(), table, str(tmp_path / "c"), 4).awaitTermination(60)
    got = streaming.read_table(spark, table, stream().schema, 4)
    assert {r["id"]: r["name"] for r in got.collect()} == {"1": "new", "2": "two"}


def test_a_failed_run_goes_on_where_it_ended(spark, tmp_path):
    """Tasks whose client dies ask again in the next run; the replies of all others are there."""
    df = spark.createDataFrame([(k, f"p{k}") for k in range(40)], "k int, prompt string")
    folder, asked = str(tmp_path / "replies"), spark.sparkContext.accumulator(0)

    def client(fails):
        def make():
            def call(prompts):
                if fails and "p7" in prompts:
                    time.sleep(4)  # other tasks end before
                    raise SystemExit("the machine is gone")  # no failed call, a dead task
                asked.add(len(prompts))
                return [p.upper() for p in prompts]

            return call

        return make

    with pytest.raises(Exception):  # noqa: B017
        align.ask(df, "prompt", client(True), store=folder).collect()
    kept = align.stored(spark, folder).count()
    assert 0 < kept < 40
    before = asked.value
    got = {r["k"]: r["reply"] for r in align.ask(df, "prompt", client(False), store=folder).collect()}
    assert got == {k: f"P{k}" for k in range(40)} and asked.value - before == 40 - kept
    before = asked.value
    assert align.ask(df, "prompt", client(False), store=folder).where("reply is null").count() == 0
    assert asked.value == before  # the third run asks nothing


def _project(spark):
    req = spark.createDataFrame([("p", f"r{k}", f"parse header number{k}") for k in range(6)], "project string, requirement_id string, requirement string")
    chunks = spark.createDataFrame([("p", f"f{k}", 1, 2, f"parse line number{k}") for k in range(6)], "project string, file string, start_line int, end_line int, content string")
    lines = spark.createDataFrame([("p", f"f{k}", [f"parse line number{k}", "end"]) for k in range(6)], "project string, file string, lines array<string>")
    return req, chunks, lines


def test_align_by_store_cache_and_candidates(spark, tmp_path):
    req, chunks, lines = _project(spark)
    asked = spark.sparkContext.accumulator(0)

    def client():
        def call(prompts):
            asked.add(len(prompts))
            words = [set(p.split()) for p in prompts]
            return ["[[1, 1]]" if any(sum(w.startswith(f"number{k}") for w in p.split()) == 2 for k in range(6)) else "[]" for p, _ in zip(prompts, words)]

        return call

    whole = align.align(req, chunks, lines, client, store=str(tmp_path / "s"))
    want = sorted((f"r{k}", f"f{k}") for k in range(6))
    assert sorted((r.requirement_id, r.filename) for r in whole.collect()) == want
    assert asked.value == 36
    again = align.align(req, chunks, lines, client, store=str(tmp_path / "s"))
    assert sorted((r.requirement_id, r.filename) for r in again.collect()) == want and asked.value == 36
    best = retrieve.candidates(req, chunks, 2, common=0.5)
    few = align.align(req, chunks, lines, client, candidates=best)
    assert sorted((r.requirement_id, r.filename) for r in few.collect()) == want and asked.value == 42  # one word is shared with one chunk
    both = req.crossJoin(chunks.select("content")).select(align.pair_key(F.col("requirement"), F.col("content")).alias("prompt_key"), F.lit("[[2, 2]]").alias("reply"))
    cached = align.align(req, chunks, lines, client, cache=both)
    assert {r.start for r in cached.collect()} == {2} and asked.value == 42


def test_candidates_keep_what_the_product_finds(spark):
    """Recall of the best twenty against all pairs, by the stub client, for which any long word aligns: 0.97 with 30 % of the pairs."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("project"), F.col("item_id").cast("string").alias("requirement_id"), F.col("text").alias("requirement")
    )
    files = docs.select(F.col("source").alias("project"), F.col("doc_id").alias("file"), F.col("text").alias("content"))
    chunks = files.selectExpr("project", "file", "1 AS start_line", "1000000 AS end_line", "concat('1: ', replace(content, '\\n', ' ')) AS content")
    lines = files.select("project", "file", F.array(F.replace("content", F.lit("\n"), F.lit(" "))).alias("lines"))
    whole = {(r.requirement_id, r.filename) for r in align.align(items, chunks, lines, align.overlap_stub).collect()}
    best = retrieve.candidates(items, chunks)
    found = {(r.requirement_id, r.filename) for r in align.align(items, chunks, lines, align.overlap_stub, candidates=best).collect()}
    assert found <= whole and len(found) >= 0.9 * len(whole)
    assert best.count() < 0.32 * items.join(chunks, "project").count()


def test_uploads_by_deltas(spark, tmp_path):
    schema = "path string, content string, ordinal int"
    manifest, sums = ingest.empty(spark), spark.createDataFrame([], "kind string, n_files long, n_lines long")
    uploads = [
        [("a.py", "x\ny\n", 1), ("b.py", "\n", 2), ("../evil.py", "x", 3)],
        [("a.py", "x\ny\n", 1), ("b.py", "1\n2\n3", 2), ("c.py", "z", 3), ("c.py", "z\nz", 4)],
        [("a.py", "", 1)],
    ]
    counts = []
    for some in uploads:
        rows = ingest.counted(ingest.changed(manifest, spark.createDataFrame(some, schema), "code", "/p"))
        counts.append(rows.count())
        sums = ingest.totals(sums, ingest.delta(manifest, rows))
        manifest = ingest.apply(manifest, rows)
    assert counts == [2, 2, 1]
    assert sorted((r.path, r.n_lines) for r in manifest.collect()) == [("a.py", 0), ("b.py", 3), ("c.py", 2)]
    assert [tuple(r) for r in sums.collect()] == [("code", 3, 5)]
    docs = ingest.changed(manifest, spark.createDataFrame([("x/n.docx", b"no zip", 1), ("y.exe", b"", 2)], "path string, content binary, ordinal int"), "doc", "/p")
    markdown, _ = ingest.convert_new(manifest, docs, str(tmp_path / "d"))
    assert [(r.path, r.markdown, r.error is not None) for r in markdown.collect()] == [("n.docx", None, True)]
    manifest = ingest.apply(manifest, ingest.counted(docs))
    assert ingest.convert_new(manifest, docs, str(tmp_path / "e"))[0].count() == 0  # its content was converted


def test_projects_from_folders_are_guarded(spark, tmp_path):
    with pytest.raises(repo.Refused):
        repo.create_from_folder(spark, "n", str(tmp_path / "absent"), F.lit("2024-01-01 00:00:00"))
    root = tmp_path / "p"
    (root / "code_repo").mkdir(parents=True)
    (root / "code_repo/a.py").write_text("x\n\ny\n")
    with pytest.raises(repo.Refused, match="lacks"):
        repo.create_from_folder(spark, "n", str(root), F.lit("2024-01-01 00:00:00"))
    (root / "doc_repo").mkdir()
    (root / "doc_repo/d.md").write_text("# T\n")
    got = repo.create_from_folder(spark, "n", str(root), F.lit("2024-01-01 00:00:00")).first()
    assert (got.code_scale, got.code_files, got.doc_files) == (2, ["a.py"], ["d.md"])
    assert (root / "metadata.json").exists()
    with pytest.raises(repo.Refused, match="already"):
        repo.create_from_folder(spark, "n", str(root), F.lit("2024-01-01 00:00:00"))


def test_opening_is_guarded(spark):
    have = spark.createDataFrame([("/a",), ("/b",)], "project_location string")
    opened = spark.createDataFrame([("x", "/a", 1), ("y", "/gone", 2), (" ", "/b", 3), (None, "/b", 4), ("z", None, 5)], "name string, path string, last_opened int")
    before = spark.createDataFrame([("old", "/a", 0), ("kept", "/c", 0)], opened.schema)
    assert [tuple(r) for r in store.open_projects(before, have, opened).collect()] == [("x", "/a", 1), ("kept", "/c", 0)]
    assert sorted(r.last_opened for r in store.not_opened(have, opened).collect()) == [2, 3, 4, 5]
