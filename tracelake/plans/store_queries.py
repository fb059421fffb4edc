"""Queries of stores by buckets, uploads counted by what changed, guarded opening of projects, and candidates for alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tracelake.operators import ingest, retrieve, store
from tracelake.sources import scratch
from tracelake.sources.buckets import Buckets


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed_upserts(spark, sf_dir):
    """The last event of every user and type, by three upserts and a delete of a table kept by buckets."""
    ev = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    table = Buckets(spark, scratch.folder(spark, "records"), ["user_id", "event_type"], ev.schema, 16)
    for k in range(3):
        table.upsert(ev.where(F.col("event_id") % 3 == k), ["event_id"])
    table.delete(ev.where("event_type = 'error' or user_id % 10 = 7").select("user_id", "event_type"))
    return table.read()


def _uploads(spark, sf_dir):
    """Three uploads of pages as code: a third each of the pages by id, and in the later two every fifth of the one before again,
    half of these with other content."""
    pages = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("src/p"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("content"), F.col("page_id").alias("ordinal"))
    new = [pages.where(F.col("page_id") % 3 == k) for k in range(3)]
    again = F.when(F.col("page_id") % 2 == 0, F.concat("content", F.lit("\nmore"))).otherwise(F.col("content"))
    for k in (1, 2):
        new[k] = new[k].unionByName(pages.where((F.col("page_id") % 3 == k - 1) & (F.col("page_id") % 5 == 0)).withColumn("content", again))
    return [n.select("path", "content", "ordinal") for n in new]


def incremental_totals(spark, sf_dir):
    """Totals after each of three uploads, kept up by deltas, and how many files each upload had to count."""
    folder = scratch.folder(spark, "manifest")
    manifest, sums, out = ingest.empty(spark), spark.createDataFrame([], "kind string, n_files long, n_lines long"), []
    for k, incoming in enumerate(_uploads(spark, sf_dir)):
        rows = ingest.counted(ingest.changed(manifest, incoming, "code", "/p/code_repo"))
        rows.write.mode("overwrite").parquet(f"{folder}/rows-{k}")  # counted once
        rows = spark.read.schema(ingest.MANIFEST).parquet(f"{folder}/rows-{k}")
        sums = ingest.totals(sums, ingest.delta(manifest, rows))
        out.append(sums.select(F.lit(k).alias("upload"), "n_files", "n_lines").withColumn("n_counted", F.lit(rows.count()).cast("long")))
        ingest.apply(manifest, rows).write.mode("overwrite").parquet(f"{folder}/manifest-{k}")
        manifest = spark.read.schema(ingest.MANIFEST).parquet(f"{folder}/manifest-{k}")
    return reduce(lambda a, b: a.unionByName(b), out)


def guarded_history(spark, sf_dir):
    """Projects that suppliers open: those that no longer are where they were, and those without a name, are refused."""
    have = _t(spark, sf_dir, "nation").select(F.concat(F.lit("/p/"), "n_nationkey").alias("project_location"))
    ev = _t(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 9 == 0, F.lit(" ")).otherwise(F.concat(F.lit("n"), "event_id"))
    opened = ev.select(name.alias("name"), F.concat(F.lit("/p/"), F.col("user_id") % 40).alias("path"), F.col("ts").alias("last_opened"))
    return store.open_projects(opened.limit(0), have, opened).select("path", "last_opened")


def refused_openings(spark, sf_dir):
    have = _t(spark, sf_dir, "nation").select(F.concat(F.lit("/p/"), "n_nationkey").alias("project_location"))
    name = F.when(F.col("event_id") % 9 == 0, F.lit(" ")).otherwise(F.concat(F.lit("n"), "event_id"))
    opened = _t(spark, sf_dir, "events").select("event_id", name.alias("name"), F.concat(F.lit("/p/"), F.col("user_id") % 40).alias("path"))
    return store.not_opened(have, opened).select("event_id", "name", "path")


def candidate_chunks(spark, sf_dir):
    """The five documents of its source that share the weightiest words with each benchmark item."""
    items = _t(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), F.col("item_id") % 20).alias("project"), F.col("item_id").alias("requirement_id"), F.col("text").alias("requirement"))
    chunks = _t(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("doc_id").alias("file"), F.lit(1).alias("start_line"), F.col("text").alias("content"))
    got = retrieve.candidates(items, chunks, 5)
    return got.select("requirement_id", F.col("file").alias("doc_id"), "score", F.col("place").cast("long").alias("place"))


QUERIES = [bucketed_upserts, incremental_totals, guarded_history, refused_openings, candidate_chunks]

OPENED = "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE 'n' || event_id END AS name, user_id % 40 AS k, '/p/' || (user_id % 40) AS path, ts FROM events"
ORACLE_SQL = {
    "bucketed_upserts": """
        SELECT user_id, event_type, event_id, value FROM events WHERE event_type <> 'error' AND user_id % 10 <> 7
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 DESC, event_id DESC) = 1""",
    "incremental_totals": """
        WITH p AS (SELECT page_id, page_id % 3 AS third, html FROM pages),
        files AS (
            SELECT k, page_id, CASE WHEN k > third AND page_id % 5 = 0 AND page_id % 2 = 0 AND third < 2 THEN html || chr(10) || 'more' ELSE html END AS html, third
            FROM p, (SELECT unnest([0, 1, 2]) AS k) WHERE third <= k),
        n AS (SELECT *, len(list_filter(string_split(replace(replace(coalesce(html, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_matches(x, '\\S'))) AS lines FROM files)
        SELECT k AS upload, count(*) AS n_files, CAST(sum(lines) AS BIGINT) AS n_lines,
               CAST(count_if(third = k) + count_if(third = k - 1 AND page_id % 5 = 0 AND page_id % 2 = 0) AS BIGINT) AS n_counted FROM n GROUP BY k""",
    "guarded_history": f"""
        SELECT path, max(ts) AS last_opened FROM ({OPENED}) WHERE name <> ' ' AND k IN (SELECT n_nationkey FROM nation) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
    "refused_openings": f"SELECT event_id, name, path FROM ({OPENED}) WHERE name = ' ' OR k NOT IN (SELECT n_nationkey FROM nation)",
    "candidate_chunks": """
        WITH c AS (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]{3,}'))) AS word FROM documents),
        s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
        d AS (SELECT source, word, count(*) AS df FROM c GROUP BY 1, 2),
        w AS (SELECT source, word, CAST(floor(ln(1 + n / df) * 1000) AS BIGINT) AS weight FROM d JOIN s USING (source) WHERE df <= greatest(1, floor(n * 0.25))),
        i AS (SELECT 'src' || (item_id % 20) AS source, item_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]{3,}'))) AS word FROM benchmark)
        SELECT item_id AS requirement_id, doc_id, CAST(sum(weight) AS BIGINT) AS score, row_number() OVER (PARTITION BY item_id ORDER BY sum(weight) DESC, doc_id) AS place
        FROM i JOIN c USING (source, word) JOIN w USING (source, word) GROUP BY 1, 2 QUALIFY place <= 5""",
}
