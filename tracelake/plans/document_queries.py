"""Queries of highlights, stabbed lines, token counts and edit logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import bpe
from tracelake.operators import edits, intervals

#: Where the public vocabulary lies that ``token_counts_bpe`` counts by; a file that Spark reads.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_counts_bpe(spark, sf_dir):
    """Tokens of every text by a public byte-pair vocabulary."""
    counts = bpe.counter(spark, VOCABULARY)
    return _t(spark, sf_dir, "documents").select("doc_id", bpe.count(counts, F.col("text")).cast("long").alias("n_tokens"))


def _sessions(spark, sf_dir):
    """Half-open ranges of seconds of every user: an hour from each event, some of them empty."""
    start = F.unix_timestamp("ts")
    end = start + F.when(F.col("event_id") % 11 == 0, 0).otherwise(3600 * (1 + F.col("event_id") % 30))
    return _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", start.alias("start"), end.alias("end"))


def highlight_segments(spark, sf_dir):
    """Pieces that the ranges of a user cut one another to, with the ranges on each."""
    got = intervals.segments(_sessions(spark, sf_dir), "user_id", "event_id")
    return got.select("user_id", "start", "end", F.array_join("ids", ",").alias("ids"))


def highlight_segments_one_document(spark, sf_dir):
    """The same with the ranges of all parts in one document."""
    li = _t(spark, sf_dir, "lineitem")
    start = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    spans = li.select(F.lit("d").alias("doc"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), start.alias("start"), (start + F.floor(F.col("l_quantity"))).alias("end"))
    got = intervals.segments(spans, "doc", "id", width=1000)
    return got.select("start", "end", F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"))


def stabbed_lines(spark, sf_dir):
    """Every purchase with the sessions of clicks of its user that hold it."""
    s = _sessions(spark, sf_dir)
    points = s.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("at_id"), F.col("start").alias("at"))
    got = intervals.stabbing_join(points, s.where("event_type = 'click'").drop("event_type"), "user_id", "at")
    return got.select("user_id", "at_id", F.col("r_event_id").alias("session_id"), "r_start", "r_end")


def _log(spark, sf_dir):
    """Edits of the annotations of every user, from all events."""
    kind, n = F.col("event_id") % 8, F.col("event_id")
    verb = F.when(kind == 0, "create").when(kind.isin(1, 2, 3, 4), "add").when(kind == 5, "rename").when(kind == 6, "remove").otherwise(F.when(n % 5 == 0, "delete").otherwise("remove"))
    side = F.when(n % 3 == 0, "codeRanges").otherwise("docRanges")
    name = F.when(n % 7 == 0, "  ").otherwise(F.concat(F.lit("n"), n.cast("string")))
    return _t(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), n.alias("seq"), verb.alias("verb"), side.alias("side"), (n % 4).cast("int").alias("ordinal"), name.alias("name"), n.cast("string").alias("range")
    )


def edit_log(spark, sf_dir):
    """Annotations of customers after a log of edits of users of the same numbers."""
    mine = F.array(F.concat(F.lit("c"), "c_custkey"))
    have = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), mine.alias("docRanges"), F.array().cast("array<string>").alias("codeRanges"))
    got = edits.replay(have, _log(spark, sf_dir))
    return got.select("id", "name", F.array_join("docRanges", ",").alias("doc_ranges"), F.array_join("codeRanges", ",").alias("code_ranges"), "last_seq")


QUERIES = [token_counts_bpe, highlight_segments, highlight_segments_one_document, stabbed_lines, edit_log]

SESSIONS = """
    SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s,
           CAST(floor(epoch(ts)) AS BIGINT) + CASE WHEN event_id % 11 = 0 THEN 0 ELSE 3600 * (1 + event_id % 30) END AS e FROM events"""


def _segments(ranges: str) -> str:
    """Pieces of ranges (k, id, s, e) with their ids."""
    return f"""
        WITH r AS (SELECT * FROM ({ranges}) WHERE e > s),
        c AS (SELECT k, s AS x FROM r UNION SELECT k, e FROM r),
        p AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY x) AS y FROM c)
        SELECT k, x AS start, y AS "end", count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT p.k, x, y, id FROM p JOIN r ON r.k = p.k AND r.s <= x AND r.e >= y) GROUP BY 1, 2, 3"""


ORACLE_SQL = {
    "token_counts_bpe": f"""
        WITH RECURSIVE ranks AS (
            SELECT hex(from_base64(token)) AS h, rank
            FROM read_csv('{VOCABULARY}', delim = ' ', header = false, quote = '', escape = '', columns = {{'token': 'VARCHAR', 'rank': 'BIGINT'}})),
        texts AS (SELECT doc_id, row_number() OVER () AS rid, regexp_replace(coalesce(text, ''), '(\\s)(\\S)', chr(1) || '\\1\\2', 'g') AS t FROM documents),
        words AS (
            SELECT rid, unnest(regexp_extract_all(t, '''(?:[sdmt]|ll|ve|re)| ?\\p{{L}}+| ?\\p{{N}}+| ?[^\\s\\p{{L}}\\p{{N}}\\x01]+|\\s+')) AS w FROM texts),
        per AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
        merging AS (
            SELECT w, list_transform(range(0, len(h), 2), lambda i: h[i + 1:i + 2]) AS l FROM per
            UNION ALL
            SELECT w, l[1:i - 1] || [l[i] || l[i + 1]] || l[i + 2:] FROM (
                SELECT w, l, arg_min(i, rank * 1000000 + i) AS i
                FROM (SELECT w, l, unnest(range(1, len(l))) AS i FROM merging) JOIN ranks ON ranks.h = l[i] || l[i + 1] GROUP BY w, l)),
        n AS (SELECT w, min(len(l)) AS n FROM merging GROUP BY w)
        SELECT doc_id, CAST(coalesce(s, 0) AS BIGINT) AS n_tokens FROM texts LEFT JOIN (SELECT rid, sum(n) AS s FROM words JOIN n USING (w) GROUP BY rid) USING (rid)""",
    "highlight_segments": f"SELECT k AS user_id, start, \"end\", ids FROM ({_segments(f'SELECT user_id AS k, event_id AS id, s, e FROM ({SESSIONS})')})",
    "highlight_segments_one_document": "SELECT start, \"end\", n, ids FROM ("
    + _segments("SELECT 0 AS k, l_orderkey || '-' || l_linenumber AS id, l_orderkey * 8 + l_linenumber AS s, CAST(l_orderkey * 8 + l_linenumber + floor(l_quantity) AS BIGINT) AS e FROM lineitem")
    + ")",
    "stabbed_lines": f"""
        SELECT p.user_id, p.event_id AS at_id, c.event_id AS session_id, c.s AS r_start, c.e AS r_end
        FROM ({SESSIONS}) p JOIN ({SESSIONS}) c ON p.user_id = c.user_id AND p.s BETWEEN c.s AND c.e WHERE p.event_type = 'purchase' AND c.event_type = 'click'""",
    "edit_log": """
        WITH RECURSIVE steps AS (
            SELECT user_id AS id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
                   CASE event_id % 8 WHEN 0 THEN 'create' WHEN 5 THEN 'rename' WHEN 6 THEN 'remove' WHEN 7 THEN CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'remove' END ELSE 'add' END AS verb,
                   event_id % 3 = 0 AS code, event_id % 4 AS o, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'n' || event_id END AS named, CAST(event_id AS VARCHAR) AS r FROM events),
        state AS (
            SELECT coalesce(c_custkey, id) AS id, CAST(0 AS BIGINT) AS k, c_custkey IS NOT NULL AS stands, c_name AS name, CASE WHEN c_custkey IS NULL THEN [] ELSE ['c' || c_custkey] END AS d,
                   CAST([] AS VARCHAR[]) AS c, CAST(NULL AS BIGINT) AS last_seq
            FROM customer FULL JOIN (SELECT DISTINCT id FROM steps) ON id = c_custkey
            UNION ALL
            SELECT id, k, CASE WHEN NOT done THEN stands WHEN verb = 'delete' THEN false ELSE len(d2) + len(c2) > 0 END,
                   CASE WHEN NOT done THEN name WHEN verb = 'create' THEN named WHEN verb = 'rename' THEN named ELSE name END, d2, c2, CASE WHEN done THEN seq ELSE last_seq END
            FROM (
                SELECT *, CASE WHEN NOT done OR verb IN ('rename', 'delete') THEN d WHEN verb = 'create' THEN CASE WHEN code THEN [] ELSE [r] END WHEN code THEN d
                               WHEN verb = 'add' THEN d || [r] ELSE d[1:o] || d[o + 2:] END AS d2,
                       CASE WHEN NOT done OR verb IN ('rename', 'delete') THEN c WHEN verb = 'create' THEN CASE WHEN code THEN [r] ELSE [] END WHEN NOT code THEN c
                            WHEN verb = 'add' THEN c || [r] ELSE c[1:o] || c[o + 2:] END AS c2
                FROM (
                    SELECT s.*, stands, name, d, c, last_seq, CASE verb WHEN 'create' THEN NOT stands WHEN 'rename' THEN stands AND named IS NOT NULL
                           WHEN 'remove' THEN stands AND o < CASE WHEN code THEN len(c) ELSE len(d) END ELSE stands END AS done
                    FROM state t JOIN steps s ON s.id = t.id AND s.k = t.k + 1)))
        SELECT id, name, array_to_string(d, ',') AS doc_ranges, array_to_string(c, ',') AS code_ranges, last_seq FROM state WHERE stands QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1
        AND k = (SELECT max(k) FROM state u WHERE u.id = state.id)""",
}
