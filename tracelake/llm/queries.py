"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontam, dialogue, exact_dedup, html_text, katz, langid, merkle, mixing, secrets, simhash, spotsigs, toxicity, warc
from tracelake.llm.common import crc_mod, table


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text by the model of those whose crc32(doc_id) modulo 5 is not 1. Null text is empty (end mark only), null
    ids count as empty text in the remainder; repeated rows are scored each; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.score(docs, crc_mod("doc_id", 5) == 1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text; labels of rows whose crc32(doc_id) modulo 3 is 1 are not learned. Null text is empty and scored so;
    of repeated labels the larger counts; with labels of one class, or none, all scores are alike; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", crc_mod("doc_id", 3) == 1)
    model = toxicity.train(docs.where("not held_out"), toxicity.learnable(table(spark, sf_dir, "labels")))
    found = toxicity.score(docs, model)
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; null counts as empty. The largest id stays, a null id loses, of rows that repeat it one stays."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest").drop("rid")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every text. Null and wordless texts have fingerprint zero; a class of null ids only has none; an
    empty table gives no rows."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every text; null text is empty and has none. A null owner or repository is one of its own; repeated rows are rows
    of their own; an empty table gives no rows."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind < 3)

    def n(kind: int):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s.live)).cast("long").alias("n_live"),
    )


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from rows whose crc32(doc_id) modulo 4 is not 2. ``und`` and score zero for null, empty and
    letterless texts, and for all where nothing can be learned. Of languages that tie the first by code point is taken."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", crc_mod("doc_id", 4) == 2)
    trees = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), trees).select("doc_id", "held_out", "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every text. Null has no words; items without words or id are none; rows that repeat an item id are one item."""
    found = decontam.occurrences(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive, read back. Null html is empty; the smallest id answers for equal payloads, a null id
    loses, and of rows that tie one is the response; an empty table writes no file and gives no rows."""
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(manifest, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. Null text has no words; a null source is one of its own, last in order; documents
    and sources without words take none."""
    return mixing.mix_taken(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null html is empty. Repeated rows are rows of their own; an empty table gives none."""
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after planted damage. A null conversation is one too; null roles and texts
    are one space; turns of one number go by role, then by the hash of their text; an empty table gives no rows."""
    found = dialogue.repair(dialogue.damaged(table(spark, sf_dir, "conversations")))
    return found.withColumnRenamed("conv", "conv_id")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents in a tree for every language. Where 3 divides the crc32 of the id, the text is met in lower case.
    A null language is a tree of its own; a null id stands first and is met as it was, as null and empty texts are."""
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.verify(docs, found=F.when(hit, merkle.leaf_hash("doc_id", "source", "lang", "n_chars", lower)))


def op13_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike it is to that and to the next one. Null text is empty; texts
    without words are alike; a null id stands first, rows of one id go by the hash of their text; an empty table gives no rows."""
    return spotsigs.with_next(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_katz,
        op2_toxicity,
        op3_exact_dedup,
        op4_simhash,
        op5_secret_scan,
        op6_langid,
        op7_decontamination,
        op8_warc,
        op9_mixing,
        op10_html_text,
        op11_conversation_repair,
        op12_merkle,
        op13_spotsigs,
    )
}

#: crc32 of the ASCII text ``key`` of the rows that are put in, as column ``crc``.
CRC_SQL = """
    crc_bits AS (SELECT i, list_reduce([i] || [CAST(x AS UBIGINT) FOR x IN range(8)],
                        lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v
                 FROM (SELECT unnest(range(256))::UBIGINT AS i)),
    crc_table AS (SELECT list(v ORDER BY i) AS tb FROM crc_bits)"""
CRC_OF = """xor(list_reduce([4294967295::UBIGINT] || [CAST(ascii(c) AS UBIGINT) FOR c IN string_split({0}, '')],
                        lambda a, b: xor(a >> 8, tb[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT)"""
LEAF_SQL = "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

ORACLE_SQL = {
    "op3_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op7_decontamination": r"""
        WITH dw AS (
            SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        bw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE item_id IS NOT NULL),
        pat AS (
            SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
            FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
                  FROM (SELECT item_id, w, least(13, len(w)) AS m FROM bw WHERE len(w) > 0))),
        occ AS (
            SELECT rid, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
            FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i
                  FROM dw, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m)),
        hit AS (SELECT rid, i, occ.m, item_id FROM occ JOIN pat ON occ.m = pat.m AND occ.g = pat.g),
        nh AS (
            SELECT rid, count(*) AS n_hit
            FROM (SELECT DISTINCT rid, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT rid, i, m FROM hit)) GROUP BY rid),
        ni AS (
            SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN nh USING (rid) LEFT JOIN ni USING (rid)
    """,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM p LEFT JOIN g USING (payload_digest)
    """,
    "op11_conversation_repair": f"""
        WITH RECURSIVE {CRC_SQL},
        damage AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {CRC_OF.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
            FROM conversations, crc_table),
        rows AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
            FROM damage),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM rows),
        turns AS (
            SELECT *, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair,
                   CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault
            FROM placed),
        ins(a, b, n) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
        edit(a, b, letter, initial, cost) AS (
            VALUES (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0),
                   (0, 2, 'R', NULL, 1), (1, 2, 'R', NULL, 1), (3, 2, 'R', NULL, 1), (2, 3, 'R', NULL, 1),
                   (0, 0, 'D', NULL, 2), (1, 1, 'D', NULL, 2), (2, 2, 'D', NULL, 2), (3, 3, 'D', NULL, 2)),
        ways AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, pos, state, w.c AS cost, w.a AS audit FROM (
                SELECT w.conv_id, t.pos, e.b AS state,
                       min({{'c': CAST(w.cost + 5 * n + e.cost + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS BIGINT), 'a': audit || repeat('I', n) || letter}}) AS w
                FROM ways w JOIN ins ON ins.a = w.state JOIN edit e ON e.a = ins.b
                JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1
                WHERE letter = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR t.initial = e.initial))
                GROUP BY 1, 2, 3)),
        sums AS (
            SELECT c.conv_id, count(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
                   count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY 1),
        best AS (
            SELECT s.conv_id, min({{'c': cost + 5 * ins.n, 'a': audit || repeat('I', ins.n)}}) AS w
            FROM ways JOIN ins ON ins.a = state AND ins.b IN (0, 3) JOIN sums s ON s.conv_id IS NOT DISTINCT FROM ways.conv_id AND s.n = pos GROUP BY 1),
        letters AS (SELECT conv_id, unnest(string_split(w.a, '')) AS letter, unnest(range(1, length(w.a) + 1)) AS i FROM best WHERE w.a <> ''),
        counted AS (
            SELECT *, count_if(letter <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS pos, count_if(letter <> 'D') OVER (PARTITION BY conv_id ORDER BY i) AS e FROM letters),
        kept AS (
            SELECT c.*, role, text, max(CASE WHEN e = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id) AS led
            FROM counted c LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.pos = c.pos AND letter <> 'I' WHERE letter <> 'D'),
        texts AS (
            SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (e - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
                                       CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS repaired
            FROM kept GROUP BY 1)
        SELECT s.conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated,
               CAST(illegal AS BIGINT) AS illegal, CAST(w.c AS BIGINT) AS cost, w.a AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM sums s JOIN best b ON b.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM s.conv_id
    """,
    "op12_merkle": f"""
        WITH RECURSIVE {CRC_SQL},
        docs AS (
            SELECT doc_id, coalesce('=' || lang, '') AS tree, {LEAF_SQL.format("text")} AS leaf,
                   {LEAF_SQL.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed,
                   {CRC_OF.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 AS hit
            FROM documents, crc_table),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM docs),
        nodes AS (
            SELECT tree, 0 AS level, idx, n, leaf AS h FROM leaves
            UNION ALL
            SELECT tree, level + 1, idx // 8, CAST((max(n) + 7) // 8 AS BIGINT), sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 8),
        subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops AS (
            SELECT 0 AS level, idx, n, subroot AS h FROM subroots
            UNION ALL
            SELECT level + 1, idx // 8, CAST((max(n) + 7) // 8 AS BIGINT), sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 8),
        low AS (
            SELECT l.tree, l.idx AS leaf_idx, s.level, string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < l.idx // pow(8, s.level)::BIGINT) AS lo,
                   string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > l.idx // pow(8, s.level)::BIGINT) AS hi
            FROM leaves l JOIN nodes s ON s.tree = l.tree AND s.n > 1 AND s.idx // 8 = l.idx // pow(8, s.level + 1)::BIGINT GROUP BY 1, 2, 3),
        high AS (
            SELECT l.tree, s.level + 100 AS level, string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < l.idx // pow(8, s.level)::BIGINT) AS lo,
                   string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > l.idx // pow(8, s.level)::BIGINT) AS hi
            FROM subroots l JOIN tops s ON s.n > 1 AND s.idx // 8 = l.idx // pow(8, s.level + 1)::BIGINT GROUP BY 1, 2),
        steps AS (
            SELECT tree, leaf_idx, coalesce(lo, '') AS lo, coalesce(hi, '') AS hi, row_number() OVER (PARTITION BY tree, leaf_idx ORDER BY level) AS k FROM (
                SELECT * FROM low UNION ALL SELECT l.tree, l.idx, level, lo, hi FROM leaves l JOIN high USING (tree))),
        folded AS (
            SELECT tree, idx, CAST(0 AS BIGINT) AS k, CASE WHEN hit THEN changed ELSE leaf END AS h FROM leaves
            UNION ALL
            SELECT f.tree, f.idx, s.k, sha256(s.lo || f.h || s.hi) FROM folded f JOIN steps s ON s.tree = f.tree AND s.leaf_idx = f.idx AND s.k = f.k + 1),
        proofs AS (SELECT tree, leaf_idx, string_agg(lo || hi, '' ORDER BY k) AS p, max(k) AS k FROM steps GROUP BY 1, 2)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
        FROM leaves l JOIN subroots s USING (tree) JOIN (SELECT h AS root FROM tops WHERE n = 1) ON true
        LEFT JOIN proofs p ON p.tree = l.tree AND p.leaf_idx = l.idx JOIN folded f ON f.tree = l.tree AND f.idx = l.idx AND f.k = coalesce(p.k, 0)
    """,
}
