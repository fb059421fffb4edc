"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every whole text is scanned for the base kinds and for bare tokens of 20 or more characters, at least four digits
and four letters among them, both in one of their parts, so that paths and hyphenated words are none. All candidate
values are hashed and counted over the corpus by distinct owners, repositories and texts. A value of many owners,
repositories or texts is a copied example; one that few carry looks live. Bare tokens have no context of their own, so
only the live-looking ones become spans (kind ``owned``); base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import materialise, text_of, with_row_id

#: The base kinds, in order.
KINDS = ["assign", "access", "hex", "owned"]
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    # Runs are greedy, so a minimum in the pattern drops just the matches that the length rule drops.
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "owned": r"[A-Za-z0-9+/_-]{20,}={0,2}",
}
#: A part of a bare token that mixes digits and letters.
MIXED = r"(?:^|[+/_-])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{5,}"
ASSIGN_VALUE = 12
#: Sums of lengths are kept for so many matches and for so many of these, so positions stay cheap with very many matches.
RUN = 256


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def _run_sums(of: str) -> Column:
    """Sums of every ``RUN`` elements of an array; null for none."""
    last = F.floor((F.size(of) - 1) / RUN).cast("int")
    return F.when(F.size(of) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: _sum(F.slice(of, b * RUN + 1, F.lit(RUN)))))


def _with_spans(df: DataFrame, kind: str, text: str) -> DataFrame:
    """Adds array column ``kind`` of (kind, start, end, value): all matches, by code points.

    The pieces between the matches and the matches give the positions: a match starts after all of both before it.
    """
    pattern = F.lit(PATTERNS[kind])
    df = df.withColumn("__m", F.regexp_extract_all(text, pattern, F.lit(0)))
    df = df.withColumn(
        "__gap",
        F.when(F.size("__m") > 0, F.transform(F.split(F.col(text), PATTERNS[kind], -1), F.length)),
    )
    df = df.withColumn("__len", F.zip_with(F.slice("__gap", F.lit(1), F.size("__m")), "__m", lambda g, m: g + F.length(m)))
    df = df.withColumn("__run", _run_sums("__len"))
    df = df.withColumn("__top", _run_sums("__run"))

    def span(m: Column, i: Column) -> Column:
        run, top = (F.floor(i / n).cast("int") for n in (RUN, RUN * RUN))
        before = _sum(F.slice("__top", F.lit(1), top)) + _sum(F.slice("__run", top * RUN + 1, run - top * RUN))
        before += _sum(F.slice("__len", run * RUN + 1, i - run * RUN))
        start = before + F.element_at("__gap", i + 1)
        value = F.regexp_extract(m, ASSIGN, 2) if kind == "assign" else m
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), value.alias("value")
        )

    return df.withColumn(kind, F.transform("__m", span)).drop("__m", "__gap", "__len", "__run", "__top")


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """``rid, id, owner, repo, words (hash of the text), spans`` of every row; written once, so the texts are scanned once."""
    df = docs.select(
        F.col(id_col).alias("id"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), text_of(text_col).alias("text")
    )
    for kind in KINDS:
        df = _with_spans(df, kind, "text")
    df = df.withColumn("base", F.concat(F.filter("assign", lambda s: F.length(s.value) >= ASSIGN_VALUE), "access", "hex"))

    def bare(s: Column) -> Column:
        return s.value.rlike("^(?:[^0-9]*[0-9]){4}") & s.value.rlike("^(?:[^A-Za-z]*[A-Za-z]){4}") & s.value.rlike(MIXED)

    df = df.withColumn("owned", _apart(F.filter("owned", bare), F.col("base")))
    df = df.withColumn("spans", F.array_sort(F.concat("base", "owned"), _by_start))
    return materialise(with_row_id(df.select("id", "owner", "repo", F.xxhash64("text").alias("words"), "spans")), "secrets")


def _apart(spans: Column, base: Column) -> Column:
    """Those of ``spans``, which are in order and apart from one another, that overlap none of ``base``, by two sorts.

    Base spans that begin before a span ends, less those that end before it begins, are those that overlap it. In a sorted array of
    such places the j-th span stands behind j others and as many base spans as its place tells.
    """

    def before(own: str, other: str, own_first: int) -> Column:
        mine = F.transform(spans, lambda s: F.struct(s[own].alias("at"), F.lit(1 - own_first).alias("side"), F.lit(True).alias("own")))
        theirs = F.transform(base, lambda b: F.struct(b[other].alias("at"), F.lit(own_first).alias("side"), F.lit(False).alias("own")))
        places = F.transform(F.array_sort(F.concat(mine, theirs)), lambda x, i: F.struct(x["own"].alias("own"), i.alias("i")))
        return F.transform(F.filter(places, lambda x: x["own"]), lambda x, j: x["i"] - j)

    begun, over = before("end", "start", 1), before("start", "end", 0)
    zipped = F.arrays_zip(spans.alias("s"), begun.alias("begun"), over.alias("over"))
    return F.transform(F.filter(zipped, lambda x: x["begun"] == x["over"]), lambda x: x["s"])


def _by_start(a: Column, b: Column) -> Column:
    x, y = F.struct(a.start, a.kind), F.struct(b.start, b.kind)
    return F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(F.lit(0))


def ownership(found: DataFrame) -> DataFrame:
    """``digest, n_rows, n_texts, n_repos, n_owners`` of every candidate value. A repository belongs to its owner, a text
    to its repository.

    Counted from the finest key up, each step combined before its shuffle: a value in every row is no hot key.
    """
    values = found.select("owner", "repo", "words", F.explode("spans").alias("s")).select(
        "owner", "repo", "words", F.sha2(F.col("s.value"), 256).alias("digest")
    )
    texts = values.groupBy("digest", "owner", "repo", "words").agg(F.count("*").alias("n"))
    repos = texts.groupBy("digest", "owner", "repo").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    owners = repos.groupBy("digest", "owner").agg(F.count("*").alias("repos"), F.sum("texts").alias("texts"), F.sum("n").alias("n"))
    return owners.groupBy("digest").agg(
        F.sum("n").alias("n_rows"), F.sum("texts").alias("n_texts"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners")
    )


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "lang",
    few_owners: int = 2,
    few_repos: int = 3,
    few_texts: int = 50,
) -> DataFrame:
    """One row per input row: ``rid, id_col, spans`` with spans (kind, start, end, value, n_owners, n_repos, n_texts, live).

    A value is live-looking if at most ``few_owners`` owners, ``few_repos`` repositories and ``few_texts`` different texts
    of theirs have it; copies of one text in a repository count once.
    Null text counts as empty; a null owner or repository is one of its own. Repeated rows are rows of their own,
    of one owner. An empty table gives no rows; extra columns are ignored.
    """
    found = candidates(docs, id_col, text_col, owner_col, repo_col)
    each = found.select("rid", F.explode("spans").alias("s")).withColumn("digest", F.sha2(F.col("s.value"), 256))
    judged = each.join(ownership(found), "digest").withColumn(
        "live", (F.col("n_owners") <= few_owners) & (F.col("n_repos") <= few_repos) & (F.col("n_texts") <= few_texts)
    )
    spans = (
        judged.where((F.col("s.kind") < 3) | F.col("live"))
        .groupBy("rid")
        .agg(F.collect_list(F.struct("s.start", "s.kind", "s.end", "s.value", "n_owners", "n_repos", "n_texts", "live")).alias("spans"))
    )
    out = found.select("rid", "id").join(spans, "rid", "left")
    return out.select(
        "rid", F.col("id").alias(id_col), F.coalesce(F.array_sort("spans"), F.expr("array()")).alias("spans")
    )


def span_text(spans: Column | str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end)), ","
    )
