"""Candidates for alignment: an inverted index of the words of chunks, and the best chunks of every requirement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of so many letters, digits or underscores are indexed.
WORD = r"(?U)\w{3,}"
#: Words that more than this share of a project's chunks have say nothing about one of them.
COMMON = 0.25


def words(text: Column) -> Column:
    """Distinct words of a text in lower case; none of a null one."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def index(chunks: DataFrame, common: float = COMMON, only: DataFrame | None = None) -> DataFrame:
    """``project, word, file, start_line, weight`` of ``chunks (project, file, start_line, content)``: the postings of every word
    but the common ones; of the words ``only (project, word)``, if given. A word weighs floor(1000 * ln(1 + chunks of the project / chunks
    that have it))."""
    rows = chunks.select("project", "file", "start_line", F.explode(words(F.col("content"))).alias("word"))
    if only is not None:  # before any shuffle: what nobody asks for is most of the words
        rows = rows.join(only.select("project", "word").distinct(), ["project", "word"], "left_semi")
    rows = rows.select("project", "file", "start_line", "word").distinct()
    sizes = chunks.select("project", "file", "start_line").distinct().groupBy("project").agg(F.count("*").alias("n"))
    often = rows.groupBy("project", "word").agg(F.count("*").alias("df")).join(sizes, "project")
    often = often.where(F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n") * common)))
    weight = F.floor(F.log(1 + F.col("n") / F.col("df")) * 1000).cast("long")
    return rows.join(often.select("project", "word", weight.alias("weight")), ["project", "word"])


def candidates(requirements: DataFrame, chunks: DataFrame, k: int = 20, common: float = COMMON) -> DataFrame:
    """``project, requirement_id, file, start_line, score, place``: the ``k`` chunks of its project whose shared words weigh most,
    for every requirement ``(project, requirement_id, requirement)``; those that tie go by file and line.

    Requirements and chunks meet by word only, and a word is in at most the share ``common`` of the chunks, so pairs are
    a fraction of the product; a requirement that shares no such word with any chunk has no candidate.
    """
    asked = requirements.select("project", "requirement_id", F.explode(words(F.col("requirement"))).alias("word")).distinct()
    met = asked.join(index(chunks, common, asked), ["project", "word"])
    scored = met.groupBy("project", "requirement_id", "file", "start_line").agg(F.sum("weight").alias("score"))
    best = Window.partitionBy("project", "requirement_id").orderBy(F.desc("score"), "file", "start_line")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
