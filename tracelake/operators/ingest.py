"""Uploads to a project, counted and converted by what changed: a manifest of files by content hash is the state.

``path, kind, sha256, n_lines`` of every file. An upload looks at its own files only: those whose hash their path has already are
left alone, the others are counted, and documents whose content was never converted are converted. Totals move by what was
counted anew less what it replaces, so no upload reads the files that stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions import text as T
from tracelake.operators import annotations
from tracelake.sources import docx

MANIFEST = "path string, kind string, sha256 string, n_lines long"


def empty(spark: SparkSession) -> DataFrame:
    """The manifest of a project without files."""
    return spark.createDataFrame([], MANIFEST)


def changed(manifest: DataFrame, incoming: DataFrame, kind: str, root: str) -> DataFrame:
    """``path, kind, sha256, content`` of the files of an upload that are new or new in content, by the rules of
    ``annotations.upload``: other kinds and paths that leave the root are refused, of one path the last file counts."""
    none = manifest.select("path").limit(0).withColumn("content", F.lit(None).cast(incoming.schema["content"].dataType))
    files = annotations.upload(none, incoming, kind, root).withColumns({"kind": F.lit(kind), "sha256": F.sha2(F.col("content").cast("binary"), 256)})
    known = manifest.select(F.col("path").alias("p"), F.col("kind").alias("k"), F.col("sha256").alias("h"))
    same = (F.col("path") == F.col("p")) & (F.col("kind") == F.col("k")) & (F.col("sha256") == F.col("h"))
    return files.join(known, same, "left_anti").select("path", "kind", "sha256", "content")


def counted(files: DataFrame) -> DataFrame:
    """Rows of a manifest for changed files; only code has lines, and what is no UTF-8 has none."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    n = F.when(F.col("kind") == "code", F.coalesce(T.nonblank_count(text), F.lit(0))).otherwise(0)
    return files.select("path", "kind", "sha256", n.cast("long").alias("n_lines"))


def delta(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """``kind, n_files, n_lines``: by how much the rows of an upload change the totals of their kind."""
    old = rows.select("path", "kind").join(manifest, ["path", "kind"]).select("kind", F.lit(-1).alias("f"), (-F.col("n_lines")).alias("l"))
    both = rows.select("kind", F.lit(1).alias("f"), F.col("n_lines").alias("l")).unionByName(old)
    return both.groupBy("kind").agg(F.sum("f").cast("long").alias("n_files"), F.sum("l").cast("long").alias("n_lines"))


def totals(before: DataFrame, change: DataFrame) -> DataFrame:
    """Totals ``(kind, n_files, n_lines)`` after a ``delta``."""
    return before.unionByName(change).groupBy("kind").agg(F.sum("n_files").alias("n_files"), F.sum("n_lines").alias("n_lines"))


def apply(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """The manifest after an upload."""
    last = Window.partitionBy("path", "kind").orderBy(F.desc("side"))
    both = manifest.withColumn("side", F.lit(0)).unionByName(rows.withColumn("side", F.lit(1)))
    return both.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "side")


def convert_new(manifest: DataFrame, files: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Markdown and media, written below a folder, of the Word documents of an upload whose content the manifest does not have."""
    word = files.where((F.col("kind") == "doc") & F.lower("path").endswith(".docx"))
    return docx.convert(docx.pending(word, manifest.select("sha256").distinct()), folder)
