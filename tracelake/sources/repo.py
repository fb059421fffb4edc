"""Repositories of code and documents as tables of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import text as T

#: Suffixes by kind of file, and by kind of upload.
SUFFIXES = {"code": "py java cpp js c h".split(), "doc": "docx md".split()}
UPLOADS = {"doc": "doc docx md txt".split(), "code": "c cpp h js py java html css".split()}


def relative_to(path: Column, root: str) -> Column:
    """Path below a root, without scheme."""
    base = root.rstrip("/").removeprefix("file://")
    return F.regexp_replace(F.regexp_replace(path, "^file:/*(?=/)", ""), rf"^\Q{base}\E/", "")


def has_suffix(path: Column, kind: str) -> Column:
    """Case-sensitive suffix of a kind; any other kind takes all."""
    known = SUFFIXES.get(kind)
    return path.rlike(rf"\.({'|'.join(known)})$") if known else F.lit(True)


def uploadable(name: Column, kind: str) -> Column:
    return T.extension(name).isin(*UPLOADS[kind])


def upload_candidates(files: DataFrame, kind: str, name_col: str = "path") -> DataFrame:
    """Files whose lower-cased extension may be uploaded as code or as documents."""
    return files.where(uploadable(F.col(name_col), kind))


def scan(spark: SparkSession, root: str, kind: str = "code") -> DataFrame:
    """``path, content (BINARY), length, modificationTime`` of the files of a kind below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if kind in SUFFIXES:
        files = files.option("pathGlobFilter", "*.{" + ",".join(SUFFIXES[kind]) + "}")
    return files.load(root).withColumn("path", relative_to(F.col("path"), root))


def _decoded(fallback: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for data in b.column(1):
                try:
                    texts.append(None if data.as_py() is None else data.as_py().decode(fallback))
                except UnicodeDecodeError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["path", "content"])

    return run


def read_text(files: DataFrame, fallback: str | None = None) -> DataFrame:
    """``path, content`` as text with Unix line ends: UTF-8, else in the ``fallback`` encoding (such as GBK), else null."""
    valid = F.try_validate_utf8(F.col("content").cast("string"))
    if fallback is None:
        return files.select("path", T.regularize(valid).alias("content"))
    rows = files.select("path", "content", valid.alias("text"))
    other = rows.where("text is null").select("path", "content").mapInArrow(_decoded(fallback), "path string, content string")
    both = rows.where("text is not null").select("path", F.col("text").alias("content")).unionByName(other)
    return both.select("path", T.regularize(F.col("content")).alias("content"))


def line_counts(files: DataFrame) -> DataFrame:
    """Non-blank lines of every file; files that are no UTF-8 count zero."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", F.coalesce(T.nonblank_count(text), F.lit(0)).cast("long").alias("n_lines"))


def resolve_documents(names: DataFrame, converted: DataFrame) -> DataFrame:
    """``name`` to Markdown: itself if it is Markdown, else the converted document of its stem."""
    stem = F.when(F.endswith("name", F.lit(".md")), F.col("name")).otherwise(F.concat(T.stem_last_dot(F.col("name")), F.lit(".md")))
    return names.withColumn("md", stem).join(converted.withColumnRenamed("path", "md"), "md", "left").drop("md")


def valid_project(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row: whether both repositories, the metadata and its project name are there."""
    have = files.agg(
        F.bool_or(F.startswith("path", F.lit("code_repo/"))).alias("code_repo"),
        F.bool_or(F.startswith("path", F.lit("doc_repo/"))).alias("doc_repo"),
    )
    named = metadata.agg(F.coalesce(F.bool_or(F.coalesce(F.length("project_name"), F.lit(0)) > 0), F.lit(False)).alias("named"))
    return have.crossJoin(named).select((F.coalesce("code_repo", F.lit(False)) & F.coalesce("doc_repo", F.lit(False)) & F.col("named")).alias("valid"))


class Refused(ValueError):
    """A folder that cannot become a project."""


def _paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files below a folder; an error where there is none."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(relative_to(F.col("path"), root).alias("path"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise Refused(f"no folder: {root}") from e


def refusal(spark: SparkSession, location: str) -> str | None:
    """Why a folder cannot become a project: it lacks a repository of code or of documents, or is a project already."""
    have = _paths(spark, location).select(F.substring_index("path", "/", 1).alias("top"), F.startswith("path", F.lit("metadata.json")).alias("meta"))
    tops = {r["top"]: r["meta"] for r in have.where("top in ('code_repo', 'doc_repo') or meta").groupBy("top").agg(F.bool_or("meta").alias("meta")).collect()}
    if any(tops.values()):
        return "it is a project already"
    return None if {"code_repo", "doc_repo"} <= set(tops) else "it lacks code_repo or doc_repo"


def create_from_folder(spark: SparkSession, name: str, location: str, now: Column) -> DataFrame:
    """A project from a folder: checked, its Word documents converted below ``doc_repo_converted``, its metadata written as
    ``metadata.json`` (a folder of one JSON file, as Spark writes it) and returned. A folder that cannot is ``Refused``."""
    from tracelake.sources import docx

    if why := refusal(spark, location):
        raise Refused(f"{location}: {why}")
    documents = scan(spark, f"{location}/doc_repo", "doc").where(F.endswith("path", F.lit(".docx")))
    docx.convert(documents, f"{location}/doc_repo_converted")
    made = project(spark, name, location, now)
    made.coalesce(1).write.mode("overwrite").json(f"{location}/metadata.json")
    return spark.read.schema(made.schema).json(f"{location}/metadata.json")


def project(spark: SparkSession, name: str, location: str, now: Column) -> DataFrame:
    """A project's metadata from its folder: files of both kinds and the sum of non-blank code lines."""
    code, doc = scan(spark, f"{location}/code_repo", "code"), scan(spark, f"{location}/doc_repo", "doc")
    scale = line_counts(code).agg(F.array_sort(F.collect_list("path")).alias("code_files"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("code_scale"))
    docs = doc.agg(F.array_sort(F.collect_list("path")).alias("doc_files"))
    return scale.crossJoin(docs).select(
        F.lit(name).alias("project_name"), F.lit(location).alias("project_location"), now.cast("timestamp_ntz").alias("create_time"),
        F.lit("code_repo").alias("code_repo"), F.lit("doc_repo").alias("doc_repo"), "code_files", "doc_files", "code_scale",
    )
