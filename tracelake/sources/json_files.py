"""JSON records of projects, alignments, issues, history and exports, read with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.schema import schema


def objects(files: DataFrame, kind: str) -> DataFrame:
    """One object per file, ``path, content`` rows; what is no JSON object of the kind is dropped."""
    valid = files.where(F.json_object_keys("content").isNotNull())
    return valid.select("path", F.from_json("content", schema(kind)).alias("r")).select("path", "r.*")


def records(files: DataFrame, kind: str) -> DataFrame:
    """Records of files that hold either a map from id to record or a list of records, in order."""
    record = schema(kind)
    as_map = F.map_values(F.from_json("content", T.MapType(T.StringType(), record)))
    as_list = F.from_json("content", T.ArrayType(record))
    is_list = F.ltrim(F.col("content")).startswith("[")
    found = files.select("path", F.when(is_list, as_list).otherwise(as_map).alias("r")).where("r is not null")
    return found.select("path", F.posexplode("r").alias("ordinal", "r")).select("path", "ordinal", "r.*")


def read_or_empty(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of a folder or file of JSON; an empty table where there is none."""
    return records(_files(spark, path), kind)


def _files(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, content string")


def history(spark: SparkSession, path: str) -> DataFrame:
    """Opened projects, newest first; an empty table where the file is missing or no JSON list."""
    found = _files(spark, path).select(F.explode(F.from_json("content", T.ArrayType(schema("history")))).alias("r")).where("r.path is not null")
    return found.select("r.*").orderBy(F.desc("last_opened"), "path")


def export(df: DataFrame, name: str = "json") -> DataFrame:
    """Rows as JSON text, nested arrays included."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
