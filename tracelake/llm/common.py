"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where a session of one machine names no shared folder (tests, notebooks).
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Where that is unset, a session of one machine (``local[...]``) gets a folder of its own; on a cluster there is no
    folder that all would see, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="tracelake-"))
    return _OWN[0]


#: Spark's setting that files of an execution's shuffles go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table and read it back. Once it is written nothing needs its shuffles, so their files go at once."""
    spark = df.sparkSession
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(nullable(df.schema)).parquet(path)


def materialise(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """``save`` to the shared folder under a name of its own: lineage is cut, a lost executor loses nothing."""
    return save(df, f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}", partition_by)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """A key per row, repeated rows and null ids included. Stable only once written (see ``materialise``)."""
    return df.withColumn(name, F.monotonically_increasing_id())


def set_aside(df: DataFrame, *keep: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with all columns but ``keep`` under names that no operator uses, and the columns that name them back."""
    private = {c: c if c in keep else f"__aside_{k}" for k, c in enumerate(df.columns)}
    moved = df.select(*[F.col(f"`{c}`").alias(p) for c, p in private.items()])
    return moved, [F.col(f"`{p}`").alias(c) for c, p in private.items()]


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, -(-rows // per_part))


def byte_slices(batch, column: int, most: int):
    """Slices of an Arrow batch with at most ``most`` bytes of a binary column each (a single longer row is one)."""
    import numpy as np

    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], np.int64)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield batch.slice(at, n)
        at += n
