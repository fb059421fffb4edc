"""Streaming ingest: files of alignment records are upserted to a table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators import store
from tracelake.schema import schema
from tracelake.sources.buckets import Buckets


def alignment_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON-lines files of alignments as a stream, with the time each file was changed."""
    lines = spark.readStream.schema(schema("alignments")).json(folder)
    return lines.select("*", F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("origin"))


def upsert_batches(stream: DataFrame, table: str, checkpoint: str):
    """Start the upsert; each batch is merged by (project, doc, id), the latest file winning, into a new version.

    Versions are folders ``table/v=N``; a batch that runs again writes the same version, so restarts do no harm.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        keys = ["project", "doc", "id"]
        fresh = store.latest(batch, keys, ["arrived", "origin"])
        before = spark.read.schema(fresh.schema).parquet(f"{table}/v={n - 1}") if n else fresh.limit(0)
        store.upsert(before, fresh, keys, ["arrived", "origin"]).write.mode("overwrite").parquet(f"{table}/v={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_bucket_batches(stream: DataFrame, table: str, checkpoint: str, buckets: int = 64):
    """Start the upsert; each batch is merged by (project, doc, id), the latest file winning, into a new version of a
    table by buckets (``sources.buckets``): only the buckets that a batch touches are written.

    The version is the number of the batch; a batch that runs again writes the same version, so restarts do no harm.
    """
    spark = stream.sparkSession
    keys = ["project", "doc", "id"]
    kept = Buckets(spark, table, keys, T.StructType([T.StructField(f.name, f.dataType, True) for f in stream.schema]), buckets)

    def merge(batch: DataFrame, n: int) -> None:
        kept.upsert(batch, ["arrived", "origin"], version=n)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, table: str, schema: T.StructType, buckets: int = 64) -> DataFrame:
    """The last version of a table that ``upsert_bucket_batches`` writes."""
    return Buckets(spark, table, ["project", "doc", "id"], schema, buckets).read()
