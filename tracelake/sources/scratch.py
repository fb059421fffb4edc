"""A folder that all tasks see, for tables that a query writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new name below ``spark.checkpoint.dir``; where that is unset, on one machine (``local[...]``) below a temporary folder,
    elsewhere an error, as there is no folder that all would see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="tracelake-")
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
