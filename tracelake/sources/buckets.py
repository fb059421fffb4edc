"""Tables of records kept by buckets of their key: an update writes new files for the buckets that it touches, no others.

A version of a table is a manifest, a row a bucket with the folder of its rows. An update reads the touched buckets of the version before,
writes their next state to folders of its own and then a manifest that names these and, for all other buckets, the
folders that stand. A manifest counts once it is whole, so readers see one version or the next, and an update that
failed or runs again leaves or makes the same version. There is one writer at a time.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators import store

MANIFEST = "bucket int, folder string, n_rows long"


class Buckets:
    """A table below a folder, by ``keys``, in ``n`` buckets: a manifest has as many rows, so ``n`` is thousands at most."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema, n: int = 64):
        self.spark, self.root, self.keys, self.schema, self.n = spark, root.rstrip("/"), keys, schema, n

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def versions(self) -> list[int]:
        """Versions that are whole, in order: a manifest is one file, which is there when its job has ended."""
        try:
            done = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{self.root}/manifest")
            paths = [r["path"] for r in done.select("path").collect()]  # a file a version
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return sorted(int(m[1]) for p in paths if (m := re.search(r"/v=(\d+)/part-[^/]*$", p)))

    def manifest(self, version: int | None = None) -> dict[int, tuple[str, int]]:
        """Folder and rows of every bucket that has any, of the last version or a given one."""
        have = self.versions()
        at = version if version is not None else have[-1] if have else None
        if at is None:
            return {}
        if at not in have:
            raise ValueError(f"no version {at}")
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v={at}").collect()  # ``n`` at most
        return {r["bucket"]: (r["folder"], r["n_rows"]) for r in rows}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last version or a given one; none of a table that was never written."""
        return self._read([f for f, _ in self.manifest(version).values()])

    def _commit(self, version: int, touched: set[int], state: DataFrame, before: dict[int, tuple[str, int]]) -> int:
        data = f"data/v={version}"
        rows = state.select(*self.schema.names, self._bucket().alias("__bucket"))
        rows.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.root}/{data}")
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("__bucket", T.IntegerType())])).parquet(f"{self.root}/{data}")
        sizes = {r["__bucket"]: r["count"] for r in written.groupBy("__bucket").count().collect()}
        after = {b: x for b, x in before.items() if b not in touched} | {b: (f"{data}/__bucket={b}", n) for b, n in sizes.items()}
        made = self.spark.createDataFrame([(b, f, n) for b, (f, n) in sorted(after.items())], MANIFEST)
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")
        return version

    def _next(self, version: int | None) -> tuple[int, dict[int, tuple[str, int]]]:
        """The version to write, and the buckets of the last whole one before it."""
        have = self.versions()
        at = version if version is not None else have[-1] + 1 if have else 0
        before = [v for v in have if v < at]
        return at, self.manifest(before[-1]) if before else {}

    def _touched(self, keys: DataFrame) -> set[int]:
        return {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # ``n`` at most

    def upsert(self, updates: DataFrame, order: list[str], version: int | None = None) -> int:
        """Replace whole records by key, the last update by ``order`` winning; the version that this made.

        A ``version`` that is given, such as the number of a batch, is written anew if it is there. Without updates the
        new version has the folders of the one before.
        """
        at, before = self._next(version)
        touched = self._touched(updates)
        current = self._read([before[b][0] for b in sorted(touched) if b in before])
        return self._commit(at, touched, store.upsert(current, updates.select(*self.schema.names), self.keys, order), before)

    def delete(self, ids: DataFrame, version: int | None = None) -> int:
        """Without the records of some keys; the version that this made."""
        at, before = self._next(version)
        touched = self._touched(ids)
        current = self._read([before[b][0] for b in sorted(touched) if b in before])
        return self._commit(at, touched, store.delete(current, ids.select(*self.keys).distinct(), self.keys), before)
