"""Code lines: numbering, fixed chunks, offsets. One row per line; a file's lines never leave its rows' order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import text as T


def code_lines(files: DataFrame, file_col: str = "file", content_col: str = "content") -> DataFrame:
    """``file, line_no, text``; a narrow step."""
    return files.select(F.col(file_col).alias("file"), F.posexplode(T.lines(F.col(content_col))).alias("i", "text")).select(
        "file", (F.col("i") + 1).alias("line_no"), "text"
    )


def fixed_chunks(files: DataFrame, size: int = 1000, file_col: str = "file", content_col: str = "content") -> DataFrame:
    """Chunks of ``size`` numbered lines, cut inside the row: no shuffle."""
    rows = files.select(F.col(file_col).alias("file"), T.lines(F.col(content_col)).alias("l"))
    starts = F.when(F.size("l") > 0, F.sequence(F.lit(0), F.floor((F.size("l") - 1) / size).cast("int")))  # a filter would cut the text once more
    before = F.col("chunk_no") * size
    numbered = F.transform(F.slice("l", before + 1, F.lit(size)), lambda x, i: F.concat((before + i + 1).cast("string"), F.lit(": "), x))
    return rows.select("file", "l", F.explode(starts).alias("chunk_no")).select(
        "file",
        "chunk_no",
        (before + 1).alias("start_line"),
        F.least(before + size, F.size("l")).alias("end_line"),
        F.array_join(numbered, "\n").alias("content"),
    )


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat = b.column(1).flatten()
        per = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy()
        size = pc.utf8_length(flat).to_numpy().astype(np.int64)
        first = np.cumsum(per) - per
        line = np.arange(len(flat)) - np.repeat(first, per)
        before = np.cumsum(size + 1) - size - 1
        start = before - np.repeat(np.r_[before, 0][np.minimum(first, len(flat))], per)
        files = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), per)))
        cols = [files, pa.array((line + 1).astype(np.int32)), pa.array(start), pa.array(start + size)]
        yield pa.RecordBatch.from_arrays(cols, ["file", "line_no", "start_off", "end_off"])


def line_offsets(files: DataFrame, file_col: str = "file", content_col: str = "content") -> DataFrame:
    """``file, line_no, start_off, end_off``: half-open character ranges of the lines in their file, a terminator counting one.

    Summed inside the row: no shuffle. Null and empty contents have no lines.
    """
    rows = files.select(F.col(file_col).alias("file"), T.lines(F.col(content_col)).alias("lines"))
    kind = rows.schema["file"].dataType.simpleString()
    return rows.mapInArrow(_offsets, f"file {kind}, line_no int, start_off long, end_off long")
