"""Annotations, selections and highlights: lookups and flags over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions import text as T
from tracelake.operators import intervals, store


def touching(annotations: DataFrame, document: Column) -> DataFrame:
    """Annotations with any range in a document, on either side."""

    def hit(side: str) -> Column:
        return F.coalesce(F.exists(side, lambda r: r["documentId"] == document), F.lit(False))

    return annotations.where(hit("docRanges") | hit("codeRanges"))


def ranges(annotations: DataFrame) -> DataFrame:
    """``id, side, ordinal, documentId, start, end`` of all ranges."""

    def side(name: str) -> DataFrame:
        rows = annotations.select("id", F.lit(name).alias("side"), F.posexplode(name).alias("ordinal", "r"))
        return rows.select("id", "side", "ordinal", "r.documentId", "r.start", "r.end")

    return side("docRanges").unionByName(side("codeRanges"))


def with_files(found: DataFrame, files: DataFrame) -> DataFrame:
    """Ranges with the file that they name; of files of a name the first by id."""
    first = files.groupBy("name").agg(F.min("id").alias("file_id"))
    return found.join(first, found.documentId == first.name, "left").drop("name")


def distinct_blocks(blocks: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One block per (filename, start, end), the last by ordinal."""
    w = Window.partitionBy("filename", "start", "end").orderBy(F.desc(ordinal))
    return blocks.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def highlight_flags(lines: DataFrame, current: DataFrame, previous: DataFrame) -> DataFrame:
    """``lines (file, line_no)`` plus whether a current and a previous block (file, start, end) holds them. A block whose ends
    are exchanged holds no line."""

    def marked(blocks: DataFrame, name: str) -> DataFrame:
        return intervals.held(lines, blocks, "file", "line_no").withColumn(name, F.lit(True))

    out = lines.join(marked(current, "is_current"), ["file", "line_no"], "left").join(marked(previous, "is_previous"), ["file", "line_no"], "left")
    return out.fillna(False, ["is_current", "is_previous"])


def highlight_blocks(flagged: DataFrame, flag: str) -> DataFrame:
    """Consecutive lines with a flag as blocks."""
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    rows = flagged.where(flag).withColumn("__g", island)
    return rows.groupBy("file", "__g").agg(F.min("line_no").alias("start"), F.max("line_no").alias("end")).drop("__g")


def selection_lines(text: Column, start: Column, end: Column) -> Column:
    """``STRUCT<first, last>`` lines (from one) of a half-open character range of a text with Unix line ends.

    Lines follow from offsets, so repeated lines are no trouble.
    """

    def line_of(at: Column) -> Column:
        return F.length(F.regexp_replace(F.substring(text, F.lit(1), at), r"[^\n]", "")) + 1

    return F.struct(line_of(start).alias("first"), line_of(F.greatest(start, end - 1)).alias("last"))


def locate_after(text: Column, piece: Column, after: Column) -> Column:
    """Half-open range of the next occurrence of a piece at or after an offset; null if there is none."""
    at = F.position(piece, text, after + 1)
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(piece)).alias("end")))


def locate_in_turn(text: Column, pieces: Column) -> Column:
    """``ARRAY<STRUCT<start, end>>`` of pieces, each looked for at or after the end of the last one found; null where absent."""
    none = F.lit(None).cast("struct<start: int, end: int>")
    first = F.struct(F.lit(0).alias("after"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("found"))

    def step(done: Column, piece: Column) -> Column:
        def add(at: Column) -> Column:
            hit = F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(piece)).alias("end"))).otherwise(none)
            after = F.when(at > 0, at - 1 + F.length(piece)).otherwise(done["after"])
            return F.struct(after.cast("int").alias("after"), F.concat(done["found"], F.array(hit)).alias("found"))

        return F.transform(F.array(F.position(piece, text, done["after"] + 1)), add)[0]

    return F.aggregate(pieces, first, step)["found"]


def selected_spans(selections: DataFrame, spans: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """``key, selection, start, end``: the whole spans that a selection touches, distinct, and from where to where they reach.

    ``selections (key, selection, start, end)`` and ``spans (key, start, end)`` are half-open.
    """
    both = intervals.overlap_join(selections, spans, key, width)
    hit = both.select(key, F.col("l_selection").alias("selection"), F.struct(F.col("r_start").alias("start"), F.col("r_end").alias("end")).alias("r"))
    per = hit.groupBy(key, "selection").agg(F.array_sort(F.collect_set("r")).alias("spans"))
    return per.withColumns({"start": F.array_min(F.transform("spans", lambda r: r["start"])), "end": F.array_max(F.transform("spans", lambda r: r["end"]))})


def neighbour(index: Column, step: int, size: Column) -> Column:
    """Previous or next position, held inside the list."""
    return F.greatest(F.lit(0), F.least(size - 1, index + step))


def export_name(prefix: str, at: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.date_format(at, "yyyy-MM-dd"), F.lit(".json"))


def remove_block(blocks: Column, index: Column) -> Column:
    """Blocks without the one at an index."""
    return F.filter(blocks, lambda b, i: i != index)


def add_block(blocks: Column, block: Column) -> Column:
    """Blocks with one more, by file name in locale order and start."""
    return store.sort_blocks(F.concat(F.coalesce(blocks, F.array()), F.array(block)))


def upload(current: DataFrame, incoming: DataFrame, kind: str, root: str) -> DataFrame:
    """Files after an upload: code keeps its path below the root, documents their base name; other kinds are refused.

    Paths that leave the root are dropped, a file of the same path is replaced. Of several incoming files of one path
    the last by ``ordinal`` stays, or without that column the last by content.
    """
    if kind not in ("code", "doc"):
        raise ValueError("kind is 'code' or 'doc'")
    full = F.concat(F.lit(root.rstrip("/") + "/"), F.col("path"))
    ok = incoming.where(T.inside(full, F.lit(root))) if kind == "code" else incoming.where(T.extension(F.col("path")).isin("md", "docx"))
    named = ok if kind == "code" else ok.withColumn("path", T.folder_name(F.col("path")))
    by = ["ordinal"] if "ordinal" in incoming.columns else ["content"]
    last = Window.partitionBy("path").orderBy(*[F.desc(c) for c in by])
    named = named.withColumn("__n", F.row_number().over(last)).where("__n = 1").select(current.columns)
    return current.join(named, "path", "left_anti").unionByName(named)


def upload_totals(files: DataFrame) -> DataFrame:
    """One row after an upload: ``n_files, code_scale`` (non-blank lines) of the files that stand now."""
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum(T.nonblank_count(F.col("content"))), F.lit(0)).alias("code_scale"))
