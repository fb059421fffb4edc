"""A log of edits of annotations, applied in order: create, add a range, rename, remove a range by its ordinal, delete.

After each edit an ordinal means another range, so the edits of one record are folded one after the other. They come to the fold
as a stream, sorted by record and order, which holds one record at a time and none of its log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Verbs of a log.
VERBS = ("create", "add", "rename", "remove", "delete")
SIDES = ("docRanges", "codeRanges")


class Record:
    """One annotation as its edits leave it."""

    def __init__(self) -> None:
        self.stands, self.name, self.seq, self.ranges = False, None, None, {s: [] for s in SIDES}

    def restore(self, name: str | None, doc: list | None, code: list | None) -> None:
        self.stands, self.name, self.ranges = True, name, {"docRanges": list(doc or []), "codeRanges": list(code or [])}

    def apply(self, seq, verb: str, side: str | None, ordinal: int | None, name: str | None, item) -> None:
        """An edit that cannot be done (a record that does not stand, or stands already; an ordinal or a side that is none; a blank
        name) changes nothing."""
        named, ranges = (name or "").strip(" ") != "", self.ranges.get(side)
        if verb == "create" and not self.stands:
            self.stands, self.name = True, name if named else None
            self.ranges = {s: [item] if s == side and item is not None else [] for s in SIDES}
        elif verb == "add" and self.stands and ranges is not None and item is not None:
            ranges.append(item)
        elif verb == "rename" and self.stands and named:
            self.name = name
        elif verb == "remove" and self.stands and ranges is not None and ordinal is not None and 0 <= ordinal < len(ranges):
            del ranges[ordinal]
            self.stands = any(self.ranges.values())  # the last range takes the record with it
        elif verb == "delete" and self.stands:
            self.stands = False
        else:
            return
        self.seq = seq


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "name", *SIDES, "last_seq"]
    record, key, any_row, types = Record(), None, False, None

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 5, types)], names)

    def done() -> list[tuple]:
        return [(key, record.name, record.ranges["docRanges"], record.ranges["codeRanges"], record.seq)] if any_row and record.stands else []

    for b in batches:
        kind = {c: b.schema.field(c).type for c in b.schema.names}
        types = [kind["id"], kind["name"], kind["docRanges"], kind["codeRanges"], kind["seq"]]
        found: list[tuple] = []
        for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("id", "seq", "verb", "side", "ordinal", "name", "range", *SIDES))):
            if not any_row or r[0] != key:
                found += done()
                record, key, any_row = Record(), r[0], True
            if r[2] is None:
                record.restore(r[5], r[7], r[8])
            else:
                record.apply(*r[1:7])
        yield out(found)
    if types:
        yield out(done())


def replay(annotations: DataFrame, log: DataFrame) -> DataFrame:
    """``id, name, docRanges, codeRanges, last_seq`` of the annotations that stand after a log.

    ``annotations (id, name, docRanges, codeRanges)``, one row an id; ``log (id, seq, verb, side, ordinal, name, range)``: edits
    go by ``seq``, null first, those that tie by the hash of their columns. ``side`` is ``docRanges`` or ``codeRanges``, ``ordinal`` counts
    from zero among the ranges that stand then. ``last_seq`` is the last edit that changed the record, null where none
    did. A null id is one too. Edits that cannot be done change nothing; verbs that are none are an error of the log and
    change nothing either.
    """
    range_type = log.schema["range"].dataType
    ranges = f"array<{range_type.simpleString()}>"
    seq = log.schema["seq"].dataType.simpleString()
    none = F.lit(None)
    heads = annotations.select(
        "id", none.cast(seq).alias("seq"), none.cast("string").alias("verb"), none.cast("string").alias("side"), none.cast("int").alias("ordinal"), "name",
        none.cast(range_type).alias("range"), *[F.col(s).cast(ranges).alias(s) for s in SIDES], F.lit(0).alias("kind"),
    )
    steps = log.select(
        "id", "seq", F.coalesce("verb", F.lit("")).alias("verb"), "side", F.col("ordinal").cast("int").alias("ordinal"), "name", "range",
        *[none.cast(ranges).alias(s) for s in SIDES], F.lit(1).alias("kind"),
    )
    both = heads.unionByName(steps).withColumn("tie", F.xxhash64("verb", "side", "ordinal", "name", "range"))
    ordered = both.repartition("id").sortWithinPartitions("id", "kind", "seq", "tie").drop("kind", "tie")
    kind = ordered.schema["id"].dataType.simpleString()
    return ordered.mapInArrow(_replay, f"id {kind}, name string, docRanges {ranges}, codeRanges {ranges}, last_seq {seq}")
