"""Exact deduplication by a tree merge of sorted digest runs.

Every row belongs to one of ``radix ** rounds`` leaf nodes. Each leaf condenses its rows to a run: one
record per distinct text, sorted by digest, with the identifier that survives and the number of rows. In
binomial round r the ``radix`` nodes that differ only in digit r exchange their runs: a record moves to the
node whose digit r is digit r of its digest bucket, and the receiving node merges the runs that reach it.
A merge meets at most ``radix`` records of a text, however many copies there are, so no text makes a node
heavy. The way back walks the same tree from the root runs to the leaves, again with at most ``radix``
records a text and node, and so reaches every copy without one hot join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import materialise, text_of, with_row_id

#: A record is merged with another only if all three agree; length and second hash verify the digest.
VERIFIED = ["digest", "n_bytes", "check"]


def _digit(number: Column, radix: int, r: int) -> Column:
    return F.pmod(F.floor(number / F.lit(radix**r)).cast("long"), F.lit(radix))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    radix: int = 8,
    rows_per_leaf: int = 500_000,
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty. A null id loses to any other id; a group of null ids only has a null
    ``keep_id``. Of repeated rows with the surviving id exactly one is kept. An empty table gives no rows;
    extra columns, whatever their names, are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = text_of(text_col)
    base = materialise(
        with_row_id(
            docs.select(
                F.col(id_col).alias("id"),
                F.unhex(F.sha2(text, 256)).alias("digest"),
                F.octet_length(text).alias("n_bytes"),
                F.xxhash64(text).alias("check"),
            )
        ),
        "dedup-digests",
    )
    leaves = radix * radix
    rounds = 2
    n_rows = base.count()
    while leaves * rows_per_leaf < n_rows:
        leaves, rounds = leaves * radix, rounds + 1
    best = F.min if keep == "smallest" else F.max
    present = F.col("id").isNull() if keep == "smallest" else F.col("id").isNotNull()
    bucket = F.pmod(F.xxhash64("digest"), F.lit(leaves))
    base = base.withColumn("node", F.pmod(F.xxhash64("rid"), F.lit(leaves))).withColumn(
        "best", F.struct(present.alias("present"), "id", "rid")
    )

    def moved(runs: DataFrame, r: int) -> DataFrame:
        step = (_digit(bucket, radix, r) - _digit(F.col("node"), radix, r)) * F.lit(radix**r)
        return runs.withColumn("next", F.col("node") + step)

    # Up: leaf runs, then one exchange and multiway merge a round.
    runs = [
        materialise(
            base.groupBy("node", *VERIFIED).agg(best("best").alias("best"), F.count("*").alias("n")), "dedup-runs"
        )
    ]
    for r in range(rounds):
        received = moved(runs[-1], r).select(F.col("next").alias("node"), *VERIFIED, "best", "n")
        merged = (
            received.repartition(F.col("node"))
            .sortWithinPartitions("node", *VERIFIED)
            .groupBy("node", *VERIFIED)
            .agg(best("best").alias("best"), F.sum("n").alias("n"))
        )
        runs.append(materialise(merged, "dedup-runs"))

    # Down: only texts with copies travel back.
    found = runs[-1].where("n > 1")
    for r in reversed(range(rounds)):
        below = moved(runs[r], r).select(F.col("node").alias("below"), F.col("next").alias("node"), *VERIFIED)
        found = below.join(found, ["node", *VERIFIED]).select(F.col("below").alias("node"), *VERIFIED, "best", "n")
    out = base.drop("best").join(found, ["node", *VERIFIED], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("best").isNull() | (F.col("best.rid") == F.col("rid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *([] if "rid" == id_col else ["rid"]),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents that stay, with the columns of ``docs``: one row of each text, whole repeated rows included."""
    stay = (
        exact_dedup(docs, id_col, text_col, keep)
        .where("kept")
        .select(_key(F.col(id_col)).alias("__id"), F.col("text_sha256").alias("__digest"))
    )
    return one_row_per_key(docs, F.sha2(text_of(text_col), 256), stay, id_col)


def _key(col: Column) -> Column:
    """Null-proof join key of an id."""
    return F.concat(col.isNull().cast("string"), F.coalesce(col.cast("string"), F.lit("")))


def one_row_per_key(docs: DataFrame, digest: Column, stay: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose (id, digest) is in ``stay (__id, __digest)``; of repeated rows one. One shuffle of the rows.

    A row travels as a struct, so no name of a column can clash with those that are used here.
    """
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # Spark hashes no maps
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    mine = Window.partitionBy("__id", "__digest").orderBy("__tie")
    return (
        docs.select(_key(F.col(f"`{id_col}`")).alias("__id"), digest.alias("__digest"), tie.alias("__tie"), row.alias("__row"))
        .join(stay, ["__id", "__digest"], "left_semi")
        .withColumn("__nth", F.row_number().over(mine))
        .where("__nth = 1")
        .select(*[F.col(f"__row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
    )
