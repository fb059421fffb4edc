"""Record stores as tables: upserts, deletes, history, issues, annotations. Every verb maps a table to its next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of every key; of records that tie the one whose columns hash largest."""
    plain = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]  # Spark hashes no maps
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], F.xxhash64(*plain).desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Whole-record replace by key; of several updates the last by ``order`` wins, and any update wins over what stands."""
    both = current.withColumn("__side", F.lit(0)).unionByName(updates.withColumn("__side", F.lit(1)))
    return latest(both, keys, ["__side", *order]).drop("__side")


def delete(current: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Without the records of some keys; absent keys do no harm."""
    return current.join(ids, keys, "left_anti")


def open_history(opened: DataFrame, most: int = 15, key: str = "path", when: str = "last_opened") -> DataFrame:
    """The last ``most`` distinct paths, newest first."""
    return latest(opened, [key], [when]).orderBy(F.desc(when), key).limit(most)


def open_projects(history: DataFrame, projects: DataFrame, opened: DataFrame, most: int = 15) -> DataFrame:
    """The history ``(name, path, last_opened)`` after projects were opened: only those whose location there is, with a name."""
    there = projects.select(F.col("project_location").alias("path")).distinct()
    good = opened.where(F.trim("name") != "").join(there, "path", "left_semi").select(history.columns)
    return open_history(history.unionByName(good), most)


def not_opened(projects: DataFrame, opened: DataFrame) -> DataFrame:
    """What is refused of them: projects without a name or path, or that have been moved or deleted."""
    there = projects.select(F.col("project_location").alias("path"), F.lit(True).alias("there")).distinct()
    good = (F.trim(F.coalesce("name", F.lit(""))) != "") & F.coalesce("there", F.lit(False))
    return opened.join(there, "path", "left").where(~good).select(opened.columns)


def _nth(df: DataFrame, key: str, ordinal: str) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(ordinal))


def update_first(df: DataFrame, changes: DataFrame, key: str, ordinal: str, column: str) -> DataFrame:
    """Set ``column`` of the first record of every key in ``changes (key, new)``; ids may repeat.

    Of several changes of a key the one with the largest ``at`` counts, or without that column the largest value.
    """
    numbered = df.withColumn("__n", _nth(df, key, ordinal))
    by = F.struct("at", "new") if "at" in changes.columns else F.struct("new")
    last = changes.groupBy(key).agg(F.max(by)["new"].alias("__new"))
    got = numbered.join(last, key, "left")
    first = (F.col("__n") == 1) & F.col("__new").isNotNull()
    return got.withColumn(column, F.when(first, F.col("__new")).otherwise(F.col(column))).drop("__n", "__new").select(df.columns)


def delete_first(df: DataFrame, ids: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Without the first record of every key in ``ids``."""
    got = df.withColumn("__n", _nth(df, key, ordinal)).join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return got.where(~((F.col("__n") == 1) & F.coalesce("__hit", F.lit(False)))).select(df.columns)


def missing(wanted: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of updates or deletes that no record has: the errors of those verbs."""
    return wanted.join(current, keys, "left_anti")


def confirm(issues: DataFrame, ids: DataFrame) -> DataFrame:
    """Issues with the first record of every id in ``ids`` confirmed."""
    return update_first(issues, ids.select("id", F.lit("confirmed").alias("new")), "id", "createdDate", "status")


def ignore(issues: DataFrame, ids: DataFrame) -> DataFrame:
    """Issues without the first record of every id in ``ids``: an issue that is ignored is deleted."""
    return delete_first(issues, ids, "id", "createdDate")


def append_issues(issues: DataFrame, new: DataFrame) -> DataFrame:
    """Issues with more of them: ids may repeat; columns that ``new`` lacks are null, others than those of an issue an error."""
    unknown = set(new.columns) - set(issues.columns)
    if unknown:
        raise ValueError(f"no columns of an issue: {sorted(unknown)}")
    return issues.unionByName(new, allowMissingColumns=True)


def create_project(projects: DataFrame, new: DataFrame) -> DataFrame:
    """Projects with the new ones whose location none has yet; of new ones at one location the first by name."""
    w = Window.partitionBy("project_location").orderBy("project_name")
    first = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    fresh = first.join(projects.select("project_location"), "project_location", "left_anti")
    return projects.unionByName(fresh, allowMissingColumns=True)


def refused_projects(projects: DataFrame, new: DataFrame) -> DataFrame:
    """New projects that are not created, as their location is taken."""
    return new.join(projects.select("project_location"), "project_location", "left_semi").select(new.columns)


def rename(records: DataFrame, names: DataFrame) -> DataFrame:
    """Records (annotations, alignments) with the names that ``names (id, name)`` gives; blank names change nothing."""
    given = names.where(F.trim("name") != "").groupBy("id").agg(F.max("name").alias("__name"))
    out = records.join(given, "id", "left")
    return out.withColumn("name", F.coalesce("__name", "name")).select(records.columns)


def create_alignments(alignments: DataFrame, selections: DataFrame) -> DataFrame:
    """Alignments with one more for every selection ``(project, doc, id, name, docRanges)``: named, unreviewed, without code."""
    new = selections.withColumn("name", default_name(F.col("name"), F.col("id"))).withColumn("isReviewed", F.lit(False))
    return alignments.unionByName(new, allowMissingColumns=True)


def add_range(annotations: DataFrame, ranges: DataFrame, side: str) -> DataFrame:
    """``ranges (id, range, at)`` appended in order to ``docRanges`` or ``codeRanges``."""
    more = ranges.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "range"))).alias("__more"))
    grown = F.concat(F.coalesce(F.col(side), F.array()), F.coalesce(F.transform("__more", lambda r: r["range"]), F.array()))
    return annotations.join(more, "id", "left").withColumn(side, grown).select(annotations.columns)


def remove_range(annotations: DataFrame, index: Column, side: str) -> DataFrame:
    """Without the range at an index of a side; annotations left without any range go."""
    out = annotations.withColumn(side, F.filter(side, lambda r, i: ~F.coalesce(i == index, F.lit(False))))
    return out.where(F.coalesce(F.size("docRanges"), F.lit(0)) + F.coalesce(F.size("codeRanges"), F.lit(0)) > 0)


def default_name(name: Column, ident: Column) -> Column:
    """A given name, else one from the id. Fixed value: the prefix."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("需求点_"), F.left(ident, F.lit(8))))


def sort_blocks(blocks: Column) -> Column:
    """An array of code blocks by file name in locale order, then start."""

    def place(b: Column) -> Column:
        return F.struct(F.collate(b["filename"], "UNICODE"), b["start"])

    return F.array_sort(blocks, lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0))


def sorted_blocks(blocks: DataFrame) -> DataFrame:
    """Code blocks by file name in locale order, then start."""
    return blocks.orderBy(F.collate("filename", "UNICODE"), "start")


def issue_document(summary: Column, issues: Column) -> Column:
    """Issue text as a page that word processors open."""
    return F.concat(F.lit("<html><body><h1>"), summary, F.lit("</h1>"), F.replace(issues, F.lit("\n"), F.lit("<br>")), F.lit("</body></html>"))


def _filled(items: Column, path: Column, side: str, **missing) -> Column:
    """Items of an import: a missing id is a UUID made from file, side and place, so that a rerun gives the same."""

    def fill(x: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", path, F.lit(side), i.cast("string")), 256)
        parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        out = x.withField("id", F.coalesce(F.nullif(x["id"], F.lit("")), F.concat_ws("-", *parts)))
        for name, of in missing.items():
            out = out.withField(name, F.coalesce(F.nullif(x[name], F.lit("")), x[of]))
        return out

    return F.transform(items, fill)


def valid_annotations(files: DataFrame, schema) -> DataFrame:
    """Annotation exports that have the three arrays they need, parsed; missing ids are made, missing paths are the names."""
    parsed = files.select("*", F.from_json("content", schema).alias("j"))
    ok = F.col("j.annotations").isNotNull() & F.col("j.docFiles").isNotNull() & F.col("j.codeFiles").isNotNull()
    return parsed.where(ok).select(
        "path",
        _filled(F.col("j.annotations"), F.col("path"), "annotations").alias("annotations"),
        _filled(F.col("j.docFiles"), F.col("path"), "docFiles", localPath="name").alias("docFiles"),
        _filled(F.col("j.codeFiles"), F.col("path"), "codeFiles", localPath="name").alias("codeFiles"),
    )


def valid_requirement_points(files: DataFrame, schema) -> DataFrame:
    """Exports with an array ``requirementPoints``, one row a point: ``path, ordinal`` and the fields of a point."""
    parsed = files.select("path", F.from_json("content", schema)["requirementPoints"].alias("p")).where("p is not null")
    made = _filled(F.col("p"), F.col("path"), "requirementPoints")
    return parsed.select("path", F.posexplode(made).alias("ordinal", "r")).select("path", "ordinal", "r.*")
