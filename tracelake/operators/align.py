"""Language-model operators: align, review, generate. The model is any callable from prompts to replies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions import replies
from tracelake.functions.batches import parts as slices
from tracelake.operators import intervals

#: Makes a client, once per task; the client takes prompts and returns as many replies (None: failed).
Backend = Callable[[], Callable[[list[str]], list[str | None]]]

#: What replies are kept as.
REPLIES = "prompt_key string, reply string"

ALIGN = "Requirement:\n{requirement}\n\nNumbered code:\n{code}\n\nName the line intervals that implement it, as JSON: {{\"related_code\": [[first, last]]}}"
REVIEW = "Requirement:\n{requirement}\n\nRelated code:\n{code}\n\nReview whether they agree; end the analysis with \"" + replies.END_OF_REVIEW + "\", then list the issues."
GENERATE = "Related code:\n{code}\n\nState the requirement that this code implements."


def overlap_stub():
    """A client without a model: names the lines that share a long word with the requirement."""

    last: list = [None, []]  # prompts about one chunk follow one another, so its lines are read once

    def reply(prompt: str) -> str:
        head, _, code = prompt.partition("\n\nNumbered code:\n")
        wanted = set(re.findall(r"\w{5,}", head.partition("\n")[2].lower()))
        if last[0] != code:
            last[:] = code, [(n, set(re.findall(r"\w{5,}", t.lower()))) for n, t in re.findall(r"^(\d+): (.*)$", code, re.M)]
        hits = [int(n) for n, found in last[1] if wanted & found]
        return '{"related_code": [' + ", ".join(f"[{n}, {n}]" for n in hits) + "]}"

    return lambda prompts: [reply(p) for p in prompts]


def prompt(template: str, **parts: Column) -> Column:
    """A template with its named places filled from columns."""
    pieces = re.split(r"\{(\w+)\}(?!\})", template.replace("{{", "\1").replace("}}", "\2"))
    clean = [p.replace("\1", "{").replace("\2", "}") for p in pieces]
    return F.concat(*[parts[p] if k % 2 else F.lit(p) for k, p in enumerate(clean)])


def _calls(client, texts: list[str], tries: int) -> list[str | None]:
    for _ in range(tries):
        try:
            out = list(client(texts))[: len(texts)]
            return out + [None] * (len(texts) - len(out))
        except Exception:  # a failed call is a null reply, as a failed row must not end the job
            continue
    return [None] * len(texts)


def _answers(backend: Backend, make: Callable[..., str], keys: int, reply_col: str, per_call: int, tries: int):
    """Rows of ``keys`` key columns and the parts of a prompt -> keys and reply. One client a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = backend()
        for b in batches:
            texts, out = [make(*x) for x in zip(*(c.to_pylist() for c in b.columns[keys:]))], []
            for at in range(0, len(texts), per_call):
                out += _calls(client, texts[at : at + per_call], tries)
            yield pa.RecordBatch.from_arrays([*b.columns[:keys], pa.array(out, pa.string())], [*b.schema.names[:keys], reply_col])

    return run


#: Replies about a chunk.
TOLD = "c string, r string, reply string"


def _answers_of_chunks(backend: Backend, make: Callable[..., str], per_call: int, tries: int):
    """Rows of ``_chunks_and_asks`` -> a row (c, r, reply) for each of the asks. One client a task; prompts are made a call at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = backend()
        for b in slices(batches):
            rows = ((c, code, asks, set(skip or ())) for c, code, asks, skip in zip(*(x.to_pylist() for x in b.columns)))
            todo = ((c, q["r"], make(q["requirement"], code)) for c, code, asks, skip in rows for q in asks if q["r"] not in skip)
            while some := list(islice(todo, per_call)):
                c, r, texts = map(list, zip(*some))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (c, r, _calls(client, texts, tries))], ["c", "r", "reply"])

    return run


#: Prompts of a task that writes to a store: what a task that dies has to ask again.
PER_TASK = 256


def stored(spark: SparkSession, store: str) -> DataFrame:
    """``prompt_key, reply``: what a store holds, one reply a key; nothing where there is none yet."""
    try:
        found = spark.read.schema(REPLIES).parquet(store)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], REPLIES)
    return found.groupBy("prompt_key").agg(F.min("reply").alias("reply"))


def _replies(wanted: DataFrame, texts, make: Callable[..., str], backend: Backend, per_call: int, tries: int, cache: DataFrame | None, store: str | None) -> DataFrame:
    """``prompt_key, reply`` for the distinct keys of ``wanted (prompt_key, ...)``.

    ``texts`` makes (prompt_key, parts of the prompt) from the rows that are left to ask, dealt to so many tasks. Replies of ``cache`` and ``store`` are not
    asked again. With a store each task's replies are there as soon as the task ends (its files are moved in place when it
    commits, not when the job does), so a run that fails is gone on with where it ended. Failed calls are not stored.
    """
    spark = wanted.sparkSession
    had = [] if cache is None else [cache.select("prompt_key", "reply").where("reply is not null")]
    had += [] if store is None else [stored(spark, store)]
    left = wanted
    for known in had:
        left = left.join(known, "prompt_key", "left_anti")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: their number is set
    if store is not None:
        tasks = max(tasks, -(-left.count() // PER_TASK))
    asked = texts(left, tasks).mapInArrow(_answers(backend, make, 1, "reply", per_call, tries), REPLIES)
    if store is not None:
        asked.where("reply is not null").write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(store)
        asked, had = stored(spark, store), had[:-1]
    for known in had:
        asked = asked.unionByName(known)
    return asked.groupBy("prompt_key").agg(F.min("reply").alias("reply"))


def ask(
    df: DataFrame, prompt_col: str, backend: Backend, reply_col: str = "reply", per_call: int = 16, tries: int = 2, cache: DataFrame | None = None, store: str | None = None
) -> DataFrame:
    """``df`` plus the replies; a column of that name is replaced. Equal prompts are asked once.

    A call that fails ``tries`` times, and what a client leaves out, is null. ``cache (prompt_key, reply)`` holds replies of
    earlier runs by ``prompt_key``, and ``store`` is a folder that all tasks see, where replies are kept as they come; what either
    has is not asked again.
    """
    keyed = df.drop(reply_col).withColumn("__key", prompt_key(F.col(prompt_col)))
    wanted = keyed.groupBy(F.col("__key").alias("prompt_key")).agg(F.first(prompt_col).alias("p"))
    got = _replies(wanted, lambda left, tasks: left.repartition(tasks), lambda p: p, backend, per_call, tries, cache, store)
    return keyed.join(got.select(F.col("prompt_key").alias("__key"), F.col("reply").alias(reply_col)), "__key", "left").drop("__key")


def prompt_key(text: Column) -> Column:
    """What replies are cached by."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def related_code(answers: DataFrame, strict: bool = False) -> DataFrame:
    """``requirement_id, file, lines, reply`` rows to merged, extracted blocks: ``requirement_id, filename, content, start, end``.

    A malformed reply loses only its own blocks; ``strict`` drops all blocks of a requirement that got one.
    """
    parsed = answers.withColumn("pairs", replies.related_intervals(F.col("reply"), tolerant=not strict))
    if strict:
        bad = parsed.where("pairs is null").select("requirement_id").distinct()
        parsed = parsed.join(bad, "requirement_id", "left_anti")
    merged = parsed.select("requirement_id", "file", "lines", F.explode(intervals.merge_array(F.col("pairs"))).alias("b"))
    return merged.select("requirement_id", F.col("file").alias("filename"), *_block(F.col("lines"), F.col("b")))


def _block(lines: Column, b: Column) -> tuple[Column, ...]:
    return intervals.extract_from_lines(lines, b[0], b[1]).alias("content"), b[0].alias("start"), b[1].alias("end")


#: Chunks of a lot of a project: its requirements are dealt with one lot at a time. Also, requirements of a lot that meet a chunk in one task.
LOT = 64

#: Chunks of a share of a project: its requirements come to each share, and the texts of its chunks to their share once.
SHARE = 256


def pair_key(requirement: Column, content: Column) -> Column:
    """What replies about a requirement and a chunk are cached and stored by: hashes of the template and of both texts."""
    return F.sha2(F.concat_ws("|", F.sha2(F.lit(ALIGN), 256), prompt_key(requirement), prompt_key(content)), 256)


def _product(reqs: DataFrame, places: DataFrame) -> DataFrame:
    """Every requirement with every chunk of its project, as a row of keys each."""
    # A project of many chunks has as many lots, so that it is no single key however large it is.
    lots = F.ceil(F.count("*") / LOT).cast("int")
    sizes = places.groupBy("project").agg(lots.alias("lots"))
    dealt = places.join(sizes, "project").withColumn("lot", F.pmod(F.xxhash64("file", "start_line"), F.col("lots")).cast("int")).drop("lots")
    keys = reqs.join(sizes, "project").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    return keys.join(dealt, ["project", "lot"]).drop("lot")


def _chunks_and_asks(reqs: DataFrame, parts: DataFrame, places: DataFrame, tasks: int) -> DataFrame:
    """``c, content, asks: array of (r, requirement), skip: array of r``: every text of a chunk with every requirement of its project, a row for each ``LOT`` of them.

    No row of a pair is made or shuffled: texts of chunks are dealt once to shares of their project, and its requirements to each share.
    Of equal texts of a project the first place is asked. What is in ``skip`` is asked about that text in another project.
    """
    # Names of large projects only, at most one in SHARE chunks; the others are one share. It asks for every column of places, as all
    # that read places here and in ``align`` do: so chunks are made and hashed for one shuffle that serves them all.
    at = F.min(F.struct("file", "start_line", "end_line", "c")).alias("at")
    counts = places.groupBy("project").agg(F.count("*").alias("n"), at).where(f"n > {SHARE} and at is not null")
    large = F.broadcast(counts.select("project", F.ceil(F.col("n") / SHARE).cast("int").alias("shares")))
    shares = F.coalesce("shares", F.lit(1))

    # Which places are asked is found by keys, and told to the texts where they are dealt to, so that copies are dealt evenly too.
    first, none = places.groupBy("c", "project").agg(at), F.lit(None).cast("array<string>")
    twice = reqs.groupBy("r").agg(F.count_distinct("project").alias("n")).where("n > 1").select("r")
    if twice.isEmpty():
        first = first.withColumn("skip", none)
    else:  # a pair is met in many projects only if both of it are there: such pairs are made by their keys, and the first project asks
        many = first.withColumn("n", F.count("*").over(Window.partitionBy("c"))).where("n > 1 and at is not null").select("project", "at.file", "at.start_line", "c")
        met = _product(reqs.join(twice, "r").select("project", "r").distinct(), many)
        later = met.withColumn("owner", F.min("project").over(Window.partitionBy("r", "c"))).where("project > owner")
        first = first.join(later.groupBy("c", "project").agg(F.collect_list("r").alias("skip")), ["c", "project"], "left")
    first = first.select("project", "at.file", "at.start_line", "c", F.lit(None).cast("string").alias("content"), "skip", F.lit(True).alias("first"))
    rows = parts.select("project", "file", "start_line", "c", "content", none.alias("skip"), F.lit(False).alias("first")).unionByName(first)
    rows = rows.join(large, "project", "left").withColumn("share", F.pmod(F.xxhash64("file", "start_line"), shares).cast("int")).repartition(tasks, "project", "share")
    codes = rows.groupBy("project", "share", "file", "start_line", "c").agg(F.first("content", True).alias("content"), F.first("skip", True).alias("skip"), F.max("first").alias("first"))

    own = reqs.groupBy("project", "r").agg(F.first("requirement").alias("requirement"))
    lots = own.groupBy("project").agg(F.ceil(F.count("*") / LOT).alias("lots"))
    own = own.join(lots, "project").withColumn("lot", F.pmod(F.xxhash64("r"), "lots")).groupBy("project", "lot")
    asks = own.agg(F.collect_list(F.struct("r", "requirement")).alias("asks")).join(large, "project", "left")
    asks = asks.select("project", "asks", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share")).repartition(tasks, "project", "share")
    return codes.where("first").hint("merge").join(asks, ["project", "share"]).select("c", "content", "asks", "skip")


def align(
    requirements: DataFrame, chunks: DataFrame, lines: DataFrame, backend: Backend, strict: bool = False, per_call: int = 16, tries: int = 2,
    cache: DataFrame | None = None, store: str | None = None, candidates: DataFrame | None = None,
) -> DataFrame:
    """Every requirement of a project against every chunk of its code: ``requirement_id, filename, content, start, end``.

    ``requirements (project, requirement_id, requirement)``, ``chunks (project, file, start_line, end_line, content)``,
    ``lines (project, file, lines)``. Intervals of a reply are clipped to the lines of its chunk; those of all chunks of a
    file are merged. Each distinct pair of texts is asked once, and lines come in only where a reply names some. Without the
    three below, requirements come to the chunks and are asked there, so nothing on disk grows with the pairs but what is found.
    Files are known by project and path; equal requirement ids of one project are one requirement.

    ``candidates (project, requirement_id, file, start_line)`` limits the pairs (see ``retrieve``); without it every pair is asked.
    ``cache (prompt_key, reply)`` by ``pair_key`` and the folder ``store`` hold replies that are not asked again; see ``ask``.
    With either of the three, keys are paired.
    """
    reqs = requirements.withColumn("r", F.sha2(F.coalesce("requirement", F.lit("")), 256))
    parts = chunks.withColumn("c", F.sha2(F.coalesce("content", F.lit("")), 256))
    known = "project is not null and c is not null" + ("" if strict else " and file is not null")  # others name no lines
    places = parts.select("project", "file", "start_line", "end_line", "c").where(known).repartition("c")
    make = lambda requirement, code: ALIGN.format(requirement=requirement or "", code=code or "")

    def texts(left: DataFrame, tasks: int) -> DataFrame:
        # Keys are few bytes for much work, so the number of tasks is set, not left to the size of the rows. A chunk comes in once for
        # each LOT of its project's requirements, and its prompts are made where it is: texts of prompts are not shuffled.
        most = reqs.groupBy("project").count().agg(F.max("count")).first()[0] or 1
        lots = -(-most // LOT)
        left = left.join(reqs.groupBy("r").agg(F.first("requirement").alias("requirement")), "r")
        left = left.withColumn("lot", F.pmod(F.xxhash64("r"), F.lit(lots)).cast("int")).repartition(tasks, "c", "lot")
        codes = parts.select("c", "content").dropDuplicates(["c"]).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).repartition(tasks, "c", "lot")
        return left.join(codes.hint("merge"), ["c", "lot"]).select("prompt_key", "requirement", "content")

    def asked(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select("r", "c").distinct()
        wanted = wanted.withColumn("prompt_key", F.sha2(F.concat_ws("|", F.sha2(F.lit(ALIGN), 256), "r", "c"), 256))
        return wanted.join(_replies(wanted, texts, make, backend, per_call, tries, cache, store), "prompt_key", "left").select("c", "r", "reply")

    if candidates is not None:
        named = candidates.select("project", "requirement_id", "file", "start_line").distinct()
        pairs = named.join(reqs.select("project", "requirement_id", "r"), ["project", "requirement_id"]).join(places, ["project", "file", "start_line"])
        told = asked(pairs)
    elif cache is not None or store is not None:  # what is kept is kept by pair, so pairs are made
        told = asked(_product(reqs.select("project", "r").distinct(), places))
    else:
        tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        told = _chunks_and_asks(reqs, parts, places, tasks).mapInArrow(_answers_of_chunks(backend, make, per_call, tries), TOLD)

    def found(reply: Column) -> Column:
        return replies.related_intervals(reply, tolerant=not strict)

    # Replies without intervals go before any shuffle; the others are as many as there are findings.
    told = told.withColumn("pairs", found(F.col("reply"))).where("pairs is null or size(pairs) > 0" if strict else "size(pairs) > 0").drop("pairs")
    told = told.repartition("c").groupBy("c", "r").agg(F.min("reply").alias("reply")).select("c", "r", found(F.col("reply")).alias("pairs"))
    if candidates is None:
        named = told.join(places, "c").join(reqs.select("project", "requirement_id", "r"), ["project", "r"])
    else:
        named = pairs.join(told, ["r", "c"])
    if strict:
        bad = named.where("pairs is null").select("project", "requirement_id").distinct()
        named = named.join(bad, ["project", "requirement_id"], "left_anti")

    def clip(p: Column) -> Column:
        return F.array(F.greatest(p[0], "start_line"), F.least(p[1], "end_line"))

    clipped = F.filter(F.transform("pairs", clip), lambda p: p[0] <= p[1])
    named = named.where("pairs is not null").withColumn("pairs", clipped).where("size(pairs) > 0")
    per = named.groupBy("project", "requirement_id", "file").agg(F.flatten(F.collect_list("pairs")).alias("pairs"))
    blocks = per.join(lines, ["project", "file"]).select("requirement_id", "file", "lines", F.explode(intervals.merge_array(F.col("pairs"))).alias("b"))
    return blocks.select("requirement_id", F.col("file").alias("filename"), *_block(F.col("lines"), F.col("b")))


def code_context(blocks: Column) -> Column:
    """Blocks (filename, content) as one text. Its wording."""
    return F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("所属文件: "), b["filename"], F.lit("\n代码:\n"), b["content"])), "\n\n")


def review(points: DataFrame, backend: Backend) -> DataFrame:
    """``points (requirement, relatedCode)`` plus ``review_process, issues``; null where the model failed."""
    p = prompt(REVIEW, requirement=F.col("requirement"), code=code_context(F.col("relatedCode")))
    out = ask(points.withColumn("__p", p), "__p", backend, "__r").withColumn("__v", replies.review(F.col("__r")))
    return out.select("*", "__v.review_process", "__v.issues").drop("__p", "__r", "__v")


def generate(points: DataFrame, backend: Backend) -> DataFrame:
    """``points (relatedCode)`` plus ``generatedRequirement``; null where the model failed."""
    p = prompt(GENERATE, code=code_context(F.col("relatedCode")))
    return ask(points.withColumn("__p", p), "__p", backend, "generatedRequirement").drop("__p")
