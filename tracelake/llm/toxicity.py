"""Toxicity by weak supervision.

Many voters read a text and vote toxic, vote clean or abstain: groups of a lexicon of insults, words that a bounded
sample of labelled rows sets apart, general patterns, and the absence of all of these. A generative label model takes
the votes of labelled and unlabelled rows as observed and the class as hidden. Its parameters are the rates at which a
voter votes each way in either class, hence its accuracy, and the correlations of voters: a voter may depend on one
other, by a table for each class. Expectation maximisation estimates all of them; gold labels choose words, tell the
classes apart and are one more voter where a row has one. A linear classifier over words is trained on the posterior
labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import byte_slices, crc_mod, materialise, text_of

#: All ASCII but letters to a space; bytes from 0x80 on belong to words.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
STARTS = (4, 5, 6)
#: Plain insults by language, one voter each.
LEXICON = {
    "en": "idiot idiots moron morons imbecile stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown vermin filth bastard jerk",
    "de": "idiot idioten trottel depp vollidiot arschloch dreck abschaum missgeburt schwachkopf versager widerlich",
    "fr": "idiot idiote imbécile crétin abruti connard salaud ordure minable débile",
    "es": "idiota imbécil estúpido tonto basura cabrón pendejo gilipollas inútil asqueroso",
}
#: Patterns over whole texts and how they vote.
PATTERNS = {
    "#masked": (re.compile(rb"\b[A-Za-z]+[*@#$]{2,}[A-Za-z]+"), 1),
    "#you": (re.compile(rb"\byou(?:'re| are| all)? (?:an? )?(?:\w+ ){0,2}(?:idiot|moron|loser|clown|trash|scum)", re.I), 1),
    "#shout": (re.compile(rb"!{3,}"), 1),
    "#licence": (re.compile(rb"\blicen[cs]e[ds]?\b|\bcopyright\b", re.I), 0),
}
CLEAN, TOXIC, ABSTAIN = 0, 1, 2
#: Mined roots beyond so many share voters, so that none is left out.
GROUPS = 64


#: Words of which less than this share of the labelled rows that have them, by weight, is toxic have no vote.
PRECISE = 0.9


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(LETTERS).split())


def with_starts(words: set[bytes]) -> set[bytes]:
    """Words and their beginnings, marked by a star."""
    return words | {w[:n] + b"*" for w in words if len(w) > 3 for n in STARTS if len(w) >= n}


def features(text: bytes) -> set[bytes]:
    """Words, word beginnings and general patterns of a whole text."""
    out = with_starts(words_of(text))
    out |= {name.encode() for name, (p, _) in PATTERNS.items() if p.search(text)}
    return out


@dataclass
class Voters:
    """``toxic`` and ``clean``: mined words and beginnings to the number of their voter; fixed lexicons and patterns follow."""

    toxic: dict[bytes, int]
    clean: dict[bytes, int]
    groups: int
    fixed: list[tuple[str, set[bytes]]] = field(default_factory=lambda: [(f"lexicon-{k}", set(v.encode().split())) for k, v in LEXICON.items()])

    def __len__(self) -> int:
        return 2 * self.groups + len(self.fixed) + len(PATTERNS) + 1

    def votes(self, text: bytes) -> list[int]:
        out, words = [ABSTAIN] * len(self), words_of(text)
        for w in with_starts(words):
            if (g := self.toxic.get(w)) is not None:
                out[g] = TOXIC
            if (g := self.clean.get(w)) is not None:
                out[self.groups + g] = CLEAN
        at = 2 * self.groups
        for k, (_, lexicon) in enumerate(self.fixed):
            if not words.isdisjoint(lexicon):
                out[at + k] = TOXIC
        at += len(self.fixed)
        for k, (p, way) in enumerate(PATTERNS.values()):
            if p.search(text):
                out[at + k] = way
        if TOXIC not in out[: 2 * self.groups + len(self.fixed)]:
            out[-1] = CLEAN  # no word of any lexicon
        return out


@dataclass
class Model:
    """The linear classifier; ``accuracies`` of voters and agreement with gold labels (``check``) for the record."""

    bias: float
    weights: dict[bytes, float]
    accuracies: list[float] = field(default_factory=list)
    edges: list[tuple[int, int]] = field(default_factory=list)
    check: float | None = None

    def logit(self, text: bytes) -> float:
        get, total = self.weights.get, self.bias
        for w in with_starts(words_of(text)):
            if x := get(w):
                total += x
        for name, (p, _) in PATTERNS.items():
            if (x := get(name.encode())) and p.search(text):
                total += x
        return total


# -- label model ----------------------------------------------------------------------------------------------------


@dataclass
class LabelModel:
    """``prior`` of the toxic class, ``tables[j][y][u][v]``: P(voter j votes v | class y, its parent votes u), ``parent``."""

    prior: float
    tables: np.ndarray
    parent: np.ndarray

    def posterior(self, votes: np.ndarray, more: np.ndarray | float = 0.0) -> np.ndarray:
        """P(toxic | votes) of every row; ``more`` is added to the log odds."""
        log = np.log(self.tables)
        logit = np.full(len(votes), math.log(self.prior / (1 - self.prior))) + more
        for j, k in enumerate(self.parent):
            u = votes[:, k] if k >= 0 else 0
            logit += log[j, 1, u, votes[:, j]] - log[j, 0, u, votes[:, j]]
        return 1 / (1 + np.exp(-logit.clip(-30, 30)))

    def accuracies(self, votes: np.ndarray, weight: np.ndarray) -> list[float]:
        """Expected share of right votes among those that a voter casts."""
        p = self.posterior(votes)
        out = []
        for j in range(votes.shape[1]):
            right = np.where(votes[:, j] == TOXIC, p, 1 - p) * weight
            cast = votes[:, j] != ABSTAIN
            out.append(float(right[cast].sum() / weight[cast].sum()) if cast.any() else float("nan"))
        return out


#: Votes each way added to every count, and the first belief in a gold label.
SMOOTH, TRUST = 0.1, 0.95


def maximise(votes: np.ndarray, p: np.ndarray, weight: np.ndarray, parent: np.ndarray) -> LabelModel:
    """The most likely parameters under posteriors p, smoothed by ``SMOOTH`` votes each way."""
    tables = np.empty((votes.shape[1], 2, 3, 3))
    for y, share in ((0, (1 - p) * weight), (1, p * weight)):
        for j, k in enumerate(parent):
            code = votes[:, j] + 3 * (votes[:, k].astype(np.int64) if k >= 0 else 0)
            n = np.bincount(code, weights=share, minlength=9).reshape(3, 3) + SMOOTH
            tables[j, y] = n / n.sum(axis=1, keepdims=True)
    return LabelModel(float(np.average(p, weights=weight).clip(1e-4, 1 - 1e-4)), tables, parent)


def correlations(votes: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Parent of every voter: the forest of the pairs that say most of each other beyond the class, if significantly."""
    n, m = votes.shape
    one_hot = (votes[:, :, None] == np.arange(3)).reshape(n, 3 * m).astype(np.float64)
    total, gain = weight.sum(), np.zeros((m, m))
    for share in ((1 - p) * weight, p * weight):
        size = share.sum()
        if size <= 0:
            continue
        joint = (one_hot.T @ (one_hot * share[:, None])).reshape(m, 3, m, 3).transpose(0, 2, 1, 3) / size
        alone = np.einsum("jjaa->ja", joint)
        expected = alone[:, None, :, None] * alone[None, :, None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain += size * np.where(joint > 0, joint * np.log(joint / expected), 0).sum(axis=(2, 3))
    parent, root = np.full(m, -1), np.arange(m)
    links: dict[int, list[int]] = {}
    # Eight more parameters a pair: the price of the Bayesian information criterion.
    pairs = [(gain[j, k], j, k) for j in range(m) for k in range(j) if gain[j, k] > 4 * math.log(max(2.0, total))]
    for _, j, k in sorted(pairs, reverse=True):
        if root[j] != root[k]:
            root[root == root[j]] = root[k]
            links.setdefault(j, []).append(k)
            links.setdefault(k, []).append(j)
    for top in range(m):
        todo = [top] if parent[top] < 0 and top == min(np.flatnonzero(root == root[top])) else []
        while todo:
            j = todo.pop()
            for k in links.get(j, ()):
                if k != parent[j]:
                    parent[k] = j
                    todo.append(k)
    return parent


def label_model(votes: np.ndarray, weight: np.ndarray, first: np.ndarray, gold: np.ndarray | float = 0.0, rounds: int = 100, structures: int = 2) -> LabelModel:
    """EM over all rows; correlations are chosen from the first beliefs, then once more: without them voters that copy one
    another would outvote the class.

    ``first`` is the first belief (not a number: none yet), which tells the classes apart; rows without one get theirs
    from what the others give. ``gold`` is added to every row's log odds in each step.
    """
    parent, has = np.full(votes.shape[1], -1), ~np.isnan(first)
    p = np.where(has, first, maximise(votes[has], first[has], weight[has], parent).posterior(votes))
    for _ in range(structures):
        parent = correlations(votes, p, weight)
        for _ in range(rounds):
            new = maximise(votes, p, weight, parent).posterior(votes, gold)
            moved, p = np.abs(new - p).max(), new
            if moved < 1e-6:
                break
    return maximise(votes, p, weight, parent)


def linear_classifier(at: list[np.ndarray], posterior: np.ndarray, weight: np.ndarray, n: int, rounds: int = 600, l2: float = 1e-5):
    """Logistic regression on posterior labels (Adam, full batch); ``(bias, weights)``, the bias as entry n."""
    row = np.repeat(np.arange(len(at)), [len(a) + 1 for a in at])
    col = np.concatenate([np.r_[a, n] for a in at])
    weight = weight / weight.sum()
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[col], minlength=len(at))
        err = (1 / (1 + np.exp(-z.clip(-30, 30))) - posterior) * weight
        g = np.bincount(col, weights=err[row], minlength=n + 1) + l2 * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[n], w[:n]


# -- Spark ----------------------------------------------------------------------------------------------------------


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice: the weight of toxic and of clean texts that have a feature. Columns: text, p (toxic), weight."""
    for batch in batches:
        for b in byte_slices(batch, 0, 8 << 20):
            counts: dict[bytes, list[float]] = {}
            for text, p, weight in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for f in features(text.as_py()):
                    c = counts.setdefault(f, [0.0, 0.0])
                    c[0] += weight * (1 - p)
                    c[1] += weight * p
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.binary()), *(pa.array([c[k] for c in counts.values()], pa.float64()) for k in (0, 1))],
                ["feature", "clean", "toxic"],
            )


def _lists(make, shared):
    """``rid, at``: a list of numbers for every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [make(shared.value, t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["rid", "at"])

    return run


def _surprise(toxic, clean, n_toxic: float, n_clean: float):
    """G statistic of a feature's counts against the class sizes, negative if it leans to clean texts."""
    n, share = toxic + clean, n_toxic / (n_toxic + n_clean)

    def part(k, q: float):
        return F.when(k > 0, k * F.log(k / (n * F.lit(q)))).otherwise(0.0)

    g = 2 * (part(toxic, share) + part(clean, 1 - share))
    return F.when(toxic > n * F.lit(share), g).otherwise(-g)


def _telling(rows: DataFrame, tag: str) -> list[tuple[bytes, float]]:
    """Features that lean to a class beyond the chance of the best of all of them, with their toxic share; ``rows (text, p, weight)``."""
    n_toxic, n_clean = rows.agg(F.sum(F.col("weight") * F.col("p")), F.sum(F.col("weight") * (1 - F.col("p")))).first()
    counts = rows.mapInArrow(_mine, "feature binary, clean double, toxic double").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    counts = materialise(counts.withColumn("g", _surprise(F.col("toxic"), F.col("clean"), n_toxic, n_clean)), tag)
    chance = 2 * math.log(max(2, counts.count()))
    best = counts.where(F.abs("g") > chance).orderBy(F.desc(F.abs("g")), "feature").collect()
    return [(bytes(r["feature"]), r["toxic"] / (r["toxic"] + r["clean"])) for r in best]


def _drawn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, unlabelled: int) -> tuple[DataFrame, dict]:
    """``rid, text, toxic (null: unlabelled), weight`` and rows by class: rows drawn by hash of the id, a row of many near copies weighs less.

    Near copies are rows that share four min-hashes of their runs of five words.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64("id")
    drawn = [known.where(F.col("toxic") == c).withColumn("place", place).orderBy("place", "id").limit(per_class) for c in (0, 1)]
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    others = base.select("id").join(labels.select(F.col(id_col).alias("id")), "id", "left_anti")
    others = others.distinct().withColumn("place", place).orderBy("place", "id").limit(unlabelled).withColumn("toxic", F.lit(None).cast("int"))
    ids = materialise(drawn[0].unionByName(drawn[1]).unionByName(others).select("id", "toxic"), "toxicity-ids")
    rows = base.join(F.broadcast(ids), "id")
    words = F.split(F.lower("text"), r"\s+")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(5)), " "))
    rows = rows.withColumn("w", words).withColumn("g", F.transform(grams, lambda g: F.xxhash64(g)))
    least = [F.array_min(F.transform("g", lambda h, k=k: F.xxhash64(F.lit(k), h))) for k in range(4)]
    rows = rows.withColumn("kind", F.xxhash64(*least)).drop("w", "g")
    rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "toxicity-rows")
    got = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    share = F.lit(1.0)
    for c in (0, 1):  # a class that was drawn in part stands for the whole
        share = F.when(F.col("toxic") == c, sizes.get(c, 0) / max(1, min(sizes.get(c, 0), per_class))).otherwise(share)
    rows = rows.withColumn("share", share).withColumn("cls", F.coalesce("toxic", F.lit(-1)))
    copies = rows.groupBy("cls", "kind").agg(F.count("*").alias("copies"))
    out = rows.join(copies, ["cls", "kind"]).select("rid", F.col("text").cast("binary").alias("text"), "toxic", (F.col("share") / F.col("copies")).alias("weight"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: Spark would make one task of them
    return materialise(out.repartition(tasks, "rid"), "toxicity-sample"), got


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = 6000,
    unlabelled: int = 12_000,
    gold: bool = True,
    trust: float = 0.999,
    share: float = 0.01,
) -> Model:
    """Fit on at most ``per_class`` labelled rows of either class and ``unlabelled`` others, whole texts, drawn by hash.

    Labels choose the words that vote, tell the classes apart and are compared with what votes alone say (``check``).
    With ``gold`` a labelled row has one more voter, right with probability ``trust``. An unlabelled row weighs ``share``
    of a labelled one for the classifier. Rows of ``labels`` with a null or other label are ignored, of repeated ones
    the larger label counts; labels without a document have no say. With rows of one class only the model is constant, with none all is clean.
    Null text counts as empty; repeated documents count as often as they stand, near copies share one weight. Extra
    columns of either table are ignored.
    """
    spark = docs.sparkSession
    sample, got = _drawn(docs, labels, id_col, text_col, label_col, per_class, unlabelled)
    if not got.get(0) or not got.get(1):
        return Model(30.0 if got.get(1) else -30.0, {})
    labelled = sample.where("toxic is not null")
    mined = _telling(labelled.select("text", F.col("toxic").cast("double").alias("p"), "weight"), "toxicity-lexicon")
    n_toxic, n_all = labelled.agg(F.sum(F.col("weight") * F.col("toxic")), F.sum("weight")).first()
    lean = [f for f, share in mined if share >= PRECISE and b"#" not in f], [f for f, share in mined if share < n_toxic / n_all and b"#" not in f]
    # Forms of a word are one voter, as they say the same.
    roots = [{r: k % GROUPS for k, r in enumerate(dict.fromkeys(f[: STARTS[0]] for f in side))} for side in lean]
    groups = min(GROUPS, max(1, *map(len, roots)))
    voters = Voters(*({f: of[f[: STARTS[0]]] for f in side} for side, of in zip(lean, roots)), groups)
    texts = sample.select("rid", "text")
    coded = texts.mapInArrow(_lists(Voters.votes, spark.sparkContext.broadcast(voters)), "rid long, at array<int>").toArrow()
    rows = sample.select("rid", "toxic", "weight").toArrow()
    order, back = np.argsort(coded["rid"].to_numpy()), np.argsort(rows["rid"].to_numpy())
    rid = coded["rid"].to_numpy()[order]
    votes = np.stack(coded["at"].combine_chunks().flatten().to_numpy().reshape(-1, len(voters)))[order].astype(np.int8)
    toxic = rows["toxic"].to_numpy(zero_copy_only=False)[back].astype(np.float64)  # not a number where unlabelled
    weight = rows["weight"].to_numpy()[back]
    has = ~np.isnan(toxic)
    sure = math.log(trust / (1 - trust))
    say = np.where(has, sure * (2 * np.nan_to_num(toxic) - 1), 0.0) if gold else 0.0
    estimated = label_model(votes, weight, np.where(toxic == 1, TRUST, np.where(toxic == 0, 1 - TRUST, np.nan)), say)
    p = estimated.posterior(votes, say)
    check = float(np.average((estimated.posterior(votes[has]) > 0.5) == (toxic[has] == 1), weights=weight[has]))
    posterior = spark.createDataFrame(pa.table({"rid": rid, "p": p}))
    counted = F.when(F.col("toxic").isNull(), F.lit(share)).otherwise(F.lit(1.0)) * F.col("weight")
    soft = sample.join(F.broadcast(posterior), "rid").select("text", "p", counted.alias("weight"))
    names = [f for f, _ in _telling(soft, "toxicity-features")]
    index = {f: i for i, f in enumerate(names)}

    def known(index: dict[bytes, int], text: bytes) -> list[int]:
        return sorted(index[f] for f in features(text) if f in index)

    coded = texts.mapInArrow(_lists(known, spark.sparkContext.broadcast(index)), "rid long, at array<int>").toArrow()
    order = np.argsort(coded["rid"].to_numpy())
    at = [np.array(coded["at"][int(i)].as_py(), np.int64) for i in order]
    bias, weights = linear_classifier(at, p, np.where(has, weight, share * weight), len(names))
    edges = [(int(k), j) for j, k in enumerate(estimated.parent) if k >= 0]
    return Model(float(bias), {f: float(w) for f, w in zip(names, weights)}, estimated.accuracies(votes, weight), edges, check)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for b in batches:
            z = np.array([model.logit(t.as_py()) for t in b.column(b.num_columns - 1)])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(1 / (1 + np.exp(-z.clip(-500, 500))))], [*b.schema.names[:-1], "score"]
            )

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` (without the text) plus ``score`` from 0 to 1 of every whole text.

    Null counts as the empty text, which gets the score of no evidence. A column of that name in any case is replaced; repeated rows
    are rows of their own; an empty table gives none.
    """
    plain = [c for c in docs.columns if c != text_col and c.lower() not in ("score", "__bytes")]
    rows = docs.select(*plain, text_of(text_col).cast("binary").alias("__bytes"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(shared), docs.select(*plain, F.lit(0.0).alias("score")).schema)


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose labels may be learned; the others are held out."""
    return labels.where(crc_mod(id_col, 3) != 1)
