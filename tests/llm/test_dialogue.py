"""Conversation repair against a search over all edits, on nulls, ties, repeats and conversations cut by partitions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tracelake.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def faults(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns):
    """Cost, audit and repaired lines by dynamic programming over (state, cost, audit, lines), one turn at a time."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    names = {"u": "user", "a": "assistant"}

    def put(ways, state, way):
        if state not in ways or way[:2] < ways[state][:2]:
            ways[state] = way

    def inserted(ways):
        ways = dict(ways)
        for _ in range(4):
            for (state, (cost, audit, lines)), x in itertools.product(list(ways.items()), "ua"):
                if (state, x) in step:
                    put(ways, step[state, x], (cost + 5, audit + "I", [*lines, names[x] + ":"]))
        return ways

    ways = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(turns, faults(turns)):
        after = {}
        for state, (cost, audit, lines) in inserted(ways).items():
            put(after, state, (cost + 2, audit + "D", lines))
            if fault in ("", "t"):
                more = 5 if fault else 0
                if (state, role[:1]) in step:
                    put(after, step[state, role[:1]], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                for x in "ua":
                    if (state, x) in step:
                        put(after, step[state, x], (cost + 1 + more, audit + "R", [*lines, f"{names[x]}:{text}"]))
        ways = after
    return min((w for s, w in inserted(ways).items() if s in ("", "a")), key=lambda w: w[:2])


def brute(rows):
    convs = {r[0]: [] for r in rows}
    for r in damage(rows):
        convs[r[0]].append(r)
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        numbers = [r[1] for r in turns if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(turns)
        f = faults(turns)
        yield c, gaps, f.count("b"), f.count("d"), f.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def order(r):
    return r[0] is not None, r[0] or 0


def repaired(df):
    return sorted((tuple(r) for r in dialogue.repair(dialogue.damaged(df)).collect()), key=order)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [
        (rnd.choice([1, 1, 1, 2, None, 3, *range(10, 60)]), rnd.choice([None, *range(40)]), rnd.choice(["user", "assistant", "system", "tool", "", None]), rnd.choice(["a.", "b", "", None, "c!", "d?", " \t", "e.\n", "é。", "\u2028", "f.\u0085", " \u2029\n"]))
        for _ in range(700)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(brute(rows), key=order)
    assert repaired(df) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "30")  # conversation 1 lies in many partitions
    try:
        assert repaired(df) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_every_short_conversation():
    """All sequences of up to five symbols: the tree of matrices finds what the search finds, and its audit is allowed."""
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in range(5):
        for symbols in itertools.product("suaodUA", repeat=n):
            turns = [(1, k, roles.get(x.lower(), "user"), "" if x == "d" else f"t{k}" + ("" if x.isupper() else ".")) for k, x in enumerate(symbols)]
            assert dialogue.best(dialogue.span("".join(symbols))) == cheapest(turns)[:2]


def test_products_are_associative():
    rnd = random.Random(5)
    for _ in range(50):
        x, y, z = (dialogue.span("".join(rnd.choices("suaodSUAO", k=rnd.randrange(40)))) for _ in range(3))
        plus = dialogue._plus
        assert plus(plus(x, y), z) == plus(x, plus(y, z))


def test_long_conversation(spark):
    """One conversation of 30,000 turns in many partitions; its repeats are one row."""
    df = spark.range(30_000).selectExpr("7L AS conv", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "if(id % 5 = 0, 'same', concat('t', id, '.')) AS text", "1L AS copies")
    got = dialogue.repair(df).collect()
    assert len(got) == 1 and got[0]["gaps"] == 0 and got[0]["truncated"] == 2 and got[0]["duplicate"] == 5998
    turns = [(7, k, ("user", "assistant")[k % 2], "same" if k % 5 == 0 else f"t{k}.") for k in range(1000)]
    short = dialogue.repair(df.where("turn < 1000")).first()
    cost, audit, lines = cheapest(turns)
    assert (short["cost"], short["audit"]) == (cost, audit)
    assert short["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    copies = dialogue.repair(spark.createDataFrame([(1, 0, "user", "a.", 5000), (2, 0, "user", "b.", 0)], "conv long, turn long, role string, text string, copies long"))
    rows = {r["conv"]: r for r in copies.collect()}
    assert (rows[1]["duplicate"], rows[1]["illegal"], rows[1]["cost"]) == (4999, 4999, 10_000)  # all go: cheaper than keeping one and its answer
    assert (rows[2]["audit"], rows[2]["cost"], rows[2]["repaired_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest())


def test_empty_table_extra_columns_and_long_texts(spark):
    none = spark.createDataFrame([], SCHEMA + ", conv string, audit string, copies int, edge int")
    assert dialogue.repair(dialogue.damaged(none)).collect() == []
    rows = [(1, 0, "user", "x" * 300_000 + "."), (1, 1, "assistant", "y.")]
    df = spark.createDataFrame([(*r, "c", "KK", 3, 1) for r in rows], SCHEMA + ", conv string, audit string, copies int, edge int")
    assert repaired(df) == sorted(brute(rows), key=order)
