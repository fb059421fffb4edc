"""Byte-pair counts against the library of the same vocabulary, where both are there."""

import base64
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tracelake.functions import bpe
from tracelake.operators import chunking
from tracelake.plans.document_queries import VOCABULARY

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def ranks():
    with open(VOCABULARY, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges(ranks, encoding):
    rnd = random.Random(1)
    for _ in range(2000):
        piece = "".join(rnd.choice("aabcdehtéß漢1x") for _ in range(rnd.randrange(1, 40))).encode()
        want = [encoding.decode_single_token_bytes(t) for t in encoding._encode_single_piece(piece)]
        assert bpe.merged(piece, ranks) == want


def test_long_piece_is_not_quadratic(ranks):
    began = time.perf_counter()
    tokens = bpe.merged(b"xyzzy" * 100_000, ranks)
    assert b"".join(tokens) == b"xyzzy" * 100_000 and time.perf_counter() - began < 10


def test_counts_of_texts(spark, encoding):
    rnd = random.Random(5)
    texts = [None, "", " ", "\n\n  x", "it's they'll", "a b  c\t\td \n", "x" * 5000, "漢字 😀 é́", "1234 5,6"]
    texts += ["".join(rnd.choice("ab 1\n\t.'sé漢") for _ in range(60)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    counts = bpe.counter(spark, VOCABULARY)
    got = {r.k: r.n for r in df.select("k", bpe.count(counts, F.col("text")).alias("n")).collect()}
    assert got == {k: len(encoding.encode_ordinary(t or "")) for k, t in enumerate(texts)}


def test_chunks_by_tokens_of_the_vocabulary(spark, encoding):
    code = "".join(f"int value_{k} = compute({k}, 'é');\n" for k in range(60))
    files = spark.createDataFrame([("f", code), ("e", ""), ("n", None)], "file string, content string")
    got = chunking.token_budget_chunks(files, 100, line_tokens=bpe.counter(spark, VOCABULARY)).collect()
    lines = [f"{k}: {t}" for k, t in enumerate(code.splitlines(), 1)]
    sizes = [len(encoding.encode_ordinary(x)) for x in lines]
    want, room = [], 0
    for k, n in enumerate(sizes, 1):
        if want and n <= room:
            want[-1][1], room = k, room - n
        else:
            want.append([k, k])
            room = 100 - n
    assert sorted((r.start_line, r.end_line) for r in got) == sorted(map(tuple, want))


def test_broken_vocabulary(spark, tmp_path):
    (tmp_path / "v").write_text("YQ== 0\nYg== x\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(spark, str(tmp_path / "v"))
