"""The registered queries over the smallest tables: SQL where there is one, else columns and digests by brute force."""

import hashlib
import os
import re
import zlib

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tracelake.llm import queries, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_katz": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op4_simhash": "doc_id fingerprint component_id",
    "op5_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op6_langid": "doc_id held_out lang_pred score",
    "op7_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op9_mixing": "doc_id size source_size target taken",
    "op10_html_text": "page_id url text n_chars",
    "op11_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op12_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_spotsigs": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: q(spark, SF).toPandas() for name, q in queries.QUERIES.items()}


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")


def rest(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(results, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.execute(queries.ORACLE_SQL[name]).fetchdf()
    cols = COLUMNS[name].split()
    assert list(want.columns) == cols

    def plain(df):
        rows = df[cols].astype(object).itertuples(index=False)
        return sorted(repr(tuple(None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in r)) for r in rows)

    assert plain(results[name]) == plain(want)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(results, name):
    cols = COLUMNS[name].split()
    assert list(results[name].columns)[: len(cols)] == cols
    table = {"page_id": "pages", "conv_id": "conversations"}.get(cols[0], "documents")
    ids = pd.read_parquet(f"{SF}/{table}.parquet")[cols[0]]
    assert sorted(results[name][cols[0]]) == sorted(set(ids) if cols[0] == "conv_id" else ids)


@pytest.mark.parametrize("name, n, held", [("op1_katz", 5, 1), ("op2_toxicity", 3, 1), ("op6_langid", 4, 2)])
def test_held_out_rows(results, name, n, held):
    got = results[name]
    assert list(got["held_out"]) == [rest(i, n) == held for i in got["doc_id"]]


def test_katz_totals(results, docs):
    train = sum(len(re.findall(r"[^ \t-\r]+", t or "")) + 1 for i, t in docs["text"].items() if rest(i, 5) != 1)
    assert set(results["op1_katz"]["train_tokens"]) == {train}


def test_predicted_follows_the_score(results):
    got = results["op2_toxicity"]
    assert (got["predicted"] == (got["score"] >= 0.7)).all() and got["score"].between(0, 1).all()


def test_labels_held_out_are_not_learned(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert not any(rest(r["doc_id"], 3) == 1 for r in toxicity.learnable(labels).collect())


def test_base_digest(results, docs):
    for r in results["op5_secret_scan"].itertuples():
        base = [s for s in r.spans.split(",") if s and not s.startswith("owned")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        kinds = [s.split(":")[0] for s in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        want = [m for m in re.finditer(r"[0-9a-f]+", docs["text"].get(r.doc_id) or "") if len(m[0]) >= 16]
        assert r.n_hex == len(want)


def test_fingerprints_are_sixteen_digits(results):
    assert results["op4_simhash"]["fingerprint"].str.fullmatch("[0-9a-f]{16}").all()


def test_text_length(results):
    got = results["op10_html_text"]
    assert (got["text"].str.len() == got["n_chars"]).all()


def test_stages_and_sql():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [n for n, _ in corpus_pipeline.STAGES]
    assert corpus_pipeline.ORACLE_SQL is None
