"""Helpers of Arrow batches: small parts of large batches, and workers whose memory is not that of the batch."""

import io
import zipfile

import pyarrow as pa

from tracelake.functions.batches import PART, parts
from tracelake.operators import blocks, chunking, requirements
from tracelake.plans import package_queries
from tracelake.sources import docx


def test_parts_keep_all_rows():
    texts = ["x" * n for n in (0, 3 * PART, 5, 0, PART)] + ["y" * 1000] * 5000 + [None]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"])
    got = list(parts([batch, batch.slice(0, 0), batch]))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch, batch]))
    assert len(got) > 10 and list(parts([])) == []
    assert [p.num_rows for p in parts([batch.slice(1, 1)])] == [1]


def package(k):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        body = f"<w:p><w:r><w:t>{k} {'x' * 2000}</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>"
        z.writestr("word/document.xml", f"<w:document {package_queries.SPACES}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Type="t/image" Target="media/i.png"/></Relationships>')
        z.writestr("word/media/i.png", b"i")
    return data.getvalue()


def test_helpers_answer_in_parts():
    """Of a batch of several parts no helper makes all rows before it gives the first ones; all of them come, in order."""
    n = 3000
    ids = pa.array([f"d{k}" for k in range(n)])
    files = pa.record_batch([ids, pa.array([package(k) for k in range(n)])], ["path", "content"])
    text = pa.array(["| a | b |\n|---|---|\n" + "| c | d |\n" * 100] * n)
    none = pa.array([[]] * n, pa.list_(pa.string()))
    made = pa.record_batch([ids, text, text, text], ["path", "body", "links", "image"])
    lined = pa.record_batch([ids, pa.array([["x" * 1000]] * n), pa.array([[1]] * n, pa.list_(pa.int32()))], ["file", "lines", "counts"])
    for helper, batch in (
        (docx._read, files), (docx._relations, files), (docx._cells, files), (docx._media_bytes, files), (package_queries._packages, made), (chunking._chunks(9), lined),
        (requirements._points, pa.record_batch([ids, text, none], ["doc", "text", "formulas"])), (requirements._blocks, made.select(["path", "body"])), (blocks._trees, made.select(["path", "body"])),
    ):
        got = list(helper(iter([batch])))
        assert 1 < len(got) < n
        assert list(dict.fromkeys(x for b in got for x in b.column(0).to_pylist())) == ids.to_pylist()
