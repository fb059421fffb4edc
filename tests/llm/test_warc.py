import gzip
import hashlib
import pathlib

from tracelake.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def pages():
    big, other = "<p>é" + "x" * 200, "y" * 100
    rows = [
        (5, "http://a/5", big, "c"), (3, "http://a/3", big, "c"), (9, None, big, "c"), (4, "http://b/ü\r\nX: y", other, "c"), (None, "http://n", big, "c"),
        (1, "u", None, "c"), (2, "u", "", "c"), (7, "u", "z" * 99, "c"), (8, "u", "z" * 99, "c"), (20, "u", "\r\n\r\nWARC/1.1\r\n" + "w" * 300, "c"),
    ]
    rows += [(100 + k, f"u{k}", f"{k}-" + "v" * 4000, "c") for k in range(40)]
    rows += [(50, "same", "q" * 150, "c")] * 3 + [(51, "same", "q" * 150, "c")]
    rows += [(60, "http://a/%41%2F?q=%20", "r" * 120, "c"), (61, ' sp"ace\n\u00e9 ', "s" * 120, "c"), (62, "", "t" * 120, "c"), (1 << 40, "far", "u" * 120, "c")]
    return rows


def expected(rows):
    out, first = [], {}
    for i, _, html, _ in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            first[html] = min(i, first.get(html, i))
    answered = set()
    for i, _, html, _ in rows:
        data = (html or "").encode()
        of = first.get(html)
        plain = len(data) < 100 or i == of and (i, html) not in answered
        answered.add((i, html))
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if plain else "revisit", None if plain else of))
    return sorted(map(repr, out))


def test_round_trip(spark, tmp_path):
    rows = pages()
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA), folder, shard_bytes=20_000, roll_bytes=1500)
    got = warc.read_archives(manifest, folder, with_payload=True).collect()
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(repr(tuple(r[f] for f in fields)) for r in got) == expected(rows)
    assert len({r["record_id"] for r in got}) == len(rows)
    assert sorted(map(repr, ((r["page_id"], r["url"]) for r in got))) == sorted(repr(r[:2]) for r in rows)
    payloads = {(r["page_id"], r["url"]): bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert payloads[(20, "u")] == rows[9][2].encode()
    listed = manifest.collect()
    assert len(listed) > 3 and max(m["seq"] for m in listed) > 0
    for m in listed:
        data = (tmp_path / "a" / m["file"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (m["n_bytes"], m["sha256"])
        assert gzip.decompress(data).startswith(b"WARC/1.1")
    assert not list(pathlib.Path(tmp_path / "a").glob(".tmp*"))
    # Shards are ranges of the id.
    ranges = {}
    for m in listed:
        ids = [int(x[11:]) for x in gzip.decompress((tmp_path / "a" / m["file"]).read_bytes()).split(b"\r\n") if x.startswith(b"X-Page-ID")]
        low, high = ranges.get(m["shard"], (1 << 60, -1))
        ranges[m["shard"]] = (min([low, *ids]), max([high, *ids]))
    spans = sorted(r for r in ranges.values() if r[1] >= 0)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_same_rows_same_bytes(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA)
    one, two = (warc.write_archives(x, f"file://{tmp_path}/{k}", shard_bytes=20_000) for k, x in enumerate((df, df.repartition(5))))
    names = [sorted((r["file"], r["sha256"]) for r in m.collect()) for m in (one, two)]
    assert names[0] == names[1]


def test_shards_hold_equal_bytes_and_every_file_is_a_task(spark, tmp_path):
    """Ids of which one is far out, and so many files that a task reads few of them."""
    rows = [(k if k else 1 << 50, f"u{k}", f"{k}-" + "v" * 500, "c") for k in range(200)]
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/m", shard_bytes=5000, roll_bytes=500)
    listed = manifest.collect()
    per_shard = {}
    for m in listed:
        per_shard[m["shard"]] = per_shard.get(m["shard"], 0) + m["n_records"]
    assert len(per_shard) > 30 and max(per_shard.values()) <= 6 and len(listed) > 60
    read = warc.read_archives(manifest, f"file://{tmp_path}/m")
    assert read.rdd.getNumPartitions() == len(listed)
    assert sorted(r["page_id"] for r in read.select("page_id").collect()) == sorted(r[0] for r in rows)


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    manifest = warc.write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert manifest.count() == 0 and warc.read_archives(manifest, folder).count() == 0
