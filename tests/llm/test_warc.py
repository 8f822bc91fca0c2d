import base64
import gzip
import hashlib
import io
import zlib

import pytest
from pyarrow import fs

from conftest import SF
from spanloom.llm import queries, warc

HARD = [
    (1, "http://a/b c\r\nX: y", "<p>one</p>"),
    (2, None, None),
    (3, "http://x", ""),
    (4, "http://y", "<p>one</p>"),
    (5, "http://z", "é" * 100_000 + "\r\n\r\nWARC/1.1\r\n"),
    (6, "http://z", "<p>two</p>"),
    (7, "", "<p>one</p>"),
    (7, "", "<p>one</p>"),
    (9, "u", "<p>nine</p>"),
    (9, "u", "<p>nine</p>"),
    (None, "u", "gone"),
]


def want(rows, least=0):
    out, first = [], {}
    rows = [(p, (h or "").encode()) for p, _, h in rows if p is not None]
    for p, h in rows:
        if len(h) >= least:
            first[h] = min(p, first.get(h, p))
    for p, h in rows:
        refers = first[h] if len(h) >= least and first[h] != p else None
        out.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, "x") for r in HARD], "page_id long, url string, html string, payload string")
    index = warc.archive(pages, least)
    read = warc.read_records(index)
    assert sorted((tuple(r) for r in warc.page_rows(read).collect()), key=str) == want(HARD, least)
    payloads = {r.record_id: bytes(r.payload) for r in read.collect() if r.type == "response"}
    assert payloads["<urn:page:5>"] == HARD[4][2].encode()
    assert warc.read_records(warc.archive(pages.where("false"))).count() == 0
    for file in {r.file for r in index.collect()}:  # members stand alone, and together are a plain gzip file
        store, at = fs.FileSystem.from_uri(file)
        data = store.open_input_file(at).read()
        rows = sorted((r.offset, r.length) for r in index.where(f"file = '{file}'").collect())
        assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:])) and sum(rows[-1]) == len(data)
        assert gzip.decompress(data) == b"".join(zlib.decompress(data[a : a + n], 31) for a, n in rows)
        assert len(store.open_input_file(at + ".idx").read().splitlines()) == len(rows)


def test_query(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op7_warc(spark, SF).collect()), key=str) == want(rows)


def test_any_members_and_bad_streams():
    one, two = warc.record(1, "u", b"abc", "D", None, "t"), warc.record(2, "u", b"", "D", 1, "t")
    for data in (gzip.compress(one + two), gzip.compress(one) + gzip.compress(two), gzip.compress(one + b"\r\n" + two)):
        out = io.BytesIO()
        rows = list(warc.rewrite(io.BytesIO(data), out))
        assert [zlib.decompress(out.getvalue()[a : a + n], 31) for a, n, _ in rows] == [one, two]
    with pytest.raises(ValueError):
        list(warc.rewrite(io.BytesIO(gzip.compress(one[:-10])), io.BytesIO()))


def test_ids_beyond_the_exact_doubles(spark):
    one = 2**53 + 1
    pages = spark.createDataFrame([(one, "http://a.b/", "same"), (one + 2, "http://a.b/", "same"), (5, "http://a.b/", "other")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.page_rows(warc.read_records(warc.archive(pages))).collect()}
    assert got == {one: None, one + 2: one, 5: None}
