import hashlib
import base64
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vellum.llm import warc
from vellum.llm.common import Workspace

PAGES = "page_id long, url string, html string"


def expected(rows):
    best = defaultdict(list)
    for i, _, html in rows:
        best[html or ""].append(i)
    out = []
    for i, _, html in rows:
        data, ids = (html or "").encode(), [x for x in best[html or ""] if x is not None]
        top = max(ids, default=None)
        revisit = len(best[html or ""]) > 1 and i != top and top is not None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/", "<p>é</p>"), (2, "http://b/ x\r\ny", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "x" * 100_000), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 0\r\n\r\n" * 3000),
    (7, "u", "\r\n\r\n"), (None, "u", "alone"), (8, "u", "漢字\U0001f600" * 9000), (9, "u", "漢字\U0001f600" * 9000), (9, "u", "漢字\U0001f600" * 9000), (None, "u", "<p>é</p>"), (2**53 + 1, "u", "big id"),
]


@pytest.mark.parametrize("params", [{}, {"segment_bytes": 1000, "chunk_bytes": 7777, "file_bytes": 10_000}])
def test_round_trip(spark, params):
    df = spark.createDataFrame(ROWS, PAGES).withColumns({"record": F.lit(1), "refers_to": F.lit(2)})
    got = warc.round_trip(df, **params)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS)


def test_payloads_and_segments(spark):
    ws = Workspace(spark, "t")
    warc.write_archives(spark.createDataFrame(ROWS, PAGES), ws.path("a"), ws, segment_bytes=500, chunk_bytes=300)
    records = warc.read_records(spark, ws.path("a"))
    assert records.where("record_type = 'continuation'").count() > 200
    shuffled = records.repartition(5, F.rand(3))
    found = {r["page_id"]: bytes(r["payload"]) for r in warc.decode_payloads(warc.reassemble(shuffled), True).where("record_type = 'response'").collect()}
    assert found[5] == b"x" * 100_000 and found[6] == ROWS[5][2].encode() and found[4] == b""
    broken = records.where("NOT (record_type = 'continuation' AND segment = 2)")
    with pytest.raises(Exception, match="segments"):
        warc.decode_payloads(warc.reassemble(broken)).collect()
    short = records.where("NOT (total_length IS NOT NULL AND page_id IS NULL)")
    with pytest.raises(Exception, match="last segment"):
        warc.decode_payloads(warc.reassemble(short)).collect()


def test_references_name_records(spark):
    ws = Workspace(spark, "t")
    warc.write_archives(spark.createDataFrame(ROWS, PAGES), ws.path("a"), ws)
    found = {}
    for r in spark.read.format("binaryFile").load(ws.path("a")).collect():
        for headers, _ in warc.parse(bytes(r["content"])):
            assert headers["warc-record-id"] not in found
            found[headers["warc-record-id"]] = headers
    revisits = [h for h in found.values() if h["warc-type"] == "revisit"]
    named = [h for h in revisits if "warc-refers-to" in h]
    assert len(revisits) > len(named) >= 3  # page 9 is there twice
    for h in named:
        to = found[h["warc-refers-to"]]
        assert (to["warc-type"], to["x-page-id"], to["warc-payload-digest"]) == ("response", h["x-refers-to-page"], h["warc-payload-digest"])
    assert {h["x-refers-to-page"] for h in revisits if "warc-refers-to" not in h} == {"9"}


def test_framing():
    for size in (1, 3, 1000):
        assert warc.dechunked(warc.chunked(b"hello world", size)) == b"hello world"
    assert warc.dechunked(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nhelloX\r\n0\r\n\r\n")
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    with pytest.raises(ValueError):
        list(warc.parse(b"nonsense"))
    with pytest.raises(ValueError):
        warc.join_parts("r", [1, 2], [b"a", b"b"], 3)


def test_digest(spark):
    text = "any text"
    got = spark.range(1).select(warc.base32_of(F.sha1(F.lit(text))).alias("d")).first()["d"]
    assert got == warc.base32_sha1(text.encode())


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
