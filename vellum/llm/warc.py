"""WARC 1.1: writing pages as archives, and reading archives back with segment reassembly.

*Writing.* Each page becomes a record: ``response``, or ``revisit`` if another page with an equal payload and a
larger id holds it. The HTTP block carries the payload in chunked transfer framing. A block over
``segment_bytes`` is cut: the first record has ``WARC-Segment-Number: 1``, ``continuation`` records follow with
``WARC-Segment-Origin-ID``, and the last gives ``WARC-Segment-Total-Length``. Records go to files through Spark's own
text sink, as raw bytes with the record's trailing CRLF as line separator: any file system works, and
task output is committed, so a lost executor leaves no half archive. Files roll by records, of which even the
largest make no more than ``file_bytes``. A revisit names the record id of its response in ``WARC-Refers-To``, and its page in a
header of our own; where rows repeat the response, so that several records are it, only the latter.

*Reading.* Archives are parsed by ``Content-Length``. Segments are grouped by their origin, put in order of their
number, and checked: numbers without a gap or repeat, and the total length. Whole blocks are
split into HTTP head and body, chunked bodies are decoded, and payloads are checked against their digest. A
group is one page's payload, whatever the size of the table.

Cases: a null html is an empty payload; a null url has no target; a null ``page_id`` is its own value and refers to
none; rows that repeat the largest id of a payload are all responses (so are those that tie in it); a very long html is
cut into segments; an empty table gives no records; other columns are ignored. A broken record, a missing segment, a wrong length or digest raises an error naming the record.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bound_batches

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, page_id long, record_type string, refers_to long, digest string, origin_id string, segment int, total_length long, block binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk doesn't end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    """A record up to, and without, the last CRLF of its end."""
    lines = [f"{k}: {v}" for k, v in headers if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + CRLF


def page_record_id(page_id: int, digest: str) -> str:
    """The record id of a response that others may refer to."""
    return f"<urn:vellum:page:{page_id}:{digest}>"


def page_records(uid: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, held_once: bool, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page. ``refers_to``: the page that holds an equal payload, or None; ``held_once``: one record is that page's, or this is it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = http + (chunked(payload, chunk_bytes) if refers_to is None else b"")
    digest = base32_sha1(payload)
    name = lambda n: f"<urn:vellum:record:{uid}:{n}>"
    first = page_record_id(page_id, digest) if held_once and refers_to is None else name(1)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    common = [("WARC-Target-URI", target), ("WARC-Date", DATE), ("Content-Type", "application/http;msgtype=response")]
    own = [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id)]
    if refers_to is not None:
        to = page_record_id(refers_to, digest) if held_once else None
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(1)), *common, *own, ("WARC-Profile", PROFILE), ("WARC-Refers-To", to), ("X-Refers-To-Page", refers_to)], block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for n, part in enumerate(parts, 1):
        headers = [("WARC-Type", "continuation" if n > 1 else "response"), ("WARC-Record-ID", name(n) if n > 1 else first), *common]
        headers += own if n == 1 else [("WARC-Segment-Origin-ID", first)]
        if len(parts) > 1:
            headers += [("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)]
        yield record(headers, part)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its Content-Length says")
        yield headers, data[start:stop]
        at = stop + 4


def winners(pages: DataFrame, ws: Workspace, least: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to, held_once``: ``refers_to`` is null for the largest id of equal payloads and for those under ``least`` bytes."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    # the long digest stands for the payload: equal payloads are found by 256 bits and their length
    key = F.concat_ws("/", F.octet_length(html).cast("string"), F.sha2(html, 256))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("_key", key)
    each = rows.where(F.octet_length("html") >= least).groupBy("_key", "page_id").agg(F.count(F.lit(1)).alias("rows"))
    shared = each.groupBy("_key").agg(F.max(F.struct("page_id", "rows")).alias("first"), F.sum("rows").alias("n")).where("n > 1")
    shared = ws.write(shared.select("_key", F.col("first.page_id").alias("first_id"), (F.col("first.rows") == 1).alias("held_once")), "equal")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(shared, "_key", "left").select("page_id", "url", "html", refers.alias("refers_to"), F.coalesce(F.col("held_once") & F.col("first_id").isNotNull(), F.lit(False)).alias("held_once"))


def write_archives(pages: DataFrame, path: str, ws: Workspace, least: int = 0, segment_bytes: int = 16384, chunk_bytes: int = 4096, file_bytes: int = 64 << 20) -> None:
    """Writes ``pages`` (``page_id, url, html``) as WARC files below ``path``."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[bytes] = []
            for page_id, url, html, refers_to, once in zip(*[batch[c] for c in ("page_id", "url", "html", "refers_to", "held_once")], strict=True):
                n += 1
                whole = lambda v: None if pd.isna(v) else int(v)
                out += page_records(f"{task}-{n}", whole(page_id), url, html.encode(), whole(refers_to), once, segment_bytes, chunk_bytes)
                if len(out) >= 1000:
                    yield pd.DataFrame({"record": out})
                    out = []
            yield pd.DataFrame({"record": out})

    bound_batches(pages.sparkSession)
    texts = winners(pages, ws, least).withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    # bytes pass through the string type unchanged, and the sink writes them as they are
    records = texts.mapInPandas(encode, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n").option("maxRecordsPerFile", max(1, file_bytes // (segment_bytes + 1024))).text(path)


def read_records(spark: SparkSession, path: str, most: int = 1 << 30) -> DataFrame:
    """One row for each record. An archive is parsed in one piece, so one over ``most`` bytes is an error."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for h, block in parse(content):
                    digest = h.get("warc-payload-digest", "")
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    rows.append((h["warc-record-id"], number("x-page-id"), h["warc-type"], number("x-refers-to-page"), digest.removeprefix("sha1:") or None, h.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), block))
                    if len(rows) >= 1000:
                        yield _frame(rows, names)
                        rows = []
                yield _frame(rows, names)

    files = spark.read.format("binaryFile").load(path)
    size = F.when(F.col("length") > most, F.raise_error(F.lit(f"an archive is larger than {most} bytes"))).otherwise(F.col("content"))
    return files.select(size.cast("binary").alias("content")).mapInPandas(decode, RECORD)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "segment": "Int32", "total_length": "Int64"})


def reassemble(records: DataFrame) -> DataFrame:
    """Whole ``response`` and ``revisit`` records: those in segments joined, in order, with their total length checked."""
    whole = records.where("segment IS NULL")
    key = F.coalesce("origin_id", "record_id").alias("record_id")
    parts = records.where("segment IS NOT NULL").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("page_id", "record_type", "refers_to", "digest")],
        F.max("total_length").alias("total_length"),
    )
    fields = ["record_id", "page_id", "record_type", "refers_to", "digest", "total_length"]
    one = F.array(F.struct(F.lit(1).alias("segment"), F.col("block")))
    return whole.select(*fields, one.alias("parts")).unionByName(parts.select(*fields, "parts"))


def join_parts(name: str, numbers: list[int], blocks: list[bytes], total: int | None) -> bytes:
    if numbers != list(range(1, len(numbers) + 1)):
        raise ValueError(f"{name}: segments {numbers}")
    block = b"".join(blocks)
    if len(numbers) > 1 and total is None:
        raise ValueError(f"{name}: the last segment is missing")
    if total is not None and len(block) != total:
        raise ValueError(f"{name}: {len(block)} bytes, {total} declared")
    return block


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, decoded if it is chunked."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head) else body


def decode_payloads(whole: DataFrame, with_payload: bool = False) -> DataFrame:
    """``record_id, page_id, record_type, refers_to, payload_digest, payload_bytes`` (null for revisits), and the payload if asked for."""
    schema = "record_id string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * with_payload

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, payloads = [], []
            for name, kind, digest, total, parts in zip(batch["record_id"], batch["record_type"], batch["digest"], batch["total_length"], batch["parts"], strict=True):
                block = join_parts(name, [p["segment"] for p in parts], [p["block"] for p in parts], None if pd.isna(total) else int(total))
                payload = payload_of(block) if kind == "response" else None
                if payload is not None and digest is not None and base32_sha1(payload) != digest:
                    raise ValueError(f"{name}: the payload doesn't have its digest")
                sizes.append(None if payload is None else len(payload))
                payloads.append(payload)
            out = batch[["record_id", "page_id", "record_type", "refers_to"]].astype({"page_id": "Int64", "refers_to": "Int64"})
            out["payload_digest"], out["payload_bytes"] = batch["digest"], pd.array(sizes, "Int64")
            if with_payload:
                out["payload"] = payloads
            yield out

    return whole.select("record_id", F.col("page_id").cast("string").alias("page_id"), "record_type", F.col("refers_to").cast("string").alias("refers_to"), "digest", F.col("total_length").cast("string").alias("total_length"), "parts").mapInPandas(decode, schema)


def round_trip(pages: DataFrame, **params) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    write_archives(pages, ws.path("archives"), ws, **params)
    found = ws.write(decode_payloads(reassemble(read_records(spark, ws.path("archives")))), "found")
    ws.drop("archives", "equal")
    held = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("_held"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    # only pages that another refers to have to be joined, and only revisits look them up
    held = ws.write(held, "held")
    ws.keep("found", "held")
    revisits = found.where("record_type = 'revisit'").join(held, (F.col("refers_to") == F.col("_held")) & (F.col("payload_digest") == F.col("_digest")), "left").withColumn("payload_bytes", F.col("_bytes"))
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.where("record_type <> 'revisit'").select(*fields).unionByName(revisits.select(*fields))


def base32_of(hex_digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1, without Python: 5 hexadecimal digits are 4 of base32."""
    group = lambda i: F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.lower(F.concat(*[group(i) for i in range(8)])), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


#: DuckDB SQL for the rows of ``round_trip`` over ``pages``.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages),
d AS (SELECT page_id, h, m, list_transform(range(8), lambda i: CAST('0x' || substr(sha1(h), CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER)) AS v FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(v, lambda x: {" || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> {b}) % 32 + 1, 1)" for b in (15, 10, 5, 0))}), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM d
"""
