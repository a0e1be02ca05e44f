"""WARC archives: writing response, revisit and continuation records, and reading them back.

Writing: every row becomes an HTTP response with a chunked body. A record block longer than
``segment_bytes`` is cut into segments: the first is the response itself (segment 1), the
others are continuation records that name it as their origin, the last one with the total
length. Among rows with equal payloads of at least ``min_revisit`` bytes the one with the
least id is the response; the others are revisit records that refer to it. Records are rows
of Spark's text writer, with the blank lines after a record as the line separator, so any
file system that Spark can write to holds the archives; a file has at most
``records_per_file`` records, each bounded by the segment length.

Reading: a file's records are parsed one after another by their Content-Length. Continuation
records and first segments are grouped by the origin's identifier (only these are
shuffled), ordered by segment number, checked for gaps and against the total length, joined,
and the chunked framing is decoded.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, scratch

SEPARATOR = "\r\n\r\n"
SEGMENT_BYTES = 16_384
_SENT_ROWS = 200_000  # of 80 bytes
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def record_id(page_id, digest: str) -> str:
    """A stable identifier of a row's record, from its id and payload digest."""
    h = hashlib.sha256(f"{'' if page_id is None else page_id}|{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    parts = []
    for s in range(0, len(payload), size):
        part = payload[s : s + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Decodes chunked framing; extensions and trailers are skipped. Raises ValueError on a broken frame."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size line is cut off")
        n = int(body[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("HTTP header is cut off")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _head(fields: list[tuple[str, object]]) -> bytes:
    clean = (f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + "".join(clean).encode() + b"\r\n"


def records(page_id, url, payload: bytes, digest: str, first_id, segment_bytes: int, date: str) -> list[bytes]:
    """The archive records of one row, without the separator after each."""
    own = record_id(page_id, digest)
    common = [("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", page_id)]
    kind = ("Content-Type", "application/http;msgtype=response")
    if first_id is not None and first_id != page_id:
        refers = record_id(first_id, digest)
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Refers-To", refers), ("X-Refers-To-Page-Id", first_id),
                  ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), kind]
        block = b"HTTP/1.1 200 OK\r\n\r\n"
        return [_head([*fields, ("Content-Length", len(block))]) + block]
    block = _HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        return [_head([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, kind, ("Content-Length", len(block))]) + block]
    out = []
    for n, s in enumerate(range(0, len(block), segment_bytes), 1):
        part = block[s : s + segment_bytes]
        total = len(block) if s + segment_bytes >= len(block) else None
        if n == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, kind]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{own}{n}", digest)), *common[:2], ("WARC-Segment-Origin-ID", own)]
        out.append(_head([*fields, ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total), ("Content-Length", len(part))]) + part)
    return out


def write_archive(
    pages: DataFrame,
    path: str,
    min_revisit: int = 100,
    segment_bytes: int = SEGMENT_BYTES,
    records_per_file: int = 2_000,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Writes ``pages`` (page_id, url, html; other columns are not archived) as gzipped WARC files.

    A null html has an empty payload; null ids and urls leave their header out. Where all ids
    of equal payloads are null, or rows repeat the least id, each of those rows is a response; a
    row with a null id beside others revisits theirs. Ids must be integers. An empty table writes
    an archive without records.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.where(F.octet_length("payload") >= min_revisit)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for r in batch.to_pylist():
                made = records(r["page_id"], r["url"], r["payload"], r["digest"], r["first_id"], segment_bytes, date)
                out += made
                held += sum(map(len, made))
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    first = cut(first)
    sent = F.broadcast(first) if first.count() <= _SENT_ROWS else first
    short = F.octet_length("payload") < min_revisit
    fields = ["page_id", "url", "payload", "digest", "first_id"]
    joined = rows.where(~short).join(sent, "digest", "left").select(*fields)
    joined = joined.unionByName(rows.where(short).withColumn("first_id", F.lit(None).cast("long")).select(*fields))
    (
        joined.mapInArrow(run, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", SEPARATOR)
        .option("maxRecordsPerFile", records_per_file)
        .option("compression", "gzip")
        .text(path)
    )


def _stream(content: bytes):
    """Decompressed pieces of a file of one or more gzip members; plain files as they are."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        d = zlib.decompressobj(31)
        while not d.eof:
            piece = d.decompress(content, 1 << 20)
            content = d.unconsumed_tail
            if piece:
                yield piece
            elif not content and not d.eof:
                raise ValueError("gzip member is cut off")
        content = d.unused_data


def parse(content: bytes):
    """(headers with lower-case names, block) of every record of one file."""
    held = b""
    pieces = _stream(content)

    def need(n: int) -> bool:
        nonlocal held
        got = [held]
        size = len(held)
        while size < n:
            piece = next(pieces, None)
            if piece is None:
                held = b"".join(got)
                return False
            got.append(piece)
            size += len(piece)
        held = b"".join(got)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                if held.strip():
                    raise ValueError("record header is cut off")
                return
        first, *lines = held[:end].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        head = {}
        for line in lines:
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode()] = v.strip().decode("utf-8", "replace")
        n = int(head["content-length"])
        if not need(end + 4 + n + 4):
            if len(held) < end + 4 + n:
                raise ValueError("record block is cut off")
        yield head, held[end + 4 : end + 4 + n]
        held = held[end + 4 + n :]
        held = held[4:] if held.startswith(b"\r\n\r\n") else held


_RECORD = (
    "page_id long, url string, type string, record_id string, origin_id string, segment int, total long, "
    "refers_to string, refers_to_page_id long, digest string, block binary"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive files under ``path``, blocks undecoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches):
        def row(head, block):
            as_int = lambda k: int(head[k]) if k in head else None
            return {
                "page_id": as_int("x-page-id"), "url": head.get("warc-target-uri"), "type": head.get("warc-type"), "record_id": head.get("warc-record-id"),
                "origin_id": head.get("warc-segment-origin-id"), "segment": as_int("warc-segment-number"), "total": as_int("warc-segment-total-length"),
                "refers_to": head.get("warc-refers-to"), "refers_to_page_id": as_int("x-refers-to-page-id"),
                "digest": (head.get("warc-payload-digest") or "").removeprefix("sha256:") or None, "block": block,
            }

        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()),
            ("total", pa.int64()), ("refers_to", pa.string()), ("refers_to_page_id", pa.int64()), ("digest", pa.string()), ("block", pa.binary()),
        ])
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for head, block in parse(content.as_py()):
                    rows.append(row(head, block))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, _RECORD)


def reassemble(parts: list[dict]) -> tuple[bytes, int]:
    """(whole block, copies) of one origin's segments; copies counts repeated first segments.

    Raises ValueError on a gap, on copies of a segment that differ, or on a wrong total length.
    """
    by_number: dict[int, bytes] = {}
    total, copies = None, 0
    for p in parts:
        n = p["segment"]
        if by_number.setdefault(n, p["block"]) != p["block"]:
            raise ValueError(f"two different segments {n}")
        copies += n == 1
        if p["total"] is not None:
            if total not in (None, p["total"]):
                raise ValueError("two different total lengths")
            total, last = p["total"], n
    if total is None:
        raise ValueError("the last segment is missing")
    if sorted(by_number) != list(range(1, last + 1)):
        raise ValueError(f"segments {sorted(by_number)} of {last}")
    block = b"".join(by_number[n] for n in range(1, last + 1))
    if len(block) != total:
        raise ValueError(f"{len(block)} bytes; the total length says {total}")
    return block, copies


def read_responses(records_: DataFrame) -> DataFrame:
    """(page_id, url, record_id, payload, error) of each response, segments reassembled.

    A record that can't be put together has a null payload and says why in ``error``.
    """
    whole = records_.where("type = 'response' and segment is null").select("page_id", "url", "record_id", "block")

    def simple(batches):
        for batch in batches:
            payloads, errors = [], []
            for b in batch.column("block").to_pylist():
                try:
                    payloads.append(payload_of(b))
                    errors.append(None)
                except ValueError as e:
                    payloads.append(None)
                    errors.append(str(e))
            cols = [batch.column(c) for c in ("page_id", "url", "record_id")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(payloads, pa.binary()), pa.array(errors, pa.string())], names=["page_id", "url", "record_id", "payload", "error"]
            )

    def grouped(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next((r for r in rows if r["segment"] == 1), rows[0])
        payload, error, copies = None, None, max(1, sum(r["segment"] == 1 for r in rows))
        try:
            block, copies = reassemble(rows)
            payload = payload_of(block)
        except ValueError as e:
            error = str(e)
        return pa.table(
            {
                "page_id": pa.array([head["page_id"]] * copies, pa.int64()), "url": pa.array([head["url"]] * copies, pa.string()),
                "record_id": pa.array([head["origin"]] * copies, pa.string()), "payload": pa.array([payload] * copies, pa.binary()),
                "error": pa.array([error] * copies, pa.string()),
            }
        )

    schema = "page_id long, url string, record_id string, payload binary, error string"
    pieces = records_.where("segment is not null").select(
        "page_id", "url", F.coalesce("origin_id", "record_id").alias("origin"), "segment", "total", "block"
    )
    return whole.mapInArrow(simple, schema).unionByName(pieces.groupBy("origin").applyInArrow(grouped, schema))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = read_records(spark, path)
    responses = cut(
        read_responses(found).select(
            "page_id",
            "record_id",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_digest"),
            F.when(F.col("error").isNotNull(), F.raise_error("error")).alias("broken"),
        )
    )
    revisits = cut(found.where("type = 'revisit'").select("page_id", "refers_to", "refers_to_page_id", "digest"))
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    seen = responses.groupBy("record_id").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    again = revisits.join(seen, F.col("refers_to") == F.col("record_id"), "left").select(
        "page_id",
        "payload_bytes",
        F.coalesce("payload_digest", F.raise_error(F.concat(F.lit("no response for the revisit of "), "refers_to"))).alias("payload_digest"),
        F.lit("revisit").alias("record_type"),
        F.col("refers_to_page_id").alias("refers_to"),
    )
    own = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(again)


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
