"""WARC archives: write captures as transactions, read them back, assemble one row per capture.

A capture is three records. Request and metadata name the response (or revisit) in
``WARC-Concurrent-To``; assembling joins them on it. A payload that an earlier capture already holds
(smallest key first) is written as a revisit that names that capture in ``WARC-Refers-To``.

Archives are gzip files of text, one per task, written and read by Spark's text source, so they work
in any store that Spark reaches. Records end in two line breaks; the reader cuts at two line breaks
followed by ``WARC/1.`` and puts pieces together again until ``Content-Length`` is reached, so a
payload that holds such a text comes back whole.

Defined cases: a null payload is empty; a null url leaves its headers out; captures with equal or null
keys are captures of their own, told apart by a row number; line breaks in a url are percent-encoded.
A piece that is no record comes back with type ``malformed``; a file cut short gives its last record
with ``truncated`` set.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, numbered

END = "\r\n"
CUT = "\r\n\r\nWARC/1."
RECORDS = (
    "file string, warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string,"
    " warc_date string, content_type string, declared_digest string, http_head string, payload binary, truncated boolean"
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: ten hex digits make eight of base 32, spelled with other signs."""
    digits = F.sha1(payload)
    eights = [F.lpad(F.conv(F.substring(digits, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*eights), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(number: Column, part: str) -> Column:
    h = F.md5(F.concat(F.lit(f"{part}:"), number.cast("string")))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    spelled = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))
    return F.when(number.isNotNull(), spelled)


def _record(block: Column, **fields: Column) -> Column:
    """A record without the two line breaks behind it, which the writer adds."""
    names = {k: "-".join({"warc": "WARC", "id": "ID", "uri": "URI"}.get(w, w.title()) for w in k.split("_")) for k in fields}
    lines = [F.concat(F.lit(f"{names[k]}: "), v) for k, v in fields.items()]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(END, F.lit("WARC/1.1"), *lines, length), F.lit(END + END), block)


def write_captures(
    pages: DataFrame, path: str, scratch: Scratch, key: str = "page_id", url: str = "url", payload: str = "html",
    min_revisit_bytes: int = 0, date: str = "2025-01-01T00:00:00Z",
) -> None:
    """Write ``pages`` below ``path``; equal payloads of ``min_revisit_bytes`` or more are kept once."""
    rows = numbered(pages, key, scratch, payload)
    field = lambda c: F.col("_row").getField(c)
    slim = rows.select(
        "_rid",
        field(key).cast("string").alias("_key"),
        F.replace(F.replace(field(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("_url"),
        F.coalesce(field(payload), F.lit("")).alias("_body"),
    ).withColumn("_digest", base32_sha1(F.col("_body")))
    facts = slim.select("_rid", "_digest", F.octet_length("_body").alias("_bytes")).where(F.col("_bytes") >= min_revisit_bytes)
    facts = scratch.save(facts, "digests")
    # Digests seen once, that is most, leave before anything is joined.
    first = facts.groupBy("_digest", "_bytes").agg(F.min("_rid").alias("_first"), F.count("*").alias("n")).where("n > 1")
    again = facts.join(first, ["_digest", "_bytes"]).where("_rid != _first").select("_rid", "_first")
    joined = slim.join(scratch.save(again, "revisits"), "_rid", "left")
    me, revisit, stamp = record_id(F.col("_rid"), "response"), F.col("_first").isNotNull(), F.lit(date)
    size = F.octet_length("_body").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("sha1:"), F.col("_digest"))
    http = F.lit("application/http; msgtype=response")
    response = _record(
        F.concat(head, F.when(revisit, "").otherwise(F.col("_body"))),
        warc_type=F.when(revisit, "revisit").otherwise("response"),
        warc_record_id=me, warc_date=stamp, warc_target_uri=F.col("_url"), warc_payload_digest=digest,
        warc_refers_to=record_id(F.col("_first"), "response"),
        warc_profile=F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        content_type=http,
    )
    place = F.regexp_extract("_url", r"^[A-Za-z]+://([^/?#]*)([^#]*)", 2)
    host = F.regexp_extract("_url", r"^[A-Za-z]+://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    request = _record(
        F.coalesce(asked, F.lit("GET / HTTP/1.1\r\n\r\n")), warc_type=F.lit("request"),
        warc_record_id=record_id(F.col("_rid"), "request"), warc_date=stamp, warc_target_uri=F.col("_url"),
        warc_concurrent_to=me, content_type=F.lit("application/http; msgtype=request"),
    )
    facts_block = F.concat_ws(END, F.concat(F.lit("capture-key: "), F.col("_key")), F.concat(F.lit("payload-length: "), size), F.lit(""))
    metadata = _record(
        facts_block, warc_type=F.lit("metadata"), warc_record_id=record_id(F.col("_rid"), "metadata"),
        warc_date=stamp, warc_target_uri=F.col("_url"), warc_concurrent_to=me, content_type=F.lit("application/warc-fields"),
    )
    out = joined.select(F.explode(F.array(request, response, metadata)).alias("value"))
    out.write.option("lineSep", END + END).option("compression", "gzip").text(path)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from the pieces of archives, in their order within each file."""
    schema = pa.schema([
        *[(n, pa.string()) for n in ("file", "warc_type", "record_id", "concurrent_to", "refers_to", "target_uri",
                                     "warc_date", "content_type", "declared_digest", "http_head")],
        ("payload", pa.binary()), ("truncated", pa.bool_()),
    ])
    out, held, file, raw = [], 0, None, None

    def flush():
        nonlocal out, held
        batch = pa.RecordBatch.from_pylist(out, schema=schema)
        out, held = [], 0
        return batch

    def missing(record: bytes) -> int:
        head, gap, body = record.partition(b"\r\n\r\n")
        if not gap:
            return 0
        for line in head.split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                return int(value) - len(body)
        return 0

    def put(last: bool) -> None:
        nonlocal raw, held
        if raw is not None and raw.strip():
            out.append(_record_row(file, raw, last and missing(raw) > 0))
            held += len(raw)
        raw = None

    for batch in batches:
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != file:
                put(True)
                file, raw = name, piece
            elif raw is not None and missing(raw) > 0:
                raw += CUT.encode() + piece  # the cut was inside a payload
            else:
                put(False)
                raw = piece
            if held > 8_000_000:
                yield flush()
    put(True)
    yield flush()


def _record_row(file: str, raw: bytes, truncated: bool) -> dict:
    head, gap, block = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    row = {
        "file": file, "warc_type": fields.get("warc-type", "malformed") if gap else "malformed",
        "record_id": fields.get("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"),
        "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"),
        "warc_date": fields.get("warc-date"), "content_type": fields.get("content-type"),
        "declared_digest": fields.get("warc-payload-digest"), "http_head": None, "payload": None, "truncated": truncated,
    }
    size = fields.get("content-length", "")
    block = block[: int(size)] if size.isdigit() else block
    if (row["content_type"] or "").startswith("application/http"):
        http, _, block = block.partition(b"\r\n\r\n")
        row["http_head"] = http.decode("latin-1")
    row["payload"] = block
    return row


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record below ``path`` (``*.gz``, also many gzip members in a file).

    A gzip file is read by one task from its start, in order and piece by piece.
    """
    pieces = spark.read.option("lineSep", CUT).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(_parsed, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``response``, ``request``, ``metadata`` and what a revisit refers to.

    Requests and metadata are joined through their concurrent-to ids. Should several name the same
    capture, the one with the smallest id counts. A capture without one of them has null there.
    """
    fields = ["record_id", "target_uri", "warc_date", "content_type", "http_head"]
    kinds = records.where(F.col("warc_type").isin("response", "revisit"))
    capture = kinds.select(
        F.col("record_id").alias("capture_id"), "warc_type", "target_uri", "warc_date", "refers_to", "declared_digest",
        F.struct("http_head", "payload", "truncated").alias("response"),
    )

    def side(kind: str, content: Column) -> DataFrame:
        mine = records.where((F.col("warc_type") == kind) & F.col("concurrent_to").isNotNull())
        best = F.min_by(F.struct(*fields, content.alias("content")), "record_id")
        return mine.groupBy(F.col("concurrent_to").alias("capture_id")).agg(best.alias(kind))

    text = F.col("payload").cast("string")
    joined = capture.join(side("request", F.lit(None).cast("string")), "capture_id", "left")
    return joined.join(side("metadata", text), "capture_id", "left")


def metadata_field(name: str) -> Column:
    return F.nullif(F.regexp_extract("metadata.content", rf"(?:^|\n){name}: ([^\r\n]*)", 1), F.lit(""))
