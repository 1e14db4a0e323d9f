"""Web archives: records of a capture written to WARC files, and read back as one row.

Each page makes three records: a request, a response or a revisit, and metadata.
The request and the metadata name the response as concurrent. Reading assembles
the records of a capture through those identifiers into one nested row.

Of pages with equal payloads the one with the largest page_id is the response;
the others are revisits that refer to it and repeat its digest and length.
Spark's text writer makes the files: the two line ends after a record are its line
separator. Reading goes by Content-Length, so any payload is safe.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm import words
from marketlake.llm.common import materialize, work_path

#: Records of a file; a file is read by one task.
RECORDS = 3000
#: Payloads shorter than this are always responses.
LEAST = 0
EOL = "\r\n"
_END = EOL * 2
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, "
    "page_id long, payload_bytes long, payload_digest string, payload binary"
)


def _record_id(kind: str, page: Column) -> Column:
    """A stable identifier from kind, page and payload, in the form of a UUID."""
    code = F.md5(F.concat_ws(":", F.lit(kind), page.cast("string"), "digest"))
    parts = [F.substring(code, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _lines(*fields: tuple[str, Column | str]) -> Column:
    """Header lines; a field whose value is NULL is left out."""
    made = [
        F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(EOL))
        for name, value in fields
    ]
    return F.concat(*[F.coalesce(line, F.lit("")) for line in made])


def base32(digest: Column) -> Column:
    """Upper-case base32 of a 20-byte digest given in hexadecimal."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(4):
        chunk = F.conv(F.substring(digest, 10 * i + 1, 10), 16, 10).cast("long")
        for shift in range(35, -1, -5):
            at = F.shiftright(chunk, shift).bitwiseAND(F.lit(31)).cast("int")
            out.append(F.substring(alphabet, at + 1, F.lit(1)))
    return F.concat(*out)


def revisits(payloads: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page of a larger page_id has.

    ``payloads``: page_id, digest, n (bytes).
    """
    rows = payloads.where(F.col("n") >= LEAST).select("page_id", "digest")
    last = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    return (
        rows.join(last.where("n > 1").drop("n"), "digest")
        .where("page_id < refers_to")
        .select("page_id", "digest", "refers_to")
        .distinct()
    )


def records(pages: DataFrame) -> DataFrame:
    """(value): the text of the three records of each row of ``pages`` (page_id, url, html)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", base32(F.sha1("html")))
    payloads = materialize(
        rows.select("page_id", "digest", F.octet_length("html").alias("n")), "payloads"
    )
    rows = rows.join(revisits(payloads), ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    size = F.octet_length("html").cast("string")
    uri = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    parts = rows.select(
        F.col("page_id").cast("string").alias("page"), "digest", uri.alias("uri"), size.alias("size"),
        again.alias("again"), "refers_to",
        F.concat(
            F.lit(f"HTTP/1.1 200 OK{EOL}"),
            _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)),
            F.lit(EOL),
            F.when(again, "").otherwise(F.col("html")),
        ).alias("answer"),
    )
    response_id = _record_id("response", F.col("page"))
    path = F.regexp_extract(F.coalesce("uri", F.lit("")), r"^[a-z]+://[^/?#]*([^#]*)", 1)
    request = F.concat(
        F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{EOL}{EOL}")
    )
    about = _lines(("payload-length", F.col("size")), ("payload-digest", F.col("digest")))

    def record(kind: Column | str, mime: str, body: Column, *fields: tuple[str, Column | str]) -> Column:
        head = _lines(
            ("WARC-Type", kind), ("WARC-Target-URI", F.col("uri")), ("WARC-Date", _DATE),
            ("X-Page-Id", F.col("page")), *fields, ("Content-Type", mime),
            ("Content-Length", F.octet_length(body).cast("string")),
        )
        return F.concat(F.lit(f"WARC/1.1{EOL}"), head, F.lit(EOL), body)

    made = [
        record(
            "request", "application/http; msgtype=request", request,
            ("WARC-Record-ID", _record_id("request", F.col("page"))),
            ("WARC-Concurrent-To", response_id),
        ),
        record(
            F.when(F.col("again"), "revisit").otherwise("response"),
            "application/http; msgtype=response", F.col("answer"),
            ("WARC-Record-ID", response_id),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(F.col("again"), _record_id("response", F.col("refers_to")))),
            ("WARC-Profile", F.when(F.col("again"), _PROFILE)),
        ),
        record(
            "metadata", "application/warc-fields", about,
            ("WARC-Record-ID", _record_id("metadata", F.col("page"))),
            ("WARC-Concurrent-To", response_id),
        ),
    ]
    return parts.select(F.explode(F.array(*made)).alias("value"))


def write(pages: DataFrame, folder: str) -> None:
    """Write the archives of ``pages``, compressed, at most ``RECORDS`` records a file.

    A NULL html is an empty payload; a NULL url or page_id leaves its line out, and a
    page without page_id is always a response. Rows of one page_id with different
    payloads are captures of their own. An empty table writes no record.
    """
    (
        records(pages)
        .write.option("lineSep", _END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS)
        .text(folder)
    )


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and block of each record."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record ends early")
        yield fields, block


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = fields["warc-type"]
    payload, digest, size = block, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    if kind in ("response", "revisit"):
        payload = block.partition(b"\r\n\r\n")[2]
    if kind == "response":
        size = len(payload)
        if _digest(payload) != digest:
            raise ValueError(f"the digest of {fields['warc-record-id']} is wrong")
    page = fields.get("x-page-id")
    return (
        fields["warc-record-id"], kind, fields.get("warc-concurrent-to"), fields.get("warc-refers-to"),
        fields.get("warc-target-uri"), page and int(page), size, digest,
        payload if payloads or kind in ("request", "metadata") else None,
    )


def _records(payloads: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [
        pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(),
        pa.string(), pa.binary(),
    ]
    names = [field.split()[0] for field in _SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for data in batch["content"]:
            rows, size = [], 0
            with gzip.open(io.BytesIO(data.as_py())) as stream:
                for fields, block in parse(stream):
                    rows.append(_row(fields, block, payloads))
                    size += len(block)
                    if size > words.BATCH:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives of ``folder``. A block that is cut short, a wrong
    payload digest or bytes between records raise an error."""
    return (
        spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
        .mapInArrow(partial(_records, payloads), _SCHEMA)
    )


def captures(records: DataFrame) -> DataFrame:
    """One row per capture: page_id, url, and request, response and metadata as structs.

    Requests and metadata join the response or revisit that they name as concurrent;
    one without a partner leaves the struct NULL, and of several the least identifier
    counts. A revisit has length and payload of the response it refers to.
    """
    answers = records.where("type IN ('response', 'revisit')")

    def beside(kind: str) -> DataFrame:
        return (
            records.where(F.col("type") == kind)
            .groupBy(F.col("concurrent_to").alias("record_id"))
            .agg(F.min(F.struct("record_id", "target_uri", "payload")).alias(kind))
        )

    full = (
        records.where("type = 'response'")
        .select(
            F.col("record_id").alias("refers_to"), F.col("page_id").alias("referred_page"),
            F.col("payload_bytes").alias("referred_bytes"), F.col("payload").alias("referred_payload"),
        )
    )
    full = full.dropDuplicates(["refers_to"])
    return (
        answers.join(beside("request"), "record_id", "left")
        .join(beside("metadata"), "record_id", "left")
        .join(full, "refers_to", "left")
        .select(
            "page_id",
            F.col("target_uri").alias("url"),
            "request",
            F.struct(
                "record_id", "type", "refers_to", "referred_page", "payload_digest",
                F.coalesce("payload_bytes", "referred_bytes").alias("payload_bytes"),
                F.when(F.col("type") == "revisit", F.col("referred_payload"))
                .otherwise(F.col("payload")).alias("payload"),
            ).alias("response"),
            "metadata",
        )
    )


def _said(record: str, pattern: str) -> Column:
    """What a pattern finds in the block of a record of a capture."""
    return F.regexp_extract(F.decode(F.col(f"{record}.payload"), "UTF-8"), pattern, 1)


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, request_target, metadata_bytes)
    of every page, from archives written for it: the target that its request record asks for and
    the length that its metadata record states, NULL for a capture without such a record."""
    spark = pages.sparkSession
    folder = work_path(spark, "warc")
    write(pages, folder)
    return captures(materialize(read(spark, folder, payloads=False), "warc-records")).select(
        "page_id",
        "response.payload_bytes",
        "response.payload_digest",
        F.col("response.type").alias("record_type"),
        F.col("response.referred_page").alias("refers_to"),
        _said("request", r"^GET ([^ ]*) HTTP").alias("request_target"),
        _said("metadata", r"payload-length: (\d+)").cast("long").alias("metadata_bytes"),
    )
