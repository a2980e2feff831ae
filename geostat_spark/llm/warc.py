"""WARC archives: a writer with revisit records and a salvage reader that gets past damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geostat_spark.operators.attach import attach_counted
from geostat_spark.session import cut

LINE = "\r\n"
GZIP = b"\x1f\x8b\x08"
PIECE = 1 << 16
find_version = re.compile(rb"WARC/1\.[01]\r\n").search
find_start = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n").search
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a string's UTF-8 bytes: 40 bits, hence 8 letters, at a time."""
    whole = F.sha1(payload.cast("binary"))
    pieces = [F.translate(F.lpad(F.conv(F.substring(whole, at, 10), 16, 32), 8, "0"), DIGITS, BASE32) for at in (1, 11, 21, 31)]
    return F.concat(*pieces)


def with_revisits(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, url, payload, n_bytes, digest, first): ``first`` is the smallest id with an equal payload, null
    where the row is that one, or the payload is shorter than ``least_bytes``."""
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    firsts = (
        rows.where(F.col("n_bytes") >= least_bytes)
        .groupBy("digest", "n_bytes")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    joined = attach_counted(rows, cut(firsts), ["digest", "n_bytes"], "n", "id", pages.count()).drop("n")
    return joined.withColumn("first", F.when(F.col("first") != F.col("id"), F.col("first")))


def write_warc(
    pages: DataFrame,
    path: str,
    id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    records_per_file: int = 10_000,
) -> None:
    """Write one record per page to archives in ``path``: uncompressed WARC 1.1, a file per task and
    ``records_per_file`` records.

    Equal payloads are stored once, as the ``response`` of the smallest id; the others are ``revisit`` records
    that name it. A null payload is empty; a null url is an empty one and line ends in it are percent-coded. A
    row with a null id is a response of its own with the record id ``urn:page:``. Rows that repeat the smallest
    id are all responses. No rows give an empty folder."""
    rows = with_revisits(pages, id, url, payload, least_bytes)
    target = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(LINE * 2)
    )
    block = F.when(F.col("first").isNull(), F.concat(http, F.col("payload"))).otherwise(http)
    fields = [
        ("WARC-Type", F.when(F.col("first").isNull(), "response").otherwise("revisit")),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    refers = F.when(
        F.col("first").isNotNull(),
        F.concat(
            F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{LINE}WARC-Refers-To: <urn:page:"),
            F.col("first").cast("string"),
            F.lit(f">{LINE}"),
        ),
    ).otherwise("")
    head = F.concat(F.lit(f"WARC/1.1{LINE}"), *[F.concat(F.lit(f"{k}: "), v, F.lit(LINE)) for k, v in fields], refers, F.lit(LINE))
    # A record ends with two line ends, which the text writer puts after every row.
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", LINE * 2).option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


class Damaged(Exception):
    pass


def _record(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """(end, fields, block) of the record that begins at ``at``; checks its form, length and digests."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        raise Damaged("no version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise Damaged("header without end")
    fields = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no content length")
    start = head + 4
    end = start + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record without end" if end + 4 <= len(data) else "record cut off")
    block = data[start:end]
    _verify(fields.get("warc-block-digest"), block)
    if fields.get("warc-type") != "revisit":
        _verify(fields.get("warc-payload-digest"), payload_of(fields, block))
    return end + 4, fields, block


def _verify(stated: str | None, content: bytes) -> None:
    name, _, value = (stated or "").partition(":")
    if name.lower() == "sha1" and value.upper() != base64.b32encode(hashlib.sha1(content).digest()).decode():
        raise Damaged("digest differs")


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP header, if it has one."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _member(data: bytes, at: int) -> tuple[int | None, list[tuple[str | None, dict[str, str], bytes]]]:
    """(end, records) of the gzip member, or the plain record, that begins at ``at``; a record is (fault, fields, block).

    The plain bytes of a member are searched record by record, also those before a zlib error or a cut; the end is
    None then. As an error shows only after the bytes it spoils, records before one need a digest that holds. A
    member without a sound record is damaged as a whole."""
    if not data.startswith(GZIP, at):
        end, fields, block = _record(data, at)
        return end, [(None, fields, block)]
    # Fed in pieces: what follows the member is then copied a piece at most, not up to the archive's end.
    unpack, parts, fed, reason = zlib.decompressobj(31), [], at, None
    while not unpack.eof and fed < len(data):
        piece = data[fed : fed + PIECE]
        try:
            before = unpack.copy()
            parts.append(unpack.decompress(piece))
        except zlib.error:
            reason = "gzip member damaged"
            parts.append(_until_error(before, piece))
            break
        fed = min(fed + PIECE, len(data))
    if not reason and not unpack.eof:
        reason = "gzip member cut off"
    plain = b"".join(parts)
    records = list(_plain_records(plain))
    if reason == "gzip member damaged":
        records = [r if r[0] or _has_digest(r[1]) else ("no digest in a damaged member", {}, b"") for r in records]
    if plain and not any(fault is None for fault, _, _ in records):
        raise Damaged(reason or records[0][0])
    if not reason:
        return fed - len(unpack.unused_data), records
    if not plain:
        raise Damaged(reason)
    # The last inner gap, if any, is what the fault cut; the fault itself is named once.
    if records[-1][0] is not None:
        records.pop()
    return None, [*records, (reason, {}, b"")]


def _has_digest(fields: dict[str, str]) -> bool:
    """Whether ``_record`` has checked a digest."""
    stated = [fields.get("warc-block-digest", "")]
    if fields.get("warc-type") != "revisit":
        stated.append(fields.get("warc-payload-digest", ""))
    return any(s.lower().startswith("sha1:") for s in stated)


def _until_error(unpack, piece: bytes) -> bytes:
    """What can be unpacked of ``piece`` before its zlib error, fed byte by byte."""
    parts = []
    try:
        for k in range(len(piece)):
            parts.append(unpack.decompress(piece[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(parts)


def _plain_records(plain: bytes) -> Iterator[tuple[str | None, dict[str, str], bytes]]:
    """(fault, fields, block) of the records of a member's plain bytes; a gap up to the next sound one is one row."""
    at = 0
    while at < len(plain):
        try:
            end, fields, block = _record(plain, at)
        except Damaged as fault:
            yield str(fault), {}, b""
            at = _next_record(plain, at)
        else:
            yield None, fields, block
            at = end


def _next_record(plain: bytes, at: int) -> int:
    """Where the next sound record after ``at`` begins, or the end."""
    while found := find_version(plain, at + 1):
        at = found.start()
        try:
            _record(plain, at)
            return at
        except Damaged:
            continue
    return len(plain)


def _next_start(data: bytes, at: int) -> int:
    """Where the next member or record after ``at`` that can be read begins, or the end."""
    while found := find_start(data, at + 1):
        at = found.start()
        try:
            _member(data, at)
            return at
        except Damaged:
            continue
    return len(data)


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(offset, length, fault, fields, block) of everything in an archive, in order.

    ``fault`` is None for a sound record (offset and length are its member's). After a failed check the reader
    looks for the next place where a member or record can be read; the bytes before it are one gap. Within a
    member it looks for the next sound record in the plain bytes; such a gap has its member's offset and length 0,
    as its compressed bytes are not told apart."""
    at = 0
    while at < len(data):
        try:
            end, records = _member(data, at)
        except Damaged as fault:
            end = _next_start(data, at)
            yield at, end - at, str(fault), {}, b""
        else:
            end = _next_start(data, at) if end is None else end
            for fault, fields, block in records:
                yield at, 0 if fault else end - at, fault, fields, block
        at = end


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives in ``path``, whatever their compression.

    ``fault`` is null for records; a gap has its reason, place and length there and null elsewhere. ``payload``
    is null for revisits, ``payload_bytes`` then comes from the stored HTTP header. No archives give no rows."""
    schema = (
        "archive string, offset long, length long, fault string, record_type string, record_id string, target_uri string, "
        "refers_to string, payload_digest string, payload_bytes long, payload binary"
    )
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
        names = [part.split()[0] for part in schema.split(", ")]

        def answer(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for at, length, fault, fields, block in salvage(content.as_py()):
                    rows.append((archive.as_py(), at, length, fault, *_facts(fields, block, with_payload)) if fault is None else (archive.as_py(), at, length, fault, *[None] * 7))
                    size += len(block) if with_payload else 0
                    if len(rows) >= 5000 or size > 1 << 24:
                        yield answer(rows)
                        rows, size = [], 0
                if rows:
                    yield answer(rows)

    return files.select("path", "content").mapInArrow(run, schema)


def _facts(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    revisit = fields.get("warc-type") == "revisit"
    if revisit:
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", block)
        n, payload = int(stated[1]) if stated else None, None
    else:
        payload = payload_of(fields, block)
        n = len(payload)
    digest = fields.get("warc-payload-digest", "")
    return (
        fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
        digest.partition(":")[2] or None, n, payload if with_payload else None,
    )
