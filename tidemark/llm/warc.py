"""WARC archives: a writer with revisit records, and a splittable reader.

Writer: every page becomes one gzip member with one record. Of equal payloads (same SHA-1 and length)
of at least SMALLEST bytes the one with the largest page id is a response, the others are revisits
that refer to it and hold no payload; the HTTP head of a revisit still has the full length, its WARC
head the full digest. Only ids and digests are exchanged to decide that. Pages that may be revisits (a
bounded filter of digests tells) are joined to the decisions by id, so no group of copies meets in one
task; the others are written where they are read.

Reader: files are cut into byte ranges of any size. A task looks for gzip magic in its range, takes a
place for a member only if a WARC head can be decoded there, owns the records that start inside its
range and reads past its end to finish the last one.

Cases: a null payload is an empty one. A null page id is written as such; it is never preferred as
response. Rows that share the response's page id are responses too. An empty table gives archives
without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, written
from .files import Replacing, opened
from .hash_bits import may_be_among

SMALLEST = 1000
MAGIC = b"\x1f\x8b\x08"
#: Bytes read at a time, and bytes that a place is tried on at a time.
CHUNK, HEAD = 1 << 20, 1 << 16
LEVEL = 4
#: Size of a reader's byte range.
SPLIT = 8 << 20
_FOUND = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _name(page_id: str | None) -> bytes:
    return b"<urn:x-page:%s>" % (page_id or "none").encode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    target = (url or "").encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _name(page_id), b"WARC-Target-URI: " + target, b"WARC-Date: 2024-01-01T00:00:00Z", b"WARC-Payload-Digest: sha1:" + digest]
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _name(refers_to)]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    made = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return made.compress(b"\r\n".join(head) + b"\r\n\r\n") + made.compress(body) + made.compress(b"\r\n\r\n") + made.flush()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives under ``path``, one per task; returns (file, size) of each."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    big = rows.where(F.octet_length("payload") >= SMALLEST).select("id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("bytes"))
    big = written(big, "digests")
    chosen = big.groupBy("sha", "bytes").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null")
    # only copies go on; the prefixed key keeps the exchanges of both sides apart, so copies in thousands can be split
    chosen = chosen.select(F.concat(F.lit("s"), "sha").alias("k"), F.col("bytes").alias("b"), "response")
    revisits = big.join(chosen, (F.concat(F.lit("s"), "sha") == F.col("k")) & ((F.col("bytes") - F.col("b")) == 0)).where("not id <=> response")
    revisits = revisits.select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), "response").distinct()
    revisits = written(revisits, "revisits")
    # a payload whose digest no revisit has is written where it is read; the others are exchanged
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("some", may_be_among(F.xxhash64("sha"), revisits.select(F.xxhash64("rsha").alias("h"))))
    # an id that is null or repeats is told apart by its digest
    met = F.col("id").eqNullSafe(F.col("rid")) & (F.col("sha") == F.col("rsha")) & (F.octet_length("payload") >= SMALLEST)
    some = rows.where("some").join(revisits.hint("shuffle_hash"), met, "left").select("id", "url", "payload", "response", F.col("rsha").isNotNull().alias("revisit"))
    joined = rows.where("not some").select("id", "url", "payload", F.lit(None).cast("long").alias("response"), F.lit(False).alias("revisit")).union(some)
    # as strings, since pandas turns long columns with nulls into floats
    joined = joined.select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("response").cast("string").alias("response"), "revisit")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        with Replacing(file) as out:
            out.write(_info())
            for batch in batches:
                for i, url, body, to, again in zip(batch["id"], batch["url"], batch["payload"], batch["response"], batch["revisit"], strict=True):
                    out.write(record(i, url, bytes(body), to, bool(again)))
        yield pd.DataFrame({"file": [file], "size": [out.size]})

    return written(joined.mapInPandas(write, "file string, size long"), "archives")


def _info() -> bytes:
    body = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    head = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-file:info>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(body)
    made = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return made.compress(head + body + b"\r\n\r\n") + made.flush()


class Range:
    """Bytes of a file by position, read a chunk at a time."""

    def __init__(self, file: str) -> None:
        store, inner = opened(file)
        self.source = store.open_input_file(inner)
        self.size = self.source.size()
        self.at, self.held = 0, b""

    def bytes_at(self, start: int, n: int) -> bytes:
        if start < self.at or start + n > self.at + len(self.held):
            self.source.seek(start)
            self.at, self.held = start, self.source.read(max(n, CHUNK))
        return self.held[start - self.at : start - self.at + n]

    def held_from(self, start: int) -> bytes:
        """What is held from ``start`` on, or the next chunk if nothing is."""
        held = self.at + len(self.held) - start
        return self.bytes_at(start, held if 0 < held <= len(self.held) else CHUNK)


def _fields(head: bytes) -> dict[str, str] | None:
    """Fields of a WARC head by lower-case name; null if it isn't one, whole and with what every record must say."""
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/1.") or any(b":" not in x for x in lines):
        return None
    try:
        fields = {k.strip().lower(): v.strip() for k, v in (x.decode().split(":", 1) for x in lines)}
    except UnicodeDecodeError:
        return None
    named = all(fields.get(k) for k in ("warc-type", "warc-record-id", "warc-date"))
    return fields if named and fields.get("content-length", "").isdigit() else None


def _head_at(data: Range, at: int) -> bool:
    """A gzip member begins here whose content begins with a whole and valid WARC head, however long."""
    zipped, seen = zlib.decompressobj(31), b""
    try:
        while b"\r\n\r\n" not in seen:
            piece = data.bytes_at(at, HEAD)
            more = zipped.decompress(piece)
            seen += more
            if not piece or zipped.eof and not more or not seen.startswith(b"WARC/"[: len(seen)]):
                break
            at += len(piece)
    except zlib.error:
        return False
    head, end, _ = seen.partition(b"\r\n\r\n")
    return bool(end) and _fields(head) is not None


def _next_member(data: Range, at: int, end: int) -> int | None:
    """The first place from ``at`` and before ``end`` where a record's member starts."""
    while at < end:
        # the last two bytes of a piece are seen again, as a magic may lie across
        piece = data.bytes_at(at, min(CHUNK, end + len(MAGIC) - 1 - at))
        hit = piece.find(MAGIC)
        while hit >= 0:
            if at + hit < end and _head_at(data, at + hit):
                return at + hit
            hit = piece.find(MAGIC, hit + 1)
        if len(piece) < CHUNK:
            return None
        at += len(piece) - len(MAGIC) + 1
    return None


def _member(data: Range, at: int) -> tuple[bytes, int]:
    """A member's content and the place after it."""
    zipped, out = zlib.decompressobj(31), []
    while not zipped.eof:
        piece = data.held_from(at)
        if not piece:
            raise EOFError("an archive ends inside a record")
        out.append(zipped.decompress(piece))
        at += len(piece) - len(zipped.unused_data)
    return b"".join(out), at


def records(file: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head fields in lower case, content) of the records whose members start in [start, end)."""
    data = Range(file)
    end = min(end, data.size)
    at = _next_member(data, start, end)
    while at is not None and at < end:
        content, after = _member(data, at)
        head, _, rest = content.partition(b"\r\n\r\n")
        fields = _fields(head)
        if fields is None:
            raise ValueError(f"no WARC head at {at} of {file}")
        yield fields, rest[: int(fields["content-length"])]
        at = after if after >= end or data.bytes_at(after, 3) == MAGIC else _next_member(data, after, end)


def _number(name: str | None) -> int | None:
    told = (name or "").strip("<>").removeprefix("urn:x-page:")
    return int(told) if told.lstrip("-").isdigit() else None


def _row(fields: dict[str, str], content: bytes) -> tuple:
    http, _, payload = content.partition(b"\r\n\r\n")
    full = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response" and (len(payload) != full or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['warc-record-id']} doesn't match its digest")
    return _number(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], _number(fields.get("warc-refers-to")), full, digest, payload if fields["warc-type"] == "response" else None


def read_warc(spark: SparkSession, archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """One row per response or revisit in ``archives`` (file, size); payload is null in revisits."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long")))
    ranges = archives.select("file", starts.alias("start"))
    n = max(spark.sparkContext.defaultParallelism, ranges.count())
    ranges = ranges.repartition(n, "file", "start")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, start in zip(batch["file"], batch["start"], strict=True):
                rows, held = [], 0
                for fields, content in records(file, int(start), int(start) + split):
                    if fields["warc-type"] in ("response", "revisit"):
                        rows.append(_row(fields, content))
                        held += len(content)
                    if held >= 4 * CHUNK:
                        yield _frame(rows)
                        rows, held = [], 0
                yield _frame(rows)

    return ranges.mapInPandas(read, _FOUND)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})
