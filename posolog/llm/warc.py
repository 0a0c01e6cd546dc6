"""WARC archives: one gzip member for each record, written by partitions and read back record by record."""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posolog.llm.common import pieces, quoted, released, small, written

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
#: An archive is closed at this compressed size.
ARCHIVE_BYTES = 8 << 20
CHUNK = 1 << 16
#: Bytes that one step of unpacking gives at most.
UNPACKED = 1 << 20
BROADCAST_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
READ_SCHEMA = "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, intact boolean, payload binary"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, level: int = 5) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone. White space in a url becomes
    single blanks, as a header line must not break."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url is not None else []),
        *([f"WARC-Profile: {PROFILE}"] if revisit else []),
        *([f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"] if refers_to is not None else []),
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    raw = "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class _Members:
    """Bytes of the members one after the other, unpacked as they are asked for, UNPACKED of them at most at once."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.at, self.ready, self.rest = memoryview(data), 0, b"", b""
        self.unpacker = None

    def more(self) -> bool:
        """Unpacks a further chunk; False at the end of the archive, ValueError if that is within a member."""
        while self.rest or self.at < len(self.data) or self.unpacker is not None:
            last = not self.rest and self.at >= len(self.data)
            part = self.rest or self.data[self.at : self.at + CHUNK]
            self.at += 0 if self.rest else len(part)
            self.unpacker = self.unpacker or zlib.decompressobj(31)
            try:
                got = self.unpacker.decompress(part, UNPACKED)
            except zlib.error as error:
                raise ValueError(f"a member is broken: {error}") from error
            self.rest = self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.at -= len(self.unpacker.unused_data)
                self.unpacker, self.rest = None, b""
            if got:
                self.ready += got
                return True
            if last and self.unpacker is not None:
                raise ValueError("the archive ends within a member")
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the next mark; None if nothing comes any more."""
        while (k := self.ready.find(mark)) < 0:
            if not self.more():
                if self.ready:
                    raise ValueError("the archive ends within a record's head")
                return None
        out, self.ready = self.ready[:k], self.ready[k + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.ready], len(self.ready)
        while have < n:
            self.ready = b""
            if not self.more():
                raise ValueError("the archive ends within a record")
            parts.append(self.ready)
            have += len(self.ready)
        whole = b"".join(parts)
        self.ready = whole[n:]
        return whole[:n]


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(archive: bytes) -> Iterator[dict]:
    """The records of an archive in order, with checked digests; a broken frame or a cut archive raises ValueError.

    A revisit has no payload: its digest is what its header says, see checked_revisits()."""
    members = _Members(archive)
    while (head := members.until(b"\r\n\r\n")) is not None:
        if not head.startswith(b"WARC/1."):
            raise ValueError("no WARC record where one should begin")
        fields = _fields(head)
        block = members.take(int(fields["content-length"]))
        if members.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = fields["warc-type"] == "revisit"
        said = fields.get("warc-payload-digest", "")
        own = lambda name: (fields.get(name, "").strip("<>").removeprefix(RECORD_ID)) or None  # noqa: B023, E731
        yield {
            "page_id": own("warc-record-id"),
            "url": fields.get("warc-target-uri"),
            "record_type": fields["warc-type"],
            "refers_to": own("warc-refers-to"),
            "payload_bytes": int(_fields(http).get("content-length", 0)) if revisit else len(payload),
            "payload_digest": base64.b32decode(said.removeprefix("sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest(),
            "intact": _digest(block) == fields.get("warc-block-digest") and (revisit or _digest(payload) == said),
            "payload": None if revisit else payload,
        }


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Rows (_id, _digest, refers_to) of the pages whose payload a page of a larger id has too."""
    each = pages.select("_id", "_digest").filter(F.octet_length("_payload") >= least)
    shared = each.groupBy("_digest").agg(F.max("_id").alias("refers_to"), F.count("*").alias("_n")).filter("_n > 1 AND refers_to IS NOT NULL")
    return each.join(shared.drop("_n"), "_digest").filter(~F.col("_id").eqNullSafe(F.col("refers_to"))).select("_id", "_digest", "refers_to").distinct()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Archives of the pages as rows (archive binary, records long), one or more for each partition.

    A null page body is an empty payload, a null url has no target line. Of equal payloads of `least` bytes or more the
    one with the largest id is the response and all others are revisits of it (also those with a null id); rows that
    repeat the largest id are responses all. Shorter payloads are always responses. Ids are of any type that is the same
    after a cast to text and back; a payload of any length is one record. Other columns are not stored.
    """
    docs = pages.select(quoted(id_col).alias("_id"), quoted(url_col).cast("string").alias("_url"), F.coalesce(quoted(html_col), F.lit("")).cast("binary").alias("_payload"))
    docs = docs.withColumn("_digest", F.sha1("_payload"))
    known = written(revisits(docs, least), "revisits")
    known = small(known.toDF("_rid", "_rdigest", "refers_to").withColumn("_revisit", F.lit(True)), known.count(), BROADCAST_ROWS)
    same = F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_digest") == F.col("_rdigest"))
    typed = docs.join(known, same, "left").select(F.col("_id").cast("string"), "_url", "_payload", F.col("refers_to").cast("string"), F.coalesce("_revisit", F.lit(False)).alias("_revisit"))

    @released
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary()), pa.array([len(parts)], pa.int64())], ["archive", "records"])

        for batch in pieces(batches, 2):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(record(*row))
                held += len(parts[-1])
                if held >= ARCHIVE_BYTES:
                    yield closed()
                    parts, held = [], 0
        if parts:
            yield closed()

    return typed.mapInArrow(pack, "archive binary, records bigint")


def read_archives(archives: DataFrame, id_kind: str = "bigint", payloads: bool = True) -> DataFrame:
    """The records of archives in a binary column `archive`: see READ_SCHEMA. Null archives have none."""
    schema = READ_SCHEMA if payloads else READ_SCHEMA.removesuffix(", payload binary")
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = [x.split()[0] for x in schema.split(", ")], [kinds[x.split()[1]] for x in schema.split(", ")]

    @released
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, held = [], 0
                for r in records(archive.as_buffer()) if archive.is_valid else ():
                    rows.append(r)
                    held += 200 + len(r["payload"] or b"") * payloads
                    if held > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in zip(names, types, strict=True)], names)
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in zip(names, types, strict=True)], names)

    found = archives.select("archive").mapInArrow(unpack, schema)
    return found.withColumns({c: F.col(c).cast(id_kind) for c in ("page_id", "refers_to")})


def checked_revisits(found: DataFrame) -> DataFrame:
    """Records of which a revisit is intact only if the response that it refers to is there and has its digest."""
    known = found.filter("record_type = 'response'").select(F.col("page_id").cast("string").alias("_known"), F.col("payload_digest").alias("_digest")).distinct().withColumn("_met", F.lit(True))
    key = F.when(F.col("record_type") == "revisit", F.col("refers_to").cast("string")).otherwise(F.concat(F.lit("-"), F.col("page_id").cast("string")))  # no id, and not one key for all
    met = found.withColumn("_key", key).join(known, (F.col("_key") == F.col("_known")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return met.select(*[(F.col(c) & ((F.col("record_type") != "revisit") | F.coalesce("_met", F.lit(False)))).alias(c) if c == "intact" else F.col(c) for c in found.columns])


def archives_of_files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files (.warc.gz) under a path as rows that read_archives takes."""
    return spark.read.format("binaryFile").load(path).select(F.col("content").alias("archive"))


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive to a file in a folder that all machines mount; returns the names. Safe to repeat."""

    @released
    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for archive in batch.column(0).to_pylist():
                names.append(f"{hashlib.sha256(archive).hexdigest()[:32]}.warc.gz")
                part = f"{folder}/.{names[-1]}.{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(archive)
                os.replace(part, f"{folder}/{names[-1]}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return archives.filter("archive IS NOT NULL").select("archive").mapInArrow(save, "name string")
