"""A deterministic sharded WARC writer and its reader.

Pages are sorted by id into ranges; each range is written as a series of files of gzip members, one
per record, and a new file is begun when the compressed size is reached. Headers, record ids and
digests are made anew from the payload, so the same pages give the same bytes. A task writes under
a temporary name of its own attempt and reports it; the reports of the attempts that counted become
the manifest, and only files in the manifest are moved to their final names. A lost executor leaves
at most temporary files behind, which are deleted at the end.

Among pages with equal payloads the one with the largest id is a response, the others are revisits
that refer to it.

Edge cases: a null html is an empty payload; a null page_id sorts first and counts as the smallest;
of several pages with that largest id and an equal payload the first in the sorted order is the
response; a null url has no target header; control characters and ``%`` in a url are escaped in the
header and restored by the reader; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.operators.skew import attach
from twinsift.session import ship_package

# Payload digests that occur twice, up to so many rows of about 60 bytes, are broadcast.
BROADCAST_DIGESTS = 500_000
# Payload bytes per range of pages, and the ranges that even few pages get.
RANGE_BYTES = 64 << 20
LEAST_RANGES = 12

_NO_ID = -(1 << 63)
_MANIFEST = "name string, temporary string, bytes long, records long"
_RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _escaped(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in url)


def _record(page_id: int | None, url: str | None, payload: bytes, response: int | None, repeat: bool, date: str) -> bytes:
    """One WARC record; ``response`` is the id of the page that holds the payload."""
    digest = _base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if repeat else http + payload
    headers = [
        ("WARC-Type", "revisit" if repeat else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + digest),
        ("WARC-Block-Digest", "sha1:" + _base32_sha1(block)),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", _escaped(url)))
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if repeat:
        headers.append(("WARC-Profile", _PROFILE))
        headers.append(("WARC-Refers-To", _record_id(response, digest)))
        if response is not None:
            headers.append(("X-Refers-To-Page", str(response)))
    headers.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class _Roller:
    """Writes the files of one range one after another."""

    def __init__(self, folder: str, part: int, limit: int):
        self.files, self.path = _open_folder(folder)
        self.part, self.limit, self.attempt = part, limit, uuid.uuid4().hex
        self.done: list[dict] = []
        self.out = None

    def add(self, member: bytes) -> None:
        if self.out is not None and self.done[-1]["bytes"] + len(member) > self.limit:
            self.close()
        if self.out is None:
            name = f"pages-{self.part:06d}-{len(self.done):06d}.warc.gz"
            temporary = f"_temporary/{name}.{self.attempt}"
            self.out = self.files.open_output_stream(f"{self.path}/{temporary}", compression=None)
            self.done.append({"name": name, "temporary": temporary, "bytes": 0, "records": 0})
        self.out.write(member)
        self.done[-1]["bytes"] += len(member)
        self.done[-1]["records"] += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _with_response(pages: DataFrame) -> DataFrame:
    """(id, url, html, response): the id of the page that holds the payload of each page."""
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("id"),
        "url",
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    repeated = (
        rows.groupBy("digest")
        .agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
    if repeated.count() <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(repeated.drop("copies")), "digest", "left")
    else:
        joined = attach(rows, repeated, ["digest"], ["id"], how="left", counts="copies")
    return joined.select("id", "url", "html", F.coalesce("response", "id").alias("response"), "digest")


def write_archive(
    pages: DataFrame, folder: str, file_bytes: int = 256 << 20, date: str = "2024-01-01T00:00:00Z", level: int = 6
) -> DataFrame:
    """Write pages (page_id, url, html) below ``folder``, which all executors reach and which is
    empty, and return the manifest (name, temporary, bytes, records)."""
    ship_package(pages.sparkSession)
    files, path = _open_folder(folder)
    files.create_dir(f"{path}/_temporary", recursive=True)
    size = pages.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    ordered = (
        _with_response(pages)
        .repartitionByRange(ranges, "id")
        .sortWithinPartitions("id", "digest", "url")
        .withColumn("part", F.spark_partition_id())
    )

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, before = None, None
        for batch in batches:
            for id_, url, html, response, digest, part in zip(*(batch[c].to_pylist() for c in ("id", "url", "html", "response", "digest", "part"))):
                roller = roller or _Roller(folder, part, file_bytes)
                repeat = id_ != response or before == (id_, digest)
                before = (id_, digest)
                record = _record(*(None if id_ == _NO_ID else id_, url, html), None if response == _NO_ID else response, repeat, date)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                roller.add(packer.compress(record) + packer.flush())
        if roller:
            roller.close()
            yield pa.RecordBatch.from_pylist(roller.done)

    ordered.mapInArrow(written, _MANIFEST).write.parquet(f"{folder}/manifest")
    manifest = pages.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")

    def committed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                final = f"{path}/{row['name']}"
                # A repeated task finds the file where it belongs already.
                if files.get_file_info(final).type == fs.FileType.NotFound:
                    files.move(f"{path}/{row['temporary']}", final)
                if files.get_file_info(final).size != row["bytes"]:
                    raise OSError(f"{final} is not as long as its manifest says")
            yield batch

    manifest.mapInArrow(committed, _MANIFEST).write.format("noop").mode("overwrite").save()
    files.delete_dir(f"{path}/_temporary")
    return manifest


def _members(stream) -> Iterator[bytes]:
    """The contents of the gzip members of a file, one after another."""
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            parts.append(unpack.decompress(data))
            if not unpack.eof:
                break
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if parts and any(parts):
        raise OSError("the last record of the file is cut off")


def _parsed(record: bytes, with_payload: bool) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if "sha1:" + _base32_sha1(block) != fields["WARC-Block-Digest"]:
        raise OSError(f"{fields['WARC-Record-ID']} has another digest than its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    response = fields["WARC-Type"] == "response"
    number = lambda name: int(fields[name]) if name in fields else None
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number("X-Page-ID"),
        "url": None if url is None else unquote(url),
        "payload_bytes": len(payload) if response else int(http.rsplit(b"Content-Length: ", 1)[1]),
        "payload_digest": _base32_sha1(payload) if response else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page"),
        "payload": payload if response and with_payload else None,
    }


def read_archive(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of all files in the manifest; digests and sizes of responses come from the
    payloads read, those of revisits from their headers. Every block is checked by its digest."""
    ship_package(spark)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open_folder(folder)
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for name in batch["name"].to_pylist():
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    rows, held = [], 0
                    for member in _members(stream):
                        rows.append(_parsed(member, with_payload))
                        held += len(member) if with_payload else 256
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # One file per task or nearly: the manifest is small, its files are not.
    spread = manifest.repartition(max(1, manifest.count()), "name")
    return spread.mapInArrow(records, _RECORDS)
