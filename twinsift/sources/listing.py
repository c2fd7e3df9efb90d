"""Directory listings and file contents read by executors.

The folders are a shared mount: every executor sees the same paths. Listing is breadth-first,
one Spark job per folder level, so a deep or wide tree spreads over all tasks instead of one
task walking one root.
"""

from __future__ import annotations

import hashlib
import itertools
import mimetypes
import os
import stat
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from twinsift.functions import paths as P
from twinsift.functions.fingerprints import dhash64, phash64
from twinsift.schemas import CONTENT_HASH, DHASH, PHASH
from twinsift.session import checkpointed, ship_package

_ENTRY = T.StructType(
    [
        T.StructField("root_id", T.LongType()),
        T.StructField("root_path", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("abs_path", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("mtime_epoch_ns", T.LongType()),
        T.StructField("ctime_epoch_ns", T.LongType()),
        T.StructField("inode", T.LongType()),
        T.StructField("dev", T.LongType()),
    ]
)
ROWS_PER_BATCH = 5_000


def entries_of(root_id: int, root_path: str, folder: str) -> Iterator[tuple]:
    """What lies directly in a folder; a folder that cannot be opened is skipped unless it is the root."""
    try:
        found = os.scandir(folder)
    except OSError:
        if folder == root_path:
            raise
        return
    with found:
        for entry in found:
            if entry.is_dir(follow_symlinks=False):
                yield (root_id, root_path, True, entry.path, None, None, None, None, None)
                continue
            try:
                info = os.stat(entry.path)
            except OSError:
                continue
            if stat.S_ISREG(info.st_mode):
                yield (
                    root_id, root_path, False, entry.path,
                    info.st_size, info.st_mtime_ns, info.st_ctime_ns, info.st_ino, info.st_dev,
                )


def _list_folders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        folders = batch.to_pylist()
        entries = (row for f in folders for row in entries_of(f["root_id"], f["root_path"], f["abs_path"]))
        while rows := list(itertools.islice(entries, ROWS_PER_BATCH)):
            yield as_batch(rows, _ENTRY)


def as_batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    """Rows as an Arrow batch: whole numbers stay exact, also next to nulls."""
    arrow = to_arrow_schema(schema)
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), arrow)]
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def list_files(roots: DataFrame, folders_per_task: int = 200) -> DataFrame:
    """Every regular file below the roots (root_id, path); a missing root fails the job.

    Hidden, empty and symlinked files are listed, symlinked folders are not entered. Each
    level of folders is one distributed pass whose result is pinned by a checkpoint.
    """
    spark = roots.sparkSession
    ship_package(spark)
    level = roots.select("root_id", F.col("path").alias("root_path"), F.col("path").alias("abs_path"))
    files = None
    folder_count = level.count()
    while folder_count:
        tasks = -(-folder_count // folders_per_task)
        tasks = max(tasks, min(folder_count, spark.sparkContext.defaultParallelism))
        entries = checkpointed(level.repartition(tasks).mapInArrow(_list_folders, _ENTRY))
        found = entries.where(~F.col("is_dir"))
        files = found if files is None else files.unionByName(found)
        level = entries.where("is_dir").select("root_id", "root_path", "abs_path")
        folder_count = level.count()
    if files is None:
        files = spark.createDataFrame([], _ENTRY)
    return files.select(
        "root_id",
        P.rel_path(F.col("abs_path"), F.col("root_path")).alias("rel_path"),
        "abs_path",
        P.file_name(F.col("abs_path")).alias("file_name"),
        "size_bytes", "mtime_epoch_ns", "ctime_epoch_ns", "inode", "dev",
    )


def mime_table(spark: SparkSession) -> DataFrame:
    """Extension to mime type, from Python's built-in registry (a fixed, small table)."""
    registry = mimetypes.MimeTypes(filenames=())
    types = dict(registry.types_map[True])
    rows = [(ext, kind) for ext, kind in types.items()]
    for alias, full in registry.suffix_map.items():
        inner = "." + full.split(".")[1]
        if inner in types:
            rows.append((alias, types[inner]))
    return spark.createDataFrame(rows, "mime_ext string, mime_type string")


def path_attributes(listing: DataFrame) -> DataFrame:
    """Add lower-cased extension and guessed mime type to a listing.

    A compression suffix (``.gz`` and the like) is looked through: ``a.tar.gz`` is a tar file.
    """
    packed = sorted(mimetypes.MimeTypes(filenames=()).encodings_map)
    ending = "|".join(ext.replace(".", r"\.") for ext in packed)
    visible = F.regexp_replace("file_name", r"^\.+", "")
    inner = F.regexp_replace(visible, rf"(?<=.)(?:{ending})$", "")
    keyed = listing.withColumn("extension", P.extension(F.col("file_name"))).withColumn(
        "mime_ext", P.extension(inner)
    )
    known = F.broadcast(mime_table(listing.sparkSession))
    return keyed.join(known, "mime_ext", "left").drop("mime_ext")


_CONTENT = T.StructType(
    [T.StructField("file_id", T.LongType()), T.StructField("content", T.BinaryType())]
)
_DIGEST = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("samples_65", T.BinaryType()),
        T.StructField("samples_64", T.BinaryType()),
    ]
)
CHUNKS = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("chunk_no", T.LongType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
_CHUNK = 1 << 20
# What opening a file and reading its samples costs, in bytes read.
_SEEK_COST = 1 << 18


def _read_contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.to_pylist():
            with open(file["abs_path"], "rb") as handle:
                yield as_batch([(file["file_id"], handle.read())], _CONTENT)


def _digest_contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = (
            (f["file_id"], *(_digest_file if f["needs_digest"] else _sample_file)(f["abs_path"]))
            for f in batch.to_pylist()
        )
        while rows := list(itertools.islice(digests, ROWS_PER_BATCH)):
            yield as_batch(rows, _DIGEST)


def _offsets(size: int, k: int) -> np.ndarray:
    return np.minimum((np.arange(k) * (size / k)).astype("int64"), size - 1)


def _sample_file(path: str) -> tuple[None, bytes, bytes]:
    """Only the bytes at the two sets of sample offsets, without reading the rest."""
    with open(path, "rb") as handle:
        size = os.fstat(handle.fileno()).st_size
        if size <= 65:
            whole = handle.read()
            return None, whole, whole
        picks = lambda k: b"".join(os.pread(handle.fileno(), 1, int(at)) for at in _offsets(size, k))
        return None, picks(65), picks(64)


class _Fold:
    """Digest and sample bytes of a file from its parts, given one after another."""

    def __init__(self, size: int):
        self.size, self.start, self.digest = size, 0, hashlib.sha256()
        self.wanted = {k: _offsets(size, k) for k in (65, 64)}
        self.kept: dict[int, list[bytes]] = {65: [], 64: []}

    def add(self, part: bytes) -> None:
        self.digest.update(part)
        view = np.frombuffer(part, dtype="uint8")
        for k, at in self.wanted.items():
            if self.size > k:
                inside = at[(at >= self.start) & (at < self.start + len(part))]
                self.kept[k].append(view[inside - self.start].tobytes())
            else:
                self.kept[k].append(part)
        self.start += len(part)

    def result(self) -> tuple[str, bytes, bytes]:
        return self.digest.hexdigest(), b"".join(self.kept[65]), b"".join(self.kept[64])


def _digest_file(path: str) -> tuple[str, bytes, bytes]:
    """Stream a file once: its digest, and the bytes at the two sets of sample offsets."""
    with open(path, "rb") as handle:
        fold = _Fold(os.fstat(handle.fileno()).st_size)
        while chunk := handle.read(_CHUNK):
            fold.add(chunk)
    return fold.result()


def _read_chunks(batches: Iterable[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.to_pylist():
            with open(file["abs_path"], "rb") as handle:
                size = os.fstat(handle.fileno()).st_size
                for number in itertools.count():
                    chunk = handle.read(chunk_bytes)
                    if not chunk and number:
                        break
                    yield as_batch([(file["file_id"], number, size, chunk)], CHUNKS)


def _fold_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest row per file from its chunks, which come sorted by file and number."""
    file_id, following, fold, out = None, 0, None, []
    for batch in batches:
        for row in range(len(batch)):
            own, number, size = (batch[c][row].as_py() for c in ("file_id", "chunk_no", "size_bytes"))
            if fold is None or own != file_id:
                if fold is not None:
                    out.append((file_id, *fold.result()))
                file_id, following, fold = own, 0, _Fold(size)
            if number != following:
                raise ValueError(f"file {own}: chunk {following} is missing or there twice")
            fold.add(batch["content"][row].as_py())
            following += 1
            if len(out) >= ROWS_PER_BATCH:
                yield as_batch(out, _DIGEST)
                out = []
    if fold is not None:
        out.append((file_id, *fold.result()))
    if out:
        yield as_batch(out, _DIGEST)


def _dealt(changed: DataFrame, bytes_per_task: int) -> DataFrame:
    """Changed files (file_id, abs_path) in as many tasks as their bytes ask for."""
    full = F.col("needs_digest") if "needs_digest" in changed.columns else F.lit(True)
    due = changed.where("changed").select("file_id", "abs_path", "size_bytes", full.alias("needs_digest"))
    cost = F.when(F.col("needs_digest"), F.col("size_bytes")).otherwise(0) + _SEEK_COST
    total = due.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0]
    least = changed.sparkSession.sparkContext.defaultParallelism
    tasks = int(max(total // bytes_per_task, least))
    return due.repartition(tasks, "file_id").select("file_id", "abs_path", "needs_digest")


def read_changed_content(changed: DataFrame, bytes_per_task: int = 1 << 30) -> DataFrame:
    """Bytes of the changed files (file_id, abs_path, size_bytes, changed), a whole file in one cell.

    For files that are small for certain; :func:`read_chunks` has no limit.
    """
    ship_package(changed.sparkSession)
    return _dealt(changed, bytes_per_task).mapInArrow(_read_contents, _CONTENT)


def fingerprint_changed(changed: DataFrame, bytes_per_task: int = 1 << 30) -> DataFrame:
    """All three prints of the changed files, reading each file once in small chunks.

    Only the digest and 129 sample bytes per file leave the reading task, so files of any size
    work and no content is shuffled. Where ``needs_digest`` is false only the sample bytes are
    read and there is no content hash. The prints come from the same expressions as in
    :func:`twinsift.functions.fingerprints.fingerprint`: samples of the right length are
    returned unchanged by the sampling step.
    """
    ship_package(changed.sparkSession)
    return _prints(_dealt(changed, bytes_per_task).mapInArrow(_digest_contents, _DIGEST))


def read_chunks(changed: DataFrame, chunk_bytes: int = _CHUNK, bytes_per_task: int = 1 << 30) -> DataFrame:
    """Bytes of the changed files as rows (file_id, chunk_no, size_bytes, content) of at most
    ``chunk_bytes``. An empty file has one empty chunk."""
    ship_package(changed.sparkSession)
    return _dealt(changed, bytes_per_task).mapInArrow(lambda batches: _read_chunks(batches, chunk_bytes), CHUNKS)


def fingerprint_chunks(chunks: DataFrame) -> DataFrame:
    """All three prints of files given as chunk rows in any order, as of a stored table.

    The chunks of a file are folded in order by one task, which holds a batch of them at a time;
    a chunk that is missing or there twice fails the job.
    """
    ship_package(chunks.sparkSession)
    ordered = chunks.select(*CHUNKS.fieldNames()).repartition("file_id").sortWithinPartitions("file_id", "chunk_no")
    return _prints(ordered.mapInArrow(_fold_chunks, _DIGEST))


def _prints(read: DataFrame) -> DataFrame:
    wide = read.select(
        "file_id",
        F.col("content_hash").alias(CONTENT_HASH),
        dhash64(F.col("samples_65")).alias(DHASH),
        phash64(F.col("samples_64")).alias(PHASH),
    )
    long = wide.unpivot("file_id", [CONTENT_HASH, DHASH, PHASH], "hash_type", "hash_hex")
    return long.where("hash_hex IS NOT NULL")
