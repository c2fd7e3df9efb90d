"""Files below shared folders as a Spark data source, in batch and as a stream.

    register_folder_source(spark)
    spark.read.format("folder_listing").option("roots", '{"1": "/nas/photo"}').load()
    spark.readStream.format("folder_listing").option("roots", '{"1": "/nas/photo"}').load()

Planning opens folders level by level only until there are enough of them to share out; each of these is
walked by one task as a whole. The option ``rootIds`` leaves out the other roots before any folder is
opened. (Filters are not pushed into the source: Spark 4.1 keeps what a filtered read has pushed for the
next, unfiltered read of the same DataFrame.) The stream's offset is a change time: a batch holds the files whose inode changed after the last
one, which covers new, rewritten and renamed files; a file that changes again while a batch waits moves on
to the next. Removed files are not seen; that takes a complete listing.

The rows are those of :func:`twinsift.sources.listing.list_files`, which spreads every level of folders over
all tasks instead, at the price of a job per level: better where a few folders hold most files.
"""

from __future__ import annotations

import itertools
import json
import os
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, InputPartition,
)
from pyspark.sql.types import StructType

from twinsift.schemas import LISTING
from twinsift.session import ship_package
from twinsift.sources.listing import ROWS_PER_BATCH, as_batch, entries_of

FORMAT = "folder_listing"
# Folders that planning shares out, unless the option ``folders`` says otherwise.
FOLDERS = 256
# A file that changed less than this long ago waits for the next batch: its writer may not be done.
SETTLE_MS = 2_000


@dataclass
class Folders(InputPartition):
    """Folders (root_id, root, path, whether to walk what lies below) of one task."""

    entries: list[tuple[int, str, str, bool]]


def _shared_out(roots: dict[int, str], folders: int) -> list[Folders]:
    """Whole subtrees, and the folders above them whose own files are still to be listed."""
    level = [(root_id, path, path) for root_id, path in sorted(roots.items())]
    above: list[tuple[int, str, str, bool]] = []
    while level and len(level) < folders:
        below = []
        for root_id, root, folder in level:
            above.append((root_id, root, folder, False))
            below += [(root_id, root, e[3]) for e in entries_of(root_id, root, folder) if e[2]]
        level = below
    every = above + [(*entry, True) for entry in level]
    return [Folders(every[i::folders]) for i in range(min(folders, len(every)))]


def _listed(part: Folders, after: int | None = None, upto: int | None = None) -> Iterator[tuple]:
    """Listing rows of a task's folders, of files changed in (after, upto] if these are given."""
    for root_id, root, folder, deep in part.entries:
        waiting = [folder]
        while waiting:
            for _, _, is_dir, path, size, mtime, ctime, inode, dev in entries_of(root_id, root, waiting.pop()):
                if is_dir:
                    if deep:
                        waiting.append(path)
                elif after is None or after < ctime <= upto:
                    relative = path[len(root.rstrip("/")) + 1 :]
                    yield root_id, relative, path, os.path.basename(path), size, mtime, ctime, inode, dev


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, ROWS_PER_BATCH)):
        yield as_batch(some, LISTING)


class FolderReader(DataSourceReader):
    def __init__(self, roots: dict[int, str], folders: int):
        self.roots, self.folders = roots, folders

    def partitions(self) -> list[Folders]:
        return _shared_out(self.roots, self.folders) or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return _batches(_listed(partition))


class FolderStreamReader(DataSourceStreamReader):
    def __init__(self, roots: dict[int, str], folders: int, settle_ms: int):
        self.roots, self.folders, self.settle_ms = roots, folders, settle_ms

    def initialOffset(self) -> dict:
        return {"changed_ns": 0}

    def latestOffset(self) -> dict:
        return {"changed_ns": time.time_ns() - self.settle_ms * 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        shared = _shared_out(self.roots, self.folders) or [Folders([])]
        return [SpanOfFolders(p.entries, start["changed_ns"], end["changed_ns"]) for p in shared]

    def read(self, partition: SpanOfFolders) -> Iterator[pa.RecordBatch]:
        return _batches(_listed(partition, partition.after, partition.upto))


@dataclass
class SpanOfFolders(Folders):
    """Folders whose files changed in (after, upto], in nanoseconds."""

    after: int = 0
    upto: int = 0


class FolderListing(DataSource):
    """Options: ``roots`` (JSON: root_id to folder), ``rootIds`` (JSON: those to list, all by default),
    ``folders``, and for streams ``settleMs``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return LISTING

    def _roots(self) -> dict[int, str]:
        roots = {int(k): v for k, v in json.loads(self.options["roots"]).items()}
        wanted = json.loads(self.options.get("rootIds", "null"))
        return roots if wanted is None else {k: v for k, v in roots.items() if k in wanted}

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self._roots(), int(self.options.get("folders", FOLDERS)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        settle = int(self.options.get("settleMs", SETTLE_MS))
        return FolderStreamReader(self._roots(), int(self.options.get("folders", FOLDERS)), settle)


def register_folder_source(spark: SparkSession) -> None:
    """Make the format known to the session."""
    ship_package(spark)
    spark.dataSource.register(FolderListing)


def _options(roots: dict[int, str], root_ids: Iterable[int] | None, folders: int) -> dict[str, str]:
    wanted = None if root_ids is None else sorted(int(r) for r in root_ids)
    return {"roots": json.dumps(roots), "rootIds": json.dumps(wanted), "folders": str(folders)}


def read_folders(
    spark: SparkSession, roots: dict[int, str], root_ids: Iterable[int] | None = None, folders: int = FOLDERS
) -> DataFrame:
    register_folder_source(spark)
    return spark.read.format(FORMAT).options(**_options(roots, root_ids, folders)).load()


def stream_folders(
    spark: SparkSession, roots: dict[int, str], root_ids: Iterable[int] | None = None, folders: int = FOLDERS,
    settle_ms: int = SETTLE_MS,
) -> DataFrame:
    register_folder_source(spark)
    reader = spark.readStream.format(FORMAT).options(**_options(roots, root_ids, folders))
    return reader.option("settleMs", settle_ms).load()
