"""Keep the file index current from listings that arrive as a stream.

A micro-batch says which files were seen, not which are gone, so nothing is marked missing
here; that needs a complete listing (:mod:`twinsift.plans.scan`).

Every batch writes only the files it saw, and the hashes it read, to a partition of its own. The index
is the newest row of each file, and the hashes of the newest batch that read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from twinsift.operators import index
from twinsift.schemas import FILE_HASHES, FILES
from twinsift.session import checkpointed
from twinsift.sources.listing import fingerprint_changed, path_attributes
from twinsift.sources.tables import replace_partition

Prints = Callable[[DataFrame], DataFrame]

_BEFORE_ALL = -1


def create_index(
    spark: SparkSession, base: str, files: DataFrame | None = None, file_hashes: DataFrame | None = None
) -> None:
    """Start an index below ``base``, empty or from tables stored elsewhere."""
    tables = {"files": (files, FILES), "file_hashes": (file_hashes, FILE_HASHES)}
    for name, (df, schema) in tables.items():
        start = spark.createDataFrame([], schema) if df is None else df
        replace_partition(start, f"{base}/{name}", "batch", _BEFORE_ALL)


def read_index(spark: SparkSession, base: str, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Current files and hashes, or those before the batch of that number."""

    def written(name: str, schema: T.StructType) -> DataFrame:
        numbered = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        rows = spark.read.schema(numbered).parquet(f"{base}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    newest = F.max_by(F.struct(*FILES.fieldNames()), "batch")
    files = written("files", FILES).groupBy("file_id").agg(newest.alias("row")).select("row.*")
    hashes = written("file_hashes", FILE_HASHES)
    last = hashes.groupBy("file_id").agg(F.max("batch").alias("batch"))
    return files, hashes.join(last, ["file_id", "batch"], "left_semi").select(*FILE_HASHES.fieldNames())


def index_batch(
    batch: DataFrame, base: str, number: int, job_id: str, read_prints: Prints = fingerprint_changed
) -> None:
    """Index one batch of listing rows. Running it again replaces what it wrote.

    Hashes are stored before files: after a crash in between, the batch counts as not run, since it
    starts from the batches before it.
    """
    files, _ = read_index(batch.sparkSession, base, before=number)
    owned = index.resolve_overlapping_roots(batch)
    refreshed = index.refresh_index(files, path_attributes(owned), [], job_id)
    seen = checkpointed(refreshed.where(F.col("last_seen_job_id") == job_id))
    due = seen.where("changed").select("file_id", "abs_path", "size_bytes", "changed")
    replace_partition(read_prints(due), f"{base}/file_hashes", "batch", number)
    replace_partition(seen.drop("changed"), f"{base}/files", "batch", number)


def index_stream(
    listing: DataFrame, base: str, checkpoint: str, job_prefix: str = "stream", read_prints: Prints = fingerprint_changed,
    **trigger,
) -> StreamingQuery:
    """Start a query that indexes a streaming listing. Each batch reads the index of file rows once,
    so use a long trigger interval (or ``availableNow=True``) for a large one."""
    work = lambda batch, number: index_batch(batch, base, number, f"{job_prefix}-{number}", read_prints)
    writer = listing.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
