"""Incremental file index: change detection, upserts and missing files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.operators.skew import global_index
from twinsift.session import checkpointed

# Attributes a listing does not carry are overwritten with null by an upsert, as are all
# others: only the file id and the job that first saw the file are kept.
_KEPT = ["file_id", "first_seen_job_id"]


def detect_changes(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``is_new`` and ``changed`` to a listing by comparing it with the index.

    Size and modification time must match; inode and device only where the listing knows
    them; a file that was marked missing counts as changed when it is back.
    """
    old = files.select(
        "abs_path", "file_id",
        *[F.col(c).alias(f"old_{c}") for c in ("size_bytes", "mtime_epoch_ns", "inode", "dev", "is_present")],
    )
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    is_new = F.col("file_id").isNull()
    changed = (
        is_new
        | differs("size_bytes")
        | differs("mtime_epoch_ns")
        | (F.col("inode").isNotNull() & differs("inode"))
        | (F.col("dev").isNotNull() & differs("dev"))
        | ~F.col("old_is_present").eqNullSafe(F.lit(1))
    )
    return listing.join(old, "abs_path", "left").select(
        *[F.col(c) for c in listing.columns], "file_id", is_new.alias("is_new"), changed.alias("changed")
    )


def resolve_overlapping_roots(listing: DataFrame) -> DataFrame:
    """One row per path; with overlapping roots the highest root owns the file."""
    rest = [c for c in listing.columns if c not in ("abs_path", "root_id")]
    owner = F.max(F.struct("root_id", *rest)).alias("owner")
    return listing.groupBy("abs_path").agg(owner).select("abs_path", "owner.*").select(*listing.columns)


def upsert_files(files: DataFrame, listing: DataFrame, job_id: str, now: Column | None = None) -> DataFrame:
    """Index after a scan: listed files inserted or overwritten, all others unchanged.

    ``listing`` has one row per path. New ids continue after the highest id in path order.
    """
    return refresh_index(files, listing, [], job_id, now).drop("changed")


def mark_missing(
    files: DataFrame, listing: DataFrame, root_ids: Iterable[int], job_id: str, now: Column | None = None
) -> DataFrame:
    """Files of the scanned roots that are no longer listed become not present."""
    now = F.current_timestamp() if now is None else now
    seen = listing.select("abs_path").distinct().withColumn("seen", F.lit(True))
    gone = (
        F.col("seen").isNull()
        & F.col("root_id").isin([int(r) for r in root_ids])
        & (F.col("is_present") != 0)
    )
    marked = {"is_present": F.lit(0), "last_seen_job_id": F.lit(job_id), "updated_at": now}
    return files.join(seen, "abs_path", "left").select(
        *[
            F.when(gone, marked[c].cast(files.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c in marked
            else F.col(c)
            for c in files.columns
        ]
    )


def refresh_index(
    files: DataFrame, listing: DataFrame, root_ids: Iterable[int], job_id: str, now: Column | None = None
) -> DataFrame:
    """Index after a scan with ``changed`` per row: detect, upsert and mark missing in one join.

    Gives what :func:`detect_changes`, :func:`upsert_files` and :func:`mark_missing` give one
    after another, but shuffles the index and the listing (one row per path) only once. An index
    that is stored in buckets of the path (``sources.tables.save_bucketed``) is not shuffled at all.
    """
    now = F.current_timestamp() if now is None else now
    listed = [c for c in files.columns if c in listing.columns and c not in ("abs_path", *_KEPT)]
    old = files.withColumn("indexed", F.lit(True))
    new = listing.select("abs_path", F.lit(True).alias("listed"), *[F.col(c).alias(f"new_{c}") for c in listed])
    is_new, seen = F.col("indexed").isNull(), F.col("listed").isNotNull()
    differs = lambda c: ~F.col(f"new_{c}").eqNullSafe(F.col(c))
    changed = seen & (
        is_new
        | differs("size_bytes")
        | differs("mtime_epoch_ns")
        | (F.col("new_inode").isNotNull() & differs("inode"))
        | (F.col("new_dev").isNotNull() & differs("dev"))
        | ~F.col("is_present").eqNullSafe(F.lit(1))
    )
    gone = ~seen & F.col("root_id").isin([int(r) for r in root_ids]) & (F.col("is_present") != 0)

    def value(c: str) -> Column:
        kind = files.schema[c].dataType
        if c in ("abs_path", "file_id"):
            return F.col(c)
        if c == "first_seen_job_id":
            return F.when(is_new, F.lit(job_id)).otherwise(F.col(c)).alias(c)
        if c == "updated_at":
            return F.when(is_new | gone, now.cast(kind)).otherwise(F.col(c)).alias(c)
        if c == "last_seen_job_id":
            return F.when(seen | gone, F.lit(job_id)).otherwise(F.col(c)).alias(c)
        if c == "is_present":
            return F.when(seen, 1).when(gone, 0).otherwise(F.col(c)).cast(kind).alias(c)
        fresh = F.col(f"new_{c}") if c in listed else F.lit(None)
        return F.when(seen, fresh.cast(kind)).otherwise(F.col(c)).alias(c)

    merged = checkpointed(
        old.join(new, "abs_path", "full_outer").select(
            *[value(c) for c in files.columns], changed.alias("changed"), is_new.alias("is_new")
        )
    )
    last_id = merged.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
    fresh = global_index(merged.where("is_new").drop("file_id"), ["abs_path"], "file_id", start=last_id + 1)
    return merged.where("NOT is_new").unionByName(fresh).drop("is_new")


def upsert_hashes(file_hashes: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    """Latest value per file and hash type; ``seq`` orders repeated new values."""
    key = ["file_id", "hash_type"]
    if seq:
        new = new.groupBy(*key).agg(F.max_by("hash_hex", seq).alias("hash_hex"))
    # Used twice: pinned, so that a reader behind it opens each file once.
    new = checkpointed(new.select(*key, "hash_hex"))
    kept = file_hashes.join(new.select(*key), key, "left_anti")
    return kept.select(*key, "hash_hex").unionByName(new.select(*key, "hash_hex"))


def scan_metrics(listing: DataFrame, changes: DataFrame) -> DataFrame:
    """files_seen counts a path once per root that lists it, files_indexed once."""
    seen = listing.select(F.lit(1).alias("seen"), F.lit(0).alias("indexed"))
    indexed = changes.select(F.lit(0).alias("seen"), F.col("changed").cast("int").alias("indexed"))
    return seen.unionByName(indexed).agg(
        F.coalesce(F.sum("seen"), F.lit(0)).alias("files_seen"),
        F.coalesce(F.sum("indexed"), F.lit(0)).alias("files_indexed"),
    )
