"""Groups of byte-identical files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.skew import attach
from twinsift.schemas import CONTENT_HASH
from twinsift.sources.tables import files_in_roots


def exact_candidates(
    files: DataFrame, file_hashes: DataFrame, root_ids: Iterable[int] | None = None
) -> DataFrame:
    """Present files of the roots with their content hash."""
    present = files_in_roots(files, root_ids).select("file_id", "size_bytes")
    signed = file_hashes.where(F.col("hash_type") == CONTENT_HASH).select(
        "file_id", F.col("hash_hex").alias("signature")
    )
    return present.join(signed, "file_id")


def size_prefilter(files: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Files whose size occurs at least twice: only these can have an exact copy."""
    sizes = (
        files.groupBy("size_bytes")
        .agg(F.count(F.lit(1)).alias("same_size"))
        .where(F.col("same_size") > 1)
    )
    return attach(files, sizes, ["size_bytes"], ["file_id"], counts="same_size", hot_rows=hot_rows).select(
        *files.columns
    )


def exact_groups(candidates: DataFrame, job_id: str) -> DataFrame:
    """One row per signature shared by two or more files."""
    return (
        candidates.groupBy("signature")
        .agg(
            F.count(F.lit(1)).alias("file_count"),
            F.sum("size_bytes").alias("total_bytes"),
            (F.sum("size_bytes") - F.max("size_bytes")).alias("reclaimable_bytes"),
        )
        .where(F.col("file_count") > 1)
        .select(F.lit(job_id).alias("job_id"), "signature", "file_count", "total_bytes", "reclaimable_bytes")
    )


def exact_group_items(candidates: DataFrame, job_id: str, hot_rows: int | None = None) -> DataFrame:
    """Members of the groups; the lowest file id is the first primary."""
    heads = (
        candidates.groupBy("signature")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("file_id").alias("first_id"))
        .where(F.col("copies") > 1)
    )
    members = attach(candidates, heads, ["signature"], ["file_id"], counts="copies", hot_rows=hot_rows)
    return members.select(
        F.lit(job_id).alias("job_id"),
        "signature",
        "file_id",
        (F.col("file_id") == F.col("first_id")).cast("int").alias("is_primary"),
    )


def exact_totals(groups: DataFrame) -> DataFrame:
    """Number of groups and bytes that could be freed."""
    return groups.agg(
        F.count(F.lit(1)).alias("groups_found"),
        F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).cast("long").alias("reclaimable_bytes"),
    )
