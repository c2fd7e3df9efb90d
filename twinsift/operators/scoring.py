"""Which copy of a group to keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.operators.skew import attach
from twinsift.session import checkpointed

# Points and names of the rules, in the order the reasons are listed.
RULES = [
    ("max_resolution", 5.0),
    ("max_size", 3.0),
    ("has_exif_datetime", 2.0),
    ("earliest_mtime", 1.0),
]
FALLBACK_REASON = "fallback_lowest_file_id"

# What scoring needs to know of a file.
FILE_COLUMNS = ["width", "height", "size_bytes", "exif_datetime_original", "mtime_epoch_ns"]


def resolution() -> Column:
    return F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0)).cast("long")


def with_file_attributes(items: DataFrame, files: DataFrame) -> DataFrame:
    return items.join(files.select("file_id", *FILE_COLUMNS), "file_id")


def group_extremes(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best resolution and size and earliest time per group (items joined to their files)."""
    return members.groupBy(*keys).agg(
        F.max(resolution()).alias("max_resolution"),
        F.max("size_bytes").alias("max_size"),
        F.min("mtime_epoch_ns").alias("min_mtime"),
        F.count(F.lit(1)).alias("members"),
    )


def _rule_hits() -> dict[str, Column]:
    return {
        "max_resolution": (resolution() > 0) & (resolution() == F.col("max_resolution")),
        "max_size": F.col("size_bytes") == F.col("max_size"),
        "has_exif_datetime": F.coalesce("exif_datetime_original", F.lit("")) != "",
        "earliest_mtime": F.col("mtime_epoch_ns") == F.col("min_mtime"),
    }


def keep_score() -> Column:
    """Points of a member, with its group extremes in the same row."""
    hits = _rule_hits()
    return sum((F.when(hits[name], points).otherwise(0.0) for name, points in RULES), F.lit(0.0))


def keep_reason() -> Column:
    hits = _rule_hits()
    listed = F.concat_ws(",", *[F.when(hits[name], name) for name, _ in RULES])
    return F.coalesce(F.nullif(listed, F.lit("")), F.lit(FALLBACK_REASON))


def choose_primary(
    scored: DataFrame, keys: Sequence[str], hot_rows: int | None = None, total: int | None = None
) -> DataFrame:
    """Exactly one primary per group: most points, then the lowest file id."""
    best = F.struct((-F.col("keep_score")).alias("points"), F.col("file_id"))
    winners = scored.groupBy(*keys).agg(
        F.min(best)["file_id"].alias("winner"), F.count(F.lit(1)).alias("members")
    )
    rest = [c for c in scored.columns if c != "is_primary"]
    joined = attach(
        scored.select(*rest), winners, keys, ["file_id"], counts="members", hot_rows=hot_rows, total=total
    )
    return joined.select(*rest, (F.col("file_id") == F.col("winner")).cast("int").alias("is_primary"))


def score_groups(
    items: DataFrame, files: DataFrame, keys: Sequence[str], hot_rows: int | None = None
) -> DataFrame:
    """Items with keep_score, reason and a new is_primary; all other columns stay."""
    members = checkpointed(with_file_attributes(items.drop("is_primary", "keep_score", "reason"), files))
    total = members.count()
    extremes = group_extremes(members, keys)
    rated = attach(members, extremes, keys, ["file_id"], counts="members", hot_rows=hot_rows, total=total)
    kept = [c for c in items.columns if c not in ("is_primary", "keep_score", "reason")]
    scored = rated.select(*kept, keep_score().alias("keep_score"), keep_reason().alias("reason"))
    return choose_primary(scored, keys, hot_rows=hot_rows, total=total)


def score_summary(exact_items: DataFrame, similar_items: DataFrame) -> DataFrame:
    """Number of groups rated per kind."""
    groups = exact_items.select(F.lit("exact").alias("kind"), "job_id", F.col("signature").alias("key")).unionByName(
        similar_items.select(
            F.lit("similar").alias("kind"), "job_id", F.col("anchor_file_id").cast("string").alias("key")
        )
    ).distinct()
    return groups.agg(
        F.count_if(F.col("kind") == "exact").alias("exact_groups_updated"),
        F.count_if(F.col("kind") == "similar").alias("similar_groups_updated"),
    )
