"""Previews and plans of clean-up actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions import paths as P
from twinsift.operators.outcomes import latest_unrestored
from twinsift.schemas import ACTION_TYPES


def _check_action(action: str) -> str:
    clean = action.strip().lower()
    if clean not in ACTION_TYPES:
        raise ValueError(f"action_type must be one of: {', '.join(ACTION_TYPES)}")
    return clean


def normalize_file_ids(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct positive ids with their first position, rejected ids) of (file_id, pos)."""
    kept = ids.where(F.col("file_id") > 0).groupBy("file_id").agg(F.min("pos").alias("pos"))
    return kept, ids.where(F.col("file_id") <= 0)


def missing_file_ids(ids: DataFrame, files: DataFrame) -> DataFrame:
    return ids.select("file_id").distinct().join(files.select("file_id"), "file_id", "left_anti")


def preview(ids: DataFrame, files: DataFrame, action: str, movements: DataFrame | None = None) -> DataFrame:
    """One row: files, bytes and reclaimable bytes (none for a restore) of a selection.

    ``missing_files`` counts ids that are not indexed and ``not_restorable`` files without an
    open movement; the action is possible only when both are zero.
    """
    action = _check_action(action)
    selected = ids.select("file_id").distinct().join(
        files.select("file_id", "size_bytes", F.lit(True).alias("known")), "file_id", "left"
    )
    if action == "restore":
        open_files = movements.where("restored_at IS NULL").select("file_id", F.lit(True).alias("open")).distinct()
        selected = selected.join(open_files, "file_id", "left")
        not_restorable = F.count_if(F.col("known") & F.col("open").isNull())
    else:
        not_restorable = F.lit(0).cast("long")
    total = F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long")
    return selected.agg(
        F.count("known").alias("files_count"),
        total.alias("total_bytes"),
        (F.lit(0).cast("long") if action == "restore" else total).alias("estimated_reclaimable_bytes"),
        F.count_if(F.col("known").isNull()).alias("missing_files"),
        not_restorable.alias("not_restorable"),
    ).select(F.lit(action).alias("action_type"), "*")


def preview_selection(ids: DataFrame, files: DataFrame, action: str, movements: DataFrame | None = None) -> DataFrame:
    """Preview of files that were picked one by one (file_id, pos): an empty pick is refused, as are
    ids that are not positive. A whole job without anything to clean up has a preview of zeros instead."""
    kept, rejected = normalize_file_ids(ids)
    bad = rejected.first()
    if bad is not None:
        raise ValueError(f"file_ids must be positive, not {bad.file_id}")
    if kept.isEmpty():
        raise ValueError("file_ids must not be empty")
    return preview(kept, files, action, movements)


def job_non_primary_files(exact_items: DataFrame, similar_items: DataFrame, job_id: str) -> DataFrame:
    """File ids that are a non-primary in a group of either kind."""
    pick = lambda items: items.where((F.col("job_id") == job_id) & (F.col("is_primary") == 0)).select("file_id")
    return pick(exact_items).unionByName(pick(similar_items)).distinct()


def job_preview(
    job_id: str, exact_items: DataFrame, similar_items: DataFrame, files: DataFrame, action: str,
    movements: DataFrame | None = None,
) -> DataFrame:
    """Preview of all non-primaries of a job, all zero when there are none.

    ``doomed_signatures`` counts exact groups of which every copy is selected. It is a warning
    only: conflicting choices in the two kinds of groups can select the last copy of a file.
    """
    ids = job_non_primary_files(exact_items, similar_items, job_id)
    numbers = preview(ids, files, action, movements)
    copies = exact_items.where(F.col("job_id") == job_id).select("signature", "file_id")
    chosen = copies.join(ids.withColumn("chosen", F.lit(1)), "file_id", "left")
    doomed = (
        chosen.groupBy("signature")
        .agg(F.min(F.coalesce("chosen", F.lit(0))).alias("all_chosen"))
        .agg(F.count_if(F.col("all_chosen") == 1).alias("doomed_signatures"))
    )
    columns = numbers.columns
    both = numbers.withColumn("doomed_signatures", F.lit(0).cast("long")).unionByName(
        doomed.select(
            F.lit(None).cast("string").alias("action_type"),
            *[F.lit(0).cast("long").alias(c) for c in columns[1:]],
            "doomed_signatures",
        )
    )
    return both.agg(
        F.max("action_type").alias("action_type"),
        *[F.sum(c).alias(c) for c in columns[1:]],
        F.sum("doomed_signatures").alias("doomed_signatures"),
    )


def refused_ids(
    ids: DataFrame, files: DataFrame, action: str, movements: DataFrame | None = None
) -> DataFrame:
    """Selected ids that no item can be planned for, each with the reason."""
    action = _check_action(action)
    judged = ids.select("file_id").distinct().join(
        files.select("file_id", F.lit(True).alias("known")), "file_id", "left"
    )
    reason = F.when(F.coalesce("file_id", F.lit(0)) <= 0, "id is not positive").when(
        F.col("known").isNull(), "file is not indexed"
    )
    if action == "restore":
        moved = movements.where("restored_at IS NULL").select("file_id", F.lit(True).alias("moved")).distinct()
        judged = judged.join(moved, "file_id", "left")
        reason = reason.when(F.col("moved").isNull(), "file has no open movement")
    return judged.select("file_id", reason.alias("reason")).where("reason IS NOT NULL")


def plan_items(
    ids: DataFrame, files: DataFrame, action: str, trash_dir: str, movements: DataFrame | None = None
) -> DataFrame:
    """Pending items: where each file is and where it goes (nowhere for a delete).

    The ids of :func:`refused_ids` have no item.
    """
    action = _check_action(action)
    wanted = ids.select("file_id").distinct()
    if action == "restore":
        latest = latest_unrestored(movements)
        placed = wanted.join(latest, "file_id").select(
            "file_id", F.col("to_path").alias("source_path"), F.col("from_path").alias("target_path")
        )
    else:
        source = F.col("abs_path")
        target = P.trash_path(source, trash_dir) if action == "move_to_trash" else F.lit(None).cast("string")
        placed = wanted.join(files.select("file_id", "abs_path"), "file_id").select(
            "file_id", source.alias("source_path"), target.alias("target_path")
        )
    return placed.withColumn("status", F.lit("pending"))
