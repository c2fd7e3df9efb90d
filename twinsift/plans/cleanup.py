"""Clean-up batches: draft, confirm and rollback.

What becomes of a confirmed batch is told by ``outcomes.evaluate_confirmed``; movements are input,
written by whoever moves files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.operators import outcomes
from twinsift.operators.planning import job_non_primary_files, plan_items, refused_ids
from twinsift.operators.skew import global_index
from twinsift.session import checkpointed


def draft_job_batch(
    batch_id: str, job_id: str, exact_items: DataFrame, similar_items: DataFrame, files: DataFrame,
    action: str, trash_dir: str, movements: DataFrame | None = None,
) -> DataFrame:
    """Pending items for all non-primaries of a job; item ids follow the file ids."""
    ids = job_non_primary_files(exact_items, similar_items, job_id)
    return draft_batch(batch_id, ids, files, action, trash_dir, movements)


def draft_batch(
    batch_id: str, ids: DataFrame, files: DataFrame, action: str, trash_dir: str,
    movements: DataFrame | None = None,
) -> DataFrame:
    """Pending items of the given files; an empty selection or any refused id refuses the draft."""
    ids = checkpointed(ids.select("file_id").distinct())
    if ids.isEmpty():
        raise ValueError("no files are selected")
    refused = refused_ids(ids, files, action, movements).first()
    if refused is not None:
        raise ValueError(f"file {refused.file_id} cannot be drafted: {refused.reason}")
    plan = plan_items(ids, files, action, trash_dir, movements)
    numbered = global_index(plan, ["file_id"], "item_id", start=1)
    return numbered.select(
        "item_id", F.lit(batch_id).alias("batch_id"), "file_id", "source_path", "target_path", "status",
        F.lit(None).cast("string").alias("error_message"),
    )


def batch_header(
    items: DataFrame, action: str, requested_by: str, requested_at: Column,
    dry_run: bool = False, summary: str | None = None,
) -> DataFrame:
    """One draft row for each batch of drafted items."""
    return items.select("batch_id").distinct().select(
        "batch_id", F.lit(action).alias("action_type"), F.lit("draft").alias("status"),
        F.lit(requested_by).alias("requested_by"), F.lit(int(dry_run)).alias("dry_run"),
        F.lit(summary).cast("string").alias("summary"), requested_at.cast("timestamp").alias("requested_at"),
    )


def confirm(batches: DataFrame, items: DataFrame, hard_delete: bool = False) -> DataFrame:
    """Batches with every draft that can be confirmed confirmed; the others stay as they are."""
    able = outcomes.confirmable(batches, items, hard_delete).where("can_confirm").select(
        "batch_id", F.lit("confirmed").alias("__new")
    )
    return batches.join(able, "batch_id", "left").select(
        *[F.coalesce("__new", "status").alias(c) if c == "status" else F.col(c) for c in batches.columns]
    )


def rollback(source: DataFrame, batch_id: str, movements: DataFrame) -> DataFrame:
    """Restore items of a new batch that undoes the one given source batch."""
    if source.limit(2).count() != 1:
        raise ValueError("a rollback has one source batch")
    return _restore_items(outcomes.rollback_plan(source, movements), F.lit(batch_id))


def rollback_batches(
    sources: DataFrame, movements: DataFrame, requested_by: str, requested_at: Column, prefix: str = "rollback-"
) -> tuple[DataFrame, DataFrame]:
    """(drafted headers, restore items) that undo many batches: each source has a batch of its own,
    named by prefix and source. Sources that cannot be rolled back have none."""
    plan = checkpointed(outcomes.rollback_plan(sources, movements))
    name = F.concat(F.lit(prefix), "rollback_of")
    headers = plan.select("rollback_of").distinct().select(
        name.alias("batch_id"), F.lit("restore").alias("action_type"), F.lit("draft").alias("status"),
        F.lit(requested_by).alias("requested_by"), F.lit(0).alias("dry_run"),
        F.concat(F.lit("rollback_of="), "rollback_of").alias("summary"),
        requested_at.cast("timestamp").alias("requested_at"),
    )
    return headers, _restore_items(plan, name)


def _restore_items(plan: DataFrame, batch_id: Column) -> DataFrame:
    return plan.select(
        F.col("movement_id").alias("item_id"), batch_id.alias("batch_id"), "file_id",
        "source_path", "target_path", "status", F.lit(None).cast("string").alias("error_message"),
    )
