"""Outcomes of planned actions against a manifest, the movement ledger and rollback.

No file is touched: a manifest (path, is_file) says what exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions import paths as P
from twinsift.operators.naming import next_available_path
from twinsift.operators.skew import attach
from twinsift.session import checkpointed

_ROLLBACK_STATUSES = ["executed", "partially_failed"]


def _with_source(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    sources = manifest.select(F.col("path").alias("source_path"), F.col("is_file").alias("source_is_file"))
    return plan.join(sources, "source_path", "left")


def _judged(checked: DataFrame, columns: list[str], error: Column) -> DataFrame:
    rest = [c for c in columns if c not in ("status", "error_message")]
    return checked.select(
        *rest,
        F.when(error.isNull(), "done").otherwise("failed").alias("status"),
        error.alias("error_message"),
    )


def _pending(plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items still to be carried out, and those already decided, which stay as they are."""
    if "status" not in plan.columns:
        plan = plan.withColumn("status", F.lit("pending"))
    decided = plan if "error_message" in plan.columns else plan.withColumn("error_message", F.lit(None).cast("string"))
    waits = F.coalesce(F.col("status"), F.lit("pending")) == "pending"
    return plan.where(waits), decided.where(~waits)


def evaluate_move(plan: DataFrame, manifest: DataFrame, trash_dir: str) -> DataFrame:
    """Moves of pending items to the trash: done with the final target, or failed with the reason."""
    plan, decided = _pending(plan)
    target = F.coalesce("target_path", P.trash_path(F.col("source_path"), trash_dir))
    error = (
        F.when(F.col("source_is_file").isNull(), F.concat(F.lit("source file not found: "), "source_path"))
        .when(~F.col("source_is_file"), F.concat(F.lit("source path is not a file: "), "source_path"))
        .when(
            ~P.inside_trash(target, trash_dir),
            F.concat(F.lit("target path is not below the trash folder: "), target),
        )
    )
    judged = _judged(_with_source(plan, manifest).withColumn("target_path", target), plan.columns, error)
    moved = next_available_path(judged.where("status = 'done'"), manifest.select("path"))
    return moved.unionByName(judged.where("status = 'failed'")).unionByName(decided)


def evaluate_delete(plan: DataFrame, manifest: DataFrame, hard_delete: bool = False) -> DataFrame:
    """Permanent deletes of pending items; all fail unless hard delete is enabled."""
    plan, decided = _pending(plan)
    if not hard_delete:
        refused = _judged(plan, plan.columns, F.lit("permanent deletion is off (hard_delete=False)"))
        return refused.unionByName(decided)
    error = F.when(
        F.col("source_is_file").isNull(), F.concat(F.lit("source file not found: "), "source_path")
    ).when(~F.col("source_is_file"), F.concat(F.lit("source path is not a file: "), "source_path"))
    return _judged(_with_source(plan, manifest), plan.columns, error).unionByName(decided)


def evaluate_restore(plan: DataFrame, manifest: DataFrame, movements: DataFrame) -> DataFrame:
    """Restores of pending items: the trash copy must exist, its old place be free and the movement
    open. Of several good items with one target the first (smallest item_id, or file_id) is restored.

    ``source_batch_id`` names the batch whose movement a done item closes.
    """
    plan, decided = _pending(plan)
    occupied = manifest.select(F.col("path").alias("target_path"), F.lit(True).alias("target_exists"))
    matched = match_movement(plan, movements).select(
        "file_id", "source_path", "target_path", F.col("batch_id").alias("source_batch_id")
    )
    checked = (
        _with_source(plan, manifest)
        .join(occupied, "target_path", "left")
        .join(matched, ["file_id", "source_path", "target_path"], "left")
    )
    error = (
        F.when(F.col("source_is_file").isNull(), F.concat(F.lit("restore source not found: "), "source_path"))
        .when(~F.col("source_is_file"), F.concat(F.lit("restore source is not a file: "), "source_path"))
        .when(F.coalesce("target_path", F.lit("")) == "", "restore target_path is required")
        .when(F.col("target_exists"), F.concat(F.lit("restore target already exists: "), "target_path"))
        .when(
            F.col("source_batch_id").isNull(),
            F.format_string(
                "restore movement record not found for file_id=%d from=%s to=%s",
                "file_id", "target_path", "source_path",
            ),
        )
    )
    order = F.col("item_id") if "item_id" in plan.columns else F.struct("file_id", "source_path")
    checked = checkpointed(checked.withColumn("__error", error).withColumn("__order", order))
    winners = (
        checked.where("__error IS NULL")
        .groupBy("target_path")
        .agg(F.min("__order").alias("__winner"), F.count(F.lit(1)).alias("__rivals"))
    )
    arbitrated = attach(checked, winners, ["target_path"], ["file_id"], how="left", counts="__rivals")
    error = F.when(
        F.col("__error").isNull() & (F.col("__order") != F.col("__winner")),
        F.concat(F.lit("restore target already exists: "), "target_path"),
    ).otherwise(F.col("__error"))
    judged = _judged(arbitrated, [*plan.columns, "source_batch_id"], error)
    return judged.unionByName(decided.withColumn("source_batch_id", F.lit(None).cast("string")))


def executable(batches: DataFrame, items: DataFrame) -> DataFrame:
    """Whether each batch (batch_id, status) can be carried out, with the reason if not."""
    waits = items.where(F.coalesce("status", F.lit("pending")) == "pending").select("batch_id").distinct()
    error = F.when(F.col("status") != "confirmed", "only confirmed batch can be executed").when(
        F.col("waits").isNull(), "batch has no pending items"
    )
    return batches.join(waits.withColumn("waits", F.lit(True)), "batch_id", "left").select(
        "batch_id", error.isNull().alias("can_execute"), error.alias("error")
    )


def evaluate_confirmed(
    batches: DataFrame, items: DataFrame, manifest: DataFrame, movements: DataFrame, trash_dir: str, hard_delete: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(items, batches) after all confirmed batches (batch_id, action_type, status) were carried out.

    Only pending items of confirmed batches are judged, by the action of their batch; all other items
    and batches stay as they are. ``items`` has item_id, batch_id, file_id, source_path, target_path and
    status; names that several moves want go by item id, whatever their batch.
    """
    if "error_message" not in items.columns:
        items = items.withColumn("error_message", F.lit(None).cast("string"))
    columns = items.columns
    able = executable(batches, items).where("can_execute").select("batch_id")
    action = batches.join(able, "batch_id").select("batch_id", F.col("action_type").alias("__action"))
    sized = items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("__held"))
    told = attach(items, action.join(sized, "batch_id"), ["batch_id"], ["item_id"], how="left", counts="__held")
    told = checkpointed(told.drop("__held"))
    of = lambda kind: told.where(F.col("__action") == kind).select(*columns)
    judged = checkpointed(
        evaluate_move(of("move_to_trash"), manifest, trash_dir).select(*columns)
        .unionByName(evaluate_delete(of("delete_permanent"), manifest, hard_delete).select(*columns))
        .unionByName(evaluate_restore(of("restore"), manifest, movements).select(*columns))
    )
    after = batch_status(judged).select("batch_id", F.col("status").alias("__after"))
    status = F.coalesce("__after", "status").alias("status")
    return (
        told.where("__action IS NULL").select(*columns).unionByName(judged),
        batches.join(after, "batch_id", "left").select(*[status if c == "status" else F.col(c) for c in batches.columns]),
    )


def batch_status(items: DataFrame) -> DataFrame:
    """Status of each batch after its items were carried out."""
    counted = items.groupBy("batch_id").agg(
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    status = (
        F.when(F.col("failed") == 0, "executed").when(F.col("done") > 0, "partially_failed").otherwise("failed")
    )
    return counted.select("batch_id", "done", "failed", status.alias("status"))


def item_stats(items: DataFrame) -> DataFrame:
    """Items per batch, in total and by status."""
    by_status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return items.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[by_status(s) for s in ("pending", "done", "failed", "skipped")],
    )


def latest_unrestored(movements: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Newest open movement of each file, optionally of one batch only."""
    open_rows = movements.where("restored_at IS NULL")
    if batch_id is not None:
        open_rows = open_rows.where(F.col("batch_id") == batch_id)
    rest = [c for c in movements.columns if c not in ("file_id", "movement_id", "restored_at")]
    return (
        open_rows.groupBy("file_id")
        .agg(F.max(F.struct("movement_id", *rest)).alias("m"))
        .select("file_id", "m.*")
    )


def open_movements(movements: DataFrame, batch_id: str) -> DataFrame:
    return movements.where((F.col("batch_id") == batch_id) & F.col("restored_at").isNull()).orderBy("movement_id")


def open_movement_counts(movements: DataFrame) -> DataFrame:
    """Movements of each batch and how many are still open."""
    return movements.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("movements"),
        F.count_if(F.col("restored_at").isNull()).alias("open"),
    )


def match_movement(items: DataFrame, movements: DataFrame) -> DataFrame:
    """Newest open movement that each restore item (file, trash path, old path) undoes."""
    newest = (
        movements.where("restored_at IS NULL")
        .groupBy("file_id", F.col("to_path").alias("source_path"), F.col("from_path").alias("target_path"))
        .agg(F.max(F.struct("movement_id", "batch_id")).alias("m"))
    )
    wanted = items.select("file_id", "source_path", "target_path").distinct()
    return wanted.join(newest, ["file_id", "source_path", "target_path"]).select(
        "file_id", "source_path", "target_path", "m.movement_id", "m.batch_id"
    )


def rollback_verdict(batches: DataFrame, movements: DataFrame) -> DataFrame:
    """Whether each batch can be rolled back, with the reason if not."""
    open_batches = movements.where("restored_at IS NULL").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("open_movements")
    )
    error = (
        F.when(F.col("action_type") != "move_to_trash", "rollback is supported only for move_to_trash batches")
        .when(
            ~F.col("status").isin(_ROLLBACK_STATUSES),
            "rollback is allowed only for executed/partially_failed batches",
        )
        .when(F.col("open_movements").isNull(), "rollback is unavailable: no unrestored file movements found")
    )
    return batches.join(open_batches, "batch_id", "left").select(
        "batch_id", F.coalesce("open_movements", F.lit(0)).alias("open_movements"), error.alias("error")
    )


def rollback_plan(batches: DataFrame, movements: DataFrame) -> DataFrame:
    """Restore items that undo the open movements of every batch that can be rolled back."""
    able = batches.where(
        (F.col("action_type") == "move_to_trash") & F.col("status").isin(_ROLLBACK_STATUSES)
    ).select("batch_id")
    open_rows = movements.where("restored_at IS NULL")
    return attach(open_rows, able.distinct(), ["batch_id"], ["movement_id"], how="left_semi").select(
        F.col("batch_id").alias("rollback_of"),
        "movement_id",
        "file_id",
        F.col("to_path").alias("source_path"),
        F.col("from_path").alias("target_path"),
        F.lit("pending").alias("status"),
    )


def close_movements(movements: DataFrame, restores: DataFrame, now: Column) -> DataFrame:
    """Ledger with the movement of each done restore closed at ``now``."""
    closed = match_movement(restores.where("status = 'done'"), movements).select(
        "movement_id", F.lit(True).alias("closed")
    )
    at = F.when(F.col("closed"), now.cast("timestamp")).otherwise(F.col("restored_at"))
    return movements.join(closed, "movement_id", "left").select(
        *[at.alias(c) if c == "restored_at" else F.col(c) for c in movements.columns]
    )


def rolled_back(batches: DataFrame, movements: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Batches with the status after restores: ``rolled_back`` once no movement is open.

    ``touched`` (batch_id) names the batches a restore worked on; by default every batch with a
    movement counts.
    """
    touched = movements if touched is None else touched
    done = touched.select("batch_id").distinct().join(
        movements.where("restored_at IS NULL").select("batch_id").distinct(), "batch_id", "left_anti"
    )
    marked = batches.join(done.withColumn("closed", F.lit(True)), "batch_id", "left")
    status = F.when(
        F.col("closed") & F.col("status").isin(_ROLLBACK_STATUSES), "rolled_back"
    ).otherwise(F.col("status"))
    return marked.select(*[status.alias(c) if c == "status" else F.col(c) for c in batches.columns])


def confirmable(batches: DataFrame, items: DataFrame, hard_delete: bool = False) -> DataFrame:
    """Whether each batch can be confirmed, with the reason if not."""
    filled = items.select("batch_id").distinct().withColumn("filled", F.lit(True))
    error = (
        F.when(F.col("status") != "draft", "only draft batch can be confirmed")
        .when(F.col("filled").isNull(), "batch has no action items")
        .when(
            (F.col("action_type") == "delete_permanent") & F.lit(not hard_delete),
            "permanent deletion is off (hard_delete=False)",
        )
    )
    return batches.join(filled, "batch_id", "left").select(
        "batch_id", error.isNull().alias("can_confirm"), error.alias("error")
    )
