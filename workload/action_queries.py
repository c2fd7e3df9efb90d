"""Clean-up plans, outcomes, ledger and rollback."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift.functions import paths as P
from twinsift.operators import naming, outcomes, planning
from twinsift.plans import cleanup
from workload import derived as d
from workload.registry import query


def _event_ids(spark, sf):
    """File ids as events name them: repeated, and shifted so that some are not positive."""
    return d.table(spark, sf, "events").select((F.col("user_id") - 5).alias("file_id"), F.col("event_id").alias("pos"))


@query("SELECT user_id - 5 AS file_id, min(event_id) AS pos FROM events WHERE user_id > 5 GROUP BY 1")
def a1_normalize_file_ids(spark, sf):
    return planning.normalize_file_ids(_event_ids(spark, sf))[0]


@query("SELECT user_id - 5 AS file_id, event_id AS pos FROM events WHERE user_id <= 5")
def a1_rejected_file_ids(spark, sf):
    return planning.normalize_file_ids(_event_ids(spark, sf))[1]


@query("SELECT DISTINCT o_custkey AS file_id FROM orders WHERE o_custkey NOT IN (SELECT file_id FROM files)")
def a2_missing_file_ids(spark, sf):
    ids = d.table(spark, sf, "orders").select(F.col("o_custkey").alias("file_id"))
    return planning.missing_file_ids(ids, d.files(spark, sf))


@query("""
    SELECT 'move_to_trash' AS action_type, count(f.file_id) AS files_count, coalesce(sum(size_bytes), 0)::BIGINT AS total_bytes,
           coalesce(sum(size_bytes), 0)::BIGINT AS estimated_reclaimable_bytes, count_if(f.file_id IS NULL)::BIGINT AS missing_files,
           0::BIGINT AS not_restorable
    FROM (SELECT DISTINCT o_custkey AS file_id FROM orders) o LEFT JOIN files f USING (file_id)""")
def a3_preview_move(spark, sf):
    ids = d.table(spark, sf, "orders").select(F.col("o_custkey").alias("file_id"))
    return planning.preview(ids, d.files(spark, sf), "move_to_trash")


@query("""
    SELECT 'restore' AS action_type, count(*) AS files_count, coalesce(sum(size_bytes), 0)::BIGINT AS total_bytes,
           0::BIGINT AS estimated_reclaimable_bytes, 0::BIGINT AS missing_files,
           count_if(file_id NOT IN (SELECT file_id FROM movements WHERE NOT restored))::BIGINT AS not_restorable
    FROM files""")
def a3_preview_restore(spark, sf):
    files = d.files(spark, sf)
    return planning.preview(files, files, "restore", d.file_movements(spark, sf))


@query("SELECT DISTINCT file_id FROM items WHERE is_primary = 0")
def a4_job_non_primary_files(spark, sf):
    return planning.job_non_primary_files(d.exact_items(spark, sf), d.similar_items(spark, sf), d.JOB)


@query("""
    SELECT 'delete_permanent' AS action_type, count(*) AS files_count, coalesce(sum(size_bytes), 0)::BIGINT AS total_bytes,
           coalesce(sum(size_bytes), 0)::BIGINT AS estimated_reclaimable_bytes, 0::BIGINT AS missing_files, 0::BIGINT AS not_restorable,
           (SELECT count(*) FROM (SELECT group_key FROM items i WHERE group_kind = 'exact' GROUP BY group_key
              HAVING count(*) = count_if(file_id IN (SELECT file_id FROM items WHERE is_primary = 0))))::BIGINT AS doomed_signatures
    FROM files WHERE file_id IN (SELECT file_id FROM items WHERE is_primary = 0)""")
def a5_job_preview(spark, sf):
    return planning.job_preview(
        d.JOB, d.exact_items(spark, sf), d.similar_items(spark, sf), d.files(spark, sf), "delete_permanent"
    )


@query("""
    SELECT file_id, abs_path AS source_path, '/nas/.trash' || abs_path AS target_path, 'pending' AS status
    FROM files WHERE file_id IN (SELECT file_id FROM items WHERE is_primary = 0)""")
def a6_plan_move(spark, sf):
    ids = planning.job_non_primary_files(d.exact_items(spark, sf), d.similar_items(spark, sf), d.JOB)
    return planning.plan_items(ids, d.files(spark, sf), "move_to_trash", d.TRASH)


@query("""
    SELECT file_id, to_path AS source_path, from_path AS target_path, 'pending' AS status FROM movements
    WHERE NOT restored QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY movement_id DESC) = 1""")
def a6_plan_restore(spark, sf):
    moves = d.file_movements(spark, sf)
    return planning.plan_items(moves, d.files(spark, sf), "restore", d.TRASH, moves)


@query("""
    SELECT file_id, '/nas/.trash' || abs_path AS trash_path, abs_path LIKE '/nas/root1/%' AS inside FROM files""")
def a7_trash_path(spark, sf):
    path = F.col("abs_path")
    return d.files(spark, sf).select(
        "file_id", P.trash_path(path, d.TRASH).alias("trash_path"), P.inside_trash(path, "/nas/root1").alias("inside")
    )


@query("""
    SELECT item_id, CASE WHEN n = 0 THEN t ELSE t[:-5] || '.' || n || '.txt' END AS target_path
    FROM (SELECT item_id, '/nas/.trash' || abs_path AS t,
                 row_number() OVER (PARTITION BY file_id ORDER BY item_id) - 1
                 + CASE WHEN doc_id % 10 = 0 THEN 2 WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n
          FROM action_items JOIN files USING (file_id))""")
def a8_next_available_path(spark, sf):
    """All items of all batches at once, so that many want the same name."""
    plan = d.action_items(spark, sf).select("item_id", P.trash_path(F.col("source_path"), d.TRASH).alias("target_path"))
    return naming.next_available_path(plan, d.trash_listing(spark, sf))


@query("""
    SELECT file_id, CASE WHEN e = '' THEN CASE WHEN doc_id % 10 = 0 THEN t[:-5] || '.2.txt' WHEN doc_id % 5 = 0 THEN t[:-5] || '.1.txt' ELSE t END
             ELSE t END AS target_path, CASE WHEN e = '' THEN 'done' ELSE 'failed' END AS status, e AS error_message
    FROM (SELECT file_id, doc_id, '/nas/.trash' || abs_path AS t,
                 CASE WHEN is_present = 0 THEN 'source file not found: ' || abs_path
                      WHEN doc_id % 17 = 0 THEN 'source path is not a file: ' || abs_path ELSE '' END AS e FROM files)""")
def a9_evaluate_move(spark, sf):
    files = d.files(spark, sf)
    plan = planning.plan_items(files, files, "move_to_trash", d.TRASH).withColumn("item_id", F.col("file_id"))
    done = outcomes.evaluate_move(plan, d.manifest(spark, sf), d.TRASH)
    return done.select("file_id", "target_path", "status", F.coalesce("error_message", F.lit("")).alias("error_message"))


def _batches_to_execute(spark, sf):
    """Every second batch is confirmed; a third of the items wait."""
    number = F.split("batch_id", "-")[1].cast("long")
    confirmed = (number % 2 == 1) & (number % 10 != 9) & (number % 7 != 6)
    batches = d.action_batches(spark, sf).select(
        "batch_id",
        F.when(number % 7 == 5, "delete_permanent").otherwise(F.col("action_type")).alias("action_type"),
        F.when(confirmed, "confirmed").otherwise(F.col("status")).alias("status"),
    )
    items = d.action_items(spark, sf).select(
        "item_id", "batch_id", "file_id", "source_path", F.lit(None).cast("string").alias("target_path"),
        F.when(F.col("item_id") % 3 == 0, "pending").otherwise(F.col("status")).alias("status"),
    )
    return batches, items


_DUE = """
    SELECT i.item_id, i.b, i.file_id, doc_id, '/nas/.trash' || abs_path AS t, i.batch_id,
           CASE WHEN i.item_id % 3 = 0 THEN 'pending' ELSE i.status END AS status,
           i.item_id % 3 = 0 AND b % 2 = 1 AND b % 10 <> 9 AND b % 7 <> 6 AS due, b % 7 = 5 AS deletes,
           CASE WHEN is_present = 0 THEN 'source file not found: ' || abs_path
                WHEN doc_id % 17 = 0 THEN 'source path is not a file: ' || abs_path ELSE '' END AS e
    FROM action_items i JOIN files f USING (file_id)"""


@query(f"""
    SELECT item_id, CASE WHEN NOT due THEN status WHEN e = '' THEN 'done' ELSE 'failed' END AS status,
           CASE WHEN due THEN e ELSE '' END AS error_message,
           CASE WHEN NOT due OR deletes THEN '' WHEN e <> '' OR n = 0 THEN t ELSE t[:-5] || '.' || n || '.txt' END AS target_path
    FROM (SELECT *, row_number() OVER (PARTITION BY due AND NOT deletes AND e = '', file_id ORDER BY item_id) - 1
                 + CASE WHEN doc_id % 10 = 0 THEN 2 WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n FROM ({_DUE}))""")
def a9_evaluate_confirmed(spark, sf):
    """Only pending items of confirmed batches are carried out, each by the action of its batch."""
    batches, items = _batches_to_execute(spark, sf)
    done, _ = outcomes.evaluate_confirmed(
        batches, items, d.manifest(spark, sf), d.file_movements(spark, sf), d.TRASH, hard_delete=True)
    return done.select(
        "item_id", "status", *[F.coalesce(c, F.lit("")).alias(c) for c in ("error_message", "target_path")])


@query(f"""
    SELECT batch_id, b % 2 = 1 AND b % 10 <> 9 AND b % 7 <> 6 AS can_execute,
           CASE WHEN b % 2 = 1 AND b % 10 <> 9 AND b % 7 <> 6 THEN '' ELSE 'only confirmed batch can be executed' END AS error
    FROM (SELECT DISTINCT b, batch_id FROM ({_DUE}))""")
def a9_executable_batches(spark, sf):
    verdict = outcomes.executable(*_batches_to_execute(spark, sf))
    return verdict.withColumn("error", F.coalesce("error", F.lit("")))


@query("""
    SELECT file_id, CASE WHEN is_present = 0 THEN 'source file not found: ' || abs_path
             WHEN doc_id % 17 = 0 THEN 'source path is not a file: ' || abs_path ELSE '' END AS error_message
    FROM files""")
def a9_evaluate_delete(spark, sf):
    files = d.files(spark, sf)
    plan = planning.plan_items(files, files, "delete_permanent", d.TRASH)
    done = outcomes.evaluate_delete(plan, d.manifest(spark, sf), hard_delete=True)
    return done.select("file_id", F.coalesce("error_message", F.lit("")).alias("error_message"))


@query("""
    SELECT m.file_id, CASE WHEN doc_id % 5 <> 0 THEN 'restore source not found: ' || to_path
             WHEN is_present = 1 THEN 'restore target already exists: ' || from_path ELSE '' END AS error_message
    FROM movements m JOIN files f USING (file_id) WHERE NOT restored
    QUALIFY row_number() OVER (PARTITION BY m.file_id ORDER BY movement_id DESC) = 1""")
def a9_evaluate_restore(spark, sf):
    moves = d.file_movements(spark, sf)
    plan = planning.plan_items(moves, d.files(spark, sf), "restore", d.TRASH, moves)
    done = outcomes.evaluate_restore(plan, d.manifest(spark, sf), moves)
    return done.select("file_id", F.coalesce("error_message", F.lit("")).alias("error_message"))


@query("SELECT batch_id, done, failed, status FROM batch_states")
def a10_batch_status(spark, sf):
    return outcomes.batch_status(d.action_items(spark, sf))


@query("""
    SELECT batch_id, count(*) AS total, count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'done')::BIGINT AS done,
           count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'skipped')::BIGINT AS skipped
    FROM action_items GROUP BY batch_id""")
def a11_item_stats(spark, sf):
    return outcomes.item_stats(d.action_items(spark, sf))


@query("SELECT file_id, max(movement_id) AS movement_id, max_by(batch_id, movement_id) AS batch_id FROM movements WHERE NOT restored GROUP BY file_id")
def a12_latest_unrestored(spark, sf):
    return outcomes.latest_unrestored(d.file_movements(spark, sf)).select("file_id", "movement_id", "batch_id")


@query("SELECT movement_id, file_id, from_path, to_path FROM movements WHERE batch_id = 'batch-2' AND NOT restored ORDER BY movement_id")
def a13_open_movements(spark, sf):
    rows = outcomes.open_movements(d.file_movements(spark, sf), "batch-2")
    return rows.select("movement_id", "file_id", "from_path", "to_path")


@query("SELECT batch_id, count(*) AS movements, count_if(NOT restored)::BIGINT AS open FROM movements GROUP BY batch_id")
def a13_open_movement_counts(spark, sf):
    return outcomes.open_movement_counts(d.file_movements(spark, sf))


@query("""
    SELECT file_id, to_path AS source_path, from_path AS target_path, max(movement_id) AS movement_id, max_by(batch_id, movement_id) AS batch_id
    FROM movements WHERE NOT restored GROUP BY ALL""")
def a14_match_movement(spark, sf):
    files = d.files(spark, sf).select(
        "file_id", P.trash_path(F.col("abs_path"), d.TRASH).alias("source_path"), F.col("abs_path").alias("target_path")
    )
    return outcomes.match_movement(files, d.file_movements(spark, sf))


@query("""
    SELECT m.batch_id AS rollback_of, movement_id, file_id, to_path AS source_path, from_path AS target_path, 'pending' AS status
    FROM movements m JOIN batches b USING (batch_id)
    WHERE NOT restored AND action_type = 'move_to_trash' AND b.status IN ('executed', 'partially_failed')""")
def a15_rollback_plan(spark, sf):
    return outcomes.rollback_plan(d.action_batches(spark, sf), d.file_movements(spark, sf))


@query("""
    SELECT batch_id, coalesce(n, 0) AS open_movements,
           CASE WHEN action_type <> 'move_to_trash' THEN 'rollback is supported only for move_to_trash batches'
                WHEN status NOT IN ('executed', 'partially_failed') THEN 'rollback is allowed only for executed/partially_failed batches'
                WHEN n IS NULL THEN 'rollback is unavailable: no unrestored file movements found' ELSE '' END AS error
    FROM batches LEFT JOIN (SELECT batch_id, count(*) AS n FROM movements WHERE NOT restored GROUP BY 1) USING (batch_id)""")
def a15_rollback_verdict(spark, sf):
    verdict = outcomes.rollback_verdict(d.action_batches(spark, sf), d.file_movements(spark, sf))
    return verdict.withColumn("error", F.coalesce("error", F.lit("")))


@query("""
    SELECT DISTINCT user_id - 5 AS file_id, CASE WHEN user_id <= 5 THEN 'id is not positive'
             WHEN user_id - 5 NOT IN (SELECT file_id FROM files) THEN 'file is not indexed' ELSE 'file has no open movement' END AS reason
    FROM events WHERE user_id <= 5 OR user_id - 5 NOT IN (SELECT file_id FROM files)
      OR user_id - 5 NOT IN (SELECT file_id FROM movements WHERE NOT restored)""")
def a6_refused_ids(spark, sf):
    """Ids as events name them: some are not positive, not indexed or never moved."""
    return planning.refused_ids(_event_ids(spark, sf), d.files(spark, sf), "restore", d.file_movements(spark, sf))


@query("SELECT batch_id, CASE WHEN status = 'draft' THEN 'confirmed' ELSE status END AS status FROM batches")
def a18_confirm(spark, sf):
    return cleanup.confirm(d.action_batches(spark, sf), d.action_items(spark, sf)).select("batch_id", "status")


@query("""
    SELECT movement_id, restored OR movement_id IN (SELECT max(movement_id) FROM movements WHERE NOT restored GROUP BY file_id) AS closed
    FROM movements""")
def a16_close_movements(spark, sf):
    """Every file is restored once: its newest open movement closes."""
    moves = d.file_movements(spark, sf)
    done = planning.plan_items(moves, d.files(spark, sf), "restore", d.TRASH, moves).withColumn("status", F.lit("done"))
    after = outcomes.close_movements(moves, done, F.lit("2026-01-01 00:00:00"))
    return after.select("movement_id", F.col("restored_at").isNotNull().alias("closed"))


@query("""
    SELECT 'rollback-' || m.batch_id AS batch_id, 'rollback_of=' || m.batch_id AS summary, movement_id AS item_id, to_path AS source_path
    FROM movements m JOIN batches b USING (batch_id)
    WHERE NOT restored AND action_type = 'move_to_trash' AND status IN ('executed', 'partially_failed')""")
def a15_rollback_batches(spark, sf):
    """Every batch that can be rolled back gets a restore batch of its own."""
    headers, items = cleanup.rollback_batches(
        d.action_batches(spark, sf), d.file_movements(spark, sf), "tester", F.lit("2026-01-01 00:00:00"))
    return items.join(headers.select("batch_id", "summary"), "batch_id").select("batch_id", "summary", "item_id", "source_path")


@query("""
    SELECT batch_id, CASE WHEN status IN ('executed', 'partially_failed') AND batch_id IN (SELECT batch_id FROM movements)
             AND batch_id NOT IN (SELECT batch_id FROM movements WHERE NOT restored) THEN 'rolled_back' ELSE status END AS status
    FROM batches""")
def a17_rolled_back(spark, sf):
    return outcomes.rolled_back(d.action_batches(spark, sf), d.file_movements(spark, sf)).select("batch_id", "status")


@query("""
    SELECT batch_id, status = 'draft' AS can_confirm, CASE WHEN status = 'draft' THEN '' ELSE 'only draft batch can be confirmed' END AS error
    FROM batches""")
def a18_confirmable(spark, sf):
    verdict = outcomes.confirmable(d.action_batches(spark, sf), d.action_items(spark, sf))
    return verdict.withColumn("error", F.coalesce("error", F.lit("")))


@query("""
    SELECT 'move' AS kind, file_id, CASE WHEN is_present = 1 AND doc_id % 17 <> 0 THEN 'done' ELSE 'failed' END AS status, 'confirmed' AS before
    FROM files WHERE file_id IN (SELECT file_id FROM items WHERE is_primary = 0)
    UNION ALL
    SELECT 'restore', file_id, CASE WHEN doc_id % 5 = 0 AND is_present = 0 AND first = movement_id THEN 'done' ELSE 'failed' END, 'confirmed'
    FROM (SELECT *, min(movement_id) OVER (PARTITION BY file_id) AS first FROM movements m JOIN batches b USING (batch_id)
          WHERE NOT restored AND action_type = 'move_to_trash' AND status IN ('executed', 'partially_failed')) JOIN files USING (file_id)""")
def e3_cleanup_and_rollback(spark, sf):
    """What would become of a job's non-primaries moved to the trash, and of all batches of the ledger
    rolled back, given what exists."""
    files, manifest, ledger = d.files(spark, sf), d.manifest(spark, sf), d.file_movements(spark, sf)
    when = F.lit("2026-01-01 00:00:00")
    draft = cleanup.draft_job_batch("b1", d.JOB, d.exact_items(spark, sf), d.similar_items(spark, sf), files, "move_to_trash", d.TRASH)
    header = cleanup.batch_header(draft, "move_to_trash", "tester", when)
    undo, restores = cleanup.rollback_batches(d.action_batches(spark, sf), ledger, "tester", when)
    found = None
    for kind, headers, items in (("move", header, draft), ("restore", undo, restores)):
        confirmed = cleanup.confirm(headers, items)
        done, _ = outcomes.evaluate_confirmed(confirmed, items, manifest, ledger, d.TRASH)
        part = done.join(confirmed.select("batch_id", F.col("status").alias("before")), "batch_id").select(
            F.lit(kind).alias("kind"), "file_id", "status", "before"
        )
        found = part if found is None else found.unionByName(part)
    return found
