import os
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import files, movements, rows
from twinsift.operators import naming, outcomes, planning
from twinsift.schemas import FILE_MOVEMENTS
from twinsift.plans import cleanup

TRASH = "/nas/.trash"


def items(spark, *entries):
    return spark.createDataFrame(
        list(entries), "job_id string, signature string, anchor_file_id long, file_id long, is_primary int"
    )


def expected_names(plan, existing):
    """One item after another, as a person would move the files."""
    taken, out = set(existing), {}
    for item, path in sorted(plan):
        folder, name = os.path.split(path)
        dot = name.rfind(".")
        stem, suffix = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
        candidate, n = path, 0
        while candidate in taken:
            n += 1
            candidate = f"{folder}/{stem}.{n}{suffix}"
        taken.add(candidate)
        out[item] = candidate
    return out


def available(spark, plan, existing, **how):
    df = spark.createDataFrame(plan, "item_id long, target_path string")
    busy = spark.createDataFrame([(p,) for p in existing], "path string")
    return {r.item_id: r.target_path for r in naming.next_available_path(df, busy, **how).collect()}


def test_free_names(spark):
    plan = [(1, "/t/a.txt"), (2, "/t/b.txt"), (3, "/t/README"), (4, "/t/.rc"), (5, "/t/x.tar.gz"), (6, "/t/dot.")]
    existing = ["/t/a.txt", "/t/a.1.txt", "/t/a.3.txt", "/t/README", "/t/.rc", "/t/.rc.1", "/t/x.tar.gz", "/t/a.01.txt", "/t/dot."]
    got = available(spark, plan, existing)
    assert got == expected_names(plan, existing)
    assert got[1] == "/t/a.2.txt" and got[3] == "/t/README.1" and got[4] == "/t/.rc.2" and got[5] == "/t/x.tar.1.gz"


def test_items_of_different_names_meet(spark):
    plan = [(1, "/t/a.txt"), (2, "/t/a.1.txt"), (3, "/t/a.txt"), (4, "/t/a.1.1.txt"), (5, "/t/a.txt")]
    for existing in ([], ["/t/a.txt"], ["/t/a.txt", "/t/a.1.txt", "/t/a.1.2.txt"]):
        assert available(spark, plan, existing) == expected_names(plan, existing)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_free_names_at_random(spark, seed):
    rng = random.Random(seed)
    pool = ["/t/a", "/t/a.txt", "/t/a.1", "/t/a.1.txt", "/t/a.2.txt", "/t/a.1.1.txt", "/u/a.txt", "/t/a.1.2"]
    plan = [(i, rng.choice(pool)) for i in range(1, 25)]
    existing = rng.sample(pool + ["/t/a.3.txt", "/t/a.5.txt", "/t/a.10.txt", "/t/a.2"], 5)
    assert available(spark, plan, existing) == expected_names(plan, existing)
    if seed == 5:  # names with four rows or more by range sort
        assert available(spark, plan, existing, hot_rows=4) == expected_names(plan, existing)


@pytest.mark.parametrize("numbered_first", [True, False])
def test_a_family_of_rivals_settles_in_few_rounds(spark, monkeypatch, numbered_first):
    """500 items want one name, 500 others its numbered forms."""
    names = [f"/t/a.{k}.txt" for k in range(1, 501)] + ["/t/a.txt"] * 500
    plan = list(enumerate(names if numbered_first else names[::-1], 1))
    existing = ["/t/a.txt", "/t/a.7.txt", "/t/a.502.txt"]
    rounds = []
    move_on = naming._move_on
    monkeypatch.setattr(naming, "_move_on", lambda *a: rounds.append(1) or move_on(*a))
    assert available(spark, plan, existing) == expected_names(plan, existing)
    assert len(rounds) <= 5


def test_ids(spark):
    ids = spark.createDataFrame([(3, 0), (0, 1), (3, 2), (1, 3), (-4, 4)], "file_id long, pos long")
    kept, rejected = planning.normalize_file_ids(ids)
    assert rows(kept, "pos") == [(3, 0), (1, 3)]
    assert rows(rejected, "pos") == [(0, 1), (-4, 4)]
    assert rows(planning.missing_file_ids(kept, files(spark, dict(file_id=1))), "file_id") == [(3,)]


def test_previews(spark):
    table = files(spark, dict(file_id=1, size_bytes=128), dict(file_id=2, size_bytes=512))
    got = planning.preview(table, table, " Move_To_Trash ").first()
    assert tuple(got) == ("move_to_trash", 2, 640, 640, 0, 0)
    moves = movements(spark, (1, 1, "b", "/nas/photo/1.jpg", "/t/1", False), (2, 2, "b", "/nas/photo/2.jpg", "/t/2", True))
    got = planning.preview(table, table, "restore", moves).first()
    assert tuple(got) == ("restore", 2, 640, 0, 0, 1)
    more = spark.createDataFrame([(1,), (7,)], "file_id long")
    assert planning.preview(more, table, "delete_permanent").first().missing_files == 1
    with pytest.raises(ValueError):
        planning.preview(table, table, "shred")


def test_job_preview(spark):
    table = files(spark, dict(file_id=1, size_bytes=100), dict(file_id=2, size_bytes=200), dict(file_id=3, size_bytes=300))
    exact = items(spark, ("j", "s", None, 1, 1), ("j", "s", None, 2, 0))
    similar = items(spark, ("j", None, 2, 2, 0), ("j", None, 2, 3, 0), ("other", None, 1, 1, 0))
    assert rows(planning.job_non_primary_files(exact, similar, "j"), "file_id") == [(2,), (3,)]
    got = planning.job_preview("j", exact, similar, table, "move_to_trash").first()
    assert tuple(got) == ("move_to_trash", 2, 500, 500, 0, 0, 0)
    empty = planning.job_preview("none", exact, similar, table, "move_to_trash").first()
    assert tuple(empty) == ("move_to_trash", 0, 0, 0, 0, 0, 0)


def test_conflicting_choices_can_doom_every_copy(spark):
    table = files(spark, dict(file_id=1), dict(file_id=2))
    exact = items(spark, ("j", "s", None, 1, 1), ("j", "s", None, 2, 0))
    similar = items(spark, ("j", None, 1, 1, 0), ("j", None, 1, 2, 1))
    got = planning.job_preview("j", exact, similar, table, "move_to_trash").first()
    assert (got.files_count, got.doomed_signatures) == (2, 1)


def test_plans(spark):
    table = files(spark, dict(file_id=1, abs_path="/nas/photo/a.jpg"), dict(file_id=2, abs_path="/nas/photo/b.jpg"))
    one = table.where("file_id = 1")
    assert rows(planning.plan_items(one, table, "move_to_trash", TRASH + "/"), "file_id") == [
        (1, "/nas/photo/a.jpg", "/nas/.trash/nas/photo/a.jpg", "pending")
    ]
    assert rows(planning.plan_items(one, table, "delete_permanent", TRASH), "file_id") == [(1, "/nas/photo/a.jpg", None, "pending")]
    moves = movements(
        spark, (1, 1, "b1", "/old", "/t/1", False), (2, 1, "b2", "/nas/photo/a.jpg", "/t/2", False), (3, 1, "b3", "/c", "/t/3", True)
    )
    assert rows(planning.plan_items(one, table, "restore", TRASH, moves), "file_id") == [(1, "/t/2", "/nas/photo/a.jpg", "pending")]
    assert rows(outcomes.latest_unrestored(moves, "b1").select("movement_id"), "movement_id") == [(1,)]


def test_move_outcomes(spark):
    plan = spark.createDataFrame(
        [
            (1, 1, "/nas/a", "/nas/.trash/nas/a"), (2, 2, "/nas/gone", "/nas/.trash/nas/gone"), (3, 3, "/nas/dir", "/nas/.trash/nas/dir"),
            (4, 4, "/nas/b", "/nas/.trashy/b"), (5, 5, "/nas/c", None),
        ],
        "item_id long, file_id long, source_path string, target_path string",
    ).withColumn("status", F.lit("pending"))
    manifest = spark.createDataFrame(
        [("/nas/a", True), ("/nas/dir", False), ("/nas/b", True), ("/nas/c", True), ("/nas/.trash/nas/a", True)], "path string, is_file boolean"
    )
    got = outcomes.evaluate_move(plan, manifest, TRASH)
    assert rows(got.select("item_id", "status", "target_path", "error_message"), "item_id") == [
        (1, "done", "/nas/.trash/nas/a.1", None),
        (2, "failed", "/nas/.trash/nas/gone", "source file not found: /nas/gone"),
        (3, "failed", "/nas/.trash/nas/dir", "source path is not a file: /nas/dir"),
        (4, "failed", "/nas/.trashy/b", "target path is not below the trash folder: /nas/.trashy/b"),
        (5, "done", "/nas/.trash/nas/c", None),
    ]
    off = outcomes.evaluate_delete(plan, manifest)
    assert off.select("error_message").distinct().collect()[0][0] == "permanent deletion is off (hard_delete=False)"
    on = outcomes.evaluate_delete(plan, manifest, hard_delete=True)
    assert rows(on.select("item_id", "status"), "item_id") == [(1, "done"), (2, "failed"), (3, "failed"), (4, "done"), (5, "done")]


def test_restore_outcomes(spark):
    plan = spark.createDataFrame(
        [(1, "/t/a", "/nas/a"), (2, "/t/gone", "/nas/b"), (3, "/t/c", "/nas/c"), (4, "/t/d", "/nas/d"), (5, "/t/e", None), (6, "/t/f", "/nas/f")],
        "file_id long, source_path string, target_path string",
    ).withColumn("status", F.lit("pending"))
    manifest = spark.createDataFrame(
        [("/t/a", True), ("/t/c", True), ("/nas/c", True), ("/t/d", True), ("/t/e", True), ("/t/f", False)], "path string, is_file boolean"
    )
    moves = movements(spark, (1, 1, "b", "/nas/a", "/t/a", False), (2, 3, "b", "/nas/c", "/t/c", False), (3, 4, "b", "/nas/d", "/t/d", True))
    got = outcomes.evaluate_restore(plan, manifest, moves)
    assert rows(got.select("file_id", "status", "error_message", "source_batch_id"), "file_id") == [
        (1, "done", None, "b"),
        (2, "failed", "restore source not found: /t/gone", None),
        (3, "failed", "restore target already exists: /nas/c", "b"),
        (4, "failed", "restore movement record not found for file_id=4 from=/nas/d to=/t/d", None),
        (5, "failed", "restore target_path is required", None),
        (6, "failed", "restore source is not a file: /t/f", None),
    ]


def test_decided_items_stay_and_rivals_are_arbitrated(spark):
    columns = "item_id long, file_id long, source_path string, target_path string, status string, error_message string"
    manifest = spark.createDataFrame([("/t/a", True), ("/t/b", True), ("/nas/x", True)], "path string, is_file boolean")
    moves = spark.createDataFrame(
        [(1, 1, "b1", "/nas/a", "/t/a", None, None), (2, 2, "b2", "/nas/a", "/t/b", None, None)], FILE_MOVEMENTS
    )
    plan = spark.createDataFrame(
        [(2, 2, "/t/b", "/nas/a", "pending", None), (1, 1, "/t/a", "/nas/a", "pending", None), (3, 3, "/t/a", "/nas/q", "skipped", "no")],
        columns,
    )
    got = outcomes.evaluate_restore(plan, manifest, moves).orderBy("item_id")
    assert [(r.item_id, r.status, r.error_message) for r in got.collect()] == [
        (1, "done", None),
        (2, "failed", "restore target already exists: /nas/a"),
        (3, "skipped", "no"),
    ]
    decided = spark.createDataFrame([(7, 7, "/nas/x", None, "failed", "old"), (8, 8, "/nas/x", None, "skipped", None)], columns)
    for evaluated in (outcomes.evaluate_move(decided, manifest, TRASH), outcomes.evaluate_delete(decided, manifest, True)):
        assert {(r.item_id, r.status, r.error_message) for r in evaluated.collect()} == {(7, "failed", "old"), (8, "skipped", None)}


def test_batch_states_and_stats(spark):
    df = spark.createDataFrame(
        [("a", "done"), ("a", "skipped"), ("b", "done"), ("b", "failed"), ("c", "failed"), ("d", "pending")], "batch_id string, status string"
    )
    assert rows(outcomes.batch_status(df).select("batch_id", "status"), "batch_id") == [
        ("a", "executed"), ("b", "partially_failed"), ("c", "failed"), ("d", "executed"),
    ]
    assert rows(outcomes.item_stats(df), "batch_id")[:2] == [("a", 2, 0, 1, 0, 1), ("b", 2, 0, 1, 1, 0)]


def test_rollback_rules(spark):
    batches = spark.createDataFrame(
        [("a", "move_to_trash", "executed"), ("b", "restore", "executed"), ("c", "move_to_trash", "draft"), ("d", "move_to_trash", "partially_failed")],
        "batch_id string, action_type string, status string",
    )
    moves = movements(spark, *[(i, i, b, f"/nas/{b}", f"/t/{b}", b == "d") for i, b in enumerate("abcd", 1)])
    assert rows(outcomes.rollback_plan(batches, moves), "movement_id") == [("a", 1, 1, "/t/a", "/nas/a", "pending")]
    assert [r.error for r in outcomes.rollback_verdict(batches, moves).orderBy("batch_id").collect()] == [
        None,
        "rollback is supported only for move_to_trash batches",
        "rollback is allowed only for executed/partially_failed batches",
        "rollback is unavailable: no unrestored file movements found",
    ]
    assert rows(outcomes.rolled_back(batches, moves).select("batch_id", "status"), "batch_id")[3] == ("d", "rolled_back")
    assert [r.movement_id for r in outcomes.open_movements(moves, "a").collect()] == [1]


def test_confirm_rules(spark):
    batches = spark.createDataFrame(
        [("a", "move_to_trash", "draft"), ("b", "move_to_trash", "executed"), ("c", "restore", "draft"), ("d", "delete_permanent", "draft")],
        "batch_id string, action_type string, status string",
    )
    filled = spark.createDataFrame([("a",), ("b",), ("d",)], "batch_id string")
    got = rows(outcomes.confirmable(batches, filled), "batch_id")
    assert got == [
        ("a", True, None), ("b", False, "only draft batch can be confirmed"), ("c", False, "batch has no action items"),
        ("d", False, "permanent deletion is off (hard_delete=False)"),
    ]
    assert rows(outcomes.confirmable(batches, filled, hard_delete=True), "batch_id")[3] == ("d", True, None)


def test_trash_and_rollback(spark):
    table = files(spark, dict(file_id=1, abs_path="/nas/photo/a.jpg", size_bytes=256), dict(file_id=2, abs_path="/nas/photo/b.jpg"))
    exact = items(spark, ("j", "s", None, 1, 0), ("j", "s", None, 2, 1))
    similar = exact.where("false")
    now = F.lit("2026-03-13 10:00:00")
    manifest = spark.createDataFrame([("/nas/photo/a.jpg", True), ("/nas/photo/b.jpg", True)], "path string, is_file boolean")
    ledger = movements(spark, (7, 2, "old", "/nas/x", "/t/x", True))
    draft = cleanup.draft_job_batch("b1", "j", exact, similar, table, "move_to_trash", TRASH)
    header = cleanup.batch_header(draft, "move_to_trash", "me", now)
    moved, unconfirmed = outcomes.evaluate_confirmed(header, draft, manifest, ledger, TRASH)
    assert moved.first().status == "pending" and unconfirmed.first().status == "draft"
    moved, batches = outcomes.evaluate_confirmed(cleanup.confirm(header, draft), draft, manifest, ledger, TRASH)
    assert batches.first().status == "executed"
    assert rows(moved.select("file_id", "source_path", "target_path", "status"), "file_id") == [
        (1, "/nas/photo/a.jpg", "/nas/.trash/nas/photo/a.jpg", "done"),
    ]
    # The ledger as whoever moved the file has written it.
    ledger = ledger.unionByName(movements(spark, (8, 1, "b1", "/nas/photo/a.jpg", "/nas/.trash/nas/photo/a.jpg", False)))
    undo = cleanup.rollback(batches, "b2", ledger)
    after = spark.createDataFrame([("/nas/photo/b.jpg", True), ("/nas/.trash/nas/photo/a.jpg", True)], "path string, is_file boolean")
    header = cleanup.confirm(cleanup.batch_header(undo, "restore", "me", now), undo)
    back, restored = outcomes.evaluate_confirmed(header, undo, after, ledger, TRASH)
    assert restored.first().status == "executed"
    closed = outcomes.close_movements(ledger, back, now)
    assert closed.where("restored_at IS NULL").count() == 0
    assert outcomes.rolled_back(batches, closed, undo.select(F.lit("b1").alias("batch_id"))).first().status == "rolled_back"
    with pytest.raises(ValueError, match="one source batch"):
        cleanup.rollback(batches.unionByName(batches.withColumn("batch_id", F.lit("b9"))), "b2", ledger)


def test_each_rolled_back_batch_has_a_restore_batch_of_its_own(spark):
    batches = spark.createDataFrame(
        [("a", "move_to_trash", "executed"), ("b", "move_to_trash", "partially_failed"), ("c", "move_to_trash", "draft"),
         ("d", "restore", "executed"), ("e", "move_to_trash", "executed")], "batch_id string, action_type string, status string")
    ledger = movements(spark, *[(i, i, b, f"/x/{i}", f"/t/{i}", b == "e") for i, b in enumerate("aabcde")])
    headers, undo = cleanup.rollback_batches(batches, ledger, "me", F.lit("2026-03-13 10:00:00"))
    assert rows(headers.select("batch_id", "action_type", "status", "summary"), "batch_id") == [
        ("rollback-a", "restore", "draft", "rollback_of=a"), ("rollback-b", "restore", "draft", "rollback_of=b"),
    ]
    assert rows(undo.select("batch_id", "item_id"), "item_id") == [("rollback-a", 0), ("rollback-a", 1), ("rollback-b", 2)]


def test_only_pending_items_of_confirmed_batches_are_carried_out(spark):
    batches = spark.createDataFrame(
        [("m", "move_to_trash", "confirmed"), ("x", "delete_permanent", "confirmed"), ("q", "move_to_trash", "draft"),
         ("done", "move_to_trash", "confirmed")], "batch_id string, action_type string, status string")
    plan = spark.createDataFrame(
        [(1, "m", 1, "/nas/a", None, "pending"), (2, "m", 2, "/nas/gone", None, "pending"), (3, "m", 3, "/nas/a", None, "done"),
         (4, "x", 1, "/nas/a", None, "pending"), (5, "q", 1, "/nas/a", None, "pending"), (6, "done", 1, "/nas/a", None, "skipped")],
        "item_id long, batch_id string, file_id long, source_path string, target_path string, status string")
    manifest = spark.createDataFrame([("/nas/a", True)], "path string, is_file boolean")
    verdict = {r.batch_id: r.error for r in outcomes.executable(batches, plan).collect()}
    assert verdict == {"m": None, "x": None, "q": "only confirmed batch can be executed", "done": "batch has no pending items"}
    after, status = outcomes.evaluate_confirmed(batches, plan, manifest, movements(spark), TRASH)
    assert [r.status for r in after.orderBy("item_id").collect()] == ["done", "failed", "done", "failed", "pending", "skipped"]
    assert rows(status.select("batch_id", "status"), "batch_id") == [
        ("done", "confirmed"), ("m", "partially_failed"), ("q", "draft"), ("x", "failed"),
    ]
    after, status = outcomes.evaluate_confirmed(batches, plan, manifest, movements(spark), TRASH, hard_delete=True)
    assert status.where("batch_id = 'x'").first().status == "executed"


def test_an_empty_pick_has_no_preview(spark):
    table = files(spark, dict(file_id=1, size_bytes=7))
    ids = lambda *numbers: spark.createDataFrame([(n, i) for i, n in enumerate(numbers)], "file_id long, pos int")
    assert planning.preview_selection(ids(1, 1), table, "move_to_trash").first().total_bytes == 7
    for picked in (ids(), ids(1, 0)):
        with pytest.raises(ValueError):
            planning.preview_selection(picked, table, "move_to_trash")


def test_moving_an_absent_file_fails_the_batch(spark):
    table = files(spark, dict(file_id=1, abs_path="/nas/photo/gone.jpg"))
    draft = cleanup.draft_batch("b", table, table, "move_to_trash", TRASH)
    nothing = spark.createDataFrame([], "path string, is_file boolean")
    header = cleanup.batch_header(draft, "move_to_trash", "me", F.lit("2026-03-13 10:00:00"))
    ledger = movements(spark, (1, 1, "x", "/a", "/b", True))
    got, batches = outcomes.evaluate_confirmed(cleanup.confirm(header, draft), draft, nothing, ledger, TRASH)
    assert got.first().error_message == "source file not found: /nas/photo/gone.jpg"
    assert batches.first().status == "failed"


def test_drafts_refuse_what_they_cannot_plan(spark):
    table = files(spark, dict(file_id=1, abs_path="/nas/a"), dict(file_id=2, abs_path="/nas/b"))
    ids = spark.createDataFrame([(1,), (2,), (2,), (9,), (0,), (None,)], "file_id long")
    refused = planning.refused_ids(ids, table, "move_to_trash")
    assert {(r.file_id, r.reason) for r in refused.collect()} == {
        (9, "file is not indexed"), (0, "id is not positive"), (None, "id is not positive"),
    }
    ledger = movements(spark, (7, 2, "old", "/nas/b", "/t/b", False), (8, 1, "old", "/nas/a", "/t/a", True))
    refused = planning.refused_ids(ids.where("file_id < 3 AND file_id > 0"), table, "restore", ledger)
    assert [tuple(r) for r in refused.collect()] == [(1, "file has no open movement")]
    with pytest.raises(ValueError, match="not indexed"):
        cleanup.draft_batch("b", ids.where("file_id > 0"), table, "move_to_trash", TRASH)
    with pytest.raises(ValueError, match="no files are selected"):
        cleanup.draft_batch("b", ids.where("false"), table, "move_to_trash", TRASH)


def test_a_draft_is_confirmed_once(spark):
    table = files(spark, dict(file_id=1, abs_path="/nas/a"))
    draft = cleanup.draft_batch("b", table, table, "delete_permanent", TRASH)
    header = cleanup.batch_header(draft, "delete_permanent", "me", F.lit("2026-03-13 10:00:00"))
    assert header.count() == 1 and header.first().status == "draft"
    assert cleanup.confirm(header, draft).first().status == "draft"
    confirmed = cleanup.confirm(header, draft, hard_delete=True)
    assert confirmed.first().status == "confirmed" and confirmed.columns == header.columns
    assert not outcomes.confirmable(confirmed, draft, hard_delete=True).first().can_confirm
