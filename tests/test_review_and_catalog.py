import uuid

import pytest
from pyspark.sql import functions as F

from tests.helpers import files, rows
from twinsift.functions import paths as P
from twinsift.functions import text as X
from twinsift.operators import decisions as dec
from twinsift.operators import integrity, jobs, review, roots
from twinsift.schemas import DECISIONS, SCAN_JOBS

NOW = "2026-03-13 12:00:00"


def unified(spark, *entries):
    return spark.createDataFrame(
        [(k, "j", g, f, p) for k, g, f, p in entries],
        "group_kind string, job_id string, group_key string, file_id long, is_primary int",
    )


def decided(spark, *entries):
    return spark.createDataFrame(
        [(k, "j", g, f, d, n, s) for k, g, f, d, n, s in entries],
        "group_kind string, job_id string, group_key string, file_id long, decision string, note string, seq long",
    )


def job_rows(spark, *entries):
    """(id, mode, status, requested, started, seen, indexed)"""
    df = spark.createDataFrame(
        list(entries), "job_id string, mode string, status string, r string, s string, files_seen long, files_indexed long"
    )
    stamp = lambda c: F.to_timestamp(c)
    made = {"requested_at": stamp("r"), "started_at": stamp("s")}
    columns = []
    for field in SCAN_JOBS.fields:
        value = made.get(field.name) if field.name in made else (
            F.col(field.name) if field.name in df.columns else F.lit(0 if field.dataType.typeName() == "long" else None)
        )
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v")).alias("out")).collect()]


# ---- decisions --------------------------------------------------------------------------


def test_decisions_need_a_member_a_kind_and_a_value(spark):
    items = unified(spark, ("exact", "s", 1, 1), ("exact", "s", 2, 0))
    asked = decided(
        spark, ("exact", "s", 1, "keep", None, 1), ("exact", "s", 9, "keep", None, 2), ("other", "s", 1, "keep", None, 3),
        ("exact", "s", 2, "burn", None, 4), ("similar", "s", 1, "keep", None, 5),
    )
    good, bad = dec.validate_decisions(asked, items)
    assert [r.seq for r in good.collect()] == [1]
    assert {r.seq: r.error for r in bad.collect()} == {
        2: "group item not found: kind=exact group_id=s file_id=9",
        3: "group_kind must be 'exact' or 'similar'",
        4: "unknown decision",
        5: "group item not found: kind=similar group_id=s file_id=1",
    }


def test_last_decision_wins_with_its_note(spark):
    first = decided(spark, ("exact", "s", 1, "keep", "n", 1), ("exact", "s", 2, "trash", None, 2))
    after = dec.upsert_decisions(first, decided(spark, ("exact", "s", 1, "trash", None, 3)))
    assert rows(after.select("file_id", "decision", "note"), "file_id") == [(1, "trash", None), (2, "trash", None)]


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_keep_moves_the_primary(spark, hot_rows):
    items = unified(spark, ("exact", "s", 1, 1), ("exact", "s", 2, 0), ("exact", "s", 3, 0), ("similar", "1", 1, 1), ("similar", "1", 2, 0))
    history = decided(
        spark, ("exact", "s", 2, "keep", None, 1), ("exact", "s", 3, "keep", None, 2), ("exact", "s", 3, "trash", None, 3),
        ("similar", "1", 2, "trash", None, 4),
    )
    after = dec.apply_keep(items, history, hot_rows=hot_rows)
    assert rows(after.where("is_primary = 1").select("group_kind", "file_id"), "group_kind") == [("exact", 3), ("similar", 1)]
    assert integrity.check_one_primary(after, dec.GROUP).count() == 0


def test_bulk_decisions(spark):
    items = unified(spark, ("exact", "s", 1, 1), ("exact", "s", 2, 0), ("exact", "s", 3, 0), ("exact", "t", 4, 1), ("exact", "t", 5, 0))
    one = items.where("group_key = 's'")
    assert rows(dec.bulk_decision(items, "trash", group_keys=one).select("file_id", "decision"), "file_id") == [(2, "trash"), (3, "trash")]
    kept = dec.bulk_decision(items, "keep", group_keys=one, file_ids=one)
    assert dec.apply_keep(items, kept).where("is_primary = 1 AND group_key = 's'").first().file_id == 3
    with pytest.raises(ValueError):
        dec.bulk_decision(items, "burn")
    assert rows(dec.decisions_for_group(kept, "exact", "s").select("file_id"), "file_id") == [(1,), (2,), (3,)]


# ---- review -----------------------------------------------------------------------------


def test_group_details_carry_the_decision(spark):
    items = unified(spark, ("exact", "s", 1, 1), ("exact", "s", 2, 0))
    table = files(spark, dict(file_id=1, size_bytes=4), dict(file_id=2, size_bytes=4))
    got = review.group_details(items, table, decided(spark, ("exact", "s", 2, "trash", None, 1), ("similar", "s", 1, "keep", None, 1)))
    assert rows(got.select("file_id", "abs_path", "decision"), "file_id") == [(1, "/nas/photo/1.jpg", None), (2, "/nas/photo/2.jpg", "trash")]


def test_scopes(spark):
    items = unified(spark, ("exact", "s", 1, 1), ("exact", "s", 3, 0), ("exact", "s", 2, 0), ("exact", "t", 2, 0), ("exact", "t", 5, 1))
    chosen = spark.createDataFrame([(9,), (1,), (9,)], "file_id long")
    ids = lambda df: [r.file_id for r in df.collect()]
    assert ids(review.resolve_scope(items, "selected", file_ids=chosen)) == [1, 9]
    assert ids(review.resolve_scope(items, "selected_groups", groups=items.where("group_key = 't'"))) == [2]
    assert ids(review.resolve_scope(items, "all_in_group", groups=items.where("group_key = 's'"))) == [2, 3]
    assert ids(review.resolve_scope(items, "all_filtered")) == [2, 3]
    with pytest.raises(ValueError):
        review.resolve_scope(items, "everything")


def test_group_pages(spark):
    groups = spark.createDataFrame([("j", s, 2) for s in "dbca"] + [("k", "z", 2)], "job_id string, signature string, file_count long")
    got, total = review.list_groups(groups, "exact", "j", page=2, page_size=2)
    assert [r.signature for r in got.collect()] == ["c", "d"] and total.first().total == 4
    after, _ = review.list_groups(groups, "exact", "j", page_size=2, after="b")
    assert [r.signature for r in after.collect()] == ["c", "d"]


# ---- jobs -------------------------------------------------------------------------------


def catalog(spark):
    return job_rows(
        spark,
        ("a", "both", "completed", "2026-03-13 10:00:00", None, 10, 5),
        ("b", "exact", "running", "2026-03-13 11:00:00", "2026-03-13 11:59:30", 0, 0),
        ("c", "both", "completed", "2026-03-13 11:30:00", None, 3, 3),
        ("d", "similar", "failed", "2026-03-13 11:45:00", None, 8, 1),
        ("e", "both", "queued", "2026-03-13 09:00:00", None, 0, 0),
    )


def test_job_pages_newest_first(spark):
    ids = lambda df: [r.job_id for r in df.collect()]
    page, total = jobs.list_jobs(catalog(spark), "completed", "both", page_size=1)
    assert (ids(page), total.first().total) == (["c"], 2)
    assert ids(jobs.list_jobs(catalog(spark), "completed", "both", page=2, page_size=1)[0]) == ["a"]
    assert ids(jobs.list_jobs(catalog(spark), order="asc")[0]) == ["e", "a", "b", "c", "d"]
    last = jobs.list_jobs(catalog(spark), page_size=2)[0].collect()[-1]
    following = jobs.list_jobs(catalog(spark), page_size=2, after=(last.requested_at, last.job_id))[0]
    assert ids(following) == ids(jobs.list_jobs(catalog(spark), page=2, page_size=2)[0])
    assert ids(jobs.recent_jobs(catalog(spark), 2)) == ["d", "c"]
    assert ids(jobs.latest_processed(catalog(spark))) == ["d"]
    assert jobs.has_active(catalog(spark)).first().has_active
    assert not jobs.has_active(catalog(spark).where("status = 'failed'")).first().has_active
    assert not jobs.has_active(catalog(spark).where("false")).first().has_active


def test_job_status_lists_roots_in_order(spark):
    table = spark.createDataFrame([(1, "/nas/a", 1), (2, "/nas/b", 0)], "root_id long, path string, enabled int")
    bridge = spark.createDataFrame([("a", 2), ("a", 1)], "job_id string, root_id long")
    got = {r.job_id: [tuple(x) for x in r.roots] for r in jobs.job_status(catalog(spark), bridge, table).collect()}
    assert got["a"] == [(1, "/nas/a", True), (2, "/nas/b", False)] and got["b"] == []
    assert rows(roots.first_root_of_job(bridge, table), "job_id") == [("a", 1, "/nas/a", 2)]


def test_delete_rules(spark):
    groups = spark.createDataFrame([("a",), ("a",)], "job_id string")
    table = files(spark, dict(file_id=1, first_seen_job_id="c", last_seen_job_id="c"), dict(file_id=2, first_seen_job_id="c", last_seen_job_id="d"))
    batch_items = spark.createDataFrame([(1,), (2,), (2,)], "file_id long")
    needs = jobs.delete_dependencies(catalog(spark), groups, groups.where("false"), batch_items, table)
    assert rows(needs, "job_id") == [("a", 2, 0, 0), ("b", 0, 0, 0), ("c", 0, 0, 3), ("d", 0, 0, 2), ("e", 0, 0, 0)]
    now = F.to_timestamp(F.lit(NOW))
    verdict = lambda **o: {r.job_id: r.verdict for r in jobs.deletable(catalog(spark), needs, now, **o).collect()}
    assert verdict() == {"a": "blocked", "b": "active", "c": "blocked", "d": "blocked", "e": "active"}
    assert verdict(allow_stale=True)["b"] == "not_stale" and verdict(allow_stale=True)["e"] == "ok"
    assert verdict(allow_stale=True, timeout_seconds=1)["b"] == "not_stale"

    bridge = spark.createDataFrame([("c", 1), ("d", 1)], "job_id string, root_id long")
    doomed = catalog(spark).where("job_id = 'c'")
    after = jobs.delete_jobs(doomed, catalog(spark), bridge, table, groups, groups)
    assert after["jobs"].count() == 4 and rows(after["job_roots"], "job_id") == [("d", 1)]
    assert rows(after["files"].select("file_id", "first_seen_job_id", "last_seen_job_id"), "file_id") == [(1, None, None), (2, None, "d")]


def test_status_and_metric_updates(spark):
    update = spark.createDataFrame(
        [("d", "running", None, True, False)], "job_id string, status string, error_message string, started boolean, finished boolean"
    )
    old = catalog(spark).withColumn("error_message", F.lit("old"))
    row = jobs.update_status(old, update, F.to_timestamp(F.lit(NOW))).where("job_id = 'd'").first()
    assert (row.status, row.error_message, row.started_at is None, row.finished_at) == ("running", "old", False, None)
    new = spark.createDataFrame([("a", 99, None)], "job_id string, files_seen long, files_indexed long")
    assert rows(jobs.merge_metrics(catalog(spark), new).select("job_id", "files_seen", "files_indexed"), "job_id")[0] == ("a", 99, 5)
    more = catalog(spark).withColumn("files_seen", F.when(F.col("job_id") == "b", 4).otherwise(F.col("files_seen")))
    assert [r.job_id for r in jobs.changed_rows(catalog(spark), more).collect()] == ["b"]


def test_requests_are_idempotent(spark):
    asked = spark.createDataFrame(
        [(1, "k", "both", [1, 2]), (2, "k", "both", [1, 2]), (3, "k", "exact", [1, 2]), (4, "old", "both", [1]), (5, "old", "both", [2])],
        "seq long, request_key string, mode string, root_ids array<long>",
    )
    stored = job_rows(spark, (str(uuid.uuid5(uuid.NAMESPACE_URL, "old")), "both", "queued", NOW, None, 0, 0))
    bridge = stored.select("job_id", F.lit(1).cast("long").alias("root_id"))
    got = rows(jobs.submit_requests(asked, stored, bridge), "seq")
    assert [r[3] for r in got] == ["new", "existing", "conflict", "existing", "conflict"]
    assert got[0][2] == str(uuid.uuid5(uuid.NAMESPACE_URL, "k"))


def test_requests_of_one_key_are_spread(spark):
    asked = spark.range(200).selectExpr("id AS seq", "IF(id % 3 = 0, 'k', concat('k', id)) AS request_key", "'both' AS mode", "array(1L) AS root_ids")
    none = job_rows(spark).where("false")
    bridge = none.select("job_id", F.lit(1).cast("long").alias("root_id"))
    plain = rows(jobs.submit_requests(asked, none, bridge), "seq")
    assert rows(jobs.submit_requests(asked, none, bridge, hot_rows=5), "seq") == plain
    assert [r[3] for r in plain].count("existing") == 66


def test_names_and_progress(spark):
    assert rows(jobs.display_names(catalog(spark)).select("sequence", "title"), "sequence") == [
        (1, "SCAN-BOTH-0001"), (2, "SCAN-BOTH-0002"), (3, "SCAN-EXACT-0003"), (4, "SCAN-BOTH-0004"), (5, "SCAN-SIMILAR-0005"),
    ]
    df = spark.createDataFrame([(None, "abcdefghij", None), ("both", "x", 12345)], "m string, j string, s long")
    assert [r[0] for r in df.select(jobs.job_title(F.col("m"), F.col("j"), F.col("s"))).collect()] == ["SCAN-UNKNOWN-ABCDEFGH", "SCAN-BOTH-12345"]
    got = catalog(spark).select("job_id", X.progress_percent(F.col("status"), F.col("files_seen"), F.col("files_indexed")).alias("p"))
    assert rows(got, "job_id") == [("a", 100), ("b", 0), ("c", 100), ("d", 13), ("e", 0)]
    assert values(spark, lambda c: X.page_count(c, 50), [0, 1, 50, 51], "long") == [1, 1, 1, 2]


# ---- roots and integrity ----------------------------------------------------------------


def test_canonical_roots(spark):
    cases = {
        "/nas/photo/": "/nas/photo", " /nas//a/./b/../c ": "/nas/a/c", "/nas": "/nas", "//nas/x": "//nas/x", "///nas/x": "/nas/x",
        "/nas/../etc": None, "nas/x": None, "/nasty": None, "  ": None, "/nas/a/../..": None, "/../nas/b": "/nas/b",
    }
    assert values(spark, P.canonical_root, list(cases)) == list(cases.values())
    errors = values(spark, P.root_error, ["/nas/a", " ", "a", "/etc"])
    assert errors == [None, "path must not be empty", "path must be absolute", "path must be under '/nas'"]


def test_registering_roots(spark):
    known = spark.createDataFrame([(1, "/nas/a", 1)], "root_id long, path string, enabled int")
    asked = spark.createDataFrame([(1, "/nas/a/"), (2, "/nas/b"), (3, "/nas/./b"), (4, "/tmp")], "seq long, path string")
    assert [r[2] for r in rows(roots.register_roots(asked, known), "seq")] == ["conflict", "created", "conflict", "invalid"]
    many = spark.range(90).selectExpr("id AS seq", "element_at(array('/nas/b', 'nowhere', concat('/nas/', id)), int(id % 3) + 1) AS path")
    plain = rows(roots.register_roots(many, known), "seq")
    assert [r[2] for r in plain].count("invalid") == 30 and [r[2] for r in plain].count("created") == 31
    assert rows(roots.register_roots(many, known, hot_rows=4), "seq") == plain
    off = spark.createDataFrame([(1, False)], "root_id long, enabled boolean")
    assert roots.set_enabled(known, off).first().enabled == 0
    nobody = spark.createDataFrame([], "job_id string, root_id long")
    assert roots.roots_in_use(known, nobody, files(spark, dict(file_id=1))).count() == 1
    assert roots.roots_in_use(known, nobody, files(spark, dict(file_id=1, root_id=2))).count() == 0


def test_resolving_roots(spark):
    table = spark.createDataFrame([(1, "/nas/a", 1), (2, "/nas/b", 1), (3, "/nas/c", 0)], "root_id long, path string, enabled int")
    asked = spark.createDataFrame([(1, []), (2, [2, 1, 2]), (3, [3]), (4, [1, 9]), (5, None)], "request_id long, root_ids array<long>")
    assert rows(roots.resolve_roots(asked, table), "request_id") == [
        (1, [1, 2], None), (2, [1, 2], None), (3, None, "disabled scan root selected"),
        (4, None, "one or more scan roots were not found"), (5, [1, 2], None),
    ]
    none = roots.resolve_roots(asked.where("request_id = 1"), table.where("enabled = 0"))
    assert none.first().error == "no scan roots selected"


def test_checks_observed_while_a_table_is_written(spark, tmp_path):
    df = spark.range(1000).selectExpr("id AS file_id", "element_at(array('keep', 'burn', null, 'trash'), int(id % 4) + 1) AS decision", "id AS size_bytes")
    table, seen = integrity.watch_table(df, {"decision": ["keep", "trash"]}, ["size_bytes"])
    table.write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    apart = integrity.check_enums(stored, {"decision": ["keep", "trash"]}).first()
    assert seen.get == {"rows": stored.count(), "bad_decision": apart["rows"], "sum_size_bytes": 499500}


def test_integrity_checks(spark):
    df = spark.createDataFrame([(1, "keep"), (2, "burn"), (2, "burn"), (None, None)], "file_id long, decision string")
    assert rows(integrity.check_enums(df, {"decision": DECISIONS}), "value") == [("decision", "burn", 2)]
    assert rows(integrity.check_unique(df, ["file_id"]), "file_id") == [(2, 2)]
    assert rows(integrity.check_fk(df, "file_id", files(spark, dict(file_id=1)), "file_id"), "file_id") == [(2, 2)]
    two = unified(spark, ("exact", "s", 1, 1), ("exact", "s", 2, 1), ("exact", "t", 3, 1), ("exact", "u", 4, 0))
    assert rows(integrity.check_one_primary(two, ["group_key"]), "group_key") == [("s", 2, 2), ("u", 0, 1)]


# ---- scalar functions -------------------------------------------------------------------


def test_format_bytes(spark):
    cases = {
        None: "0 B", 0: "0 B", -5: "0 B", 1: "1 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 1331: "1.3 KB", 1280: "1.3 KB",
        1024**2 - 1: "1024.0 KB", 1024**2: "1.0 MB", 1024**3: "1.0 GB", 5 * 1024**4: "5.0 TB", 1024**5: "1024.0 TB",
    }
    assert values(spark, X.format_bytes, list(cases), "long") == list(cases.values())


def test_parse_ts(spark):
    cases = {
        "2026-03-13 10:00:00": 1773396000, "2026-03-13T10:00:00Z": 1773396000, "2026-03-13T10:00:00+02:00": 1773388800,
        " 2026-03-13T10:00:00.5+00:00 ": 1773396000, "2026-03-13": 1773360000, "": None, "soon": None, "2026-13-01 00:00:00": None, "10:00": None,
    }
    assert values(spark, lambda c: F.unix_timestamp(X.parse_ts(c)), list(cases)) == list(cases.values())


def test_staleness(spark):
    df = spark.createDataFrame([("2026-03-13 11:59:00",), ("2026-03-13 11:59:01",), (None,)], "t string")
    stale = X.is_stale(F.to_timestamp("t"), F.to_timestamp(F.lit(NOW)), 5)
    assert [r[0] for r in df.select(stale).collect()] == [True, False, False]


def test_small_texts(spark):
    assert values(spark, X.normalize_action, [" RESTORE ", "move_to_trash", "shred"]) == ["restore", "move_to_trash", None]
    assert values(spark, P.short_path, ["", None, "a" * 72, "b" * 70 + "tail"]) == ["-", "-", "a" * 72, "..." + "b" * 65 + "tail"]
    ids = spark.createDataFrame([([1, 2],)], "ids array<long>")
    lit = F.lit
    signature = X.preview_signature(lit(None).cast("string"), lit("exact"), lit("selected"), lit("restore"), lit(None).cast("string"), F.col("ids"))
    assert ids.select(signature).first()[0] == "none|exact|selected|restore|none|1,2"
    keys = ["a", "", "ключ", "x" * 200]
    assert values(spark, X.idempotent_job_id, keys) == [str(uuid.uuid5(uuid.NAMESPACE_URL, k)) for k in keys]


def test_paths(spark):
    assert values(spark, lambda c: P.extension(P.file_name(c)), ["/a/B.JPG", "/a/.rc", "/a.b/c", "/x.", "/x.tar.gz"]) == [".jpg", None, None, None, ".gz"]
    assert values(spark, lambda c: P.trash_path(c, "/nas/.trash"), ["/nas/a", "//b", "/"]) == ["/nas/.trash/nas/a", "/nas/.trash/b", None]
    assert values(spark, lambda c: P.inside_trash(c, "/nas/.trash"), ["/nas/.trash/a", "/nas/.trash", "/nas/.trash2/a"]) == [True, True, False]
