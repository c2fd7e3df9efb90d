import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import files, listing, movements, rows
from twinsift.functions.fingerprints import fingerprint
from twinsift.operators import index
from twinsift.plans.scan import drop_job, load_index, run_job, save_scan, scan_roots
from twinsift.schemas import FILE_HASHES, FILE_MOVEMENTS, FILES, LISTING, SCAN_JOBS
from twinsift.sources import folder_source
from twinsift.sources import listing as src
from twinsift.sources import tables


def root_table(spark, *paths):
    return spark.createDataFrame([(i + 1, str(p)) for i, p in enumerate(paths)], "root_id long, path string")


def empty_index(spark):
    return spark.createDataFrame([], FILES), spark.createDataFrame([], FILE_HASHES)


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_listing_finds_hidden_empty_and_nested_files(spark, tmp_path):
    expected = {"a.jpg": b"alpha", ".hidden": b"h", "_x/y/z.TXT": b"", ".dir/deep/er/f": b"12"}
    for name, data in expected.items():
        write(tmp_path / name, data)
    os.symlink(tmp_path / "a.jpg", tmp_path / "link.jpg")
    os.symlink(tmp_path / "_x", tmp_path / "folder_link")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken")
    got = {r.rel_path: r for r in src.list_files(root_table(spark, tmp_path)).collect()}
    assert set(got) == set(expected) | {"link.jpg"}
    for name, data in expected.items():
        info = (tmp_path / name).stat()
        row = got[name]
        assert (row.size_bytes, row.mtime_epoch_ns, row.inode, row.dev) == (
            len(data), info.st_mtime_ns, info.st_ino, info.st_dev,
        )
        assert row.abs_path == str(tmp_path / name) and row.file_name == os.path.basename(name)


def test_missing_root_fails(spark, tmp_path):
    with pytest.raises(Exception, match="No such file"):
        src.list_files(root_table(spark, tmp_path / "gone")).collect()


def test_streamed_prints_equal_those_of_the_whole_content(spark, tmp_path):
    sizes = [0, 1, 63, 64, 65, 66, 4097, (1 << 20) - 1, 1 << 20, (1 << 20) + 13, 3_000_001]
    for i, size in enumerate(sizes):
        write(tmp_path / f"{i}.bin", bytes((j * 31 + i * 7 + j // 251) % 256 for j in range(size)))
    changed = spark.createDataFrame(
        [(i, str(tmp_path / f"{i}.bin"), size, True) for i, size in enumerate(sizes)] + [(99, "/gone", 5, False)],
        "file_id long, abs_path string, size_bytes long, changed boolean",
    )
    whole = rows(fingerprint(src.read_changed_content(changed)), "file_id", "hash_type")
    assert rows(src.fingerprint_changed(changed), "file_id", "hash_type") == whole
    assert len(whole) == 3 * len(sizes)
    assert whole[0][2] == hashlib.sha256(b"").hexdigest()


def test_prints_from_chunks_equal_those_of_the_whole_content(spark, tmp_path):
    sizes = [0, 1, 64, 65, 66, 1000, 70_001]
    for i, size in enumerate(sizes):
        write(tmp_path / f"{i}.bin", bytes((j * 31 + i * 7 + j // 251) % 256 for j in range(size)))
    changed = spark.createDataFrame(
        [(i, str(tmp_path / f"{i}.bin"), size, True) for i, size in enumerate(sizes)],
        "file_id long, abs_path string, size_bytes long, changed boolean",
    )
    chunks = src.read_chunks(changed, chunk_bytes=1000)
    assert rows(chunks.groupBy("file_id").count(), "file_id") == [(i, max(1, -(-size // 1000))) for i, size in enumerate(sizes)]
    assert chunks.select(F.max(F.octet_length("content"))).first()[0] == 1000
    whole = rows(fingerprint(src.read_changed_content(changed)), "file_id", "hash_type")
    assert rows(src.fingerprint_chunks(chunks.orderBy(F.rand(3))), "file_id", "hash_type") == whole
    with pytest.raises(Exception, match="chunk 3 is missing"):
        src.fingerprint_chunks(chunks.where("chunk_no <> 3")).collect()


def test_a_large_file_is_never_one_cell(spark, tmp_path):
    size, path = 300 << 20, tmp_path / "large.bin"
    with open(path, "wb") as file:
        for i in range(size >> 20):
            file.write(bytes([i % 251]) * (1 << 20))
    changed = spark.createDataFrame([(1, str(path), size, True)], "file_id long, abs_path string, size_bytes long, changed boolean")
    chunks = src.read_chunks(changed)
    assert rows(src.fingerprint_chunks(chunks), "hash_type") == rows(src.fingerprint_changed(changed), "hash_type")


def test_the_folder_source_lists_what_list_files_does(spark, tmp_path):
    for name in ("a.jpg", ".hidden", "_x/y/z.TXT", ".dir/deep/er/f", "_x/k", "é ü/n"):
        write(tmp_path / "one" / name, name.encode())
    write(tmp_path / "two" / "b", b"2")
    os.symlink(tmp_path / "one" / "_x", tmp_path / "one" / "folder_link")
    roots = {1: str(tmp_path / "one"), 2: str(tmp_path / "two")}
    table = spark.createDataFrame(list(roots.items()), "root_id long, path string")
    want = rows(src.list_files(table).select(*LISTING.fieldNames()), "root_id", "rel_path")
    for folders in (1, 3, 100):
        assert rows(folder_source.read_folders(spark, roots, folders=folders), "root_id", "rel_path") == want
    # Roots that are not asked for are not opened: the missing one does no harm.
    lost = {**roots, 3: str(tmp_path / "gone")}
    assert rows(folder_source.read_folders(spark, lost, [1, 2]), "root_id", "rel_path") == want
    assert folder_source.read_folders(spark, lost, []).count() == 0
    both = folder_source.read_folders(spark, roots)
    assert both.where("root_id = 2").count() == 1 and both.count() == len(want)
    with pytest.raises(Exception, match="No such file"):
        folder_source.read_folders(spark, lost).collect()


def test_path_attributes(spark):
    names = ["a.JPG", "b.tar.gz", "c.tgz", ".bashrc", "d.", "e", "f.unknownext", "g.txt.gz", "..h.png", "i.html.br"]
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    got = {r.file_name: (r.extension, r.mime_type) for r in src.path_attributes(df).collect()}
    assert got == {
        "a.JPG": (".jpg", "image/jpeg"),
        "b.tar.gz": (".gz", "application/x-tar"),
        "c.tgz": (".tgz", "application/x-tar"),
        ".bashrc": (None, None),
        "d.": (None, None),
        "e": (None, None),
        "f.unknownext": (".unknownext", None),
        "g.txt.gz": (".gz", "text/plain"),
        "..h.png": (".png", "image/png"),
        "i.html.br": (".br", "text/html"),
    }


def test_change_rules(spark):
    base = dict(size_bytes=5, mtime_epoch_ns=10, inode=7, dev=1)
    old = files(
        spark,
        *[dict(file_id=i, abs_path=f"/nas/{n}", **base) for i, n in enumerate("abcdefg", 1)],
        dict(file_id=8, abs_path="/nas/back", **{**base, "is_present": 0}),
    )
    now = listing(
        spark,
        dict(abs_path="/nas/a", **base),
        dict(abs_path="/nas/b", **{**base, "size_bytes": 6}),
        dict(abs_path="/nas/c", **{**base, "mtime_epoch_ns": 11}),
        dict(abs_path="/nas/d", **{**base, "inode": 8}),
        dict(abs_path="/nas/e", **{**base, "dev": 2}),
        dict(abs_path="/nas/f", **{**base, "inode": None, "dev": None}),
        dict(abs_path="/nas/back", **base),
        dict(abs_path="/nas/new", **base),
    )
    got = {p: (n, c) for p, n, c in index.detect_changes(now, old).select("abs_path", "is_new", "changed").collect()}
    assert got == {
        "/nas/a": (False, False), "/nas/b": (False, True), "/nas/c": (False, True), "/nas/d": (False, True),
        "/nas/e": (False, True), "/nas/f": (False, False), "/nas/back": (False, True), "/nas/new": (True, True),
    }


def test_upsert_keeps_id_and_wipes_unlisted_attributes(spark):
    old = files(
        spark,
        dict(file_id=5, abs_path="/nas/a", size_bytes=101, width=10, exif_make="x", first_seen_job_id="j1", last_seen_job_id="j1", is_present=0),
        dict(file_id=9, abs_path="/nas/z", width=4, last_seen_job_id="j1"),
    )
    now = listing(spark, dict(abs_path="/nas/a", size_bytes=202, root_id=3), dict(abs_path="/nas/n2"), dict(abs_path="/nas/n1"))
    after = index.upsert_files(old, src.path_attributes(now), "j2")
    got = rows(after.select("file_id", "abs_path", "root_id", "size_bytes", "width", "exif_make", "first_seen_job_id", "last_seen_job_id", "is_present"), "file_id")
    assert got == [
        (5, "/nas/a", 3, 202, None, None, "j1", "j2", 1),
        (9, "/nas/z", 1, 1, 4, None, None, "j1", 1),
        (10, "/nas/n1", 1, 1, None, None, "j2", "j2", 1),
        (11, "/nas/n2", 1, 1, None, None, "j2", "j2", 1),
    ]


def test_missing_only_in_scanned_roots(spark):
    old = files(
        spark, dict(file_id=1, abs_path="/nas/a"), dict(file_id=2, abs_path="/nas/b"),
        dict(file_id=3, abs_path="/nas/c", root_id=2), dict(file_id=4, abs_path="/nas/d", is_present=0, last_seen_job_id="j0"),
    )
    after = index.mark_missing(old, listing(spark, dict(abs_path="/nas/a")), [1], "j1")
    assert rows(after.select("file_id", "is_present", "last_seen_job_id"), "file_id") == [
        (1, 1, None), (2, 0, "j1"), (3, 1, None), (4, 0, "j0"),
    ]


def test_overlapping_roots(spark):
    both = listing(spark, dict(abs_path="/nas/a/x", root_id=1), dict(abs_path="/nas/a/x", root_id=2, rel_path="x"), dict(abs_path="/nas/y"))
    owned = index.resolve_overlapping_roots(both)
    assert rows(owned.select("abs_path", "root_id", "rel_path"), "abs_path") == [("/nas/a/x", 2, "x"), ("/nas/y", 1, "nas/y")]
    changes = index.detect_changes(owned, files(spark, dict(file_id=1, abs_path="/nas/y")))
    assert tuple(index.scan_metrics(both, changes).first()) == (3, 1)


def test_hash_upsert_replaces(spark):
    current = spark.createDataFrame([(1, "phash64", "abc"), (2, "phash64", "x")], FILE_HASHES)
    new = spark.createDataFrame([(1, "phash64", "def"), (1, "dhash64", "d")], FILE_HASHES)
    assert rows(index.upsert_hashes(current, new), "file_id", "hash_type") == [
        (1, "dhash64", "d"), (1, "phash64", "def"), (2, "phash64", "x"),
    ]


def test_rescans_of_a_real_folder(spark, tmp_path):
    write(tmp_path / "root" / "a.jpg", b"alpha")
    write(tmp_path / "root" / "b.jpg", b"beta")
    roots = root_table(spark, tmp_path / "root")
    table, hashes = empty_index(spark)

    first = scan_roots(roots, table, hashes, "j1")
    assert tuple(first.metrics.select("files_seen", "files_indexed").first()) == (2, 2)
    second = scan_roots(roots, first.files, first.file_hashes, "j2")
    assert tuple(second.metrics.select("files_seen", "files_indexed").first()) == (2, 0)
    os.remove(tmp_path / "root" / "b.jpg")
    third = scan_roots(roots, second.files, second.file_hashes, "j3")
    assert third.metrics.first().files_seen == 1
    assert rows(third.files.select("file_name", "is_present"), "file_name") == [("a.jpg", 1), ("b.jpg", 0)]


def test_unchanged_files_of_earlier_jobs_are_grouped_again(spark, tmp_path):
    write(tmp_path / "a", b"A" * 256)
    roots = root_table(spark, tmp_path)
    first = scan_roots(roots, *empty_index(spark), "j1")
    assert first.metrics.first().exact_groups_found == 0
    write(tmp_path / "b", b"A" * 256)
    write(tmp_path / "c", b"A" * 128 + b"B" * 128)
    both = scan_roots(roots, first.files, first.file_hashes, "j2")
    totals = both.metrics.first()
    assert (totals.files_seen, totals.files_indexed, totals.exact_groups_found, totals.reclaimable_bytes) == (3, 2, 1, 256)
    assert totals.similar_groups_found == 1
    exact_only = scan_roots(roots, first.files, first.file_hashes, "j3", mode="exact").metrics.first()
    assert (exact_only.exact_groups_found, exact_only.similar_groups_found) == (1, 0)


def test_files_of_unique_size_are_not_read_in_full(spark, tmp_path):
    write(tmp_path / "a", b"A" * 256)
    write(tmp_path / "b", b"B" * 100)
    roots = root_table(spark, tmp_path)
    options = dict(skip_unique_sizes=True)
    digests = lambda r: r.file_hashes.where("hash_type = 'blake3_full'").count()
    first = scan_roots(roots, *empty_index(spark), "j1", **options)
    assert (digests(first), first.file_hashes.count()) == (0, 4)
    write(tmp_path / "c", b"A" * 256)
    second = scan_roots(roots, first.files, first.file_hashes, "j2", **options)
    totals = second.metrics.first()
    assert (totals.files_indexed, totals.exact_groups_found, totals.reclaimable_bytes) == (1, 1, 256)
    assert (digests(second), second.file_hashes.count()) == (2, 8)
    write(tmp_path / "c", b"D" * 77)
    third = scan_roots(roots, second.files, second.file_hashes, "j3", **options)
    assert third.metrics.first().exact_groups_found == 0 and digests(third) == 1
    full = scan_roots(roots, *empty_index(spark), "j4")
    same = lambda r: rows(r.file_hashes.where("hash_type <> 'blake3_full'").join(r.files.select("file_id", "file_name"), "file_id").select("file_name", "hash_type", "hash_hex"), "file_name", "hash_type")
    assert same(third) == same(full)


def test_one_pass_refresh_equals_the_three_steps(spark):
    base = dict(size_bytes=5, mtime_epoch_ns=10, inode=7, dev=1, first_seen_job_id="j0", last_seen_job_id="j0")
    old = files(
        spark,
        *[dict(file_id=i, abs_path=f"/nas/{n}", **base) for i, n in enumerate("abcdef", 1)],
        dict(file_id=8, abs_path="/nas/back", **{**base, "is_present": 0}),
        dict(file_id=9, abs_path="/nas/other", root_id=4, **base),
        dict(file_id=10, abs_path="/nas/gone", **base),
    )
    fresh = dict(size_bytes=5, mtime_epoch_ns=10, inode=7, dev=1)
    now = src.path_attributes(listing(
        spark, dict(abs_path="/nas/a", **fresh), dict(abs_path="/nas/b", **{**fresh, "size_bytes": 6}),
        dict(abs_path="/nas/c", **{**fresh, "inode": None, "dev": None}), dict(abs_path="/nas/d", **{**fresh, "dev": 3}),
        dict(abs_path="/nas/back", **fresh), dict(abs_path="/nas/new2", **fresh), dict(abs_path="/nas/new1", **fresh),
    ))
    at = F.to_timestamp(F.lit("2026-03-13 10:00:00"))
    got = index.refresh_index(old, now, [1], "j1", at)
    steps = index.mark_missing(index.upsert_files(old, now, "j1", at), now, [1], "j1", at)
    assert rows(got.select(*old.columns), "file_id") == rows(steps, "file_id")
    changed = index.detect_changes(now, old).where("changed").select("abs_path")
    assert rows(got.where("changed").select("abs_path"), "abs_path") == rows(changed, "abs_path")


def test_storing_a_scan_twice_and_dropping_it(spark, tmp_path):
    write(tmp_path / "in" / "a", b"A" * 100)
    write(tmp_path / "in" / "b", b"A" * 100)
    base = str(tmp_path / "store")
    result = scan_roots(root_table(spark, tmp_path / "in"), *empty_index(spark), "j1")
    save_scan(result, base)
    save_scan(result, base)
    assert spark.read.parquet(f"{base}/exact_groups").count() == 1
    files, hashes = load_index(spark, base, "j1")
    assert rows(files, "file_id") == rows(result.files, "file_id") and hashes.count() == 6
    # A later job starts from it and leaves it alone.
    write(tmp_path / "in" / "c", b"C")
    second = scan_roots(root_table(spark, tmp_path / "in"), files, hashes, "j/2")
    save_scan(second, base)
    assert load_index(spark, base, "j/2")[0].count() == 3
    assert load_index(spark, base, "j1")[0].count() == 2
    groups = spark.read.parquet(f"{base}/exact_groups")
    assert rows(groups.select("job_id"), "job_id") == [("j/2",), ("j1",)]
    drop_job(spark, base, "j1")
    assert rows(spark.read.parquet(f"{base}/exact_groups").select("job_id"), "job_id") == [("j/2",)]


def test_a_batch_that_is_appended_twice_is_in_the_ledger_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = movements(spark, (1, 1, "7", "/a", "/t/a", False), (2, 2, "7", "/b", "/t/b", False))
    tables.append_ledger(first, path)
    tables.append_ledger(movements(spark, (3, 1, "b/2", "/a", "/t/a", False)), path)
    tables.append_ledger(first, path)
    stored = tables.read_ledger(spark, path)
    assert rows(stored.select("movement_id", "batch_id"), "movement_id") == [(1, "7"), (2, "7"), (3, "b/2")]
    assert stored.schema == FILE_MOVEMENTS


def test_files_of_a_ledger_do_not_grow_with_its_batches(spark, tmp_path):
    path = tmp_path / "ledger"
    many = movements(spark, *[(i, i, str(i % 300), f"/x/{i}", f"/t/{i}", False) for i in range(900)])
    tables.append_ledger(many, str(path))
    assert 0 < len(list(path.rglob("*.parquet"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A batch is replaced as a whole, also one without a name; the others stay.
    tables.append_ledger(movements(spark, (901, 1, None, "/a", "/t/a", False), (902, 2, None, "/b", "/t/b", False)), str(path))
    tables.append_ledger(movements(spark, (7, 7, "7", "/x/7", "/t/7", True), (902, 2, None, "/b", "/t/b", True)), str(path))
    stored = tables.read_ledger(spark, str(path))
    assert stored.count() == 900 - 2 + 1
    changed = stored.where("batch_id = '7' OR batch_id IS NULL").select("movement_id", F.col("restored_at").isNotNull())
    assert rows(changed, "movement_id") == [(7, True), (902, True)]


def test_pages_after_a_key_go_both_ways(spark):
    df = spark.createDataFrame([(r, f) for r in (1, 2) for f in range(1, 5)], "root_id long, file_id long")
    down = tables.page_after(df, ["root_id", "file_id"], (2, 2), 2, descending=True)
    assert [tuple(r) for r in down.collect()] == [(2, 1), (1, 4)]
    assert [r.file_id for r in tables.list_by_root(df, 1, limit=2, after=2).collect()] == [3, 4]


def test_pages_follow_the_last_key(spark):
    df = spark.createDataFrame([(r, f) for r in (1, 2) for f in range(1, 5)], "root_id long, file_id long")
    seen, after = [], None
    while page := [tuple(r) for r in tables.page_after(df, ["root_id", "file_id"], after, 3).collect()]:
        seen, after = seen + page, page[-1]
    assert seen == [(r, f) for r in (1, 2) for f in range(1, 5)]
    with pytest.raises(ValueError):
        tables.page_after(df, ["file_id"], None, 0)


def test_empty_rebuild_removes_old_groups(spark, tmp_path):
    path = str(tmp_path / "groups")
    groups = spark.createDataFrame([("j1", "s"), ("j2", "t")], "job_id string, signature string")
    tables.replace_job_groups(groups, path, "j1")
    tables.replace_job_groups(groups, path, "j2")
    tables.replace_job_groups(groups.where("false"), path, "j1")
    assert rows(spark.read.parquet(path).select("job_id", "signature"), "job_id") == [("j2", "t")]


def test_failed_scan_marks_the_job(spark, tmp_path):
    jobs = spark.createDataFrame([("j1", "both", "queued", None, None, None, None, 0, 0, 0, 0, 0)], SCAN_JOBS)
    now = F.to_timestamp(F.lit("2026-03-13 10:00:00"))
    gone = root_table(spark, tmp_path / "gone")
    result, after = run_job(jobs, "j1", now, lambda: scan_roots(gone, *empty_index(spark), "j1"))
    row = after.first()
    assert result is None and row.status == "failed" and "No such file" in row.error_message
    assert row.started_at is not None and row.finished_at is not None
    write(tmp_path / "ok" / "a", b"1")
    result, after = run_job(jobs, "j1", now, lambda: scan_roots(root_table(spark, tmp_path / "ok"), *empty_index(spark), "j1"))
    row = after.first()
    assert (row.status, row.error_message, row.files_seen) == ("completed", None, 1)


def test_pages_and_wide_hashes(spark):
    df = spark.range(1, 8).withColumnRenamed("id", "file_id")
    assert [r[0] for r in tables.page(df, ["file_id"], 2, 3).collect()] == [4, 5, 6]
    assert tables.page(df, ["file_id"], 9, 3).count() == 0
    with pytest.raises(ValueError):
        tables.page(df, ["file_id"], 0)
    long = spark.createDataFrame([(1, "phash64", "p"), (1, "blake3_full", "b")], FILE_HASHES)
    wide = tables.hashes_wide(long)
    assert wide.first().asDict() == {"file_id": 1, "blake3_full": "b", "dhash64": None, "phash64": "p"}
    assert rows(tables.hashes_long(wide), "hash_type") == rows(long, "hash_type")


def test_root_filter_reaches_the_parquet_scan(spark, tmp_path):
    files(spark, dict(file_id=1)).write.parquet(str(tmp_path / "files"))
    stored = spark.read.parquet(str(tmp_path / "files"))
    plan = tables.files_in_roots(stored, [1]).select("file_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(is_present,1)" in plan and "root_id" in plan.split("PushedFilters")[1]
    assert "abs_path" not in plan.split("ReadSchema")[1]


def test_new_prints_are_read_once_on_a_filled_index(spark):
    reads = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    stored = spark.createDataFrame([(1, "phash64", "abc"), (2, "phash64", "x"), (9, "dhash64", "y")], FILE_HASHES)
    new = spark.createDataFrame([(1, "phash64", "def"), (3, "phash64", "g")], FILE_HASHES).mapInArrow(read, FILE_HASHES)
    got = index.upsert_hashes(stored, new)
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "phash64", "def"), (2, "phash64", "x"), (3, "phash64", "g"), (9, "dhash64", "y"),
    ]
    assert reads.value == 2
