"""Work that follows a rescan: new prints, touched signatures, the bucketed index, crowded joins."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import files, listing, rows
from tests.test_groups import near_pairs, signed, union_find
from twinsift import schemas
from twinsift.operators import index, maintenance, print_index
from twinsift.operators.components import connected_components
from twinsift.operators.similar import similar_links, similar_pairs
from twinsift.operators.slices import class_sizes, sliced_join, triangle_join
from twinsift.sources import tables as src


def frame(spark, values):
    return spark.createDataFrame([(signed(v),) for v in values], "print long")


def clustered(rng, n):
    out = {rng.getrandbits(64) for _ in range(n // 3)}
    while len(out) < n:
        out.add(rng.choice(sorted(out)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))))
    return out


def operators_above(plan, leaf):
    """Names of the operators between the root of a physical plan and each scan whose text holds ``leaf``."""
    found = []

    def walk(node, above):
        children = [node.children().apply(i) for i in range(node.children().size())]
        if not children and leaf in node.toString():
            found.append(above)
        for child in children:
            walk(child, above + [node.nodeName()])

    walk(plan, [])
    return found


@pytest.fixture
def static_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ---- crowded joins


@pytest.mark.parametrize("slice_rows", [7, 1000])
def test_sliced_join_equals_a_plain_join(spark, slice_rows):
    rng = random.Random(4)
    left = spark.createDataFrame([("hot" if i % 3 else f"k{rng.randrange(5)}", i) for i in range(90)], "k string, a long")
    right = spark.createDataFrame([("hot" if i % 4 == 0 else f"k{rng.randrange(9)}", i) for i in range(60)], "k string, b long")
    got = sliced_join(left, right, ["k"], ["a"], ["b"], slice_rows, hot_rows=10)
    assert rows(got.select("k", "a", "b"), "k", "a", "b") == rows(left.join(right, "k"), "k", "a", "b")


def test_no_task_of_a_sliced_join_meets_all_rows_of_a_key(spark, static_plans):
    left = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    right = spark.range(50).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    got = sliced_join(left, right, ["k"], ["a"], ["b"], slice_rows=100)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 150_000 and len(sizes) > 1


@pytest.mark.parametrize("slice_rows", [3, 50])
def test_triangle_join_meets_every_pair_of_unlike_kinds_once(spark, slice_rows):
    rng = random.Random(9)
    data = [(k, v, rng.choice([0, 0, 1, 2, 2, 2, 2])) for k in ("x", "y") for v in range(40)]
    df = spark.createDataFrame(data, "k string, v long, kind int")
    sized = df.join(class_sizes(df, ["k"], "kind"), "k")
    got = triangle_join(sized, ["k"], "v", "kind", [], slice_rows)
    want = [
        (k, a, b) for k, a, p in data for k2, b, q in data if k == k2 and a < b and (p == 0 or p != q)
    ]
    assert rows(got.select("k", "v_a", "v_b"), "k", "v_a", "v_b") == sorted(want)
    work = {r.k: r.work for r in class_sizes(df, ["k"], "kind").collect()}
    for key in ("x", "y"):
        assert abs(work[key] - sum(k == key for k, _, _ in want)) <= 40


# ---- prints


@pytest.mark.parametrize("threshold", [1, 4, 8, 11])
def test_new_pairs_and_stored_pairs_are_all_pairs(spark, threshold):
    values = sorted(clustered(random.Random(threshold), 90))
    old, new = values[::2] + values[1:20:2], values[1::2]
    gone = old[::7]
    left = [v for v in old if v not in gone]
    stored = similar_pairs(frame(spark, old), threshold)
    got = print_index.pairs_after(
        stored, print_index.file_prints(frame(spark, old), threshold), frame(spark, left + new), frame(spark, set(gone) - set(new)), threshold
    )
    assert rows(got, "print_a", "print_b") == near_pairs(set(left + new), threshold)


def test_a_crowded_block_value_is_searched_in_slices(spark):
    rng = random.Random(8)
    values = sorted({rng.getrandbits(6) << 58 | rng.getrandbits(5) << 30 for _ in range(120)})
    old, new = values[::3], values[1::3] + values[2::3]
    filed = print_index.file_prints(frame(spark, old))
    want = [p for p in near_pairs(values, 8) if not ({p[0], p[1]} <= {signed(v) for v in old})]
    got = print_index.delta_pairs(filed, frame(spark, new), 8, slice_rows=10, hot_rows=20)
    assert rows(got, "print_a", "print_b") == want


def test_stored_prints_are_read_as_they_are_filed(spark, tmp_path, static_plans):
    """Nothing multiplies the rows of the stored index; a batch that is stored again replaces itself."""
    values = sorted(clustered(random.Random(2), 60))
    base = str(tmp_path / "index")
    print_index.store_prints(frame(spark, values[:40]), base, "one")
    print_index.store_prints(frame(spark, values[30:50]), base, "two")
    print_index.store_prints(frame(spark, values[40:50]), base, "two")
    stored = print_index.stored_prints(spark, base)
    assert stored.count() == 3 * 50
    fresh = print_index.new_prints(stored, frame(spark, values))
    assert fresh.count() == 10
    pairs = print_index.delta_pairs(stored, frame(spark, values))
    above = operators_above(pairs._jdf.queryExecution().executedPlan(), "index")
    assert above and not any("Generate" in name for names in above for name in names)
    assert print_index.probe_prints(fresh).count() == 10 * (2 * (1 + 21 + 210) + 1 + 22 + 231)


@pytest.mark.parametrize("seed", [1, 2])
def test_continued_labels_equal_labels_from_scratch(spark, seed):
    rng = random.Random(seed)
    values = sorted(clustered(rng, 120))
    rng.shuffle(values)
    old, new = values[:80], values[80:]
    gone = set(rng.sample(old, 15))
    labels = connected_components(similar_links(frame(spark, old)))
    got = print_index.update_labels(
        labels, print_index.file_prints(frame(spark, old)), frame(spark, (set(old) - gone) | set(new)), frame(spark, gone), hot_rows=6
    )
    left = (set(old) - gone) | set(new)
    assert dict(map(tuple, got.collect())) == union_find([(a, b) for a, b, _ in near_pairs(left, 8)])


def test_labels_without_changes_stay(spark):
    values = sorted(clustered(random.Random(5), 40))
    labels = connected_components(similar_links(frame(spark, values)))
    filed = print_index.file_prints(frame(spark, values))
    got = print_index.update_labels(labels, filed, frame(spark, values), frame(spark, []))
    assert rows(got, "id") == rows(labels, "id")
    none = print_index.update_labels(labels, filed, frame(spark, []), frame(spark, values))
    assert none.count() == 0


# ---- exact groups


def members(spark, entries):
    """(file_id, signature, size)"""
    df = spark.createDataFrame(entries, "file_id long, signature string, size_bytes long")
    return df.select(
        "file_id", "signature", (F.col("file_id") % 4 * 10).cast("int").alias("width"), F.lit(10).alias("height"),
        "size_bytes", F.lit(None).cast("string").alias("exif_datetime_original"), (F.col("file_id") * 7 % 5).alias("mtime_epoch_ns"),
    )


def state_rows(state):
    items = rows(state.items.select("signature", "file_id", "keep_score", "reason", "is_primary"), "signature", "file_id")
    return items, rows(state.groups.select("signature", "file_count", "total_bytes", "reclaimable_bytes"), "signature")


def test_refreshed_groups_equal_groups_from_scratch(spark, tmp_path):
    rng = random.Random(6)
    before = {i: "hot" if i % 3 == 0 else f"s{rng.randrange(30)}" for i in range(120)}
    after = {i: (f"s{rng.randrange(30)}" if i % 9 == 0 else s) for i, s in before.items() if i % 13 != 5}
    after |= {i: f"s{rng.randrange(40)}" for i in range(200, 215)}
    as_rows = lambda table: [(i, s, 5) for i, s in table.items()]
    base = str(tmp_path / "state")
    maintenance.save_state(maintenance.build_state(members(spark, as_rows(before)), parts=8), base)
    gone = [(i, s) for i, s in before.items() if after.get(i) != s]
    added = {i: s for i, s in after.items() if before.get(i) != s}
    change = (spark.createDataFrame(gone, "file_id long, signature string"), members(spark, as_rows(added)))
    want = state_rows(maintenance.build_state(members(spark, as_rows(after)), parts=8))
    for _ in range(2):  # a repeated job changes nothing
        maintenance.refresh_state(spark, base, *change, parts=8, hot_rows=10)
        assert state_rows(maintenance.load_state(spark, base)) == want
    assert rows(maintenance.load_state(spark, base).members.select("file_id", "signature"), "file_id") == sorted(after.items())


def test_only_touched_partitions_are_read_and_replaced(spark, tmp_path):
    table = {i: f"s{i // 2}" for i in range(200)}
    base = str(tmp_path / "state")
    maintenance.save_state(maintenance.build_state(members(spark, [(i, s, 5) for i, s in table.items()]), parts=32), base)
    stored = maintenance.load_state(spark, base)
    written = {f: (tmp_path / "state").joinpath(f).stat().st_mtime_ns for f in
               [str(p.relative_to(tmp_path / "state")) for p in (tmp_path / "state").rglob("*.parquet")]}
    gone = spark.createDataFrame([(0, "s0")], "file_id long, signature string")
    nothing = members(spark, [(0, "s0", 5)]).where("false")
    part = maintenance.in_parts(gone, 32).first().part
    assert maintenance.refresh_state(spark, base, gone, nothing, parts=32) == [part]
    changed = [f for f, at in written.items()
               if not (tmp_path / "state" / f).exists() or (tmp_path / "state" / f).stat().st_mtime_ns != at]
    assert changed and all(f"part={part}/" in f for f in changed)
    assert maintenance.load_state(spark, base).groups.where("signature = 's0'").count() == 0


def test_other_partitions_are_not_even_opened(spark, tmp_path):
    table = {i: f"s{i // 2}" for i in range(100)}
    base = tmp_path / "state"
    maintenance.save_state(maintenance.build_state(members(spark, [(i, s, 5) for i, s in table.items()]), parts=16), str(base))
    stored = maintenance.load_state(spark, str(base))
    gone = spark.createDataFrame([(0, "s0")], "file_id long, signature string")
    part = maintenance.in_parts(gone, 16).first().part
    for file in base.rglob("*.parquet"):
        if f"part={part}/" not in str(file):
            file.write_bytes(b"not to be read")
    after = maintenance.update_state(stored, gone, members(spark, [(0, "s0", 5)]).where("false"), parts=16)
    assert after.members.where("file_id = 1").count() == 1 and after.items.where("signature = 's0'").count() == 0
    assert after.groups.where(f"part <> {part}").count() == 0


def test_a_partition_that_loses_its_last_group_is_emptied(spark, tmp_path):
    base = str(tmp_path / "state")
    maintenance.save_state(maintenance.build_state(members(spark, [(1, "a", 5), (2, "a", 5)]), parts=4), base)
    gone = spark.createDataFrame([(1, "a"), (2, "a")], "file_id long, signature string")
    maintenance.refresh_state(spark, base, gone, members(spark, [(1, "a", 5)]).where("false"), parts=4)
    state = maintenance.load_state(spark, base)
    assert (state.members.count(), state.items.count(), state.groups.count()) == (0, 0, 0)


# ---- the bucketed index


def test_a_bucketed_index_is_not_shuffled_by_a_rescan(spark, tmp_path, static_plans):
    old = files(spark, *[dict(file_id=i, abs_path=f"/nas/photo/{i}.jpg") for i in range(1, 30)])
    now = listing(spark, *[dict(abs_path=f"/nas/photo/{i}.jpg", size_bytes=i % 3) for i in range(10, 40)])
    path = str(tmp_path / "files")
    src.save_bucketed(old, "files_in_buckets", path, buckets=4)
    spark.sql("DROP TABLE files_in_buckets")  # as in a new session; the folder is external
    stored = src.open_bucketed(spark, "files_again", path, schemas.FILES, buckets=4)
    at = F.to_timestamp(F.lit("2026-03-13 10:00:00"))
    joined = stored.join(now.withColumnRenamed("size_bytes", "new_size").select("abs_path", "new_size"), "abs_path", "full_outer")
    above = operators_above(joined._jdf.queryExecution().executedPlan(), "files_again")
    assert above and not any("Exchange" in name for names in above for name in names)
    got = index.refresh_index(stored, now, [1], "j1", at)
    want = index.refresh_index(old, now, [1], "j1", at)
    assert rows(got, "abs_path") == rows(want.select(*got.columns), "abs_path")


def test_upsert_is_a_refresh_that_marks_nothing_missing(spark):
    old = files(spark, dict(file_id=1, abs_path="/nas/photo/a.jpg"), dict(file_id=2, abs_path="/nas/photo/b.jpg"))
    now = listing(spark, dict(abs_path="/nas/photo/b.jpg", size_bytes=9), dict(abs_path="/nas/photo/c.jpg"))
    after = {r.abs_path: r for r in index.upsert_files(old, now, "j2").collect()}
    assert after["/nas/photo/a.jpg"].is_present == 1 and after["/nas/photo/a.jpg"].last_seen_job_id is None
    assert (after["/nas/photo/b.jpg"].size_bytes, after["/nas/photo/b.jpg"].last_seen_job_id) == (9, "j2")
    assert (after["/nas/photo/c.jpg"].file_id, after["/nas/photo/c.jpg"].first_seen_job_id) == (3, "j2")
