import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import files, rows
from twinsift.functions.fingerprints import fingerprint
from twinsift.operators import exact, scoring, similar
from twinsift.operators.components import connected_components
from twinsift.operators.integrity import check_one_primary
from twinsift.session import checkpointed


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def near_pairs(values, threshold):
    values = sorted(set(signed(v) for v in values))
    out = []
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            distance = ((a ^ b) & ((1 << 64) - 1)).bit_count()
            if distance <= threshold:
                out.append((a, b, distance))
    return sorted(out)


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def clustered_prints(n, seed):
    """Prints around a few centres, many sharing their upper bits."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    out = set()
    while len(out) < n:
        v = rng.choice(centres)
        for _ in range(rng.randrange(12)):
            v ^= 1 << rng.randrange(30 if rng.random() < 0.7 else 64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("threshold", [0, 1, 3, 5, 8, 16])
def test_pairs_equal_comparing_all(spark, threshold):
    values = clustered_prints(130, threshold)
    df = spark.createDataFrame([(signed(v),) for v in values], "print long")
    want = near_pairs(values, threshold)
    assert rows(similar.similar_pairs(df, threshold), "print_a", "print_b") == want


@pytest.mark.parametrize("threshold,bucket_rows", [(2, 5), (8, 10), (8, 40)])
def test_refined_buckets_lose_nothing(spark, threshold, bucket_rows):
    values = clustered_prints(110, 100 + threshold)
    df = spark.createDataFrame([(signed(v),) for v in values], "print long")
    want = near_pairs(values, threshold)
    assert rows(similar.similar_pairs(df, threshold, bucket_rows), "print_a", "print_b") == want
    links = [tuple(r) for r in similar.similar_links(df, threshold, bucket_rows, hot_rows=15).collect()]
    assert union_find(links) == union_find([(a, b) for a, b, _ in want])


@pytest.mark.parametrize("bucket_rows", [40])
def test_one_block_value_held_by_most_prints(spark, bucket_rows):
    """All prints share their low bits but a few, which differ there by one or two bits."""
    rng = random.Random(bucket_rows)
    values = {rng.getrandbits(6) << 58 | rng.getrandbits(5) << 30 for _ in range(150)}
    values |= {rng.choice(sorted(values)) ^ (1 << rng.randrange(21)) for _ in range(6)}
    values |= {rng.choice(sorted(values)) ^ (1 << rng.randrange(21)) for _ in range(3)}
    df = spark.createDataFrame([(signed(v),) for v in values], "print long")
    want = near_pairs(values, 8)
    assert rows(similar.similar_pairs(df, 8, bucket_rows), "print_a", "print_b") == want
    links = [tuple(r) for r in similar.similar_links(df, 8, bucket_rows, hot_rows=20).collect()]
    assert union_find(links) == union_find([(a, b) for a, b, _ in want])


def test_links_of_a_dense_cluster_stay_few(spark):
    """All prints within the threshold of each other: no pair needs to be listed."""
    values = [i for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "print long")
    assert similar.similar_pairs(df, 8).count() == 200 * 199 // 2
    assert similar.similar_links(df, 8).count() < 200 * 10


@pytest.mark.parametrize("bucket_rows", [60, 150, 20_000])
def test_links_grow_with_the_prints_not_with_their_pairs(spark, bucket_rows):
    """Dense prints, of which no hub is near all: links connect what the pairs connect, and stay few."""
    rng = random.Random(17)
    bits = [bit for block in (0, 22, 43) for bit in range(block, block + 6)]
    values = {sum(1 << bit for bit in bits if rng.random() < 0.5) for _ in range(300)}
    values |= {1 << 21 | 1 << 40 | 7 << 60 | rng.getrandbits(64) for _ in range(40)}
    df = spark.createDataFrame([(signed(v),) for v in values], "print long")
    want = near_pairs(values, 8)
    links = [tuple(r) for r in similar.similar_links(df, 8, bucket_rows).collect()]
    assert set(links) <= {(a, b) for a, b, _ in want} | {(b, a) for a, b, _ in want}
    assert union_find(links) == union_find([(a, b) for a, b, _ in want])
    assert len(links) < 10 * len(values) < len(want) / 4
    items = similar.find_similar(df.withColumn("file_id", F.abs("print") + F.when(F.col("print") < 0, 1).otherwise(0)), "j", 8, bucket_rows)
    groups = {}
    for print64, group in union_find([(a, b) for a, b, _ in want]).items():
        groups.setdefault(group, set()).add(abs(print64) + (print64 < 0))
    found = {}
    for r in items.collect():
        found.setdefault(r.anchor_file_id, set()).add(r.file_id)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_negative_threshold_is_refused(spark):
    with pytest.raises(ValueError):
        similar.similar_pairs(spark.createDataFrame([(1,)], "print long"), -1)


@pytest.mark.parametrize("seed", [1])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    chain = list(range(200, 260))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:]))
    edges += [(1000, 1000 + rng.randrange(1, 80)) for _ in range(100)]
    edges += [(rng.randrange(150), rng.randrange(150)) for _ in range(70)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = union_find(edges)
    for hot_rows in (None, 10):
        assert dict(map(tuple, connected_components(df, hot_rows=hot_rows).collect())) == want


def test_a_long_chain_settles(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long")
    assert connected_components(df).where("component = 0").count() == 301


def dedup_fixture(spark):
    contents = [b"X" * 512, b"X" * 512, b"X" * 500 + b"Y" * 12]
    table = files(spark, *[dict(file_id=i + 1, size_bytes=len(c)) for i, c in enumerate(contents)])
    data = spark.createDataFrame([(i + 1, bytearray(c)) for i, c in enumerate(contents)], "file_id long, content binary")
    return table, fingerprint(data)


def test_exact_and_similar_groups_of_three_files(spark):
    table, hashes = dedup_fixture(spark)
    candidates = exact.exact_candidates(table, hashes, [1])
    groups = exact.exact_groups(candidates, "j")
    (group,) = groups.collect()
    assert (group.file_count, group.total_bytes, group.reclaimable_bytes) == (2, 1024, 512)
    assert rows(exact.exact_group_items(candidates, "j").select("file_id", "is_primary"), "file_id") == [(1, 1), (2, 0)]
    assert tuple(exact.exact_totals(groups).first()) == (1, 512)

    items = similar.find_similar(similar.similar_candidates(table, hashes, [1]), "j", 16)
    got = rows(items.select("file_id", "anchor_file_id", "distance_to_anchor", "is_primary"), "file_id")
    assert [r[:2] for r in got][:2] == [(1, 1), (2, 1)] and got[0][2:] == (0, 1)
    assert similar.similar_groups(items, threshold=16).count() == 1
    for hot in (None, 1):
        rated = scoring.score_groups(items, table, ["job_id", "anchor_file_id"], hot_rows=hot)
        assert check_one_primary(rated, ["job_id", "anchor_file_id"]).count() == 0


def test_other_roots_and_missing_files_take_no_part(spark):
    table = files(spark, dict(file_id=1), dict(file_id=2, root_id=2), dict(file_id=3, is_present=0), dict(file_id=4))
    hashes = spark.createDataFrame([(i, "blake3_full", "s") for i in (1, 2, 3, 4)], "file_id long, hash_type string, hash_hex string")
    assert rows(exact.exact_candidates(table, hashes, [1]).select("file_id"), "file_id") == [(1,), (4,)]
    assert exact.exact_totals(exact.exact_groups(exact.exact_candidates(table, hashes, [2]), "j")).first() == (0, 0)


def test_chained_group_may_exceed_the_threshold(spark):
    prints = [0, 0b1111, 0b11111111, 1 << 63]
    df = spark.createDataFrame([(i + 1, signed(p)) for i, p in enumerate(prints)], "file_id long, print long")
    got = rows(similar.find_similar(df, "j", 4).select("file_id", "anchor_file_id", "distance_to_anchor", "confidence"), "file_id")
    assert got == [(1, 1, 0, 1.0), (2, 1, 4, 0.9375), (3, 1, 8, 0.875), (4, 1, 1, 0.9844)]


def test_confidence_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 0)] + [(d + 2, (1 << d) - 1) for d in range(1, 63)], "file_id long, print long")
    for _, _, d, c in similar.find_similar(df, "j", 1).select("file_id", "anchor_file_id", "distance_to_anchor", "confidence").collect():
        assert c == round(max(0.0, 1 - d / 64), 4)


@pytest.mark.parametrize("hot_rows", [None, 7])
def test_a_third_of_all_files_in_one_group(spark, hot_rows):
    n = 300
    table = files(spark, *[dict(file_id=i, size_bytes=i % 5 + 1, mtime_epoch_ns=1000 - i) for i in range(1, n + 1)])
    sign = lambda i: "hot" if i % 3 == 0 else f"s{i % 50}"
    hashes = spark.createDataFrame([(i, "blake3_full", sign(i)) for i in range(1, n + 1)], "file_id long, hash_type string, hash_hex string")
    items = exact.exact_group_items(exact.exact_candidates(table, hashes), "j", hot_rows=hot_rows)
    by_group = {}
    for i in range(1, n + 1):
        by_group.setdefault(sign(i), []).append(i)
    want = sorted((s, i, int(i == min(g))) for s, g in by_group.items() if len(g) > 1 for i in g)
    assert rows(items.select("signature", "file_id", "is_primary"), "signature", "file_id") == want
    rated = scoring.score_groups(items, table, ["job_id", "signature"], hot_rows=hot_rows)
    assert check_one_primary(rated, ["signature"]).count() == 0
    assert rated.count() == len(want)
    same_size = exact.size_prefilter(table, hot_rows=hot_rows)
    assert same_size.count() == n


def test_scoring_rules(spark):
    table = files(
        spark,
        dict(file_id=1, width=10, height=10, size_bytes=5, mtime_epoch_ns=9),
        dict(file_id=2, width=20, height=10, size_bytes=5, mtime_epoch_ns=9, exif_datetime_original=""),
        dict(file_id=3, size_bytes=7, exif_datetime_original="2020", mtime_epoch_ns=1),
        dict(file_id=4, size_bytes=2, mtime_epoch_ns=5),
        dict(file_id=5, size_bytes=9, mtime_epoch_ns=5),
        dict(file_id=6, size_bytes=9, mtime_epoch_ns=5),
    )
    items = spark.createDataFrame(
        [("j", "a", 1, 1), ("j", "a", 2, 0), ("j", "a", 3, 0), ("j", "a", 4, 0), ("j", "b", 5, 0), ("j", "b", 6, 1)],
        "job_id string, signature string, file_id long, is_primary int",
    )
    got = rows(scoring.score_groups(items, table, ["job_id", "signature"]).drop("job_id"), "file_id")
    assert got == [
        ("a", 1, 0.0, "fallback_lowest_file_id", 0),
        ("a", 2, 5.0, "max_resolution", 0),
        ("a", 3, 6.0, "max_size,has_exif_datetime,earliest_mtime", 1),
        ("a", 4, 0.0, "fallback_lowest_file_id", 0),
        ("b", 5, 4.0, "max_size,earliest_mtime", 1),
        ("b", 6, 4.0, "max_size,earliest_mtime", 0),
    ]


@pytest.mark.parametrize("threshold", [2, 8])
def test_crowded_buckets_are_told_from_the_prints_own_values(spark, threshold):
    rng = random.Random(threshold)
    values = {rng.getrandbits(64) & 0x3F00003F00003F for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    base = spark.createDataFrame([(similar._signed(v),) for v in sorted(values)], "print long")
    rows_ = base.select(F.lit(0).alias("path"), F.lit(0).cast("long").alias("bucket"), "print")
    paths = {0: list(range(64))}
    for level in (0, 1):
        if not paths:
            break
        rules, below = similar._children(paths, threshold)
        rows_ = checkpointed(similar._file_under(rows_, rules, level))
        flip = F.col(f"flip{level}")
        counted = rows_.groupBy("path", "bucket").agg(
            F.count(F.lit(1)).alias("size"), F.min("print").alias("hub"),
            ((F.min(flip) < F.max(flip)) | (F.max(flip) == 0)).alias("meets"),
        )
        for bucket_rows in (1, 20):
            want = sorted(map(tuple, counted.where(F.col("size") > bucket_rows).collect()))
            got = similar._crowded(rows_, rules, level, bucket_rows).select("path", "bucket", "size", "hub", "meets")
            assert sorted(map(tuple, got.collect())) == want and (want or bucket_rows > 1)
        rows_ = rows_.withColumn("parent", F.lit(99).cast("long"))
        paths = {p: free for p, free in below.items() if len(free) > threshold}
        rows_ = rows_.where(F.col("path").isin(list(paths)))
