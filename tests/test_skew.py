import random

from pyspark.sql import functions as F

from tests.helpers import rows
from twinsift.operators import skew
from twinsift.operators.skew import attach, global_index, hot_keys, rank_within


def skewed(spark, n=600):
    rng = random.Random(1)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, id long")


def test_attach_with_a_hot_key_equals_a_plain_join(spark):
    data, df = skewed(spark)
    per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    plain = rows(df.join(per_key, "k").select("k", "id", "n", "first"), "id")
    for counts in ("n", None):
        got = attach(df, per_key, ["k"], ["id"], counts=counts, hot_rows=10)
        assert rows(got.select("k", "id", "n", "first"), "id") == plain


def test_left_attach_keeps_rows_without_a_value(spark):
    data, df = skewed(spark)
    per_key = df.where("k = 'hot'").groupBy("k").agg(F.max("id").alias("last"))
    got = attach(df, per_key, ["k"], ["id"], how="left", hot_rows=10)
    assert got.count() == len(data)
    assert got.where("last IS NOT NULL").count() == sum(k == "hot" for k, _ in data)


def test_a_hot_key_is_spread_over_partitions(spark):
    _, df = skewed(spark, 3000)
    per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = attach(df, per_key, ["k"], ["id"], counts="n", hot_rows=20).where("k = 'hot'")
        used = got.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert used == 4


def test_global_index_is_dense_and_ordered(spark):
    data, df = skewed(spark)
    got = rows(global_index(df.repartition(7), ["k", "id"], "i", start=5), "i")
    assert [r[:2] for r in got] == sorted(data)
    assert [r[2] for r in got] == list(range(5, 5 + len(data)))


def test_global_index_of_nothing(spark):
    _, df = skewed(spark)
    assert global_index(df.where("false"), ["id"], "i").count() == 0


def test_rank_within(spark):
    data, df = skewed(spark)
    got = {(k, i): r for k, i, r in rank_within(df, ["k"], ["id"], ["id"], "r").collect()}
    for key in {k for k, _ in data}:
        members = sorted(i for k, i in data if k == key)
        assert [got[key, i] for i in members] == list(range(len(members)))


def test_every_key_above_the_limit_is_split(spark):
    df = spark.range(2500 * 4).select((F.col("id") % 2500).alias("k"), "id")
    sized = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(sized, ["k"], "n", 2)
    assert hot.count() == 2500
    assert hot.where("__slices <> 2").count() == 0
    got = attach(df, sized, ["k"], ["id"], counts="n", hot_rows=2)
    assert rows(got.select("k", "id", "n"), "id") == rows(df.join(sized, "k").select("k", "id", "n"), "id")


def test_the_list_of_hot_keys_is_bounded_by_the_limit_it_implies(spark, monkeypatch):
    monkeypatch.setattr("twinsift.operators.skew.MOST_HOT_KEYS", 3)
    data, df = skewed(spark)
    sized = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert [r.k for r in hot_keys(sized, ["k"], "n", 2).collect()] == ["hot"]


def test_semi_and_anti_joins_spread_hot_keys(spark):
    rows_ = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    keys = spark.createDataFrame([(0,), (2,)], "k long")
    kept = attach(rows_, keys, ["k"], ["v"], how="left_semi", hot_rows=100)
    gone = attach(rows_, keys, ["k"], ["v"], how="left_anti", hot_rows=100)
    assert kept.columns == gone.columns == ["k", "v"]
    assert (kept.count(), gone.count()) == (2000, 1000)
    assert kept.select("k").distinct().count() == 2 and gone.select("v").distinct().count() == 1000


def test_hot_keys_are_found_without_counting_every_key(spark, monkeypatch):
    """Keys are counted one by one only in parts of the keys that a hot key can be in."""
    data = [("hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}", i) for i in range(900)]
    df = spark.createDataFrame(data, "k string, id long")
    counted = []
    above = skew._above
    monkeypatch.setattr(skew, "_above", lambda sized, *rest: counted.append(sized.count()) or above(sized, *rest))
    found = skew.hot_keys_of(df, ["k"], 200)
    assert sorted(map(tuple, found.collect()), key=str) == [("hot", 2), (None, 2)]
    assert 2 <= counted.pop() < 50
    assert skew.hot_keys_of(df, ["k"], 400) is None and not counted


def test_pinned_values_are_not_written_again(spark, monkeypatch):
    written = []
    monkeypatch.setattr(skew, "checkpointed", lambda df: written.append(df) or df)
    _, df = skewed(spark)
    keys = spark.createDataFrame([("hot",)], "k string")
    got = attach(df, keys, ["k"], ["id"], how="left_anti", hot_rows=10, like=df.select("k"), pinned=True)
    assert got.count() == df.where("k <> 'hot'").count() and not written
