"""Comparison of rows that share a key, apart from the search that deals them."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from twinsift.operators import near_rows
from twinsift.operators.similar import _search


def near(a, b):
    return (a ^ b).bit_count() <= 3


@pytest.mark.parametrize("size", [30, 300])
def test_pairs_of_a_key_are_all_found_however_large_it_is(spark, size):
    rng = random.Random(size)
    keys = {k: rng.sample(range(1 << 12), size if k else 3) for k in range(4)}
    held = spark.createDataFrame([(k, v, 0) for k, vs in keys.items() for v in vs], "k int, print long, flip int")
    want = sorted((a, b) for vs in keys.values() for a in vs for b in vs if a < b and near(a, b))
    assert rows(near_rows.pairs_within(held, ["k"], ["flip"], 3, False), "a", "b") == want
    sides = held.withColumn("side", (F.col("print") % 5 == 0).cast("int"))
    unlike = sorted((k, a, b) for k, vs in keys.items() for a in vs for b in vs if a % 5 and b % 5 == 0 and near(a, b))
    assert rows(near_rows.meetings(sides, ["k"], "k", 3).select("k", "a", "b"), "k", "a", "b") == unlike
    assert rows(near_rows.pairs_across(sides, ["k"], 3), "a", "b") == sorted((min(p), max(p)) for _, *p in unlike)


def test_a_search_compares_prints_in_arrays_not_in_a_join(spark):
    """A join took 8 million comparisons a second and core, four for each pair of a bucket."""
    prints = spark.createDataFrame([(v,) for v in range(0, 3000, 7)], "print long")
    plan = _search(prints, 8, True, 20_000)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
