"""Components of few edges in one task, of more piece by piece and in rounds."""

import random

import pytest

from tests.test_groups import union_find
from twinsift.operators import components
from twinsift.operators.components import connected_components


def mixed_edges(seed):
    rng = random.Random(seed)
    chain = rng.sample(range(-400, -300), 100)
    edges = list(zip(chain, chain[1:]))
    edges += [(1000, 1000 + rng.randrange(1, 80)) for _ in range(100)]
    edges += [(rng.randrange(150), rng.randrange(150)) for _ in range(70)]
    # Ends of 63 bits, as prints have them, and pairs that come twice or the other way round.
    edges += [(k << 55, (k + 1) << 55) for k in range(-200, 200, 3)]
    edges += [(b, a) for a, b in rng.sample(edges, 40)] + rng.sample(edges, 40)
    return [(a, b) for a, b in edges if a != b]


@pytest.fixture
def written(monkeypatch):
    """What was checkpointed."""
    kept, real = [], components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: kept.append(real(df)) or kept[-1])
    return kept


@pytest.mark.parametrize("shape", ["chain", "mixed"])
def test_few_edges_take_no_rounds(spark, written, shape):
    """Each round costs the driver two plans and their stages, however few the edges."""
    edges = [(i, i + 1) for i in range(300)] if shape == "chain" else mixed_edges(1)
    found = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert dict(map(tuple, found)) == union_find(edges) and len(found) == len(union_find(edges))
    assert len(written) <= 2


@pytest.mark.parametrize("local_edges, hot_rows", [(1, None), (40, 10), (150, None), (300, 10)])
def test_more_edges_than_a_task_takes_are_connected_by_pieces_and_rounds(spark, written, local_edges, hot_rows):
    edges = mixed_edges(local_edges)
    df = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    found = connected_components(df, hot_rows=hot_rows, local_edges=local_edges).collect()
    assert dict(map(tuple, found)) == union_find(edges) and len(found) == len(union_find(edges))
    assert len(written) > 2


def test_no_more_edges_are_held_than_a_task_takes(spark):
    """Each piece gives one star per component it sees, so a chain cut into pieces has as many stars."""
    chain = spark.range(1, 1001, numPartitions=1).selectExpr("id AS u", "id - 1 AS v")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        stars = [tuple(r) for r in components._connected_locally(chain, 1, 200).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert sorted(stars) == [(u, (u - 1) // 200 * 200) for u in range(1, 1001)]


def test_nothing_loops_and_nulls(spark):
    rows = [(1, 1), (None, 2), (3, None), (None, None)]
    assert connected_components(spark.createDataFrame(rows, "src long, dst long")).collect() == []
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
    held = connected_components(spark.createDataFrame([*rows, (5, 4), (4, 5)], "src long, dst long")).collect()
    assert sorted(map(tuple, held)) == [(4, 4), (5, 4)]


def test_ids_that_are_no_whole_numbers_take_rounds(spark):
    edges = [("b", "c"), ("c", "d"), ("d", "a"), ("x", "y")]
    found = connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert dict(map(tuple, found)) == {**dict.fromkeys("abcd", "a"), "x": "x", "y": "x"}
