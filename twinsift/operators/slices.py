"""Joins with many rows per key on both sides, cut into bounded pieces where a key is crowded.

Spark splits a crowded key on one side of a join only. Here a key with too many rows is cut into slices
by a hash of the row, on both sides, and every pair of slices is a join key of its own. So no task
meets more than ``slice_rows`` rows of a key with as many others, whatever the key holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.operators.skew import attach
from twinsift.session import checkpointed

# Rows of one key that one side of a task holds.
SLICE_ROWS = 20_000


def _slices(rows: str, slice_rows: int) -> Column:
    return F.ceil(F.col(rows) / F.lit(slice_rows)).cast("int")


def _slice(by: Sequence[str], slices: Column) -> Column:
    return F.pmod(F.xxhash64(*by), slices.cast("long")).cast("int")


def sliced_sides(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_by: Sequence[str], right_by: Sequence[str],
    slice_rows: int = SLICE_ROWS, hot_rows: int | None = None,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of :func:`sliced_join` and the keys, slices among them, on which they meet."""
    keys = list(keys)
    counted = lambda rows, name: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    crowded = checkpointed(
        counted(left, "__left").join(counted(right, "__right"), keys)
        .where((F.col("__left") > slice_rows) | (F.col("__right") > slice_rows))
        .withColumn("__across", _slices("__left", slice_rows))
        .withColumn("__down", _slices("__right", slice_rows))
    )
    if crowded.isEmpty():
        return left, right, keys
    one = F.lit(1)
    across, down = F.coalesce("__across", one), F.coalesce("__down", one)
    extra = ["__left", "__right", "__across", "__down"]
    placed = attach(left, crowded, keys, left_by, how="left", counts="__left", hot_rows=hot_rows)
    placed = (
        placed.withColumn("__i", _slice(left_by, across))
        .withColumn("__j", F.explode(F.sequence(F.lit(0), down - 1)))
        .drop(*extra)
    )
    met = attach(right, crowded, keys, right_by, how="left", counts="__right", hot_rows=hot_rows)
    met = (
        met.withColumn("__j", _slice(right_by, down))
        .withColumn("__i", F.explode(F.sequence(F.lit(0), across - 1)))
        .drop(*extra)
    )
    return placed, met, [*keys, "__i", "__j"]


def sliced_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_by: Sequence[str], right_by: Sequence[str],
    slice_rows: int = SLICE_ROWS, hot_rows: int | None = None,
) -> DataFrame:
    """Inner join in which both sides may have any number of rows per key.

    ``left_by`` and ``right_by`` tell the rows of a key apart. The sides share no column but ``keys``.
    """
    placed, met, on = sliced_sides(left, right, keys, left_by, right_by, slice_rows, hot_rows)
    return placed.join(met, on).drop("__i", "__j")


def class_sizes(rows: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """Per key: ``size``, its ``classes`` (kind, n) and ``work``, the pairs that a triangle join of it
    compares. ``kind`` has few values per key; rows of one kind other than 0 do not meet."""
    per_kind = rows.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    return (
        per_kind.groupBy(*keys)
        .agg(
            F.sum("n").alias("size"),
            F.array_sort(F.collect_list(F.struct(F.col(kind).cast("int").alias("kind"), "n"))).alias("classes"),
            F.sum(F.when(F.col(kind) == 0, F.lit(0.0)).otherwise(n * n)).alias("__idle"),
            F.sum(n).alias("__all"),
        )
        .withColumn("work", (F.col("__all") * F.col("__all") - F.col("__idle")) / 2)
        .drop("__idle", "__all")
    )


def triangle_sides(
    rows: DataFrame, keys: Sequence[str], by: str, kind: str, carried: Sequence[str], slice_rows: int = SLICE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """What :func:`triangle_join` pairs, without pairing it: (rows of one slice each, where all pairs of a
    ``slice`` meet; rows of pairs of slices ``kind_one``, ``one``, ``kind_two``, ``two``, where those of
    ``side`` 0 meet those of ``side`` 1)."""
    dealt = _dealt(rows, keys, by, kind, carried, slice_rows)
    same = F.col("__one") == F.col("__two")
    own = dealt.where(same).select(*keys, F.col("__one.slice").alias("slice"), by, kind, *carried)
    across = dealt.where(~same).select(
        *keys,
        F.col("__one.kind").alias("kind_one"), F.col("__one.slice").alias("one"),
        F.col("__two.kind").alias("kind_two"), F.col("__two.slice").alias("two"),
        (F.col("__own") == F.col("__two")).cast("int").alias("side"), by, kind, *carried,
    )
    return own, across


def _dealt(
    rows: DataFrame, keys: Sequence[str], by: str, kind: str, carried: Sequence[str], slice_rows: int
) -> DataFrame:
    """Each row once for every pair of slices (``__one``, ``__two``) that its own slice is in."""
    count = lambda c: F.ceil(c["n"] / F.lit(slice_rows)).cast("int")
    own = F.element_at(F.filter("classes", lambda c: c["kind"] == F.col(kind)), 1)
    every = F.flatten(
        F.transform(
            "classes",
            lambda c: F.transform(
                F.sequence(F.lit(0), count(c) - 1), lambda s: F.struct(c["kind"].alias("kind"), s.alias("slice"))
            ),
        )
    )
    return (
        rows.withColumn("__own", F.struct(F.col(kind).cast("int").alias("kind"), _slice([by], count(own)).alias("slice")))
        .withColumn(
            "__other",
            F.explode(F.filter(every, lambda o: (o["kind"] == 0) | (o["kind"] != F.col(kind)))),
        )
        .withColumn("__one", F.least("__own", "__other"))
        .withColumn("__two", F.greatest("__own", "__other"))
        .select(*keys, "__own", "__one", "__two", by, kind, *carried)
    )


def triangle_join(
    rows: DataFrame, keys: Sequence[str], by: str, kind: str, carried: Sequence[str], slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """All pairs of rows with the same key that may meet, once: columns of the row with the smaller ``by``
    with suffix ``_a``, of the other with ``_b``.

    ``rows`` has the ``classes`` of its key from :func:`class_sizes`. Slices are of one kind each, and
    slices of one kind other than 0 are not paired with each other, so a key flooded by one kind
    costs its few other rows times that kind, not the square of it.
    """
    keys, carried = list(keys), list(carried)
    dealt = _dealt(rows, keys, by, kind, carried, slice_rows)
    side = lambda which, tag: dealt.where(F.col("__own") == F.col(which)).select(
        *keys, "__one", "__two", *[F.col(c).alias(f"__{c}_{tag}") for c in (by, kind, *carried)]
    )
    met = side("__one", "x").join(side("__two", "y"), [*keys, "__one", "__two"])
    x, y = F.col(f"__{by}_x"), F.col(f"__{by}_y")
    met = met.where((F.col("__one") != F.col("__two")) | (x < y))
    pick = lambda c, first, second: F.when(x < y, F.col(f"__{c}_{first}")).otherwise(F.col(f"__{c}_{second}"))
    return met.select(
        *keys,
        *[pick(c, "x", "y").alias(f"{c}_a") for c in (by, kind, *carried)],
        *[pick(c, "y", "x").alias(f"{c}_b") for c in (by, kind, *carried)],
    )
