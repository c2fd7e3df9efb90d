"""Joins and ranks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.session import checkpointed

# A key with at least this many rows is split into slices of about this size.
HOT_ROWS = 2_000_000
# A key also counts as hot only if it holds more than one in so many of all rows. So there are
# never more hot keys than this, and their list is small enough to broadcast at any scale.
MOST_HOT_KEYS = 100_000
# Rows whose keys are not counted yet are first counted by a hash of the key, into so many parts.
COUNT_PARTS = 4096

_SALT = "__salt"
_SLICES = "__slices"
_COUNT = "__rows"


def _limit(total: int, hot_rows: int) -> int:
    return max(hot_rows, -(-total // MOST_HOT_KEYS))


def _above(sized: DataFrame, keys: Sequence[str], count: str, limit: int) -> DataFrame | None:
    found = sized.where(F.col(count) >= limit).select(
        *keys, F.ceil(F.col(count) / F.lit(limit)).cast("int").alias(_SLICES)
    )
    # At most MOST_HOT_KEYS rows; as local rows their size is known to every join planned on them.
    rows = found.collect()
    return sized.sparkSession.createDataFrame(rows, found.schema) if rows else None


def hot_keys(sized: DataFrame, keys: Sequence[str], count: str, hot_rows: int) -> DataFrame | None:
    """All keys with too many rows and into how many slices to cut them; None if there are none.

    Too many is ``hot_rows``, or the MOST_HOT_KEYS-th part of all rows if that is more.
    """
    total, most = sized.agg(F.sum(count), F.max(count)).first()
    limit = _limit(total or 0, hot_rows)
    return None if (most or 0) < limit else _above(sized, keys, count, limit)


def hot_keys_of(rows: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """:func:`hot_keys` of rows that are not counted by key.

    A hot key makes its whole part of the keys hot, so only the keys of such parts are counted one by
    one. Where no part is, nothing but a number per task and part is shuffled.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(COUNT_PARTS))
    parts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias(_COUNT)).collect()
    limit = _limit(sum(p[_COUNT] for p in parts), hot_rows)
    full = [p["__part"] for p in parts if p[_COUNT] >= limit]
    if not full:
        return None
    sized = rows.where(part.isin(full)).groupBy(*keys).agg(F.count(F.lit(1)).alias(_COUNT))
    return _above(sized, keys, _COUNT, limit)


def attach(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    counts: str | None = None,
    hot_rows: int | None = None,
    total: int | None = None,
    like: DataFrame | None = None,
    pinned: bool = False,
) -> DataFrame:
    """Join one-row-per-key values back to rows without sending a hot key to one task.

    ``counts`` names the column of ``per_key`` that holds the rows per key; without it they
    are counted. Rows of a hot key are spread over slices by a hash of ``spread_by`` and the
    value row is repeated once per slice. ``how`` decides as in a join: inner, left, left_semi or
    left_anti.
    ``total`` is the counted number of rows, if known: too few rows cannot hold a hot key.
    ``like`` has as many rows of each key as ``rows``, if those are dearer to count.

    The values are checkpointed, so that they are worked out once and chains of calls keep
    short plans; not again if they are ``pinned``, that is checkpointed already.
    """
    keys = list(keys)
    limit = hot_rows or HOT_ROWS
    if total is not None and total < limit:
        return rows.join(per_key, keys, how)
    per_key = per_key if pinned else checkpointed(per_key)
    hot = hot_keys(per_key, keys, counts, limit) if counts else hot_keys_of(rows if like is None else like, keys, limit)
    if hot is None:
        return rows.join(per_key, keys, how)
    slices = F.coalesce(F.col(_SLICES), F.lit(1))
    spread = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn(_SALT, F.pmod(F.xxhash64(*spread_by), slices.cast("long")).cast("int"))
        .drop(_SLICES)
    )
    repeated = (
        per_key.join(F.broadcast(hot), keys, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop(_SLICES)
    )
    return spread.join(repeated, keys + [_SALT], how).drop(_SALT)


def global_index(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in a total order, without a single-partition window.

    The rows are range-sorted and pinned by a checkpoint; each partition then numbers its own
    rows from the summed sizes of the partitions before it. Only those sizes (one row per
    partition) are broadcast.
    """
    pinned = checkpointed(df.orderBy(*order))
    numbered = pinned.withColumn("__part", F.spark_partition_id()).withColumn(
        "__pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__size"))
        .select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    )
    return numbered.join(F.broadcast(offsets), "__part").select(
        *df.columns, (F.col("__start") + F.col("__pos") + F.lit(start)).alias(name)
    )


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], spread_by: Sequence[str], name: str
) -> DataFrame:
    """0-based position of each row inside its key, balanced even if one key is huge."""
    indexed = global_index(df, list(keys) + list(order), "__index")
    first = indexed.groupBy(*keys).agg(
        F.min("__index").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    placed = attach(indexed, first, keys, spread_by, counts="__n", total=indexed.count())
    return placed.select(*df.columns, (F.col("__index") - F.col("__first")).alias(name))
