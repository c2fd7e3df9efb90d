"""Free names for files that move into a folder where their name may be taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions import paths as P
from twinsift.operators.skew import HOT_ROWS, attach, hot_keys, rank_within
from twinsift.session import checkpointed


def _numbered_family(path: Column) -> Column:
    """(base, n) readings of ``stem.N.suffix``: the base paths this path is a numbered form of."""
    name, folder = P.file_name(path), P.parent(path)

    def reading(pattern: str, tail: int | None) -> Column:
        rest = F.regexp_extract(name, pattern, tail) if tail else F.lit("")
        base = F.concat(folder, F.regexp_extract(name, pattern, 1), rest)
        n = F.regexp_extract(name, pattern, 2).try_cast("long")
        fits = n.isNotNull() & P.numbered_path(base, n).eqNullSafe(path)
        return F.when(fits, F.struct(base.alias("base"), n.alias("n")))

    inner = reading(r"(?s)^(.+)\.([1-9][0-9]{0,17})(\.[^.]+)$", 3)
    last = reading(r"(?s)^(.+)\.([1-9][0-9]{0,17})$", None)
    own = F.struct(path.alias("base"), F.lit(0).cast("long").alias("n"))
    return F.array_compact(F.array(own, inner, last))


def _free_numbers(askers: DataFrame, blocked: DataFrame, hot_rows: int | None) -> DataFrame:
    """(item_id, free): the r-th item of a base, by id, gets its r-th number from ``start`` on that is not blocked.

    That is its place when the items of askers (base, start, item_id) and the blocked (base, start, n) are
    merged in order of the free numbers below them. Bases are sorted by window; those with ``hot_rows`` or
    more rows are numbered by a range sort instead, so that they are not gathered in one task.
    """
    entries = checkpointed(
        askers.select("base", "start", F.lit(1).alias("wants"), F.col("item_id").alias("number")).unionByName(
            blocked.where("n >= start")
            .select("base", "start", F.lit(0).alias("wants"), (F.col("n") - F.col("start")).alias("number"))
        )
    )
    sizes = entries.groupBy("base").agg(F.count(F.lit(1)).alias("rows"))
    hot = hot_keys(sizes, ["base"], "rows", hot_rows or HOT_ROWS)
    free_below = F.when(F.col("wants") == 1, F.col("rank")).otherwise(F.col("number") - F.col("rank"))
    merged = ["free_below", "wants", "number"]
    usual = entries if hot is None else entries.join(F.broadcast(hot), "base", "left_anti")
    place = F.row_number().over(Window.partitionBy("base").orderBy(*merged)) - 1
    numbered = (
        usual.repartition("base")
        .withColumn("rank", F.row_number().over(Window.partitionBy("base", "wants").orderBy("number")) - 1)
        .withColumn("free_below", free_below)
        .withColumn("place", place)
    )
    if hot is not None:
        crowd = entries.join(F.broadcast(hot), "base", "left_semi")
        ranked = rank_within(crowd, ["base", "wants"], ["number"], ["number"], "rank").withColumn("free_below", free_below)
        numbered = numbered.unionByName(rank_within(ranked, ["base"], merged, ["number"], "place"))
    return numbered.where("wants = 1").select(F.col("number").alias("item_id"), (F.col("start") + F.col("place")).alias("free"))


def _losers(placed: DataFrame, busy: DataFrame, total: int) -> DataFrame:
    """Items whose path a lower item id claims too, or a file has."""
    shared = (
        placed.groupBy("path")
        .agg(F.min("item_id").alias("keeper"), F.count(F.lit(1)).alias("claims"))
        .where("claims > 1")
    )
    moved = placed.where("n > 0").join(busy, "path", "left_semi").select("item_id")
    return checkpointed(
        attach(placed, shared, ["path"], ["item_id"], counts="claims", total=total)
        .where("item_id <> keeper").select("item_id").unionByName(moved).distinct()
    )


def _move_on(placed: DataFrame, losers: DataFrame, taken: DataFrame, total: int, hot_rows: int | None) -> DataFrame:
    """Losers and the later items of their bases, at the next numbers that they can still get.

    In id order the items of a base end at rising numbers. The first loser of a base ends above its present
    number, and neither it nor a later item can have a number that a file has or that an item before the
    first loser holds. So the r-th of them ends at the r-th other number or later, however many it skips.
    """
    lost = placed.join(losers.withColumn("lost", F.lit(1)), "item_id", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    first = checkpointed(
        lost.where("lost = 1").groupBy("base").agg(F.min(F.struct("item_id", "n")).alias("f"))
        .select("base", F.col("f.item_id").alias("first"), (F.col("f.n") + 1).alias("start"))
    )
    sizes = placed.join(first, "base", "left_semi").groupBy("base").agg(F.count(F.lit(1)).alias("items"))
    askers = attach(placed, first.join(sizes, "base"), ["base"], ["item_id"], counts="items", total=total).where("item_id >= first")
    held = placed.select("item_id", F.inline(_numbered_family(F.col("path"))))
    blocked = (
        taken.join(first, "base").select("base", "start", "n")
        .unionByName(held.join(first, "base").where("item_id < first").select("base", "start", "n"))
        .distinct()
    )
    free = _free_numbers(askers, blocked, hot_rows)
    n = F.greatest(F.col("n") + F.col("lost"), F.coalesce("free", "n"))
    return checkpointed(
        lost.join(free, "item_id", "left")
        .withColumn("n", n)
        .select("item_id", "base", "n", P.numbered_path(F.col("base"), F.col("n")).alias("path"))
    )


def next_available_path(plan: DataFrame, existing: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Plan (item_id, target_path, ...) with targets that are free when moved in item order.

    A taken target becomes ``stem.N.suffix`` with the first free N; the r-th item that wants a name
    gets its r-th free number. Items of different names can still meet (``a.1.txt`` wanted by
    ``a.1.txt`` and as the first number of ``a.txt``): the lower item id keeps the path and the
    others of its base jump past all numbers that they cannot get, until nobody shares a path.
    """
    wanted = checkpointed(plan.select("item_id", F.col("target_path").alias("base")))
    total = wanted.count()
    busy = existing.select("path").distinct()
    taken = busy.select(F.inline(_numbered_family(F.col("path"))))
    crowded = checkpointed(
        wanted.groupBy("base").agg(F.count(F.lit(1)).alias("items"))
        .join(busy.select(F.col("path").alias("base"), F.lit(True).alias("exists")), "base", "left")
        .where("items > 1 OR exists")
        .select("base", "items", F.lit(0).cast("long").alias("start"))
    )
    crowd = attach(wanted, crowded, ["base"], ["item_id"], counts="items", total=total)
    numbers = _free_numbers(crowd, taken.join(crowded, "base"), hot_rows)
    n = F.coalesce("free", F.lit(0).cast("long"))
    placed = checkpointed(
        wanted.join(numbers, "item_id", "left")
        .select("item_id", "base", n.alias("n"), P.numbered_path(F.col("base"), n).alias("path"))
    )
    losers = _losers(placed, busy, total)
    while not losers.isEmpty():  # numbers only ever rise, and each base has only so many rivals
        placed = _move_on(placed, losers, taken, total, hot_rows)
        losers = _losers(placed, busy, total)
    final = placed.select("item_id", F.col("path").alias("final_path"))
    return plan.join(final, "item_id").select(
        *[F.col("final_path").alias(c) if c == "target_path" else F.col(c) for c in plan.columns]
    )
