"""Near copies after a rescan: only what new prints can change is searched and grouped again.

The index of known prints has one row per print and bit block (block, value, print), stored by block
and batch. Two prints within the threshold differ by few bits in some block, so a new print looks up
its own block values and all values that near them; known prints are read as they are stored and never
filed again. A pair counts in the first block that shows it, so it is found once.

Components follow: those that a new print touches grow as one node each, those that lose a print are
searched again among their own members, all others keep their labels.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions.fingerprints import hamming
from twinsift.operators.components import connected_components
from twinsift.operators.near_rows import meetings
from twinsift.operators.similar import similar_links
from twinsift.operators.skew import attach
from twinsift.operators.slices import SLICE_ROWS, sliced_sides
from twinsift.schemas import DEFAULT_THRESHOLD
from twinsift.session import checkpointed
from twinsift.sources.tables import replace_partition

INDEX = "block int, value long, print long"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _blocks(threshold: int) -> list[tuple[int, list[int], int]]:
    """(mask, bits, radius) of each block: a pair within the threshold differs by at most the radius
    of some block in it. Differences of all blocks above their radius would exceed the threshold."""
    count = threshold // 3 + 1
    cuts = [i * 64 // count for i in range(count + 1)]
    budget = threshold - count + 1
    out = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        bits = list(range(a, b))
        out.append((sum(1 << bit for bit in bits), bits, budget // count + (1 if i < budget % count else 0)))
    return out


def file_prints(prints: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Index rows (block, value, print) of prints: one for each block."""
    rows = [
        F.struct(F.lit(i).alias("block"), F.col("print").bitwiseAND(F.lit(_signed(mask))).alias("value"))
        for i, (mask, _, _) in enumerate(_blocks(threshold))
    ]
    return prints.select(F.inline(F.array(*rows)), "print")


def probe_prints(prints: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """(block, value, probe): every block value within the block's radius of a new print's own."""
    changes = [
        (i, _signed(mask), _signed(sum(1 << bit for bit in flipped)))
        for i, (mask, bits, radius) in enumerate(_blocks(threshold))
        for size in range(radius + 1)
        for flipped in combinations(bits, size)
    ]
    # A constant table: its size follows from the threshold alone.
    table = F.from_json(
        F.lit("[" + ",".join(f'{{"block":{i},"mask":{m},"flip":{f}}}' for i, m, f in changes) + "]"),
        "array<struct<block:int,mask:long,flip:long>>",
    )
    told = prints.select(F.col("print").alias("probe"), F.inline(table))
    return told.select("block", F.col("probe").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("value"), "probe")


def _first_block(a: Column, b: Column, threshold: int) -> Column:
    """The first block in which two prints differ by no more than its radius."""
    difference = a.bitwiseXOR(b)
    found = F.lit(None).cast("int")
    for i, (mask, _, radius) in reversed(list(enumerate(_blocks(threshold)))):
        found = F.when(F.bit_count(difference.bitwiseAND(F.lit(_signed(mask)))) <= radius, F.lit(i)).otherwise(found)
    return found


def store_prints(prints: DataFrame, base: str, batch: str, threshold: int = DEFAULT_THRESHOLD) -> None:
    """Add prints to the stored index. A batch that is stored again replaces its own rows."""
    rows = file_prints(prints.select("print").distinct(), threshold).withColumn("batch", F.lit(batch))
    replace_partition(rows, base, "batch", batch)


def stored_prints(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(INDEX + ", batch string").parquet(base).select("block", "value", "print")


def new_prints(index: DataFrame, prints: DataFrame) -> DataFrame:
    """Distinct prints that the index does not hold; one block of the index tells."""
    known = index.where("block = 0").select("print")
    return prints.select("print").distinct().join(known, "print", "left_anti")


def _meet(
    homes: DataFrame, probes: DataFrame, threshold: int, slice_rows: int, hot_rows: int | None
) -> DataFrame:
    """Pairs (print, probe) within the threshold, each in the first block that shows it."""
    homes, probes, on = sliced_sides(homes, probes, ["value", "block"], ["print"], ["probe"], slice_rows, hot_rows)
    sides = homes.select(*on, F.lit(0).alias("side"), "print").unionByName(
        probes.select(*on, F.lit(1).alias("side"), F.col("probe").alias("print"))
    )
    met = meetings(sides, on, "block", threshold)
    a, b = F.col("a"), F.col("b")
    return met.where(F.col("block") == _first_block(a, b, threshold)).select(a.alias("print"), b.alias("probe"))


def delta_pairs(
    index: DataFrame, prints: DataFrame, threshold: int = DEFAULT_THRESHOLD, slice_rows: int = SLICE_ROWS,
    hot_rows: int | None = None,
) -> DataFrame:
    """Pairs (print_a < print_b, distance) within the threshold with at least one print new to the index.

    New prints meet the stored ones and each other; two stored prints never meet.
    """
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    fresh = checkpointed(new_prints(index, prints))
    homes = index.select("block", "value", "print").unionByName(file_prints(fresh, threshold))
    met = _meet(homes, probe_prints(fresh, threshold), threshold, slice_rows, hot_rows).where("print <> probe")
    a, b = F.col("print"), F.col("probe")
    # Two new prints meet twice, each as the probe of the other; the index may hold a print twice.
    return met.select(
        F.least(a, b).alias("print_a"), F.greatest(a, b).alias("print_b"), hamming(a, b).alias("distance")
    ).distinct()


def pairs_after(
    stored_pairs: DataFrame, index: DataFrame, added: DataFrame, removed: DataFrame, threshold: int = DEFAULT_THRESHOLD,
    slice_rows: int = SLICE_ROWS, hot_rows: int | None = None,
) -> DataFrame:
    """All pairs after prints came and went: stored ones whose prints are left, and those of new prints."""
    gone = checkpointed(removed.select("print").distinct())
    live = index.join(gone, "print", "left_anti").select(*index.columns)
    kept = stored_pairs.select("print_a", "print_b", "distance")
    for end in ("print_a", "print_b"):
        kept = kept.join(gone.withColumnRenamed("print", end), end, "left_anti")
    return kept.select("print_a", "print_b", "distance").unionByName(
        delta_pairs(live, added, threshold, slice_rows, hot_rows)
    )


# ---- components that follow


def update_labels(
    labels: DataFrame, index: DataFrame, added: DataFrame, removed: DataFrame, threshold: int = DEFAULT_THRESHOLD,
    slice_rows: int = SLICE_ROWS, hot_rows: int | None = None,
) -> DataFrame:
    """Components (id, component) of near prints after prints were added to and removed from the index.

    ``labels`` are those before, of every print with a near one, and ``index`` holds the prints before.
    A component without a removed print can only grow: in the rounds that follow it is one node, however
    many prints it has. One that lost a print may fall apart, so its other prints are searched again
    among themselves. All other labels stay as they are.
    """
    gone = checkpointed(removed.select("print").distinct())
    hurt = checkpointed(labels.join(gone.withColumnRenamed("print", "id"), "id").select("component").distinct())
    left = (
        labels.join(hurt, "component", "left_semi")
        .select(F.col("id").alias("print"))
        .join(gone, "print", "left_anti")
    )
    again = connected_components(similar_links(left, threshold, hot_rows=hot_rows), hot_rows=hot_rows)
    labels = checkpointed(
        labels.join(hurt, "component", "left_anti").select("id", "component").unionByName(again.select("id", "component"))
    )

    live = index.join(gone, "print", "left_anti").select(*index.columns)
    fresh = checkpointed(new_prints(live, added))
    met = checkpointed(_meet(live, probe_prints(fresh, threshold), threshold, slice_rows, hot_rows))
    # A stored print stands for its component; one link of a new print to a component is enough.
    held = met.groupBy("print").agg(F.count(F.lit(1)).alias("held"))
    named = held.join(labels.withColumnRenamed("id", "print"), "print", "left").select(
        "print", "held", F.coalesce("component", "print").alias("node")
    )
    to_old = attach(met, named, ["print"], ["probe"], counts="held", hot_rows=hot_rows).select(
        F.col("probe").alias("src"), F.col("node").alias("dst")
    )
    edges = to_old.distinct().unionByName(similar_links(fresh, threshold, hot_rows=hot_rows))
    merged = checkpointed(connected_components(edges, hot_rows=hot_rows).withColumnRenamed("component", "whole"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("held"))
    moved = merged.withColumnRenamed("id", "component").join(sizes, "component")
    grown = attach(labels, moved, ["component"], ["id"], how="left", counts="held", hot_rows=hot_rows)
    joined = merged.join(labels.select("id"), "id", "left_anti").select("id", F.col("whole").alias("component"))
    return checkpointed(
        grown.select("id", F.coalesce("whole", "component").alias("component")).unionByName(joined)
    )
