"""Checks that replace database constraints; each returns the offending rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def check_enums(table: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Rows with a value outside the allowed ones, as (column_name, value, rows)."""
    checks = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(c).cast("string").alias("value"),
                F.col(c).isin(list(values)).alias("ok"),
            )
            for c, values in allowed.items()
        ]
    )
    return (
        table.select(F.inline(checks))
        .where("NOT ok")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def watch_table(table: DataFrame, allowed: dict[str, Sequence[str]], totals: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """The table to write and what is observed while it is written, without a pass of its own.

    The observation has ``rows``, ``bad_<column>`` (rows with a value outside the allowed ones) and
    ``sum_<column>`` of the columns in ``totals``. Write the returned table as it is: metrics of the
    stage that writes count each task once, those of a stage behind a shuffle again when it is repeated.
    """
    seen = Observation()
    # A null is in no list and not outside of it either, as in check_enums.
    bad = [F.count_if(~F.col(c).isin(list(values))).alias(f"bad_{c}") for c, values in allowed.items()]
    sums = [F.sum(c).alias(f"sum_{c}") for c in totals]
    return table.observe(seen, F.count(F.lit(1)).alias("rows"), *bad, *sums), seen


def check_unique(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def check_fk(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Values of a reference that have no parent row, with their number of child rows."""
    used = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    known = parent.select(F.col(parent_column).alias(column))
    return used.join(known, column, "left_anti")


def check_one_primary(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups without exactly one primary."""
    return (
        items.groupBy(*keys)
        .agg(F.sum("is_primary").alias("primaries"), F.count(F.lit(1)).alias("members"))
        .where("primaries <> 1")
    )
