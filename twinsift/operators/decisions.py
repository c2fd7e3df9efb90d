"""Manual decisions on group members.

Decisions are keyed by natural keys (group_kind, job_id, group_key, file_id), so they stay
attached when the groups of a job are rebuilt. ``seq`` orders decisions in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.operators.skew import attach
from twinsift.schemas import DECISIONS, GROUP_KINDS

GROUP = ["group_kind", "job_id", "group_key"]
MEMBER = GROUP + ["file_id"]


def unified_items(exact_items: DataFrame | None, similar_items: DataFrame | None) -> DataFrame:
    """Items of both kinds under one key: group_kind, job_id, group_key, file_id, is_primary."""
    parts = []
    if exact_items is not None:
        parts.append(
            exact_items.select(
                F.lit("exact").alias("group_kind"), "job_id", F.col("signature").alias("group_key"),
                "file_id", "is_primary",
            )
        )
    if similar_items is not None:
        parts.append(
            similar_items.select(
                F.lit("similar").alias("group_kind"), "job_id",
                F.col("anchor_file_id").cast("string").alias("group_key"), "file_id", "is_primary",
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def validate_decisions(decisions: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``error``): kind and value must be known, the file a member."""
    member = items.select(*MEMBER).distinct().withColumn("is_member", F.lit(True))
    error = (
        F.when(~F.col("group_kind").isin(GROUP_KINDS), "group_kind must be 'exact' or 'similar'")
        .when(~F.col("decision").isin(DECISIONS), "unknown decision")
        .when(
            F.col("is_member").isNull(),
            F.format_string(
                "group item not found: kind=%s group_id=%s file_id=%d", "group_kind", "group_key", "file_id"
            ),
        )
    )
    checked = decisions.join(member, MEMBER, "left").select(*decisions.columns, error.alias("error"))
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def upsert_decisions(current: DataFrame, new: DataFrame) -> DataFrame:
    """Last write per member wins; decision and note are replaced together."""
    both = current.unionByName(new)
    return (
        both.groupBy(*MEMBER)
        .agg(F.max(F.struct("seq", "decision", "note")).alias("last"))
        .select(*MEMBER, "last.decision", "last.note", "last.seq")
    )


def apply_keep(items: DataFrame, decisions: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """The newest ``keep`` of a group's member becomes its only primary; other decisions, and keeps
    of files that are not in the group, move nothing.

    ``items`` are unified items; ``decisions`` is the full history, not only the last write
    per member, because an older keep of another member still moved the primary.
    """
    keeps = decisions.where(F.col("decision") == "keep").select(*GROUP, "file_id", "seq")
    chosen = (
        keeps.join(items.select(*GROUP, "file_id").distinct(), [*GROUP, "file_id"], "left_semi")
        .groupBy(*GROUP)
        .agg(F.max_by("file_id", "seq").alias("kept_id"))
    )
    joined = attach(items, chosen, GROUP, ["file_id"], how="left", hot_rows=hot_rows)
    moved = F.when(F.col("kept_id").isNull(), F.col("is_primary")).otherwise(
        (F.col("file_id") == F.col("kept_id")).cast("int")
    )
    return joined.select(*[moved.alias(c) if c == "is_primary" else F.col(c) for c in items.columns])


def bulk_decision(
    items: DataFrame, decision: str, group_keys: DataFrame | None = None, file_ids: DataFrame | None = None,
    start_seq: int = 0, note: Column | None = None,
) -> DataFrame:
    """One decision for the given files of their groups, or for every non-primary of groups.

    ``group_keys`` (group_kind, job_id, group_key) selects groups, ``file_ids`` files. The
    decisions count as made one after another in ascending file id.
    """
    if decision not in DECISIONS:
        raise ValueError(f"decision must be one of: {', '.join(DECISIONS)}")
    chosen = items
    if group_keys is not None:
        chosen = attach(items, group_keys.select(*GROUP).distinct(), GROUP, ["file_id"], how="left_semi")
    if file_ids is not None:
        chosen = chosen.join(file_ids.select("file_id").distinct(), "file_id", "left_semi")
    else:
        chosen = chosen.where(F.col("is_primary") == 0)
    return chosen.select(
        *MEMBER,
        F.lit(decision).alias("decision"),
        (F.lit(None) if note is None else note).cast("string").alias("note"),
        (F.col("file_id") + F.lit(start_seq)).alias("seq"),
    )


def decisions_for_group(decisions: DataFrame, kind: str, group_key: str) -> DataFrame:
    return decisions.where((F.col("group_kind") == kind) & (F.col("group_key") == group_key)).orderBy("file_id")
