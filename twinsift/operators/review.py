"""Review queries over groups, files and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.decisions import GROUP, MEMBER
from twinsift.operators.skew import attach
from twinsift.sources.tables import page as page_of
from twinsift.sources.tables import page_after

SCOPES = ["selected", "selected_groups", "all_in_group", "all_filtered"]

_ORDER = {"exact": "signature", "similar": "anchor_file_id"}


def list_groups(
    groups: DataFrame, kind: str, job_id: str, page: int = 1, page_size: int = 50, after: str | int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(page of group headers in creation order, one-row total).

    ``after`` is the key (signature or anchor file) that the page before ended with, in place of ``page``.
    """
    of_job = groups.where(F.col("job_id") == job_id)
    key = _ORDER[kind]
    found = page_of(of_job, [key], page, page_size) if after is None else page_after(of_job, [key], [after], page_size)
    return found, of_job.agg(F.count(F.lit(1)).alias("total"))


def group_details(items: DataFrame, files: DataFrame, decisions: DataFrame) -> DataFrame:
    """Members with path, size and decision.

    ``items`` are unified items with whatever extra columns their kind has (score, reason,
    distance, confidence); restrict them to one group for the detail page.
    """
    located = items.join(files.select("file_id", "abs_path", "size_bytes"), "file_id")
    decided = decisions.select(*MEMBER, "decision")
    return located.join(decided, MEMBER, "left").select(*items.columns, "abs_path", "size_bytes", "decision")


def non_primary(items: DataFrame) -> DataFrame:
    """Members that may be cleaned up."""
    return items.where(F.col("is_primary") == 0)


def resolve_scope(
    items: DataFrame, scope: str, groups: DataFrame | None = None, file_ids: DataFrame | None = None
) -> DataFrame:
    """Distinct file ids of a selection, ascending.

    ``selected`` takes the given files as they are; the group scopes take the non-primaries of
    the given groups; ``all_filtered`` those of all given items.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of: {', '.join(SCOPES)}")
    if scope == "selected":
        return file_ids.select("file_id").distinct().orderBy("file_id")
    chosen = non_primary(items)
    if scope != "all_filtered":
        chosen = attach(chosen, groups.select(*GROUP).distinct(), GROUP, ["file_id"], how="left_semi")
    return chosen.select("file_id").distinct().orderBy("file_id")
