"""Scan roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.paths import canonical_root, root_error
from twinsift.operators.skew import attach


def register_roots(requests: DataFrame, roots: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Outcome of registering paths (seq, path): created, conflict or invalid with the reason.

    Invalid paths have no canonical form and take no part in the joins.
    """
    clean = requests.select(
        "seq", canonical_root(F.col("path")).alias("canonical"), root_error(F.col("path")).alias("error")
    )
    valid = clean.where("canonical IS NOT NULL")
    first = valid.groupBy("canonical").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("asked"))
    known = roots.select(F.col("path").alias("canonical"), F.lit(True).alias("known"))
    judged = attach(valid, first.join(known, "canonical", "left"), ["canonical"], ["seq"], counts="asked", hot_rows=hot_rows)
    conflict = F.coalesce("known", F.lit(False)) | (F.col("seq") != F.col("first_seq"))
    outcome = F.when(conflict, "conflict").otherwise("created")
    refused = clean.where("canonical IS NULL").select("seq", "canonical", F.lit("invalid").alias("outcome"), "error")
    return judged.select("seq", "canonical", outcome.alias("outcome"), "error").unionByName(refused)


def set_enabled(roots: DataFrame, updates: DataFrame) -> DataFrame:
    """Roots with the enabled flag of (root_id, enabled) applied."""
    new = updates.select("root_id", F.col("enabled").cast("int").alias("new_enabled"))
    return roots.join(new, "root_id", "left").select(
        *[F.coalesce("new_enabled", "enabled").alias(c) if c == "enabled" else F.col(c) for c in roots.columns]
    )


def resolve_roots(requests: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots of each request (request_id, root_ids): sorted distinct, or why it is refused.

    A request without roots gets all enabled ones, after the join: that array is never shuffled with the
    requests. The arrays hold at most one entry per root.
    """
    all_enabled = roots.where(F.col("enabled") == 1).agg(F.sort_array(F.collect_list("root_id"))).scalar()
    asked = requests.select("request_id", F.explode(F.array_distinct("root_ids")).alias("root_id"))
    found = asked.join(roots.select("root_id", "enabled"), "root_id", "left").groupBy("request_id").agg(
        F.sort_array(F.collect_list("root_id")).alias("chosen"),
        F.count_if(F.col("enabled").isNull()).alias("unknown"),
        F.count_if(F.col("enabled") != 1).alias("disabled"),
    )
    chosen = F.coalesce(F.col("chosen"), all_enabled)
    error = (
        F.when(F.col("unknown") > 0, "one or more scan roots were not found")
        .when(F.col("disabled") > 0, "disabled scan root selected")
        .when(F.size(chosen) == 0, "no scan roots selected")
    )
    return (
        requests.select("request_id").join(found, "request_id", "left")
        .select("request_id", F.when(error.isNull(), chosen).alias("root_ids"), error.alias("error"))
    )


def roots_in_use(roots: DataFrame, job_roots: DataFrame, files: DataFrame) -> DataFrame:
    """Roots that cannot be deleted because a job or a file refers to them."""
    used = job_roots.select("root_id").unionByName(files.select("root_id")).distinct()
    return roots.join(used, "root_id", "left_semi")


def first_root_of_job(job_roots: DataFrame, roots: DataFrame) -> DataFrame:
    """Lowest root of each job and how many roots it has."""
    firsts = job_roots.groupBy("job_id").agg(
        F.min("root_id").alias("root_id"), F.count(F.lit(1)).alias("roots_count")
    )
    return firsts.join(roots.select("root_id", "path"), "root_id").select("job_id", "root_id", "path", "roots_count")
