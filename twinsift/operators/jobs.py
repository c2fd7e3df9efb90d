"""Catalog of scan jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.text import idempotent_job_id, is_stale
from twinsift.operators.skew import attach, global_index
from twinsift.schemas import ACTIVE_JOB_STATUSES, DEFAULT_JOB_TIMEOUT_SECONDS
from twinsift.session import checkpointed
from twinsift.sources.tables import page as page_of
from twinsift.sources.tables import page_after

METRICS = ["files_seen", "files_indexed", "exact_groups_found", "similar_groups_found", "reclaimable_bytes"]
RUNTIME = ["status", "started_at", "finished_at", "error_message", *METRICS]


def _direction(order: str) -> list[Column]:
    if order not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    return [F.col(c).desc() if order == "desc" else F.col(c).asc() for c in ("requested_at", "job_id")]


def filter_jobs(jobs: DataFrame, status: str | None = None, mode: str | None = None) -> DataFrame:
    if status is not None:
        jobs = jobs.where(F.col("status") == status)
    return jobs if mode is None else jobs.where(F.col("mode") == mode)


def list_jobs(
    jobs: DataFrame, status: str | None = None, mode: str | None = None, order: str = "desc",
    page: int = 1, page_size: int = 50, after: tuple | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(page of matching jobs, one-row total).

    ``after`` is the (requested_at, job_id) that the page before ended with; it takes the place of
    ``page`` and costs the same however deep the page is.
    """
    matching = filter_jobs(jobs, status, mode)
    ordered = _direction(order)
    if after is None:
        found = page_of(matching, ordered, page, page_size)
    else:
        found = page_after(matching, ["requested_at", "job_id"], after, page_size, descending=order == "desc")
    return found, matching.agg(F.count(F.lit(1)).alias("total"))


def recent_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest jobs; equal times are ordered by id to keep the result stable."""
    return jobs.orderBy(*_direction("desc")).limit(limit)


def latest_processed(jobs: DataFrame) -> DataFrame:
    """Newest job that is neither queued nor running, whatever its outcome."""
    return recent_jobs(jobs.where(~F.col("status").isin(ACTIVE_JOB_STATUSES)), 1)


def job_status(jobs: DataFrame, job_roots: DataFrame, roots: DataFrame) -> DataFrame:
    """Jobs with their roots as an array ordered by id (at most one entry per scan root)."""
    entry = F.struct(F.col("root_id").alias("id"), "path", (F.col("enabled") == 1).alias("enabled"))
    listed = (
        job_roots.join(roots.select("root_id", "path", "enabled"), "root_id")
        .groupBy("job_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("roots"))
    )
    empty = F.array().cast("array<struct<id:bigint,path:string,enabled:boolean>>")
    return jobs.join(listed, "job_id", "left").withColumn("roots", F.coalesce("roots", empty))


def delete_dependencies(
    jobs: DataFrame, exact_groups: DataFrame, similar_groups: DataFrame, action_items: DataFrame, files: DataFrame
) -> DataFrame:
    """What still refers to each job: groups, and action items on files it saw first or last."""
    groups = lambda df, name: df.groupBy("job_id").agg(F.count(F.lit(1)).alias(name))
    per_file = action_items.groupBy("file_id").agg(F.count(F.lit(1)).alias("items"))
    seen_by = F.array_distinct(F.array("first_seen_job_id", "last_seen_job_id"))
    per_job = (
        files.select("file_id", F.explode(seen_by).alias("job_id"))
        .where("job_id IS NOT NULL")
        .join(per_file, "file_id")
        .groupBy("job_id")
        .agg(F.sum("items").alias("action_items"))
    )
    joined = (
        jobs.select("job_id")
        .join(groups(exact_groups, "exact_groups"), "job_id", "left")
        .join(groups(similar_groups, "similar_groups"), "job_id", "left")
        .join(per_job, "job_id", "left")
    )
    counts = ["exact_groups", "similar_groups", "action_items"]
    return joined.select("job_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def deletable(
    jobs: DataFrame, dependencies: DataFrame, now: Column, allow_stale: bool = False,
    timeout_seconds: int = DEFAULT_JOB_TIMEOUT_SECONDS,
) -> DataFrame:
    """Verdict per job: active, not_stale, blocked or ok."""
    active = F.col("status").isin(ACTIVE_JOB_STATUSES)
    stale = is_stale(F.coalesce("started_at", "requested_at"), now, timeout_seconds)
    blockers = F.col("exact_groups") + F.col("similar_groups") + F.col("action_items")
    verdict = (
        F.when(active & F.lit(not allow_stale), "active")
        .when(active & ~stale, "not_stale")
        .when(F.coalesce(blockers, F.lit(0)) > 0, "blocked")
        .otherwise("ok")
    )
    return jobs.join(dependencies, "job_id", "left").select("job_id", "status", verdict.alias("verdict"))


def delete_jobs(
    doomed: DataFrame, jobs: DataFrame, job_roots: DataFrame, files: DataFrame,
    exact_groups: DataFrame, similar_groups: DataFrame,
    exact_items: DataFrame | None = None, similar_items: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tables after deleting jobs (job_id): their rows go, files forget having been seen by them.

    Group items, where given, go with their groups. One job may own most groups or have seen
    all files last, so its rows are spread.
    """
    ids = checkpointed(doomed.select("job_id").distinct())

    def without(df: DataFrame) -> DataFrame:
        return attach(df, ids, ["job_id"], df.columns, how="left_anti", pinned=True).select(*df.columns)

    def forget(df: DataFrame, column: str) -> DataFrame:
        gone = ids.select(F.col("job_id").alias(column), F.lit(True).alias("__gone"))
        kept = F.when(F.col("__gone").isNull(), F.col(column))
        # Forgetting the one job keeps all rows and the other job of each.
        return attach(df, gone, [column], ["file_id"], how="left", like=files, pinned=True).select(
            *[kept.alias(c) if c == column else F.col(c) for c in files.columns]
        )

    items = {"exact_items": exact_items, "similar_items": similar_items}
    return {
        **{name: without(df) for name, df in items.items() if df is not None},
        "jobs": without(jobs),
        "job_roots": without(job_roots),
        "files": forget(forget(files, "first_seen_job_id"), "last_seen_job_id"),
        "exact_groups": without(exact_groups),
        "similar_groups": without(similar_groups),
    }


def merge_metrics(jobs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Jobs with new totals; a null total keeps the old one."""
    named = metrics.select("job_id", *[F.col(c).alias(f"new_{c}") for c in METRICS if c in metrics.columns])
    merged = jobs.join(named, "job_id", "left")
    value = lambda c: F.coalesce(f"new_{c}", c).alias(c) if f"new_{c}" in named.columns else F.col(c)
    return merged.select(*[value(c) for c in jobs.columns])


def update_status(
    jobs: DataFrame, updates: DataFrame, now: Column
) -> DataFrame:
    """Apply (job_id, status, error_message, started, finished): a null message keeps the old one."""
    new = updates.select(
        "job_id", F.col("status").alias("new_status"), F.col("error_message").alias("new_error"), "started", "finished"
    )
    changed = {
        "status": F.coalesce("new_status", "status"),
        "error_message": F.coalesce("new_error", "error_message"),
        "started_at": F.when(F.col("started"), now).otherwise(F.col("started_at")),
        "finished_at": F.when(F.col("finished"), now).otherwise(F.col("finished_at")),
    }
    return jobs.join(new, "job_id", "left").select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in jobs.columns]
    )


def submit_requests(
    requests: DataFrame, jobs: DataFrame, job_roots: DataFrame, submission: str = "", hot_rows: int | None = None
) -> DataFrame:
    """Outcome of job requests (seq, request_key, mode, root_ids sorted): new, existing, conflict.

    The first request with a key owns the job id; later ones must ask for the same. A request with
    a null or empty key is one of its own: its id comes from ``submission`` and its seq, so that a
    retry of the same submission repeats it. Requests that share a key are spread over tasks.
    """
    own = F.concat(F.lit(f"\0{submission}\0"), F.col("seq").cast("string"))
    asked = requests.withColumn("job_id", idempotent_job_id(F.coalesce(F.nullif("request_key", F.lit("")), own)))
    stored = jobs.select("job_id", F.col("mode").alias("old_mode")).join(
        job_roots.groupBy("job_id").agg(F.sort_array(F.collect_list("root_id")).alias("old_roots")), "job_id", "left"
    )
    stored = stored.withColumn("old_roots", F.coalesce("old_roots", F.array().cast("array<bigint>")))
    first = asked.groupBy("job_id").agg(
        F.min(F.struct("seq", "mode", "root_ids")).alias("first"), F.count(F.lit(1)).alias("asked")
    )
    owner = first.join(stored, "job_id", "left").select(
        "job_id",
        "asked",
        F.when(F.col("old_mode").isNull(), F.col("first.seq")).alias("owner_seq"),
        F.coalesce("old_mode", "first.mode").alias("owner_mode"),
        F.coalesce("old_roots", "first.root_ids").alias("owner_roots"),
    )
    same = (F.col("mode") == F.col("owner_mode")) & (F.col("root_ids") == F.col("owner_roots"))
    outcome = (
        F.when(F.col("seq").eqNullSafe(F.col("owner_seq")), "new").when(same, "existing").otherwise("conflict")
    )
    judged = attach(asked, owner, ["job_id"], ["seq"], counts="asked", hot_rows=hot_rows)
    return judged.select("seq", "request_key", "job_id", outcome.alias("outcome"))


def display_names(jobs: DataFrame) -> DataFrame:
    """Title of each job by its place among all jobs: ``SCAN-<MODE>-<0001>``.

    Oldest is 1; counting down from the total in a newest-first list gives the same number.
    """
    numbered = global_index(jobs.select("job_id", "mode", "requested_at"), _direction("asc"), "sequence", start=1)
    return numbered.select("job_id", "sequence", job_title(F.col("mode"), F.col("job_id"), F.col("sequence")).alias("title"))


def job_title(mode: Column, job_id: Column, sequence: Column) -> Column:
    """Without a sequence the first 8 characters of the id are shown."""
    number = sequence.cast("string")
    padded = F.when(F.length(number) >= 4, number).otherwise(F.lpad(number, 4, "0"))
    token = F.coalesce(padded, F.upper(F.substring(job_id, 1, 8)))
    return F.concat(F.lit("SCAN-"), F.upper(F.coalesce(F.nullif(mode, F.lit("")), F.lit("unknown"))), F.lit("-"), token)


def has_active(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.coalesce(F.bool_or(F.col("status").isin(ACTIVE_JOB_STATUSES)), F.lit(False)).alias("has_active")
    )


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` whose runtime fields differ from the same job in ``old``."""
    before = old.select("job_id", *[F.col(c).alias(f"old_{c}") for c in RUNTIME])
    differs = F.lit(False)
    for c in RUNTIME:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return new.join(before, "job_id").where(differs).select(*new.columns)
