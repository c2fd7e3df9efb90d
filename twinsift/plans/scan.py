"""The whole scan job: listing to scored groups and job totals."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.operators import exact, index, jobs, scoring, similar
from twinsift.schemas import CONTENT_HASH, DEFAULT_THRESHOLD, FILE_HASHES, FILES
from twinsift.session import checkpointed
from twinsift.sources.listing import fingerprint_changed, list_files, path_attributes
from twinsift.sources.tables import delete_job_groups, partition_folder, replace_job_groups, replace_partition

GROUP_TABLES = ("exact_groups", "exact_items", "similar_groups", "similar_items")


@dataclass(frozen=True)
class ScanResult:
    job_id: str
    files: DataFrame
    file_hashes: DataFrame
    exact_groups: DataFrame
    exact_items: DataFrame
    similar_groups: DataFrame
    similar_items: DataFrame
    metrics: DataFrame


def job_metrics(scan_totals: DataFrame, exact_groups: DataFrame, similar_groups: DataFrame, job_id: str) -> DataFrame:
    """One row of job totals; reclaimable bytes come from exact groups only."""
    zero = F.lit(0).cast("long")
    parts = scan_totals.select(
        "files_seen", "files_indexed", zero.alias("exact_groups_found"),
        zero.alias("similar_groups_found"), zero.alias("reclaimable_bytes"),
    ).unionByName(
        exact_groups.agg(
            F.count(F.lit(1)).alias("exact_groups_found"),
            F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).cast("long").alias("reclaimable_bytes"),
        ).select(
            zero.alias("files_seen"), zero.alias("files_indexed"), "exact_groups_found",
            zero.alias("similar_groups_found"), "reclaimable_bytes",
        )
    ).unionByName(
        similar_groups.agg(F.count(F.lit(1)).alias("similar_groups_found")).select(
            zero.alias("files_seen"), zero.alias("files_indexed"), zero.alias("exact_groups_found"),
            "similar_groups_found", zero.alias("reclaimable_bytes"),
        )
    )
    return parts.agg(*[F.sum(c).alias(c) for c in jobs.METRICS]).select(F.lit(job_id).alias("job_id"), *jobs.METRICS)


def scan(
    listing: DataFrame,
    files: DataFrame,
    file_hashes: DataFrame,
    root_ids: Iterable[int],
    job_id: str,
    mode: str = "both",
    threshold: int = DEFAULT_THRESHOLD,
    now: Column | None = None,
    read_prints: Callable[[DataFrame], DataFrame] = fingerprint_changed,
    skip_unique_sizes: bool = False,
) -> ScanResult:
    """Index a listing and rebuild the job's groups.

    ``read_prints`` gets the due files (file_id, abs_path, size_bytes, changed, needs_digest)
    and returns their hash rows. Unchanged files keep the prints of earlier jobs and take part
    in grouping. With ``skip_unique_sizes`` a file is read in full only once another present
    file has its size: the groups are the same, the other files have no content hash.
    """
    root_ids = [int(r) for r in root_ids]
    owned = index.resolve_overlapping_roots(listing)
    refreshed = index.refresh_index(files, path_attributes(owned), root_ids, job_id, now)
    after = refreshed.drop("changed")
    due = refreshed.select("file_id", "abs_path", "size_bytes", "changed", F.lit(True).alias("needs_digest"))
    if skip_unique_sizes:
        due = checkpointed(_due_by_size(refreshed, file_hashes))
    due = due.where("changed")
    kept = file_hashes.join(due.select("file_id"), "file_id", "left_anti")
    # The kept hashes are those of other files, so the prints are read once and only added.
    hashes = checkpointed(kept.unionByName(read_prints(due)))
    changes = refreshed.where(F.col("last_seen_job_id") == job_id).select("changed")
    totals = index.scan_metrics(listing, changes)

    exact_candidates = exact.exact_candidates(after, hashes, root_ids)
    similar_candidates = similar.similar_candidates(after, hashes, root_ids)
    if mode not in ("exact", "both"):
        exact_candidates = exact_candidates.where("false")
    if mode in ("similar", "both"):
        similar_items = similar.find_similar(similar_candidates, job_id, threshold)
    else:
        no_components = listing.sparkSession.createDataFrame([], "id long, component long")
        similar_items = similar.similar_group_items(similar_candidates.where("false"), no_components, job_id)
    exact_items = checkpointed(
        scoring.score_groups(exact.exact_group_items(exact_candidates, job_id), after, ["job_id", "signature"])
    )
    similar_items = checkpointed(scoring.score_groups(similar_items, after, ["job_id", "anchor_file_id"]))
    exact_groups = exact.exact_groups(exact_candidates, job_id)
    similar_groups = similar.similar_groups(similar_items, threshold=threshold)
    return ScanResult(
        job_id, after, hashes, exact_groups, exact_items, similar_groups, similar_items,
        job_metrics(totals, exact_groups, similar_groups, job_id),
    )


def _due_by_size(refreshed: DataFrame, file_hashes: DataFrame) -> DataFrame:
    """Files to read: changed ones, and those whose size is no longer unique but were not digested."""
    present = refreshed.where("is_present = 1").select("file_id", "abs_path", "size_bytes", "changed")
    shared = exact.size_prefilter(present).select("file_id", F.lit(True).alias("shared"))
    digested = file_hashes.where(F.col("hash_type") == CONTENT_HASH).select("file_id", F.lit(True).alias("digested"))
    needs = F.col("shared").isNotNull() & (F.col("changed") | F.col("digested").isNull())
    return (
        present.join(shared, "file_id", "left")
        .join(digested, "file_id", "left")
        .select(
            "file_id", "abs_path", "size_bytes", (F.col("changed") | needs).alias("changed"), needs.alias("needs_digest")
        )
    )


def scan_roots(roots: DataFrame, files: DataFrame, file_hashes: DataFrame, job_id: str, **options) -> ScanResult:
    """Scan real folders (root_id, path) that every executor can read."""
    root_ids = [row.root_id for row in roots.select("root_id").collect()]
    return scan(list_files(roots), files, file_hashes, root_ids, job_id, **options)


def save_scan(result: ScanResult, base: str) -> None:
    """Store a scan in the partitions of its job.

    Nothing of another job is touched: the index of the last completed job stays as it is, and this
    one counts once the job table says that the job is completed. A repeated job replaces its own
    partitions, so its input must be the index of an earlier job.
    """
    for name in GROUP_TABLES:
        replace_job_groups(getattr(result, name), f"{base}/{name}", result.job_id)
    replace_partition(result.file_hashes, f"{base}/file_hashes", "job_id", result.job_id)
    replace_partition(result.files, f"{base}/files", "job_id", result.job_id)


def load_index(spark: SparkSession, base: str, job_id: str) -> tuple[DataFrame, DataFrame]:
    """Files and hashes as a completed job left them."""
    stored = lambda name, schema: spark.read.schema(schema).parquet(partition_folder(f"{base}/{name}", "job_id", job_id))
    return stored("files", FILES), stored("file_hashes", FILE_HASHES)


def drop_job(spark: SparkSession, base: str, job_id: str) -> None:
    """Remove the stored groups of a deleted job."""
    for name in GROUP_TABLES:
        delete_job_groups(spark, f"{base}/{name}", job_id)


def run_job(job_table: DataFrame, job_id: str, now: Column, work: Callable[[], ScanResult]) -> tuple[ScanResult | None, DataFrame]:
    """Run a scan and return it with the job table after it: completed, or failed with the message."""
    spark = job_table.sparkSession

    def with_status(table: DataFrame, status: str, message: str | None, started: bool, finished: bool) -> DataFrame:
        update = spark.createDataFrame(
            [(job_id, status, message, started, finished)],
            "job_id string, status string, error_message string, started boolean, finished boolean",
        )
        return jobs.update_status(table, update, now)

    running = with_status(job_table, "running", None, True, False)
    try:
        result = work()
        done = jobs.merge_metrics(running, checkpointed(result.metrics))
    except Exception as error:
        return None, with_status(running, "failed", str(error), False, True)
    return result, with_status(done, "completed", None, False, True)
