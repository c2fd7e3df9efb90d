"""Table schemas and allowed values of the duplicate-file data model."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {
    "long": T.LongType(),
    "string": T.StringType(),
    "int": T.IntegerType(),
    "timestamp": T.TimestampType(),
}


def _table(columns: str) -> T.StructType:
    """The schema that a DDL string names; unlike Spark's own parser it needs no session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


# Tables and columns of the data model.
SCAN_ROOTS = _table("root_id long, path string, enabled int")

SCAN_JOBS = _table(
    "job_id string, mode string, status string, requested_at timestamp, started_at timestamp, "
    "finished_at timestamp, error_message string, files_seen long, files_indexed long, "
    "exact_groups_found long, similar_groups_found long, reclaimable_bytes long"
)

SCAN_JOB_ROOTS = _table("job_id string, root_id long")

LISTING = _table(
    "root_id long, rel_path string, abs_path string, file_name string, size_bytes long, "
    "mtime_epoch_ns long, ctime_epoch_ns long, inode long, dev long"
)

FILES = _table(
    "file_id long, root_id long, rel_path string, abs_path string, file_name string, "
    "extension string, mime_type string, size_bytes long, mtime_epoch_ns long, ctime_epoch_ns long, "
    "inode long, dev long, width int, height int, exif_datetime_original string, exif_make string, "
    "exif_model string, first_seen_job_id string, last_seen_job_id string, is_present int, "
    "updated_at timestamp"
)

FILE_HASHES = _table("file_id long, hash_type string, hash_hex string")

FILE_MOVEMENTS = _table(
    "movement_id long, file_id long, batch_id string, from_path string, to_path string, "
    "moved_at timestamp, restored_at timestamp"
)

# Stored names and enumerations of the data model.
CONTENT_HASH = "blake3_full"
DHASH = "dhash64"
PHASH = "phash64"
HASH_TYPES = [CONTENT_HASH, DHASH, PHASH]
JOB_MODES = ["exact", "similar", "both"]
JOB_STATUSES = ["queued", "running", "completed", "failed", "canceled"]
ACTIVE_JOB_STATUSES = ["queued", "running"]
GROUP_KINDS = ["exact", "similar"]
SIMILAR_ALGORITHMS = ["phash64", "dhash64", "hybrid"]
DECISIONS = ["keep", "trash", "delete", "ignore"]
ACTION_TYPES = ["move_to_trash", "delete_permanent", "restore"]
BATCH_STATUSES = ["draft", "confirmed", "executed", "partially_failed", "failed", "rolled_back"]
ITEM_STATUSES = ["pending", "done", "failed", "skipped"]

# Defaults of the original configuration.
DEFAULT_THRESHOLD = 8
DEFAULT_JOB_TIMEOUT_SECONDS = 7200
DEFAULT_PAGE_SIZE = 50
MOUNT_ROOT = "/nas"
