"""File, job and action tables derived from the provided Parquet tables with Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions import paths as P
from twinsift.functions.fingerprints import fingerprint, from_hex64
from twinsift.operators.components import connected_components
from twinsift.operators.decisions import unified_items
from twinsift.operators.exact import exact_candidates, exact_group_items
from twinsift.operators.maintenance import ExactState, build_state, load_state, members_of, refresh_state, save_state
from twinsift.operators.outcomes import batch_status
from twinsift.operators.print_index import store_prints, stored_prints
from twinsift.operators.scoring import score_groups
from twinsift.operators.similar import find_similar, similar_candidates, similar_links, similar_pairs
from twinsift.session import checkpointed, shared_dir
from twinsift.sources.tables import hashes_wide

TRASH = "/nas/.trash"
JOB = "job-current"

_stored: dict[tuple, DataFrame | str] = {}


def _store(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A table as an earlier job would have stored it, built once per Spark application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        _stored[key] = checkpointed(build())
    return _stored[key]


def _folder(spark: SparkSession, sf: str, name: str, fill) -> str:
    """A shared folder that ``fill`` writes once per Spark application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        fill(path)
        _stored[key] = path
    return _stored[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(1, "/nas/root1", 1), (2, "/nas/root2", 1), (3, "/nas/root3", 0)],
        "root_id long, path string, enabled int",
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    root = doc % 3 + 1
    rel = F.concat_ws("/", "source", "lang", F.concat(doc.cast("string"), F.lit(".txt")))
    text = lambda value: F.lit(value).cast("string")
    number = lambda value: F.lit(value).cast("long")
    return table(spark, sf, "documents").select(
        (doc + 1).alias("file_id"),
        root.alias("root_id"),
        rel.alias("rel_path"),
        F.concat(F.lit("/nas/root"), root.cast("string"), F.lit("/"), rel).alias("abs_path"),
        F.concat(doc.cast("string"), F.lit(".txt")).alias("file_name"),
        text(".txt").alias("extension"),
        text("text/plain").alias("mime_type"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        (F.lit(1_700_000_000_000_000_000) + (doc * 7919 % 1000) * 1_000_000_000).alias("mtime_epoch_ns"),
        number(None).alias("ctime_epoch_ns"),
        number(None).alias("inode"),
        number(None).alias("dev"),
        F.when(doc % 4 != 0, doc % 5 * 100).cast("int").alias("width"),
        (doc % 3 * 100).cast("int").alias("height"),
        F.when(doc % 3 == 0, "2020-01-01").when(doc % 3 == 1, "").alias("exif_datetime_original"),
        text(None).alias("exif_make"),
        text(None).alias("exif_model"),
        F.concat(F.lit("job-"), doc.cast("string")).alias("first_seen_job_id"),
        F.concat(F.lit("job-"), (doc + doc % 2).cast("string")).alias("last_seen_job_id"),
        F.when(doc % 11 != 0, 1).otherwise(0).alias("is_present"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def contents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # A table in few pieces is spread before the costly hashing; a larger one is hashed where it is read,
    # so that no text is shuffled.
    if docs.rdd.getNumPartitions() < 2 * spark.sparkContext.defaultParallelism:
        docs = docs.repartition("doc_id")
    return docs.select((F.col("doc_id") + 1).alias("file_id"), F.col("text").cast("binary").alias("content"))


def listing(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select(
        "root_id", "rel_path", "abs_path", "file_name", "size_bytes", "mtime_epoch_ns",
        "ctime_epoch_ns", "inode", "dev",
    )


def overlapping_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The listing, with a fifth of the files listed again below a wider root 4."""
    once = listing(spark, sf)
    again = once.where(F.col("mtime_epoch_ns") / 1_000_000_000 % 5 == 0).select(
        F.lit(4).cast("long").alias("root_id"),
        P.rel_path(F.col("abs_path"), F.lit("/nas")).alias("rel_path"),
        *once.columns[2:],
    )
    return once.unionByName(again)


def prev_files(spark: SparkSession, sf: str) -> DataFrame:
    """The index before the listing: some files unknown, some smaller, some since removed."""
    now = files(spark, sf)
    doc = F.col("file_id") - 1
    smaller = F.when(doc % 7 == 0, F.col("size_bytes") - 1).otherwise(F.col("size_bytes"))
    known = now.where(doc % 10 != 0).withColumn("size_bytes", smaller)
    old = now.where(doc % 13 == 0).withColumn("file_id", F.col("file_id") + 1_000_000)
    for column in ("rel_path", "abs_path", "file_name"):
        old = old.withColumn(column, F.concat(column, F.lit(".old")))
    return known.unionByName(old)


def file_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf, "file_hashes", lambda: fingerprint(contents(spark, sf)))


def exact_cands(spark: SparkSession, sf: str) -> DataFrame:
    return exact_candidates(files(spark, sf), file_hashes(spark, sf))


def similar_cands(spark: SparkSession, sf: str) -> DataFrame:
    return similar_candidates(files(spark, sf), file_hashes(spark, sf))


# ---- what the scan before the current one stored


def files_before(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the scan before: some of today's were unknown, those marked missing since were there."""
    return files(spark, sf).where((F.col("file_id") - 1) % 10 != 0)


def changed_since() -> Column:
    """Whether a known file had other contents then; its print of another kind stands for the old one."""
    return (F.col("file_id") - 1) % 7 == 0


def hash_values(spark: SparkSession, sf: str) -> DataFrame:
    return hashes_wide(file_hashes(spark, sf))


def prints_before(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(changed_since(), F.col("dhash64")).otherwise(F.col("phash64"))
    known = files_before(spark, sf).select("file_id").join(hash_values(spark, sf), "file_id")
    return known.select("file_id", from_hex64(value).alias("print"))


def pairs_before(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf, "pairs_before", lambda: similar_pairs(prints_before(spark, sf)))


def labels_before(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf, "labels_before", lambda: connected_components(similar_links(prints_before(spark, sf))))


def print_index_before(spark: SparkSession, sf: str) -> DataFrame:
    base = _folder(spark, sf, "print-index", lambda path: store_prints(prints_before(spark, sf), path, "first"))
    return stored_prints(spark, base)


def prints_gone(spark: SparkSession, sf: str) -> DataFrame:
    return prints_before(spark, sf).select("print").distinct().join(
        similar_cands(spark, sf).select("print").distinct(), "print", "left_anti"
    )


def members_before(spark: SparkSession, sf: str) -> DataFrame:
    signature = F.when(changed_since(), F.col("phash64")).otherwise(F.col("blake3_full"))
    known = files_before(spark, sf)
    signed = known.select("file_id").join(hash_values(spark, sf), "file_id").select("file_id", signature.alias("signature"))
    return members_of(signed, known)


def exact_state_after(spark: SparkSession, sf: str) -> ExactState:
    """The state that the scan before stored, brought up to date with the files that changed since."""

    def store(path: str) -> None:
        save_state(build_state(members_before(spark, sf), parts=16), path)
        before = members_before(spark, sf).select("file_id", "signature")
        now = members_of(exact_cands(spark, sf), files(spark, sf))
        same = ["file_id", "signature"]
        refresh_state(
            spark, path, before.join(now.select(*same), same, "left_anti"), now.join(before, same, "left_anti"), parts=16
        )

    return load_state(spark, _folder(spark, sf, "exact-state", store))


def exact_items(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf, "exact_items", lambda: score_groups(
        exact_group_items(exact_cands(spark, sf), JOB), files(spark, sf), ["job_id", "signature"]))


def plain_similar_items(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf, "plain_similar_items", lambda: find_similar(similar_cands(spark, sf), JOB))


def similar_items(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf, "similar_items", lambda: score_groups(
        plain_similar_items(spark, sf), files(spark, sf), ["job_id", "anchor_file_id"]))


def all_items(spark: SparkSession, sf: str) -> DataFrame:
    return unified_items(exact_items(spark, sf), similar_items(spark, sf))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A decision for every labelled file in every group it is a member of."""
    return labelled(spark, sf).join(all_items(spark, sf).drop("is_primary"), "file_id").select(
        "group_kind", "job_id", "group_key", "file_id", "decision", F.lit(None).cast("string").alias("note"), "seq"
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    choice = (
        F.when(F.col("toxic") == 1, "delete").when(F.col("quality") == 1, "keep").otherwise("trash")
    )
    return table(spark, sf, "labels").select(
        (F.col("doc_id") + 1).alias("file_id"), choice.alias("decision"), F.col("doc_id").alias("seq")
    )


def scan_jobs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    zero = F.lit(0).cast("long")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("job-"), key.cast("string")).alias("job_id"),
        F.when(key % 3 == 0, "exact").when(key % 3 == 1, "similar").otherwise("both").alias("mode"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("requested_at"),
        F.lit(None).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
        F.lit(None).cast("string").alias("error_message"),
        F.col("o_custkey").alias("files_seen"),
        (F.col("o_custkey") % 100).alias("files_indexed"),
        zero.alias("exact_groups_found"),
        zero.alias("similar_groups_found"),
        zero.alias("reclaimable_bytes"),
    )


def scan_job_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Every job scans one root, every fourth job a second one."""
    key = F.col("o_orderkey")
    chosen = F.when(key % 4 == 0, F.array(key % 3 + 1, (key + 1) % 3 + 1)).otherwise(F.array(key % 3 + 1))
    return table(spark, sf, "orders").select(
        F.concat(F.lit("job-"), key.cast("string")).alias("job_id"), F.explode(chosen).alias("root_id")
    )


def action_items(spark: SparkSession, sf: str) -> DataFrame:
    event = F.col("event_id")
    batch = F.floor(event / 200)
    by_type = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("done")
    status = F.when(batch % 5 == 0, "done").when(batch % 5 == 1, "failed").otherwise(by_type)
    items = table(spark, sf, "events").select(
        event.alias("item_id"),
        F.concat(F.lit("batch-"), batch.cast("string")).alias("batch_id"),
        (event % 200 + 1).alias("file_id"),
        status.alias("status"),
    )
    return items.join(files(spark, sf).select("file_id", F.col("abs_path").alias("source_path")), "file_id")


def action_batches(spark: SparkSession, sf: str) -> DataFrame:
    number = F.split("batch_id", "-")[1].cast("long")
    return batch_status(action_items(spark, sf)).select(
        "batch_id",
        F.when(number % 7 == 6, "restore").otherwise("move_to_trash").alias("action_type"),
        F.when(number % 10 == 9, "draft").otherwise(F.col("status")).alias("status"),
    )


def file_movements(spark: SparkSession, sf: str) -> DataFrame:
    event = F.col("event_id")
    batch = F.floor(event / 200)
    moves = table(spark, sf, "events").where(F.col("event_type").isin("view", "click")).select(
        event.alias("movement_id"),
        (event % 200 + 1).alias("file_id"),
        F.concat(F.lit("batch-"), batch.cast("string")).alias("batch_id"),
        F.col("ts").cast("timestamp").alias("moved_at"),
        F.when((event % 3 == 0) | (batch % 4 == 0), F.col("ts").cast("timestamp")).alias("restored_at"),
    )
    located = moves.join(files(spark, sf).select("file_id", F.col("abs_path").alias("from_path")), "file_id")
    return located.select(
        "movement_id", "file_id", "batch_id", "from_path",
        P.trash_path(F.col("from_path"), TRASH).alias("to_path"), "moved_at", "restored_at",
    )


def trash_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that already exist in the trash, some with their first numbered name."""
    doc = F.col("file_id") - 1
    path = P.trash_path(F.col("abs_path"), TRASH)
    taken = F.array(F.lit(0), F.lit(1))
    return (
        files(spark, sf).where(doc % 5 == 0)
        .select(F.explode(F.when(doc % 10 == 0, taken).otherwise(F.array(F.lit(0)))).alias("n"), path.alias("base"))
        .select(P.numbered_path(F.col("base"), F.col("n")).alias("path"))
    )


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What exists: present files (some paths are folders) and the trash."""
    doc = F.col("file_id") - 1
    present = files(spark, sf).where("is_present = 1").select(F.col("abs_path").alias("path"), (doc % 17 != 0).alias("is_file"))
    return present.unionByName(trash_listing(spark, sf).select("path", F.lit(True).alias("is_file")))
