"""Exact groups after a rescan: only signatures of changed files are grouped and scored again.

The members of all signatures, with the attributes that scoring needs, are stored in partitions by a
hash of the signature, and so are the scored items and the groups made of them; which job they are read
for is the reader's to say (``for_job``). A rescan reads the partitions that hold a touched signature, works out the touched signatures anew and replaces those
partitions. The result is the same as grouping and scoring all files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.operators.exact import exact_group_items, exact_groups
from twinsift.operators.scoring import FILE_COLUMNS, score_groups
from twinsift.session import checkpointed
from twinsift.sources.tables import replace_partition

# Partitions of each stored table; fixed once the tables exist.
PARTS = 256
MEMBERS = ["file_id", "signature", *FILE_COLUMNS]
TABLES = ("members", "items", "groups")


@dataclass(frozen=True)
class ExactState:
    """Members (file, signature, attributes), scored items and groups, each with its partition ``part``."""

    members: DataFrame
    items: DataFrame
    groups: DataFrame


def in_parts(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("signature"), F.lit(parts)).cast("int"))


def members_of(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates (file_id, signature) with the attributes of their files."""
    return candidates.select("file_id", "signature").join(files.select("file_id", *FILE_COLUMNS), "file_id").select(*MEMBERS)


def build_state(members: DataFrame, parts: int = PARTS, hot_rows: int | None = None) -> ExactState:
    """The state of all members, from scratch."""
    members = checkpointed(members.select(*MEMBERS))
    candidates = members.select("file_id", "size_bytes", "signature")
    items = exact_group_items(candidates, "", hot_rows).drop("job_id")
    scored = score_groups(items, members, ["signature"], hot_rows)
    groups = exact_groups(candidates, "").drop("job_id")
    return ExactState(*[in_parts(x, parts) for x in (members, scored, groups)])


def for_job(rows: DataFrame, job_id: str) -> DataFrame:
    """Stored items or groups as those of a job."""
    return rows.drop("part").select(F.lit(job_id).alias("job_id"), "*")


def touched_signatures(gone: DataFrame, added: DataFrame, parts: int = PARTS) -> DataFrame:
    """Signatures that lose or get a file, with their partition."""
    return checkpointed(in_parts(gone.select("signature").unionByName(added.select("signature")).distinct(), parts))


def update_state(
    state: ExactState, gone: DataFrame, added: DataFrame, parts: int = PARTS, hot_rows: int | None = None
) -> ExactState:
    """The touched partitions of the state after files lost (``gone``: file_id, signature) and got
    (``added``: members) a signature. Partitions that are not in the result stay as they are."""
    touched = touched_signatures(gone, added, parts)
    numbers = [r.part for r in touched.select("part").distinct().collect()]  # at most ``parts``
    in_touched = lambda rows: rows.where(F.col("part").isin(numbers))
    old = in_touched(state.members)
    own = ["file_id", "signature"]
    # Added files are taken out first, so a job that is repeated does not add them twice.
    lost = checkpointed(gone.select(*own).unionByName(added.select(*own)).distinct())
    left = old.join(lost, own, "left_anti").select(*MEMBERS, "part")
    members = checkpointed(left.unionByName(in_parts(added.select(*MEMBERS), parts)))
    again = members.join(touched.select("signature"), "signature", "left_semi").select(*MEMBERS)
    fresh = build_state(again, parts, hot_rows)
    merged = lambda stored, new: (
        in_touched(stored).join(touched.select("signature"), "signature", "left_anti")
        .select(*new.columns).unionByName(new)
    )
    return ExactState(members, merged(state.items, fresh.items), merged(state.groups, fresh.groups))


# ---- stored


def save_state(state: ExactState, base: str) -> None:
    for name in TABLES:
        getattr(state, name).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{base}/{name}")


def load_state(spark: SparkSession, base: str) -> ExactState:
    return ExactState(*[spark.read.parquet(f"{base}/{name}") for name in TABLES])


def refresh_state(
    spark: SparkSession, base: str, gone: DataFrame, added: DataFrame, parts: int = PARTS, hot_rows: int | None = None
) -> list[int]:
    """Bring the stored state up to date and return the partitions that were replaced.

    Members are replaced last: a job that dies before and is repeated finds them as they were and
    writes the same items and groups again.
    """
    after = update_state(load_state(spark, base), gone, added, parts, hot_rows)
    touched = touched_signatures(gone, added, parts)
    numbers = sorted(r.part for r in touched.select("part").distinct().collect())
    for name in ("items", "groups", "members"):
        # Pinned: the partitions it reads are those it replaces.
        rows = checkpointed(getattr(after, name))
        held = {r.part for r in rows.select("part").distinct().collect()}
        writer = rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("part").parquet(f"{base}/{name}")
        for part in set(numbers) - held:  # dynamic overwrite leaves a partition that became empty
            replace_partition(rows.where("false"), f"{base}/{name}", "part", part)
    return numbers
