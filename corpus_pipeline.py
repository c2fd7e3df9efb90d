"""From raw documents to a training mix: quality, recurring lines, near copies, benchmark, mixing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; the last returns what the mix takes of each document. ``run`` writes
each stage as Parquet to the shared folder and reads it again, so a later stage never recomputes an
earlier one and survives lost executors.

Edge cases: rows are told apart by doc_id and text, so rows that share a doc_id are judged one by one;
of repeated rows one stays, and a document without a doc_id stays only if its group has none with one;
rows without words are copies only if doc_id and text are equal; a document that loses all its lines
stays with an empty text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinsift.llm.decontaminate import drop_contaminated
from twinsift.llm.mixing import mix
from twinsift.llm.ngram_join import similar_documents
from twinsift.llm.quality_crf import score_quality
from twinsift.llm.template_tree import drop_recurring_lines
from twinsift.session import shared_dir


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark, docs, sf_dir):
    """Documents that the line labels find good."""
    return score_quality(docs, _table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def lines(spark, docs, sf_dir):
    """All documents, without the lines whose template recurs across unlike documents."""
    return drop_recurring_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark, docs, sf_dir):
    """One row, that with the smallest id, of each group of near copies."""
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text")).withColumn("__text", F.sha2("text", 256))
    groups = similar_documents(keyed.select(F.col("__key").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("__key"), "component_id"
    )
    per_key = (
        keyed.select("__key", "doc_id", "__text")
        .distinct()
        .groupBy("__key")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("id"), F.count(F.lit(1)).alias("n"))
    )
    least = per_key.join(groups.distinct(), "__key").groupBy("component_id").agg(F.min(F.struct("id", "__key")).alias("first"))
    # Different rows that chance to share a key stay, rather than one going for the other's copies.
    kept = least.select("first.__key").unionByName(per_key.where("n > 1").select("__key"))
    # Repeated rows are reduced before they are shuffled.
    rows = keyed.groupBy("__key", "doc_id", "__text").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return rows.join(kept, "__key", "left_semi").select("row.*")


def benchmark(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """What the mix takes of each document."""
    return mix(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("mixing", mixing),
]

# The line model cannot be expressed in SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
