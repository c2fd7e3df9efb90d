"""Bounded samples of labelled documents to fit small models on, and helpers to score batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.session import ship_package

# Text bytes that one step of scoring holds in numpy arrays.
STEP_BYTES = 2 << 20


def sampled(docs: DataFrame, labels: DataFrame, label: str, per_value: dict[int, int], usable: Column) -> DataFrame:
    """(text, label) of at most ``per_value`` documents for each label value, chosen by a hash of
    the doc_id. ``usable`` is a condition on doc_id. A doc_id with two labels has the larger one."""
    ship_package(docs.sparkSession)
    known = labels.where(F.col(label).isin(list(per_value)) & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.max(label).alias("label")).withColumn("order", F.xxhash64("doc_id"))
    chosen = None
    for value, rows in per_value.items():
        some = known.where(F.col("label") == value).orderBy("order", "doc_id").limit(rows).select("doc_id", "label")
        chosen = some if chosen is None else chosen.unionByName(some)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the ``text`` column of each has about STEP_BYTES."""
    for batch in batches:
        sizes = pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(batch):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + STEP_BYTES, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))
