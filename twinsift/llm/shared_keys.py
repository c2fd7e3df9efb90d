"""Which hashed keys of a chunk of documents occur elsewhere, without one row per key.

Documents are dealt into chunks by a hash. A chunk sends its distinct keys, sorted, as one packed
row per key bucket; so a key that a third of all documents hold counts once per chunk. A bucket
answers with packed rows as well. Both numbers grow with the text, so the size of a chunk and of a
bucket does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.session import ship_package

# Bytes of text per chunk.
CHUNK_BYTES = 12 << 20
# Chunks that even a small input gets, so that all cores have work.
LEAST_PARTS = 64
# Buckets of keys per chunk of text.
BUCKETS = 4
_BITS = np.uint64(24)
_LOW = np.uint64((1 << 24) - 1)

KEYS_SCHEMA = "bucket int, chunk int, keys binary"
COUNTS_SCHEMA = "bucket int, chunk int, keys binary, counts binary"
FLAGS_SCHEMA = "bucket int, chunk int, flags binary"
_LAST_ID = (1 << 63) - 1


def parts_of(docs: DataFrame, text: str = "text") -> int:
    """The number of chunks and of buckets for these documents."""
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(LEAST_PARTS, -(-size // CHUNK_BYTES))


def chunked(docs: DataFrame, parts: int) -> DataFrame:
    """(chunk, id, text): a null id counts as the largest number, a null text as empty."""
    ship_package(docs.sparkSession)
    return docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts).cast("long")).cast("int").alias("chunk"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def filed(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bucket and 24 bits of each key in one number. A bucket has about half a million keys, so some
    3 in 100 agree with another by chance; callers use the answer only to leave out keys that
    certainly occur nowhere else, or to order keys."""
    bucket = (keys >> np.uint64(32)) % np.uint64(parts * BUCKETS)
    return (bucket << _BITS) | (keys & _LOW)


def _squeezed(low: np.ndarray) -> bytes:
    """Sorted distinct numbers as their differences of two bytes, if they are that close."""
    gaps = np.diff(low, prepend=np.uint32(0))
    if gaps.max() < 1 << 16:
        return b"\1" + gaps.astype(np.uint16).tobytes()
    return b"\0" + low.tobytes()


def _spread(data: bytes) -> np.ndarray:
    if data[:1] == b"\1":
        return np.cumsum(np.frombuffer(data, np.uint16, offset=1), dtype=np.uint32)
    return np.frombuffer(data[1:], np.uint32)


def _cells(distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of sorted distinct filed keys, and where each begins (and the end)."""
    buckets = (distinct >> _BITS).astype(np.int64)
    heads = np.flatnonzero(np.diff(buckets, prepend=-1))
    return buckets[heads], np.append(heads, len(distinct))


def packed_keys(chunk: int, distinct: np.ndarray) -> pa.Table:
    """Rows of KEYS_SCHEMA for sorted distinct filed keys."""
    buckets, cuts = _cells(distinct)
    low = (distinct & _LOW).astype(np.uint32)
    return pa.table(
        {
            "bucket": pa.array(buckets, pa.int32()),
            "chunk": pa.array(np.full(len(buckets), chunk), pa.int32()),
            "keys": pa.array([_squeezed(low[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
        }
    )


def packed_counts(chunk: int, distinct: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Rows of COUNTS_SCHEMA: the keys, and how often the chunk has each."""
    _, cuts = _cells(distinct)
    counts = counts.astype(np.uint32)
    packed = pa.array([counts[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
    return packed_keys(chunk, distinct).append_column("counts", packed)


def _answer(table: pa.Table) -> pa.Table:
    rows = [_spread(x) for x in table["keys"].to_pylist()]
    every = np.sort(np.concatenate(rows))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    flags = []
    for row in rows:
        if len(again):
            at = np.minimum(np.searchsorted(again, row), len(again) - 1)
            flags.append(np.packbits(again[at] == row).tobytes())
        else:
            flags.append(np.packbits(np.zeros(len(row), bool)).tobytes())
    return pa.table({"bucket": table["bucket"], "chunk": table["chunk"], "flags": pa.array(flags, pa.binary())})


def _totals(table: pa.Table) -> pa.Table:
    rows = [_spread(x) for x in table["keys"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table["counts"].to_pylist()])
    known, which = np.unique(np.concatenate(rows), return_inverse=True)
    total = np.minimum(np.bincount(which, counts), (1 << 32) - 1).astype(np.uint32)
    flags = [total[np.searchsorted(known, row)].tobytes() for row in rows]
    return pa.table({"bucket": table["bucket"], "chunk": table["chunk"], "flags": pa.array(flags, pa.binary())})


def seen_elsewhere(keys: DataFrame) -> DataFrame:
    """For rows of KEYS_SCHEMA, a bit per key: does another chunk have it too?"""
    return keys.groupBy("bucket").applyInArrow(_answer, FLAGS_SCHEMA)


def counted_everywhere(keys: DataFrame) -> DataFrame:
    """For rows of COUNTS_SCHEMA, the total of each key over all chunks."""
    return keys.groupBy("bucket").applyInArrow(_totals, FLAGS_SCHEMA)


def _per_key(distinct: np.ndarray, answer: pa.Table, values: np.ndarray, read) -> np.ndarray:
    buckets = distinct >> _BITS
    for bucket, data in zip(answer["bucket"].to_pylist(), answer["flags"].to_pylist()):
        a, b = np.searchsorted(buckets, np.array([bucket, bucket + 1], dtype=np.uint64))
        values[a:b] = read(data, b - a)
    return values


def flags_of(distinct: np.ndarray, answer: pa.Table) -> np.ndarray:
    """The bits of ``seen_elsewhere`` in the order of the chunk's sorted distinct filed keys."""
    return _per_key(
        distinct,
        answer,
        np.zeros(len(distinct), dtype=bool),
        lambda data, n: np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool),
    )


def totals_of(distinct: np.ndarray, answer: pa.Table) -> np.ndarray:
    """The numbers of ``counted_everywhere`` in the same order."""
    return _per_key(
        distinct, answer, np.zeros(len(distinct), dtype=np.int64), lambda data, n: np.frombuffer(data, np.uint32)
    )
