"""Repeated passages: seed on winnowed anchors, extend both ways, keep maximal repeats.

A passage of ``window`` words that occurs twice has the same winnowed anchor (the smallest
``anchor``-word gram in it, the last of equal ones) at the same place in both copies. So documents
first exchange anchors, a quarter of all positions; only around anchors that another document has
too are matches extended, to all windows that chose the anchor. Each such window finds the smallest
document that holds it by a minimum that is taken per chunk, then per bucket: no pairs are made, so
a passage that a third of all documents share costs one row per chunk. Windows that overlap or touch
join into maximal repeats.

Edge cases: a null or empty text has no words; a null doc_id counts as larger than any number, so
its repeats go and it never makes another document's go; rows that share a doc_id never remove each
other's words; other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.shared_keys import (
    KEYS_SCHEMA,
    chunked,
    filed,
    flags_of,
    packed_keys,
    parts_of,
    seen_elsewhere,
)
from twinsift.llm.words import binary_rows, hashed_words, ngrams

_LAST_ID = (1 << 63) - 1
_OWNED_SCHEMA = "bucket int, chunk int, keys binary, owners binary"
_RESULT_SCHEMA = (
    "id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept_text string"
)


def _windows_inside(index: np.ndarray, window: int) -> np.ndarray:
    """Positions at which a window begins and ends in the same text."""
    n = int(index[-1])
    ok = np.ones(max(0, n - window + 1), dtype=bool)
    for end in np.unique(index[1:]):
        ok[max(0, end - window + 1) : end] = False
    return np.flatnonzero(ok)


def _anchor_of(grams: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """For windows that begin ``at``, the position of the smallest gram in them."""
    best = at.copy()
    least = grams[at]
    for k in range(1, width):
        here = grams[at + k]
        better = here <= least
        best[better] = at[better] + k
        least = np.where(better, here, least)
    return best


class _Chunk:
    """The windows of a chunk's documents, in order of document id, with their anchors."""

    def __init__(self, table: pa.Table, window: int, anchor: int, parts: int):
        table = table.sort_by("id")
        self.table, self.window = table, window
        self.buffer, self.starts, self.ends, hashes, self.index = hashed_words(table["text"], lower=False)
        self.ids = table["id"].to_numpy()
        self.at = _windows_inside(self.index, window)
        grams = ngrams(hashes, anchor)
        self.anchors = filed(grams[_anchor_of(grams, self.at, window - anchor + 1)], parts)
        self.keys = ngrams(hashes, window, salt=1)[self.at]
        self.buckets = (ngrams(hashes, window, salt=2)[self.at] % np.uint64(parts)).astype(np.int32)
        self.owner = self.ids[np.searchsorted(self.index, self.at, "right") - 1]


def _first_of_runs(*sorted_columns: np.ndarray) -> np.ndarray:
    changed = np.zeros(len(sorted_columns[0]), dtype=bool)
    changed[:1] = True
    for column in sorted_columns:
        changed[1:] |= column[1:] != column[:-1]
    return changed


def _least_owner(table: pa.Table) -> pa.Table:
    """To each chunk the windows of this bucket that a smaller document of another chunk has."""
    rows = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    owners = [np.frombuffer(x, np.int64) for x in table["owners"].to_pylist()]
    keys, owner = np.concatenate(rows), np.concatenate(owners)
    order = np.lexsort((owner, keys))
    first = _first_of_runs(keys[order])
    known, least = keys[order][first], owner[order][first]
    out_keys, out_owners = [], []
    for row, own in zip(rows, owners):
        found = least[np.searchsorted(known, row)]
        smaller = found < own
        out_keys.append(row[smaller].tobytes())
        out_owners.append(found[smaller].tobytes())
    return pa.table(
        {
            "bucket": table["bucket"],
            "chunk": table["chunk"],
            "keys": pa.array(out_keys, pa.binary()),
            "owners": pa.array(out_owners, pa.binary()),
        }
    )


def remove_repeats(docs: DataFrame, window: int = 13, anchor: int = 7, parts: int | None = None) -> DataFrame:
    """Per document (id, n_words, n_removed, spans, kept_text).

    A word goes if a window of ``window`` words that covers it also begins in a document with a
    smaller id. ``spans`` are the maximal repeats, as word positions from ``start`` up to ``end``;
    ``kept_text`` has the other words, joined by one blank.
    """
    parts = parts or parts_of(docs)
    texts = chunked(docs, parts)

    def seeds(table: pa.Table) -> pa.Table:
        return packed_keys(table["chunk"][0].as_py(), np.unique(_Chunk(table, window, anchor, parts).anchors))

    def extended(table: pa.Table, answer: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, anchor, parts)
        distinct, which = np.unique(chunk.anchors, return_inverse=True)
        shared = flags_of(distinct, answer)[which]
        buckets, keys, owner = chunk.buckets[shared], chunk.keys[shared], chunk.owner[shared]
        order = np.lexsort((keys, buckets))  # stable, and owners ascend already
        buckets, keys, owner = buckets[order], keys[order], owner[order]
        first = _first_of_runs(buckets, keys)
        buckets, keys, owner = buckets[first], keys[first], owner[first]
        heads = np.flatnonzero(np.diff(buckets, prepend=-1))
        cuts = np.append(heads, len(keys))
        return pa.table(
            {
                "bucket": pa.array(buckets[heads], pa.int32()),
                "chunk": pa.array(np.full(len(heads), table["chunk"][0].as_py() if len(table) else 0), pa.int32()),
                "keys": pa.array(binary_rows(keys, cuts), pa.binary()),
                "owners": pa.array(binary_rows(owner, cuts), pa.binary()),
            }
        )

    def cut(table: pa.Table, answer: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, anchor, parts)
        order = np.argsort(chunk.keys, kind="stable")
        first = _first_of_runs(chunk.keys[order])
        known = chunk.keys[order][first]
        least = chunk.owner[order][first]
        for keys, owners in zip(answer["keys"].to_pylist(), answer["owners"].to_pylist()):
            at = np.searchsorted(known, np.frombuffer(keys, np.uint64))
            np.minimum.at(least, at, np.frombuffer(owners, np.int64))
        repeated = np.empty(len(order), dtype=bool)
        repeated[order] = least[np.cumsum(first) - 1] < chunk.owner[order]
        depth = np.zeros(int(chunk.index[-1]) + 1, dtype=np.int32)
        np.add.at(depth, chunk.at[repeated], 1)
        np.add.at(depth, chunk.at[repeated] + window, -1)
        gone = np.cumsum(depth[:-1]) > 0
        n_removed, spans, kept = [], [], []
        raw = chunk.buffer.tobytes()
        for a, b in zip(chunk.index[:-1], chunk.index[1:]):
            mask = gone[a:b]
            n_removed.append(int(mask.sum()))
            edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])])
            stay, at = [], a
            for s, e in zip([*edges[::2], b - a], [*edges[1::2], b - a]):
                if at < a + s:
                    stay += raw[chunk.starts[at] : chunk.ends[a + s - 1]].split()
                at = a + e
            kept.append(b" ".join(stay).decode())
        return pa.table(
            {
                "id": chunk.table["id"],
                "n_words": pa.array(np.diff(chunk.index), pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept_text": pa.array(kept, pa.string()),
            }
        )

    anchors = texts.groupBy("chunk").applyInArrow(seeds, KEYS_SCHEMA)
    windows = (
        texts.groupBy("chunk")
        .cogroup(seen_elsewhere(anchors).groupBy("chunk"))
        .applyInArrow(extended, _OWNED_SCHEMA)
    )
    earlier = windows.groupBy("bucket").applyInArrow(_least_owner, _OWNED_SCHEMA)
    result = texts.groupBy("chunk").cogroup(earlier.groupBy("chunk")).applyInArrow(cut, _RESULT_SCHEMA)
    return result.select(
        F.when(F.col("id") != _LAST_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "spans", "kept_text"
    )
