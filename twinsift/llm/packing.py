"""Best-fit packing of tokenised documents into sequences, improved by a swap-based local search.

A document is cut only if it is longer than a sequence: into full pieces, of which the first takes what
does not divide. Full pieces are sequences of their own. The others are dealt evenly to groups of a fixed
number of pieces, one task each. A group packs its pieces best-fit decreasing; then its least filled bin
is emptied: its pieces move to other underfull bins, or are exchanged one for one or one for two against
smaller ones, always the exchange that raises the sum of squared fills most. A group ends when it has no
more bins than its tokens need, or when rounds over all its bins have emptied none. The least filled bins of all groups
are opened and packed again together, group by group, until one group is left, so what the groups waste
does not add up.

Only (id, lengths, checksum) of a piece is kept after its document has been tokenised; a task holds one
group. Rows are dealt by their place in a checkpoint, so copies and repeated ids spread like others.

Edge cases: a null or empty text is the end mark alone; rows that share a doc_id, or have none, are
packed each for itself; a text of any length is tokenised whole; ties go to the lower bin; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.session import checkpointed, ship_package

# Pieces that one task packs.
GROUP_PIECES = 16_384
# One in so many bins of a group is packed again in the next round.
REOPENED = 16
# One-for-two exchanges are looked for among so many pieces of a bin at once.
_PAIR_ROWS = 256
# The search ends when all bins have been tried so often without emptying one.
ROUNDS = 3
_BATCH_ROWS = 2_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", bin int, offset long, open boolean"


# ---- documents to pieces


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable characters are
    themselves, the others follow from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevelEncoder:
    """Ids of texts by the byte-level BPE of a tokenizer file, as an array.

    The merges of such a file are ranked by the ids of what they make, so the same vocabulary serves a
    faster library; a text it cannot take goes to the file's own.
    """

    def __init__(self, content: str, pattern: str):
        import tiktoken

        file = json.loads(content)
        special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        byte_of = _byte_of()
        ranks = {
            bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special
        }
        self._content, self._own = content, None
        self._fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def own(self, text: str) -> np.ndarray:
        if self._own is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_str(self._content)
        return np.array(self._own.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self._fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
        except Exception:  # the library's matcher gives up on some very long runs
            return self.own(text)


_encoders: dict[int, ByteLevelEncoder] = {}


def _encoder(content: str, pattern: str) -> ByteLevelEncoder:
    key = zlib.crc32(content.encode() + pattern.encode())
    if key not in _encoders:
        _encoders[key] = ByteLevelEncoder(content, pattern)
    return _encoders[key]


def cuts(size: int, capacity: int) -> list[int]:
    """Where the pieces of a document of ``size`` ids begin, and its end."""
    first = size % capacity or capacity
    return [0, *range(first, size + 1, capacity)]


def _tokenised(batches: Iterator[pa.RecordBatch], content, pattern: str, end: int, capacity: int):
    encode = _encoder(content.value, pattern)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32")]])
    for batch in batches:
        for begin in range(0, len(batch), _BATCH_ROWS):
            part = batch.slice(begin, _BATCH_ROWS)
            out: list[tuple] = []
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"]):
                ids = np.append(encode(text.as_py() or ""), np.array([end], "<u4"))
                at = cuts(len(ids), capacity)
                for piece, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    out.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pieces(docs: DataFrame, tokenizer: str, pattern: str, end: int = 2, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document (doc_id, text).

    ``tokenizer`` is the path of a byte-level BPE file, read once by the driver; ``pattern`` cuts texts
    into what merges may not cross; ``end`` is put after each document.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _tokenised(batches, content, pattern, end, capacity), _PIECES)


# ---- packing of one group


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, largest first, goes to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins


class LocalSearch:
    """Empties the least filled bin of a packing, as long as exchanges raise the sum of squared fills."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes.astype(np.int64), capacity
        self.bin = np.empty(len(sizes), dtype=np.int64)
        self.fill = np.zeros(len(bins), dtype=np.int64)
        for b, items in enumerate(bins):
            self.bin[items] = b
            self.fill[b] = sizes[items].sum()
        self.least = -(-int(sizes.sum()) // capacity)
        self.passed_over = np.zeros(len(bins), dtype=bool)

    def _gain(self, moved: np.ndarray, to: np.ndarray, donor: int) -> np.ndarray:
        """How much the sum of squared fills rises when the donor gives up ``moved`` tokens."""
        return moved * (self.fill[to] - self.fill[donor] + moved)

    def _best(self, sizes: list[int], donor: int, room: np.ndarray, others: np.ndarray, hosts: np.ndarray):
        """The best move of one of these sizes, or exchange of it against one piece of a host."""
        best, chosen = 0, None
        # What an exchange gains follows from the size and the room alone: one piece of each kind will do.
        _, first = np.unique(self.sizes[others] * (self.capacity + 1) + room[self.bin[others]], return_index=True)
        others = others[first]
        _, first = np.unique(room[hosts], return_index=True)
        hosts = hosts[first]
        at, theirs = self.bin[others], self.sizes[others]
        free = room[at]
        for size in sizes:
            fits = hosts[room[hosts] >= size]
            if len(fits):
                to = fits[np.argmax(self._gain(np.int64(size), fits, donor))]
                if (gain := int(self._gain(np.int64(size), to, donor))) > best:
                    best, chosen = gain, (size, [], int(to))
            moved = size - theirs
            good = np.flatnonzero((moved > 0) & (moved <= free))
            if len(good):
                gains = self._gain(moved[good], at[good], donor)
                k = int(np.argmax(gains))
                if gains[k] > best:
                    best, chosen = int(gains[k]), (size, [int(others[good[k]])], int(at[good[k]]))
        return chosen

    def _step(self, donor: int) -> bool:
        """Carry out the best move or exchange that takes tokens from the donor."""
        room = self.capacity - self.fill
        room[donor] = 0
        mine = np.flatnonzero(self.bin == donor)
        others = np.flatnonzero(room[self.bin] > 0)
        hosts = np.flatnonzero((room > 0) & (self.fill > 0))
        if not len(hosts):
            return False
        sizes = np.unique(self.sizes[mine])[::-1]
        chosen = self._best(sizes.tolist(), donor, room, others, hosts) or self._two_for_one(donor, mine, others)
        if chosen:
            given = [mine[np.argmax(self.sizes[mine] == chosen[0])]]
        else:
            # Two of the donor's for one of a host.
            total = np.add.outer(self.sizes[mine], self.sizes[mine])
            pairs = total[np.triu_indices(len(mine), 1)]
            chosen = self._best(np.unique(pairs)[::-1].tolist(), donor, room, others, hosts)
            if not chosen:
                return False
            first, second = np.argwhere(np.triu(total == chosen[0], 1))[0]
            given = [mine[first], mine[second]]
        size, back, to = chosen
        self.bin[given] = to
        self.bin[back] = donor
        moved = size - int(self.sizes[back].sum())
        self.fill[to] += moved
        self.fill[donor] -= moved
        return True

    def _two_for_one(self, donor: int, mine: np.ndarray, others: np.ndarray):
        """The first bin in which two pieces can be exchanged for a larger one of the donor."""
        order = others[np.lexsort((self.sizes[others], self.bin[others]))]
        starts = np.flatnonzero(np.r_[True, np.diff(self.bin[order]) != 0, True]) if len(order) else [0]
        largest = int(self.sizes[mine].max())
        have = np.zeros(self.capacity + 2, dtype=bool)
        have[self.sizes[mine]] = True
        # For every total, the largest piece of the donor that is no larger.
        upto = np.maximum.accumulate(np.where(have, np.arange(len(have)), 0))
        for a, b in zip(starts[:-1], starts[1:]):
            items = order[a:b]
            if len(items) < 2 or self.sizes[items[0]] + self.sizes[items[1]] >= largest:
                continue
            to = int(self.bin[items[0]])
            room = self.capacity - int(self.fill[to])
            for begin in range(0, len(items), _PAIR_ROWS):
                left = items[begin : begin + _PAIR_ROWS]
                total = self.sizes[left][:, None] + self.sizes[items][None, :]
                total[left[:, None] == items[None, :]] = self.capacity
                size = upto[np.minimum(total + room, self.capacity + 1)]
                gains = np.where(size > total, self._gain(size - total, np.int64(to), donor), 0)
                k = np.unravel_index(int(np.argmax(gains)), gains.shape)
                if gains[k] > 0:
                    return int(size[k]), [int(left[k[0]]), int(items[k[1]])], to
        return None

    def run(self) -> None:
        bins = int(np.count_nonzero(self.fill))
        rounds, raised = 0, False
        while bins > self.least:
            candidates = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity) & ~self.passed_over)
            if not len(candidates):
                rounds += 1
                if not raised or rounds == ROUNDS:
                    return
                self.passed_over[:], raised = False, False
                continue
            donor = int(candidates[np.argmin(self.fill[candidates])])
            if not self._step(donor):
                self.passed_over[donor] = True
                continue
            raised = True
            if self.fill[donor] == 0:
                bins, rounds = bins - 1, 0
                self.passed_over[:] = False


def packed(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each size, bins numbered from 0 without gaps from the fullest on."""
    search = LocalSearch(sizes, best_fit(sizes, capacity), capacity)
    search.run()
    order = np.argsort(-search.fill, kind="stable")
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    return number[search.bin]


def _pack_group(table: pa.Table, capacity: int, last: bool) -> pa.Table:
    sizes = table["length"].to_numpy()
    order = np.lexsort((table["row"].to_numpy(), -sizes))
    table, sizes = table.take(pa.array(order)), sizes[order]
    bins = packed(sizes, capacity)
    order = np.argsort(bins, kind="stable")
    table, sizes, bins = table.take(pa.array(order)), sizes[order], bins[order]
    ends = np.cumsum(sizes)
    first = np.flatnonzero(np.r_[True, np.diff(bins) != 0])
    offset = ends - sizes - (ends - sizes)[first][bins]
    count = int(bins[-1]) + 1
    kept = count if last else count - -(-count // REOPENED)
    columns = [table[c].combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    return pa.Table.from_arrays(
        [*columns, pa.array(bins, pa.int32()), pa.array(offset, pa.int64()), pa.array(bins >= kept)],
        names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "open"],
    )


# ---- all pieces


def pack(found: DataFrame, capacity: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset. ``found`` is what ``pieces`` returns."""
    found = checkpointed(found)  # tokenised once; fixes the places by which rows are dealt
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    row = F.monotonically_increasing_id()
    full = found.withColumn("row", row).where(F.col("length") == capacity)
    result = full.select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = found.withColumn("row", row).where(F.col("length") < capacity)
    step = 0
    while True:
        count = rest.count()
        groups = max(1, -(-count // group_pieces))
        last = groups == 1
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
        placed = checkpointed(
            dealt.groupBy("group").applyInArrow(
                lambda key, table: _with_group(key, _pack_group(table, capacity, last)), "group long, " + _PACKED
            )
        )
        name = F.lit(step << 56) + F.shiftleft("group", 24) + F.col("bin")
        result = result.unionByName(placed.where("NOT open").select(*columns, name.alias("sequence_id"), "offset"))
        if last:
            return result
        rest = placed.where("open").select(*columns, F.monotonically_increasing_id().alias("row"))
        step += 1


def _with_group(key, table: pa.Table) -> pa.Table:
    return table.add_column(0, "group", pa.array([key[0].as_py()] * len(table), pa.int64()))
