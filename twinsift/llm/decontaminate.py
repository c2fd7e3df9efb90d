"""Benchmark passages in documents, found by pieces and verified by edit distance.

Texts are compared as lower-cased words joined by one blank. An item of m characters may occur with
up to k = floor(rate * m) edits. Cut into k + 1 pieces, at least one piece is then unharmed, so the
documents are scanned once for all pieces (Aho-Corasick). Around each hit the least edit distance
between the item and any part of the text is worked out by Myers' bit-parallel method, on whole
integers of m bits; hits whose surroundings overlap share one run, so a text that repeats a piece
is read once per item. Items of fewer than ``edits_from`` words are too short for edits: they are
found only as the same sequence of whole words.

The items are a stated query set: they are searched in blocks of bounded size, each a pass over the
documents, and there is no limit on the number of hits.

Edge cases: a null or empty text has no matches; an item without words is found nowhere; repeated
rows each get their matches; a null id is reported as null; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.session import ship_package

# Characters of item text that one pass over the documents searches.
BLOCK_CHARS = 1 << 20
_MATCHES = "doc_id long, item_id long, distance int, start int, end int"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
)
_WORD = re.compile(r"\w+")


def plain(text: str) -> str:
    """The words of a text in lower case, joined by one blank."""
    return " ".join(_WORD.findall(text.lower()))


def best_match(pattern_bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance between a pattern of ``m`` characters and any part of ``text``, and
    where the first such part ends (Myers 1999)."""
    ones = (1 << m) - 1
    top = 1 << (m - 1)
    plus, minus, score = ones, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        equal = pattern_bits.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (ones & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & ones
        down = (down << 1) & ones
        plus = down | (ones & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, i + 1
    return best, end


class _Search:
    """Pieces of a block of items and the bit vectors to verify them."""

    def __init__(self, items: list[tuple[int, str]], rate: float, edits_from: int):
        import ahocorasick

        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (item_id, text) in enumerate(items):
            m = len(text)
            if text.count(" ") + 1 < edits_from:
                self.items.append((item_id, text, m, 0))
                pieces.setdefault(f" {text} ", []).append((n, m + 1))
                continue
            k = int(rate * m)
            self.items.append((item_id, text, m, k))
            for i in range(k + 1):
                a, b = i * m // (k + 1), (i + 1) * m // (k + 1)
                pieces.setdefault(text[a:b], []).append((n, b))
        self.finder = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.finder.add_word(piece, places)
        self.finder.make_automaton()
        self.bits: dict[int, dict[str, int]] = {}

    def _bits(self, n: int) -> dict[str, int]:
        if n not in self.bits:
            bits = self.bits[n] = {}
            for i, c in enumerate(self.items[n][1]):
                bits[c] = bits.get(c, 0) | (1 << i)
        return self.bits[n]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end): the best match of each item within its budget; the
        start is that of a part as long as the item."""
        best: dict[int, tuple[int, int]] = {}
        windows: dict[int, tuple[int, int]] = {}

        def verify(n: int, a: int, b: int) -> None:
            _, _, m, k = self.items[n]
            distance, end = best_match(self._bits(n), m, text[a:b])
            if distance <= k and (distance, a + end) < best.get(n, (k + 1, 0)):
                best[n] = (distance, a + end)

        for last, places in self.finder.iter(f" {text} "):
            for n, offset in places:
                _, item, m, k = self.items[n]
                if n in best and best[n][0] == 0:
                    continue
                begin = last - offset
                if begin >= 0 and text.startswith(item, begin):
                    best[n] = (0, begin + m)
                    windows.pop(n, None)
                    continue
                # Matches that hold this piece in its place lie in this window.
                a, b = max(0, begin - k), min(len(text), begin + m + k)
                if n in windows:
                    low, high = windows[n]
                    if a <= high and low <= b:
                        a, b = min(a, low), max(b, high)
                    else:
                        verify(n, low, high)
                windows[n] = (a, b)
        for n, (a, b) in windows.items():
            verify(n, a, b)
        return [(self.items[n][0], d, max(0, end - self.items[n][2]), end) for n, (d, end) in best.items()]


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, plain text) in blocks of about ``block_chars`` characters."""

    def plain_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, plain(t or "")) for i, t in zip(batch[0].to_pylist(), batch[1].to_pylist())]
            yield pa.RecordBatch.from_pydict(
                {"item_id": pa.array([i for i, _ in rows], pa.int64()), "plain": pa.array([t for _, t in rows], pa.string())}
            )

    ship_package(items.sparkSession)
    wanted = items.select(F.col("item_id").cast("long"), "text").mapInArrow(plain_items, "item_id long, plain string").where(
        "plain <> ''"
    )
    size = wanted.agg(F.sum(F.length("plain").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    for block in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item_id", "plain"), F.lit(blocks)) == block).distinct()
        chosen = sorted((tuple(r) for r in mine.collect()), key=str)  # about block_chars characters
        if chosen:
            yield chosen


def contaminated(
    docs: DataFrame, items: DataFrame, rate: float = 0.05, edits_from: int = 5, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for each document and the items found in it.

    ``distance`` is the least number of edits; ``start`` and ``end`` are positions in the plain text.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    result = docs.sparkSession.createDataFrame([], _MATCHES)
    for chosen in _blocks(items, block_chars):

        def found(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            search = _Search(chosen, rate, edits_from)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch[0], batch[1]):
                    if text.is_valid:
                        rows += [(doc_id.as_py(), *m) for m in search.matches(plain(text.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _ARROW)], schema=_ARROW)

        result = result.unionByName(texts.mapInArrow(found, _MATCHES))
    return result


def drop_contaminated(
    docs: DataFrame, items: DataFrame, rate: float = 0.05, edits_from: int = 5, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The rows of documents in which no item is found, each judged by its own text."""

    def holds(chosen: list[tuple[int, str]]):
        def judged(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            search = _Search(chosen, rate, edits_from)
            for batch in texts:
                yield batch.map(lambda t: t is not None and bool(search.matches(plain(t)))).astype(bool)

        return F.pandas_udf(judged, "boolean")

    for chosen in _blocks(items, block_chars):
        docs = docs.where(~holds(chosen)("text"))
    return docs
