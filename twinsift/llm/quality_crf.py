"""Document quality from a linear-chain conditional random field over lines.

Each line that is not blank is a node with a label, good or bad. Its features are threshold tests on
counts of its characters and words, and the same tests on the lines before and after it. Forward and
backward messages give each line's marginal probability of being good; a document's score is their
mean, weighted by line length.

The model is fitted on the driver from at most ``FIT_DOCS`` documents of each label, of those with at
most ``FIT_LINES`` lines; every line of such a document carries the document's label. Only the packed
features of this sample leave the executors. All documents are scored, over their whole texts.

Edge cases: a null, empty or blank text is one empty line and is scored like any other; without
usable labels of both kinds every score is 0.5; documents that share a doc_id are scored each by its
own text; a null doc_id is never held out; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.labelled import sampled, sigmoid, steps
from twinsift.llm.words import span_hashes, text_buffer, word_spans

FIT_DOCS = 2000
FIT_LINES = 512
_ROUNDS = 200

_UPPER, _LETTER, _DIGIT, _STOP, _SYMBOL = range(5)
_KINDS = np.zeros((256, 5), dtype=bool)
_KINDS[65:91, _UPPER] = True
_KINDS[65:91, _LETTER] = _KINDS[97:123, _LETTER] = True
_KINDS[0xC3:0xF5, _LETTER] = True  # first bytes of longer characters
_KINDS[48:58, _DIGIT] = True
_KINDS[[ord(c) for c in ".,;:?'\"-()"], _STOP] = True
_KINDS[33:127, _SYMBOL] = True
_KINDS[:, _SYMBOL] &= ~(_KINDS[:, _LETTER] | _KINDS[:, _DIGIT] | _KINDS[:, _STOP])
_SHARES = (0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.8)
_TESTS = {
    "upper": _SHARES,
    "letter": (0.5, 0.7, 0.8, 0.9, 0.95),
    "digit": _SHARES,
    "stop": (0.005, 0.02, 0.05, 0.1, 0.2),
    "symbol": _SHARES,
    "marked": _SHARES,
    "shouted": _SHARES,
    "repeated": _SHARES,
    "near": _SHARES,
    "single": _SHARES,
    "word": (2.0, 3.0, 4.0, 5.0, 6.5, 8.0, 11.0),
    "words": (1, 2, 4, 8, 16, 32, 64, 128, 256),
    "ended": (0.5,),
    "begun": (0.5,),
}
N_TESTS = sum(map(len, _TESTS.values()))


class Lines(NamedTuple):
    tests: np.ndarray  # a row of 0 and 1 per line
    length: np.ndarray  # bytes that are not blank, at least 1
    index: np.ndarray  # each document's first line, and the number of all lines


def lines_of(column) -> Lines:
    """The lines of each text and what the threshold tests say of them."""
    buffer, bounds = text_buffer(column)
    starts, ends, words_at = word_spans(buffer, bounds)
    newline = np.flatnonzero(buffer == 10)
    # Words of one line have the same number of newlines and texts before them.
    doc = np.searchsorted(bounds, starts, "right") - 1
    row = np.searchsorted(newline, starts)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n_words = np.diff(np.append(first, len(starts)))
    # Texts without words have one line without words.
    blank = np.flatnonzero(np.diff(words_at) == 0)
    per_doc = np.bincount(doc[first], minlength=len(bounds) - 1)
    per_doc[blank] = 1
    index = np.concatenate(([0], np.cumsum(per_doc)))
    place = np.delete(np.arange(index[-1]), index[blank]) if len(blank) else np.arange(index[-1])
    n = int(index[-1])

    def per_line(of_words: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(first):
            out[place] = np.add.reduceat(of_words.astype(np.float64), first)
        return out

    def of_bytes(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, dtype=np.int32)
        np.cumsum(mask, out=sums[1:], dtype=np.int32)
        return sums[ends] - sums[starts]

    length = ends - starts
    hashes = span_hashes(buffer, starts, ends, lower=True)
    line_of_word = np.cumsum(new)
    repeated = np.zeros(len(starts), dtype=bool)
    repeated[1:] = (hashes[1:] == hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    near = np.zeros(len(starts), dtype=bool)
    for k in range(2, 9):
        near[k:] |= (hashes[k:] == hashes[:-k]) & (line_of_word[k:] == line_of_word[:-k])
    upper, letter, digit, stop, symbol = (of_bytes(_KINDS[buffer, k]) for k in range(5))
    last, begin = buffer[ends - 1], buffer[starts]
    total = per_line(length)
    count = per_line(np.ones(len(starts)))
    size, number = np.maximum(total, 1), np.maximum(count, 1)
    values = {
        "upper": per_line(upper) / np.maximum(per_line(letter), 1),
        "letter": per_line(letter) / size,
        "digit": per_line(digit) / size,
        "stop": per_line(stop) / size,
        "symbol": per_line(symbol) / size,
        "marked": per_line(_KINDS[last, _SYMBOL]) / number,
        "shouted": per_line((upper >= 2) & (upper == letter)) / number,
        "repeated": per_line(repeated) / number,
        "near": per_line(near) / number,
        "single": per_line(length == 1) / number,
        "word": total / number,
        "words": count,
    }
    ended, begun = np.zeros(n), np.zeros(n)
    if len(first):
        ended[place] = np.isin(last[first + n_words - 1], [ord(c) for c in ".!?"])
        begun[place] = _KINDS[begin[first], _UPPER] | (begin[first] >= 0xC3)
    values |= {"ended": ended, "begun": begun}
    tests = np.stack([values[name] > t for name, cuts in _TESTS.items() for t in cuts], axis=1)
    return Lines(tests, np.maximum(total, 1), index)


def with_neighbours(tests: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Each line's tests, those of the lines before and after it, whether there are any, and a 1."""
    n, width = tests.shape
    out = np.zeros((n, 3 * width + 3), dtype=np.float32)
    out[:, :width] = tests
    head, tail = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    head[index[:-1]] = True
    tail[index[1:] - 1] = True
    out[1:, width : 2 * width] = tests[:-1]
    out[head, width : 2 * width] = 0
    out[:-1, 2 * width : 3 * width] = tests[1:]
    out[tail, 2 * width : 3 * width] = 0
    out[:, -3], out[:, -2], out[:, -1] = head, tail, 1
    return out


def messages(unary: np.ndarray, index: np.ndarray, moves: np.ndarray):
    """Log odds for good of the forward message, which includes the line itself, and of the backward
    message of each line. ``moves`` has the score of each label (bad 0, good 1) after each."""
    forward, backward = unary.copy(), np.zeros(len(unary))
    sizes = np.diff(index)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = index[:-1][order], sizes[order]
    for t in range(1, int(sizes[0]) if len(sizes) else 0):
        here = starts[: np.searchsorted(-sizes, -t)] + t
        m = forward[here - 1]
        forward[here] += np.logaddexp(m + moves[1, 1], moves[0, 1]) - np.logaddexp(m + moves[1, 0], moves[0, 0])
    for t in range(int(sizes[0]) - 2 if len(sizes) else -1, -1, -1):
        here = starts[: np.searchsorted(-sizes, -(t + 1))] + t
        m = unary[here + 1] + backward[here + 1]
        backward[here] = np.logaddexp(moves[1, 1] + m, moves[1, 0]) - np.logaddexp(moves[0, 1] + m, moves[0, 0])
    return forward, backward


class Model(NamedTuple):
    weights: np.ndarray
    moves: np.ndarray

    def scores(self, column) -> np.ndarray:
        """The score of each text of a column."""
        lines = lines_of(column)
        unary = with_neighbours(lines.tests, lines.index).astype(np.float64) @ self.weights
        forward, backward = messages(unary, lines.index, self.moves)
        good = sigmoid(forward + backward)
        heads = lines.index[:-1]
        return np.add.reduceat(good * lines.length, heads) / np.add.reduceat(lines.length, heads)


def fit(tests: np.ndarray, index: np.ndarray, good: np.ndarray, rounds: int = _ROUNDS, ridge: float = 1e-3) -> Model:
    """Maximum conditional likelihood of label sequences (``good`` has 0 or 1 per line) by Adam."""
    x = with_neighbours(tests, index)
    n_docs = len(index) - 1
    weights, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(good), dtype=bool)
    inner[index[1:] - 1] = False
    now = np.flatnonzero(inner)
    # Each document weighs the same, whatever its number of lines.
    sizes = np.diff(index)
    weigh = np.repeat(1 / sizes, sizes)
    seen = np.array([[np.sum(weigh[now] * (good[now] == a) * (good[now + 1] == b)) for b in (0, 1)] for a in (0, 1)])
    steps_, squares = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for t in range(1, rounds + 1):
        unary = (x @ weights.astype(np.float32)).astype(np.float64)
        forward, backward = messages(unary, index, moves)
        error = (good - sigmoid(forward + backward)) * weigh
        after = unary[now + 1] + backward[now + 1]
        joint = np.stack(
            [forward[now] * a + moves[a, b] + after * b for a in (0, 1) for b in (0, 1)], axis=1
        )
        joint = np.exp(joint - joint.max(axis=1, keepdims=True)) if len(now) else joint
        joint = (joint / joint.sum(axis=1, keepdims=True) * weigh[now][:, None]).sum(axis=0).reshape(2, 2)
        slope = np.concatenate((x.T @ error.astype(np.float32), (seen - joint).ravel())) / n_docs
        slope -= ridge * np.concatenate((weights, moves.ravel()))
        steps_ = 0.9 * steps_ + 0.1 * slope
        squares = 0.99 * squares + 0.01 * slope**2
        change = 0.1 * (steps_ / (1 - 0.9**t)) / (np.sqrt(squares / (1 - 0.99**t)) + 1e-8)
        weights += change[:-4]
        moves = moves + change[-4:].reshape(2, 2)
    return Model(weights, moves)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, number of lines and packed tests of each document that is not too long to fit on."""
    for batch in steps(batches):
        lines = lines_of(batch["text"])
        rows = [
            {"label": label, "lines": int(b - a), "tests": np.packbits(lines.tests[a:b]).tobytes()}
            for label, a, b in zip(batch["label"].to_pylist(), lines.index[:-1], lines.index[1:])
            if b - a <= FIT_LINES
        ]
        yield pa.RecordBatch.from_pylist(
            rows, pa.schema([("label", pa.int32()), ("lines", pa.int32()), ("tests", pa.binary())])
        )


def learn(docs: DataFrame, labels: DataFrame, usable: Column, fit_docs: int = FIT_DOCS) -> Model | None:
    """A model from the labels (doc_id, quality) of documents for which ``usable`` holds."""
    some = sampled(docs, labels, "quality", {0: fit_docs, 1: fit_docs}, usable)
    rows = some.select("text", F.col("label").cast("int")).mapInArrow(_packed, "label int, lines int, tests binary").collect()
    rows.sort(key=lambda r: (r.label, r.lines, bytes(r.tests)))
    if len({r.label for r in rows}) < 2:
        return None
    unpacked = [
        np.unpackbits(np.frombuffer(r.tests, np.uint8), count=r.lines * N_TESTS).reshape(r.lines, N_TESTS) for r in rows
    ]
    index = np.concatenate(([0], np.cumsum([r.lines for r in rows])))
    good = np.repeat([float(r.label) for r in rows], [r.lines for r in rows])
    return fit(np.concatenate(unpacked), index, good)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels the registered query never learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """The documents with ``held_out``, ``score`` and ``predicted`` added or replaced."""
    model = learn(docs, labels, ~held_out(), fit_docs)
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    scored = docs.select(*kept).withColumn("held_out", held_out()).withColumn("score", F.lit(0.5))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            value = model.scores(batch["text"])
            yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(value, pa.float64()))

    if model is not None:
        scored = scored.mapInArrow(scores, scored.schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
