"""Toxic clauses from a weighted finite-state grammar.

Small transducers each read the classes of a clause's words (insult, threat, target, negation,
reported speech, other) and keep one fact: was there a negation within three words, a verb of
reporting in the clause, a target within four words, a threat that still lacks its target? Their
composition is one table of states; run over a clause, it emits an event at each word that completes
a pattern: a plain or targeted insult, each also negated or reported, a threat at a target, or a
target that follows an insult. Events are summed per clause and clauses per document; a logistic
model gives each kind of event its weight, so what counts are matched clauses, not words.

The terminal symbols for insults are learned: words, and word beginnings of 4 to 6 bytes, that occur
in clearly more toxic than other documents of a sample of at most ``FIT_TOXIC`` toxic and
``FIT_OTHER`` other labelled documents. The other terminals are fixed lists. All documents are
scored, over their whole texts.

Edge cases: a null or empty text has no clauses and the lowest score; without usable labels of both
kinds every score is 0; documents that share a doc_id are scored each by its own text; a null doc_id
is never held out; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.labelled import sampled, sigmoid, steps
from twinsift.llm.words import mixed, ngrams, span_hashes, text_buffer, word_spans

FIT_TOXIC = 3000
FIT_OTHER = 9000
# Learned terminals at most; the strongest stay.
LEXICON = 4000
_EVIDENCE = 20.0
# Documents that agree in so many minimum hashes count as copies of one another when learning.
_MINIMA = 3
_BEGINNINGS = (4, 5, 6)

# Terminal symbols of the grammar in English, German, French and Spanish.
THREATS = "kill hurt destroy murder strangle töten umbringen vernichten tuer détruire frapper matar destruir golpear"
TARGETS = (
    "you your yours he she him her they them their people everyone du dich dir dein ihr euch sie er "
    "tu toi te ton vous votre il elle ils elles leur tú ti usted ustedes vosotros él ella ellos ellas"
)
NEGATIONS = "not never no none isn't aren't don't nicht kein keine nie ne pas jamais aucun nunca jamás ningún"
REPORTS = "said says say called wrote quoted claimed sagte nannte schrieb dit appelé écrit dijo llamó escribió"

_OTHER, _INSULT, _THREAT, _TARGET, _NEGATION, _REPORT = range(6)
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?;:"]] = True

# Events: insults by (targeted, negated, reported), threats by (negated, reported), late targets.
EVENTS = 8 + 4 + 1
_LATE = EVENTS - 1


class Transducer(NamedTuple):
    """``step[state][symbol]`` is the next state; state 0 is the first. What a transducer says of a
    word is its state before it."""

    step: list[list[int]]


def _countdown(length: int, *starts: int) -> Transducer:
    """States that say how many words a fact still holds after one of the symbols ``starts``."""
    return Transducer([[length if s in starts else max(0, k - 1) for s in range(6)] for k in range(length + 1)])


def compose(*machines: Transducer) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """One table of steps for all machines side by side, and the machines' states in each state."""
    states, known = [tuple(0 for _ in machines)], {tuple(0 for _ in machines): 0}
    table = []
    for state in states:  # grows as new states are found
        row = []
        for symbol in range(6):
            after = tuple(m.step[s][symbol] for m, s in zip(machines, state))
            if after not in known:
                known[after] = len(states)
                states.append(after)
            row.append(known[after])
        table.append(row)
    return np.array(table), states


_NEGATED = _countdown(3, _NEGATION)
_REPORTED = Transducer([[1 if s == _REPORT else 0 for s in range(6)], [1] * 6])
_TARGETED = _countdown(4, _TARGET)
_PENDING_THREAT = _countdown(4, _THREAT)
_PENDING_INSULT = _countdown(3, _INSULT)
_STEP, _STATES = compose(_NEGATED, _REPORTED, _TARGETED, _PENDING_THREAT, _PENDING_INSULT)


def _emitted(state: tuple[int, ...], symbol: int) -> int:
    """The event that a symbol completes, or -1."""
    negated, reported, targeted, threat, insult = (int(x > 0) for x in state)
    if symbol == _INSULT:
        return 4 * targeted + 2 * negated + reported
    if symbol == _TARGET and threat or symbol == _THREAT and targeted:
        return 8 + 2 * negated + reported
    if symbol == _TARGET and insult:
        return _LATE
    return -1


_EVENT = [[_emitted(state, symbol) for symbol in range(6)] for state in _STATES]


def _word_hashes(words: str) -> np.ndarray:
    buffer, bounds = text_buffer(pa.array([words]))
    starts, ends, _ = word_spans(buffer, bounds)
    return span_hashes(buffer, starts, ends, lower=True)


_FIXED = {
    int(h): symbol
    for symbol, words in ((_THREAT, THREATS), (_TARGET, TARGETS), (_NEGATION, NEGATIONS), (_REPORT, REPORTS))
    for h in _word_hashes(words)
}


class _Tokens:
    """Words of a text column without the punctuation around them, as hashes of whole words and of
    their beginnings."""

    def __init__(self, column):
        buffer, bounds = text_buffer(column)
        starts, ends, self.index = word_spans(buffer, bounds)
        last = buffer[ends - 1] if len(ends) else buffer[:0]
        closing = _ENDS[last]
        newlines = np.searchsorted(np.flatnonzero(buffer == 10), starts)
        closing[:-1] |= newlines[1:] != newlines[:-1]
        self.closing = closing
        for _ in range(4):
            ends = np.where((ends - starts > 1) & _PUNCTUATION[buffer[ends - 1]], ends - 1, ends) if len(ends) else ends
            starts = np.where((ends - starts > 1) & _PUNCTUATION[buffer[starts]], starts + 1, starts) if len(ends) else starts
        self.words = span_hashes(buffer, starts, ends, lower=True)
        self.beginnings = []
        for size in _BEGINNINGS:
            part = span_hashes(buffer, starts, np.minimum(ends, starts + size), lower=True)
            # A beginning is not the same terminal as a whole word of its spelling.
            self.beginnings.append(mixed(part + np.uint64(size)))
        self.long = [ends - starts >= size for size in _BEGINNINGS]

    def signature(self, a: int, b: int) -> int:
        """A number that near copies are likely to share: minimum hashes of the word 5-grams."""
        grams = ngrams(self.words[a:b], max(1, min(5, b - a)))
        return hash(tuple(int(mixed(grams ^ np.uint64(k)).min()) for k in range(_MINIMA))) if b > a else 0

    def features(self) -> list[np.ndarray]:
        """The distinct terminals that each text could hold."""
        out = []
        for a, b in zip(self.index[:-1], self.index[1:]):
            parts = [self.words[a:b]] + [p[a:b][long[a:b]] for p, long in zip(self.beginnings, self.long)]
            out.append(np.unique(np.concatenate(parts)))
        return out


class Lexicon(NamedTuple):
    """Sorted hashes of the insult terminals and how strongly each speaks for toxicity."""

    keys: np.ndarray
    strength: np.ndarray

    def of(self, tokens: _Tokens) -> np.ndarray:
        """Strength of each word, 0 if it is no terminal."""
        out = np.zeros(len(tokens.words))
        if not len(self.keys):
            return out
        low = np.zeros(1 << 16, dtype=bool)
        low[(self.keys & np.uint64(0xFFFF)).astype(int)] = True
        for hashes, long in [(tokens.words, None), *zip(tokens.beginnings, tokens.long)]:
            maybe = low[(hashes & np.uint64(0xFFFF)).astype(np.int32)]
            if long is not None:
                maybe &= long
            at = np.flatnonzero(maybe)
            place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            hit = self.keys[place] == hashes[at]
            out[at[hit]] = np.maximum(out[at[hit]], self.strength[place[hit]])
        return out


_THREAT_HASHES = np.sort(_word_hashes(THREATS))
N_FEATURES = 2 * EVENTS + 3


def clause_features(column, lexicon: Lexicon) -> np.ndarray:
    """A row per text: for each event the log of its summed strength, the most of it that one clause
    has, then the strongest clause, the log of the number of matched clauses, and their density."""
    tokens = _Tokens(column)
    strength = lexicon.of(tokens)
    n_docs = len(tokens.index) - 1
    sums, most = np.zeros((n_docs, EVENTS)), np.zeros((n_docs, EVENTS))
    strongest, matched = np.zeros(n_docs), np.zeros(n_docs)
    hits = np.flatnonzero((strength > 0) | np.isin(tokens.words, _THREAT_HASHES))
    if len(hits):
        ends = np.unique(np.concatenate((np.flatnonzero(tokens.closing) + 1, tokens.index[1:])))
        clauses = np.unique(np.searchsorted(ends, hits, "right"))
        for c in clauses:
            a, b = (ends[c - 1] if c else 0), ends[c]
            doc = int(np.searchsorted(tokens.index, a, "right")) - 1
            state, clause = 0, {}
            for h, s in zip(tokens.words[a:b].tolist(), strength[a:b].tolist()):
                symbol = _INSULT if s > 0 else _FIXED.get(h, _OTHER)
                event = _EVENT[state][symbol]
                if event >= 0:
                    clause[event] = clause.get(event, 0.0) + (s if symbol == _INSULT else 1.0)
                state = _STEP_ROWS[state][symbol]
            if clause:
                matched[doc] += 1
                total = 0.0
                for event, value in clause.items():
                    sums[doc, event] += value
                    most[doc, event] = max(most[doc, event], value)
                    total += value
                strongest[doc] = max(strongest[doc], total)
    words = np.maximum(np.diff(tokens.index), 1)
    return np.concatenate(
        (np.log1p(sums), most, strongest[:, None], np.log1p(matched)[:, None], (matched / np.sqrt(words))[:, None]), axis=1
    )


_STEP_ROWS = _STEP.tolist()


class Model(NamedTuple):
    lexicon: Lexicon
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column) -> np.ndarray:
        return sigmoid(clause_features(column, self.lexicon) / self.scale @ self.weights + self.bias)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge * len(y) / 100)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (y - p) - keep * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        change = np.linalg.solve(bend, slope)
        w += np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _learned_lexicon(sample: DataFrame) -> Lexicon:
    """Terminals with enough evidence (a likelihood ratio) for toxic documents of the sample.

    Near copies count once: else every word of a toxic document that was copied would qualify.
    """

    def terminals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            tokens = _Tokens(batch["text"])
            found = tokens.features()
            minima = [tokens.signature(a, b) for a, b in zip(tokens.index[:-1], tokens.index[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch["label"], pa.array(minima, pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))],
                names=["label", "minima", "terminals"],
            )

    unlike = sample.mapInArrow(terminals, "label int, minima long, terminals array<long>").dropDuplicates(["label", "minima"])
    totals = unlike.agg(F.sum("label"), F.count(F.lit(1))).first()
    toxic, every = float(totals[0]), float(totals[1])
    counted = (
        unlike.select("label", F.explode("terminals").alias("terminal"))
        .groupBy("terminal")
        .agg(F.sum("label").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("n"))
        .where("t >= 3")
    )
    share = toxic / every
    expected_t, expected_c = F.col("n") * share, F.col("n") * (1 - share)
    c = F.col("n") - F.col("t")
    evidence = 2 * (F.col("t") * F.log(F.col("t") / expected_t) + F.when(c > 0, c * F.log(c / expected_c)).otherwise(0.0))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (every - toxic + 1))
    best = (
        counted.select("terminal", evidence.alias("evidence"), odds.alias("odds"))
        .where((F.col("evidence") >= _EVIDENCE) & (F.col("odds") >= 2))
        .orderBy(F.desc("evidence"), "terminal")
        .limit(LEXICON)
        .collect()
    )
    keys = np.array([r.terminal for r in best], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Lexicon(keys[order], np.array([r.odds for r in best])[order] if best else np.zeros(0))


def learn(docs: DataFrame, labels: DataFrame, usable: Column) -> Model | None:
    """A model from the labels (doc_id, toxic) of documents for which ``usable`` holds."""
    sample = sampled(docs, labels, "toxic", {1: FIT_TOXIC, 0: FIT_OTHER}, usable).select("text", F.col("label").cast("int"))
    if sample.select("label").distinct().count() < 2:
        return None
    lexicon = _learned_lexicon(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = clause_features(batch["text"], lexicon)
            yield pa.RecordBatch.from_arrays(
                [batch["label"], pa.array([f.tobytes() for f in found], pa.binary())], names=["label", "features"]
            )

    got = sample.mapInArrow(rows, "label int, features binary").collect()
    got.sort(key=lambda r: (r.label, bytes(r.features)))
    x = np.array([np.frombuffer(r.features) for r in got])
    y = np.array([r.label for r in got], dtype=float)
    scale = np.maximum(x.std(axis=0), 1e-3)
    weights, bias = _logistic(x / scale, y)
    return Model(lexicon, scale, weights, bias)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels the registered query never learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with ``held_out``, ``score`` and ``predicted`` added or replaced."""
    model = learn(docs, labels, ~held_out())
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    scored = docs.select(*kept).withColumn("held_out", held_out()).withColumn("score", F.lit(0.0))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            value = model.scores(batch["text"])
            yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(value, pa.float64()))

    if model is not None:
        scored = scored.mapInArrow(scores, scored.schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
