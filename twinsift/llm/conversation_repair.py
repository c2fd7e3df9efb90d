"""Cheapest repair of the turn structure of conversations, once per distinct suffix of their signatures.

A row counts by the initial of its role and by its first fault: blank, duplicate or truncated. So a
conversation is a word over nine symbols, runs of rows that must go counting as one symbol with a length.
Words are sorted by their reversed form, which brings those with a common suffix together, and a task
walks them along one path of the suffix-shared automaton: a node is a distinct suffix, made when the walk
first reaches it, with the cost-to-go and the first edit of the best audit for every grammar state. The
grammar ``(s?(ua)+)?`` has four states (start, after s, after u, after a), and in a state every edit leads
to just one state, so the least letter decides between equal costs and audits are read off the nodes.

Rows are range-sorted by conversation, so one that holds most of all rows is spread over tasks. It is
cut into chunks of a bounded number of rows: the last chunk has costs-to-go, the others costs and audits
from each state to each state, which are chained from the end. Only the digest of the repaired text, one
sequence by definition, streams the rows of a conversation through one task, in sorted order.

Edge cases: a null role or text counts as one blank; a null conv_id is a conversation of its own; a null
turn comes first; rows with the same turn go by role and by the SHA-256 of the text; identical rows are
one row with a count, and all but the first are duplicates; a role of another initial than s, u, a can
only be re-roled or deleted; a conversation without rows has zeros, an empty audit and the empty string's
digest; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.operators.skew import attach
from twinsift.session import checkpointed, ship_package

# Distinct rows of a conversation that one chunk holds at most.
CHUNK = 1_024
# A signature of fewer chunks is never split.
HOT_CHUNKS = 50

# Costs of the edits and of leaving a truncated row.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

_START, _AFTER_S, _AFTER_U, _AFTER_A = range(4)
_STATES = 4
_FAR = 1 << 60
# The state after a row of this initial; inserting and re-roling can give u and a only.
_NEXT = {
    "s": {_START: _AFTER_S},
    "u": {_START: _AFTER_U, _AFTER_S: _AFTER_U, _AFTER_A: _AFTER_U},
    "a": {_AFTER_U: _AFTER_A},
}
_GIVEN = {_START: _AFTER_U, _AFTER_S: _AFTER_U, _AFTER_A: _AFTER_U, _AFTER_U: _AFTER_A}
_ROLE = {_AFTER_U: "user", _AFTER_A: "assistant"}
# Insertions in a row are tried this often: one more leads back to where it began.
_INSERTIONS = 3


# ---- the automaton


class Node:
    """A distinct suffix: per grammar state the cost-to-go and the edit (letter, next state, stays)."""

    __slots__ = ("below", "cost", "edit")

    def __init__(self, below: Node | None):
        self.below = below
        self.cost = [_FAR] * _STATES
        self.edit: list[tuple | None] = [None] * _STATES

    def offer(self, state: int, cost: int, letter: str, then: int, stays: bool = False) -> None:
        if cost < self.cost[state] or (cost == self.cost[state] < _FAR and letter < self.edit[state][0]):
            self.cost[state], self.edit[state] = cost, (letter, then, stays)

    def insert(self) -> None:
        for _ in range(_INSERTIONS):
            for state, then in _GIVEN.items():
                if self.cost[then] < _FAR:
                    self.offer(state, self.cost[then] + INSERT, "I", then, True)


def end_node(target: int | None) -> Node:
    """The empty suffix: of a conversation (insertions may still follow), or of a chunk that has to
    leave the grammar in the state ``target``."""
    node = Node(None)
    for state in (_START, _AFTER_A) if target is None else (target,):
        node.cost[state], node.edit[state] = 0, ("", state, False)
    if target is None:
        node.insert()
    return node


def node_before(symbol: str, below: Node) -> Node:
    """The node of ``symbol`` followed by the suffix ``below``."""
    node = Node(below)
    if symbol[0] == "D":
        times = int(symbol[1:])
        for state in range(_STATES):
            if below.cost[state] < _FAR:
                node.offer(state, below.cost[state] + DELETE * times, "D" * times, state)
    else:
        extra = TRUNCATED if symbol[0].isupper() else 0
        initial = symbol[0].lower()
        for state in range(_STATES):
            if below.cost[state] < _FAR:
                node.offer(state, below.cost[state] + DELETE, "D", state)
            then = _NEXT.get(initial, {}).get(state)
            if then is not None and below.cost[then] < _FAR:
                node.offer(state, below.cost[then] + extra, "K", then)
            then = _GIVEN[state]
            if below.cost[then] < _FAR:
                node.offer(state, below.cost[then] + extra + REROLE, "R", then)
    node.insert()
    return node


def audit(node: Node, state: int) -> str:
    """The best audit from a state on."""
    out = []
    while node is not None and node.edit[state] is not None:
        letter, then, stays = node.edit[state]
        out.append(letter)
        state = then
        if not stays:
            node = node.below
    return "".join(out)


def walk(endings: Iterator[tuple[bool, str]]) -> Iterator[tuple[bool, str, list[int], list[str]]]:
    """(last, ending, costs, audits) of sorted endings; an ending is a word's symbols from its end on.

    For the last chunk of a conversation there is one entry per state; for others one per state and
    target state. Only the nodes of the current path are kept.
    """
    path: list[str] = []
    stacks: list[list[Node]] = []
    current = None
    for last, ending in endings:
        symbols = ending.split(" ") if ending else []
        if last != current:
            current, path = last, []
            stacks = [[end_node(t)] for t in ((None,) if last else range(_STATES))]
        same = 0
        while same < min(len(path), len(symbols)) and path[same] == symbols[same]:
            same += 1
        for stack in stacks:
            del stack[same + 1 :]
            for symbol in symbols[same:]:
                stack.append(node_before(symbol, stack[-1]))
        path = symbols
        tops = [stack[-1] for stack in stacks]
        found = [(top.cost[state], audit(top, state) if top.cost[state] < _FAR else "") for state in range(_STATES) for top in tops]
        yield last, ending, [c for c, _ in found], [a for _, a in found]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            yield from zip(batch["last"].to_pylist(), batch["ending"].to_pylist())

    out: list[tuple] = []
    size = 0

    def made():
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.list_(pa.string()))],
            names=["last", "ending", "costs", "audits"],
        )

    for row in walk(rows()):
        out.append(row)
        size += sum(map(len, row[3]))
        if len(out) >= 5_000 or size > 1 << 22:
            yield made()
            out, size = [], 0
    if out:
        yield made()


# ---- rows and chunks


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after the fixed damage of the check, with ``times`` in place of repeated rows."""
    drawn = F.crc32(F.concat(_text(F.col("conv_id")), F.lit(":"), _text(F.col("turn")))) % 20
    return (
        conversations.withColumn("__drawn", drawn)
        .where("__drawn <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("__drawn") == 4, F.lit("user")).otherwise(_text(F.col("role"))).alias("role"),
            F.when(F.col("__drawn") == 1, F.lit(""))
            .when(F.col("__drawn") == 2, F.translate(_text(F.col("text")), ".!?", ""))
            .otherwise(_text(F.col("text")))
            .alias("text"),
            F.when(F.col("__drawn") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("times"),
        )
    )


def _conv_key(column: Column) -> Column:
    """A text that no two conversations share, the one without an id included."""
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), column.cast("string")))


_ORDER = ["conv", "has_turn", "turn", "role", "digest"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(
        _conv_key(F.col("conv_id")).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        _text(F.col("role")).alias("role"),
        _text(F.col("text")).alias("text"),
        F.coalesce(F.col("times"), F.lit(1)).cast("long").alias("times"),
    )


_CHUNKS = (
    "conv string, part long, seq long, ending string, head string, tail string, first_turn long, last_turn long, "
    "turns long, blank long, duplicate long, truncated long, illegal long"
)
_LEGAL = {"su", "ua", "au"}


def _chunked(batches: Iterator[pa.RecordBatch], chunk_rows: int) -> Iterator[pa.RecordBatch]:
    """One row per chunk of the sorted rows of this partition."""
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    out: list[tuple] = []
    held: list[tuple] = []

    def close():
        nonlocal seq
        symbols: list[str] = []
        gone = blank = duplicate = truncated = illegal = turns = 0
        before = last_turn = None
        for _, has_turn, turn, initial, fault, times in held:
            must_go = times if fault in "bd" else times - 1
            if fault == "b":
                blank += times
            elif fault == "d":
                duplicate += times
            else:
                duplicate += times - 1
                truncated += fault == "t"
                if gone:
                    symbols.append(f"D{gone}")
                    gone = 0
                kind = initial if initial in ("s", "u", "a") else "o"
                symbols.append(kind.upper() if fault == "t" else kind)
            gone += must_go
            illegal += times - 1 + (before is not None and before + initial not in _LEGAL)
            before = initial
            if has_turn and turn != last_turn:
                turns, last_turn = turns + 1, turn
        if gone:
            symbols.append(f"D{gone}")
        dated = [r[2] for r in held if r[1]]
        out.append(
            (held[0][0], part, seq, " ".join(reversed(symbols)), held[0][3], held[-1][3], dated[0] if dated else None,
             dated[-1] if dated else None, turns, blank, duplicate, truncated, illegal)
        )
        seq += 1
        held.clear()

    schema = pa.schema(
        [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _CHUNKS.split(", ")]
    )

    def made():
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        for row in zip(*[batch[c].to_pylist() for c in ("conv", "has_turn", "turn", "initial", "fault", "times")]):
            if held and (held[0][0] != row[0] or len(held) >= chunk_rows):
                close()
            held.append(row)
        if len(out) >= 2_000:
            yield made()
    if held:
        close()
    if out:
        yield made()


def _faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with their first fault and how often they stand there."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = rows.select(
        "conv", "has_turn", "turn", "role", F.sha2("text", 256).alias("digest"), "times",
        F.when(last == "", F.lit("b")).when(~last.isin(".", "!", "?"), F.lit("t")).otherwise(F.lit("k")).alias("fault"),
    )
    distinct = checkpointed(narrow.groupBy(*_ORDER, "fault").agg(F.sum("times").alias("times")))
    said = (
        distinct.groupBy("conv", "role", "digest")
        .agg(F.min(F.struct("has_turn", "turn")).alias("first"), F.count(F.lit(1)).alias("held"))
        .where("held > 1")
    )
    marked = attach(distinct, said, ["conv", "role", "digest"], ["turn"], how="left", counts="held")
    again = F.col("first").isNotNull() & (F.struct("has_turn", "turn") > F.col("first"))
    return marked.select(
        *_ORDER, F.substring("role", 1, 1).alias("initial"), "times",
        F.when(again & (F.col("fault") != "b"), F.lit("d")).otherwise(F.col("fault")).alias("fault"),
    )


def _chosen(table: pa.Table) -> pa.Table:
    """The states in which the chunks of one conversation begin and end, chained from the last chunk."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    to_go = rows[-1]["costs"]
    ends: list[list[int]] = []
    for r in reversed(rows[:-1]):
        cost, end = [], []
        for state in range(_STATES):
            options = [(r["costs"][state * _STATES + t] + to_go[t], r["ranks"][state * _STATES + t], t) for t in range(_STATES)]
            cost.append(min(options)[0])
            end.append(min(options)[2])
        to_go = cost
        ends.append(end)
    picks, state = [], _START
    for end in reversed(ends):
        picks.append(state * _STATES + end[state])
        state = end[state]
    picks.append(state)
    return pa.table(
        {
            "conv": pa.array([r["conv"] for r in rows], pa.string()),
            "part": pa.array([r["part"] for r in rows], pa.int64()),
            "seq": pa.array([r["seq"] for r in rows], pa.int64()),
            "pick": pa.array(picks, pa.int32()),
            "total": pa.array([to_go[_START]] * len(rows), pa.int64()),
        }
    )


def audits(rows: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation with rows.

    ``rows`` has conv, has_turn, turn, role, text and times.
    """
    ship_package(rows.sparkSession)
    spread = _faults(rows).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    # The rows lie in sorted order over the partitions, so (part, seq) is the order of the chunks.
    chunks = checkpointed(
        spread.select("conv", "has_turn", "turn", "initial", "fault", "times").mapInArrow(
            lambda batches: _chunked(batches, chunk_rows), _CHUNKS
        )
    )
    along = Window.partitionBy("conv").orderBy("part", "seq")
    chunks = checkpointed(
        chunks.withColumn("last", F.lead("seq").over(along).isNull())
        .withColumn("alone", F.col("last") & F.lag("seq").over(along).isNull())
        .withColumn("seam", F.concat(F.lag("tail").over(along), F.col("head")))
        .withColumn(
            "turn_before",
            F.last("last_turn", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)),
        )
    )
    words = chunks.groupBy("last", "ending").agg(F.count(F.lit(1)).alias("chunks"))
    solved = words.repartitionByRange("last", "ending").sortWithinPartitions("last", "ending")
    solved = solved.select("last", "ending").mapInArrow(_solved, "last boolean, ending string, costs array<long>, audits array<string>")
    solved = solved.join(words, ["last", "ending"])
    # A signature that more chunks have than a task gets on average is split.
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot_rows = max(HOT_CHUNKS, chunks.count() // tasks)
    answered = attach(chunks, solved, ["last", "ending"], ["conv"], counts="chunks", hot_rows=hot_rows)
    answered = checkpointed(answered.drop("chunks"))
    # Between equal costs from one state, the least audit of the first chunk decides; none begins another.
    ranks = F.transform(
        "audits",
        lambda a, i: F.size(
            F.filter("audits", lambda b, j: (F.floor(j / _STATES) == F.floor(i / _STATES)) & (b < a))
        ),
    )
    several = answered.where("NOT alone").select("conv", "part", "seq", "costs", ranks.alias("ranks"))
    picked = several.groupBy("conv").applyInArrow(lambda table: _chosen(table), "conv string, part long, seq long, pick int, total long")
    parts = answered.join(picked, ["conv", "part", "seq"], "left").select(
        "conv", "part", "seq", "turns", "first_turn", "last_turn", "turn_before", "blank", "duplicate", "truncated", "illegal", "seam",
        F.element_at("audits", F.coalesce("pick", F.lit(_START)) + 1).alias("audit"),
        F.coalesce("total", F.element_at("costs", _START + 1)).alias("cost"),
    )
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"]))
    turns = F.sum(F.col("turns") - F.coalesce((F.col("first_turn") == F.col("turn_before")).cast("long"), F.lit(0)))
    gap = F.max("last_turn").cast("decimal(38,0)") - F.min("first_turn") + 1 - turns
    return parts.groupBy("conv").agg(
        F.coalesce(gap.cast("long"), F.lit(0).cast("long")).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.count_if(F.col("seam").isNotNull() & ~F.col("seam").isin(*sorted(_LEGAL)))).alias("illegal"),
        F.max("cost").alias("cost"),
        joined.alias("audit"),
    )


# ---- the repaired text


def repaired_lines(edits: str, rows: Iterator[tuple[str, str, int]]) -> Iterator[str]:
    """The lines ``role:text`` of a repaired conversation from its audit and its rows (role, text, times)."""
    state, at = _START, 0

    def inserted():
        nonlocal state, at
        while at < len(edits) and edits[at] == "I":
            state = _GIVEN[state]
            at += 1
            yield f"{_ROLE[state]}:"

    for role, text, times in rows:
        yield from inserted()
        letter = edits[at]
        at += times  # all but the first of identical rows are deleted
        if letter == "K":
            state = _NEXT[role[0]][state]
            yield f"{role}:{text}"
        elif letter == "R":
            state = _GIVEN[state]
            yield f"{_ROLE[state]}:{text}"
    yield from inserted()


_OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, from its audit row followed by its rows in order."""

    def records():
        for batch in batches:
            yield from batch.to_pylist()

    schema = pa.schema(
        [("conv_id", pa.string()), *[(c, pa.int64()) for c in _OUT[1:-1]], ("audit", pa.string()), ("repaired_sha256", pa.string())]
    )
    stream = records()
    ahead = next(stream, None)
    out: list[dict] = []
    while ahead is not None:
        head = ahead

        def own_rows(conv=head["conv"]):
            nonlocal ahead
            ahead = next(stream, None)
            while ahead is not None and ahead["conv"] == conv:
                yield ahead["role"], ahead["text"], ahead["times"]
                ahead = next(stream, None)

        digest, first = hashlib.sha256(), True
        for line in repaired_lines(head["audit"], own_rows()):
            digest.update(("" if first else "\n").encode() + line.encode())
            first = False
        out.append({c: head[c] for c in _OUT} | {"repaired_sha256": digest.hexdigest()})
        if len(out) >= 2_000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def repair(rows: DataFrame, conversations: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """The contract's columns for each conv_id of ``conversations``; ``rows`` are their (conv_id, turn,
    role, text, times) as they are to be repaired."""
    ship_package(rows.sparkSession)
    keyed = _keyed(rows)
    ids = conversations.select("conv_id").distinct().withColumn("conv", _conv_key(F.col("conv_id")))
    kind = dict(ids.dtypes)["conv_id"]
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    heads = ids.join(audits(keyed, chunk_rows), "conv", "left").select(
        "conv", F.col("conv_id").cast("string").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zeros],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.lit(0).alias("kind"), F.lit(False).alias("has_turn"), F.lit(0).cast("long").alias("turn"),
        F.lit("").alias("role"), F.lit("").alias("digest"), F.lit("").alias("text"), F.lit(0).cast("long").alias("times"),
    )
    # Identical rows are one before they are shuffled to their conversation.
    distinct = keyed.groupBy("conv", "has_turn", "turn", "role", "text").agg(F.sum("times").alias("times"))
    lines = distinct.select(
        "conv", F.lit(None).cast("string").alias("conv_id"), *[F.lit(None).cast("long").alias(c) for c in zeros],
        F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind"), "has_turn", "turn", "role",
        F.sha2("text", 256).alias("digest"), "text", "times",
    )
    stream = (
        heads.unionByName(lines)
        .repartition("conv")
        .sortWithinPartitions("conv", "kind", "has_turn", "turn", "role", "digest")
    )
    found = stream.mapInArrow(
        _hashed, "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))
