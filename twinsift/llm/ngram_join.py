"""Documents whose word n-gram sets have a Jaccard similarity of at least a threshold.

The documents and their n-grams form a sparse 0/1 matrix; overlap counts are its product with its
own transpose. It is worked out in blocks of columns (buckets of n-grams), and what cannot reach the
threshold is discarded early, always by a bound that follows from the set sizes:

1. Each chunk of documents sends its distinct n-grams, packed, to the buckets, which say which of
   them occur in another chunk. A document of n n-grams can only have a partner if at least
   ``threshold * n`` of them occur in another document. This leaves copies and little else.
2. Documents with equal sets become one class. Of each class only the rarest n-grams matter, so
   many that any partner must share one (n minus the least overlap, plus one).
3. Classes that meet on such an n-gram, and whose sizes and positions allow the threshold, are
   compared exactly. First each class is compared only with the most typical class of each of its
   n-grams; then only classes that are not connected yet. So a dense group of near copies costs a
   few comparisons per class, while no link between different components can be missed.

Edge cases: a null or empty text has an empty set and no links; a text with fewer words than n has
one n-gram, its whole sequence; documents that share a doc_id are separate rows that may well be
linked; a null doc_id is never the smallest of a component unless all are null; other columns of
the input are not looked at.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.shared_keys import (
    COUNTS_SCHEMA,
    KEYS_SCHEMA,
    chunked,
    counted_everywhere,
    filed,
    flags_of,
    packed_counts,
    packed_keys,
    parts_of,
    seen_elsewhere,
    totals_of,
)
from twinsift.llm.words import hashed_words, ngrams
from twinsift.operators.components import connected_components
from twinsift.operators.skew import attach
from twinsift.session import checkpointed

_LAST_ID = (1 << 63) - 1
_ROWS_SCHEMA = "id long, n int, node binary, grams array<long>"
_RARE_SCHEMA = "node binary, n int, own int, grams array<long>"
# The ids of classes to compare, up to so many of 16 bytes, are broadcast to pick their sets.
BROADCAST_CLASSES = 1_000_000
# Classes that look for others on one n-gram in one task.
SLICE = 2048


def _sets(table: pa.Table, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    _, _, _, hashes, index = hashed_words(table["text"], lower=True)
    grams = ngrams(hashes, n)
    out = []
    for a, b in zip(index[:-1], index[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(ngrams(hashes[a:b], int(b - a), salt=int(b - a)) if b > a else hashes[:0])
    return out


def _located(sets: list[np.ndarray], parts: int):
    """Filed keys of all sets, the distinct ones, and which distinct key each is."""
    keys = filed(np.concatenate(sets) if sets else np.empty(0, np.uint64), parts)
    distinct, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, which, counts


def ngram_sets(docs: DataFrame, threshold: Fraction, n: int = 5, parts: int | None = None) -> DataFrame:
    """(id, n, node, grams) per document. ``node`` identifies the set; ``grams`` is there, once per
    set and chunk, where the set may have a partner, and null elsewhere."""
    parts = parts or parts_of(docs)
    texts = chunked(docs, parts)
    top, bottom = threshold.numerator, threshold.denominator

    def columns(table: pa.Table) -> pa.Table:
        distinct, _, _ = _located(_sets(table, n), parts)
        return packed_keys(table["chunk"][0].as_py(), distinct)

    def rows(table: pa.Table, answer: pa.Table) -> pa.Table:
        sets = _sets(table, n)
        distinct, which, counts = _located(sets, parts)
        shared = ((counts > 1) | flags_of(distinct, answer))[which]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        sums = np.concatenate(([0], np.cumsum(shared)))
        overlap = sums[ends[1:]] - sums[ends[:-1]]
        possible = (sizes > 0) & (overlap * bottom >= sizes * top)
        nodes, grams, known = [], [], set()
        for grams_of, ok in zip(sets, possible):
            node = hashlib.blake2b(grams_of.tobytes(), digest_size=16).digest() if len(grams_of) else None
            nodes.append(node)
            grams.append(grams_of.view(np.int64) if ok and node not in known else None)
            known.add(node)
        return pa.table(
            {
                "id": table["id"],
                "n": pa.array(sizes, pa.int32()),
                "node": pa.array(nodes, pa.binary()),
                "grams": pa.array(grams, pa.list_(pa.int64())),
            }
        )

    keys = texts.groupBy("chunk").applyInArrow(columns, KEYS_SCHEMA)
    return (
        texts.groupBy("chunk")
        .cogroup(seen_elsewhere(keys).groupBy("chunk"))
        .applyInArrow(rows, _ROWS_SCHEMA)
    )


def _rarest(sets: DataFrame, threshold: Fraction, parts: int) -> DataFrame:
    """(gram, node, n, place, own): of each class the n-grams among its rarest ones that another may
    have, so many that any partner must share one; ``place`` counts from the rarest, ``own`` is how
    many no other class has.

    N-grams are ordered by the number of classes that have them. Two that are filed alike count
    together, which is the same order for all classes and so changes no result.
    """
    top, bottom = threshold.numerator, threshold.denominator
    dealt = sets.select(F.pmod(F.xxhash64("node"), F.lit(parts).cast("long")).cast("int").alias("chunk"), "node", "grams")

    def distinct_sets(table: pa.Table) -> dict[bytes, np.ndarray]:
        grams = table["grams"].combine_chunks()
        flat, at = grams.flatten().to_numpy().view(np.uint64), 0
        out = {}
        for node, size in zip(table["node"].to_pylist(), np.diff(grams.offsets.to_numpy())):
            out.setdefault(node, flat[at : at + size])
            at += size
        return out

    def held(table: pa.Table) -> pa.Table:
        distinct, _, counts = _located(list(distinct_sets(table).values()), parts)
        return packed_counts(table["chunk"][0].as_py(), distinct, counts)

    def rare(table: pa.Table, answer: pa.Table) -> pa.Table:
        classes = distinct_sets(table)
        distinct, which, _ = _located(list(classes.values()), parts)
        frequency = totals_of(distinct, answer)[which]
        rows, at = [], 0
        for node, grams in classes.items():
            n = len(grams)
            df = frequency[at : at + n]
            at += n
            own = int(np.sum(df == 1))
            reach = n - -(-n * top // bottom) + 1
            if own < reach:
                chosen = np.lexsort((grams, df))[own:reach]
                rows.append({"node": node, "n": n, "own": own, "grams": grams[chosen].view(np.int64)})
        kinds = [("node", pa.binary()), ("n", pa.int32()), ("own", pa.int32()), ("grams", pa.list_(pa.int64()))]
        return pa.Table.from_pylist(rows, pa.schema(kinds))

    totals = counted_everywhere(dealt.groupBy("chunk").applyInArrow(held, COUNTS_SCHEMA))
    return (
        dealt.groupBy("chunk")
        .cogroup(totals.groupBy("chunk"))
        .applyInArrow(rare, _RARE_SCHEMA)
        .select("node", "n", "own", F.posexplode("grams").alias("place", "gram"))
        .withColumn("place", F.col("place") + F.col("own"))
    )


def _linked(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Those pairs (a, b) whose sets reach the threshold."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    small = wanted.count() <= BROADCAST_CLASSES
    sets = sets.join(F.broadcast(wanted) if small else wanted, "node", "left_semi").dropDuplicates(["node"])
    both = pairs.join(sets.toDF("a", "grams_a"), "a").join(sets.toDF("b", "grams_b"), "b")
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    union = F.size("grams_a") + F.size("grams_b") - common
    return both.where(common * threshold.denominator >= union * threshold.numerator).select("a", "b")


def _possible(threshold: Fraction):
    """Bound on the pairs x, y that meet on an n-gram: with all in common that follows it in both
    orders, would they reach the least overlap? A pair that links does so at least where it meets
    first, since nothing before that is common."""
    t = F.lit(threshold.numerator) / F.lit(threshold.numerator + threshold.denominator)
    after = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    return after >= t * (F.col("x.n") + F.col("y.n")) - F.lit(1e-6)


def _apart(labelled: DataFrame, threshold: Fraction, slice_rows: int = SLICE) -> DataFrame:
    """Pairs (a, b) of classes of different components that meet on an n-gram and may link.

    Two classes that are apart cannot both be of the largest component of their n-gram, and the
    smaller of two that may link could link with one of its own size there (a head). So only the
    classes outside the largest component look for others, and of each pair one must be a head. Those
    that look are dealt into slices, so an n-gram that many have is no single task.
    """
    t = F.lit(threshold.numerator) / F.lit(threshold.numerator + threshold.denominator)
    labelled = labelled.withColumn("head", F.col("n") - F.col("place") >= 2 * t * F.col("n") - F.lit(1e-6))
    grams = (
        labelled.groupBy("gram", "component")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("head").alias("head"))
        .groupBy("gram")
        .agg(F.sum("rows").alias("rows"), F.max(F.struct("rows", "component")).alias("largest"), F.max("head").alias("any"))
        .where("rows > largest.rows and any")
        .select("gram", "rows", F.col("largest.component").alias("largest"), (F.col("rows") - F.col("largest.rows")).alias("looking"))
    )
    met = checkpointed(
        attach(labelled, grams, ["gram"], ["node"], counts="rows").withColumn(
            "slices", F.ceil(F.col("looking") / slice_rows).cast("int")
        )
    )
    looking = met.where("component <> largest").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    others = met.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        return (
            x.alias("x")
            .join(y.alias("y"), ["gram", "slice"])
            .where("x.component <> y.component")
            .where(_possible(threshold))
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        )

    found = pairs(others, looking.where("head")).unionByName(pairs(others.where("head"), looking.where("not head")))
    return found.distinct()


def links(sets: DataFrame, threshold: Fraction, parts: int) -> DataFrame:
    """Links (a, b) between classes (node, grams) that connect all that similarity connects. Rows of
    one class may repeat.

    Every link reaches the threshold. Two classes that do but are left out are connected by others.
    """
    entries = checkpointed(_rarest(sets, threshold, parts))
    typical = entries.groupBy("gram").agg(
        F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "node", "n", "place", "own")).alias("y")
    )
    x = entries.alias("x")
    near = checkpointed(
        x.join(typical.select("gram", "y.*").alias("y"), "gram")
        .where(F.col("x.node") != F.col("y.node"))
        .where(_possible(threshold))
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        .distinct()
    )
    first = checkpointed(_linked(near, sets, threshold))
    groups = connected_components(first.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    labelled = checkpointed(
        entries.join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )
    )
    apart = _apart(labelled, threshold)
    rest = checkpointed(apart.join(near, ["a", "b"], "left_anti"))
    return first.unionByName(_linked(rest, sets, threshold))


def similar_documents(
    docs: DataFrame, threshold: Fraction = Fraction(3, 4), n: int = 5, parts: int | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document; component_id is the smallest doc_id that
    links between documents reach, its own included."""
    parts = parts or parts_of(docs)
    rows = checkpointed(ngram_sets(docs, threshold, n, parts))
    classes = checkpointed(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least")))
    found = checkpointed(links(rows.where("grams is not null").select("node", "grams"), threshold, parts))
    groups = connected_components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = (
        classes.select("node", "least")
        .join(groups.withColumnRenamed("id", "node"), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "component").select("node", "component_id")
    known = F.col("id") != F.lit(_LAST_ID)
    return rows.select("id", "n", "node").join(labels, "node", "left").select(
        F.when(known, F.col("id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.nullif(F.coalesce("component_id", "id"), F.lit(_LAST_ID)).alias("component_id"),
    )
