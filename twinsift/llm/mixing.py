"""Mix sources to target weights with hash thresholds, without sorting documents.

Each source gets a share of all words by weight, but at most ``most`` times its own words; what is
over is shared again by weight. A source is then repeated as a whole as often as its target allows,
and for the rest of its budget it gives the documents whose hash lies under a threshold. The
threshold is found from histograms of words per (source, hash bucket): the bucket in which the
running sum passes the budget is the only one that is refined, by the next bits of the hash, until
it holds a single hash. Only histogram rows are ever ordered, at most 4096 per source and level.

Edge cases: a null or empty text has size 0 and takes 0; a null source is a source like any other,
ranked last; rows that agree in doc_id and text share a hash, and of those at the threshold as many go
as the budget takes; a source without words has target 0; a null doc_id is told from an id by its hash;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.operators.skew import attach, global_index, rank_within
from twinsift.session import checkpointed

_BITS = 60
_LEVEL_BITS = 12
_WORD = r"[^\x20\x09-\x0D]+"


def _whole(column) -> F.Column:
    return F.col(column).cast("decimal(38,0)")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``target`` for each row (source, source_size): its share of all words by weight, capped.

    Weights go to the sources in code point order, null last, and repeat.
    """
    marked = sizes.withColumn("__last", F.col("source").isNull())
    ranked = global_index(marked, ["__last", "source"], "rank").withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    ranked = checkpointed(
        ranked.select("source", "source_size", "weight", (F.col("source_size") * most).alias("cap"))
    )
    full = F.lit(False)
    settled = -1
    while True:
        # What the full sources leave, shared by the weights of the others.
        rest = ranked.agg(
            F.count_if(full),
            F.sum("source_size") - F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        if rest[0] == settled or not rest[2]:
            break
        settled, words, parts = rest
        full = _whole("weight") * F.lit(words).cast("decimal(38,0)") > _whole("cap") * F.lit(parts).cast("decimal(38,0)")
    share = F.col("weight") * F.lit(float(rest[1] or 0)) / F.lit(float(rest[2] or 1))
    return ranked.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, limit, held, some): all documents of the source ``key`` with a hash below ``limit`` and
    ``some`` of the ``held`` ones with that hash fill its ``budget`` as nearly as whole documents can.
    A source of which all documents fit is left out."""
    below = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live, state, done = rows, budgets.select("key", "budget", F.lit(0).cast("long").alias("under")), []
    for used in range(_LEVEL_BITS, _BITS + 1, _LEVEL_BITS):
        histogram = (
            live.withColumn("bucket", F.shiftright("hash", _BITS - used))
            .groupBy("key", "bucket")
            .agg(
                F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"),
                F.count(F.lit(1)).alias("held"),
            )
        )
        state = checkpointed(
            histogram.withColumn("before", below)
            .join(state, "key")
            .withColumn("under", F.col("under") + F.col("before"))
            .where((F.col("under") <= F.col("budget")) & (F.col("under") + F.col("words") > F.col("budget")))
            .select("key", "budget", "under", "words", "bucket", "low", "high", "held")
        )
        single = F.col("low") == F.col("high")
        # Rows with one hash are repeated rows: each has its share of the words.
        some = F.floor((F.col("budget") - F.col("under")) * F.col("held") / F.col("words") + 0.5)
        done.append(state.where(single).select("key", F.col("low").alias("limit"), "held", some.alias("some")))
        state = state.where(~single).select("key", "budget", "under", "bucket")
        if state.isEmpty():
            break
        live = attach(rows, state.select("key", "bucket"), ["key"], ["hash"]).where(
            F.shiftright("hash", _BITS - used) == F.col("bucket")
        ).drop("bucket")
        live = checkpointed(live)
        state = state.drop("bucket")
    limits = done[0]
    for more in done[1:]:
        limits = limits.unionByName(more)
    return limits


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per document (doc_id, source, size, source_size, target, repeats, taken): ``repeats`` is how
    often the mix holds the document, ``taken`` the words that makes."""
    hashed = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit("")))), 1, 15), 16, 10)
    rows = checkpointed(
        docs.select(
            "doc_id",
            "source",
            F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source").cast("string"))).alias("key"),
            F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
            hashed.cast("long").alias("hash"),
        )
    )
    sizes = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    keys = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    targets = (
        source_targets(sizes.select("source", "source_size"), weights, most)
        .withColumn("key", keys)
        .withColumn("whole", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    targets = checkpointed(targets.drop("source"))
    limits = checkpointed(_thresholds(rows.select("key", "hash", "size"), targets))
    # Repeated rows at a threshold are alike: any so many of them go.
    at = limits.where("held > 1").select("key", F.col("limit").alias("hash"), "held")
    repeated = attach(rows.withColumn("row", F.monotonically_increasing_id()), at, ["key", "hash"], ["row"], how="left", counts="held")
    repeated = checkpointed(repeated)
    ranked = rank_within(repeated.where("held IS NOT NULL"), ["key", "hash"], ["row"], ["row"], "place")
    placed = repeated.where("held IS NULL").withColumn("place", F.lit(0).cast("long")).unionByName(ranked).drop("held", "row")
    plan = targets.join(limits.drop("held"), "key", "left")
    inside = (F.col("hash") < F.col("limit")) | ((F.col("hash") == F.col("limit")) & (F.col("place") < F.col("some")))
    extra = F.coalesce(inside, F.col("budget") > 0).cast("long")
    return (
        attach(placed, plan, ["key"], ["hash", "place"])
        .withColumn("repeats", F.least(F.col("whole") + extra, F.lit(most)))
        .select(
            "doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken")
        )
    )
