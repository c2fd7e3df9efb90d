"""Line dedup by log templates from a fixed-depth tree.

A line, trimmed, is masked (words with a digit become ``<*>``) and filed in the tree under its
number of words and its first words: that is its leaf. Two kinds of template come from the tree:

* the masked line itself;
* generalised templates of a leaf: a word is constant if enough texts have it in the same place of
  the leaf, ``<*>`` stands for the others, and lines with the same constant words make a template if
  they are enough and these words are most of the line. A leaf so has as many templates as it holds,
  and other lines in it take none away. A line belongs to every template that it fits, also where a
  variable word of it is constant in another template.

A template recurs if enough unlike documents hold it: text that repeats because the whole document was
copied is left to the document-level operators. Exact copies count once. For near copies, the marks of
a document are the hashes of its lines' first words, and its signature are the two smallest and two
largest marks beside that of the template's own line. Where a good part of the texts that agree in one
of these marks have one signature, they are near copies, and the other signatures with that mark count
as more of them. So copies, however many, take nothing away from the unlike documents. A third of all
documents may hold one line: documents vote once per template and votes are counted before they are
shuffled.

Edge cases: empty lines are neither counted nor dropped; a null text has no lines and stays null; a
document may lose all its lines and keeps an empty text; rows with equal doc_id and text are treated
alike; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.skew import attach
from twinsift.session import checkpointed

# Leaf lists up to so many rows (8 bytes each) are broadcast, larger ones shuffled.
BROADCAST_LEAVES = 1_000_000
# The same for words and templates of leaves, some 100 bytes each.
BROADCAST_WORDS = 100_000


def _masked(line: F.Column) -> F.Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)


def _key() -> F.Column:
    """The document id as text, so that joins also match documents without one."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")


def _lines(docs: DataFrame) -> DataFrame:
    """(key, body, at, line): the trimmed, masked lines that are not empty."""
    return (
        docs.select(_key(), F.xxhash64("text").alias("body"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
        .select("key", "body", "at", F.trim("raw", F.lit(" \t\r")).alias("line"))
        .where("line <> ''")
        .withColumn("line", _masked(F.col("line")))
    )


def _places(depth: int):
    """Columns of a masked line: number of words, first words, leaf."""
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lead = F.substring_index("line", " ", depth)
    return words, lead, F.xxhash64(words, lead)


def _general(docs: DataFrame, leaves: DataFrame, depth: int, least: int, similar: float) -> DataFrame:
    """(key, body, at, mark, group): lines and the generalised templates of their leaf that they fit."""
    _, lead, leaf = _places(depth)
    small = leaves.count() <= BROADCAST_LEAVES
    inside = _lines(docs).withColumn("leaf", leaf).join(F.broadcast(leaves) if small else leaves, "leaf")
    # Few lines are in such leaves; kept, they are read again without scanning the texts again.
    inside = checkpointed(
        inside.select(
            "key", "body", "at", "leaf", F.xxhash64(lead).alias("mark"), F.xxhash64("line").alias("template"), "line"
        )
    )
    # Each masked line once, with the number of different texts that hold it.
    masked = checkpointed(
        inside.groupBy("leaf", "template", "body")
        .agg(F.min("line").alias("line"))
        .groupBy("leaf", "template")
        .agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("texts"))
        .withColumn("words", F.split("line", " "))
        .drop("line")
    )
    word = ["leaf", "place", "word"]
    placed = masked.select(
        "leaf", "template", "texts", F.size("words").alias("n"), F.posexplode("words").alias("place", "word")
    ).where(F.col("place") >= depth)
    frequent = checkpointed(placed.groupBy(*word).agg(F.sum("texts").alias("having")).where(F.col("having") >= least))
    few_words = frequent.count() <= BROADCAST_WORDS
    fixed = (
        (placed.join(F.broadcast(frequent), word) if few_words else attach(placed, frequent, word, ["template"]))
        .groupBy("leaf", "template", "texts", "n")
        .agg(
            F.sort_array(F.collect_list(F.struct("place", "word"))).alias("fixed"),
            F.min(F.struct("having", "place", "word")).alias("rarest"),
        )
        .where(F.size("fixed") + depth >= F.greatest(F.lit(depth + 1), F.ceil(similar * F.col("n"))))
        .withColumn("group", F.xxhash64("leaf", "fixed"))
    )
    fixed = checkpointed(fixed)
    groups = (
        fixed.groupBy("leaf", "group")
        .agg(F.sum("texts").alias("texts"), F.min("fixed").alias("needed"), F.min("rarest").alias("rarest"))
        .where(F.col("texts") >= least)
        .select("leaf", "group", "needed", "rarest.place", "rarest.word")
    )
    groups = checkpointed(groups)
    few_groups = groups.count() <= BROADCAST_WORDS
    # A template is looked up by its rarest constant word, by every line that has this word there.
    lines = fixed.select("leaf", "template", "fixed", F.inline("fixed"))
    fits = (
        (lines.join(F.broadcast(groups), word) if few_groups else attach(lines, groups, word, ["template"]))
        .where(F.size(F.array_except("needed", "fixed")) == 0)
        .select("leaf", "template", "group")
    )
    return attach(inside.drop("line"), fits, ["leaf", "template"], ["key", "at"]).select("key", "body", "at", "mark", "group")


def _signed(votes: DataFrame) -> DataFrame:
    """Votes (mark, ends, ..) with ``parts``, the two smallest and two largest marks of the document
    beside that of the line, and their hash, the signature."""
    others = F.filter("ends", lambda x: x != F.col("mark"))
    parts = F.when(F.size("others") == 0, F.array("mark")).otherwise(
        F.array_distinct(F.concat(F.slice("others", 1, 2), F.slice(F.reverse("others"), 1, 2)))
    )
    return (
        votes.withColumn("others", others)
        .withColumn("parts", parts)
        .withColumn("signature", F.xxhash64("parts"))
        .drop("others", "ends", "mark")
    )


def _unlike(holders: DataFrame, key: str, share: float, stray: float) -> DataFrame:
    """Keys that enough unlike documents hold, of (key, body, signature, parts, least): how many are
    enough depends on the key."""
    held = checkpointed(
        holders.groupBy(key, "body")
        .agg(F.min(F.struct("signature", "parts", "least")).alias("s"))
        .groupBy(key, "s")
        .agg(F.count(F.lit(1)).alias("texts"))
        .select(key, "s.signature", "s.parts", "s.least", "texts")
    )
    by_part = held.select(key, "signature", "texts", F.explode("parts").alias("part"))
    crowds = checkpointed(
        by_part.groupBy(key, "part")
        .agg(F.max("texts").alias("top"), F.sum("texts").alias("total"))
        .where((F.col("top") > 1) & (F.col("top") >= share * F.col("total")))
        .select(key, "part", "top")
    )
    small = crowds.count() <= BROADCAST_LEAVES
    copies = (
        by_part.join(F.broadcast(crowds) if small else crowds, [key, "part"])
        .where("top > texts")
        .groupBy(key, "signature")
        .agg(F.max("texts").alias("copies"))
    )
    return (
        held.groupBy(key)
        .agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("signatures"), F.sum(F.when(F.col("texts") > 1, F.col("texts")).otherwise(0)).alias("crowd"))
        .join(copies.groupBy(key).agg(F.count(F.lit(1)).alias("near"), F.sum("copies").alias("copies")), key, "left")
        .withColumn("unlike", F.col("signatures") - F.coalesce("near", F.lit(0)))
        .where(F.col("unlike") >= F.col("least") + stray * F.when(F.col("near") > 0, F.col("crowd") + F.col("copies")).otherwise(0))
        .select(key)
    )


def recurring_lines(
    docs: DataFrame,
    least: int = 10,
    least_long: int = 5,
    long_words: int = 3,
    share: float = 0.25,
    stray: float = 0.02,
    depth: int = 3,
    similar: float = 0.6,
) -> DataFrame:
    """(key, body, lines, drop) per distinct document with lines: how many lines it has and the
    positions (from 0, in the text split at newlines) of those whose template recurs.

    A template recurs if at least ``least`` unlike documents hold it; for a whole line of at least
    ``long_words`` words, ``least_long`` are enough. Texts that agree in a mark are
    near copies if ``share`` of them have one signature; ``stray`` of the near copies may differ in all
    marks and are not taken for unlike documents. In a leaf, a word is constant if ``least`` texts have
    it there, and there is a general template if at least ``similar`` of the words are constant and
    ``least`` texts have lines with just these.
    """
    words, lead, leaf = _places(depth)
    needed = F.when(words >= long_words, least_long).otherwise(least)
    lines = checkpointed(
        _lines(docs).select(
            "key", "body", "at", leaf.alias("leaf"), F.xxhash64("line").alias("template"), F.xxhash64(lead).alias("mark"),
            needed.alias("least"),
        )
    )
    marks = F.array_sort(F.collect_set("mark"))
    per_doc = checkpointed(
        lines.groupBy("key", "body")
        .agg(
            marks.alias("ends"),
            F.collect_set(F.struct("template", "leaf", "mark", "least")).alias("votes"),
            F.count(F.lit(1)).alias("lines"),
        )
        # With six ends, two at each side are left without any one of them.
        .withColumn("ends", F.when(F.size("ends") > 6, F.concat(F.slice("ends", 1, 3), F.slice("ends", -3, 3))).otherwise(F.col("ends")))
    )
    votes = per_doc.select("body", "ends", F.inline("votes"))
    held = checkpointed(votes.select("template", "leaf", "body", "least").distinct())
    often = held.groupBy("template").agg(F.count(F.lit(1)).alias("texts"), F.min("least").alias("least"))
    often = often.where("texts >= least").select("template")
    often = checkpointed(often)
    few = often.count() <= BROADCAST_LEAVES
    same = _unlike(_signed(votes.join(F.broadcast(often) if few else often, "template")), "template", share, stray)
    leaves = (
        held.groupBy("leaf", "body")
        .agg(F.min("template").alias("low"), F.max("template").alias("high"))
        .groupBy("leaf")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where((F.col("texts") >= least) & (F.col("low") < F.col("high")))
        .select("leaf")
    )
    general = checkpointed(_general(docs, checkpointed(leaves), depth, least, similar))
    holders = general.select("key", "body", "group", "mark").distinct().join(per_doc.select("key", "body", "ends"), ["key", "body"])
    alike = _unlike(_signed(holders.withColumn("least", F.lit(least))), "group", share, stray)
    found = (
        attach(lines.select("key", "body", "at", "template"), same, ["template"], ["key", "at"])
        .select("key", "body", "at")
        .unionByName(attach(general, alike, ["group"], ["key", "at"]).select("key", "body", "at"))
    )
    drop = found.groupBy("key", "body").agg(F.collect_set("at").alias("drop"))
    return per_doc.select("key", "body", "lines").join(drop, ["key", "body"], "left")


def drop_recurring_lines(docs: DataFrame, **rule) -> DataFrame:
    """The documents, with ``text`` without its recurring lines, and n_lines and n_dropped added.

    Takes the parameters of ``recurring_lines``.
    """
    docs = docs.drop("n_lines", "n_dropped")
    found = recurring_lines(docs, **rule).select(
        F.col("key").alias("__key"),
        F.col("body").alias("__body"),
        F.col("lines").alias("__lines"),
        F.col("drop").alias("__drop"),
    )
    marked = docs.withColumn("__key", _key()).withColumn("__body", F.xxhash64("text")).join(found, ["__key", "__body"], "left")
    kept = F.array_join(
        F.filter(F.split("text", "\n"), lambda line, at: ~F.array_contains(F.col("__drop"), at)), "\n"
    )
    return marked.select(
        *[F.when(F.col("__drop").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce("__lines", F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
    )
