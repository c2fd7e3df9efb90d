"""Groups of near copies: all files linked by chains of 64-bit prints within a distance.

Prints are first reduced to distinct values, so copies never meet each other. Pairs of prints
come from bit blocks: two prints within ``threshold`` must be close in at least one block, so
each print is filed under its block value and under every value one bit away, and only prints
filed under the same value are compared. A crowded bucket is cut into slices and each pair of slices
is a task of its own. Where even that is too much work, its prints are filed again by the bits not
used yet, as long as this makes the buckets smaller. Nothing is capped: the search finds every pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.fingerprints import from_hex64, hamming
from twinsift.operators.components import connected_components
from twinsift.operators.near_rows import pairs_across, pairs_within
from twinsift.operators.skew import attach, hot_keys_of
from twinsift.operators.slices import class_sizes, triangle_sides
from twinsift.schemas import DEFAULT_THRESHOLD, PHASH
from twinsift.session import checkpointed
from twinsift.sources.tables import files_in_roots

# Buckets above this size are compared slice by slice; a slice has as many prints at most.
BUCKET_ROWS = 20_000
# A bucket is filed again if it needs more comparisons than a bucket of this size compared as a whole.
REFINE_ROWS = 1_000_000


def similar_candidates(
    files: DataFrame,
    file_hashes: DataFrame,
    root_ids: Iterable[int] | None = None,
    algorithm: str = PHASH,
) -> DataFrame:
    """Present files of the roots with their 64-bit print as a number."""
    present = files_in_roots(files, root_ids).select("file_id")
    prints = file_hashes.where(F.col("hash_type") == algorithm).select(
        "file_id", from_hex64(F.col("hash_hex")).alias("print")
    )
    return present.join(prints, "file_id")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _blocks(bits: list[int], threshold: int) -> list[list[int]]:
    """Split bits so that a pair within the threshold differs by at most 2 in some block."""
    count = threshold // 3 + 1
    return [bits[i * len(bits) // count : (i + 1) * len(bits) // count] for i in range(count)]


def _children(paths: dict[int, list[int]], threshold: int) -> tuple[list[tuple], dict[int, list[int]]]:
    """Filing rules of the next level and the bits that stay unused under each new path.

    A rule is (path, child, mask, flip, flipped): file under ``(print & mask) ^ flip``.
    By the pigeonhole bound the allowed differences of all blocks may sum to
    ``threshold - blocks + 1``; blocks allowed none need no flipped entries.
    """
    rules, below = [], {}
    for path, free in paths.items():
        blocks = _blocks(free, threshold)
        budget = threshold - len(blocks) + 1
        for i, block in enumerate(blocks):
            child = len(below) + 1
            below[child] = [b for b in free if b not in block]
            mask = _signed(sum(1 << b for b in block))
            allowed = budget // len(blocks) + (1 if i < budget % len(blocks) else 0)
            rules.append((path, child, mask, 0, 0))
            if allowed > 0:
                rules += [(path, child, mask, _signed(1 << b), n + 1) for n, b in enumerate(block)]
    return rules, below


def _label(rows: DataFrame) -> list[str]:
    """The column by which prints are connected already, if there is one."""
    return ["label"] if "label" in rows.columns else []


def _file_under(rows: DataFrame, rules: list[tuple], level: int) -> DataFrame:
    """One row per print and bucket of the next level.

    At the first level all rows follow the same rules, so these are a constant; later the small
    rule table (fixed by the threshold, not by the data) is broadcast and joined on the path.
    """
    carried = _label(rows)
    kept = [f"flip{i}" for i in range(level + 1)] + (["parent"] if level else []) + carried
    if level == 0:
        constant = F.array(
            *[
                F.struct(F.lit(c).alias("child"), F.lit(m).cast("long").alias("mask"), F.lit(f).cast("long").alias("flip"), F.lit(n).alias("flip0"))
                for _, c, m, f, n in rules
            ]
        )
        filed = rows.select("bucket", "print", *carried, F.inline(constant))
    else:
        schema = f"path int, child int, mask long, flip long, flip{level} int"
        filed = rows.join(F.broadcast(rows.sparkSession.createDataFrame(rules, schema)), "path")
    block = F.col("print").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip"))
    return filed.select(F.col("child").alias("path"), F.col("bucket").bitwiseOR(block).alias("bucket"), "print", *kept)


def _crowded(rows: DataFrame, rules: list[tuple], level: int, bucket_rows: int) -> DataFrame:
    """Buckets of more than ``bucket_rows`` prints with one fixed member (hub). ``meets`` tells whether a
    bucket can hold a pair: prints filed with the same flipped bit agree in that block and meet under
    their own value already, so a bucket where all rows flip the same bit has none.

    What is filed under flipped bits is known from the prints' own values: only these are counted. A
    bucket is crowded only if a value that is filed there has its share of ``bucket_rows``, so only the
    buckets of such values are summed up from the values one bit away.

    There are at most as many as filed rows by ``bucket_rows``, so the list is broadcast.
    """
    reach = max(Counter(child for _, child, _, _, _ in rules).values())
    turns = F.broadcast(
        rows.sparkSession.createDataFrame([(c, flip, n) for _, c, _, flip, n in rules], "path int, turn long, flip int")
    )
    turned = F.col("value").bitwiseXOR(F.col("turn"))
    own = rows.where(F.col(f"flip{level}") == 0).groupBy("path", F.col("bucket").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.min("print").alias("least")
    )
    full = own.where(F.col("n") * reach > bucket_rows).join(turns, "path").select("path", turned.alias("bucket")).distinct()
    filed = full.withColumnRenamed("bucket", "value").join(turns, "path").select(
        "path", F.col("value").alias("bucket"), turned.alias("value"), "flip"
    )
    sizes = filed.join(own, ["path", "value"]).groupBy("path", "bucket").agg(
        F.sum("n").alias("size"),
        F.min("least").alias("hub"),
        ((F.min("flip") < F.max("flip")) | (F.max("flip") == 0)).alias("meets"),
    )
    return checkpointed(sizes.where(F.col("size") > bucket_rows))


def _compare(rows: DataFrame, level: int, threshold: int, links_only: bool) -> DataFrame:
    """Pairs of one bucket within the threshold, each found once per block that shows it."""
    if level == 0:
        rows = _dealt_by_rule(rows, threshold)
    flips = [f"flip{i}" for i in range(level + 1)]
    label = next(iter(_label(rows)), None)
    return pairs_within(rows, ["bucket", "path"], flips, threshold, links_only, label=label, dealt=level == 0)


def _dealt_by_rule(rows: DataFrame, threshold: int) -> DataFrame:
    """Rows of the first level dealt by bucket. Most rows of a search are these, so only the print and the
    number of its rule are shuffled: the bucket follows from them on both sides."""
    rules, _ = _children({0: list(range(64))}, threshold)
    place = {(child, flipped): i + 1 for i, (_, child, _, _, flipped) in enumerate(rules)}
    starts = F.array(*[F.lit(place[path, 0]) for path in sorted({child for child, _ in place})])
    told = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("rule"))
    _, child, mask, flip, flipped = zip(*rules)
    path = told(child, "int")
    bucket = F.col("print").bitwiseAND(told(mask, "long")).bitwiseXOR(told(flip, "long"))
    packed = rows.select((F.element_at(starts, F.col("path")) + F.col("flip0")).alias("rule"), "print", *_label(rows))
    return packed.repartition(bucket, path).select(
        path.alias("path"), bucket.alias("bucket"), "print", told(flipped, "int").alias("flip0"), *_label(rows)
    )


def _compare_slices(rows: DataFrame, level: int, threshold: int, links_only: bool, slice_rows: int) -> DataFrame:
    """What ``_compare`` finds, for buckets cut into slices. ``rows`` has the classes of its bucket.

    A block value held by many prints floods the buckets one bit away as well, where nearly all rows
    flip the same bit. These do not meet each other, so such a bucket costs its few other rows only.
    """
    last = f"flip{level}"
    label = next(iter(_label(rows)), None)
    kept = [f"flip{i}" for i in range(level)] + _label(rows)
    near = hamming(F.col("print"), F.col("hub")) <= threshold
    rows = rows.withColumn("near", near)
    flips, closeness = [f"flip{i}" for i in range(level + 1)], "near" if links_only else None
    own, across = triangle_sides(rows, ["path", "bucket"], "print", last, ["near", *kept], slice_rows)
    within = pairs_within(own, ["bucket", "path", "slice"], flips, threshold, links_only, near=closeness, label=label)
    meet = ["bucket", "path", "kind_one", "one", "kind_two", "two"]
    pairs = within.unionByName(pairs_across(across, meet, threshold, flips, near=closeness, label=label))
    if links_only:
        # The hub stands for itself and is linked to its own label by a row (hub, hub).
        told = [F.col("hub").alias("of_a"), F.col("label").alias("of_b")] if label else []
        spokes = rows.where("near" if label else "near AND print <> hub").select(
            F.col("hub").alias("a"), F.col("print").alias("b"), *told
        )
        pairs = pairs.unionByName(spokes)
    return pairs


def print_counts(candidates: DataFrame) -> DataFrame:
    """Distinct prints with their number of files and lowest file id, worked out once."""
    return checkpointed(
        candidates.groupBy("print").agg(F.count(F.lit(1)).alias("copies"), F.min("file_id").alias("first_id"))
    )


def _unique(pairs: DataFrame) -> DataFrame:
    """Each pair once; of labelled ones, one pair of prints for two labels."""
    if "of_a" not in pairs.columns:
        return pairs.distinct()
    two = [F.least("of_a", "of_b").alias("of_a"), F.greatest("of_a", "of_b").alias("of_b")]
    return pairs.groupBy(*two).agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.*", "of_a", "of_b")


def _unfiled(distinct: DataFrame) -> DataFrame:
    return distinct.select(F.lit(0).alias("path"), F.lit(0).cast("long").alias("bucket"), "print", *_label(distinct))


def _search(
    distinct: DataFrame, threshold: int, links_only: bool, bucket_rows: int, hot_rows: int | None = None,
    refine_rows: int = REFINE_ROWS,
) -> DataFrame:
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    if threshold == 0:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    found = None
    distinct = distinct.where("print IS NOT NULL")
    prints = distinct.count()
    rows = _unfiled(distinct)
    paths = {0: list(range(64))}
    bucket, level = ["path", "bucket"], 0
    while True:
        rules, below = _children(paths, threshold)
        rows = _file_under(rows, rules, level)
        if prints <= bucket_rows:
            return _unique(_compare(rows, level, threshold, links_only))
        over = _crowded(rows, rules, level, bucket_rows)
        small = rows if over.isEmpty() else rows.join(F.broadcast(over.select(*bucket)), bucket, "left_anti")
        small = _compare(small, level, threshold, links_only)
        found = small if found is None else found.unionByName(small)
        over = over.where("meets").drop("meets")
        if over.isEmpty():
            return _unique(found)
        crowded = checkpointed(rows.join(F.broadcast(over), bucket))
        shapes = class_sizes(crowded, bucket, f"flip{level}")
        told = checkpointed(
            attach(crowded.drop("size"), shapes, bucket, ["print"], counts="size", hot_rows=hot_rows)
        )
        paths = {p: free for p, free in below.items() if len(free) > threshold}
        deep = (F.col("work") > float(refine_rows) ** 2 / 2) & F.col("path").isin(list(paths))
        if level:  # filing again must have made the bucket smaller
            deep = deep & (F.col("size") <= F.col("parent") / 2)
        found = found.unionByName(_compare_slices(told.where(~deep), level, threshold, links_only, bucket_rows))
        rows = told.where(deep)
        if not paths or rows.isEmpty():
            return _unique(found)
        rows = rows.drop("hub", "classes", "work", "parent").withColumnRenamed("size", "parent")
        level += 1


def _search_links(
    distinct: DataFrame, threshold: int, bucket_rows: int, hot_rows: int | None = None, refine_rows: int = REFINE_ROWS
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(links, labelled, later): what connects all prints within the threshold, in two steps.

    Near prints that agree in a whole block are linked first, a spanning forest of each bucket.
    ``labelled`` tells by which ``label`` these ``links`` connect each print, and the search of all buckets
    then keeps links between labels only: one pair (a, b) for two labels (of_a, of_b). So prints that are
    many and dense cost links by their number, not by that of their pairs. Few prints need one step.
    """
    distinct = distinct.where("print IS NOT NULL")
    if threshold <= 0 or distinct.count() <= bucket_rows:
        return _search(distinct, threshold, True, bucket_rows, hot_rows, refine_rows), None, None
    bucket = ["path", "bucket"]
    plain = [rule for rule in _children({0: list(range(64))}, threshold)[0] if rule[4] == 0]
    rows = _file_under(_unfiled(distinct), plain, 0)
    # Crowded buckets are left to the search by slices.
    crowded = hot_keys_of(rows, bucket, bucket_rows + 1)
    if crowded is not None:
        rows = rows.join(F.broadcast(crowded.select(*bucket)), bucket, "left_anti")
    links = checkpointed(_compare(rows, 0, threshold, True).distinct())
    labels = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), hot_rows=hot_rows)
    labelled = checkpointed(
        distinct.join(labels.withColumnRenamed("id", "print"), "print", "left")
        .select("print", F.coalesce("component", "print").alias("label"))
    )
    return links, labelled, checkpointed(_search(labelled, threshold, True, bucket_rows, hot_rows, refine_rows))


def _components(
    distinct: DataFrame, threshold: int, bucket_rows: int, hot_rows: int | None = None
) -> DataFrame:
    """(id, component) of prints in a component of two or more; its smallest print may have no row."""
    links, labelled, later = _search_links(distinct, threshold, bucket_rows, hot_rows)
    if labelled is None:
        return connected_components(_as_links(links), hot_rows=hot_rows)
    joined = connected_components(later.select(F.col("of_a").alias("src"), F.col("of_b").alias("dst")), hot_rows=hot_rows)
    found = labelled.join(joined.withColumnRenamed("id", "label"), "label", "left").select(
        F.col("print").alias("id"), F.coalesce("component", "label").alias("component")
    )
    return found.where("id <> component")


def similar_pairs(
    prints: DataFrame, threshold: int = DEFAULT_THRESHOLD, bucket_rows: int = BUCKET_ROWS,
    refine_rows: int = REFINE_ROWS,
) -> DataFrame:
    """Every pair of distinct prints within the threshold: print_a < print_b, distance."""
    distinct = checkpointed(prints.select("print").distinct())
    pairs = _search(distinct, threshold, False, bucket_rows, refine_rows=refine_rows)
    return pairs.select(
        F.col("a").alias("print_a"), F.col("b").alias("print_b"),
        hamming(F.col("a"), F.col("b")).alias("distance"),
    )


def similar_links(
    prints: DataFrame, threshold: int = DEFAULT_THRESHOLD, bucket_rows: int = BUCKET_ROWS,
    hot_rows: int | None = None, refine_rows: int = REFINE_ROWS,
) -> DataFrame:
    """Enough pairs (src, dst) within the threshold to connect what all pairs connect.

    A dense cluster costs about a link per print and block instead of all its pairs.
    """
    distinct = checkpointed(prints.select("print").distinct())
    links, _, later = _search_links(distinct, threshold, bucket_rows, hot_rows, refine_rows)
    return _as_links(links if later is None else links.unionByName(later.where("a <> b").select("a", "b")).distinct())


def _as_links(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def similar_group_items(
    candidates: DataFrame, components: DataFrame, job_id: str, hot_rows: int | None = None,
    prints: DataFrame | None = None,
) -> DataFrame:
    """Members of the groups of two or more files with distance and confidence to the anchor.

    ``components`` labels prints (id, component); prints without a label stand alone. Distance
    and group are worked out once per distinct print, then joined to the files once.
    """
    prints = print_counts(candidates) if prints is None else prints
    labelled = prints.join(components.withColumnRenamed("id", "print"), "print", "left").withColumn(
        "component", F.coalesce("component", "print")
    )
    groups = (
        labelled.groupBy("component")
        .agg(
            F.sum("copies").alias("files"),
            F.count(F.lit(1)).alias("prints"),
            F.min("first_id").alias("anchor_file_id"),
            F.min_by("print", "first_id").alias("anchor_print"),
        )
        .where(F.col("files") > 1)
    )
    placed = attach(labelled, groups, ["component"], ["print"], counts="prints", hot_rows=hot_rows)
    distance = hamming(F.col("print"), F.col("anchor_print"))
    scored = placed.select(
        "print",
        "copies",
        "anchor_file_id",
        distance.cast("long").alias("distance_to_anchor"),
        F.bround(F.greatest(F.lit(0.0), F.lit(1.0) - distance / F.lit(64.0)), 4).alias("confidence"),
    )
    members = attach(candidates, scored, ["print"], ["file_id"], counts="copies", hot_rows=hot_rows)
    return members.select(
        F.lit(job_id).alias("job_id"),
        "anchor_file_id",
        "file_id",
        "distance_to_anchor",
        "confidence",
        (F.col("file_id") == F.col("anchor_file_id")).cast("int").alias("is_primary"),
    )


def similar_groups(items: DataFrame, algorithm: str = PHASH, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Header rows of the groups, keyed by job and anchor file."""
    return items.groupBy("job_id", "anchor_file_id").agg(F.count(F.lit(1)).alias("file_count")).select(
        "job_id",
        "anchor_file_id",
        F.lit(algorithm).alias("algorithm"),
        F.lit(threshold).cast("long").alias("threshold"),
        "file_count",
    )


def find_similar(
    candidates: DataFrame,
    job_id: str,
    threshold: int = DEFAULT_THRESHOLD,
    bucket_rows: int = BUCKET_ROWS,
    hot_rows: int | None = None,
) -> DataFrame:
    """Items of all near-copy groups of the candidates (file_id, print)."""
    prints = print_counts(candidates)
    components = _components(prints.select("print"), threshold, bucket_rows, hot_rows)
    return similar_group_items(candidates, components, job_id, hot_rows=hot_rows, prints=prints)
