"""Sources, index, fingerprints, groups and scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinsift.functions import fingerprints as fp
from twinsift.operators import components, exact, index, maintenance, print_index, scoring, similar
from twinsift.plans.scan import scan
from twinsift.schemas import FILES, HASH_TYPES
from twinsift.session import shared_dir
from twinsift.sources import tables as src
from twinsift.sources.listing import path_attributes
from workload import derived as d
from workload.registry import query


# ---- sources ----------------------------------------------------------------------------


@query("""
    SELECT file_name, CASE WHEN file_name LIKE '%.%' AND length(ext) < length(file_name) AND ext <> '.' THEN lower(ext) END AS extension,
           CASE k WHEN 0 THEN 'text/plain' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/x-tar' WHEN 3 THEN 'application/x-tar'
             WHEN 6 THEN 'application/pdf' END AS mime_type
    FROM (SELECT *, '.' || split_part(file_name, '.', -1) AS ext FROM (
      SELECT doc_id % 7 AS k, CASE doc_id % 7 WHEN 0 THEN doc_id || '.TXT' WHEN 1 THEN doc_id || '.old.Jpg' WHEN 2 THEN doc_id || '.tar.gz'
        WHEN 3 THEN doc_id || '.tgz' WHEN 4 THEN '.' || doc_id WHEN 5 THEN doc_id || '.' ELSE source || '.' || doc_id || '.pdf' END AS file_name
      FROM documents))""")
def s2_path_attributes(spark, sf):
    doc = F.col("doc_id")
    number = doc.cast("string")
    name = (
        F.when(doc % 7 == 0, F.concat(number, F.lit(".TXT")))
        .when(doc % 7 == 1, F.concat(number, F.lit(".old.Jpg")))
        .when(doc % 7 == 2, F.concat(number, F.lit(".tar.gz")))
        .when(doc % 7 == 3, F.concat(number, F.lit(".tgz")))
        .when(doc % 7 == 4, F.concat(F.lit("."), number))
        .when(doc % 7 == 5, F.concat(number, F.lit(".")))
        .otherwise(F.concat("source", F.lit("."), number, F.lit(".pdf")))
    )
    named = d.table(spark, sf, "documents").select(name.alias("file_name"))
    return path_attributes(named).select("file_name", "extension", "mime_type")


@query("SELECT file_id, root_id, abs_path FROM files WHERE root_id IN (1, 3) AND is_present = 1")
def s4_files_in_roots(spark, sf):
    return src.files_in_roots(d.files(spark, sf), [1, 3]).select("file_id", "root_id", "abs_path")


@query("SELECT file_id, size_bytes FROM files ORDER BY size_bytes DESC, file_id LIMIT 50 OFFSET 50")
def s5_page(spark, sf):
    rows = d.files(spark, sf).select("file_id", "size_bytes")
    return src.page(rows, [F.desc("size_bytes"), "file_id"], page=2, page_size=50)


@query("SELECT file_id, abs_path FROM files WHERE root_id = 2 ORDER BY file_id LIMIT 20 OFFSET 10")
def s5_list_by_root(spark, sf):
    return src.list_by_root(d.files(spark, sf), 2, limit=20, offset=10).select("file_id", "abs_path")


@query("SELECT file_id, blake3_full, dhash64, phash64 FROM hashes")
def s6_hashes_wide(spark, sf):
    return src.hashes_wide(d.file_hashes(spark, sf)).select("file_id", *HASH_TYPES)


@query("SELECT file_id, hash_type, hash_hex FROM hash_rows")
def s6_hashes_long(spark, sf):
    return src.hashes_long(src.hashes_wide(d.file_hashes(spark, sf)))


@query("SELECT file_id, hash_type, hash_hex FROM hash_rows WHERE file_id = 7")
def s6_hashes_for_file(spark, sf):
    return src.hashes_for_file(d.file_hashes(spark, sf), 7)


@query("SELECT root_id, file_id FROM files WHERE (root_id, file_id) > (2, 100) ORDER BY root_id, file_id LIMIT 50")
def s5_page_after(spark, sf):
    files = d.files(spark, sf).select("root_id", "file_id")
    return src.page_after(files, ["root_id", "file_id"], (2, 100), 50)


@query("""
    SELECT 'job-current' AS job_id, group_key AS signature, file_id FROM items WHERE group_kind = 'exact' AND is_primary = 1
    UNION ALL SELECT 'job-other', group_key, file_id FROM items WHERE group_kind = 'exact'""")
def s7_replace_job_groups(spark, sf):
    """Two jobs store all their items; then one is rebuilt with its primaries only."""
    path = f"{shared_dir(spark)}/s7-{uuid.uuid4().hex}"
    items = d.exact_items(spark, sf).select("job_id", "signature", "file_id", "is_primary")
    src.replace_job_groups(items, path, d.JOB)
    src.replace_job_groups(items.withColumn("job_id", F.lit("job-other")), path, "job-other")
    src.replace_job_groups(items.where("is_primary = 1"), path, d.JOB)
    return spark.read.parquet(path).select("job_id", "signature", "file_id")


@query("SELECT movement_id, file_id, batch_id, restored FROM movements")
def s8_append_ledger(spark, sf):
    """Every batch is appended with its movements still open, then once more as it is now."""
    path = f"{shared_dir(spark)}/s8-{uuid.uuid4().hex}"
    moves = d.file_movements(spark, sf)
    src.append_ledger(moves.withColumn("restored_at", F.lit(None).cast("timestamp")), path)
    src.append_ledger(moves, path)
    return src.read_ledger(spark, path).select(
        "movement_id", "file_id", "batch_id", F.col("restored_at").isNotNull().alias("restored")
    )


# ---- incremental index --------------------------------------------------------------------


@query("SELECT abs_path, is_new, changed FROM changes")
def i1_detect_changes(spark, sf):
    changes = index.detect_changes(d.listing(spark, sf), d.prev_files(spark, sf))
    return changes.select("abs_path", "is_new", "changed")


@query("""
    SELECT abs_path, root_id, rel_path FROM listed_twice
    QUALIFY row_number() OVER (PARTITION BY abs_path ORDER BY root_id DESC) = 1""")
def i2_resolve_overlapping_roots(spark, sf):
    owned = index.resolve_overlapping_roots(d.overlapping_listing(spark, sf))
    return owned.select("abs_path", "root_id", "rel_path")


@query("""
    SELECT p.file_id, p.abs_path, coalesce(f.size_bytes, p.size_bytes) AS size_bytes,
           coalesce(CASE WHEN f.abs_path IS NULL THEN p.width END, -1)::INT AS width,
           p.first_seen_job_id, CASE WHEN f.abs_path IS NULL THEN p.last_seen_job_id ELSE 'job-current' END AS last_seen_job_id,
           (CASE WHEN f.abs_path IS NULL THEN p.is_present ELSE 1 END)::INT AS is_present
    FROM prev_files p LEFT JOIN files f USING (abs_path)
    UNION ALL
    SELECT (SELECT max(file_id) FROM prev_files) + row_number() OVER (ORDER BY abs_path), abs_path, size_bytes, -1,
           'job-current', 'job-current', 1
    FROM files WHERE abs_path NOT IN (SELECT abs_path FROM prev_files)""")
def i3_upsert_files(spark, sf):
    after = index.upsert_files(d.prev_files(spark, sf), path_attributes(d.listing(spark, sf)), d.JOB)
    width = F.coalesce("width", F.lit(-1)).alias("width")
    return after.select(
        "file_id", "abs_path", "size_bytes", width, "first_seen_job_id", "last_seen_job_id", "is_present"
    )


@query("""
    SELECT o.file_id, o.root_id, o.rel_path, o.abs_path, o.file_name, '.txt' AS extension, 'text/plain' AS mime_type,
           coalesce(f.size_bytes, o.size_bytes) AS size_bytes, o.mtime_epoch_ns,
           CASE WHEN f.abs_path IS NULL THEN o.width END AS width, CASE WHEN f.abs_path IS NULL THEN o.height END AS height,
           CASE WHEN f.abs_path IS NULL THEN o.exif END AS exif_datetime_original, o.first_seen_job_id,
           CASE WHEN f.abs_path IS NULL AND (o.root_id NOT IN (1, 2) OR o.is_present = 0) THEN o.last_seen_job_id ELSE 'job-current' END AS last_seen_job_id,
           (CASE WHEN f.abs_path IS NOT NULL THEN 1 WHEN o.root_id IN (1, 2) THEN 0 ELSE o.is_present END)::INT AS is_present
    FROM index_before o LEFT JOIN files f USING (abs_path)
    UNION ALL
    SELECT (SELECT max(file_id) FROM index_before) + row_number() OVER (ORDER BY abs_path), root_id, rel_path, abs_path, file_name, '.txt', 'text/plain',
           size_bytes, mtime_epoch_ns, NULL, NULL, NULL, 'job-current', 'job-current', 1
    FROM files WHERE abs_path NOT IN (SELECT abs_path FROM index_before)""")
def i3_refresh_bucketed_index(spark, sf):
    """A rescan over an index that is stored in buckets of its path; times of change aside, all columns."""
    name = f"index_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    src.save_bucketed(d.prev_files(spark, sf), name, path, buckets=8)
    listed = path_attributes(d.listing(spark, sf))
    after = index.refresh_index(src.open_bucketed(spark, name, path, FILES, buckets=8), listed, [1, 2], d.JOB)
    empty = ["ctime_epoch_ns", "inode", "dev", "exif_make", "exif_model", "updated_at", "changed"]
    return after.drop(*empty)


@query("""
    SELECT p.file_id, (CASE WHEN gone THEN 0 ELSE p.is_present END)::INT AS is_present,
           CASE WHEN gone THEN 'job-current' ELSE p.last_seen_job_id END AS last_seen_job_id
    FROM (SELECT *, root_id IN (1, 2) AND is_present <> 0 AND abs_path NOT IN (SELECT abs_path FROM files) AS gone
          FROM prev_files) p""")
def i4_mark_missing(spark, sf):
    after = index.mark_missing(d.prev_files(spark, sf), d.listing(spark, sf), [1, 2], d.JOB)
    return after.select("file_id", "is_present", "last_seen_job_id")


@query("""
    SELECT h.file_id, hash_type, CASE WHEN size_bytes % 3 = 0 THEN hash_hex ELSE 'old' || hash_hex END AS hash_hex
    FROM hash_rows h JOIN files USING (file_id) WHERE size_bytes % 3 = 0 OR size_bytes % 2 = 0""")
def i5_upsert_hashes(spark, sf):
    """Even sizes have an older hash; sizes divisible by three are hashed again, twice."""
    hashes = d.file_hashes(spark, sf).join(d.files(spark, sf).select("file_id", "size_bytes"), "file_id")
    old = F.concat(F.lit("old"), "hash_hex")
    current = hashes.where("size_bytes % 2 = 0").select("file_id", "hash_type", old.alias("hash_hex"))
    again = hashes.where("size_bytes % 3 = 0").select(
        "file_id", "hash_type", F.explode(F.array(F.struct(F.lit(1).alias("seq"), old.alias("hash_hex")),
                                                  F.struct(F.lit(2).alias("seq"), F.col("hash_hex").alias("hash_hex")))).alias("w")
    ).select("file_id", "hash_type", "w.*")
    return index.upsert_hashes(current, again, seq="seq")


@query("""
    SELECT (SELECT count(*) FROM listed_twice) AS files_seen, (SELECT count_if(changed) FROM changes)::BIGINT AS files_indexed""")
def i6_scan_metrics(spark, sf):
    listing = d.overlapping_listing(spark, sf)
    owned = index.resolve_overlapping_roots(listing)
    return index.scan_metrics(listing, index.detect_changes(owned, d.prev_files(spark, sf)))


# ---- fingerprints -----------------------------------------------------------------------


@query("SELECT file_id, sha256(text) AS content_hash FROM files")
def f1_content_hash(spark, sf):
    return d.contents(spark, sf).select("file_id", fp.content_hash(F.col("content")).alias("content_hash"))


@query("""
    SELECT file_id, CASE WHEN n > 0 THEN array_to_string(s65, ',') END AS s65,
           CASE WHEN n > 0 THEN array_to_string(s64, ',') END AS s64 FROM sampled""")
def f2_sample_bytes(spark, sf):
    joined = lambda k: F.array_join(fp.sample_bytes(F.col("content"), k).cast("array<string>"), ",")
    return d.contents(spark, sf).select("file_id", joined(65).alias("s65"), joined(64).alias("s64"))


@query("SELECT file_id, dhash64 FROM hashes")
def f3_dhash64(spark, sf):
    return d.contents(spark, sf).select("file_id", fp.dhash64(F.col("content")).alias("dhash64"))


@query("SELECT file_id, phash64 FROM hashes")
def f4_phash64(spark, sf):
    return d.contents(spark, sf).select("file_id", fp.phash64(F.col("content")).alias("phash64"))


@query("SELECT file_id, bit_count(xor(dprint, pprint))::INT AS distance FROM prints")
def f5_hamming_hex(spark, sf):
    wide = src.hashes_wide(d.file_hashes(spark, sf))
    return wide.select("file_id", fp.hamming_hex(F.col("dhash64"), F.col("phash64")).alias("distance"))


@query("SELECT file_id, hash_type, hash_hex FROM hash_rows")
def f6_fingerprint(spark, sf):
    return fp.fingerprint(d.contents(spark, sf))


# ---- exact groups -----------------------------------------------------------------------


@query("SELECT file_id, size_bytes, signature FROM exact_cands")
def x1_exact_candidates(spark, sf):
    return d.exact_cands(spark, sf).select("file_id", "size_bytes", "signature")


@query("""
    SELECT file_id, size_bytes FROM files
    WHERE size_bytes IN (SELECT size_bytes FROM files GROUP BY size_bytes HAVING count(*) > 1)""")
def x2_size_prefilter(spark, sf):
    return exact.size_prefilter(d.files(spark, sf)).select("file_id", "size_bytes")


@query("SELECT * FROM exact_groups")
def x3_exact_groups(spark, sf):
    return exact.exact_groups(d.exact_cands(spark, sf), d.JOB)


@query("SELECT * FROM exact_members")
def x4_exact_group_items(spark, sf):
    return exact.exact_group_items(d.exact_cands(spark, sf), d.JOB)


@query("SELECT count(*) AS groups_found, coalesce(sum(reclaimable_bytes), 0)::BIGINT AS reclaimable_bytes FROM exact_groups")
def x5_exact_totals(spark, sf):
    return exact.exact_totals(exact.exact_groups(d.exact_cands(spark, sf), d.JOB))


@query("""
    SELECT sha256(text) AS signature, count(*) AS file_count, sum(strlen(text))::BIGINT AS total_bytes,
           (sum(strlen(text)) - max(strlen(text)))::BIGINT AS reclaimable_bytes
    FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_copies_of_documents(spark, sf):
    """Straight from the text to groups of identical documents, present or not."""
    docs = d.table(spark, sf, "documents").select(
        fp.content_hash(F.col("text").cast("binary")).alias("signature"),
        F.octet_length("text").cast("long").alias("size_bytes"),
    )
    return exact.exact_groups(docs, d.JOB).drop("job_id")


@query("""
    SELECT sha256(text) AS signature, count(*) AS file_count, sum(strlen(text))::BIGINT AS total_bytes,
           (sum(strlen(text)) - max(strlen(text)))::BIGINT AS reclaimable_bytes
    FROM conversations GROUP BY 1 HAVING count(*) > 1""")
def exact_copies_of_turns(spark, sf):
    turns = d.table(spark, sf, "conversations").select(
        fp.content_hash(F.col("text").cast("binary")).alias("signature"),
        F.octet_length("text").cast("long").alias("size_bytes"),
    )
    return exact.exact_groups(turns, d.JOB).drop("job_id")


# ---- similar groups ---------------------------------------------------------------------


@query("SELECT file_id, phash64 FROM hashes JOIN files USING (file_id) WHERE is_present = 1")
def g1_similar_candidates(spark, sf):
    return d.similar_cands(spark, sf).select("file_id", fp.to_hex64(F.col("print")).alias("phash64"))


@query("""
    SELECT lpad(lower(to_hex(least(a, b))), 16, '0') AS low, lpad(lower(to_hex(greatest(a, b))), 16, '0') AS high,
           bit_count(xor(a, b))::INT AS distance
    FROM near WHERE a < b""")
def g2_similar_pairs(spark, sf):
    pairs = similar.similar_pairs(d.similar_cands(spark, sf), 8)
    a, b = fp.to_hex64(F.col("print_a")), fp.to_hex64(F.col("print_b"))
    return pairs.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), "distance")


@query("""
    SELECT lpad(lower(to_hex(p)), 16, '0') AS print, (SELECT count(*) FROM (SELECT DISTINCT p FROM reached r2 WHERE r2.start = n.p))::BIGINT AS linked
    FROM nodes n WHERE p IN (SELECT a FROM near)""")
def g3_connected_components(spark, sf):
    """Prints with a near print and the number of prints in their component."""
    links = similar.similar_links(d.similar_cands(spark, sf), 8)
    labels = components.connected_components(links)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("linked"))
    return labels.join(sizes, "component").select(fp.to_hex64(F.col("id")).alias("print"), "linked")


_PAIRS = """
    SELECT lpad(lower(to_hex(least(a, b))), 16, '0') AS low, lpad(lower(to_hex(greatest(a, b))), 16, '0') AS high,
           bit_count(xor(a, b))::INT AS distance
    FROM near WHERE a < b"""


def _hex_pairs(pairs):
    a, b = fp.to_hex64(F.col("print_a")), fp.to_hex64(F.col("print_b"))
    return pairs.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), "distance")


@query(_PAIRS)
def g2_similar_pairs_after_rescan(spark, sf):
    """Pairs stored by the scan before, without those of removed prints, and the pairs of new prints."""
    return _hex_pairs(print_index.pairs_after(
        d.pairs_before(spark, sf), d.print_index_before(spark, sf), d.similar_cands(spark, sf), d.prints_gone(spark, sf)))


@query(_PAIRS + """ AND (a NOT IN (SELECT p FROM before) OR b NOT IN (SELECT p FROM before))""")
def g2_pairs_of_new_prints(spark, sf):
    return _hex_pairs(print_index.delta_pairs(
        d.print_index_before(spark, sf).join(d.prints_gone(spark, sf), "print", "left_anti").select("block", "value", "print"),
        d.similar_cands(spark, sf)))


@query("SELECT * FROM similar_members")
def g4_similar_group_items_after_rescan(spark, sf):
    """Components of the scan before, continued with the prints that came and went since."""
    now = d.similar_cands(spark, sf)
    labels = print_index.update_labels(
        d.labels_before(spark, sf), d.print_index_before(spark, sf), now, d.prints_gone(spark, sf))
    return similar.similar_group_items(now, labels, d.JOB)


@query("SELECT * FROM similar_members")
def g4_similar_group_items(spark, sf):
    return similar.find_similar(d.similar_cands(spark, sf), d.JOB, 8)


@query("""
    SELECT 'job-current' AS job_id, anchor_file_id, 'phash64' AS algorithm, 8::BIGINT AS threshold, count(*) AS file_count
    FROM similar_members GROUP BY anchor_file_id""")
def g5_similar_groups(spark, sf):
    return similar.similar_groups(d.plain_similar_items(spark, sf))


# ---- keep-scoring -----------------------------------------------------------------------


@query("""
    SELECT DISTINCT group_key AS signature, max_res AS max_resolution, max_size, min_mtime FROM rated WHERE group_kind = 'exact'""")
def k1_group_extremes(spark, sf):
    members = scoring.with_file_attributes(d.exact_items(spark, sf), d.files(spark, sf))
    return scoring.group_extremes(members, ["signature"]).drop("members")


@query("SELECT group_key AS signature, file_id, keep_score FROM scored WHERE group_kind = 'exact'")
def k2_keep_score(spark, sf):
    items = exact.exact_group_items(d.exact_cands(spark, sf), d.JOB)
    return scoring.score_groups(items, d.files(spark, sf), ["signature"]).select("signature", "file_id", "keep_score")


@query("SELECT group_key AS anchor, file_id, reason FROM scored WHERE group_kind = 'similar'")
def k3_keep_reason(spark, sf):
    rated = scoring.score_groups(d.plain_similar_items(spark, sf), d.files(spark, sf), ["anchor_file_id"])
    return rated.select(F.col("anchor_file_id").cast("string").alias("anchor"), "file_id", "reason")


@query("SELECT group_kind, group_key, file_id FROM items WHERE is_primary = 1")
def k4_choose_primary(spark, sf):
    return d.all_items(spark, sf).where("is_primary = 1").select("group_kind", "group_key", "file_id")


@query("SELECT group_key AS signature, file_id, keep_score, reason, is_primary FROM items WHERE group_kind = 'exact'")
def k5_score_exact_groups(spark, sf):
    items = exact.exact_group_items(d.exact_cands(spark, sf), d.JOB)
    return scoring.score_groups(items, d.files(spark, sf), ["job_id", "signature"]).drop("job_id")


@query("SELECT group_key AS signature, file_id, keep_score, reason, is_primary FROM items WHERE group_kind = 'exact'")
def k5_exact_items_after_rescan(spark, sf):
    """Scored items of the scan before, where only signatures of changed files were worked out again."""
    return d.exact_state_after(spark, sf).items.drop("part")


@query("SELECT * FROM exact_groups")
def x3_exact_groups_after_rescan(spark, sf):
    return maintenance.for_job(d.exact_state_after(spark, sf).groups, d.JOB)


@query("""
    SELECT i.file_id, m.anchor_file_id, distance_to_anchor, confidence, i.keep_score, i.reason, i.is_primary
    FROM items i JOIN similar_members m ON m.file_id = i.file_id AND m.anchor_file_id::VARCHAR = i.group_key
    WHERE i.group_kind = 'similar'""")
def k5_score_similar_groups(spark, sf):
    rated = scoring.score_groups(d.plain_similar_items(spark, sf), d.files(spark, sf), ["job_id", "anchor_file_id"])
    return rated.drop("job_id")


@query("""
    SELECT (SELECT count(*) FROM exact_groups) AS exact_groups_updated,
           (SELECT count(DISTINCT anchor_file_id) FROM similar_members) AS similar_groups_updated""")
def k5_score_summary(spark, sf):
    return scoring.score_summary(d.exact_items(spark, sf), d.similar_items(spark, sf))


# ---- whole job --------------------------------------------------------------------------


@query("""
    SELECT 'job-next' AS job_id, (SELECT count(*) FROM files) AS files_seen,
           (SELECT count_if(changed) FROM changes)::BIGINT AS files_indexed,
           (SELECT count(*) FROM all_copies) AS exact_groups_found,
           (SELECT count(DISTINCT anchor) FROM (
              SELECT n.p, min(m.first_id) AS anchor FROM all_nodes n
              JOIN (SELECT p AS start, p FROM all_nodes UNION SELECT start, p FROM all_reached) r ON r.start = n.p
              JOIN all_nodes m ON m.p = r.p GROUP BY n.p HAVING sum(m.copies) > 1))::BIGINT AS similar_groups_found,
           (SELECT coalesce(sum(reclaimable), 0) FROM all_copies)::BIGINT AS reclaimable_bytes""")
def e1_scan_job(spark, sf):
    """A rescan over the older index: every listed file is present again, all take part."""
    prints = lambda due: fp.fingerprint(
        due.select("abs_path", F.col("file_id").alias("new_id"))
        .join(d.files(spark, sf).select("abs_path", "file_id"), "abs_path")
        .join(d.contents(spark, sf), "file_id")
        .select(F.col("new_id").alias("file_id"), "content")
    )
    old = d.prev_files(spark, sf)
    stored = d.file_hashes(spark, sf).join(old.select("file_id"), "file_id", "left_semi")
    return scan(d.listing(spark, sf), old, stored, [1, 2, 3], "job-next", read_prints=prints).metrics
