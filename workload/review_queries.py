"""Decisions and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift.operators import decisions as dec
from twinsift.operators import exact, review, similar
from workload import derived as d
from workload.registry import query


def _claims(spark, sf):
    """A decision on the exact group of every labelled file, group or not."""
    signatures = d.exact_cands(spark, sf).select("file_id", F.col("signature").alias("group_key"))
    return d.labelled(spark, sf).join(signatures, "file_id").select(
        F.lit("exact").alias("group_kind"), F.lit(d.JOB).alias("job_id"), "group_key", "file_id", "decision",
        F.lit(None).cast("string").alias("note"), "seq",
    )


@query("""
    SELECT l.file_id, l.decision FROM labelled l JOIN exact_members m USING (file_id)""")
def d1_accepted_decisions(spark, sf):
    accepted, _ = dec.validate_decisions(_claims(spark, sf), d.all_items(spark, sf))
    return accepted.select("file_id", "decision")


@query("""
    SELECT l.file_id, 'group item not found: kind=exact group_id=' || c.signature || ' file_id=' || l.file_id AS error
    FROM labelled l JOIN exact_cands c USING (file_id) WHERE l.file_id NOT IN (SELECT file_id FROM exact_members)""")
def d1_rejected_decisions(spark, sf):
    _, rejected = dec.validate_decisions(_claims(spark, sf), d.all_items(spark, sf))
    return rejected.select("file_id", "error")


@query("""
    SELECT group_kind, group_key, file_id, CASE WHEN decision = 'trash' THEN 'ignore' ELSE decision END AS decision,
           CASE WHEN decision = 'trash' THEN seq + 1000000000 ELSE seq END AS seq
    FROM decided""")
def d2_upsert_decisions(spark, sf):
    """Every trash decision is revised to ignore later on."""
    first = d.decisions(spark, sf)
    revised = first.where("decision = 'trash'").withColumn("decision", F.lit("ignore")).withColumn(
        "seq", F.col("seq") + 1_000_000_000
    )
    return dec.upsert_decisions(first, revised).drop("job_id", "note")


@query("""
    SELECT i.group_kind, i.group_key, i.file_id,
           (CASE WHEN k.kept IS NULL THEN i.is_primary WHEN i.file_id = k.kept THEN 1 ELSE 0 END)::INT AS is_primary
    FROM items i LEFT JOIN (SELECT group_kind, group_key, max_by(file_id, seq) AS kept FROM decided
                            WHERE decision = 'keep' GROUP BY ALL) k USING (group_kind, group_key)""")
def d3_apply_keep(spark, sf):
    return dec.apply_keep(d.all_items(spark, sf), d.decisions(spark, sf)).drop("job_id")


@query("""
    SELECT group_kind, group_key, file_id, 'trash' AS decision FROM items
    WHERE is_primary = 0 AND group_kind = 'similar'""")
def d4_bulk_decision(spark, sf):
    items = d.all_items(spark, sf)
    groups = items.where("group_kind = 'similar'")
    return dec.bulk_decision(items, "trash", group_keys=groups).select("group_kind", "group_key", "file_id", "decision")


@query("""
    SELECT group_kind, group_key, file_id, (CASE WHEN file_id = max(file_id) OVER (PARTITION BY group_kind, group_key)
           THEN 1 ELSE 0 END)::INT AS is_primary FROM items""")
def d4_bulk_keep_moves_primary(spark, sf):
    """Keeping every member one after another leaves the highest id as primary."""
    items = d.all_items(spark, sf)
    kept = dec.bulk_decision(items, "keep", file_ids=items)
    return dec.apply_keep(items, kept).drop("job_id")


@query("""
    SELECT file_id, decision FROM decided WHERE group_kind = 'exact'
      AND group_key = (SELECT min(signature) FROM exact_groups) ORDER BY file_id""")
def d5_decisions_for_group(spark, sf):
    first = exact.exact_groups(d.exact_cands(spark, sf), d.JOB).agg(F.min("signature")).first()[0]
    return dec.decisions_for_group(d.decisions(spark, sf), "exact", first).select("file_id", "decision")


@query("SELECT * FROM exact_groups ORDER BY signature LIMIT 20 OFFSET 20")
def q1_list_exact_groups(spark, sf):
    groups = exact.exact_groups(d.exact_cands(spark, sf), d.JOB)
    return review.list_groups(groups, "exact", d.JOB, page=2, page_size=20)[0]


@query("""
    SELECT anchor_file_id, count(*) AS file_count FROM similar_members GROUP BY ALL ORDER BY anchor_file_id LIMIT 20""")
def q1_list_similar_groups(spark, sf):
    groups = similar.similar_groups(d.similar_items(spark, sf))
    return review.list_groups(groups, "similar", d.JOB, page_size=20)[0].select("anchor_file_id", "file_count")


@query("SELECT count(*) AS total FROM exact_groups")
def q1_group_total(spark, sf):
    return review.list_groups(exact.exact_groups(d.exact_cands(spark, sf), d.JOB), "exact", d.JOB)[1]


@query("""
    SELECT i.group_kind, i.group_key, i.file_id, i.is_primary, f.abs_path, f.size_bytes, coalesce(c.decision, '-') AS decision
    FROM items i JOIN files f USING (file_id)
    LEFT JOIN decided c ON c.group_kind = i.group_kind AND c.group_key = i.group_key AND c.file_id = i.file_id""")
def q2_group_details(spark, sf):
    details = review.group_details(d.all_items(spark, sf), d.files(spark, sf), d.decisions(spark, sf))
    return details.drop("job_id").withColumn("decision", F.coalesce("decision", F.lit("-")))


@query("""
    SELECT i.file_id, i.is_primary, i.keep_score, i.reason, m.distance_to_anchor, m.confidence, f.abs_path, f.size_bytes,
           coalesce(c.decision, '-') AS decision
    FROM items i JOIN files f USING (file_id)
    JOIN similar_members m ON m.file_id = i.file_id AND m.anchor_file_id::VARCHAR = i.group_key
    LEFT JOIN decided c ON c.group_kind = i.group_kind AND c.group_key = i.group_key AND c.file_id = i.file_id
    WHERE i.group_kind = 'similar'""")
def q2_similar_details(spark, sf):
    items = d.similar_items(spark, sf).select(
        F.lit("similar").alias("group_kind"), "job_id", F.col("anchor_file_id").cast("string").alias("group_key"),
        "file_id", "is_primary", "keep_score", "reason", "distance_to_anchor", "confidence",
    )
    details = review.group_details(items, d.files(spark, sf), d.decisions(spark, sf))
    return details.drop("group_kind", "job_id", "group_key").withColumn("decision", F.coalesce("decision", F.lit("-")))


@query("SELECT group_kind, group_key, file_id FROM items WHERE is_primary = 0")
def q3_non_primary(spark, sf):
    return review.non_primary(d.all_items(spark, sf)).select("group_kind", "group_key", "file_id")


@query("""
    SELECT DISTINCT file_id FROM items i WHERE is_primary = 0 AND group_kind = 'exact'
      AND group_key IN (SELECT signature FROM exact_groups WHERE reclaimable_bytes >= 1000)""")
def q4_scope_selected_groups(spark, sf):
    large = exact.exact_groups(d.exact_cands(spark, sf), d.JOB).where("reclaimable_bytes >= 1000").select(
        F.lit("exact").alias("group_kind"), "job_id", F.col("signature").alias("group_key")
    )
    return review.resolve_scope(d.all_items(spark, sf), "selected_groups", groups=large)


@query("SELECT DISTINCT file_id FROM items WHERE is_primary = 0")
def q4_scope_all_filtered(spark, sf):
    return review.resolve_scope(d.all_items(spark, sf), "all_filtered")
