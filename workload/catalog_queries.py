"""Job catalog, scan roots, integrity checks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift.functions import paths as P
from twinsift.functions import text as X
from twinsift.operators import exact, integrity, jobs, roots, similar
from twinsift.schemas import GROUP_KINDS, ITEM_STATUSES, JOB_MODES, JOB_STATUSES
from workload import derived as d
from workload.registry import query

NOW = "1998-08-02 00:00:00"


def _now():
    return F.to_timestamp(F.lit(NOW))


# ---- jobs -------------------------------------------------------------------------------


@query("""
    SELECT job_id, mode, status, files_seen, files_indexed FROM jobs WHERE status = 'completed' AND mode = 'both'
    ORDER BY requested_at DESC, job_id DESC LIMIT 50 OFFSET 50""")
def j1_list_jobs(spark, sf):
    rows, _ = jobs.list_jobs(d.scan_jobs(spark, sf), "completed", "both", page=2)
    return rows.select("job_id", "mode", "status", "files_seen", "files_indexed")


@query("SELECT count(*) AS total FROM jobs WHERE status = 'failed'")
def j1_list_jobs_total(spark, sf):
    return jobs.list_jobs(d.scan_jobs(spark, sf), status="failed", order="asc")[1]


@query("SELECT job_id, status FROM jobs ORDER BY requested_at DESC, job_id DESC LIMIT 50")
def j2_recent_jobs(spark, sf):
    return jobs.recent_jobs(d.scan_jobs(spark, sf)).select("job_id", "status")


@query("SELECT job_id, status FROM jobs WHERE status NOT IN ('queued', 'running') ORDER BY requested_at DESC, job_id DESC LIMIT 1")
def j3_latest_processed(spark, sf):
    return jobs.latest_processed(d.scan_jobs(spark, sf)).select("job_id", "status")


@query("""
    SELECT job_id, status, string_agg(root_id || ':' || path || ':' || (enabled = 1), ',' ORDER BY root_id) AS roots
    FROM jobs JOIN job_roots USING (job_id) JOIN roots USING (root_id) GROUP BY ALL""")
def j4_job_status(spark, sf):
    rows = jobs.job_status(d.scan_jobs(spark, sf), d.scan_job_roots(spark, sf), d.roots(spark))
    line = lambda r: F.concat_ws(":", r["id"].cast("string"), r["path"], r["enabled"].cast("string"))
    return rows.select("job_id", "status", F.array_join(F.transform("roots", line), ",").alias("roots"))


def _of_jobs(df, column):
    """Rows spread over many jobs by a number."""
    return df.withColumn("job_id", F.concat(F.lit("job-"), (F.col(column) % 1000).cast("string")))


def _groups(spark, sf):
    return (
        _of_jobs(exact.exact_groups(d.exact_cands(spark, sf), d.JOB), "reclaimable_bytes"),
        _of_jobs(similar.similar_groups(d.similar_items(spark, sf)), "anchor_file_id"),
    )


def _delete_failed(spark, sf):
    table = d.scan_jobs(spark, sf)
    return jobs.delete_jobs(
        table.where("status = 'failed'"), table, d.scan_job_roots(spark, sf), d.files(spark, sf), *_groups(spark, sf),
        _of_jobs(d.exact_items(spark, sf), "file_id"), _of_jobs(d.similar_items(spark, sf), "file_id"),
    )


def _dependencies(spark, sf):
    groups, similar_groups = _groups(spark, sf)
    return jobs.delete_dependencies(
        d.scan_jobs(spark, sf), groups, similar_groups, d.action_items(spark, sf), d.files(spark, sf)
    )


_DEPENDENCIES = """
    SELECT job_id, coalesce(e.n, 0) AS exact_groups, coalesce(s.n, 0) AS similar_groups, coalesce(a.n, 0)::BIGINT AS action_items
    FROM jobs
    LEFT JOIN (SELECT 'job-' || (reclaimable_bytes % 1000) AS job_id, count(*) AS n FROM exact_groups GROUP BY 1) e USING (job_id)
    LEFT JOIN (SELECT 'job-' || (anchor_file_id % 1000) AS job_id, count(*) AS n
               FROM (SELECT DISTINCT anchor_file_id FROM similar_members) GROUP BY 1) s USING (job_id)
    LEFT JOIN (SELECT j AS job_id, count(*) AS n
               FROM (SELECT DISTINCT item_id, unnest([first_seen_job_id, last_seen_job_id]) AS j FROM action_items JOIN files USING (file_id))
               GROUP BY 1) a USING (job_id)"""


@query(_DEPENDENCIES)
def j5_delete_dependencies(spark, sf):
    return _dependencies(spark, sf)


@query("""
    SELECT job_id, requested_at <= TIMESTAMP '1998-08-02 00:00:00' - INTERVAL 7200 SECOND AS stale FROM jobs""")
def j6_is_stale(spark, sf):
    stale = X.is_stale(F.col("requested_at"), _now(), 7200)
    return d.scan_jobs(spark, sf).select("job_id", stale.alias("stale"))


@query(f"""
    SELECT job_id, status, CASE WHEN status = 'running' AND requested_at > TIMESTAMP '1998-08-02 00:00:00' - INTERVAL 7200 SECOND THEN 'not_stale'
             WHEN exact_groups + similar_groups + action_items > 0 THEN 'blocked' ELSE 'ok' END AS verdict
    FROM jobs JOIN ({_DEPENDENCIES}) USING (job_id)""")
def j7_deletable(spark, sf):
    return jobs.deletable(d.scan_jobs(spark, sf), _dependencies(spark, sf), _now(), allow_stale=True)


@query("""
    SELECT file_id, coalesce(CASE WHEN first_seen_job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'failed') THEN first_seen_job_id END, '-') AS first_seen_job_id,
           coalesce(CASE WHEN last_seen_job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'failed') THEN last_seen_job_id END, '-') AS last_seen_job_id
    FROM files""")
def j8_delete_jobs(spark, sf):
    after = _delete_failed(spark, sf)
    shown = [F.coalesce(c, F.lit("-")).alias(c) for c in ("first_seen_job_id", "last_seen_job_id")]
    return after["files"].select("file_id", *shown)


@query("SELECT job_id, root_id FROM job_roots WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'failed')")
def j8_delete_jobs_cascade(spark, sf):
    return _delete_failed(spark, sf)["job_roots"]


@query("""
    SELECT kind, job_id, key, file_id
    FROM (SELECT 'exact' AS kind, 'job-' || (file_id % 1000) AS job_id, signature AS key, file_id FROM exact_members
          UNION ALL SELECT 'similar', 'job-' || (file_id % 1000), anchor_file_id::VARCHAR, file_id FROM similar_members
          UNION ALL SELECT 'exact_group', 'job-' || (reclaimable_bytes % 1000), signature, 0 FROM exact_groups
          UNION ALL SELECT 'similar_group', 'job-' || (anchor_file_id % 1000), anchor_file_id::VARCHAR, 0
                    FROM (SELECT DISTINCT anchor_file_id FROM similar_members))
    WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'failed')""")
def j8_delete_jobs_groups(spark, sf):
    after = _delete_failed(spark, sf)
    shown = lambda name, kind, key, file_id: after[name].select(
        F.lit(kind).alias("kind"), "job_id", F.col(key).cast("string").alias("key"), file_id.cast("long").alias("file_id")
    )
    none = F.lit(0)
    return (
        shown("exact_items", "exact", "signature", F.col("file_id"))
        .unionByName(shown("similar_items", "similar", "anchor_file_id", F.col("file_id")))
        .unionByName(shown("exact_groups", "exact_group", "signature", none))
        .unionByName(shown("similar_groups", "similar_group", "anchor_file_id", none))
    )


@query("""
    SELECT job_id, CASE WHEN k % 2 = 0 THEN files_seen + 1 ELSE files_seen END AS files_seen,
           CASE WHEN k % 3 = 0 THEN k ELSE files_indexed END AS files_indexed FROM jobs""")
def j9_merge_metrics(spark, sf):
    table = d.scan_jobs(spark, sf)
    key = F.split("job_id", "-")[1].cast("long")
    new = table.select(
        "job_id",
        F.when(key % 2 == 0, F.col("files_seen") + 1).alias("files_seen"),
        F.when(key % 3 == 0, key).alias("files_indexed"),
    )
    return jobs.merge_metrics(table, new).select("job_id", "files_seen", "files_indexed")


_UUID5 = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
    || lower(to_hex((('0x' || substr(h, 17, 2))::INT & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12)"""
_KEY_HASH = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(key))"


@query(f"""
    SELECT key, {_UUID5} AS job_id FROM (SELECT key, {_KEY_HASH} AS h FROM (SELECT 'key-' || c_custkey AS key FROM customer))""")
def j10_idempotent_job_id(spark, sf):
    key = F.concat(F.lit("key-"), F.col("c_custkey").cast("string"))
    keys = d.table(spark, sf, "customer").select(key.alias("key"))
    return keys.select("key", X.idempotent_job_id(F.col("key")).alias("job_id"))


@query("""
    SELECT seq, request_key, CASE WHEN o_custkey % 5 = 0
             THEN CASE WHEN mode = 'exact' AND root_id = 1 THEN 'existing' ELSE 'conflict' END
             WHEN seq = first_seq THEN 'new' WHEN mode = first_mode THEN 'existing' ELSE 'conflict' END AS outcome
    FROM (SELECT *, min(seq) OVER (PARTITION BY request_key) AS first_seq, min_by(mode, seq) OVER (PARTITION BY request_key) AS first_mode
          FROM requests)""")
def j11_submit_requests(spark, sf):
    """Customers order again and again under their own key; every fifth one already has a job."""
    key = lambda c: F.concat(F.lit("key-"), F.col(c).cast("string"))
    by = F.col("o_custkey")
    mode = F.when(by % 3 == 0, "exact").when(by % 3 == 1, "similar").otherwise(
        F.when(F.col("o_orderkey") % 2 == 0, "both").otherwise("exact")
    )
    asked = d.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), key("o_custkey").alias("request_key"), mode.alias("mode"),
        F.array(by % 3 + 1).alias("root_ids"),
    )
    stored = d.table(spark, sf, "orders").where("o_custkey % 5 = 0").select(
        X.idempotent_job_id(key("o_custkey")).alias("job_id"), F.lit("exact").alias("mode")
    ).distinct()
    stored_roots = stored.select("job_id", F.lit(1).cast("long").alias("root_id"))
    return jobs.submit_requests(asked, stored, stored_roots).drop("job_id")


@query("""
    SELECT o_orderkey AS request_id, CASE o_orderkey % 5 WHEN 0 THEN '1,2' WHEN 1 THEN '1,2' WHEN 4 THEN '1' ELSE '' END AS root_ids,
           CASE o_orderkey % 5 WHEN 2 THEN 'disabled scan root selected' WHEN 3 THEN 'one or more scan roots were not found' ELSE '' END AS error
    FROM orders""")
def j12_resolve_roots(spark, sf):
    key = F.col("o_orderkey")
    ids = lambda *values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    asked = d.table(spark, sf, "orders").select(
        key.alias("request_id"),
        F.when(key % 5 == 0, ids()).when(key % 5 == 1, ids(2, 1, 2)).when(key % 5 == 2, ids(3))
        .when(key % 5 == 3, ids(9, 1)).otherwise(ids(1)).alias("root_ids"),
    )
    rows = roots.resolve_roots(asked, d.roots(spark))
    return rows.select(
        "request_id",
        F.coalesce(F.array_join(F.col("root_ids").cast("array<string>"), ","), F.lit("")).alias("root_ids"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query("""
    SELECT job_id, CASE WHEN status = 'completed' THEN 100 WHEN files_seen <= 0 AND files_indexed <= 0 THEN 0
             ELSE least(100, floor(files_indexed::DOUBLE / greatest(files_seen, files_indexed, 1) * 100 + 0.5)) END::BIGINT AS percent
    FROM jobs""")
def j13_progress_percent(spark, sf):
    percent = X.progress_percent(F.col("status"), F.col("files_seen"), F.col("files_indexed"))
    return d.scan_jobs(spark, sf).select("job_id", percent.alias("percent"))


@query("""
    SELECT job_id, n AS sequence, 'SCAN-' || upper(mode) || '-' || CASE WHEN n < 10000 THEN printf('%04d', n) ELSE n::VARCHAR END AS title
    FROM (SELECT *, row_number() OVER (ORDER BY requested_at, job_id) AS n FROM jobs)""")
def j14_display_names(spark, sf):
    return jobs.display_names(d.scan_jobs(spark, sf))


@query("SELECT mode, status, count(*) AS total, greatest(1, ceil(count(*) / 50.0))::BIGINT AS pages FROM jobs GROUP BY mode, status")
def j15_page_count(spark, sf):
    totals = d.scan_jobs(spark, sf).groupBy("mode", "status").agg(F.count(F.lit(1)).alias("total"))
    return totals.withColumn("pages", X.page_count(F.col("total"), 50))


@query("SELECT bool_or(status IN ('queued', 'running')) AS has_active FROM jobs")
def j16_has_active(spark, sf):
    return jobs.has_active(d.scan_jobs(spark, sf))


@query("SELECT job_id, files_indexed + 1 AS files_indexed FROM jobs WHERE status = 'running'")
def j16_changed_rows(spark, sf):
    """Between two polls every running job indexed one more file."""
    old = d.scan_jobs(spark, sf)
    more = F.when(F.col("status") == "running", F.col("files_indexed") + 1).otherwise(F.col("files_indexed"))
    return jobs.changed_rows(old, old.withColumn("files_indexed", more)).select("job_id", "files_indexed")


# ---- roots ------------------------------------------------------------------------------


def _raw_roots(spark, sf):
    doc = F.col("doc_id")
    source, lang = F.col("source"), F.col("lang")
    path = (
        F.when(doc % 8 == 0, F.concat(F.lit("/nas/"), source, F.lit("/./"), lang))
        .when(doc % 8 == 1, F.concat(F.lit("  /nas//"), source, F.lit("/../"), lang, F.lit("/ ")))
        .when(doc % 8 == 2, F.concat(F.lit("/nas/../etc/"), source))
        .when(doc % 8 == 3, F.concat(F.lit("nas/"), source))
        .when(doc % 8 == 4, F.concat(F.lit("//nas/"), source))
        .when(doc % 8 == 5, F.concat(F.lit("/nasty/"), source))
        .when(doc % 8 == 6, F.lit("   "))
        .otherwise(F.concat(F.lit("/nas/"), source, F.lit("/a/b/../../")))
    )
    return d.table(spark, sf, "documents").select(doc.alias("seq"), path.alias("path"))


@query("SELECT seq, coalesce(canonical, '-') AS canonical, coalesce(error, '-') AS error FROM raw_roots")
def r1_canonical_root(spark, sf):
    shown = lambda c, name: F.coalesce(c, F.lit("-")).alias(name)
    path = F.col("path")
    return _raw_roots(spark, sf).select("seq", shown(P.canonical_root(path), "canonical"), shown(P.root_error(path), "error"))


@query("""
    SELECT seq, coalesce(canonical, '-') AS canonical,
           CASE WHEN canonical IS NULL THEN 'invalid'
                WHEN canonical IN (SELECT '/nas/' || lang FROM documents)
                  OR seq > min(seq) OVER (PARTITION BY canonical) THEN 'conflict' ELSE 'created' END AS outcome
    FROM raw_roots""")
def r2_register_roots(spark, sf):
    known = d.table(spark, sf, "documents").select(F.concat(F.lit("/nas/"), "lang").alias("path")).distinct()
    rows = roots.register_roots(_raw_roots(spark, sf), known)
    return rows.select("seq", F.coalesce("canonical", F.lit("-")).alias("canonical"), "outcome")


@query("SELECT root_id, path FROM roots WHERE root_id IN (SELECT root_id FROM job_roots UNION SELECT root_id FROM files)")
def r3_roots_in_use(spark, sf):
    return roots.roots_in_use(d.roots(spark), d.scan_job_roots(spark, sf), d.files(spark, sf)).select("root_id", "path")


@query("""
    SELECT job_id, first_root AS root_id, '/nas/root' || first_root AS path, n AS roots_count
    FROM (SELECT job_id, min(root_id) AS first_root, count(*) AS n FROM job_roots GROUP BY job_id)""")
def r4_first_root_of_job(spark, sf):
    return roots.first_root_of_job(d.scan_job_roots(spark, sf), d.roots(spark))


# ---- integrity --------------------------------------------------------------------------


@query("""
    SELECT 'mode' AS column_name, mode AS value, count(*) AS rows FROM jobs WHERE mode NOT IN ('exact', 'similar') GROUP BY mode
    UNION ALL
    SELECT 'status', status, count(*) FROM jobs WHERE status NOT IN ('pending', 'done', 'failed', 'skipped') GROUP BY status""")
def v1_check_enums(spark, sf):
    """Values that are allowed elsewhere but not in the lists given here."""
    return integrity.check_enums(d.scan_jobs(spark, sf), {"mode": GROUP_KINDS, "status": ITEM_STATUSES})


@query("SELECT count(*) AS rows FROM jobs WHERE false")
def v1_jobs_have_known_values(spark, sf):
    wrong = integrity.check_enums(d.scan_jobs(spark, sf), {"mode": JOB_MODES, "status": JOB_STATUSES})
    return wrong.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


@query("SELECT hash_type, hash_hex, count(*) AS rows FROM hash_rows GROUP BY ALL HAVING count(*) > 1")
def v2_check_unique(spark, sf):
    return integrity.check_unique(d.file_hashes(spark, sf), ["hash_type", "hash_hex"])


@query("""
    SELECT file_id, count(*) AS rows FROM action_items WHERE file_id NOT IN (SELECT file_id FROM files WHERE is_present = 1) GROUP BY file_id""")
def v3_check_fk(spark, sf):
    """Action items on files that are not present."""
    present = d.files(spark, sf).where("is_present = 1")
    return integrity.check_fk(d.action_items(spark, sf), "file_id", present, "file_id")


@query("""
    SELECT group_kind, group_key, sum(p)::BIGINT AS primaries, count(*) AS members
    FROM (SELECT group_kind, group_key, CASE WHEN file_id % 2 = 0 THEN 1 ELSE 0 END AS p FROM items)
    GROUP BY ALL HAVING sum(p) <> 1""")
def v4_check_one_primary(spark, sf):
    """A wrong rule (even ids are primary) must be caught."""
    wrong = d.all_items(spark, sf).withColumn("is_primary", (F.col("file_id") % 2 == 0).cast("int"))
    return integrity.check_one_primary(wrong, ["group_kind", "group_key"])


@query("SELECT 0::BIGINT AS broken_groups")
def v4_scored_groups_have_one_primary(spark, sf):
    broken = integrity.check_one_primary(d.all_items(spark, sf), ["group_kind", "group_key"])
    return broken.agg(F.count(F.lit(1)).alias("broken_groups"))


# ---- scalar functions -------------------------------------------------------------------


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN b <= 0 THEN '0 B' WHEN b < 1024 THEN b || ' B' WHEN b < 1024**2 THEN printf('%.1f KB', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10)
             WHEN b < 1024**3 THEN printf('%.1f MB', floor(b / (1024.0::DOUBLE**2) * 10 + 0.5) / 10)
             WHEN b < 1024**4 THEN printf('%.1f GB', floor(b / (1024.0::DOUBLE**3) * 10 + 0.5) / 10)
             ELSE printf('%.1f TB', floor(b / (1024.0::DOUBLE**4) * 10 + 0.5) / 10) END AS shown
    FROM (SELECT *, l_partkey * CASE l_linenumber % 5 WHEN 0 THEN 1 WHEN 1 THEN 997 WHEN 2 THEN 1048576 WHEN 3 THEN 777777777 ELSE 98765432109 END AS b FROM lineitem)""")
def u1_format_bytes(spark, sf):
    scale = (
        F.when(F.col("l_linenumber") % 5 == 0, 1).when(F.col("l_linenumber") % 5 == 1, 997)
        .when(F.col("l_linenumber") % 5 == 2, 1_048_576).when(F.col("l_linenumber") % 5 == 3, 777_777_777)
        .otherwise(98_765_432_109)
    )
    rows = d.table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", X.format_bytes(F.col("l_partkey") * scale).alias("shown"))


@query("""
    SELECT page_id, CASE WHEN p = '' THEN '-' WHEN length(p) > 72 THEN '...' || right(p, 69) ELSE p END AS shown
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN url ELSE url || '/' || url || '/' || url END AS p FROM pages)""")
def u2_short_path(spark, sf):
    url, page = F.col("url"), F.col("page_id")
    path = F.when(page % 3 == 0, "").when(page % 3 == 1, url).otherwise(F.concat_ws("/", url, url, url))
    return d.table(spark, sf, "pages").select("page_id", P.short_path(path).alias("shown"))


@query("""
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts))
             WHEN 2 THEN epoch_us(date_trunc('second', ts)) - 7200000000 ELSE -1 END AS micros FROM events""")
def u3_parse_ts(spark, sf):
    event, ts = F.col("event_id"), F.col("ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(event % 4 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(event % 4 == 1, F.concat(iso, F.lit("Z")))
        .when(event % 4 == 2, F.concat(iso, F.lit("+02:00")))
        .otherwise("soon")
    )
    micros = F.coalesce(F.unix_micros(X.parse_ts(text)), F.lit(-1))
    return d.table(spark, sf, "events").select("event_id", micros.alias("micros"))


@query("""
    SELECT event_id, CASE event_type WHEN 'view' THEN 'restore' WHEN 'click' THEN 'move_to_trash' WHEN 'purchase' THEN 'delete_permanent' ELSE '-' END AS action
    FROM events""")
def u4_normalize_action(spark, sf):
    kind = F.col("event_type")
    raw = F.when(kind == "view", " Restore ").when(kind == "click", "MOVE_TO_TRASH").when(
        kind == "purchase", "delete_permanent"
    ).otherwise(kind)
    return d.table(spark, sf, "events").select(
        "event_id", F.coalesce(X.normalize_action(raw), F.lit("-")).alias("action")
    )


@query("""
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'job-' || user_id ELSE 'none' END || '|exact|selected|restore|'
             || CASE WHEN event_id % 3 = 0 THEN 'none' ELSE user_id::VARCHAR END || '|' || event_id || ',' || (event_id + 1) AS signature
    FROM events""")
def u5_preview_signature(spark, sf):
    event, user = F.col("event_id"), F.col("user_id").cast("string")
    signature = X.preview_signature(
        F.when(event % 2 == 0, F.concat(F.lit("job-"), user)), F.lit("exact"), F.lit("selected"), F.lit("restore"),
        F.when(event % 3 != 0, user), F.array(event, event + 1),
    )
    return d.table(spark, sf, "events").select("event_id", signature.alias("signature"))
