"""The derived tables once more, as SQL common table expressions for the check engine."""

from __future__ import annotations

import re

TABLES = {
    "roots": """
        SELECT * FROM (VALUES (1::BIGINT, '/nas/root1', 1), (2, '/nas/root2', 1), (3, '/nas/root3', 0))
        AS t(root_id, path, enabled)""",
    "files": """
        SELECT doc_id, doc_id + 1 AS file_id, doc_id % 3 + 1 AS root_id,
               source || '/' || lang || '/' || doc_id || '.txt' AS rel_path,
               '/nas/root' || (doc_id % 3 + 1) || '/' || source || '/' || lang || '/' || doc_id || '.txt' AS abs_path,
               doc_id || '.txt' AS file_name,
               strlen(text)::BIGINT AS size_bytes,
               1700000000000000000 + (doc_id * 7919 % 1000) * 1000000000 AS mtime_epoch_ns,
               (CASE WHEN doc_id % 4 <> 0 THEN doc_id % 5 * 100 END)::INT AS width,
               (doc_id % 3 * 100)::INT AS height,
               CASE doc_id % 3 WHEN 0 THEN '2020-01-01' WHEN 1 THEN '' END AS exif,
               'job-' || doc_id AS first_seen_job_id,
               'job-' || (doc_id + doc_id % 2) AS last_seen_job_id,
               (CASE WHEN doc_id % 11 <> 0 THEN 1 ELSE 0 END)::INT AS is_present,
               text
        FROM documents""",
    "listed_twice": """
        SELECT root_id, rel_path, abs_path, size_bytes, mtime_epoch_ns FROM files
        UNION ALL
        SELECT 4, substr(abs_path, 6), abs_path, size_bytes, mtime_epoch_ns FROM files
        WHERE (mtime_epoch_ns // 1000000000) % 5 = 0""",
    "prev_files": """
        SELECT file_id, root_id, abs_path, size_bytes - (CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS size_bytes,
               mtime_epoch_ns, width, first_seen_job_id, last_seen_job_id, is_present
        FROM files WHERE doc_id % 10 <> 0
        UNION ALL
        SELECT file_id + 1000000, root_id, abs_path || '.old', size_bytes,
               mtime_epoch_ns, width, first_seen_job_id, last_seen_job_id, is_present
        FROM files WHERE doc_id % 13 = 0""",
    "index_before": """
        SELECT file_id, root_id, rel_path, abs_path, file_name, size_bytes - (CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS size_bytes,
               mtime_epoch_ns, width, height, exif, first_seen_job_id, last_seen_job_id, is_present
        FROM files WHERE doc_id % 10 <> 0
        UNION ALL
        SELECT file_id + 1000000, root_id, rel_path || '.old', abs_path || '.old', file_name || '.old', size_bytes, mtime_epoch_ns,
               width, height, exif, first_seen_job_id, last_seen_job_id, is_present
        FROM files WHERE doc_id % 13 = 0""",
    "changes": """
        SELECT f.abs_path, f.size_bytes, p.file_id IS NULL AS is_new,
               p.file_id IS NULL OR p.size_bytes <> f.size_bytes OR p.mtime_epoch_ns <> f.mtime_epoch_ns
                 OR p.is_present <> 1 AS changed
        FROM files f LEFT JOIN prev_files p USING (abs_path)""",
    "samples": """
        SELECT file_id, strlen(text) AS n, hx,
               list_transform(range(0, 65), lambda i: CASE WHEN n > 65 THEN floor(i * (n / 65.0::DOUBLE))::BIGINT ELSE i END) AS at65,
               list_transform(range(0, 64), lambda i: CASE WHEN n > 64 THEN floor(i * (n / 64.0::DOUBLE))::BIGINT ELSE i END) AS at64
        FROM (SELECT file_id, text, strlen(text) AS n, hex(encode(text)) AS hx FROM files)""",
    "sampled": """
        SELECT file_id, n,
               list_transform(at65, lambda i: ('0x' || substr(hx, 2 * least(i, n - 1) + 1, 2))::INT) AS s65,
               list_transform(at64, lambda i: ('0x' || substr(hx, 2 * least(i, n - 1) + 1, 2))::INT) AS s64
        FROM samples""",
    "prints": """
        SELECT file_id,
               CASE WHEN n = 0 THEN 0::UBIGINT ELSE ('0b' || array_to_string(list_transform(range(1, 65),
                 lambda i: CASE WHEN s65[i] > s65[i + 1] THEN '1' ELSE '0' END), ''))::UBIGINT END AS dprint,
               CASE WHEN n = 0 THEN 0::UBIGINT ELSE ('0b' || array_to_string(list_transform(s64,
                 lambda v: CASE WHEN v >= list_sum(s64) / 64.0::DOUBLE THEN '1' ELSE '0' END), ''))::UBIGINT END AS pprint
        FROM sampled""",
    "hashes": """
        SELECT file_id, sha256(text) AS blake3_full, lpad(lower(to_hex(dprint)), 16, '0') AS dhash64,
               lpad(lower(to_hex(pprint)), 16, '0') AS phash64, pprint
        FROM prints JOIN files USING (file_id)""",
    "hash_rows": """
        SELECT file_id, 'blake3_full' AS hash_type, blake3_full AS hash_hex FROM hashes
        UNION ALL SELECT file_id, 'dhash64', dhash64 FROM hashes
        UNION ALL SELECT file_id, 'phash64', phash64 FROM hashes""",
    "exact_cands": """
        SELECT file_id, size_bytes, sha256(text) AS signature FROM files WHERE is_present = 1""",
    "exact_groups": """
        SELECT 'job-current' AS job_id, signature, count(*) AS file_count, sum(size_bytes)::BIGINT AS total_bytes,
               (sum(size_bytes) - max(size_bytes))::BIGINT AS reclaimable_bytes
        FROM exact_cands GROUP BY signature HAVING count(*) > 1""",
    "exact_members": """
        SELECT 'job-current' AS job_id, signature, file_id,
               (CASE WHEN file_id = min(file_id) OVER (PARTITION BY signature) THEN 1 ELSE 0 END)::INT AS is_primary
        FROM exact_cands WHERE signature IN (SELECT signature FROM exact_groups)""",
    "similar_cands": """
        SELECT file_id, pprint FROM hashes JOIN files USING (file_id) WHERE is_present = 1""",
    "nodes": """
        SELECT pprint AS p, count(*) AS copies, min(file_id) AS first_id FROM similar_cands GROUP BY pprint""",
    "near": """
        SELECT a.p AS a, b.p AS b FROM nodes a JOIN nodes b ON a.p <> b.p AND bit_count(xor(a.p, b.p)) <= 8""",
    "before": """
        SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN dprint ELSE pprint END AS p
        FROM prints JOIN files USING (file_id) WHERE doc_id % 10 <> 0""",
    "reached": """
        SELECT a AS start, b AS p FROM near UNION SELECT r.start, n.b FROM reached r JOIN near n ON n.a = r.p""",
    "labels_of": """
        SELECT n.p, min(f.first_id) AS anchor_file_id, sum(f.copies) AS files
        FROM nodes n
        JOIN (SELECT p AS start, p FROM nodes UNION SELECT start, p FROM reached) r ON r.start = n.p
        JOIN nodes f ON f.p = r.p
        GROUP BY n.p HAVING sum(f.copies) > 1""",
    "all_copies": """
        SELECT sum(size_bytes) - max(size_bytes) AS reclaimable FROM files GROUP BY sha256(text) HAVING count(*) > 1""",
    "all_nodes": """
        SELECT pprint AS p, count(*) AS copies, min(file_id) AS first_id FROM hashes GROUP BY pprint""",
    "all_near": """
        SELECT a.p AS a, b.p AS b FROM all_nodes a JOIN all_nodes b ON a.p <> b.p AND bit_count(xor(a.p, b.p)) <= 8""",
    "all_reached": """
        SELECT a AS start, b AS p FROM all_near UNION SELECT r.start, n.b FROM all_reached r JOIN all_near n ON n.a = r.p""",
    "similar_members": """
        SELECT 'job-current' AS job_id, l.anchor_file_id, c.file_id,
               bit_count(xor(c.pprint, a.pprint))::BIGINT AS distance_to_anchor,
               round_even(1 - bit_count(xor(c.pprint, a.pprint)) / 64.0::DOUBLE, 4)::DOUBLE AS confidence,
               (CASE WHEN c.file_id = l.anchor_file_id THEN 1 ELSE 0 END)::INT AS is_primary
        FROM similar_cands c JOIN labels_of l ON l.p = c.pprint JOIN similar_cands a ON a.file_id = l.anchor_file_id""",
    "plain_items": """
        SELECT 'exact' AS group_kind, signature AS group_key, file_id FROM exact_members
        UNION ALL SELECT 'similar', anchor_file_id::VARCHAR, file_id FROM similar_members""",
    "rated": """
        SELECT group_kind, group_key, file_id, res, size_bytes, exif, mtime_epoch_ns,
               max(res) OVER g AS max_res, max(size_bytes) OVER g AS max_size, min(mtime_epoch_ns) OVER g AS min_mtime
        FROM (SELECT i.*, coalesce(width, 0)::BIGINT * coalesce(height, 0) AS res, size_bytes, exif, mtime_epoch_ns
              FROM plain_items i JOIN files USING (file_id))
        WINDOW g AS (PARTITION BY group_kind, group_key)""",
    "scored": """
        SELECT group_kind, group_key, file_id,
               (CASE WHEN res > 0 AND res = max_res THEN 5 ELSE 0 END + CASE WHEN size_bytes = max_size THEN 3 ELSE 0 END
                + CASE WHEN coalesce(exif, '') <> '' THEN 2 ELSE 0 END
                + CASE WHEN mtime_epoch_ns = min_mtime THEN 1 ELSE 0 END)::DOUBLE AS keep_score,
               coalesce(nullif(concat_ws(',', CASE WHEN res > 0 AND res = max_res THEN 'max_resolution' END,
                 CASE WHEN size_bytes = max_size THEN 'max_size' END,
                 CASE WHEN coalesce(exif, '') <> '' THEN 'has_exif_datetime' END,
                 CASE WHEN mtime_epoch_ns = min_mtime THEN 'earliest_mtime' END), ''), 'fallback_lowest_file_id') AS reason
        FROM rated""",
    "items": """
        SELECT group_kind, 'job-current' AS job_id, group_key, file_id, keep_score, reason,
               (CASE WHEN row_number() OVER (PARTITION BY group_kind, group_key ORDER BY keep_score DESC, file_id) = 1
                THEN 1 ELSE 0 END)::INT AS is_primary
        FROM scored""",
    "labelled": """
        SELECT doc_id + 1 AS file_id,
               CASE WHEN toxic = 1 THEN 'delete' WHEN quality = 1 THEN 'keep' ELSE 'trash' END AS decision, doc_id AS seq
        FROM labels""",
    "decided": """
        SELECT group_kind, job_id, group_key, file_id, decision, seq FROM labelled JOIN items USING (file_id)""",
    "jobs": """
        SELECT o_orderkey AS k, 'job-' || o_orderkey AS job_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'similar' ELSE 'both' END AS mode,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
               o_orderdate AS requested_at, epoch_us(o_orderdate) AS requested_us,
               o_custkey AS files_seen, o_custkey % 100 AS files_indexed
        FROM orders""",
    "job_roots": """
        SELECT 'job-' || o_orderkey AS job_id, o_orderkey % 3 + 1 AS root_id FROM orders
        UNION ALL SELECT 'job-' || o_orderkey, (o_orderkey + 1) % 3 + 1 FROM orders WHERE o_orderkey % 4 = 0""",
    "action_items": """
        SELECT event_id AS item_id, event_id // 200 AS b, 'batch-' || (event_id // 200) AS batch_id,
               event_id % 200 + 1 AS file_id,
               CASE WHEN (event_id // 200) % 5 = 0 THEN 'done' WHEN (event_id // 200) % 5 = 1 THEN 'failed'
                    WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'skipped' ELSE 'done' END AS status
        FROM events""",
    "batch_states": """
        SELECT batch_id, b, count_if(status = 'done')::BIGINT AS done, count_if(status = 'failed')::BIGINT AS failed,
               CASE WHEN count_if(status = 'failed') = 0 THEN 'executed'
                    WHEN count_if(status = 'done') > 0 THEN 'partially_failed' ELSE 'failed' END AS status
        FROM action_items GROUP BY batch_id, b""",
    "batches": """
        SELECT batch_id, CASE WHEN b % 7 = 6 THEN 'restore' ELSE 'move_to_trash' END AS action_type,
               CASE WHEN b % 10 = 9 THEN 'draft' ELSE status END AS status
        FROM batch_states""",
    "movements": """
        SELECT event_id AS movement_id, event_id % 200 + 1 AS file_id, 'batch-' || (event_id // 200) AS batch_id,
               abs_path AS from_path, '/nas/.trash' || abs_path AS to_path,
               event_id % 3 = 0 OR (event_id // 200) % 4 = 0 AS restored
        FROM events JOIN files ON files.file_id = event_id % 200 + 1
        WHERE event_type IN ('view', 'click')""",
    "in_trash": """
        SELECT '/nas/.trash' || abs_path AS path FROM files WHERE doc_id % 5 = 0
        UNION ALL SELECT '/nas/.trash' || abs_path[:-5] || '.1.txt' FROM files WHERE doc_id % 10 = 0""",
    "requests": """
        SELECT o_orderkey AS seq, 'key-' || o_custkey AS request_key, o_custkey,
               CASE o_custkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'similar'
                    ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'both' ELSE 'exact' END END AS mode,
               (o_custkey % 3 + 1) AS root_id
        FROM orders""",
    "raw_roots": """
        SELECT doc_id AS seq, CASE doc_id % 8 WHEN 0 THEN '/nas/' || source || '/./' || lang
                 WHEN 1 THEN '  /nas//' || source || '/../' || lang || '/ ' WHEN 2 THEN '/nas/../etc/' || source
                 WHEN 3 THEN 'nas/' || source WHEN 4 THEN '//nas/' || source WHEN 5 THEN '/nasty/' || source
                 WHEN 6 THEN '   ' ELSE '/nas/' || source || '/a/b/../../' END AS path,
               CASE doc_id % 8 WHEN 0 THEN '/nas/' || source || '/' || lang WHEN 1 THEN '/nas/' || lang
                 WHEN 4 THEN '//nas/' || source WHEN 7 THEN '/nas/' || source END AS canonical,
               CASE doc_id % 8 WHEN 2 THEN 'path must be under ''/nas''' WHEN 3 THEN 'path must be absolute'
                 WHEN 5 THEN 'path must be under ''/nas''' WHEN 6 THEN 'path must not be empty' END AS error
        FROM documents""",
}


def with_tables(query: str) -> str:
    """Prefix a query with the tables it needs, directly or through other tables."""
    needed: list[str] = []

    def need(text: str, own: str = "") -> None:
        words = set(re.findall(r"\b\w+\b", text))
        for name, body in TABLES.items():
            if name in words and name != own and name not in needed:
                need(body, name)
                if name not in needed:
                    needed.append(name)

    need(query)
    if not needed:
        return query
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in needed) + "\n" + query
