"""Statements for ``timedspark.plans.store_queries``."""

from oracle.base import define, oracle

define("usr", """
  SELECT c_custkey AS user_id, c_name AS name, g AS "group",
         CASE g WHEN 'BUILDING' THEN NULL WHEN 'free' THEN 1 ELSE 2 END::INTEGER AS monthly_videos,
         CASE g WHEN 'MACHINERY' THEN NULL WHEN 'free' THEN 30 ELSE 400 END::INTEGER AS retention_days, g = 'AUTOMOBILE' AS admin
  FROM (SELECT *, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN c_mktsegment ELSE 'free' END AS g FROM customer)""")
define("jb", """
  SELECT *, CASE WHEN state <> 'queued' THEN created_at + INTERVAL 1 DAY END AS finished_at,
         CASE WHEN job_id % 6 = 0 THEN created_at + INTERVAL 1 DAY END AS purged_at FROM (
    SELECT o_orderkey AS job_id, o_custkey AS user_id, o_orderkey % 4 AS video_id,
         CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'queued' WHEN o_orderkey % 3 = 0 THEN 'expired' ELSE 'failed' END AS state,
         o_orderdate AS created_at, o_orderstatus <> 'P' AS reserved FROM orders)""")
define("rl", """
  SELECT l_orderkey AS job_id, l_linenumber AS line, l_partkey AS part, 'reel-' || l_linenumber || '-' || l_partkey AS path, l_returnflag AS title FROM lineitem""")
define("xj", """
  SELECT j.*, retention_days FROM jb j JOIN usr u ON u.user_id = j.user_id WHERE retention_days IS NOT NULL
   AND ((state IN ('completed', 'partial', 'failed') AND finished_at < TIMESTAMP '1999-01-01' - to_days(retention_days))
        OR (state = 'expired' AND purged_at IS NULL))""")
oracle("access_limits", 'SELECT user_id, "group", monthly_videos, retention_days, admin FROM usr')
oracle("quota_use", """
SELECT u.user_id, count(job_id) AS used, coalesce(count(job_id) >= max(monthly_videos), false) AS "full"
FROM usr u LEFT JOIN jb j ON j.user_id = u.user_id AND strftime(created_at, '%Y-%m') = '1997-05' AND reserved GROUP BY u.user_id""")
oracle("job_states", "SELECT state, count(*) AS n FROM jb j GROUP BY ROLLUP (state)")
oracle("retention", "SELECT job_id, user_id, state, retention_days FROM xj")
oracle("kept_reels", "SELECT job_id, count(*) AS reels FROM rl r WHERE job_id NOT IN (SELECT job_id FROM xj) GROUP BY job_id")
oracle("idempotent_submits", """
WITH r AS (SELECT event_id, user_id, event_id % 25 AS request_key, event_type, min(event_id) OVER (PARTITION BY user_id, event_id % 25) AS f,
                  arg_min(event_type, event_id) OVER (PARTITION BY user_id, event_id % 25) AS ft FROM events)
SELECT event_id, user_id, request_key, CASE WHEN event_id = f THEN 'created' WHEN event_type = ft THEN 'repeated' ELSE 'conflict' END AS outcome FROM r""")
oracle("existing_jobs", """
SELECT user_id, video_id, arg_max(job_id, {'c': created_at, 'j': job_id}) AS job_id FROM jb j
WHERE state IN ('queued', 'running', 'completed', 'partial') GROUP BY ALL""")
oracle("upsert_users", """
WITH b AS (SELECT c_custkey AS user_id, c_name AS name, 0 AS t, 0 AS side FROM customer
           UNION ALL SELECT user_id * 3, event_type, event_id, 1 FROM events)
SELECT user_id, arg_max(name, {'a': t, 's': side}) AS name, max(t)::BIGINT AS "at" FROM b GROUP BY user_id""")
oracle("merge_users", """
WITH b AS (SELECT c_custkey AS user_id, c_name AS name, 0 AS t, 0 AS side FROM customer
           UNION ALL SELECT user_id * 3, event_type, event_id, 1 FROM events)
SELECT user_id, arg_max(name, {'a': t, 's': side}) AS name, max(t)::BIGINT AS "at" FROM b GROUP BY user_id""")
oracle("insert_ignore", """
SELECT job_id, min(line * 1000000 + part)::BIGINT AS "at" FROM rl r WHERE line > 2 AND job_id NOT IN (SELECT job_id FROM rl WHERE line <= 2) GROUP BY job_id""")
oracle("upload_status", """
WITH u AS (SELECT o_orderkey AS job_id, round(o_totalprice)::BIGINT * 400 + 1 AS size FROM orders),
c AS (SELECT l_orderkey AS job_id, list_sort(list_distinct(list(l_linenumber - 1)))::BIGINT[] AS idx, sum(round(l_extendedprice)::BIGINT)::BIGINT AS b FROM lineitem GROUP BY ALL)
SELECT u.job_id, size, coalesce(b, 0) AS received_bytes, coalesce(len(idx), 0) AS chunks, ceil(size / 32000000)::BIGINT AS total_chunks,
       coalesce(idx = range(ceil(size / 32000000)::BIGINT), false) AS complete FROM u LEFT JOIN c USING (job_id)""")
oracle("corrupt_chunks", """
SELECT job_id, chunk_index, chunk_bytes, sha256(part::VARCHAR) AS sha256 FROM (
  SELECT l_orderkey AS job_id, l_linenumber AS chunk_index, max(l_partkey) AS part, min(l_quantity::BIGINT) AS chunk_bytes FROM lineitem GROUP BY ALL)
WHERE part % 11 = 0 OR part % 13 = 0 OR part % 17 = 0""")
oracle("upload_admission", """
SELECT page_id, CASE WHEN page_id % 7 = 2 THEN 'filename' WHEN page_id % 7 = 1 THEN 'suffix' WHEN page_id % 11 = 3 THEN 'size' WHEN page_id % 13 = 4 THEN 'container'
   WHEN page_id % 5 = 0 THEN 'streams' WHEN page_id * 150 = 0 OR page_id * 150 > 10800 THEN 'duration' END AS refused FROM pages""")
oracle("added_columns", "SELECT job_id, user_id, CASE WHEN job_id % 2 = 1 AND job_id % 3 = 0 THEN 'upload' ELSE 'link' END AS source_type FROM jb j")
oracle("fingerprint_todo", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 3 = 1 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
oracle("fingerprint_reuse", """
SELECT o_orderkey AS key, sha256('{"settings":"' || o_orderstatus || '","words":' || o_custkey || '}') AS fingerprint FROM orders
WHERE NOT (o_orderkey % 3 = 1 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0)""")
oracle("resume_selection", """
WITH s AS (SELECT media_id, seq, start_ms, start_ms + (end_ms - start_ms) // 4 AS end_ms FROM ev WHERE kind = 'purchase'),
x AS (SELECT * FROM ev WHERE kind = 'signup'),
f AS (SELECT s.*, max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
             EXISTS (SELECT 1 FROM x WHERE x.media_id = s.media_id AND x.start_ms < s.end_ms AND x.end_ms > s.start_ms) AS hit FROM s)
SELECT media_id, bool_and(media_id % 9 <> 0 AND seq % 61 <> 0 AND NOT hit AND NOT coalesce(start_ms < reach, false)) AND count(*) <= 12 AS resumable FROM f GROUP BY media_id""")
oracle("newest_jobs_page", "SELECT job_id, created_at FROM jb j ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 50")
oracle("ready_tasks", """
SELECT job_id, created_at FROM jb j WHERE job_id % 2 = 0 AND state = 'queued'
 AND (job_id % 3 = 0 OR (job_id % 3 = 1 AND created_at + INTERVAL 200 DAY < TIMESTAMP '1999-01-01')) ORDER BY created_at, job_id LIMIT 20""")
oracle("job_cards", """
SELECT j.job_id, name, coalesce(n, 0) AS ready_count, t AS first_title FROM jb j JOIN usr u ON u.user_id = j.user_id
LEFT JOIN (SELECT job_id, count(*) AS n, arg_min(title, {'p': path, 't': title}) AS t FROM rl GROUP BY ALL) r ON r.job_id = j.job_id""")
oracle("visible_jobs", "SELECT u.user_id, job_id FROM usr u JOIN jb j ON j.user_id = u.user_id WHERE NOT admin")
oracle("newest_artifact", """
SELECT l_partkey AS key, arg_max(l_orderkey || '/' || l_linenumber, {'d': l_shipdate, 'p': l_orderkey || '/' || l_linenumber}) AS path FROM lineitem GROUP BY ALL""")
oracle("alive_owners", """
SELECT user_id AS owner, max(ts) > TIMESTAMP '2024-01-29 11:00:00' AS alive FROM events WHERE ts <= TIMESTAMP '2024-01-29 12:00:00' GROUP BY ALL""")
oracle("distinct_results", "SELECT DISTINCT job_id, path FROM rl r WHERE job_id % 2 = 0 OR job_id % 3 = 0")
oracle("file_trio_results", """
SELECT 'reels/' || l_orderkey AS stem FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY l_orderkey
HAVING bool_or((l_linenumber - 1) % 4 = 0) AND bool_or((l_linenumber - 1) % 4 = 1) AND bool_or((l_linenumber - 1) % 4 = 2)""")
