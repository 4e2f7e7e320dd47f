"""Statements for ``timedspark.plans.source_queries``."""

from oracle.base import oracle

oracle("nested_transcripts", "SELECT media_id, seq, start_ms, end_ms, text, 1.0::DOUBLE AS confidence FROM words w WHERE turn % 3 <> 2")
oracle("transcript_segments", """
SELECT media_id, 'en' AS language, turn AS seg, start_ms, end_ms, text, CASE WHEN turn % 3 = 2 THEN 0 ELSE n_words END AS n_words FROM segs""")
oracle("flat_words", """
SELECT media_id || '-' || turn AS media_id, pos AS seq, start_ms, end_ms, text, 1.0::DOUBLE AS confidence FROM words w WHERE turn % 3 <> 2""")
oracle("timestamped_text", "SELECT media_id, turn AS seg, '[' || printf('%.2f', start_ms / 1000) || '-' || printf('%.2f', end_ms / 1000) || '] ' || text AS line FROM segs")
oracle("line_transcripts", """
WITH r AS (SELECT media_id, turn AS line_no, (start_ms // 60000) * 60000 + round(printf('%.2f', (start_ms % 60000) / 1000)::DOUBLE * 1000)::BIGINT AS start_ms, text FROM segs WHERE turn <> 1)
SELECT media_id, line_no, start_ms, text, lead(start_ms) OVER (PARTITION BY media_id ORDER BY line_no) AS end_ms FROM r""")
oracle("song_sections", """
SELECT n_regionkey AS library, n_nationkey::VARCHAR AS song_id, 's' || i AS section_id, (n_nationkey * 1000 + i * 1500)::BIGINT AS start_ms,
       (n_nationkey * 1000 + i * 1500 + 20000)::BIGINT AS end_ms, CASE WHEN n_nationkey % 2 = 0 THEN 'ooh' ELSE 'la' END AS vocals
FROM nation, range(2) t(i) WHERE n_nationkey % 7 <> 0 AND n_nationkey % 3 <> i""")
oracle("selection_verdicts", """
SELECT media_id AS path, media_id % 5 <> 4 AND media_id % 20 NOT IN (5, 10, 15) AND NOT bool_or(media_id % 5 IN (1, 2) AND clip = 0) AND NOT bool_or(media_id % 5 = 3 AND score > 100) AS accepted
FROM clips c GROUP BY media_id""")
oracle("saved_clips", """
WITH g AS (SELECT media_id FROM clips GROUP BY media_id HAVING media_id % 5 <> 4 AND media_id % 20 NOT IN (5, 10, 15) AND NOT bool_or(media_id % 5 IN (1, 2) AND clip = 0) AND NOT bool_or(media_id % 5 = 3 AND score > 100))
SELECT media_id AS path, clip_start AS start_ms, clip_end AS end_ms, 'T' || clip AS title, CASE WHEN media_id % 20 = 0 THEN 0 ELSE round(score / CASE WHEN media_id % 5 = 3 THEN 100 ELSE 1000 END, 3) END::DOUBLE AS hook_score
FROM clips c JOIN g USING (media_id)""")
oracle("probed_media", """
WITH p AS (SELECT page_id AS path, page_id AS k, page_id % 11 <> 3 AS v FROM pages),
f AS (SELECT *, CASE WHEN v AND k % 3 = 0 THEN k * 1000 + 250 WHEN k % 4 <> 1 THEN 12500 END AS d, v AND k % 2 = 0 AS a,
             CASE WHEN NOT v OR k % 7 IN (2, 6) THEN 0 WHEN k % 7 = 4 THEN 25 WHEN k % 7 = 5 THEN 29.97::DOUBLE ELSE 30000 / 1001 END AS r FROM p)
SELECT path, d::BIGINT AS duration_ms, round(r, 4)::DOUBLE AS fps, a AS has_audio,
       CASE WHEN NOT v THEN 'no video stream' WHEN d IS NULL THEN 'no duration' WHEN k % 5 = 1 THEN 'bad size' WHEN r = 0 THEN 'bad frame rate' END AS problem FROM f""")
RESPONSES = """
WITH i AS (SELECT w.media_id, w.turn, pos, w.start_ms - s.start_ms AS s, w.end_ms - s.start_ms AS e, n_words, w.text FROM words w JOIN segs s ON s.media_id = w.media_id AND s.turn = w.turn),
v AS (SELECT media_id, turn, turn % 5 <> 4 AND NOT bool_or(turn % 5 = 2 AND pos = 5) AND NOT (max(n_words) = 0) AS ok FROM i GROUP BY media_id, turn)
"""
oracle("speech_verdicts", RESPONSES + "SELECT media_id * 100 + turn AS response_id, ok AS accepted FROM v")
oracle("speech_words", RESPONSES + """
SELECT media_id * 100 + turn AS response_id, pos, s AS start_ms, e AS end_ms, CASE WHEN pos % 3 = 0 THEN 0.4 ELSE 1 END::DOUBLE AS confidence
FROM i JOIN v USING (media_id, turn) WHERE ok AND pos % 10 NOT IN (3, 7)""")
oracle("speech_events", RESPONSES + """
SELECT media_id * 100 + turn AS response_id, pos, s AS start_ms, e AS end_ms, '(laughter)' AS text
FROM i JOIN v USING (media_id, turn) WHERE ok AND pos % 20 = 7 AND pos % 3 <> 0 AND e - s <= 10000""")
oracle("sidecar_verdicts", """
SELECT event_id, 'A: b ' || event_type AS title, 'why' AS reason,
       CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN CASE event_id % 4 WHEN 0 THEN 'publish' WHEN 1 THEN 'review' WHEN 2 THEN 'skip' END END AS verdict FROM events""")
oracle("finished_paths", """
SELECT '/data/' || event_id || '.mp4' AS path FROM events WHERE event_id % 3 <> 2 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 2 = 0""")
oracle("policy_problems", """
SELECT 'BUILDING' AS subject, 'bad limits' AS problem WHERE EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL SELECT c_custkey::VARCHAR, 'unknown group' FROM customer WHERE c_mktsegment = 'FURNITURE'
UNION ALL SELECT 'MACHINERY', 'bad default group'""")
oracle("selection_report", """
WITH t AS (SELECT c.media_id, c.clip, clip_start AS a, clip_end AS b,
       coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (start_ms < clip_start + 5000), '') AS o,
       coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (end_ms > clip_end - 7000), '') AS e, coalesce(string_agg(text, ' ' ORDER BY seq), '') AS x
     FROM clips c LEFT JOIN words w ON w.media_id = c.media_id AND start_ms >= clip_start AND end_ms <= clip_end GROUP BY ALL),
n AS (SELECT *, chr(10) || chr(10) AS nl, lpad((a // 60000)::VARCHAR, 2, '0') || ':' || lpad((a // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((a % 1000 // 10)::VARCHAR, 2, '0') AS ta,
             lpad((b // 60000)::VARCHAR, 2, '0') || ':' || lpad((b // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((b % 1000 // 10)::VARCHAR, 2, '0') AS tb FROM t)
SELECT media_id, clip, '## ' || clip || nl || ta || '–' || tb || nl || 'Opening: ' || o || nl || 'Ending: ' || e || nl || 'Transcript: ' || x AS markdown FROM n""")
oracle("caption_sidecars", """
SELECT c.media_id, clip, count(*) AS n_words, arg_min(text, seq) AS first, arg_max(least(end_ms, clip_end) - clip_start, seq) AS last_ms
FROM clips c JOIN words w ON w.media_id = c.media_id AND start_ms < clip_end AND end_ms > clip_start GROUP BY ALL""")
oracle("source_limit", "SELECT media_id, seq FROM words w WHERE start_ms < 60000")
oracle("extraction_bounds", "SELECT media_id, clip, greatest(clip_start - 150, 0) AS source_start, least(clip_end + 150, duration_ms) AS source_end FROM clips c")
oracle("trailer_words", """
SELECT media_id, seq, start_ms - 5000 AS start_ms, least(end_ms - 5000, 30000) AS end_ms FROM words w WHERE start_ms BETWEEN 5000 AND 35000""")
oracle("repeated_lines", """
WITH l AS (SELECT doc_id AS media_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
n AS (SELECT media_id, seq::BIGINT AS seq, lower(trim(regexp_replace(line, '[ \\t]+', ' ', 'g'))) AS norm FROM l)
SELECT media_id, norm, count(*) AS n, min(seq) AS first_seq FROM n WHERE len(string_split(norm, ' ')) >= 3 GROUP BY media_id, norm HAVING count(*) >= 2""")
