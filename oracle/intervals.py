"""Statements for ``timedspark.plans.interval_queries``."""

from oracle.base import define, oracle

oracle("clip_words", """
SELECT w.media_id, clip, seq, greatest(start_ms, clip_start) - clip_start AS start_ms,
       least(end_ms, clip_end) - clip_start AS end_ms
FROM words w JOIN clips c ON w.media_id = c.media_id AND start_ms < clip_end AND end_ms > clip_start""")

oracle("clip_excerpts", """
SELECT c.media_id, c.clip, count(seq) AS n_words,
       coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (start_ms < clip_start + 5000), '') AS opening,
       coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (end_ms > clip_end - 7000), '') AS ending,
       coalesce(string_agg(text, ' ' ORDER BY seq), '') AS excerpt
FROM clips c LEFT JOIN words w ON w.media_id = c.media_id AND start_ms >= clip_start AND end_ms <= clip_end
GROUP BY c.media_id, c.clip""")

oracle("refine_context", """
WITH ctx AS (
  SELECT c.media_id, clip, clip_start, clip_end, w.start_ms, w.end_ms,
         row_number() OVER (PARTITION BY c.media_id, clip ORDER BY seq) - 1 AS idx
  FROM clips c JOIN words w ON w.media_id = c.media_id
   AND start_ms BETWEEN greatest(clip_start - 10000, 0) AND clip_end + 10000)
SELECT media_id, clip, count(*) AS n_words, arg_min(idx, abs(start_ms - clip_start) * 100000 + idx) AS first_idx,
       arg_min(idx, abs(end_ms - clip_end) * 100000 + idx) AS last_idx, count(*) < 8 AS sparse
FROM ctx GROUP BY media_id, clip""")

oracle("nearest_snap", """
WITH n AS (
  SELECT c.media_id, clip, clip_start, clip_end, duration_ms,
         arg_min(s.start_ms, abs(s.start_ms - clip_start) * 10000000 + s.start_ms) AS ns,
         arg_min(s.end_ms, abs(s.end_ms - clip_end) * 10000000 + s.end_ms) AS ne
  FROM clips c JOIN segs s ON s.media_id = c.media_id GROUP BY ALL),
m AS (
  SELECT *, CASE WHEN abs(ns - clip_start) <= 3000 THEN ns ELSE clip_start END AS a,
         CASE WHEN abs(ne - clip_end) <= 3000 THEN ne ELSE clip_end END AS b FROM n)
SELECT media_id, clip,
       CASE WHEN a >= 0 AND a < b AND b <= duration_ms AND b - a BETWEEN 15000 AND 90000 THEN a ELSE clip_start END AS snap_start,
       CASE WHEN a >= 0 AND a < b AND b <= duration_ms AND b - a BETWEEN 15000 AND 90000 THEN b ELSE clip_end END AS snap_end
FROM m""")

oracle("reaction_tail", """
SELECT c.media_id, clip, greatest(clip_end, least(clip_end + 2000, coalesce(min(w.start_ms), duration_ms) - 100,
                                                  clip_start + 90000, duration_ms)) AS tail_end
FROM clips c LEFT JOIN words w ON w.media_id = c.media_id AND w.start_ms >= clip_end
GROUP BY c.media_id, clip, clip_start, clip_end, duration_ms""")

oracle("exclude_overlaps", """
SELECT media_id, seq, start_ms, end_ms, score FROM ev p WHERE kind = 'purchase' AND NOT EXISTS (
  SELECT 1 FROM ev x WHERE x.kind = 'error' AND x.media_id = p.media_id
     AND x.start_ms < p.end_ms AND x.end_ms > p.start_ms)""")

oracle("active_word", """
SELECT c.media_id, clip, min(seq) AS seq FROM clips c JOIN words w
  ON w.media_id = c.media_id AND clip_start BETWEEN start_ms AND end_ms GROUP BY ALL""")

oracle("segment_at", """
SELECT c.media_id, clip, clip_start, max(turn) AS turn FROM clips c LEFT JOIN segs s
  ON s.media_id = c.media_id AND s.start_ms <= clip_start GROUP BY ALL""")

oracle("finished_skip", """
SELECT media_id, clip FROM clips c WHERE NOT EXISTS (
  SELECT 1 FROM clips d WHERE d.clip % 2 = 0 AND d.media_id = c.media_id
     AND abs(c.clip_start - (d.clip_start + (d.clip % 4) * 20)) < 50
     AND abs(c.clip_end - (d.clip_end - (d.clip % 4) * 20)) < 50)""")

oracle("containing_reuse", """
WITH st AS (SELECT media_id, media_id * 10000 + clip AS manifest, greatest(clip_start - 20000, 0) AS hs,
                   clip_end + 20000 AS he FROM clips WHERE clip % 3 = 0),
r AS (SELECT c.media_id, c.clip, manifest, greatest(w.start_ms, hs, clip_start) - clip_start AS a,
             least(w.end_ms, he, clip_end) - clip_start AS b
      FROM clips c JOIN st ON st.media_id = c.media_id AND hs <= clip_start AND clip_end <= he
      JOIN words w ON w.media_id = c.media_id AND w.start_ms < clip_end AND w.end_ms > clip_start),
f AS (SELECT media_id, clip, min(manifest) AS manifest FROM r GROUP BY ALL)
SELECT media_id, clip, manifest, count(*) AS n_words, min(a) AS first_ms, max(b) AS last_ms
FROM r JOIN f USING (media_id, clip, manifest) GROUP BY ALL""")

oracle("cut_bounds", """
SELECT c.media_id, clip, greatest(coalesce(arg_min(start_ms, seq), clip_start) - 100, 0) AS cut_start,
       coalesce(arg_max(end_ms, seq), clip_end) + 100 AS cut_end
FROM clips c LEFT JOIN words w ON w.media_id = c.media_id AND start_ms BETWEEN clip_start - 100 AND clip_end + 100
GROUP BY c.media_id, clip, clip_start, clip_end""")

UNION = """
  SELECT media_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
    SELECT *, sum(head) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms) AS grp FROM (
      SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS head
      FROM {source})) GROUP BY media_id, grp"""

oracle("interval_union", "SELECT * FROM (" + UNION.format(source="ev") + ")")

oracle("overlap_measure", """
SELECT p.media_id, p.seq, coalesce(sum(greatest(0, least(p.end_ms, s.end_ms) - greatest(p.start_ms, s.start_ms))), 0)::BIGINT AS overlap_ms
FROM (SELECT * FROM ev WHERE kind = 'purchase') p
LEFT JOIN (SELECT * FROM ev WHERE kind IN ('view', 'click')) s ON s.media_id = p.media_id GROUP BY p.media_id, p.seq""")

oracle("midpoint_count", """
SELECT c.media_id, clip, count(seq) AS n_words, count(seq) FILTER (end_ms - start_ms <= 500) AS n_short
FROM clips c LEFT JOIN words w ON w.media_id = c.media_id
  AND start_ms + end_ms >= 2 * clip_start AND start_ms + end_ms < 2 * clip_end GROUP BY c.media_id, clip""")

oracle("interval_subtract", """
WITH err AS (""" + UNION.format(source="(SELECT * FROM ev WHERE kind = 'error')") + """),
sp AS (SELECT * FROM ev WHERE kind IN ('view', 'click')),
cut AS (SELECT s.media_id, s.seq, s.start_ms, s.end_ms, greatest(e.start_ms, s.start_ms) AS hs, least(e.end_ms, s.end_ms) AS he
        FROM sp s JOIN err e ON e.media_id = s.media_id AND e.start_ms < s.end_ms AND e.end_ms > s.start_ms
        UNION ALL SELECT media_id, seq, start_ms, end_ms, end_ms, end_ms FROM sp),
pieces AS (SELECT media_id, seq, coalesce(lag(he) OVER (PARTITION BY media_id, seq ORDER BY hs, he), start_ms) AS a, hs AS b FROM cut)
SELECT media_id, seq, a AS start_ms, b AS end_ms FROM pieces WHERE a < b""")

GAPS = """
  SELECT media_id, a AS start_ms, b AS end_ms FROM (
    SELECT media_id, greatest(coalesce(max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS a, start_ms AS b
    FROM (SELECT media_id, start_ms, end_ms FROM {source}
          UNION ALL SELECT media_id, duration_ms, duration_ms FROM durs)) WHERE a < b"""

oracle("coverage_gaps", """
WITH padded AS (SELECT media_id, greatest(start_ms - 150, 0) AS start_ms, end_ms + 150 AS end_ms FROM words w)
SELECT * FROM (""" + GAPS.format(source="padded") + """) , (SELECT count(*) AS n FROM durs) WHERE n >= 0
""".replace(" , (SELECT count(*) AS n FROM durs) WHERE n >= 0", ""))

define("heard", """
  SELECT media_id, seq, start_ms, CASE WHEN (turn * 31 + pos) % 97 = 0 THEN start_ms + 3000 ELSE end_ms END AS end_ms, text
  FROM words WHERE NOT (turn % 3 = 1 AND pos % 5 < 4)""")
define("speech", """
  SELECT media_id, s AS start_ms, (s + e) // 2 - 150 AS end_ms FROM (
    SELECT media_id, turn, min(start_ms) AS s, max(end_ms) AS e FROM words GROUP BY ALL) WHERE s < (s + e) // 2 - 150
  UNION ALL
  SELECT media_id, (s + e) // 2 + 150, e FROM (
    SELECT media_id, turn, min(start_ms) AS s, max(end_ms) AS e FROM words GROUP BY ALL) WHERE (s + e) // 2 + 150 < e""")
define("refw", "SELECT media_id, seq, start_ms, end_ms FROM words WHERE pos % 2 = 0")
define("cov", "SELECT h.media_id, greatest(start_ms - 150, 0) AS start_ms, least(end_ms + 150, duration_ms) AS end_ms "
              "FROM heard h JOIN durs USING (media_id) WHERE end_ms - start_ms <= 2500")
define("aq", """
  SELECT media_id, 'long' AS kind, seq AS qid, start_ms, end_ms FROM heard WHERE end_ms - start_ms > 2500
  UNION ALL SELECT media_id, 'gap', start_ms, start_ms, end_ms FROM (""" + GAPS.format(source="cov") + """)
  UNION ALL SELECT media_id, 'sparse', s, s, least(s + 6000, duration_ms) FROM (
    SELECT media_id, duration_ms, unnest(range(0, duration_ms, 3000)) AS s FROM durs)""")
define("spoken", """
  SELECT q.media_id, kind, qid, sum(greatest(0, least(q.end_ms, s.end_ms) - greatest(q.start_ms, s.start_ms)))::BIGINT AS sp,
         min(s.start_ms) AS first, max(s.end_ms) AS last
  FROM aq q JOIN speech s ON s.media_id = q.media_id AND s.start_ms < q.end_ms AND s.end_ms > q.start_ms GROUP BY ALL""")
define("nword", """
  SELECT q.media_id, kind, qid, count(*) AS n FROM aq q JOIN heard h ON h.media_id = q.media_id
   AND h.end_ms - h.start_ms <= 2500 AND h.start_ms + h.end_ms >= 2 * q.start_ms AND h.start_ms + h.end_ms < 2 * q.end_ms GROUP BY ALL""")
define("nref", """
  SELECT q.media_id, kind, qid, count(*) AS r FROM aq q JOIN refw h ON h.media_id = q.media_id
   AND h.start_ms + h.end_ms >= 2 * q.start_ms AND h.start_ms + h.end_ms < 2 * q.end_ms GROUP BY ALL""")
define("measured", """
  SELECT q.*, coalesce(sp, 0) AS sp, coalesce(n, 0) AS n, coalesce(r, 0) AS r, first, last FROM aq q
  LEFT JOIN spoken USING (media_id, kind, qid) LEFT JOIN nword USING (media_id, kind, qid) LEFT JOIN nref USING (media_id, kind, qid)""")
define("findings", """
  SELECT media_id, kind, start_ms, end_ms, (end_ms - start_ms) * 100 AS score_units FROM measured
   WHERE kind = 'long' AND (sp >= 1500 OR r >= 4)
  UNION ALL SELECT media_id, kind, greatest(start_ms, first), least(end_ms, last), sp * 100 FROM measured WHERE kind = 'gap' AND sp >= 1500
  UNION ALL SELECT media_id, kind, start_ms, end_ms, greatest(sp * 65, CASE WHEN r >= 4 THEN r * 35000 ELSE 0 END) - n * 100000
   FROM measured WHERE kind = 'sparse' AND (sp >= 1500 OR r >= 4)
   AND greatest(sp * 65, CASE WHEN r >= 4 THEN r * 35000 ELSE 0 END) - n * 100000 > 0""")
define("issues", UNION.format(source="findings"))

oracle("coverage_findings", "SELECT media_id, kind, start_ms, end_ms, score_units::BIGINT AS score_units FROM findings")
oracle("coverage_audit", """
SELECT media_id, n_issues, issue_ms, score FROM
  (SELECT media_id, count(*) AS n_issues, sum(end_ms - start_ms)::BIGINT AS issue_ms FROM issues GROUP BY ALL)
  JOIN (SELECT media_id, round(sum(score_units)::BIGINT / 100000, 5) AS score FROM findings GROUP BY ALL) USING (media_id)""")

oracle("valid_words", """
WITH p AS (SELECT h.*, duration_ms, coalesce(lag(end_ms) OVER (PARTITION BY h.media_id ORDER BY seq), 0) AS prev
           FROM heard h JOIN durs USING (media_id))
SELECT media_id, bool_and(trim(text) <> '' AND start_ms >= prev - 20 AND start_ms >= 0 AND end_ms >= start_ms
                          AND end_ms <= duration_ms + 100) AS valid FROM p GROUP BY ALL""")

CHUNKS = """
  SELECT media_id, idx, idx * {step} AS start_ms, least(idx * {step} + {size}, duration_ms) AS end_ms, duration_ms
  FROM (SELECT media_id, duration_ms, unnest(range(0, greatest(ceil((duration_ms - {size}) / {step})::BIGINT, 0) + 1)) AS idx FROM durs)"""
define("ch300", CHUNKS.format(step=290000, size=300000))
define("ch100", CHUNKS.format(step=89999, size=100000))
define("ch100e", CHUNKS.format(step=90000, size=100000))
define("ch200", CHUNKS.format(step=110000, size=200000))
OWNED = """
  SELECT *, coalesce(lag(end_ms) OVER (PARTITION BY media_id ORDER BY idx) + start_ms, 0) AS left_x2,
         coalesce(lead(start_ms) OVER (PARTITION BY media_id ORDER BY idx) + end_ms, 2 * end_ms) AS right_x2 FROM {chunks}"""
define("owned100", OWNED.format(chunks="ch100"))
define("owned100e", OWNED.format(chunks="ch100e"))

oracle("chunk_plan", "SELECT media_id, idx, start_ms, end_ms FROM ch300")
oracle("section_plan", """
SELECT media_id, idx AS section, start_ms, end_ms, cap, least(2 * cap, greatest(3, ceil(2 * cap * (end_ms - start_ms) / duration_ms)))::BIGINT AS budget
FROM (SELECT *, least(30, greatest(3, ceil(duration_ms / 300000)))::BIGINT AS cap FROM ch200)""")
oracle("owned_chunks", "SELECT media_id, idx, left_x2, right_x2 FROM owned100")
oracle("owned_words", """
SELECT w.media_id, idx, count(*) AS n_words, min(seq) AS first_seq, max(seq) AS last_seq
FROM words w JOIN owned100 o ON o.media_id = w.media_id AND w.start_ms + w.end_ms >= left_x2 AND w.start_ms + w.end_ms < right_x2
GROUP BY ALL""")
oracle("retry_windows", """
WITH cores AS (SELECT media_id, end_ms, unnest(range(start_ms, end_ms, 16000)) AS c FROM issues),
num AS (SELECT media_id, c, least(c + 16000, end_ms) AS e, row_number() OVER (PARTITION BY media_id ORDER BY c) AS window_no FROM cores)
SELECT media_id, window_no, c AS core_start, e AS core_end, greatest(c - 4000, 0) AS start_ms, least(e + 4000, duration_ms) AS end_ms
FROM num JOIN durs USING (media_id) WHERE window_no <= 8""")
oracle("unreliable_chunks", """
WITH loc AS (SELECT o.media_id, o.idx, greatest(i.start_ms, o.start_ms) - o.start_ms AS a, least(i.end_ms, o.end_ms) - o.start_ms AS b
             FROM issues i JOIN owned100e o ON o.media_id = i.media_id AND i.start_ms < o.end_ms AND i.end_ms > o.start_ms),
tot AS (SELECT media_id, idx, sum(b - a)::BIGINT AS issue_ms FROM loc GROUP BY ALL),
j AS (SELECT o.*, coalesce(issue_ms, 0) AS issue_ms, coalesce(issue_ms, 0) > (end_ms - start_ms) * 0.1::DOUBLE AS rejected
      FROM owned100e o LEFT JOIN tot USING (media_id, idx)),
x AS (SELECT l.media_id, l.idx, greatest((greatest(a - 4000, 0) + start_ms) * 2, left_x2) AS s2,
             least((least(b + 4000, end_ms - start_ms) + start_ms) * 2, right_x2) AS e2
      FROM loc l JOIN j USING (media_id, idx) WHERE NOT rejected),
xa AS (SELECT media_id, idx, count(*) AS n, sum((e2 - s2) / 2) AS ms FROM x WHERE s2 < e2 GROUP BY ALL)
SELECT media_id, idx, issue_ms, rejected, coalesce(n, 0) AS n_excluded, coalesce(ms, 0) AS excluded_ms
FROM j LEFT JOIN xa USING (media_id, idx)""")
oracle("contiguous_turns", """
WITH c AS (SELECT media_id, start_ms + CASE WHEN media_id % 2 = 0 THEN least(idx, 1) * 10000 ELSE 0 END AS s, end_ms AS e, duration_ms FROM ch300),
p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY media_id ORDER BY s, e), 0) AS prev FROM c)
SELECT media_id, bool_and(s = prev AND e > s) AND max(e) = max(duration_ms) AS contiguous FROM p GROUP BY media_id""")
oracle("even_samples", """
WITH n AS (SELECT media_id, seq, row_number() OVER (PARTITION BY media_id ORDER BY seq) - 1 AS rank,
                  count(*) OVER (PARTITION BY media_id) AS n FROM words)
SELECT media_id, seq, rank FROM n WHERE n <= 40 OR rank IN (SELECT (i * n) // 40 FROM range(40) t(i))""")

define("sold", "SELECT media_id, seq, start_ms, end_ms, text FROM words WHERE pos % 7 <> 3")
define("srep", """
  SELECT media_id, seq AS j, start_ms + 40 AS start_ms, end_ms + 40 AS end_ms, text FROM words
  WHERE start_ms >= 12000 AND end_ms <= 44000 AND (media_id % 4 <> 0 OR (start_ms >= 20000 AND end_ms <= 36000))""")
oracle("anchor_splice", """
WITH pairs AS (SELECT o.media_id, o.seq AS i, r.j, o.start_ms AS os, o.end_ms AS oe FROM sold o JOIN srep r
   ON r.media_id = o.media_id AND regexp_replace(lower(o.text), '[^\\p{L}\\p{M}\\p{N}_]', '', 'g') = regexp_replace(lower(r.text), '[^\\p{L}\\p{M}\\p{N}_]', '', 'g')
   AND regexp_replace(lower(o.text), '[^\\p{L}\\p{M}\\p{N}_]', '', 'g') <> '' AND abs(o.start_ms + o.end_ms - r.start_ms - r.end_ms) < 2000),
m AS (SELECT DISTINCT media_id FROM words),
la AS (SELECT media_id, max({'i': i, 'j': j, 'at': oe}) AS l FROM pairs WHERE oe <= 20000 GROUP BY ALL),
ra AS (SELECT media_id, min({'i': i, 'j': j, 'at': os}) AS r FROM pairs WHERE os >= 36000 GROUP BY ALL),
cr AS (SELECT media_id, arg_min(start_ms, seq) AS cs, arg_max(end_ms, seq) AS ce FROM sold WHERE start_ms < 36000 AND end_ms > 20000 GROUP BY ALL),
plan AS (SELECT media_id, l, r, coalesce(l.j < r.j, false) AS anchored, least(20000, cs) AS ps, greatest(36000, ce) AS pe
         FROM m LEFT JOIN la USING (media_id) LEFT JOIN ra USING (media_id) LEFT JOIN cr USING (media_id)),
kept AS (SELECT media_id, NULL::BIGINT AS j, start_ms, end_ms FROM sold o JOIN plan p USING (media_id)
         WHERE CASE WHEN anchored THEN seq <= l.i OR seq >= r.i ELSE end_ms <= ps OR start_ms >= pe END),
ins AS (SELECT media_id, j, greatest(CASE WHEN anchored THEN l.at ELSE ps END, start_ms) AS start_ms,
               least(CASE WHEN anchored THEN r.at ELSE pe END, end_ms) AS end_ms FROM srep JOIN plan p USING (media_id)
        WHERE CASE WHEN anchored THEN j > l.j AND j < r.j ELSE start_ms + end_ms >= 2 * ps AND start_ms + end_ms < 2 * pe END)
SELECT media_id, count(*) AS n_words, count(j) AS n_inserted, min(j) AS first_j, max(j) AS last_j, sum(end_ms - start_ms)::BIGINT AS spoken_ms
FROM (SELECT * FROM kept UNION ALL SELECT * FROM ins) GROUP BY media_id""")
