"""Statements for ``timedspark.plans.reply_queries``: the expected outcome of every reply variant."""

from oracle.base import define, oracle, rounded
from oracle.sequences import fold

oracle("discovery", """
WITH e AS (SELECT event_id, event_id % 9 AS v, 1000 + event_id * 1237 % 700000 AS s,
                  1000 + event_id * 1237 % 700000 + 10000 + event_id * 7 % 90 * 1000 AS e FROM events),
c AS (SELECT *, unnest(CASE WHEN v = 7 THEN [0, 1] ELSE [0] END)::BIGINT AS pos, least(s, 650000) AS a, least(e, 650000) AS b FROM e WHERE v NOT IN (4, 6, 8))
SELECT event_id, pos, a AS start_ms, b AS end_ms,
       CASE WHEN v = 2 THEN 'Clip ' || round_even(a / 1000, 0)::BIGINT || '-' || round_even(b / 1000, 0)::BIGINT ELSE 'Big idea ' || event_id END AS title,
       'ok' AS reason, CASE WHEN v = 3 THEN 0.5 ELSE least(1, (event_id % 130) / 100) END::DOUBLE AS hook_score
FROM c WHERE b > a AND b - a BETWEEN 15000 AND 90000 AND b <= 600000""")

define("exc", """
  SELECT c.media_id, c.clip, (c.media_id * 7 + c.clip) % 8 AS v,
         string_split(regexp_replace(string_agg(text, ' ' ORDER BY seq), '["\\\\{}]', '', 'g'), ' ') AS ws
  FROM clips c JOIN words w ON w.media_id = c.media_id AND start_ms >= clip_start AND end_ms <= clip_end GROUP BY c.media_id, c.clip""")
oracle("review_gate", """
WITH t AS (SELECT *, rtrim(array_to_string(ws[1:4], ' '), ' .,!?;:') AS t4, rtrim(array_to_string(ws[1:9], ' '), ' .,!?;:') AS t9,
                  rtrim(array_to_string(ws[1:2], ' '), ' .,!?;:') AS t2 FROM exc),
n AS (SELECT *, CASE WHEN t4 = '' THEN 0 ELSE len(string_split(t4, ' ')) END AS n4, CASE WHEN t9 = '' THEN 0 ELSE len(string_split(t9, ' ')) END AS n9 FROM t),
o AS (SELECT *, CASE WHEN v IN (0, 1) THEN 'rejected' WHEN v IN (2, 3, 6, 7) THEN 'review_failed'
   WHEN v = 5 AND n9 < 3 THEN 'review_failed'
   WHEN v = 5 AND n9 <= 7 AND length(t9) <= 38 THEN 'accepted9'
   WHEN n4 < 3 THEN 'review_failed' WHEN n4 <= 7 AND length(t4) <= 38 THEN 'accepted' WHEN v = 5 THEN 'review_failed' ELSE 'title_too_long' END AS o FROM n)
SELECT media_id, clip, replace(o, '9', '') AS outcome, CASE o WHEN 'accepted' THEN t4 WHEN 'accepted9' THEN t9 END AS title FROM o""")

define("ctx", """
  SELECT c.media_id, clip, clip_start, clip_end, w.start_ms, w.end_ms, w.text,
         row_number() OVER (PARTITION BY c.media_id, clip ORDER BY seq) - 1 AS idx
  FROM clips c JOIN words w ON w.media_id = c.media_id AND start_ms BETWEEN greatest(clip_start - 10000, 0) AND clip_end + 10000""")
oracle("refine_gate", """
WITH n AS (SELECT media_id, clip, max(clip_start) AS cs, max(clip_end) AS ce, count(*) AS n, clip % 6 AS v FROM ctx GROUP BY ALL),
p AS (SELECT n.*, clip % 5 AS f, n - 1 - clip % 7 AS l FROM n),
b AS (SELECT p.*, x.start_ms AS a, y.end_ms AS b FROM p LEFT JOIN ctx x ON x.media_id = p.media_id AND x.clip = p.clip AND x.idx = f
      LEFT JOIN ctx y ON y.media_id = p.media_id AND y.clip = p.clip AND y.idx = l),
o AS (SELECT *, CASE WHEN n < 8 THEN 'sparse_window_fallback' WHEN v = 4 THEN 'failed' WHEN v = 3 THEN 'rejected' WHEN v = 2 THEN 'failed'
   WHEN v = 1 OR f > l THEN 'out_of_range' WHEN b - a NOT BETWEEN 15000 AND 90000 THEN 'invalid_duration_fallback' ELSE 'picked' END AS outcome FROM b)
SELECT media_id, clip, outcome, CASE WHEN outcome = 'picked' THEN a ELSE cs END AS start_ms, CASE WHEN outcome = 'picked' THEN b ELSE ce END AS end_ms FROM o""")

define("cw", """
  SELECT media_id, seq, start_ms, end_ms, text, 1.0::DOUBLE - pos % 5 / 10 AS conf, rn // 60 AS chunk, rn % 60 AS i,
         count(*) OVER (PARTITION BY media_id, rn // 60) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seq) - 1 AS rn FROM words)""")
oracle("correction_chunks", """
SELECT media_id, chunk, n, CASE chunk % 4 WHEN 1 THEN n > 1 WHEN 3 THEN n = 1 ELSE true END AS ok FROM cw c GROUP BY ALL""")
oracle("corrections", """
WITH good AS (SELECT * FROM cw c WHERE CASE chunk % 4 WHEN 1 THEN n > 1 WHEN 3 THEN n = 1 ELSE true END),
r AS (
  SELECT media_id, chunk, CASE WHEN chunk % 4 = 1 THEN i - 1 ELSE i END AS item, 0 AS part, start_ms, end_ms, text, conf FROM good
   WHERE NOT (chunk % 4 = 1 AND i < 2) AND NOT (chunk % 4 = 2 AND i = 0)
  UNION ALL SELECT media_id, chunk, 0, 0, arg_min(start_ms, i), arg_max(end_ms, i), 'joined', min(conf) FROM good WHERE chunk % 4 = 1 AND i < 2 GROUP BY media_id, chunk
  UNION ALL SELECT media_id, chunk, 0, 0, start_ms, start_ms + round((end_ms - start_ms) * 3 / 9)::BIGINT, 'two', conf FROM good WHERE chunk % 4 = 2 AND i = 0
  UNION ALL SELECT media_id, chunk, 0, 1, start_ms + round((end_ms - start_ms) * 3 / 9)::BIGINT, end_ms, 'halves', conf FROM good WHERE chunk % 4 = 2 AND i = 0)
SELECT media_id, chunk, item::BIGINT AS item, part::BIGINT AS part, start_ms, end_ms, text, round(conf, 2) AS confidence FROM r""")

oracle("shot_decisions", """
WITH s AS (SELECT s_suppkey AS media_id, s_suppkey % 6 AS v, unnest([0, 1, 2])::INTEGER AS id FROM supplier),
c AS (SELECT *, CASE id WHEN 0 THEN (media_id % 100) / 100 WHEN 1 THEN 0.8::DOUBLE ELSE 0.71::DOUBLE END AS conf FROM s)
SELECT media_id, id, CASE WHEN v = 0 AND conf >= 0.7 THEN CASE id WHEN 0 THEN 'speaker' WHEN 1 THEN 'audience' ELSE 'other' END ELSE 'uncertain' END AS mode,
       CASE WHEN v = 0 THEN conf END AS confidence, v <> 0 AS review_error FROM c""")


def scorecard(name: str, dims: tuple[str, ...], tail: str) -> None:
    levels = ", ".join(f"CASE WHEN v = 2 AND {i} = 1 THEN 3 ELSE 1 + (doc_id * {i + 3} + quality * 3 - toxic) % 5 END AS {d}" for i, d in enumerate(dims))
    total = " + ".join(dims)
    oracle(name, f"""
WITH l AS (SELECT doc_id, quality, doc_id % 7 AS v, {levels} FROM (SELECT *, doc_id % 7 AS v FROM labels)),
o AS (SELECT *, ({total}) / {len(dims)} AS mean, CASE WHEN v = 3 THEN 4.5::DOUBLE ELSE {rounded(f"({total}) / {len(dims)}", 1)} END AS ov FROM l)
SELECT doc_id, {", ".join(f"CASE WHEN v <> 5 THEN {d}::INTEGER END AS {d}" for d in dims)}, CASE WHEN v <> 5 THEN ov END AS overall,
  CASE WHEN doc_id % 11 = 0 THEN 'skip' WHEN v = 5 THEN 'review' WHEN v = 4 THEN 'publish' WHEN ov >= 4 THEN 'publish' WHEN ov >= 3 THEN 'review' ELSE 'skip' END AS verdict,
  CASE WHEN doc_id % 11 = 0 THEN 'empty transcript' WHEN v = 5 THEN 'parse error' ELSE 'fine' END AS feedback{tail} FROM o""")


scorecard("scorecard", ("hook", "arc", "ending", "standalone", "shareability", "title_match"),
          ", CASE WHEN v <> 5 THEN " + rounded("(0.5::DOUBLE + quality * 0.25::DOUBLE) * 0.3::DOUBLE + mean / 5 * 0.7::DOUBLE", 2) + " END AS final_score")
scorecard("trailer_scorecard", ("opener_hook", "thematic_coherence", "pacing", "closer_punch", "standalone_quality"), "")

oracle("tech_metrics", """
WITH fr AS (SELECT f.media_id, f.frame, n > 0 AS person, EXISTS (SELECT 1 FROM fbox b WHERE b.media_id = f.media_id AND b.frame = f.frame) AS face, l.x + l.w / 2 AS xc
            FROM fcount f LEFT JOIN lbox l ON l.media_id = f.media_id AND l.frame = f.frame),
m AS (SELECT media_id, sum(face::INT)::BIGINT / count(*) AS fv, sum(person::INT)::BIGINT / count(*) AS sc,
             CASE WHEN count(xc) >= 2 THEN greatest(0, 1 - stddev_pop(xc) / 288.0::DOUBLE) ELSE 1 END AS st FROM fr GROUP BY ALL),
c AS (SELECT media_id, duration_ms AS len FROM durs),
w AS (SELECT c.media_id, len, count(seq) AS n, coalesce(sum(greatest(0, end_ms - start_ms)), 0)::BIGINT AS ms
      FROM c LEFT JOIN words x ON x.media_id = c.media_id AND end_ms <= len GROUP BY ALL),
a AS (SELECT m.*, len, n / greatest(0.1, len / 1000) AS wps, least(1, ms / 1000 / greatest(0.1, len / 1000)) AS cov FROM w JOIN m USING (media_id))
SELECT media_id, round(fv, 6) AS face_visibility, round(st, 6) AS crop_stability, round(sc, 6) AS speaker_coverage, round(wps, 6) AS words_per_second,
       round(cov, 6) AS subtitle_coverage, round(fv * 0.25::DOUBLE + st * 0.2::DOUBLE + sc * 0.15::DOUBLE + CASE WHEN len / 1000 BETWEEN 25 AND 60 THEN 1 ELSE 0.5 END * 0.15::DOUBLE
         + CASE WHEN wps BETWEEN 1.5 AND 3.5 THEN 1 ELSE 0.5 END * 0.15::DOUBLE + cov * 0.1::DOUBLE, 6) AS score FROM a""")

define("qt", """
  SELECT * FROM (
    SELECT event_id AS media_id, 0::BIGINT AS seq, (b + 20) * 1000 AS s, (b + 29) * 1000 AS e, 'later words' AS t FROM (SELECT *, event_id * 13 % 500 AS b FROM events)
    UNION ALL SELECT event_id, 1, b * 1000, (b + event_id % 12) * 1000, 'first words' FROM (SELECT *, event_id * 13 % 500 AS b FROM events)
    UNION ALL SELECT event_id, 2, (b + 5) * 1000, (b + 15) * 1000, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'middle' END FROM (SELECT *, event_id * 13 % 500 AS b FROM events))
  WHERE e > s AND t <> '' AND e <= 520000""")
oracle("quotables", "WITH s AS (" + fold("qt", "media_id", "{'seq': seq, 's': s, 'e': e, 't': t}", "s, seq",
                                        "CASE WHEN x[1].s < a[-1].e THEN a ELSE list_concat(a, x) END") + """)
SELECT media_id, r.seq AS seq, r.s AS start_ms, r.e AS end_ms, r.t AS sentence FROM s""")
oracle("section_choice", """
WITH s AS (SELECT o_orderkey AS clip, n_nationkey AS position, n_name, (o_orderkey * 7 + n_nationkey * 31) % (2 + o_orderkey % 9) AS score
           FROM orders, nation WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0),
b AS (SELECT clip, max(score) AS m, arg_max(position, {'s': score, 'p': -position}) AS position, arg_max(n_name, {'s': score, 'p': -position}) AS name FROM s GROUP BY ALL)
SELECT clip, position::BIGINT AS position, m::DOUBLE AS score, name AS section_id FROM b WHERE m >= 5""")
oracle("context_prompts", """
SELECT media_id, clip, string_agg('  [' || lpad(idx::VARCHAR, 4, ' ') || '] ' || printf('%7.2f', start_ms / 1000) || '-' || printf('%7.2f', end_ms / 1000) || '  ' || text, chr(10) ORDER BY idx) AS prompt
FROM ctx GROUP BY ALL""")
oracle("scorecard_prompts", """
WITH w AS (SELECT c.media_id, clip, clip_end - clip_start AS len, seq, greatest(start_ms - clip_start, 0) AS s, text
           FROM clips c JOIN words w ON w.media_id = c.media_id AND start_ms < clip_end AND end_ms > clip_start),
a AS (SELECT media_id, clip, len, count(*) AS n, string_agg(text, ' ' ORDER BY seq) AS t, coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (s < 2000), '') AS o FROM w GROUP BY ALL)
SELECT media_id, clip, 'Clip ' || clip AS title, n AS word_count, """ + rounded("len / 1000", 1) + """ AS duration_seconds, o AS opening,
       CASE WHEN contains(t, '.') THEN trim(split_part(t, '.', 1)) || '.' ELSE t[1:80] END AS first_sentence,
       CASE WHEN len(string_split(t, '.')) >= 3 THEN trim(string_split(t, '.')[-2]) || '.' ELSE right(t, 80) END AS last_sentence FROM a""")
oracle("timestamped_lines", """
SELECT media_id, turn, '[' || lpad((start_ms // 60000)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') || '-'
       || lpad((end_ms // 60000)::VARCHAR, 2, '0') || ':' || lpad((end_ms // 1000 % 60)::VARCHAR, 2, '0') || '] ' || text AS line,
       lpad((start_ms // 60000)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((start_ms % 1000 // 10)::VARCHAR, 2, '0') AS "at" FROM segs""")
define("trn", "SELECT media_id, 'SPEAKER_0' || (turn % 3) AS speaker_id, start_ms, end_ms FROM segs")
oracle("speaker_share", "SELECT media_id, speaker_id, sum(end_ms - start_ms)::BIGINT AS spoken_ms FROM trn GROUP BY ALL")
oracle("longest_turn", """
SELECT media_id, speaker_id, arg_max(start_ms, {'d': end_ms - start_ms, 's': -start_ms}) AS start_ms,
       arg_max(end_ms, {'d': end_ms - start_ms, 's': -start_ms}) AS end_ms FROM trn GROUP BY ALL""")
oracle("main_language", """
SELECT media_id, arg_max(lang, {'n': n, 'f': -f}) AS language FROM (
  SELECT doc_id // 10 AS media_id, lang, sum(n_chars) AS n, min(doc_id % 10) AS f FROM documents GROUP BY ALL) GROUP BY ALL""")
oracle("densest_pass", """
WITH p AS (SELECT l_orderkey AS media_id, l_linenumber - 1 AS pass, sum(l_quantity::BIGINT)::BIGINT AS n, l_orderkey % 40 AS sec FROM lineitem GROUP BY ALL),
a AS (SELECT * FROM p WHERE pass = 0),
b AS (SELECT media_id, max(n) AS bn, arg_max(pass, {'n': n, 'p': -pass}) AS bp FROM p WHERE pass > 0 GROUP BY ALL)
SELECT media_id, CASE WHEN s THEN bp ELSE 0 END::INTEGER AS pass, CASE WHEN s THEN bn ELSE n END AS n_words FROM (
  SELECT media_id, n, bn, bp, n IS NULL OR coalesce(sec >= 3 AND n / nullif(sec, 0) < 1.5 AND media_id % 13 <> 0 AND bn > n, false) AS s FROM a FULL JOIN b USING (media_id))""")
oracle("usage_report", """
WITH r AS (SELECT o_orderpriority AS model, year(o_orderdate)::INTEGER AS year, round(o_totalprice * 100)::BIGINT AS cost, o_custkey AS sec, o_orderkey % 9973 AS el FROM orders)
SELECT model, year, GROUPING_ID(model, year)::INTEGER AS level, count(*) AS requests, sum(cost)::BIGINT AS cost_usd, sum(sec)::BIGINT AS seconds,
       round(sum(cost)::BIGINT / sum(sec)::BIGINT * 3600, 4) AS cost_per_hour, min(el) AS fastest, max(el) AS slowest
FROM r GROUP BY GROUPING SETS ((model, year), (model), ())""")
oracle("stored_receipts", """
WITH r AS (SELECT o_orderpriority AS model, year(o_orderdate)::INTEGER AS year, round(o_totalprice * 100)::BIGINT AS cost, o_custkey AS sec, o_orderkey % 9973 AS el FROM orders)
SELECT model, year, GROUPING_ID(model, year)::INTEGER AS level, count(*) AS requests, sum(cost)::BIGINT AS cost_usd, sum(sec)::BIGINT AS seconds, min(el) AS fastest, max(el) AS slowest
FROM r GROUP BY GROUPING SETS ((model, year), (model), ())""")
oracle("judge_agreement", """
SELECT dimension, round(c, 6) AS correlation, c > 0.7 AS agrees FROM (
  SELECT 'quality' AS dimension, corr(quality + doc_id % 3, quality * 2) AS c FROM labels
  UNION ALL SELECT 'toxic', corr(toxic * 3 + doc_id % 2, toxic) FROM labels)""")
oracle("timing_problems", """
WITH w AS (SELECT media_id, seq, CASE WHEN pos % 23 = 5 THEN NULL ELSE start_ms END AS s0, CASE WHEN pos % 29 = 7 THEN CASE WHEN pos % 23 = 5 THEN NULL ELSE start_ms END - 1 ELSE end_ms END AS e,
             start_ms AS raw, pos FROM words),
l AS (SELECT media_id, seq, CASE WHEN seq % 31 = 4 THEN CASE WHEN s0 IS NULL THEN 0 ELSE greatest(s0 - 2000, 0) END ELSE s0 END AS s,
             CASE WHEN pos % 29 = 7 THEN raw - 1 ELSE e END AS e FROM w),
o AS (SELECT *, coalesce(s IS NOT NULL AND e IS NOT NULL AND s >= 0 AND e >= s AND e <= 600250, false) AS ok FROM l),
p AS (SELECT *, last_value(CASE WHEN ok THEN s END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM o)
SELECT media_id, seq, CASE WHEN NOT ok THEN 'invalid' ELSE 'unordered' END AS problem FROM p WHERE NOT ok OR s < prev""")
oracle("titles", """
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS line FROM documents),
l AS (SELECT *, rtrim(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' .,!?;:') AS title FROM d)
SELECT doc_id, line, title, CASE WHEN title = '' THEN 0 ELSE len(string_split(title, ' ')) END BETWEEN 3 AND 7 AND length(title) <= 38 AS fits,
       CASE WHEN title = '' THEN 0 ELSE len(string_split(title, ' ')) END::BIGINT AS n_words,
       CASE WHEN contains(text, '.') THEN trim(split_part(text, '.', 1)) || '.' ELSE text[1:80] END AS first_sentence,
       CASE WHEN len(string_split(text, '.')) >= 3 THEN trim(string_split(text, '.')[-2]) || '.' ELSE right(text, 80) END AS last_sentence FROM l""")
oracle("slugs", """
SELECT p_partkey, CASE WHEN s = '' THEN 'clip' ELSE s END AS slug FROM (
  SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_name || '  &   ' || p_brand || '  _  ' || p_type), '[^\\w\\s-]', '', 'g')), '[\\s_-]+', '-', 'g')[1:40] AS s FROM part)""")
oracle("video_links", """
SELECT page_id, CASE WHEN page_id % 8 IN (0, 1, 2, 5) THEN lpad((page_id * 7919)::VARCHAR, 11, 'a') END AS video FROM pages""")
oracle("hashtags", """
WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
c AS (SELECT doc_id, '#' || regexp_replace(w, '[^A-Za-z0-9_]', '', 'g') AS tag, i FROM t),
f AS (SELECT doc_id, arg_min(tag, i) AS tag, min(i) AS i FROM c WHERE length(tag) > 1 GROUP BY doc_id, lower(tag)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
j AS (SELECT doc_id, string_agg(tag, ' ' ORDER BY i) AS tags FROM r WHERE k <= 15 GROUP BY doc_id)
SELECT d.doc_id, coalesce(tags, '') AS tags,
       least(2200, length(trim(text)) + CASE WHEN tags IS NULL THEN 0 ELSE 2 + length(tags) END)::BIGINT AS caption_chars FROM documents d LEFT JOIN j USING (doc_id)""")
oracle("danda_words", """
WITH r AS (SELECT media_id, turn, seq, CASE WHEN turn % 5 = 0 AND pos = 1 THEN 'नमस्ते।' WHEN pos % 9 = 0 THEN text || '।' ELSE text END AS text,
                  bool_or(turn % 5 = 0 AND pos = 1) OVER (PARTITION BY media_id, turn) AS mixed FROM words)
SELECT media_id, seq, CASE WHEN NOT mixed OR regexp_matches(text, '\\p{Latin}') THEN replace(text, '।', '.') ELSE text END AS fixed FROM r WHERE contains(text, '।')""")
oracle("scored_prompts", "SELECT media_id || '-' || clip AS key, 'count ' || count(*) AS raw FROM ctx GROUP BY media_id, clip")
oracle("latest_replies", """
SELECT user_id AS key, max(event_id) AS attempt, arg_max(event_type, event_id) AS raw FROM events WHERE event_type NOT IN ('view', 'error') GROUP BY ALL""")
