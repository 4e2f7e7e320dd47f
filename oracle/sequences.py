"""Statements for ``timedspark.plans.sequence_queries``."""

from oracle.base import define, oracle


def fold(source: str, key: str, element: str, order: str, step: str) -> str:
    """Rows of a left fold: `step` maps (a, x) to the grown list, x[1] being the new element."""
    return f"""
      SELECT {key}, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: {step})) AS r
      FROM (SELECT {key}, list({element} ORDER BY {order}) AS l FROM {source} GROUP BY ALL)"""


oracle("word_sessions", "WITH s AS (" + fold(
    "words", "media_id", "{'seq': seq, 's': start_ms, 'e': end_ms, 'text': text, 'g': seq, 'gs': start_ms}", "seq",
    """CASE WHEN x[1].s - a[-1].e > 700 OR x[1].e - a[-1].gs > 15000 THEN list_concat(a, x)
       ELSE list_concat(a, [{'seq': x[1].seq, 's': x[1].s, 'e': x[1].e, 'text': x[1].text, 'g': a[-1].g, 'gs': a[-1].gs}]) END""") + """)
SELECT media_id, r.g AS session, min(r.s) AS start_ms, max(r.e) AS end_ms, count(*) AS n_words,
       string_agg(r.text, ' ' ORDER BY r.seq) AS text FROM s GROUP BY ALL""")

define("pop_isl", """
  SELECT *, sum(head) OVER (PARTITION BY media_id ORDER BY seq) AS isl FROM (
    SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w > {gap} OR right(lag(text) OVER w, 1) IN ('.', '!', '?')
                     OR lag(seq) OVER w IS NULL THEN 1 ELSE 0 END AS head
    FROM words WINDOW w AS (PARTITION BY media_id ORDER BY seq))""".replace("{gap}", "1000"))
oracle("popups", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY media_id, isl ORDER BY seq) - 1 AS rn FROM pop_isl p)
SELECT media_id, min(seq) AS popup, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, count(*) AS n_words,
       string_agg(text, ' ' ORDER BY seq) AS text FROM n GROUP BY media_id, isl, rn // 3""")
oracle("single_popups", "SELECT media_id, seq, seq AS popup FROM words w")
oracle("caption_lines", "WITH s AS (" + fold(
    "words", "media_id", "{'seq': seq, 's': start_ms, 'e': end_ms, 'text': text, 'g': seq, 'n': length(text)}", "seq",
    """CASE WHEN x[1].s - a[-1].e > 800 OR a[-1].n + 1 + x[1].n > 20 OR right(a[-1].text, 1) IN ('.', '!', '?') THEN list_concat(a, x)
       ELSE list_concat(a, [{'seq': x[1].seq, 's': x[1].s, 'e': x[1].e, 'text': x[1].text, 'g': a[-1].g, 'n': a[-1].n + 1 + x[1].n}]) END""") + """)
SELECT media_id, r.g AS line, arg_min(r.s, r.seq) AS start_ms, arg_max(r.e, r.seq) AS end_ms, count(*) AS n_words,
       string_agg(r.text, ' ' ORDER BY r.seq) AS text FROM s GROUP BY ALL""")

define("fcount", """
  SELECT m.media_id, m.frame, coalesce(n, 0) AS n FROM mframes m LEFT JOIN
    (SELECT media_id, frame, count(*) AS n FROM det GROUP BY ALL) c ON m.media_id = c.media_id AND m.frame = c.frame""")
oracle("majority_smooth", """
SELECT media_id, frame, n >= 2 AS flag,
       avg((n >= 2)::INT) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) >= 0.5 AS smooth
FROM fcount f""")
oracle("debounce", "WITH s AS (" + fold(
    "fcount", "media_id", "{'f': frame, 'flag': n >= 2, 'st': n >= 2, 'p': 0}", "frame",
    """list_concat(a, [{'f': x[1].f, 'flag': x[1].flag,
         'st': CASE WHEN x[1].flag <> a[-1].st AND a[-1].p + 1 >= 4 THEN x[1].flag ELSE a[-1].st END,
         'p': CASE WHEN x[1].flag = a[-1].st OR a[-1].p + 1 >= 4 THEN 0 ELSE a[-1].p + 1 END}])""") + """)
SELECT media_id, r.f AS frame, r.flag AS flag, r.st AS stable FROM s""")
define("filled", """
  SELECT media_id, frame, coalesce(CASE WHEN n > 0 THEN n % 3 WHEN p IS NULL THEN q.l WHEN q IS NULL THEN p.l
           WHEN q.f - frame <= frame - p.f THEN q.l ELSE p.l END, 0)::INTEGER AS filled FROM (
    SELECT *, last_value(CASE WHEN n > 0 THEN {'f': frame, 'l': n % 3} END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY frame
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
              first_value(CASE WHEN n > 0 THEN {'f': frame, 'l': n % 3} END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY frame
                ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM fcount)""")
oracle("fill_nearest", "SELECT media_id, frame, filled FROM filled")
define("runs", """
  SELECT media_id, filled, min(frame) AS s, max(frame) + 1 AS e FROM (
    SELECT *, frame - row_number() OVER (PARTITION BY media_id, filled ORDER BY frame) AS g FROM filled) GROUP BY media_id, filled, g""")
oracle("label_runs", """SELECT media_id, filled, s AS "start", e AS "end" FROM runs""")
oracle("min_dwell", """
WITH g AS (SELECT *, sum(CASE WHEN e - s >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY s)
             - first_value(CASE WHEN e - s >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY s) AS g FROM runs)
SELECT media_id, arg_min(filled, s) AS filled, min(s) * 40 AS start_ms, max(e) * 40 AS end_ms FROM g GROUP BY media_id, g""")
COLLAPSE = """
WITH l AS (SELECT media_id, seq, start_ms, end_ms, (pos // 6) %% 2 AS label FROM words),
h AS (SELECT *, CASE WHEN lag(seq) OVER w IS NULL OR label <> lag(label) OVER w OR start_ms - lag(end_ms) OVER w %s THEN 1 ELSE 0 END AS head
      FROM l WINDOW w AS (PARTITION BY media_id ORDER BY seq)),
g AS (SELECT *, sum(head) OVER (PARTITION BY media_id ORDER BY seq) AS g FROM h)
SELECT media_id, min(label) AS label, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY media_id, g"""
oracle("collapse_turns", COLLAPSE % ">= 150")
oracle("collapse_windows", COLLAPSE % "> 500")
oracle("rolling_variance", """
WITH s AS (SELECT media_id, frame, ((y / 40) % 3)::INTEGER AS track, max(x) AS x FROM det GROUP BY ALL),
t AS (SELECT DISTINCT media_id, track FROM s),
v AS (SELECT m.media_id, m.frame, t.track, var_pop(x) OVER w AS v, count(x) OVER w AS n
      FROM mframes m JOIN t USING (media_id) LEFT JOIN s ON s.media_id = m.media_id AND s.frame = m.frame AND s.track = t.track
      WINDOW w AS (PARTITION BY m.media_id, t.track ORDER BY m.frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
b AS (SELECT media_id, frame, max(CASE WHEN n >= 3 THEN {'v': v, 't': -track} END) AS b FROM v GROUP BY ALL)
SELECT media_id, frame, CASE WHEN b.v >= 1e-5 THEN -b.t END AS winner, round(b.v, 4) AS variance FROM b""")
oracle("concat_offsets", """
WITH p AS (SELECT media_id, turn, start_ms AS s, (end_ms - start_ms) * 9 // 10 AS len FROM segs),
o AS (SELECT *, coalesce(sum(len + 600) OVER (PARTITION BY media_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM p)
SELECT w.media_id, o.turn AS pick, seq, start_ms - s + off AS start_ms, least(end_ms - s, len) + off AS end_ms
FROM words w JOIN o ON o.media_id = w.media_id AND o.turn = w.turn WHERE start_ms - s BETWEEN 0 AND len""")
oracle("split_spans", """
WITH w AS (SELECT media_id, turn, pos, text, greatest(length(text), 1) AS n FROM words),
c AS (SELECT *, sum(n) OVER (PARTITION BY media_id, turn ORDER BY pos) AS upto, sum(n) OVER (PARTITION BY media_id, turn) AS total FROM w)
SELECT media_id, turn, text, turn * 100000 + round(7001 * (upto - n) / total)::BIGINT AS start_ms,
       turn * 100000 + round(7001 * upto / total)::BIGINT AS end_ms FROM c""")
define("energy", """
  SELECT m.media_id, m.frame, coalesce(h, 0)::DOUBLE AS level FROM mframes m LEFT JOIN
    (SELECT media_id, frame, sum(h)::BIGINT AS h FROM det GROUP BY ALL) d ON d.media_id = m.media_id AND d.frame = m.frame""")
oracle("normalised_levels", """
WITH q AS (SELECT media_id, quantile_cont(level, 0.95) AS hi FROM energy GROUP BY ALL),
n AS (SELECT media_id, frame, greatest(0, least(1, level / CASE WHEN hi = 0 THEN 1 ELSE hi END)) AS level FROM energy JOIN q USING (media_id))
SELECT media_id, frame, round(sum(level) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS level FROM n""")
oracle("miss_counter", """
SELECT media_id, frame, frame - coalesce(max(CASE WHEN n > 0 THEN frame END) OVER (PARTITION BY media_id ORDER BY frame), -1) AS misses FROM fcount f""")
oracle("merge_chunks", "WITH s AS (" + fold(
    "clips", "media_id", "{'seq': clip, 's': clip_start, 'e': clip_end, 'mark': clip_end, 'k': true, 'f': NULL::BIGINT, 'pk': clip_end}", "clip",
    """CASE WHEN x[1].s < a[-1].mark - 100
         THEN list_concat(a, [{'seq': x[1].seq, 's': x[1].s, 'e': x[1].e, 'mark': a[-1].mark, 'k': false, 'f': NULL::BIGINT, 'pk': greatest(a[-1].pk, x[1].e)}])
         ELSE list_concat(a, [{'seq': x[1].seq, 's': x[1].s, 'e': x[1].e, 'mark': greatest(a[-1].mark, x[1].e), 'k': true,
                               'f': CASE WHEN x[1].s < a[-1].pk THEN a[-1].mark - 100 END, 'pk': greatest(a[-1].pk, x[1].e)}]) END""") + """)
SELECT media_id, r.seq AS seq, r.s AS start_ms, r.e AS end_ms, r.f AS words_from FROM s WHERE r.k""")

define("bnd", """
  SELECT media_id, seq * 2 AS seq, start_ms, end_ms + CASE WHEN seq % 3 = 0 THEN 400 ELSE 0 END AS end_ms, text,
         (start_ms + end_ms) // 40000 * 40000 AS left_x2 FROM words
  UNION ALL SELECT media_id, seq * 2 + 1, start_ms + 60, end_ms + 60, text, start_ms * 2 + 200 FROM words
  WHERE start_ms + end_ms - (start_ms + end_ms) // 40000 * 40000 < 6000""")
PLAIN = "trim(lower(text), '.,!?;:।…\"''“”‘’()[]{}')"
oracle("boundary_words", "WITH s AS (" + fold(
    "bnd", "media_id", "{'seq': seq, 's': start_ms, 'e': end_ms, 'raw': end_ms, 'p': " + PLAIN + ", 'l': left_x2}", "seq",
    """CASE WHEN x[1].s >= a[-1].raw THEN list_concat(a, x)
            WHEN 2 * x[1].s < x[1].l AND x[1].l < 2 * a[-1].raw AND x[1].p = a[-1].p THEN a
            ELSE list_concat(list_concat(a[:-2], [{'seq': a[-1].seq, 's': a[-1].s, 'e': (a[-1].raw + x[1].s) // 2, 'raw': a[-1].raw, 'p': a[-1].p, 'l': a[-1].l}]),
                 [{'seq': x[1].seq, 's': (a[-1].raw + x[1].s) // 2, 'e': x[1].e, 'raw': x[1].raw, 'p': x[1].p, 'l': x[1].l}]) END""") + """)
SELECT media_id, r.seq AS seq, r.s AS start_ms, r.e AS end_ms FROM s""")

define("candidates", "SELECT media_id, seq, start_ms, end_ms, score FROM ev")
oracle("score_order", """
SELECT * FROM (SELECT media_id, seq, score, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, seq)::INTEGER AS place FROM candidates b)""")
GREEDY = fold("candidates", "media_id", "{'seq': seq, 's': start_ms, 'e': end_ms, 'score': score}", "score DESC, seq",
              "CASE WHEN len(a) >= 5 OR len(list_filter(a, lambda y: y.s < x[1].e AND y.e > x[1].s)) > 0 THEN a ELSE list_concat(a, x) END")
oracle("greedy_clips", "WITH s AS (" + GREEDY + """)
SELECT media_id, r.seq AS seq, r.s AS start_ms, r.e AS end_ms, r.score AS score,
       row_number() OVER (PARTITION BY media_id ORDER BY r.score DESC, r.seq)::INTEGER AS pick FROM s""")
oracle("greedy_by_start", "WITH s AS (" + fold(
    "candidates", "media_id", "{'seq': seq, 's': start_ms, 'e': end_ms}", "start_ms, seq",
    "CASE WHEN x[1].s < a[-1].e THEN a ELSE list_concat(a, x) END") + """)
SELECT media_id, r.seq AS seq, r.s AS start_ms, r.e AS end_ms FROM s""")
oracle("clip_caps", """
SELECT media_id, CASE WHEN media_id % 5 = 0 THEN least(media_id % 40 + 1, 30)
                      ELSE least(30, greatest(3, ceil(duration_ms / 60000)::BIGINT)) END AS cap FROM durs d""")

define("excl", """SELECT media_id, s AS start_ms, s + 4000 AS end_ms FROM (
  SELECT media_id, unnest(range(30000, duration_ms + 30001, 100000)) AS s FROM durs WHERE media_id % 3 = 0)""")
define("cand", """
  SELECT c.media_id, s.idx AS section, s.end_ms AS section_end, c.duration_ms, least(30, greatest(3, ceil(c.duration_ms / 60000)::BIGINT)) AS target,
         clip_start AS s, clip_end AS e, clip_start + clip % 5 * 200 AS fs, clip_end - clip % 3 * 300 AS fe, score, clip AS seq
  FROM clips c JOIN ch200 s ON s.media_id = c.media_id AND clip_start >= s.start_ms AND clip_end <= s.end_ms
  WHERE NOT EXISTS (SELECT 1 FROM excl x WHERE x.media_id = c.media_id AND x.start_ms < clip_end AND x.end_ms > clip_start)""")
define("admit", fold(
    "(SELECT *, CASE WHEN section_end >= duration_ms THEN target ELSE greatest(1, target * section_end // duration_ms) END AS allow FROM cand)",
    "media_id", "{'sec': section, 'allow': allow, 'target': target, 's': s, 'e': e, 'fs': fs, 'fe': fe, 'score': score, 'seq': seq, 'st': 1}",
    "section, score DESC, seq",
    """list_concat(a, [{'sec': x[1].sec, 'allow': x[1].allow, 'target': x[1].target, 's': x[1].s, 'e': x[1].e, 'fs': x[1].fs, 'fe': x[1].fe,
         'score': x[1].score, 'seq': x[1].seq, 'st': CASE
           WHEN len(list_filter(a, lambda y: y.st = 1 AND y.sec < x[1].sec)) >= x[1].target THEN 0
           WHEN len(list_filter(a, lambda y: y.st = 1)) >= x[1].allow THEN 2
           WHEN len(list_filter(a, lambda y: y.st = 1 AND ((y.fs < x[1].e AND y.fe > x[1].s) OR (y.fs < x[1].fe AND y.fe > x[1].fs)))) > 0 THEN 3
           ELSE 1 END}])"""))
oracle("select_clips", "WITH f AS (" + fold(
    "(SELECT media_id, r FROM admit WHERE r.st IN (1, 2))", "media_id", "r", "r.st, r.score DESC, r.sec, r.seq",
    """CASE WHEN x[1].st = 1 THEN list_concat(a, x) WHEN len(a) >= x[1].target THEN a
            WHEN len(list_filter(a, lambda y: (y.fs < x[1].e AND y.fe > x[1].s) OR (y.fs < x[1].fe AND y.fe > x[1].fs))) > 0 THEN a
            ELSE list_concat(a, x) END""") + """)
SELECT media_id, r.sec AS section, r.seq AS seq, r.fs AS final_start, r.fe AS final_end, r.score AS score, r.st = 1 AS in_order FROM f""")

oracle("beat_snap", """
WITH b AS (SELECT media_id, start_ms FROM words WHERE media_id % 10 <> 9)
SELECT c.media_id, clip, coalesce(arg_min(start_ms, abs(start_ms - clip_start) * 10000000 + start_ms), (clip_start + 5) // 10 * 10) AS snapped
FROM clips c LEFT JOIN b ON b.media_id = c.media_id GROUP BY c.media_id, clip, clip_start""")
oracle("peak_sections", "WITH e AS (SELECT media_id, frame, level::BIGINT * 1000 + frame % 7 AS v FROM energy), t AS (SELECT media_id, max(v) AS top FROM e GROUP BY ALL),\ns AS (" + fold(
    "(SELECT e.* FROM e JOIN t USING (media_id) WHERE v >= 0.55::DOUBLE * top)", "media_id", "{'f': frame, 'v': v}", "v DESC, frame",
    "CASE WHEN len(a) >= 4 OR len(list_filter(a, lambda y: x[1].f >= y.f - 3 AND x[1].f < y.f + 53)) > 0 THEN a ELSE list_concat(a, x) END") + """)
SELECT media_id, r.f AS frame, r.v AS level, row_number() OVER (PARTITION BY media_id ORDER BY r.v DESC, r.f)::INTEGER AS pick FROM s""")
oracle("spaced_sections", "WITH s AS (" + fold(
    "energy", "media_id", "{'f': frame, 'v': level::BIGINT}", "level DESC, frame",
    "CASE WHEN len(a) >= 2 OR len(list_filter(a, lambda y: abs(x[1].f - y.f) < 25)) > 0 THEN a ELSE list_concat(a, x) END") + """)
SELECT media_id, r.f AS seq, r.f * 40 AS start_ms, r.v AS score, row_number() OVER (PARTITION BY media_id ORDER BY r.v DESC, r.f)::INTEGER AS pick FROM s""")
oracle("longest_run", """
WITH h AS (SELECT media_id, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY media_id ORDER BY frame) > 2 THEN 1 ELSE 0 END AS brk FROM fcount WHERE n > 0),
g AS (SELECT *, sum(brk) OVER (PARTITION BY media_id ORDER BY frame) AS g FROM h),
r AS (SELECT media_id, max(frame) - min(frame) + 1 AS span, count(*) AS n FROM g GROUP BY media_id, g)
SELECT media_id, max(span) AS longest, round(sum(n)::BIGINT / 300, 6) AS persistence FROM r GROUP BY ALL""")
