"""Statements for ``timedspark.plans.frame_queries``."""

from oracle.base import define, oracle
from oracle.sequences import fold

define("nbox", """
  SELECT *, row_number() OVER (PARTITION BY media_id, frame ORDER BY x, y, w, h)::INTEGER AS person
  FROM (SELECT DISTINCT media_id, frame, x, y, w, h FROM det)""")
define("fbox", """
  SELECT media_id, frame, person AS face, x + w // 3 AS x, y + 5 AS y, w // 4 AS w, h // 8 AS h FROM nbox WHERE (x + y) % 3 <> 0""")
define("lbox", """
  SELECT media_id, frame, b.x AS x, b.y AS y, b.w AS w, b.h AS h FROM (
    SELECT media_id, frame, arg_max({'x': x, 'y': y, 'w': w, 'h': h}, {'a': w * h, 'b': -x, 'c': -y}) AS b FROM det GROUP BY ALL)""")

oracle("person_boxes", "SELECT media_id, frame, det, x, y, w, h FROM det d WHERE y % 3 = 0 AND confidence >= 0.5")
oracle("foreground_boxes", "SELECT media_id, frame, det, x, y, w, h FROM det d WHERE h BETWEEN 0.3 * 1080 AND 0.6 * 1080")
oracle("foreground_faces", """
SELECT media_id, frame, face, h FROM (SELECT *, max(h) OVER (PARTITION BY media_id, frame) AS t FROM fbox)
WHERE h >= 0.06 * 1080 AND h >= 0.4 * t""")
oracle("wide_frames", """
SELECT m.media_id, m.frame, coalesce(w, false) AS wide FROM mframes m LEFT JOIN (
  SELECT media_id, frame, count(*) >= 2 AND max(x + w / 2) - min(x + w / 2) >= 0.2 * 1920 AS w FROM det
  WHERE h BETWEEN 0.2 * 1080 AND 1080 GROUP BY ALL) d ON d.media_id = m.media_id AND d.frame = m.frame""")
oracle("hit_rates", """
SELECT media_id, count(*) AS frames, round(avg((n >= 1)::INT), 6) AS person_rate, round(avg((n >= 2)::INT), 6) AS multi_rate
FROM fcount f GROUP BY media_id""")
oracle("largest_box", "SELECT * FROM lbox")
oracle("best_performer", """
SELECT media_id, frame, b.x AS x, b.y AS y, b.w AS w, b.h AS h, s AS score FROM (
  SELECT media_id, frame, arg_max({'x': x, 'y': y, 'w': w, 'h': h}, {'s': s, 'a': -x, 'b': -y, 'c': -h}) AS b, max(s) AS s FROM (
    SELECT *, round((det % 256) / 255.0::DOUBLE * 1.0 + (1 - y / 1080) * 0.5::DOUBLE + h / 1080 * 0.3::DOUBLE, 9) AS s FROM det WHERE h >= 270)
  GROUP BY media_id, frame)""")
define("pan", """
  SELECT media_id, frame, panel, l, r FROM mframes, (VALUES (0, 0, 630), (1, 650, 1270), (2, 1290, 1920)) v(panel, l, r)""")
define("placed", """
  SELECT b.media_id, b.frame, person, b.w * b.h AS area,
         arg_min(panel, greatest(l - (x + w / 2), 0, x + w / 2 - (r - 1)) * 100 + panel) AS panel
  FROM nbox b JOIN pan p ON p.media_id = b.media_id AND p.frame = b.frame GROUP BY ALL""")
oracle("nearest_panel", "SELECT media_id, frame, person, panel FROM placed")
oracle("prominent_panels", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id, frame ORDER BY area DESC, panel)::INTEGER AS place FROM (
  SELECT media_id, frame, panel, max(area) AS area FROM placed GROUP BY ALL)) WHERE place <= 2""")
SHARED = ("(greatest(0, least(f.x + f.w, p.x + p.w) - greatest(f.x, p.x)) * greatest(0, least(f.y + f.h, p.y + p.h) - greatest(f.y, p.y)))")
define("fpairs", f"""
  SELECT f.media_id, f.frame, face, person, {SHARED} / (f.w * f.h) AS score FROM fbox f JOIN nbox p ON p.media_id = f.media_id AND p.frame = f.frame
  WHERE f.w > 0 AND f.h > 0 AND f.y + f.h / 2 >= p.y AND f.y + f.h / 2 <= p.y + 0.6::DOUBLE * p.h AND {SHARED} / (f.w * f.h) >= 0.5 AND f.w >= 0.05::DOUBLE * p.w""")
oracle("face_match", "WITH s AS (" + fold(
    "fpairs", "media_id, frame", "{'f': face, 'p': person, 'score': score}", "score DESC, face, person",
    "CASE WHEN len(list_filter(a, lambda y: y.f = x[1].f OR y.p = x[1].p)) > 0 THEN a ELSE list_concat(a, x) END") + """)
SELECT media_id, frame, r.f AS face, r.p AS person, round(r.score, 6) AS score FROM s""")
oracle("distinct_subjects", "WITH e AS (SELECT vec_id // 250 AS media_id, vec_id // 10 AS frame, vec_id AS face, embedding::DOUBLE[] AS v, vec_id % 10 * 60 AS x, 100 + vec_id * 7 % 50 AS w, 100 + vec_id * 13 % 50 AS h FROM embeddings),\ns AS (" + fold(
    "e", "media_id, frame", "{'face': face, 'v': v, 'x': x, 'w': w, 'h': h}", "w * h DESC, face",
    """CASE WHEN len(list_filter(a, lambda y: NOT (
         greatest(0, least(x[1].x + x[1].w, y.x + y.w) - greatest(x[1].x, y.x)) * least(x[1].h, y.h)
         / (x[1].w * x[1].h + y.w * y.h - greatest(0, least(x[1].x + x[1].w, y.x + y.w) - greatest(x[1].x, y.x)) * least(x[1].h, y.h)) <= 0.3
         AND list_cosine_similarity(x[1].v, y.v) < 0.05))) > 0 THEN a ELSE list_concat(a, x) END""") + """)
SELECT media_id, frame, r.face AS face FROM s""")
define("changes", """
  SELECT media_id, frame, CASE WHEN p1 IS NULL THEN 0 ELSE list_sum(list_transform(range(1, 65), lambda i: abs(s[i] - p1[i]))) / 64 END AS d1,
         CASE WHEN p6 IS NULL THEN 0 ELSE list_sum(list_transform(range(1, 65), lambda i: abs(s[i] - p6[i]))) / 64 END AS d6
  FROM (SELECT media_id, frame, signature::DOUBLE[] AS s, lag(signature::DOUBLE[]) OVER w AS p1, lag(signature::DOUBLE[], 6) OVER w AS p6
        FROM sigs WINDOW w AS (PARTITION BY media_id ORDER BY frame))""")
oracle("signature_changes", "SELECT media_id, frame, round(d1, 6) AS d1, round(d6, 6) AS d6 FROM changes c")
define("cutl", "SELECT media_id, r.f AS frame FROM (" + fold(
    "changes", "media_id", "{'f': frame, 'd1': d1, 'd6': d6}", "frame",
    """CASE WHEN x[1].f - a[-1].f >= 3 AND greatest(x[1].d1, CASE WHEN x[1].f - a[-1].f >= 6 THEN x[1].d6 ELSE 0 END) >= 0.165
       THEN list_concat(a, x) ELSE a END""") + ")")
oracle("shot_cuts", "SELECT media_id, frame FROM cutl WHERE frame > 0")
define("shotl", """
  SELECT media_id, frame AS start_frame, coalesce(lead(frame) OVER (PARTITION BY media_id ORDER BY frame), n) AS end_frame
  FROM cutl JOIN (SELECT media_id, max(frame) + 1 AS n FROM sigs GROUP BY ALL) USING (media_id)""")
oracle("shots", "SELECT * FROM shotl")
oracle("frame_shot", """
SELECT g.media_id, frame, start_frame, end_frame FROM sigs g JOIN shotl s ON s.media_id = g.media_id AND frame >= start_frame AND frame < end_frame""")
oracle("smoothed_centers", """
WITH f AS (SELECT m.media_id, m.frame, m.frame // 37 AS seg, (m.frame // 50) % 2 AS panel, x + w / 2 AS x
           FROM mframes m LEFT JOIN lbox l ON l.media_id = m.media_id AND l.frame = m.frame),
t AS (SELECT *, coalesce(last_value(x IGNORE NULLS) OVER w,
             CASE WHEN first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER n <= seg * 37 + 3
                  THEN first_value(x IGNORE NULLS) OVER n END, 960) AS target
      FROM f WINDOW w AS (PARTITION BY media_id, seg ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    n AS (PARTITION BY media_id, seg ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, frame // 50 AS run FROM t),
s AS (""" + fold("g", "media_id, seg, run", "{'f': frame, 't': target::DOUBLE, 'c': target::DOUBLE}", "frame",
                 "list_concat(a, [{'f': x[1].f, 't': x[1].t, 'c': 0.1::DOUBLE * x[1].t + (1 - 0.1::DOUBLE) * a[-1].c}])") + """)
SELECT media_id, r.f AS frame, r.t AS target, round(r.c + 1e-9, 6) AS center,
       greatest(0, least(round_even(round(r.c + 1e-9, 6) - 304, 0)::INTEGER, 1920 - 608)) AS crop_x FROM s""")
oracle("portrait_boxes", """
WITH a AS (SELECT *, x + w / 2 AS nx, y + h / 8 AS ny, greatest(8, abs(y + h / 4 - (y + h / 8))) AS head FROM nbox),
b AS (SELECT *, ny - 1.5::DOUBLE * head AS top, least((ny + 3.5::DOUBLE * head) - (ny - 1.5::DOUBLE * head), 1080, 1920 / 1.125::DOUBLE) AS ph FROM a),
c AS (SELECT *, greatest(1, least(1080, (round_even(ph / 8, 0) * 8)::INTEGER)) AS ch, greatest(1, least(1920, (round_even(ph * 1.125::DOUBLE / 8, 0) * 8)::INTEGER)) AS cw FROM b)
SELECT media_id, frame, person, greatest(0, least(1920 - cw, (round_even((nx - cw / 2) / 8, 0) * 8)::INTEGER)) AS x,
       greatest(0, least(1080 - ch, (round_even(top / 8, 0) * 8)::INTEGER)) AS y, cw AS w, ch AS h FROM c""")
oracle("panel_crops", """
WITH a AS (SELECT media_id, frame, person, x, y, w * 3 AS bw, h * 3 AS bh, x // 640 * 640 AS l, y + h / 8 AS focus FROM nbox),
b AS (SELECT *, least(1.0::DOUBLE, 640 / greatest(1, bw), 1080 / greatest(1, bh)) AS sc FROM a),
c AS (SELECT *, greatest(1, least(640, round_even(bw * sc, 0)::BIGINT)) AS cw, greatest(1, least(1080, round_even(bh * sc, 0)::BIGINT)) AS ch FROM b)
SELECT media_id, frame, person, greatest(l, least(l + 640 - cw, round_even(x + (bw - cw) / 2, 0)::BIGINT)) AS x,
       greatest(0, least(1080 - ch, CASE WHEN ch < bh THEN round_even(focus - ch * 0.5::DOUBLE, 0)::BIGINT ELSE y END)) AS y, cw AS w, ch AS h FROM c""")
oracle("box_overlaps", """
WITH a AS (SELECT *, lead(x) OVER w AS ox, lead(y) OVER w AS oy, lead(w) OVER w AS ow, lead(h) OVER w AS oh FROM nbox
           WINDOW w AS (PARTITION BY media_id, frame ORDER BY person)),
b AS (SELECT *, greatest(0, least(x + w, ox + ow) - greatest(x, ox)) * greatest(0, least(y + h, oy + oh) - greatest(y, oy)) AS inter,
             greatest(0, least(x + w // 3 + w // 4, ox + ow) - greatest(x + w // 3, ox)) * greatest(0, least(y + 5 + h // 8, oy + oh) - greatest(y + 5, oy)) AS fin
      FROM a WHERE ox IS NOT NULL)
SELECT media_id, frame, person, round(inter / (w * h + ow * oh - inter), 6) AS iou, fin / greatest((w // 4) * (h // 8), 1) >= 0.95 AS visible FROM b""")

IOU = ("(greatest(0, least({p}.x + {p}.w, {q}.x + {q}.w) - greatest({p}.x, {q}.x)) * greatest(0, least({p}.y + {p}.h, {q}.y + {q}.h) - greatest({p}.y, {q}.y)))"
       " / ({p}.w * {p}.h + {q}.w * {q}.h - (greatest(0, least({p}.x + {p}.w, {q}.x + {q}.w) - greatest({p}.x, {q}.x)) * greatest(0, least({p}.y + {p}.h, {q}.y + {q}.h) - greatest({p}.y, {q}.y))))")

NEAR = "list_position(list_transform(a[-1].cs, lambda v: abs(v - x[1].x)), list_min(list_transform(a[-1].cs, lambda v: abs(v - x[1].x))))"
CLUSTER = """list_concat(a, [CASE WHEN list_min(list_transform(a[-1].cs, lambda v: abs(v - x[1].x))) <= 120
  THEN {'f': x[1].f, 'x': x[1].x, 'c': (NEAR - 1)::INTEGER, 'cs': list_transform(a[-1].cs, lambda v, i: CASE WHEN i = NEAR THEN MOVED ELSE v END),
        'ns': list_transform(a[-1].ns, lambda v, i: CASE WHEN i = NEAR THEN v + 1 ELSE v END)}
  ELSE {'f': x[1].f, 'x': x[1].x, 'c': len(a[-1].cs)::INTEGER, 'cs': list_append(a[-1].cs, x[1].x), 'ns': list_append(a[-1].ns, 1)} END])"""
for name, moved in (("online_clusters", "(v * a[-1].ns[i] + x[1].x) / (a[-1].ns[i] + 1)"), ("drifting_tracks", "0.9::DOUBLE * v + 0.1::DOUBLE * x[1].x")):
    oracle(name, "WITH s AS (" + fold(
        "lbox", "media_id", "{'f': frame, 'x': (x + w / 2)::DOUBLE, 'c': 0, 'cs': [(x + w / 2)::DOUBLE], 'ns': [1]}", "frame",
        CLUSTER.replace("MOVED", moved).replace("NEAR", NEAR)) + ")\nSELECT media_id, r.f AS frame, r.c AS cluster FROM s")

define("tracked", """
  SELECT m.media_id, m.frame, coalesce(bs, []) AS bs FROM mframes m LEFT JOIN (
    SELECT media_id, frame, list({'x': x::DOUBLE, 'y': y::DOUBLE, 'w': w::DOUBLE, 'h': h::DOUBLE,
                                  'fx': CASE WHEN (x + y) % 3 = 0 THEN x + w / 3 END} ORDER BY x, y, w, h) AS bs FROM nbox GROUP BY ALL) b
  ON b.media_id = m.media_id AND b.frame = m.frame""")
POOL = "CASE WHEN len(list_filter(x[1].bs, lambda b: b.fx IS NOT NULL)) > 0 THEN list_filter(x[1].bs, lambda b: b.fx IS NOT NULL) ELSE x[1].bs END"
oracle("link_speakers", """
WITH turns AS (SELECT s_suppkey AS media_id, 'S' || (k % 3) AS speaker_id, k * 1000 AS s, k * 1000 + 400 + (s_suppkey * 7 + k * 131) % 600 AS e
               FROM supplier, range(0, 9) t(k)),
sp AS (SELECT media_id, speaker_id, arg_max({'s': s, 'e': e}, {'d': e - s, 'n': -s}) AS t FROM turns GROUP BY ALL),
w AS (SELECT media_id, speaker_id, floor(t.s * 30.0 / 1000) AS lo, floor(t.e * 30.0 / 1000) AS hi FROM sp),
sm AS (SELECT media_id, frame, (x // 400)::INTEGER AS cluster, CASE WHEN media_id % 4 <> 0 THEN h ELSE 7 END::DOUBLE AS o FROM nbox),
cl AS (SELECT DISTINCT media_id, cluster FROM sm),
r AS (SELECT w.media_id, speaker_id, c.cluster, count(o) AS n, coalesce(CASE WHEN count(o) >= 2 THEN var_pop(o) END, 0) AS v
      FROM w JOIN cl c ON c.media_id = w.media_id LEFT JOIN sm ON sm.media_id = w.media_id AND sm.cluster = c.cluster AND frame >= lo AND frame < hi
      WHERE hi > lo GROUP BY ALL),
p AS (SELECT media_id, speaker_id, CASE WHEN max(v) = 0 THEN arg_max(cluster, {'n': n, 'c': -cluster}) ELSE arg_max(cluster, {'v': v, 'c': -cluster}) END AS want,
             list(cluster ORDER BY n DESC, cluster) AS dens FROM r GROUP BY ALL),
s AS (""" + fold("p", "media_id", "{'sp': speaker_id, 'd': dens, 'want': want}", "speaker_id",
    """list_concat(a, [{'sp': x[1].sp, 'd': x[1].d, 'want': CASE WHEN list_contains(list_transform(a, lambda y: y.want), x[1].want)
         THEN coalesce(list_filter(x[1].d, lambda c: c <> x[1].want)[1], x[1].want) ELSE x[1].want END}])""") + """)
SELECT media_id, r.sp AS speaker_id, r.want AS cluster FROM s""")

oracle("layout_panels", """
WITH b AS (SELECT media_id, frame, panel, max(area) AS area FROM placed GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY media_id, frame ORDER BY area DESC, panel) AS place FROM b),
f AS (SELECT media_id, frame, frame // 60 AS layout, string_agg(panel::VARCHAR, ',' ORDER BY panel) AS panels FROM r WHERE place <= 2 GROUP BY ALL HAVING count(*) = 2)
SELECT media_id, layout, min(frame) AS frame, arg_min(panels, frame) AS panels FROM f GROUP BY ALL""")
oracle("shot_samples", """
WITH s AS (SELECT media_id, start_frame, end_frame, least(4, greatest(0, (end_frame - start_frame - 1) // 4)) AS i FROM shotl),
p AS (SELECT *, start_frame + i AS lo, end_frame - 1 - i AS hi FROM s)
SELECT DISTINCT media_id, start_frame, lo + (hi - lo) * k // 2 AS frame FROM p, range(3) t(k)""")


def iou(p: str, q: str) -> str:
    return IOU.replace("{p}", p).replace("{q}", q)


def let(name: str, value: str, body: str) -> str:
    """`body` with `name` bound to `value`."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


NO_BOX = "NULL::STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, fx DOUBLE)"
define("pools", """
  SELECT media_id, frame, pool, pool[list_position(list_transform(pool, lambda b: b.w * b.h), list_max(list_transform(pool, lambda b: b.w * b.h)))] AS big FROM (
    SELECT media_id, frame, {front} AS pool FROM tracked)
""".replace("{front}", "CASE WHEN len(list_filter(bs, lambda b: b.fx IS NOT NULL)) > 0 THEN list_filter(bs, lambda b: b.fx IS NOT NULL) ELSE bs END"))
NEAREST = ("x[1].pool[list_position(list_transform(x[1].pool, lambda b: " + iou("b", "a[-1].body") + "), "
           "list_max(list_transform(x[1].pool, lambda b: " + iou("b", "a[-1].body") + ")))]")
CENTRED = "{'x': CASE WHEN c.fx IS NULL THEN c.x ELSE c.fx - c.w / 2 END, 'y': c.y, 'w': c.w, 'h': c.h, 'fx': NULL::DOUBLE}"
oracle("follow_primary", "WITH src AS (SELECT media_id, frame, pool, big FROM pools UNION ALL SELECT DISTINCT media_id, -1, [], " + NO_BOX + " FROM pools),\ns AS (" + fold(
    "src", "media_id", "{'f': frame, 'pool': pool, 'big': big, 'body': " + NO_BOX + ", 'out': " + NO_BOX + "}", "frame",
    "list_concat(a, [CASE WHEN x[1].f % 2 = 1 THEN {'f': x[1].f, 'pool': [], 'big': " + NO_BOX + ", 'body': a[-1].body, 'out': a[-1].body}"
    " WHEN len(x[1].pool) = 0 THEN {'f': x[1].f, 'pool': [], 'big': " + NO_BOX + ", 'body': a[-1].body, 'out': " + NO_BOX + "}"
    " ELSE " + let("c", "CASE WHEN a[-1].body IS NULL THEN x[1].big ELSE " + let(
        "n", NEAREST, "CASE WHEN " + iou("n", "a[-1].body") + " >= 1e-4 THEN n ELSE x[1].big END") + " END",
        "{'f': x[1].f, 'pool': [], 'big': " + NO_BOX + ", 'body': " + CENTRED + ", 'out': " + CENTRED + "}") + " END])") + """)
SELECT media_id, r.f AS frame, round(r.out.x, 6) AS x, round(r.out.y, 6) AS y, round(r.out.w, 6) AS w, round(r.out.h, 6) AS h FROM s WHERE r.f >= 0""")

define("crowds", """
  SELECT media_id, frame // 100 AS shot, frame, bs AS pool,
         bs[list_position(list_transform(bs, lambda b: b.w * b.h), list_max(list_transform(bs, lambda b: b.w * b.h)))] AS big FROM tracked""")
SNAPPED = "greatest(0, least(1312, (round_even(greatest(0, least(1312, round_even(c.x + c.w / 2 - 304, 0))) / 8, 0) * 8)))::DOUBLE"
STEP = let("c", "CASE WHEN len(x[1].pool) = 0 THEN " + NO_BOX + " WHEN a[-1].body IS NULL THEN x[1].big ELSE " + let(
    "n", NEAREST, "CASE WHEN " + iou("n", "a[-1].body") + " >= 0.15 THEN n ELSE x[1].big END") + " END",
    let("s", "CASE WHEN c IS NULL OR a[-1].body IS NULL THEN 0 ELSE " + iou("c", "a[-1].body") + " END",
    let("keep", "c IS NULL OR (a[-1].target IS NOT NULL AND s >= 0.5)",
    let("nt", "CASE WHEN keep THEN a[-1].target ELSE " + SNAPPED + " END",
    let("miss", "CASE WHEN c IS NULL THEN a[-1].miss + 1 ELSE 0 END",
    let("sh", "CASE WHEN NOT keep AND a[-1].shown IS NOT NULL AND s < 0.15 THEN nt ELSE a[-1].shown END",
    let("adv", "CASE WHEN sh IS NULL THEN nt WHEN sh = nt THEN sh WHEN abs(round_even(sh + (nt - sh) / 16, 0) - nt) <= 1 THEN nt ELSE round_even(sh + (nt - sh) / 16, 0) END",
    let("idle", "c IS NULL AND NOT (a[-1].shown IS NOT NULL AND miss <= 15)",
        "{'f': x[1].f, 'pool': [], 'big': " + NO_BOX + ", 'body': CASE WHEN keep THEN a[-1].body ELSE c END, 'target': nt, 'miss': miss, "
        "'shown': CASE WHEN idle THEN a[-1].shown ELSE adv END, 'out': CASE WHEN idle THEN 656 ELSE adv END}"))))))))
oracle("locked_crops", "WITH src AS (SELECT * FROM crowds UNION ALL SELECT DISTINCT media_id, shot, -1, [], " + NO_BOX + " FROM crowds),\ns AS (" + fold(
    "src", "media_id, shot", "{'f': frame, 'pool': pool, 'big': big, 'body': " + NO_BOX + ", 'target': NULL::DOUBLE, 'miss': 0, 'shown': NULL::DOUBLE, 'out': NULL::DOUBLE}",
    "frame", "list_concat(a, [" + STEP + "])") + """)
SELECT media_id, shot, r.f AS frame, r.out::INTEGER AS crop_x FROM s WHERE r.f >= 0""")
