"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

#: Fixed values in SQL: words of a text with A-Z lower-cased, and the blanks that do not count.
WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
BARE = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"


def poisson_mixing(weights: dict[str, float], other: float, seed: int = 29) -> str:
    weight = "CASE source " + " ".join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in weights.items()) + f" ELSE {other}::DOUBLE END"
    uniform = lambda s, *keys: f"(('0x' || substr(md5(concat_ws('|', '{s}', {', '.join(keys)})), 1, 13))::BIGINT)::DOUBLE / 4503599627370496"
    doc = "coalesce(doc_id::VARCHAR, 'null')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest FROM documents),
have AS (SELECT source, sum(length(text) + 1)::DOUBLE AS available, {weight} AS weight FROM d GROUP BY source),
rates AS (SELECT source, weight * (SELECT sum(available) FROM have) / (SELECT sum(weight) FROM have) / available AS rate FROM have),
steps AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
          UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < 100),
drawn AS (SELECT doc_id, d.source, text, digest, rate, count(*) FILTER (c <= {uniform(seed, doc, "digest", "'1'")})::INTEGER AS copies
          FROM d JOIN steps ON steps.source IS NOT DISTINCT FROM d.source GROUP BY ALL),
out AS (SELECT *, unnest(range(copies))::INTEGER AS copy FROM drawn)
SELECT doc_id, source, digest, rate, copies, copy, {uniform(seed + 1, doc, "digest", "copy::VARCHAR")} AS mix_key FROM out"""


QUOTIENT_FILTERS = f"""
WITH d AS (SELECT doc_id, sha256({BARE}) AS text_sha256, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256 FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"""

POSITIONAL_INDEX = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
            FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, phrase)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

CHUNKED_RECORDS = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT page_id, strlen(html) AS payload_bytes, digest, max(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, payload_bytes, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(digest, (k // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31)::BIGINT + 1, 1)), '') AS payload_digest FROM g"""


#: CRC-32 of a decimal number, bit by bit.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""

PREFIX_TRIE = f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS k FROM (
    SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS id, length(coalesce(text, '')) AS len
    FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM n)),
r AS (SELECT c.conv_id, 0 AS part, k, id, len FROM c JOIN n ON n.conv_id = base AND k <= h
      UNION ALL SELECT c.conv_id, 1, k, id, len FROM c JOIN n ON n.conv_id = c.conv_id AND k > h),
l AS (SELECT c.conv_id, coalesce(list(id ORDER BY part, k) FILTER (id IS NOT NULL), []) AS ids, coalesce(list(len ORDER BY part, k) FILTER (id IS NOT NULL), []) AS lens
      FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, d, array_to_string(ids[1:d], '') AS node, CASE WHEN d = 0 THEN 0 ELSE lens[d] END AS len, d = len(ids) AS ends
      FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM l)),
nodes AS (SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(len) AS len,
          string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ids FROM p GROUP BY node),
kids AS (SELECT node[1:32 * (depth - 1)] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT node[1:32 * up] AS node, sum((n_convs - 1) * len)::BIGINT AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
          FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM nodes LEFT JOIN kids USING (node)) GROUP BY 1)
SELECT nodes.conv_id, nodes.depth, parent.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(nodes.ids, '')) AS ends_sha256
FROM nodes JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes parent ON nodes.depth > 0 AND parent.node = nodes.node[1:32 * (nodes.depth - 1)]"""

#: Rows that take part, with whole-number vectors and a number of their own.
VECTORS = """v AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
SCORE = "list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT"

BLOCK_SEARCH = f"""
WITH {VECTORS},
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, c.row AS other, {SCORE} AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.row <> q.row)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY row ORDER BY score DESC, vec_id, other) QUALIFY row_number() OVER w <= 5"""

HARD_NEGATIVES = f"""
WITH {VECTORS},
r AS (SELECT row, vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
s AS (SELECT q.row AS anchor, q.vec_id AS anchor_id, c.row, c.vec_id, q.label = c.label AS same, {SCORE} AS score FROM r q, r c WHERE q.vec_id % 50 = 0 AND c.row <> q.row),
p AS (SELECT anchor, row, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5)
SELECT anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id, s.row) QUALIFY row_number() OVER w <= 3"""
