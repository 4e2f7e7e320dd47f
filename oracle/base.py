"""Shared common table expressions: the bindings of ``timedspark.plans.bind`` in SQL."""

from __future__ import annotations

import re

ORACLE: dict[str, str] = {}

CTES: dict[str, str] = {
    "words": """
      SELECT media_id, turn, pos, turn * 4294967296 + pos AS seq, role,
             (end_raw - len_ms)::BIGINT AS start_ms, end_raw::BIGINT AS end_ms, text
      FROM (SELECT *, sum(gap_ms + len_ms) OVER (PARTITION BY media_id ORDER BY turn, pos) AS end_raw
            FROM (SELECT *, 80 * length(text) + 60 AS len_ms,
                         CASE WHEN pos = 0 THEN 900 ELSE 40 + 170 * (pos % 7) END AS gap_ms
                  FROM (SELECT media_id, turn, role, unnest(toks) AS text,
                               (generate_subscripts(toks, 1) - 1)::BIGINT AS pos
                        FROM (SELECT conv_id AS media_id, turn, role,
                                     list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS toks
                              FROM conversations))))""",
    "segs": """
      SELECT media_id, turn, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
             string_agg(text, ' ' ORDER BY pos) AS text, count(*) AS n_words
      FROM words GROUP BY ALL""",
    "durs": "SELECT media_id, max(end_ms) AS duration_ms FROM words GROUP BY ALL",
    "clips": """
      SELECT * FROM (
        SELECT media_id, k AS clip, 12000 * k + (media_id * 137 + k * 911) % 5000 AS clip_start,
               12000 * k + (media_id * 137 + k * 911) % 5000 + 15000 + 1000 * ((media_id * 31 + k * 17) % 40) AS clip_end,
               (media_id * 7919 + k * 104729) % 1000 AS score, duration_ms
        FROM (SELECT media_id, duration_ms, unnest(range(0, duration_ms // 12000 + 1)) AS k FROM durs))
      WHERE clip_end <= duration_ms""",
    "ev": """
      SELECT user_id AS media_id, event_id AS seq, event_type AS kind, epoch_us(ts) // 1000 AS start_ms,
             epoch_us(ts) // 1000 + round(value * 300000)::BIGINT AS end_ms, round(value * 100)::BIGINT AS score
      FROM events""",
    "det": """
      SELECT l_suppkey AS media_id, l_orderkey % 300 AS frame, l_partkey % 1600 AS x,
             (l_linenumber * 40)::BIGINT AS y, 100 + l_quantity::BIGINT * 4 AS w,
             150 + l_quantity::BIGINT * 12 AS h, l_discount * 10 AS confidence, l_orderkey AS det
      FROM lineitem""",
    "mframes": "SELECT s_suppkey AS media_id, unnest(range(0, 300)) AS frame FROM supplier",
    "sigs": """
      SELECT vec_id // 250 AS media_id, vec_id % 250 AS frame, embedding AS signature FROM embeddings""",
}

NEEDS = {name: [other for other in CTES if other != name and re.search(rf"\b{other}\b", body)]
         for name, body in CTES.items()}


def define(name: str, body: str) -> None:
    """Add a shared expression."""
    CTES[name] = body
    NEEDS[name] = [other for other in CTES if other != name and re.search(rf"\b{other}\b", body)]


def oracle(name: str, body: str) -> None:
    """Register a statement, with the shared expressions it mentions put in front."""
    if name in ORACLE:
        raise ValueError(f"oracle {name} is registered twice")
    ordered: list[str] = []

    def visit(cte: str) -> None:
        for other in NEEDS[cte]:
            visit(other)
        if cte not in ordered:
            ordered.append(cte)

    for cte in CTES:
        if re.search(rf"\b(FROM|JOIN)\s+{cte}\b|,\s*{cte}\s", body):
            visit(cte)
    prefix = ",\n".join(f"{cte} AS ({CTES[cte].strip()})" for cte in ordered)
    own = body.strip()
    if own.upper().startswith("WITH RECURSIVE"):
        ORACLE[name] = "WITH RECURSIVE " + (prefix + ",\n" if prefix else "") + own[len("WITH RECURSIVE"):].lstrip()
    elif own.upper().startswith("WITH "):
        ORACLE[name] = "WITH " + (prefix + ",\n" if prefix else "") + own[5:]
    else:
        ORACLE[name] = (f"WITH {prefix}\n" if prefix else "") + own


def rounded(x: str, digits: int) -> str:
    """SQL for the nearest number with `digits` decimals by the exact binary value; true halves go to even."""
    scale = 2 * 10 ** digits
    return (f"list_transform([({x})::DOUBLE], lambda v: list_transform([v * 134217729.0::DOUBLE - (v * 134217729.0::DOUBLE - v)], lambda h: "
            f"(floor(v * {scale} / 2) + CASE WHEN NOT (v * {scale} = floor(v * {scale}) AND (v * {scale}) % 2 = 1) "
            f"THEN floor(v * {scale} / 2 + 0.5) - floor(v * {scale} / 2) "
            f"WHEN (h * {scale} - v * {scale}) + (v - h) * {scale} < 0 THEN 0 WHEN (h * {scale} - v * {scale}) + (v - h) * {scale} > 0 THEN 1 "
            f"ELSE floor(v * {scale} / 2) % 2 END) / {10 ** digits})[1])[1]")
