"""The operators' results in SQL, where SQL can express them."""

from __future__ import annotations

import math

from tidelog.llm import secrets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SET_JOIN = f"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS id, doc_id AS reach FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(reach) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(name: str, pattern: str, group: int) -> str:
    """A table of all matches: doc_id, s, e, m (the match), v (its group)."""
    rx = _quoted(pattern)
    return f"""{name}_x AS (SELECT doc_id, regexp_extract_all(t, {rx}) AS m, regexp_extract_all(t, {rx}, {group}) AS v, string_split_regex(t, {rx}) AS g FROM d),
    {name}_y AS (SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM {name}_x),
    {name} AS (SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n, m[i] AS m, v[i] AS v FROM {name}_y)"""


def secret_scans() -> str:
    parts, base = ["d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"], []
    for rank, (kind, pattern, group, least) in enumerate(secrets.PATTERNS):
        parts.append(_matches(f"k{rank}", pattern, group))
        base.append(f"SELECT doc_id, s, s + n AS e, {rank} AS rank, '{kind}' AS kind FROM k{rank} WHERE length(v) >= {least}")
    parts.append("s0 AS (" + " UNION ALL ".join(base) + ")")
    allowed = " OR ".join(f"regexp_full_match(m, {_quoted(p)})" for p in secrets.ALLOWED)
    for step, of in enumerate(secrets.CLASSES):
        limit = int(of.window * (math.log2(of.window) - of.bits) * secrets.SCALE)
        name, rank = f"c{step}", len(secrets.PATTERNS) + step
        parts.append(_matches(name, f"{of.run}{{{of.window},}}", 0))
        parts.append(f"""{name}_f AS (SELECT * FROM {name} c WHERE NOT ({allowed}) AND NOT EXISTS (SELECT 1 FROM s{step} b WHERE b.doc_id = c.doc_id AND b.s < c.s + c.n AND c.s < b.e)),
    {name}_w AS (SELECT doc_id, s, n, j, unnest(string_split(substr(m, j, {of.window}), '')) AS ch FROM (SELECT *, unnest(range(1, n - {of.window} + 2)) AS j FROM {name}_f)),
    {name}_h AS (SELECT doc_id, s, n, j, ch, count(*) AS k FROM {name}_w GROUP BY ALL),
    {name}_l AS (SELECT doc_id, s, n, j, sum(CAST(round(k * log2(k) * {secrets.SCALE}) AS BIGINT)) AS total FROM {name}_h GROUP BY ALL),
    {name}_r AS (SELECT doc_id, s, n FROM {name}_l GROUP BY ALL HAVING min(total) <= {limit}),
    s{step + 1} AS (SELECT * FROM s{step} UNION ALL SELECT doc_id, s, s + n AS e, {rank} AS rank, '{of.kind}' AS kind FROM {name}_r)""")
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in secrets.PATTERNS)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    return f"""WITH {", ".join(parts)}
    SELECT d.doc_id, {counts}, sha256(coalesce({joined} FILTER (rank < {len(secrets.PATTERNS)}), '')) AS base_sha256, coalesce({joined} FILTER (kind IS NOT NULL), '') AS spans
    FROM d LEFT JOIN s{len(secrets.CLASSES)} USING (doc_id) GROUP BY d.doc_id"""


EXACT_DEDUP = f"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""

TOP_K = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

PHRASES = f"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
    p AS (SELECT id, lang, generate_subscripts(ps, 1) AS piece, list_filter(regexp_split_to_array(unnest(ps), '[\\x20\\x09]+'), lambda x: x <> '') AS w
        FROM (SELECT id, lang, regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]') AS ps FROM d)),
    n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
    g AS (SELECT lang, w[i:i + m - 1] AS ws FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, 6) r(m) WHERE len(w) >= m)),
    f AS (SELECT lang, ws, len(ws) AS m, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT a.lang, a.ws, a.f AS a, x.f AS l, y.f AS r, n.n, k, CAST(1000::HUGEINT * a.f * n.n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
        FROM (SELECT *, unnest(range(1, f.m)) AS k FROM f WHERE f.m > 1) a JOIN f x ON x.lang = a.lang AND x.ws = a.ws[1:k] JOIN f y ON y.lang = a.lang AND y.ws = a.ws[k + 1:a.m] JOIN n ON n.lang = a.lang),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS place FROM c),
    o AS (SELECT lang, ws[i:i + s - 1] AS ws, max(f) AS f FROM (SELECT lang, ws, f, s, unnest(range(1, m - s + 2)) AS i FROM f, range(2, 5) q(s) WHERE m > s) GROUP BY 1, 2),
    k AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.ws = b.ws WHERE place = 1 AND (o.f IS NULL OR 100 * o.f < 100 * a)),
    z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
    SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000
"""

ORACLE_SQL = {"op1_ngram_jaccard": SET_JOIN, "op2_secret_scans": secret_scans(), "op7_exact_dedup": EXACT_DEDUP, "op11_exact_top_k": TOP_K, "op12_phrases": PHRASES}
