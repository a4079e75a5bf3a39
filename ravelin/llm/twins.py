"""SQL twins that are long: the manifest as recursive levels, the clustering round by round."""

from __future__ import annotations

_CRC = """xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)::BIGINT[]), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)))"""


def _leaf(n_chars: str) -> str:
    field = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
    return "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


MANIFEST = f"""
    WITH RECURSIVE docs AS (
        SELECT *, row_number() OVER () AS rid, {_leaf("n_chars")} AS leaf,
               CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars::HUGEINT + 1)")} END AS changed
        FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS place FROM docs),
    up(lang, level, pos, n, h) AS (
        SELECT lang, 0, place, count(*) OVER (PARTITION BY lang), leaf FROM placed
        UNION ALL
        SELECT lang, level + 1, pos // 2, (n + 1) // 2, h
        FROM (SELECT lang, level, pos, n, sha256(h || coalesce(lead(h) OVER (PARTITION BY lang ORDER BY pos), '')) AS h FROM up WHERE n > 1)
        WHERE pos % 2 = 0),
    subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS place FROM up WHERE n = 1),
    top(level, pos, n, h) AS (
        SELECT 0, place, count(*) OVER (), subroot FROM subroots
        UNION ALL
        SELECT level + 1, pos // 2, (n + 1) // 2, h
        FROM (SELECT level, pos, n, sha256(h || coalesce(lead(h) OVER (ORDER BY pos), '')) AS h FROM top WHERE n > 1)
        WHERE pos % 2 = 0),
    walk(rid, lang, level, pos, h, proof) AS (
        SELECT rid, lang, 0, place, coalesce(changed, leaf), '' FROM placed
        UNION ALL
        SELECT w.rid, w.lang, w.level + 1, w.pos // 2,
               sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END), w.proof || coalesce(s.h, '')
        FROM walk w JOIN up own ON own.lang IS NOT DISTINCT FROM w.lang AND own.level = w.level AND own.pos = w.pos AND own.n > 1
        LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.pos = xor(w.pos, 1)),
    low AS (SELECT * FROM walk QUALIFY level = max(level) OVER (PARTITION BY rid)),
    high(rid, level, pos, h, proof) AS (
        SELECT l.rid, 0, s.place, l.h, l.proof FROM low l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
        UNION ALL
        SELECT w.rid, w.level + 1, w.pos // 2,
               sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END), w.proof || coalesce(s.h, '')
        FROM high w JOIN top own ON own.level = w.level AND own.pos = w.pos AND own.n > 1
        LEFT JOIN top s ON s.level = w.level AND s.pos = xor(w.pos, 1)),
    done AS (SELECT * FROM high QUALIFY level = max(level) OVER (PARTITION BY rid))
    SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(d.proof) AS proof_sha256, d.h AS folded_root, d.h = t.h AS verified
    FROM placed p JOIN done d USING (rid) JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT h FROM top WHERE n = 1) t
"""


def _round(i: int) -> str:
    # Floor of s / n by whole numbers alone; // cuts towards zero.
    return f"""
    a{i} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d
        FROM (SELECT rid, c, sum((v.x - m.x) * (v.x - m.x))::HUGEINT AS d FROM parts v JOIN m{i} m USING (j) GROUP BY rid, c) GROUP BY rid),
    m{i + 1} AS MATERIALIZED (SELECT m.c, m.j, coalesce(t.x, m.x) AS x FROM m{i} m LEFT JOIN (
        SELECT c, j, (s - ((s % n) + n) % n) // n AS x
        FROM (SELECT c, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM parts JOIN a{i} USING (rid) GROUP BY c, j)) t ON t.c = m.c AND t.j = m.j),"""


CENTROIDS = f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS q FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT rid, unnest(range(64)) AS j, unnest(q) AS x FROM kept),
    first AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR) NULLS LAST, q) - 1 AS c FROM kept),
    m0 AS MATERIALIZED (SELECT c, j, x FROM first JOIN parts USING (rid) WHERE c < 8),
    {"".join(_round(i) for i in range(10))}
    last AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d
        FROM (SELECT rid, c, sum((v.x - m.x) * (v.x - m.x))::HUGEINT AS d FROM parts v JOIN m10 m USING (j) GROUP BY rid, c) GROUP BY rid),
    names AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM m10 GROUP BY c)
    SELECT k.vec_id, l.c::INTEGER AS cluster, l.d::BIGINT AS distance, (sum(l.d) OVER (PARTITION BY l.c))::BIGINT AS cluster_inertia,
           (sum(l.d) OVER ())::BIGINT AS inertia, n.centroid_sha256
    FROM kept k JOIN last l USING (rid) JOIN names n ON n.c = l.c
"""
