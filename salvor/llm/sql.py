"""SQL twins of the queries that SQL can express."""



def _cluster_sql(rounds: int) -> str:
    """Rounds of assignment (a0, a1, ...) and of means (c1, c2, ...) as named tables."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS MATERIALIZED (
            SELECT id, c, d FROM (
                SELECT id, c, d, row_number() OVER (PARTITION BY id ORDER BY d, c) AS place FROM (
                    SELECT v.id, m.c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d FROM v JOIN c{r} m USING (i) GROUP BY v.id, m.c
                )
            ) WHERE place = 1
        )""")
        if r < rounds:
            steps.append(f"""
        c{r + 1} AS MATERIALIZED (
            SELECT m.c, m.i, CASE WHEN s.n IS NULL THEN m.x ELSE ((s.total - ((s.total % s.n) + s.n) % s.n) // s.n)::BIGINT END AS x
            FROM c{r} m LEFT JOIN (
                SELECT a.c, v.i, sum(v.x)::BIGINT AS total, count(*)::BIGINT AS n FROM a{r} a JOIN v USING (id) GROUP BY a.c, v.i
            ) s ON m.c = s.c AND m.i = s.i
        )""")
    return f"""
        WITH numbered AS MATERIALIZED (
            SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings WHERE len(embedding) = 64
        ), flat AS (
            SELECT id, vec_id, unnest(range(1, 65)) AS i, unnest(embedding) AS e FROM numbered
        ), whole AS (
            SELECT id FROM flat GROUP BY id HAVING count(e) = 64 AND bool_and(isfinite(e))
        ), v AS MATERIALIZED (
            SELECT id, vec_id, i, floor(64 * e::DOUBLE)::BIGINT AS x FROM flat SEMI JOIN whole USING (id)
        ), ids AS MATERIALIZED (
            SELECT DISTINCT id, vec_id FROM v
        ), seeds AS (
            SELECT id, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, id) - 1 AS c FROM ids
        ), c0 AS MATERIALIZED (
            SELECT s.c, v.i, v.x FROM seeds s JOIN v USING (id) WHERE s.c < 16
        ), {", ".join(steps)}, sums AS (
            SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY c
        ), names AS (
            SELECT c, sha256(string_agg(x, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c
        )
        SELECT ids.vec_id, a.c::INTEGER AS cluster, a.d AS distance, s.cluster_inertia,
               (SELECT sum(cluster_inertia) FROM sums)::BIGINT AS inertia, n.centroid_sha256
        FROM a{rounds} a JOIN ids USING (id) JOIN sums s USING (c) JOIN names n USING (c)
    """


SQL = {
    "op2_mix_sources": r"""
        WITH sized AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                   CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
            FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
                   1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
            FROM sized GROUP BY source
        ), levels AS (
            SELECT *, row_number() OVER o AS place,
                   ((sum(source_size) OVER ())::DOUBLE - (coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
                   / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM sources WINDOW o AS (ORDER BY most / weight, source NULLS LAST)
        ), free AS (
            SELECT min(place) AS place, arg_min(level, place) AS level FROM levels WHERE most > level * weight
        ), targets AS (
            SELECT l.source, l.source_size,
                   CASE WHEN f.place IS NULL OR l.place < f.place THEN l.most::DOUBLE ELSE f.level * l.weight END AS target
            FROM levels l CROSS JOIN free f
        ), running AS (
            SELECT s.doc_id, s.size, s.source, t.source_size, t.target,
                   coalesce(floor(t.target / nullif(t.source_size, 0)), 0)::BIGINT AS whole,
                   sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h) AS until,
                   sum(s.size) OVER (PARTITION BY s.source, s.h) AS held
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, source,
               size * (whole + CASE WHEN until - held / 2.0 < target - whole * source_size THEN 1 ELSE 0 END)::BIGINT AS taken
        FROM running
    """,
    "op3_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), sized AS (
            SELECT *, length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS body,
                   length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) AS head
            FROM turns
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(body + head + 14)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, (count(*) OVER w)::BIGINT AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_clusters": _cluster_sql(3),
}
