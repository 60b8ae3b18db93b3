"""DuckDB SQL for the results that SQL can express; the other operators are tested against brute force in tests/llm."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """r(node, found) AS (SELECT id, id FROM nodes UNION SELECT r.node, e.y FROM r JOIN edges e ON r.found = e.x),
    c AS (SELECT node, min(found) AS component_id FROM r GROUP BY node)"""

SQL: dict[str, str] = {
    "op1_minhash_near_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
    u AS (SELECT doc_id, unnest(sh) AS g FROM s),
    i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    edges AS (SELECT x, y FROM i JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * n >= 80 * (len(a.sh) + len(b.sh) - n)),
    nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
    SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.node = doc_id""",
    "op10_subspace_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
    edges AS (SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    nodes AS (SELECT id FROM v), {_REACH}
    SELECT id AS vec_id, (SELECT count(*) FROM edges WHERE x = id) AS n_links, component_id, id = component_id AS kept FROM v JOIN c ON c.node = id""",
    "op11_source_divergence": rf"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
    g AS (SELECT DISTINCT lang, source FROM t), o AS (SELECT doc_id, lang, source, unnest(ts) AS term FROM t),
    kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT doc_id) >= 30),
    n AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    full_n AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS n FROM g JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)),
    p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM full_n),
    qn AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL),
    q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM qn),
    d AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
    over AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over))
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
    "op13_filter_interaction": r"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
    f AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e FROM w JOIN s USING (t) LEFT JOIN labels USING (doc_id)),
    x AS (SELECT part, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n FROM f GROUP BY ALL),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
    steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
    k AS (SELECT x.part, filter_order, step, filter_order[step] AS filter,
        sum(CASE WHEN translate(fails, filter_order[1:step], '') = fails THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN contains(fails, filter_order[step]) AND translate(fails, filter_order[1:step - 1], '') = fails THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN contains(fails, filter_order[step]) AND translate(fails, filter_order[1:step - 1], '') <> fails THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN good AND contains(fails, filter_order[step]) AND translate(fails, filter_order[1:step - 1], '') = fails THEN n ELSE 0 END) AS good_lost,
        sum(CASE WHEN toxic AND contains(fails, filter_order[step]) AND translate(fails, filter_order[1:step - 1], '') = fails THEN n ELSE 0 END) AS toxic_lost
        FROM x, steps GROUP BY ALL)
    SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
        (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM k""",
}
