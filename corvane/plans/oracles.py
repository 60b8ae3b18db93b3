"""DuckDB SQL with the results of the queries."""

from __future__ import annotations

# What the SQL has in common with the code under test is written out here, so that a wrong constant there shows.
STOPWORDS = (
    "ao aos as os um uma uns umas de do da dos das em no na nos nas por pelo pela pelos pelas para pra "
    "com sem sob sobre entre ate apos ante ou mas que se como quando onde quem qual quais porque pq "
    "seu sua seus suas meu minha nosso nossa este esta estes estas esse essa esses essas isso isto "
    "aquele aquela aquilo ser sao foi foram sendo estar estao esteve tem ter tinha havia haver "
    "fazer faz feito usar usa usado funciona funcionar deve pode posso quero preciso queria "
    "mais menos muito pouco todo toda todos todas ja nao sim so tambem entao assim aqui agora hoje "
    "the of in to for and or is are how what where when why does did an"
).split()
AUTHORITY = {"spec": 1.05, "doc": 0.99, "nota": 0.98, "decisao": 1.06}
AS_OF = "2001-08-01"
WORDS = {0: ["aton", "erbe", "thndly", "that"]}
PAIR = {0: ["that", "ention"]}
SYNONYMS = {"ention": ["estion", "lytion"], "that": ["this"], "and": ["und", "et"]}

FOLD = "strip_accents(lower(text))"
TERMS = rf"regexp_extract_all({FOLD}, '[\p{{L}}\p{{N}}]+')"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _tokens(text: str = "text") -> str:
    every = rf"list_filter(regexp_extract_all(strip_accents(lower({text})), '[\p{{L}}\p{{N}}_]+'), lambda t: len(t) >= 2)"
    content = f"list_filter({every}, lambda t: NOT list_contains({_list(STOPWORDS)}, t))"
    return f"CASE WHEN len({content}) > 0 THEN {content} ELSE {every} END"


def _batch(words: dict[int, list[str]]) -> str:
    return f"SELECT * FROM (VALUES {_values((q, t) for q, ts in words.items() for t in dict.fromkeys(ts))}) v(query_id, term)"


BENCH = f"SELECT item_id AS query_id, unnest(list_distinct({_tokens()})) AS term FROM benchmark"
DOCS = "SELECT doc_id AS id, text FROM documents"
# the words and phrases that begin each text of the benchmark
PHRASES = f"""SELECT item_id AS query_id, unnest(list_distinct(CASE WHEN len(content) > 0 THEN content ELSE every END)) AS term FROM (SELECT *, list_filter(every, lambda t: NOT list_contains({_list(STOPWORDS)}, t)) AS content FROM (
    SELECT item_id, list_filter([w[1] || coalesce('_' || w[2], ''), array_to_string(w[3:5], '_'), w[6]], lambda t: len(t) >= 2) AS every FROM (SELECT item_id, {TERMS} AS w FROM benchmark)))"""


def bm25(batch: str, name: str = "scored", docs: str = DOCS, fields: dict[str, int] | None = None) -> str:
    """Common table expressions that end in ``name`` (query_id, id, score, matched); tokens of up to three parts are phrases."""
    fields = fields or {"text": 1}
    terms = lambda f: rf"regexp_extract_all(strip_accents(lower(coalesce({f}, ''))), '[\p{{L}}\p{{N}}]+')"
    lists = ", ".join(f"{terms(f)} AS ts_{f}" for f in fields)
    places = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {w}::DOUBLE AS weight, unnest(ts_{f}) AS term, generate_subscripts(ts_{f}, 1) AS i FROM {name}_t" for f, w in fields.items())
    return f"""
    {name}_q AS ({batch}),
    {name}_t AS (SELECT id, {lists} FROM ({docs})),
    {name}_l AS (SELECT id, ({' + '.join(f'len(ts_{f})' for f in fields)})::DOUBLE AS length FROM {name}_t),
    {name}_tot AS (SELECT count(*)::DOUBLE AS n, avg(length)::DOUBLE AS mean FROM {name}_l),
    {name}_k AS (SELECT term AS token, regexp_extract_all(term, '[\\p{{L}}\\p{{N}}]+') AS p FROM (SELECT DISTINCT term FROM {name}_q)),
    {name}_p AS ({places}),
    {name}_o AS (SELECT token, id, weight FROM {name}_k JOIN {name}_p ON term = p[1] WHERE len(p) = 1
        UNION ALL SELECT token, a.id, a.weight FROM {name}_k JOIN {name}_p a ON a.term = p[1] JOIN {name}_p b ON b.id = a.id AND b.field = a.field AND b.i = a.i + 1 AND b.term = p[2] WHERE len(p) = 2
        UNION ALL SELECT token, a.id, a.weight FROM {name}_k JOIN {name}_p a ON a.term = p[1] JOIN {name}_p b ON b.id = a.id AND b.field = a.field AND b.i = a.i + 1 AND b.term = p[2]
            JOIN {name}_p c ON c.id = a.id AND c.field = a.field AND c.i = a.i + 2 AND c.term = p[3] WHERE len(p) = 3),
    {name}_h AS (SELECT id, token AS term, sum(weight) AS tf, any_value(length) AS length FROM {name}_o JOIN {name}_l USING (id) GROUP BY id, token),
    {name}_df AS (SELECT term, count(*)::DOUBLE AS df FROM {name}_h GROUP BY term),
    {name}_w AS (SELECT id, term, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean)) AS w FROM {name}_h JOIN {name}_df USING (term), {name}_tot),
    {name} AS (SELECT query_id, id, round(sum(w), 6) AS score, count(*) AS matched FROM {name}_w JOIN {name}_q USING (term) GROUP BY query_id, id)"""


def top(source: str, k: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {source} QUALIFY rank <= {k}"


LEX = bm25(_batch(WORDS)) + f", lex AS ({top('scored', 60)})"
DOT = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6)"
VEC = f"v AS (SELECT a.vec_id AS id, {DOT} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0), vec AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM v QUALIFY rank <= 60)"
FUSED = "fused AS (SELECT coalesce(l.id, v.id) AS id, coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0) AS rrf, l.rank AS rank_0, v.rank AS rank_1 FROM lex l FULL JOIN vec v ON l.id = v.id)"
DATED = """dated AS (SELECT d.*, o_orderdate::DATE AS data, CASE lang WHEN 'en' THEN 'spec' WHEN 'fr' THEN 'doc' WHEN 'de' THEN 'nota' ELSE 'decisao' END AS doc_type,
    CASE WHEN source = 'src3' THEN 'arquivado' END AS status FROM documents d LEFT JOIN orders ON o_orderkey = doc_id)"""
_KINDS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in AUTHORITY.items())
WEIGHT = f"(CASE doc_type {_KINDS} ELSE 1 END)::DOUBLE * (CASE WHEN status = 'arquivado' THEN 0.92 ELSE 1.0 END)::DOUBLE * (CASE WHEN DATE '{AS_OF}' - data <= 30 THEN 1.015 WHEN DATE '{AS_OF}' - data > 365 THEN 0.98 ELSE 1.0 END)::DOUBLE"
KEY = r"trim(regexp_replace(strip_accents(lower(left(text, 300))), '\s+', ' ', 'g'))"
ORDERS = """o AS (SELECT o_orderkey AS path, c_mktsegment AS feature, o_orderpriority AS repo, o_orderstatus AS doc_type, CASE WHEN o_totalprice > 499900 THEN 'arquivado' END AS status,
    o_orderdate::DATE AS data, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey)"""
CALLS = """calls AS (SELECT event_id, ts, event_type AS tool, round(value * 100)::BIGINT AS ms, value < 5 AS empty, len(props) AS size,
    CASE WHEN k % 3 > 0 THEN k % 3 = 1 END AS semantic FROM (SELECT *, (props->>'$.k')::INT AS k FROM events))"""
PCT = "list_sort(list(ms))[(floor({p} * (count(*) - 1)))::BIGINT + 1]"
USAGE = f"""SELECT tool, count(*) AS calls, count(*) FILTER (empty) AS empty, round(avg(size), 6) AS mean_size, {{share}} AS words_only,
    {PCT.format(p=0.5)} AS p50, {PCT.format(p=0.9)} AS p90 FROM calls GROUP BY tool"""
PAIRS = """pairs AS (SELECT event_id, ts, props, CASE WHEN nxt.ts <= ts + INTERVAL 90 MINUTES THEN nxt.id END AS read_id FROM (
    SELECT *, first(CASE WHEN event_type = 'view' THEN {'ts': ts, 'id': event_id} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events)
    WHERE event_type = 'click')"""
RANKED = bm25(BENCH) + f", hits AS ({top('scored', 10)}), expected AS (SELECT b.item_id AS case_id, (SELECT min(rank) FROM hits h JOIN documents d ON d.doc_id = h.id WHERE h.query_id = b.item_id AND contains(d.text, b.text) AND rank <= 10) AS rank FROM benchmark b)"
GAIN = "CASE WHEN rank BETWEEN 1 AND 5 THEN 1 / log2(rank + 1.0) ELSE 0 END"
EDGES = "SELECT 'n:' || l_orderkey AS src, 'n:' || l_partkey AS dst, l_returnflag AS rel FROM lineitem"
STYLE = r"CASE WHEN contains(q, '?') OR len(string_split_regex(trim(q), '\s+')) > 5 THEN 'natural' ELSE 'keywords' END"
CASES = f"cases AS (SELECT *, {STYLE} AS style FROM (SELECT item_id AS id, text AS q, CASE WHEN item_id % 2 = 0 THEN 'code' ELSE 'docs' END AS source, CASE WHEN item_id % 20 = 3 THEN 'negativo' ELSE 'positivo' END AS kind FROM benchmark))"
TITLE = r"CASE WHEN len(f) <= 110 THEN f ELSE regexp_replace(left(f, 110), '\s+\S*$', '') || '…' END"


def _slug(x: str) -> str:
    return f"left(regexp_replace(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 60)"


def _hybrid(fused: str, diverse: bool = False) -> str:
    order = "score DESC, rank_0 ASC NULLS LAST, rank_1 ASC NULLS LAST, id"
    return f"""WITH {LEX}, {VEC}, {fused}, {DATED},
    rows AS (SELECT id, source, rank_0, rank_1, round(rrf * ({WEIGHT}), 8) AS score, {KEY} AS key FROM fused JOIN dated ON doc_id = id),
    one AS (SELECT *, count(*) OVER (PARTITION BY key) - 1 AS collapsed FROM rows QUALIFY row_number() OVER (PARTITION BY key ORDER BY {order}) = 1)
    {f", of_doc AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {order}) AS doc_rank FROM one QUALIFY doc_rank <= 2)" if diverse else ""}
    SELECT id, score, collapsed, row_number() OVER (ORDER BY {"doc_rank, " if diverse else ""}{order}) AS place FROM {"of_doc" if diverse else "one"} QUALIFY place <= 8"""


SQL: dict[str, str] = {
    "q01_fold_slug_title": rf"""SELECT doc_id, md5({FOLD}) AS folded, {_slug('title')} AS slug, title FROM (SELECT *, {TITLE} AS title FROM (
        SELECT *, CASE WHEN regexp_matches(text, '(?s)[.!?]\s') THEN regexp_extract(text, '(?s)^(.*?[.!?])\s', 1) ELSE text END AS f FROM documents))""",
    "q02_query_tokens": f"SELECT item_id, array_to_string({_tokens()}, ' ') AS tokens FROM benchmark",
    "q03_synonym_expansion": f"""SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(t, flatten(list_transform(t, lambda x: CASE x {' '.join(f"WHEN '{k}' THEN {_list(v)}" for k, v in SYNONYMS.items())} ELSE []::VARCHAR[] END))))), ' ') AS tokens
        FROM (SELECT item_id, {_tokens()} AS t FROM benchmark)""",
    "q04_bm25_top60": f"WITH {LEX} SELECT id, score, rank FROM lex",
    "q05_bm25_and_filtered": f"WITH {bm25(_batch(PAIR))}, kept AS (SELECT * FROM scored WHERE matched = 2 AND id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND source <> 'src3')) SELECT id, score, rank FROM ({top('kept', 60)})",
    "q06_two_pass": f"""WITH {bm25(_batch(PAIR), 's')}, {bm25(_batch({0: [*PAIR[0], *SYNONYMS['that'], *SYNONYMS['ention']]}), 'w')},
        a AS (SELECT id, score, 0 AS pass FROM s WHERE matched = 2 ORDER BY score DESC, id LIMIT 60),
        b AS (SELECT id, score, 1 AS pass FROM w WHERE (SELECT count(*) FROM a) < 60 ORDER BY score DESC, id LIMIT 60),
        u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a))
        SELECT id, score, pass::BIGINT AS pass, row_number() OVER (ORDER BY pass, score DESC, id) AS rank FROM u""",
    "q07_bm25_batch": f"WITH {bm25(BENCH)} SELECT query_id, id, score, rank FROM ({top('scored', 10)})",
    "q08_mentions": f"""WITH {DATED}, f AS (SELECT doc_id, source, data, len(list_intersect({TERMS}, ['ention', 'thndly'])) AS n FROM dated)
        SELECT doc_id, source, data FROM f WHERE n >= CASE WHEN (SELECT max(n) FROM f) = 2 THEN 2 ELSE 1 END ORDER BY data DESC NULLS LAST, doc_id LIMIT 15""",
    "q10_catalogue": f"""WITH {ORDERS} SELECT feature, repo, max(CASE WHEN status = 'arquivado' THEN 1 ELSE 0 END)::BIGINT AS archived, string_agg(DISTINCT doc_type, ',' ORDER BY doc_type) AS kinds, count(*) AS n_docs, max(data) AS last_date FROM o GROUP BY ALL""",
    "q11_timeline": f"WITH {ORDERS} SELECT o_custkey, path, doc_type, data, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE doc_type WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, path) AS place FROM o",
    "q12_recent_activity": f"""WITH {ORDERS}, r AS (SELECT *, CASE repo WHEN '1-URGENT' THEN 25 WHEN '2-HIGH' THEN 10 ELSE 5 END AS cap, row_number() OVER (PARTITION BY repo ORDER BY data DESC, path) AS rank, count(*) OVER (PARTITION BY repo) AS n FROM o WHERE data >= DATE '{AS_OF}' - 7)
        SELECT repo, path, data, rank, greatest(0, n - cap)::BIGINT AS more FROM r WHERE rank <= cap""",
    "q14_vector_topk_filtered": f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS id, {DOT} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.label IN (1, 2, 3)) QUALIFY rank <= 60",
    "q15_vector_topk_batch": f"WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS id, {DOT} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0) SELECT query_id, id, score, rank FROM ({top('s', 10)})",
    "q16_coverage": "SELECT count(*) AS total, count(vec_id) AS with_vector, count(*) - count(vec_id) AS pending FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "q16_pending": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "q17_related": f"SELECT id, score FROM (SELECT a.vec_id AS id, {DOT} AS score FROM (SELECT * FROM embeddings WHERE vec_id > 0 ORDER BY vec_id DESC LIMIT 300) a, embeddings b WHERE b.vec_id = 0) WHERE score >= 0.1 ORDER BY score DESC, id LIMIT 5",
    "q17_term_overlap": r"""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{4,}')) AS w FROM benchmark), s AS (
        SELECT a.item_id, round(len(list_intersect(b.w, a.w))::DOUBLE / greatest(1, len(b.w)), 6) AS share FROM w a, w b WHERE b.item_id = 0 AND a.item_id > 0)
        SELECT item_id, share FROM s WHERE share >= 0.05 ORDER BY share DESC, item_id LIMIT 5""",
    "q18_rank_fusion": f"WITH {LEX}, {VEC}, {FUSED} SELECT id, round(rrf, 8) AS rrf, rank_0, rank_1 FROM fused",
    "q19_authority": f"WITH {DATED} SELECT doc_id, round({WEIGHT}, 6) AS weight FROM dated",
    "q20_late_hydration": f"WITH {LEX}, {VEC}, {FUSED} SELECT id, round(rrf, 8) AS rrf, source, lang, left(text, 300) AS snippet FROM fused JOIN documents ON doc_id = id",
    "q21_content_collapse": f"""WITH k AS (SELECT doc_id, source, {KEY} AS key FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS n, min(doc_id) OVER (PARTITION BY key) AS first FROM k)
        SELECT first AS doc_id, count(*) - 1 AS collapsed, coalesce(string_agg(DISTINCT source, ',' ORDER BY source) FILTER (n > 1), '') AS also_in FROM n GROUP BY first""",
    "q22_per_document": f"""WITH k AS (SELECT conv_id AS doc, turn, len(text) AS score, {KEY} AS key FROM conversations), one AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, doc, turn) = 1),
        two AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, doc, turn) AS doc_rank FROM one QUALIFY doc_rank <= 2)
        SELECT doc, turn, row_number() OVER (ORDER BY doc_rank, score DESC, doc, turn) AS place, doc_rank FROM two QUALIFY place <= 100""",
    "q23_hybrid_search": _hybrid(FUSED),
    "q23_hybrid_diverse": _hybrid(FUSED, diverse=True),
    "q23_lexical_only": _hybrid("fused AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS rrf, rank AS rank_0, NULL AS rank_1 FROM lex)"),
    "q24_relevance_floor": f"""WITH {bm25(_batch(WORDS))}, lex AS ({top('scored', 24)}), kept AS (SELECT id, rank FROM lex JOIN documents ON doc_id = id
        WHERE (CASE WHEN source IN ('src1', 'src2') THEN starts_with(source, 'src1') ELSE lang <> 'es' END) AND len(list_filter({_list(WORDS[0])}, lambda t: contains({FOLD}, t))) >= 2)
        SELECT id, row_number() OVER (ORDER BY rank) AS place FROM kept QUALIFY place <= 5""",
    "q25_entity_merge": """WITH c AS (SELECT 'nation:' || n_nationkey AS key, 0::BIGINT AS seq, 'nation' AS kind, NULL AS repo, n_name AS title, NULL AS status FROM nation
        UNION ALL SELECT 'nation:' || s_nationkey, s_suppkey + 1, 'supplier', 's', CASE WHEN s_suppkey % 2 = 0 THEN s_name END, CASE WHEN s_acctbal > 5000 THEN 'rich' END FROM supplier
        UNION ALL SELECT 'nation:' || c_nationkey, c_custkey + 10000000, 'customer', 'c', CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_acctbal < 0 THEN 'poor' END FROM customer)
        SELECT key, first(kind ORDER BY seq) AS kind, first(repo ORDER BY seq) AS repo, last(title ORDER BY seq) FILTER (title IS NOT NULL) AS title, last(status ORDER BY seq) FILTER (status IS NOT NULL) AS status FROM c GROUP BY key""",
    "q26_distinct_edges": f"SELECT rel, count(*) AS edges, count(DISTINCT dst) AS targets FROM (SELECT DISTINCT * FROM ({EDGES}) WHERE src <> dst) GROUP BY rel",
    "q27_round_robin": """WITH n AS (SELECT DISTINCT 'part:' || l_partkey AS target, 'order:' || l_orderkey AS neighbour, 'in' AS direction, 2 AS k FROM lineitem
        UNION SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'out', 1 FROM lineitem), t AS (SELECT *, row_number() OVER (PARTITION BY target, k ORDER BY neighbour) AS turn FROM n)
        SELECT target, neighbour, direction, row_number() OVER (PARTITION BY target ORDER BY turn, k) AS place FROM t WHERE target IN (SELECT 'part:' || p_partkey FROM part) QUALIFY place <= 6""",
    "q30_entity_precedence": "SELECT * FROM (VALUES (1::BIGINT, 'Customer#000000007'), (2, 'Customer#000000005'), (3, 'Customer#000000009'), (5, 'Customer#000000001')) v(request, key) WHERE key IN (SELECT c_name FROM customer)",
    "q30_lookup": "SELECT 'card:r#' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'arquivo' ELSE 'card' END AS kind, c_name AS title FROM customer WHERE c_custkey = 123",
    "q31_usage_report": f"WITH {CALLS} " + USAGE.format(share="round(count(*) FILTER (NOT semantic)::DOUBLE / nullif(count(semantic), 0), 6)"),
    "q31_usage_without_column": f"WITH {CALLS} " + USAGE.format(share="NULL::DOUBLE"),
    "q32_calls_per_day": "SELECT ts::DATE AS day, count(*) AS calls FROM events GROUP BY 1",
    "q32_latest_empty": f"WITH {CALLS} SELECT event_id, tool FROM calls WHERE empty ORDER BY ts DESC, event_id LIMIT 10",
    "q33_following_read": f"WITH {PAIRS} SELECT event_id, read_id FROM pairs WHERE read_id IS NOT NULL",
    "q34_harvest": f"""WITH {PAIRS}, p AS (SELECT event_id AS id, ts, ' Query ' || (props->>'$.k') AS query, read_id % 1200 AS target, (props->>'$.k')::INT % 2 = 0 AS en FROM pairs WHERE read_id IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(query)) ORDER BY ts, id) AS n FROM p)
        SELECT id, CASE WHEN n > 1 THEN 'repeated' WHEN doc_id IS NULL THEN 'missing' WHEN en AND lang <> 'en' THEN 'incoherent' ELSE 'kept' END AS fate, 'keywords' AS style, 'doc/' || target AS expected FROM r LEFT JOIN documents ON doc_id = target""",
    "q35_rank_of_expected": f"WITH {RANKED} SELECT case_id, rank FROM expected",
    "q36_merged_cases": f"WITH {CASES} SELECT id, 'manual' AS origin FROM cases WHERE id % 4 = 0 UNION ALL SELECT id, 'uso' FROM cases WHERE lower(trim(q)) NOT IN (SELECT lower(trim(q)) FROM cases WHERE id % 4 = 0)",
    "q36_coverage_faults": f"""WITH {CASES} SELECT count(*) AS cases, array_to_string(list_filter([CASE WHEN count(*) < 60 THEN 'fewer than 60 cases' END, CASE WHEN count(*) FILTER (source = 'code') = 0 THEN 'no code target' END,
        CASE WHEN count(*) FILTER (kind = 'negativo') < 2 THEN 'fewer than two negatives' END, CASE WHEN count(DISTINCT style) FILTER (kind = 'negativo') < 2 THEN 'negatives of one style' END], lambda x: x IS NOT NULL), '; ') AS faults FROM cases""",
    "q37_verdict": f"""WITH {RANKED}, j AS (SELECT *, case_id % 20 = 3 AS neg, CASE WHEN case_id % 20 = 3 THEN CASE WHEN rank IS NULL THEN 1.0 ELSE 0.0 END ELSE {GAIN} END AS g FROM expected)
        SELECT count(*) AS cases, count(*) FILTER (NOT neg) AS positives, count(*) FILTER (neg) AS negatives, false AS void, round(avg(g), 6) AS ndcg5, count(*) FILTER (NOT neg AND rank = 1) AS hit1,
        count(*) FILTER (NOT neg AND rank <= 5) AS hit5, round(avg(coalesce(1.0::DOUBLE / rank, 0)) FILTER (NOT neg), 6) AS mrr, count(*) FILTER (neg AND rank IS NULL) AS empty_negatives FROM j""",
    "q38_compare": f"""WITH {RANKED}, g AS (SELECT case_id, ({GAIN})::DOUBLE AS base, (CASE WHEN rank <= 2 THEN {GAIN} ELSE 0 END)::DOUBLE AS head FROM expected)
        SELECT case_id, round(base, 6) AS base, round(head, 6) AS head, round(head - base, 6) AS delta, round(head - base, 6) < -1e-9 AS worse FROM g""",
    "q40_differences": "SELECT doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'same' END AS change FROM documents WHERE doc_id % 10 <> 0 OR doc_id % 7 <> 0",
    "q41_source_stats": "SELECT source, count(DISTINCT doc_id) AS docs, count(quality) AS labelled, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "q41_totals": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM embeddings) AS embeddings",
    "q42_leaks": "SELECT page_id, url FROM pages WHERE contains(url, '/en/') OR contains(url, '/de/') ORDER BY page_id LIMIT 5",
    "q43_session_notes": r"""WITH t AS (SELECT *, role = 'user' AND trim(text) <> '' AND NOT regexp_matches(text, '^\s*(<|/|Caveat:)') AS heard FROM conversations WHERE turn % 11 <> 10)
        SELECT conv_id AS session, count(*) FILTER (heard) AS asked, count(*) FILTER (role = 'assistant') AS answered, first(left(text, 220) ORDER BY turn) FILTER (heard) AS first FROM t GROUP BY conv_id HAVING asked >= 1 AND answered >= 2""",
    "q45_crawl": "SELECT 'docs' AS source, 3::BIGINT AS files",
    "q49_json_props": "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k, count(DISTINCT (props->>'$.k')::BIGINT) AS kinds FROM events GROUP BY event_type",
    "q50_stream_increments": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "q51_stream_late": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "q56_backfill": "SELECT doc_id AS vec_id, 384::BIGINT AS dims FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0) ORDER BY doc_id LIMIT 50",
    "q54_upsert": "SELECT source, count(*) AS n, sum(n_chars + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END)::BIGINT AS chars FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 9 = 0 GROUP BY source",
}

_COMMITS = """c AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS sha, o_orderpriority AS repo, strftime(o_orderdate, '%Y-%m-%d') AS data, list_transform(range(1, o_orderkey % 60 + 1), lambda i: 'f' || i) AS fs FROM orders)"""
SQL |= {
    "q58_described_notes": "SELECT doc_id, md5(CASE WHEN source = 'src1' AND lang IS NOT NULL THEN concat_ws(chr(10) || chr(10), lang, text) ELSE text END) AS digest FROM documents",
    "q59_month_files": f"""WITH {_COMMITS}, l AS (SELECT *, data || ' s ' || array_to_string(fs[1:25], ', ') || CASE WHEN len(fs) > 25 THEN ' (+' || (len(fs) - 25) || ')' ELSE '' END AS line FROM c)
        SELECT repo, left(data, 7) AS month, count(*) AS commits, count(DISTINCT CASE WHEN k % 3 = 0 THEN k % 100 END) AS cards, (sum(length(line)) + count(*) - 1)::BIGINT AS chars FROM l GROUP BY ALL""",
    "q60_citing_commits": f"WITH {_COMMITS} SELECT sha, least(len(fs), 40)::BIGINT AS files, (k % 100)::BIGINT AS card FROM c WHERE k % 3 = 0",
    "q61_written_cases": "SELECT doc_id AS id, 'negativo' AS kind, md5(text) AS q FROM documents WHERE doc_id % 40 = 3",
    "q62_beginnings": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), j AS (SELECT conv_id, left(string_agg(text, chr(10) ORDER BY n), 40000) AS t FROM f WHERE n <= 40 GROUP BY conv_id)
        SELECT conv_id, length(t)::BIGINT AS chars, md5(t) AS digest FROM j""",
    "q63_changes_by_repo": "SELECT coalesce(nullif(lang, 'fr'), '?') AS lang, count(*) AS changes FROM documents WHERE source <> 'src3' GROUP BY 1",
    "q64_reasons": "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type",
    "q65_first_chunks": "SELECT conv_id, md5(arg_min(text, turn)) AS digest FROM conversations GROUP BY conv_id",
    "q66_briefings": f"""WITH {ORDERS}, r AS (SELECT repo, path, data, row_number() OVER (PARTITION BY repo ORDER BY data DESC, path) AS rank FROM o WHERE data >= DATE '2001-08-01' - 10)
        SELECT * FROM r WHERE rank <= CASE repo WHEN '1-URGENT' THEN 6 WHEN '2-HIGH' THEN 6 WHEN '3-MEDIUM' THEN 4 WHEN '5-LOW' THEN 5 ELSE 0 END""",
    "q67_described_neighbours": """WITH t AS (SELECT DISTINCT 'part:' || l_partkey AS target FROM lineitem ORDER BY 1 LIMIT 4),
        n AS (SELECT 'part:' || l_partkey AS target, 'order:' || l_orderkey AS neighbour, 'has' AS rel, o_orderstatus AS doc_type FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey UNION SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'from', NULL FROM lineitem),
        r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY rel, neighbour) AS k FROM n WHERE target IN (SELECT target FROM t) QUALIFY k <= 10)
        SELECT target, rel, count(*) AS n, string_agg(neighbour || ' ' || coalesce(doc_type, '-'), ', ' ORDER BY k) AS listed FROM r GROUP BY target, rel""",
    "q68_related_in_scope": f"""SELECT id, score FROM (SELECT a.vec_id AS id, {DOT} AS score FROM (SELECT * FROM embeddings WHERE vec_id > 0 AND vec_id % 7 <> 0 AND (vec_id % 5 = 0 OR vec_id % 2 = 1) ORDER BY vec_id DESC LIMIT 300) a, embeddings b WHERE b.vec_id = 0)
        WHERE score >= 0.05 ORDER BY score DESC, id LIMIT 5""",
    "q69_sync_marks": """WITH e AS (SELECT *, user_id % 50 AS repo, event_type = 'error' AND event_id % 200 = 0 AS failed FROM events), b AS (SELECT repo, min(ts) AS mark FROM e WHERE event_id % 10 = 0 GROUP BY repo)
        SELECT e.repo, CASE WHEN count(*) FILTER (failed) = 0 THEN max(ts) ELSE any_value(b.mark) END AS mark, count(*) FILTER (failed) AS failures FROM e LEFT JOIN b ON e.repo = b.repo GROUP BY e.repo""",
    "q70_telemetry": "SELECT event_type, count(*) AS n, sum(least(length(props) * 100, 500))::BIGINT AS chars FROM events GROUP BY event_type",
    "q71_blobs": "SELECT vec_id, 4 * len(embedding) AS bytes, true AS same FROM embeddings",
    "q72_github_labels": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '[card #' || c_custkey || ']' WHEN 1 THEN '[pr #' || c_custkey || ']' END AS label FROM customer",
    "q73_biggest_drops": f"SELECT case_id, delta FROM ({SQL['q38_compare']}) ORDER BY delta, case_id LIMIT 10",
}

SQL |= {
    "q101_phrase_search": f"WITH {bm25(PHRASES)} SELECT query_id, id, score, matched, rank FROM ({top('scored', 60)})",
    "q102_weighted_fields": f"""WITH {bm25(BENCH + " UNION ALL SELECT -1, unnest(['src1', 'en', 'that'])", fields={'text': 1, 'breadcrumb': 3, 'title': 5}, docs=f"""SELECT doc_id AS id, text, concat_ws(' > ', source, lang) AS breadcrumb, {TITLE} AS title FROM (
        SELECT *, CASE WHEN regexp_matches(text, '(?s)[.!?]\\s') THEN regexp_extract(text, '(?s)^(.*?[.!?])\\s', 1) ELSE text END AS f FROM documents)""")}
        SELECT query_id, id, score, matched, rank FROM ({top('scored', 10)})""",
    "q103_segment_search": f"""WITH {bm25(f"SELECT DISTINCT * FROM ({BENCH} UNION ALL {PHRASES})", docs="""SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN 'That erbe, ' || reverse(text) || ' aton' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 5
        UNION ALL SELECT -doc_id, text || ' erbe und' FROM documents WHERE doc_id % 10 = 4""")} SELECT query_id, id, score, matched, rank FROM ({top('scored', 10)})""",
    "q104_index_refresh": f"""WITH {bm25(_batch(WORDS), docs="SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN text || ' thndly' ELSE text END AS text FROM documents WHERE doc_id % 9 <> 0")}
        SELECT query_id, id, score, matched, rank FROM ({top('scored', 60)})""",
    "q105_hot_session": """SELECT event_id, CASE WHEN nxt.ts <= ts + INTERVAL 5 MINUTES THEN nxt.id END AS read_id FROM (
        SELECT *, first(CASE WHEN event_type = 'view' THEN {'ts': ts, 'id': event_id} END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events) WHERE event_type = 'click'""",
    "q106_fragments_in_documents": r"""WITH s AS (SELECT item_id, string_split_regex(regexp_replace(text, '([.!?])\s', '\1' || chr(1), 'g'), chr(1)) AS parts FROM benchmark),
        f AS (SELECT item_id || '/' || (generate_subscripts(parts, 1) - 1) AS fragment_id, unnest(parts) AS fragment FROM s)
        SELECT fragment_id, doc_id AS id FROM f JOIN documents ON contains(text, fragment) WHERE fragment <> ''""",
    "q107_fragments_in_urls": f"""WITH f AS (SELECT DISTINCT unnest({TERMS}) AS fragment FROM benchmark)
        SELECT fragment AS fragment_id, count(*) AS pages, min(page_id) AS first FROM f JOIN pages ON contains(url, fragment) GROUP BY fragment""",
}

_SYNC = """WITH t AS (SELECT *, turn % 3 = 0 AS review, conv_id % 2 = 0 AS card FROM conversations),
    c AS (SELECT conv_id, turn, CASE WHEN review THEN 'f' ELSE '-' END AS file, CASE WHEN turn % 2 = 1 AND conv_id % 3 = 0 THEN 'again ' || text ELSE text END AS body FROM t
        WHERE turn > 0 AND NOT (review AND card) AND (turn % 2 = 0 OR conv_id % 3 <> 0 OR turn % 4 = 1)),
    l AS (SELECT conv_id, count(*) AS n, string_agg(turn || '=' || file || '=' || body, '|' ORDER BY turn) AS listed FROM c GROUP BY conv_id)
    SELECT CASE WHEN card THEN 'card' ELSE 'pr' END AS kind, conv_id AS number, CASE WHEN conv_id % 5 = 0 THEN '2024-02' ELSE '2024-01' END AS updated, CASE WHEN conv_id % 5 = 0 THEN '2 ' ELSE '' END || md5(text) AS title, coalesce(n, 0) AS n, md5(coalesce(listed, '')) AS digest
    FROM t LEFT JOIN l USING (conv_id) WHERE turn = 0"""
_FRONT = "doc_id % 7 <> 0 AND doc_id % 10 <> 9"
SQL |= {
    "q108_stream_sync": _SYNC,
    "q109_batch_sync": _SYNC,
    "q110_exported_log": """SELECT sha1(o_orderkey::VARCHAR) AS sha, left(sha1(o_orderkey::VARCHAR), 7) AS short, strftime(o_orderdate, '%Y-%m-%d') AS data, 'order ' || o_orderkey || ' #' || (o_orderkey % 900 + 100) AS subject,
        o_orderkey % 4 + 1 AS files, o_orderkey % 900 + 100 AS card FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 10 <> 0 AND o_orderdate >= DATE '1998-01-01'""",
    "q111_yaml_front_matter": f"""SELECT doc_id, md5(CASE WHEN doc_id % 10 = 9 AND doc_id % 7 <> 0 THEN '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'tags: [' || lang || ', ''b c'', ' || source || ']' || chr(10) || 'cards:' || chr(10) || '  - 101' || chr(10) || '  - 7' || chr(10)
        || 'where:' || chr(10) || '  source: "' || source || ': \\"x\\" #1"' || chr(10) || '  deep: {{a: [1, 2.5], b: true}}' || chr(10) || 'note: >' || chr(10) || '  folded' || chr(10) || '  text' || chr(10) || 'raw: |' || chr(10) || '  two' || chr(10) || '  lines' || chr(10) || 'data: 2024-05-06'
        || chr(10) || 'broken: [1, 2' || chr(10) || '---' || chr(10) || text ELSE text END) AS text,
        CASE WHEN {_FRONT} THEN doc_id END AS id, CASE WHEN {_FRONT} THEN lang || '|b c|' || source END AS tags, CASE WHEN {_FRONT} THEN 7::BIGINT END AS card, CASE WHEN {_FRONT} THEN source || ': "x" #1' END AS source,
        CASE WHEN {_FRONT} THEN 2.5::DOUBLE END AS deep, CASE WHEN {_FRONT} THEN true END AS flag, CASE WHEN {_FRONT} THEN 'folded text' || chr(10) END AS note, CASE WHEN {_FRONT} THEN 'two' || chr(10) || 'lines' || chr(10) END AS raw, CASE WHEN {_FRONT} THEN '2024-05-06' END AS data FROM documents""",
}

FILES = """files AS (SELECT p_partkey, 'repo/' || replace(lower(p_brand), '#', '-') || '/' || p_size || '/f' || (p_partkey % 1500) || '.ts' AS path FROM part),
    cut AS (SELECT path, string_split(path, '/') AS parts FROM files),
    suffixes AS (SELECT suffix, any_value(path) AS path FROM (SELECT path, unnest([CASE WHEN len(parts) >= k THEN array_to_string(parts[len(parts) - k + 1:], '/') END FOR k IN [2, 3, 4, 5]]) AS suffix FROM cut) WHERE suffix IS NOT NULL GROUP BY suffix HAVING count(*) = 1),
    names AS (SELECT parts[-1] AS name, any_value(path) AS path FROM cut GROUP BY parts[-1] HAVING count(*) = 1)"""
CITING = """citing AS (SELECT d.doc_id, lang AS repo, ['planning', 'diario', 'github', 'code', 'docs'][d.doc_id % 5 + 1] AS source,
    CASE WHEN d.doc_id % 3 = 0 THEN (d.doc_id % 900 + 100) || '-new' WHEN d.doc_id % 7 = 0 THEN 'plain-' || (d.doc_id % 50) END AS feature,
    CASE WHEN d.doc_id % 4 = 0 THEN 'feat/' || (d.doc_id * 7 % 900 + 100) || '-plain-' || (d.doc_id % 50) END AS branch,
    text || chr(10) || CASE d.doc_id % 6 WHEN 0 THEN '**Card:** #' || (d.doc_id * 7 % 900 + 100) WHEN 1 THEN 'It Fixes #' || (d.doc_id * 7 % 900 + 100) WHEN 2 THEN 'see #' || (d.doc_id * 7 % 900 + 100) || ' and #4567' ELSE 'none' END || chr(10) || 'in `' ||
    coalesce(CASE d.doc_id % 5 WHEN 0 THEN './' || array_to_string(string_split(path, '/')[-2:], '/') WHEN 1 THEN string_split(path, '/')[-1] || ':3-9' WHEN 2 THEN array_to_string(string_split(path, '/')[-3:], '/') WHEN 3 THEN '/' || array_to_string(string_split(path, '/')[-4:], '/') ELSE 'src/none.py' END, 'lost.ts') || '` and `not code`' AS text
    FROM documents d LEFT JOIN files ON p_partkey = d.doc_id + 1)"""
REFS = """refs AS (SELECT repo, number, min(kind) || repo || '#' || number AS key FROM (SELECT ['en', 'de', 'fr', 'es'][o_orderkey % 4 + 1] AS repo, (o_orderkey % 900 + 100)::INT AS number, CASE WHEN o_orderkey % 3 > 0 THEN 'card:' ELSE 'pr:' END AS kind FROM orders WHERE o_orderkey % 37 = 0) GROUP BY repo, number),
    alone AS (SELECT number, any_value(key) AS key FROM refs GROUP BY number HAVING count(*) = 1)"""
_CITED = r"""cited AS (SELECT DISTINCT doc_id, regexp_replace(c, '^\.?/', '') AS cited FROM (SELECT doc_id, regexp_replace(trim(unnest(regexp_extract_all(text, '`([^`\n]{3,120})`', 1))), ':\d+(-\d+)?$', '') AS c FROM citing)
    WHERE regexp_matches(c, '(?i)\.(ts|tsx|js|jsx|mjs|cjs|py|sql|prisma|zmodel|sh|ps1|yaml|yml|toml)$') AND NOT regexp_matches(c, '\s')),
    named AS (SELECT doc_id AS doc, cited, coalesce(s.path, n.path) AS target FROM cited LEFT JOIN suffixes s ON s.suffix = cited LEFT JOIN names n ON n.name = string_split(cited, '/')[-1] WHERE coalesce(s.path, n.path) IS NOT NULL)"""
_SAID = r"""said AS (SELECT doc_id AS doc, source, repo, coalesce(nullif(regexp_extract(text, '\*\*Card:\*\*\s*#(\d{1,5})', 1), ''), nullif(regexp_extract(text, '(?i)\b(?:closes|fixes|resolves)\s+#(\d{1,5})\b', 1), ''), nullif(regexp_extract(coalesce(branch, ''), '/(\d{3,5})-', 1), ''))::INT AS number FROM citing),
    numbered AS (SELECT doc, source, said.number, coalesce(r.key, a.key) AS target FROM said LEFT JOIN refs r ON r.repo = said.repo AND r.number = said.number LEFT JOIN alone a ON a.number = said.number WHERE coalesce(r.key, a.key) IS NOT NULL)"""
_KEY = "CASE source WHEN 'diario' THEN 'sessao:' WHEN 'github' THEN 'pr:' ELSE 'doc:' END || "
_HEADS = """h AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^[A-EÀ-É]') THEN '# ' || l WHEN regexp_matches(l, '^[F-S]') THEN '### ' || l ELSE l END) AS ls FROM documents)"""
SQL |= {
    "q28_unique_citations": f"WITH {FILES}, {CITING}, {_CITED} SELECT doc, cited, target FROM named",
    "q29_explicit_refs": f"WITH {FILES}, {CITING}, {REFS}, {_SAID} SELECT doc, number, target FROM numbered",
    "q39_invalid_runs": """SELECT event_id AS case_id, CASE WHEN event_type = 'error' THEN 'erro' WHEN event_id % 7 = 0 THEN 'sem-diagnostico' WHEN (props->>'$.k')::INT % 3 <> 1 THEN 'so-lexico' WHEN value < 2 THEN 'apodreceu' END AS invalid FROM events""",
    "q44_front_matter": """SELECT doc_id, CASE WHEN doc_id % 8 = 4 THEN 'repo' ELSE 'r' END AS repo, CASE doc_id % 8 WHEN 0 THEN 'docs' WHEN 1 THEN 'old' || doc_id WHEN 2 THEN 'plain' END AS feature,
        CASE doc_id % 8 WHEN 0 THEN 'spec' WHEN 1 THEN 'prd' WHEN 2 THEN 'task' WHEN 4 THEN 'card' WHEN 5 THEN 'code' WHEN 6 THEN 'memoria' ELSE 'doc' END AS doc_type,
        CASE WHEN doc_id % 8 = 4 THEN CASE WHEN doc_id % 3 = 0 THEN 'open' END WHEN doc_id % 8 IN (1, 3) THEN 'arquivado' WHEN doc_id % 8 IN (0, 2) THEN 'done' END AS status,
        CASE WHEN doc_id % 8 = 5 THEN 'x/y/' || doc_id || '.py' WHEN doc_id % 8 = 6 AND doc_id % 3 = 0 THEN 'N: ' || doc_id WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id
            ELSE CASE doc_id % 8 WHEN 1 THEN 'prd' ELSE doc_id::VARCHAR END END AS title,
        CASE WHEN doc_id % 3 = 0 THEN '2024-05-06' WHEN doc_id % 8 = 2 THEN '2024-03-04' ELSE '2024-01-02' END AS data FROM documents""",
    "q46_section": f"""WITH {_HEADS}, m AS (SELECT doc_id, ls, [CASE WHEN starts_with(l, '# ') THEN 1 WHEN starts_with(l, '### ') THEN 3 ELSE 0 END FOR l IN ls] AS lv, [contains(strip_accents(lower(l)), 'e') FOR l IN ls] AS hit FROM h),
        s AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: lv[i] > 0 AND hit[i])[1] AS a FROM m), e AS (SELECT *, list_filter(range(a + 1, len(ls) + 1), lambda i: lv[i] > 0 AND lv[i] <= lv[a])[1] AS b FROM s WHERE a IS NOT NULL),
        t AS (SELECT doc_id, left(array_to_string(ls[a:coalesce(b - 1, len(ls))], chr(10)), 60000) AS t FROM e) SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS chars FROM t""",
    "q48_code_passages": """WITH RECURSIVE d AS (SELECT doc_id, source || '.py' AS title, string_split(translate(replace(text, chr(10), chr(10) || chr(10)), ' ,', chr(10) || chr(10)), chr(10)) AS ls FROM documents),
        f AS (SELECT doc_id, 1 AS i, 1 AS start, len(ls[1]) + 1 AS size, 1 AS held, false AS ended FROM d
            UNION ALL SELECT f.doc_id, i + 1, CASE WHEN ends THEN i + 1 ELSE start END, CASE WHEN ends THEN 0 ELSE size END + len(d.ls[i + 1]) + 1, CASE WHEN ends THEN 0 ELSE held END + 1, ends FROM
                (SELECT f.*, (held >= 70 AND trim(ls[i]) = '') OR size >= 3500 OR held >= 130 AS ends FROM f JOIN d USING (doc_id)) f JOIN d USING (doc_id) WHERE i < len(ls)),
        e AS (SELECT f.*, ls, title, (held >= 70 AND trim(ls[i]) = '') OR size >= 3500 OR held >= 130 OR i = len(ls) AS ends FROM f JOIN d USING (doc_id)),
        b AS (SELECT doc_id, title, start, i, trim(array_to_string(ls[start:i], chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS block FROM e WHERE ends)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, title || ':' || start || '-' || i AS breadcrumb, md5(block) AS digest, ceil(len(block) / 4)::BIGINT AS token_est FROM b WHERE block <> ''""",
    "q52_commit_months": f"""WITH {_COMMITS}, l AS (SELECT *, data || ' s ' || array_to_string(fs[1:10], ', ') || CASE WHEN len(fs) > 10 THEN ' (+' || (len(fs) - 10) || ')' ELSE '' END AS line FROM c)
        SELECT repo, left(data, 7) AS month, count(*) AS commits, count(DISTINCT CASE WHEN k % 3 = 0 THEN k % 100 END) AS cards, (sum(length(line)) + count(*) - 1)::BIGINT AS chars FROM l GROUP BY ALL""",
    "q53_graph_build": rf"""WITH {FILES}, {CITING}, {REFS}, {_CITED}, {_SAID}, known AS (SELECT DISTINCT feature AS slug FROM citing WHERE feature IS NOT NULL),
        nums AS (SELECT DISTINCT doc_id, source, repo, unnest(regexp_extract_all(text, '#(\d{{3,5}})\b', 1))::INT AS number FROM citing),
        e AS (SELECT 1 AS seq, {_KEY} doc_id AS src, 'feature:' || feature AS dst, 'pertence' AS rel, 'planning' AS origin FROM citing WHERE feature IS NOT NULL AND source NOT IN ('code', 'github', 'diario')
            UNION ALL SELECT 2, {_KEY} doc, target, 'implementa', source FROM numbered WHERE source IN ('github', 'diario', 'planning')
            UNION ALL SELECT 3, {_KEY} doc_id, 'feature:' || slug, 'pertence', 'rotulo' FROM citing JOIN known ON slug = regexp_extract(coalesce(branch, ''), '/\d{{3,5}}-(.+)$', 1)
            UNION ALL SELECT 4, 'feature:' || slug, max(key), 'implementa', 'slug' FROM known JOIN refs ON number::VARCHAR = regexp_extract(slug, '^(\d{{3,5}})-', 1) WHERE starts_with(key, 'card:') GROUP BY slug
            UNION ALL SELECT 5, {_KEY} doc_id, coalesce(r.key, a.key), CASE source WHEN 'diario' THEN 'registra' ELSE 'referencia' END, 'rotulo' FROM nums n LEFT JOIN refs r ON r.repo = n.repo AND r.number = n.number LEFT JOIN alone a ON a.number = n.number WHERE coalesce(r.key, a.key) IS NOT NULL
            UNION ALL SELECT 6, {_KEY} doc_id, 'arquivo:' || target, 'toca', 'rotulo' FROM named JOIN citing ON doc_id = doc)
        SELECT src, dst, rel, first(origin ORDER BY seq) AS origin FROM e WHERE src <> dst GROUP BY src, dst, rel""",
    "q55_superseded_decisions": "SELECT o.o_orderkey AS id, max(s.o_orderkey) AS superseded_by FROM orders o LEFT JOIN orders s ON s.o_orderkey % 3 = 0 AND s.o_orderkey // 2 = o.o_orderkey GROUP BY o.o_orderkey",
    "q57_paths_under_roots": """WITH r AS (SELECT DISTINCT rtrim(lower(array_to_string(string_split(url, '/')[1:CASE WHEN page_id % 20 = 3 THEN 3 ELSE 4 END], '/')), '/') AS root FROM pages WHERE page_id % 10 = 3)
        SELECT url AS path FROM pages WHERE EXISTS (FROM r WHERE lower(url) = root OR starts_with(lower(url), root || '/'))""",
    "q112_decision_edges": f"""WITH {FILES}, {CITING}, {REFS}, d AS (SELECT o_orderkey AS id, ['en', 'de', 'fr', 'es'][o_orderkey % 4 + 1] AS repo, CASE o_orderkey % 4 WHEN 0 THEN '#' || (o_orderkey % 900 + 100) WHEN 1 THEN 'plain-' || (o_orderkey % 60) WHEN 2 THEN 'f' || (o_orderkey % 1500) || '.ts' END AS scope FROM orders WHERE o_orderkey % 5 <> 0),
        t AS (SELECT id, coalesce(r.key, a.key) AS dst FROM d LEFT JOIN refs r ON '#' || r.number = scope AND r.repo = d.repo LEFT JOIN alone a ON '#' || a.number = scope WHERE starts_with(scope, '#')
            UNION ALL SELECT id, 'feature:' || scope FROM d WHERE scope IN (SELECT feature FROM citing) UNION ALL SELECT id, 'arquivo:' || path FROM d JOIN names ON name = scope)
        SELECT 'decisao:' || id AS src, dst, 'decide' AS rel, 'lembrar' AS origin FROM t WHERE dst IS NOT NULL""",
    "q113_commit_edges": f"""WITH {FILES}, {REFS}, c AS (SELECT o_orderkey AS id, ['en', 'de', 'fr', 'es'][o_orderkey % 4 + 1] AS repo, o_orderkey % 900 + 100 AS number, 'f' || (o_orderkey % 1500) || '.ts' AS file FROM orders),
        t AS (SELECT id, file, coalesce(r.key, a.key) AS dst FROM c LEFT JOIN refs r ON r.number = c.number AND r.repo = c.repo LEFT JOIN alone a ON a.number = c.number WHERE coalesce(r.key, a.key) IS NOT NULL)
        SELECT 'commit:' || id AS src, dst, CASE WHEN starts_with(dst, 'card:') THEN 'implementa' ELSE 'pertence' END AS rel, 'git' AS origin FROM t
        UNION ALL SELECT 'commit:' || id, 'arquivo:' || path, 'toca', 'git' FROM t JOIN names ON name = file""",
}

_DECIDED = """x AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS data, o_orderstatus AS kind, CASE o_orderkey % 4 WHEN 0 THEN '#' || (o_orderkey % 900 + 100) WHEN 1 THEN 'plain-' || (o_orderkey % 60) WHEN 2 THEN 'f' || (o_orderkey % 1500) || '.ts' END AS scope,
    'Order ' || o_orderkey || ' Ação é final.' AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS why, CASE WHEN o_orderkey % 5 = 0 THEN 'none' END AS alternatives, CASE WHEN o_orderkey % 6 = 0 THEN 'a · ' || o_orderkey END AS refs, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 2 END AS supersedes FROM orders)"""
SQL |= {
    "q114_recorded_decisions": f"""WITH {FILES}, {CITING}, {REFS}, {_DECIDED}, s AS (SELECT supersedes AS id, max(id) AS superseded_by FROM x WHERE supersedes IS NOT NULL GROUP BY supersedes),
        r AS (SELECT o_orderkey AS id, ['en', 'de', 'fr', 'es'][o_orderkey % 4 + 1] AS repo FROM orders),
        t AS (SELECT x.id, coalesce(f.key, a.key) AS dst FROM x JOIN r USING (id) LEFT JOIN refs f ON '#' || f.number = scope AND f.repo = r.repo LEFT JOIN alone a ON '#' || a.number = scope WHERE starts_with(scope, '#')
            UNION ALL SELECT id, 'feature:' || scope FROM x WHERE scope IN (SELECT feature FROM citing) UNION ALL SELECT id, 'arquivo:' || path FROM x JOIN names ON name = scope),
        e AS (SELECT id, count(*) AS edges FROM t LEFT JOIN s USING (id) WHERE dst IS NOT NULL AND superseded_by IS NULL GROUP BY id), filled AS (SELECT id FROM x WHERE id % 2 = 1 ORDER BY id LIMIT 200)
        SELECT x.id, 'decisoes/' || data || '-order-' || x.id || '-acao-e-final-and-more-' || x.id || '.md' AS doc_path, title, superseded_by, CASE WHEN x.id % 2 = 0 OR x.id IN (FROM filled) THEN 384::BIGINT END AS dims, coalesce(edges, 0) AS edges,
        md5('---' || chr(10) || 'data: ' || data || chr(10) || 'tipo: ' || kind || chr(10) || coalesce('escopo: ' || scope || chr(10), '') || coalesce('substitui: ' || supersedes || chr(10), '') || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || title || ' And more.' || chr(10)
            || coalesce(chr(10) || '**Por quê:** ' || why || chr(10), '') || coalesce(chr(10) || '**Descartado:** ' || alternatives || chr(10), '') || coalesce(chr(10) || '**Refs:** ' || refs || chr(10), '')) AS text
        FROM x LEFT JOIN s USING (id) LEFT JOIN e USING (id)""",
    "q115_search_diagnostics": f"""WITH {bm25(BENCH)}, lex AS ({top('scored', 60)}), v AS (SELECT b.vec_id AS query_id, a.vec_id AS id, {DOT} AS score FROM embeddings a JOIN embeddings b ON b.vec_id % 2 = 0 AND b.vec_id IN (SELECT item_id FROM benchmark)), vec AS ({top('v', 60)}),
        hits AS (SELECT query_id, id FROM lex UNION SELECT query_id, id FROM vec), f AS (SELECT query_id, count(*) - count(DISTINCT {KEY}) AS collapsed FROM hits JOIN documents ON doc_id = id GROUP BY query_id),
        l AS (SELECT query_id, count(*) AS lexical FROM lex GROUP BY 1), w AS (SELECT query_id, count(*) AS vector FROM vec GROUP BY 1)
        SELECT query_id, coalesce(lexical, 0) AS lexical, coalesce(vector, 0) AS vector, coalesce(vector, 0) > 0 AS semantic, coalesce(collapsed, 0) AS collapsed FROM l FULL JOIN w USING (query_id) LEFT JOIN f USING (query_id)""",
    "q116_vectors_filtered_like_texts": f"""SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS id, {DOT} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND source <> 'src3')) QUALIFY rank <= 20""",
    "q117_harvest_counts": f"""WITH h AS ({SQL['q34_harvest']}), {PAIRS} SELECT (SELECT count(*) FROM pairs) AS raw, (SELECT count(*) FROM pairs WHERE read_id IS NULL) AS unread, count(*) FILTER (fate = 'missing') AS missing,
        count(*) FILTER (fate = 'incoherent') AS incoherent, count(*) FILTER (fate = 'repeated') AS repeated, count(*) FILTER (fate = 'kept') AS kept FROM h""",
    "q118_cases_and_their_targets": """WITH c AS (SELECT item_id, item_id % 20 = 3 AS no, item_id % 40 = 3 AS volatile FROM benchmark),
        f AS (SELECT item_id, d.* FROM c JOIN documents d ON NOT no AND contains('x/doc/' || doc_id, 'doc/' || item_id) AND (item_id % 3 <> 0 OR lang = 'en')),
        n AS (SELECT count(*) AS n, count(*) FILTER (no) AS k, count(*) FILTER (no AND NOT volatile) AS firm, count(*) FILTER (no AND volatile) AS loose FROM c)
        SELECT unnest(list_filter([CASE WHEN n < 100 THEN 'fewer than 100 cases' END, CASE WHEN (SELECT count(*) FROM f WHERE source = 'src1') = 0 THEN 'no code target' END, CASE WHEN (SELECT count(*) FROM f WHERE lang = 'de') = 0 THEN 'no target in de' END,
            CASE WHEN k < 2 THEN 'fewer than two negatives' END, CASE WHEN k >= 2 AND firm = 0 THEN 'no structural negative' END, CASE WHEN k >= 2 AND loose = 0 THEN 'no volatile negative' END], lambda x: x IS NOT NULL)) AS fault, NULL::BIGINT AS case_id FROM n
        UNION ALL SELECT 'no target satisfies the case', item_id FROM c WHERE NOT no AND item_id NOT IN (SELECT item_id FROM f)""",
}

_TURN = "'conversation:' || lpad(conv_id::VARCHAR, 19, '0') || ':' || lpad(turn::VARCHAR, 19, '0')"
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL |= {
    "q09_snippets": f"""WITH w AS (SELECT doc_id, string_split_regex(trim(text), '\\s+') AS ws FROM documents), h AS (SELECT doc_id, ws, [len(list_intersect(regexp_extract_all(strip_accents(lower(x)), '[\\p{{L}}\\p{{N}}]+'), {_list(WORDS[0])})) > 0 FOR x IN ws] AS hs FROM w),
        s AS (SELECT doc_id, ws, hs, unnest(list_filter(range(1, len(ws) + 1), lambda i: hs[i])) AS a FROM h),
        b AS (SELECT doc_id, ws, hs, a FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(list_filter(hs[a:a + 39], lambda x: x)) DESC, a) = 1)
        SELECT doc_id, CASE WHEN a > 1 THEN '… ' ELSE '' END || array_to_string([CASE WHEN hs[i] THEN '«' || ws[i] || '»' ELSE ws[i] END FOR i IN range(a, least(a + 40, len(ws) + 1))], ' ') || CASE WHEN a + 39 < len(ws) THEN ' …' ELSE '' END AS snippet FROM b""",
    "q13_hashing_encoder": f"SELECT doc_id, 384::BIGINT AS dims, CASE WHEN len({TERMS}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents",
    "q22_greedy_collapse": f"""WITH RECURSIVE {bm25(BENCH, 'a', docs=f"SELECT {_TURN} AS id, text FROM conversations")}, {bm25(BENCH, 'b', docs="SELECT 'document:' || lpad(doc_id::VARCHAR, 19, '0') AS id, text FROM documents")},
        v AS (SELECT b.vec_id AS query_id, a.vec_id AS vec, {DOT} AS score FROM embeddings a JOIN embeddings b ON b.vec_id IN (SELECT item_id FROM benchmark)),
        vec AS (SELECT query_id, 'document:' || lpad(vec::VARCHAR, 19, '0') AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec) AS rank FROM v QUALIFY rank <= 60),
        lists AS (SELECT query_id, id, rank FROM ({top('a', 60)}) UNION ALL SELECT query_id, id, rank FROM ({top('b', 60)}) UNION ALL SELECT query_id, id, rank FROM vec),
        f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf FROM lists GROUP BY query_id, id),
        t AS (SELECT {_TURN} AS id, 'conversation:' || conv_id AS doc, role AS label, text FROM conversations UNION ALL SELECT 'document:' || lpad(doc_id::VARCHAR, 19, '0'), 'document:' || doc_id, source, text FROM documents),
        p AS (SELECT query_id, id, doc, label, {KEY} AS key, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS position FROM f JOIN t USING (id)),
        g AS (SELECT query_id, position, id, doc, key, true AS kept, 1 AS nth, [key] AS seen, [doc] AS docs FROM p WHERE position = 1
            UNION ALL SELECT p.query_id, p.position, p.id, p.doc, p.key, NOT list_contains(seen, p.key) AND len(list_filter(docs, lambda d: d = p.doc)) < 2, len(list_filter(docs, lambda d: d = p.doc)) + 1,
                CASE WHEN NOT list_contains(seen, p.key) AND len(list_filter(docs, lambda d: d = p.doc)) < 2 THEN list_append(seen, p.key) ELSE seen END, CASE WHEN NOT list_contains(seen, p.key) AND len(list_filter(docs, lambda d: d = p.doc)) < 2 THEN list_append(docs, p.doc) ELSE docs END
            FROM g JOIN p ON p.query_id = g.query_id AND p.position = g.position + 1),
        l AS (SELECT k.query_id, k.id, p.label, min(p.position) AS since, count(*) AS n FROM g k JOIN p ON p.query_id = k.query_id AND p.key = k.key AND p.position > k.position WHERE k.kept GROUP BY ALL),
        m AS (SELECT query_id, id, sum(n) AS collapsed, string_agg(label, ',' ORDER BY since) AS also_in FROM l GROUP BY query_id, id)
        SELECT g.query_id, g.id, g.doc, coalesce(also_in, '') AS also_in, coalesce(collapsed, 0)::BIGINT AS collapsed, row_number() OVER (PARTITION BY g.query_id ORDER BY least(nth, 2), position) AS place
        FROM g LEFT JOIN m ON m.query_id = g.query_id AND m.id = g.id WHERE kept QUALIFY place <= 30""",
    "q47_markdown_passages": f"""WITH RECURSIVE d AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10)) AS ls FROM documents),
        x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d), y AS (SELECT *, length(regexp_extract(line, '^(#{{1,3}})\\s+.', 1)) AS level, trim(regexp_extract(line, '^#{{1,3}}\\s+(.+)', 1), {_STRIP}) AS name FROM x),
        z AS (SELECT *, max(CASE WHEN level > 0 THEN i ELSE 0 END) OVER w AS head, max(CASE WHEN level = 1 THEN i ELSE 0 END) OVER w AS p1, max(CASE WHEN level = 2 THEN i ELSE 0 END) OVER w AS p2, max(CASE WHEN level = 3 THEN i ELSE 0 END) OVER w AS p3 FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        s AS (SELECT doc_id, head, any_value(p1) AS p1, any_value(p2) AS p2, any_value(p3) AS p3, trim(string_agg(line, chr(10) ORDER BY i), {_STRIP}) AS whole FROM z GROUP BY doc_id, head),
        c AS (SELECT s.doc_id, head, whole, list_filter([a.name, CASE WHEN p2 > p1 THEN b.name END, CASE WHEN p3 > p1 AND p3 > p2 THEN e.name END], lambda n: n IS NOT NULL AND n <> '' AND n <> 't') AS crumbs FROM s
            LEFT JOIN y a ON a.doc_id = s.doc_id AND a.i = p1 LEFT JOIN y b ON b.doc_id = s.doc_id AND b.i = p2 LEFT JOIN y e ON e.doc_id = s.doc_id AND e.i = p3 WHERE whole <> ''),
        ps AS (SELECT doc_id, head, string_split_regex(whole, '\\n{{2,}}') AS paras FROM c WHERE length(whole) > 4800),
        r AS (SELECT doc_id, head, 1 AS i, 1 AS piece, length(paras[1]) AS room FROM ps
            UNION ALL SELECT r.doc_id, r.head, i + 1, CASE WHEN room + length(paras[i + 1]) + 2 <= 3200 THEN piece ELSE piece + 1 END, CASE WHEN room + length(paras[i + 1]) + 2 <= 3200 THEN room + length(paras[i + 1]) + 2 ELSE length(paras[i + 1]) END FROM r JOIN ps USING (doc_id, head) WHERE i < len(paras)),
        pieces AS (SELECT doc_id, head, piece, string_agg(paras[i], chr(10) || chr(10) ORDER BY i) AS text FROM r JOIN ps USING (doc_id, head) GROUP BY doc_id, head, piece UNION ALL SELECT doc_id, head, 1, whole FROM c WHERE length(whole) <= 4800),
        q AS (SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.head, piece) AS k, p.text, array_to_string(list_prepend('t', crumbs), ' > ') || CASE WHEN piece > 1 THEN ' (cont. ' || piece || ')' ELSE '' END AS crumb FROM pieces p JOIN c ON c.doc_id = p.doc_id AND c.head = p.head),
        n AS (SELECT doc_id, k, 0 AS ord, length(text) AS size FROM q WHERE k = 1
            UNION ALL SELECT n.doc_id, q.k, CASE WHEN size + length(q.text) + 2 <= 2200 THEN ord ELSE ord + 1 END, CASE WHEN size + length(q.text) + 2 <= 2200 THEN size + length(q.text) + 2 ELSE length(q.text) END FROM n JOIN q ON q.doc_id = n.doc_id AND q.k = n.k + 1),
        o AS (SELECT n.doc_id, ord, first(crumb ORDER BY q.k) AS breadcrumb, string_agg(text, chr(10) || chr(10) ORDER BY q.k) AS t FROM n JOIN q ON q.doc_id = n.doc_id AND q.k = n.k GROUP BY n.doc_id, ord)
        SELECT doc_id, ord::BIGINT AS ord, breadcrumb, md5(t) AS digest, ceil(length(t) / 4)::BIGINT AS token_est FROM o""",
}

SQL |= {
    "q119_lookups": """WITH e AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'feature:' || c_custkey || '-new' ELSE 'card:r#' || c_custkey END AS key, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS file, c_name AS title FROM customer),
        a AS (SELECT s_suppkey AS request, CASE s_suppkey % 3 WHEN 0 THEN 'card ' || (s_suppkey * 7) WHEN 1 THEN ' R#' || (s_suppkey % 90) ELSE 'mer#0000000' || (s_suppkey % 100) END AS text FROM supplier),
        n AS (SELECT request, text, nullif(regexp_extract(text, '[0-9]{3,5}'), '') AS number FROM a), x AS (SELECT request, key, file FROM n JOIN e ON key LIKE '%#' || number OR key LIKE 'feature:' || number || '-%'),
        y AS (SELECT * FROM x UNION SELECT request, key, file FROM n JOIN e ON contains(lower(key), lower(trim(text))) OR contains(lower(title), lower(trim(text))) WHERE request NOT IN (SELECT request FROM x))
        SELECT request, key, row_number() OVER (PARTITION BY request ORDER BY file DESC, key) AS place FROM y QUALIFY place <= 10""",
}

SQL |= {
    "q120_active_features": f"WITH {ORDERS} SELECT feature, repo, string_agg(DISTINCT doc_type, ',' ORDER BY doc_type) AS kinds, count(*) AS n_docs, max(data) AS last_date FROM o GROUP BY ALL HAVING count(*) FILTER (status = 'arquivado') = 0",
    "q121_entity_counts": "SELECT kind, count(*) AS n FROM (SELECT c_mktsegment AS kind FROM customer UNION ALL SELECT p_brand FROM part) GROUP BY kind",
    "q122_item_notes": """WITH c AS (SELECT conv_id, string_agg('### ' || role || ' — ' || lpad((1000 - turn)::VARCHAR, 9, '0') || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn DESC) AS talk FROM conversations WHERE turn > 0 GROUP BY conv_id)
        SELECT t.conv_id AS number, md5('# ' || role || chr(10) || chr(10) || 'estado: OPEN' || chr(10) || chr(10) || CASE WHEN t.conv_id % 3 > 0 THEN text ELSE '' END || chr(10) || chr(10) || coalesce(talk, '')) AS digest FROM conversations t LEFT JOIN c USING (conv_id) WHERE turn = 0""",
    "q123_empty_answers": """WITH a AS (SELECT source, doc_id % 6 AS i, (['Nenhum resultado para ', 'Query vazia', 'Nenhuma ', 'Nada no grafo ', ' Nenhuma ', ''])[doc_id % 6 + 1] || text AS answer FROM documents)
        SELECT source, count(*) FILTER (regexp_matches(answer, '^(Nenhum resultado|Query vazia|Nenhuma)')) AS empty, sum(ceil(length(answer) / 4))::BIGINT AS tokens FROM a GROUP BY source""",
    "q124_rewritten_blocks": """SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN text || chr(10) || '<!-- auto:begin -->' || chr(10) || 'new ' || lang || chr(10) || '<!-- auto:end -->' || chr(10) || 'tail'
        ELSE text || CASE doc_id % 3 WHEN 1 THEN chr(10) || '<!-- auto:begin --> open' ELSE '' END || chr(10) || '<!-- auto:begin -->' || chr(10) || 'new ' || lang || chr(10) || '<!-- auto:end -->' END) AS digest FROM documents""",
}
