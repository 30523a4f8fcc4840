"""DuckDB SQL for the queries of catalogue.py that SQL can express."""

from __future__ import annotations

from quillet.functions.entities import PATTERNS
from quillet.functions.text import KEYWORD_STOPWORDS, STOPWORDS

TOKEN = r"[\x{4e00}-\x{9fff}]{2,}|[a-zA-Z]{3,}|[\p{Nd},.]+[万亿千百%]?"
PHRASE = "licensed under the apache license version 2.0 released public mit"


def listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{TOKEN}'), lambda x: NOT list_contains({listed(STOPWORDS)}, x))"


MEMORIES = """memories AS (
    SELECT 'mem_' || doc_id AS id, doc_id AS ord, text, source,
        [['temporary'], ['dynamic'], ['static'], ['preference', 'temporary'], []::VARCHAR[]][doc_id % 5 + 1] AS tags,
        [30, 180, 365, 30, 180][doc_id % 5 + 1] AS ttl,
        TIMESTAMP '2024-01-01' + to_days((doc_id % 400)::INTEGER) AS created_at,
        CASE WHEN doc_id % 7 <> 0 THEN ttl END AS ttl_days,
        CASE WHEN doc_id % 3 <> 0 THEN created_at + to_days(ttl) END AS expire_at,
        CASE WHEN expire_at IS NOT NULL THEN TIMESTAMP '2025-01-15' > expire_at ELSE date_diff('day', created_at, TIMESTAMP '2025-01-15') > coalesce(ttl_days, ttl) END AS due
    FROM documents)"""
MESSAGES = """messages AS (
    SELECT event_id AS id, user_id AS box, ts, 24 + (props->>'$.k')::INTEGER AS ttl_hours,
        CASE WHEN event_type IN ('view', 'click') THEN 'unread' WHEN event_type IN ('signup', 'purchase') THEN 'read' ELSE 'acked' END AS status,
        epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) <= ttl_hours * 3600000000 AS live
    FROM events)"""
VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
PAIRS = f"{VECTORS}, p AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.e, b.e) AS sim FROM v a JOIN v b ON a.id < b.id)"
EDGES = f"{PAIRS}, g AS (SELECT a AS src, b AS dst, round(sim, 3) AS weight FROM p WHERE sim >= 0.4 UNION ALL SELECT b, a, round(sim, 3) FROM p WHERE sim >= 0.4)"
QUERY = f"{VECTORS}, s AS (SELECT v.id, v.label, list_inner_product(v.e, q.e) AS sim FROM v, (SELECT e FROM v WHERE id = 0) q)"
DEGREE = f"{EDGES}, d AS (SELECT src AS id, count(*) AS degree FROM g GROUP BY 1)"
REACH = f"{DEGREE}, r(id, other) AS (SELECT src, src FROM g UNION SELECT r.id, g.dst FROM r JOIN g ON g.src = r.other), root AS (SELECT id, min(other) AS root FROM r GROUP BY 1), c AS (SELECT id, 'cluster_' || (dense_rank() OVER (ORDER BY root) - 1) AS cluster FROM root)"
HUBS = "h AS (SELECT id, degree FROM d WHERE degree >= 3 ORDER BY degree DESC, id LIMIT 30)"
TOKENS = f"t AS (SELECT doc_id AS id, {tokens('text')} AS w FROM documents)"


def bm25(queries: str, k: int) -> str:
    return f"""{TOKENS}, q0 AS ({queries}), q AS (SELECT qid, token, count(*) AS times FROM (SELECT qid, unnest({tokens('query')}) AS token FROM q0) GROUP BY ALL),
        tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(w) AS token FROM t) GROUP BY ALL),
        df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n, sum(len(w)) / greatest(count(*), 1) AS avgdl FROM t),
        sc AS (SELECT qid, id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / greatest(avgdl, 1.0)))), 4) AS score
            FROM q JOIN tf USING (token) JOIN df USING (token) JOIN t USING (id), n GROUP BY qid, id),
        bm AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM sc WHERE score > 0 QUALIFY rank < {k})"""


TRIVIAL = r"'^(?:嗯|好|ok|继续|go\s*on|next|yes|no|对|行|可以|明白|了解|收到)$|^[!！?？。.]{1,3}$'"


def cleaned(text: str) -> str:
    inner = f"coalesce({text}, '')"
    for b in ("memory-context", "session-context"):
        inner = f"regexp_replace({inner}, '<{b}>.*?</{b}>', '', 'gs')"
    return rf"regexp_replace(regexp_replace({inner}, '^[\s\x0B\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{3000}}]+', ''), '[\s\x0B\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{3000}}]+$', '')"


STRIPPED = cleaned("text")
W = r"[\p{L}\p{N}_]"
NOISE = [rf"^/[\p{{L}}\p{{N}}_/]+\.{W}+$", r"^[a-f0-9]{7,40}$", r"(?:fixed?|resolved?|completed?|done)\s+(?:bug|issue|error)", r"^commit\s+[a-f0-9]", r"temporary|temp fix|workaround"]
CODE = [rf"(?:class|def|function|import|from)\s+{W}+", r"(?:\.py|\.js|\.ts|\.yaml|\.json|\.toml)\b.*(?:modified|updated|changed)", r"(?:error|traceback|exception):.*(?:line|file|module)", r'File\s+"[^"]+",\s+line\s+\d+']
TASK = [r"^(?:Phase|Step|阶段)\s*\d+\s*(?:完成|done|completed)", r"已(?:完成|修复|解决|处理)\s*[：:]", r"^\d+\s*(?:个|条)\s*(?:文件|commit|PR)"]
CHAT = [r"^(?:今天|昨晚|中午|早上)(?:吃了|喝了|看了|玩了).{2,10}$", r"^(?:好开心|好难过|好累|好困|好饿|哈哈|呵呵|嘻嘻)", r"^(?:天气|心情|感觉)(?:真|好|很|太).{1,6}$", r"^(?:我|他|她)(?:今天|昨天|刚才)(?:吃了|喝了|看了)"]


def matches(text: str, patterns: list[str]) -> str:
    return f"regexp_matches({text}, '" + "|".join(f"(?:{p})" for p in patterns) + "')"


LAYER = f"""(SELECT doc_id, CASE WHEN length(t) < 10 THEN 'length' WHEN {matches('lower(t)', NOISE)} THEN 'noise' WHEN {matches('t', CODE)} THEN 'code'
    WHEN {matches('t', TASK)} THEN 'task' WHEN {matches('t', CHAT)} THEN 'chat' END AS layer
    FROM (SELECT doc_id, {STRIPPED.replace("regexp_replace(regexp_replace(coalesce(text, ''), '<memory-context>.*?</memory-context>', '', 'gs'), '<session-context>.*?</session-context>', '', 'gs')", "coalesce(text, '')")} AS t FROM documents))"""
KEYWORDS = f"list_filter(regexp_extract_all(text, '{TOKEN}'), lambda x: NOT list_contains({listed(KEYWORD_STOPWORDS)}, x))"
KEYS = f"""k0 AS (SELECT doc_id AS id, list_transform({KEYWORDS}, lambda x: lower(x)) AS w FROM documents),
    k AS (SELECT id, list_filter(w, lambda x, i: list_position(w, x) = i)[:25] AS k FROM k0)"""
FACTS = " UNION ALL ".join(
    f"SELECT doc_id AS id, source, '{a}' AS attr, unnest(regexp_extract_all(text, '{p}', 1))::DOUBLE AS value, unnest(regexp_extract_all(text, '{p}', 0)) AS raw FROM documents"
    for a, p in {"version": r"version (\d+\.?\d*)", "ratio": r"(\d+\.\d+)", "number": r"\b(\d{2,4})\b"}.items()
)
TURNS = "n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)), tp AS (SELECT conv_id, turn, text AS user_text, next_text AS assistant_text FROM n WHERE role = 'user' AND next_role = 'assistant')"
FMT = "'%Y-%m-%d %H:%M:%S'"

FOUND = " UNION ALL ".join(f"SELECT doc_id AS id, '{label}' AS label, unnest(list_distinct(regexp_extract_all(text, '{p}'))) AS found FROM documents" for label, p in PATTERNS.items())
DROPS = f"""f AS ({FACTS}), cf AS (SELECT source, attr, arg_max(id, (id % 400) * 10000000000 - id) AS keep FROM f GROUP BY ALL HAVING count(DISTINCT value) > 1),
    dr AS (SELECT DISTINCT f.id FROM f JOIN cf ON f.source IS NOT DISTINCT FROM cf.source AND f.attr = cf.attr WHERE f.id <> keep)"""
REVIEW = """rv AS (SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN least(length(a.text), length(b.text)) / greatest(length(a.text), length(b.text), 1) > 0.85 THEN CASE WHEN length(a.text) < length(b.text) THEN a.doc_id ELSE b.doc_id END END AS gone FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 10 = 0)"""
NEAR_DOCS = QUERY.replace("FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))", 1)

SQL = {
    "vector_topk": f"WITH {QUERY} SELECT id, round(sim, 4) AS similarity FROM (SELECT * FROM s ORDER BY round(sim, 6) DESC, id LIMIT 5) WHERE sim >= 0.3",
    "vector_topk_filtered": f"WITH {QUERY} SELECT id, round(sim, 4) AS similarity FROM (SELECT * FROM s WHERE label = 3 ORDER BY round(sim, 6) DESC, id LIMIT 10) WHERE sim >= 0.1",
    "vector_threshold": f"WITH {PAIRS} SELECT a, b, round(sim, 4) AS similarity FROM p WHERE sim >= 0.3",
    "knn_batch": f"WITH {VECTORS} SELECT q.id AS query_id, c.id AS id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(q.e, c.e), 6) DESC, c.id) - 1 AS rank, round(list_inner_product(q.e, c.e), 4) AS similarity FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0 QUALIFY rank < 5 AND list_inner_product(q.e, c.e) >= 0",
    "rerank_two_stage": f"WITH {QUERY} SELECT id, round(sim, 4) AS similarity FROM s WHERE sim >= 0.2 ORDER BY round(sim, 6) DESC, id LIMIT 3",
    "search_all": f"WITH {QUERY}, r AS (SELECT id, sim, CASE WHEN id % 2 = 0 THEN 'active' ELSE 'archived' END AS state, row_number() OVER (PARTITION BY id % 2 ORDER BY round(sim, 6) DESC, id) AS rn FROM s) SELECT id, round(sim, 4) AS similarity, state FROM r WHERE rn <= 5 AND sim >= 0.2",
    "quality_gate": f"SELECT 'mem_' || doc_id AS id, layer, layer IS NULL AS accepted FROM {LAYER}",
    "quality_gate_counts": f"SELECT coalesce(layer, 'accepted') AS layer, count(*) AS n FROM {LAYER} GROUP BY 1",
    "tokenize_counts": f"WITH {TOKENS} SELECT id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM t",
    "doc_freq": f"WITH {TOKENS} SELECT token, count(DISTINCT id) AS df FROM (SELECT id, unnest(w) AS token FROM t) GROUP BY 1",
    "term_freq": f"WITH {TOKENS} SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(w) AS token FROM t) GROUP BY ALL",
    "bm25_topk": f"WITH {bm25(f'''SELECT 0 AS qid, '{PHRASE}' AS query''', 10)} SELECT id, score, rank FROM bm",
    "bm25_batch": f"WITH {bm25('SELECT item_id AS qid, text AS query FROM benchmark', 3)} SELECT qid, id, score, rank FROM bm",
    "hybrid_rrf": f"""WITH {QUERY.replace('FROM embeddings)', 'FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))', 1)}, {bm25(f"SELECT 0 AS qid, '{PHRASE}' AS query", 10)},
        near0 AS (SELECT id, round(sim, 4) AS sim4 FROM (SELECT * FROM s ORDER BY round(sim, 6) DESC, id LIMIT 10) WHERE sim >= 0.2),
        near AS (SELECT id, row_number() OVER (ORDER BY sim4 DESC, id) - 1 AS rank FROM near0)
        SELECT id, round(coalesce(0.6 / (61 + a.rank), 0) + coalesce(0.4 / (61 + b.rank), 0), 4) AS score, a.rank AS vector_rank, b.rank AS bm25_rank
        FROM near a FULL JOIN bm b USING (id)
        ORDER BY round(coalesce(0.6 / (61 + a.rank), 0) + coalesce(0.4 / (61 + b.rank), 0), 12) DESC, a.rank NULLS LAST, b.rank, id LIMIT 5""",
    "sim_edges": f"WITH {EDGES} SELECT src, dst, weight FROM g",
    "degree": f"WITH {DEGREE} SELECT id, degree FROM d",
    "hubs": f"WITH {DEGREE}, {HUBS} SELECT id, degree FROM h",
    "graph_stats": f"WITH {DEGREE}, a AS (SELECT v.id, coalesce(degree, 0) AS degree FROM v LEFT JOIN d USING (id)) SELECT count(*) AS nodes, sum(degree) // 2 AS edges, count(*) FILTER (degree = 0) AS isolated, least(count(*) FILTER (degree >= 3), 30) AS hubs, round(sum(degree) / count(*), 1) AS avg_degree FROM a",
    "components": f"WITH RECURSIVE {REACH} SELECT id, cluster FROM c",
    "node_table": f"WITH RECURSIVE {REACH} SELECT v.id, label::VARCHAR AS tags, coalesce(degree, 0) AS degree, coalesce(cluster, '') AS cluster FROM v LEFT JOIN d USING (id) LEFT JOIN c USING (id)",
    "cluster_summary": f"""WITH RECURSIVE {REACH}, {HUBS},
        tg AS (SELECT cluster, string_agg(label || '=' || n, ',' ORDER BY label::VARCHAR) AS tags FROM (SELECT cluster, label, count(*) AS n FROM c JOIN v USING (id) GROUP BY ALL) GROUP BY 1),
        th AS (SELECT cluster, string_agg(id, ',' ORDER BY degree DESC, id) AS top_hubs FROM (SELECT cluster, id, degree FROM c JOIN h USING (id) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY degree DESC, id) <= 5) GROUP BY 1)
        SELECT cluster, count(*) AS size, coalesce(any_value(top_hubs), '') AS top_hubs, any_value(tags) AS tags FROM c LEFT JOIN tg USING (cluster) LEFT JOIN th USING (cluster) GROUP BY 1""",
    "neighbors_1hop": f"WITH {EDGES} SELECT src AS start, dst AS id, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) - 1 AS rank FROM g WHERE src % 20 = 0 QUALIFY rank < 10",
    "neighbors_2hop": f"""WITH {EDGES}, h1 AS (SELECT src AS start, dst AS id, weight, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos, 1 AS hop FROM g WHERE src % 20 = 0),
        h2 AS (SELECT h1.start, g.dst AS id, h1.weight * g.weight AS weight, h1.pos AS parent FROM h1 JOIN g ON g.src = h1.id WHERE g.dst <> h1.start AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.start = h1.start AND x.id = g.dst)
            QUALIFY row_number() OVER (PARTITION BY h1.start, g.dst ORDER BY h1.pos) = 1),
        u AS (SELECT start, id, weight, pos, hop FROM h1 UNION ALL SELECT start, id, weight, row_number() OVER (PARTITION BY start ORDER BY parent, id), 2 FROM h2)
        SELECT start, id, round(weight, 9) AS weight, row_number() OVER (PARTITION BY start ORDER BY weight DESC, hop, pos) - 1 AS rank FROM u QUALIFY rank < 10""",
    "keyword_jaccard": f"WITH {KEYS} SELECT a.id, len(a.k) AS n_keywords, round(len(list_intersect(a.k, b.k)) / greatest(len(list_distinct(list_concat(a.k, b.k))), 1), 4) AS shared FROM k a JOIN k b ON b.id = a.id + 1",
    "dedup_tiers_static": f"""WITH {KEYS}, {VECTORS}, x AS (SELECT v.id, e, k FROM v JOIN k USING (id)),
        b AS (SELECT a.id, b.id AS best_id, list_inner_product(a.e, b.e) AS sim, len(list_intersect(a.k, b.k)) / greatest(len(list_distinct(list_concat(a.k, b.k))), 1) AS shared
            FROM x a JOIN x b ON a.id <> b.id WHERE a.id % 20 = 0 AND list_inner_product(a.e, b.e) >= 0.1 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.e, b.e), 6) DESC, b.id) = 1)
        SELECT x.id, best_id, round(sim, 4) AS similarity, round(shared, 4) AS shared, CASE WHEN best_id IS NULL OR shared < 0.02 THEN 'added' WHEN sim >= 0.35 THEN 'skipped' WHEN sim >= 0.25 THEN 'flagged' ELSE 'added' END AS action
        FROM x LEFT JOIN b USING (id) WHERE x.id % 20 = 0""",
    "ttl_assign": f"WITH {MEMORIES} SELECT id, ttl, strftime(expire_at, {FMT}) AS expire_at FROM memories",
    "ttl_histogram": f"WITH {MEMORIES} SELECT ttl_days, count(*) AS n FROM memories GROUP BY 1",
    "archive_preview": f"WITH {MEMORIES}, f AS (SELECT ord, substring(text, 1, 80) AS t FROM memories WHERE due ORDER BY ord LIMIT 5) SELECT count(*) FILTER (due) AS would_archive, count(*) FILTER (NOT due) AS kept, (SELECT coalesce(string_agg(t, '|' ORDER BY ord), '') FROM f) AS examples FROM memories",
    "archive_split": f"WITH {MEMORIES} SELECT id, CASE WHEN due THEN 'archived' ELSE 'active' END AS state, CASE WHEN due THEN '2025-01-15 00:00:00' END AS archived_at FROM memories",
    "restore_ids": f"WITH {MEMORIES} SELECT id, CASE WHEN due AND ord % 3 <> 0 THEN 'archived' ELSE 'active' END AS state, CASE WHEN due AND ord % 3 <> 0 THEN '2025-01-15 00:00:00' END AS archived_at FROM memories",
    "backfill_ttl": f"WITH {MEMORIES} SELECT id, coalesce(ttl_days, ttl) AS ttl_days, strftime(CASE WHEN ttl_days IS NULL THEN coalesce(expire_at, created_at + to_days(ttl)) ELSE expire_at END, {FMT}) AS expire_at FROM memories",
    "backfill_meta": f"WITH {MEMORIES} SELECT id, CASE WHEN ord % 4 = 0 OR coalesce(source, '') = '' THEN 'legacy' ELSE source END AS source, CASE WHEN ord % 6 = 0 THEN '2025-01-15 00:00:00' ELSE strftime(created_at, {FMT}) END AS created_at, CASE WHEN ord % 9 = 0 THEN 0 ELSE 1 END AS merged_count FROM memories WHERE ord % 4 = 0 OR ord % 6 = 0 OR ord % 9 = 0 OR coalesce(source, '') = ''",
    "stats": f"WITH {MEMORIES} SELECT count(*) AS total_memories, count(*) FILTER (ttl_days IS NULL) AS missing_ttl, count(*) FILTER (expire_at IS NULL) AS missing_expire, strftime(min(created_at), {FMT}) AS oldest, strftime(max(created_at), {FMT}) AS newest FROM memories",
    "tag_dist": f"WITH {MEMORIES} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM memories) GROUP BY 1",
    "source_dist": "SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1",
    "list_page": f"WITH {MEMORIES} SELECT id, ord, source FROM memories ORDER BY ord LIMIT 25 OFFSET 50",
    "update_merge": f"WITH {MEMORIES} SELECT id, CASE WHEN ord % 3 <> 0 THEN source END AS a, CASE WHEN ord % 3 = 0 THEN 'new' ELSE 'old' END AS b, CASE WHEN ord % 3 = 0 THEN '1' END AS c FROM memories",
    "delete_ids": "SELECT source, count(*) AS n FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1",
    "chat_cleanup": "SELECT count(*) AS n FROM documents WHERE NOT coalesce(starts_with(text, '[对话]'), false)",
    "export_json": "SELECT coalesce(nullif(source, ''), 'restore') || '-restored' AS source, count(*) AS n, sum(length(text)) AS chars FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY 1",
    "numeric_facts": f"SELECT id, attr, count(*) AS n, max(value) AS largest, min(raw) AS first_raw FROM ({FACTS}) GROUP BY ALL",
    "numeric_conflicts": f"""WITH f AS ({FACTS}), o AS (SELECT id, source, attr, value, (id % 400) AS age FROM f)
        SELECT source AS entity, attr, count(DISTINCT value) AS values, arg_max(id, age * 10000000000 - id) AS keep, count(DISTINCT id) - 1 AS n_drop FROM o GROUP BY ALL HAVING count(DISTINCT value) > 1""",
    "stale_count": f"WITH {MEMORIES} SELECT count(*) FILTER (date_diff('day', created_at, TIMESTAMP '2025-01-15') > 200) AS stale FROM memories",
    "conflict_count": r"WITH m AS (SELECT 'p' || (doc_id % 10) AS p, source, least(len(regexp_extract_all(text, '[\p{Nd},.]+[万亿千百]')), 2) AS money FROM documents), k AS (SELECT p || '+' || source AS key FROM m WHERE source IS NOT NULL UNION ALL SELECT p || '+money' FROM m, range(2) r(i) WHERE i < money) SELECT count(*) - count(DISTINCT key) AS conflicts FROM k",
    "audit_pairs": f"WITH {PAIRS} SELECT a, b, round(sim, 4) AS similarity, CASE WHEN sim >= 0.45 THEN 'duplicate' WHEN sim >= 0.4 THEN 'grey' ELSE 'distinct' END AS verdict FROM p WHERE sim > 0.35",
    "review_pairs": "SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN least(length(a.text), length(b.text)) / greatest(length(a.text), length(b.text), 1) > 0.85 THEN 'duplicate' ELSE 'keep' END AS verdict, CASE WHEN verdict = 'duplicate' THEN CASE WHEN length(a.text) < length(b.text) THEN a.doc_id ELSE b.doc_id END END AS drop FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 10 = 0",
    "latency_summary": "SELECT count(*) AS n, round(avg(value), 4) AS avg, round(quantile_cont(value, 0.5), 4) AS p50, round(max(value), 4) AS max FROM events",
    "turn_pairs": f"WITH {TURNS} SELECT * FROM tp",
    "turn_memories": f"WITH {TURNS}, c AS (SELECT conv_id, turn, {cleaned('user_text')} AS u, {cleaned('assistant_text')} AS a FROM tp) SELECT conv_id, turn, 'User: ' || u || chr(10) || 'Assistant: ' || a AS text, 'session:' || conv_id || ',source:conversation' AS tags FROM c WHERE NOT (regexp_matches(u, {TRIVIAL}) AND regexp_matches(a, {TRIVIAL}))",
    "trivial_turns": f"SELECT role, coalesce(regexp_matches({cleaned('text')}, {TRIVIAL}), false) AS trivial, count(*) AS n FROM conversations GROUP BY ALL",
    "strip_context": f"SELECT conv_id, turn, role, {cleaned('text')} AS cleaned FROM conversations",
    "session_tail": "WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations WHERE text IS NOT NULL) SELECT conv_id, string_agg(substring(text, 1, 200), ' ' ORDER BY back DESC) AS snippet FROM b WHERE back <= 5 GROUP BY 1 HAVING trim(snippet) <> ''",
    "context_block": f"""WITH {QUERY}, {MEMORIES}, n AS (SELECT id, round(sim, 4) AS sim4 FROM s WHERE sim >= 0.2 ORDER BY round(sim, 6) DESC, id LIMIT 5)
        SELECT CASE WHEN count(*) > 0 THEN '<memory-context>' || chr(10) || '[memory] Contextual recall:' || chr(10) || string_agg('- ' || CASE WHEN len(tags) > 0 THEN '[' || array_to_string(tags, ', ') || '] ' ELSE '' END || text || '  (' || strftime(created_at, '%Y-%m-%d') || ')', chr(10) ORDER BY sim4 DESC, n.id) || chr(10) || '</memory-context>' ELSE '' END AS block
        FROM n JOIN memories m ON m.ord = n.id""",
    "mailbox_list": f"WITH {MESSAGES} SELECT id, box, strftime(ts, {FMT}) AS ts FROM messages WHERE ts IS NOT NULL AND status = 'unread' AND live",
    "mailbox_next_unread": f"WITH {MESSAGES} SELECT box, id, strftime(ts, {FMT}) AS ts FROM messages WHERE status = 'unread' AND live QUALIFY row_number() OVER (PARTITION BY box ORDER BY messages.ts, id) = 1",
    "mailbox_ack": f"WITH {MESSAGES}, f AS (SELECT id FROM messages WHERE status = 'unread' AND live QUALIFY row_number() OVER (PARTITION BY box ORDER BY ts, id) = 1) SELECT CASE WHEN id IN (SELECT id FROM f) THEN 'acked' ELSE status END AS status, count(*) AS n FROM messages GROUP BY 1",
    "mailbox_cleanup": f"WITH {MESSAGES} SELECT box, count(*) FILTER (NOT live) AS cleaned, count(*) FILTER (live) AS remaining FROM messages GROUP BY 1",
    "mailbox_stats": f"WITH {MESSAGES} SELECT box, count(*) AS total, count(*) FILTER (status = 'unread') AS unread FROM messages GROUP BY ROLLUP (box)",
    "stream_ingest": f"WITH {MESSAGES} SELECT status, count(*) AS n, sum(ttl_hours) AS hours FROM messages GROUP BY 1",
    "orders_latest": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "customers_without_orders": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1",
    "pricing_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 4) AS discount FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "stream_enrich": f"SELECT label, count(*) AS n, count(DISTINCT id) AS docs FROM ({FOUND}) GROUP BY 1",
    "entity_extract": f"SELECT label, count(*) AS n, count(DISTINCT id) AS docs FROM ({FOUND}) GROUP BY 1",
    "stream_live": f"WITH {MESSAGES} SELECT status, count(*) AS n FROM messages WHERE coalesce(live, true) GROUP BY 1",
    "message_windows": f"WITH {MESSAGES} SELECT strftime(date_trunc('day', ts), {FMT}) AS window_start, status, count(*) AS n FROM messages WHERE ts IS NOT NULL GROUP BY ALL",
    "lookup_ids": f"WITH {MEMORIES} SELECT id, source FROM memories WHERE ord % 11 = 0",
    "stats_full": f"""WITH {MEMORIES} SELECT count(*) AS total_memories, count(*) FILTER (ttl_days IS NULL) AS missing_ttl, count(*) FILTER (expire_at IS NULL) AS missing_expire,
        (SELECT string_agg(tag || '=' || n, ',' ORDER BY tag) FROM (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM memories) GROUP BY 1)) AS tags,
        (SELECT string_agg(s || '=' || n, ',' ORDER BY s) FROM (SELECT coalesce(source, 'unknown') AS s, count(*) AS n FROM memories GROUP BY 1)) AS sources FROM memories""",
    "stale_rows": f"WITH {MEMORIES} SELECT id FROM memories WHERE date_diff('day', created_at, TIMESTAMP '2025-01-15') > 200 AND ord % 7 <> 0",
    "ttl_job": f"""WITH {MEMORIES}, b AS (SELECT coalesce(ttl_days, ttl) AS ttl_days, created_at, CASE WHEN ttl_days IS NULL THEN coalesce(expire_at, created_at + to_days(ttl)) ELSE expire_at END AS expire_at FROM memories)
        SELECT CASE WHEN CASE WHEN expire_at IS NOT NULL THEN TIMESTAMP '2025-01-15' > expire_at ELSE date_diff('day', created_at, TIMESTAMP '2025-01-15') > ttl_days END THEN 'archived' ELSE 'active' END AS state, ttl_days, count(*) AS n FROM b GROUP BY ALL""",
    "conflict_drops": f"WITH {DROPS} SELECT id FROM dr",
    "review_apply": f"WITH {REVIEW} SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT unnest([a, b]) FROM rv WHERE gone IS NULL) THEN false ELSE doc_id % 10 = 0 END AS needs_review, CASE WHEN doc_id % 10 = 0 AND doc_id NOT IN (SELECT unnest([a, b]) FROM rv WHERE gone IS NULL) THEN doc_id + 1 END AS review_similar_to FROM documents WHERE doc_id NOT IN (SELECT gone FROM rv WHERE gone IS NOT NULL)",
    "nightly_deletes": f"WITH {REVIEW}, {DROPS}, dd AS (SELECT id FROM dr UNION SELECT gone FROM rv WHERE gone IS NOT NULL) SELECT id, 'drop' AS what FROM dd UNION ALL SELECT doc_id, 'stay' FROM documents WHERE doc_id NOT IN (SELECT id FROM dd)",
    "session_end_rows": "WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations WHERE text IS NOT NULL) SELECT conv_id, string_agg(substring(text, 1, 200), ' ' ORDER BY back DESC) AS text, 'session:' || conv_id || ',session-summary' AS tags FROM b WHERE back <= 5 GROUP BY conv_id HAVING trim(string_agg(substring(text, 1, 200), ' ' ORDER BY back DESC)) <> ''",
    "mirror_writes": "SELECT 'target:notes,source:builtin-memory' || CASE WHEN doc_id % 2 = 0 AND coalesce(source, '') <> '' THEN ',session:' || source ELSE '' END AS tags, count(*) AS n FROM documents WHERE doc_id % 3 < 2 GROUP BY 1",
    "recall_tool": f"WITH {NEAR_DOCS} SELECT count(*) AS n, coalesce(string_agg(id, ',' ORDER BY round(sim, 4) DESC, id), '') AS ids FROM (SELECT * FROM (SELECT * FROM s ORDER BY round(sim, 6) DESC, id LIMIT 20) WHERE sim >= 0.1 ORDER BY round(sim, 6) DESC, id LIMIT 10)",
    "preserved_facts": f"WITH {NEAR_DOCS} SELECT CASE WHEN count(*) > 0 THEN '[memory preserved facts]' || chr(10) || string_agg('- ' || text, chr(10) ORDER BY round(sim, 4) DESC, id) ELSE '' END AS block FROM (SELECT * FROM (SELECT * FROM s ORDER BY round(sim, 6) DESC, id LIMIT 10) WHERE sim >= 0.3 ORDER BY round(sim, 6) DESC, id LIMIT 3) JOIN (SELECT doc_id AS id, text FROM documents) USING (id)",
    "graph_cache": f"WITH RECURSIVE {REACH} SELECT (SELECT count(*) FROM g) AS edges, (SELECT count(DISTINCT cluster) FROM c) AS clusters, true AS after_23h, false AS after_25h",
    "keywords_segmented": f"WITH w AS (SELECT doc_id AS id, list_filter(string_split(coalesce(text, ''), ' '), lambda x: NOT list_contains({listed(KEYWORD_STOPWORDS)}, x)) AS w FROM documents) SELECT id, least(len(list_distinct(list_transform(w, lambda x: lower(x)))), 25) AS n FROM w",
    "restore_gate": f"SELECT coalesce(nullif(source, ''), 'restore') || '-restored' AS source, count(*) AS n FROM documents JOIN {LAYER} USING (doc_id) WHERE layer IS NULL GROUP BY 1",
    "snapshot_append": "SELECT source, count(*) AS n, 0 AS flags FROM documents GROUP BY 1",
}
SQL["bm25_index"] = SQL["bm25_topk"]
SQL["hybrid_formatted"] = f"SELECT h.id, h.score, 'global' AS method, text, source FROM ({SQL['hybrid_rrf']}) h JOIN documents ON doc_id = h.id"
SQL["stored_rows"] = f"""WITH f AS ({SQL['dedup_tiers_static']}), p AS (SELECT best_id AS id, arg_max(id, id) AS points, arg_max(similarity, id) AS sim FROM f WHERE action = 'flagged' GROUP BY 1),
    {MEMORIES}, x AS (SELECT f.*, m.ttl, f.action = 'flagged' AS flagged, p.points, p.sim FROM f JOIN memories m ON m.ord = f.id LEFT JOIN p ON p.id = f.id WHERE f.action IN ('added', 'flagged'))
    SELECT id, CASE WHEN NOT flagged THEN ttl END AS ttl_days, CASE WHEN NOT flagged THEN strftime(TIMESTAMP '2025-01-15' + to_days(ttl), {FMT}) END AS expire_at, flagged OR points IS NOT NULL AS needs_review,
        coalesce(points, CASE WHEN flagged THEN best_id END) AS review_similar_to, round(coalesce(sim, CASE WHEN flagged THEN similarity END), 4) AS review_similarity FROM x"""
SQL["vector_threshold_cells"], SQL["knn_cells"] = SQL["vector_threshold"], SQL["knn_batch"]
SQL["index_recall"] = "SELECT count(*) FILTER (vec_id % 20 = 0) AS queries, true AS recall_ok FROM embeddings"
SQL["bm25_blocks"] = SQL["bm25_batch"]

# what a stream has given when it stops: what the watermark has passed, which counts milliseconds
MESSAGES = "m AS (SELECT event_id AS id, user_id AS box, ts, CASE WHEN event_type IN ('view', 'click') THEN 'unread' WHEN event_type IN ('signup', 'purchase') THEN 'read' ELSE 'acked' END AS status, 24 + CAST(props->>'$.k' AS INT) AS hours FROM events)"


def watermark(hours: int) -> str:
    return f"w AS (SELECT epoch_us(max(ts)) // 1000 - {hours * 3_600_000} AS wm FROM events)"


SQL["stream_windows"] = f"""WITH {MESSAGES}, {watermark(24)}, x AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s, status FROM m)
    SELECT strftime(s, {FMT}) AS window_start, strftime(s + INTERVAL 2 DAY, {FMT}) AS window_end, status, count(*) AS n FROM x, w WHERE epoch_us(s + INTERVAL 2 DAY) // 1000 <= wm GROUP BY ALL"""
SQL["stream_sessions"] = f"""WITH {MESSAGES}, {watermark(1)}, g AS (SELECT box, ts, coalesce(ts - lag(ts) OVER o >= INTERVAL 30 MINUTE, true) AS cut FROM m WHERE box IS NOT NULL WINDOW o AS (PARTITION BY box ORDER BY ts)),
    i AS (SELECT box, ts, count_if(cut) OVER (PARTITION BY box ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT box, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 1800000000 AS ends_us, count(*) AS n FROM i, w GROUP BY box, k, wm HAVING epoch_us(max(ts)) + 1800000000 <= wm * 1000"""
SQL["stream_expired"] = f"WITH {MESSAGES}, {watermark(1)} SELECT id, box, status, epoch_us(ts) // 1000 + hours * 3600000 AS expires_ms FROM m, w WHERE epoch_us(ts) // 1000 + hours * 3600000 <= wm"
SQL["stream_rebuilds"] = f"""WITH RECURSIVE {watermark(0)}, e AS (SELECT event_type AS name, epoch_us(ts) // 1000 AS t FROM events WHERE ts IS NOT NULL),
    r AS (SELECT name, min(t) AS first FROM e GROUP BY 1 UNION ALL SELECT r.name, (SELECT min(t) FROM e WHERE e.name = r.name AND t >= r.first + 21600000) FROM r WHERE r.first IS NOT NULL),
    p AS (SELECT name, first, lead(first) OVER (PARTITION BY name ORDER BY first) AS nxt FROM r WHERE first IS NOT NULL)
    SELECT p.name, first AS first_ms, first + 21600000 AS due_ms, count(*) AS changes FROM p JOIN e ON e.name = p.name AND t >= first AND t < first + 21600000, w
    WHERE nxt IS NOT NULL OR first + 21600000 <= wm GROUP BY ALL"""

# one row after the other, with the list of rows that are stored so far
SQL["write_tiers"] = f"""WITH RECURSIVE {KEYS}, {VECTORS}, y AS (SELECT doc_id AS id, layer FROM {LAYER} WHERE doc_id IN (SELECT id FROM v)),
    x AS (SELECT v.id, e, k, row_number() OVER (ORDER BY v.id) AS rn FROM v JOIN k USING (id) JOIN y USING (id) WHERE layer IS NULL),
    l AS (SELECT a.rn, b.id AS other, list_inner_product(a.e, b.e) AS raw, round(raw, 6) AS sim, len(list_intersect(a.k, b.k)) / greatest(len(list_distinct(list_concat(a.k, b.k))), 1) AS shared
        FROM x a JOIN x b ON b.rn < a.rn WHERE list_inner_product(a.e, b.e) >= 0.1),
    n AS (SELECT rn, list(struct_pack(other, sim, shared, raw) ORDER BY sim DESC, other) AS near FROM l GROUP BY 1),
    o AS MATERIALIZED (SELECT x.rn, x.id, coalesce(near, []) AS near FROM x LEFT JOIN n USING (rn)),
    s AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS kept, NULL::BIGINT AS id, NULL::STRUCT(other BIGINT, sim DOUBLE, shared DOUBLE, raw DOUBLE) AS best
        UNION ALL SELECT rn, CASE WHEN best.sim >= 0.3 AND best.shared >= 0.02 THEN kept ELSE list_append(kept, id) END, id, best
        FROM (SELECT o.rn, o.id, s.kept, list_filter(o.near, lambda z: list_contains(s.kept, z.other))[1] AS best FROM s JOIN o ON o.rn = s.rn + 1))
    SELECT y.id, CASE WHEN layer IS NOT NULL THEN 'rejected' WHEN best.shared >= 0.02 AND best.sim >= 0.3 THEN 'skipped' WHEN best.shared >= 0.02 AND best.sim >= 0.25 THEN 'flagged' ELSE 'added' END AS action,
        best.other AS best_id, round(best.raw, 4) AS similarity FROM y LEFT JOIN s USING (id)"""
SQL["components_kept_up"] = SQL["components"].replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 7 <> 0)", 1)
SQL["mailbox_sent"] = """WITH e AS (SELECT user_id::VARCHAR AS box, event_type AS subject, concat_ws(' ', event_id::VARCHAR, props) AS body FROM events
        UNION ALL SELECT '_global', event_type, count(*) || ' events' FROM events GROUP BY event_type)
    SELECT 'msg_' || substring(sha256(concat_ws(chr(31), box, 'events', subject, body, '2024-01-20 00:00:00')), 1, 8) AS id, box, subject, '2024-01-20 00:00:00' AS ts, 'unread' AS status, 72 AS ttl_hours, 'normal' AS priority FROM e"""
SQL["mailbox_removed"] = f"WITH {MESSAGES} SELECT box, status, count(*) AS n FROM m WHERE id % 3 <> 0 GROUP BY ALL"
SQL["audit_nearest"] = f"""WITH {QUERY}, n AS (SELECT id FROM (SELECT id, sim FROM s ORDER BY round(sim, 6) DESC, id LIMIT 100) WHERE sim >= 0),
    p AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.e, b.e) AS x FROM v a JOIN v b ON a.id < b.id WHERE a.id IN (SELECT id FROM n) AND b.id IN (SELECT id FROM n) AND list_inner_product(a.e, b.e) > 0.3)
    SELECT row_number() OVER (ORDER BY round(x, 4) DESC, a, b) - 1 AS rank, a, b, round(x, 4) AS similarity, CASE WHEN x >= 0.4 THEN 'duplicate' WHEN x >= 0.35 THEN 'grey' ELSE 'distinct' END AS verdict FROM p"""
SQL["review_page"] = "WITH m AS (SELECT doc_id FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 4 = 0) SELECT 'mem_' || doc_id AS id, doc_id AS ord, (SELECT count(*) FROM m) AS total FROM m ORDER BY doc_id LIMIT 20 OFFSET 10"
SQL["parsed_metadata"] = "SELECT doc_id, concat_ws('/', source, lang) AS tags, concat(source, ':', lang, ':organization|', lang, ':unknown') AS entities FROM documents"


def hybrid_of(k: int) -> str:
    """hybrid_rrf with k rows, from twice as many of each list."""
    return SQL["hybrid_rrf"].replace("LIMIT 10", f"LIMIT {2 * k}").replace("rank < 10", f"rank < {2 * k}").replace("LIMIT 5", f"LIMIT {k}")


# ten rows of the hybrid result are more than the five asked for, so neighbours are never added
SQL["guided_search"] = f"""WITH RECURSIVE {REACH}, b0 AS ({hybrid_of(10)}),
    b AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, vector_rank NULLS LAST, bm25_rank, id) - 1 AS rank FROM b0),
    seeds AS (SELECT DISTINCT cluster FROM c JOIN b USING (id) WHERE rank < 3), inside AS (SELECT id FROM c JOIN seeds USING (cluster)),
    x AS (WITH {bm25(f"SELECT 0 AS qid, '{PHRASE}' AS query", 10).replace("FROM documents", "FROM documents WHERE doc_id IN (SELECT id FROM inside)")} SELECT id, rank FROM bm),
    f AS (SELECT id, b.rank AS global_rank, x.rank AS cluster_rank, CASE WHEN EXISTS (FROM seeds) THEN coalesce(0.6 / (61 + b.rank), 0) + coalesce(0.4 / (61 + x.rank), 0) ELSE b.score END AS y FROM b FULL JOIN x USING (id))
    SELECT id, round(y, 4) AS score, 'graph-guided' AS method, global_rank, cluster_rank, CAST(NULL AS BIGINT) AS expanded_from, CAST(NULL AS DOUBLE) AS edge_weight
    FROM f ORDER BY round(y, 12) DESC, global_rank IS NULL, coalesce(global_rank, cluster_rank), id LIMIT 5"""
SQL["stream_distinct"] = f"SELECT DISTINCT sha256(text) AS text_sha256, length(text) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM {LAYER} WHERE layer IS NULL)"
