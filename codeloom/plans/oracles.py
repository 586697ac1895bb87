"""DuckDB SQL for the registered queries, over the same whole tables.

Written against RE2 and DuckDB's own functions, with no shared logic beyond the corpus
text, so that agreement means something.
"""

from __future__ import annotations

from codeloom import constants as K
from codeloom.plans.fixtures import CLAIM_COLUMNS, CLAIM_ORDER, CORPUS_SQL

ORACLES: dict[str, str] = {}


def _chars(text: str) -> str:
    return "||".join(f"chr({ord(c)})" for c in text)


NL = "chr(10)"
WS = f"({_chars(K.WHITESPACE)})"
CORPUS = f"corpus AS ({CORPUS_SQL})"

# Patterns as the semantics state them, for an engine that matches in linear time.
JAVA = (
    r"(?m)^\s*(?:public|private|protected|static|\s)*\s*[\w<>\[\]]+\s+"
    r"([a-zA-Z0-9_]+)\s*\([^\)]*\)\s*\{"
)
PYTHON = r"(?m)^\s*def\s+([A-Za-z0-9_]+)\s*\([^)]*\)\s*:"
JS = r"(?m)^\s*(?:function\s+)?([A-Za-z0-9_]+)\s*\([^\)]*\)\s*\{"
BOUNDARY = (
    r"(?m)(?:^\s*(?:public|private|protected|static|final|def|class|function)\b.*$)|(?:\n\s*\n)"
)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def lines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, {NL}, '')) + 1)"


def cc(x: str, tokens=K.BRANCH_TOKENS) -> str:
    low = f"lower({x})"
    parts = [
        f"((length({low}) - length(replace({low}, '{t}', ''))) // {len(t)})" for t in tokens
    ]
    return f"CAST(1 + {' + '.join(parts)} AS INTEGER)"


def name_of(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def suffix_of(path: str) -> str:
    return f"regexp_extract({name_of(path)}, '^\\.*[^.].*?(\\.[^.]+)$', 1)"


def language_of(path: str) -> str:
    ext = f"lower({suffix_of(path)})"
    return (
        f"CASE WHEN {ext} IN ('.java', '.kt') THEN 'java' WHEN {ext} = '.py' THEN 'python' "
        f"WHEN {ext} IN ('.js', '.ts') THEN 'js' WHEN {ext} IN ('.html', '.htm') THEN 'html' "
        f"WHEN {ext} = '.css' THEN 'css' ELSE 'other' END"
    )


def _role(path: str, values) -> str:
    out = "CASE"
    for i, (role, terms) in enumerate(K.ROLE_TERMS):
        test = " OR ".join(f"contains(lower({path}), '{t}')" for t in terms)
        out += f" WHEN {test} THEN {values(i, role)}"
    return f"{out} ELSE {values(len(K.ROLE_TERMS), K.OTHER_ROLE)} END"


def role_of(path: str) -> str:
    return _role(path, lambda i, role: f"'{role}'")


def rank_of(path: str) -> str:
    return f"CAST({_role(path, lambda i, role: str(i))} AS INTEGER)"


ALLOWED = ", ".join(f"'{s}'" for s in K.SOURCE_SUFFIXES)
VISIBLE = r"NOT regexp_matches('/' || path, '/\.[^/]*/')"
ADMITTED = f"lower({suffix_of('path')}) IN ({ALLOWED}) AND {VISIBLE}"
DECODED = (
    "CASE WHEN path LIKE '%.kt' THEN content || chr(128) || chr(129) || chr(130) "
    "ELSE content END"
)
LOSSY = (
    "CASE WHEN path LIKE '%.kt' THEN content || chr(65533) || chr(65533) || chr(65533) "
    "ELSE content END"
)


def split_lines(x: str) -> str:
    parts = f"string_split({x}, {NL})"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def slice_of(lines_: str, start: str, end: str) -> str:
    first = f"greatest({start}, 1)"
    return (
        f"CASE WHEN {end} < {first} OR len({lines_}) < {first} THEN '' ELSE "
        f"array_to_string({lines_}[{first}:least({end}, len({lines_}))], {NL}) END"
    )


def heuristic(body: str) -> str:
    line = strip(f"string_split({strip(body)}, {NL})[1]")
    return (
        f"CASE WHEN {line} = '' THEN '{K.HEURISTIC_EMPTY}' "
        f"ELSE '{K.HEURISTIC_PREFIX}' || left({line}, {K.HEURISTIC_CHARS}) END"
    )


def add(name: str, sql: str, *ctes: str) -> None:
    ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql


# --- scan --------------------------------------------------------------------------

CODEC = "CASE WHEN path LIKE '%.kt' THEN 'latin-1' ELSE 'utf-8' END"
add(
    "corpus_scan",
    f"SELECT repo, path, {CODEC} AS decoded_as, CAST(length({DECODED}) AS INTEGER) AS n_chars, "
    f"sha256({DECODED}) AS sha FROM corpus WHERE {ADMITTED}",
    CORPUS,
)
add("ext_filter",
    f"SELECT repo, path FROM corpus WHERE lower({suffix_of('path')}) IN ({ALLOWED})", CORPUS)
add("hidden_dir_filter", f"SELECT repo, path FROM corpus WHERE {VISIBLE}", CORPUS)
add("decode_fallback",
    f"SELECT path, {CODEC} AS decoded_as, sha256({DECODED}) AS sha FROM corpus", CORPUS)
add(
    "newline_norm",
    f"SELECT page_id, CAST({lines('t')} AS INTEGER) AS n_lines, sha256(t) AS sha FROM "
    "(SELECT page_id, replace(html, '</p>', '</p>' || chr(10)) || chr(10) AS t FROM pages)",
)
add(
    "scan_limit",
    "SELECT repo, path FROM corpus "
    "QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 5",
    CORPUS,
)
add(
    "vector_dim_check",
    "SELECT vec_id, CAST(CASE WHEN label = 3 THEN 1 ELSE len(embedding) END AS INTEGER) AS dim, "
    "label <> 3 AS fits FROM embeddings",
)
add(
    "points_upsert",
    "SELECT sha256('repo' || chr(0) || path || chr(0) || i) AS id, path, "
    "CAST(i AS INTEGER) AS chunk_index, sha256(t) AS text_sha FROM ("
    "SELECT 'doc/' || doc_id AS path, text AS t, unnest(range((doc_id // 3) % 4)) AS i "
    "FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL "
    "SELECT 'doc/' || vec_id, 'label ' || label, unnest(range(vec_id % 3 + 1)) FROM embeddings "
    "WHERE vec_id NOT IN (SELECT doc_id FROM labels JOIN documents USING (doc_id)))",
)

# --- scalar functions ----------------------------------------------------------------

add(
    "language_profile",
    f"SELECT {language_of('path')} AS language, count(*) AS files, "
    f"CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum({lines('content')}) AS BIGINT) "
    "AS lines FROM corpus GROUP BY 1",
    CORPUS,
)
add(
    "path_parts",
    f"SELECT path, {name_of('path')} AS module_name, {suffix_of('path')} AS suffix, "
    f"{language_of('path')} AS language FROM corpus",
    CORPUS,
)
add("nonblank_docs",
    f"SELECT repo, path FROM corpus WHERE {strip('content')} <> ''", CORPUS)
add("line_count",
    f"SELECT doc_id, CAST({lines('text')} AS INTEGER) AS n_lines FROM documents")
add("cyclomatic", f"SELECT path, {cc('content')} AS cyclomatic FROM corpus", CORPUS)
add("cyclomatic_validator",
    f"SELECT page_id, {cc('html', K.VALIDATION_BRANCH_TOKENS)} AS cyclomatic FROM pages")
add("role_class",
    f"SELECT path, {role_of('path')} AS role, {rank_of('path')} AS role_rank FROM corpus", CORPUS)
add("content_hash", "SELECT doc_id, sha256(text) AS sha FROM documents")
add("token_estimate",
    "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS tokens FROM documents")
add("heuristic_summary",
    f"SELECT conv_id, turn, {heuristic('text')} AS summary FROM conversations")
add(
    "prompt_body",
    "SELECT doc_id, replace(left(replace(text, '. ', '```'), 800), '```', '''```''') AS body "
    "FROM documents",
)
add(
    "line_slice",
    f"SELECT doc_id, {slice_of('ls', 's', 's + doc_id % 6 - 1')} AS lines FROM ("
    f"SELECT doc_id, n_chars % 7 - 1 AS s, {split_lines('text')} AS ls FROM documents)",
)
add(
    "file_lines",
    "SELECT path, CAST(len(ls) AS INTEGER) AS n_lines, "
    f"sha256(array_to_string(ls, {NL})) AS sha FROM "
    f"(SELECT path, {split_lines('t')} AS ls FROM (SELECT path, {LOSSY} AS t FROM corpus))",
    CORPUS,
)


def adjusted(conf: str, valid: str, branches: str) -> str:
    seen = (
        f"CASE WHEN {valid} THEN coalesce({conf}, 0.5::DOUBLE) "
        f"ELSE least(coalesce({conf}, 0.5::DOUBLE), 0.6::DOUBLE) END"
    )
    return (
        f"round(CASE WHEN {branches} >= 15 THEN least({seen}, 0.6::DOUBLE) "
        f"WHEN {branches} <= 3 THEN least(1.0::DOUBLE, ({seen}) + 0.05::DOUBLE) "
        f"ELSE {seen} END, 3)"
    )


add(
    "confidence_adjust",
    f"SELECT o_orderkey, {adjusted('c', 'v', 'b')} AS adjusted FROM (SELECT o_orderkey, "
    "CASE WHEN o_custkey % 10 > 0 THEN CAST(o_custkey % 100 AS DOUBLE) / 100 END AS c, "
    "o_orderstatus = 'O' AS v, "
    "CASE WHEN o_orderkey % 23 > 0 THEN o_orderkey % 23 END AS b FROM orders)",
)
K_OF = "CAST(json_extract(props, '$.k') AS INTEGER)"
PAIR = "event_type IN ('click', 'purchase')"
add(
    "json_salvage",
    f"SELECT event_id, CAST(CASE WHEN {PAIR} THEN 2 END AS INTEGER) AS n_items, "
    f"CASE WHEN {PAIR} THEN {K_OF} END AS first_k, "
    f"CASE WHEN event_type = 'view' THEN {K_OF} END AS object_k FROM events",
)
add(
    "summary_defaults",
    "SELECT conv_id, turn, CASE WHEN s = '' THEN '<summary unavailable>' ELSE s END AS summary "
    f"FROM (SELECT conv_id, turn, replace({strip('coalesce(c, d, chr(32))')}, chr(10), ' ') AS s "
    "FROM (SELECT *, CASE WHEN role = 'user' THEN nullif(text, '') END AS c, "
    "CASE WHEN turn % 4 = 1 THEN ' ' || chr(10) || text || chr(10) "
    "WHEN turn % 4 = 3 THEN ' ' END AS d FROM conversations))",
)
add("collection_name",
    "SELECT DISTINCT 'repo_' || lower(p_brand) AS collection FROM part")
add(
    "repo_from_url",
    "SELECT page_id, CASE WHEN regexp_matches(n, '^.+\\.[^.]*$') "
    "THEN regexp_extract(n, '^(.+)\\.[^.]*$', 1) ELSE n END AS repo FROM "
    "(SELECT page_id, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), "
    "'([^/]*)$', 1) AS n FROM pages)",
)

# --- functions and modules ---------------------------------------------------------------


def _found(language: str, pattern: str) -> str:
    return (
        f"SELECT repo, path, content, '{language}' AS language, "
        f"regexp_extract_all(content, '{pattern}', 0) AS m, "
        f"regexp_extract_all(content, '{pattern}', 1) AS names, "
        f"string_split_regex(content, '{pattern}') AS g FROM typed WHERE language = '{language}'"
    )


TYPED = f"typed AS (SELECT *, {language_of('path')} AS language FROM corpus)"
FOUND = (
    f"found AS ({_found('java', JAVA)} UNION ALL {_found('python', PYTHON)} "
    f"UNION ALL {_found('js', JS)})"
)
OFFSETS = (
    "placed AS (SELECT repo, path, content, language, m[i] AS hit, names[i] AS name, i - 1 AS "
    "fn_index, list_sum(list_transform(g[1:i], lambda x: length(x))) + "
    "coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start_idx "
    "FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found))"
)
FUNCTIONS = (
    "functions AS (SELECT repo, path, language, CAST(fn_index AS INTEGER) AS fn_index, name, "
    rf"regexp_replace({strip('hit')}, '\s*\{{\s*$', '') AS signature, "
    "CAST(start_idx AS INTEGER) AS start_idx, "
    f"CAST({lines('substr(content, 1, CAST(start_idx AS BIGINT))')} AS INTEGER) AS start_line, "
    f"CAST({lines('body')} AS INTEGER) AS loc, {cc('body')} AS cyclomatic, body FROM "
    "(SELECT *, substr(content, CAST(start_idx AS BIGINT) + 1, 1200) AS body FROM placed))"
)
FUNCS = (CORPUS, TYPED, FOUND, OFFSETS, FUNCTIONS)
TOPS = (
    "tops AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY cyclomatic DESC, "
    "loc DESC, fn_index) AS INTEGER) AS rank FROM functions QUALIFY rank <= 12)"
)
MODULES = (
    f"modules AS (SELECT t.repo, {name_of('t.path')} AS module_name, t.path, t.language, "
    f"CAST({lines('t.content')} AS INTEGER) AS total_lines, "
    "CAST(coalesce(n, 0) AS INTEGER) AS num_functions FROM typed t LEFT JOIN "
    "(SELECT path, count(*) AS n FROM functions GROUP BY path) f ON t.path = f.path "
    f"WHERE {strip('t.content')} <> '')"
)
MODS = (*FUNCS, TOPS, MODULES)

add(
    "functions",
    "SELECT path, language, fn_index, name, signature, start_idx, start_line, loc, cyclomatic, "
    "sha256(body) AS body_sha FROM functions",
    *FUNCS,
)
add("top_functions",
    "SELECT path, rank, fn_index, name, start_line, loc, cyclomatic FROM tops", *FUNCS, TOPS)
add("module_metrics",
    "SELECT repo, path, language, total_lines, num_functions FROM modules", *MODS)
TOP_TEXT = (
    "SELECT path, string_agg(name || ':' || start_line || ':' || loc || ':' || cyclomatic, ',' "
    "ORDER BY rank) AS t FROM tops GROUP BY path"
)
add(
    "module_profile",
    "SELECT repo, module_name, m.path AS path, language, total_lines, num_functions, "
    "coalesce(t, '') AS top_functions, 0.95::DOUBLE AS confidence FROM modules m "
    f"LEFT JOIN ({TOP_TEXT}) x ON x.path = m.path",
    *MODS,
)
LANGUAGES = (
    "SELECT repo, string_agg(language, ',' ORDER BY language) AS languages FROM "
    "(SELECT DISTINCT repo, language FROM modules) GROUP BY repo"
)
add("primary_languages", LANGUAGES, *MODS)
ROLES = ", ".join(f"({i}, '{r}')" for i, r in enumerate(K.ROLES))
GRID = (
    f"grid AS (SELECT repo, CAST(i AS INTEGER) AS role_rank, role FROM "
    f"(SELECT DISTINCT repo FROM modules) CROSS JOIN (VALUES {ROLES}) r(i, role))"
)
add(
    "modules_by_role",
    "SELECT g.repo AS repo, role_rank, role, language || ':' || path AS module, "
    "CASE WHEN path IS NOT NULL THEN row_number() OVER (PARTITION BY g.repo, role "
    "ORDER BY lower(path), path) END AS position FROM grid g "
    f"LEFT JOIN modules m ON m.repo = g.repo AND {role_of('m.path')} = g.role",
    *MODS, GRID,
)
add(
    "role_counts",
    "SELECT g.repo AS repo, role_rank, role, count(path) AS n_modules FROM grid g "
    f"LEFT JOIN modules m ON m.repo = g.repo AND {role_of('m.path')} = g.role GROUP BY ALL",
    *MODS, GRID,
)
add("priority_order",
    f"SELECT repo, {rank_of('path')} AS role_rank, {role_of('path')} AS role, path, row_number() "
    f"OVER (ORDER BY repo, {rank_of('path')}, lower(path), path) AS n FROM corpus",
    CORPUS)
PRIORITY = (
    "CAST(row_number() OVER (PARTITION BY repo ORDER BY "
    f"{rank_of('path')}, lower(path), path) AS INTEGER)"
)
add(
    "priority_limit",
    f"SELECT repo, {PRIORITY} AS priority, {role_of('path')} AS role, path FROM corpus "
    "QUALIFY priority <= 20",
    CORPUS,
)

# --- chunks --------------------------------------------------------------------------------

DOC_FILES = "SELECT source AS repo, 'doc/' || doc_id AS path, text AS content FROM documents"


def _hard(part: str) -> str:
    size = f"greatest(CAST(floor(length({part}) * 1500 / ceil(length({part}) / 4)) AS BIGINT), 1000)"
    return (
        f"list_transform(range(0, length({part}), {size}), "
        f"lambda o: substr({part}, o + 1, {size}))"
    )


CHUNKED = (
    "parts AS (SELECT repo, path, content, m, g FROM (SELECT *, "
    f"regexp_extract_all(content, '{BOUNDARY}') AS m, "
    f"string_split_regex(content, '{BOUNDARY}') AS g FROM files WHERE length(content) > 6000)), "
    "cut AS (SELECT repo, path, list_filter(list_transform(list_concat([g[1]], "
    "list_transform(range(1, len(m) + 1), lambda i: m[i] || g[i + 1])), "
    f"lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM parts), "
    "pieces AS (SELECT repo, path, flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= "
    f"6000 THEN [p] ELSE {_hard('p')} END)) AS cs FROM cut UNION ALL "
    "SELECT repo, path, [content] FROM files WHERE length(content) BETWEEN 1 AND 6000), "
    "chunks AS (SELECT repo, path, i - 1 AS chunk_index, cs[i] AS t FROM "
    "(SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM pieces))"
)
SHOW_CHUNKS = (
    "SELECT path, CAST(chunk_index AS INTEGER) AS chunk_index, "
    "CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS chunk_sha FROM chunks"
)
add(
    "chunks_token", SHOW_CHUNKS, CORPUS,
    f"files AS (SELECT repo, path, content FROM corpus UNION ALL {DOC_FILES})", CHUNKED,
)
add(
    "chunks_fixed", SHOW_CHUNKS, f"files AS ({DOC_FILES})",
    f"s AS (SELECT path, {strip('content')} AS t FROM files WHERE content <> '')",
    "chunks AS (SELECT path, i AS chunk_index, substr(t, i * 1230 + 1, 1500) AS t FROM "
    "(SELECT *, unnest(range(0, CASE WHEN length(t) <= 1500 THEN 1 ELSE "
    "1 + CAST(ceil((length(t) - 1500) / 1230) AS BIGINT) END)) AS i FROM s))",
)
add(
    "corpus_totals",
    "SELECT f.repo AS repo, files, file_chars, coalesce(chunks, 0) AS chunks, "
    "coalesce(chunk_chars, 0) AS chunk_chars FROM (SELECT repo, count(*) AS files, "
    "CAST(sum(length(content)) AS BIGINT) AS file_chars FROM files GROUP BY repo) f "
    "LEFT JOIN (SELECT repo, count(*) AS chunks, CAST(sum(length(t)) AS BIGINT) AS chunk_chars "
    "FROM chunks GROUP BY repo) c ON c.repo = f.repo",
    f"files AS ({DOC_FILES})", CHUNKED,
)
add(
    "run_metrics",
    "SELECT count(*) AS chunks, CAST(sum(length(t)) AS BIGINT) AS chunk_chars FROM chunks",
    f"files AS ({DOC_FILES})", CHUNKED,
)
add(
    "dedup_hash",
    "SELECT sha256(text) AS sha, CAST(length(text) AS INTEGER) AS n_chars "
    "FROM (SELECT DISTINCT text FROM documents)",
)

# --- caches -----------------------------------------------------------------------------------

CACHED = (
    "cached AS (SELECT DISTINCT sha256(text) AS sha FROM documents "
    "JOIN embeddings ON vec_id = doc_id WHERE label <> 9)"
)
add(
    "cache_lookup",
    "SELECT doc_id, sha256(text) AS sha, sha256(text) IN (SELECT sha FROM cached) AS hit "
    "FROM documents",
    CACHED,
)
add(
    "cache_table",
    "SELECT doc_id, sha, sha IN (SELECT sha FROM cached) AS hit, sha NOT IN (SELECT sha FROM cached) "
    "AS missed FROM (SELECT doc_id, sha256(text) AS sha FROM documents)",
    CACHED,
)
MISSED = (
    "SELECT DISTINCT sha256(text) AS sha, CAST(length(text) AS INTEGER) AS n_chars "
    "FROM documents WHERE sha256(text) NOT IN (SELECT sha FROM cached)"
)
add("cache_miss", MISSED, CACHED)
add(
    "cache_merge",
    "SELECT sha, CAST(64 AS INTEGER) AS dim FROM cached UNION ALL "
    f"SELECT sha, CAST(32 AS INTEGER) FROM ({MISSED})",
    CACHED,
)
add(
    "embed_cached",
    "SELECT sha, CAST(64 AS INTEGER) AS dim, false AS fresh FROM cached UNION ALL "
    f"SELECT sha, CAST(64 AS INTEGER), true FROM ({MISSED})",
    CACHED,
)
KEYED = (
    f"keyed AS (SELECT *, sha256(signature || {NL} || body) AS sha FROM functions)"
)
SUMMARIES = (
    "known AS (SELECT sha, min('cached ' || name) AS summary FROM keyed "
    "WHERE language = 'java' GROUP BY sha)"
)
add(
    "summary_cache_lookup",
    "SELECT path, fn_index, k.sha AS sha, summary FROM keyed k LEFT JOIN known n ON n.sha = k.sha",
    *FUNCS, KEYED, SUMMARIES,
)
add(
    "summarize_methods",
    f"SELECT path, fn_index, coalesce(summary, {heuristic('body')}) AS description "
    "FROM keyed k LEFT JOIN known n ON n.sha = k.sha",
    *FUNCS, KEYED, SUMMARIES,
)
add(
    "describe_model",
    "SELECT path, fn_index, CASE substr(sha, 1, 1) WHEN '0' THEN '<summary unavailable>' "
    f"WHEN '1' THEN {heuristic('body')} ELSE 'says ' || replace(signature, {NL}, ' ') END AS description, "
    "substr(sha, 1, 1) NOT IN ('0', '1') AS stored FROM keyed",
    *FUNCS, KEYED,
)
add(
    "describe_functions",
    "SELECT m.path AS path, num_functions, coalesce(d, '') AS descriptions FROM modules m "
    f"LEFT JOIN (SELECT path, string_agg(name || '|' || {heuristic('body')}, {NL} "
    "ORDER BY rank) AS d FROM tops GROUP BY path) t ON t.path = m.path",
    *MODS,
)
add(
    "reply_match",
    "SELECT DISTINCT sha, name, CASE WHEN language IN ('java', 'python') "
    "THEN 'does ' || name ELSE '<summary unavailable>' END AS summary FROM "
    f"(SELECT *, sha256(signature || {NL} || body) AS sha FROM tops)",
    *FUNCS, TOPS,
)
add(
    "known_collections",
    "SELECT 'repo_' || lower(p_brand) AS collection, "
    "bool_or(p_size > 49 AND p_type = 'SMALL') AS known FROM part GROUP BY 1",
)

# --- inference and search ------------------------------------------------------------------------

BYTE = "CAST('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2) AS INTEGER)"
add(
    "embed_corpus",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(32 AS INTEGER) AS dim, "
    "round(list_sum(list_transform(range(1, 33), lambda i: "
    f"CAST(CAST(({BYTE} - 127.5::DOUBLE) / 127.5::DOUBLE AS FLOAT) AS DOUBLE) * i)), 3) "
    f"AS checksum FROM (SELECT doc_id, sha256('0' || {NL} || text) AS h FROM documents)",
)
add(
    "batching",
    "SELECT count(*) AS rows, true AS within_bound FROM documents",
)


def _means(keys: str) -> str:
    group = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return (
        f"means AS (SELECT {group}list(x ORDER BY pos) AS q FROM (SELECT {group}pos, avg(x) AS x "
        f"FROM (SELECT {group}unnest(CAST(embedding AS DOUBLE[])) AS x, "
        f"unnest(range(1, 65)) AS pos FROM embeddings) GROUP BY {group}pos) {by})"
    )


COSINE = (
    "list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"
)
add(
    "vector_topk",
    f"SELECT id, label, round({COSINE}, 6) AS score FROM (SELECT vec_id AS id, label, "
    "CAST(embedding AS DOUBLE[]) AS v FROM embeddings) CROSS JOIN means "
    f"ORDER BY {COSINE} DESC, id LIMIT 8",
    _means(""),
)
_PAIR = (
    "(list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * "
    "sqrt(list_dot_product(b.v, b.v)), 0))"
)
HITS = (
    f"hits AS (SELECT query_id, id, {COSINE} AS s, CAST(row_number() OVER (PARTITION BY query_id "
    f"ORDER BY {COSINE} DESC, id) AS INTEGER) AS rank FROM (SELECT vec_id AS id, "
    "CAST(embedding AS DOUBLE[]) AS v FROM embeddings) CROSS JOIN "
    "(SELECT label AS query_id, q FROM means) QUALIFY rank <= 8)"
)
add("vector_topk_batch",
    "SELECT query_id, rank, id, round(s, 6) AS score FROM hits", _means("label"), HITS)
_FIRST = "CASE WHEN label % 2 = 0 THEN 0.0 ELSE v[1] END"
add(
    "vector_topk_zero",
    "SELECT id, CASE WHEN s <> 0 THEN round(s, 6) END AS score FROM (SELECT vec_id AS id, "
    f"{_FIRST} / nullif(sqrt(list_dot_product(v, v) - CASE WHEN label % 2 = 0 THEN v[1] * v[1] ELSE 0 END), 0) "
    "AS s FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)) "
    "ORDER BY s DESC NULLS LAST, id LIMIT 1000",
)
_VECTORS = "vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
add(
    "vector_topk_all",
    f"SELECT a.id AS query_id, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {_PAIR} DESC, b.id) "
    f"AS INTEGER) AS rank, b.id AS id, round({_PAIR}, 6) AS score FROM vecs a CROSS JOIN vecs b "
    "QUALIFY rank <= 8",
    _VECTORS,
)
# planes as signs by a rule, buckets by the sides, the 32 cheapest buckets of 8 tables
_SIGN = "CASE WHEN strpos('0123456789abcdef', substr(md5(t || ':' || b || ':' || d), 2, 1)) % 2 = 0 THEN 1.0 ELSE -1.0 END"
add(
    "vector_topk_approx",
    f"SELECT qid AS query_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY {_PAIR} DESC, b.id) "
    f"AS INTEGER) AS rank, b.id AS id, round({_PAIR}, 6) AS score FROM met JOIN vecs a ON a.id = qid "
    "JOIN vecs b ON b.id = met.id QUALIFY rank <= 8",
    _VECTORS,
    f"planes AS (SELECT t, b, list({_SIGN} ORDER BY d) AS w FROM range(8) x(t), range(8) y(b), range(64) z(d) GROUP BY t, b)",
    "sides AS (SELECT id, t, b, list_dot_product(v, CAST(w AS DOUBLE[])) AS s FROM vecs CROSS JOIN planes)",
    "buckets AS (SELECT id, t, sum(CASE WHEN s > 0 THEN 1 << b ELSE 0 END) AS bucket FROM sides GROUP BY id, t)",
    "costs AS (SELECT id, t, m, sum(CASE WHEN (m >> b) & 1 = 1 THEN abs(s) ELSE 0 END) AS c "
    "FROM sides CROSS JOIN range(256) r(m) WHERE id % 20 = 0 GROUP BY id, t, m)",
    "probes AS (SELECT id AS qid, t, m FROM costs QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY c, m) <= 32)",
    "met AS (SELECT DISTINCT qid, p.id FROM probes JOIN buckets o ON o.id = qid AND o.t = probes.t "
    "JOIN buckets p ON p.t = probes.t AND p.bucket = xor(CAST(o.bucket AS BIGINT), m))",
)
add(
    "prompt_context",
    "SELECT query_id, string_agg('[file: ' || source || '#0]' || chr(10) || left(text, 1500), "
    f"{_chars(K.CONTEXT_SEPARATOR)} ORDER BY rank) AS contexts FROM hits "
    "JOIN documents ON doc_id = id GROUP BY query_id",
    _means("label"), HITS,
)
add(
    "prompt_evidence",
    f"SELECT repo, string_agg(e, {_chars(K.EVIDENCE_SEPARATOR)} ORDER BY n) AS evidence FROM ("
    "SELECT m.repo, '[file: ' || m.path || ']' || chr(10) || 'lang: ' || language || chr(10) || "
    "'lines: ' || total_lines || chr(10) || 'functions:' || chr(10) || coalesce(f, '') AS e, n "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {rank_of('path')}, "
    "lower(path), path) AS n FROM modules QUALIFY n <= 40) m LEFT JOIN (SELECT path, "
    "string_agg('- ' || name || ' (loc=' || loc || ', cc=' || cyclomatic || ', start=' || "
    "start_line || ')', chr(10) ORDER BY rank) AS f FROM tops WHERE rank <= 6 GROUP BY path) t "
    "ON t.path = m.path) GROUP BY repo",
    *MODS,
)

# --- reports ----------------------------------------------------------------------------------------

add(
    "report_assemble",
    "SELECT m.repo AS repo, m.repo AS project_name, 'DRY_RUN' AS project_overview, languages, "
    "string_agg(path, ',' ORDER BY n) FILTER (WHERE n <= 20) AS key_modules, "
    "count(*) FILTER (WHERE role = 'controllers') AS controllers, "
    "count(*) FILTER (WHERE role = 'other') AS other, CAST(count(*) FILTER (WHERE role = 'other' "
    "AND n <= 20) AS INTEGER) AS listed_other, 'unknown' AS branch, 0 AS dependencies, false AS has_tests, "
    "'dry-run' AS assumption FROM (SELECT *, "
    f"{role_of('path')} AS role, row_number() OVER (PARTITION BY repo ORDER BY "
    f"{rank_of('path')}, lower(path), path) AS n FROM modules) m "
    f"JOIN ({LANGUAGES}) l ON l.repo = m.repo GROUP BY m.repo, languages",
    *MODS,
)

add(
    "report_round_trip",
    "SELECT repo AS repository, repo AS project_name, 'unknown' AS commit, "
    "CAST(least(count(*), 20) AS INTEGER) AS modules, coalesce(string_agg(path, ',' ORDER BY n) "
    "FILTER (WHERE role = 'services' AND n <= 20), '') AS services, 6 AS roles, "
    "count(*) FILTER (WHERE role = 'other') AS other, true AS dated FROM (SELECT *, "
    f"{role_of('path')} AS role, row_number() OVER (PARTITION BY repo ORDER BY "
    f"{rank_of('path')}, lower(path), path) AS n FROM modules) GROUP BY repo",
    *MODS,
)

_CLAIMS = ", ".join(f"{e} AS {c}" for c, e in CLAIM_COLUMNS.items())
CLAIMS = (
    "claims AS (SELECT r.*, c.path AS path, CAST(row_number() OVER (PARTITION BY report_id, "
    f"module_pos ORDER BY {', '.join(CLAIM_ORDER)}) - 1 AS INTEGER) AS method_pos, "
    f"{ADMITTED.replace('path', 'c.path')} AS present, t FROM "
    f"(SELECT {_CLAIMS}, {', '.join(CLAIM_ORDER)} FROM lineitem) r "
    f"LEFT JOIN (SELECT file_id, path, {LOSSY} AS t FROM corpus) c ON c.file_id = r.file_id), "
    # positions of modules count only orders that have line items
    "spots AS (SELECT report_id, module_pos AS slot, CAST(row_number() OVER (PARTITION BY "
    "report_id ORDER BY module_pos) - 1 AS INTEGER) AS module_pos, "
    "min(path) AS first_path, max(path) AS last_path, min(start_line) AS low, "
    "max(end_line) AS high FROM claims GROUP BY report_id, module_pos), "
    "claimed AS (SELECT c.* EXCLUDE (module_pos), s.module_pos, s.slot FROM claims c "
    "JOIN spots s ON s.report_id = c.report_id AND s.slot = c.module_pos)"
)
REPORTS = (CORPUS, CLAIMS)
TOTALS = (
    "SELECT 'report ' || report_id AS project_name, "
    "CAST(count(DISTINCT module_pos) AS INTEGER) AS modules, CAST(count(*) AS INTEGER) AS methods, "
    "(SELECT max(path) FROM claimed x WHERE x.report_id = c.report_id AND x.module_pos = 0) "
    "AS first_path FROM claimed c GROUP BY report_id"
)
add(
    "report_json",
    f"SELECT *, 'r' || CAST(CAST(replace(project_name, 'report ', '') AS BIGINT) % 5 AS VARCHAR) "
    f"AS repo FROM ({TOTALS})",
    *REPORTS,
)
add("report_scan", TOTALS, *REPORTS)
add(
    "report_unnest",
    "SELECT report_id, module_pos, 'order ' || slot AS module_name, method_pos, name, path, "
    "CAST(start_line AS VARCHAR) AS start, CAST(end_line AS VARCHAR) AS \"end\", confidence "
    "FROM claimed",
    *REPORTS,
)
CHOSEN = (
    "chosen AS (SELECT s.*, CASE WHEN a.path IS NOT NULL THEN s.first_path "
    "WHEN b.path IS NOT NULL THEN s.last_path END AS chosen_path FROM spots s "
    "LEFT JOIN admitted a ON a.path = s.first_path LEFT JOIN admitted b ON b.path = s.last_path)"
)
ADMITTED_FILES = (
    f"admitted AS (SELECT path, {split_lines('t')} AS ls FROM "
    f"(SELECT path, {LOSSY} AS t FROM corpus WHERE {ADMITTED}))"
)
add(
    "first_existing_path",
    "SELECT report_id, module_pos, chosen_path FROM chosen",
    *REPORTS, ADMITTED_FILES, CHOSEN,
)
add(
    "claim_lookup",
    "SELECT report_id, path, count(*) AS claims, count(*) FILTER (WHERE present) AS found "
    "FROM claims GROUP BY report_id, path",
    *REPORTS,
)
SPANS = (
    "spans AS (SELECT f.path, fn_index, cyclomatic, start_line, coalesce(lead(start_line) OVER "
    "(PARTITION BY f.path ORDER BY fn_index) - 1, len(ls)) AS end_line "
    "FROM functions f JOIN admitted a ON a.path = f.path)"
)
CLAIM_KEY = (
    "SELECT row_number() OVER () AS id, report_id, path, start_line, end_line FROM claims"
)
add(
    "containing_function",
    "SELECT report_id, path, start_line, end_line, CAST(min(fn_index) AS INTEGER) AS fn_index, "
    "min_by(cyclomatic, fn_index) AS cyclomatic FROM (SELECT k.*, fn_index, cyclomatic FROM "
    f"({CLAIM_KEY}) k LEFT JOIN spans s ON s.path = k.path AND "
    "(k.start_line BETWEEN s.start_line AND s.end_line "
    "OR k.end_line BETWEEN s.start_line AND s.end_line)) "
    "GROUP BY id, report_id, path, start_line, end_line",
    *FUNCS, CLAIMS, ADMITTED_FILES, SPANS,
)
CHECKED = (
    "ranged AS (SELECT c.*, coalesce(c.path, h.chosen_path) AS cited, ls, "
    "CASE WHEN start_line <= 0 THEN 1 ELSE start_line END AS s FROM claimed c "
    "JOIN chosen h ON h.report_id = c.report_id AND h.module_pos = c.module_pos "
    "LEFT JOIN admitted a ON a.path = coalesce(c.path, h.chosen_path)), "
    "bounded AS (SELECT *, CASE WHEN end_line <= 0 THEN least(len(ls), s + 200) "
    "ELSE end_line END AS e, coalesce(s <= len(ls), false) AS valid FROM ranged), "
    f"shown AS (SELECT *, CASE WHEN valid THEN {slice_of('ls', 's', 'e')} END AS ev FROM bounded), "
    f"checked AS (SELECT *, {cc('ev', K.VALIDATION_BRANCH_TOKENS)} AS complexity FROM shown)"
)
VALIDATED = (*REPORTS, ADMITTED_FILES, CHOSEN, CHECKED)
add(
    "validate_methods",
    "SELECT report_id, module_pos, method_pos, name, cited AS path, sha256(ev) AS evidence_sha, "
    f"CAST(CASE WHEN ev = '' THEN 0 ELSE {lines('ev')} END AS INTEGER) AS computed_loc, "
    "complexity AS computed_cyclomatic, "
    f"{adjusted('confidence', 'valid', 'complexity')} AS confidence_adjusted, "
    "valid AS validated FROM checked",
    *VALIDATED,
)
SNIPPETS = (
    "snips AS (SELECT h.report_id, h.module_pos, h.chosen_path, ls, "
    "CASE WHEN slot % 4 = 0 THEN 1 ELSE low END AS s, "
    "CASE WHEN slot % 4 = 0 THEN least(200, len(ls)) WHEN slot % 4 > 1 THEN high "
    "ELSE low + 50 END AS e FROM chosen h LEFT JOIN admitted a ON a.path = h.chosen_path)"
)
add(
    "validate_modules",
    "SELECT s.report_id AS report_id, s.module_pos AS module_pos, any_value(chosen_path) AS path, "
    f"any_value(sha256(CASE WHEN s.ls IS NOT NULL THEN {slice_of('s.ls', 's.s', 's.e')} END)) "
    "AS snippet_sha, bool_or(valid) AS validated, count(*) AS methods, "
    "count(*) FILTER (WHERE valid) AS valid_methods FROM snips s JOIN checked c "
    "ON c.report_id = s.report_id AND c.module_pos = s.module_pos GROUP BY 1, 2",
    *VALIDATED, SNIPPETS,
)
add(
    "module_validity",
    "SELECT report_id, module_pos, bool_or(valid) AS validated FROM checked GROUP BY 1, 2",
    *VALIDATED,
)
add(
    "validation_summary",
    "SELECT report_id, count(DISTINCT module_pos) FILTER (WHERE valid) AS modules_validated, "
    "count(*) FILTER (WHERE valid) AS methods_validated, count(*) AS methods_total, "
    "count(*) FILTER (WHERE NOT valid) AS warnings FROM checked GROUP BY report_id",
    *VALIDATED,
)
add(
    "validation_warnings",
    "SELECT report_id, module_pos, method_pos, 'Method ' || name || ' could not be validated "
    "(path ' || coalesce(cited, 'None') || ')' AS warning, row_number() OVER (PARTITION BY "
    "report_id ORDER BY module_pos, method_pos) <= 10 AS shown FROM checked WHERE NOT valid",
    *VALIDATED,
)
VALIDATED_TOTALS = (
    "SELECT report_id, CAST(count(DISTINCT module_pos) AS INTEGER) AS modules, "
    "CAST(count(DISTINCT module_pos) FILTER (WHERE valid) AS INTEGER) AS valid_modules, "
    "CAST(count(*) FILTER (WHERE valid) AS INTEGER) AS valid_methods, "
    "CAST(coalesce(sum(complexity), 0) AS INTEGER) AS complexity, count(*) AS methods_total, "
    "CAST(count(*) FILTER (WHERE NOT valid) AS INTEGER) AS warnings "
    "FROM checked GROUP BY report_id"
)
add("validated_report", VALIDATED_TOTALS, *VALIDATED)
add("validated_sink", VALIDATED_TOTALS, *VALIDATED)
_BROKEN = "o_orderpriority LIKE '1%'"
_GAP = "o_orderstatus = 'O'"


def _absent(kind: str, field: str, when: str, times: int = 1) -> str:
    return (
        f"SELECT o_orderkey, '{field}' AS field, CAST({times} AS INTEGER) AS absent, "
        f"'{kind}' AS kind FROM orders WHERE {when}"
    )


_WHOLE = f"NOT {_BROKEN}"
add(
    "report_conformance",
    " UNION ALL ".join(
        [_absent(kind, "$", _BROKEN) for kind in ("lead", "simple")]
        + [
            _absent("lead", f, _WHOLE)
            for f in ("repo.branch", "repo.commit", "dependencies", "tests_and_ci",
                      "global_complexity_notes", "assumptions", "key_modules[].description",
                      "key_modules[].lines.end", "key_modules[].example_snippet",
                      "key_modules[].complexity_notes", "key_modules[].recommendations",
                      "key_modules[].confidence")
        ]
        + [
            _absent("lead", f"key_modules[].key_methods[].{f}", _WHOLE, 2)
            for f in ("signature", "loc", "cyclomatic_complexity", "source_ref")
        ]
        + [
            _absent("lead", f, f"{_WHOLE} AND {_GAP}")
            for f in ("architecture_summary", "generated_at", "key_modules[].lines.start",
                      "key_modules[].key_methods[].name")
        ]
        + [_absent("simple", "primary_languages", _WHOLE)]
        + [
            _absent("simple", "key_modules[].path", f"{_WHOLE} AND {_GAP}"),
            _absent("simple", "key_modules[].key_methods[].name", f"{_WHOLE} AND {_GAP}", 2),
        ]
    ),
)
add(
    "analysis_run",
    "SELECT m.repo AS repo, CAST(least(20, count(*)) AS INTEGER) AS key_modules, languages, "
    "count(*) AS modules, CAST(sum(least(12, num_functions)) AS BIGINT) AS described, "
    "any_value(chunks) AS chunks, any_value(chunks) AS points FROM modules m "
    f"JOIN ({LANGUAGES}) l ON l.repo = m.repo "
    "JOIN (SELECT repo, count(*) AS chunks FROM chunks GROUP BY repo) c ON c.repo = m.repo "
    "GROUP BY m.repo, languages",
    f"corpus AS (SELECT file_id, repo, path, {DECODED} AS content FROM ({CORPUS_SQL}) "
    f"WHERE {ADMITTED})",
    TYPED, FOUND, OFFSETS, FUNCTIONS, TOPS, MODULES,
    "files AS (SELECT repo, path, content FROM corpus)", CHUNKED,
)
