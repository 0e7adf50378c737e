"""SQL over the same tables, written from the rules, for the queries that SQL can express."""

from __future__ import annotations

_URL = r"'^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)'"


def _scheme(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, {_URL}, 1)), '')"


def _host(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, {_URL}, 2)), '')"


def _port(u: str) -> str:
    return f"coalesce(CAST(nullif(regexp_extract({u}, {_URL}, 3), '') AS INTEGER), CASE {_scheme(u)} WHEN 'https' THEN 443 WHEN 'http' THEN 80 END)"


def _path(u: str) -> str:
    return f"CASE WHEN {_scheme(u)} IS NOT NULL THEN coalesce(nullif(regexp_extract({u}, {_URL}, 4), ''), '/') END"


def _prefix(p: str) -> str:
    return f"CASE WHEN {p} IS NOT NULL THEN coalesce(nullif(regexp_extract({p}, '^(.*/)', 1), ''), '/') END"


def _type(p: str) -> str:
    low = f"lower({p})"
    return f"CASE WHEN {low} LIKE '%.pdf' THEN 'application/pdf' WHEN {low} LIKE '%.json' THEN 'application/json' WHEN {low} LIKE '%.txt' OR {low} LIKE '%.md' THEN 'text/plain' WHEN {low} LIKE '%.html' OR {low} LIKE '%.htm' OR {low} LIKE '%/' OR regexp_extract({low}, '([^/]*)$', 1) NOT LIKE '%.%' THEN 'text/html' END"


def _same_origin(a: str, b: str) -> str:
    return f"coalesce({_scheme(a)} = {_scheme(b)} AND {_host(a)} = {_host(b)} AND {_port(a)} IS NOT DISTINCT FROM {_port(b)}, false)"


def _same_path(u: str, s: str) -> str:
    return f"coalesce(starts_with({_path(u)}, {_prefix(_path(s))}), false)"


_WS = r"[\s\x{00a0}\x{2000}-\x{200a}\x{3000}\x{202f}]"
_BATCH = "SELECT batch_id, item_index, min(url) AS url, max(status) AS was FROM batch_items GROUP BY batch_id, item_index"
_DEDUPED = f"SELECT batch_id, item_index, url, was, row_number() OVER (PARTITION BY batch_id, url ORDER BY item_index) > 1 AS again FROM ({_BATCH})"
_RUNS = "SELECT 'run-' || artifact_id AS run_id, CAST(floor(epoch(fetched_at)) AS BIGINT) AS modified, CAST(coalesce(strlen(content), 0) AS BIGINT) AS size_bytes, sensitive, url, greatest(0, 1772323200 - CAST(floor(epoch(fetched_at)) AS BIGINT)) AS age_seconds FROM source_artifacts"
_RANKED = f"SELECT *, row_number() OVER (ORDER BY modified DESC, run_id) AS newest FROM ({_RUNS})"
_REQUESTS = "SELECT page_id, url, sensitive, CAST(floor(epoch(fetched_at)) AS BIGINT) AS taken, sha256(coalesce(url, '')) AS key, content FROM source_pages"
_COOKIES = f"SELECT 's' || (crawl_id % 7) AS session, 'c' || depth AS name, coalesce(status, '') AS value, {_host('coalesce(final_url, url)')} AS domain FROM crawl_items WHERE url IS NOT NULL AND {_host('coalesce(final_url, url)')} IS NOT NULL"
_MERGED = f"SELECT name, domain, '/' AS path, min(value) AS value, max(value) AS other, min(session) AS s1, max(session) AS s2 FROM ({_COOKIES}) GROUP BY name, domain"
_LINKS = "SELECT source_url, regexp_replace(url, '#.*$', '') AS url, coalesce(text, '') AS text, row_number() OVER (PARTITION BY source_url ORDER BY url, text NULLS FIRST) - 1 AS pos FROM links WHERE url IS NOT NULL AND source_url IS NOT NULL"

_SECTIONS = rf"""
parts AS (SELECT artifact_id, string_split(content, chr(10)) AS ls FROM source_artifacts WHERE content IS NOT NULL AND content <> '' {{where}}),
lines AS (SELECT artifact_id, unnest(ls) AS line, unnest(range(len(ls))) AS i, len(ls) AS n FROM parts),
marked AS (SELECT *, CASE WHEN regexp_matches(line, '^{_WS}*#{{{{1,6}}}} ') THEN 1 ELSE 0 END AS heads, length(line) + CASE WHEN i < n - 1 THEN 1 ELSE 0 END AS size FROM lines),
placed AS (SELECT *, sum(heads) OVER w AS sec, sum(size) OVER w - size AS char_start, sum(size) OVER w AS char_end FROM marked WINDOW w AS (PARTITION BY artifact_id ORDER BY i)),
secs AS (
  SELECT artifact_id, sec, min(char_start) AS char_start, max(char_end) AS char_end, string_agg(line || CASE WHEN i < n - 1 THEN chr(10) ELSE '' END, '' ORDER BY i) AS text,
    CASE WHEN max(heads) = 1 THEN trim(regexp_replace(min_by(line, i), '^#+', ''), ' ' || chr(9) || chr(13) || chr(160)) ELSE 'Document' END AS heading
  FROM placed GROUP BY artifact_id, sec),
numbered AS (SELECT artifact_id, 'section-' || row_number() OVER (PARTITION BY artifact_id ORDER BY char_start) AS section_id, heading, text, char_start, char_end FROM secs WHERE char_end > char_start)
"""


def _sections(where: str = "") -> str:
    return _SECTIONS.replace("{where}", where).replace("{{", "{").replace("}}", "}")


def _hits(term: str) -> str:
    return f"least((length(low) - length(replace(low, '{term}', ''))) // {len(term)}, 8) * 6"


def _lines(term: str) -> str:
    bare = f"regexp_replace(l, '^{_WS}+', '')"
    return f"least(len(list_filter(string_split(text, chr(10)), lambda l: (starts_with({bare}, '- ') OR starts_with({bare}, '* ') OR contains(l, '|') OR contains(l, '[')) AND contains(lower({bare}), '{term}'))), 4) * 4"


_TOPK = rf"""
WITH {_sections("AND NOT coalesce(sensitive, false)")},
lowered AS (SELECT *, lower(text) AS low, lower(heading) AS head FROM numbered),
scored AS (
  SELECT *, CAST(CASE WHEN contains(head, 'library card') THEN 120 ELSE 0 END + CASE WHEN contains(low, 'library card') THEN 60 ELSE 0 END
    + CASE WHEN contains(head, 'card') THEN 30 ELSE 0 END + CASE WHEN contains(head, 'library') THEN 30 ELSE 0 END + {_hits("card")} + {_hits("library")} + {_lines("card")} + {_lines("library")} AS BIGINT) AS score,
    coalesce(least(nullif(instr(low, 'library card'), 0), nullif(instr(low, 'card'), 0), nullif(instr(low, 'library'), 0)) - 1, 0) AS place
  FROM lowered),
ranked AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY score DESC, char_start) AS rank, greatest(place - 120, 0) AS a, least(place + 120, length(text)) AS b FROM scored WHERE score > 0)
SELECT artifact_id, CAST(rank AS BIGINT) AS rank, section_id, score,
  trim(regexp_replace(CASE WHEN a > 0 THEN '...' ELSE '' END || substring(text, a + 1, b - a) || CASE WHEN b < length(text) THEN '...' ELSE '' END, '{_WS}+', ' ', 'g')) AS snippet,
  CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end
FROM ranked WHERE rank <= 3
"""

ORACLES: dict[str, str] = {
    "page_usage": "SELECT page_id, CAST(strlen(content) AS BIGINT) AS content_bytes, CAST(ceil(length(content) / 4.0) AS BIGINT) AS estimated_tokens FROM source_pages WHERE content IS NOT NULL",
    "needs_render": r"SELECT page_id, coalesce(list_bool_or(list_transform(regexp_extract_all(content, '(?i)<script([^>]*)>', 1), lambda a: regexp_extract(a, '(?i)type\s*=\s*[\x22\x27]?([^\x22\x27\s;>]*)', 1) IN ('', 'module', 'text/javascript', 'application/javascript', 'text/ecmascript', 'application/ecmascript', 'text/jscript'))), false) AS needs_render FROM source_pages WHERE content_format = 'html' AND content IS NOT NULL",
    "max_chars_limits": "SELECT page_id, left(content, 1000) AS content, length(content) > 1000 AS truncated, CAST(length(content) AS BIGINT) AS chars_before, CAST(least(length(content), 1000) AS BIGINT) AS chars_after FROM source_pages WHERE content IS NOT NULL",
    "input_classify": f"SELECT DISTINCT batch_id, item_index, url, CASE WHEN starts_with(url, 'file://') THEN 'file' WHEN starts_with(url, 'raw:') THEN 'inline' WHEN {_scheme('url')} IN ('http', 'https') AND {_host('url')} IS NOT NULL THEN 'http' END AS kind FROM batch_items",
    "url_parts": f"SELECT page_id, {_scheme('url')} AS scheme, {_host('url')} AS host, {_port('url')} AS port, {_path('url')} AS path, {_prefix(_path('url'))} AS prefix, regexp_replace(url, '#.*$', '') AS normal FROM source_pages",
    "content_types": f"SELECT {_type(_path('url'))} AS content_type, count(*) AS links FROM links GROUP BY 1",
    "link_origins": f"SELECT {_same_origin('url', 'source_url')} AS same_origin, {_same_path('url', 'source_url')} AS same_path, count(*) AS links FROM links GROUP BY 1, 2",
    "map_filtered": f"""
WITH firsts AS (SELECT *, row_number() OVER (PARTITION BY source_url, url ORDER BY pos) AS n FROM ({_LINKS})),
kept AS (SELECT * FROM firsts WHERE n = 1 AND {_same_origin('source_url', 'url')} AND NOT contains(url, '/login') AND {_type(_path('url'))} = 'text/html'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY pos) AS r FROM kept)
SELECT source_url, url, text, pos FROM ranked WHERE r <= 3""",
    "search_sections": f"WITH {_sections()} SELECT artifact_id, section_id, heading, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end FROM numbered",
    "search_topk": _TOPK,
    "extract_metadata": "SELECT page_id, json_extract_string(metadata, '$.site') AS site, json_extract_string(metadata, '$.lang') AS lang FROM source_pages WHERE content_format IN ('markdown', 'html', 'text') AND content IS NOT NULL",
    "extract_json": """SELECT page_id, true AS ok, '{"code": ' || coalesce(CAST(json_extract(content, '$.error.code') AS VARCHAR), 'null') || ', "status": ' || coalesce(CAST(json_extract(content, '$.status') AS VARCHAR), 'null') || '}' AS values_json, CAST(NULL AS VARCHAR) AS error FROM source_pages WHERE content_format = 'json' AND content IS NOT NULL""",
    "extract_summary": "SELECT count(*) AS sources, CAST(1 AS BIGINT) AS fields, count(*) FILTER (WHERE sensitive) AS sensitive_sources, count(*) FILTER (WHERE content IS NULL) AS failed FROM source_artifacts",
    "batch_dedupe": f"SELECT batch_id, item_index, url, CASE WHEN again THEN 'skipped' ELSE 'pending' END AS status, CASE WHEN again THEN 'duplicate' END AS reason FROM ({_DEDUPED})",
    "batch_fail_fast": f"""
WITH f AS (SELECT *, CASE WHEN NOT again THEN (count(*) FILTER (WHERE NOT again) OVER (PARTITION BY batch_id ORDER BY item_index) - 1) // 2 END AS chunk FROM ({_DEDUPED})),
g AS (SELECT *, min(chunk) FILTER (WHERE was = 'failed') OVER (PARTITION BY batch_id) AS stop FROM f)
SELECT batch_id, item_index, url, CASE WHEN again OR chunk > stop THEN 'skipped' WHEN was = 'failed' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN again THEN 'duplicate' WHEN chunk > stop THEN 'fail_fast' END AS reason FROM g""",
    "batch_summary": "SELECT batch_id, count(*) AS requested, count(*) FILTER (WHERE status = 'ok') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') = 0 AS ok FROM batch_items GROUP BY batch_id",
    "crawl_summary": "SELECT crawl_id, count(*) AS fetched, count(*) FILTER (WHERE status = 'ok') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'failed') = 0 AS ok FROM crawl_items GROUP BY crawl_id",
    "cache_latest": f"SELECT key, taken AS created_at, CAST(length(content) AS BIGINT) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY taken DESC, content DESC) AS n FROM ({_REQUESTS}) WHERE content IS NOT NULL) WHERE n = 1",
    "cache_status": f"""
WITH req AS ({_REQUESTS}),
entries AS (SELECT key, max(taken) AS created FROM req WHERE content IS NOT NULL AND taken < 1768435200 GROUP BY key),
j AS (SELECT req.*, created, greatest(0, 1768435200 - created) AS age, CASE WHEN coalesce(sensitive, false) THEN 'session-backed requests are not reusable' WHEN coalesce({_scheme('url')} NOT IN ('http', 'https'), true) THEN 'only http(s) URLs are cacheable' END AS bad FROM req LEFT JOIN entries USING (key))
SELECT page_id, CASE WHEN bad IS NOT NULL THEN 'ineligible' WHEN created IS NULL THEN 'miss' WHEN age >= 604800 THEN 'stale' ELSE 'hit' END AS cache_status, bad IS NULL AS cache_eligible,
  CASE WHEN bad IS NULL AND created IS NOT NULL THEN age END AS age_seconds, CASE WHEN bad IS NOT NULL THEN bad WHEN created IS NULL THEN 'cache entry not found' WHEN age >= 604800 THEN 'cache entry is stale' END AS cache_reason FROM j""",
    "artifacts_summary": f"SELECT count(*) AS count, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, count(*) FILTER (WHERE sensitive) AS sensitive_count, CAST(0 AS BIGINT) AS malformed_count FROM ({_RUNS})",
    "artifacts_list": f"SELECT run_id, modified, size_bytes, age_seconds, CASE WHEN age_seconds >= 86400 THEN (age_seconds // 86400) || 'd' WHEN age_seconds >= 3600 THEN (age_seconds // 3600) || 'h' WHEN age_seconds >= 60 THEN (age_seconds // 60) || 'm' ELSE age_seconds || 's' END AS age FROM ({_RUNS})",
    "prune_keep_last": f"SELECT run_id FROM ({_RANKED}) WHERE newest > 25",
    "prune_older_than": f"SELECT run_id FROM ({_RANKED}) WHERE newest > 5 AND age_seconds > 2592000",
    "prune_max_bytes": f"""
WITH c AS (SELECT *, newest <= 5 AS kept, newest > 5 AND age_seconds > 4752000 AS chosen FROM ({_RANKED})),
w AS (SELECT *, sum(CASE WHEN chosen THEN 0 ELSE size_bytes END) OVER () - coalesce(sum(CASE WHEN kept OR chosen THEN 0 ELSE size_bytes END) OVER (ORDER BY modified, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM c)
SELECT run_id FROM w WHERE chosen OR (NOT kept AND remaining > 150000)""",
    "session_compose": f"SELECT name, domain, path, value, CASE WHEN s1 = s2 THEN s1 END AS source_session FROM ({_MERGED}) WHERE value = other",
    "session_conflicts": f"SELECT name, domain, path, 'session_conflict' AS code FROM ({_MERGED}) WHERE value <> other",
    "session_filter": f"SELECT domain, count(*) AS cookies FROM ({_COOKIES}) WHERE domain = 'example' OR domain = 'test' OR domain LIKE '%.example' OR domain LIKE '%.test' GROUP BY domain",
    "session_inspect": f"SELECT session, '<redacted>' AS value, count(*) AS cookies FROM ({_COOKIES}) GROUP BY session",
    "replay_scope": f"""
WITH req AS (SELECT DISTINCT batch_id, item_index, url, 's' || (batch_id % 7) AS session FROM batch_items),
state AS (SELECT DISTINCT session, domain FROM ({_COOKIES})),
j AS (SELECT req.*, domain, domain IS NOT NULL AND {_host('url')} IS NOT NULL AND ({_host('url')} = domain OR {_host('url')} LIKE '%.' || domain) AS covers FROM req LEFT JOIN state USING (session))
SELECT batch_id, item_index, url, session, CASE WHEN {_host('url')} IS NULL THEN 'usage_error' WHEN count(domain) = 0 OR count(*) FILTER (WHERE covers) < count(domain) THEN 'session_scope_mismatch' END AS scope_error FROM j GROUP BY batch_id, item_index, url, session""",
    "redact_titles": "SELECT doc_id, replace(replace(replace(replace(replace(replace(text, 'token%20%26%20budget', '<redacted>'), 'token+%26+budget', '<redacted>'), 'library%20card', '<redacted>'), 'token & budget', '<redacted>'), 'library card', '<redacted>'), 'library+card', '<redacted>') AS text FROM documents WHERE text IS NOT NULL",
    "authorize_predicates": "SELECT page_id, contains(coalesce(content, ''), 'the') AND NOT contains(coalesce(content, ''), 'Access denied') AS verified FROM source_pages",
    "plan_validation": "SELECT text <> '' AS ok, count(*) AS plans FROM (SELECT DISTINCT url, coalesce(text, '') AS text FROM links WHERE url IS NOT NULL) GROUP BY 1",
}

# -- URLs in normal form --------------------------------------------------------------


def _ascii(text: str) -> str:
    """``text`` with characters beyond ASCII percent-encoded."""
    return f"list_aggregate(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) > 127 THEN url_encode(c) ELSE c END), 'string_agg', '')"


def _origin(u: str) -> str:
    port = f"regexp_extract({u}, {_URL}, 3)"
    return f"{_scheme(u)} || '://' || {_host(u)} || CASE WHEN {port} IN ('', CASE {_scheme(u)} WHEN 'https' THEN '443' ELSE '80' END) THEN '' ELSE ':' || {port} END"


def _normal(u: str) -> str:
    return f"CASE WHEN {_host(u)} IS NOT NULL THEN {_origin(u)} || {_path(u)} || regexp_extract({u}, '^[^?#]*([?][^#]*)', 1) || regexp_extract({u}, '(#.*)$', 1) END"


def _redacted(u: str) -> str:
    return f"CASE WHEN {_host(u)} IS NULL THEN '<redacted>' ELSE {_origin(u)} || {_path(u)} || CASE WHEN regexp_matches({u}, '^[^#]*[?]') THEN '?%3Credacted%3E' ELSE '' END || CASE WHEN contains({u}, '#') THEN '#%3Credacted%3E' ELSE '' END END"


def _joined(base: str, href: str) -> str:
    """Links of the tables are absolute, or start at the root of their site."""
    return f"CASE WHEN starts_with({href}, '/') AND {_host(base)} IS NOT NULL THEN {_origin(base)} || {_ascii(href)} ELSE coalesce({_normal(href)}, {href}) END"


def _plain(html: str) -> str:
    """Text of a piece of markup without elements within."""
    return f"replace(replace({html}, '&lt;', '<'), '&gt;', '>')"


_IS_HTML = "(content_format = 'html' OR contains(content, '<html') OR contains(content, '<table') OR contains(content, '<a ') OR contains(content, '<dl'))"
_TEXTS = "content IS NOT NULL AND content_format IN ('markdown', 'text', 'html')"
_BARE = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_LAST = "coalesce(final_url, url)"
#: Links of html pages in order: page, its address, place, target and text.
_ANCHORS = f"SELECT page_id, base, unnest(range(len(a))) AS pos, regexp_extract(unnest(a), 'href=\"([^\"]*)\"', 1) AS href, trim({_plain("regexp_extract(unnest(a), '>([^<]*)</a>', 1)")}, {_BARE}) AS text FROM (SELECT page_id, {_LAST} AS base, regexp_extract_all(content, '<a [^>]*>[^<]*</a>') AS a FROM source_pages WHERE content IS NOT NULL AND content_format = 'html')"
_MAPPED = f"SELECT page_id, base, {_origin('base')} || {_ascii('href')} AS url, text, pos FROM ({_ANCHORS}) WHERE {_host('base')} IS NOT NULL"
_FNV = "lpad(lower(to_hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(CAST(octet_length(encode(t)) AS BIGINT)), lambda i: CAST(('0x' || substring(hex(encode(t)), i * 2 + 1, 2)) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS UBIGINT))), 16, '0')"
_MANIFEST = f"SELECT batch_id, item_index, url, CASE WHEN again THEN 'skipped' ELSE 'pending' END AS status, CASE WHEN again THEN 'duplicate' END AS reason FROM ({_DEDUPED})"
_STORAGE = f"SELECT 's' || (length(source_url) % 5) AS session, {_scheme('url')} || '://' || {_host('url')} AS origin, 'local' AS kind, coalesce({_type(_path('url'))}, 'none') AS name, coalesce({_prefix(_path('url'))}, '') AS value FROM links WHERE url IS NOT NULL AND source_url IS NOT NULL"
_STORED = f"SELECT origin, kind, name, min(value) AS value, max(value) AS other, min(session) AS s1, max(session) AS s2 FROM ({_STORAGE}) GROUP BY origin, kind, name"
_KEPT = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY pos) AS r FROM (SELECT *, row_number() OVER (PARTITION BY source_url, url ORDER BY pos) AS n FROM ({_LINKS})) WHERE n = 1 AND {_same_origin('source_url', 'url')}) WHERE r <= 5"
_EVENTS = "SELECT crawl_id AS run, item_index AS pos, min(url) AS url, min(depth) AS depth, CASE min(depth) WHEN 1 THEN 'Page.frameScheduledNavigation' WHEN 3 THEN 'Page.javascriptDialogOpening' ELSE 'Page.loadEventFired' END AS method FROM crawl_items WHERE url IS NOT NULL AND crawl_id IS NOT NULL AND item_index IS NOT NULL GROUP BY crawl_id, item_index"
_TRACKED = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos) AS n FROM ({_EVENTS}) WHERE method <> 'Page.loadEventFired') WHERE n <= 64"
_TEST_SITE = "(domain = 'test' OR domain LIKE '%.test')"
_MD_LINES = f"SELECT page_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT page_id, string_split(content, chr(10)) AS ls FROM source_pages WHERE {_TEXTS} AND NOT {_IS_HTML})"


def _row(line: str) -> str:
    return f"trim(trim({line}, {_BARE}), '|')"


_PRETTY = """
SELECT batch_id, CAST(1 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts, count(*) AS items,
  '{' || chr(10) || '  "summary" : {' || chr(10) || '    "requested" : ' || count(*) || ',' || chr(10) || '    "succeeded" : 0,' || chr(10) || '    "failed" : 0,' || chr(10) || '    "skipped" : ' || count(*) FILTER (WHERE status = 'skipped') || chr(10) || '  },' || chr(10) || '  "items" : [ '
  || string_agg('{' || chr(10) || CASE WHEN item_index IS NULL THEN '' ELSE '    "index" : ' || item_index || ',' || chr(10) END || CASE WHEN url IS NULL THEN '' ELSE '    "url" : ' || to_json(url) || ',' || chr(10) END || '    "status" : "' || status || '"' || CASE WHEN reason IS NULL THEN '' ELSE ',' || chr(10) || '    "reason" : "' || reason || '"' END || chr(10) || '  }', ', ' ORDER BY item_index NULLS FIRST) || ' ]' || chr(10) || '}' AS manifest_json,
  string_agg('- ' || status || ' `' || coalesce(url, '') || '`', chr(10) ORDER BY item_index NULLS FIRST) AS manifest_md
"""

ORACLES |= {
    "page_metadata": "SELECT page_id, name, CASE name WHEN 'title' THEN nullif(trim(regexp_extract(content, '(?is)<title[^>]*>(.*?)</title>', 1)), '') ELSE nullif(trim(regexp_extract(content, '(?i)<meta name=.' || name || '. content=.([^>]*).>', 1)), '') END AS value FROM source_pages, (VALUES ('title'), ('description'), ('keywords'), ('author')) AS n(name) WHERE content_format = 'html' AND content IS NOT NULL",
    "map_links": f"SELECT page_id, url, text, base AS source_url, true AS same_origin, {_same_path('url', 'base')} AS same_path, {_type(_path('url'))} AS content_type FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS n FROM ({_MAPPED})) WHERE n = 1",
    "map_summary": f"""
WITH firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS n FROM ({_MAPPED})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM firsts WHERE n = 1),
counts AS (SELECT page_id, count(*) AS emitted, max(pos) FILTER (WHERE r = 5) AS last FROM ranked WHERE r <= 5 GROUP BY page_id)
SELECT p.page_id, coalesce(c.last + 1, (SELECT count(*) FROM ({_MAPPED}) m WHERE m.page_id = p.page_id)) AS discovered, coalesce(c.emitted, 0) AS emitted, c.last IS NOT NULL AS truncated
FROM source_pages p LEFT JOIN counts c USING (page_id) WHERE p.content_format = 'html' AND p.content IS NOT NULL""",
    "search_report": _TOPK.replace("AND NOT coalesce(sensitive, false)", "").replace("SELECT artifact_id, CAST(rank AS BIGINT) AS rank, section_id, score,\n  trim(", "SELECT artifact_id, string_agg('## ' || heading || ' (' || section_id || ')' || chr(10) || chr(10) || trim(").replace("'g')) AS snippet,\n  CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end\n", "'g')), chr(10) || chr(10) ORDER BY rank) AS report\n") + " GROUP BY artifact_id",
    "extract_headings": rf"""
WITH lines AS ({_MD_LINES})
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, CAST(length(regexp_extract(line, '^{_WS}*(#+)', 1)) AS BIGINT) AS level, trim(regexp_replace(line, '^{_WS}*#+', ''), {_BARE}) AS text
FROM lines WHERE regexp_matches(line, '^{_WS}*#{{1,6}} ')
UNION ALL
SELECT page_id, unnest(range(len(h))) AS pos, CAST(substring(unnest(h), 3, 1) AS BIGINT) AS level, trim({_plain("regexp_extract(unnest(h), '>([^<]*)<', 1)")}, {_BARE}) AS text
FROM (SELECT page_id, regexp_extract_all(content, '<h[1-6]>[^<]*</h[1-6]>') AS h FROM source_pages WHERE {_TEXTS} AND {_IS_HTML})""",
    "extract_links": rf"""
WITH found AS (SELECT page_id, {_LAST} AS base, regexp_extract_all(content, '(?s)\[.*?\]\(.*?\)') AS a FROM source_pages WHERE {_TEXTS} AND NOT {_IS_HTML}),
parts AS (SELECT page_id, base, unnest(range(len(a))) AS i, trim(regexp_extract(unnest(a), '(?s)^\[(.*)\]\(', 1), {_BARE}) AS text, trim(regexp_extract(unnest(a), '(?s)\]\((.*)\)$', 1), {_BARE}) AS href FROM found)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, text, {_joined('base', 'href')} AS url FROM parts WHERE text <> '' AND href <> ''
UNION ALL SELECT page_id, pos, text, {_joined('base', 'href')} AS url FROM ({_ANCHORS})""",
    "extract_tables": rf"""
WITH lines AS (SELECT *, contains(line, '|') AND contains({_row('line')}, '|') AS is_row, contains({_row('line')}, '|') AND len(list_filter(string_split({_row('line')}, '|'), lambda c: NOT contains(c, '-') OR trim(c, '-: ') <> '')) = 0 AS is_rule FROM ({_MD_LINES})),
heads AS (SELECT *, is_row AND lead(is_rule) OVER w AS starts, NOT is_row AS stops FROM lines WINDOW w AS (PARTITION BY page_id ORDER BY i)),
blocks AS (SELECT *, sum(CASE WHEN stops THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS block FROM heads),
first_ AS (SELECT page_id, block, min(i) AS head FROM blocks WHERE starts AND is_row GROUP BY page_id, block),
tabs AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY head) - 1 AS pos FROM first_),
cells AS (SELECT t.page_id, t.pos, b.i - t.head - 2 AS row, list_transform(string_split({_row('b.line')}, '|'), lambda c: trim(c, {_BARE})) AS vals, list_transform(string_split({_row('h.line')}, '|'), lambda c: trim(c, {_BARE})) AS names
  FROM tabs t JOIN blocks b ON b.page_id = t.page_id AND b.block = t.block AND b.is_row AND b.i >= t.head + 2 JOIN blocks h ON h.page_id = t.page_id AND h.i = t.head),
html AS (SELECT page_id, unnest(range(len(t))) AS pos, regexp_extract_all(unnest(t), '(?s)<tr>.*?</tr>') AS rows FROM (SELECT page_id, regexp_extract_all(content, '(?s)<table>.*?</table>') AS t FROM source_pages WHERE {_TEXTS} AND {_IS_HTML})),
trs AS (SELECT page_id, pos, unnest(range(len(rows))) AS row, regexp_extract_all(unnest(rows), '<td>([^<]*)</td>', 1) AS vals FROM html)
SELECT page_id, pos, row, unnest(names) AS name, unnest(list_transform(range(len(names)), lambda k: coalesce(vals[k + 1], ''))) AS value FROM cells
UNION ALL
SELECT page_id, pos, row, unnest(list_transform(range(len(vals)), lambda k: 'column_' || (k + 1))) AS name, unnest(list_transform(vals, lambda v: trim({_plain('v')}, {_BARE}))) AS value FROM trs""",
    "extract_definitions": rf"""
WITH lines AS (SELECT page_id, i, trim(line, {_BARE}) AS line FROM ({_MD_LINES})),
parts AS (SELECT page_id, i, trim(split_part(line, ':', 1), {_BARE}) AS term, trim(substring(line, instr(line, ':') + 1), {_BARE}) AS definition FROM lines WHERE contains(line, ':'))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, term, definition FROM parts WHERE term <> '' AND definition <> '' AND strlen(term) <= 80 AND NOT contains(term, '://') AND NOT starts_with(term, '#')""",
    "extract_selector": f"SELECT page_id, nullif(trim({_plain("regexp_extract(content, '<h1>([^<]*)</h1>', 1)")}, {_BARE}), '') AS title, array_to_string(regexp_extract_all(content, '<a [^>]*href=\"([^\"]*)\"', 1), ' ') AS targets FROM source_pages WHERE content_format = 'html' AND content IS NOT NULL",
    "batch_manifest": f"{_PRETTY} FROM ({_MANIFEST}) GROUP BY batch_id",
    "batch_manifest_lines": f"SELECT batch_id, item_index AS index, '- ' || status || ' `' || url || '`' AS item_md FROM ({_MANIFEST})",
    "cache_keys": f"SELECT page_id, {_FNV} AS key FROM (SELECT page_id, 'v' || chr(0) || '1' || chr(0) || 'url' || chr(0) || url || chr(0) || 'format' || chr(0) || 'text' || chr(0) AS t FROM source_pages WHERE url IS NOT NULL)",
    "artifacts_inspect": f"SELECT run_id, CASE WHEN coalesce(sensitive, false) THEN {_redacted('url')} ELSE url END AS url, sensitive FROM ({_RUNS})",
    "cookie_header": f"""
WITH req AS (SELECT DISTINCT url, 's' || (batch_id % 7) AS session FROM batch_items WHERE url IS NOT NULL),
held AS (SELECT name, domain, value, CASE WHEN s1 = s2 THEN s1 ELSE 's0' END AS session FROM ({_MERGED}) WHERE value = other)
SELECT req.url, req.session, string_agg(name || '=' || value, '; ' ORDER BY domain, name) AS cookie_header
FROM req LEFT JOIN held ON req.session = held.session AND {_scheme('req.url')} = 'https' AND ({_host('req.url')} = domain OR {_host('req.url')} LIKE '%.' || domain) GROUP BY req.url, req.session""",
    "envelope": """SELECT page_id, '{"ok":true,"schema_version":"pagelake.envelope.v1","command":"get","data":{' || concat_ws(',', '"url":' || CAST(to_json(url) AS VARCHAR), CASE WHEN NOT coalesce(sensitive, false) THEN '"content":' || CAST(to_json(content) AS VARCHAR) END) || '},"warnings":[],"timing_ms":{"total":0}}' AS envelope FROM source_pages""",
    "redact_urls": f"SELECT page_id, {_redacted('url')} AS url FROM source_pages WHERE url IS NOT NULL",
    "normal_urls": f"SELECT DISTINCT url, {_normal('url')} AS normal FROM links WHERE url IS NOT NULL",
    "storage_compose": f"SELECT origin, kind, name, value, CASE WHEN s1 = s2 THEN s1 END AS source_session FROM ({_STORED}) WHERE value = other",
    "storage_conflicts": f"SELECT origin, kind, name, 'session_conflict' AS code FROM ({_STORED}) WHERE value <> other",
    "storage_filter": f"SELECT origin, count(*) AS entries FROM ({_STORAGE}) WHERE origin LIKE '%.example' OR origin LIKE '%://docs.bobabe.invalid' GROUP BY origin",
    "login_merge": f"SELECT session, domain, count(*) AS cookies FROM ({_COOKIES}) WHERE session = 's0' OR NOT {_TEST_SITE} GROUP BY session, domain",
    "login_merge_storage": f"SELECT session, origin, count(*) AS entries FROM ({_STORAGE}) WHERE session = 's0' OR origin NOT LIKE '%.test' GROUP BY session, origin",
    "cookie_events": f"SELECT name, domain, CASE WHEN length(value) > 2 THEN length(value) - 2 END AS expires, false AS http_only, true AS secure, count(*) AS cookies FROM ({_COOKIES}) WHERE name IS NOT NULL GROUP BY name, domain, expires",
    "cookie_records": f"""SELECT '{{' || CASE WHEN name IS NULL THEN '' ELSE '"name":' || CAST(to_json(name) AS VARCHAR) || ',' END || '"value":' || CAST(to_json(value) AS VARCHAR) || ',"domain":' || CAST(to_json(domain) AS VARCHAR) || ',"path":"/","httpOnly":false,"secure":true}}' AS cookie, count(*) AS rows FROM ({_COOKIES}) GROUP BY cookie""",
    "cookie_dedupe": f"SELECT name, domain, '/' AS path, min(session) AS session, min_by(value, session || chr(1) || value) AS value FROM ({_COOKIES}) GROUP BY name, domain",
    "candidate_origins": f"SELECT DISTINCT batch_id, origin FROM (SELECT batch_id, unnest(['https://' || {_host('url')}, 'http://' || {_host('url')}, 'https://extra.example']) AS origin FROM batch_items WHERE url IS NOT NULL) WHERE origin IS NOT NULL",
    "login_domains": f"SELECT page_id, unnest(CASE WHEN starts_with(h, 'www.') THEN [substring(h, 5), h] ELSE [h] END) AS domain FROM (SELECT page_id, {_host('url')} AS h, {_scheme('url')} AS s FROM source_pages) WHERE s = 'https' AND h IS NOT NULL",
    "import_domains": f"SELECT page_id, (h = root OR h LIKE '%.' || root) AS plain, h = root AS dotted FROM (SELECT page_id, {_host('url')} AS h, regexp_extract({_host('url')}, '([^.]+[.][^.]+)$', 1) AS root FROM source_pages) WHERE h IS NOT NULL",
    "import_cookies": f"SELECT name, domain, '/' AS path, min(value) AS value, CASE WHEN name IS DISTINCT FROM 'c1' THEN CAST(1800000000 AS BIGINT) END AS expires, true AS http_only FROM ({_COOKIES}) WHERE {_TEST_SITE} OR domain = 'docs.bobabe.invalid' OR domain LIKE '%.docs.bobabe.invalid' GROUP BY name, domain HAVING min(value) = max(value)",
    "browser_events": f"SELECT run, pos, method FROM ({_TRACKED})",
    "browser_hazards": f"SELECT run, min(pos) AS pos, min_by(code, pos) AS code, min_by(method, pos) AS method FROM (SELECT *, CASE WHEN method = 'Page.javascriptDialogOpening' THEN 'requires_confirmation' WHEN {_scheme('url')} IS NOT NULL AND NOT {_same_origin('url', chr(39) + 'https://docs.bobabe.invalid/' + chr(39))} THEN 'navigation_blocked' END AS code FROM ({_TRACKED})) WHERE code IS NOT NULL GROUP BY run",
    "browser_targets": "SELECT batch_id AS run, 't' || min_by(item_index, CASE WHEN u IN ('', 'about:blank') THEN 1000000000 ELSE 0 END + item_index) AS target_id FROM (SELECT batch_id, item_index, min(coalesce(url, '')) AS u FROM batch_items WHERE item_index IS NOT NULL AND batch_id IS NOT NULL GROUP BY batch_id, item_index) WHERE item_index % 3 <> 0 AND NOT regexp_matches(u, '^(chrome|chrome-extension|devtools)://') GROUP BY batch_id",
    "screenshot_warnings": "SELECT page_id, CAST(CASE WHEN content_format = 'json' THEN 1 ELSE 0 END AS BIGINT) AS warnings FROM source_pages",
    "action_rows": "WITH i AS (SELECT crawl_id, item_index, max(status) AS status FROM crawl_items WHERE crawl_id IS NOT NULL AND item_index IS NOT NULL GROUP BY crawl_id, item_index), f AS (SELECT crawl_id, min(item_index) AS stop FROM i WHERE status = 'failed' GROUP BY crawl_id) SELECT crawl_id, item_index, status FROM i LEFT JOIN f USING (crawl_id) WHERE stop IS NULL OR item_index <= stop",
    "plan_dry_run": "SELECT artifact_id, unnest([CAST(0 AS BIGINT), 1]) AS index, 'wait' AS type, 'planned' AS status FROM source_artifacts",
    "plan_redaction": "SELECT artifact_id, NOT coalesce(sensitive, false) AS ok, CASE WHEN coalesce(sensitive, false) THEN '<redacted>' ELSE word END AS text, CASE WHEN coalesce(sensitive, false) THEN length(word) END AS text_chars FROM (SELECT *, regexp_extract(coalesce(url, ''), '/([a-z]+)-', 1) AS word FROM source_artifacts)",
    "consent_checks": "SELECT CASE WHEN depth = 1 AND status IS DISTINCT FROM 'failed' THEN 'the open tab needs the port of its browser' WHEN depth = 1 THEN 'the open tab may show private content, which must be allowed' WHEN status = 'failed' THEN 'a port belongs to the open tab only' WHEN depth = 2 THEN 'sessions may show private content, which must be allowed' END AS consent_error, count(*) AS rows FROM crawl_items WHERE crawl_id IS NOT NULL GROUP BY 1",
    "safe_errors": "SELECT CASE WHEN error IS NOT NULL AND coalesce(batch_id % 2 = 0, false) THEN 'extraction failed for a session-backed request' ELSE error END AS message, count(*) AS rows FROM batch_items GROUP BY 1",
    "secrets": f"WITH c AS ({_COOKIES}), s AS ({_STORAGE}) SELECT DISTINCT session, secret FROM (SELECT session, value AS secret FROM c UNION ALL SELECT session, value FROM s) WHERE secret <> '' AND session IN (SELECT session FROM c) AND session IN (SELECT session FROM s)",
    "artifacts_delete": f"SELECT run_id FROM ({_RUNS}) WHERE run_id NOT IN ('run-1', 'run-7', 'run-100')",
    "cache_store": f"""
WITH e AS (SELECT key, taken, content, taken < 1768435200 AS old FROM ({_REQUESTS})),
best AS (SELECT *, row_number() OVER (PARTITION BY key, old ORDER BY taken DESC, content DESC) AS n FROM e WHERE content IS NOT NULL)
SELECT key, taken AS created_at, CAST(length(content) AS BIGINT) AS chars FROM best b WHERE n = 1 AND (NOT old OR key NOT IN (SELECT key FROM e WHERE NOT old))""",
    "extract_provenance": f"SELECT page_id, unnest([CAST(0 AS BIGINT), 1]) AS pos, unnest(['site', 'heads']) AS field, unnest(['metadata', 'headings']) AS kind, {_LAST} AS source_url, unnest(['$.site', NULL]) AS path FROM source_pages WHERE {_TEXTS}",
    "metadata_records": """SELECT artifact_id, '{"artifact_id":' || artifact_id || ',"sensitive":' || coalesce(CAST(sensitive AS VARCHAR), 'null') || ',"url":' || coalesce(CAST(to_json(url) AS VARCHAR), 'null') || '}' AS record FROM source_artifacts""",
    "error_records": """SELECT DISTINCT batch_id, item_index, '{"ok":false,"error":{"code":"extraction_failed"' || CASE WHEN status IS NULL THEN '' ELSE ',"message":' || CAST(to_json(status) AS VARCHAR) END || '},"usage":{"content_bytes":0,"estimated_tokens":0},"limits":{"truncated":false,"chars_before":0,"chars_after":0},"cache":{"status":"disabled","eligible":false}}' AS record FROM batch_items WHERE error IS NOT NULL""",
    "debug_traces": """SELECT artifact_id, '{"schema_version":"pagelake.debug_trace.v1","artifact_id":' || artifact_id || CASE WHEN sensitive IS NULL THEN '' ELSE ',"sensitive":' || sensitive END || '}' AS trace FROM source_artifacts""",
    "run_ids": "SELECT artifact_id, 'run-' || left(sha256(artifact_id || chr(1) || coalesce(url, '')), 16) || '-get' AS run_id FROM source_artifacts",
    "content_files": "SELECT artifact_id, sha256(c) AS digest, CAST(strlen(c) AS BIGINT) AS bytes FROM (SELECT artifact_id, CASE WHEN suffix(content, chr(10)) THEN content ELSE content || chr(10) END AS c FROM source_artifacts WHERE content IS NOT NULL)",
    "links_report": f"SELECT source_url, string_agg('- [' || CASE WHEN text = '' THEN url ELSE text END || '](' || url || ')', chr(10) ORDER BY url) AS report FROM ({_KEPT}) GROUP BY source_url",
    "links_report_json": f"SELECT source_url, row_number() OVER (PARTITION BY source_url ORDER BY url) - 1 AS pos, url, text, true AS same_origin, {_same_path('url', 'source_url')} AS same_path, {_type(_path('url'))} AS content_type FROM ({_KEPT})",
    "records_report": f"""SELECT page_id, '## ' || {_LAST} || chr(10) || chr(10) || '```json' || chr(10) || '{{"status": ' || coalesce(CAST(json_extract(content, '$.status') AS VARCHAR), 'null') || '}}' || chr(10) || '```' AS report, json_extract_string(content, '$.status') AS status FROM source_pages WHERE content_format = 'json' AND content IS NOT NULL""",
    "batch_unsupported": f"SELECT batch_id, item_index, url FROM ({_BATCH}) WHERE url IS NULL OR NOT (starts_with(url, 'file://') OR starts_with(url, 'raw:') OR coalesce({_scheme('url')} IN ('http', 'https') AND {_host('url')} IS NOT NULL, false))",
    "url_list": f"SELECT row_number() OVER (ORDER BY batch_id, item_index) - 1 AS index, trim(url, {_BARE}) AS url FROM ({_BATCH}) WHERE trim(url, {_BARE}) <> '' AND NOT starts_with(trim(url, {_BARE}), '#')",
    "glob_matches": "SELECT DISTINCT url, contains(url, '/docs/') AS inside, suffix(url, '.pdf') AS ends, contains(url, 'guide') AS holds FROM links WHERE url IS NOT NULL",
    "crawl_scope": f"SELECT DISTINCT u AS url, coalesce({_host('u')} IS NOT NULL AND ({_same_origin('u', chr(39) + 'https://docs.bobabe.invalid/' + chr(39))} OR {_host('u')} = 'katroko.test' OR {_host('u')} LIKE '%.katroko.test') AND starts_with({_path('u')}, '/guide/') AND NOT contains(u, '.pdf'), false) AS admitted FROM (SELECT regexp_replace(url, '#.*$', '') AS u FROM links WHERE url IS NOT NULL)",
    "crawl_manifest": """
WITH i AS (SELECT item_index, min(url) AS url, min(depth) AS depth, min(status) AS status FROM crawl_items WHERE item_index IS NOT NULL AND crawl_id = (SELECT min(crawl_id) FROM crawl_items WHERE item_index IS NOT NULL) GROUP BY item_index ORDER BY item_index LIMIT 100)
SELECT '# Crawl' || chr(10) || chr(10) || 'Start: https://docs.bobabe.invalid/' || chr(10) || 'Fetched: ' || count(*) || chr(10) || 'Succeeded: ' || count(*) FILTER (WHERE status = 'ok') || chr(10) || 'Failed: ' || count(*) FILTER (WHERE status = 'failed') || chr(10) || chr(10) || coalesce(string_agg('- ' || status || ' depth=' || depth || ' `' || url || '`' || chr(10), '' ORDER BY item_index), '') AS manifest_md FROM i""",
    "stored_runs": "SELECT artifact_id, CAST(length(content) AS BIGINT) AS chars FROM source_artifacts WHERE content IS NOT NULL AND artifact_id % 5 <> 0 AND artifact_id % 4 <> 0 AND NOT coalesce(sensitive, false)",
    "manifest_items": f"SELECT batch_id * 1000000 + item_index AS index, CASE WHEN (batch_id * 1000000 + item_index) % 3 <> 0 THEN CAST(length(url) AS VARCHAR) END AS content, CASE WHEN (batch_id * 1000000 + item_index) % 3 = 0 THEN 'missing' END AS error FROM ({_BATCH}) WHERE url IS NOT NULL AND item_index IS NOT NULL",
    "stream_extract": "SELECT page_id, content IS NOT NULL AS ok, CAST(strlen(content) AS BIGINT) AS source_bytes FROM source_pages WHERE content_format = 'html'",
    "stream_dedupe": "SELECT DISTINCT url FROM source_pages WHERE arrived_at IS NOT NULL",
    "stream_windows": "SELECT date_trunc('day', arrived_at) AS start, count(*) AS pages FROM source_pages WHERE arrived_at IS NOT NULL GROUP BY 1",
    "prune_result": f"SELECT run_id, size_bytes, 'would_delete' AS action FROM ({_RANKED}) WHERE newest > 25",
    "file_entries": """
WITH r AS (SELECT 'run-' || artifact_id AS run_id, artifact_id % 3 = 0 AS away, artifact_id % 4 <> 0 AS there, CAST(coalesce(strlen(content), 0) AS BIGINT) AS size FROM source_artifacts)
SELECT run_id, '/store/' || run_id || '/metadata.json' AS path, 'metadata' AS kind, 'internal' AS ownership, false AS exists, CAST(0 AS BIGINT) AS size_bytes FROM r
UNION ALL SELECT run_id, CASE WHEN away THEN '/other/./' || run_id ELSE '/store/' || run_id || '/content.md' END, 'content', CASE WHEN away THEN 'external' ELSE 'internal' END, there, CASE WHEN there THEN size ELSE 0 END FROM r
UNION ALL SELECT run_id, '/store/' || run_id || '/../trace.json', 'debug', 'external', false, 0 FROM r""",
    "finalize": "SELECT artifact_id, left(content, 40) AS start, CAST(length(content) AS BIGINT) AS chars_before, CAST(ceil(least(length(content), 500) / 4.0) AS BIGINT) AS tokens, NOT coalesce(sensitive, false) AS inline, CAST(strlen(content) AS BIGINT) AS traced FROM source_artifacts WHERE content IS NOT NULL",
    "extract_actions": "SELECT page_id, page_id % 3 <> 0 AND page_id % 5 <> 0 AS ok, CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN 'Seen' END AS content, CASE WHEN page_id % 3 = 0 THEN 'selector_not_found' WHEN page_id % 5 = 0 THEN 'extraction_failed' END AS code FROM source_pages WHERE content_format = 'html' AND content IS NOT NULL",
    # the same rows as long as the crawl runs out of links before it reaches its limit of 100 pages
    "crawl_replay": f"""
WITH RECURSIVE t AS ({_LINKS}),
start AS (SELECT regexp_replace(source_url, '#.*$', '') AS url FROM t GROUP BY source_url ORDER BY count(*) DESC, source_url LIMIT 1),
found AS (SELECT regexp_replace(url, '#.*$', '') AS url, min(coalesce(final_url, regexp_replace(url, '#.*$', ''))) AS final_url FROM source_pages WHERE url IS NOT NULL GROUP BY 1),
edges AS (SELECT source_url, url, row_number() OVER (PARTITION BY source_url ORDER BY pos, url) AS place FROM (SELECT regexp_replace(source_url, '#.*$', '') AS source_url, url, min(pos) AS pos FROM t WHERE {_host('url')} IS NOT NULL GROUP BY 1, 2)),
walk AS (
  SELECT url, CAST(0 AS BIGINT) AS depth, CAST(NULL AS VARCHAR) AS source_url, [CAST(0 AS BIGINT)] AS path FROM start
  UNION ALL
  SELECT e.url, w.depth + 1, w.url, list_append(w.path, e.place) FROM walk w JOIN found USING (url) JOIN edges e ON e.source_url = w.url WHERE w.depth < 5),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY depth, path) AS n FROM walk) WHERE n = 1)
SELECT row_number() OVER (ORDER BY depth, path) - 1 AS index, f.url, found.final_url, depth, source_url, CASE WHEN found.url IS NULL THEN 'failed' ELSE 'ok' END AS status, CASE WHEN found.url IS NULL THEN 'page not found' END AS error
FROM firsts f LEFT JOIN found USING (url)""",
}
