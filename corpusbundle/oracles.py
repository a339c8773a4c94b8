"""The same results as plain SQL, written independently of the operators."""

from __future__ import annotations

_FILES = """
files AS (
  SELECT doc_id, source, text AS content,
         source || CASE WHEN doc_id % 5 = 0 THEN '-x' ELSE '' END || '/'
         || CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || lang || '/' || doc_id || '.'
         || CASE doc_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' WHEN 2 THEN 'go' ELSE 'json' END
           AS rel_path
  FROM documents
),
parts AS (
  SELECT *, split_part(rel_path, '/', 1) AS top, split_part(rel_path, '/', 2) AS mid,
         split_part(rel_path, '/', 3) AS base, split_part(rel_path, '.', -1) AS ext
  FROM files
)"""

_TREE = """
tree AS (
  SELECT top || '/' || mid || '/'
         || CASE WHEN doc_id % 3 = 0 THEN '_' WHEN doc_id % 11 = 0 THEN '.' ELSE '' END || base AS tree_path,
         mid, ext, coalesce(content, '') AS content, strlen(coalesce(content, ''))::BIGINT AS size
  FROM parts
)"""

_IGNORED = """(top = 'src1' OR base LIKE '%9%.txt' OR top = 'src2'
  OR (top = 'src3' AND mid = 'en') OR (top = 'src4' AND mid IN ('en')))"""
_GENERATED = "(base LIKE '%7.go' OR (mid LIKE '%de' AND base LIKE '1%' AND ext = 'md'))"
_NOTE = f"CASE WHEN {_GENERATED} THEN ' (Code-generated, Read-only)' ELSE '' END"

_SECTIONS = f"""{_FILES},
sections AS (
  SELECT rel_path, source, string_split(rel_path, '/') AS segments,
         '# File: ' || rel_path || {_NOTE} || chr(10) || chr(10) || '```' || ext || chr(10)
         || content || '```' || chr(10) || chr(10) AS section
  FROM parts
  WHERE ext IN ('md', 'txt', 'go') AND mid NOT LIKE '.%' AND NOT {_IGNORED}
)"""

_HOST = r"regexp_extract(url, '^https?://([^/]+)', 1)"
_PATH = r"regexp_extract(url, '^https?://[^/]+([^?#]*)', 1)"
_LOCATED = f"""
located AS (
  SELECT page_id, url, html, {_HOST} AS host, {_PATH} AS path FROM pages
),
hosts AS (SELECT DISTINCT host FROM located),
allowed AS (
  SELECT *, 'https://' || host AS base_url,
         (starts_with(path, '/en') OR starts_with(path, '/fr')) AND NOT starts_with(path, '/en/9')
           AS allowed
  FROM located
),
latest AS (
  SELECT * FROM allowed WHERE allowed
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1
)"""
_CSS = """CASE WHEN starts_with(path, '/fr/1') THEN 'article' WHEN starts_with(path, '/fr') THEN 'h1'
  WHEN starts_with(path, '/en/2') THEN 'nav' ELSE 'article' END"""


def _dashed(text: str) -> str:
    return f"trim(regexp_replace({text}, '[^a-zA-Z0-9]+', '-', 'g'), '-')"


def _underscored(text: str) -> str:
    cleaned = f"trim(regexp_replace({text}, '[^a-zA-Z0-9_-]+', '_', 'g'), '_')"
    return f"coalesce(nullif({cleaned}, ''), 'untitled')"


def _offsets(keys: str, order: str, size: str, source: str, gap: int = 0) -> str:
    """Byte position of every row in its document, from one window per document."""
    by = f"PARTITION BY {keys} " if keys else ""
    return f"""
placed AS (
  SELECT *, row_number() OVER ({by}ORDER BY {order}) - 1 AS n,
         coalesce(sum({size}) OVER ({by}ORDER BY {order}
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raw_at
  FROM {source}
),
parted AS (
  SELECT *, CAST(greatest(raw_at - {gap}, 0) AS BIGINT) AS first_byte,
         CAST(greatest(raw_at - {gap}, 0) // 65536 AS BIGINT) AS part_no
  FROM placed
)"""


def _trimmed_lines(text: str) -> str:
    return f"""trim(array_to_string(list_transform(
    string_split({text}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), chr(10)), chr(10))"""


_TITLED = """
titled AS (
  SELECT *, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM latest
)"""


def _by_path(sources: str, pages: str, content: str, names: str) -> str:
    """Documents per site and matched path from rows (base_url, host, path, url, content)."""
    keys = "base_url, prefix, matched_path"
    return f"""
WITH {sources},
grouped AS (
  SELECT *, CASE WHEN starts_with(path, '/en') THEN '/en' ELSE '/fr' END AS matched_path,
         CASE WHEN host LIKE 'blog.%' THEN '' ELSE {_dashed("host")} END AS prefix
  FROM {pages}
),
filled AS (
  SELECT * FROM grouped
  QUALIFY bool_or(regexp_matches({content}, '\\S')) OVER (PARTITION BY {keys})
),
{_offsets(keys, "url", f"strlen({content}) + 2", "filled", gap=2)},
named AS (
  SELECT {keys}, CASE WHEN prefix = '' THEN 'doc' ELSE prefix END || '-' || substr(matched_path, 2) AS stem
  FROM (SELECT DISTINCT {keys} FROM grouped)
),
files AS (
  SELECT *, stem || CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN '-' || substr(sha256(
    '{{"base_url":"' || base_url || '","prefix":"' || prefix || '","matched_path":"' || matched_path || '"}}'),
    1, 12) ELSE '' END || '.md' AS file_name
  FROM named
)
SELECT {names}, part_no, count(*) AS n_sections, min(first_byte) AS byte_offset,
       string_agg(CASE WHEN n > 0 THEN chr(10) || chr(10) ELSE '' END || {content}, '' ORDER BY url) AS text
FROM parted JOIN files USING ({keys})
GROUP BY {names}, part_no"""


_REQUESTS = """
requests AS (
  SELECT event_id, user_id, epoch_us(ts) AS arrival_us FROM events
)"""


def _bucket(key: str, interval: int, burst: int, requests: str = _REQUESTS, units: int = 1) -> str:
    """Token bucket stepped one request at a time; ``tokens`` is kept in microseconds of refill.

    With ``units`` all times are multiples of so small a part of a microsecond.
    """
    full = interval * burst
    admit = "admit_us" if units == 1 else f"CAST((admit_us + {units - 1}) // {units} AS BIGINT)"
    arrival = "arrival_us" if units == 1 else f"arrival_us // {units}"
    return f"""
WITH RECURSIVE {requests},
numbered AS (
  SELECT *, {key} AS bucket,
         row_number() OVER (PARTITION BY {key} ORDER BY arrival_us, event_id) AS k
  FROM requests
),
steps AS (
  SELECT event_id, user_id, arrival_us, bucket, k,
         arrival_us AS admit_us, CAST({full} - {interval} AS BIGINT) AS tokens
  FROM numbered WHERE k = 1
  UNION ALL
  SELECT event_id, user_id, arrival_us, bucket, k,
         ready + greatest({interval} - have, 0) AS admit_us,
         greatest(have - {interval}, 0) AS tokens
  FROM (
    SELECT n.event_id, n.user_id, n.arrival_us, n.bucket, n.k,
           greatest(n.arrival_us, s.admit_us) AS ready,
           least({full}, s.tokens + greatest(n.arrival_us, s.admit_us) - s.admit_us) AS have
    FROM steps s JOIN numbered n ON n.bucket = s.bucket AND n.k = s.k + 1
  )
)
SELECT event_id, user_id, {arrival} AS arrival_us, {admit} AS admit_us,
       {admit} - {arrival} AS wait_us FROM steps"""


_SEEDS = """
asked AS (SELECT DISTINCT regexp_replace(url, '^http:', 'https:') AS url FROM pages)"""

# Grouped documents as files: the same names as in the bundles, and the lines of their pages.
_GROUPED_LINES = _by_path(f"{_LOCATED}, {_TITLED}", "titled", "title", "file_name").split(
    "SELECT file_name, part_no"
)[0] + """
SELECT file_name, line, count(*) AS n
FROM (
  SELECT file_name, unnest(string_split(title || chr(10), chr(10))) AS line FROM parted JOIN files
  USING (base_url, prefix, matched_path)
) GROUP BY ALL"""

ORACLES: dict[str, str] = {
    "scan_pages": "SELECT page_id, url, md5(html) AS html_md5 FROM pages",
    "hosted_base_path": f"""
SELECT DISTINCT url, 'https://' || {_HOST} || '/en' AS base_url FROM pages
WHERE regexp_matches({_PATH}, '^/en/[123]')
  AND NOT starts_with({_PATH}, '/en/33')""",
    "section_sink": f"""
WITH {_SECTIONS},
lines AS (
  SELECT source, unnest(string_split(regexp_replace(section, '\\n$', ''), chr(10))) AS line FROM sections
)
SELECT source, line, count(*) AS n FROM lines GROUP BY ALL""",
    "combined_sink": """
WITH latest AS (
  SELECT url, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM pages
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1
),
lines AS (
  SELECT unnest(string_split('## ' || url || chr(10) || chr(10) || title || chr(10), chr(10))) AS line FROM latest
)
SELECT line, count(*) AS n FROM lines GROUP BY ALL""",
    "grouped_sink": _GROUPED_LINES,
    "profile_sink": f"""
WITH {_FILES}
SELECT string_agg(DISTINCT ext, '|' ORDER BY ext) AS file_extensions,
       'node_modules/**|vendor/**|.git/**' AS ignore_paths
FROM parts WHERE ext IN ('md', 'txt', 'go', 'json')""",
    "binary_tree": f"""
WITH {_SECTIONS}
SELECT 'source=' || source AS folder, CAST(sum(strlen(section)) AS BIGINT) AS n_bytes
FROM sections GROUP BY source""",
    "single_bundle": f"""
WITH {_LOCATED}, {_TITLED},
sections AS (
  SELECT url, '## ' || url || chr(10) || chr(10) || title || chr(10) || chr(10) AS section FROM titled
), {_offsets("", "url", "strlen(section)", "sections")}
SELECT 'combined.md' AS file_name, part_no, count(*) AS n_sections, min(first_byte) AS byte_offset,
       string_agg(section, '' ORDER BY url) AS text
FROM parted GROUP BY part_no""",
    "ext_profile": f"""
WITH {_FILES}
SELECT ext, count(*) AS n_files, CAST(sum(strlen(content)) AS BIGINT) AS total_bytes
FROM parts WHERE ext IN ('md', 'txt', 'go', 'json') GROUP BY ext ORDER BY ext""",
    "generated_policy": f"""
WITH {_FILES}
SELECT string_agg(DISTINCT ext, '|' ORDER BY ext) AS file_extensions,
       'node_modules/**|vendor/**|.git/**' AS ignore_paths
FROM parts WHERE ext IN ('md', 'txt', 'go', 'json')""",
    "type_filter": f"WITH {_FILES} SELECT rel_path, ext FROM parts WHERE ext IN ('md', 'txt', 'go')",
    "hidden_prune": f"WITH {_FILES} SELECT rel_path FROM parts WHERE mid NOT LIKE '.%'",
    "glob_filter": f"""
WITH {_FILES}
SELECT rel_path, ext = 'go' AS any_depth,
       base LIKE '%1%.md' AS mid_segment,
       top = 'src1' AND ext = 'txt' AS one_level,
       top IN ('src0', 'src1', 'src2', 'src3') AND mid IN ('en', 'es') AND ext = 'go' AS char_class,
       top IN ('src15', 'src16', 'src17', 'src18', 'src19') AND base LIKE '%7.json' AS negated
FROM parts""",
    "ignore_filter": f"WITH {_FILES} SELECT rel_path FROM parts WHERE NOT {_IGNORED}",
    "generated_tag": f"""
WITH {_FILES} SELECT rel_path, {_GENERATED} AS generated, {_NOTE} AS note FROM parts""",
    "tree_order": f"""
WITH {_FILES}
SELECT rel_path, row_number() OVER (ORDER BY string_split(rel_path, '/')) - 1 AS ordinal FROM files""",
    "file_sections": f"WITH {_SECTIONS} SELECT rel_path, section FROM sections",
    "files_bundle": f"""
WITH {_SECTIONS}, {_offsets("source", "segments", "strlen(section)", "sections")}
SELECT source, part_no, count(*) AS n_sections, min(first_byte) AS byte_offset,
       string_agg(section, '' ORDER BY segments) AS text
FROM parted GROUP BY source, part_no""",
    "files_bundle_all": f"""
WITH {_SECTIONS}, {_offsets("", "segments", "strlen(section)", "sections")}
SELECT part_no, count(*) AS n_sections, min(first_byte) AS byte_offset,
       string_agg(section, '' ORDER BY segments) AS text
FROM parted GROUP BY part_no""",
    "size_labels": """
WITH sized AS (
  SELECT doc_id, strlen(text) * (doc_id + 1) * (doc_id % 97 + 1) AS size FROM documents
)
SELECT doc_id, size, CASE
  WHEN size < 1024 THEN size || ' B'
  WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0::DOUBLE)
  WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0::DOUBLE)
  WHEN size < 1099511627776 THEN printf('%.1f GB', size / 1073741824.0::DOUBLE)
  ELSE printf('%.1f TB', size / 1099511627776.0::DOUBLE) END AS label
FROM sized""",
    "bundle_names": """
SELECT event_id, event_type || '-' || strftime(ts, '%Y%m%d-%H%M%S') || '.bundle.md' AS name FROM events""",
    "normalize_extract": f"""
WITH messy AS (
  SELECT doc_id, replace('  ' || chr(13) || chr(10)
    || replace(text, '. ', '.' || chr(13) || chr(10) || chr(9) || ' ') || ' ' || chr(9) || chr(13),
    chr(13) || chr(10), chr(10)) AS t
  FROM documents
)
SELECT doc_id, {_trimmed_lines("replace(t, chr(13), chr(10))")} AS clean FROM messy""",
    "url_parts": f"SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages",
    "url_allowed": f"WITH {_LOCATED} SELECT page_id, base_url, allowed FROM allowed",
    "seed_urls": f"""
WITH {_LOCATED}, listed(path, path_no) AS (VALUES ('/en', 0), ('/fr', 1), ('/en/1', 2))
SELECT 'https://' || host || l.path AS url, l.path, CAST(l.path_no AS INTEGER) AS path_no
FROM hosts, listed l""",
    "seed_urls_plain": f"""
WITH {_SEEDS} SELECT url, '' AS path, 'h1' AS css, '.ad' AS excludes FROM asked""",
    "seed_coverage": f"WITH {_SEEDS} SELECT url FROM asked ANTI JOIN pages USING (url)",
    "seeded_pages": f"""
WITH {_SEEDS}
SELECT url, {_PATH} AS url_path, url AS base_url, md5(html) AS html_md5
FROM pages WHERE url IN (SELECT url FROM asked)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1""",
    "resolve_overrides": f"""
WITH {_LOCATED}
SELECT url, {_CSS} AS css, CASE WHEN starts_with(path, '/fr/1') THEN '.x'
  WHEN starts_with(path, '/fr') THEN '' WHEN starts_with(path, '/en/2') THEN 'li|.y'
  ELSE '.ad' END AS excludes
FROM latest""",
    "matched_path": f"""
WITH {_LOCATED}
SELECT url, CASE WHEN starts_with(path, '/en') THEN '/en' ELSE '/fr' END AS matched_path FROM latest""",
    "page_filename": f"""
SELECT page_id, {_underscored("trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's'))")}
       || '.bundle.md' AS file_name, CAST(NULL AS VARCHAR) AS error
FROM pages""",
    "page_filename_from_url": f"""
SELECT page_id, CASE WHEN starts_with(url, 'https') THEN
         {_underscored(f"{_HOST} || rtrim({_PATH}, '/')")} || '.bundle.md' END AS file_name,
       CASE WHEN NOT starts_with(url, 'https') THEN 'invalid URL: missing host' END AS error
FROM pages""",
    "page_filename_dash": f"""
SELECT page_id, {_dashed("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} || '.md' AS file_name
FROM pages""",
    "html_title": f"""
WITH titled AS (
  SELECT page_id, substr(html, instr(html, '<title>') + 7,
    instr(html, '</title>') - instr(html, '<title>') - 7) AS title
  FROM pages
)
SELECT page_id, title, {_underscored("title")} AS name FROM titled""",
    "normalize_path": f"""
WITH n AS (SELECT page_id, {_dashed(_PATH)} AS normalized FROM pages)
SELECT page_id, normalized, 'doc-' || coalesce(nullif(normalized, ''), 'index') || '.md' AS file_name
FROM n""",
    "non_blank": """
SELECT conv_id, turn, regexp_matches(text, '\\S') AS has_text, false AS left_text FROM conversations""",
    "dedupe_latest": """
SELECT * FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "page_run_summary": f"""
SELECT {_HOST} AS host, count(DISTINCT url) AS n_urls,
       count(DISTINCT CASE WHEN html IS NOT NULL THEN url END) AS n_with_content,
       CAST(sum(strlen(html)) AS BIGINT) AS content_bytes
FROM pages GROUP BY 1""",
    "bundle_single": f"""
WITH sections AS (
  SELECT url, '## ' || url || chr(10) || chr(10) || html || chr(10) || chr(10) AS section FROM pages
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1
), {_offsets("", "url", "strlen(section)", "sections")}
SELECT part_no, count(*) AS n_sections, min(first_byte) AS byte_offset,
       string_agg(section, '' ORDER BY url) AS text
FROM parted GROUP BY part_no""",
    "bundle_by_path": _by_path(_LOCATED, "latest", "html", "file_name, base_url, matched_path"),
    "conversation_bundle": """
SELECT conv_id, count(*) AS n_sections,
       string_agg('## ' || role || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""",
    "corpus_union": f"""
WITH {_SECTIONS}
SELECT 'file' AS kind, rel_path AS name, section FROM sections
UNION ALL
SELECT 'page', url, '## ' || url || chr(10) || chr(10) || html || chr(10) || chr(10) FROM pages""",
    "web_bundle": _by_path(f"{_LOCATED}, {_TITLED}", "titled", "title", "file_name"),
    "failed_pages": f"""
WITH {_SEEDS}
SELECT url, 'no content found in the document' AS error FROM asked ANTI JOIN pages USING (url)""",
    "seed_summary": f"""
WITH {_SEEDS},
answered AS (
  SELECT a.url, {_HOST.replace("(url", "(a.url")} AS host,
         regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title
  FROM asked a LEFT JOIN (
    SELECT html, url FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1
  ) p USING (url)
)
SELECT host, count(*) AS n_urls, count(title) AS n_with_content,
       CAST(sum(strlen(title)) AS BIGINT) AS content_bytes
FROM answered GROUP BY host""",
    "throttle_schedule": _bucket("user_id", 172_800_000_000, 2),
    "throttle_shared": _bucket("1", 300_000_000, 3),
    "throttle_thirds": _bucket(
        "1", 1_000_000, 2, """
requests AS (
  SELECT event_id, user_id, epoch_us(ts) // 1000000 * 3 AS arrival_us FROM events
)""", 3
    ),
    "rule_violations": """
WITH checks AS (
  SELECT c_custkey, [
    CASE WHEN c_custkey % 15 = 0 THEN 1 END,
    CASE WHEN c_custkey % 4 = 3 THEN 2 END,
    CASE WHEN c_acctbal <= 0 THEN 3 END,
    CASE WHEN c_nationkey <= 3 THEN 4 END,
    CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 = 0 THEN 5 END
  ] AS found
  FROM customer
),
broken AS (SELECT c_custkey, unnest(found) AS check_no FROM checks)
SELECT c_custkey, CAST(check_no AS INTEGER) AS check_no,
       CASE check_no WHEN 1 THEN 'file_extensions or sites must be specified'
         WHEN 2 THEN 'output_type must be ''single'' or ''separate'''
         WHEN 3 THEN 'requests_per_second must be positive'
         WHEN 4 THEN 'burst_limit must be positive'
         ELSE 'base_url must be specified for each site' END AS message,
       check_no = min(check_no) OVER (PARTITION BY c_custkey) AS is_first
FROM broken WHERE check_no IS NOT NULL""",
    "selector_violations": f"""
WITH {_LOCATED}
SELECT 'https://' || host AS base_url, 'p:first-child' AS selector FROM hosts WHERE host LIKE 'm.%'""",
    "tree_scan": f"""
        WITH {_FILES}, {_TREE}
        SELECT tree_path AS rel_path, size FROM tree WHERE mid NOT LIKE '.%'
    """,
    "tree_read": f"""
        WITH {_FILES}, {_TREE}
        SELECT tree_path AS rel_path, greatest((size - 1) // 997, 0) + 1 AS n_ranges, content AS text
        FROM tree WHERE mid NOT LIKE '.%'
    """,
    "tree_profile": f"""
        WITH {_FILES}, {_TREE}
        SELECT ext, count(*) AS n_files, sum(size)::BIGINT AS total_bytes
        FROM tree WHERE mid NOT LIKE '.%' GROUP BY ext
    """,
    "glob_table": f"""
        WITH {_FILES}
        SELECT rel_path,
               source <> 'src3' AND ((top = source AND base LIKE '1%.md') OR base LIKE '%7.go') AS glob_hit,
               source <> 'src3' AND (top = source || '-x' OR mid = 'fr') AS ignored,
               source <> 'src3' AND base LIKE '2%.txt' AS generated
        FROM parts
    """,
}
