"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS held FROM documents),
words AS (SELECT doc_id, unnest(held) AS word, unnest(range(1, len(held) + 1)) AS pos FROM split),
windows AS (
  SELECT doc_id, pos, word,
         CASE WHEN count(*) OVER w = 20 THEN md5(string_agg(word, ' ') OVER w) END AS mark
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
),
ranked AS (SELECT *, mark IS NOT NULL AND row_number() OVER (PARTITION BY mark ORDER BY doc_id, pos) > 1 AS again FROM windows),
judged AS (
  SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM ranked
),
per AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per USING (doc_id)
"""

NEAR_DUP = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS held FROM documents
),
words AS (SELECT doc_id, len(held) AS n, unnest(held) AS word, unnest(range(1, len(held) + 1)) AS pos FROM split),
windows AS (
  SELECT doc_id, n, pos, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) AS shingle FROM words
),
shingles AS (SELECT DISTINCT doc_id, shingle FROM windows WHERE pos <= greatest(n - 3, 1)),
sizes AS (SELECT doc_id, count(*) AS n_shingles FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * common >= 80 * (p.n_shingles + q.n_shingles - common)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT a AS doc_id, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n_shingles, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
hashed AS (SELECT page_id, payload, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS last FROM payloads)
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM hashed
"""

_HOST = f"translate(regexp_extract({{0}}, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
_PATH = "regexp_extract({0}, '://[^/?#]*([^?#]*)', 1)"
_PAGE = f"""
  translate(regexp_extract(regexp_replace({{0}}, '(?s)#.*$', ''), '^[^:/?#]+://[^/?#]*'), '{_UPPER}', '{_LOWER}')
  || substr(regexp_replace({{0}}, '(?s)#.*$', ''), 1 + length(regexp_extract(regexp_replace({{0}}, '(?s)#.*$', ''), '^[^:/?#]+://[^/?#]*')))"""
_QUOTE = "[\"'']?"

URL_FILTERS = f"""
WITH RECURSIVE rules(host, start, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
),
found AS (
  SELECT url, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*{_QUOTE}canonical\\b[^>]*>'), '(?is)\\bhref\\s*=\\s*{_QUOTE}([^"''\\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*{_QUOTE}refresh\\b[^>]*>'), '(?is)\\burl\\s*=\\s*{_QUOTE}([^"''\\s>;]+)', 1)
  ]) AS target,
  regexp_extract(url, '^[^:/?#]+') AS scheme, regexp_extract(url, '^[^:/?#]+://[^/?#]*') AS site,
  regexp_extract(url, '^([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)', 1) AS folder
  FROM pages WHERE url IS NOT NULL
),
whole AS (
  SELECT url, CASE WHEN regexp_matches(target, '^[^:/?#]+://') THEN target WHEN starts_with(target, '//') THEN scheme || ':' || target
    WHEN starts_with(target, '/') THEN site || target WHEN starts_with(target, '?') OR starts_with(target, '#') THEN regexp_extract(url, '^[^?#]*') || target
    ELSE folder || CASE WHEN ends_with(folder, '/') THEN '' ELSE '/' END || target END AS target
  FROM found WHERE target <> ''
),
links AS (SELECT {_PAGE.format("url")} AS a, {_PAGE.format("target")} AS b FROM whole),
edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT a, a AS b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
aliases AS (SELECT a, b, {_HOST.format("b")} AS host, {_PATH.format("b")} AS path FROM reach),
alias_rules AS (
  SELECT a, b, arg_max(r.action, length(r.host || r.start)) AS action FROM aliases x
  JOIN rules r ON (x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.start) GROUP BY a, b
),
by_alias AS (SELECT a, bool_or(action = 'allow') AS allowed, bool_or(action = 'block') AS blocked FROM alias_rules GROUP BY a),
roots AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
named AS (SELECT page_id, coalesce({_HOST.format("url")}, '') AS host, coalesce({_PATH.format("url")}, '') AS path, {_PAGE.format("url")} AS page FROM pages),
own AS (
  SELECT page_id, arg_max(r.host || r.start, length(r.host || r.start)) AS rule, arg_max(r.action, length(r.host || r.start)) AS action FROM named x
  JOIN rules r ON (x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.start) GROUP BY page_id
)
SELECT n.page_id, n.host, n.path, own.rule,
       coalesce(own.action, CASE WHEN NOT coalesce(allowed, false) AND coalesce(blocked, false) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(component, n.page) AS component
FROM named n LEFT JOIN own USING (page_id) LEFT JOIN by_alias ON by_alias.a = n.page LEFT JOIN roots ON roots.a = n.page
"""

_CRC = "[CASE WHEN x = 0 THEN unicode(substr(conv_id::VARCHAR, 1 + i::INTEGER, 1)) ELSE -1 END FOR x IN range(0, 9)]"

PREFIX_TRIE = f"""
WITH own AS (
  SELECT conv_id, list(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns,
         list(strlen(coalesce(text, ''))
              ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS sizes
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
steps AS (SELECT conv_id, flatten([{_CRC} FOR i IN range(0, strlen(conv_id::VARCHAR))]) AS step FROM own),
taken AS (
  SELECT conv_id, xor(list_reduce(step, lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT conv_id, [x::BIGINT FOR x IN step] AS step FROM steps)
),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:h], o.turns[h + 1:]) AS turns, list_concat(coalesce(b.sizes, [])[1:h], o.sizes[h + 1:]) AS sizes
  FROM own o JOIN taken USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
),
places AS (SELECT conv_id, turns, sizes, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT depth, CASE WHEN depth > 0 THEN turns[1:depth] ELSE [] END AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(any_value(sizes[depth]), 0) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
  FROM places GROUP BY ALL
),
children AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM (SELECT path, depth FROM nodes WHERE depth > 0) GROUP BY ALL),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path),
above AS (SELECT CASE WHEN up > 0 THEN path[1:up] ELSE [] END AS path, up AS depth, n_children, n_convs, size FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM whole)),
sums AS (SELECT path, depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens FROM above GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM whole n JOIN sums s ON s.depth = n.depth AND s.path = n.path LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""

RANKED_SEARCH = f"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM documents
),
counts AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM found GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY ALL),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, whole GROUP BY term, n_docs),
marks AS (SELECT doc_id, 100 - 50 + ((50 * n * n_docs) // n_terms) AS m FROM lengths, whole),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN marks USING (doc_id) GROUP BY item_id, doc_id
),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

ORACLES = {"op11_prefix_trie": PREFIX_TRIE, "op13_ranked_search": RANKED_SEARCH, "op2_substring_dedup": SUBSTRING_DEDUP, "op4_url_filters": URL_FILTERS, "op6_minhash_near_dup": NEAR_DUP, "op8_warc": WARC}
