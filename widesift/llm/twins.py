"""DuckDB twins of the queries that SQL can express; they read the same tables."""

#: conversations, with quotation links
QUOTATIONS = r"""
WITH RECURSIVE d AS (SELECT a.*, b.text AS said1, c.text AS said2, strpos('0123456789abcdef', substr(md5(concat_ws(':', CAST(a.conv_id AS VARCHAR), CAST(a.turn AS VARCHAR))), 1, 1)) - 1 AS digit
  FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn + 2 = a.turn),
m AS (SELECT conv_id, turn, role, coalesce(CASE WHEN digit BETWEEN 4 AND 7 THEN '>> ' || replace(said2, chr(10), chr(10) || '>> ') || chr(10) END, '')
  || coalesce(CASE WHEN digit < 10 THEN '> ' || replace(said1, chr(10), chr(10) || '> ') || chr(10) END, '') || text AS text FROM d),
l AS (SELECT conv_id, turn, role, text, unnest(string_split_regex(coalesce(text, ''), '\r\n|\r|\n')) AS raw,
             generate_subscripts(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), 1) AS i FROM m),
v AS (SELECT *, length(regexp_replace(regexp_extract(raw, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level,
             regexp_replace(raw, '^[ \t]*((?:>[ \t]?)+)', '') AS line FROM l),
s AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS island FROM v),
p AS (SELECT conv_id, turn, level, island, min(i) AS place, list(line ORDER BY i) AS lines FROM s WHERE level > 0 GROUP BY ALL),
norm AS (SELECT conv_id, turn, level, place, unnest(list_append(lines, array_to_string(lines, chr(10)))) AS part FROM p),
wanted AS (SELECT DISTINCT conv_id, turn, level, place, trim(regexp_replace(lower(part), '\s+', ' ', 'g')) AS part FROM norm
           WHERE trim(regexp_replace(lower(part), '\s+', ' ', 'g')) <> ''),
own AS (SELECT conv_id, turn, any_value(role) AS role, any_value(text) AS text,
               CASE WHEN max(level) > 0 THEN trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), ''), chr(10)) ELSE any_value(text) END AS own
        FROM v GROUP BY conv_id, turn),
said AS (SELECT conv_id, turn, unnest(list_concat([own], string_split_regex(own, '(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)'),
                string_split_regex(own, '\r\n|\r|\n'))) AS part FROM own WHERE own IS NOT NULL),
held AS (SELECT DISTINCT conv_id, trim(regexp_replace(lower(part), '\s+', ' ', 'g')) AS part, turn AS source FROM said),
found AS (SELECT w.conv_id, w.turn, w.place, max(CASE WHEN w.level = 1 THEN f.source END) AS source FROM wanted w
          JOIN held f ON f.conv_id = w.conv_id AND f.part = w.part AND f.source < w.turn WHERE length(w.part) >= 16 GROUP BY ALL),
links AS (SELECT q.conv_id, q.turn, count(*) AS n_quotes, count(f.place) AS n_linked, max(f.source) AS parent
          FROM (SELECT DISTINCT conv_id, turn, place FROM wanted) q LEFT JOIN found f USING (conv_id, turn, place) GROUP BY ALL),
tree AS (SELECT conv_id, turn, CAST(turn AS VARCHAR) AS path, 0 AS depth FROM own LEFT JOIN links USING (conv_id, turn) WHERE parent IS NULL
         UNION ALL SELECT k.conv_id, k.turn, t.path || ',' || k.turn, t.depth + 1 FROM links k JOIN tree t ON t.conv_id = k.conv_id AND t.turn = k.parent)
SELECT o.conv_id, o.turn, coalesce(parent, -1) AS parent, t.depth, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, t.path,
       sha256('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(own, '')) AS message_sha256
FROM own o LEFT JOIN links USING (conv_id, turn) JOIN tree t USING (conv_id, turn)"""

#: dated list entries that both engines derive from the hosts of `pages`: a hash of the host decides lists and days
HOST = r"""CASE WHEN rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1), '.') <> ''
      THEN rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1), '.') END"""
URL_LISTS = rf"""
WITH c AS (SELECT page_id, url, {HOST} AS host, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day FROM pages),
h AS (SELECT host, strpos('0123456789abcdef', substr(md5(host), 1, 1)) - 1 AS x, strpos('0123456789abcdef', substr(md5(host), 2, 1)) - 1 AS y
      FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)),
spans AS (
  SELECT 'malware' AS list, 'host' AS kind, host AS value, DATE '2023-12-01' + CAST(y * 20 AS INTEGER) AS since, DATE '2023-12-01' + CAST(y * 20 + 90 AS INTEGER) AS until FROM h WHERE x < 6
  UNION ALL SELECT 'malware', 'host', host, DATE '2023-12-01' + CAST(y * 20 + 150 AS INTEGER), DATE '9999-12-31' FROM h WHERE x < 6
  UNION ALL SELECT 'adult', 'domain', regexp_replace(host, '^[^.]+\.', ''), min(DATE '2024-02-01' + CAST(y * 10 AS INTEGER)), DATE '9999-12-31' FROM h
    WHERE x >= 13 AND length(host) - length(replace(host, '.', '')) >= 3 GROUP BY 3
  UNION ALL SELECT 'spam', 'prefix', host || '/en', DATE '2024-01-01' + CAST(y * 5 AS INTEGER), DATE '2024-01-01' + CAST(y * 5 + 120 AS INTEGER) FROM h WHERE x % 2 = 0),
hit AS (SELECT DISTINCT c.page_id, s.list FROM c JOIN spans s ON s.since <= c.day AND c.day < s.until AND (
  s.kind = 'host' AND s.value = c.host OR s.kind = 'domain' AND (s.value = c.host OR ends_with(c.host, '.' || s.value))
  OR s.kind = 'prefix' AND starts_with(c.host || '/' || regexp_extract(lower(c.url), '^[a-z][a-z0-9+.-]*://[^/?#]*/?([^?#]*)', 1) || '/', s.value || '/')))
SELECT c.page_id, c.host, CAST(c.day AS VARCHAR) AS fetched_on, coalesce(string_agg(list, ',' ORDER BY list), '') AS lists, count(list) > 0 AS blocked
FROM c LEFT JOIN hit USING (page_id) GROUP BY ALL"""

#: the base kinds only need places; pieces between matches give them
SECRETS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r(kind, k, pattern, least) AS (VALUES
  ('assign', 0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?[A-Za-z0-9+/_.=-]+', 6),
  ('access', 1, 'AKIA[A-Z0-9]+', 20), ('hex', 2, '[0-9a-f]{24,}', 24)),
g AS (SELECT doc_id, kind, k, least, regexp_extract_all(t, pattern) AS found, string_split_regex(t, pattern) AS gaps FROM d, r),
e AS (SELECT doc_id, kind, k, least, found[i] AS m,
             list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS s
      FROM g, range(1, len(found) + 1) AS x(i)),
f AS (SELECT doc_id, kind, k, CAST(s AS BIGINT) AS s, CAST(s AS BIGINT) + length(m) AS e FROM e
      WHERE length(CASE WHEN kind = 'assign' THEN regexp_extract(m, '^[A-Za-z_]+["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE m END) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""

CONTAMINATION = r"""
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, up),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, up),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
        FROM b, range(1, greatest(1, len(w) - 12) + 1) AS x(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, range(1, len(w) - n + 2) AS x(i)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
cover AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, range(i, i + n) AS y(j) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""

VECTORS = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT vec_id, label, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
walk AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT w.node, p.b FROM walk w JOIN pairs p ON p.a = w.seen)
SELECT e.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = e.vec_id) AS n_links, min(w.seen) AS component_id, e.vec_id = min(w.seen) AS kept
FROM embeddings e JOIN walk w ON w.node = e.vec_id GROUP BY e.vec_id"""

#: lines of at least 20 code points that three documents hold stay in the last one only
LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
v AS (SELECT k.*, hot.key IS NOT NULL AND doc_id <> last AS lost FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256 FROM v GROUP BY doc_id"""

#: crc32 byte by byte over a table of 256 entries; near words by what stays when a place is masked or left out
SPELLING = r"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM range(256) AS r(b)),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents WHERE text IS NOT NULL),
often AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
  lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END)) AS b FROM often),
hashed AS (SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h FROM bytes, crc_table),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS MATERIALIZED (SELECT word, n, left(word, CAST(i - 1 AS INTEGER)) AS l, substr(word, CAST(i + 1 AS INTEGER)) AS r FROM w, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (SELECT a.word, b.word AS other, b.n FROM places a JOIN places b ON a.l = b.l AND a.r = b.r AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM places a JOIN w ON w.word = a.l || a.r
  UNION SELECT w.word, a.word, a.n FROM places a JOIN w ON w.word = a.l || a.r),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN other END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, (SELECT arg_max(root, step) FROM walk WHERE walk.word = f.word) AS root FROM f"""
