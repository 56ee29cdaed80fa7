"""DuckDB twins of the queries that SQL can express."""

from .license_scan import BLOCK_WORDS, PHRASES, TEMPLATES, THRESHOLD, needed

OP1 = r"""
WITH raw AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         4 + (strlen(coalesce(text, '')) + 3) // 4 AS tokens,
         row_number() OVER o - 1 AS idx,
         coalesce(sum(4 + (strlen(coalesce(text, '')) + 3) // 4) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM raw
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), sized AS (
  SELECT *, length(role) + 8 + length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g')) + 8 AS chars FROM turns
), sys AS (
  SELECT conv_id, tokens AS st, chars AS sc FROM sized WHERE idx = 0 AND role = 'system' AND tokens < 1024
), ruled AS (
  SELECT s.*, coalesce(st, 0) AS st, sc, idx = 0 AND st IS NOT NULL AS opens, greatest(before - coalesce(st, 0), 0) AS after,
         least(256, (1024 - coalesce(st, 0)) // 2) AS past, 1024 - coalesce(st, 0) - least(256, (1024 - coalesce(st, 0)) // 2) AS stride
  FROM sized s LEFT JOIN sys USING (conv_id)
), windowed AS (
  SELECT *, after + CASE WHEN opens THEN 0 ELSE tokens END > (after // stride + 1) * stride AS alone,
         2 * (after // stride) + CASE WHEN after + CASE WHEN opens THEN 0 ELSE tokens END > (after // stride + 1) * stride THEN 1 ELSE 0 END AS win
  FROM ruled
), firsts AS (
  SELECT conv_id, win, min(idx) AS f, any_value(sc) AS sc, any_value(st) AS st, any_value(past) AS past, max(CASE WHEN alone THEN tokens ELSE stride END) AS own FROM windowed GROUP BY conv_id, win
), past AS (
  SELECT f.conv_id, f.win, p.chars, sum(p.tokens) OVER (PARTITION BY f.conv_id, f.win ORDER BY p.idx DESC) AS t, least(f.past, 1024 - f.st - f.own) AS most
  FROM firsts f JOIN windowed p ON p.conv_id = f.conv_id AND p.idx BETWEEN f.f - 2 AND f.f - 1
  WHERE NOT p.opens
), extra AS (
  SELECT conv_id, sum(chars) AS c FROM (
    SELECT conv_id, chars FROM past WHERE t <= most
    UNION ALL SELECT conv_id, sc FROM firsts WHERE f > 0 AND win > 0 AND sc IS NOT NULL AND st + own <= 1024
  ) GROUP BY conv_id
)
SELECT w.conv_id,
       count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY idx), '')) AS loss_sha256,
       (sum(chars) + coalesce(any_value(e.c), 0))::BIGINT AS formatted_chars
FROM windowed w LEFT JOIN extra e ON e.conv_id = w.conv_id
GROUP BY w.conv_id
"""

_TEMPLATES = ", ".join(f"('{label}', {sorted(set(t.split()))}, {needed(len(set(t.split())), THRESHOLD)})" for label, t in TEMPLATES.items())
_PHRASES = ", ".join(f"('{label}', {p.split()})" for p, label in PHRASES.items())

# Every block meets every template here; nothing is filtered before the sets are compared.
OP6 = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT k, label, i - 1 AS word FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d), (VALUES {_PHRASES}) p(label, phrase) WHERE w[i:i + len(phrase) - 1] = phrase
), base AS (
  SELECT k, count(*) AS n, min(word) AS first_word, max(word) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY k
), blocks AS (
  SELECT k, list_distinct(w[b * {BLOCK_WORDS // 2} + 1:b * {BLOCK_WORDS // 2} + {BLOCK_WORDS}]) AS block FROM (SELECT k, w, unnest(range((len(w) + {BLOCK_WORDS // 2 - 1}) // {BLOCK_WORDS // 2})) AS b FROM d)
), met AS (
  SELECT k, list(DISTINCT label) AS labels, max(len(list_intersect(block, words)) / len(words)) AS score FROM blocks, (VALUES {_TEMPLATES}) t(label, words, need) WHERE len(list_intersect(block, words)) >= need GROUP BY k
)
SELECT doc_id,
       len(w)::BIGINT AS n_words,
       coalesce(base.n, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, met.labels))), ','), '') AS labels,
       greatest(CASE WHEN base.n > 0 THEN 1.0 ELSE 0.0 END, coalesce(met.score, 0.0))::DOUBLE AS score
FROM d LEFT JOIN base USING (k) LEFT JOIN met USING (k)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wanted AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM wanted
), runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS run FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), met AS (
  SELECT doc_id, i, n, item_id FROM runs JOIN wanted USING (n, run)
), hit AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM (SELECT DISTINCT doc_id, i, n FROM met)) GROUP BY doc_id
), items AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM met GROUP BY doc_id
)
SELECT doc_id,
       len(w)::BIGINT AS n_words,
       coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# Equal sets are one node; links among nodes are walked from every node to all it reaches.
OP9 = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)])) AS s FROM d WHERE len(w) > 0
), same AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, min(doc_id) OVER (PARTITION BY s) AS node FROM sets
), entry AS MATERIALIZED (
  SELECT node, n, unnest(s) AS shingle FROM (SELECT node, n, s FROM same JOIN sets USING (doc_id) WHERE node = doc_id)
), pairs AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS common
  FROM entry a JOIN entry b ON a.shingle = b.shingle AND a.node < b.node AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs WHERE 100 * common >= 75 * (na + nb - common)
  UNION ALL SELECT b, a FROM pairs WHERE 100 * common >= 75 * (na + nb - common)
), reach(node, far) AS (
  SELECT a, b FROM links
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.far
), label AS (
  SELECT node, least(node, min(far)) AS low FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(same.n, 0)::BIGINT AS n_shingles, coalesce(low, same.node, d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN same ON same.doc_id = d.doc_id LEFT JOIN label ON label.node = same.node
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), size AS (
  SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), postings AS (
  SELECT doc_id, k, term, 50 + (50 * m * n) // l AS m, count(*) AS tf FROM (SELECT doc_id, k, len(w) AS m, unnest(w) AS term FROM d), size WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM postings, size GROUP BY term
), scores AS (
  SELECT item_id, k, any_value(doc_id) AS doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM asked JOIN postings USING (term) JOIN weights USING (term) GROUP BY item_id, k
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), tokens AS MATERIALIZED (
  SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), kept AS MATERIALIZED (
  SELECT lang, term, sum(n)::BIGINT AS n FROM tokens GROUP BY lang, term HAVING count(*) >= 10
), groups AS (
  SELECT lang, source, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)
), counts AS (
  SELECT t.lang, source, term, sum(t.n)::BIGINT AS n FROM tokens t JOIN kept USING (lang, term) GROUP BY ALL
), mass AS (
  SELECT lang, source, v, coalesce(sum(n), 0)::BIGINT AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS MATERIALIZED (
  SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000 * (coalesce(c.n, 0) + 2) // (m.total + 2 * m.v))::BIGINT AS p, (1 + 1000000000 * (k.n + 2) // (sum(m.total) OVER (PARTITION BY m.lang, k.term) + 2 * m.v))::BIGINT AS q
  FROM mass m JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((s.p - t.p) * (s.p - t.p) // (s.p + t.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares s ON s.lang = a.lang AND s.source = a.source LEFT JOIN shares t ON t.lang = b.lang AND t.source = b.source AND t.term = s.term
  GROUP BY ALL
), own AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM own) WHERE rank <= 10
"""

# Every string of 400 bytes is written out and counted.
OP13 = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), starts AS MATERIALIZED (
  SELECT k, 400 * j + i AS i, md5_number(piece[2 * i + 1:2 * i + 800]) AS m FROM (
    SELECT k, j, piece, unnest(range(0, len(piece) // 2 - 399)) AS i FROM (SELECT k, j, h[800 * j + 1:800 * j + 1598] AS piece FROM (SELECT k, h, unnest(range(0, len(h) // 800)) AS j FROM d)) WHERE len(piece) >= 800)
), twice AS (
  SELECT m FROM starts GROUP BY m HAVING count(*) > 1
), hit AS (
  SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM starts JOIN twice USING (m)
), runs AS (
  SELECT k, min(i) AS a, max(i) + 400 AS b FROM (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS run FROM hit) GROUP BY k, run
), cut AS (
  SELECT k, list(struct_pack(a := a, b := b) ORDER BY a) AS r, sum(b - a)::BIGINT AS gone FROM runs GROUP BY k
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(len(r), 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN r IS NULL THEN h ELSE array_to_string([h[CASE WHEN j = 1 THEN 0 ELSE 2 * r[j - 1].b END + 1:CASE WHEN j > len(r) THEN len(h) ELSE 2 * r[j].a END] FOR j IN range(1, len(r) + 2)], '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (k)
"""
