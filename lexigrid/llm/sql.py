"""DuckDB SQL of the operators that SQL can express."""

OP2_SUBSTRING_DEDUP = r"""
WITH split_words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), bodies AS (
  SELECT doc_id, list_transform(range(0, len(ws) - 19), lambda i: md5(array_to_string(ws[i + 1 : i + 20], ' '))) AS bs FROM split_words
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS nth
  FROM (SELECT doc_id, unnest(bs) AS body, generate_subscripts(bs, 1) AS pos FROM bodies)
), cut AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM ranked, (SELECT unnest(range(0, 20)) AS d) WHERE nth > 1
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM split_words
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(cut.pos) AS n_removed, string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE cut.pos IS NULL) AS body
  FROM words LEFT JOIN cut USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

OP7_LINE_DEDUP = r"""
WITH split_lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), windows AS (
  SELECT doc_id, pos, array_to_string(ls[pos + 1 : pos + 3], chr(10)) AS body
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM split_lines)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS nth
  FROM windows WHERE regexp_matches(body, '[^\x20\x09-\x0D]')
), cut AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM ranked, (SELECT unnest(range(0, 3)) AS d) WHERE nth > 1
), lines AS (
  SELECT doc_id, i AS pos, ls[i + 1] AS line
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM split_lines)
)
SELECT doc_id, count(*) AS n_lines, count(cut.pos) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY lines.pos) FILTER (WHERE cut.pos IS NULL), '') AS text
FROM lines LEFT JOIN cut USING (doc_id, pos)
GROUP BY doc_id
"""

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_DIVERGENCE = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), words AS MATERIALIZED (
  SELECT r, lang, source, unnest(ws) AS term FROM docs
), kept AS MATERIALIZED (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), sources AS MATERIALIZED (
  SELECT DISTINCT lang, source FROM docs
), sizes AS MATERIALIZED (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counts AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), totals AS MATERIALIZED (
  SELECT lang, source, coalesce(sum(n), 0) AS n FROM sources LEFT JOIN counts USING (lang, source) GROUP BY ALL
), p AS MATERIALIZED (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.n + 2 * v) AS p
  FROM totals t JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN counts c USING (lang, source, term)
), q AS MATERIALIZED (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL)
  JOIN (SELECT lang, sum(n) AS total FROM counts GROUP BY ALL) USING (lang) JOIN sizes USING (lang)
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_OP12_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_DECONTAMINATION = rf"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, {_OP12_WORDS} AS ws FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item, {_OP12_WORDS} AS ws FROM benchmark
), asked AS MATERIALIZED (
  SELECT DISTINCT item, n, array_to_string(ws[i + 1 : i + n], ' ') AS body
  FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(0, len(ws) - least(10, len(ws)) + 1)) AS i FROM items WHERE len(ws) > 0)
), windows AS MATERIALIZED (
  SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS body
  FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM asked))
), found AS MATERIALIZED (
  SELECT doc_id, n, i, item FROM windows JOIN asked USING (n, body)
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
