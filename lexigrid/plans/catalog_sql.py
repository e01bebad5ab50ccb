"""DuckDB SQL of the registered queries, written from the definitions on its own."""

from __future__ import annotations

#: Questions of the search queries.
QUESTIONS = (
    "licensed under the terms of the license",
    "what is the name of the person",
    "the anble of the thering",
    "what are and is not in here",
    "und der die das",
    "los que con para una",
    "les des dans pour avec",
    "worthless idiot",
    "under under licensed",
    "from this that with have",
    "be as at by it on",
    "mail and phone of the person",
    "and and and",
    "erthe ontion ingthe",
    "xyzzy unknown words",
)

#: Name -> (query, its condition in SQL over the list ``tokens``).
BOOLEAN = {
    "bool_and": ("the AND licensed", "list_contains(tokens, 'the') AND list_contains(tokens, 'licensed')"),
    "bool_or": ("licensed or idiot", "list_contains(tokens, 'licensed') OR list_contains(tokens, 'idiot')"),
    "bool_not": ("the and NOT of NOT in", "list_contains(tokens, 'the') AND NOT list_contains(tokens, 'of')"),
    "bool_mixed": (
        "the of AND licensed under OR in NOT to AND NOT idiot",
        "(list_contains(tokens, 'the') AND list_contains(tokens, 'of')) AND ((list_contains(tokens, 'licensed') AND list_contains(tokens, 'under')) "
        "OR (list_contains(tokens, 'in') AND NOT list_contains(tokens, 'to'))) AND NOT list_contains(tokens, 'idiot')",
    ),
    "bool_empty": ("", "true"),
}


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({text}), '[^a-z0-9]', ' ', 'g'), ' +'), lambda t: t <> '')"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _count(text: str) -> str:
    return rf"len(list_filter(string_split_regex({text}, '\s+'), lambda t: t <> ''))"


_STOP = "('the', 'of', 'and', 'in', 'to')"
_QUESTIONS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS, 1)) + ") AS q(question_id, question)"


def _bm25(k: int, stop: str | None = None) -> str:
    """Common table expressions; the last, ``sparse``, has the ranked hits."""
    kept = (lambda x: f"list_filter({x}, lambda t: t NOT IN {stop})") if stop else (lambda x: x)
    return f"""
tok AS MATERIALIZED (SELECT doc_id AS chunk_id, {kept(_tokens('text'))} AS tokens FROM documents),
words AS MATERIALIZED (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM tok),
stats AS MATERIALIZED (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
raw AS MATERIALIZED (SELECT term, count(DISTINCT chunk_id) AS df FROM words GROUP BY term),
idfs AS MATERIALIZED (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS x FROM raw, stats),
idf AS MATERIALIZED (SELECT term, CASE WHEN x < 0 THEN 0.25 * (SELECT avg(x) FROM idfs) ELSE x END AS idf FROM idfs),
asked AS MATERIALIZED ({_QUESTIONS}),
wanted AS MATERIALIZED (SELECT question_id, term, count(*) AS times FROM (SELECT question_id, unnest({kept(_tokens('question'))}) AS term FROM asked) GROUP BY ALL),
tf AS MATERIALIZED (SELECT term, chunk_id, dl, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
scored AS (SELECT question_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN wanted USING (term) JOIN idf USING (term), stats GROUP BY ALL),
sparse AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= {k} AND score > 0)"""


def _dense(queries: str, k: int = 30) -> str:
    return f"""
dense AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.vec_id AS question_id, v.vec_id AS chunk_id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings v, embeddings q WHERE {queries})) WHERE rank <= {k})"""


_OF_QUESTION = f"q.vec_id BETWEEN 1 AND {len(QUESTIONS)}"
_FUSED = f"""{_bm25(30)},{_dense(_OF_QUESTION)},
both_lists AS (SELECT question_id, chunk_id, rank AS b, NULL AS a FROM sparse UNION ALL SELECT question_id, chunk_id, NULL, rank FROM dense),
sums AS (SELECT question_id, chunk_id, round(coalesce(sum(1.0::DOUBLE / (60 + b)), 0) + coalesce(sum(1.0::DOUBLE / (60 + a)), 0), 12) AS score, min(b) AS b, min(a) AS a FROM both_lists GROUP BY ALL),
fused AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, b NULLS LAST, a) AS rank FROM sums),
hybrid AS MATERIALIZED (SELECT question_id, chunk_id, rank, doc_id::VARCHAR AS doc, 1 AS page, text FROM fused JOIN documents ON doc_id = chunk_id WHERE rank <= 10)"""

_CONTEXT = r"""
best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS i FROM hybrid),
contexts AS (SELECT question_id, string_agg('[EXCERPT ' || i || ']' || chr(10) || 'Source: ' || doc || ' | Page: ' || page || chr(10) || text || chr(10), chr(10) ORDER BY i) AS context
  FROM best WHERE i <= 3 GROUP BY question_id)"""

_RAW = r"""
raws AS MATERIALIZED (SELECT conv_id, turn, coalesce(text, '') || ' (see file' || conv_id % 7 || '.pdf, p.' || turn + 1 || ') and (other, p. 3)' ||
  CASE conv_id % 4
    WHEN 0 THEN chr(10) || '```json' || chr(10) || '{"sources": [{"document": "file' || conv_id % 7 || '.pdf", "page": ' || turn + 1 || ', "evidence": "words"}]}' || chr(10) || '```' || chr(10)
    WHEN 1 THEN chr(10) || '```json' || chr(10) || '{"sources": [broken}' || chr(10) || '```'
    WHEN 2 THEN chr(10) || '```json {"sources": []} ```'
    ELSE '' END AS raw FROM conversations)"""


def _inline(raw: str) -> str:
    pattern = r"'\(([^,]+),\s*p\.?(\d+)\)'"
    return f"list_transform(list_zip(regexp_extract_all({raw}, {pattern}, 1), regexp_extract_all({raw}, {pattern}, 2)), lambda z: {_strip('z[1]')} || '|' || z[2]::INT || '|')"


_STRIPPED = _strip(r"regexp_replace(raw, '(?s)```json.*?```', '', 'g')")
#: The table has one kind of readable fence with a source, one without, and one that is broken.
_GIVEN = r"""list_transform(from_json(regexp_extract(raw, '(?s)```json\s*(\{.*?\})\s*```', 1), '{"sources": [{"document": "VARCHAR", "page": "INTEGER", "evidence": "VARCHAR"}]}').sources, lambda s: s.document || '|' || s.page || '|' || s.evidence)"""
_READABLE = r"""(regexp_extract(raw, '(?s)```json\s*(\{.*?\})\s*```', 1) <> '' AND json_valid(regexp_extract(raw, '(?s)```json\s*(\{.*?\})\s*```', 1)))"""
_PARSED = {
    "v2": f"CASE WHEN {_READABLE} THEN {_GIVEN} ELSE {_inline('raw')} END",
    "v1": f"CASE WHEN {_READABLE} AND len({_GIVEN}) > 0 THEN {_GIVEN} ELSE {_inline(_STRIPPED)} END",
    "inline": _inline("raw"),
}


def _sources(mode: str) -> str:
    return f"WITH {_RAW}, found AS (SELECT conv_id, turn, {_PARSED[mode]} AS s FROM raws) SELECT conv_id, turn, len(s) AS n, coalesce(array_to_string(s, ';'), '') AS sources FROM found"


#: Windows of 600 words with the white space before them, every 540 words.
_TOKEN_CHUNKS = rf"""WITH texts AS (SELECT doc_id, {_strip('text')} AS whole FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, whole, regexp_extract_all(whole, '\s*\S+') AS words FROM texts),
numbered AS (SELECT *, unnest(range(0, 1 + greatest(0, ceil((len(words) - 600) / 540.0))::BIGINT)) AS i FROM split WHERE len(words) > 0),
pieces AS (SELECT doc_id, whole, i, {_strip("array_to_string(words[i * 540 + 1 : i * 540 + 600], '')")} AS piece FROM numbered),
placed AS (SELECT *, strpos(whole, left(piece, 40)) - 1 AS place FROM pieces)
SELECT doc_id || '_p1_token_' || i AS id, doc_id::VARCHAR AS doc, 1 AS page, place::INT AS start_offset, (place + len(piece))::INT AS end_offset, piece AS text,
  'token' AS chunk_type, doc_id AS corpus_ord, {_count('piece')}::INT AS token_count FROM placed"""

#: Windows of 1000 characters that end behind the last break in their last 200, one after the other.
_SENTENCE_CHUNKS = rf"""WITH RECURSIVE texts AS MATERIALIZED (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND len(text) > 0),
spans AS (
  SELECT doc_id, -1::BIGINT AS start, 0::BIGINT AS next, 0::BIGINT AS stop, false AS over FROM texts
  UNION ALL
  SELECT doc_id, start, greatest(stop - 150, start + 1), stop, stop >= n FROM (
    SELECT doc_id, start, n, CASE WHEN full_end >= n OR len(matches) = 0 THEN least(full_end, n) ELSE full_end - 201 + len(tail) - len(gaps[-1]) - len(matches[-1]) + 2 END AS stop FROM (
      SELECT *, regexp_extract_all(tail, '[.!?\n]\s+') AS matches, string_split_regex(tail, '[.!?\n]\s+') AS gaps FROM (
        SELECT s.doc_id, s.next AS start, len(t.text) AS n, s.next + 1000 AS full_end, substring(t.text, s.next + 800, 201) AS tail FROM spans s JOIN texts t USING (doc_id) WHERE NOT s.over)))
), pieces AS (SELECT doc_id, start, {_strip('substring(text, start + 1, stop - start)')} AS piece FROM spans JOIN texts USING (doc_id) WHERE start >= 0),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS i FROM pieces WHERE piece <> '')
SELECT doc_id || '_p1_c' || i AS id, doc_id::VARCHAR AS doc, 1 AS page, start::INT AS start_offset, (start + len(piece))::INT AS end_offset, piece AS text, 'token' AS chunk_type, doc_id AS corpus_ord FROM kept"""

_LEGAL = r"""
legal AS MATERIALIZED (SELECT l_orderkey, l_linenumber, 'Under ' || l_linenumber || ' U.S.C. § ' || l_suppkey || ' and § ' || l_partkey || '(b), Smith v. Jones, ' || l_linenumber || ' F. ' || l_suppkey
  || ' held; see Rule ' || l_linenumber || ' and ' || l_linenumber || ' U.S.C. § ' || l_suppkey || '.' AS text FROM lineitem)"""
_LOOSE = (
    r"'[A-Z][a-z][\w\s]+\s+v\.?\s+[\w\s]+,\s+\d+\s+[\w\.]+\s+\d+'",
    r"'\d+\s+U\.S\.C\.?\s+§+\s*\d+[a-z]?'",
    r"'§+\s*\d+(?:\.\d+)*(?:\([a-z]\))?'",
    r"'\bRule\s+\d+(?:\.\d+)?(?:\([a-z]\))?\b'",
)
_STRICT = (
    r"'[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+v\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,?\s+\d+\s+[A-Z\.]+\s+\d+'",
    r"'\d+\s+U\.S\.C\.\s+§\s*\d+[a-z]?'",
    r"'§\s*\d+[a-z]?(?:\(\w\))?'",
)


def _matches(patterns: tuple[str, ...]) -> str:
    joined = " || ".join(f"regexp_extract_all(text, {p})" for p in patterns)
    return f"list_transform({joined}, lambda c: {_strip('c')})"


_GRAPH = """
lines AS (SELECT 'o' || l_orderkey AS doc, 'part ' || l_partkey AS entity, l_linenumber AS number FROM lineitem),
edges AS MATERIALIZED (
  SELECT DISTINCT 'doc:o' || o_orderkey AS src, 'entity:customer#' || o_custkey AS dst, 'party' AS relation FROM orders
  UNION SELECT 'doc:o' || o_orderkey, 'doc:o' || o_orderkey % 100, 'cites' FROM orders
  UNION SELECT 'doc:' || doc, 'page:' || doc || ':' || number, 'has_page' FROM lines WHERE number <= 3
  UNION SELECT 'entity:' || entity, 'page:' || doc || ':' || number, 'appears_on' FROM lines)"""

_PAGE = f"SELECT doc_id || '_p1_page_0' AS id, doc_id::VARCHAR AS doc, 1 AS page, 0 AS start_offset, len(t) AS end_offset, t AS text, 'page' AS chunk_type, {_count('t')} AS token_count, doc_id AS corpus_ord FROM (SELECT doc_id, {_strip('text')} AS t FROM documents) WHERE len(t) > 0"
_STRIDE = f"""SELECT doc_id || '_p1_token_' || pos // 850 AS id, doc_id::VARCHAR AS doc, 1 AS page, pos::INT AS start_offset, (pos + len(piece))::INT AS end_offset, piece AS text, 'token' AS chunk_type,
  {_count('piece')} AS token_count, doc_id AS corpus_ord
  FROM (SELECT doc_id, pos, {_strip('substring(t, pos + 1, 1000)')} AS piece FROM (SELECT doc_id, t, unnest(range(0, len(t), 850)) AS pos FROM (SELECT doc_id, {_strip('text')} AS t FROM documents))) WHERE len(piece) > 0"""

#: The same for the jobs' SQL.
STRIDE, tokens_sql, strip_sql = _STRIDE, _tokens, _strip

_MESSY = r"chr(10) || chr(9) || ' ' || replace(text, chr(10), chr(13) || chr(10) || chr(10) || ' ' || chr(9) || chr(10) || chr(10)) || chr(13) || ' '"



def _html_text() -> str:
    """Text nodes by lines: skipped subtrees and comments are as tags, runs of tags are line ends."""
    text = "html"
    for tag in ("script", "style", "nav", "header", "footer"):
        text = rf"regexp_replace({text}, '(?is)<{tag}[^>]*>.*?(</{tag}>|$)', '<x>', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '(?s)<!--.*?-->', '<x>', 'g'), '(<[^>]*>)+', chr(10), 'g')"
    for name, sign in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{sign}')"
    return _strip(rf"regexp_replace(regexp_replace({text}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


_HEADINGS = (
    r"'(?m)^([A-Z][A-Z\s\d\.]+[:—\-]?\s*[A-Z\s]*)$'",
    r"'(?m)^(\d+(?:\.\d+)*\.?\s+[A-Z][A-Za-z\s]{3,})$'",
    r"'(?mi)^(Section\s+\d+[a-z]?[:.\s]+[A-Z][A-Za-z\s]{2,})$'",
)


def _clauses(texts: str) -> str:
    """Headings by pattern, placed by what lies before them, each up to the next."""
    sides = " UNION ALL ".join(f"SELECT doc, text, {n} AS n, regexp_extract_all(text, {p}) AS found, string_split_regex(text, {p}) AS gaps FROM texts" for n, p in enumerate(_HEADINGS))
    return f"""WITH texts AS MATERIALIZED ({texts}), sides AS MATERIALIZED ({sides}),
        marks AS (SELECT doc, text, n, found[i] AS found, (len(array_to_string(gaps[1:i], '')) + len(array_to_string(found[1:i - 1], '')))::INT AS start FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM sides)),
        ends AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start, n), len(text))::INT AS "end" FROM marks)
        SELECT doc, {_strip('found')} AS heading, start, "end", {_strip('substring(text, start + 1, least("end" - start, 500))')} AS snippet FROM ends"""


ORACLE_SQL: dict[str, str] = {
    "clause_rows": _clauses("SELECT doc_id::VARCHAR AS doc, coalesce(text, '') AS text FROM documents"),
    "clause_texts": _clauses("""SELECT o_orderkey::VARCHAR AS doc, 'opening words' || chr(10) || 'LEASE TERMS' || chr(10) || 'body of ' || o_custkey || chr(10) || o_orderkey % 9 + 1 || '.2 Payment Terms' || chr(10)
        || 'sums, and when they are due' || chr(10) || 'Section ' || o_orderkey % 5 + 1 || ': Notice Periods' || chr(10) || 'body, with words' || chr(10) || repeat('more words, ', o_orderkey % 80)
        || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'SECTION 4: AB' || chr(10) || 'x.' ELSE chr(10) || 'END OF FILE' END AS text FROM orders"""),
    "html_extract": f"SELECT * FROM (SELECT page_id, {_html_text()} AS text FROM pages) WHERE text <> ''",
    "detect_type": """SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'html' WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' WHEN 3 THEN 'docx' WHEN 4 THEN 'docx' WHEN 5 THEN 'txt' WHEN 6 THEN 'csv' WHEN 7 THEN 'xlsx' WHEN 8 THEN 'unknown'
        ELSE coalesce(CASE regexp_extract(url, '\\.([a-z]+)$', 1) WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'txt' THEN 'txt' WHEN 'pdf' THEN 'pdf' END, 'unknown') END AS type FROM pages""",
    "list_documents": "SELECT 'doc' || doc_id || '.txt' AS name, round(n_chars / 1024, 1) AS size_kb, 'txt' AS type FROM documents",
    "questions_load": "SELECT row_number() OVER (ORDER BY item_id)::INT AS question_id, text AS question FROM benchmark WHERE item_id % 3 <> 0 AND text IS NOT NULL",
    "paragraph_pages": rf"""WITH lines AS (SELECT doc_id, i, {_strip('ls[i]')} AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
        kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM lines WHERE line <> '')
        SELECT doc_id::VARCHAR AS doc_name, (n // 30 + 1)::INT AS page_number, (n // 30)::INT AS "offset", {_strip("regexp_replace(string_agg(line, chr(10) ORDER BY n), '[ \t]+', ' ', 'g')")} AS text FROM kept GROUP BY doc_id, n // 30""",
    "embedding_cache_miss": "SELECT doc_id::VARCHAR AS id, lang, source, sha256(text) AS text_sha FROM documents WHERE lang = 'de' OR source IN ('src3', 'src5')",
    "clean_text": rf"""SELECT doc_id, {_strip(f"regexp_replace(regexp_replace(regexp_replace({_MESSY}, chr(13) || chr(10) || '|' || chr(13), chr(10), 'g'), '[ ' || chr(9) || ']+', ' ', 'g'), chr(10) || '{{3,}}', chr(10) || chr(10), 'g')")} AS text FROM documents""",
    "tokenize": f"SELECT doc_id, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents",
    "tokenize_stop": f"SELECT doc_id, array_to_string(w, ' ') AS tokens, len(w) AS n FROM (SELECT doc_id, list_filter({_tokens('text')}, lambda t: t NOT IN {_STOP}) AS w FROM documents)",
    "token_count": f"SELECT doc_id, {_count('text')} AS token_count FROM documents",
    "preview": "SELECT doc_id, CASE WHEN len(text) > 300 THEN left(text, 300) || '...' ELSE text END AS preview, CASE WHEN len(text) > 200 THEN left(text, 200) || '…' ELSE text END AS short FROM documents",
    "chunk_page": _PAGE,
    "chunk_stride": _STRIDE,
    "chunk_token": _TOKEN_CHUNKS,
    "chunk_token_sql": f"SELECT * EXCLUDE (token_count) FROM ({_TOKEN_CHUNKS})",
    "chunk_sentence": f"SELECT *, {_count('text')}::INT AS token_count FROM ({_SENTENCE_CHUNKS})",
    "chunk_sentence_sql": _SENTENCE_CHUNKS,
    "chunk_dedupe": f"SELECT id, corpus_ord, end_offset, token_count FROM ({_PAGE})",
    "bm25_stats": f"WITH {_bm25(30)} SELECT n, round(avgdl, 6) AS avgdl, (SELECT round(avg(x), 6) FROM idfs) AS avg_idf, (SELECT count(*) FROM idfs) AS n_terms FROM stats",
    "term_stats": f"WITH {_bm25(30)} SELECT term, df, round(x, 6) AS raw_idf FROM raw JOIN idfs USING (term)",
    "postings": f"SELECT term, chunk_id, count(*)::INT AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM (SELECT doc_id AS chunk_id, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)) GROUP BY ALL",
    "bm25_topk": f"WITH {_bm25(30)} SELECT question_id, chunk_id, score, rank FROM sparse",
    "bm25_topk_stop": f"WITH {_bm25(30, _STOP)} SELECT question_id, chunk_id, score, rank FROM sparse",
    **{name: f"SELECT doc_id AS chunk_id, doc_id AS corpus_ord FROM (SELECT doc_id, {_tokens('text')} AS tokens FROM documents) WHERE {condition}" for name, (_, condition) in BOOLEAN.items()},
    "proximity": f"""WITH placed AS (SELECT doc_id, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents))
        SELECT DISTINCT a.doc_id AS chunk_id, a.doc_id AS corpus_ord FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 2 WHERE a.term = 'under' AND b.term = 'licensed'""",
    "l2_normalize": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE 3.0 END) AS e FROM embeddings),
        u AS (SELECT vec_id, list_transform(e, lambda x: round(x / CASE WHEN sqrt(list_inner_product(e, e)) = 0 THEN 1.0 ELSE sqrt(list_inner_product(e, e)) END, 6) + 0.0) AS e FROM v)
        SELECT vec_id, round(list_sum(e), 4) AS total, e[1] AS first, e[64] AS last FROM u""",
    "vector_topk": f"WITH {_dense('q.vec_id % 100 = 0')} SELECT question_id, chunk_id AS vec_id, score, rank FROM dense",
    "rrf_fuse": f"WITH {_FUSED} SELECT question_id, chunk_id, round(score, 9) AS score, rank FROM fused",
    "hybrid_topk": f"WITH {_FUSED} SELECT question_id, chunk_id, rank, len(text) AS n_chars FROM hybrid",
    "fast_topk": f"WITH {_bm25(10)} SELECT question_id, chunk_id, score, rank, source FROM sparse JOIN documents ON doc_id = chunk_id",
    "rerank_overlap": f"""WITH {_FUSED}, over AS (SELECT h.question_id, chunk_id, rank AS was, round(len(list_intersect(list_distinct({_tokens('question')}), list_distinct({_tokens('text')})))::DOUBLE / len(list_distinct({_tokens('question')})), 9) AS rerank_score FROM hybrid h JOIN asked USING (question_id))
        SELECT question_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, was) AS rank FROM over""",
    "topk_per_query": "SELECT * FROM (SELECT o_custkey AS question_id, o_orderkey AS chunk_id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "build_context": f"WITH {_FUSED}, {_CONTEXT} SELECT * FROM contexts",
    "build_prompt": f"WITH {_FUSED}, {_CONTEXT} SELECT question_id, 'DOCUMENT EXCERPTS:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'QUESTION: ' || question AS prompt FROM contexts JOIN asked USING (question_id)",
    "parse_sources": _sources("v2"),
    "parse_sources_v1": _sources("v1"),
    "inline_citations": _sources("inline"),
    "strip_json": f"WITH {_RAW} SELECT conv_id, turn, {_STRIPPED} AS answer FROM raws",
    "flatten_answer": f"WITH {_RAW}, found AS (SELECT conv_id, turn, string_split(coalesce(({_PARSED['v2']})[1], '|0|'), '|') AS s FROM raws) SELECT conv_id, turn, array_to_string(s[1:-3], '|') AS document, s[-2]::INT AS page, s[-1] AS evidence FROM found",
    "pretty_answer": f"""WITH {_RAW}, found AS (SELECT conv_id, turn, {_STRIPPED} AS answer, {_PARSED['v2']} AS s FROM raws)
        SELECT conv_id, turn, 'Q' || turn || ': what?' || chr(10) || answer || chr(10) || coalesce(array_to_string(list_transform(s[1:3], lambda x: '  - ' || regexp_replace(x, '\\|(\\d+)\\|[^|]*$', ', p.\\1')), chr(10)), '') AS shown FROM found""",
    "citations": f"WITH {_LEGAL} SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct({_matches(_LOOSE)})), ';') AS citations FROM legal",
    "citations_raw": f"WITH {_LEGAL} SELECT l_orderkey, l_linenumber, (unnest(range(0, len(c))))::INT AS seq, unnest(c) AS citation FROM (SELECT *, {_matches(_STRICT)} AS c FROM legal)",
    "graph_edges": f"WITH {_GRAPH} SELECT src, dst, relation FROM edges",
    "documents_citing": f"WITH {_GRAPH} SELECT DISTINCT dst[5:] AS cited, src[5:] AS doc FROM edges WHERE relation = 'cites'",
    "co_parties": f"WITH {_GRAPH} SELECT DISTINCT dst[8:] AS entity, src[5:] AS doc FROM edges WHERE relation = 'party'",
    "entity_pages": f"WITH {_GRAPH} SELECT DISTINCT src[8:] AS entity, dst AS page_id, CASE WHEN n <= 3 THEN split_part(dst, ':', 2) ELSE '' END AS doc, CASE WHEN n <= 3 THEN n ELSE 0 END AS number FROM (SELECT *, split_part(dst, ':', 3)::INT AS n FROM edges WHERE relation = 'appears_on')",
    "graph_summary": f"""WITH {_GRAPH}, named AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges UNION SELECT 'doc:o' || o_orderkey FROM orders)
        SELECT (SELECT count(*) FROM named) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM edges)) AS edges, (SELECT count(DISTINCT o_orderkey) FROM orders) AS docs""",
    "corpus_counts": f"SELECT count(DISTINCT doc) AS documents, count(*) AS chunks FROM ({_STRIDE})",
    "bottleneck_report": """WITH s AS (SELECT event_type AS stage, sum(value) AS seconds FROM events GROUP BY 1), t AS (SELECT sum(seconds) AS total FROM s)
        SELECT stage, round(seconds, 3) AS seconds, round(100 * seconds / greatest(total, 0.001), 3) AS percent, seconds > 0.4 * total AS flagged, row_number() OVER (ORDER BY seconds DESC, stage)::INT AS priority, total > 30 AS over_limit FROM s, t""",
    "graph_upserts": """WITH said AS (SELECT 'entity:part ' || l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber <= 2 THEN 'o' || l_orderkey END AS doc, l_quantity::INT AS number,
          CASE WHEN l_returnflag <> 'N' THEN 'Part ' || l_partkey || ' ' || l_returnflag END AS text, CASE WHEN l_linestatus = 'F' THEN 'part' END AS entity_type FROM lineitem)
        SELECT id, 'entity' AS kind, NULL::VARCHAR AS name, arg_max(doc, (seq, doc)) FILTER (WHERE doc IS NOT NULL) AS doc, arg_max(number, (seq, number)) AS number,
          arg_max(text, (seq, text)) FILTER (WHERE text IS NOT NULL) AS text, arg_max(entity_type, (seq, entity_type)) FILTER (WHERE entity_type IS NOT NULL) AS entity_type FROM said GROUP BY id""",
    "index_status": f"SELECT true AS ready, count(DISTINCT doc) AS documents, count(*) AS chunks, 12.3::DOUBLE AS build_seconds FROM ({_PAGE})",
    "success_count": "SELECT count(*) FILTER (WHERE length(text) > 500) AS done, count(*) AS tried FROM documents",
    "first_pages": "SELECT doc_id::VARCHAR AS doc_name, doc_id AS corpus_ord FROM documents ORDER BY doc_id LIMIT 200",
    "bm25_indexed": f"WITH {_bm25(30)} SELECT question_id, chunk_id, score, rank FROM sparse",
    "pages_sorted": "SELECT source AS doc_name, doc_id AS page_number FROM documents ORDER BY source, doc_id",
    "event_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}

#: Searches of stored indexes give what those of plain tables do.
ORACLE_SQL |= {
    "bm25_blocks": ORACLE_SQL["bm25_topk"],
    "proximity_indexed": ORACLE_SQL["proximity"],
    "vector_topk_cells": ORACLE_SQL["vector_topk"],
    **{f"{name}_indexed": ORACLE_SQL[name] for name in BOOLEAN},
}
