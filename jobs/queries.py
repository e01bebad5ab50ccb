"""The jobs as registered queries: run twice into one new folder, its output read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import evidence_sheets, index_refresh
from lexigrid.plans.catalog_sql import STRIDE, strip_sql, tokens_sql
from lexigrid.session import shared_folder

STOPWORDS = ("the", "of", "and", "in", "to")


def job1_index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search index of ``documents``, refreshed twice: the second run finds nothing new."""
    folder = shared_folder(spark, "job1")
    config = index_refresh.Config(f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    for _ in range(2):
        index_refresh.refresh(spark, config)
    found = index_refresh.output(spark, config.out)
    return found.select("term", "chunk_id", "corpus_ord", "dl", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def job2_evidence_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for the items of ``benchmark`` in ``documents``, written twice."""
    folder = shared_folder(spark, "job2")
    config = evidence_sheets.Config(f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder, "benchmark", stopwords=STOPWORDS)
    for _ in range(2):
        evidence_sheets.write_sheet(spark, config)
    found = evidence_sheets.output(spark, folder)
    return found.select("sheet", "question_id", "rank", "rerank_score", "score", "doc", "chunk_id", "start_offset", "end_offset", "evidence", F.size("citations").alias("n_citations"), "source", "lang")


QUERIES = {"job1_index_refresh": job1_index_refresh, "job2_evidence_sheets": job2_evidence_sheets}

_STOPPED = "list_filter({0}, lambda t: t NOT IN ('the', 'of', 'and', 'in', 'to'))"

ORACLE_SQL = {
    "job1_index_refresh": f"""
WITH tokens AS MATERIALIZED (SELECT doc_id, {tokens_sql("text")} AS t FROM (SELECT doc_id, {strip_sql("text")} AS text FROM documents) WHERE len(text) > 0),
placed AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM tokens)
SELECT term, doc_id || '_p1_page_0' AS chunk_id, doc_id AS corpus_ord, dl::INT AS dl, count(*)::INT AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM placed GROUP BY ALL""",
    "job2_evidence_sheets": f"""
WITH chunks AS MATERIALIZED ({STRIDE}),
tok AS MATERIALIZED (SELECT id, corpus_ord, {_STOPPED.format(tokens_sql("text"))} AS tokens FROM chunks),
words AS MATERIALIZED (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM tok),
stats AS MATERIALIZED (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
idfs AS MATERIALIZED (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS x FROM (SELECT term, count(DISTINCT id) AS df FROM words GROUP BY term), stats),
idf AS MATERIALIZED (SELECT term, CASE WHEN x < 0 THEN 0.25 * (SELECT avg(x) FROM idfs) ELSE x END AS idf FROM idfs),
asked AS MATERIALIZED (SELECT item_id, text AS question FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wanted AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_STOPPED.format(tokens_sql("question"))}) AS term FROM asked) GROUP BY ALL),
tf AS MATERIALIZED (SELECT term, id, dl, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
scored AS (SELECT item_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN wanted USING (term) JOIN idf USING (term), stats GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, corpus_ord, id) AS was FROM scored JOIN (SELECT id, corpus_ord FROM tok) USING (id)),
shared AS (SELECT item_id, question, r.id, score, was, doc, start_offset, end_offset, text, list_distinct({tokens_sql("question")}) AS q, list_distinct({tokens_sql("text")}) AS t
  FROM ranked r JOIN chunks USING (id) JOIN asked USING (item_id) WHERE was <= 30 AND score > 0),
again AS (SELECT *, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, t))::DOUBLE / len(q) END, 9) AS rerank_score FROM shared),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, was)::INT AS rank FROM again)
SELECT 'benchmark' AS sheet, item_id AS question_id, rank, rerank_score, score, doc, id AS chunk_id, start_offset, end_offset,
  CASE WHEN len(text) > 300 THEN left(text, 300) || '...' ELSE text END AS evidence, 0 AS n_citations, source, coalesce(lang, '') AS lang
FROM best JOIN (SELECT doc_id::VARCHAR AS doc, lang, source FROM documents) USING (doc) WHERE rank <= 10""",
}
