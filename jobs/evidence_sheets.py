"""Write the evidence sheet of a list of questions: for each, the passages that bear on it.

    spark-submit jobs/evidence_sheets.py jobs/evidence_sheets.json questions=/data/questions out=/data/sheets sheet=may

Documents are cut to overlapping passages, ranked for each question by BM25, and the best are
reranked by the share of the question's words that they hold. ``out`` has a folder for each
sheet, partitioned by the documents' language, with where the passage stands, its beginning
and the citations in it. A sheet that is written again replaces its folder alone, so a run
gives the same result however often it is repeated.
"""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.citations import distinct_citations
from lexigrid.functions.text import preview
from lexigrid.operators import chunking, fusion, lexical
from lexigrid.session import spread

LOG = logging.getLogger("evidence_sheets")

COLUMNS = "question_id long, question string, rank int, rerank_score double, score double, doc string, chunk_id string, start_offset int, end_offset int, evidence string, citations array<string>, source string, lang string"


@dataclass(frozen=True)
class Config:
    source: str
    questions: str
    out: str
    sheet: str
    question_id: str = "item_id"
    question: str = "text"
    stopwords: tuple[str, ...] = ()
    size: int = 1000
    overlap: int = 150
    candidates: int = 30
    top: int = 10


def write_sheet(spark: SparkSession, config: Config) -> dict:
    """Rank, rerank and write the sheet; returns what was read and written."""
    docs = spread(spark.read.parquet(config.source))
    asked = spark.read.parquet(config.questions)
    asked = asked.select(F.col(config.question_id).cast("long").alias("question_id"), F.col(config.question).alias("question")).where("question_id is not null and question is not null")
    pages = docs.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("doc_name"), F.lit(1).alias("page_number"), "text", F.col("doc_id").cast("long").alias("corpus_ord"))
    chunks = chunking.stride_chunks(pages, config.size, config.overlap)
    tokens = lexical.token_table(chunks, config.stopwords)
    hits = lexical.bm25_search(tokens, asked, config.candidates, config.stopwords, digits=6)
    # Only documents with a hit are cut and read again; Spark knows the size of kept hits, and sends them if they are few.
    hits = hits.persist()
    hits.count()
    placed = hits.select("corpus_ord").distinct()
    chunks = chunking.stride_chunks(pages.join(placed, "corpus_ord", "left_semi"), config.size, config.overlap)
    found = fusion.fetch_chunks(hits, chunks.drop("corpus_ord"))
    best = fusion.rerank(found, asked, config.top)
    holders = docs.join(placed, F.col("doc_id").cast("long") == placed["corpus_ord"], "left_semi")
    origin = holders.select(F.col("doc_id").cast("string").alias("doc"), F.coalesce("lang", F.lit("")).alias("lang"), "source").dropDuplicates(["doc"])
    rows = best.join(origin, "doc").join(asked, "question_id").withColumn("evidence", preview(F.col("text"))).withColumn("citations", distinct_citations(F.col("text")))
    folder = f"{config.out}/sheet={config.sheet}"
    rows.select(*[c.split()[0] for c in COLUMNS.split(", ")]).write.mode("overwrite").partitionBy("lang").parquet(folder)
    hits.unpersist()
    written = output(spark, config.out).where(F.col("sheet") == config.sheet)
    counts = written.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("question_id").alias("answered"), F.countDistinct("doc").alias("documents")).first().asDict()
    report = {"sheet": config.sheet, "questions": asked.count(), "read": docs.count(), **counts}
    LOG.info("sheet %(sheet)s: read %(read)d documents and %(questions)d questions; wrote %(rows)d rows for %(answered)d questions from %(documents)d documents", report)
    return report


def output(spark: SparkSession, out: str) -> DataFrame:
    """All sheets as they stand; a partition without a name holds documents without a language."""
    found = spark.read.schema(f"{COLUMNS}, sheet string").option("basePath", out).parquet(out)
    return found.withColumn("lang", F.coalesce("lang", F.lit("")))


if __name__ == "__main__":
    from jobs.config import run

    run("evidence_sheets", Config, write_sheet)
