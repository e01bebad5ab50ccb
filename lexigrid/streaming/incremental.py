"""A search index that grows by batches, and answers as one build of everything would.

Tables below one folder, each with a ``batch`` partition that a repeated batch overwrites:
``documents`` (what was taken, by id), ``chunks``, ``postings`` (sorted by term within
files), ``terms`` (chunks that have a term) and ``figures`` (chunks and tokens of the batch).
A document whose id was taken before, in this or an earlier batch, counts once: the first
stays, of one batch the text of least hash.

Scale: a batch reads itself, and of earlier batches the column of ids alone. Figures of
terms and corpus add up over batches, so nothing is counted again; a search reads postings
of the asked terms by a pushed-down filter from every batch.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators import chunking, lexical

LOG = logging.getLogger(__name__)

TABLES = {
    "documents": "doc string, corpus_ord long, text_hash long",
    "chunks": "id string, doc string, page int, start_offset int, end_offset int, text string, chunk_type string, corpus_ord long, token_count int",
    "postings": "term string, chunk_id string, corpus_ord long, dl int, tf int, positions array<int>",
    "terms": "term string, df long",
    "figures": "n long, tokens long, documents long",
}


def table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of all batches, or the part of one batch if ``out`` ends with it."""
    return spark.read.schema(f"{TABLES[name]}, batch long").option("basePath", f"{out}/{name}").parquet(f"{out}/{name}")


def _put(spark: SparkSession, rows: DataFrame, out: str, name: str, batch_id: int) -> DataFrame:
    where = f"{out}/{name}/batch={batch_id}"
    rows.write.mode("overwrite").parquet(where)
    return spark.read.schema(TABLES[name]).parquet(where)


def add_batch(spark: SparkSession, rows: DataFrame, out: str, batch_id: int, first: int = 0, strategy: str = "page", stopwords: Sequence[str] = ()) -> dict:
    """Take the documents (``doc string, corpus_ord long, text string``) that are new; returns what was written.

    ``first``: the number of the first batch of this folder. Rows without an id are left out.
    ``spark`` reads back what was written: a stream's own session has no adaptive execution.
    """
    once = rows.where(F.col("doc").isNotNull()).groupBy("doc").agg(F.min(F.struct(F.xxhash64("text").alias("text_hash"), "corpus_ord", "text")).alias("r")).select("doc", "r.*")
    if batch_id > first:
        known = table(spark, out, "documents").where(F.col("batch") < batch_id).select("doc")
        once = once.join(known, "doc", "left_anti")
    pages = once.select(F.col("doc").alias("doc_name"), F.lit(1).alias("page_number"), "text", "corpus_ord", "text_hash")
    # Texts are read once for the chunks; all else comes from what was written.
    pages = pages.persist()
    try:
        taken = _put(spark, pages.select(F.col("doc_name").alias("doc"), "corpus_ord", "text_hash"), out, "documents", batch_id)
        made = chunking.stride_chunks(pages) if strategy == "stride" else chunking.page_chunks(pages)
        chunks = _put(spark, made.select(*[c.split()[0] for c in TABLES["chunks"].split(", ")]), out, "chunks", batch_id)
    finally:
        pages.unpersist()
    tokens = lexical.token_table(chunks, stopwords)
    found = lexical.row_postings(tokens).sortWithinPartitions("term", "chunk_id")
    postings = _put(spark, found, out, "postings", batch_id)
    terms = _put(spark, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("term"), out, "terms", batch_id)
    sizes = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("tokens"))
    counts = chunks.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(sizes)).join(F.broadcast(taken.agg(F.count(F.lit(1)).alias("documents"))))
    figures = _put(spark, counts.select("n", "tokens", "documents"), out, "figures", batch_id).first().asDict()
    report = {"batch": batch_id, "documents": figures["documents"], "chunks": figures["n"], "tokens": figures["tokens"], "terms": terms.count()}
    LOG.info("batch %(batch)d: wrote %(documents)d documents, %(chunks)d chunks, %(tokens)d tokens, %(terms)d terms", report)
    return report


def open_index(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables that ``lexical.indexed_search`` takes, summed over the batches."""
    corpus = table(spark, out, "figures").agg(F.sum("n").alias("n"), (F.sum("tokens") / F.sum("n")).alias("avgdl"))
    df = table(spark, out, "terms").groupBy("term").agg(F.sum("df").alias("df"))
    terms = df.join(F.broadcast(corpus.select("n"))).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw_idf"))
    idf = terms.agg(F.avg("raw_idf").alias("avg_idf"), F.count(F.lit(1)).alias("n_terms"))
    return {"postings": table(spark, out, "postings").drop("batch"), "terms": terms, "corpus": corpus.join(F.broadcast(idf)), "chunks": table(spark, out, "chunks").drop("batch")}
