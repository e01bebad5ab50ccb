"""Keep the search index of a growing folder of documents up to date.

    spark-submit jobs/index_refresh.py jobs/index_refresh.json source=/data/documents out=/data/index

Takes the Parquet files of ``source`` that no earlier run took, in a file stream with a
checkpoint, cuts their documents to chunks and appends chunks, postings and term figures to
``out``. Ends when nothing new is left; a run without new files changes nothing, and one that
was broken off does its last batch again, into the same place. ``ask`` in the config: questions
whose best hits in the refreshed index are logged.

``out`` and ``checkpoint`` belong together; neither is of use without the other.
"""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators import lexical
from lexigrid.streaming import incremental

LOG = logging.getLogger("index_refresh")


@dataclass(frozen=True)
class Config:
    source: str
    out: str
    checkpoint: str = ""
    id: str = "doc_id"
    text: str = "text"
    strategy: str = "page"
    stopwords: tuple[str, ...] = ()
    files_per_batch: int = 1000
    ask: tuple[str, ...] = ()
    top: int = 10


def refresh(spark: SparkSession, config: Config) -> list[dict]:
    """Bring the index up to date; returns what each batch wrote."""
    try:
        schema = spark.read.parquet(config.source).select(config.id, config.text).schema
    except AnalysisException as error:
        if "UNABLE_TO_INFER_SCHEMA" not in str(error.getCondition()):
            raise
        LOG.info("%s holds no files yet", config.source)
        return []
    reports: list[dict] = []

    def take(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.col(config.id).cast("string").alias("doc"), F.col(config.id).cast("long").alias("corpus_ord"), F.col(config.text).alias("text"))
        reports.append(incremental.add_batch(spark, rows, config.out, batch_id, 0, config.strategy, config.stopwords))

    # As a pattern a source may be a folder or one file.
    parent, _, name = config.source.rpartition("/")
    pattern = config.source if any(c in config.source for c in "{}[]*?") else f"{parent}/{{{name}}}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_per_batch).parquet(pattern)
    started = stream.writeStream.foreachBatch(take).option("checkpointLocation", config.checkpoint or f"{config.out}/_checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    read = sum(p["numInputRows"] for p in started.recentProgress)
    LOG.info("%s: read %d rows in %d batches", config.source, read, len(reports))
    if config.ask:
        asked = spark.createDataFrame(list(enumerate(config.ask, 1)), "question_id int, question string")
        for hit in search(spark, config, asked).orderBy("question_id", "rank").collect():
            LOG.info("question %d, rank %d: %s (%.6f)", hit["question_id"], hit["rank"], hit["chunk_id"], hit["score"])
    return reports


def search(spark: SparkSession, config: Config, questions: DataFrame) -> DataFrame:
    """The best chunks of ``question_id, question`` in the index as it stands."""
    index = incremental.open_index(spark, config.out)
    return lexical.indexed_search(index, questions, config.top, config.stopwords, digits=6)


def output(spark: SparkSession, out: str) -> DataFrame:
    """The whole index as it stands: postings of all batches."""
    return incremental.table(spark, out, "postings")


if __name__ == "__main__":
    from jobs.config import run

    run("index_refresh", Config, refresh)
