"""Incremental ingestion, an extension: new files of a folder to page and token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrid.config import EngineConfig
from lexigrid.operators import chunking, lexical
from lexigrid.sources import files

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, config: EngineConfig | None = None) -> DataFrame:
    config = config or EngineConfig()
    found = spark.readStream.format("binaryFile").schema(_FILES).load(folder)
    return found.where(files.suffix(F.col("path")).isin(*config.extensions))


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, strategy: str = "page") -> StreamingQuery:
    """Append chunks and tokens of new files to ``out``; each batch is written under its id.

    A batch that is run again after a failure overwrites its own folder, so files count once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        pages = files.with_corpus_order(files.extract(batch).where("error is null").drop("error"))
        chunks = chunking.chunk_all(pages, strategy)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={batch_id}")
        lexical.token_table(chunks).write.mode("overwrite").parquet(f"{out}/tokens/batch={batch_id}")

    return stream_files(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Watermarked tumbling counts of events, for streams and tables alike."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
