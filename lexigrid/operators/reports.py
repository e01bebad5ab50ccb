"""Counts and timing reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def corpus_counts(chunks: DataFrame, doc: str = "doc") -> DataFrame:
    return chunks.agg(F.countDistinct(doc).alias("documents"), F.count(F.lit(1)).alias("chunks"))


def index_status(chunks: DataFrame, ready: bool, seconds: float | None) -> DataFrame:
    """One row: ``ready, documents, chunks, build_seconds``; the seconds are null if nothing was timed."""
    return corpus_counts(chunks).select(F.lit(ready).alias("ready"), "documents", "chunks", F.round(F.lit(seconds).cast("double"), 1).alias("build_seconds"))


def success_count(rows: DataFrame, done: Column) -> DataFrame:
    """One row: how many of all rows are done; null is not."""
    return rows.agg(F.count_if(F.coalesce(done, F.lit(False))).alias("done"), F.count(F.lit(1)).alias("tried"))


def first_pages(pages: DataFrame, n: int = 200) -> DataFrame:
    """The first ``n`` pages in corpus order."""
    return pages.orderBy("corpus_ord").limit(n)


def bottleneck_report(timings: DataFrame, flag_above: float = 0.4, limit: float = 30.0) -> DataFrame:
    """Stages by seconds, their share of the total, who is flagged, and if over the limit.

    ``timings``: ``stage, seconds``, summed by stage first; a report has few stages.
    """
    by_stage = timings.groupBy("stage").agg(F.sum("seconds").alias("seconds"))
    total = by_stage.agg(F.sum("seconds").alias("total"))
    order = W.orderBy(F.desc("seconds"), "stage")
    return by_stage.join(F.broadcast(total)).select(
        "stage",
        F.round("seconds", 3).alias("seconds"),
        F.round(100 * F.col("seconds") / F.greatest("total", F.lit(0.001)), 3).alias("percent"),
        (F.col("seconds") > flag_above * F.col("total")).alias("flagged"),
        F.row_number().over(order).alias("priority"),
        (F.col("total") > limit).alias("over_limit"),
    )


def extrapolate(seconds: float, asked: int, of: int = 15) -> float:
    """Seconds for ``of`` questions at the rate of those asked."""
    return seconds * of / max(asked, 1)
