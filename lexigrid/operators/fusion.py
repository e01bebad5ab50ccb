"""Reciprocal-rank fusion, hybrid retrieval and reranking.

Ranked lists have ``question_id, chunk_id, rank``; all joins are by question and chunk, and
every list holds at most its ``k`` rows a question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrid.functions.text import tokenize


def rrf_fuse(lexical: DataFrame, dense: DataFrame, k: int = 60, top: int | None = None) -> DataFrame:
    """Sum of ``1 / (k + rank)``; ties: lexical hits in their order, then dense hits in theirs."""
    both = lexical.select("question_id", "chunk_id", F.col("rank").alias("bm25_rank"), F.lit(None).cast("int").alias("ann_rank")).unionByName(
        dense.select("question_id", "chunk_id", F.lit(None).cast("int").alias("bm25_rank"), F.col("rank").alias("ann_rank"))
    )

    def part(column: str) -> Column:
        return F.coalesce(F.sum(1.0 / (k + F.col(column))), F.lit(0.0))

    fused = both.groupBy("question_id", "chunk_id").agg(
        F.round(part("bm25_rank") + part("ann_rank"), 12).alias("score"), F.min("bm25_rank").alias("bm25_rank"), F.min("ann_rank").alias("ann_rank")
    )
    order = W.partitionBy("question_id").orderBy(F.desc("score"), F.asc_nulls_last("bm25_rank"), "ann_rank")
    out = fused.withColumn("rank", F.row_number().over(order))
    return out if top is None else out.where(F.col("rank") <= top)


def fetch_chunks(hits: DataFrame, chunks: DataFrame, id_col: str = "id", few: bool = False) -> DataFrame:
    """Hits with their chunks' columns; hits without a chunk go.

    ``few``: the hits are of a known, short list of questions; they are sent to the chunks, which stay where they are.
    """
    return (F.broadcast(hits) if few else hits).join(chunks.withColumnRenamed(id_col, "chunk_id"), "chunk_id")


def hybrid_retrieve(lexical: DataFrame, dense: DataFrame, chunks: DataFrame, k: int = 60, top: int = 10, id_col: str = "id", few: bool = False) -> DataFrame:
    """The first ``top`` of the fusion, and only then those that have a chunk."""
    return fetch_chunks(rrf_fuse(lexical, dense, k, top), chunks, id_col, few)


def overlap_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct tokens that the text has."""
    asked = F.array_distinct(tokenize(question))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, tokenize(text))) / F.size(asked))


def batched_scorer(make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], size: int = 64) -> Callable[[Column, Column], Column]:
    """A scorer of a model that takes (question, text) pairs by the batch.

    ``make`` loads the model, once for a partition; its function is called with ``size`` pairs
    at a time, of as many questions as there are. A failed call fails the task.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    def score(batches):
        import pandas as pd

        model = make()
        for questions, texts in batches:
            pairs = list(zip(questions.fillna(""), texts.fillna(""), strict=True))
            scores = [float(s) for i in range(0, len(pairs), size) for s in model(pairs[i : i + size])]
            yield pd.Series(scores, dtype="float64")

    from collections.abc import Iterator

    import pandas as pd

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return pandas_udf(score, "double")


def rerank(hits: DataFrame, questions: DataFrame, top: int = 10, scorer: Callable[[Column, Column], Column] | None = overlap_score, digits: int = 9) -> DataFrame:
    """The best ``top`` by ``scorer(question, text)``; equal scores keep their order.

    Without a scorer, the first ``top`` as they are. Questions are joined by their id.
    """
    if scorer is None:
        return hits.where(F.col("rank") <= top)
    scored = hits.join(questions.select("question_id", "question"), "question_id").withColumn("rerank_score", F.round(scorer(F.col("question"), F.col("text")), digits))
    order = W.partitionBy("question_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("question")


def top_per_query(scores: DataFrame, k: int, by: str = "question_id", order: tuple[Column, ...] = ()) -> DataFrame:
    best = F.row_number().over(W.partitionBy(by).orderBy(*(order or (F.desc("score"), F.col("chunk_id")))))
    return scores.withColumn("rank", best).where(F.col("rank") <= k)
