"""Dense vectors: embedding, normalisation and exact inner-product search.

Search goes over all rows in one pass for each block of queries: a block is sent along
with the pass (``QUERY_BYTES`` bound it), each task keeps its best ``k`` a query, and
the best of those are ranked by a window. Nothing but these partial results is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrid.functions.text import tokenize

#: Queries that one pass over the vectors serves hold at most so many bytes.
QUERY_BYTES = 32 << 20


def l2_normalize(vector: Column) -> Column:
    """Divided by its length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def _hashed(dim: int):
    """Offline embedding: signed token counts hashed to ``dim`` places, of length 1.

    No model is behind it; it stands in where none is given.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("array<float>")
    def embed(tokens):
        import pandas as pd
        from zlib import crc32

        out = []
        for row in tokens:
            vector = np.zeros(dim, np.float32)
            for token in row if row is not None else ():
                h = crc32(token.encode())
                vector[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            norm = float(np.linalg.norm(vector))
            out.append(vector / norm if norm else vector)
        return pd.Series(out)

    return embed


def embed_texts(rows: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = 384, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """``chunk_id, vec``: by ``embedder`` (column -> column), else hashed term counts."""
    made = embedder(F.col(text_col)) if embedder else _hashed(dim)(tokenize(F.coalesce(F.col(text_col), F.lit(""))))
    return rows.select(F.col(id_col).alias("chunk_id"), made.alias("vec"))


def batched_embedder(make: Callable[[], Callable[[list[str]], list]], size: int = 100, workers: int = 10) -> Callable[[Column], Column]:
    """An embedder of a client that takes texts by the batch: ``size`` texts a call, ``workers`` calls at a time, in order.

    ``make`` gives the client's function in the task; a failed call fails the task.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("array<float>")
    def embed(texts):
        import pandas as pd
        from concurrent.futures import ThreadPoolExecutor

        call, rows = make(), [t or "" for t in texts]
        with ThreadPoolExecutor(workers) as pool:
            parts = pool.map(call, [rows[i : i + size] for i in range(0, len(rows), size)])
            return pd.Series([np.asarray(v, np.float32) for part in parts for v in part])

    return lambda column: embed(F.coalesce(column, F.lit("")))


def select_embedder(adapters: dict[str, Callable], prefer_openai: bool = False) -> tuple[str, Callable | None]:
    """(name, embedder): Gemini unless OpenAI is preferred and there, then OpenAI, then a local one; else the hashed counts."""
    order = ("openai", "local") if prefer_openai else ("gemini", "local")
    for name in order:
        if name in adapters:
            return name, adapters[name]
    return "hashed", None


def _best(query_ids: list, queries: np.ndarray, k: int, digits: int | None):
    """The partition's best ``k`` a query, kept from batch to batch and sent at its end."""

    def run(batches):
        held_names = [np.empty(0, object)] * len(query_ids)
        held_scores = [np.empty(0)] * len(query_ids)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            whole = batch.filter(batch.column(1).is_valid())
            if not whole.num_rows:
                continue
            matrix = np.asarray(whole.column(1).flatten(), np.float64).reshape(whole.num_rows, -1)
            scores = matrix @ queries.T
            if digits is not None:
                scores = np.round(scores, digits)
            names = np.array(whole.column(0).to_pylist(), object)
            for q in range(len(query_ids)):
                every, mine = np.concatenate((held_names[q], names)), np.concatenate((held_scores[q], scores[:, q]))
                if len(mine) > k:  # only what can be among the best is sorted
                    least = np.partition(mine, len(mine) - k)[len(mine) - k]
                    every, mine = every[mine >= least], mine[mine >= least]
                order = np.lexsort((every, -mine))[:k]
                held_names[q], held_scores[q] = every[order], mine[order]
        if id_type is not None:
            sizes = [len(x) for x in held_names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(query_ids, sizes), pa.int64()), pa.array(np.concatenate(held_names).tolist(), id_type), pa.array(np.concatenate(held_scores), pa.float64())],
                ["question_id", "vec_id", "score"],
            )

    return run


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 30, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "question_id", query_vec: str = "query_vec", digits: int | None = 6) -> DataFrame:
    """``question_id, vec_id, score, rank``: the ``k`` greatest inner products of each query."""
    kind = dict(vectors.dtypes)[id_col]
    found = None
    block, size = [], 0

    def one_pass(rows: list) -> DataFrame:
        matrix = np.array([r[1] for r in rows], np.float64)
        return vectors.select(id_col, vec_col).mapInArrow(_best([r[0] for r in rows], matrix, k, digits), f"question_id long, vec_id {kind}, score double")

    for row in queries.select(F.col(query_id).cast("long"), query_vec).where(F.col(query_vec).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        size += 8 * len(row[1])
        if size >= QUERY_BYTES:
            found = one_pass(block) if found is None else found.unionByName(one_pass(block))
            block, size = [], 0
    if block:
        found = one_pass(block) if found is None else found.unionByName(one_pass(block))
    if found is None:
        found = vectors.sparkSession.createDataFrame([], f"question_id long, vec_id {kind}, score double")
    best = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k)
