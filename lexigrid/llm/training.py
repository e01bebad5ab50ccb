"""Fitting a model on a bounded, fixed sample of labelled documents, in one task.

The sample is the ``limit`` labelled rows whose ids have the least hashes, so it is the
same in every run and attempt. It is bounded before texts are joined to it, and of an id
that documents repeat the text of least hash stays, so both its broadcast and the task that
fits see at most ``limit`` rows at any input size.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm._shared import fold_rows


def sample(docs: DataFrame, labels: DataFrame, label: Column, limit: int, where: Column | None = None) -> DataFrame:
    """``doc_id, text, label``; rows without a label or an id are left out, of repeated ids one stays."""
    known = labels.where(label.isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(where) if where is not None else known
    chosen = known.groupBy("doc_id").agg(F.max(label.cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return one.select("doc_id", F.col("least.text").alias("text"), "label")


def _fit(fit: Callable, args: tuple):
    def run(batches):
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        rows.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % (1 << 64), r[0], r[1]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(t, y) for _, t, y in rows], *args))], pa.binary())], ["model"])

    return run


def fit_in_task(rows: DataFrame, fit: Callable[..., Any], *args) -> Any:
    """``fit(list of (text, label), *args)`` of a sample, as pickled by the task."""
    made = rows.repartition(1).mapInArrow(fold_rows(_fit, fit, args), "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([], *args)
