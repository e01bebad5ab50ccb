"""A corpus pipeline of five stages, from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the one before kept,
and returns a DataFrame that is written as Parquet and read again by the next. All but
the last return the columns of ``documents``; ``n_chars`` follows the text (0 if it is null).

Defined results, besides those of the operators
* null texts are empty to every stage; a stage that leaves a text alone leaves it null.
* documents that line or substring dedup empties stay, with an empty text.
* near copies have a Jaccard similarity of 0.8 at least, of shingles of five words; of a
  group the least id stays; rows that repeat an id stay or go
  together, and rows without an id stay.
* an empty table goes through as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import line_dedup, near_copies, packing, quality_classifier, substring_dedup
from lexigrid.llm._shared import cut, delete_path, documents, scratch_dir


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``changed``, with ``n_chars`` of the new text."""
    columns = [F.length(F.coalesce("text", F.lit(""))).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return changed.select(*columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train(docs, labels, where=~quality_classifier.held_out(F.col("doc_id")))
    return quality_classifier.score(docs, model).where("predicted = 1").select(*docs.columns)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later occurrences of repeated three-line windows go."""
    return _with_text(docs, line_dedup.dedup_lines(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group of verified near copies stays."""
    found = near_copies.copy_groups(docs).where("doc_id <> component").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(found.hint("shuffle_hash"), docs["doc_id"] == found["_dropped"], "left_anti")


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words of 20-word windows that start earlier go."""
    return _with_text(docs, substring_dedup.dedup_substrings(docs))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: ids of all documents in sequences of at most 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", cut_lines),
    ("SimHash near-dedup", drop_copies),
    ("substring dedup", cut_passages),
    ("packing", pack_tokens),
]

#: Scoring and tokenising have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs, behind = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        where = scratch_dir(spark, "stage")
        docs = cut(stage(spark, docs, sf_dir), "stage", where)
        if behind:
            delete_path(spark, behind)
        behind = where
    return STAGES[-1][1](spark, docs, sf_dir)
