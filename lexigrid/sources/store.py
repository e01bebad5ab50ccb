"""Persisted indexes: Parquet tables with a JSON manifest, and the embedding cache."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.session import shared_folder

FORMAT_VERSION = 2


def save_tables(folder: str, kind: str, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], **facts) -> None:
    """Write tables, then the manifest: a folder without one is not an index.

    A table may be a function of those that were written before it.

    Postings and embeddings are sorted within files by their first column, so that
    Parquet statistics prune what a query doesn't ask for.
    """
    spark = next(iter(tables.values())).sparkSession
    saved: dict[str, DataFrame] = {}
    for name, table in tables.items():
        table = table(saved) if callable(table) else table
        table.sortWithinPartitions(table.columns[0]).write.mode("overwrite").parquet(f"{folder}/{name}")
        saved[name] = spark.read.schema(table.schema).parquet(f"{folder}/{name}")
    manifest = {"format": FORMAT_VERSION, "kind": kind, "tables": sorted(tables), **facts}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    try:
        return json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    except Exception:  # there is no readable manifest: no index
        return None


def load_tables(spark: SparkSession, folder: str, kind: str) -> dict[str, DataFrame]:
    manifest = read_manifest(spark, folder)
    if manifest is None:
        raise FileNotFoundError(f"no index in {folder}")
    if (manifest["kind"], manifest["format"]) != (kind, FORMAT_VERSION):
        raise ValueError(f"{folder} holds {manifest['kind']} of format {manifest['format']}, not {kind} of {FORMAT_VERSION}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["tables"]}


def numbered(rows: DataFrame, order: str, name: str, first: int = 0) -> DataFrame:
    """``rows`` with a number from ``first`` in the order of a column, however many there are.

    Rows are written by ranges of the column, each with its place in its range; the counts of
    the ranges, one number for each, then say where a range begins. ``_part`` and ``_nth`` are used
    between. Rows of equal ``order`` come in any order.
    """
    spark = rows.sparkSession
    marked = rows.repartitionByRange(order).sortWithinPartitions(order)
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    folder = shared_folder(spark, "numbered", keep=False)
    marked.select("*", F.spark_partition_id().alias("_part"), nth.alias("_nth")).write.parquet(folder)
    held = spark.read.parquet(folder)
    starts, at = [], first
    for r in held.groupBy("_part").count().orderBy("_part").collect():
        starts.append((r["_part"], at))
        at += r["count"]
    offsets = spark.createDataFrame(starts, "_part int, _start long")
    return held.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_nth")).drop("_part", "_nth", "_start")


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cache_key(text: str = "text"):
    return F.sha2(F.col(text), 256)


def cached_embeddings(chunks: DataFrame, cached: DataFrame | None, model: str, embed) -> DataFrame:
    """``chunk_id, vec, text_sha, model`` of all chunks; ``embed`` is given only those the cache lacks."""
    keyed = chunks.select(F.col("id").alias("chunk_id"), "text", cache_key().alias("text_sha"))
    if cached is None:
        missing, known = chunks, None
    else:
        missing = embedding_misses(chunks, cached, model)
        known = cached.where(F.col("model") == model).join(keyed.select("chunk_id", "text_sha"), ["chunk_id", "text_sha"], "left_semi").dropDuplicates(["chunk_id", "text_sha"])
    made = embed(missing).join(keyed.select("chunk_id", "text_sha"), "chunk_id").withColumn("model", F.lit(model)).select("chunk_id", "vec", "text_sha", "model")
    return made if known is None else made.unionByName(known.select("chunk_id", "vec", "text_sha", "model"))


def embedding_misses(chunks: DataFrame, cached: DataFrame, model: str, id_col: str = "id") -> DataFrame:
    """Chunks whose id, text and model have no cached embedding: only these are embedded.

    ``cached``: ``chunk_id, text_sha, model`` (and ``vec``).
    """
    keyed = chunks.withColumn("text_sha", cache_key())
    known = cached.where(F.col("model") == model).select(F.col("chunk_id").alias("_id"), F.col("text_sha").alias("_sha"))
    return keyed.join(known, (F.col(id_col) == F.col("_id")) & (F.col("text_sha") == F.col("_sha")), "left_anti")
