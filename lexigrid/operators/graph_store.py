"""A document graph that is kept: adds are logged, and merged into tables by bucket of the key.

Adds carry ``seq``, the order in which they were said. Of each attribute of a node the value
of the greatest ``seq`` stays, and of edges between the same two nodes the relation; equal
``seq`` leave the greatest value. So adds may come late, or again, or in any batches: the
tables are the same. Values that are null add nothing.

Below one folder: ``adds_nodes`` and ``adds_edges``, the log, with a ``batch`` partition that a
repeated batch overwrites; ``nodes`` and ``edges``, merged, partitioned by ``bucket``. A merge
reads and rewrites the buckets that its batch touches, by dynamic partition overwrite, and no
other. The log has everything, so tables that were damaged are made again by ``rebuild``.

Scale: a batch costs itself and its buckets; ``buckets`` is chosen so that one fits a few
tasks. Keys are dealt out by hash, so a hot document is as many rows as it has edges.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators.graph import NODE

BUCKETS = 64
_KINDS = {"number": "int"}
#: What is merged: keys, and attributes with the place in time at which each was said.
_KEYS = {"nodes": ("id",), "edges": ("src", "dst")}
_VALUES = {"nodes": {c: _KINDS.get(c, "string") for c in NODE[1:]}, "edges": {"relation": "string"}}


def _ddl(kind: str, said: bool) -> str:
    keys = ", ".join(f"{k} string" for k in _KEYS[kind])
    values = ", ".join(f"{c} {f'struct<seq:long,value:{t}>' if said else t}" for c, t in _VALUES[kind].items())
    return f"{keys}, {values}, {'bucket int' if said else 'seq long'}"


class GraphStore:
    """The graph of a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self, kind: str) -> Column:
        # An edge lies with its source, as questions about it do.
        return F.pmod(F.xxhash64(_KEYS[kind][0]), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ddl)

    def add(self, batch_id: int, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> dict[str, int]:
        """Log and merge a batch (``seq`` and the columns of ``graph``); how many buckets it touched."""
        return {kind: self._add(kind, rows, batch_id) for kind, rows in (("nodes", nodes), ("edges", edges)) if rows is not None}

    def _add(self, kind: str, rows: DataFrame, batch_id: int) -> int:
        where = f"{self.folder}/adds_{kind}/batch={batch_id}"
        rows.select(*_KEYS[kind], *[F.col(c).cast(t) for c, t in _VALUES[kind].items()], F.col("seq").cast("long")).write.mode("overwrite").parquet(where)
        return self._merge(kind, self.spark.read.schema(_ddl(kind, False)).parquet(where))

    def _merge(self, kind: str, adds: DataFrame) -> int:
        said = adds.select(*_KEYS[kind], *[F.when(F.col(c).isNotNull(), F.struct(F.col("seq"), F.col(c).alias("value"))).alias(c) for c in _VALUES[kind]]).withColumn("bucket", self._bucket(kind))
        touched = [r["bucket"] for r in said.select("bucket").distinct().collect()]
        if not touched:
            return 0
        held = self._read(kind, _ddl(kind, True)).where(F.col("bucket").isin(*touched))
        merged = held.unionByName(said).groupBy("bucket", *_KEYS[kind]).agg(*[F.max(c).alias(c) for c in _VALUES[kind]])
        # Grouped by bucket and key, dealt by bucket and a few salts: a bucket is a few files.
        dealt = merged.repartition("bucket", F.pmod(F.xxhash64(*_KEYS[kind]), F.lit(4)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{kind}")
        return len(touched)

    def rebuild(self) -> None:
        """Merge the whole log again."""
        for kind in _KEYS:
            self._merge(kind, self._read(f"adds_{kind}", _ddl(kind, False)))

    def nodes(self) -> DataFrame:
        """``id, kind, name, doc, number, text, entity_type`` as said last."""
        return self._plain("nodes")

    def edges(self) -> DataFrame:
        """``src, dst, relation`` as said last."""
        return self._plain("edges")

    def _plain(self, kind: str) -> DataFrame:
        return self._read(kind, _ddl(kind, True)).select(*_KEYS[kind], *[F.col(c)["value"].alias(c) for c in _VALUES[kind]])
