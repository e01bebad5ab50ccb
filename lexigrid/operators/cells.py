"""A vector index of cells: exact inner-product search that skips cells, or a few probes.

Centroids are fitted by k-means on a bounded sample; every vector belongs to the nearest
one, and a cell keeps its radius, the greatest distance of a vector from its centroid. For a
query ``q`` no vector of a cell scores more than ``q . centroid + |q| * radius``. An exact
search first searches the most promising cells until they have ``k`` vectors, and then only
those whose bound reaches the k-th best score so far, so it returns what a search of
all vectors does. With ``probes`` it searches that many cells and stops.

Scale: the table of cells is bounded (``CELLS`` rows, ``SAMPLE_BYTES`` of fitted vectors) and
sent to the tasks that read queries. Queries stay distributed: each is joined with the
cells it needs. A cell is dealt out in parts of about ``PART`` vectors, and queries in parts
of about ``QUERIES``, so one crowded cell is many tasks and no group outgrows its two sides.
A task keeps the best ``k`` of each query; only these are ranked. Vectors lie sorted by cell
within files, so a filter on the needed cells skips row groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cells at most, and bytes of vectors (as doubles) that centroids are fitted on.
CELLS, SAMPLE_BYTES = 4096, 64 << 20
#: Vectors and queries of a task, about; scores that are computed at once.
PART, QUERIES, SCORES = 8192, 4096, 1 << 22


def _nearest(centroids: np.ndarray):
    """(id, vector) -> with its cell and its distance from the centroid."""

    def run(batches):
        norms = (centroids**2).sum(axis=1)
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, SCORES // len(centroids))):
                part = batch.slice(at, max(1, SCORES // len(centroids)))
                x = np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
                cell = (norms - 2 * x @ centroids.T).argmin(axis=1)
                away = np.sqrt(((x - centroids[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(away)], ["vec_id", "vec", "cell", "away"])

    return run


def fit_centroids(vectors: DataFrame, cells: int | None = None, rounds: int = 10, sample_bytes: int = SAMPLE_BYTES, seed: int = 7) -> np.ndarray:
    """Centroids of ``vec_id, vec``; ``cells``: the root of their number by default. The sample has the least hashes of ids."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not size["n"]:
        return np.empty((0, 0))
    wanted = min(CELLS, size["n"], cells or max(1, round(size["n"] ** 0.5)))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(wanted, sample_bytes // (8 * max(1, size["dim"]))))
    rows = sample.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    if wanted == 1:
        return np.asarray(vectors.sparkSession.createDataFrame(rows.limit(1).collect(), rows.schema).first()[0].toArray())[None, :]
    return np.array(KMeans(k=wanted, maxIter=rounds, seed=seed).fit(rows).clusterCenters(), np.float64)


def index_tables(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, rounds: int = 10, sample_bytes: int = SAMPLE_BYTES) -> dict[str, DataFrame]:
    """``vectors`` (``vec_id, vec, cell, away``) by cell, and ``centroids`` (``cell, centroid``). Null vectors are left out."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<float>").alias("vec")).where("vec is not null")
    centroids = fit_centroids(rows, cells, rounds, sample_bytes)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, vec array<float>, cell int, away double"
    spark = vectors.sparkSession
    dealt = rows.mapInArrow(_nearest(centroids), schema) if len(centroids) else spark.createDataFrame([], schema)
    return {"vectors": dealt.select("cell", "vec_id", "vec", "away").repartitionByRange("cell", "vec_id"), "centroids": spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")}


class _Cells:
    """The table of cells, as arrays that tasks get."""

    def __init__(self, index: dict[str, DataFrame]) -> None:
        sizes = index["vectors"].groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
        rows = index["centroids"].join(sizes, "cell").orderBy("cell").collect()
        self.cell = np.array([r["cell"] for r in rows], np.int32)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.radius = np.array([r["radius"] for r in rows])
        self.centroid = np.array([r["centroid"] for r in rows], np.float64)


def _bounds(cells: _Cells, k: int, probes: int | None):
    """(question, vector) -> its first cells, and all with what they can reach at most."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, SCORES // max(1, len(cells.cell)))):
                part = batch.slice(at, max(1, SCORES // max(1, len(cells.cell))))
                q = np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
                middle = q @ cells.centroid.T
                order = np.argsort(-middle, axis=1, kind="stable")
                held = np.cumsum(cells.n[order], axis=1)
                # Cells until k vectors are held: one more than those that hold fewer.
                many = np.minimum((held < k).sum(axis=1) + 1, len(cells.cell)) if probes is None else np.full(len(q), min(probes, len(cells.cell)))
                bound = middle + np.sqrt((q**2).sum(axis=1))[:, None] * cells.radius
                width = 0 if probes is not None else len(cells.cell)
                reach = pa.StructArray.from_arrays([pa.array(np.tile(cells.cell[:width], len(q)), pa.int32()), pa.array(bound[:, :width].ravel())], ["cell", "bound"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([cells.cell[o[:m]].tolist() for o, m in zip(order, many, strict=True)], pa.list_(pa.int32())),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * width, pa.int32()), reach),
                    ],
                    ["question_id", "query_vec", "first", "bounds"],
                )

    return run


def _best(k: int, digits: int | None, kind: pa.DataType):
    """A part of a cell's vectors and a part of the queries that need it -> the best ``k`` of each query."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("question_id", pa.int64()), ("vec_id", kind), ("score", pa.float64())])
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        vectors, queries = vectors.combine_chunks(), queries.combine_chunks()
        names = np.array(vectors.column("vec_id").to_pylist(), object)
        x = np.asarray(vectors.column("vec").combine_chunks().flatten(), np.float64).reshape(len(names), -1)
        q = np.asarray(queries.column("query_vec").combine_chunks().flatten(), np.float64).reshape(queries.num_rows, -1)
        ids, out = queries.column("question_id").to_numpy(), ([], [], [])
        step = max(1, SCORES // len(names))
        for at in range(0, len(q), step):
            scores = q[at : at + step] @ x.T
            if digits is not None:
                scores = np.round(scores, digits)
            for i, row in enumerate(scores):
                mine = np.arange(len(row))
                if len(row) > k:  # only what can be among the best is sorted
                    mine = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                mine = mine[np.lexsort((names[mine], -row[mine]))[:k]]
                out[0].append(np.full(len(mine), ids[at + i]))
                out[1].extend(names[mine].tolist())
                out[2].append(row[mine])
        return pa.table([pa.array(np.concatenate(out[0]), pa.int64()), pa.array(out[1], kind), pa.array(np.concatenate(out[2]))], schema=schema)

    return run


class CellSearch:
    """A search of one index for one set of queries (``question_id, query_vec``)."""

    def __init__(self, index: dict[str, DataFrame], queries: DataFrame, k: int = 30, digits: int | None = 6, probes: int | None = None) -> None:
        self.index, self.k, self.digits, self.probes = index, k, digits, probes
        self.cells = _Cells(index)
        known = queries.select(F.col("question_id").cast("long").alias("question_id"), F.col("query_vec").cast("array<double>").alias("query_vec")).where("query_vec is not null")
        schema = "question_id long, query_vec array<double>, first array<int>, bounds array<struct<cell:int,bound:double>>"
        self.queries = known.mapInArrow(_bounds(self.cells, k, probes), schema) if len(self.cells.cell) else queries.sparkSession.createDataFrame([], schema)
        self.query_parts = max(1, -(-known.count() // QUERIES))
        self._parts()

    def _parts(self) -> None:
        spark = self.queries.sparkSession
        self.sizes = spark.createDataFrame([(int(c), int(n), int(-(-n // PART))) for c, n in zip(self.cells.cell, self.cells.n, strict=True)], "cell int, n long, parts int")

    def _searched(self, pairs: DataFrame) -> DataFrame:
        """The best of each query in the cells it is paired with."""
        needed = pairs.select("cell").distinct()
        keys = ["cell", "part", "deal"]
        rows = self.index["vectors"].join(needed, "cell", "left_semi").join(F.broadcast(self.sizes), "cell")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(self.query_parts - 1)))).select(*keys, "vec_id", "vec")
        asked = pairs.join(F.broadcast(self.sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        asked = asked.withColumn("deal", F.pmod(F.xxhash64("question_id"), F.lit(self.query_parts)).cast("int")).select(*keys, "question_id", "query_vec")
        field = self.index["vectors"].schema["vec_id"].dataType
        from pyspark.sql.pandas.types import to_arrow_type

        made = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_best(self.k, self.digits, to_arrow_type(field)), f"question_id long, vec_id {field.simpleString()}, score double")
        return self._ranked(made)

    def _ranked(self, found: DataFrame) -> DataFrame:
        order = W.partitionBy("question_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)

    def first_pairs(self) -> DataFrame:
        return self.queries.select("question_id", "query_vec", F.explode("first").alias("cell"))

    def more_pairs(self, found: DataFrame) -> DataFrame:
        """Cells besides the first ones that may hold a vector as good as the k-th found."""
        last = found.where(F.col("rank") == self.k).select("question_id", F.col("score").alias("least"))
        slack = 10.0 ** -self.digits if self.digits is not None else 1e-9
        able = F.filter("bounds", lambda b: (F.col("least").isNull() | (b["bound"] >= F.col("least") - slack)) & ~F.array_contains("first", b["cell"]))
        return self.queries.join(last, "question_id", "left").select("question_id", "query_vec", F.explode(F.transform(able, lambda b: b["cell"])).alias("cell"))

    def result(self) -> DataFrame:
        """``question_id, vec_id, score, rank``: the ``k`` greatest inner products of each query."""
        found = self._searched(self.first_pairs())
        if self.probes is not None:
            return found
        return self._ranked(found.drop("rank").unionByName(self._searched(self.more_pairs(found)).drop("rank")))

    def rows_read(self) -> DataFrame:
        """``question_id, rows``: vectors that the search compares with each query."""
        pairs = self.first_pairs()
        if self.probes is None:
            pairs = pairs.unionByName(self.more_pairs(self._searched(pairs)))
        return pairs.join(F.broadcast(self.sizes), "cell").groupBy("question_id").agg(F.sum("n").alias("rows"))


def search(index: dict[str, DataFrame], queries: DataFrame, k: int = 30, digits: int | None = 6, probes: int | None = None) -> DataFrame:
    """``question_id, vec_id, score, rank``, exact; with ``probes``, from that many cells of each query."""
    return CellSearch(index, queries, k, digits, probes).result()
