"""What the operators share: scratch tables in the shared folder, and small Spark helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a task takes from an Arrow batch at once; one larger row goes alone.
BATCH_ROWS, BATCH_BYTES = 1024, 2 << 20

_CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled"


def is_local(master: str) -> bool:
    """Whether driver and tasks are one process, so that any folder is shared."""
    return master == "local" or master.startswith("local[")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; set here only where a local session has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        root = getattr(sc, "_lexigrid_scratch", None)
        given = sc._jsc.sc().getCheckpointDir()
        if not root and given.isDefined():
            root = given.get()
        if not root and not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not root:
            root = sc._lexigrid_scratch = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
            sc.setCheckpointDir(root)
            spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(root))
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared root, removed when the driver's JVM ends."""
    made = f"{shared_root(spark)}/lexigrid-{tag}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return made


def delete_path(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, tag: str, where: str | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends here.

    So do its shuffles: their files are removed when the write has ended.
    """
    spark = df.sparkSession
    where = where or scratch_dir(spark, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(where)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(where)


def bounded(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and ``size`` bytes, if they have strings or lists."""
    for batch in batches:
        n, long = batch.num_rows, [c for c in batch.columns if _is_long(c.type)]
        if n <= 1 or not long or (n <= rows and batch.nbytes <= size):
            yield batch
            continue
        sums = np.cumsum(sum(map(_lengths, long), np.zeros(n, np.int64)))
        at = 0
        while at < n:
            end = int(np.searchsorted(sums, (sums[at - 1] if at else 0) + size, side="right"))
            end = min(max(end, at + 1), at + rows, n)
            yield batch.slice(at, end - at)
            at = end


def _is_long(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_list(kind)


def _lengths(column: pa.Array) -> np.ndarray:
    sizes = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes * 8 if pa.types.is_list(column.type) else sizes


def size_bytes(df: DataFrame) -> int:
    """What the optimizer takes for the size of ``df``: of written tables, their files' bytes."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 56 else 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``: a lambda variable is never evaluated again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_rows(make: Callable, *args) -> Callable[[Iterable], Iterator]:
    """A ``mapInArrow`` function of ``make(*args)``, which is called once in each task.

    It sees bounded slices of Spark's batches, whatever the session's batch sizes are.
    """

    def run(batches):
        yield from make(*args)(bounded(batches))

    return run


def refuse_reserved(df: DataFrame, prefix: str) -> None:
    """Raise where a column has a name that an operator uses between its steps."""
    taken = [c for c in df.columns if c.startswith(prefix)]
    if taken:
        raise ValueError(f"names that begin with {prefix} are reserved: {taken}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
