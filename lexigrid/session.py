"""Session helpers: one place for defaults, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexigrid")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(scan: DataFrame) -> DataFrame:
    """A table as it is read; of fewer partitions than cores, its rows dealt out to all of them.

    A file of one row group is one task whatever follows. Larger inputs have a partition for
    every core, and are never shuffled by this.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_folder(spark: SparkSession, tag: str, keep: bool = True) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset, a local session gets one.

    The folder is left to its user, or removed when the driver's JVM ends.
    """
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
        sc.setCheckpointDir(root)
    made = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if not keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return made


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once for each application.

    Executors then need no installed copy; where they have one, nothing changes.
    """
    sc = spark.sparkContext
    if getattr(sc, "_lexigrid_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lexigrid-ship-")
    target = os.path.join(folder, "lexigrid_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for top, dirs, names in os.walk(_PACKAGE):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(target)
    sc._lexigrid_shipped = True


#: SQL functions of a session; bodies are expressions, so the optimizer sees through them.
FUNCTIONS = {
    "lexigrid_tokenize(t STRING) RETURNS ARRAY<STRING>": r"filter(split(regexp_replace(lower(t), '[^a-z0-9]', ' '), ' +'), x -> x <> '')",
    "lexigrid_clean_text(t STRING) RETURNS STRING": r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n|\r', '\n'), '[ \t]+', ' '), '\n{3,}', '\n\n'), '^[\\s\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x1c-\\x1f\\x85\\p{Z}]+$', '')",
}


def register_functions(spark: SparkSession) -> None:
    """Make the text functions known to SQL of this session."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
