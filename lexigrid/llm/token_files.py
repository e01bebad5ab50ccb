"""Token-id files: ids of whole documents in ascending order of ids, in coded blocks.

``write_ids`` deals documents by ranges of their id, sorts and encodes them, and writes
one file a task: blocks of ``mixing_coder`` one behind the other. Its result, the
manifest, has a row for each block; files are named anew by every attempt, so a file
counts only if a manifest row names it, and a lost or repeated attempt leaves nothing
that is read. ``read_ids`` reads blocks by offset, apart from each other, and checks them.

Defined results
* null and empty texts have the end id alone. Rows that repeat an id follow each other;
  null ids come first. Columns besides id and text are not read.
* an empty table gives an empty manifest, which reads as no rows.

Scale: texts are shuffled once, by range. A task holds one block of about
``BLOCK_IDS`` ids (more only for one longer document). The driver sees a count for each
file. Files go where the folder's scheme says; other schemes than ``file`` need the
library that pyarrow loads for them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import cut, fold_rows, scratch_dir
from lexigrid.llm.mixing_coder import decode_block, encode_block
from lexigrid.llm.tokenizers_io import ids_of

BLOCK_IDS, END_ID = 1 << 20, 1
MANIFEST = "part int, file string, at long, bytes long, before long, n_ids long, n_docs long"
_NAMES = [c.split()[0] for c in MANIFEST.split(", ")]
IDS = "doc_id long, start long, ids binary"


def _write(folder: str, path: str, special: str, end_id: int, block_ids: int):
    def blocks(batches) -> Iterator[tuple[list, list]]:
        ids, docs, parts, n = ids_of(path, special), [], [], 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc, made in zip(batch.column(0).to_pylist(), ids.of([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                docs.append(doc)
                parts.append(np.concatenate((made, end)))
                n += len(parts[-1])
                if n >= block_ids:
                    yield docs, parts
                    docs, parts, n = [], [], 0
        if docs:
            yield docs, parts

    def run(batches):
        part = TaskContext.get().partitionId()
        store, root = pafs.FileSystem.from_uri(folder)
        name, out, at, before, rows = f"part-{part:06d}-{uuid.uuid4().hex}.ids", None, 0, 0, []
        for docs, parts in blocks(batches):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}")
            block, n = encode_block(docs, parts), sum(map(len, parts))
            out.write(block)
            rows.append((part, name, at, len(block), before, n, len(docs)))
            at, before = at + len(block), before + n
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), *[pa.int64()] * 5), strict=True)], _NAMES)

    return run


def write_ids(docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS, special: str = "tokens") -> DataFrame:
    """Write the ids of all documents; returns the manifest, with ``folder`` in each row.

    ``special``: strings of added tokens are ``"tokens"``, or ordinary ``"text"``.
    """
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark, "ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    manifest = cut(dealt.mapInArrow(fold_rows(_write, folder, path, special, end_id, block_ids), MANIFEST), "manifest")
    return manifest.withColumn("folder", F.lit(folder))


def _read():
    def run(batches):
        for batch in batches:
            cols = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("folder", "file", "at", "bytes", "start")}
            for folder, name, at, size, start in zip(*cols.values(), strict=True):
                store, root = pafs.FileSystem.from_uri(folder)
                with store.open_input_file(f"{root}/{name}") as source:
                    docs, parts = decode_block(source.read_at(size, at))
                firsts = start + np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
                for i in range(0, len(docs), 1024):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[i : i + 1024], pa.int64()),
                            pa.array(firsts[i : i + 1024], pa.int64()),
                            pa.array([p.astype("<u4").tobytes() for p in parts[i : i + 1024]], pa.binary()),
                        ],
                        ["doc_id", "start", "ids"],
                    )

    return run


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids``: ids (packed 32-bit) as the files have them, and ids before them."""
    base, bases = 0, []
    for row in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        bases.append((row["part"], base))
        base += row["n"]
    begins = spark.createDataFrame(bases, "part int, base long")
    blocks = manifest.join(begins, "part").withColumn("start", F.col("base") + F.col("before"))
    dealt = blocks.repartition(max(1, min(len(bases) * 4, 4096)), "part", "at")
    return dealt.mapInArrow(fold_rows(_read), IDS)
