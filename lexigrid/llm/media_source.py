"""Media columns: payloads stored losslessly as 8-bit audio in archives, and read back.

A payload is stored as a WAV file of 8-bit mono samples, one for each byte; a chunk of
its own keeps the length before padding. Files are members of zip archives, which tasks
stream into one folder. ``MediaArchives`` is a Spark data source over such a folder: it
plans partitions of byte ranges of archives. The manifest, a Parquet table beside them, has
a row for each range, with the slice of the archive's directory that lists its members; a
task reads that slice alone. Without a manifest ranges are planned from names and sizes,
and a task reads the whole directory. Members are streamed as Arrow batches. Each is read
at its offset, checked by its CRC, and on an error is read again by itself, from a file
opened anew; members that were read are not repeated.

Archives are named anew by every attempt, and the manifest says which count.

Defined results
* null and empty texts: 64 zero bytes, length 0. Equal texts have equal media.
* rows that repeat an id are members of their own; a null id comes back as null. Columns
  besides id and text are not read. An empty table gives no member.
* a member that can't be read after ``RETRIES`` attempts fails the task, or, with the
  option ``onError=null``, is a row with null media and the error.

Scale: archives have about ``ARCHIVE_BYTES`` and are never held; a task holds the names of
one archive's members in writing and a batch of ``BATCH_BYTES`` in reading. The planner
reads one manifest row for ``RANGE_BYTES`` of archives and passes nothing else on.
"""

from __future__ import annotations

import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from lexigrid.llm._shared import cut, fold_rows, scratch_dir

PAD, RATE = 64, 8000
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, RETRIES = 512 << 20, 64 << 20, 4 << 20, 3
#: A row a byte range: where its members begin, and its slice of the archive's directory.
MANIFEST = "archive string, begin long, end long, directory long, directory_bytes long, members long"
_NAMES = [c.split()[0] for c in MANIFEST.split(", ")]
#: A member's header, and its entry in an archive's directory.
_LOCAL = struct.Struct("<4sHHHHHIIIHH")
_ENTRY = struct.Struct("<4sHHHHHHIIIHHHHHII")


def to_payload(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes padded with zeros to a positive multiple of 64, length before)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % PAD if raw else PAD), len(raw)


def to_media(payload: bytes, n_bytes: int) -> bytes:
    """WAV file: 8-bit mono; the chunk ``nbyt`` has the length before padding."""
    data = payload + bytes(len(payload) & 1)
    chunks = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"nbyt" + struct.pack("<IQ", 8, n_bytes) + b"data" + struct.pack("<I", len(payload)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def from_media(media: bytes) -> tuple[bytes, int]:
    """(samples as bytes, length before padding) of a file that ``to_media`` made."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, found = 12, {}
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        found[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if struct.unpack_from("<HH", found[b"fmt "])[1] != 1 or struct.unpack_from("<H", found[b"fmt "], 14)[0] != 8:
        raise ValueError("not 8-bit mono")
    return found[b"data"], struct.unpack("<Q", found[b"nbyt"])[0]


def feature(payload: bytes) -> str:
    """Mean, root mean square about 128, peak and zero crossings of the samples."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    rms = float(np.sqrt(np.square(samples, dtype=np.int64).sum() / len(samples)))
    return f"mean={samples.mean():.4f};rms={rms:.4f};peak={int(np.abs(samples).max())};crossings={crossings}"


class _Stream:
    """A file that is only written to, never sought in."""

    def __init__(self, out) -> None:
        self.write, self.flush = out.write, lambda: None


def _ranges(name: str, archive: zipfile.ZipFile, range_bytes: int) -> pa.RecordBatch:
    """Manifest rows of a closed archive."""
    rows, at = [], archive.start_dir
    for info in archive.filelist:
        size = _ENTRY.size + len(info.filename.encode()) + len(info.extra) + len(info.comment)
        if not rows or info.header_offset - rows[-1][1] >= range_bytes:
            rows.append([name, info.header_offset, info.header_offset, at, 0, 0])
        rows[-1][2] = info.header_offset + 1
        rows[-1][4] += size
        rows[-1][5] += 1
        at += size
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 5), strict=True)], _NAMES)


def _write(folder: str, archive_bytes: int, range_bytes: int):
    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        part, out, archive, name = TaskContext.get().partitionId(), None, None, ""

        def close() -> pa.RecordBatch:
            archive.close()
            out.close()
            return _ranges(name, archive, range_bytes)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None:
                    store.create_dir(root, recursive=True)
                    name = f"media-{part:06d}-{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                info = zipfile.ZipInfo(f"{len(archive.filelist):08d}.{'' if doc is None else doc}.wav")
                archive.writestr(info, to_media(*to_payload(text)), zipfile.ZIP_DEFLATED, 1)
                if archive.start_dir >= archive_bytes:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    return run


def write_media(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES, range_bytes: int = RANGE_BYTES) -> tuple[str, DataFrame]:
    """Store each text in archives under ``folder``; (folder, the manifest beside them)."""
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark, "media")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return folder, cut(rows.mapInArrow(fold_rows(_write, folder, archive_bytes, range_bytes), MANIFEST), "ranges", f"{folder}/manifest")


class ByteRange(InputPartition):
    """Members that begin in a range; ``directory``: (offset, bytes) of the slice that lists them, if known."""

    def __init__(self, archive: str, begin: int, end: int, directory: tuple[int, int] | None = None) -> None:
        self.archive, self.begin, self.end, self.directory = archive, begin, end, directory


class MediaArchives(DataSource):
    """``spark.read.format("media_archives")``; options: ``path``, ``manifest`` (a Parquet
    folder; else all archives of the path, in ranges of ``rangeBytes``), ``retries``, ``onError``."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id long, archive string, offset long, media binary, error string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MediaReader(schema, dict(self.options))


class MediaReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        lower = {k.lower(): v for k, v in options.items()}
        self.schema, self.folder, self.manifest = schema, lower["path"], lower.get("manifest")
        self.range_bytes, self.retries = int(lower.get("rangebytes", RANGE_BYTES)), int(lower.get("retries", RETRIES))
        self.null_errors = lower.get("onerror", "fail") == "null"

    def partitions(self) -> list[ByteRange]:
        if self.manifest is not None:
            store, root = pafs.FileSystem.from_uri(self.manifest)
            rows = pq.ParquetDataset(root, filesystem=store).read(columns=_NAMES[:-1])
            return [ByteRange(name, begin, end, (at, size)) for name, begin, end, at, size in sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True))]
        store, root = pafs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(pafs.FileSelector(root))
        archives = sorted((f.base_name, f.size) for f in found if f.is_file and f.extension == "zip")
        return [ByteRange(name, at, min(at + self.range_bytes, size)) for name, size in archives for at in range(0, size, self.range_bytes)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no archive
            return
        store, root = pafs.FileSystem.from_uri(self.folder)
        where, rows, size = f"{root}/{partition.archive}", [], 0
        for offset, name, packed, crc, method in self._again(lambda: directory(store, where, partition.directory)):
            if not partition.begin <= offset < partition.end:
                continue
            media, error = None, None
            try:
                media = self._again(lambda offset=offset, packed=packed, crc=crc, method=method: member(store, where, offset, packed, crc, method))
            except Exception as failed:
                if not self.null_errors:
                    raise
                error = f"{type(failed).__name__}: {failed}"
            doc = name.split(".")[1]
            rows.append((int(doc) if doc else None, partition.archive, offset, media, error))
            size += len(media or b"")
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        schema = to_arrow_schema(self.schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def _again(self, read):
        for attempt in range(self.retries):
            try:
                return read()
            except (OSError, ValueError, zlib.error, zipfile.BadZipFile):
                if attempt + 1 == self.retries:
                    raise
                time.sleep(0.05 * 2**attempt)


def directory(store: pafs.FileSystem, where: str, part: tuple[int, int] | None = None) -> list[tuple[int, str, int, int, int]]:
    """(offset, name, packed bytes, crc, method) of each member, of a slice of the directory or of all."""
    with store.open_input_file(where) as source:
        if part is None:
            with zipfile.ZipFile(source) as archive:
                return [(i.header_offset, i.filename, i.compress_size, i.CRC, i.compress_type) for i in archive.infolist()]
        data = source.read_at(part[1], part[0])
    found, at = [], 0
    if len(data) < part[1]:
        raise ValueError("the directory is cut off")
    while at < len(data):
        magic, _, _, _, method, _, _, crc, packed, _, name, extra, comment, _, _, _, offset = _ENTRY.unpack_from(data, at)
        if magic != b"PK\x01\x02":
            raise ValueError(f"no directory entry at {part[0] + at}")
        found.append((offset, data[at + _ENTRY.size : at + _ENTRY.size + name].decode(), packed, crc, method))
        at += _ENTRY.size + name + extra + comment
    return found


def member(store: pafs.FileSystem, where: str, offset: int, packed: int, crc: int, method: int) -> bytes:
    """One member, read at its offset from a file opened for it alone, and checked."""
    with store.open_input_file(where) as source:
        head = source.read_at(_LOCAL.size, offset)
        if len(head) < _LOCAL.size or head[:4] != b"PK\x03\x04":
            raise ValueError(f"no member at {offset}")
        *_, name_size, extra_size = _LOCAL.unpack(head)
        data = source.read_at(packed, offset + _LOCAL.size + name_size + extra_size)
    media = zlib.decompress(data, -15) if method == zipfile.ZIP_DEFLATED else data
    if zlib.crc32(media) != crc:
        raise ValueError(f"member at {offset} is damaged")
    return media


def read_media(spark: SparkSession, folder: str, manifest: str | None = "manifest", **options: str) -> DataFrame:
    """``doc_id, archive, offset, media, error`` of a folder's archives.

    ``manifest``: its name in the folder; None takes all archives of the folder.
    """
    spark.dataSource.register(MediaArchives)
    reader = spark.read.format("media_archives").option("path", folder).options(**options)
    return (reader.option("manifest", f"{folder}/{manifest}") if manifest else reader).load()


def _decode(media_index: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            found = [(None, None) if m is None else from_media(m) for m in batch.column(media_index).to_pylist()]
            made = {
                "payload": pa.array([p for p, _ in found], pa.binary()),
                "n_bytes": pa.array([n for _, n in found], pa.int64()),
                "feature": pa.array([None if p is None else feature(p) for p, _ in found], pa.string()),
            }
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(batch.schema.get_field_index(n)) for n in schema.names], schema=schema)

    return run


def decode_media(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """``rows`` with ``payload`` (samples), ``n_bytes`` and ``feature`` of their media."""
    fields = [f for f in rows.schema.fields if f.name not in ("payload", "n_bytes", "feature")]
    rows = rows.select(*[f.name for f in fields])
    schema = T.StructType([*fields, T.StructField("payload", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("feature", T.StringType())])
    return rows.mapInArrow(fold_rows(_decode, rows.columns.index(media_col), to_arrow_schema(schema)), schema)
