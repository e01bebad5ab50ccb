"""Byte-level BPE encoding and decoding, with overlapping chunks for long texts.

A text of up to ``chunk`` characters is one chunk, which is encoded where it is read. A
longer one is cut into chunks that overlap by ``OVERLAP`` characters. Chunks are rows of
their own, dealt to all tasks, and are pre-tokenised in parallel; what each tells is only
the pre-token boundaries near its two ends. Neighbours are stitched, from these alone, at
the first boundary inside their overlap that both have: from there on both see the same
text, so all later boundaries agree. The pieces between two stitches, each one match of the
pattern, are then encoded in parallel, chunk by chunk, and their ids are put in a row.

Where neighbours never agree (one pre-token as long as the overlap), they are a run: its
text is put together and pre-tokenised from the last stitch on. Should the next stitch not
be one of its boundaries, as a pattern that counts could make it, the text is encoded whole.

Decoding concatenates the ids' bytes; they need not be valid UTF-8 before they are joined.

Defined results
* null and empty texts have no ids. Every character of a text is encoded, none is special.
* lone surrogates cannot be stored in a Spark string and are not met.
* rows are handled one by one: repeated rows give repeated results; other columns pass
  through, but for ``ids`` which is replaced. An empty table gives an empty table. Names
  beginning ``_bb_`` are reserved, and refused.
* a pattern must match everywhere, look ahead by less than ``MARGIN`` characters beyond
  its match and not look behind.

Scale: short texts are encoded where they are read, without a shuffle. Long ones are written
once with a key; their chunks are shuffled once, spread by key and chunk number, so one
giant text is the work of many tasks. By text only boundaries, then ids, are gathered: ids
are written and shuffled by chunk, packed, and made a list of numbers only in the worker that
puts them in a row (Spark's Parquet reader holds thousands of rows at once, and for each
number of a list its levels too). The memo of pieces is bounded.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexigrid.llm._shared import cut, fold_rows, size_bytes

#: Characters of a chunk, those that neighbours share, and those at an end that are not trusted.
CHUNK, OVERLAP, MARGIN = 1 << 14, 1 << 10, 16
#: Bytes, as written, of the long texts that a task of chunks has.
TASK_BYTES = 8 << 20
#: Pieces whose ids a task remembers.
REMEMBERED = 1 << 17


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Strings:
    """Numbered byte strings; rows of numbers are joined by array operations."""

    def __init__(self, strings: list[bytes]) -> None:
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.store = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray, step: int = 1 << 17) -> np.ndarray:
        parts = [self._joined(numbers[i : i + step]) for i in range(0, len(numbers), step)]
        return np.concatenate(parts) if parts else np.empty(0, np.uint8)

    def _joined(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.store[np.repeat(self.begins[numbers] - (ends - sizes), sizes) + np.arange(ends[-1])]

    def joined_rows(self, numbers: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """One byte string for each row; row i has the numbers from offset i to the next."""
        ends = np.concatenate(([0], np.cumsum(self.sizes[numbers])))[offsets]
        whole = self.joined(numbers).tobytes()
        return [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def codec_of(path: str, pattern: str) -> Codec:
    """The codec of a file, kept by the worker process from task to task."""
    return Codec(path, pattern)


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = load_ranks(path)
        self.find = regex.compile(pattern)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = Strings([token for _, token in sorted((i, token) for token, i in ranks.items())])
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks are not 0, 1, 2 ...")
        self.packed = "<u2" if len(ranks) <= 1 << 16 else "<u4"  # ids between tasks
        self.memo: dict[str, list[int]] = {}

    def pieces(self, text: str, at: int = 0) -> list[str]:
        return self.find.findall(text, at)

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > REMEMBERED:
            memo.clear()
        for piece in [p for p in set(pieces) if p not in memo]:
            memo[piece] = self.library._core_bpe.encode_single_piece(piece.encode())
        return list(chain.from_iterable(map(memo.__getitem__, pieces)))

    def encode(self, text: str) -> np.ndarray:
        """A text that is one chunk: the library splits it and encodes the pieces."""
        return self.library.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens.joined(np.asarray(ids, np.int64)).tobytes()


def chunk_starts(size: int, chunk: int) -> range:
    """Where the chunks of a text begin; the last one reaches its end."""
    stride = chunk - OVERLAP
    return range(0, max(1, -(-(size - OVERLAP) // stride)) * stride, stride)


def edges(codec: Codec, text: str, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries of a chunk that begins at ``start``: those its neighbours before and behind see too."""
    ends = start + np.cumsum([0, *map(len, codec.pieces(text))])
    last = start + len(text)
    return ends[ends < start + OVERLAP], ends[(ends >= last - OVERLAP) & (ends <= last - MARGIN)]


def stitch(heads: list[np.ndarray], tails: list[np.ndarray], size: int) -> list[tuple[int, int, int, int]]:
    """(first chunk, last chunk, begin, end) of the parts of a text, from its chunks' edges."""
    out, first, begin = [], 0, 0
    for i in range(len(heads) - 1):
        both = np.intersect1d(tails[i], heads[i + 1])
        if len(both):
            out.append((first, i, begin, int(both[0])))
            first, begin = i + 1, int(both[0])
    return [*out, (first, len(heads) - 1, begin, size)]


def pieces_between(codec: Codec, text: str, start: int, begin: int, end: int) -> list[str] | None:
    """Pre-tokens from ``begin`` to ``end``, of text from ``start`` on; none if ``end`` isn't a boundary."""
    pieces = codec.pieces(text, begin - start)
    stops = begin + np.cumsum([0, *map(len, pieces)])
    at = int(np.searchsorted(stops, end))
    return pieces[:at] if at < len(stops) and stops[at] == end else None


def _with_ids(schema: pa.Schema, batch: pa.RecordBatch, ids: list[np.ndarray]) -> pa.RecordBatch:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
    made = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat))
    return pa.RecordBatch.from_arrays([made.cast(schema.field(n).type) if n == "ids" else batch.column(batch.schema.get_field_index(n)) for n in schema.names], schema=schema)


def _followed(run: Callable, then: Callable | None) -> Callable:
    return run if then is None else lambda batches: then()(run(batches))


def _encode_short(path: str, pattern: str, text_index: int, schema: pa.Schema, then: Callable | None):
    def run(batches):
        codec = codec_of(path, pattern)
        for batch in batches:
            yield _with_ids(schema, batch, [codec.encode(t or "") for t in batch.column(text_index).to_pylist()])

    return _followed(run, then)


_CHUNKS = "_bb_key long, _bb_at int, _bb_start long, _bb_text string"
_EDGES = "_bb_key long, _bb_at int, _bb_stop long, _bb_head binary, _bb_tail binary"
_SPANS = "_bb_key long, _bb_at int, _bb_first int, _bb_last int, _bb_begin long, _bb_end long"
_PARTS = "_bb_key long, _bb_at int, _bb_ids binary"


def _table(columns: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    named = [c.split() for c in columns.split(", ")]
    values = zip(*rows, strict=True) if rows else [()] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(values, named, strict=True)], [n for n, _ in named])


def _split(chunk: int):
    """(key, text) -> a row for each chunk."""

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts = chunk_starts(len(text), chunk)
                for at in range(0, len(starts), 64):
                    yield _table(_CHUNKS, [(key, at + i, start, text[start : start + chunk]) for i, start in enumerate(starts[at : at + 64])])

    return run


def _find_edges(path: str, pattern: str):
    def run(batches):
        codec = codec_of(path, pattern)
        for batch in batches:
            rows = []
            for key, at, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head, tail = edges(codec, text, start)
                rows.append((key, at, start + len(text), head.astype("<i8").tobytes(), tail.astype("<i8").tobytes()))
            yield _table(_EDGES, rows)

    return run


def _by_key(batches):
    """(key, rows) of runs of equal first columns, in order."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key and rows:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def _stitch():
    def run(batches):
        for key, rows in _by_key(batches):
            heads, tails = ([np.frombuffer(r[i], "<i8") for r in rows] for i in (3, 4))
            parts = stitch(heads, tails, rows[-1][2])
            yield _table(_SPANS, [(key, at, first, last, begin, end) for first, last, begin, end in parts for at in range(first, last + 1)])

    return run


def _encode_spans(path: str, pattern: str):
    """Rows (key, chunk, start, text, first, last, begin, end); the chunks of a run follow each other."""

    def run(batches):
        codec, texts, since = codec_of(path, pattern), [], 0
        for batch in batches:
            out = []
            for key, at, start, text, first, last, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == first:
                    texts, since = [text], start
                else:
                    texts.append(text[OVERLAP:])
                if at == last:
                    pieces = pieces_between(codec, "".join(texts), since, begin, end)
                    out.append((key, at, None if pieces is None else np.array(codec.encode_pieces(pieces), codec.packed).tobytes()))
            yield _table(_PARTS, out)

    return run


def _in_a_row(path: str, pattern: str, schema: pa.Schema, then: Callable | None):
    """Rows of texts, each followed by those of its parts -> texts with their ids; without texts of which a part has none."""

    def run(batches):
        packed, text, parts = codec_of(path, pattern).packed, None, []

        def whole():
            if text is not None and None not in parts:
                yield _with_ids(schema, text, [np.frombuffer(b"".join(parts), packed)])

        for batch in batches:
            places, ids = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("_bb_at", "_bb_ids"))
            for i, (at, part) in enumerate(zip(places, ids, strict=True)):
                if at < 0:
                    yield from whole()
                    text, parts = batch.slice(i, 1), []
                else:
                    parts.append(part)
        yield from whole()

    return _followed(run, then)


def chunk_rows(keyed: DataFrame, text_col: str, chunk: int = CHUNK) -> DataFrame:
    """The chunks of texts with a key ``_bb_key``, spread over tasks."""
    # The filter is that of a join by these columns, which would else shuffle the chunks again.
    rows = keyed.select("_bb_key", text_col).mapInArrow(fold_rows(_split, chunk), _CHUNKS).where("_bb_key is not null and _bb_at is not null")
    # By number, so that few bytes, which are much work, are not put in one task again.
    tasks = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size_bytes(keyed) // TASK_BYTES, 1 << 20))
    return rows.repartition(tasks, "_bb_key", "_bb_at")


def _parts_of_chunks(chunks: DataFrame, path: str, pattern: str) -> DataFrame:
    """``_bb_key, _bb_at, _bb_ids`` of texts in chunks: packed ids of a part each, null where it can't be told apart."""
    found = chunks.mapInArrow(fold_rows(_find_edges, path, pattern), _EDGES)
    spans = found.repartition("_bb_key").sortWithinPartitions("_bb_key", "_bb_at").mapInArrow(fold_rows(_stitch), _SPANS)
    columns = ["_bb_key", "_bb_at", "_bb_start", "_bb_text", "_bb_first", "_bb_last", "_bb_begin", "_bb_end"]
    placed = chunks.join(spans.hint("shuffle_hash"), ["_bb_key", "_bb_at"]).select(*columns)
    alone = placed.where("_bb_first = _bb_last")
    runs = placed.where("_bb_first < _bb_last").repartition("_bb_key", "_bb_first").sortWithinPartitions("_bb_key", "_bb_at")
    return alone.mapInArrow(fold_rows(_encode_spans, path, pattern), _PARTS).unionByName(runs.mapInArrow(fold_rows(_encode_spans, path, pattern), _PARTS))


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK, carry: Sequence[str] | None = None, then: tuple[Callable, str] | None = None) -> DataFrame:
    """``docs`` with ``ids array<int>`` of each text; of its columns those of ``carry``, if given.

    ``then``: what makes a function of these rows' batches, and the columns that it makes of
    them, in the same worker: one Python process a task less, and no ids go back and forth.
    """
    if chunk < 2 * OVERLAP:
        raise ValueError("a chunk is at least twice the overlap")
    if any(c.startswith("_bb_") for c in docs.columns):
        raise ValueError("names that begin with _bb_ are reserved")
    fields = [f for f in docs.schema.fields if f.name != "ids"]
    docs = docs.select(*[f.name for f in fields])
    kept = [f for f in fields if carry is None or f.name in carry]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)
    after, columns = then or (None, schema)
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    whole = fold_rows(_encode_short, path, pattern, docs.columns.index(text_col), arrow, after)
    short = docs.where(size <= chunk).mapInArrow(whole, columns)
    long = cut(docs.where(size > chunk).withColumn("_bb_key", F.monotonically_increasing_id()), "long")
    parts = cut(_parts_of_chunks(chunk_rows(long, text_col, chunk), path, pattern), "long-parts")
    texts = long.select("_bb_key", F.lit(-1).alias("_bb_at"), *[f.name for f in kept])
    rows = texts.unionByName(parts, allowMissingColumns=True).repartition("_bb_key").sortWithinPartitions("_bb_key", "_bb_at")
    made = short.unionByName(rows.mapInArrow(fold_rows(_in_a_row, path, pattern, arrow, after), columns))
    untold = parts.where("_bb_ids is null").select("_bb_key")
    if untold.isEmpty():
        return made
    return made.unionByName(long.join(untold, "_bb_key", "left_semi").select(*docs.columns).mapInArrow(whole, columns))


def id_rows(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all ids in a row, where each row begins and the last ends); null rows are empty."""
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    return np.asarray(column.flatten()).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))


def _decode(path: str, pattern: str, ids_index: int, schema: pa.Schema, then: Callable | None):
    def run(batches):
        codec = codec_of(path, pattern)
        for batch in batches:
            numbers, offsets = id_rows(batch.column(ids_index))
            known = batch.column(ids_index).is_valid().to_pylist()
            made = pa.array([b if k else None for b, k in zip(codec.tokens.joined_rows(numbers, offsets), known, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([made if n == "decoded" else batch.column(batch.schema.get_field_index(n)) for n in schema.names], schema=schema)

    return _followed(run, then)


def decoding(path: str, pattern: str, schema: T.StructType, then: Callable) -> Callable:
    """For ``encode_texts``: what makes ``then`` of its rows, which are of ``schema``, with their ``decoded`` bytes."""
    made = to_arrow_schema(schema.add("decoded", T.BinaryType()))
    return partial(_decode, path, pattern, schema.names.index("ids"), made, then)


def decode_ids(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", then: tuple[Callable, str] | None = None) -> DataFrame:
    """``rows`` with ``decoded binary``: the bytes of the ids, joined. Null ids stay null.

    ``then``: what makes a function of these rows' batches, and the columns that it makes of
    them, in the same worker: one Python process a task less, and no bytes go back and forth.
    """
    fields = [f for f in rows.schema.fields if f.name != "decoded"]
    rows = rows.select(*[f.name for f in fields])
    schema = T.StructType([*fields, T.StructField("decoded", T.BinaryType())])
    made, columns = then or (None, schema)
    return rows.mapInArrow(fold_rows(_decode, path, pattern, rows.columns.index(ids_col), to_arrow_schema(schema), made), columns)
