"""Substring dedup with a log-structured fingerprint index.

Words are ``[^\\x20\\x09-\\x0D]+``; a window is ``WINDOW`` (20) consecutive words of one
document. Every word is removed that a window covers whose words also start earlier:
in a document that comes before, or before it in the same document. Windows are judged
on the input, not on what is left.

The index. A window's selected gram is the one of its 11 grams of ``GRAM`` (10) words
with the least hash (the leftmost of equals), so equal windows select equal grams at
equal offsets, and about one gram in six is ever selected. A run is immutable and has a
sorted file for each hash range, of two kinds:
* grams: hashes of selected grams with the place where they were first met;
* windows: 128-bit digests of the windows whose selected gram is not unique.
A batch is hashed to sorted chunks, which are dealt by hash range; the task of a range
reads the range's files of all runs and merge-joins them with the chunks, so runs are never
shuffled. Only windows whose gram was met elsewhere can repeat: those are digested from
their words, and merge-joined with the window files. Equality is that of the 128-bit
digests of the words. A history gram met for the first time wakes its own place, whose
windows are then digested too. The tasks that join also write the batch's run. ``FANOUT``
runs of a level are compacted into one of the next level, so a hash is rewritten once a
level. The folder's latest manifest says what the index holds; a lost attempt's files are
in no manifest. A new ``SubstringIndex`` on the folder goes on where the last one ended.

Documents of a batch must come after those of earlier batches: the manifest keeps the last
one's key, and a batch that begins before it is refused. Order of documents is
(id, crc32 of the text), null ids first. A batch after the first is refused without the
history, whose woken places have to be read.

Defined results
* null and empty texts and texts of less than 20 words: nothing removed; null stays null.
* rows that repeat id and text are one document, each returned with the same result;
  rows that share an id but not a text are different documents.
* an empty table gives an empty table. Other columns pass through, those named
  ``n_words, n_removed, kept_sha256`` are replaced; names beginning ``_sd_`` are refused.

Scale: hashes travel as packed sorted arrays, of the batch alone. A task sends each gram
or window once however often it met it, so what a third of all documents share is summed
before it is shuffled. Texts are shuffled only if they have a place to look at: up to
``SENT`` such documents are counted and their keys sent along to leave out the rest, of
history too; beyond that texts are joined by equality. Documents are joined by id and
crc32, so rows that repeat one are a skewed key that adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_64_digest, xxh3_128_digest

from lexigrid.llm._shared import cut, delete_path, fold_rows, refuse_reserved, scratch_dir, size_bytes

WINDOW, GRAM, FANOUT, FORMAT = 20, 10, 4, 1
#: Documents whose keys are sent to all tasks at most, 16 bytes each.
SENT = 1 << 20
#: Selected grams, or windows, that a task gathers before it sends sorted chunks.
FLUSH = 1 << 19
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 18
#: The place of a null id; the bit of a gram that its task met more than once.
NO_ID, OFTEN = -(1 << 63), np.uint32(1 << 31)
#: Kinds of rows between steps.
GRAMS, PLACES, WAKES, WINDOWS, COVERS, FILES_OF_GRAMS, FILES_OF_WINDOWS = range(7)
_ROWS = "_sd_kind int, _sd_b long, _sd_blob binary"
_WORD = re.compile(rb"[^ \t-\r]+")
#: Odd multiplier of the rolling hash.
_M = 0x9E3779B97F4A7C15


class _WordHashes(dict):
    """Word -> 8 hash bytes, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> bytes:
        self[word] = made = xxh3_64_digest(word)
        return made

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def _rolled(a: np.ndarray, m: int) -> np.ndarray:
    """Polynomial hashes of all runs of ten values."""
    two = a[:-1] * np.uint64(m) + a[1:]
    four = two[:-2] * np.uint64(pow(m, 2, 1 << 64)) + two[2:]
    eight = four[:-4] * np.uint64(pow(m, 4, 1 << 64)) + four[4:]
    return eight[:-2] * np.uint64(pow(m, 2, 1 << 64)) + two[8:]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Hashed:
    """Grams and selections of one text of at least ``WINDOW`` words."""

    def __init__(self, keys: np.ndarray) -> None:
        self.grams = _mixed(_rolled(keys, _M))
        value, at = self.grams, np.arange(len(self.grams), dtype=np.int64)
        for step in (1, 2, 4, 3):  # least of 2, 4, 8 and 11 grams
            right = value[step:] < value[:-step]
            value, at = np.where(right, value[step:], value[:-step]), np.where(right, at[step:], at[:-step])
        self.selected = at  # of each window


def window_digests(words: list[bytes], starts: np.ndarray) -> np.ndarray:
    """The 128-bit digest of the words of each window, joined by one space, as two numbers."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    joined, stops = b" ".join(words), (ends[starts + WINDOW - 1] - 1).tolist()
    begins = np.concatenate(([0], ends))[starts].tolist()
    return np.frombuffer(b"".join([xxh3_128_digest(joined[a:b]) for a, b in zip(begins, stops, strict=True)]), np.uint64).reshape(-1, 2)


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


_GRAM_TYPES = (np.uint64, np.int64, np.uint32, np.uint32)  # hash, id, tag, at
_WINDOW_TYPES = (np.uint64, np.uint64, np.int64, np.uint32, np.uint32)  # digest, id, tag, at
_KNOWN_TYPES = (np.uint64, np.uint64)  # digests in a run
_PLACE_TYPES = (np.int64, np.uint32, np.uint32)


def _unpack(blobs: list[bytes], types: tuple) -> list[np.ndarray]:
    width, parts = sum(np.dtype(t).itemsize for t in types), [[] for _ in types]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for part, t in zip(parts, types, strict=True):
            part.append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) if p else np.empty(0, t) for p, t in zip(parts, types, strict=True)]


def _rows(kind: int, buckets: np.ndarray, columns: tuple) -> list[tuple[int, int, bytes]]:
    """A row for each run of equal buckets (sorted)."""
    if not len(buckets):
        return []
    edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
    return [(kind, int(buckets[a]), _pack(*[c[a:b] for c in columns])) for a, b in zip(edges, edges[1:], strict=False)]


def _place_rows(kind: int, doc_buckets: int, doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> list[tuple[int, int, bytes]]:
    b = (doc % doc_buckets + tag.astype(np.int64) * 40503 % doc_buckets) % doc_buckets
    order = np.argsort(b, kind="stable")
    return _rows(kind, b[order], (doc[order], tag[order], at[order]))


def _range_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hash range of a hash; ranges are in the order of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, b, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(b, pa.int64()), pa.array(blob, pa.binary())], ["_sd_kind", "_sd_b", "_sd_blob"])


def _sliced(rows: list[tuple[int, int, bytes]], size: int = 512):
    for i in range(0, len(rows), size):
        yield _batch(rows[i : i + size])


def _heads(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before it."""
    head = np.ones(len(keys[0]), bool)
    head[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return head


def _by_key(keys: tuple[np.ndarray, ...], rest: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Sorted by key; rows of equal keys stay in order. One more key only where needed."""
    order = np.argsort(keys[0], kind="stable")
    first = keys[0][order]
    if len(keys) > 1 and np.any((first[1:] == first[:-1]) & (keys[1][order][1:] != keys[1][order][:-1])):
        order = np.lexsort((keys[1], keys[0]))
    return [c[order] for c in (*keys, *rest)]


class _Gathered:
    """Per-document arrays, handed over in the order of documents."""

    def __init__(self) -> None:
        self.docs, self.n = [], 0

    def add(self, doc: int, tag: int, at: np.ndarray, *values: np.ndarray) -> None:
        self.docs.append((doc, tag, at.astype(np.uint32), *values))
        self.n += len(at)

    def take(self) -> list[np.ndarray]:
        self.docs.sort(key=lambda d: d[:2])
        size = [len(d[2]) for d in self.docs]
        out = [np.repeat(np.array([d[0] for d in self.docs], np.int64), size), np.repeat(np.array([d[1] for d in self.docs], np.uint32), size)]
        out += [np.concatenate([d[i] for d in self.docs]) for i in range(2, len(self.docs[0]))]
        self.docs, self.n = [], 0
        return out


def _tag(text: bytes) -> int:
    return zlib.crc32(text)


def _hash_batch(buckets: int, doc_buckets: int):
    """Texts -> sorted chunks of selected grams; places of grams that repeat in a chunk."""

    def run(batches):
        words, held = _WordHashes(), _Gathered()

        def flush():
            doc, tag, at, h = held.take()
            h, doc, tag, at = _by_key((h,), (doc, tag, at))
            head = _heads(h)
            again = ~head
            often = np.zeros(len(h), bool)
            often[:-1] = again[1:]
            met = often | again
            yield from _sliced(_place_rows(PLACES, doc_buckets, doc[met], tag[met], at[met]))
            at = np.where(often & head, at | OFTEN, at)
            yield from _sliced(_rows(GRAMS, _range_of(h[head], buckets), (h[head], doc[head], tag[head], at[head])))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                split = raw.split()
                if len(split) >= WINDOW:
                    hashed = _Hashed(words.of(split))
                    chosen = hashed.selected[np.concatenate(([True], hashed.selected[1:] != hashed.selected[:-1]))]
                    held.add(NO_ID if doc is None else doc, _tag(raw), chosen, hashed.grams[chosen])
                    if held.n >= FLUSH:
                        yield from flush()
        if held.n:
            yield from flush()

    return run


def _groups(batches, columns: int):
    """(key, rows) of runs of equal first columns; the partition is sorted by it."""
    key, rows = None, []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(columns)]
        for row in zip(*cols, strict=True):
            if row[0] != key:
                if rows:
                    yield key, rows
                key, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield key, rows


def _save(folder: str, kind: int, b: int, columns: tuple) -> tuple[int, int, bytes]:
    """Write one file of a run; the row that names it."""
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = f"{'grams' if kind == FILES_OF_GRAMS else 'windows'}-{b:08d}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{root}/{name}") as out:
        out.write(_pack(*columns))
    return kind, b, f"{folder}/{name}".encode()


def _load(paths: list[bytes], types: tuple) -> list[np.ndarray]:
    blobs = []
    for path in paths:
        store, where = pafs.FileSystem.from_uri(path.decode())
        with store.open_input_file(where) as source:
            blobs.append(source.read())
    return _unpack(blobs, types)


def _join_grams(folder: str, doc_buckets: int):
    """Rows (range, new, chunk or file) -> places of the batch's grams met elsewhere, history's to wake; the batch's run."""

    def run(batches):
        for b, rows in _groups(batches, 3):
            chunks = [r[1] for r in rows if r[0]]
            if not chunks:
                continue
            mine, known = _unpack(chunks, _GRAM_TYPES), _load([r[1] for r in rows if not r[0]], _GRAM_TYPES)
            new = np.repeat([True, False], [len(mine[0]), len(known[0])])
            h, doc, tag, at = (np.concatenate(c) for c in zip(mine, known, strict=True))
            order = np.lexsort((at & ~OFTEN, tag, doc))
            h, doc, tag, at, new = _by_key((h[order],), (doc[order], tag[order], at[order], new[order]))
            head = _heads(h)
            group = np.cumsum(head) - 1
            size, single = np.bincount(group), (at & OFTEN) == 0
            old, fresh = np.bincount(group, weights=~new) > 0, np.bincount(group, weights=new) > 0
            woken = np.bincount(group, weights=~new & ~single) > 0  # history's own place was woken before
            met = single & (size > 1)[group]
            yield from _sliced(_place_rows(PLACES, doc_buckets, *(c[met & new] for c in (doc, tag, at))))
            wake = met & ~new & (fresh & ~woken)[group]
            yield from _sliced(_place_rows(WAKES, doc_buckets, *(c[wake] for c in (doc, tag, at))))
            often = (size > 1) | (np.bincount(group, weights=~single) > 0)
            first = np.flatnonzero(new)[_heads(h[new])]  # of the batch
            yield _batch([_save(folder, FILES_OF_GRAMS, b, (h[first], doc[first], tag[first], np.where(often[group[first]], at[first] | OFTEN, at[first])))])

    return run


def _per_document(kinds: tuple[int, ...]):
    """Rows (document range, kind, chunk) -> a row for each document and group of kinds, with its distinct places."""

    def run(batches):
        for _, rows in _groups(batches, 3):
            for new in (True, False):
                doc, tag, at = _unpack([r[1] for r in rows if (r[0] in kinds) == new], _PLACE_TYPES)
                order = np.lexsort((at, tag, doc))
                doc, tag, at = doc[order], tag[order], at[order] & ~OFTEN
                some = _heads(doc, tag, at)
                doc, tag, at = doc[some], tag[some], at[some]
                edges = np.flatnonzero(_heads(doc, tag)).tolist() if len(doc) else []
                for i in range(0, len(edges), 1024):
                    part = edges[i : i + 1024]
                    ends = [*edges[i + 1 : i + 1025], len(doc)][: len(part)]
                    blobs = [at[x:y].astype("<u4").tobytes() for x, y in zip(part, ends, strict=True)]
                    columns = [pa.array([new] * len(part), pa.bool_()), pa.array(doc[part]), pa.array(tag[part].astype(np.int64)), pa.array(blobs, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["_sd_new", "_sd_id", "_sd_tag", "_sd_starts"])

    return run


def _hash_windows(buckets: int, doc_buckets: int):
    """Texts with the places of their grams -> sorted chunks of windows; covers known here."""

    def run(batches):
        words, held = _WordHashes(), _Gathered()

        def flush():
            doc, tag, at, new, k1, k2 = held.take()
            k1, k2, doc, tag, at, new = _by_key((k1, k2), (doc, tag, at, new))
            head = _heads(k1, k2)
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = new & ~((doc == doc[first]) & (tag == tag[first]) & (at == at[first]))
            yield from _sliced(_place_rows(COVERS, doc_buckets, doc[later], tag[later], at[later]))
            yield from _sliced(_rows(WINDOWS, _range_of(k1[head], buckets), (k1[head], k2[head], doc[head], tag[head], at[head])))

        for batch in batches:
            for new, doc, tag, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                split = text.encode("utf-8", "surrogatepass").split()
                hashed = _Hashed(words.of(split))
                met = np.zeros(len(hashed.grams), bool)
                met[np.frombuffer(places, "<u4")] = True
                starts = np.flatnonzero(met[hashed.selected])
                held.add(doc, tag, starts, np.full(len(starts), new), *window_digests(split, starts).T)
                if held.n >= FLUSH:
                    yield from flush()
        if held.n:
            yield from flush()

    return run


def _join_windows(folder: str, doc_buckets: int):
    """Rows (range, new, chunk or file) -> covers of the batch; the batch's run of windows that history lacks."""

    def run(batches):
        for b, rows in _groups(batches, 3):
            chunks = [r[1] for r in rows if r[0]]
            if not chunks:
                continue
            k1, k2, doc, tag, at = _unpack(chunks, _WINDOW_TYPES)
            order = np.lexsort((at, tag, doc))
            k1, k2, doc, tag, at = _by_key((k1[order], k2[order]), (doc[order], tag[order], at[order]))
            head = _heads(k1, k2)
            known = _in_runs(k1, k2, _load([r[1] for r in rows if not r[0]], _KNOWN_TYPES))
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = known | ~((doc == doc[first]) & (tag == tag[first]) & (at == at[first]))
            yield from _sliced(_place_rows(COVERS, doc_buckets, doc[later], tag[later], at[later]))
            lacked = head & ~known
            if lacked.any():
                yield _batch([_save(folder, FILES_OF_WINDOWS, b, (k1[lacked], k2[lacked]))])

    return run


def _in_runs(k1: np.ndarray, k2: np.ndarray, runs: list[np.ndarray]) -> np.ndarray:
    """Which digests are in the runs."""
    a, b, new = np.concatenate((runs[0], k1)), np.concatenate((runs[1], k2)), np.repeat([0, 1], [len(runs[0]), len(k1)])
    order = np.lexsort((new, b, a))
    a, b = a[order], b[order]
    head = _heads(a, b)
    old = (new[order] == 0)[np.flatnonzero(head)][np.cumsum(head) - 1]  # old ones come first
    out = np.empty(len(a), bool)
    out[order] = old
    return out[len(runs[0]) :]


def _merge_files(folder: str):
    """Rows (kind, range, file) of several runs -> one file of each kind and range."""

    def run(batches):
        for (kind, b), rows in _groups(((_keyed(batch)) for batch in batches), 2):
            if kind == FILES_OF_GRAMS:
                h, doc, tag, at = _load([r[0] for r in rows], _GRAM_TYPES)
                order = np.lexsort((at & ~OFTEN, tag, doc))
                h, doc, tag, at = _by_key((h[order],), (doc[order], tag[order], at[order]))
                head = _heads(h)
                group = np.cumsum(head) - 1
                often = (np.bincount(group) > 1) | (np.bincount(group, weights=(at & OFTEN) > 0) > 0)
                columns = tuple(c[head] for c in (h, doc, tag, np.where(often[group], at | OFTEN, at)))
            else:
                k1, k2 = _by_key(tuple(_load([r[0] for r in rows], _KNOWN_TYPES)), ())
                head = _heads(k1, k2)
                columns = (k1[head], k2[head])
            yield _batch([_save(folder, kind, b, columns)])

    return run


class _keyed:
    """A batch (kind, range, file) whose first column is the pair of kind and range."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch = batch

    def column(self, i: int):
        return self if i == 0 else self.batch.column(2)

    def to_pylist(self) -> list[tuple]:
        return list(zip(self.batch.column(0).to_pylist(), self.batch.column(1).to_pylist(), strict=True))


def _cut_out(raw: bytes, removed: np.ndarray) -> str:
    """The text without the removed words and the white space behind each."""
    spans = [m.span() for m in _WORD.finditer(raw)]
    ends = [s[0] for s in spans[1:]] + [len(raw)]
    out, at = [], 0
    for i in np.flatnonzero(removed).tolist():
        out.append(raw[at : spans[i][0]])
        at = ends[i]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _remove(text_index: int, schema: pa.Schema):
    """Texts with their covers (or null), as last column -> the texts without covered words."""

    def run(batches):
        for batch in batches:
            texts, counts, gone, digests = [], [], [], []
            for text, starts in zip(batch.column(text_index).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                counts.append(len(words))
                n = 0
                if starts:
                    at = np.frombuffer(starts, "<u4").astype(np.int64)
                    steps = np.zeros(len(words) + 1, np.int64)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + WINDOW, -1)
                    removed = np.cumsum(steps[:-1]) > 0
                    n = int(removed.sum())
                    words = [words[i] for i in np.flatnonzero(~removed).tolist()]
                    text = _cut_out(raw, removed)
                texts.append(text)
                gone.append(n)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            made = {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            made[batch.schema.names[text_index]] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(batch.schema.get_field_index(n)) for n in schema.names], schema.names)

    return run


class SubstringIndex:
    """The log-structured index of a folder; ``dedup_batch`` is the way in.

    ``folder``: where the index is, or is made; None makes one in the scratch folder.
    ``size_bytes``: rough bytes of all texts to come, which set how finely hashes and
    documents are dealt out; any value gives the same result. A folder keeps its own.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, size_bytes: int = 0, fanout: int = FANOUT) -> None:
        self.spark, self.folder, self.fanout = spark, (folder or scratch_dir(spark, "substrings")).rstrip("/"), fanout
        self.buckets, self.doc_buckets = max(256, size_bytes >> 27), max(256, size_bytes >> 21)
        self.version, self.runs = 0, []  # runs: [level, name]
        self.last: list[int] | None = None  # id and crc32 of the last document
        self._open()

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _open(self) -> None:
        path, files = self._files()
        if not files.exists(path(self.folder)):
            return
        names = sorted(f.getPath().getName() for f in files.listStatus(path(self.folder)))
        found = [n for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if found:
            held = json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.folder}/{found[-1]}").values().first())
            if (held["format"], held["window"], held["gram"]) != (FORMAT, WINDOW, GRAM):
                raise ValueError(f"{self.folder} holds another kind of index: {held}")
            self.version, self.runs = held["version"], held["runs"]
            self.buckets, self.doc_buckets, self.last = held["buckets"], held["doc_buckets"], held.get("last")

    def _publish(self, runs: list) -> None:
        """A new manifest; written beside its name first, so it is whole or not there."""
        path, files = self._files()
        facts = {"format": FORMAT, "window": WINDOW, "gram": GRAM, "version": self.version + 1, "buckets": self.buckets, "doc_buckets": self.doc_buckets, "last": self.last, "runs": runs}
        made, named = (path(f"{self.folder}/{n}") for n in (f"_{uuid.uuid4().hex}", f"manifest-{self.version + 1:08d}.json"))
        out = files.create(made)
        out.write(bytearray(json.dumps(facts).encode()))
        out.close()
        if not files.rename(made, named):
            raise RuntimeError(f"another writer has published {named}")
        self.version, self.runs = self.version + 1, runs

    def _run_files(self, runs: list) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(*[f"{self.folder}/{name}/files" for _, name in runs])

    def _merge_join(self, new: DataFrame, kind: int, files: int, make, run: str) -> DataFrame:
        both = new.where(F.col("_sd_kind") == kind).select("_sd_b", F.lit(1).alias("_sd_new"), "_sd_blob")
        if self.runs:
            both = both.unionByName(self._run_files(self.runs).where(F.col("_sd_kind") == files).select("_sd_b", F.lit(0).alias("_sd_new"), "_sd_blob"))
        dealt = both.repartition("_sd_b").sortWithinPartitions("_sd_b")
        return dealt.mapInArrow(fold_rows(make, f"{self.folder}/{run}", self.doc_buckets), _ROWS)

    def compact(self) -> None:
        """While a level has ``fanout`` runs, merge them into one of the next level."""
        while full := [n for n in sorted({r[0] for r in self.runs}) if sum(r[0] == n for r in self.runs) >= self.fanout]:
            mine, name = [r for r in self.runs if r[0] == full[0]], f"run-{uuid.uuid4().hex}"
            dealt = self._run_files(mine).repartition("_sd_kind", "_sd_b").sortWithinPartitions("_sd_kind", "_sd_b")
            cut(dealt.mapInArrow(fold_rows(_merge_files, f"{self.folder}/{name}"), _ROWS), "files", f"{self.folder}/{name}/files")
            self._publish([r for r in self.runs if r not in mine] + [[full[0] + 1, name]])
            for _, old in mine:
                delete_path(self.spark, f"{self.folder}/{old}")

    def _by_document(self, rows: DataFrame, tag: str) -> tuple[DataFrame, str, dict]:
        """Places by document, ``_sd_new`` but for those to wake; where they are, and how many documents have any."""
        dealt = rows.select("_sd_b", "_sd_kind", "_sd_blob").repartition("_sd_b").sortWithinPartitions("_sd_b")
        where = scratch_dir(self.spark, tag)
        found = cut(dealt.mapInArrow(fold_rows(_per_document, (PLACES, COVERS)), "_sd_new boolean, _sd_id long, _sd_tag long, _sd_starts binary"), tag, where)
        return found, where, {r[0]: r[1] for r in found.groupBy("_sd_new").count().collect()}

    @staticmethod
    def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return docs.withColumns({"_sd_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_sd_tag": F.crc32(F.coalesce(F.col(text_col), F.lit("")))})

    @staticmethod
    def _beside(texts: DataFrame, places: DataFrame, n: int, how: str = "inner") -> DataFrame:
        """Texts with the places of their documents; texts without any are not shuffled if few have."""
        keys, places = ["_sd_id", "_sd_tag"], places.select("_sd_id", "_sd_tag", "_sd_starts")
        if n > SENT:
            return texts.join(places.hint("shuffle_hash"), keys, how)
        sent = F.broadcast(places.select(*keys))
        mine = texts.join(sent, keys, "left_semi").join(places.hint("shuffle_hash"), keys)
        if how == "inner":
            return mine
        return mine.unionByName(texts.join(sent, keys, "left_anti").withColumn("_sd_starts", F.lit(None).cast("binary")))

    def _last_key(self, batch: DataFrame, id_col: str, text_col: str) -> list[int] | None:
        """The key of the batch's last document; refuses a batch that doesn't come after the index.

        Texts are read for it only where ids alone don't tell.
        """
        ids = batch.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"))
        ends = ids.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
        if ends["low"] is None:
            return self.last
        if self.last and ends["low"] <= self.last[0]:
            same = ids.where(F.col("id") == self.last[0]).agg(F.min("tag").alias("tag")).first()["tag"]
            if ends["low"] < self.last[0] or same <= self.last[1]:
                raise ValueError(f"the batch begins with document {ends['low']}, which does not come after {self.last} of the index")
        return [ends["high"], ids.where(F.col("id") == ends["high"]).agg(F.max("tag").alias("tag")).first()["tag"]]

    def dedup_batch(self, batch: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``batch`` without repeated windows; the index then holds the batch too.

        ``history``: the documents of all batches before, read again for woken places; an
        index that holds any can't do without.
        """
        refuse_reserved(batch, "_sd_")
        if self.runs and history is None:
            raise ValueError("the index holds earlier batches: their documents are needed as history")
        last = self._last_key(batch, id_col, text_col)
        self.compact()
        run, temporary = f"run-{uuid.uuid4().hex}", []

        def keep(df: DataFrame, tag: str) -> DataFrame:
            temporary.append(scratch_dir(self.spark, tag))
            return cut(df, tag, temporary[-1])

        plain = batch.select(F.col(id_col).cast("long").alias("_sd_id"), F.col(text_col).alias("_sd_text"))
        hashed = keep(plain.mapInArrow(fold_rows(_hash_batch, self.buckets, self.doc_buckets), _ROWS), "grams")
        met = keep(self._merge_join(hashed, GRAMS, FILES_OF_GRAMS, _join_grams, run), "met")
        of_places = hashed.where(F.col("_sd_kind") == PLACES).unionByName(met.where(F.col("_sd_kind").isin(PLACES, WAKES)))
        places, where, n = self._by_document(of_places, "places")
        temporary.append(where)
        texts = self._beside(self._keyed(batch, id_col, text_col), places.where("_sd_new"), n.get(True, 0)).withColumn("_sd_new", F.lit(True))
        columns = ["_sd_new", "_sd_id", "_sd_tag", F.col(text_col).alias("_sd_text"), "_sd_starts"]
        texts = texts.select(*columns)
        if history is not None and n.get(False, 0):
            woken = self._beside(self._keyed(history, id_col, text_col), places.where("not _sd_new"), n[False]).withColumn("_sd_new", F.lit(False))
            texts = texts.unionByName(woken.select(*columns))
        found = keep(texts.mapInArrow(fold_rows(_hash_windows, self.buckets, self.doc_buckets), _ROWS), "windows")
        joined = keep(self._merge_join(found, WINDOWS, FILES_OF_WINDOWS, _join_windows, run), "covers")
        covers, where, n = self._by_document(found.where(F.col("_sd_kind") == COVERS).unionByName(joined.where(F.col("_sd_kind") == COVERS)), "covered")
        temporary.append(where)

        fields = [f for f in batch.schema.fields if f.name not in ("n_words", "n_removed", "kept_sha256")]
        added = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
        names = [f.name for f in fields]
        beside = self._beside(self._keyed(batch.select(*names), id_col, text_col), covers, n.get(True, 0), "left").select(*names, "_sd_starts")
        out = cut(beside.mapInArrow(fold_rows(_remove, names.index(text_col), to_arrow_schema(added)), added), "kept")
        files = met.where(F.col("_sd_kind") == FILES_OF_GRAMS).unionByName(joined.where(F.col("_sd_kind") == FILES_OF_WINDOWS))
        cut(files, "files", f"{self.folder}/{run}/files")
        self.last = last
        self._publish([*self.runs, [0, run]])
        for where in temporary:
            delete_path(self.spark, where)
        return out

    def drop(self) -> None:
        """Remove the index and its folder."""
        delete_path(self.spark, self.folder)
        self.runs = []


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3) -> DataFrame:
    """``docs`` through a new index in ``batches`` ranges of ids, in their order."""
    spark = docs.sparkSession
    index = SubstringIndex(spark, size_bytes=size_bytes(docs))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    bounds = docs.select(key.alias("k")).stat.approxQuantile("k", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = [None, *sorted({int(b) for b in bounds or []}), None]
    outs = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        mine = F.lit(True) if low is None else key > low
        part = docs.where(mine & (F.lit(True) if high is None else key <= high))
        outs.append(index.dedup_batch(part, None if low is None else docs.where(key <= low), id_col, text_col))
    done = outs[0]
    for out in outs[1:]:
        done = done.unionByName(out)
    index.drop()
    return done
