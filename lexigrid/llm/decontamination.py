"""Benchmark decontamination by winnowing: words of documents that repeat a test item.

A window is ``WINDOW`` consecutive words of an item, or all words of a shorter one. Of the
``k``-grams in a window the one of least hash is its fingerprint, the last one of equals
(``k`` is ``GRAM``, or the window's length if that is less). Documents choose fingerprints
by the same rule, so equal windows choose equal fingerprints: whatever span of a document
has a window's words has a fingerprint of the item. Fingerprints of both sides are joined;
a hit is extended to the windows that chose it, and these are compared word by word, so a
hash only ever proposes. A document word in any window so found is hit.

Defined results
* null and empty texts have no words and no hits; an item without words has no window.
* rows are judged one by one: rows that repeat an id, or have none, each have their result.
* items of one id are one item with the windows of all its rows; windows of items without
  an id count as hits and name no item. Item ids are cast to strings.
* without documents there are no rows; without items nothing is hit.
* extra columns pass through; those named like a result (``n_words``, ``n_hit``, ``items``,
  ``spans``) are replaced. Names that begin with ``_dc_`` are refused.

Scale: a benchmark is small beside a corpus. Up to ``SENT_WINDOWS`` distinct windows of
``SENT_BYTES`` in all, counted first, are sent to the tasks; then documents are read once
and nothing of them is shuffled. A larger benchmark is joined by equality: fingerprints of
documents meet those of the items, only hits go on to be extended, and what a document
gathers is bounded by its own length and the items it holds. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrid.llm._shared import cut, fold_rows, refuse_reserved
from lexigrid.llm.byte_words import Words, byte_class, mixed

WINDOW, GRAM = 10, 5
#: Distinct windows, and bytes of them with their items' ids, that are sent to tasks.
SENT_WINDOWS, SENT_BYTES = 1 << 18, 32 << 20

_MADE = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_FACTOR = 0xC2B2AE3D27D4EB4F


def _grams(hashes: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A hash of ``n`` words from each word on, of those that have ``n``; by position."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    sums, power = np.full(size, salt, np.uint64), 1
    for i in range(n):
        sums += hashes[i : i + size] * np.uint64(power)
        power = power * _FACTOR % (1 << 64)
    return mixed(sums)


def _chosen(hashes: np.ndarray, left: np.ndarray, n: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows of ``n`` words, the place of each one's fingerprint, and gram hashes."""
    k = min(gram, n)
    grams, starts = _grams(hashes, k, n), np.flatnonzero(left >= n)
    place = starts.copy()
    if len(starts):
        least = grams[starts]
        for d in range(1, n - k + 1):
            other = grams[starts + d]
            lower = other <= least
            least, place = np.where(lower, other, least), np.where(lower, starts + d, place)
    return starts, place, grams


def _held(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


class Index:
    """Windows of the items, by length: fingerprints to look for and texts to compare with."""

    def __init__(self, rows: list[tuple[int, int, bytes, list[str]]]) -> None:
        self.bodies: dict[int, dict[bytes, list[str]]] = {}
        prints: dict[int, list[int]] = {}
        for n, fingerprint, body, items in rows:
            self.bodies.setdefault(n, {})[bytes(body)] = items
            prints.setdefault(n, []).append(fingerprint)
        self.prints = {n: np.unique(np.array(found, np.int64).view(np.uint64)) for n, found in prints.items()}

    def found(self, words: Words, gram: int) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, length, items) of each window of the texts that items have too."""
        hashes, left = words.hashes(), words.left()
        for n, prints in self.prints.items():
            starts, place, grams = _chosen(hashes, left, n, gram)
            seen = np.zeros(len(hashes), bool)
            seen[place] = True
            seeds = np.flatnonzero(seen)
            hit = np.zeros(len(hashes), bool)
            hit[seeds[_held(prints, grams[seeds])]] = True
            bodies = self.bodies[n]
            for start in starts[hit[place]].tolist():
                items = bodies.get(words.joined(start, n))
                if items is not None:
                    yield start, n, items


def _covered(words: Words, found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hit words of each text, and first words, ends and texts of the spans they form."""
    edge = np.zeros(len(words) + 1, np.int64)
    if found:
        starts, sizes = np.array(found).T
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + sizes, -1)
    hit = np.cumsum(edge)[:-1] > 0
    sums = np.concatenate(([0], np.cumsum(hit)))
    first = np.zeros(len(words) + 1, bool)
    first[words.row] = True
    opens = np.flatnonzero(hit & (first[:-1] | ~np.concatenate(([False], hit[:-1])))) if len(hit) else np.empty(0, np.int64)
    closes = np.flatnonzero(hit & (first[1:] | ~np.concatenate((hit[1:], [False])))) + 1 if len(hit) else np.empty(0, np.int64)
    return sums[words.row[1:]] - sums[words.row[:-1]], opens, closes, np.searchsorted(words.row, opens, side="right") - 1


def _result(words: Words, found: list[tuple[int, int]], items: list[list[str]]) -> list[pa.Array]:
    n_hit, opens, closes, texts = _covered(words, found)
    base = words.row[texts]
    bounds = np.searchsorted(texts, np.arange(len(words.row)))
    spans = pa.StructArray.from_arrays([pa.array(opens - base), pa.array(closes - base)], fields=list(_SPAN))
    return [
        pa.array(words.counts(), pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array(items, pa.list_(pa.string())),
        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans),
    ]


def _search(index, gram: int, text_at: int, keep: list[int], names: list[str]):
    def run(batches):
        table, known = byte_class(digits=True), index.value
        for batch in batches:
            words = Words(batch.column(text_at), table)
            places: list[tuple[int, int]] = []
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for start, n, owners in known.found(words, gram):
                places.append((start, n))
                items[int(np.searchsorted(words.row, start, side="right")) - 1].update(owners)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *_result(words, places, [sorted(s, key=str.encode) for s in items])], names)

    return run


def _windows(window: int, gram: int):
    """(item, text) -> ``n, print, body, item`` of each window."""

    def run(batches):
        table = byte_class(digits=True)
        for batch in batches:
            words = Words(batch.column(1), table)
            hashes, left, counts = words.hashes(), words.left(), words.counts()
            sizes = np.repeat(np.minimum(counts, window), counts)
            texts, names = np.repeat(np.arange(batch.num_rows), counts), batch.column(0).to_pylist()
            for n in np.unique(sizes).tolist():
                starts, place, grams = _chosen(hashes, np.where(sizes == n, left, 0), n, gram)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(starts), n), pa.int32()),
                        pa.array(grams[place].view(np.int64)),
                        pa.array([words.joined(s, n) for s in starts.tolist()], pa.binary()),
                        pa.array([names[i] for i in texts[starts].tolist()], pa.string()),
                    ],
                    ["n", "print", "body", "item"],
                )

    return run


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``n, print, body, items``: each distinct window, its fingerprint and the ids of its items."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(fold_rows(_windows, window, gram), "n int, print long, body binary, item string")
    return made.groupBy("n", "print", "body").agg(F.collect_set("item").alias("items"))


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, sent_windows: int = SENT_WINDOWS, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items`` (sorted ids) and ``spans`` (of hit words, ends excluded)."""
    refuse_reserved(docs, "_dc_")
    spark, made = docs.sparkSession, StructType.fromDDL(_MADE)
    keep = [i for i, c in enumerate(docs.columns) if c not in made.names]
    schema = StructType([*(docs.schema[i] for i in keep), *made.fields])
    windows = cut(item_windows(items, item_id, item_text, window, gram), "windows")
    size = F.octet_length("body") + F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 8)
    held = windows.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    if held["n"] <= sent_windows and (held["bytes"] or 0) <= sent_bytes:
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in windows.collect()]))
        return docs.mapInArrow(fold_rows(_search, index, gram, docs.columns.index(text_col), keep, schema.names), schema)
    return _joined(docs, windows, id_col, text_col, gram, keep, schema)


def _prints(lengths: list[int], gram: int):
    """(id, hash of the text, text) -> every fingerprint of the text, once."""

    def run(batches):
        table = byte_class(digits=True)
        for batch in batches:
            words = Words(batch.column(2), table)
            hashes, left = words.hashes(), words.left()
            texts = np.repeat(np.arange(batch.num_rows), words.counts())
            for n in lengths:
                _, place, grams = _chosen(hashes, left, n, gram)
                place = np.unique(place)
                row = pa.array(texts[place])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.full(len(place), n), pa.int32()), pa.array(grams[place].view(np.int64))],
                    ["_dc_id", "_dc_hash", "n", "print"],
                )

    return run


def _extend(gram: int):
    """(id, hash, text, hits) -> the windows of the text that chose a hit: their places and words."""

    def run(batches):
        table = byte_class(digits=True)
        for batch in batches:
            words = Words(batch.column(2), table)
            hashes, left = words.hashes(), words.left()
            texts = np.repeat(np.arange(batch.num_rows), words.counts())
            hits = [(i, h["n"], h["print"]) for i, row in enumerate(batch.column(3).to_pylist()) for h in row]
            for n in sorted({n for _, n, _ in hits}):
                starts, place, grams = _chosen(hashes, left, n, gram)
                keys = np.stack((texts[starts].astype(np.uint64), grams[place]), axis=1) if len(starts) else np.empty((0, 2), np.uint64)
                wanted = {(i, p % (1 << 64)) for i, m, p in hits if m == n}
                mine = [j for j, key in enumerate(map(tuple, keys.tolist())) if key in wanted]
                row = pa.array(texts[starts[mine]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        pa.array(np.full(len(mine), n), pa.int32()),
                        pa.array(starts[mine] - words.row[texts[starts[mine]]], pa.int64()),
                        pa.array([words.joined(s, n) for s in starts[mine].tolist()], pa.binary()),
                    ],
                    ["_dc_id", "_dc_hash", "n", "start", "body"],
                )

    return run


def _gather(text_at: int, places_at: int, keep: list[int], names: list[str]):
    """Rows with the places found -> their result."""

    def run(batches):
        table = byte_class(digits=True)
        for batch in batches:
            words = Words(batch.column(text_at), table)
            places = [(int(words.row[i]) + p["start"], p["n"]) for i, row in enumerate(batch.column(places_at).to_pylist()) for p in row or ()]
            items = [sorted(x or (), key=str.encode) for x in batch.column(places_at + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *_result(words, places, items)], names)

    return run


def _joined(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, gram: int, keep: list[int], schema: StructType) -> DataFrame:
    """The same rows by joins on fingerprints and on windows, for benchmarks that are not sent."""
    kind = docs.select(F.col(id_col).alias("_dc_id")).schema[0].dataType.simpleString()
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())
    rows = docs.select(F.col(id_col).alias("_dc_id"), F.xxhash64(text_col).alias("_dc_hash"), F.col(text_col).alias("_dc_text"))
    seeds = rows.mapInArrow(fold_rows(_prints, lengths, gram), f"_dc_id {kind}, _dc_hash long, n int, print long")
    hits = seeds.join(windows.select("n", "print").distinct(), ["n", "print"], "left_semi").groupBy("_dc_id", "_dc_hash").agg(F.collect_set(F.struct("n", "print")).alias("hits"))

    def same(a: DataFrame, b: DataFrame):
        return a["_dc_id"].eqNullSafe(b["_dc_id"]) & (a["_dc_hash"] == b["_dc_hash"])

    texts = rows.join(hits, same(rows, hits)).select(rows["_dc_id"], rows["_dc_hash"], "_dc_text", "hits")
    near = texts.mapInArrow(fold_rows(_extend, gram), f"_dc_id {kind}, _dc_hash long, n int, start long, body binary")
    found = near.join(windows.select("n", "body", "items"), ["n", "body"])
    # Places and items are gathered apart: neither repeats for each of the other.
    places = found.groupBy("_dc_id", "_dc_hash").agg(F.collect_set(F.struct("start", "n")).alias("_dc_places"))
    owners = found.select("_dc_id", "_dc_hash", F.explode_outer("items").alias("item")).groupBy("_dc_id", "_dc_hash").agg(F.collect_set("item").alias("_dc_items"))
    both = places.join(owners, same(places, owners)).select(places["_dc_id"].alias("_dc_doc"), places["_dc_hash"].alias("_dc_text"), "_dc_places", "_dc_items")
    joined = docs.join(both.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_dc_doc")) & (F.xxhash64(text_col) == F.col("_dc_text")), "left").select(*docs.columns, "_dc_places", "_dc_items")
    at = len(docs.columns)
    return joined.mapInArrow(fold_rows(_gather, docs.columns.index(text_col), at, keep, schema.names), schema)
