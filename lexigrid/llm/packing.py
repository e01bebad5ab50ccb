"""Bounded-space online packing of token sequences.

Each partition keeps at most ``OPEN`` windows of ``length`` tokens open. A document's
ids, with an end id, are cut into whole windows as far as they go; the rest is placed
best-fit: in the open window with the least room that holds it. When none does and no
window may be opened, the fullest is emitted: padded if at most ``slack`` tokens are
missing, else filled with the head of the piece. What is left open at the end of all
partitions is merged in rounds: each task fills windows from about ``FAN_IN`` of them and
leaves at most one open, until one task can take what is left. The very last window, if
not full, is emitted in parts whose lengths are powers of two, so it needs no padding.

Defined results
* null and empty texts are one end id. Rows are packed one by one: rows that repeat an
  id, null ids too, are documents of their own.
* extra columns are not read; an empty table gives no piece.
* each id lies in exactly one piece; offsets of a sequence have no gaps. Where documents
  are cut, and which share a sequence, depends on how the rows are dealt to partitions:
  rows read from other files may be packed otherwise. Ids and counts of documents don't.

Scale: the state of a task is its open windows; pieces are written once, and only
leftovers, at most ``OPEN`` windows of a partition, are shuffled. A merging round has tasks
in proportion to its windows, and each round has ``FAN_IN`` times fewer, so no task's share
grows with the input. Sequence numbers are made from round, partition and count, without
coordination.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm._shared import cut, fold_rows
from lexigrid.llm.tokenizers_io import ids_of

LENGTH, OPEN, SLACK, END_ID = 2048, 64, 8, 1
#: Windows that one task merges, on average; more are merged in rounds.
FAN_IN = 256

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


class _Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc, self.start, self.ids[:n], self.total), _Piece(self.doc, self.start + n, self.ids[n:], self.total)


class _Out:
    """Gathers emitted windows as rows."""

    def __init__(self, level: int, part: int) -> None:
        self.base, self.count, self.rows = (level << 58) | (part << 34), 0, []

    def emit(self, pieces: list[_Piece], is_open: bool = False) -> None:
        at = 0
        for p in pieces:
            self.rows.append((p.doc, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.total, self.base + self.count, at, is_open))
            at += len(p.ids)
        self.count += 1

    def batches(self, least: int = 1):
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), _TYPES, strict=True)], _NAMES)
            self.rows = []


class Packer:
    """The open windows of one partition."""

    def __init__(self, out: _Out, length: int, most_open: int, slack: int) -> None:
        self.out, self.length, self.most, self.slack = out, length, most_open, slack
        self.room: list[tuple[int, int]] = []  # (tokens missing, window), sorted
        self.windows: dict[int, list[_Piece]] = {}
        self.made = 0

    def add(self, piece: _Piece) -> None:
        while len(piece.ids) >= self.length:
            full, piece = piece.cut(self.length)
            self.out.emit([full])
        while len(piece.ids):
            at = bisect_left(self.room, (len(piece.ids), -1))
            if at < len(self.room):
                self._place(at, piece)
                return
            if len(self.room) < self.most:
                self.windows[self.made] = []
                insort(self.room, (self.length, self.made))
                self.made += 1
            elif self.room[0][0] <= self.slack:
                self.out.emit(self.windows.pop(self.room.pop(0)[1]))
            else:
                head, piece = piece.cut(self.room[0][0])
                self._place(0, head)

    def _place(self, at: int, piece: _Piece) -> None:
        missing, window = self.room.pop(at)
        self.windows[window].append(piece)
        if missing == len(piece.ids):
            self.out.emit(self.windows.pop(window))
        else:
            insort(self.room, (missing - len(piece.ids), window))

    def leave(self) -> None:
        for _, window in self.room:
            self.out.emit(self.windows[window], True)


def _pack(path: str, special: str, length: int, most_open: int, slack: int, end_id: int):
    def run(batches):
        ids, out = ids_of(path, special), _Out(1, TaskContext.get().partitionId())
        packer = Packer(out, length, most_open, slack)
        for batch in batches:
            for doc, made in zip(batch.column(0).to_pylist(), ids.of([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                packer.add(_Piece(doc, 0, np.append(made, np.uint32(end_id)), len(made) + 1))
            yield from out.batches(256)
        packer.leave()
        yield from out.batches()

    return run


def _fill(level: int, length: int, last: bool):
    """Pieces in a row -> full windows; the last one stays open, or ends in powers of two."""

    def run(batches):
        out, window, room = _Out(level, TaskContext.get().partitionId()), [], length
        for batch in batches:
            for doc, start, _, ids, total, *_ in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                piece = _Piece(doc, start, np.frombuffer(ids, "<u4"), total)
                while len(piece.ids):
                    head, piece = piece.cut(room)
                    window.append(head)
                    room -= len(head.ids)
                    if not room:
                        out.emit(window)
                        window, room = [], length
            yield from out.batches(256)
        if window and not last:
            out.emit(window, True)
        elif window:
            sizes = [1 << k for k in range(length.bit_length() - 1, -1, -1) if (length - room) >> k & 1]
            for size in sizes:
                part, need = [], size
                while need:
                    head, rest = window[0].cut(need)
                    part.append(head)
                    need -= len(head.ids)
                    window[:1] = [rest] if len(rest.ids) else []
                out.emit(part)
        yield from out.batches()

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most_open: int = OPEN, slack: int = SLACK, end_id: int = END_ID, special: str = "tokens", fan_in: int = FAN_IN) -> DataFrame:
    """Pieces ``doc_id, start, length, ids (packed 32-bit), doc_tokens, sequence_id, offset``.

    ``special``: strings of added tokens are ``"tokens"``, or ordinary ``"text"``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = cut(rows.mapInArrow(fold_rows(_pack, path, special, length, most_open, slack, end_id), SCHEMA), "packed")
    done, left, level = packed.where("not open"), packed.where("open"), 2
    windows = left.select("sequence_id").distinct().count()
    while windows > fan_in:
        tasks = -(-windows // fan_in)
        dealt = left.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset")
        merged = cut(dealt.mapInArrow(fold_rows(_fill, level, length, False), SCHEMA), "merged")
        done, left, level, windows = done.unionByName(merged.where("not open")), merged.where("open"), level + 1, tasks
    rest = left.repartition(1).sortWithinPartitions("sequence_id", "offset")
    last = rest.mapInArrow(fold_rows(_fill, level, length, True), SCHEMA)
    return done.unionByName(last).drop("open")
