"""Adaptive context-mixing range coder for token ids, vectorised over lanes.

A block of ids is independent of all others. It is dealt to lanes of successive ids;
every lane has a range coder of its own, and all lanes share one model, which is updated
after each step of one id a lane. The model mixes three predictions of an id:

* order 0: adaptive frequencies of ids;
* order 1: adaptive frequencies of all ids that have followed the previous one;
* order 2: the id that last followed the previous two, with a confidence.

Frequencies are rebuilt after 1, 2, 4 ... steps and at every 32nd. The mixture is linear:
with ``C0`` the cumulative order-0 frequencies, ids at or above a predicted one are shifted
by its mass. Orders 1 and 2 weigh as much as predictions of equal confidence were right so
far. All arithmetic is in integers.

Block: header, directory (zlib), lane lengths, 16-bit code words; a crc32 of everything
behind the header and one of the ids, both checked when a block is read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR2"
_HEAD = struct.Struct("<4sIIIIIIII")  # magic, ids, documents, ids' top, lanes, directory bytes, body bytes, crc of rest, crc of ids
MAX_LANES, LANE_IDS, LEVELS = 8192, 128, 16  # lanes: a power of two
#: Steps between rebuilt frequencies; order 1 has at most 2^MOST times the mass of order 0.
REBUILD, MOST = 32, 5
_POWERS = 1 << np.arange(LEVELS - 1)
_U = np.uint64
_TOP, _LOW32 = _U(1) << _U(32), _U(0xFFFFFFFF)


def _words(n: int) -> tuple[int, int]:
    lanes = max(1, min(MAX_LANES, n // LANE_IDS))
    return lanes, -(-n // lanes)


def _in_order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of up to ``MAX_LANES`` pairs, smallest first (of equal ``first``, about): sorting numbers is faster than sorting places."""
    bits = max(0, 50 - int(first.max()).bit_length())
    more = max(0, int(second.max()).bit_length() - bits)
    both = (((first << bits) | (second >> more)) * MAX_LANES) | np.arange(len(first))
    both.sort()
    return both & (MAX_LANES - 1)


def _distinct(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, of 0 to ``most``, in order, and the place among them of each one."""
    bits = (keys.size - 1).bit_length()
    if most >> (63 - bits):
        known, places = np.unique(keys, return_inverse=True)
        return known, places.reshape(keys.shape)
    both = (keys.ravel() << bits) | np.arange(keys.size)
    both.sort()
    names = both >> bits
    new = np.concatenate(([True], names[1:] != names[:-1]))
    places = np.empty(keys.size, np.int64)
    places[both & ((1 << bits) - 1)] = np.cumsum(new) - 1
    return names[new], places.reshape(keys.shape)


class _Pairs:
    """How often each id followed each other one, in order of the pairs' keys.

    The encoder knows all pairs of a block and names them by place; the decoder has those it
    has met. A context's level tells how often it had each of its ids, by powers of two; its
    mass follows how often ids behind contexts of that level were among theirs.
    """

    def __init__(self, top: int, keys: np.ndarray | None = None) -> None:
        self.size, self.all = top, keys is not None
        self.kind = np.int32 if top < 1 << 20 else np.int64  # of masses and ids: what is read all over stays small
        self.keys = np.empty(0, np.int64) if keys is None else keys
        self.counts = np.zeros(len(self.keys), np.int64)
        self.level, self.of_context = np.zeros(top, np.int64), np.zeros(top, np.int64)
        self._group()

    def _group(self) -> None:
        if len(self.keys):
            context = self.keys // self.size
            self.context, self.id = context.astype(self.kind), (self.keys - context * self.size).astype(self.kind)
            self.firsts = np.concatenate(([0], np.flatnonzero(np.diff(context)) + 1))
            self.rank = np.repeat(np.arange(len(self.firsts)), np.diff(np.concatenate((self.firsts, [len(self.keys)]))))
            self.names = self.context[self.firsts]
        self.below, self.mass = np.zeros(len(self.keys) + 1, self.kind), np.zeros(len(self.keys) + 1, self.kind)

    def rebuild(self, met: list[np.ndarray], total: int, odds: np.ndarray) -> None:
        if met and self.all:
            self.counts += np.bincount(np.concatenate(met), minlength=len(self.keys))
        elif met:
            more, times = np.unique(np.concatenate(met), return_counts=True)
            at = np.searchsorted(self.keys, more)
            old = self.keys.take(at, mode="clip") == more if len(self.keys) else np.zeros(len(more), bool)
            self.counts[at[old]] += times[old]
            self.keys, self.counts = np.insert(self.keys, at[~old], more[~old]), np.insert(self.counts, at[~old], times[~old])
            self._group()
        if not len(self.keys):
            return
        seen, kinds = np.add.reduceat(self.counts, self.firsts), np.add.reduceat((self.counts > 0).astype(np.int64), self.firsts)
        level = np.searchsorted(_POWERS, seen // np.maximum(kinds, 1), side="right")
        self.level[self.names] = level
        mass = (self.counts * ((total * odds.take(level)) >> 10).take(self.rank)) // np.maximum(seen, 1).take(self.rank)
        sums = np.cumsum(mass)
        before = sums - mass
        self.below[:-1] = before - before.take(self.firsts).take(self.rank)
        self.mass[:-1] = mass
        self.of_context[self.names] = np.add.reduceat(mass, self.firsts)

    def values(self, cum: np.ndarray) -> None:
        """Where the span of each pair begins, for :meth:`last_at`."""
        if len(self.keys):
            self.start = (self.context.astype(np.int64) << 40) + cum.take(self.id) + self.below[:-1]

    def of(self, context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mass of the context's smaller ids, own mass)."""
        if not len(self.keys):
            return np.zeros_like(ids), np.zeros_like(ids)
        wanted = context * self.size + ids
        at = np.searchsorted(self.keys, wanted)
        there = self.keys.take(at, mode="clip") == wanted
        same = self.context.take(at, mode="clip") == context
        same &= at < len(self.keys)
        there &= same
        below = np.where(same, self.below.take(at), self.of_context.take(context))
        return below, self.mass.take(at) * there

    def last_at(self, context: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Last pair of the context whose span begins at a value or below: (found, id, below, mass)."""
        if not len(self.keys):
            none = np.zeros_like(value)
            return none.astype(bool), none, none, none
        at = np.searchsorted(self.start, (context << 40) + value, "right") - 1
        found = (at >= 0) & (self.context.take(at, mode="clip") == context)
        return found, self.id.take(at, mode="clip"), self.below.take(at, mode="clip") * found, self.mass.take(at, mode="clip") * found


class _Model:
    """The three predictions; an entry of order 2 is id * LEVELS + confidence."""

    def __init__(self, top: int, keys: np.ndarray | None = None) -> None:
        self.size = top
        self.total = 1 << max(18, (4 * top - 1).bit_length())
        self.counts = np.zeros(top, np.int64)
        self.pairs = _Pairs(top, keys)
        self.waiting: list[np.ndarray] = []
        self.met: list[np.ndarray] = []
        self.kind = np.int32 if top < 1 << 27 else np.int64  # of tables that are read all over
        self.second = np.zeros(1 << 18, self.kind)
        # Of predictions of order 1, by level, and 2, by confidence: how many were wrong and right.
        self.seen = np.stack((np.ones(2 * LEVELS, np.int64), np.tile(np.array([1, 0], np.int64), LEVELS)))
        self.step = 0
        self._rebuild()

    def _rebuild(self) -> None:
        if self.waiting:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=self.size)
        seen = int(self.counts.sum())
        share = 1 + (self.counts * (self.total - self.size)) // max(1, seen)
        share[0] += self.total - int(share.sum())
        self.cum = np.concatenate(([0], np.cumsum(share)))
        self.after = self.cum[1:]
        self.lookup = None
        self.pairs.rebuild(self.met, self.total, np.minimum((self.seen[0, 1::2] << 10) // self.seen[0, ::2], 1 << (10 + MOST)))
        self.waiting, self.met = [], []

    def at(self) -> np.ndarray:
        """Order-0 value -> id."""
        if self.lookup is None:
            self.lookup = np.repeat(np.arange(self.size, dtype=self.kind), np.diff(self.cum))
            self.pairs.values(self.cum)
        return self.lookup

    def predict(self, last: np.ndarray, before: np.ndarray) -> None:
        self.last = last
        self.slot = ((last * 0x9E3779B1 + before * 0x85EBCA77) >> 7) & 0x3FFFF
        self.entry = self.second.take(self.slot)
        self.id2, self.conf = self.entry >> 4, self.entry & 15
        odds = np.minimum((self.seen[1, 1::2] << 10) // self.seen[1, ::2], 1 << 16)
        odds[0] = 0
        both = self.pairs.of_context.take(last) + self.total
        self.mass2 = np.minimum((odds.take(self.conf) * both) >> 10, self.total << 6)
        self.sum = both + self.mass2

    def span(self, ids: np.ndarray, order1: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cumulative mass below, mass) of each id; ``order1`` is what order 1 adds, if it is known."""
        below, mass = order1 or self.pairs.of(self.last, ids)
        low = self.cum.take(ids)
        size = self.after.take(ids) - low
        self.hit, self.hit1 = self.id2 == ids, mass > 0
        low += below + self.mass2 * (self.id2 < ids)
        size += mass + self.mass2 * self.hit
        return low, size

    def find(self, value: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Id (and what order 1 adds to it) in whose span a value lies: without the masses below, the value is order 0's."""
        at = self.at()
        below2, own2 = np.zeros_like(value), np.zeros_like(value)
        order = _in_order(self.last, value)  # so that searches stay near in memory
        some = order[self.mass2.take(order) > 0]
        below2[some], own2[some] = self.pairs.of(self.last.take(some), self.id2.take(some))
        low2 = self.cum.take(self.id2) + below2
        under = value < low2
        inside = ~under & (self.mass2 > 0) & (value < self.after.take(self.id2) + below2 + own2 + self.mass2)
        left = order[~inside.take(order)]
        rest = np.where(under, value, value - self.mass2).take(left)
        found, name, below, own = self.pairs.last_at(self.last.take(left), rest)
        past = found & (rest >= self.after.take(name) + below + own)
        below, own = below + own * past, own * ~past
        ids = self.id2.copy()
        ids[left] = np.where(found & ~past, name, at.take(rest - below, mode="clip"))
        below2[left], own2[left] = below, own
        return ids, (below2, own2)

    def learn(self, ids: np.ndarray, pairs: np.ndarray | None = None) -> None:
        """``pairs``: their places, if the model was given all keys."""
        self.waiting.append(ids)
        self.met.append(self.last * self.size + ids if pairs is None else pairs)
        self.seen[0] += np.bincount(2 * self.pairs.level.take(self.last) + self.hit1, minlength=2 * LEVELS)
        hit, conf = self.hit, self.conf
        self.seen[1] += np.bincount(2 * conf + hit, minlength=2 * LEVELS)
        kept = np.where(conf > 1, self.entry - conf + (conf >> 1), (ids << 4) + 1)
        self.second[self.slot] = np.where(hit, self.entry + (conf < LEVELS - 1), kept)
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % REBUILD == 0:
            self._rebuild()


def _active(n: int, steps: int, t: int) -> int:
    """Lanes, from the first, that have an id at step ``t``."""
    return -(-(n - t) // steps)


def _encode_lanes(ids: np.ndarray, top: int) -> tuple[int, bytes]:
    n = len(ids)
    lanes, steps = _words(n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    keys = grid.copy()
    keys[1:] += grid[:-1] * top
    known, pairs = _distinct(keys, top * top - 1)
    model = _Model(top, known)
    table = model.pairs
    low, span = np.zeros(lanes, _U), np.full(lanes, 1 << 48, _U)
    wide = 2 * steps + 4
    flat, used = np.zeros(lanes * wide, np.uint32), np.arange(lanes) * wide  # words, next word of each lane
    last = before = np.zeros(lanes, np.int64)
    for t in range(steps):
        m = _active(n, steps, t)
        now = grid[t, :m]
        model.predict(last[:m], before[:m])
        pair = pairs[t, :m]
        start, size = model.span(now, (table.below.take(pair), table.mass.take(pair)))
        part = span[:m] // model.sum.view(_U)
        low[:m] += part * start.view(_U)
        np.multiply(part, size.view(_U), out=span[:m])
        over = np.flatnonzero(low[:m] >> _U(48))
        if len(over):
            flat[used.take(over) - 1] += 1
            low[over] &= (_U(1) << _U(48)) - _U(1)
        small = np.flatnonzero(span[:m] < _TOP)
        while len(small):
            value, place = low.take(small), used.take(small)
            flat[place] = value >> _U(32)
            used[small] = place + 1
            low[small] = (value & _LOW32) << _U(16)
            grown = span.take(small) << _U(16)
            span[small] = grown
            small = small[grown < _TOP]
        model.learn(now, pair)
        before, last = last, grid[t]
    flat[used] = (low + _LOW32) >> _U(32)  # a value of the span that ends in zeros, which aren't kept
    used += 1
    out, used = flat.reshape(lanes, -1), used - np.arange(lanes) * (len(flat) // lanes)
    for i in range(out.shape[1] - 1, 0, -1):
        out[:, i - 1] += out[:, i] >> 16
    mask = np.arange(out.shape[1]) < used[:, None]
    return lanes, used.astype("<u4").tobytes() + (out & 0xFFFF).astype("<u2")[mask].tobytes()


def _decode_lanes(body: bytes, n: int, lanes: int, top: int) -> np.ndarray:
    steps = _words(n)[1]
    used = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    ends = np.cumsum(used + 2)  # two zero words behind each lane
    words, at = np.zeros(int(ends[-1]) + 4, _U), ends - used - 2
    words[np.repeat(2 * np.arange(lanes), used) + np.arange(int(used.sum()))] = np.frombuffer(body, "<u2", -1, 4 * lanes)
    model = _Model(top)
    span = np.full(lanes, 1 << 48, _U)
    left = (words[at] << _U(32)) | (words[at + 1] << _U(16)) | words[at + 2]
    at = at + 3
    grid = np.zeros((steps, lanes), np.int64)
    last = before = np.zeros(lanes, np.int64)
    for t in range(steps):
        m = _active(n, steps, t)
        model.predict(last[:m], before[:m])
        total = model.sum.view(_U)
        part = span[:m] // total
        now, order1 = model.find(np.minimum(left[:m] // part, total - _U(1)).view(np.int64))
        start, size = model.span(now, order1)
        left[:m] -= part * start.view(_U)
        np.multiply(part, size.view(_U), out=span[:m])
        small = np.flatnonzero(span[:m] < _TOP)
        while len(small):
            place = at.take(small)
            left[small] = (left.take(small) << _U(16)) | words.take(place)
            at[small] = place + 1
            grown = span.take(small) << _U(16)
            span[small] = grown
            small = small[grown < _TOP]
        grid[t, :m] = now
        model.learn(now)
        before, last = last, grid[t]
    return np.ascontiguousarray(grid.T).ravel()[:n].astype(np.uint32)


def encode_block(docs: list[int | None], parts: list[np.ndarray]) -> bytes:
    """One block of whole documents: their ids, in order."""
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    known = np.array([d is not None for d in docs], np.uint8)
    names = np.array([0 if d is None else d for d in docs], "<i8")
    directory = zlib.compress(known.tobytes() + names.tobytes() + np.array([len(p) for p in parts], "<u4").tobytes())
    top = int(ids.max()) + 1 if len(ids) else 1
    lanes, body = _encode_lanes(ids, top) if len(ids) else (0, b"")
    rest = directory + body
    return _HEAD.pack(MAGIC, len(ids), len(docs), top, lanes, len(directory), len(body), zlib.crc32(rest), zlib.crc32(ids.astype("<u4").tobytes())) + rest


def decode_block(block: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Documents and their ids; raises ``ValueError`` on any damage."""
    if len(block) < _HEAD.size:
        raise ValueError("block is shorter than its header")
    magic, n, docs, top, lanes, dir_bytes, body_bytes, crc, ids_crc = _HEAD.unpack_from(block)
    rest = block[_HEAD.size :]
    if magic != MAGIC or len(rest) != dir_bytes + body_bytes or zlib.crc32(rest) != crc:
        raise ValueError("block is damaged")
    raw = zlib.decompress(rest[:dir_bytes])
    known = np.frombuffer(raw, np.uint8, docs)
    names, sizes = np.frombuffer(raw, "<i8", docs, docs), np.frombuffer(raw, "<u4", docs, 9 * docs)
    ids = _decode_lanes(rest[dir_bytes:], n, lanes, top) if n else np.empty(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("ids are damaged")
    return [int(d) if k else None for d, k in zip(names, known, strict=True)], np.split(ids, np.cumsum(sizes)[:-1]) if docs else []
