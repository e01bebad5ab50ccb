"""SimHash near-dedup with anchor-point covering.

Fingerprint: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, and each shingle of
``shingle`` words, repeats included, is hashed with XXH64 (UTF-8, seed 42); a bit is 1
if over half of the hashes have it. Fewer words make one shingle; no word makes 0.

Search: two fingerprints within 3 bits differ in at most 1 bit of one 32-bit half. The
anchors of a half are the words whose first 31 bits are a codeword of the Hamming code of
length 31, a perfect covering code: each half has exactly one anchor within covering
radius 1. A fingerprint goes home to that anchor, and is replicated to every anchor
within covering radius plus threshold, 2, of its half: 17 of them. Whoever is within 1
bit of a half is therefore met at its home, and fingerprints are compared per anchor.

Equal fingerprints are one row before they are replicated, and what leaves an anchor is
a spanning forest of its links, not its pairs; components of all forests are the groups.
An anchor that is home to more than ``BLOCK`` fingerprints is split: its homes and all that
are sent to it are dealt into n blocks, and each block of homes meets each block of the
others in a cell of its own. A task holds the homes of an anchor, or cell, and a bounded
number of the rows that are compared with them.

Defined results
* null and empty texts, and texts of white space: fingerprint 0, linked like any other.
* rows that repeat an id are each fingerprinted; ids are compared as longs, null ids
  get no component (null) but keep a fingerprint.
* an empty table gives an empty table. Columns besides id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lexigrid.llm._shared import cut, fold_rows
from lexigrid.llm.components import components

#: Hashes unpacked to bits at a time.
_BLOCK = 1 << 15
#: Groups up to this size are compared by shifted rows, larger ones by a search.
_SMALL = 48
#: Homes of an anchor that are not split.
BLOCK = 4096
#: Rows of an anchor-sorted partition that are compared together.
_ROWS = 1 << 17


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate(([0], ends[:-shingle])).tolist()
    joined, stops = b" ".join(words), (ends[shingle - 1 :] - 1).tolist()
    ones, n = np.zeros(64, np.int64), len(begins)
    for at in range(0, n, _BLOCK):
        part = slice(at, at + _BLOCK)
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins[part], stops[part], strict=True)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles that are hashed already."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[at : at + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            made = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: fingerprints as signed longs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(fold_rows(_fingerprints, shingle), "doc_id long, fp long")


def _pair_masks() -> np.ndarray:
    """For each syndrome s of the Hamming code: the 15 masks of two positions p ^ q = s."""
    masks = np.zeros((32, 15), np.uint64)
    for s in range(1, 32):
        pairs = [(p, p ^ s) for p in range(1, 32) if p ^ s and p < p ^ s]
        masks[s] = [(1 << (p - 1)) | (1 << (q - 1)) for p, q in pairs]
    return masks


#: The bits of 31 positions whose number has bit k: five parity checks.
_CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) for every anchor that a fingerprint is sent to."""
    fps = fps.astype(np.uint64)
    out_row, out_key, out_home = [], [], []
    rows, masks = np.arange(len(fps)), _pair_masks()
    for half in range(2):
        part = (fps >> np.uint64(32)) if half == 0 else (fps & np.uint64(0xFFFFFFFF))
        word, free = part >> np.uint64(1), part & np.uint64(1)
        syndrome = np.zeros(len(fps), np.int64)
        for k, check in enumerate(_CHECKS):
            syndrome |= (np.bitwise_count(word & np.uint64(check)).astype(np.int64) & 1) << k
        flip = np.where(syndrome > 0, np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64), np.uint64(0))
        nearest = word ^ flip

        def key(code, bit, half=half):
            return (np.uint64(half) << np.uint64(32)) | (code << np.uint64(1)) | bit

        off = np.nonzero(syndrome)[0]
        second = word[off, None] ^ masks[syndrome[off]]
        for r, k, home in (
            (rows, key(nearest, free), True),
            (rows, key(nearest, free ^ np.uint64(1)), False),
            (np.repeat(off, 15), key(second, free[off, None]).ravel(), False),
        ):
            out_row.append(r)
            out_key.append(k)
            out_home.append(np.full(len(r), home))
    return np.concatenate(out_row), np.concatenate(out_key), np.concatenate(out_home)


def _replicate():
    def run(batches):
        for batch in batches:
            fps, reps = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            row, key, home = anchors(fps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(fps[row].view(np.int64)), pa.array(reps[row]), pa.array(home)],
                ["anchor", "fp", "rep", "home"],
            )

    return run


class Forest:
    """Union-find over the nodes that have a link."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        pairs = [(x, self.root(x)) for x in self.up]
        kept = [(x, r) for x, r in pairs if x != r]
        return [x for x, _ in kept], [r for _, r in kept]


def _search(fps: np.ndarray, reps: np.ndarray, home: np.ndarray, bits: int, forest: Forest) -> None:
    """Links of one large group: each home looks at all members, and merges those it finds."""
    label = np.arange(len(fps))
    for at in np.flatnonzero(home).tolist():
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[at]) <= bits)
        found = label[near]
        least = int(found.min())
        if (found != least).any():
            label[np.isin(label, found)] = least
    for at, to in zip(np.flatnonzero(label != np.arange(len(label))).tolist(), label[label != np.arange(len(label))].tolist(), strict=True):
        forest.link(int(reps[at]), int(reps[to]))


def link_anchors(anchor: np.ndarray, fps: np.ndarray, reps: np.ndarray, home: np.ndarray, bits: int, forest: Forest) -> None:
    """Links among rows sorted by anchor; every group is whole."""
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    sizes = np.diff(np.append(starts, len(anchor)))
    for at, n in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
        _search(fps[at : at + n], reps[at : at + n], home[at : at + n], bits, forest)
    keep = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
    anchor, fps, reps, home = anchor[keep], fps[keep], reps[keep], home[keep]
    for k in range(1, _SMALL):
        same = np.flatnonzero(anchor[k:] == anchor[:-k]) if k < len(anchor) else []
        if not len(same):
            break
        same = same[home[same] | home[same + k]]
        same = same[np.bitwise_count(fps[same] ^ fps[same + k]) <= bits]
        for a, b in set(zip(reps[same].tolist(), reps[same + k].tolist(), strict=True)):
            forest.link(a, b)


def _links(bits: int, rows: int = _ROWS):
    """Rows sorted by anchor, homes first -> a spanning forest of their links."""

    def run(batches):
        forest, held, n = Forest(), [], 0

        def flush(last: bool) -> int:
            table = pa.Table.from_batches(held)
            cols = [table.column(i).to_numpy() for i in range(4)]
            cols[1] = cols[1].view(np.uint64)
            link_anchors(*cols, bits, forest)
            # Of the anchor that may go on, its homes stay: who comes later is compared with them.
            at = len(cols[0]) if last else int(np.searchsorted(cols[0], cols[0][-1]))
            rest = table.slice(at)
            held[:] = rest.filter(rest.column(3)).combine_chunks().to_batches()
            return sum(b.num_rows for b in held)

        grow = rows
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                if n >= grow:
                    n = flush(False)
                    grow = max(rows, 2 * n)
        if held:
            flush(True)
        u, v = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """``doc_id, fp, component``: the least id of the documents linked with each document."""
    return link_fingerprints(cut(fingerprints(docs, id_col, text_col, shingle), "simhash"), bits)


def split_anchors(sent: DataFrame, block: int = BLOCK) -> DataFrame:
    """``sent`` with the rows of anchors that have many homes dealt to cells, each a key of its own.

    A cell's key is a hash; should it equal another key, groups are compared that need not be.
    """
    homes = sent.where("home").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    crowded = cut(homes.select(F.col("anchor").alias("_anchor"), F.ceil(F.col("n") / block).cast("int").alias("_n")), "crowded")
    if crowded.isEmpty():
        return sent
    on = sent["anchor"] == crowded["_anchor"]
    mine = sent.join(crowded, on).withColumn("_b", F.pmod(F.xxhash64("fp"), F.col("_n")).cast("int"))
    line = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k")
    as_home = mine.where("home").select("anchor", "fp", "rep", "home", F.col("_b").alias("_i"), line).withColumnRenamed("_k", "_j")
    as_member = mine.select("anchor", "fp", "rep", F.lit(False).alias("home"), line, F.col("_b").alias("_j")).withColumnRenamed("_k", "_i")
    cells = as_home.unionByName(as_member).select(F.xxhash64("anchor", "_i", "_j").alias("anchor"), "fp", "rep", "home")
    return sent.join(crowded, on, "left_anti").unionByName(cells)


def link_fingerprints(fps: DataFrame, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """``near_groups`` of a written table ``doc_id, fp``."""
    if not 0 <= bits <= 3:
        raise ValueError("anchors cover links of at most 3 bits")
    distinct = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    sent = distinct.mapInArrow(fold_rows(_replicate), "anchor long, fp long, rep long, home boolean")
    met = split_anchors(sent, block).repartition("anchor").sortWithinPartitions("anchor", F.desc("home"))
    edges = cut(met.mapInArrow(fold_rows(_links, bits), "u long, v long"), "links")
    groups = components(edges)
    of_fp = distinct.join(groups, distinct["rep"] == groups["node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component"))
    return fps.join(of_fp, fps["fp"] == of_fp["_fp"], "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component")
    )
