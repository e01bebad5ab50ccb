"""Near copies: groups of documents linked by a Jaccard similarity of 0.8 at least.

A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, and a text is the set of its
shingles of ``WORDS`` words (fewer words make one shingle, no word the empty set), as XXH64.

Candidates: SimHash groups (3 bits, by anchors) and, as the fingerprints of most pairs at
0.8 are farther apart than anchors can search, bands of MinHash: a pair at 0.8 shares none
of ``BANDS`` bands in 1 of 2,800 cases, a pair at 0.85 in 1 of 55,000. Every link is then
verified by the sets themselves, so no group is held together by a smaller similarity.

Equal sets are one row before they are compared (with the least of their fingerprints, which
differ where shingles are repeated). In each bucket (a band's value or a SimHash
group) all members are compared with one hub, another in each bucket. Buckets whose members
are in more than one group after that are searched as a whole, each by one task with the
sets at hand, so what a hub misses is not lost; what leaves a bucket is a spanning forest of
its links, not its pairs.

Defined results
* null and empty texts, and texts of white space, are copies of each other.
* rows that repeat an id are each compared; ids are compared as longs, null ids get no
  component (null).
* an empty table gives an empty table. Columns besides id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest, xxh64_intdigest

from lexigrid.llm import simhash
from lexigrid.llm._shared import cut, fold_rows
from lexigrid.llm.components import components

WORDS, BANDS, ROWS = 5, 20, 5
#: Links have ``LEAST[0] / LEAST[1]`` of both sets' shingles in common.
LEAST = (4, 5)
#: Shingles that are permuted at a time.
_BLOCK = 1 << 13
_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int = WORDS, seed: int = 42) -> np.ndarray:
    """One hash a shingle, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins, stops = np.concatenate(([0], ends[:-shingle])).tolist(), (ends[shingle - 1 :] - 1).tolist()
    joined = b" ".join(words)
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins, stops, strict=True)), np.uint64, len(begins))


def bands(hashes: np.ndarray) -> list[int]:
    """The keys of a set's bands, as signed longs; the empty set has none."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, ((hashes[None, at : at + _BLOCK] ^ _SEEDS[0]) * _SEEDS[1]).min(axis=1))
    keys = [xxh3_64_intdigest(band.tobytes(), seed=k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _set_id(hashes: np.ndarray) -> bytes:
    return xxh3_128_digest(hashes.tobytes())


def _describe():
    def run(batches):
        for batch in batches:
            fps, ids, sizes, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text)
                fps.append(simhash.majority(hashes))
                hashes = np.unique(hashes)
                ids.append(_set_id(hashes))
                sizes.append(len(hashes))
                keys.append(bands(hashes))
            made = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "fp", "sid", "n", "bands"])

    return run


def _sets():
    def run(batches):
        for batch in batches:
            made = [np.unique(shingle_hashes(t)) for t in batch.column(1).to_pylist()]
            sets = pa.array([m.view(np.int64) for m in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(m) for m in made], pa.binary()), sets], ["sid", "hashes"])

    return run


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as sorted arrays, have a Jaccard similarity of 0.8 at least."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _verify():
    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            kept = [similar(left[i].values.to_numpy(), right[i].values.to_numpy()) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return run


def search_sets(reps: list[int], sets: list[np.ndarray], forest: simhash.Forest) -> None:
    """Links of one bucket: each member looks once at those not yet reached."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(codes, np.cumsum(sizes)[:-1])
    mark, left, open_codes = np.zeros(len(names), np.int64), np.arange(len(sets)), codes
    while len(left):
        stack, open_codes, left = [left[0]], open_codes[sizes[left[0]] :], left[1:]
        while stack and len(left):
            at = stack.pop()
            mark[own[at]] = 1
            sums = np.concatenate(([0], np.cumsum(mark[open_codes])))
            mark[own[at]] = 0
            ends = np.cumsum(sizes[left])
            both = sums[ends] - sums[ends - sizes[left]]
            near = LEAST[1] * both >= LEAST[0] * (sizes[left] + sizes[at] - both)
            if near.any():
                for other in left[near]:
                    forest.link(reps[at], reps[other])
                stack.extend(left[near])
                open_codes, left = open_codes[np.repeat(~near, sizes[left])], left[~near]


def _search_buckets():
    """Rows (bucket, id, set) in order of buckets."""

    def run(batches):
        forest, key, reps, sets = simhash.Forest(), None, [], []
        for batch in batches:
            keys, ids, column = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i in range(batch.num_rows):
                if keys[i] != key:
                    if len(sets) > 1:
                        search_sets(reps, sets, forest)
                    key, reps, sets = keys[i], [], []
                reps.append(ids[i])
                sets.append(column[i].values.to_numpy())
        if len(sets) > 1:
            search_sets(reps, sets, forest)
        u, v = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v`` of those ``a, b, u, v`` whose sets are similar."""
    found = pairs.join(sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), "a")
    found = found.join(sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y")), "b")
    return cut(found.select("u", "v", "x", "y").mapInArrow(fold_rows(_verify), "u long, v long"), "verified")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component``: the least id of the documents linked with each document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(texts.mapInArrow(fold_rows(_describe), "doc_id long, fp long, sid binary, n long, bands array<long>"), "described")
    first = rows.where("doc_id is not null").groupBy("sid")
    reps = cut(first.agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bands").alias("bands")), "sets")

    # Buckets with more than one set, each with the order that its hub is chosen by.
    groups = simhash.link_fingerprints(reps.select(F.col("rep").alias("doc_id"), "fp")).select("fp", "component").distinct()
    by_fp = reps.join(groups, "fp").select(F.xxhash64(F.lit("simhash"), "component").alias("key"), "sid", "rep", "n")
    buckets = reps.select(F.explode("bands").alias("key"), "sid", "rep", "n").unionByName(by_fp)
    buckets = buckets.withColumn("place", F.xxhash64("key", "sid"))
    least = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("place").alias("hub")).where("members > 1")
    crowded = cut(buckets.join(least, "key").select("key", "sid", "rep", "n", (F.col("place") == F.col("hub")).alias("is_hub")), "crowded")
    wanted = crowded.select(F.col("rep").alias("_rep")).distinct()
    sets = texts.join(wanted.hint("shuffle_hash"), texts["doc_id"] == wanted["_rep"], "left_semi").mapInArrow(fold_rows(_sets), "sid binary, hashes array<long>")
    sets = cut(sets.groupBy("sid").agg(F.first("hashes").alias("hashes")), "shingles")

    # Every member with the hub of its bucket, where sizes allow the similarity.
    hubs = crowded.where("is_hub")
    met = [F.col("l.key") == F.col("r.key"), F.col("l.sid") != F.col("r.sid"), LEAST[1] * F.least("l.n", "r.n") >= LEAST[0] * F.greatest("l.n", "r.n")]
    ordered = F.col("l.sid") < F.col("r.sid")
    ends = [F.when(ordered, F.col(x)).otherwise(F.col(y)) for x, y in (("l.sid", "r.sid"), ("r.sid", "l.sid"), ("l.rep", "r.rep"), ("r.rep", "l.rep"))]
    pairs = crowded.alias("l").join(hubs.alias("r"), met).select(*[e.alias(n) for e, n in zip(ends, "abuv", strict=True)]).distinct()
    links = _verified(pairs, sets)
    stars = components(links)
    # What hubs leave apart: members of one bucket whose groups differ.
    named = crowded.where("not is_hub").join(stars, crowded["rep"] == stars["node"], "left").select("key", "sid", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    apart = named.join(mixed, "key", "left_semi").join(sets, "sid").select("key", "rep", "hashes")
    met = apart.repartition("key").sortWithinPartitions("key")
    more = cut(met.mapInArrow(fold_rows(_search_buckets), "u long, v long"), "apart")
    groups = components(links.unionByName(more))
    of_set = reps.join(groups, reps["rep"] == groups["node"], "left").select("sid", F.coalesce("component", "rep").alias("component"))
    return rows.join(of_set, "sid", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))
