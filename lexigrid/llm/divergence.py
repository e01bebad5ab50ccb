"""Source divergence audit: how far the word use of sources of a language lies apart.

Each language keeps the terms that at least ``LEAST_DOCS`` of its documents have. A group
(language, source) gives each kept term the smoothed share ``p`` in billionths; two shares
differ by ``f = (p - q)^2 // (p + q)``. Pairs of sources are told apart by the sum of ``f``
over all kept terms; terms of a group by ``f`` against the whole language.

The work goes by tiles: numpy int64 matrices of up to ``GROUPS`` sources by about ``TERMS``
terms. A tile broadcasts all pairs of its sources over its terms, and its partial pair
matrix is added to those of other tiles; each source keeps its best terms of a tile, and
these are merged. All arithmetic is on integers.

Defined results
* null text, language and source are ''. Each row is a document, whatever its id.
* every group of the table is there, also one without a term; a language that keeps no term
  has pairs of value 0. A language with one source has no pairs.
* equal values are ranked by item, in the order of UTF-8 bytes.
* an empty table gives no row; extra columns are not read.

Scale: a task counts terms of its slices by dictionary codes and merges them before
anything is sent, so what is shuffled is one row for each term, group and task, and a
frequent term or a hot source is a number. Tiles have a bounded size: terms are dealt to as
many blocks as a language needs, and sources beyond ``GROUPS`` to blocks that meet pairwise.
A source's block header (its totals) is repeated once a tile, as its row of the matrix is.
The pairs are the result; nothing else grows with the square of the sources.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrid.llm._shared import bounded, cut
from lexigrid.llm.byte_words import Words, byte_class

LEAST_DOCS, TOP_TERMS = 10, 10
#: Sources and terms of a tile.
GROUPS, TERMS = 128, 1024
#: Rows and bytes of a slice that is counted at once, and counted rows that a task holds.
SLICE_ROWS, SLICE_BYTES, HELD = 4096, 2 << 20, 1 << 17
#: Cells of the differences that are computed at once.
CELLS = 1 << 20

_COUNTS = "lang string, source string, term string, n long, docs long"
_KEYS = ["lang", "source", "term"]


def _slice_counts(batch: pa.RecordBatch, table: np.ndarray) -> pa.Table:
    """(lang, source, text) -> ``lang, source, term, n, docs`` of the slice."""
    words = Words(batch.column(2), table)
    coded = words.strings().dictionary_encode()
    names = pc.cast(pc.utf8_rtrim(coded.dictionary, " "), pa.string())
    size = max(len(names), 1)
    texts = np.repeat(np.arange(batch.num_rows, dtype=np.int64), words.counts())
    pairs, times = np.unique(texts * size + coded.indices.to_numpy(), return_counts=True)
    where = pa.array(pairs // size)
    made = {"lang": batch.column(0).take(where), "source": batch.column(1).take(where), "term": names.take(pa.array(pairs % size)), "n": pa.array(times, pa.int64()), "docs": pa.array(np.ones(len(pairs), np.int64))}
    return pa.table(made)


def _summed(parts: list[pa.Table]) -> pa.Table:
    made = pa.concat_tables(parts).group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return made.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])


def _count(batches):
    table, held, rows = byte_class(digits=False), [], 0
    for batch in bounded(batches, SLICE_ROWS, SLICE_BYTES):
        held.append(_summed([_slice_counts(batch, table)]))
        rows += held[-1].num_rows
        if rows > HELD:
            held = [_summed(held)]
            rows = held[0].num_rows
            if rows > HELD // 2:
                yield from held[0].to_batches(1 << 16)
                held, rows = [], 0
    if held:
        yield from _summed(held).to_batches(1 << 16)


def _named(docs: DataFrame, lang: str, source: str) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"))]


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that have the term."""
    rows = docs.select(*_named(docs, lang_col, source_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count, _COUNTS).groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + 10^9 * (counts + 2) // total``, in three steps of a thousand that don't overflow."""
    rest, made = counts + 2, np.zeros(np.broadcast_shapes(counts.shape, total.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        made = made * 1000 + rest // total
        rest = rest % total
    return made + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pair_sums(p: np.ndarray, q: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over the columns of what each row of ``p`` is apart from each row of ``q``."""
    sums = np.zeros((len(p), len(q)), np.int64)
    step = max(1, CELLS // max(1, p.shape[1] * len(q)))
    for i in range(0, len(p), step):
        sums[i : i + step] = (_apart(p[i : i + step, None, :], q[None, :, :]) * weights).sum(axis=2)
    return sums


def _tile(top: int):
    """One tile: ``counts`` of its terms, ``heads`` of its sources -> partial pair sums and best terms."""

    def run(counts: pa.Table, heads: pa.Table) -> pa.Table:
        lang = heads.column("lang")[0].as_py() if heads.num_rows else ""
        sources, side = np.array(heads.column("source").to_pylist(), object), heads.column("part").to_numpy()
        if not len(sources):
            return pa.table([[], [], [], [], []], schema=_PARTIAL)
        total = heads.column("total").to_numpy()
        place = {s: i for i, s in enumerate(sources.tolist())}
        terms = counts.column("term").combine_chunks().dictionary_encode()
        if isinstance(terms, pa.ChunkedArray):
            terms = terms.combine_chunks()
        names = terms.dictionary.to_pylist()
        unseen = int(heads.column("terms")[0].as_py()) - len(names)
        matrix = np.zeros((len(sources), len(names) + 1), np.int64)
        rows = np.array([place[s] for s in counts.column("source").to_pylist()], np.int64)
        columns = terms.indices.to_numpy()
        matrix[rows, columns] = counts.column("n").to_numpy()
        p = shares(matrix, total[:, None])
        # The last column stands for the block's terms that none of these sources has.
        weights = np.ones(len(names) + 1, np.int64)
        weights[-1] = unseen
        low, high = int(side.min()), int(side.max())
        a, b = np.flatnonzero(side == low), np.flatnonzero(side == high)
        first, second = np.divmod(np.arange(len(a) * len(b)), max(1, len(b)))
        sums = _pair_sums(p[a], p[b], weights).ravel()
        kept = a[first] != b[second]
        first, second, sums = a[first][kept], b[second][kept], sums[kept]
        out = [_rows(lang, sources[first], "pair", sources[second], sums)]
        if low != high:
            out.append(_rows(lang, sources[second], "pair", sources[first], sums))
        elif names:
            whole = np.zeros(len(names), np.int64)
            whole[columns] = counts.column("whole").to_numpy()
            q = shares(whole, heads.column("whole_total").to_numpy()[:1])
            out.append(_best(lang, sources, names, matrix[:, :-1], p[:, :-1], q, top))
        return pa.concat_tables(out)

    return run


_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _rows(lang: str, sources, part: str, items, values) -> pa.Table:
    n = len(values)
    return pa.table([pa.array([lang] * n, pa.string()), pa.array(list(sources), pa.string()), pa.array([part] * n, pa.string()), pa.array(list(items), pa.string()), pa.array(values, pa.int64())], schema=_PARTIAL)


def _best(lang: str, sources: np.ndarray, names: list[str], matrix: np.ndarray, p: np.ndarray, q: np.ndarray, top: int) -> pa.Table:
    """The tile's best terms of each source, by value and then by name."""
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    named, values = np.array(names, object)[order], _apart(p, q)[:, order]
    able = ((matrix > 0) & (p > q))[:, order]
    who, what, worth = [], [], []
    for i in range(len(sources)):
        at = np.flatnonzero(able[i])
        if len(at) > top:  # only what can be among the best is sorted
            least = np.partition(values[i, at], len(at) - top)[len(at) - top]
            at = at[values[i, at] >= least]
        at = at[np.argsort(-values[i, at], kind="stable")[:top]]
        who += [sources[i]] * len(at)
        what += named[at].tolist()
        worth += values[i, at].tolist()
    return _rows(lang, who, "term", what, worth)


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, groups: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: ``pair`` rows of other sources, ``term`` rows of own terms."""
    counted = term_counts(docs, text_col, lang_col, source_col)
    of_lang = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = cut(of_lang.where(F.col("docs") >= least_docs).select("lang", "term", "whole", "by"), "terms")
    # One row for each group: totals over kept terms, and the place of its source in the language.
    held = kept.select("lang", F.explode("by").alias("g")).groupBy("lang", "g.source").agg(F.sum("g.n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("whole").alias("whole"))
    found = docs.select(*_named(docs, lang_col, source_col)).distinct().join(held, ["lang", "source"], "left").join(langs, "lang", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    placed = found.select(
        "lang",
        "source",
        (count("n") + 2 * count("v")).alias("total"),
        (count("whole") + 2 * count("v")).alias("whole_total"),
        count("v").alias("v"),
        F.floor((F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1) / groups).cast("int").alias("part"),
    )
    placed = cut(placed.withColumn("parts", F.max("part").over(W.partitionBy("lang")) + 1).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / terms)).cast("int")), "groups")

    def meets() -> Column:
        """The other side of each pair of source blocks that a source takes part in."""
        return F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")

    pair = [F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")]
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    sizes = kept.join(placed.select("lang", "blocks").distinct(), "lang").select("lang", block).groupBy("lang", "block").agg(F.count(F.lit(1)).alias("terms"))
    heads = (
        placed.select("*", meets())
        .select("lang", "source", "part", "total", "whole_total", *pair, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        .join(sizes, ["lang", "block"], "left")
        .select("lang", "block", "low", "high", "source", "part", "total", "whole_total", F.coalesce("terms", F.lit(0)).alias("terms"))
    )
    cells = kept.select("lang", "term", "whole", F.explode("by").alias("g")).select("lang", "term", "whole", "g.source", "g.n")
    counts = cells.join(placed.select("lang", "source", "part", "parts", "blocks"), ["lang", "source"]).select("*", meets()).select("lang", block, *pair, "source", "term", "n", "whole")
    keys = ("lang", "block", "low", "high")
    made = counts.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInArrow(_tile(top), "lang string, source string, part string, item string, value long")
    # A term is in one block alone, so of its rows nothing is added up.
    summed = made.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
