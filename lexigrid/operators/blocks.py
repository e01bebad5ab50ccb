"""Ranked search over blocks of postings: blocks that can't reach the best ``k`` are skipped.

A span is ``SPAN`` consecutive chunk numbers; a block has the postings of one term in one
span, with their number, greatest count and least chunk length as its header. The part of a
score that a term gives is greatest for that count and length, so headers bound the score of
every chunk of a span. A search

1. sums the headers of the asked terms to a bound for each question and span,
2. scores the ``k`` spans of greatest bound of each question: its k-th best score there is
   a score that the result's last row has at least,
3. scores the spans whose bound reaches that score, and ranks what is found.

Results are those of ``lexical.indexed_search``: what is skipped can't be among them.

Scale: headers are columns of their own, so steps 1 and 2 read no entries but those of the
first spans; bounds are at most terms times spans rows, summed by question and span. A block
has at most ``SPAN`` entries, whatever its term; the first spans of a question are found by a
limit that tasks apply before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrid.operators import lexical, termwork

SPAN = 1024


def block_table(tokens: DataFrame, span: int = SPAN) -> DataFrame:
    """``term, span, n, max_tf, min_dl, entries`` from tokens with a ``number``, or a ``corpus_ord`` of each chunk's own.

    Chunks are dealt out by their span, so all blocks of a span are made in one place and none is shuffled.
    """
    if "number" not in tokens.columns:
        tokens = tokens.withColumn("number", F.col("corpus_ord"))
    sized = tokens.select("chunk_id", "corpus_ord", F.floor(F.col("number") / span).alias("span"), F.size("tokens").alias("dl"), "tokens").where("dl > 0")
    kind = dict(tokens.dtypes)["chunk_id"]
    entry = f"struct<chunk_id: {kind}, corpus_ord: bigint, dl: int, tf: int>"
    return sized.groupBy("span").applyInArrow(termwork.span_blocks, f"term string, span long, n long, max_tf int, min_dl int, entries array<{entry}>")


def index_tables(tokens: DataFrame, span: int = SPAN) -> dict:
    """What ``search`` reads: blocks, term figures and corpus figures, for ``store.save_tables`` as those of ``lexical``."""
    return {
        "blocks": block_table(tokens, span),
        "sizes": lexical.corpus_sizes(tokens),
        "terms": lambda saved: lexical.term_figures(saved["blocks"].groupBy("term").agg(F.sum("n").alias("df")), saved["sizes"]),
        "corpus": lambda saved: lexical.corpus_figures(saved["sizes"], saved["terms"]),
    }


def _part(tf: str, dl: str) -> Column:
    k1, b = lexical.K1, lexical.B
    return F.col("times") * F.col("idf") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / F.col("avgdl")))


def _asked(index: dict[str, DataFrame], queries: DataFrame, stopwords: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``question_id, term, times, idf, avgdl`` of the questions, and the blocks of their terms."""
    weighted, few, names = lexical.weighted_terms(index["terms"], index["corpus"], queries, stopwords)
    blocks = index["blocks"]
    if few:
        return F.broadcast(weighted), blocks.where(F.col("term").isin(*names) if names else F.lit(False))
    return weighted, blocks


def _scores(blocks: DataFrame, weighted: DataFrame, spans: DataFrame) -> DataFrame:
    """``question_id, chunk_id, corpus_ord, score`` in the given spans of each question."""
    mine = blocks.select("term", "span", "entries").join(weighted, "term").join(spans.select("question_id", "span"), ["question_id", "span"])
    each = mine.select("question_id", "times", "idf", "avgdl", F.explode("entries").alias("e")).select("question_id", "times", "idf", "avgdl", "e.*")
    return each.groupBy("question_id", "chunk_id", "corpus_ord").agg(F.sum(_part("tf", "dl")).alias("score"))


def _spans(index: dict[str, DataFrame], queries: DataFrame, k: int, stopwords: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Asked terms, their blocks, the bound of each question and span, and those that have to be scored."""
    weighted, blocks = _asked(index, queries, stopwords)
    heads = blocks.select("term", "span", "n", "max_tf", "min_dl").join(weighted, "term")
    bounds = heads.groupBy("question_id", "span").agg(F.sum(F.greatest(F.lit(0.0), _part("max_tf", "min_dl"))).alias("bound"), F.sum("n").alias("entries"), F.count(F.lit(1)).alias("blocks"))
    order = W.partitionBy("question_id").orderBy(F.desc("bound"), "span")
    first = bounds.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    scored = _scores(blocks, weighted, first)
    best = W.partitionBy("question_id").orderBy(F.desc("score"))
    last = scored.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select("question_id", F.col("score").alias("least"))
    # Sums of the same parts in another order may differ in their last places.
    slack = 1e-6 + 1e-9 * F.abs("least")
    needed = bounds.join(last, "question_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - slack))
    return weighted, blocks, bounds, needed


def search(index: dict[str, DataFrame], queries: DataFrame, k: int = 30, stopwords: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """``lexical.indexed_search`` that scores only spans that may hold a result."""
    weighted, blocks, _, needed = _spans(index, queries, k, stopwords)
    return lexical.ranked(_scores(blocks, weighted, needed), k, digits)


def blocks_read(index: dict[str, DataFrame], queries: DataFrame, k: int = 30, stopwords: Sequence[str] = ()) -> DataFrame:
    """``question_id, blocks, entries, read_blocks, read_entries``: what a search has to score of all there is."""
    _, _, bounds, needed = _spans(index, queries, k, stopwords)

    def total(rows: DataFrame, prefix: str = "") -> DataFrame:
        return rows.groupBy("question_id").agg(F.sum("blocks").alias(f"{prefix}blocks"), F.sum("entries").alias(f"{prefix}entries"))

    return total(bounds).join(total(needed, "read_"), "question_id")
