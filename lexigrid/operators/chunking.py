"""Pages to chunks.

Pages have ``doc_name, page_number, text, corpus_ord``; chunks ``id, doc, page,
start_offset, end_offset, text, chunk_type, token_count, corpus_ord``.

``tail``: windows end when one reaches the end of its text ("stop"). "compat" goes on
from there in steps of one, as long as anything is left, which repeats the text's end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrid.config import EngineConfig
from lexigrid.functions.text import strip, token_count

CHUNKS = "id string, doc string, page int, start_offset int, end_offset int, text string, chunk_type string, corpus_ord long"
_NAMES = [c.split()[0] for c in CHUNKS.split(", ")]
_BREAK = re.compile(r"(?<=[.!?\n])\s+")


def _finish(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("token_count", token_count(F.col("text")))


def _id(kind: str, index: Column) -> Column:
    return F.concat(F.col("doc_name"), F.lit("_p"), F.col("page_number").cast("string"), F.lit(f"_{kind}"), index.cast("string")).alias("id")


def page_chunks(pages: DataFrame) -> DataFrame:
    """A chunk for each page with text."""
    text = strip(F.col("text"))
    rows = pages.withColumn("text", text).where(F.length("text") > 0)
    return _finish(
        rows.select(
            _id("page_", F.lit(0)),
            F.col("doc_name").alias("doc"),
            F.col("page_number").alias("page"),
            F.lit(0).alias("start_offset"),
            F.length("text").alias("end_offset"),
            "text",
            F.lit("page").alias("chunk_type"),
            "corpus_ord",
        )
    )


def stride_chunks(pages: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``, for texts without a tokenizer."""
    step = max(1, size - overlap)
    rows = pages.withColumn("text", strip(F.col("text"))).where(F.length("text") > 0)
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))
    # Pieces are cut before rows are made of them, so no row carries the whole text.
    pieces = F.transform(starts, lambda at: F.struct(at.alias("at"), F.substring(F.col("text"), at + 1, F.lit(size)).alias("text")))
    cut = rows.select("doc_name", "page_number", "corpus_ord", F.posexplode(pieces).alias("idx", "p"))
    piece = cut.select("doc_name", "page_number", "corpus_ord", "idx", "p.at", strip(F.col("p.text")).alias("text")).where(F.length("text") > 0)
    return _finish(
        piece.select(
            _id("token_", F.col("idx")),
            F.col("doc_name").alias("doc"),
            F.col("page_number").alias("page"),
            F.col("at").alias("start_offset"),
            (F.col("at") + F.length("text")).alias("end_offset"),
            "text",
            F.lit("token").alias("chunk_type"),
            "corpus_ord",
        )
    )


def windows(length: int, end_of: Callable[[int], int], overlap: int, tail: str = "stop") -> Iterator[tuple[int, int]]:
    """Successive ``(start, end)``; each begins ``overlap`` before the last end, or one further."""
    start = 0
    while start < length:
        end = end_of(start)
        yield start, end
        if tail == "stop" and end >= length:
            return
        start = max(end - overlap, start + 1)


def sentence_windows(text: str, size: int = 1000, overlap: int = 150, tail: str = "stop") -> Iterator[tuple[int, int]]:
    """Windows that end behind the last sentence break in their last fifth, if there is one."""

    def end_of(start: int) -> int:
        end = min(start + size, len(text))
        if end < len(text):
            window, last = text[start:end], None
            for last in _BREAK.finditer(window, max(0, len(window) - size // 5)):
                pass
            if last is not None:
                return start + last.start() + 1
        return end

    return windows(len(text), end_of, overlap, tail)


def _sentences(size: int, overlap: int, tail: str):
    def pieces(text: str):
        index = 0
        for start, end in sentence_windows(text, size, overlap, tail):
            piece = text[start:end].strip()
            if piece:
                yield index, start, start + len(piece), piece
                index += 1

    return pieces


class WordEncoder:
    """The default encoder: white space and words, losslessly; ids are positions."""

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.finditer(r"\s*\S+|\s+$", text)]


class BpeEncoder:
    """Tokens of a rank file (base64 token, rank), by the ``tiktoken`` library.

    Spans are of characters; a token that ends inside a character ends before it here.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def spans(self, text: str) -> list[tuple[int, int]]:
        from itertools import accumulate

        ends = list(accumulate(len(self.encoding.decode_single_token_bytes(t)) for t in self.encoding.encode_ordinary(text)))
        before = list(accumulate((b & 0xC0 != 0x80 for b in text.encode()), initial=0))  # characters that begin before a byte
        # An end inside a character is moved before it: that character has begun but is not over.
        raw = text.encode()
        places = [before[e] - (e < len(raw) and raw[e] & 0xC0 == 0x80) for e in ends]
        return list(zip([0, *places], places, strict=False))


def _tokens(make_encoder: Callable[[], object], longest: int, overlap: int, tail: str):
    encoder = make_encoder()

    def pieces(text: str):
        text, index = text.strip(), 0
        spans = encoder.spans(text)
        for a, b in windows(len(spans), lambda s: min(s + longest, len(spans)), overlap, tail):
            piece = text[spans[a][0] : spans[b - 1][1]].strip()
            if piece:
                at = text.find(piece[:40])
                yield index, max(0, at), max(0, at + len(piece)), piece
                index += 1

    return pieces


def _split(make: Callable, args: tuple, kind: str):
    def run(batches):
        pieces = make(*args)
        for batch in batches:
            rows = []
            for doc, page, order, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows += [(f"{doc}_p{page}_{kind}{i}", doc, page, a, b, piece, "token", order) for i, a, b, piece in pieces(text or "")]
                if len(rows) >= 2048:
                    yield _as_batch(rows)
                    rows = []
            if rows:
                yield _as_batch(rows)

    return run


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select("doc_name", F.col("page_number").cast("int"), F.col("corpus_ord").cast("long"), "text")


def sentence_chunks(pages: DataFrame, size: int = 1000, overlap: int = 150, tail: str = "stop") -> DataFrame:
    return _finish(_pages(pages).mapInArrow(_split(_sentences, (size, overlap, tail), "c"), CHUNKS))


def token_chunks(pages: DataFrame, config: EngineConfig | None = None, tail: str = "stop", make_encoder: Callable[[], object] = WordEncoder) -> DataFrame:
    """Windows of at most ``TOKEN_CHUNK_MAX`` tokens of an encoder with ``spans(text)``."""
    config = config or EngineConfig()
    return _finish(_pages(pages).mapInArrow(_split(_tokens, (make_encoder, config.TOKEN_CHUNK_MAX, config.token_overlap(), tail), "token_"), CHUNKS))


def first_by_id(chunks: DataFrame, order: str = "corpus_ord") -> DataFrame:
    """The first chunk of each id, in corpus order and then by place in the page."""
    best = F.row_number().over(W.partitionBy("id").orderBy(order, "start_offset", "end_offset", "text"))
    return chunks.withColumn("_n", best).where("_n = 1").drop("_n")


def chunk_all(pages: DataFrame, strategy: str = "token", config: EngineConfig | None = None, tail: str = "stop", make_encoder: Callable[[], object] = WordEncoder) -> DataFrame:
    """``strategy``: "page", "token", "stride" or "sentence"; the first of equal ids stays."""
    config = config or EngineConfig()
    made = {
        "page": lambda: page_chunks(pages),
        "token": lambda: token_chunks(pages, config, tail, make_encoder),
        "stride": lambda: stride_chunks(pages, config.CHUNK_SIZE, config.CHUNK_OVERLAP),
        "sentence": lambda: sentence_chunks(pages, config.CHUNK_SIZE, config.CHUNK_OVERLAP, tail),
    }
    return first_by_id(made[strategy]())
