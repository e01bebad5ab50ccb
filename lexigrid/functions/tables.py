"""Table functions for SQL: the windows of a text, row by row with ``LATERAL``.

    SELECT d.doc_id, c.* FROM documents d, LATERAL lexigrid_sentence_chunks(d.text, 1000, 150, 'stop') c

Rows are ``idx, start_offset, end_offset, text``, as the chunking operators make them; null
and empty texts have none.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lexigrid.operators import chunking

ROWS = "idx int, start_offset int, end_offset int, text string"


class SentenceChunks:
    """``(text, size, overlap, tail)``"""

    def eval(self, text: str, size: int = 1000, overlap: int = 150, tail: str = "stop"):
        yield from chunking._sentences(size, overlap, tail)(text or "")


class TokenChunks:
    """``(text, longest, overlap, tail)``, of words; the encoder is made once for a task."""

    def __init__(self) -> None:
        self.encoder = chunking.WordEncoder()

    def eval(self, text: str, longest: int = 600, overlap: int = 60, tail: str = "stop"):
        yield from chunking._tokens(lambda: self.encoder, longest, overlap, tail)(text or "")


def register_table_functions(spark: SparkSession) -> None:
    """Make the table functions known to SQL of this session."""
    spark.udtf.register("lexigrid_sentence_chunks", udtf(SentenceChunks, returnType=ROWS))
    spark.udtf.register("lexigrid_token_chunks", udtf(TokenChunks, returnType=ROWS))
