"""Prompts, and what is read from generated answers; all are expressions.

``mode``: "v2" takes the fenced JSON's sources, and inline citations of the raw answer
only if there is no readable JSON; "v1" takes inline citations, of the answer without its
fences, whenever the JSON gave no source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrid.functions.text import strip

SOURCE = "array<struct<document:string,page:int,evidence:string>>"
#: Our own wording of the instructions for a generator.
SYSTEM_PROMPT = (
    "Answer the question from the numbered excerpts alone. Name the file and page behind each statement as (file, p.page). "
    "If the excerpts don't hold the answer, say that. End with a fenced json block: "
    '{"sources": [{"document": file, "page": number, "evidence": words of the excerpt}]}.'
)
#: How a fenced block and an inline source look.
_FENCE = r"(?s)```json\s*(\{.*?\})\s*```"
_INLINE = r"\(([^,]+),\s*p\.?(\d+)\)"


def inline_citations(text: Column) -> Column:
    """Sources named as ``(document, p.page)``; no space may follow ``p.``."""
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(_INLINE), F.lit(1)),
        F.regexp_extract_all(text, F.lit(_INLINE), F.lit(2)),
        lambda d, p: F.struct(strip(d).alias("document"), p.cast("int").alias("page"), F.lit("").alias("evidence")),
    )
    return pairs.cast(SOURCE)


def strip_json(text: Column) -> Column:
    """Without fenced JSON blocks."""
    return strip(F.regexp_replace(text, "(?s)```json.*?```", ""))


def parse_sources(raw: Column, mode: str = "v2") -> Column:
    block = F.regexp_extract(raw, _FENCE, 1)
    readable = (block != "") & F.try_parse_json(block).isNotNull()
    given = F.coalesce(F.from_json(block, f"struct<sources:{SOURCE}>")["sources"], F.array().cast(SOURCE))
    if mode == "v2":
        return F.when(readable, given).otherwise(inline_citations(raw))
    found = F.when(readable, given).otherwise(F.array().cast(SOURCE))
    return F.when(F.size(found) > 0, found).otherwise(inline_citations(strip_json(raw)))


def flatten_answer(sources: Column) -> list[Column]:
    """``document, page, evidence`` of the first source, or "", 0 and ""."""
    first = F.get(sources, 0)
    return [
        F.coalesce(first["document"], F.lit("")).alias("document"),
        F.coalesce(first["page"], F.lit(0)).alias("page"),
        F.coalesce(first["evidence"], F.lit("")).alias("evidence"),
    ]


def excerpt(rank: Column, doc: Column, page: Column, text: Column) -> Column:
    return F.concat(F.lit("[EXCERPT "), rank.cast("string"), F.lit("]\nSource: "), doc, F.lit(" | Page: "), page.cast("string"), F.lit("\n"), text, F.lit("\n"))


def build_context(hits: DataFrame, by: str = "question_id", passages: int | None = 3) -> DataFrame:
    """``by, context`` from hits ``by, rank, doc, page, text``: the best passages in order."""
    kept = hits if passages is None else hits.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy("rank"))).where(F.col("_n") <= passages)
    part = F.struct("rank", excerpt(F.row_number().over(W.partitionBy(by).orderBy("rank")), F.col("doc"), F.col("page"), F.col("text")).alias("x"))
    parts = kept.select(by, part.alias("part"))
    return parts.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["x"]), "\n").alias("context"))


def build_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("DOCUMENT EXCERPTS:\n\n"), context, F.lit("\n\nQUESTION: "), question)


def pretty(question_id: Column, question: Column, answer: Column, sources: Column) -> Column:
    """One answer as lines of text, with up to three sources."""
    shown = F.transform(F.slice(sources, 1, 3), lambda s: F.concat(F.lit("  - "), s["document"], F.lit(", p."), s["page"].cast("string")))
    return F.concat_ws("\n", F.concat(F.lit("Q"), question_id.cast("string"), F.lit(": "), question), answer, F.array_join(shown, "\n"))
