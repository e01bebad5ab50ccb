"""Clauses: headings and the text up to the next one, in expressions of each row.

The places of a pattern's matches are running sums of what lies between and in them: a text
split by the pattern has the gaps, and the matches are extracted in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import strip

CLAUSES = "doc string, heading string, start int, end int, snippet string"
#: Headings in capitals, numbered headings, "Section n" headings.
HEADINGS = (
    r"^([A-Z][A-Z\s\d\.]+[:—\-]?\s*[A-Z\s]*)$",
    r"^(\d+(?:\.\d+)*\.?\s+[A-Z][A-Za-z\s]{3,})$",
    r"^(Section\s+\d+[a-z]?[:.\s]+[A-Z][A-Za-z\s]{2,})$",
)
#: Lines end at ``\n`` alone, classes are those of Unicode; the last pattern takes any case.
_FLAGS = ("(?mdU)", "(?mdU)", "(?mdUi)")


def _marks(text: Column, n: int) -> Column:
    """``start, n, heading`` of each match of a pattern."""
    pattern = _FLAGS[n] + HEADINGS[n]
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    # As the element of an array they are made once, however often they are named below.
    return F.flatten(F.transform(F.array(both), lambda x: _placed(x["found"], x["gaps"], n)))


def _placed(found: Column, gaps: Column, n: int) -> Column:
    sizes = F.zip_with(F.transform(gaps, lambda g: F.length(g)), F.transform(found, lambda m: F.length(m)), lambda g, m: F.struct(g.alias("gap"), F.coalesce(m, F.lit(0)).alias("size")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    placed = F.aggregate(
        sizes,
        zero,
        lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(s["starts"], s["at"] + x["gap"]).alias("starts")),
        lambda s: s["starts"],
    )
    # The last gap has no match behind it.
    return F.zip_with(F.slice(placed, 1, F.size(found)), found, lambda at, m: F.struct(at.alias("start"), F.lit(n).alias("n"), strip(m).alias("heading")))


def extract_clauses(rows: DataFrame, doc_col: str = "doc_name", text_col: str = "text", width: int = 500) -> DataFrame:
    """``doc, heading, start, end, snippet``; two patterns may match at one place, then the first is empty."""
    texts = rows.select(F.col(doc_col).cast("string").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = F.sort_array(F.concat(*[_marks(F.col("text"), n) for n in range(len(HEADINGS))]))
    # Rows without a mark go when marks are exploded; a filter on them would find them all a second time.
    marks = texts.select("doc", "text", marked.alias("marks"))

    def clause(mark: Column, i: Column) -> Column:
        end = F.coalesce(F.get("marks", i + 1)["start"], F.length("text"))
        return F.struct(mark["heading"].alias("heading"), mark["start"].alias("start"), end.alias("end"), strip(F.substring(F.col("text"), mark["start"] + 1, F.least(end - mark["start"], F.lit(width)))).alias("snippet"))

    return marks.select("doc", F.explode(F.transform("marks", clause)).alias("c")).select("doc", "c.*")
