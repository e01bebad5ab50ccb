"""Citations in legal texts, as expressions.

Case, statute, section and court-rule citations; ``distinct_citations`` is the sorted set
of the looser patterns, ``raw_citations`` all matches of the stricter ones in order of
pattern and place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.functions.text import strip

#: Looser patterns (case, statute, section, rule); ``(?U)`` as in Python.
LOOSE = (
    r"(?U)[A-Z][a-z][\w\s]+\s+v\.?\s+[\w\s]+,\s+\d+\s+[\w\.]+\s+\d+",
    r"(?U)\d+\s+U\.S\.C\.?\s+§+\s*\d+[a-z]?",
    r"(?U)§+\s*\d+(?:\.\d+)*(?:\([a-z]\))?",
    r"(?U)\bRule\s+\d+(?:\.\d+)?(?:\([a-z]\))?\b",
)
#: Stricter patterns (case, statute, section).
STRICT = (
    r"(?U)[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+v\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,?\s+\d+\s+[A-Z\.]+\s+\d+",
    r"(?U)\d+\s+U\.S\.C\.\s+§\s*\d+[a-z]?",
    r"(?U)§\s*\d+[a-z]?(?:\(\w\))?",
)


def _all(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), strip)


def distinct_citations(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[_all(text, p) for p in LOOSE])))


def raw_citations(text: Column) -> Column:
    return F.concat(*[_all(text, p) for p in STRICT])
