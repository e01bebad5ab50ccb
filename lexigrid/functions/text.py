"""Text expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str`` methods see it.
_SPACE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"


def strip(text: Column) -> Column:
    """Without white space at both ends (``trim`` takes spaces alone)."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def has_text(text: Column) -> Column:
    """Whether ``strip`` leaves anything of it."""
    return text.rlike(_SPACE.replace("[", "[^", 1))


def clean_text(text: Column) -> Column:
    """Line ends made ``\\n``, runs of spaces and tabs one space, at most one blank line."""
    one_end = F.regexp_replace(text, "\r\n|\r", "\n")
    one_space = F.regexp_replace(one_end, "[ \t]+", " ")
    return strip(F.regexp_replace(one_space, "\n{3,}", "\n\n"))


def tokenize(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Lower-case runs of ``[a-z0-9]``, in order, without the stop words."""
    tokens = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")
    return F.filter(tokens, lambda t: ~t.isin(*stopwords)) if stopwords else tokens


def english_stopwords(spark) -> list[str]:
    """Spark's own English list; searches take no stop words unless they are given."""
    return sorted(StopWordsRemover.loadDefaultStopWords("english"))


def token_count(text: Column) -> Column:
    """Words between white space of the raw text."""
    return F.size(F.filter(F.split(text, f"{_SPACE}+"), lambda t: t != ""))


def preview(text: Column, width: int = 300, more: str = "...") -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit(more))).otherwise(text)
