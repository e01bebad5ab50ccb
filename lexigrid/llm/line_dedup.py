"""Line dedup by overlapping three-line windows, in DataFrame functions only.

A window is ``width`` consecutive lines (split at ``\\n``) of one document; windows
of nothing but white space are left out. A line is removed if it lies in a window
whose lines also start earlier: in a document that comes before, or before it in the
same document. Windows are judged on the input, not on what is left.

Defined results
* null or empty text: one empty line, no window, nothing removed; a null text stays null.
* fewer lines than ``width``: no window.
* documents come in the order of (id, hash of the text), null ids first; rows that
  repeat id and text are one document, each of them returned with the same result.
* an empty table gives an empty table; columns besides id and text pass through. Names
  beginning with ``_ld_`` are refused.

Scale: windows travel as two 64-bit hashes and a place, never as text. The first place
of each window is a partially aggregated minimum, so a line block shared by a third of
all documents is summed before it is shuffled; going back from windows to places is a
sort-merge join whose hot keys AQE can split, as the other side has one row a key.
The distinct starts of covering windows are gathered by document, so they are bounded by the
document's own length however often rows repeat it; each task adds up its own ones first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm._shared import refuse_reserved


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row for each window: ``_ld_id, _ld_hash, _ld_at`` and its two hashes."""
    text = F.col(text_col)
    lines = _lines(text)

    def window(i: Column) -> Column:
        return F.struct(i.alias("at"), F.array_join(F.slice(F.col("_ld_lines"), i + 1, width), "\n").alias("body"))

    starts = F.when(F.size("_ld_lines") >= width, F.sequence(F.lit(0), F.size("_ld_lines") - width)).otherwise(F.array().cast("array<int>"))
    return (
        docs.select(F.col(id_col).alias("_ld_id"), F.xxhash64(text).alias("_ld_hash"), lines.alias("_ld_lines"))
        .where(F.size("_ld_lines") >= width)
        .select("_ld_id", "_ld_hash", F.explode(F.transform(starts, window)).alias("w"))
        .where(F.col("w.body").rlike("[^\\x20\\x09-\\x0D]"))
        .select(
            "_ld_id",
            "_ld_hash",
            F.col("w.at").alias("_ld_at"),
            F.xxhash64("w.body").alias("_ld_h1"),
            F.xxhash64(F.lit(width), F.col("w.body")).alias("_ld_h2"),
        )
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with later occurrences of repeated windows cut out of the text.

    Adds ``n_lines`` and ``n_removed`` (long).
    """
    refuse_reserved(docs, "_ld_")
    place = F.struct("_ld_id", "_ld_hash", "_ld_at")
    windows = line_windows(docs, id_col, text_col, width)
    first = windows.groupBy("_ld_h1", "_ld_h2").agg(F.min(place).alias("_ld_first"), F.count(F.lit(1)).alias("_ld_n")).where("_ld_n > 1").drop("_ld_n")
    covered = (
        windows.join(first, ["_ld_h1", "_ld_h2"])
        .where(place > F.col("_ld_first"))
        .groupBy(F.col("_ld_id").alias("_ld_doc"), F.col("_ld_hash").alias("_ld_text"))
        .agg(F.flatten(F.transform(F.collect_set("_ld_at"), lambda i: F.sequence(i, i + (width - 1)))).alias("_ld_cut"))
    )
    lines = _lines(F.col(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_ld_cut"))
    joined = docs.join(
        covered.hint("shuffle_hash"),
        F.col(id_col).eqNullSafe(F.col("_ld_doc")) & (F.xxhash64(F.col(text_col)) == F.col("_ld_text")),
        "left",
    )
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    sized = joined.select(*rest, F.col(text_col), lines.alias("_ld_lines"), F.when(F.col("_ld_cut").isNotNull(), kept).alias("_ld_kept"))
    new_text = F.when(F.col("_ld_kept").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform("_ld_kept", lambda i: F.get(F.col("_ld_lines"), i)), "\n"))
    made = {
        text_col: new_text.alias(text_col),
        "n_lines": F.size("_ld_lines").cast("long").alias("n_lines"),
        "n_removed": F.when(F.col("_ld_kept").isNull(), F.lit(0)).otherwise(F.size("_ld_lines") - F.size("_ld_kept")).cast("long").alias("n_removed"),
    }
    order = [made.pop(c) if c in made else F.col(c) for c in docs.columns]
    return sized.select(*order, *made.values())
