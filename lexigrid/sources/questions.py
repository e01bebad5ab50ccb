"""Questions: from a table or file with a ``Question`` column, else our default set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.sources.store import numbered

#: Default questions, about what contracts usually settle.
DEFAULTS = (
    "Which sums are due, when, and how are they paid?",
    "How can the contract be ended, and with what notice?",
    "Who holds whom harmless, and for what?",
    "How far does each side's liability go?",
    "Who owns or may use the intellectual property?",
    "What has to be kept secret, and for how long?",
    "Are competition or hiring of staff restricted?",
    "Which law applies, and where are disputes settled?",
    "What does each side warrant?",
    "What has to happen before the contract takes effect?",
    "What excuses a delay beyond a side's control?",
    "Which insurance must be kept?",
    "What follows from a breach?",
    "Who are the parties, and what does each do?",
    "How is the contract renewed or changed?",
)


def load_questions(rows: DataFrame, column: str = "Question", order: str | None = None) -> DataFrame:
    """``question_id`` from 1 in input order, ``question``; missing questions go."""
    key = F.col(order) if order else F.monotonically_increasing_id()
    kept = rows.select(key.alias("_o"), F.col(column).alias("question")).where(F.col("question").isNotNull())
    return numbered(kept, "_o", "question_id", 1).select(F.col("question_id").cast("int").alias("question_id"), "question")


def read_questions(spark: SparkSession, paths: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The first of the CSV or XLSX files that can be read, else the defaults."""
    from lexigrid.sources.files import xlsx_rows

    for path in paths:
        try:
            if path.lower().endswith(".xlsx"):
                content = spark.read.format("binaryFile").load(path).select("content").first()[0]
                names, *rows = xlsx_rows(bytes(content))
                at = names.index("Question")
                found = [(i, r[at]) for i, r in enumerate(rows) if at < len(r) and r[at]]
                return load_questions(spark.createDataFrame(found, "_n int, Question string"), order="_n")
            table = spark.read.option("header", True).option("multiLine", True).csv(path)
            if "Question" in table.columns:
                return load_questions(table)
        except Exception:  # as with any missing candidate, the next is tried
            continue
    return spark.createDataFrame([(i + 1, q) for i, q in enumerate(DEFAULTS)], "question_id int, question string")
