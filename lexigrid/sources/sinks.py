"""Sinks for answers: JSON lines, a file a question, one array."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame


def write_answers(answers: DataFrame, folder: str) -> None:
    """JSON lines, in parallel; for any number of answers."""
    answers.write.mode("overwrite").json(folder)


def write_question_files(answers: DataFrame, folder: str) -> list[str]:
    """``q01.json`` and so on, for a batch of questions; driver-side and streamed."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for row in answers.orderBy("question_id").toLocalIterator():
        names.append(os.path.join(folder, f"q{row['question_id']:02d}.json"))
        with open(names[-1], "w", encoding="utf-8") as out:
            json.dump(row.asDict(recursive=True), out, ensure_ascii=False, indent=2)
    return names


def write_array(answers: DataFrame, path: str) -> None:
    """One JSON array, in order of question; streamed row by row."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(answers.orderBy("question_id").toLocalIterator()):
            out.write((",\n" if i else "\n") + json.dumps(row.asDict(recursive=True), ensure_ascii=False))
        out.write("\n]\n")
