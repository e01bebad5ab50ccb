from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import answers as A
from lexigrid.plans import engine

GOOD = 'Yes (a.pdf, p.2).\n```json\n{"sources": [{"document": "b.pdf", "page": 3, "evidence": "words"}, {"document": "c", "page": 1, "evidence": ""}]}\n```\nend'


def parsed(spark, raw, mode="v2"):
    row = spark.createDataFrame([(raw,)], "r string").select(A.parse_sources(F.col("r"), mode).alias("s"), A.strip_json(F.col("r")).alias("t")).first()
    return [(s.document, s.page, s.evidence) for s in row.s], row.t


def test_fence_is_read_and_removed(spark):
    assert parsed(spark, GOOD) == ([("b.pdf", 3, "words"), ("c", 1, "")], "Yes (a.pdf, p.2).\n\nend")


@pytest.mark.parametrize(
    ("raw", "v2", "v1"),
    [
        ("x (a.pdf, p.2) ```json {broken} ```", [("a.pdf", 2, "")], [("a.pdf", 2, "")]),
        ('x (a.pdf, p3) ```json {"sources": []} ```', [], [("a.pdf", 3, "")]),
        ('x ```json {"other": 1} ``` (a, p.1)', [], [("a", 1, "")]),
        ("(a b , p.7) and (c, p. 8)", [("a b", 7, "")], [("a b", 7, "")]),
        ("nothing", [], []),
        ("", [], []),
    ],
)
def test_fallbacks(spark, raw, v2, v1):
    assert parsed(spark, raw)[0] == v2
    assert parsed(spark, raw, "v1")[0] == v1


def test_first_of_two_fences_counts(spark):
    two = '```json {"sources":[{"document":"a","page":1,"evidence":""}]} ``` ```json {"sources":[{"document":"b","page":2,"evidence":""}]} ```'
    assert parsed(spark, two) == ([("a", 1, "")], "")


def test_flatten_defaults(spark):
    row = spark.createDataFrame([("none",)], "r string").select(*A.flatten_answer(A.parse_sources(F.col("r")))).first()
    assert tuple(row) == ("", 0, "")


def test_context_takes_the_best_three(spark):
    hits = spark.createDataFrame([(1, r, f"d{r}", r, f"text {r}") for r in (4, 2, 1, 3)], "question_id int, rank int, doc string, page int, text string")
    text = A.build_context(hits).first().context
    assert text == "\n".join(f"[EXCERPT {r}]\nSource: d{r} | Page: {r}\ntext {r}\n" for r in (1, 2, 3))
    assert "text 4" in A.build_context(hits, passages=None).first().context


def test_one_failure_leaves_the_others(spark):
    class Moody:  # local, so that it travels by value
        def generate(self, system, prompt):
            if "bad" in prompt:
                raise RuntimeError("no")
            return "fine (d, p.1)"

    rows = spark.createDataFrame([(1, "good", "c"), (2, "bad", "c"), (3, "good", None)], "question_id int, question string, context string")
    found = engine.generate_answers(rows, Moody).orderBy("question_id").collect()
    assert [r.answer for r in found] == ["fine (d, p.1)", "[ERROR] RuntimeError: no", "fine (d, p.1)"]
    assert [len(r.sources) for r in found] == [1, 0, 1]


def test_generator_choice():
    made = {"gemini": lambda: "g", "openai": lambda: "o"}
    assert engine.select_generator(made) == "g" and engine.select_generator(made, True) == "o"
    with pytest.raises(LookupError):
        engine.select_generator({"local": lambda: "l"})
