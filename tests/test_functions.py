from __future__ import annotations

import random

import pytest

from lexigrid.functions.tables import register_table_functions
from lexigrid.operators import chunking, fusion
from lexigrid.sources import questions, store


@pytest.mark.parametrize("tail", ["stop", "compat"])
def test_table_functions_give_the_rows_of_the_operators(spark, tail):
    register_table_functions(spark)
    r = random.Random(4)
    texts = ["", None, "one sentence. another\n\nand more", " ".join(r.choice(["word", "end.", "é😀", "line\n", "what?  "]) for _ in range(900)), "x" * 700]
    rows = spark.createDataFrame([(f"d{i}", 1, t, i) for i, t in enumerate(texts)], "doc_name string, page_number int, text string, corpus_ord long")
    rows.createOrReplaceTempView("chunked_pages")
    for name, arguments, made, kind in (
        ("sentence", "120, 30", chunking.sentence_chunks(rows, 120, 30, tail), "c"),
        ("token", "40, 9", chunking._finish(chunking._pages(rows).mapInArrow(chunking._split(chunking._tokens, (chunking.WordEncoder, 40, 9, tail), "token_"), chunking.CHUNKS)), "token_"),
    ):
        found = spark.sql(f"SELECT concat(doc_name, '_p1_{kind}', c.idx) AS id, c.start_offset, c.end_offset, c.text FROM chunked_pages, LATERAL lexigrid_{name}_chunks(text, {arguments}, '{tail}') c")
        want = made.select(*found.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


def test_a_model_is_loaded_once_a_partition_and_ties_stay(spark):
    loads, calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def make():
        loads.add(1)

        def score(pairs):
            calls.add(1)
            assert len(pairs) <= 4
            return [float(len(text) // 10) for _, text in pairs]

        return score

    hits = [(q, f"c{i}", i, "y" * (i % 5 * 7) if i else None) for q in (1, 2) for i in range(12)]
    rows = spark.createDataFrame(hits, "question_id int, chunk_id string, rank int, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "a"), (2, None)], "question_id int, question string")
    best = fusion.rerank(rows, asked, 6, fusion.batched_scorer(make, 4)).collect()
    assert calls.value >= 6 and 1 <= loads.value <= 4
    want = sorted(range(12), key=lambda i: (-(i % 5 * 7 // 10 if i else 0), i))[:6]
    for q in (1, 2):
        assert [r.chunk_id for r in sorted(best, key=lambda r: r["rank"]) if r.question_id == q] == [f"c{i}" for i in want]


def test_rows_are_numbered_in_order(spark):
    values = [random.Random(2).randrange(500) for _ in range(1000)]
    rows = spark.createDataFrame([(v, f"t{v}") for v in values], "at long, t string").repartition(7)
    found = store.numbered(rows, "at", "n", 5).orderBy("n").collect()
    assert [r.n for r in found] == list(range(5, 1005)) and [r["at"] for r in found] == sorted(values)
    assert store.numbered(rows.where("false"), "at", "n").count() == 0
    plan = store.numbered(rows, "at", "n")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_questions_are_numbered_without_gaps(spark):
    rows = spark.createDataFrame([(i * 3 % 50, None if i % 4 == 0 else f"q{i * 3 % 50:02}", "x") for i in range(50)], "k int, Question string, question_id string").repartition(5)
    found = questions.load_questions(rows, order="k").orderBy("question_id").collect()
    kept = sorted(f"q{i * 3 % 50:02}" for i in range(50) if i % 4)
    assert [(r.question_id, r.question) for r in found] == list(enumerate(kept, 1))
    assert questions.load_questions(rows.where("false")).count() == 0
    in_order = spark.createDataFrame([(f"q{i}",) for i in range(20)], "Question string").coalesce(1)
    assert [r.question for r in questions.load_questions(in_order).orderBy("question_id").collect()] == [f"q{i}" for i in range(20)]
