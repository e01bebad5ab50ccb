from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrid.operators import blocks, cells, lexical, vector
from lexigrid.sources import store

WORDS = ["rent", "lease", "notice", "deposit", "tenant", "court", "sum", "the"]


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(WORDS[: 2 + i % 7]) for _ in range(r.choice([1, 5, 30, 80]))) for i in range(400)]
    texts[250:260] = ["rare " * 9] * 10
    texts[7] = ""
    rows = [(f"c{i}", i // 3, i * 7 - 500, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, corpus_ord long, number long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def tokens(chunks):
    return lexical.token_table(chunks, number="number").cache()


@pytest.fixture(scope="module")
def index(spark, tokens, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    store.save_tables(f"{folder}/lexical", "lexical", lexical.index_tables(tokens))
    store.save_tables(f"{folder}/blocks", "blocks", blocks.index_tables(tokens, 64))
    return store.load_tables(spark, f"{folder}/lexical", "lexical"), store.load_tables(spark, f"{folder}/blocks", "blocks")


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions, 1)), "question_id int, question string")


def shown(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


QUERIES = ("", "rent", "NOT rent", "rent AND lease", "rent or the and NOT court", "the NOT rent NOT lease", "zzz", "NOT zzz", "rent lease AND (sum OR court) AND NOT the", "rare or NOT sum", "rent AND NOT rent")


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("stop", [(), ("the",)])
def test_boolean_on_postings_equals_a_scan(tokens, index, query, stop):
    want = lexical.boolean_search(tokens, query, stop)
    assert shown(lexical.indexed_boolean(index[0], query, stop), "chunk_id", "corpus_ord") == shown(want, "chunk_id", "corpus_ord")


def test_boolean_reads_postings_of_asked_terms_alone(index):
    plan = lexical.indexed_boolean(index[0], "rent AND lease NOT sum")._jdf.queryExecution().toString()
    scan = next(x for x in plan.split("== Physical Plan ==")[1].split("\n") if "FileScan" in x and "term" in x)
    assert "In(term, [lease,rent,sum])" in scan and "positions" not in scan and "tokens" not in plan


@pytest.mark.parametrize("first,second,distance", [("rent", "lease", 1), ("rent", "lease", 0), ("the", "the", 0), ("court house", "sum", 4), ("rare", "rent", 9), ("zzz", "rent", 9), ("", "rent", 3), ("tenant", "deposit", 40)])
def test_proximity_on_postings_equals_a_scan(tokens, index, first, second, distance):
    want = lexical.proximity_search(tokens, first, second, distance)
    got = lexical.indexed_proximity(index[0], first, second, distance)
    assert shown(got, "chunk_id", "corpus_ord") == shown(want, "chunk_id", "corpus_ord")


def test_proximity_reads_postings_of_two_words(index):
    plan = lexical.indexed_proximity(index[0], "rent", "lease", 3)._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [lease,rent])" in plan.replace("rent,lease", "lease,rent") and plan.count("FileScan") == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abz ", max_size=14), min_size=1, max_size=6), st.integers(0, 4))
def test_merged_lists_find_what_all_pairs_find(spark, texts, distance):
    rows = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "id string, corpus_ord long, text string")
    tokens = lexical.token_table(rows)
    made = {"postings": lexical.row_postings(tokens)}
    assert shown(lexical.indexed_proximity(made, "a", "b", distance), "chunk_id") == shown(lexical.proximity_search(tokens, "a", "b", distance), "chunk_id")


@pytest.mark.parametrize("bound", [0, 10_000])
@pytest.mark.parametrize("k", [1, 3, 30, 500])
def test_blocks_give_the_whole_ranking(spark, tokens, index, k, bound, monkeypatch):
    monkeypatch.setattr(lexical, "SENT_TERMS", bound)
    asked = ask(spark, "rent lease", "rare", "the the court", "zzz", "", "rare sum notice deposit")
    want = lexical.bm25_search(tokens, asked, k, digits=6)
    got = blocks.search(index[1], asked, k, digits=6)
    assert shown(got, "question_id", "rank", "chunk_id", "score") == shown(want, "question_id", "rank", "chunk_id", "score")


def test_blocks_are_skipped(spark, index):
    read = {r.question_id: r for r in blocks.blocks_read(index[1], ask(spark, "rare sum", "rare"), 3).collect()}
    assert read[1].read_blocks < read[1].blocks / 2 and read[1].read_entries < read[1].entries / 2
    assert read[2].read_entries <= 10


# Vectors


def clustered(n, dim=16, groups=12, seed=5):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, dim))
    x = middle[r.integers(0, groups, n)] + r.normal(size=(n, dim)) * 0.15
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark):
    x = clustered(3000)
    x[100:900] = x[100]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).cache()


def queries_of(vectors, where="vec_id % 150 = 0"):
    return vectors.where(where).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query_vec"))


COLUMNS = ("question_id", "rank", "vec_id", "score")


@pytest.mark.parametrize("k,digits,part,deal", [(30, 6, 8192, 4096), (1, 6, 100, 3), (900, 3, 500, 7), (5000, 6, 8192, 4096)])
def test_cells_give_the_exact_result(spark, vectors, tmp_path, monkeypatch, k, digits, part, deal):
    monkeypatch.setattr(cells, "PART", part)
    monkeypatch.setattr(cells, "QUERIES", deal)
    store.save_tables(f"{tmp_path}/i", "cells", cells.index_tables(vectors))
    index = store.load_tables(spark, f"{tmp_path}/i", "cells")
    asked = queries_of(vectors)
    want = vector.vector_search(vectors, asked, k, digits=digits)
    assert shown(cells.search(index, asked, k, digits), *COLUMNS) == shown(want, *COLUMNS)


def test_cells_are_skipped_and_probes_recall(vectors):
    index = {name: table.cache() for name, table in cells.index_tables(vectors, cells=40).items()}
    asked = queries_of(vectors)
    exact = cells.CellSearch(index, asked, 10)
    rows = [r["rows"] for r in exact.rows_read().collect()]
    assert len(rows) == 20 and np.mean(rows) < 3001 / 2
    want = {(r.question_id, r.vec_id) for r in exact.result().collect()}
    found = {(r.question_id, r.vec_id) for r in cells.search(index, asked, 10, probes=4).collect()}
    assert len(want & found) / len(want) >= 0.9
    few = cells.CellSearch(index, asked, 10, probes=1)
    assert np.mean([r["rows"] for r in few.rows_read().collect()]) < np.mean(rows)


def test_crowded_cells_are_many_tasks(vectors, monkeypatch):
    monkeypatch.setattr(cells, "PART", 100)
    index = cells.index_tables(vectors, cells=4)
    found = cells.CellSearch(index, queries_of(vectors), 10)
    assert {r.cell: r.parts for r in found.sizes.collect()} == {r.cell: -(-r.n // 100) for r in found.sizes.collect()} and found.sizes.count() <= 4


def test_odd_vectors(spark, vectors):
    empty = vectors.where("false")
    index = cells.index_tables(empty)
    assert cells.search(index, queries_of(vectors)).count() == 0
    one = cells.index_tables(vectors.where("vec_id in (3, 9001)"))
    assert cells.search(one, queries_of(vectors, "vec_id in (3, 4, 9001)"), 5).count() == 2
    assert cells.search(one, queries_of(empty), 5).count() == 0
    named = vectors.select(F.concat(F.lit("v"), "vec_id").alias("vec_id"), "embedding")
    asked = queries_of(vectors, "vec_id in (100, 2000)")
    assert shown(cells.search(cells.index_tables(named), asked, 7), *COLUMNS) == shown(vector.vector_search(named, asked, 7), *COLUMNS)


def test_stored_postings_and_blocks_are_not_shuffled(tokens):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    made = lexical.index_tables(tokens)
    assert "rangepartitioning" not in plan(made["postings"]) and "rangepartitioning" not in plan(made["directory"])
    assert plan(blocks.block_table(tokens, 64)).count("Exchange hashpartitioning(span") == 1 and "rangepartitioning" not in plan(blocks.block_table(tokens, 64))
