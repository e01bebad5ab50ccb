from __future__ import annotations

import math

import pytest

from lexigrid.operators import fusion, lexical, vector

TEXTS = (
    "The merger and the acquisition closed in Boston last spring.",
    "An acquisition of Acme was made in California without any merger talk.",
    "Technology licences and patents are covered in this file.",
    "Disputes about pay go to arbitration under the agreement.",
    "Rules on the environment and duties to report are set out here.",
)


@pytest.fixture(scope="module")
def tokens(spark):
    rows = spark.createDataFrame([(f"doc_{i}_p1_page_0", i, t) for i, t in enumerate(TEXTS)], "id string, corpus_ord long, text string")
    return lexical.token_table(rows).cache()


def ids(df):
    return {int(r.chunk_id.split("_")[1]) for r in df.collect()}


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions, 1)), "question_id int, question string")


def plain_bm25(query):
    docs = [t.lower().replace(".", "").split() for t in TEXTS]
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w in {w for d in docs for w in d} for d in [sum(w in x for x in docs)]}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for w in query.split()) for d in docs]


@pytest.mark.parametrize("bound", [0, 10_000])
@pytest.mark.parametrize("query", ["merger acquisition", "the the in", "patents", "the"])
def test_bm25_equals_the_formula(spark, tokens, query, bound, monkeypatch):
    monkeypatch.setattr(lexical, "SENT_TERMS", bound)
    want = {i: round(s, 6) for i, s in enumerate(plain_bm25(query)) if s > 0}
    got = {int(r.chunk_id.split("_")[1]): round(r.score, 6) for r in lexical.bm25_search(tokens, ask(spark, query)).collect()}
    assert got == want


def test_unknown_and_empty_queries_find_nothing(spark, tokens):
    assert lexical.bm25_search(tokens, ask(spark, "zzz", "", "!!")).count() == 0
    assert lexical.bm25_search(tokens, ask(spark, "the"), stopwords=["the"]).count() == 0


def test_ties_come_in_corpus_order(spark):
    rows = spark.createDataFrame([(f"c{9 - i}", i, "same text") for i in range(5)] + [("z", 9, "other words"), ("y", 10, "more of it"), ("x", 11, "and more")] + [(f"o{i}", 20 + i, "filler") for i in range(9)], "id string, corpus_ord long, text string")
    found = lexical.bm25_search(lexical.token_table(rows), ask(spark, "same"), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == ["c9", "c8", "c7"]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("merger AND acquisition", {0, 1}),
        ("acquisition NOT california", {0}),
        ("patents or arbitration", {2, 3}),
        ("merger and patents OR boston", {0}),
        ("NOT the", {1, 2}),
        ("acquisition NOT boston NOT california", {1}),
        ("", {0, 1, 2, 3, 4}),
    ],
)
def test_boolean(tokens, query, want):
    assert ids(lexical.boolean_search(tokens, query)) == want


def test_proximity(tokens):
    assert ids(lexical.proximity_search(tokens, "merger", "acquisition", 5)) == {0}
    assert ids(lexical.proximity_search(tokens, "merger", "acquisition", 3)) == {0}
    assert ids(lexical.proximity_search(tokens, "merger", "acquisition", 2)) == set()
    assert ids(lexical.proximity_search(tokens, "merger", "merger", 0)) == {0, 1}
    assert ids(lexical.proximity_search(tokens, "merger now", "closed soon", 5)) == {0}
    assert ids(lexical.proximity_search(tokens, "!!", "merger")) == set()


def test_postings(tokens):
    row = lexical.postings(tokens).where("term = 'the' and corpus_ord = 0").first()
    assert row.tf == 2 and row.positions == [0, 3]


def test_vector_search_breaks_ties_and_clamps(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(5)] + [(9, None)], "vec_id long, embedding array<double>")
    found = vector.vector_search(rows, spark.createDataFrame([(1, [1.0, 1.0])], "question_id int, query_vec array<double>"), 30)
    assert [(r.vec_id, r.score) for r in found.orderBy("rank").collect()] == [(1, 2.0), (3, 2.0), (0, 1.0), (2, 1.0), (4, 1.0)]
    none = vector.vector_search(rows, spark.createDataFrame([], "question_id int, query_vec array<double>"))
    assert none.count() == 0


def test_embeddings_have_length_one(spark):
    rows = spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", None)], "id string, text string")
    for r in vector.embed_texts(rows, dim=16).collect():
        assert abs(sum(x * x for x in r.vec) - (r.chunk_id == "a")) < 1e-6


def ranked(spark, *rows):
    return spark.createDataFrame(list(rows), "question_id int, chunk_id string, rank int")


def test_rrf_ties_and_one_sided_hits(spark):
    found = fusion.rrf_fuse(ranked(spark, (1, "a", 1), (1, "b", 2)), ranked(spark, (1, "c", 1), (1, "b", 3))).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == ["b", "a", "c"]
    assert found[0].score == pytest.approx(1 / 62 + 1 / 63)


def test_hybrid_cuts_before_it_fetches(spark):
    chunks = spark.createDataFrame([("b", "text b")], "id string, text string")
    found = fusion.hybrid_retrieve(ranked(spark, (1, "a", 1), (1, "b", 2)), ranked(spark, (1, "a", 1)), chunks, top=1)
    assert found.count() == 0


def test_rerank_is_stable_and_optional(spark):
    hits = spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 2, "red fox"), (1, "c", 3, "fox")], "question_id int, chunk_id string, rank int, text string")
    asked = ask(spark, "red fox")
    assert [r.chunk_id for r in fusion.rerank(hits, asked).orderBy("rank").collect()] == ["b", "c", "a"]
    assert [r.chunk_id for r in fusion.rerank(hits, asked, 2, None).orderBy("rank").collect()] == ["a", "b"]


def test_tasks_keep_their_best_chunks_alone(spark, monkeypatch):
    from lexigrid.operators import termwork

    monkeypatch.setattr(termwork, "STEP", 8)
    rows = spark.createDataFrame([(f"c{i % 50:02}", None if i == 3 else i // 4, ["same words", "rent same", "rent rent due", ""][i % 4]) for i in range(200)], "id string, corpus_ord long, text string").repartition(3)
    tokens, questions = lexical.token_table(rows), ask(spark, "rent", "same rent rent", "", "due")
    found = lexical.bm25_search(tokens, questions, 7, digits=6)
    want = lexical.ranked(lexical.bm25_scores(tokens, questions), 7, 6)
    columns = ("question_id", "rank", "chunk_id", "corpus_ord", "score")
    assert sorted(map(str, found.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    # Nothing but a task's best is sent on: no sum over questions and chunks.
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
