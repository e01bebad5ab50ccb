from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from jobs import evidence_sheets, index_refresh
from jobs.config import read_config
from lexigrid.operators import lexical
from lexigrid.streaming import incremental

TEXTS = [f"clause {i} of the lease on rent and notice {'deposit ' * (i % 3)}ends here" for i in range(40)] + ["", None, "  \n", "Rent is due monthly under 12 U.S.C. § 34 and § 5."]


def add(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, extra int").coalesce(1).write.mode("append").parquet(folder)


def dump(spark, config):
    return {name: sorted(map(str, incremental.table(spark, config.out, name).collect())) for name in incremental.TABLES}


def asked(spark):
    return spark.createDataFrame([(1, "rent deposit"), (2, "clause 7 notice"), (3, "monthly"), (4, "zzz")], "question_id int, question string")


def whole(spark, rows, config):
    """One search over everything at once, as a single build would give it."""
    pages = spark.createDataFrame([(str(i), 1, t, i) for i, t in rows], "doc_name string, page_number int, text string, corpus_ord long")
    from lexigrid.operators import chunking

    chunks = chunking.page_chunks(pages) if config.strategy == "page" else chunking.stride_chunks(pages)
    return lexical.bm25_search(lexical.token_table(chunks, config.stopwords), asked(spark), config.top, config.stopwords, digits=6)


def hits(df):
    return sorted((r.question_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("strategy,stopwords,per_batch", [("page", (), 1000), ("stride", ("the", "of"), 1)])
def test_refresh_over_growing_input(spark, tmp_path, strategy, stopwords, per_batch):
    source = f"{tmp_path}/in"
    config = index_refresh.Config(source, f"{tmp_path}/out", strategy=strategy, stopwords=stopwords, files_per_batch=per_batch)
    rows = list(enumerate(TEXTS))
    add(spark, source, [(i, t, 0) for i, t in rows[:15]])
    first = index_refresh.refresh(spark, config)
    assert sum(r["documents"] for r in first) == 15
    before = dump(spark, config)
    assert index_refresh.refresh(spark, config) == [] and dump(spark, config) == before
    # More files; one repeats documents, some of them with other texts, and has rows without an id.
    add(spark, source, [(i, t, 1) for i, t in rows[15:30]])
    add(spark, source, [(3, "another text of three", 2), (4, TEXTS[4], 2), (None, "no id", 2), (None, None, 2)])
    again = index_refresh.refresh(spark, config)
    assert sum(r["documents"] for r in again) == 15 and {r["batch"] for r in again}.isdisjoint(r["batch"] for r in first)
    add(spark, source, [(i, t, 3) for i, t in rows[30:]] + [(35, TEXTS[35], 3)])
    index_refresh.refresh(spark, config)
    grown = dump(spark, config)
    assert all(set(before[name]) <= set(grown[name]) for name in grown)
    assert hits(index_refresh.search(spark, config, asked(spark))) == hits(whole(spark, rows, config))
    assert incremental.table(spark, config.out, "documents").count() == len(rows)


def test_a_broken_batch_is_taken_again(spark, tmp_path, monkeypatch):
    source = f"{tmp_path}/in"
    config = index_refresh.Config(source, f"{tmp_path}/out", f"{tmp_path}/mark")
    rows = list(enumerate(TEXTS))
    add(spark, source, [(i, t, 0) for i, t in rows[:20]])
    index_refresh.refresh(spark, config)
    add(spark, source, [(i, t, 0) for i, t in rows[20:]])
    real = lexical.row_postings
    monkeypatch.setattr(incremental.lexical, "row_postings", lambda tokens: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        index_refresh.refresh(spark, config)
    monkeypatch.setattr(incremental.lexical, "row_postings", real)
    assert [r["documents"] for r in index_refresh.refresh(spark, config)] == [len(rows) - 20]
    assert hits(index_refresh.search(spark, config, asked(spark))) == hits(whole(spark, rows, config))


def test_an_empty_source_is_no_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    config = index_refresh.Config(f"{tmp_path}/in", f"{tmp_path}/out")
    assert index_refresh.refresh(spark, config) == []
    add(spark, config.source, [])
    index_refresh.refresh(spark, config)
    add(spark, config.source, [(1, "rent is due", 0)])
    index_refresh.refresh(spark, config)
    assert [r.term for r in index_refresh.output(spark, config.out).orderBy("term").collect()] == ["due", "is", "rent"]


def test_search_reads_asked_terms_alone(spark, tmp_path):
    config = index_refresh.Config(f"{tmp_path}/in", f"{tmp_path}/out")
    add(spark, config.source, [(i, t, 0) for i, t in enumerate(TEXTS)])
    index_refresh.refresh(spark, config)
    plan = index_refresh.search(spark, config, asked(spark))._jdf.queryExecution().optimizedPlan().toString()
    postings = next(x for x in plan.split("\n") if "Filter" in x and "deposit" in x)
    assert "term" in postings and "text#" not in plan


def test_sheets_are_written_again_alike(spark, tmp_path):
    docs = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}") for i, t in enumerate(TEXTS)] + [(None, "rent without an id", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(7, "rent due monthly"), (8, "clause 9 of the lease"), (9, None), (None, "no id"), (10, "zzz"), (11, "")], "item_id long, text string").write.parquet(f"{tmp_path}/asked")
    config = evidence_sheets.Config(f"{tmp_path}/docs", f"{tmp_path}/asked", f"{tmp_path}/out", "a", top=5)
    report = evidence_sheets.write_sheet(spark, config)
    assert report == {"sheet": "a", "questions": 4, "read": len(docs), "rows": 10, "answered": 2, "documents": report["documents"]}
    rows = sorted(map(str, evidence_sheets.output(spark, config.out).collect()))
    evidence_sheets.write_sheet(spark, evidence_sheets.Config(config.source, config.questions, config.out, "b", top=1))
    assert evidence_sheets.write_sheet(spark, config) == report
    both = evidence_sheets.output(spark, config.out)
    assert sorted(map(str, both.where("sheet = 'a'").collect())) == rows and both.where("sheet = 'b'").count() == 2
    top = both.where("sheet = 'a' and question_id = 7").orderBy("rank").first()
    assert (top.doc, top.rerank_score, top.citations) == ("43", 1.0, ["12 U.S.C. § 34", "§ 34", "§ 5"])
    assert {p.name for p in (tmp_path / "out" / "sheet=a").iterdir() if p.is_dir()} <= {"lang=en", "lang=de", "lang=__HIVE_DEFAULT_PARTITION__"}


def test_config_is_read_and_overridden(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"source": "/a/", "out": "/b", "stopwords": ["the"], "top": 3}))
    got = read_config(spark, index_refresh.Config, str(path), ["top=4", "source=/c/d/"])
    assert got == index_refresh.Config("/c/d", "/b", stopwords=("the",), top=4)
    with pytest.raises(ValueError, match="unknown"):
        read_config(spark, index_refresh.Config, str(path), ["topp=4"])
    path.write_text("{}")
    with pytest.raises(ValueError, match="missing"):
        read_config(spark, index_refresh.Config, str(path))


def test_command_line(spark, tmp_path):
    """The shipped configs name known settings only."""
    import jobs

    folder = jobs.__path__[0]
    for name, kind in (("index_refresh", index_refresh.Config), ("evidence_sheets", evidence_sheets.Config)):
        assert read_config(spark, kind, f"file://{folder}/{name}.json")


def test_jobs_know_nothing_of_llm():
    import pathlib

    import jobs

    for path in [*pathlib.Path(jobs.__path__[0]).glob("*.py"), pathlib.Path(incremental.__file__)]:
        assert "llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()


def test_postings_are_made_without_a_shuffle(spark):
    rows = spark.createDataFrame([("a", 0, "b a b c a b"), ("b", 1, ""), ("c", 2, "x"), ("d", 3, None)], "id string, corpus_ord long, text string")
    made = lexical.row_postings(lexical.token_table(rows))
    assert sorted((r.term, r.chunk_id, r.dl, r.tf, r.positions) for r in made.collect()) == [("a", "a", 6, 2, [1, 4]), ("b", "a", 6, 3, [0, 2, 5]), ("c", "a", 6, 1, [3]), ("x", "c", 1, 1, [0])]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.where(F.col("term") == "zz").count() == 0
