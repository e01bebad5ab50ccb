"""The built index: searches of its tables, the embedding cache, events, hooks and SQL functions."""

from __future__ import annotations

import base64
import random
import re

import pytest
from pyspark.sql import functions as F

from lexigrid.config import EngineConfig
from lexigrid.operators import chunking, clauses, graph, lexical, reports, vector
from lexigrid.plans.engine import Engine
from lexigrid.session import register_functions
from lexigrid.sources import store

TEXTS = ["the merger closed in may", "rent is due monthly and the rent is fixed", "merger terms: rent due", "", "acquisition of a company", "the the the"]


@pytest.fixture()
def tokens(spark):
    rows = [(f"c{i}", i, t) for i, t in enumerate(TEXTS)]
    return lexical.token_table(spark.createDataFrame(rows, "id string, corpus_ord long, text string"))


@pytest.fixture()
def questions(spark):
    return spark.createDataFrame([(1, "rent rent the merger"), (2, "unknown words"), (3, "")], "question_id int, question string")


@pytest.mark.parametrize("sent", [10_000, 0])
def test_a_persisted_index_gives_the_same_hits(spark, tokens, questions, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(lexical, "SENT_TERMS", sent)
    store.save_tables(str(tmp_path / "i"), "lexical", lexical.index_tables(tokens))
    index = store.load_tables(spark, str(tmp_path / "i"), "lexical")
    got = {tuple(r) for r in lexical.indexed_search(index, questions, digits=6).collect()}
    assert got == {tuple(r) for r in lexical.bm25_search(tokens, questions, digits=6).collect()} and got


def test_a_search_reads_the_asked_terms_alone(spark, tokens, questions, tmp_path):
    store.save_tables(str(tmp_path / "i"), "lexical", lexical.index_tables(tokens))
    index = store.load_tables(spark, str(tmp_path / "i"), "lexical")
    plan = lexical.indexed_search(index, questions)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len([s for s in scans if "In(term, [merger,rent,the,unknown,words])" in s]) == 2
    assert not any("tokens" in s or "positions" in s for s in scans)
    assert plan.count("HashAggregate") <= 2  # the sum of scores, in two steps


def test_build_embeds_only_what_is_new(spark, tmp_path):
    folder, seen = tmp_path / "docs", spark.sparkContext.accumulator(0)
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text(f"text number {i}")

    def make():
        def call(texts):
            seen.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return call

    engine = Engine(spark, str(tmp_path / "index"), embedder=vector.batched_embedder(make, size=2, workers=2), model="lengths")
    engine.build(str(folder))
    assert seen.value == 3
    (folder / "1.txt").write_text("another text for number 1")
    (folder / "3.txt").write_text("a new one")
    engine.build(str(folder), force=True)
    assert seen.value == 5
    held = {r.chunk_id: r.vec for r in engine._dense().collect()}
    assert held == {"0.txt_p1_page_0": [13.0, 1.0], "1.txt_p1_page_0": [25.0, 1.0], "2.txt_p1_page_0": [13.0, 1.0], "3.txt_p1_page_0": [9.0, 1.0]}
    with pytest.raises(ValueError):
        Engine(spark, "x", embedder=lambda c: c)


def test_embedders_are_chosen_in_order():
    every = {"openai": 1, "gemini": 2, "local": 3}
    assert vector.select_embedder(every) == ("gemini", 2) and vector.select_embedder(every, True) == ("openai", 1)
    assert vector.select_embedder({"local": 3}, True) == ("local", 3) and vector.select_embedder({}) == ("hashed", None)


def test_engine_with_cells_blocks_and_adapters(spark, tmp_path):
    """The same answers, from the other structures; and rebuilt three times, old vectors are removed."""
    (tmp_path / "docs").mkdir()
    for i in range(12):
        (tmp_path / "docs" / f"{i}.txt").write_text(f"paragraph {i} on rent and notice {'deposit ' * (i % 4)}")
    asked = spark.createDataFrame([(1, "deposit notice"), (2, "paragraph 7")], "question_id int, question string")

    def hits(engine):
        return sorted((r.question_id, r["rank"], r.chunk_id, r.score) for r in engine.retrieve(asked).collect())

    plain = Engine(spark, str(tmp_path / "a"))
    plain.build(str(tmp_path / "docs"))
    adapters = {"local": lambda texts: vector._hashed(384)(vector.tokenize(texts))}
    other = Engine(spark, str(tmp_path / "b"), EngineConfig(VECTOR_CELLS=-1, BLOCK_SEARCH=1), adapters=adapters)
    assert other.model == "local"
    for _ in range(3):
        other.build(str(tmp_path / "docs"), force=True)
    assert hits(other) == hits(plain)
    assert {p.name for p in (tmp_path / "b" / "dense").iterdir() if p.name.startswith("v") and p.name[1:].isdigit()} == {"v1", "v2"}
    assert {"blocks", "postings", "directory"} <= {p.name for p in (tmp_path / "b" / "lexical").iterdir()} and (tmp_path / "b" / "dense" / "v2" / "cells").exists()


def test_engine_reads_pdfs_by_a_given_extractor(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.pdf").write_bytes(b"%PDF-1.4")
    pages = [("page of a scan", []), ("", ["x\ty"]), ("", [[["", None], []]]), ("of cells", [[["a", None, "b"], [None, ""], ["", 3]], [[]], "as text"])]
    engine = Engine(spark, str(tmp_path / "index"), extractors={"pdf": lambda content: pages})
    engine.build(str(tmp_path / "docs"), fast=True)
    rows = engine._parts("pages")["pages"].orderBy("page_number").collect()
    assert [(r.page_number, r.text, r.tables) for r in rows] == [(1, "page of a scan", []), (2, "", ["x\ty"]), (4, "of cells", ["a\tb\n3", "as text"])]
    assert [r.chunk_id for r in engine.boolean("scan").collect()] == ["a.pdf_p1_page_0"]


def test_builds_tell_their_progress_and_exclude_each_other(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("some text")
    engine = Engine(spark, str(tmp_path / "index"))
    lines = list(engine.build_events(str(tmp_path / "docs"), fast=True, ping=1e-3))
    assert lines[-1] == "__DONE__" and "ingestion ..." in lines and "__PING__" in lines
    engine.building.acquire()
    with pytest.raises(RuntimeError, match="already running"):
        engine.build(str(tmp_path / "docs"), force=True)
    with pytest.raises(RuntimeError, match="already running"):
        next(engine.build_events(str(tmp_path / "docs")))
    engine.building.release()
    assert list(engine.build_events(str(tmp_path / "none"), force=True))[-1] == "__ERROR__"
    assert not engine.building.locked()


def test_later_attributes_win(spark):
    schema = "id string, kind string, name string, doc string, number int, text string, entity_type string, seq int"
    nodes = spark.createDataFrame([("a", "doc", "z", None, None, "old", None, 1), ("a", "doc", "b", None, None, None, None, 2), ("a", "doc", "c", None, 4, None, None, 0)], schema)
    merged = graph.merge_nodes(nodes).first()
    assert (merged["name"], merged["text"], merged["number"]) == ("b", "old", 4)


def test_reports(spark):
    rows = spark.createDataFrame([(True,), (None,), (False,), (True,)], "ok boolean")
    assert tuple(reports.success_count(rows, F.col("ok")).first()) == (2, 4)
    pages = spark.range(500).select((499 - F.col("id")).alias("corpus_ord")).repartition(7)
    assert [r.corpus_ord for r in reports.first_pages(pages).collect()] == list(range(200))


def test_sql_functions(spark):
    from lexigrid.functions import text as X

    register_functions(spark)
    rows = [(t,) for t in ("A  b\tc\r\n\r\n\r\n\r\nd  ", " élan & Co. 12", "", None)]
    frame = spark.createDataFrame(rows, "t string")
    frame.createOrReplaceTempView("texts_of_sql_functions")
    by_sql = spark.sql("SELECT lexigrid_tokenize(t), lexigrid_clean_text(t) FROM texts_of_sql_functions").collect()
    assert [tuple(r) for r in by_sql] == [tuple(r) for r in frame.select(X.tokenize(F.col("t")), X.clean_text(F.col("t"))).collect()]


def test_bpe_windows(spark, tmp_path):
    """Tokens of a small rank file: all bytes, and some merges; windows of at most 600, by the same steps one at a time."""
    merges = [b"th", b"the", b" t", b" th", b" the", b"in", b"ing", b"\xc3\xa9"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(b"%s %d" % (base64.b64encode(t), i) for i, t in enumerate([bytes([b]) for b in range(256)] + merges)))
    encoder = chunking.BpeEncoder(str(path), r" ?\w+| ?[^\w\s]+|\s+")
    for text in ("the thing, élan 日本 the end", "x", "", "the " * 900):
        spans = encoder.spans(text)
        assert "".join(text[a:b] for a, b in spans) == text
    text = "the thing " * 500
    pages = spark.createDataFrame([("d", 1, 0, text)], "doc_name string, page_number int, corpus_ord long, text string")
    got = [(r.start_offset, r.text) for r in chunking.token_chunks(pages, make_encoder=lambda: chunking.BpeEncoder(str(path), r" ?\w+| ?[^\w\s]+|\s+")).orderBy("start_offset", "end_offset").collect()]
    words, start, want = encoder.spans(text.strip()), 0, []
    while True:
        piece = text[words[start][0] : words[min(start + 600, len(words)) - 1][1]].strip()
        want.append((text.find(piece[:40]), piece))
        if start + 600 >= len(words):
            break
        start += 540
    assert sorted(got) == sorted(want) and len(want) > 2


def brute_clauses(text):
    """Headings found by starting at every line, one pattern after the other."""
    found = []
    for n, heading in enumerate(clauses.HEADINGS):
        at, heading = 0, re.compile(heading, re.MULTILINE | (re.IGNORECASE if n == 2 else 0))
        while at <= len(text):
            m = heading.search(text, at)
            if m is None:
                break
            found.append((m.start(), n, m[0].strip()))
            at = m.end() if m.end() > m.start() else m.end() + 1
    found.sort(key=lambda f: f[:2])
    stops = [f[0] for f in found[1:]] + [len(text)]
    return [(h, a, b, text[a:b][:500].strip()) for (a, _, h), b in zip(found, stops, strict=False)]


def test_clauses_of_texts_with_headings(spark):
    body = "\n".join(f"words of line {i} go on" for i in range(40))
    rows = [(i, f"LEASE TERMS\n{body}\n{i}.2 Payment Terms\nshort\nSection {i}: Notice Periods\n{body * i}\nEND") for i in range(6)]
    r = random.Random(1)
    rows += [(i, "".join(r.choice(["A", "B ", "C", "\n", "\n\n", "\r\n", "\u00a0", "\u2028", "1", "2.3", ".", ":", "—", "x", "yz ", "Section 4", "section 5: ", " ", "É", "😀", "٣"]) for _ in range(r.randrange(60)))) for i in range(6, 400)]
    got = clauses.extract_clauses(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()
    want = [(str(i), *c) for i, t in rows for c in brute_clauses(t)]
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) >= 18
