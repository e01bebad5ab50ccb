from __future__ import annotations

import io
import json
import zipfile

import pytest

from lexigrid.config import EngineConfig
from lexigrid.plans.engine import Engine
from lexigrid.sources import files, questions, sinks, store
from lexigrid.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def docx(n):
    body = "".join(f"<w:p><w:r><w:t>para {i}</w:t></w:r></w:p><w:p/>" for i in range(n))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>Question</t></si><si><t>why?</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {S}><sheetData><row><c r="A1"><v>7</v></c><c r="B1" t="s"><v>0</v></c></row><row><c r="B2" t="s"><v>1</v></c></row><row><c r="A3"><v>2</v></c></row></sheetData></worksheet>')
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("docs")
    (top / "lease.html").write_text("<html><head><style>x</style></head><body><nav>menu</nav><h1>Lease</h1><p>RENT: due &amp; payable monthly.</p><script>'</p>'</script><footer>f</footer></body></html>")
    (top / "note.txt").write_bytes(b"The merger closed.\r\n\r\n\r\n\r\nBad \xff byte. See 15 U.S.C. \xc2\xa7 12.")
    (top / "data.csv").write_text("col1,col2\n1,two\n30,x\n")
    (top / "long.docx").write_bytes(docx(65))
    (top / "broken.docx").write_bytes(b"PK\x03\x04 not a zip")
    (top / "scan.pdf").write_bytes(b"%PDF-1.4")
    (top / "skip.bin").write_bytes(b"x")
    (top / "empty.txt").write_text("  \n ")
    (top / "sub").mkdir()
    (top / "sub" / "deep.txt").write_text("not found")
    return str(top)


def test_large_files_are_quarantined_unread(spark, folder):
    config = EngineConfig(MAX_FILE_BYTES=100)
    pages, bad = files.ingest(spark, folder, config)
    names = {r.doc_name for r in pages.collect()}
    assert {"note.txt", "data.csv"} <= names and "lease.html" not in names
    assert {r.doc_name: r.error for r in bad.where("error like 'larger%'").collect()} == {n: "larger than 100 bytes" for n in ("lease.html", "long.docx")}
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan


def test_ingest_isolates_bad_files(spark, folder):
    pages, bad = files.ingest(spark, folder)
    got = {(r.doc_name, r.page_number): r for r in pages.collect()}
    assert set(got) == {("data.csv", 1), ("lease.html", 1), ("long.docx", 1), ("long.docx", 2), ("long.docx", 3), ("note.txt", 1)}
    assert got["lease.html", 1].text == "Lease\nRENT: due & payable monthly."
    assert got["note.txt", 1].text.startswith("The merger closed.\n\nBad � byte.")
    assert got["data.csv", 1].tables == [got["data.csv", 1].text] and "30" in got["data.csv", 1].text
    assert got["long.docx", 3].text.split("\n") == [f"para {i}" for i in range(60, 65)] and got["long.docx", 3].offset == 2
    order = [r.doc_name for r in pages.orderBy("corpus_ord").collect()]
    assert order == sorted(order)
    assert {r.doc_name for r in bad.collect()} == {"broken.docx", "scan.pdf"}


def test_extractors_can_be_given(spark, folder):
    pages, _ = files.ingest(spark, folder, extractors={"pdf": lambda content: [("page one", []), ("", []), ("page three", ["t"])]})
    assert [(r.page_number, r.offset) for r in pages.where("doc_name = 'scan.pdf'").orderBy("page_number").collect()] == [(1, 0), (3, 2)]


def test_list_documents(spark, folder):
    found = files.list_documents(spark, folder).collect()
    assert [r.name for r in found] == ["broken.docx", "data.csv", "empty.txt", "lease.html", "long.docx", "note.txt", "scan.pdf"]
    assert found[0].type == "docx" and found[0].size_kb == 0.0


def test_questions(spark, tmp_path):
    (tmp_path / "q.xlsx").write_bytes(xlsx())
    (tmp_path / "q.csv").write_text("Question,x\nfirst?,1\n,2\nsecond?,3\n")
    assert [r.question for r in questions.read_questions(spark, [str(tmp_path / "none.xlsx"), str(tmp_path / "q.xlsx")]).collect()] == ["why?"]
    assert [(r.question_id, r.question) for r in questions.read_questions(spark, [str(tmp_path / "q.csv")]).collect()] == [(1, "first?"), (2, "second?")]
    assert questions.read_questions(spark).count() == 15


def test_engine_end_to_end(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    assert engine.status() == {"ready": False, "documents": 0, "chunks": 0, "build_seconds": None}
    built = engine.build(folder)
    assert built["ready"] and built["documents"] == 4 and built["chunks"] == 6
    assert engine.build(folder)["build_seconds"] == built["build_seconds"]
    asked = spark.createDataFrame([(1, "when is rent payable"), (2, "merger closed")], "question_id int, question string")
    found = engine.ask(asked).orderBy("question_id").collect()
    assert [r.sources[0].document for r in found] == ["lease.html", "note.txt"] and all(r.answer for r in found)
    assert engine.retrieve(asked, fast=True).where("question_id = 2 and rank = 1").first().doc == "note.txt"
    assert [r.chunk_id for r in engine.boolean("merger AND NOT rent").collect()] == ["note.txt_p1_page_0"]
    assert engine.proximity("merger", "closed", 1).count() == 1
    kinds = [e["type"] for e in engine.answer_events("merger closed")]
    assert kinds[0] == "chunk" and kinds[-3:] == ["answer", "sources", "done"]
    assert [e["type"] for e in engine.answer_events("  ")] == ["error"]
    with pytest.raises(ValueError):
        engine.ask(spark.createDataFrame([(1, " ")], "question_id int, question string"))
    assert engine.report().where("stage = 'bm25_index'").count() == 1
    flat = spark.createDataFrame([(1, "a"), (2, "b")], "question_id int, answer string")
    assert [n[-8:] for n in sinks.write_question_files(flat, str(tmp_path / "out"))] == ["q01.json", "q02.json"]
    sinks.write_array(flat, str(tmp_path / "all.json"))
    assert [r["answer"] for r in json.loads((tmp_path / "all.json").read_text())] == ["a", "b"]
    sinks.write_answers(flat, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2


def test_store_refuses_what_it_does_not_hold(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.load_tables(spark, str(tmp_path / "none"), "lexical")
    store.save_tables(str(tmp_path / "i"), "dense", {"embeddings": spark.range(3)})
    with pytest.raises(ValueError):
        store.load_tables(spark, str(tmp_path / "i"), "lexical")


def test_only_new_or_changed_chunks_are_embedded(spark):
    chunks = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "id string, text string")
    cached = chunks.selectExpr("id as chunk_id", "sha2(if(id = 'b', 'old', text), 256) as text_sha", "if(id = 'c', 'other', 'm') as model")
    assert {r.id for r in store.embedding_misses(chunks, cached, "m").collect()} == {"b", "c"}


def test_stream_ingests_new_files_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("first file")
    ingest.ingest_stream(spark, inbox, out, state).awaitTermination()
    (tmp_path / "in" / "b.txt").write_text("second file")
    ingest.ingest_stream(spark, inbox, out, state).awaitTermination()
    assert [r.doc for r in spark.read.parquet(f"{out}/chunks").orderBy("doc").collect()] == ["a.txt", "b.txt"]


def test_format_table(spark):
    rows = spark.createDataFrame([([["a", None, "b"], ["", ""], ["c"]],)], "t array<array<string>>")
    assert rows.select(files.format_table(rows.t)).first()[0] == "a\tb\nc"
