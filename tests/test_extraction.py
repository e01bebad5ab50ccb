from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import citations as C
from lexigrid.operators import clauses, graph, reports
from lexigrid.sources import files

TEXT = "See Smith v. Jones, 12 F.2d 34; 15 U.S.C. § 1234 and Rule 12(b), § 3(c), then § 3(c) again."


def row(spark, make):
    return spark.createDataFrame([(TEXT,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_citations_are_a_sorted_set(spark):
    assert row(spark, C.distinct_citations) == ["15 U.S.C. § 1234", "Rule 12", "See Smith v. Jones, 12 F.2d 34", "§ 1234", "§ 3(c)"]


def test_raw_citations_keep_repeats(spark):
    assert row(spark, C.raw_citations) == ["15 U.S.C. § 1234", "§ 1234", "§ 3(c)", "§ 3(c)"]


def clauses_of(spark, text):
    rows = spark.createDataFrame([("d", text)], "doc_name string, text string")
    return [(r.heading, r.start, r.end, r.snippet) for r in clauses.extract_clauses(rows).collect()]


def test_clauses_run_to_the_next_heading(spark):
    text = "intro\nTERMS OF USE\nbody one\n12.3 Payment Terms\nbody two\nSection 4: Background\nend"
    assert [(h, s) for h, *_, s in clauses_of(spark, text)] == [
        ("TERMS OF USE", "TERMS OF USE\nbody one"),
        ("12.3 Payment Terms\nbody two", "12.3 Payment Terms\nbody two"),
        ("Section 4: Background\nend", "Section 4: Background\nend"),
    ]
    assert clauses_of(spark, "no heading") == [] and clauses_of(spark, "") == [] and clauses_of(spark, None) == []


def test_two_headings_at_one_place_leave_an_empty_snippet(spark):
    found = clauses_of(spark, "SECTION 4: AB\nx")
    assert [s for *_, s in found] == ["", "SECTION 4: AB\nx"]


def test_what_was_said_last_of_a_cited_entity_stays(spark):
    pages = spark.createDataFrame([("a", 1, "see § 3(a)", 5), ("b", 1, "see § 3(A) and § 4", 7), ("a", 2, "then § 3(B), § 3(b)", 6), ("b", 2, None, 9)], "doc_name string, page_number int, text string, corpus_ord long")
    nodes, edges = graph.citation_graph(pages, number="page_number", order="corpus_ord")
    merged = {r.id: (r.kind, r.text) for r in graph.merge_nodes(nodes).collect()}
    assert merged == {"doc:a": ("doc", None), "doc:b": ("doc", None), "entity:§ 3(a)": ("entity", "§ 3(A)"), "entity:§ 4": ("entity", "§ 4"), "entity:§ 3(b)": ("entity", "§ 3(b)")}
    plain, same = graph.citation_graph(pages, number="page_number")
    assert "seq" not in plain.columns and sorted(map(str, same.collect())) == sorted(map(str, edges.collect()))


def test_graph_questions(spark):
    docs = spark.createDataFrame([("a", "Acme"), ("b", "ACME"), ("c", "Other")], "doc string, party string")
    nodes, edges = graph.add_parties(docs)
    pages, has = graph.add_pages(spark.createDataFrame([("a", 2)], "doc string, number int"))
    cites = graph.add_document_citations(spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "b")], "doc string, cited string"))
    on = graph.add_references(spark.createDataFrame([("a", "Acme", 2), ("z", "Acme", 5)], "doc string, entity string, n int"), number=F.col("n"))
    all_nodes = graph.add_documents(docs, "doc").unionByName(nodes).unionByName(pages)
    all_edges = graph.merge_edges(edges.unionByName(has).unionByName(cites).unionByName(on))
    assert {r.doc for r in graph.documents_citing(all_edges, "b").collect()} == {"a", "c"}
    assert {r.doc for r in graph.co_parties(all_edges, "acme").collect()} == {"a", "b"}
    assert {(r.doc, r.number) for r in graph.entity_pages(all_edges, all_nodes, "ACME").collect()} == {("a", 2), ("", 0)}
    assert graph.entity_pages(all_edges, all_nodes, "nobody").count() == 0
    assert graph.summary(all_nodes, all_edges).first().asDict() == {"nodes": 7, "edges": 8, "docs": 3}


def test_last_relation_wins(spark):
    edges = spark.createDataFrame([("a", "b", "cites", 1), ("a", "b", "party", 2)], "src string, dst string, relation string, seq long")
    assert graph.merge_edges(edges).first().relation == "party"


def test_citation_graph(spark):
    rows = spark.createDataFrame([("d", 3, TEXT)], "doc_name string, n int, text string")
    nodes, edges = graph.citation_graph(rows)
    found = graph.entity_pages(edges, nodes, "§ 3(c)").collect()
    assert [(r.page_id, r.doc, r.number) for r in found] == [("page:d:0", "", 0)]
    assert graph.citation_graph(rows, number="n")[1].first().dst == "page:d:3"


def test_bottleneck_report(spark):
    rows = spark.createDataFrame([("a", 20.0), ("b", 10.0), ("a", 15.0)], "stage string, seconds double")
    found = reports.bottleneck_report(rows).orderBy("priority").collect()
    assert [(r.stage, r.percent, r.flagged, r.over_limit) for r in found] == [("a", 77.778, True, True), ("b", 22.222, False, True)]
    assert reports.extrapolate(6.0, 3) == 30.0


def test_references_in_web_pages_end_with_a_semicolon():
    assert files.html_text("<h1>that&amp;&amp</h1><p>&copy 1 &ampx; &amp;lt; &#65; &#66 &lt;i&gt; a & b</p>") == "that&&amp\n&copy 1 &ampx; &lt; A &#66 <i> a & b"
    assert files.html_text("<p>﷐ &amp</p><xmp>x &b</xmp>") == "﷐ &amp\nx &b"


def test_headings_are_found_once_a_row(spark):
    rows = spark.createDataFrame([("d", "TERMS OF USE\nbody")], "doc_name string, text string").repartition(2)
    plan = clauses.extract_clauses(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(clauses.HEADINGS) and plan.count("split(") == len(clauses.HEADINGS)
