from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.llm.training import sample


def test_repeated_documents_are_sampled_once(spark):
    rows = [(i, f"text {i} {k}" if k else None) for i in range(40) for k in range(i % 7 + 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    a, b = (sample(d, labels, F.col("quality"), 25).collect() for d in (docs.repartition(3), docs.unionByName(docs).repartition(5)))
    assert len(a) == len({r.doc_id for r in a}) == 25 and sorted(a) == sorted(b)
    assert all((r.doc_id, r.text or None) in rows and r.label == r.doc_id % 2 for r in a)
