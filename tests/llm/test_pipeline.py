from __future__ import annotations

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexigrid.llm import quality_classifier
from tests.llm.test_dedup import brute_fingerprint, brute_groups, brute_lines, brute_substrings


def packed_ids(pieces):
    """Ids of each document; places depend on partitions, so only what is defined is held."""
    found: dict = {}
    for r in sorted(pieces, key=lambda r: r.start):
        assert r.start == len(found.setdefault(r.doc_id, []))
        found[r.doc_id].extend(np.frombuffer(r.ids, "<u4").tolist())
        assert len(r.ids) == 4 * r.length
    assert all(r.doc_tokens == len(found[r.doc_id]) for r in pieces)
    room: dict = {}
    for r in sorted(pieces, key=lambda r: r.offset):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r.length
    assert all(n == 2048 or n & (n - 1) == 0 or 2048 - n <= 8 for n in room.values())
    return found


def test_stages_equal_a_plain_version(spark, tmp_path, docs, plain):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 70, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, made = str(tmp_path), {}
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf).write.parquet(f"{sf}/out/{name}")
        now = spark.read.parquet(f"{sf}/out/{name}")
        made[name] = now.collect()
        if name != "packing":
            assert now.columns == docs.columns
            assert all(r.n_chars == len(r.text or "") for r in made[name])
    rows = {r[0]: r[1] for r in plain}
    good = {r.doc_id: r.text for r in made["quality classifier"]}
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), where=~quality_classifier.held_out(F.col("doc_id")))
    kept = {r.doc_id for r in quality_classifier.score(docs, model).collect() if r.predicted}
    assert good == {k: v for k, v in rows.items() if k in kept}
    lines = {k[0]: v[2] for k, v in brute_lines([(i, t) for i, t in sorted(good.items())]).items()}
    assert {r.doc_id: r.text or "" for r in made["line dedup"]} == lines
    prints = {r.doc_id: brute_fingerprint(r.text) for r in made["line dedup"]}
    left = {i for i, c in brute_groups(prints).items() if i == c}
    assert {r.doc_id for r in made["SimHash near-dedup"]} == left
    before = [(r.doc_id, r.text) for r in made["SimHash near-dedup"]]
    words = {k[0]: v[3] for k, v in brute_substrings(before).items()}
    assert {r.doc_id: b" ".join((r.text or "").encode().split()) for r in made["substring dedup"]} == words
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in made["substring dedup"]}
    ids = {i: [*e.ids, 1] for i, e in zip(texts, tokenizer.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    assert packed_ids(made["packing"]) == ids
    whole = corpus_pipeline.run(spark, sf).collect()
    assert packed_ids(whole) == ids


def test_odd_rows_and_empty_tables(spark, tmp_path, odd, none):
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, docs in (("odd", odd), ("none", none)):
        for stage, run in corpus_pipeline.STAGES[:-1]:
            out = run(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, (name, stage)
            out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0
