from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexigrid.config import EngineConfig
from lexigrid.operators import chunking as K

PAGES = "doc_name string, page_number int, text string, corpus_ord long"


def pages(spark, *texts):
    return spark.createDataFrame([("d.txt", i + 1, t, i) for i, t in enumerate(texts)], PAGES)


@pytest.mark.parametrize(("length", "count"), [(50, 50), (500, 151), (1000, 151), (2410, 153), (20000, 174)])
def test_compat_tail_repeats_the_end(length, count):
    assert len(list(K.sentence_windows("x" * length, tail="compat"))) == count


@pytest.mark.parametrize(("tokens", "count"), [(30, 30), (500, 61), (1000, 62), (5000, 70)])
def test_compat_tail_of_tokens(tokens, count):
    windows = K.windows(tokens, lambda s: min(s + 600, tokens), EngineConfig().token_overlap(), "compat")
    assert len(list(windows)) == count


def test_stop_tail_covers_and_ends(spark):
    text = "Sentence one here. " * 200
    spans = list(K.sentence_windows(text))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False))


def test_sentence_windows_end_at_breaks(spark):
    text = "a" * 900 + ". " + "b" * 400
    assert next(iter(K.sentence_windows(text)))[1] == 902


def plain_sentences(text, size, overlap):
    """Break by break: white space behind a sentence's end, in the last fifth of a window."""
    start, out = 0, []
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            at, found = end - size // 5, None
            while at < end:
                if text[at].isspace() and at > start and text[at - 1] in ".!?\n":
                    found = at
                    while at < end and text[at].isspace():
                        at += 1
                else:
                    at += 1
            end = end if found is None else found + 1
        out.append((start, end))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


@given(st.text("ab.!? \n", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_sentence_windows_equal_a_plain_version(text, size, overlap):
    assert list(K.sentence_windows(text, size, overlap)) == plain_sentences(text, size, overlap)


@given(st.text("ab \n\té", max_size=300), st.integers(2, 9), st.integers(1, 1))
def test_token_windows_equal_a_plain_version(text, longest, overlap):
    words, want, start = text.split(), [], 0
    while start < len(words):
        want.append(words[start : start + longest])
        if start + longest >= len(words):
            break
        start += longest - overlap
    assert [piece.split() for *_, piece in K._tokens(K.WordEncoder, longest, overlap, "stop")(text)] == want


def test_page_and_stride_chunks(spark):
    rows = pages(spark, "  hello world ", "   ", "x" * 2410)
    found = K.page_chunks(rows).orderBy("corpus_ord").collect()
    assert [(r.id, r.text[:5], r.token_count) for r in found] == [("d.txt_p1_page_0", "hello", 2), ("d.txt_p3_page_0", "xxxxx", 1)]
    strides = K.stride_chunks(rows.where("page_number = 3")).orderBy("start_offset").collect()
    assert [(r.start_offset, r.end_offset) for r in strides] == [(0, 1000), (850, 1850), (1700, 2410)]


def test_token_chunks_and_first_of_equal_ids(spark):
    rows = pages(spark, " ".join(f"w{i}" for i in range(1000)))
    found = K.chunk_all(rows.unionByName(rows.selectExpr("doc_name", "page_number", "'other' as text", "9L as corpus_ord"))).orderBy("start_offset").collect()
    assert [r.id for r in found] == ["d.txt_p1_token_0", "d.txt_p1_token_1"]
    assert found[0].token_count == 600 and found[1].text.startswith("w540 ") and found[1].corpus_ord == 0


def test_pages_without_text_are_not_repeated(spark, tmp_path):
    from lexigrid.plans import catalog

    texts = ["one two", "", " \n\t ", "\r\f", None, " three ", "\u00a0\u2003"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.QUERIES["chunk_dedupe"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [("0_p1_page_0", 0, 7, 2), ("5_p1_page_0", 5, 5, 1)]


def test_empty_table(spark):
    assert K.chunk_all(spark.createDataFrame([], PAGES), "sentence").count() == 0
