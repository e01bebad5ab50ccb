from __future__ import annotations

import hashlib
import io
import os
import random
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexigrid.llm import byte_bpe, media_source, mixing_coder, packing, token_files
from lexigrid.llm.tokenizers_io import Ids

RANKS, BYTES, WORDS = (P.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path):
    return Tokenizer.from_file(path)


def reference_bpe():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


TEXTS = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sSéßİ\x1c\x85\xa0́ǅ09.,"))).filter(lambda t: "\x00" not in t)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, max_size=6))
@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_equal_the_library(path, texts):
    made = _encoders.setdefault(path, (Ids(path), library(path)))
    assert [a.tolist() for a in made[0].of(texts)] == [e.ids for e in made[1].encode_batch(texts, add_special_tokens=False)]


_encoders: dict = {}


def test_ids_of_all_low_letters():
    text = " ".join(chr(c) + "a" + chr(c) for c in range(0x21, 0x250))
    for path in (BYTES, WORDS):
        assert Ids(path).of([text])[0].tolist() == library(path).encode(text, add_special_tokens=False).ids


def thue_morse(n):
    """Words of n letters that polynomial hashes modulo powers of two can't tell apart."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_are_told_apart_by_all_their_bytes(path):
    words = [w for n in (8, 15, 16, 17, 64, 1024, 2048) for w in thue_morse(n)]
    words += [w[:-1] + c for w in words for c in "ab"] + ["a" * n for n in range(1, 40)]
    made, want = Ids(path), library(path)
    for texts in ([" ".join(words)], words, words[::-1]):
        assert [a.tolist() for a in made.of(texts)] == [e.ids for e in want.encode_batch(texts, add_special_tokens=False)]


SPECIAL = ["<|endoftext|>", "a<|endoftext|>b c", "x <|startoftext|> y<|endoftext|>", "<|EndOfText|> <|startoftext|", "plain words"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("special", ["tokens", "text"])
def test_special_strings_follow_the_library(path, special):
    want = library(path)
    want.encode_special_tokens = special == "text"
    got = [a.tolist() for a in Ids(path, special).of(SPECIAL)]
    assert got == [e.ids for e in want.encode_batch(SPECIAL, add_special_tokens=False)]
    ends = {BYTES: 50256, WORDS: 49407}[path]
    assert (got[0] == [ends]) == (special == "tokens")


def test_word_table_grows_and_finds():
    """Many words of all sizes, in small batches, against the library."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdeé'1,.") for _ in range(r.randrange(1, 24))) for _ in range(80_000)]
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    made, want = Ids(WORDS), library(WORDS)
    for part in (texts[:7], texts[5:], texts[:20]):
        assert [a.tolist() for a in made.of(part)] == [e.ids for e in want.encode_batch(part, add_special_tokens=False)]
    assert made.words.bits > 16


@pytest.mark.parametrize("joined", [True, False])
def test_new_words_are_encoded_together(joined):
    made, want = Ids(WORDS), library(WORDS)
    made.ends = made.ends if joined else None
    for words in (["don't", "x1y22", "é", "a" * 700, "...", "can't've", "½"], ["one"]):
        ids, counts = made._ids_of_words(words)
        assert [a.tolist() for a in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in want.encode_batch(words, add_special_tokens=False)]


def test_memory_of_words_is_bounded(monkeypatch):
    from lexigrid.llm import tokenizers_io

    monkeypatch.setattr(tokenizers_io, "REMEMBERED", 3)
    texts = ["one two three", "four five six", "one seven", "two eight nine ten", "one two"]
    made, want = Ids(WORDS), library(WORDS)
    for text in texts:
        assert made.of([text])[0].tolist() == want.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [2048, 3000, byte_bpe.CHUNK, 1 << 15])
def test_byte_bpe_equals_tiktoken(docs, plain, chunk):
    want = {r[0]: reference_bpe().encode_ordinary(r[1] or "") for r in plain}
    got = byte_bpe.encode_texts(docs, RANKS, P.PATTERN, chunk=chunk)
    back = byte_bpe.decode_ids(got.withColumn("ids_were", F.col("ids")), RANKS, P.PATTERN).collect()
    assert {r.doc_id: r.ids for r in back} == want
    assert {r.doc_id: bytes(r.decoded) for r in back} == {r[0]: (r[1] or "").encode() for r in plain}


def stitched(codec, text, chunk):
    """Pre-tokens of a text by its chunks; None where a run's end isn't one of its boundaries."""
    starts = byte_bpe.chunk_starts(len(text), chunk)
    chunks = [text[a : a + chunk] for a in starts]
    assert "".join([chunks[0], *[c[byte_bpe.OVERLAP :] for c in chunks[1:]]]) == text
    heads, tails = zip(*[byte_bpe.edges(codec, c, a) for c, a in zip(chunks, starts, strict=True)], strict=True)
    out = []
    for first, last, begin, end in byte_bpe.stitch(list(heads), list(tails), len(text)):
        found = byte_bpe.pieces_between(codec, text[starts[first] : starts[last] + chunk], starts[first], begin, end)
        if found is None:
            return None
        out += found
    return out


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6))
def test_stitching_resynchronises(seed):
    r = random.Random(seed)
    kinds = ["word", " ", "  \n", "12", "!?", "'s", "'re", "'ll", "é" * r.randrange(1, 1500), "\n" * r.randrange(1, 40), "7" * r.randrange(1, 3000)]
    text = "".join(r.choice(kinds) for _ in range(r.randrange(1, 500)))
    codec = _encoders.setdefault("codec", byte_bpe.Codec(RANKS, P.PATTERN))
    assert stitched(codec, text, 2048) == codec.pieces(text)


def test_a_pattern_that_counts_is_noticed():
    """Threes of digits may be cut at other places in each chunk: never a wrong result."""
    codec = byte_bpe.Codec(RANKS, r"\d{1,3}|\D")
    texts = [("x" * k + "1" * n + "y") for k in range(3) for n in (1500, 4000, 4001, 9001)]
    made = [stitched(codec, t, 2050) for t in texts]
    assert all(m is None or m == codec.pieces(t) for m, t in zip(made, texts, strict=True))
    assert any(m is None for m in made) and any(m is not None for m in made)


def test_long_texts_of_a_pattern_that_counts(spark):
    pattern = r"\d{1,3}|\D"
    rows = [(i, "x" * i + "1" * n + "y " * 40) for i, n in enumerate((1500, 4000, 4001, 9001))]
    got = byte_bpe.encode_texts(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, pattern, chunk=2050).collect()
    codec = byte_bpe.Codec(RANKS, pattern)
    assert {r.doc_id: r.ids for r in got} == {i: codec.encode_pieces(codec.pieces(t)) for i, t in rows}


def test_one_long_text_is_the_work_of_many_tasks(spark):
    text = "several words, and 12 numbers. " * 20_000
    keyed = spark.createDataFrame([(0, text)], "_bb_key long, text string")
    tasks = byte_bpe.chunk_rows(keyed, "text").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == len(byte_bpe.chunk_starts(len(text), byte_bpe.CHUNK))
    got = byte_bpe.encode_texts(keyed.withColumnRenamed("_bb_key", "doc_id"), RANKS, P.PATTERN).collect()
    assert got[0].ids == reference_bpe().encode_ordinary(text)
    with pytest.raises(ValueError, match="reserved"):
        byte_bpe.encode_texts(keyed, RANKS, P.PATTERN)


def test_tasks_hold_few_python_processes(spark, tmp_path, docs):
    """Of Python steps in one stage each has a process of its own: two, with two tasks at once, is what an executor's memory allows."""
    from lexigrid.llm import queries as Q

    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    plan = str(Q.op5_byte_bpe(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString())
    above, most = [], 0
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth]
        steps = 0 if "Exchange" in line else (above[-1][1] if above else 0) + ("MapInArrow" in line)
        above.append((depth, steps))
        most = max(most, steps)
    assert 1 <= most <= 2


def test_ids_of_long_texts_are_packed_between_tasks(spark, tmp_path, docs):
    """Lists of numbers in a table take many times their bytes of Spark's Parquet reader; a task of op5 has one Python process."""
    from lexigrid.llm import queries as Q

    got = byte_bpe.encode_texts(docs, RANKS, P.PATTERN, chunk=2048)
    read = [x for x in str(got._jdf.queryExecution().executedPlan().toString()).splitlines() if "ReadSchema" in x]
    assert read and not [x for x in read if "array<" in x.partition("ReadSchema")[2]]
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    plan = str(Q.op5_byte_bpe(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString())
    assert plan.count("MapInArrow") == 2 and "Union" in plan.splitlines()[0]


def test_columns_that_are_carried(spark):
    rows = [(1, "a", "one two " * 600, "x"), (2, None, "three", None), (3, "c", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string")
    got = byte_bpe.encode_texts(docs, RANKS, P.PATTERN, chunk=2048, carry=["source", "doc_id"])
    assert got.columns == ["doc_id", "source", "ids"]
    assert {(r.doc_id, r.source, tuple(r.ids)) for r in got.collect()} == {(i, s, tuple(reference_bpe().encode_ordinary(t or ""))) for i, _, t, s in rows}


def check_pieces(rows, ids, length=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        found = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert found == ids[doc] and [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert all(r.doc_tokens == len(ids[doc]) and r.length == len(r.ids) // 4 for r in pieces)
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in pieces])
        assert [r.offset for r in pieces] == [0, *ends[:-1].tolist()] and ends[-1] <= length
        padding += 0 if int(ends[-1]).bit_count() == 1 else length - int(ends[-1])
    assert set(by_doc) == set(ids)
    return padding


@pytest.mark.parametrize(("length", "most_open", "slack"), [(2048, 64, 8), (256, 4, 0), (64, 1, 8)])
def test_packing_places_every_id_once(docs, plain, length, most_open, slack):
    want = {r[0]: [*e.ids, 1] for r, e in zip(plain, library(BYTES).encode_batch([r[1] or "" for r in plain], add_special_tokens=False), strict=True)}
    rows = packing.pack(docs, BYTES, length=length, most_open=most_open, slack=slack).collect()
    padding = check_pieces(rows, want, length)
    assert padding <= 0.05 * sum(map(len, want.values()))


@pytest.mark.parametrize("fan_in", [1, 3])
def test_packing_merges_in_rounds(docs, plain, fan_in):
    want = {r[0]: [*e.ids, 1] for r, e in zip(plain, library(BYTES).encode_batch([r[1] or "" for r in plain], add_special_tokens=False), strict=True)}
    rows = packing.pack(docs.repartition(6), BYTES, length=256, most_open=4, fan_in=fan_in + 1).collect()
    assert len({r.sequence_id >> 58 for r in rows}) > 2
    check_pieces(rows, want, 256)


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd.withColumn("ids", F.lit("clash")), BYTES).collect()
    lengths = sum(r.length for r in rows)
    want = library(BYTES).encode_batch([r.text or "" for r in odd.collect()], add_special_tokens=False)
    assert lengths == sum(len(e.ids) + 1 for e in want)
    assert packing.pack(none, BYTES).count() == 0


def test_token_files_round_trip(spark, docs, plain):
    want, start = {}, 0
    for r, e in zip(plain, library(WORDS).encode_batch([r[1] or "" for r in plain], add_special_tokens=False), strict=True):
        want[r[0]] = (start, [*e.ids, 1])
        start += len(e.ids) + 1
    manifest = token_files.write_ids(docs, WORDS, block_ids=3000)
    assert manifest.count() > 2
    got = token_files.read_ids(spark, manifest).collect()
    assert {r.doc_id: (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got} == want


def test_token_files_of_odd_rows(spark, odd, none):
    got = token_files.read_ids(spark, token_files.write_ids(odd, WORDS)).orderBy("start").collect()
    assert len(got) == odd.count() and [r.doc_id for r in got[:2]] == [None, None]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d))
    assert token_files.read_ids(spark, token_files.write_ids(none, WORDS)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2000), st.integers(1, 70000), st.integers(0, 99))
def test_coder_round_trip(n, top, seed):
    random_ = np.random.default_rng(seed)
    ids = np.minimum(random_.zipf(1.4, n), top).astype(np.uint32) - 1 if seed % 2 else random_.integers(0, top, n).astype(np.uint32)
    cuts = np.sort(random_.integers(0, n + 1, 3))
    docs, parts = mixing_coder.decode_block(mixing_coder.encode_block([1, None, -5, 1 << 60], np.split(ids, cuts)))
    assert docs == [1, None, -5, 1 << 60] and [p.tolist() for p in parts] == [p.tolist() for p in np.split(ids, cuts)]


def test_coder_learns_and_notices_damage():
    ids = np.tile(np.random.default_rng(1).integers(0, 40000, 500), 60).astype(np.uint32)
    block = mixing_coder.encode_block([1], [ids])
    assert len(block) < len(ids)
    for at in (3, 50, len(block) // 2, len(block) - 1):
        with pytest.raises(ValueError):
            mixing_coder.decode_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])
    with pytest.raises(ValueError):
        mixing_coder.decode_block(block[:10])


@pytest.mark.parametrize("manifest", ["manifest", None])
def test_media_round_trip(spark, docs, plain, manifest):
    folder, ranges = media_source.write_media(docs, archive_bytes=20_000, range_bytes=5000)
    assert ranges.select("archive").distinct().count() > 3 and ranges.count() > ranges.select("archive").distinct().count()
    got = media_source.decode_media(media_source.read_media(spark, folder, manifest, rangeBytes="5000")).collect()
    texts = {r[0]: (r[1] or "").encode() for r in plain}
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (bytes(r.payload), r.n_bytes, r.error) == (padded, len(raw), None)
        assert r.feature == media_source.feature(padded) and bytes(r.media) == media_source.to_media(padded, len(raw))


def test_a_range_reads_its_slice_of_the_directory(docs):
    folder, ranges = media_source.write_media(docs, range_bytes=5000)
    reader = media_source.MediaReader(_schema(), {"path": folder, "manifest": f"{folder}/manifest"})
    store, root = media_source.pafs.FileSystem.from_uri(folder)
    listed = defaultdict(list)
    for p in reader.partitions():
        members = media_source.directory(store, f"{root}/{p.archive}", p.directory)
        assert members and all(p.begin <= m[0] < p.end for m in members)
        listed[p.archive] += members
    assert len(reader.partitions()) == ranges.count() > len(listed)
    assert all(found == media_source.directory(store, f"{root}/{name}") for name, found in listed.items())
    with pytest.raises(ValueError):
        media_source.directory(store, f"{root}/{p.archive}", (p.directory[0] + 1, p.directory[1] - 1))


def test_media_of_odd_rows(spark, odd, none):
    folder, _ = media_source.write_media(odd.withColumn("media", F.lit("clash")))
    got = media_source.read_media(spark, folder)
    assert got.count() == odd.count() and got.where("doc_id is null").count() == 2
    folder, _ = media_source.write_media(none)
    assert media_source.read_media(spark, folder).count() == 0


def test_members_are_retried_alone(tmp_path):
    """A member that fails twice is read the third time; one that always fails is a row of its own."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(3):
            z.writestr(f"{i:08d}.{i}.wav", media_source.to_media(b"a" * 64, i))
    (tmp_path / "media-a.zip").write_bytes(out.getvalue())
    reader = media_source.MediaReader(_schema(), {"path": f"file://{tmp_path}", "onError": "null"})
    real, tries = media_source.member, defaultdict(int)

    def flaky(store, where, offset, *rest):
        tries[offset] += 1
        if offset and (tries[offset] < 3 or len(tries) == 3):
            raise OSError("lost")
        return real(store, where, offset, *rest)

    media_source.member = flaky
    try:
        rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    finally:
        media_source.member = real
    assert [r["error"] is None for r in rows] == [True, True, False]
    assert sorted(tries.values()) == [1, 3, 3]


def _schema():
    from pyspark.sql import types as T

    return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("error", T.StringType())])


def test_stray_files_do_not_count(spark, docs):
    folder, _ = media_source.write_media(docs.limit(3))
    path = folder.removeprefix("file://")
    with open(os.path.join(path, "media-stray.zip"), "wb") as out:
        out.write(b"left by a lost attempt")
    assert media_source.read_media(spark, folder).count() == 3


def test_digests_follow_the_contract(spark, tmp_path, docs, plain):
    from lexigrid.llm import queries as Q

    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    five = {r.doc_id: r for r in Q.op5_byte_bpe(spark, sf).collect()}
    four = {r.doc_id: r for r in Q.op4_token_files(spark, sf).collect()}
    three = {r.doc_id: r for r in Q.op3_media(spark, sf).collect()}
    for doc, text, *_ in plain:
        raw, ids = (text or "").encode(), reference_bpe().encode_ordinary(text or "")
        assert (five[doc].n_tokens, five[doc].ids_sha256, five[doc].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())
        words = np.array([*library_words(text or ""), 1], "<u4")
        assert (four[doc].n_tokens, four[doc].ids_crc32) == (len(words), zlib.crc32(words.tobytes()))
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (three[doc].n_bytes, three[doc].payload_bytes, three[doc].payload_sha256, three[doc].tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def library_words(text):
    made = _encoders.setdefault("words", library(WORDS))
    return made.encode(text, add_special_tokens=False).ids
