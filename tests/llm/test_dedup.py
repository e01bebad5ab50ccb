from __future__ import annotations

import hashlib
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from lexigrid.llm import line_dedup, simhash, substring_dedup
from lexigrid.llm.components import components


def order(row):
    raw = (row[1] or "").encode()
    return (row[0] is not None, row[0] or 0, zlib.crc32(raw))


def brute_substrings(rows, n=20):
    """(id, text) -> (words, removed, digest); rows equal in both are one document."""
    seen, out = {}, {}
    for row in sorted({(r[0], r[1]): r for r in rows}.values(), key=order):
        words = (row[1] or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - n + 1):
            key = tuple(words[i : i + n])
            if key in seen:
                gone[i : i + n] = [True] * n
            seen.setdefault(key, True)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[row[0], row[1]] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept))
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substrings_equal_brute_force(docs, plain, batches):
    want = {k[0]: v for k, v in brute_substrings(plain).items()}
    got = substring_dedup.dedup_substrings(docs, batches=batches).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {k: v[:3] for k, v in want.items()}
    assert sum(r.n_removed for r in got) > 300
    for r in got:
        assert b" ".join((r.text or "").encode().split()) == want[r.doc_id][3]
        assert r.n_removed or r.text == plain[r.doc_id][1]


def test_substrings_of_odd_rows(odd):
    rows = [tuple(r) for r in odd.collect()]
    want = brute_substrings(rows)
    marked = odd.withColumn("n_words", F.lit("clash")).withColumn("was", F.col("text"))
    got = substring_dedup.dedup_substrings(marked).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id, r.was][:3]


def test_index_is_reopened_and_compacts_by_level(spark, docs, plain, tmp_path):
    """A new object a batch, on one folder: what was indexed before is known."""
    want = {k[0]: v[:2] for k, v in brute_substrings(plain).items()}
    found, step, levels = {}, 13, []
    for low in range(0, len(plain), step):
        index = substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/index", fanout=2)
        assert index.version >= len(levels) and (not levels or index.runs == levels[-1])
        batch = docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < low + step))
        for r in index.dedup_batch(batch, docs.where(F.col("doc_id") < low)).collect():
            found[r.doc_id] = (r.n_words, r.n_removed)
        levels.append(index.runs)
    assert found == want
    assert max(level for runs in levels for level, _ in runs) >= 2 and max(map(len, levels)) <= 4
    held = {p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("run-")}
    assert held == {name for _, name in levels[-1]}
    index.drop()
    assert not (tmp_path / "index").exists()


def test_history_is_not_shuffled(spark, docs, plain, monkeypatch):
    """Texts of history that have no place to look at never reach a task of windows."""
    seen = []
    real = substring_dedup.SubstringIndex._beside

    def spy(texts, places, n, how="inner"):
        out = real(texts, places, n, how)
        seen.append((how, texts.count(), out.count()))
        return out

    monkeypatch.setattr(substring_dedup.SubstringIndex, "_beside", staticmethod(spy))
    index = substring_dedup.SubstringIndex(spark)
    index.dedup_batch(docs.where("doc_id < 64"))
    index.dedup_batch(docs.where("doc_id >= 64"), docs.where("doc_id < 64"))
    history = [s for s in seen if s[0] == "inner"][-1]
    assert history[1] == 64 and history[2] < 10
    index.drop()


def test_many_documents_are_joined_instead_of_sent(docs, plain, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SENT", 0)
    want = {k[0]: v[:3] for k, v in brute_substrings(plain).items()}
    got = substring_dedup.dedup_substrings(docs, batches=2).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_windows_are_digested_from_their_words():
    import numpy as np

    words = [b"w%d" % i for i in range(30)]
    made = substring_dedup.window_digests(words, np.array([0, 3, 10]))
    assert [m.tobytes() for m in made] == [xxhash.xxh3_128_digest(b" ".join(words[i : i + 20])) for i in (0, 3, 10)]


def test_equal_first_halves_of_digests_are_told_apart():
    import numpy as np

    k1, k2 = np.array([7, 7, 7], np.uint64), np.array([1, 2, 1], np.uint64)
    a, b, at = substring_dedup._by_key((k1, k2), (np.array([10, 11, 12]),))
    assert at.tolist() == [10, 12, 11] and substring_dedup._heads(a, b).tolist() == [True, False, True]
    runs = [np.array([7, 9], np.uint64), np.array([2, 1], np.uint64)]
    assert substring_dedup._in_runs(k1, k2, runs).tolist() == [False, True, False]


def brute_lines(rows, n=3):
    lines = {(r[0], r[1]): (r[1] or "").split("\n") for r in rows}
    seen, gone = {}, {k: set() for k in lines}
    for key in sorted(lines, key=lambda k: (k[0] is not None, k[0] or 0)):
        for i in range(len(lines[key]) - n + 1):
            window = tuple(lines[key][i : i + n])
            if not "".join(window).strip(" \t\n\x0b\x0c\r"):
                continue
            if window in seen:
                gone[key].update(range(i, i + n))
            seen.setdefault(window, True)
    return {k: (len(v), len(gone[k]), "\n".join(x for i, x in enumerate(v) if i not in gone[k])) for k, v in lines.items()}


def test_lines_equal_brute_force(docs, plain):
    want = {k[0]: v for k, v in brute_lines(plain).items()}
    got = line_dedup.dedup_lines(docs).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text or "") for r in got} == want
    assert sum(r.n_removed for r in got) > 10


def test_lines_of_odd_rows(odd, docs):
    got = line_dedup.dedup_lines(odd.withColumn("n_removed", F.lit("clash")))
    assert got.count() == odd.count() and got.columns == [*odd.columns, "n_removed", "n_lines"]
    same = got.where("doc_id = 0").select("text", "n_removed").distinct().count()
    assert same == 1
    assert got.where("doc_id is null and text is null").count() == 1


def test_repeated_rows_gather_no_more_lines(spark):
    """Starts are gathered once however often a row repeats its id and text."""
    block = "\n".join(f"line {i} of a block" for i in range(10))
    rows = [(1, block)] + [(2, block)] * 300 + [(None, "x\n" + block)] * 200
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.n_removed, r.text, r["count"]) for r in line_dedup.dedup_lines(frame).groupBy("doc_id", "n_removed", "text").count().collect()}
    assert got == {(None, 0, "x\n" + block, 200), (1, 10, "", 1), (2, 10, "", 300)}
    plan = line_dedup.dedup_lines(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in plan and "collect_list" not in plan


def test_lines_use_no_python(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    up = {i: i for i in prints}

    def root(i):
        return i if up[i] == i else root(up[i])

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprints_and_groups_equal_brute_force(docs, plain):
    prints = {r[0]: brute_fingerprint(r[1]) for r in plain}
    got = simhash.near_groups(docs).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == prints
    assert {r.doc_id: r.component for r in got} == brute_groups(prints)


def test_anchors_lose_no_link():
    """Random fingerprints with 0 to 3 flipped bits meet at a home anchor."""
    import numpy as np

    random = np.random.default_rng(3)
    base = random.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in random.choice(64, int(random.integers(0, 4)), replace=False)) for _ in base]
    other = base ^ np.array(flips, np.uint64)
    for left, right in ((base, other), (other, base)):
        homes, sent = {}, {}
        for row, key, home in zip(*simhash.anchors(left), strict=True):
            if home:
                homes.setdefault(row, set()).add(key)
        for row, key, _ in zip(*simhash.anchors(right), strict=True):
            sent.setdefault(row, set()).add(key)
        assert all(homes[i] & sent[i] for i in range(len(base)))
    assert max(len(v) for v in sent.values()) <= 34


def test_large_anchor_groups_are_searched():
    import numpy as np

    fps = np.array([1 << (i % 3) | (i // 3) << 40 for i in range(300)], np.uint64)
    forest = simhash.Forest()
    simhash.link_anchors(np.zeros(300, np.int64), fps, np.arange(300), np.ones(300, bool), 3, forest)
    want = brute_groups(dict(enumerate(fps.tolist())))
    assert {i: forest.root(i) for i in range(300)} == want


@pytest.mark.parametrize("rows", [7, 100, 1 << 17])
def test_links_are_found_in_slices(rows):
    """However few rows are held at once, an anchor's homes meet all that are sent to it."""
    import numpy as np
    import pyarrow as pa

    random = np.random.default_rng(8)
    fps = np.unique(np.concatenate([random.integers(0, 1 << 63, 40, dtype=np.uint64) ^ (np.uint64(1) << random.integers(0, 64, 40).astype(np.uint64)) for _ in range(2)] + [np.arange(200, dtype=np.uint64) << np.uint64(3)]))
    row, key, home = simhash.anchors(fps)
    order = np.lexsort((~home, key))
    columns = [key.view(np.int64)[order], fps.view(np.int64)[row][order], row[order], home[order]]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 50]) for c in columns], ["anchor", "fp", "rep", "home"]) for i in range(0, len(row), 50)]
    forest = simhash.Forest()
    for batch in simhash._links(3, rows)(batches):
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            forest.link(u, v)
    assert {i: forest.root(i) for i in range(len(fps))} == brute_groups(dict(enumerate(fps.tolist())))


def test_crowded_anchors_are_split(spark):
    """One anchor with most fingerprints: in cells, with the same groups."""
    import numpy as np

    random = np.random.default_rng(5)
    high = np.uint64(0x5A5A5A5A) << np.uint64(32)
    fps = [int(high | np.uint64(x)) for x in random.choice(1 << 10, 300, replace=False)] + [int(x) for x in random.integers(0, 1 << 63, 200)]
    rows = [(i, int(np.uint64(fp).view(np.int64))) for i, fp in enumerate(fps)]
    table = spark.createDataFrame(rows, "doc_id long, fp long").repartition(3)
    sent = table.withColumn("rep", F.col("doc_id")).select("fp", "rep").mapInArrow(simhash.fold_rows(simhash._replicate), "anchor long, fp long, rep long, home boolean")
    most = [d.where("home").groupBy("anchor").count().agg(F.max("count")).first()[0] for d in (sent, simhash.split_anchors(sent, 40))]
    assert most[0] == 300 and most[1] < 80
    got = {r.doc_id: r.component for r in simhash.link_fingerprints(table, block=40).collect()}
    assert got == brute_groups(dict(enumerate(fps)))


def test_simhash_of_odd_rows(odd):
    got = simhash.near_groups(odd)
    assert got.count() == odd.count()
    assert got.where("doc_id is null and component is not null").count() == 0
    zero = got.where("fp = 0 and doc_id is not null").select("component").distinct().collect()
    assert len(zero) == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 200), (None, 3)] + [(300, 301 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)} | {i: 300 for i in range(300, 351)}


def test_empty_tables(none):
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert simhash.near_groups(none).count() == 0


def test_a_batch_needs_its_history_and_its_order(spark, tmp_path):
    """Nothing is lost in silence: a batch without history, or out of order, is refused."""
    words = " ".join(f"w{i}" for i in range(40))

    def rows(*found):
        return spark.createDataFrame(found, "doc_id long, text string")

    index = substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/index")
    first = rows((1, words), (5, "a few words"))
    index.dedup_batch(first).collect()
    again = substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/index")
    with pytest.raises(ValueError, match="history"):
        again.dedup_batch(rows((9, words)))
    for early in ((2, words), (5, "a few words"), (None, words)):
        with pytest.raises(ValueError, match="come after"):
            again.dedup_batch(rows(early, (9, words)), first)
    later = [t for t in (f"other text {i}" for i in range(9)) if zlib.crc32(t.encode()) > zlib.crc32(b"a few words")][0]
    assert {r.doc_id: r.n_removed for r in again.dedup_batch(rows((5, later), (9, words)), first).collect()} == {5: 0, 9: 40}
    assert again.dedup_batch(rows(), first).count() == 0 and again.last[0] == 9
    with pytest.raises(ValueError, match="come after"):
        again.dedup_batch(rows((9, words)), first)
    again.drop()


@pytest.mark.parametrize("name", ["_ld_lines", "_ld_doc", "_sd_id", "_sd_starts"])
def test_reserved_names_are_refused(docs, name):
    run = line_dedup.dedup_lines if name.startswith("_ld") else substring_dedup.dedup_substrings
    with pytest.raises(ValueError, match="reserved"):
        run(docs.withColumn(name, F.lit("clash")), batches=1) if name.startswith("_sd") else run(docs.withColumn(name, F.lit("clash")))
