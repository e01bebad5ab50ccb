from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrid.llm import decontamination, divergence
from lexigrid.llm.byte_words import Words, byte_class

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, digits):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aZ0 9é日\n.😀\x00\x7f", max_size=30), max_size=6), st.booleans(), st.integers(0, 2))
def test_words_equal_the_pattern(texts, digits, skip):
    column = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    found = Words(column, byte_class(digits))
    whole = [w.rstrip(" ") for w in found.strings().to_pylist()]
    assert [whole[a:b] for a, b in zip(found.row, found.row[1:])] == [words(t, digits) for t in column.to_pylist()]
    hashes = dict(zip(whole, found.hashes().tolist()))
    assert len(set(hashes.values())) == len(hashes)


# Decontamination


def brute_hits(text, items, n=10):
    own, asked = words(text, True), defaultdict(set)
    for item, body in items:
        w = words(body, True)
        for i in range(len(w) - min(n, len(w)) + 1) if w else ():
            asked[tuple(w[i : i + min(n, len(w))])].add(item)
    hit, named = [False] * len(own), set()
    for size in {len(k) for k in asked}:
        for i in range(len(own) - size + 1):
            owners = asked.get(tuple(own[i : i + size]))
            if owners:
                hit[i : i + size] = [True] * size
                named |= owners - {None}
    spans = [(m.start(), m.end()) for m in re.finditer("x+", "".join("x" if h else "." for h in hit))]
    return len(own), sum(hit), sorted(map(str, named), key=str.encode), spans


def shown(row):
    return row.n_words, row.n_hit, row["items"], [(s.start, s.end) for s in row.spans]


@pytest.fixture(scope="module")
def items(spark, plain):
    texts = [
        plain[20][1],
        " ".join((plain[9][1] or "").split()[:12]),
        "THEA, ren9 plain!",
        "be be be",
        "be",
        "naïve élan",
        "be " * 60,
        "not in any of them",
        "",
        None,
        plain[64][1],
        " ".join(plain[4][1].split()[2:9]),
        " ".join(plain[4][1].split()[5:14]),
    ]
    rows = [*enumerate(texts, 7), (7, plain[64][1]), (None, plain[12][1]), (100, "be be be be")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("sent", [1 << 18, 0])
@pytest.mark.parametrize("window,gram", [(10, 5), (4, 4), (6, 2), (3, 5)])
def test_hits_equal_brute_force(docs, plain, items, sent, window, gram):
    rows, table = items
    got = {r.doc_id: shown(r) for r in decontamination.find_contamination(docs, table, window=window, gram=gram, sent_windows=sent).collect()}
    assert got == {r[0]: brute_hits(r[1], rows, window) for r in plain}
    assert sum(v[1] > 0 for v in got.values()) >= 8


@pytest.mark.parametrize("sent", [1 << 18, 0])
def test_hits_of_odd_rows(spark, odd, none, items, sent):
    rows, table = items
    marked = odd.withColumn("n_hit", F.lit("clash")).withColumn("items", F.lit(1)).withColumn("start", F.lit(2.5))
    got = decontamination.find_contamination(marked, table, sent_windows=sent)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "start", "n_words", "n_hit", "items", "spans"]
    got = got.collect()
    assert len(got) == odd.count() and all(shown(r) == brute_hits(r.text, rows) and r.start == 2.5 for r in got)
    assert decontamination.find_contamination(none, table, sent_windows=sent).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r["items"] for r in decontamination.find_contamination(odd, nothing, sent_windows=sent).collect())
    with pytest.raises(ValueError, match="reserved"):
        decontamination.find_contamination(odd.withColumn("_dc_id", F.lit(1)), table)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_equal_windows_choose_equal_fingerprints(data):
    """Any shared span of a window's length holds a fingerprint of both sides, in few and repeated words."""
    word = st.sampled_from(["a", "b", "c"])
    span = data.draw(st.lists(word, min_size=10, max_size=14))
    sides = [data.draw(st.lists(word, max_size=12)) + span + data.draw(st.lists(word, max_size=12)) for _ in range(2)]
    chosen = []
    for side in sides:
        made = Words(pa.array([" ".join(side)]), byte_class(True))
        _, place, grams = decontamination._chosen(made.hashes(), made.left(), 10, 5)
        chosen.append(set(grams[place].tolist()))
    assert chosen[0] & chosen[1]


def test_a_sent_benchmark_shuffles_no_document(docs, items):
    plan = decontamination.find_contamination(docs, items[1])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryTableScan")[0] and "Join" not in plan.split("InMemoryTableScan")[0]


# Divergence


def brute_audit(rows, least, top=10):
    docs = [(lang or "", source or "", words(text, False)) for _, text, lang, source, *_ in rows]
    have, out = Counter((lang, t) for lang, _, ws in docs for t in set(ws)), []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for (x, t), n in have.items() if x == lang and n >= least)
        names = sorted({s for x, s, _ in docs if x == lang}, key=str.encode)
        counts = {s: Counter(t for x, y, ws in docs if (x, y) == (lang, s) for t in ws if have[lang, t] >= least) for s in names}
        whole = sum(counts.values(), Counter())

        def share(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in names:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in names if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, n in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:n], 1)]
    return sorted(out)


def audited(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("groups,terms", [(128, 1024), (2, 7), (1, 1000), (3, 1)])
def test_audit_equals_brute_force(docs, plain, groups, terms):
    least = 10 if terms > 1 else 40
    want = brute_audit(plain, least)
    assert audited(divergence.audit_sources(docs, least_docs=least, groups=groups, terms=terms)) == want
    assert sum(r[2] == "term" for r in want) >= 5


@pytest.mark.parametrize("groups", [128, 2])
def test_audit_of_odd_rows(spark, odd, none, groups):
    text = " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5))
    rows = [(i, text if i % 2 else text[: 7 * i], lang, f"s{i % 4}" if i % 5 else None, 0) for i in range(60) for lang in ("de", None)]
    rows += [(0, None, "none at all", "a", 0), (0, "few words", "none at all", "é", 0), (0, "x", "one", None, 0)] + [(1, f"équal TERMS {'tie tié' * 2}", "fr", f"s{i}", 0) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("value", F.lit("x")).withColumn("term", F.lit(3))
    got = audited(divergence.audit_sources(table, groups=groups))
    assert got == brute_audit(rows, 10)
    assert ("none at all", "a", "pair", "é", 0, 1) in got and not any(r[0] == "one" for r in got)
    assert audited(divergence.audit_sources(odd)) == brute_audit([tuple(r) for r in odd.collect()], 10)
    assert divergence.audit_sources(none).count() == 0


def test_counts_are_merged_as_they_are_held(docs, monkeypatch):
    want = sorted(map(tuple, divergence.term_counts(docs).collect()))
    batch = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text").toArrow()
    for held in (1, 40, 500):
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "SLICE_ROWS", 7)
        sums = Counter()
        for part in divergence._count(iter(batch.to_batches())):
            for lang, source, term, n, have in zip(*(c.to_pylist() for c in part.columns), strict=True):
                sums[lang, source, term] += n + have * 10**9
        assert sorted((*k, v % 10**9, v // 10**9) for k, v in sums.items()) == want


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 7, 10**12, 3 * 10**14], np.int64)
    totals = np.array([[3 * 10**14 + 10], [8 * 10**15]], np.int64)
    assert divergence.shares(counts[None, :], totals).tolist() == [[1 + 10**9 * (int(c) + 2) // int(t[0]) for c in counts] for t in totals]
