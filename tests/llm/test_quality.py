from __future__ import annotations

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import quality_classifier, quality_rules, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(odd):
    rows = quality_rules.judge(odd.withColumn("n_words", F.lit("clash"))).collect()
    assert len(rows) == odd.count()
    for r in rows:
        want = brute_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept) and 0 <= r.p_good <= 1


def test_rules_use_no_python(docs):
    plan = quality_rules.with_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_em_finds_the_accurate_rules():
    """Two rules are right nine times in ten, one is a coin, one is mostly wrong where it votes."""
    r, votes = random.Random(1), Counter()
    for _ in range(6000):
        good = r.random() < 0.7
        vote = lambda p, good=good: (1 if good else -1) if r.random() < p else (-1 if good else 1)
        votes[vote(0.9), vote(0.9), vote(0.5), vote(0.85) if r.random() < 0.5 else 0] += 1
    model = quality_rules.fit_votes(sorted(votes.items()))
    gap = [o[1] - o[-1] for o in model["odds"]]
    assert min(gap[0], gap[1], gap[3]) > 2.5 and abs(gap[2]) < 0.7
    assert 0.4 < model["base"] < 1.3
    assert quality_rules.fit_votes([])["odds"] == []


def plain_em(rows, rounds):
    """EM with a posterior for each text: (base, odds of each rule's votes)."""
    n, width = len(rows), len(rows[0])
    good = [(1 + sum(v > 0 for v in p)) / (2 + sum(v != 0 for v in p)) for p in rows]
    for _ in range(rounds):
        mass = sum(good)
        prior, odds = (mass + 1) / (n + 2), []
        for r in range(width):
            share = {v: ((sum(g for g, p in zip(good, rows, strict=True) if p[r] == v) + 0.5) / (mass + 1.5), (sum(1 - g for g, p in zip(good, rows, strict=True) if p[r] == v) + 0.5) / (n - mass + 1.5)) for v in (-1, 0, 1)}
            odds.append({v: math.log(a / b) for v, (a, b) in share.items()})
        base = math.log(prior / (1 - prior))
        good = [1 / (1 + math.exp(-(base + sum(o[v] for o, v in zip(odds, p, strict=True))))) for p in rows]
    return base, odds, good


def test_posterior_and_verdict_equal_plain_em(odd):
    rows = quality_rules.judge(odd).collect()
    votes = [tuple(r.votes) for r in rows]
    base, odds, good = plain_em(votes, 50)
    model = quality_rules.fit_votes(sorted(Counter(votes).items()))
    assert model["base"] == pytest.approx(base)
    for mine, plain in zip(model["odds"], odds, strict=True):
        assert mine == pytest.approx(plain)
    for r, p in zip(rows, good, strict=True):
        assert r.p_good == pytest.approx(p)
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_verdicts_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_rules.judge(docs).join(labels, "doc_id").where("not base_failed")
    counts = {(r.quality, r.kept): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert counts[1, True] >= 0.97 * (counts[1, True] + counts.get((1, False), 0))


def small_tables(spark):
    r = random.Random(2)
    base = ["stone", "river", "garden", "walks", "slowly", "under", "bright", "lamps", "and", "the"]

    def text(good, toxic):
        words = [r.choice(base) + r.choice(["", "s", "ing"]) for _ in range(r.randrange(20, 90))]
        if toxic:
            for _ in range(2):
                words[r.randrange(len(words))] = r.choice(["idiot", "scum", "grolmox"])
        return " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)

    rows = []
    for i in range(500):
        good, toxic = r.random() < 0.7, r.random() < 0.3
        rows.append((i, text(good, toxic), int(good), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "quality", "toxic")


def test_classifier_separates_held_out_rows(spark):
    docs, labels = small_tables(spark)
    held = quality_classifier.held_out(F.col("doc_id"))
    model = quality_classifier.train(docs, labels, where=~held)
    scored = quality_classifier.score(docs, model).join(labels, "doc_id").withColumn("held", held).collect()
    assert {r.doc_id for r in scored if r.held} == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0}
    wrong = [r for r in scored if r.held and r.predicted != r.quality]
    assert len(wrong) <= 0.03 * sum(r.held for r in scored)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in scored)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = small_tables(spark)
    held = quality_classifier.held_out(F.col("doc_id"))
    changed = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_classifier.train(docs, x, where=~held) for x in (labels, changed))
    assert a.intercept == b.intercept and (a.weights == b.weights).all()


def test_score_is_the_sparse_dot_product(spark):
    docs, labels = small_tables(spark)
    model = quality_classifier.train(docs, labels)
    features = quality_classifier.Features(model.bits)
    for r in quality_classifier.score(docs.limit(20), model).collect():
        ids, values = features.sparse(r.text)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.intercept + model.weights[ids] @ values))), rel=1e-4)


def test_updates_equal_plain_ftrl(spark):
    """Follow-the-regularised-leader, one weight after the other, as its paper writes it."""
    docs, labels = small_tables(spark)
    rows = [(r.text, r.quality) for r in docs.join(labels, "doc_id").where("doc_id < 60").orderBy("doc_id").collect()]
    bits, passes = 10, 2
    model, features = quality_classifier.fit(rows, bits, passes), quality_classifier.Features(bits)
    z, n = [0.0] * (1 << bits), [0.0] * (1 << bits)
    good = sum(y for _, y in rows)
    base = math.log((good + 1) / (len(rows) - good + 1))

    def weight(i):
        if abs(z[i]) <= quality_classifier.L1:
            return 0.0
        return -(z[i] - math.copysign(quality_classifier.L1, z[i])) / ((quality_classifier.BETA + math.sqrt(n[i])) / quality_classifier.ALPHA + quality_classifier.L2)

    for _ in range(passes):
        for text, y in rows:
            values = Counter()
            for group in features.of(text):
                for i in group.tolist():
                    values[i] += quality_classifier.SCALE / len(group)
            w = {i: weight(i) for i in values}
            p = 1 / (1 + math.exp(-(base + sum(w[i] * x for i, x in values.items()))))
            for i, x in values.items():
                g = (p - y) * x
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality_classifier.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    assert model.weights.tolist() == pytest.approx([weight(i) for i in range(1 << bits)], abs=1e-5) and model.intercept == base


def test_sample_is_bounded_and_fixed(spark):
    from lexigrid.llm.training import sample

    docs, labels = small_tables(spark)
    doubled = labels.unionByName(labels)
    a = {r.doc_id for r in sample(docs.repartition(3), doubled, F.col("quality"), 50).collect()}
    assert len(a) == 50 and a == {r.doc_id for r in sample(docs, labels.repartition(7), F.col("quality"), 50).collect()}


def test_chain_on_small_tables(spark):
    docs, labels = small_tables(spark)
    train = labels.where("doc_id % 4 <> 0")
    chain = toxicity.train(docs, train)
    assert chain.names == ["toxic_1", "toxic_2", "toxic_3", "toxic"] and (abs(chain.links[3, :3]) > 0).any()
    assert (chain.links == np.tril(chain.links, -1)).all()
    rows = toxicity.score(docs, chain).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    assert sum(r.predicted != r.toxic for r in rows) <= 0.05 * len(rows)
    # What is earlier in the chain tells kinds of toxic texts apart, and those from clean ones.
    kinds = [[r.p_toxic_1 for r in rows if r.toxic and ("idiot" in r.text.lower()) == x] for x in (True, False)]
    clean = [max(r.p_toxic_1, r.p_toxic_2, r.p_toxic_3) for r in rows if not r.toxic]
    assert abs(sum(kinds[0]) / len(kinds[0]) - sum(kinds[1]) / len(kinds[1])) > 0.2 and sum(clean) / len(clean) < 0.3


def toxic_rows(n=240):
    r = random.Random(4)
    base, bad = ["stone", "river", "garden", "walks", "under", "lamps"], [["idiot", "moronic"], ["scum"], ["grolmox"]]

    def text(kind):
        return " ".join([r.choice(base) for _ in range(8)] + ([r.choice(bad[kind]) for _ in range(2)] if kind < 3 else []))

    kinds = [r.choice([0, 0, 1, 2, 3, 3, 3, 3]) for _ in range(n)]
    return [(text(k), int(k < 3)) for k in kinds]


def plain_regress(rows, extra, y, size):
    """One number after the other: the same steps, without arrays over rows."""
    share = sum(y)
    w, v, b = [0.0] * size, [0.0] * len(extra[0]), math.log((share + 1) / (len(y) - share + 1))
    if share in (0, len(y)):
        return w, v, b
    mean = [sum(e[j] for e in extra) / len(extra) for j in range(len(v))]
    sw, sv, sb = [toxicity.DAMPING] * size, [toxicity.DAMPING] * len(v), toxicity.DAMPING
    order, batch = np.random.default_rng(7), max(16, min(toxicity.BATCH, len(y) // 16))
    for _ in range(toxicity.EPOCHS):
        p = order.permutation(len(y)).tolist()
        for at in range(0, len(y), batch):
            gw, gv, gb, mine = {}, [0.0] * len(v), 0.0, p[at : at + batch]
            for i in mine:
                z = sum(w[f] for f in rows[i]) + sum((extra[i][j] - mean[j]) * v[j] for j in range(len(v))) + b
                wrong = (1 / (1 + math.exp(-z)) - y[i]) / len(mine)
                for f in rows[i]:
                    gw[f] = gw.get(f, 0.0) + wrong
                gv = [g + (extra[i][j] - mean[j]) * wrong for j, g in enumerate(gv)]
                gb += wrong
            for f, g in gw.items():
                sw[f] += g * g
                step = toxicity.RATE / math.sqrt(sw[f])
                moved = w[f] - step * g
                w[f] = math.copysign(max(abs(moved) - toxicity.L1 * step * 0.01, 0), moved)
            for j, g in enumerate(gv):
                sv[j] += g * g
                v[j] -= toxicity.RATE / math.sqrt(sv[j]) * g
            sb += gb * gb
            b -= toxicity.RATE / math.sqrt(sb) * gb
    return w, v, b - sum(m * x for m, x in zip(mean, v, strict=True))


def plain_selection(rows, chosen):
    """Names of the features that are kept when only ``chosen`` rows are seen."""
    features = {i: toxicity.text_features(rows[i][0]) for i in chosen}
    seen, bad = Counter(n for f in features.values() for n in f), Counter(n for i, f in features.items() if rows[i][1] for n in f)
    share = sum(rows[i][1] for i in chosen) / len(chosen)
    return {n for n in seen if seen[n] >= toxicity.MIN_TEXTS and abs(bad[n] - share * seen[n]) / math.sqrt(seen[n] * share * (1 - share) + 1e-9) >= toxicity.LEAST_EXCESS}


def test_chain_equals_a_plain_version():
    """Selection, out-of-fold probabilities, links and scores, row by row."""
    rows, groups = toxic_rows(), 3
    chain = toxicity.fit(rows, groups)
    names, data = toxicity.numbered([toxicity.text_features(t) for t, _ in rows])
    toxic = np.array([y for _, y in rows], float)

    def seen_by(chosen, like=None):
        part = toxicity.Part(data, toxic, np.array(chosen), len(names), groups)
        if like is not None:
            part.number_like(like, groups)
        kept = [names[i] for i in part.kept]
        assert set(kept) == plain_selection(rows, chosen)
        return part, [[kept.index(n) for n in sorted(toxicity.text_features(t)) if n in kept] for t, _ in rows], len(kept)

    every = list(range(len(rows)))
    whole, data_of_whole, size = seen_by(every)
    others = [[i for i in every if i % toxicity.FOLDS != f] for f in range(toxicity.FOLDS)]
    parts = [seen_by(o, whole) for o in others]
    before = [[] for _ in rows]
    for k in range(groups + 1):
        w, v, b = plain_regress(data_of_whole, before, whole.targets[k].tolist(), size)
        assert w == pytest.approx(chain.weights[k].tolist(), abs=1e-5) and [*v] == pytest.approx(chain.links[k, :k].tolist(), abs=1e-9)
        assert b == pytest.approx(chain.intercepts[k])
        unseen = [0.0] * len(rows)
        for f, (part, mine, n) in enumerate(parts):
            w, v, b = plain_regress([mine[i] for i in others[f]], [before[i] for i in others[f]], part.targets[k].tolist(), n)
            for i in range(f, len(rows), toxicity.FOLDS):
                unseen[i] = 1 / (1 + math.exp(-(sum(w[x] for x in mine[i]) + sum(a * c for a, c in zip(before[i], v, strict=True)) + b)))
        before = [[*old, new] for old, new in zip(before, unseen, strict=True)]
    for text, _ in rows[:40]:
        found, made = toxicity.text_features(text), []
        for k in range(groups + 1):
            z = sum(float(chain.weights[k][i]) for n, i in chain.words.items() if n in found) + sum(chain.links[k, j] * p for j, p in enumerate(made)) + chain.intercepts[k]
            made.append(1 / (1 + math.exp(-z)))
        assert toxicity.Scorer(chain).of(text) == pytest.approx(made)


def test_fitting_holds_numbers_and_not_names():
    """A sample's features as sets of names took over a GB of the task that fits."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(3000)]
    rows = [(" ".join(r.sample(words, 300)) + " scum" * (i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    held = sum(len(toxicity.text_features(t)) for t, _ in rows)
    tracemalloc.start()
    try:
        chain = toxicity.fit(rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert "scum" in chain.words and held > 400_000 and peak < 40 * held


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_rows_in_pieces_are_the_same_rows(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    sets = [set(), {"a", "b"}, {"b", "c", "a"}, set(), {"c", "b"}, {"a", "once"}, {"b", "c"}]
    names, data = toxicity.numbered(iter(sets))
    assert names == ["a", "b", "c"]
    want = [sorted(names.index(n) for n in s if n in names) for s in sets]
    assert [data.ids[a:b].tolist() for a, b in zip(data.ends, data.ends[1:])] == want
    rows = np.array([6, 2, 0, 1, 3])
    found = [(rows[at].tolist(), [part.ids[a:b].tolist() for a, b in zip(part.ends, part.ends[1:])]) for at, part in data.pieces(rows)]
    assert [i for ids, _ in found for i in ids] == rows.tolist() and [x for _, xs in found for x in xs] == [want[i] for i in rows]
    assert all(len(xs) == 1 or sum(map(len, xs)) <= piece for _, xs in found)
    part = toxicity.Part(data, np.array([0, 1, 1, 0, 1, 0, 0.0]), rows, len(names), 2)
    part.column = np.array([-1, 0, 1], np.int32)
    mine = part.take(rows)
    assert [mine.ids[a:b].tolist() for a, b in zip(mine.ends, mine.ends[1:])] == [[n - 1 for n in want[i] if n] for i in rows]
    assert part.take(rows[:0]).ends.tolist() == [0] and toxicity.numbered([])[0] == []


def test_a_fold_is_not_seen_by_its_own_models():
    """Other labels in a fold change nothing of what its rows are told by the other folds."""
    rows, groups = toxic_rows(), 3
    own = np.arange(0, len(rows), toxicity.FOLDS)
    names, data = toxicity.numbered([toxicity.text_features(t) for t, _ in rows])
    found = []
    for flip in (False, True):
        toxic = np.array([y for _, y in rows], float)
        if flip:
            toxic[own] = 1 - toxic[own]
        part = toxicity.Part(data, toxic, np.setdiff1d(np.arange(len(rows)), own), len(names), groups)
        probabilities = toxicity.out_of_fold([part], np.where(np.isin(np.arange(len(rows)), own), 0, 1), np.empty((len(rows), 0)), 0)
        found.append((part.kept.tolist(), part.group.tolist(), probabilities[own].tolist()))
    assert found[0] == found[1]


@pytest.mark.parametrize("kind", [quality_classifier, toxicity])
def test_odd_rows_and_empty_tables(spark, odd, none, kind):
    docs, labels = small_tables(spark)
    model = kind.train(docs, labels)
    clash = odd.withColumn("predicted", F.lit("clash")).withColumn("score", F.lit("clash"))
    found = kind.score(clash, model)
    assert found.count() == odd.count() and found.where("predicted is null").count() == 0
    assert kind.score(none, model).count() == 0
    untrained = kind.train(none.select("doc_id", "text"), labels)
    assert kind.score(odd, untrained).where("predicted is null").count() == 0
    one_class = kind.train(docs, labels.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(0)))
    assert kind.score(docs.limit(5), one_class).count() == 5
    nulls = labels.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    assert kind.score(docs.limit(5), kind.train(docs, nulls)).count() == 5


@pytest.mark.parametrize("learnt", [0, 1])
def test_toxic_texts_of_the_tables_are_found(spark, learnt):
    """Learnt from half of the labelled rows, held against the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.train(docs, labels.where(f"doc_id % 2 = {learnt}"))
    rows = toxicity.score(docs, chain).join(labels.where(f"doc_id % 2 <> {learnt}"), "doc_id").collect()
    assert sum(r.predicted and not r.toxic for r in rows) <= 0.01 * len(rows)
    assert sum(r.predicted and r.toxic for r in rows) >= 0.9 * sum(r.toxic for r in rows)


def test_reserved_names_of_rules_are_refused(docs):
    with pytest.raises(ValueError, match="reserved"):
        quality_rules.judge(docs.withColumn("_qr_words", F.lit("clash")))
