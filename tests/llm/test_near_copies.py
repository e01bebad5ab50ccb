from __future__ import annotations

import random

import corpus_pipeline
from lexigrid.llm import near_copies, simhash
from tests.llm.conftest import SCHEMA, prose


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute_components(rows):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        return i if up[i] == i else root(up[i])

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def edited():
    """Texts of 60 to 400 words in copies with 1 to 12 words changed, and texts that repeat one phrase."""
    r, texts = random.Random(8), []
    for _ in range(40):
        base = prose(r, r.choice([60, 150, 400])).split()
        texts.append(" ".join(base))
        for changes in (1, 2, 4, 12):
            words = list(base)
            for at in r.sample(range(len(words)), changes):
                words[at] = f"w{r.randrange(10**6)}"
            texts.append("  ".join(words).upper() if r.random() < 0.2 and changes == 1 else " ".join(words))
    texts += ["one two three four five six seven " * 200 + prose(r, 12) for _ in range(3)]
    return list(enumerate(texts))


def test_stage_keeps_one_of_each_group_and_links_no_others(spark):
    rows = edited()
    want = brute_components(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()}
    assert kept == {i for i, c in want.items() if i == c}
    assert {len(rows) - 1, len(rows) - 2, len(rows) - 3} <= kept and len(kept) < 0.7 * len(rows)


def test_groups_equal_brute_force(spark, docs, plain):
    got = {r.doc_id: r.component for r in near_copies.copy_groups(docs).collect()}
    assert got == brute_components([r[:2] for r in plain])


def test_what_hubs_leave_apart_is_compared(spark):
    """A chain of texts, each similar to the next only."""
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(1200)]
    rows = [(i, " ".join(words[40 * i : 40 * i + 400])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.component for x in near_copies.copy_groups(docs).collect()} == {0}


def test_odd_rows(odd, none):
    got = near_copies.copy_groups(odd)
    assert got.count() == odd.count() and got.where("doc_id is null and component is not null").count() == 0
    assert got.where("doc_id is not null and component is null").count() == 0
    assert near_copies.copy_groups(none).count() == 0


def test_majority_is_the_fingerprint(plain):
    assert all(simhash.majority(near_copies.shingle_hashes(t, 3)) == simhash.fingerprint(t, 3) for _, t, *_ in plain)


def test_large_bucket_is_searched_and_not_squared(spark):
    """Copies similar to their base, and less than 0.8 to each other."""
    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    rows = [(200, " ".join(base))]
    for i in range(200):
        words = list(base)
        words[5 + i % 50] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component for x in near_copies.copy_groups(docs).collect()}
    assert got == brute_components(rows) and set(got.values()) == {0}
