from __future__ import annotations

import random

import pytest

from lexigrid.operators.graph import NODE
from lexigrid.operators.graph_store import GraphStore

NODES = "id string, kind string, name string, doc string, number int, text string, entity_type string, seq long"
EDGES = "src string, dst string, relation string, seq long"


def made(seed=2):
    r = random.Random(seed)
    nodes = [(f"n{r.randrange(30)}", r.choice(["doc", None]), r.choice(["a", "b", None]), None, r.choice([1, 2, None]), r.choice(["x", None]), None, r.randrange(40)) for _ in range(200)]
    edges = [(f"n{r.randrange(9)}", f"n{r.randrange(9)}", r.choice(["cites", "party", None]), r.randrange(20)) for _ in range(120)]
    return nodes, edges


def plain(rows, keys, values):
    out = {}
    for row in rows:
        held = out.setdefault(row[:keys], [None] * values)
        for i, value in enumerate(row[keys:-1]):
            if value is not None and (held[i] is None or (row[-1], value) > held[i]):
                held[i] = (row[-1], value)
    return {k: tuple(v and v[1] for v in held) for k, held in out.items()}


def shown(store):
    nodes = {(r.id,): tuple(r[c] for c in NODE[1:]) for r in store.nodes().collect()}
    edges = {(r.src, r.dst): (r.relation,) for r in store.edges().collect()}
    return nodes, edges


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2, 1, 3)])
def test_late_and_repeated_adds_give_the_same_graph(spark, tmp_path, order):
    nodes, edges = made()
    store = GraphStore(spark, f"{tmp_path}/g", 8)
    assert shown(store) == ({}, {})
    for batch_id, i in enumerate(order):
        store.add(batch_id, spark.createDataFrame(nodes[i * 50 : i * 50 + 50], NODES), spark.createDataFrame(edges[i * 30 : i * 30 + 30], EDGES))
    want = plain(nodes, 1, 6), plain(edges, 2, 1)
    assert shown(store) == want
    store.add(0, spark.createDataFrame(nodes[order[0] * 50 : order[0] * 50 + 50], NODES))  # a batch done again
    assert shown(store) == want
    store.rebuild()
    assert shown(GraphStore(spark, f"{tmp_path}/g", 8)) == want


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    nodes, _ = made()
    store = GraphStore(spark, f"{tmp_path}/g", 8)
    store.add(0, spark.createDataFrame(nodes, NODES))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "g" / "nodes").rglob("*.parquet")}
    assert store.add(1, spark.createDataFrame([("n1", None, "late", None, None, None, None, 99)], NODES)) == {"nodes": 1}
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "g" / "nodes").rglob("*.parquet")}
    assert len({p.parent for p in before if before[p] != after.get(p)}) == 1
    assert store.nodes().where("id = 'n1'").first()["name"] == "late"
    assert store.add(2, spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)) == {"nodes": 0, "edges": 0}
