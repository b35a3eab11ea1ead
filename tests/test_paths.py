"""Searches through deep graphs and trees against plain ones, and how many rounds they take."""

import random
from collections import Counter

import pytest
from graphloom.operators import graph


def plain(edges, seeds):
    out = {}
    for s, d in edges:
        out.setdefault(s, []).append(d)
    depth, front = dict.fromkeys(seeds, 0), list(seeds)
    while front:
        nxt = []
        for n in front:
            for x in out.get(n, ()):
                if x not in depth:
                    depth[x] = depth[n] + 1
                    nxt.append(x)
        front = nxt
    return depth


def got(spark, edges, seeds, **more):
    e, s = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(x,) for x in seeds], "id long")
    rows = [tuple(r) for r in graph.reach(e, s, **more).collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_depths_with_chains(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "CHAINED", 5)
    pick = random.Random(seed)
    edges, at = [], 1000
    for _ in range(40):
        nodes = [pick.randrange(40), *range(at, at + pick.randint(0, 30)), pick.randrange(40)]
        edges += list(zip(nodes, nodes[1:], strict=False))
        at = max(at, nodes[-2] + 1)
    edges += [(5000 + k, 5000 + (k + 1) % 9) for k in range(9)] + [(5003, 6000), (1003, 1003)]  # a ring that nothing leads to, and a loop
    seeds = [pick.randrange(40), 1002, 1010, 99_999]
    assert got(spark, edges, seeds) == plain(edges, seeds)


def test_a_chain_of_a_hundred_thousand_nodes(spark):
    n, rounds = 100_000, Counter()
    edges = [(k, k + 1) for k in range(n)]
    depth = got(spark, edges, [0], watch=lambda step: rounds.update([step]))
    assert depth == {k: k for k in range(n + 1)}
    assert rounds["double"] <= 18 and rounds["relax"] <= 2


def test_bounded_and_empty(spark):
    edges = [(k, k + 1) for k in range(20)]
    assert got(spark, edges, [3], most=4) == {3: 0, 4: 1, 5: 2, 6: 3, 7: 4}
    assert got(spark, edges, []) == {} and got(spark, [], [1]) == {1: 0}


def test_a_deep_tree_is_searched_in_few_rounds(spark):
    schema, rounds, n = "node_id string, parent_id string, kind string, label string", Counter(), 2000
    rows = [("n0", None, "module", "top")] + [(f"n{k}", f"n{k - 1}", "folder", f"level {k}.") for k in range(1, n)] + [("x", "n3", "symbol", "other"), ("y", "x", "symbol", "under other"), ("z", "n1500", "symbol", "aside")]
    tree = spark.createDataFrame(rows, schema)
    found = {r["node_id"] for r in graph.tree_search(tree, "LEVEL 1999.", lambda step: rounds.update([step])).collect()}
    assert found == {f"n{k}" for k in range(n)} and rounds["double"] <= 12
    assert {r["node_id"] for r in graph.tree_search(tree, "other").collect()} == {"n0", "n1", "n2", "n3", "x", "y"}
    assert graph.tree_search(tree, "nowhere").count() == 0
