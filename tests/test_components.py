"""Strong components against a plain search, and how many rounds long chains take."""

import random
from collections import Counter

import pytest
from graphloom.operators import graph
from graphloom.operators.components import rooted
from graphloom.sources.shared import ensure_checkpoint_dir

SCHEMA = "src long, dst long"


def plain(edges):
    """Nodes that reach each other, by closure from every node."""
    out = {}
    for s, d in edges:
        if s is not None and d is not None and s != d:
            out.setdefault(s, set()).add(d)

    def reach(n):
        seen, waiting = set(), [n]
        while waiting:
            for x in out.get(waiting.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    waiting.append(x)
        return seen

    to = {n: reach(n) for n in out}
    groups = {n: min(m for m in to[n] if n in to.get(m, ())) for n in to if n in to[n]}
    return {(n, c) for n, c in groups.items()}


def got(spark, edges, **more):
    return {tuple(r) for r in graph.components(spark.createDataFrame(edges, SCHEMA), **more).collect()}


@pytest.mark.parametrize(
    "edges",
    [
        [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (5, 7), (8, 8)],
        [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 5)],
        [(1, 2), (1, 2), (2, 1), (None, 1), (1, None), (9, 9)],
        [(1, 2), (2, 3), (3, 4)],
        [(1, 2), (2, 3), (3, 4), (1, 3), (2, 4), (4, 5), (5, 6)],
        [(k, 100 + k) for k in range(30)] + [(100 + k, k) for k in range(30)],
    ],
)
def test_small_graphs(spark, edges):
    assert got(spark, edges) == plain(edges)


def test_no_edges(spark):
    assert got(spark, []) == set()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_graphs_with_chains_rings_and_trees(spark, seed):
    pick = random.Random(seed)
    edges = [(pick.randrange(150), pick.randrange(150)) for _ in range(170)]
    at = 1000
    for _ in range(12):  # chains of forced nodes between nodes of the graph, some of them with ways out
        length = pick.randint(1, 25)
        nodes = [pick.randrange(150), *range(at, at + length), pick.randrange(150)]
        edges += list(zip(nodes, nodes[1:], strict=False))
        edges += [(pick.choice(nodes), pick.randrange(150)) for _ in range(pick.randrange(3))]
        at += length
    edges += [(2000 + k, 2000 + (k + 1) % 40) for k in range(40)] + [(2000 + 7, 3000), (3000, 3001), (3001, 3)]
    assert got(spark, edges) == plain(edges)


def test_a_long_ring_takes_as_many_rounds_as_its_length_has_digits(spark):
    n, rounds = 6000, Counter()
    order = random.Random(4).sample(range(n), n)
    edges = [(order[k], order[(k + 1) % n]) for k in range(n)]
    assert got(spark, edges, watch=lambda step: rounds.update([step])) == {(k, 0) for k in range(n)}
    assert rounds["double"] <= n.bit_length() + 1 and rounds["search"] + rounds["colour"] == 0


def test_a_long_chain_goes_without_a_round_a_node(spark):
    n, rounds = 6000, Counter()
    edges = [(k, k + 1) for k in range(n)] + [(n, n - 1)]
    assert got(spark, edges, watch=lambda step: rounds.update([step])) == {(n - 1, n - 1), (n, n - 1)}
    assert sum(rounds.values()) < 40


def test_sizes_of_doubled_tables_stay_measured(spark):
    """Each round joins a table with itself; a size estimated from joins would get twice as many digits a round."""
    ensure_checkpoint_dir(spark)
    n = 5000
    up = spark.createDataFrame([(k, (k * 7 + 3) % n) for k in range(n)], "id long, to long")
    tree, pointers = rooted(up, n, lambda step: None)
    sizes = [int(str(p._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for p in [*pointers, tree]]
    assert len(pointers) == n.bit_length() + 1 and max(sizes) < 100 * n
