"""Strong components of a directed graph by joins and aggregations alone.

Three steps, again and again until no edge is left:

* Trimming: edges at nodes without an edge in or without one out lie on no cycle.
* Contraction: where one edge alone enters a node, every cycle through the node takes that edge, so
  the node goes into the one before it, and whole trees and rings of such nodes into their root. Roots
  are found by doubling (each node's pointer becomes its target's), in as many rounds as the longest
  chain has binary digits. The same with all edges turned round. Chains and rings, however long, are
  gone after that.
* Search: forward and backward from the node with the most ways through it, whose component is what
  both reach; after that from many pivots at once, each node taking the colour of the least node that
  leads to it, and a colour's component being what leads back to its pivot.

What a contraction merged may lie on a cycle or not. When all components are known, contractions are
undone, the last first: a merged node is in its root's component if it or a node behind it has an edge
into that component; these marks go up the trees by the same doubling.

Every round is a checkpointed table, of measured size where rounds join it with itself (``settled``),
and brings one number to the driver. No task holds a graph.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.shared import ensure_checkpoint_dir, settled

#: A contraction is worth its rounds where at least one node in so many, and so many at least, would go.
SHARE, LEAST = 64, 16


def filled(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges between different nodes, nulls left out."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges whose ends may lie on a cycle: ends without an edge in or out are removed, ``rounds`` times.

    Each round is stored, since the next one reads it three times.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    live = edges.select("src", "dst").checkpoint()
    for _ in range(rounds):
        heads, tails = live.select(F.col("dst").alias("src")).distinct(), live.select(F.col("src").alias("dst")).distinct()
        live = live.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst").checkpoint()
    return live


@dataclass
class Contraction:
    """What is needed to undo it: the edges before, the tree of merged nodes (id, root), pointers by doubling (id, to), roots with a loop (id)."""

    edges: DataFrame
    tree: DataFrame
    pointers: list[DataFrame]
    loops: DataFrame


def rooted(up: DataFrame, size: int, watch: Callable[[str], None]) -> tuple[DataFrame, list[DataFrame]]:
    """The root of each node of ``up`` (id, to: its only predecessor), and its pointers of 1, 2, 4, ... steps.

    A root is a node that has no row. Of a ring the least node is the root, and has no row in the result.
    """
    now = settled(up.select("id", "to", F.col("id").alias("least")))
    pointers = []
    for _ in range(size.bit_length() + 1):
        watch("double")
        pointers.append(now.select("id", "to"))
        then = now.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("least").alias("others"))
        step = settled(now.join(then, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.least("least", F.coalesce("others", "least")).alias("least"), F.col("further").isNotNull().alias("moved")))
        now = step.select("id", "to", "least")
        if not filled(step.where("moved")):
            return now.select("id", F.col("to").alias("root")), pointers
    # pointers that still move go round a ring, of which they have seen every node
    ring = now.select(F.col("id").alias("to"), F.col("least").alias("ring"))
    out = now.join(ring, "to", "left").select("id", F.coalesce("ring", "to").alias("root")).where("id <> root")
    return settled(out), pointers


def contracted(edges: DataFrame, nodes: int, watch: Callable[[str], None]) -> tuple[DataFrame, Contraction] | None:
    """Edges between what is left when nodes with one edge in have gone into the node before; None if too few would go."""
    up = settled(edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("to")).where("n = 1").select(F.col("dst").alias("id"), "to"))
    size = up.count()
    if size < max(LEAST, nodes // SHARE):
        return None
    tree, pointers = rooted(up, size, watch)
    a, b = tree.select(F.col("id").alias("src"), F.col("root").alias("a")), tree.select(F.col("id").alias("dst"), F.col("root").alias("b"))
    # an edge into a tree's node is the tree's own; all others lead to roots
    moved = settled(edges.join(a, "src", "left").join(b, "dst", "left").where("b is null").select(F.coalesce("a", "src").alias("src"), "dst").distinct())
    loops = moved.where("src = dst").select(F.col("src").alias("id"))
    return moved.where("src <> dst"), Contraction(edges, tree, pointers, loops)


def undone(c: Contraction, known: DataFrame) -> DataFrame:
    """``known`` (id, component) with the merged nodes that are in their root's component, and roots with a loop that are in no other."""
    known = settled(known.unionByName(c.loops.join(known.select("id"), "id", "left_anti").withColumn("component", F.col("id"))))
    out = c.edges.join(c.tree.withColumnRenamed("id", "src"), "src").join(c.tree.select(F.col("id").alias("dst")), "dst", "left_anti")
    of = lambda key, name: known.select(F.col("id").alias(key), F.col("component").alias(name))
    marked = settled(out.join(of("dst", "there"), "dst").join(of("root", "own"), "root").where("own = there").select(F.col("src").alias("id")).distinct())
    if not filled(marked):
        return known
    for p in c.pointers:
        above = p.join(marked, "id", "left_semi").select(F.col("to").alias("id"))
        marked = marked.union(above).distinct().checkpoint()
    merged = c.tree.join(marked, "id", "left_semi").join(of("root", "component"), "root").select("id", "component")
    # a merged node with a loop of its own is known already; its root's component holds it now
    return settled(known.join(merged.select("id"), "id", "left_anti").unionByName(merged))


#: Rounds whose nodes are kept apart before they are stored as one.
APART = 12


def spread(arcs: DataFrame, seeds: DataFrame, watch: Callable[[str], None]) -> DataFrame:
    """All (id, way) that the seeds lead to over arcs (src, dst, way), breadth first.

    What was seen is not rewritten each round: the rounds' nodes are a union that is stored as one now and then.
    """
    seen = front = seeds.checkpoint()
    apart = 1
    while True:
        watch("search")
        step = arcs.join(front.withColumnRenamed("id", "src"), ["src", "way"]).select(F.col("dst").alias("id"), "way").distinct()
        front = step.join(seen, ["id", "way"], "left_anti").checkpoint()
        if not filled(front):
            return seen
        seen, apart = seen.unionByName(front), apart + 1
        if apart == APART:
            seen, apart = seen.checkpoint(), 1


def pivot_component(live: DataFrame, watch: Callable[[str], None]) -> DataFrame | None:
    """id, component of the node with the most ways through it: what it leads to and what leads to it. None if no node has a way through."""
    out, into = (live.groupBy(F.col(c).alias("id")).agg(F.count("*").alias(n)) for c, n in (("src", "out"), ("dst", "into")))
    pivot = out.join(into, "id").orderBy(F.desc(F.col("out") * F.col("into")), "id").limit(1).select("id").checkpoint()
    top = pivot.first()
    if top is None:
        return None
    arcs = live.withColumn("way", F.lit(0)).unionByName(turned(live).withColumn("way", F.lit(1)))
    seen = spread(arcs, pivot.withColumn("way", F.explode(F.array(F.lit(0), F.lit(1)))), watch)
    both = seen.groupBy("id").agg(F.count("*").alias("n")).where("n = 2")
    return both.select("id", F.lit(top["id"]).cast(live.schema["src"].dataType).alias("component")).checkpoint()


def coloured_components(live: DataFrame, watch: Callable[[str], None]) -> DataFrame:
    """id, component (its pivot) of every component that has the least node of all that lead to it."""
    nodes = live.select(F.col("src").alias("id")).union(live.select(F.col("dst").alias("id"))).distinct()
    colour = nodes.withColumn("colour", F.col("id")).checkpoint()
    while True:
        watch("colour")
        pushed = live.join(colour, live.src == colour.id).groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("c"))
        step = settled(colour.join(pushed, "id", "left").select("id", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") < F.col("colour")).alias("moved")))
        colour = step.select("id", "colour")
        if not filled(step.where("moved")):
            break
    of = lambda key, name: colour.select(F.col("id").alias(key), F.col("colour").alias(name))
    inner = live.join(of("src", "way"), "src").join(of("dst", "b"), "dst").where("way = b")
    # backward within the colour
    found = spread(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "way"), colour.where("id = colour").select("id", F.col("colour").alias("way")), watch)
    return found.select("id", F.col("way").alias("component")).checkpoint()


def components(edges: DataFrame, rounds: int = 1, watch: Callable[[str], None] = lambda step: None) -> DataFrame:
    """id and component (least member) of every node in a strong component of two or more.

    Null ends, loops and repeated edges are left out; without a cycle the result is empty. ``rounds``
    of trimming come first. ``watch`` is told of every round (double, search, colour).
    """
    live = trimmed(clean_edges(edges), rounds)
    found = live.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    layers: list[Contraction] = []
    first = True
    while filled(live):
        nodes = live.select("src").distinct().count()
        again = True
        while again and nodes:
            again = False
            for turn in (False, True):
                done = contracted(turned(live) if turn else live, nodes, watch)
                if done is None:
                    continue
                layers.append(done[1])
                live, again = trimmed(turned(done[0]) if turn else done[0], 1), True
                nodes = live.select("src").distinct().count()
        if not nodes:
            break
        own = pivot_component(live, watch) if first else coloured_components(live, watch)
        if own is None:
            break
        first = False
        found = found.unionByName(own)
        gone = own.select("id")
        live = live.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        live = trimmed(live.select("src", "dst"), 1)
    for c in reversed(layers):
        found = undone(c, found)
    sizes = found.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    return found.join(sizes, "component").select("id", F.col("least").alias("component"))
