"""The Merkle manifest against a plain tree, with runs and blocks so small that trees cross them."""

import hashlib
import zlib

import pytest
from graphloom.llm import merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def levels(nodes):
    """All levels of a tree and, for each leaf, its siblings as (is left, digest), None where there is none."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            s = i ^ 1
            paths[k].append((s < i, nodes[s]) if s < len(nodes) else None)
            at[k] = i >> 1
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return nodes[0], paths


def fold(node, path):
    for step in path:
        node = h(node) if step is None else h(step[1], node) if step[0] else h(node, step[1])
    return node


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))) for g in order}
    built = {g: levels([leaf(r) for r in trees[g]]) for g in order}
    root, above = levels([built[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for r, path in zip(trees[g], built[g][1], strict=True):
            way = path + above[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            got = fold(leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r), way)
            out.append((r[0], leaf(r), built[g][0], root, h(*[s[1] for s in way if s]), got, got == root))
    return sorted(map(str, out))


ROWS = [
    *[(k, f"s{k % 3}", "en", 10 + k, f"text {k}") for k in range(0, 60, 2)],
    *[(k, None, None, None if k % 2 else k, None if k % 3 else "") for k in range(7)],
    (None, "s", "en", 3, "no id"),
    (5, "s", "é", 1, "alone in its group"),
    (9, "s", "z", 1, "repeated"),
    (9, "s", "z", 1, "repeated"),
    (9, "s", "z", 2, "same id, other text"),
    (70, "日本", "de", 100_000, "long text " * 10_000),
    (71, "x", "de", 2**62, "n_chars near the end"),
]


def got(docs, **more):
    return sorted(str(tuple(r)) for r in merkle.tampering_found(docs, **more).collect())


@pytest.mark.parametrize("run, span", [(3, 2), (merkle.RUN, merkle.SPAN)])
def test_trees_and_proofs(spark, run, span):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("grp", F.lit(1)).withColumn("leaf", F.lit("x")).repartition(3)
    assert got(docs, run=run, span=span) == plain(ROWS)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_sizes(spark, n):
    rows = [(k, "s", "en", 1, str(k)) for k in range(n)]
    assert got(spark.createDataFrame(rows, SCHEMA), run=2, span=2) == plain(rows)


def test_tampering_is_found(spark):
    rows = [(k, "s", "en", 1, str(k)) for k in range(50)]
    hit = {k for k in range(50) if zlib.crc32(str(k).encode()) % 7 == 0}
    assert hit
    assert {r["doc_id"] for r in merkle.tampering_found(spark.createDataFrame(rows, SCHEMA)).where("not verified").collect()} == hit


def test_empty_table(spark):
    assert merkle.tampering_found(spark.createDataFrame([], SCHEMA)).collect() == []


def test_proofs_fold_to_the_root(spark):
    rows = merkle.manifest(spark.createDataFrame(ROWS, SCHEMA), run=4, span=2)
    assert rows.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert rows.select("root").distinct().count() == 1
