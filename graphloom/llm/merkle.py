"""Merkle manifest of a table: a digest of every row, a tree for each group of rows, a tree over the groups, proofs.

Leaves are range-sorted by group and key into partitions of about RUN rows, whose order and numbers a
checkpoint fixes. Each partition counts its rows of each group; the counts of the partitions before
give a partition its offset in the group that it begins with, and so every leaf its place in the
group's tree (coordinates: group, level, index). Each partition builds the largest aligned subtrees
that lie wholly inside it, of which a run of n leaves has at most 2 log2(n). Only the tops of these
are dealt out, by coordinate, in blocks that span SPAN levels, until each group has one node. The tops
of the groups are the leaves of one more tree, built alike.

For proofs a partition builds its subtrees again and asks for the nodes at its two edges, four a level
at most; all other siblings are its own. So neither leaves nor proofs are shuffled by node, a large
group is in many partitions, and no task sees more than its run or a block of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from graphloom.llm.common import shared_dir, ship, stored

#: Rows in a partition at most (about), and at least where there are fewer partitions than the session asks for; levels in a block.
RUN, LEAST, SPAN = 200_000, 1_000, 16


def joined(*digests: str) -> str:
    """The digest of nodes, left to right."""
    return sha256("".join(digests).encode()).hexdigest()


def field(column: Column) -> Column:
    """A value as a leaf has it: ``-`` for null, else the number of its bytes in UTF-8, a colon and the value."""
    said = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest of a row: SHA-256 (lowercase hex) of its fields one after the other."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length()


def tops(start: int, digests: list[str]) -> list[tuple[int, int, str]]:
    """(level, index, digest) of the largest aligned subtrees over the leaves from place ``start`` on."""
    out, level = [], 0
    while digests:
        if start & 1:
            out.append((level, start, digests[0]))
            start, digests = start + 1, digests[1:]
        if len(digests) & 1:
            out.append((level, start + len(digests) - 1, digests[-1]))
        digests = [joined(*digests[k : k + 2]) for k in range(0, len(digests) - 1, 2)]
        start, level = start >> 1, level + 1
    return out


def run_proofs(leaves: list[str], start: int, total: int, known: dict[tuple[int, int], str]) -> list[list[str]]:
    """For each leaf of a run its siblings, level by level: ``l`` or ``r`` for the side and the digest; empty where there is none.

    ``known`` has the nodes (level, index) at the run's edges that are not wholly inside it.
    """
    last, here, at, levels = start + len(leaves) - 1, leaves, start, []
    for level in range(height(total)):
        nodes, first, steps = ((total - 1) >> level) + 1, start >> level, []
        for i in range(first, (last >> level) + 1):
            s = i ^ 1
            side = "" if s >= nodes else ("l" if s < i else "r") + (here[s - at] if at <= s < at + len(here) else known[level, s])
            steps.append(side)
        levels.append((first, steps))
        odd = at & 1
        here, at = [joined(here[k], here[k + 1]) for k in range(odd, len(here) - 1, 2)], (at + odd) >> 1
    return [[steps[(i >> level) - first] for level, (first, steps) in enumerate(levels)] for i in range(start, last + 1)]


@dataclass
class Forest:
    """The trees of all groups: sorted leaves, runs of a group in a partition, nodes outside runs, the top of each group."""

    leaves: DataFrame
    runs: DataFrame
    nodes: DataFrame
    tops: DataFrame


def ranged(leaves: DataFrame, run: int) -> DataFrame:
    """``leaves`` sorted by group, key and digest over partitions, with ``pid`` (partition) and ``at`` (place); fixed by a checkpoint."""
    spark = leaves.sparkSession
    shared_dir(spark)
    n, usual = leaves.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(1, -(-n // run), min(usual, -(-n // LEAST)))
    # the last key splits rows that are repeated so often that they fill partitions
    order = [F.col(c).asc_nulls_first() for c in ("grp", "key", "leaf", "tie")]
    dealt = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return dealt.drop("tie").withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).checkpoint()


def with_group(rows: DataFrame, other: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """``rows`` joined by group (a null group equals itself) and ``columns`` with ``other``, whose keys go."""
    other = other.withColumnsRenamed({c: f"other_{c}" for c in ("grp", *columns)})
    cond = F.col("grp").eqNullSafe(F.col("other_grp"))
    for c in columns:
        cond = cond & (F.col(c) == F.col(f"other_{c}"))
    return rows.join(other, cond, how).drop("other_grp", *[f"other_{c}" for c in columns])


def forest(leaves: DataFrame, run: int = RUN, span: int = SPAN) -> Forest:
    """The trees over ``leaves`` (grp, key, leaf and any others), leaves of a group in order of key, then digest, nulls first."""
    ship(leaves.sparkSession)
    kind = leaves.schema["grp"].dataType.simpleString()
    leaves = ranged(leaves, run)
    by_group = Window.partitionBy("grp")
    counts = leaves.groupBy("pid", "grp").agg(F.count("*").alias("n"))
    runs = stored(counts.withColumns({"start": F.sum("n").over(by_group.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"), "total": F.sum("n").over(by_group)}), "runs")
    sizes = runs.where("start = 0").select("grp", "total")
    # a partition's first group alone can have begun before it: one row a partition at most
    begun = F.broadcast(runs.where("start > 0").select("pid", "grp", "start"))
    placed = with_group(leaves.select("pid", "grp", "leaf"), begun, "pid", how="left").select("grp", F.coalesce("start", F.lit(0)).alias("start"), "leaf")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, held = None, 0, []

        def rows() -> Iterator[pa.RecordBatch]:
            found = tops(start, held)
            if found:
                level, index, digest = zip(*found, strict=True)
                yield pa.record_batch([pa.array([now] * len(found), grp_type), pa.array(level, pa.int32()), pa.array(index, pa.int64()), pa.array(digest)], names=["grp", "level", "idx", "digest"])

        grp_type = None
        for batch in batches:
            grp_type = batch.schema.field("grp").type
            for g, s, d in zip(*[batch.column(c).to_pylist() for c in ("grp", "start", "leaf")], strict=True):
                if held and g != now:
                    yield from rows()
                    held = []
                if not held:
                    now, start = g, s
                held.append(d)
        yield from rows()

    edges = placed.mapInArrow(local, f"grp {kind}, level int, idx long, digest string")
    nodes = stored(with_group(edges, sizes), "nodes")
    most = sizes.agg(F.max("total")).first()[0] or 0
    every = live = nodes
    for to in range(span, height(most) + span if most > 1 else 0, span):
        block = F.expr(f"shiftright(idx, {to} - level)")
        low = live.where(F.col("level") < to).withColumn("block", block)
        built = stored(low.groupBy("grp", "block").applyInArrow(upwards(to), nodes.schema), "nodes")
        every = every.unionByName(built)
        live = live.where(F.col("level") >= to).unionByName(built.where(F.col("level") == to))
    heights = sizes.withColumn("h", F.when(F.col("total") > 1, F.length(F.bin(F.col("total") - 1))).otherwise(0))
    ends = with_group(every.where("idx = 0").drop("total"), heights).where("level = h").select("grp", "h", F.col("digest").alias("top"))
    return Forest(leaves, runs, every, stored(ends, "tops"))


def upwards(to: int):
    """The function that builds, from the nodes of a block of a group, all nodes above them up to level ``to``."""

    def up(table: pa.Table) -> pa.Table:
        total, grp = table.column("total")[0].as_py(), table.column("grp")[0]
        by_level: dict[int, dict[int, str]] = {}
        for level, idx, digest in zip(*[table.column(c).to_pylist() for c in ("level", "idx", "digest")], strict=True):
            by_level.setdefault(level, {})[idx] = digest
        out = []
        for level in range(min(by_level), to):
            here = by_level.get(level, {})
            if (total - 1) >> level == 0:
                break
            above = by_level.setdefault(level + 1, {})
            for i in here:
                if not i & 1:
                    above[i >> 1] = joined(here[i], here[i + 1]) if i < (total - 1) >> level else joined(here[i])
                    out.append((level + 1, i >> 1, above[i >> 1]))
        level, idx, digest = zip(*out, strict=True) if out else ((), (), ())
        columns = {"grp": pa.array([grp.as_py()] * len(out), table.schema.field("grp").type), "level": pa.array(level, pa.int32()), "idx": pa.array(idx, pa.int64()), "digest": pa.array(digest, pa.string()), "total": pa.array([total] * len(out), pa.int64())}
        return pa.table(columns)

    return up


def proved(trees: Forest, above: DataFrame | None = None) -> DataFrame:
    """The leaves with ``top`` (of their group) and ``proof``: siblings as in ``run_proofs``, then those of ``above`` (grp, root, path) if given.

    With ``above`` there is ``root`` too.
    """
    runs = with_group(trees.runs, trees.tops)
    if above is None:
        runs = runs.withColumns({"root": F.lit(None).cast("string"), "path": F.array().cast("array<string>")})
    else:
        runs = with_group(runs, above)
    level = runs.where("h > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    first, last = F.expr("shiftright(start, level)"), F.expr("shiftright(start + n - 1, level)")
    edges = level.select("pid", "grp", "level", F.explode(F.array_distinct(F.array(first, first.bitwiseXOR(F.lit(1)), last, last.bitwiseXOR(F.lit(1))))).alias("idx"))
    nodes = trees.nodes.select("grp", "level", "idx", "digest")
    given = with_group(edges, nodes, "level", "idx").groupBy("pid", "grp").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("edge"))
    runs = with_group(runs, given, "pid", how="left").select("pid", "grp", "start", "total", "top", "root", "path", "edge")

    def prove(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        grp, leaves = rows.column("grp").to_pylist(), rows.column("leaf").to_pylist()
        by_group = {r["grp"]: r for r in own.to_pylist()}
        proof, top, root, at = [], [], [], 0
        while at < len(grp):
            to = at + 1
            while to < len(grp) and grp[to] == grp[at]:
                to += 1
            r = by_group[grp[at]]
            known = {(e["level"], e["idx"]): e["digest"] for e in r["edge"] or ()}
            proof += [p + r["path"] for p in run_proofs(leaves[at:to], r["start"], r["total"], known)]
            top += [r["top"]] * (to - at)
            root += [r["root"]] * (to - at)
            at = to
        kept = rows.drop_columns(["pid", "at"])
        for name, values, kind in (("top", top, pa.string()), ("root", root, pa.string()), ("proof", proof, pa.list_(pa.string()))):
            kept = kept.append_column(name, pa.array(values, kind))
        return kept

    schema = trees.leaves.drop("pid", "at").schema.add("top", "string").add("root", "string").add("proof", ArrayType(StringType()))
    return trees.leaves.groupBy("pid").cogroup(runs.groupBy("pid")).applyInArrow(prove, schema)


def proofs(leaves: DataFrame, run: int = RUN, span: int = SPAN) -> DataFrame:
    """``leaves`` (grp, key, leaf and any others) with top, root and proof: a tree a group, and one over the groups' tops in order of grp, null first."""
    trees = forest(leaves, run, span)
    kind = leaves.schema["grp"].dataType
    upper = proved(forest(trees.tops.select(F.lit(0).alias("grp"), F.col("grp").alias("key"), F.col("top").alias("leaf")), run, span))
    above = stored(upper.select(F.col("key").cast(kind).alias("grp"), F.col("top").alias("root"), F.col("proof").alias("path")), "above")
    return proved(trees, above)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""

    def step(node: Column, s: Column) -> Column:
        other = F.substring(s, 2, 64)
        return F.sha2(F.when(s == "", node).when(F.startswith(s, F.lit("l")), F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(proof, start, step)


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), more: dict[str, Column] | None = None, run: int = RUN, span: int = SPAN) -> DataFrame:
    """One row per row of ``docs``: key, leaf, subroot (of its group), root (of all), proof, and the columns of ``more``.

    A leaf is the digest of ``fields``; null and empty differ. The leaves of a group are in order of
    key (null first), then of digest, so ties and repeated rows have a defined place; a null group is
    a group, the first one. An empty table gives an empty result, other columns are not read, texts
    are read whole. ``proof`` lists the sibling digests from the leaf's to the root's, each after ``l``
    or ``r`` for its side, an empty string where a node stands alone.
    """
    extra = F.struct(*[c.alias(name) for name, c in (more or {"none": F.lit(0)}).items()])
    leaves = stored(docs.select(F.col(group).alias("grp"), F.col(key).alias("key"), leaf(*[F.col(c) for c in fields]).alias("leaf"), extra.alias("more")), "leaves")
    out = proofs(leaves, run, span)
    return out.select(F.col("key").alias(key), "leaf", F.col("top").alias("subroot"), "root", "proof", *[F.col("more")[name].alias(name) for name in more or ()])


def tampering_found(docs: DataFrame, run: int = RUN, span: int = SPAN) -> DataFrame:
    """The manifest of ``docs`` checked against a copy in which some rows have one added to n_chars.

    Those are the rows whose doc_id in decimal has a CRC-32 that 7 divides; a null doc_id or n_chars
    stays as it is. Columns: doc_id, leaf, subroot, root, proof_sha256 (digest of all siblings in
    order), folded_root (what the copy's leaf and the proof give), verified (that it is the root).
    Odd input is as in ``manifest``.
    """
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    forged = F.when(hit, leaf(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    rows = manifest(docs, more={"forged": forged}, run=run, span=span)
    siblings = F.transform(F.filter("proof", lambda s: s != ""), lambda s: F.substring(s, 2, 64))
    out = rows.withColumns({"proof_sha256": F.sha2(F.array_join(siblings, ""), 256), "folded_root": folded(F.coalesce("forged", "leaf"), F.col("proof"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
