"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: each text's word shingles are hashed with XXH64 and each of 64 bits is put to the vote.

Links: two fingerprints within RADIUS bits agree on at least BLOCKS - RADIUS of BLOCKS blocks of
bits, so on some choice of two blocks. Every distinct fingerprint goes to the shard of each such
choice with the bits in it, and no link within the radius is lost. In a shard the fingerprints are
sorted by Gray rank, in which neighbours differ in few bits. Runs of neighbours become nodes; what
all fingerprints of a node share (a mask and the bits under it) is kept at the node, its children
keep only what they share beyond that, up to one root for each choice and bits. A search starts at
the root with its differences, adds those of each child's own mask, and drops a whole node once the
sum passes the radius. A shard sends on a spanning forest of its links, not the pairs, and a shard
that very many fingerprints share is dealt out first.

Components: large-star and small-star rounds over the forests, each round a table in the shared
folder, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ROW, dropped, joined_evenly, only, ship, stored, texts, with_row
from graphloom.llm.textbatch import CAPITAL, expand, flat, release, slices, words

WORDS, RADIUS, SEED = 4, 4, 42
#: Blocks of bits; two of them always agree within the radius. Children of a node.
BLOCKS, FAN = 6, 8
#: Search states held at once; fingerprints that a task takes together at least.
FRONTIER, BATCH = 1 << 19, 100_000
#: Fingerprints of a bucket from which on it is dealt out, and how many such buckets there can be at most.
HOT, HOT_BUCKETS = 1 << 17, 100_000


def shingles_of(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of the texts in a flat byte array, in order, and how many each text has."""
    data = data + np.where(CAPITAL[data], np.uint8(32), np.uint8(0))
    starts, ends, per = words(data, offsets)
    lens = ends - starts
    to = np.cumsum(lens + 1) - lens - 1  # words joined by one space each
    joined = np.full(int((lens + 1).sum()), 0x20, np.uint8)
    joined[expand(to, lens)] = data[expand(starts, lens)]
    raw = joined.tobytes()
    shingles = np.where(per > 0, np.maximum(per - k + 1, 1), 0)
    head = expand(np.cumsum(per) - per, shingles)
    tail = head + np.minimum(np.repeat(per, shingles), k) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(to[head].tolist(), (to[tail] + lens[tail]).tolist(), strict=True)), np.uint64, len(head))
    return hashes, shingles


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Unsigned fingerprints of the texts in a flat byte array."""
    hashes, shingles = shingles_of(data, offsets, k)
    out = np.zeros(len(shingles), np.uint64)
    filled = np.flatnonzero(shingles)
    if len(filled):
        first = (np.cumsum(shingles) - shingles)[filled]
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[filled] = np.packbits(2 * votes > shingles[filled, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id and fp (a signed long with the fingerprint's bits) of each row."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            fp = fingerprints_of(*flat(batch.column("text")), k)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Where each value stands in the Gray sequence."""
    out = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Fingerprints in buckets, as one tree a bucket.

    ``levels`` runs from the rows up to the roots; each level has first child, end of children,
    mask (bits shared within), pattern and own (the mask without the parent's).
    """

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        self.order = np.lexsort((gray_rank(fp), bucket))
        self.fp, bucket = fp[self.order], bucket[self.order]
        n = len(fp)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        level = {"bucket": bucket, "all": self.fp, "any": self.fp, "mask": np.full(n, full), "first": np.arange(n), "end": np.arange(1, n + 1), "last": np.arange(n)}
        self.levels = [level]
        while True:
            b = level["bucket"]
            m = len(b)
            head = np.append(True, b[1:] != b[:-1]) if m else np.zeros(0, bool)
            if head.all():
                break
            at = np.arange(m)
            within = at - np.maximum.accumulate(np.where(head, at, 0))
            first = np.flatnonzero(within % FAN == 0)
            end = np.append(first[1:], m)
            both, either = np.bitwise_and.reduceat(level["all"], first), np.bitwise_or.reduceat(level["any"], first)
            level = {"bucket": b[first], "all": both, "any": either, "mask": ~(both ^ either), "first": first, "end": end, "last": level["last"][end - 1]}
            self.levels.append(level)
        above = None
        for level in reversed(self.levels):
            if above is None:
                level["own"] = level["mask"]
            else:
                parent = np.repeat(np.arange(len(above["first"])), above["end"] - above["first"])
                level["own"] = level["mask"] & ~above["mask"][parent]
            above = level

    def pairs(self, radius: int = RADIUS, asking: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (as given) of all pairs in a bucket within the radius, in parts; with ``asking``, of these rows and any others."""
        top = len(self.levels) - 1
        if not len(self.fp):
            return
        root = self.levels[top]["bucket"]
        rows = np.arange(len(self.fp))
        self.once = asking is None
        if asking is not None:
            own = np.zeros(len(rows), bool)
            own[asking] = True
            rows = rows[own[self.order]]
        node = np.searchsorted(root, self.levels[0]["bucket"][rows])
        for a in range(0, len(rows), FRONTIER // 8):
            b = slice(a, a + FRONTIER // 8)
            yield from self._search(top, rows[b], node[b], self._added(top, rows[b], node[b]), radius)

    def _added(self, k: int, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        level = self.levels[k]
        return np.bitwise_count((self.fp[q] ^ level["all"][node]) & level["own"][node]).astype(np.int16)

    def _search(self, k: int, q: np.ndarray, node: np.ndarray, sums: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        live = sums <= radius
        if self.once:  # each pair once: the later row
            live &= self.levels[k]["last"][node] > q
        elif k == 0:
            live &= node != q
        q, node, sums = q[live], node[live], sums[live]
        if k == 0:
            if len(q):
                yield self.order[q], self.order[node]
            return
        level = self.levels[k]
        each = level["end"][node] - level["first"][node]
        ends = np.cumsum(each)
        at = 0
        while at < len(q):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FRONTIER, side="right")))
            n = each[at:to]
            child, who = expand(level["first"][node[at:to]], n), np.repeat(q[at:to], n)
            yield from self._search(k - 1, who, child, np.repeat(sums[at:to], n) + self._added(k - 1, who, child), radius)
            at = to


def connect(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining a[i] with b[i]; ``parent`` holds roots, the smallest number of each set."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def choices() -> list[tuple[int, int]]:
    """A mask for every choice of two blocks."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [(i, a | b) for i, (a, b) in enumerate(combinations(block, BLOCKS - RADIUS))]


def links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Spanning forests (a, b) of the links between distinct fingerprints (column fp, stored).

    A task reads its buckets one after the other and holds no more than BATCH fingerprints besides
    the bucket it is in. A bucket of more than ``hot`` fingerprints (and more than one in HOT_BUCKETS
    of all, so that the list of hot buckets is short enough to be broadcast) is dealt out: its
    fingerprints fall into groups by hash, and every two groups meet in a bucket of their own.
    """
    spark = distinct.sparkSession
    ship(spark)
    if radius > RADIUS:
        raise ValueError(f"the choices of blocks hold up to {RADIUS} bits")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in choices()])
    spread = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.choice", "key.bits")
    total = distinct.count()
    most = max(hot, -(-total * len(choices()) // HOT_BUCKETS))
    part = F.lit(0).cast("long")
    if total > most:  # else no bucket can be hot
        large = spread.groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > most).select("choice", "bits", F.ceil(F.col("n") / (most // 2)).alias("groups"))
        spread = spread.join(F.broadcast(large), ["choice", "bits"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("groups"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1), lambda j: F.least(own, j) * F.col("groups") + F.greatest(own, j))
        spread = spread.select("fp", "choice", "bits", F.explode(F.when(F.col("groups").isNull(), F.array(part)).otherwise(pairs)).alias("part"))
    else:
        spread = spread.withColumn("part", part)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["choice", "bits", "part"]

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows in whole_groups(batches, order, BATCH):
            fp = rows["fp"]
            head = np.append(True, np.any([rows[c][1:] != rows[c][:-1] for c in order], axis=0))
            bucket = np.cumsum(head) - 1
            many = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
            if not len(many):
                continue
            node, of = np.unique(fp[many], return_inverse=True)
            parent = np.arange(len(node))
            for a, b in GrayIndex(bucket[many], fp[many].view(np.uint64)).pairs(radius):
                parent = connect(parent, of[a], of[b])
            inner = np.flatnonzero(parent != np.arange(len(node)))
            for x in np.array_split(inner, len(inner) // 100_000 + 1):
                yield pa.record_batch([pa.array(node[x]), pa.array(node[parent[x]])], names=["a", "b"])

    return spread.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(shard, "a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted rows in parts of ``least`` rows or more (but the last) that end where a key ends."""
    held: list[dict[str, np.ndarray]] = []
    size, enough = 0, least
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({c: batch.column(c).to_numpy() for c in batch.schema.names})
        size += batch.num_rows
        if size < enough:
            continue
        rows = {c: np.concatenate([p[c] for p in held]) for c in held[0]}
        new = np.flatnonzero(np.any([rows[c][1:] != rows[c][:-1] for c in keys], axis=0)) + 1
        cut = int(new[-1]) if len(new) else 0  # the last key may go on
        if cut:
            yield {c: x[:cut] for c, x in rows.items()}
        held = [{c: x[cut:] for c, x in rows.items()}]
        size -= cut
        enough = max(least, 2 * size)
    if held:
        yield {c: np.concatenate([p[c] for p in held]) for c in held[0]}


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node of its component) for every node on an edge (a, b) but the roots themselves."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen, size = None, now.count()
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = joined_evenly(both, least, ["a"], "n", 2 * size).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.where("a <> b")
        small_least = lower.groupBy("a").agg(F.min("b").alias("m"))
        small = lower.join(small_least, "a").select(F.col("b").alias("v"), "m").where("v <> m").union(small_least.select(F.col("a").alias("v"), "m")).distinct()
        after = stored(small.select(F.col("v").alias("a"), F.col("m").alias("b")), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(now)
        now, size = after, state[0]
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, k: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    A text of fewer than ``k`` words is one shingle; null and empty texts and those of white space
    have fingerprint zero and link like any other. component_id is the smallest doc_id that links
    lead to, itself included; null doc_ids count as the largest (a component of nulls alone has a
    null id). Repeated rows give a row each, an empty table none; other columns are not read.
    """
    rows = stored(fingerprints(docs, k), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    by_fp = stored(joined_evenly(rooted, named, ["root"], "members", distinct.count()).select("fp", "component_id", "copies"), "by_fp")
    dropped(distinct)
    return joined_evenly(rows, by_fp, ["fp"], "copies", rows.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, k: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component stays, that with the smallest doc_id (one of equals), all columns.

    Null, empty and white texts have fingerprint zero and link like others; null doc_ids come last; of
    repeated rows one stays; an empty table gives an empty result; other columns are passed on.
    """
    numbered = with_row(docs)
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(f"{ROW}.file").alias("file"), F.col(f"{ROW}.at").alias("at"))
    rows = stored(fingerprints(numbered.select(who.alias("doc_id"), "text"), k).groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(rows.select("fp"), radius))
    kept = rows.join(roots, rows.fp == roots.node, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("who"))
    return only(numbered, kept.select(F.struct("who.file", "who.at").alias(ROW)))
