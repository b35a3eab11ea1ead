"""Benchmark decontamination by SimHash over item-sized windows.

Texts and items become words (runs of letters, marks and digits of any script, lower case) and
shingles of SHINGLE words. A window as long as an item can be as similar as THRESHOLD only if most of
its shingles are the item's, so windows are formed where so many lie close together as the similarity
needs in common, and only there; a stem that thousands of items share is looked up once for each length
of item. Each window gets a
SimHash of 64 * LANES bits of its weighted shingles, from running sums of the votes. The items of the
same length stand in a multi-index: fingerprints are cut into BLOCKS blocks of 16 bits, each with its
buckets by value, and one within RADIUS bits has a block within RADIUS // BLOCKS bits of the window's,
so looking into each block's buckets at up to that many bits finds all of them (a random pair meets in
such a bucket with probability 0.16). What is found within RADIUS is verified by the exact weighted
similarity of the shingles (sum of the lesser weights over sum of the greater, a shingle's weight
being its number of occurrences) of THRESHOLD or more.

At similarity 0.8 fingerprints differ by 39 bits of 256 on average, with a deviation of 5.7; the
radius of 63 leaves out about one in a hundred thousand such windows, and none that are equal.

The benchmark is broadcast in blocks of at most ITEM_WORDS words, and the documents are scanned once
for each block, so its size is bounded whatever the benchmark's.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.common import ship, texts
from graphloom.llm.textbatch import expand, flat, release, slices

SHINGLE, THRESHOLD = 5, 0.8
#: Words of 64 bits in a fingerprint, bits within which candidates are searched, blocks of 16 bits.
LANES, RADIUS, BLOCKS = 4, 63, 16
ITEM_WORDS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[:128] = [chr(c).isalnum() for c in range(128)]


@cache
def _word_characters() -> np.ndarray:
    """Whether each code point is a letter, a mark on one, or a number."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), bool, 0x110000)


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 text belongs to a character of a word."""
    solid = _WORD[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return solid
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code = data[lead].astype(np.int64) & (0x7F >> size)
    for j in range(1, 4):
        own = np.minimum(lead + j, len(data) - 1)
        code = np.where(size > j, (code << 6) | (data[own] & 0x3F), code)
    inside = _word_characters()[np.minimum(code, 0x10FFFF)]
    for j in range(4):
        own = (size > j) & (lead + j < len(data))
        solid[lead[own] + j] = inside[own]
    return solid


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number modulo 2^64 and their inverses, as far as asked for."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m, full = len(self.up), 1 << 64
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.BASE, m, full))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.BASE, -m, full))])
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, in order, and the number of words of each text."""
    data, offsets = flat(pc.utf8_lower(column))
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = word_bytes(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _POWERS.get(n)
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX), np.diff(np.searchsorted(starts, offsets))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Of every ``k`` words in a row (those of a shorter array: none)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _MIX + words[j : j + n]
    return mixed(out)


def votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 * LANES bits of each shingle."""
    lanes = np.stack([mixed(shingles + step) for step in np.arange(LANES, dtype=np.uint64) * _MIX], axis=1)
    return np.unpackbits(lanes.view(np.uint8).reshape(len(shingles), -1), axis=1).astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, a row of LANES numbers each."""
    return np.packbits(sums > 0, axis=1).view(np.uint64).reshape(-1, LANES)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


@cache
def _flips(bits: int) -> np.ndarray:
    """All differences of at most ``bits`` of 16 bits."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= bits]


class MultiIndex:
    """Fingerprints in buckets by the value of each block of 16 bits.

    All within ``radius`` bits of a query have a block within radius // BLOCKS bits of the query's.
    A look-up goes through the flips of the query's block or through the occupied buckets, whichever
    are fewer, so its cost is bounded however many fingerprints there are.
    """

    def __init__(self, fps: np.ndarray, radius: int = RADIUS):
        self.fps, self.radius = fps, radius
        self.flips = _flips(radius // BLOCKS)
        self.buckets = []
        for b in range(BLOCKS):
            own = self._block(fps, b)
            order = np.argsort(own, kind="stable")
            value, first = np.unique(own[order], return_index=True)
            self.buckets.append((value, np.append(first, len(own)), order))

    @staticmethod
    def _block(fps: np.ndarray, b: int) -> np.ndarray:
        return (fps[:, b // 4] >> np.uint64(16 * (b % 4))).astype(np.uint16)

    def near_buckets(self, wanted: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(number in ``wanted``, bucket) of all buckets of a block within reach."""
        value = self.buckets[b][0]
        if len(value) <= len(self.flips):
            return np.nonzero(np.bitwise_count(wanted[:, None] ^ value[None, :]) <= self.radius // BLOCKS)
        probe = wanted[:, None] ^ self.flips[None, :]
        at = np.minimum(np.searchsorted(value, probe), len(value) - 1)
        who, flip = np.nonzero(value[at] == probe)
        return who, at[who, flip]

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) numbers of all pairs within the radius."""
        n, found = len(self.fps), [np.zeros(0, np.int64)]
        for b, (_, first, order) in enumerate(self.buckets):
            wanted, of = np.unique(self._block(queries, b), return_inverse=True)
            asks = np.argsort(of, kind="stable")
            starts = np.append(0, np.cumsum(np.bincount(of, minlength=len(wanted))))
            for a in range(0, len(wanted), 1024):
                who, bucket = self.near_buckets(wanted[a : a + 1024], b)
                who = who + a
                # each query with that value meets each fingerprint in the bucket
                held, asked = first[bucket + 1] - first[bucket], starts[who + 1] - starts[who]
                item = order[expand(first[bucket], held)]
                times = np.repeat(asked, held)
                query = asks[expand(np.repeat(starts[who], held), times)]
                item = np.repeat(item, times)
                near = distance(queries[query], self.fps[item]) <= self.radius
                found.append(query[near] * n + item[near])
        pair = np.unique(np.concatenate(found))
        return pair // max(1, n), pair % max(1, n)


class Items:
    """Benchmark items that are searched together: id and word hashes of each."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.words = [len(w) for _, w in items]
        self.k = [min(SHINGLE, n) for n in self.words]
        self.shingles = [shingle_hashes(w, k) for (_, w), k in zip(items, self.k, strict=True)]
        self.weights = [Counter(s.tolist()) for s in self.shingles]
        self.by_k: dict[int, tuple] = {}
        for k in set(self.k):
            # a shingle that many items share counts once for each length of item
            own = sorted({(s, self.words[i]) for i, x in enumerate(self.shingles) if self.k[i] == k for s in x.tolist()})
            keys, of = np.array([x for x, _ in own], np.uint64), np.array([n for _, n in own], np.int64)
            bits = max(16, 4 * len(keys)).bit_length() + 2
            sieve = np.zeros(1 << bits, bool)
            sieve[keys >> np.uint64(64 - bits)] = True
            self.by_k[k] = keys, of, sieve, np.uint64(64 - bits)
        self.fps = np.array([packed(votes(s).sum(0, keepdims=True))[0] for s in self.shingles], np.uint64).reshape(-1, LANES)
        self.index: dict[tuple, tuple[MultiIndex, list[int]]] = {}

    def hits(self, words: np.ndarray, per: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles that some item has, and their hashes; places are numbers of first words."""
        keys, _, sieve, shift = self.by_k[k]
        sh = shingle_hashes(words, k)
        if not len(sh):
            return np.zeros(0, np.int64), sh
        at = np.flatnonzero(sieve[sh >> shift])
        at = at[keys[np.minimum(np.searchsorted(keys, sh[at]), len(keys) - 1)] == sh[at]]
        ends = np.cumsum(per)
        doc = np.searchsorted(ends, at, side="right")
        return at[at + k <= ends[doc]], sh

    def same_size(self, k: int, n: int) -> tuple[MultiIndex, list[int]]:
        if (k, n) not in self.index:
            own = [i for i in range(len(self.ids)) if self.k[i] == k and self.words[i] == n]
            self.index[k, n] = MultiIndex(self.fps[own]), own
        return self.index[k, n]

    def search(self, words: np.ndarray, per: np.ndarray, threshold: float) -> Iterator[tuple[int, object, float, int, int]]:
        """(text, item, similarity, first word, words) of the best window of each pair over the threshold."""
        ends = np.cumsum(per)
        for k in self.by_k:
            at, sh = self.hits(words, per, k)
            if not len(at):
                continue
            keys, of, _, _ = self.by_k[k]
            lo, hi = np.searchsorted(keys, sh[at], "left"), np.searchsorted(keys, sh[at], "right")
            place, length = np.repeat(at, hi - lo), of[expand(lo, hi - lo)]
            doc = np.searchsorted(ends, place, side="right")
            order = np.lexsort((place, length, doc))
            place, length, doc = place[order], length[order], doc[order]
            head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (length[1:] != length[:-1])))
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(place)], strict=True):
                d = int(doc[a])
                yield from self._windows(d, int(ends[d] - per[d]), int(ends[d]), int(length[a]), k, place[a:b], sh, threshold)

    def _windows(self, d: int, first: int, end: int, n: int, k: int, places: np.ndarray, sh: np.ndarray, threshold: float):
        """The best windows of a text for items of ``n`` words: ``places`` (ascending) are those of shingles that such an item has.

        Only windows are formed in which so many places lie as the similarity needs in common at least,
        so a stem that many items share forms none by itself.
        """
        size = min(n, end - first) - k + 1  # shingles of a window; a shorter text is one window
        if size <= 0:
            return
        need = max(1, int(np.ceil(threshold * (size + n - k + 1) / (1 + threshold) - 1e-9)))
        if len(places) < need:
            return
        index, own = self.same_size(k, n)
        best: dict[int, tuple[float, int]] = {}
        # from the need-th place on, the window that ends there or later begins early enough to hold need places
        spread = places[need - 1 :] - places[: len(places) - need + 1]
        near = np.flatnonzero(spread < size)
        a = 0
        while a < len(near):  # places whose windows touch are taken together
            b = a
            while b + 1 < len(near) and places[near[b + 1]] - places[near[b]] < 2 * size and places[near[b + 1]] - places[near[a]] < 4096:
                b += 1
            lo, hi = max(first, int(places[near[a] + need - 1]) - size + 1), min(end - k + 1 - size, int(places[near[b]]))
            a = b + 1
            if hi < lo:
                continue
            starts = np.arange(lo, hi + 1)
            full = np.flatnonzero(np.searchsorted(places, starts + size) - np.searchsorted(places, starts) >= need)
            if not len(full):
                continue
            own_sh = sh[lo : hi + size]
            running = np.concatenate([np.zeros((1, 64 * LANES), np.int32), np.cumsum(votes(own_sh), axis=0, dtype=np.int32)])
            q, f = index.search(packed(running[full + size] - running[full]))
            if not len(q):
                continue
            q = full[q]
            member = {}
            for j in set(f.tolist()):
                member[j] = np.append(0, np.cumsum(np.isin(own_sh, np.unique(self.shingles[own[j]]))))
            for w, j in zip(q.tolist(), f.tolist(), strict=True):
                total = len(self.shingles[own[j]])
                shared = int(member[j][w + size] - member[j][w])  # at least the common weight
                if shared < best.get(j, (threshold, 0))[0] * (size + total) / (1 + best.get(j, (threshold, 0))[0]) - 1e-9:
                    continue
                weights, mine = self.weights[own[j]], Counter(own_sh[w : w + size].tolist())
                common = sum(min(c, mine[s]) for s, c in weights.items())
                similarity = common / (size + total - common)
                if similarity >= threshold and similarity > best.get(j, (-1.0, 0))[0]:
                    best[j] = similarity, lo + w - first
        for j, (similarity, at) in best.items():
            yield d, self.ids[own[j]], similarity, at, size + k - 1


def item_blocks(benchmark: DataFrame, most: int = ITEM_WORDS) -> Iterator[Items]:
    """The items in blocks of at most ``most`` words (one item at least), read one partition at a time."""
    held: list[tuple[object, np.ndarray]] = []
    size = 0
    for row in benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        words, _ = word_hashes(pa.array([row["text"]]))
        if not len(words):
            continue
        if held and size + len(words) > most:
            yield Items(held)
            held, size = [], 0
        held.append((row["item_id"], words))
        size += len(words)
    if held:
        yield Items(held)


def _runner(shared, threshold: float, item: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            words, per = word_hashes(batch.column("text"))
            got = list(shared.value.search(words, per, threshold))
            ids = batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
            cols = [pa.array([g[j] for g in got], t) for j, t in ((1, item), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
            yield pa.record_batch([ids, *cols], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item with a window over the threshold: doc_id, item_id, similarity, start_word, n_words.

    The window given is the most similar one, the first of equals. A text shorter than an item is
    one window. Items of fewer than SHINGLE words are one shingle; null, empty and wordless texts
    and items match nothing. Repeated rows give rows each; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item.simpleString()}, similarity double, start_word long, n_words long"
    parts = [texts(docs).mapInArrow(_runner(spark.sparkContext.broadcast(x), threshold, to_arrow_type(item)), schema) for x in item_blocks(benchmark)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns; each row is decided where it is read.

    Rows with null, empty or wordless texts stay, and so do all rows if the benchmark is empty;
    repeated rows are decided alike; ids and other columns are only passed on; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    for items in item_blocks(benchmark):
        docs = docs.mapInArrow(_keeper(spark.sparkContext.broadcast(items), threshold), docs.schema)
    return docs


def _keeper(shared, threshold: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            clean = np.ones(batch.num_rows, bool)
            clean[[g[0] for g in shared.value.search(*word_hashes(pc.fill_null(batch.column("text"), "")), threshold)]] = False
            yield batch.filter(pa.array(clean))

    return keep
