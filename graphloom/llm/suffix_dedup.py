"""Suffix-array dedup: bytes covered by a string of SPAN bytes that also starts anywhere else go.

Routing. Every window of SPAN bytes chooses an anchor: the GRAM bytes in it with the least hash, the
first of equals. Equal windows have equal anchors at equal places, so only windows with the same
anchor can be equal. The windows of one place that chose the same anchor make a segment of text.
Equal segments are counted by digest, first within each task and then over all: every window of a
segment that occurs twice is repeated, whatever the number of copies. Segments count as equal if two
hashes of 64 bits agree, which are not compared with the bytes: the polynomial one, which covers the
anchor's GRAM bytes only, and the XXH64 of the whole segment, seeded with its length and the anchor's
place, on which the bytes beside the anchor rest alone. Of segments with a common
anchor but different text, one copy of each goes to the anchor's shard, since parts of it may be
equal. All other segments hold no repeated window. In the shard a segment is cut to the windows that
can be equal to another's: KERNELS groups of them, by the bytes before the anchor, each have a string
in common, a little shorter than SPAN, which must stand in another segment at that place too.

Sorting. A shard's segments are one text with separators, whose suffixes are sorted by external
induced sorting (``suffix_sort``). Two neighbours with a common prefix of SPAN bytes or more are
repeated windows; the segments' own windows never overlap, so each is another place.

What was found goes back to all places of a segment, and each document's spans are joined and cut out.

Passages of words are found the same way in a text of which every word is written as CODE bytes of its
hash, one after the other: a string of CODE * n bytes that starts anywhere else stands for n words that
stand in that order elsewhere, whatever the white space between them (a word beside a passage counts as
shared with a chance of one in 255 ** CODE).
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ROW, dropped, joined_evenly, ship, stored, swept, with_row
from graphloom.llm.decontam import _MIX, _POWERS, mixed
from graphloom.llm.suffix_sort import Scratch, sorted_suffixes
from graphloom.llm.textbatch import binary, flat, release, slices, words

SPAN, GRAM = 400, 200
#: Words of a passage, and bytes that stand for a word where passages are searched.
PASSAGE, CODE = 51, 2
#: Tuples that a sorting task holds in memory, and names that it sorts there.
MEMORY, NAMES = 1 << 23, 1 << 22
_PIECE = 1 << 23
#: Bytes of text whose segments are found at once.
PLACE_BYTES = 1 << 20
#: Files of a table whose names are broadcast at most.
FILES = 50_000
_PLACE = np.uint64((1 << 24) - 1)


def segments(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text number, start in it, place of the anchor, length, anchor hash and digest of every segment."""
    out = []
    for a in range(0, max(1, len(data) - span + 1), _PIECE):
        out.append(_segments(data[a : a + _PIECE + span - 1], offsets - a, span, gram))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _segments(data: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    if n < span:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    up, down = _POWERS.get(n)
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up))
    hashes = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    least, width, step = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), span - gram + 1, 1
    while 2 * step <= width:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    if step < width:
        least = np.minimum(least[: step - width], least[width - step :])
    inside = np.zeros(len(least) + 1, np.int64)  # windows that end in their text
    first, last = np.clip(offsets[:-1], 0, len(least)), np.clip(offsets[1:] - span + 1, 0, len(least))
    whole = last > first
    np.add.at(inside, first[whole], 1)
    np.add.at(inside, last[whole], -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(window):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    place = (least[window] & _PLACE).astype(np.int64)
    head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)))
    start, end = window[head], window[np.append(head[1:], len(window)) - 1] + span
    raw = data.tobytes()
    xxh64 = xxhash.xxh64_intdigest
    seed = (((place[head] - start) << _BITS) | (end - start)).tolist()
    digest = np.fromiter((xxh64(raw[a:b], c) for a, b, c in zip(start.tolist(), end.tolist(), seed, strict=True)), np.uint64, len(start))
    text = np.searchsorted(offsets, start, side="right") - 1
    return text, start - offsets[text], place[head] - start, end - start, hashes[place[head]], digest


PLACES = "row long, at long, anchor long, digest long"
#: In ``at``: the segment's start, the anchor's place in it and its length, the last two in so many bits.
_BITS = 12
#: An anchor with more different segments than this is dealt out by the bytes beside it.
CROWD = 256
#: Groups of a segment's windows that are told apart before the sort.
KERNELS = 16


def places(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """Every segment: row, at (start, anchor's place and length in one number), anchor, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text", PLACE_BYTES):
            text, start, place, length, anchor, digest = segments(*flat(batch.column("text")), span, gram)
            row = batch.column("row").take(pa.array(text))
            yield pa.record_batch([row, pa.array((start << 2 * _BITS) | (place << _BITS) | length), pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64))], names=["row", "at", "anchor", "digest"])

    return docs.mapInArrow(run, PLACES)


def counted(found: DataFrame) -> DataFrame:
    """Rows of (anchor, digest, n, row, at): copies in a task are counted before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row, at, anchor, digest = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("row", "at", "anchor", "digest"))
            order = np.lexsort((at, row, digest, anchor))
            a, d = anchor[order], digest[order]
            head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])))
            own = order[head]
            n = np.diff(np.append(head, len(order)))
            return pa.record_batch([pa.array(x) for x in (anchor[own], digest[own], n, row[own], at[own])], names=["anchor", "digest", "n", "row", "at"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 200_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return found.mapInArrow(run, "anchor long, digest long, n long, row long, at long")


def repeated_in(texts: Iterable[bytes], span: int = SPAN, memory: int = MEMORY, names: int = NAMES) -> list[list[tuple[int, int]]]:
    """For each text the spans covered by strings of ``span`` bytes that start at another place of these texts too.

    The texts go to a file as they come; it is read whole only if it is no longer than ``memory``.
    """
    scratch = Scratch(memory)
    try:
        name, sizes = scratch.path(), []
        with open(name, "wb") as f:
            for t in texts:
                f.write((np.frombuffer(t, np.uint8) + np.uint8(1)).tobytes())  # UTF-8 has no byte 255; 0 separates
                f.write(b"\0")
                sizes.append(len(t))
        size = np.array(sizes, np.int64)
        first = np.cumsum(size + 1) - size - 1
        total = int((size + 1).sum())
        if not total:
            return []
        text = np.fromfile(name, np.uint8) if total <= memory else np.memmap(name, np.uint8, "r")
        repeated = scratch.array(total, np.bool_)
        last = -1
        for pos, lcp in sorted_suffixes(text, span, scratch, names):
            same = np.flatnonzero(lcp >= span)
            repeated[pos[same]] = True
            before = np.append(last, pos[:-1])[same]
            repeated[before[before >= 0]] = True
            last = int(pos[-1])
        out = []
        for a, n in zip(first.tolist(), size.tolist(), strict=True):
            hit = np.flatnonzero(repeated[a : a + max(0, n - span + 1)])
            whole = len(hit) and hit[-1] - hit[0] <= span  # one run, as in all segments
            out.append([(int(hit[0]), int(hit[-1]) + span)] if whole else joined(hit, hit + span))
        return out
    finally:
        scratch.close()


def joined(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return list(zip(start[head].tolist(), end[np.append(head[1:], len(start)) - 1].tolist(), strict=True))


def kernels(data: np.ndarray, offsets: np.ndarray, place: np.ndarray, span: int, gram: int) -> np.ndarray:
    """For each segment, a row of hashes of the bytes that its windows of KERNELS groups have in common; 0 for no window.

    A group has the windows whose bytes before the anchor are of about the same number. Each of them
    holds the bytes from the fewest before the anchor to the fewest behind it, so equal windows have
    equal hashes.
    """
    low, high, before, behind = grouped(np.diff(offsets), place, span, gram)
    up, down = _POWERS.get(len(data))
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up))
    at = (offsets[:-1] + place)[:, None]
    there = low <= high
    start, end = np.where(there, at - before, 0), np.where(there, at + gram + behind, 0)
    value = mixed((sums[end] - sums[start]) * down[np.minimum(start, len(data) - 1)] + np.arange(len(before)).astype(np.uint64) * _MIX)
    return np.where(there, np.maximum(value, np.uint64(1)), np.uint64(0))


def grouped(size: np.ndarray, place: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each segment's windows of each group (first > last: none), and the group's fewest bytes before and behind the anchor."""
    step = -(-(span - gram + 1) // KERNELS)
    before = np.arange(0, span - gram + 1, step)
    most = np.minimum(before + step - 1, span - gram)
    low = np.maximum(place[:, None] - most, 0)
    high = np.minimum(place[:, None] - before, (size - span)[:, None])
    return low, high, before, span - gram - most


def shared_windows(size: np.ndarray, place: np.ndarray, kernel: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows of each segment in groups whose hash another segment has too (first > last: none)."""
    low, high, _, _ = grouped(size, place, span, gram)
    _, which, copies = np.unique(kernel, return_inverse=True, return_counts=True)
    shared = (copies[which].reshape(kernel.shape) > 1) & (kernel != 0)
    return np.where(shared, low, span).min(axis=1), np.where(shared, high, -1).max(axis=1)


def shared_parts(wanted: DataFrame, span: int, gram: int) -> DataFrame:
    """(anchor, digest, spans) of the segments (anchor, digest, place, bytes) of each shard.

    Of a segment only the windows go to the sort whose group has the same hash in another segment
    of the shard; no other window can be equal to one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own: dict[tuple[int, int], None] = {}  # in order; both sides of a crowded segment may be here
        size, place, kernel = [], [], []
        with tempfile.TemporaryFile() as held:
            for batch in slices(batches, "bytes", PLACE_BYTES):
                fresh = []
                for k, key in enumerate(zip(batch.column("anchor").to_pylist(), batch.column("digest").to_pylist(), strict=True)):
                    if key not in own:
                        own[key] = None
                        fresh.append(k)
                if not fresh:
                    continue
                batch = batch.take(pa.array(fresh))
                data, offsets = flat(batch.column("bytes"))
                held.write(data)
                size.append(np.diff(offsets))
                place.append(batch.column("place").to_numpy().astype(np.int64))
                kernel.append(kernels(data, offsets, place[-1], span, gram))
            if not own:
                return
            size = np.concatenate(size)
            first, last = shared_windows(size, np.concatenate(place), np.concatenate(kernel), span, gram)
            hit = np.flatnonzero(first <= last)

            def texts() -> Iterator[bytes]:
                at = np.cumsum(size) - size + first
                for k in hit.tolist():
                    held.seek(int(at[k]))
                    yield held.read(int(last[k] - first[k]) + span)

            spans = repeated_in(texts(), span)
        anchor, digest = np.array(list(own), np.int64).T
        some = [k for k, s in enumerate(spans) if s]
        hit = hit[some]
        rows = pa.array([[{"start": a + own, "end": b + own} for a, b in spans[k]] for k, own in zip(some, first[hit].tolist(), strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.record_batch([pa.array(anchor[hit]), pa.array(digest[hit]), rows], names=["anchor", "digest", "spans"])

    return wanted.mapInArrow(run, "anchor long, digest long, spans array<struct<start:long,end:long>>")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and row, a number for each row that is the same at every reading."""
    spark = docs.sparkSession
    named = with_row(docs, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    files = sorted(r[0] for r in named.select(f"{ROW}.file").distinct().limit(FILES + 1).collect())
    if len(files) > FILES:  # too many names to broadcast: the rows are stored once, numbered
        return stored(named.drop(ROW).withColumn("row", F.monotonically_increasing_id()), "numbered")
    table = spark.createDataFrame([(f, k) for k, f in enumerate(files)], "file string, k long")
    return named.join(F.broadcast(table), named[ROW]["file"] == table["file"]).select("doc_id", "text", (F.shiftleft("k", 38) + F.col(f"{ROW}.at")).alias("row"))


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """row and spans (array of start, end in bytes, unordered, may overlap) of each numbered row that has any."""
    spark = docs.sparkSession
    ship(spark)
    found = stored(places(docs.select("row", "text"), span, gram), "places")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # counts by task, then over all; both groupings keep the partitioning by anchor
    groups = counted(found).repartition(parts, "anchor").groupBy("anchor", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("row", "at")).alias("who"))
    own = Window.partitionBy("anchor")
    groups = groups.select("anchor", "digest", "n", "who.*", F.count("*").over(own).alias("kinds"), F.min("n").over(own).alias("fewest"))
    # a lone segment of its anchor that occurs once shares nothing; where all kinds repeat, they are known as they stand
    groups = stored(groups.where("n > 1 or (kinds > 1 and fewest = 1)"), "groups")
    cut = groups.where("kinds > 1 and fewest = 1").groupBy("row").agg(F.collect_list(F.struct("anchor", "digest", "at", (F.col("kinds") > crowd).alias("crowded"))).alias("cut"))
    low = (1 << _BITS) - 1
    fetched = docs.select("row", "text").join(cut, "row").select(F.col("text").cast("binary").alias("bytes"), F.explode("cut").alias("s"))
    fetched = fetched.select("s.anchor", "s.digest", "s.crowded", F.expr(f"cast(shiftright(s.at, {_BITS}) & {low} as int)").alias("place"), F.expr(f"substring(bytes, cast(shiftright(s.at, {2 * _BITS}) as int) + 1, cast(s.at & {low} as int))").alias("bytes"))
    # a window has half of what the anchor leaves on one side of it at least: equal windows share that side's bytes
    half = (span - gram) // 2
    left = F.when(F.col("place") >= half, F.xxhash64(F.lit("left"), "anchor", F.expr(f"substring(bytes, place + 1 - {half}, {half})")))
    right = F.when(F.octet_length("bytes") >= F.col("place") + gram + half, F.xxhash64(F.lit("right"), "anchor", F.expr(f"substring(bytes, place + {gram} + 1, {half})")))
    shards = F.when(F.col("crowded"), F.array_compact(F.array(left, right))).otherwise(F.array(F.xxhash64("anchor")))
    dealt = fetched.select("anchor", "digest", "place", "bytes", F.explode(shards).alias("shard"))
    partly = shared_parts(dealt.repartition(parts, "shard"), span, gram).groupBy("anchor", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    whole = groups.where("n > 1").select("anchor", "digest", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("at").bitwiseAND(low).alias("end"))).alias("spans"), "n")
    # a segment that is known in part only occurs once
    known = stored(whole.unionByName(partly.join(whole, ["anchor", "digest"], "left_anti").withColumn("n", F.lit(1).cast("long"))), "known")
    dropped(groups)
    spark.sparkContext._jvm.System.gc()  # lets the driver's cleaner drop shuffle files that are done with
    start = F.shiftright("at", 2 * _BITS)
    hits = joined_evenly(found, known, ["anchor", "digest"], "n", found.count()).select("row", F.transform("spans", lambda s: F.struct((s["start"] + start).alias("start"), (s["end"] + start).alias("end"))).alias("spans"))
    out = stored(hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    dropped(found)
    dropped(known)
    swept(spark)
    return out


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every word as CODE digits (0 to 254) of its hash, and the offsets of the texts in them."""
    starts, ends, per = words(data, offsets)
    up, down = _POWERS.get(len(data))
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up))
    value = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX)
    digits = np.empty((len(value), CODE), np.uint8)
    for k in range(CODE):
        digits[:, k] = value % np.uint64(255)
        value = value // np.uint64(255)
    return digits.ravel(), np.append(0, np.cumsum(per)) * CODE


def coded(rows: DataFrame) -> DataFrame:
    """row and text, which is the words' codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text", PLACE_BYTES):
            data, offsets = word_codes(*flat(batch.column("text")))
            yield pa.record_batch([batch.column("row"), binary(data, offsets)], names=["row", "text"])

    return rows.select("row", "text").mapInArrow(run, "row long, text binary")


def passages(rows: DataFrame, least: int = PASSAGE) -> DataFrame:
    """row and passages (array of start, end in codes) of each numbered row with ``least`` words in a row that stand elsewhere too."""
    span = least * CODE
    return repeated_spans(coded(rows), span, span // 2).withColumnRenamed("spans", "passages")


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, kept (the remaining bytes) and spans (maximal removed runs, in bytes).

    Null texts are empty; texts shorter than ``span`` lose nothing; repeated rows lose whatever of
    ``span`` bytes they share, all copies alike; null doc_ids are rows like others; an empty table
    gives an empty result; other columns are not read.
    """
    return _cut(docs, span, gram, _kept, "n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def removal_digests(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``remove_repeats``, taken in the same task.

    Besides, n_passages and passage_words: how many runs of PASSAGE words or more also stand elsewhere,
    whether or not they have ``span`` bytes, and the words in them. Nothing is removed for these.
    """
    return _cut(docs, span, gram, _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long", True)


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]], bytes]]:
    data, offsets = flat(batch.column("text"))
    raw = memoryview(data.tobytes())
    for k, spans in enumerate(batch.column("spans")):
        text = raw[offsets[k] : offsets[k + 1]]
        runs = _runs(spans)
        at, parts = 0, []
        for a, b in runs:
            parts.append(text[at:a])
            at = b
        parts.append(text[at:])
        yield text, runs, parts[0] if len(parts) == 1 else b"".join(parts)


def _kept(batch: pa.RecordBatch) -> list[pa.Array]:
    rows = [(len(t), bytes(kept), [{"start": a, "end": b} for a, b in runs]) for t, runs, kept in _cells(batch)]
    return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]


def _runs(spans: pa.Scalar) -> list[tuple[int, int]]:
    if not spans.is_valid or not len(spans.values):
        return []
    return joined(*(spans.values.field(c).to_numpy() for c in ("start", "end")))


def _digest(batch: pa.RecordBatch) -> list[pa.Array]:
    rows = []
    for (t, runs, kept), found in zip(_cells(batch), batch.column("passages"), strict=True):
        in_words = [b // CODE + -a // CODE for a, b in _runs(found)]  # whole words only
        rows.append((len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), len(in_words), sum(in_words)))
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]


def _cut(docs: DataFrame, span: int, gram: int, make, schema: str, with_passages: bool = False) -> DataFrame:
    if not gram < span < 1 << (_BITS - 1):
        raise ValueError("an anchor must be shorter than a span, and a span under 2048 bytes")
    rows = numbered(docs)
    found = rows.join(repeated_spans(rows, span, gram), "row", "left")
    if with_passages:
        found = found.join(passages(rows), "row", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text", PLACE_BYTES):
            yield pa.record_batch([batch.column("doc_id"), *make(batch)], names=names)

    return found.drop("row").mapInArrow(run, f"doc_id {kind}, {schema}")
