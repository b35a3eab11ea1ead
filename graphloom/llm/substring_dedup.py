"""Substring dedup: words of a window of SPAN words that also starts earlier go.

Texts with the same words in the same order are one text first: of a later copy with a window every
word is covered by windows that start earlier, so only the first copy goes on.

Prefilter. A window's anchor is the last of its GRAM-word strings with the least hash; equal windows have
equal anchors at equal places, and two windows that start at different places of a text but share an
anchor are not equal. So the number of places at which an anchor stands is at least the number of
windows equal to any window that chose it, and there are about seven times fewer anchors than windows.
Anchors are counted in a count-min sketch: LANES rows of counters, LOAD for each anchor there is, in
blocks of CELLS. Every partition makes its own sketch (the cells that it uses, and whether more than
once), the partitions' sketches of a block are added up where the block is, and each partition is told
which of its cells have a sum of two or more. The least of the rows is the estimate. It is never below
the number of windows, so no repeated window is lost; with 16 counters for each anchor about one in 270
lone anchors passes.

Second pass. Only windows whose anchor is estimated to be repeated are grouped, by two 64-bit lanes of
a hash of their words (128 bits; equal hashes count as equal words). Each task reduces its windows to
the earliest before they are shuffled, so a window in a third of all documents is one row a task. What
comes back to a document are the places of its windows that are the earliest of their kind; all its
other grouped windows start earlier elsewhere, whatever their number, and are cut out.

Texts travel once: they are dealt out by row number, compressed, together with what the first pass made
of them, to a bucketed table in the shared folder. Later joins by row number move only the other side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ROW, bucketed, ship, stored, with_row
from graphloom.llm.decontam import mixed
from graphloom.llm.textbatch import SPACE, binary, expand, flat, release, slices, sums, words

SPAN, GRAM = 20, 8
#: Rows of the sketch, counters in a block, counters for each anchor.
LANES, CELLS, LOAD = 2, 1 << 24, 16
#: Anchors whose cells a task gathers before it sends them on; bytes of text that are worked on at once.
GATHER, TEXT_BYTES = 1 << 20, 2 << 20
_BASE = np.uint64(0x5851F42D4C957F2D)
EMPTY = hashlib.sha256(b"").hexdigest()


class Words:
    """The words of a batch of texts: where they are, how many each text has, and two hashes of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, self.per = words(data, offsets)
        self.lens = self.ends - self.starts
        self.first = np.cumsum(self.per) - self.per
        coded = binary(data[~SPACE[data]], np.append(0, np.cumsum(self.lens))).dictionary_encode()
        known = b"".join(xxhash.xxh3_128_digest(x) for x in coded.dictionary.to_pylist())
        self.hash = np.frombuffer(known, np.uint64).reshape(-1, 2)[coded.indices.to_numpy(zero_copy_only=False)]

    def strings(self, lane: int, n: int) -> np.ndarray:
        """The hash of every ``n`` words that follow one another, text or not."""
        own = self.hash[:, lane]
        out = np.zeros(max(0, len(own) - n + 1), np.uint64)
        for j in range(n):
            out = out * _BASE + own[j : j + len(out)]
        return mixed(out)

    def windows(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of every window within a text, and how many each text has."""
        many = np.maximum(0, self.per - span + 1)
        return expand(self.first, many), many

    def digest(self, text: int, kept: np.ndarray | None = None) -> str:
        """SHA-256 of the words of a text (those marked in ``kept``) joined by one space."""
        at = slice(self.first[text], self.first[text] + self.per[text])
        starts, lens = self.starts[at], self.lens[at]
        if kept is not None:
            starts, lens = starts[kept], lens[kept]
        if not len(starts):
            return EMPTY
        out = np.full(int((lens + 1).sum()), 0x20, np.uint8)
        out[expand(np.cumsum(lens + 1) - lens - 1, lens)] = self.data[expand(starts, lens)]
        return hashlib.sha256(out[:-1].tobytes()).hexdigest()


def last_least(g: np.ndarray, width: int) -> np.ndarray:
    """For each place the last place of the least of the ``width`` values from there on."""
    at, have = np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: max(0, len(at) - step)], at[step:]
        at, have = np.where(g[right] <= g[left], right, left), have + step
    return at


def anchors(own: Words, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: its first word, its anchor's place and hash; and the windows of each text."""
    start, many = own.windows(span)
    g = own.strings(0, gram)
    place = last_least(g, span - gram + 1)[start] if len(start) else start
    return start, place, g[place] if len(start) else np.zeros(0, np.uint64), many


def cells(values: np.ndarray, lane: int, blocks: int) -> np.ndarray:
    """The cell of each anchor in a row of the sketch."""
    return mixed(values + np.uint64((2 * lane + 1) * int(_BASE) % (1 << 64))) % np.uint64(blocks * CELLS)


def packed(values: np.ndarray, per: np.ndarray) -> pa.Array:
    """A binary value a row: ``per`` of the values each."""
    return binary(np.ascontiguousarray(values).view(np.uint8), values.itemsize * np.append(0, np.cumsum(per)))


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    raw, ends = flat(column)
    return raw.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def compressed(texts: list[bytes]) -> pa.Array:
    press = zstandard.ZstdCompressor(level=1)
    return pa.array([press.compress(x) for x in texts], pa.binary())


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Compressed texts as flat bytes with their offsets."""
    press = zstandard.ZstdDecompressor()
    texts = [press.decompress(x) for x in column.to_pylist()]
    whole = b"".join(texts)
    return np.frombuffer(whole, np.uint8) if whole else np.zeros(0, np.uint8), np.append(0, np.cumsum([len(x) for x in texts], dtype=np.int64))


def described(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """num (of the row), its ROW, doc_id, n_words, digest (of the words), anchors and packed (the text) of each row, dealt out by num."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text", TEXT_BYTES):
            data, offsets = flat(batch.column("text"))
            own = Words(data, offsets)
            _, place, value, many = anchors(own, span, gram)
            new = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
            per = sums(new.astype(np.int64), many)
            digests = [own.digest(k) for k in range(len(own.per))]
            raw, ends = data.tobytes(), offsets.tolist()
            texts = compressed([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), pa.array(own.per.astype(np.int64)), pa.array(digests), packed(value[new], per), texts], names=[ROW, "doc_id", "n_words", "digest", "anchors", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(ROW, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(run, f"{ROW} struct<file:string,at:long>, doc_id {kind}, n_words long, digest string, anchors binary, packed binary")
    return bucketed(out.withColumn("num", F.monotonically_increasing_id()), "num", "words")


def first_copies(rows: DataFrame, span: int) -> DataFrame:
    """num, base of the first row of each sequence of words with a window: base + place of a word grows with the order of rows and places, stored."""
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "num")
    first = rows.where(F.col("n_words") >= span).groupBy("digest", "n_words").agg(F.min(order).alias("o")).select("n_words", "o.*")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            n = batch.column("n_words").to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("num"), batch.column("pid"), pa.array(ends - n)], names=["num", "pid", "at"])
            at = int(ends[-1]) if len(ends) else at

    keys = ("missing", "doc_id", "num")
    ranged = first.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id())
    # a partition has fewer than 2 ** 40 words
    return stored(ranged.select("num", "n_words", "pid").mapInArrow(run, "num long, pid int, at long").select("num", (F.shiftleft(F.col("pid").cast("long"), 40) + F.col("at")).alias("base")), "first")


def estimated(rows: DataFrame) -> DataFrame:
    """num and repeated (its anchors whose estimate is two or more) of ``rows`` (num, anchors); rows without such an anchor are left out."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("anchors")), F.lit(0))).first()[0] // 8
    blocks = max(1, -(-total * LOAD // CELLS))
    # rows that one task described: a bounded part of the input
    rows = rows.withColumn("unit", F.shiftright("num", 33))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def rows_of(unit: int) -> Iterator[pa.RecordBatch]:
            values = np.concatenate(held.pop(unit))
            for lane in range(LANES):
                used, times = np.unique(cells(values, lane, blocks), return_counts=True)
                block, cell, many = (used // np.uint64(CELLS)).astype(np.int64), (used % np.uint64(CELLS)).astype(np.uint32), times > 1
                head = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                per = np.diff(np.append(head, len(block)))
                n = len(head)
                yield pa.record_batch([pa.array([unit] * n, pa.int64()), pa.array([lane] * n, pa.int32()), pa.array(block[head]), packed(cell, per), packed(many.astype(np.uint8), per)], names=["unit", "lane", "block", "cells", "many"])

        for batch in batches:
            values, per = unpacked(batch.column("anchors"), np.uint64)
            ends = np.cumsum(per)
            unit = batch.column("unit").to_numpy()
            head = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else ()
            for a, b in zip(head, np.append(head, len(unit))[1:], strict=False):
                part = values[ends[a] - per[a] : ends[b - 1]]
                if len(part):
                    held.setdefault(int(unit[a]), []).append(part)
                    if sum(map(len, held[int(unit[a])])) >= GATHER:
                        yield from rows_of(int(unit[a]))
        for unit in list(held):
            yield from rows_of(unit)

    def merge(pieces: pa.Table) -> pa.Table:
        used, per = unpacked(pieces.column("cells").combine_chunks(), np.uint32)
        many, _ = unpacked(pieces.column("many").combine_chunks(), np.uint8)
        count, ends = np.zeros(CELLS, np.uint8), np.cumsum(per)
        for a, b in zip(ends - per, ends, strict=True):  # a piece has a cell once
            own = used[a:b]
            count[own] = np.minimum(count[own] + many[a:b] + 1, 2)
        told = count[used] >= 2
        return pa.table([pieces.column("unit"), pieces.column("lane"), pieces.column("block"), packed(used[told], sums(told.astype(np.int64), per))], names=["unit", "lane", "block", "cells"])

    partial = rows.select("unit", "anchors").mapInArrow(sketch, "unit long, lane int, block long, cells binary, many binary")
    summed = partial.groupBy("lane", "block").applyInArrow(merge, "unit long, lane int, block long, cells binary").where(F.octet_length("cells") > 0)

    def tell(own: pa.Table, told: pa.Table) -> pa.Table:
        values, per = unpacked(own.column("anchors").combine_chunks(), np.uint64)
        hit = np.ones(len(values), bool)
        lane = told.column("lane").to_numpy()
        used, n = unpacked(told.column("cells").combine_chunks(), np.uint32)
        whole = used.astype(np.uint64) + np.repeat(told.column("block").to_numpy().astype(np.uint64) * np.uint64(CELLS), n)
        of = np.repeat(lane, n)
        for k in range(LANES):
            hit &= np.isin(cells(values, k, blocks), whole[of == k])
        return pa.table([own.column("num"), packed(values[hit], sums(hit.astype(np.int64), per))], names=["num", "repeated"])

    out = rows.select("unit", "num", "anchors").groupBy("unit").cogroup(summed.groupBy("unit")).applyInArrow(tell, "num long, repeated binary")
    return out.where(F.octet_length("repeated") > 0)


def grouped(chosen: DataFrame, span: int, gram: int) -> DataFrame:
    """num, base, starts (of the windows with a repeated anchor) and their hashes, of the ``chosen`` rows (num, base, packed, repeated), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "packed", TEXT_BYTES // 3):
            own = Words(*texts_of(batch.column("packed")))
            start, _, value, many = anchors(own, span, gram)
            hit = np.isin(value, np.unique(unpacked(batch.column("repeated"), np.uint64)[0]))
            per = sums(hit.astype(np.int64), many)
            at = start[hit]
            lanes = np.stack([own.strings(j, span)[at] for j in range(2)], axis=1) if len(at) else np.zeros((0, 2), np.uint64)
            place = (at - np.repeat(own.first, per)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("num"), batch.column("base"), packed(place, per), packed(lanes.ravel(), 2 * per)], names=["num", "base", "starts", "hashes"])

    return stored(chosen.select("num", "base", "packed", "repeated").mapInArrow(run, "num long, base long, starts binary, hashes binary"), "windows")


def earliest(found: DataFrame) -> DataFrame:
    """num and firsts: the positions (base + start) of a row's windows that are the earliest of their kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "hashes"):
            starts, per = unpacked(batch.column("starts"), np.int32)
            lanes = unpacked(batch.column("hashes"), np.int64)[0].reshape(-1, 2)
            num, base = (np.repeat(batch.column(c).to_numpy(), per) for c in ("num", "base"))
            yield pa.record_batch([pa.array(np.ascontiguousarray(lanes[:, 0])), pa.array(np.ascontiguousarray(lanes[:, 1])), pa.array(base + starts), pa.array(num)], names=["h", "i", "pos", "num"])

    each = found.select("num", "base", "starts", "hashes").mapInArrow(run, "h long, i long, pos long, num long")
    first = each.groupBy("h", "i").agg(F.min("pos").alias("pos"), F.min_by("num", "pos").alias("num"))
    return first.groupBy("num").agg(F.collect_list("pos").alias("firsts"))


def cut(found: DataFrame, first: DataFrame, span: int) -> DataFrame:
    """num, spans (first and last word + 1 of each run to be removed, one after the other) of rows that lose words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, per = unpacked(batch.column("starts"), np.int32)
            base, ends = batch.column("base").to_numpy(), np.cumsum(per)
            firsts = batch.column("firsts")
            out = []
            for k in range(batch.num_rows):
                own = starts[ends[k] - per[k] : ends[k]].astype(np.int64)
                kept = firsts[k].values
                gone = np.setdiff1d(own, kept.to_numpy() - base[k]) if kept is not None else own
                if not len(gone):
                    out.append([])
                    continue
                split = np.flatnonzero(gone[1:] > gone[:-1] + span) + 1
                head, tail = gone[np.append(0, split)], gone[np.append(split, len(gone)) - 1] + span
                out.append(np.stack([head, tail], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("num"), pa.array(out, pa.list_(pa.int32()))], names=["num", "spans"])

    rows = found.select("num", "base", "starts").where(F.octet_length("starts") > 0).join(first, "num", "left")
    return rows.mapInArrow(run, "num long, spans array<int>").where(F.size("spans") > 0)


def removals(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """What goes of ``docs`` (made by ``with_row``): the rows as ``described``, with ``copy`` (all its words go), and num and spans of others that lose words."""
    ship(docs.sparkSession)
    rows = described(docs, span, gram)
    first = first_copies(rows, span)
    one = rows.join(first, "num")
    found = grouped(one.join(estimated(one.select("num", "anchors")), "num"), span, gram)
    spans = stored(cut(found, earliest(found), span), "spans")
    kept = first.select("num", F.lit(True).alias("first"))
    return rows.join(kept, "num", "left").withColumn("copy", (F.col("n_words") >= span) & F.col("first").isNull()), spans


def kept_words(own: Words, text: int, spans: list[int]) -> np.ndarray:
    """Which words of a text are in no span."""
    out = np.ones(int(own.per[text]), bool)
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out[a:b] = False
    return out


def removal_digests(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    Words are runs without ASCII white space. Earlier means a smaller doc_id (null last), of equal ones
    the row as read first, in a row the smaller place; so of repeated rows the first keeps its words.
    Windows are judged on the input, texts are read whole. Null and empty texts have no words, shorter
    ones than a window lose none; an empty table gives an empty result; other columns are not read.
    """
    rows, spans = removals(with_row(docs, "doc_id", "text"), span, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "packed", TEXT_BYTES // 3):
            own = Words(*texts_of(batch.column("packed")))
            kept = [kept_words(own, k, s) for k, s in enumerate(batch.column("spans").to_pylist())]
            removed = [int((~x).sum()) for x in kept]
            yield pa.RecordBatch.from_arrays([batch.column("num"), pa.array(removed, pa.int64()), pa.array([own.digest(k, x) for k, x in enumerate(kept)])], names=["num", "removed", "kept"])

    less = rows.select("num", "packed").join(spans, "num").mapInArrow(run, "num long, removed long, kept string")
    out = rows.select("num", "doc_id", "n_words", "digest", "copy").join(less, "num", "left")
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0)))
    kept = F.when(F.col("copy"), F.lit(EMPTY)).otherwise(F.coalesce("kept", "digest"))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))


def drop_repeated_passages(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs``, all columns; a text that loses words is its kept words joined by one space, any other stays as it is.

    Odd input is as in ``removal_digests``; texts that lose every word become empty, null texts stay null.
    """
    docs = with_row(docs)
    rows, spans = removals(docs, span, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", TEXT_BYTES // 3):
            own = Words(*texts_of(batch.column("packed")))
            out = []
            for k, s in enumerate(batch.column("spans").to_pylist()):
                at = own.first[k] + np.flatnonzero(kept_words(own, k, s))
                out.append(b" ".join(own.data[a:b].tobytes() for a, b in zip(own.starts[at], own.ends[at], strict=True)).decode())
            yield pa.RecordBatch.from_arrays([batch.column("num"), pa.array(out, pa.string())], names=["num", "kept"])

    less = rows.select("num", "packed").join(spans, "num").mapInArrow(run, "num long, kept string")
    new = rows.select("num", ROW, "copy").join(less, "num", "left").where(F.col("copy") | F.col("kept").isNotNull())
    changed = new.select(F.col(ROW)["file"].alias(f"{ROW}file"), F.col(ROW)["at"].alias(f"{ROW}at"), F.when(F.col("copy"), "").otherwise(F.col("kept")).alias(f"{ROW}text"))
    by = [docs[ROW]["file"] == changed[f"{ROW}file"], docs[ROW]["at"] == changed[f"{ROW}at"]]
    return docs.join(changed, by, "left").withColumn("text", F.coalesce(f"{ROW}text", "text")).drop(ROW, *changed.columns)
