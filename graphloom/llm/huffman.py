"""Token ids as canonical length-limited Huffman codes in independent blocks.

File format: a folder of Parquet files, which Spark's committers write and any store can hold.
``code`` has a row for each id that occurs (id, bits). ``blocks`` has a row for each block: ``part``
and ``block`` give the order, ``first`` the number of ids before the block in its part, ``doc_ids``
and ``sizes`` the documents and their id counts, ``marks`` the bit offset of every STEP-th id, and
``bits`` the codes, most significant bit first in big-endian 32-bit words. A block holds whole
documents, and nothing outside it but the code is needed to read it.

Code lengths come from the counts of all ids by package-merge, at most LIMIT bits. The code is
canonical, so the lengths alone define it. Decoding looks LIMIT bits up in a table, in all lanes
between two marks at once.

Repeated doc_ids are kept as separate documents, ordered by their ids; null texts are empty
documents (one end id); null doc_ids come first; an empty table gives empty files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.common import dropped, shared_dir, ship, stored, texts
from graphloom.llm.textbatch import DISTINCT_BYTES, flat, release, slices
from graphloom.llm.token_counts import dictionary

LIMIT, STEP, BLOCK = 20, 64, 1 << 17


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    levels, row = [], leaves
    leaf = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(leaf)
        even = len(row) // 2 * 2
        packed = row[0:even:2] + row[1:even:2]
        both = np.concatenate([leaves, packed])
        at = np.argsort(both, kind="stable")
        row, leaf = both[at], at < n
    levels.append(leaf)
    out, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        used = int(leaf[:take].sum())
        out[:used] += 1
        take = 2 * (take - used)
    lens = np.empty(n, np.int64)
    lens[order] = out
    return lens


def canonical(ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    order = np.lexsort((ids, lens))
    sizes = lens[order]
    steps = np.left_shift(np.int64(1), LIMIT - sizes)
    codes = np.empty(len(ids), np.int64)
    codes[order] = (np.cumsum(steps) - steps) >> (LIMIT - sizes)
    return codes


class Code:
    """Encoding arrays by id, and the decoding table."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray):
        self.ids, self.lens = ids.astype(np.int64), lens.astype(np.int64)
        codes = canonical(self.ids, self.lens)
        top = int(self.ids.max()) + 1 if len(ids) else 1
        self.size_of, self.code_of = np.zeros(top, np.uint8), np.zeros(top, np.uint64)
        self.size_of[self.ids], self.code_of[self.ids] = self.lens, codes
        self._table = None

    def __getstate__(self):
        return self.ids, self.lens

    def __setstate__(self, state):
        self.__init__(*state)

    def table(self) -> np.ndarray:
        """For each LIMIT bits: the first id in them, shifted left by 5, and its code's length."""
        if self._table is None:
            order = np.lexsort((self.ids, self.lens))
            entry = (self.ids[order] << 5) | self.lens[order]
            filled = np.repeat(entry, 1 << (LIMIT - self.lens[order]))
            self._table = np.full(1 << LIMIT, 1, np.int64)
            self._table[: len(filled)] = filled
        return self._table

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ``ids`` and the bit offsets of every STEP-th."""
        sizes = self.size_of[ids].astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        value = self.code_of[ids] << (64 - (starts & 31) - sizes).astype(np.uint64)
        word = starts >> 5
        words = np.zeros(int(ends[-1] >> 5) + 3 if len(ids) else 2, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            at = word[first]
            words[at] += np.add.reduceat(value >> np.uint64(32), first)
            words[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return words.astype(">u4").tobytes(), starts[::STEP]

    def unpack(self, bits: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block."""
        words = np.frombuffer(bits, ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        table, at, last = self.table(), marks.astype(np.int64), len(pairs) - 1
        out = np.empty((STEP, len(at)), np.uint32)
        for k in range(STEP):
            x = (pairs[np.minimum(at >> 5, last)] << (at & 31).astype(np.uint64)) >> np.uint64(64 - LIMIT)
            entry = table[x.astype(np.int64)]
            out[k] = entry >> 5
            at = at + (entry & 31)
        return out.T.ravel()[:n]


def encode_documents(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (unsigned 16-bit where the vocabulary allows, else 32-bit) of each document.

    ``counts`` has how often each id occurs in a batch, on the batch's first row.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", DISTINCT_BYTES):
            ids, per = dictionary(path).encoded(*flat(batch.column("text")))
            ids = np.insert(ids, np.cumsum(per), end_id)
            small = "<u2" if len(ids) == 0 or ids.max() < 1 << 16 else "<u4"
            raw, ends = ids.astype(small).tobytes(), np.append(0, np.cumsum(per + 1))
            width = np.dtype(small).itemsize
            cells = [raw[a * width : b * width] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            counts = [np.bincount(ids).astype("<u4").tobytes(), *[None] * (len(per) - 1)]
            cols = [batch.column("doc_id"), pa.array((per + 1).astype(np.int64)), pa.array(cells, pa.binary()), pa.array(np.full(len(per), width, np.int32)), pa.array(counts, pa.binary())]
            yield pa.record_batch(cols, names=["doc_id", "n_tokens", "ids", "width", "counts"])

    return texts(docs).mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary, width int, counts binary")


def _ids(cell: bytes, width: int) -> np.ndarray:
    return np.frombuffer(cell, "<u2" if width == 2 else "<u4").astype(np.int64)


def id_counts(encoded: DataFrame) -> DataFrame:
    """token_id and n over all documents: the batches' counts, added up by task and then over all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for cell in batch.column("counts").to_pylist():
                got = np.frombuffer(cell, "<u4").astype(np.int64)
                if len(got) > len(total):
                    got[: len(total)] += total
                    total = got
                else:
                    total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["token_id", "n"])

    return encoded.select("counts").where("counts is not null").mapInArrow(count, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = 1) -> None:
    """Encode ``docs`` with the tokenizer at ``path`` and write the format above to the folder ``out``."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = stored(encode_documents(docs, path, end_id), "ids")
    counts = id_counts(encoded).collect()  # a row for each id of the vocabulary at most
    ids, n = (np.array([r[k] for r in counts], np.int64) for k in (0, 1))
    order = np.argsort(ids)
    code = Code(ids[order], code_lengths(n[order]))
    rows = [(int(i), int(b)) for i, b in zip(code.ids, code.lens, strict=True)]
    spark.createDataFrame(rows, "token_id long, bits int").coalesce(1).write.parquet(f"{out}/code")
    shared = spark.sparkContext.broadcast(code)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held
            sizes = [len(x) for _, x in held]
            bits, marks = shared.value.pack(np.concatenate([x for _, x in held]))
            row = {"part": [part], "block": [block], "first": [first], "doc_ids": [[d for d, _ in held]], "sizes": [sizes], "marks": [marks.tolist()], "bits": [bits]}
            block, first, held = block + 1, first + sum(sizes), []
            return pa.RecordBatch.from_pydict(row, schema=schema)

        size = 0
        for batch in batches:
            for doc, cell, width in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "width")), strict=True):
                x = _ids(cell, width)
                held.append((doc, x))
                size += len(x)
                if size >= BLOCK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(to_arrow_type(docs.schema["doc_id"].dataType))), ("sizes", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("bits", pa.binary())])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids").select("doc_id", "ids", "width")
    blocks = ordered.mapInArrow(pack, f"part int, block int, first long, doc_ids array<{kind}>, sizes array<long>, marks array<long>, bits binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    dropped(encoded)


def read_code(spark: SparkSession, at: str) -> Code:
    rows = spark.read.parquet(f"{at}/code").orderBy("token_id").collect()  # a row for each id of the vocabulary at most
    return Code(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64))


def read_documents(spark: SparkSession, at: str) -> DataFrame:
    """Decode every block: doc_id, start, n_tokens, ids_crc32, token_bits of each document.

    ``start`` adds the ids of earlier parts (a number for each part, summed on the driver), of
    earlier blocks (stored) and of earlier documents in the block.
    """
    ship(spark)
    blocks = spark.read.parquet(f"{at}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    code = spark.sparkContext.broadcast(read_code(spark, at))
    ends = blocks.select("part", (F.col("first") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before, total = {}, 0
    for part, n in sorted(ends.groupBy("part").agg(F.max("n")).collect()):  # a row for each part
        before[part], total = total, total + n
    base = spark.sparkContext.broadcast(before)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, docs, sizes, marks, bits = (batch.column(c)[row] for c in ("part", "first", "doc_ids", "sizes", "marks", "bits"))
                size = sizes.values.to_numpy()
                ids = code.value.unpack(bits.as_py(), marks.values.to_numpy(), int(size.sum())).astype("<u4")
                raw, at_byte = memoryview(ids.tobytes()), np.append(0, np.cumsum(size)) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at_byte[:-1], at_byte[1:], strict=True)]
                start = base.value[part.as_py()] + first.as_py() + np.cumsum(size) - size
                yield pa.record_batch([docs.values, pa.array(start), pa.array(size), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, out: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to files (in the shared folder unless ``out`` is given) and read them back."""
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_ids(docs, path, out, end_id)
    return read_documents(spark, out)
