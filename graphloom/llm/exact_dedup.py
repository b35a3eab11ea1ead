"""Exact dedup by a tree-merge of sorted digest runs.

Every text is reduced to the SHA-256 of its normalised form. Each partition of the digest table is a
leaf with a sorted run, in which equal digests are merged to one entry: the row that stays and the
number of rows. Then leaves exchange runs in binomial rounds: in a round, nodes whose numbers differ
in the round's digits trade entries so that each ends up with the digests that have its own digits
there, merges the incoming sorted runs (Spark's external merge sort over the shuffle) and again keeps
one entry a digest. After the last round a digest lives at one node only. A hot text is one entry a
node from the leaves on. When each row asks what became of its digest, the entries of hot texts go to
the rows instead of the rows to them, so no task ever sees the copies of a hot text together.

Runs are sorted by the whole 32-byte digest, and two entries merge only if all 32 bytes and the
normalised lengths agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ROW, joined_evenly, only, ship, stored, with_row

#: The characters that normalising deletes: the space, and tab to carriage return.
DELETED = " \t\n\x0b\x0c\r"
#: Binary digits that one exchange settles: 2 makes it a merge of four runs.
DIGITS = 2


def digests(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, n (code points), size (of the normalised bytes), digest, row (a number of the row), stored."""
    plain = F.translate("text", DELETED, "")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)
    out = docs.select("doc_id", *more, F.char_length("text").cast("long").alias("n"), F.octet_length(plain).cast("long").alias("size"), F.unhex(F.sha2(plain, 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    return stored(out, "digests")


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge neighbours with equal (node, digest, size); the first of them stays, counts add up."""
    names = ["node", "digest", "size", "n", "doc_id", "row", "copies"]
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        batch = pa.RecordBatch.from_arrays([batch.column(c) for c in names], names=names)  # without the flags for nulls
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        cell = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint64).reshape(-1, 4)
        node, size = (batch.column(c).to_numpy() for c in ("node", "size"))
        new = np.append(True, (cell[1:] != cell[:-1]).any(1) | (node[1:] != node[:-1]) | (size[1:] != size[:-1]))
        first = np.flatnonzero(new)
        copies = np.add.reduceat(batch.column("copies").to_numpy(), first)
        out = batch.take(pa.array(first))
        out = pa.RecordBatch.from_arrays([*out.columns[:6], pa.array(copies)], names=names)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
        last = out.slice(out.num_rows - 1)
    if last is not None:
        yield last


def merged(rows: DataFrame, digits: int = DIGITS) -> DataFrame:
    """One row a digest: digest, size, keep_row, keep_id, copies."""
    spark = rows.sparkSession
    ship(spark)
    wide = max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    own = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"node long, digest binary, size long, n long, doc_id {kind}, row long, copies long"
    order = ["node", "digest", "size", F.col("n").desc(), F.col("doc_id").asc_nulls_last(), "row"]
    leaf = F.shiftright("row", 33).bitwiseAND((1 << wide) - 1)
    run = rows.select(leaf.alias("node"), "digest", "size", "n", "doc_id", "row", F.lit(1).cast("long").alias("copies"))
    run = run.sortWithinPartitions(*order).mapInArrow(merge_runs, schema)
    for at in range(0, wide, digits):
        mask = ((1 << min(digits, wide - at)) - 1) << at
        node = F.col("node").bitwiseAND(F.lit(~mask)).bitwiseOR(own.bitwiseAND(F.lit(mask)))
        run = run.withColumn("node", node).repartition(1 << wide, "node").sortWithinPartitions(*order).mapInArrow(merge_runs, schema)
    return run.select("digest", "size", F.col("row").alias("keep_row"), F.col("doc_id").alias("keep_id"), "copies")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the most code points stays, then the
    smallest doc_id (null last), then the first row as read: exactly one row of a group is kept, even
    among repeated rows. An empty table gives an empty result; other columns are not read.
    """
    rows = digests(docs)
    best = stored(merged(rows), "best")
    out = joined_evenly(rows, best, ["digest", "size"], "copies", rows.count())
    return out.select("doc_id", "keep_id", F.col("copies").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns.

    Null texts are equal to empty ones and to those of white space, of which one row stays; ties and
    repeated rows as in ``exact_duplicates``; null ids come last; an empty table gives an empty
    result; other columns are passed on, whatever their names.
    """
    numbered = with_row(docs)
    rows = digests(numbered, ROW)
    best = merged(rows).select(F.col("keep_row").alias("row"))
    return only(numbered, rows.join(best, "row", "left_semi").select(ROW))
