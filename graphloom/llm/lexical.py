"""Ranked lexical search by Fagin's threshold algorithm.

Forward index: one row a document with the terms that any query has and how often, and the document's
number of terms. Lists: a row for each term and document with its impact, which is what one occurrence
of the term in a query adds to the document's score. A list is sorted by impact and cut into bands,
the first of about FIRST rows and each next one GROWTH times as deep; bands are folders, so a round
reads no list twice and nothing below its depth. Where a list is cut is decided by counts of its
impacts in STEPS steps, which are aggregated where the rows are, so no list is ever sorted whole in one
task; a band ends between two steps.

A round takes the next band of all lists of the queries that are not done (sorted access, in turn and
equally deep), looks up the documents met there in the forward index (random access) and scores them
whole for all those queries. Each task keeps its K best a query, which are merged with the best so far.
The highest impact below a list's depth, or 0 at its end, is known; the sum of these over a query's
terms is its threshold. No document that was not met scores more. A query is done when its threshold
is strictly below its K-th score, so that ties are all seen, or when nothing is left that adds anything.

Queries are taken in blocks of at most TERMS different terms: what the driver and the tasks hold of
lists (counts by step, weights, thresholds) is bounded by that, not by the documents.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import dropped, shared_dir, ship, stored
from graphloom.llm.textbatch import CAPITAL, binary, flat, release, slices

#: Documents a query; how much of the length counts, in hundredths; the scale of a term's share of the score.
K, LENGTH, SCALE = 10, 75, 1_000_000
#: Steps of impact by which lists are cut; rows of a list in the first round, and how much deeper each next one goes.
STEPS, FIRST, GROWTH = 64, 1_024, 4
#: Different terms in a block of queries; cells of impacts that are scored at once.
TERMS, CELLS = 20_000, 4_000_000
#: Bytes of terms: ASCII digits and letters, and all bytes of other characters.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order, A-Z lowered; null has none."""
    return TERM.findall((text or "").translate(LOWER))


def counted(data: np.ndarray, offsets: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats, and (text, term, times) of those in the vocabulary, by text."""
    n, solid = len(data), WORD[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begin[heads] |= solid[heads]
    per = np.diff(np.searchsorted(np.flatnonzero(begin), offsets))
    low = np.where(CAPITAL[data], data + np.uint8(32), data)[solid]
    words = binary(low, np.append(np.flatnonzero(begin[solid]), len(low)))
    ids = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(per)), per)
    wide = max(1, len(vocabulary))
    key, times = np.unique(text[ids >= 0] * wide + ids[ids >= 0], return_counts=True)
    return per, key // wide, key % wide, times


def forward_index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """row (a number), doc_id, n (terms with repeats), ids and times (terms of the vocabulary and how often), stored."""
    ship(docs.sparkSession)
    known = pa.array([t.encode() for t in vocabulary], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            per, text, term, times = counted(*flat(batch.column("text")), known)
            ends = 4 * np.append(0, np.cumsum(np.bincount(text, minlength=len(per))))
            packed = [binary(x.astype(np.int32).view(np.uint8), ends) for x in (term, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(per.astype(np.int64)), *packed], names=["doc_id", "n", "ids", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, ids binary, times binary")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "forward")


class Postings:
    """Terms, times and lengths of a batch of the forward index as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        raw, ends = flat(batch.column("ids"))
        self.ids, self.per = raw.view(np.int32), np.diff(ends) // 4
        self.times = flat(batch.column("times"))[0].view(np.int32).astype(np.int64)
        self.n = batch.column("n").to_numpy()

    def shares(self, docs: int, length: int) -> np.ndarray:
        """What each term's weight is multiplied by, at most SCALE: for all ``docs`` with terms and their ``length`` together."""
        m = 100 - LENGTH + (LENGTH * self.n * docs) // max(1, length)
        return (1000 * SCALE * self.times) // (1000 * self.times + 8 * np.repeat(m, self.per))


def steps(shares: np.ndarray) -> np.ndarray:
    """The step of each share, the highest shares first."""
    return STEPS - 1 - shares * STEPS // (SCALE + 1)


def document_counts(forward: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(terms, np.int64)
        for batch in batches:
            out += np.bincount(Postings(batch).ids, minlength=terms)
        some = np.flatnonzero(out)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(out[some])], names=["term", "n"])

    out = np.zeros(terms, np.int64)
    for r in forward.select("n", "ids", "times").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def weights(holders: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) if x else 0 for x in holders.tolist()], np.int64)


def cuts(forward: DataFrame, weight: np.ndarray, docs: int, length: int, first: int, growth: int) -> tuple[np.ndarray, np.ndarray]:
    """The band of each step of each term's list, and for each band and term the highest impact below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = Postings(batch)
            share = p.shares(docs, length)
            key = p.ids.astype(np.int64) * STEPS + steps(share)
            order = np.argsort(key, kind="stable")
            key, share = key[order], share[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            most = np.maximum.reduceat(share, head) if len(head) else share
            yield pa.record_batch([pa.array(key[head]), pa.array(np.diff(np.append(head, len(key)))), pa.array(most)], names=["cell", "n", "most"])

    found = forward.select("n", "ids", "times").mapInArrow(run, "cell long, n long, most long").groupBy("cell").agg(F.sum("n").alias("n"), F.max("most").alias("most")).toArrow()
    n, most = np.zeros((2, len(weight) * STEPS), np.int64)
    cell = found.column("cell").to_numpy()
    n[cell], most[cell] = found.column("n").to_numpy(), found.column("most").to_numpy()
    n, most = n.reshape(-1, STEPS), most.reshape(-1, STEPS)
    before = np.cumsum(n, axis=1) - n
    band = np.zeros(n.shape, np.int8)
    depth = first
    while (deep := (before >= depth) & (n > 0)).any():
        band[deep] += 1
        depth *= growth
    below = np.array([np.where(band > r, most, 0).max(axis=1) * weight for r in range(int(band.max(initial=0)) + 1)])
    return band, below


def impact_lists(forward: DataFrame, band: np.ndarray, weight: np.ndarray, docs: int, length: int) -> str:
    """Where the lists are: term, impact, row, sorted by term and falling impact, a folder for each band. Terms without weight have none."""
    spark = forward.sparkSession
    shared = spark.sparkContext.broadcast((band, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, w = shared.value
        for batch in batches:
            p = Postings(batch)
            share = p.shares(docs, length)
            impact = w[p.ids] * share
            kept = impact > 0
            term = p.ids[kept]
            row = np.repeat(batch.column("row").to_numpy(), p.per)[kept]
            yield pa.record_batch([pa.array(bands[term, steps(share[kept])].astype(np.int32)), pa.array(term), pa.array(impact[kept]), pa.array(row)], names=["band", "term", "impact", "row"])

    path = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"
    rows = forward.select("n", "ids", "times", "row").mapInArrow(run, "band int, term int, impact long, row long")
    rows.sortWithinPartitions("band", "term", F.desc("impact"), "row").write.partitionBy("band").option("compression", "zstd").parquet(path)
    return path


def best_of(forward: DataFrame, queries: dict[int, dict[int, int]], floors: dict[int, int], weight: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """query, row, doc_id, score: of the rows of ``forward`` each task's ``k`` best for each query (term to times), above 0 and at least its floor."""
    spark = forward.sparkSession
    used = sorted({t for q in queries.values() for t in q})
    place = np.full(len(weight), -1, np.int64)
    place[used] = np.arange(len(used))
    asked = {q: (place[np.array(list(terms), np.int64)], np.array(list(terms.values()), np.int64)[:, None]) for q, terms in queries.items()}
    shared = spark.sparkContext.broadcast((place, weight, asked, floors))
    kind = forward.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, items, least = shared.value
        least = {q: max(1, least.get(q, 1)) for q in items}
        best: dict[int, list[tuple]] = {q: [] for q in items}
        doc_type = pa.int64()
        wide = max(1, CELLS // (len(used) + 1))
        for whole in batches:
            doc_type = whole.schema.field("doc_id").type
            for start in range(0, whole.num_rows, wide):
                batch = whole.slice(start, wide)
                p = Postings(batch)
                impact = w[p.ids] * p.shares(docs, length)
                doc, column = np.repeat(np.arange(batch.num_rows), p.per), at[p.ids]
                table = np.zeros((len(used), batch.num_rows), np.int64)
                table[column[column >= 0], doc[column >= 0]] = impact[column >= 0]
                ids, rows = batch.column("doc_id"), batch.column("row")
                for q, (terms, times) in items.items():
                    score = (table[terms] * times).sum(axis=0)
                    hit = np.flatnonzero(score >= least[q])
                    if len(hit):
                        found = zip((-score[hit]).tolist(), ids.take(pa.array(hit)).to_pylist(), rows.take(pa.array(hit)).to_pylist(), strict=True)
                        best[q] = sorted([*best[q], *((s, d is None, d, r) for s, d, r in found)], key=_order)[:k]
                        if len(best[q]) == k:
                            least[q] = max(least[q], -best[q][-1][0])
        out = [(q, r, d, -s) for q, rows in best.items() for s, _, d, r in rows]
        query, row, doc_id, score = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.record_batch([pa.array(query, pa.int32()), pa.array(row, pa.int64()), pa.array(doc_id, doc_type), pa.array(score, pa.int64())], names=["query", "row", "doc_id", "score"])

    return forward.select("row", "doc_id", "n", "ids", "times").mapInArrow(run, f"query int, row long, doc_id {kind}, score long")


def _order(found: tuple) -> tuple:
    s, missing, d, r = found
    return (s, missing, r) if missing else (s, missing, d, r)


def ranked_rows(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query with their rank; a row that was met twice counts once."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    return rows.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, texts: list[list[str]], k: int, first: int, growth: int, watch: list | None = None) -> DataFrame:
    """query (place in ``texts``), rank, doc_id, row, score of the ``k`` best documents of each list of terms."""
    spark = docs.sparkSession
    vocabulary = sorted({t for terms in texts for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    forward = forward_index(docs, vocabulary)
    total = forward.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    size = (total["docs"], total["length"])
    weight = weights(document_counts(forward, len(vocabulary)), size[0])
    band, below = cuts(forward, weight, *size, first, growth)
    path = impact_lists(forward, band, weight, *size)
    there = {int(b) for b in np.unique(band[weight > 0])}
    # terms that no document holds, or that weigh nothing, have no list
    live = {q: {t: n for t, n in Counter(number[x] for x in terms).items() if weight[t]} for q, terms in enumerate(texts)}
    live = {q: terms for q, terms in live.items() if terms}
    best, floors = None, {}
    for r in range(len(below)):
        if not live:
            break
        if r in there:
            terms = spark.createDataFrame([(t,) for t in sorted({t for q in live.values() for t in q})], "term int")
            met = spark.read.schema("term int, impact long, row long").parquet(f"{path}/band={r}").join(F.broadcast(terms), "term", "left_semi").select("row").distinct()
            found = best_of(forward.join(met, "row", "left_semi"), live, floors, weight, *size, k)
            merged = stored(ranked_rows(found if best is None else best.drop("rank").unionByName(found), k), "best")
            best = merged
            floors = {x["query"]: x["s"] for x in best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).collect()}
        threshold = {q: sum(int(below[r, t]) * n for t, n in terms.items()) for q, terms in live.items()}
        if watch is not None:
            watch.append((r, len(live)))
        live = {q: terms for q, terms in live.items() if 0 < threshold[q] and threshold[q] >= floors.get(q, 0)}
    dropped(spark.read.schema("term int, impact long, row long").parquet(path))
    if best is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        best = spark.createDataFrame([], f"query int, row long, doc_id {kind}, score long, rank int")
    return best


def search(docs: DataFrame, items: DataFrame, k: int = K, first: int = FIRST, growth: int = GROWTH, most: int = TERMS, watch: list | None = None) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each row of ``items`` its ``k`` documents with the highest score above 0.

    Equal scores go by ascending doc_id (null last), then by the row as read: repeated rows are
    documents each. Repeated items are queries each. Null and empty texts have no terms: such items
    have no rows, such documents are never found. A term that a query repeats counts as often. With
    empty tables the result is empty; other columns are not read; texts are read whole. Items are read
    by the driver in blocks of at most ``most`` different terms (one item at least). ``watch`` gets the
    number of each round and of the queries in it.
    """
    spark = docs.sparkSession
    out, names, texts, seen = [], [], [], set()

    def close() -> None:
        if texts:
            best = search_block(docs, texts, k, first, growth, watch)
            ids = spark.createDataFrame([(q, x) for q, x in enumerate(names)], f"query int, item_id {items.schema['item_id'].dataType.simpleString()}")
            out.append(best.join(F.broadcast(ids), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        names.clear(), texts.clear(), seen.clear()

    for r in items.select("item_id", "text").toLocalIterator():
        terms = terms_of(r["text"])
        if texts and len(seen | set(terms)) > most:
            close()
        if terms:
            names.append(r["item_id"])
            texts.append(terms)
            seen.update(terms)
    close()
    if not out:
        item, doc = (f.schema[c].dataType.simpleString() for f, c in ((items, "item_id"), (docs, "doc_id")))
        return spark.createDataFrame([], f"item_id {item}, rank int, doc_id {doc}, score long")
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows
