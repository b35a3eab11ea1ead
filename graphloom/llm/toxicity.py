"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text.

Folding takes compatibility forms apart, drops marks, lowers case, turns look-alike letters of other
scripts into Latin letters, drops invisible characters, reads digits (and @ $ ! between letters) as the letters they
stand for, and turns everything else that is no letter into a space. The lexicon holds whole words
and word beginnings that are in toxic texts more often than chance explains, with weights: the log
ratio of their shares of the words of toxic and of clean texts. Hits inside an exception phrase don't
count; besides a few written ones, phrases of two words are exceptions that hold a term but are in
clean texts only. The sum of the weights of the hits, normalised by the text's length, goes through a
logistic function fitted to the same labelled texts.

Labels are used only to fit; a score depends on the text alone.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ship, texts
from graphloom.llm.textbatch import release, slices

#: Labelled rows to fit on at most: those with the smallest hash of doc_id.
SAMPLE = 20_000
#: Least toxic training texts, least log-likelihood ratio statistic (a chance of about one in 100,000
#: for a term that says nothing) and least weight of a term.
LEAST, SIGNIFICANT, ODDS = 4, 20.0, 2.0
#: Lengths of word beginnings that may become terms.
STEMS = (4, 5, 6, 7, 8)
#: Words that a text counts as having at least; clean texts that a learnt exception is in at least.
SHORT, EXCEPT_LEAST = 25, 5
#: Phrases in which a term is harmless; hits that lie in one don't count.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "take out the trash", "trash collection", "clown fish", "class clown", "sore loser rule", "worthless check", "stupid question")
# Digits and signs, and the letters that they stand for.
DIGITS, DIGITS_AS = "0134578", "oieastb"
SIGNS = {"@": "a", "$": "s", "!": "i"}
INVISIBLE = "­​‌‍⁠﻿"
# Letters that look like a Latin one, by script, each before the letter that it looks like.
ALIKE = {
    "Greek": "αa βb γy εe ηn ιi κk νv οo ρp τt υu χx ωw",
    "Cyrillic": "аa вb сc еe ԁd ԍg һh іi јj кk ӏl мm нh оo рp ԛq ѕs тt уy ѵv ԝw хx ьb",
    "Armenian": "ոn սu օo հh զq ցg յj քf",
    "Cherokee": "ᎠD ᎡR ᎢT ᎥI ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎩY ᏀG ᏂH ᏃZ ᏎS ᏚS ᏟC ᏢP ᏤV ᏦK ᏧD ᏞL ᏴB ᏩG ᎾO",
    "small capitals": "ᴀa ʙb ᴄc ᴅd ᴇe ꜰf ɢg ʜh ɪi ᴊj ᴋk ʟl ᴍm ɴn ᴏo ᴘp ʀr ꜱs ᴛt ᴜu ᴠv ᴡw ʏy ᴢz",
    "other Latin": "ıi ȷj ɑa ɡg ɩi ſs łl øo đd ħh ŧt ƒf",
}
#: Letters in frames that have no decomposition: the first of each row of A to Z.
FRAMED = (0x1F150, 0x1F170, 0x1F1E6)


class Marks(dict):
    """A translation table that takes marks away, filled as characters come up."""

    def __missing__(self, code: int):
        return self.setdefault(code, None if unicodedata.category(chr(code))[0] == "M" else code)


class Fold(dict):
    """A translation table of lower-case text, filled as characters come up."""

    def __init__(self):
        super().__init__({ord(a): b for a, b in zip(DIGITS, DIGITS_AS, strict=True)})
        self.update({ord(pair[0].lower()): pair[1].lower() for row in ALIKE.values() for pair in row.split()})
        self.update({first + k: chr(ord("a") + k) for first in FRAMED for k in range(26)})
        self.update({ord(c): None for c in INVISIBLE})

    def __missing__(self, code: int):
        c = chr(code)
        self[code] = c if c.isalpha() else " "
        return self[code]


_MARKS, _FOLD = Marks(), Fold()
_SIGN = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])")


def fold(text: str) -> str:
    """Words of folded letters, spaces between, before and after.

    Compatibility forms (full-width, mathematical, circled and other letters) are taken apart and marks
    dropped, so that accented letters are plain ones; case is lowered; then look-alikes and digits are
    read as the letters that they stand for.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_MARKS)
    text = text.lower()
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: SIGNS[m.group()], text)
    return f" {text.translate(_FOLD)} "


@dataclass
class Lexicon:
    """Terms (" stem" or " word ") with weights, exception phrases, and the fitted logistic function."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 4.0
    offset: float = -2.0
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.weights, self.exceptions, self.slope, self.offset

    def __setstate__(self, state):
        self.weights, self.exceptions, self.slope, self.offset = state
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for term, w in self.weights.items():
                a.add_word(term, (len(term), w))
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (len(phrase) + 2, None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def measure(self, text: str) -> float:
        """The weights of the hits over the length in hundreds of words (SHORT words at least)."""
        automaton = self.automaton()
        if not len(automaton):
            return 0.0
        words = fold(text).split()
        folded = f" {' '.join(words)} "
        hits, harmless = [], []
        for end, (size, w) in automaton.iter(folded):
            if w is None:
                harmless.append((end - size + 1, end))
            else:
                hits.append((end - size + 1, end, w))
        if not hits:
            return 0.0
        harmless.sort()
        starts = [h[0] for h in harmless]
        reach = list(accumulate((h[1] for h in harmless), max))
        best: dict[int, float] = {}  # one hit a word: the heaviest term
        for start, end, w in hits:
            before = bisect_right(starts, start)
            if not before or reach[before - 1] < end:  # no phrase that begins before it goes on to its end
                best[start] = max(w, best.get(start, 0.0))
        return 100 * sum(best.values()) / max(SHORT, len(words))

    def phrases(self, folded: str) -> Counter:
        """How often each two words in a row occur of which one begins with a term."""
        out: Counter = Counter()
        if not self.weights:
            return out
        words = folded.split()
        starts = {end - size + 1 for end, (size, w) in self.automaton().iter(f" {' '.join(words)} ") if w is not None}
        at = 0
        for k, word in enumerate(words):
            if at in starts:
                out.update(" ".join(words[i : i + 2]) for i in (k - 1, k) if i >= 0 and i + 2 <= len(words))
            at += len(word) + 1
        return out

    def score(self, text: str) -> float:
        x = self.offset + self.slope * np.log1p(self.measure(text))
        return float(1 / (1 + np.exp(-min(60.0, max(-60.0, x)))))


def terms(folded: str) -> Counter:
    """How often each word and word beginning occurs in a folded text."""
    out: Counter = Counter()
    for w, n in Counter(folded.split()).items():
        if len(w) >= 3:
            out[f" {w} "] += n
        for k in STEMS:
            if len(w) > k:
                out[f" {w[:k]}"] += n
    return out


def sketch(folded: str) -> int:
    """The smallest hash of three words in a row: near copies mostly share it."""
    w = folded.split()
    return min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) - (1 << 63)


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learnt from: crc32 of doc_id as text divides by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def surprise(with1: Column, n1: int, with0: Column, n0: int) -> Column:
    """The log-likelihood ratio statistic of a two-by-two table: a term's texts among n1 toxic and n0 clean ones."""

    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    both, every = with1 + with0, float(n1 + n0)
    rest = F.lit(every) - both
    return 2 * (cell(with1, both * n1 / every) + cell(with0, both * n0 / every) + cell(n1 - with1, rest * n1 / every) + cell(n0 - with0, rest * n0 / every))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Learn a lexicon from ``labels`` (doc_id, toxic) outside the held-out fold, on at most ``sample`` rows.

    The sample is bounded, so its ids are broadcast, its measures come to the driver, and so do the
    terms that pass: there is no other cap. One text of those with the same sketch and label counts,
    so copies don't make terms. Rows without a label or a document are left out. Without a toxic row, or
    a term that passes, the lexicon is empty and every score is low.
    """
    ship(docs.sparkSession)
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            xs = [fold(t) for t in batch.column("text").to_pylist()]
            toxic = [int(t == 1) for t in batch.column("toxic").to_pylist()]
            yield pa.record_batch([pa.array([sketch(x) for x in xs]), pa.array(toxic, pa.int32()), pa.array(xs)], names=["sketch", "toxic", "text"])

    def count(found) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Counts (term, toxic, n, texts) of what ``found`` gives for each text, summed in the task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits: tuple[Counter, Counter] = (Counter(), Counter())
            texts_with: tuple[Counter, Counter] = (Counter(), Counter())

            def rows_of():
                for toxic, (h, d) in enumerate(zip(hits, texts_with, strict=True)):
                    names = list(h)
                    yield pa.record_batch([pa.array(names, pa.string()), pa.array(np.full(len(names), toxic, np.int32)), pa.array([h[t] for t in names], pa.int64()), pa.array([d[t] for t in names], pa.int64())], names=["term", "toxic", "n", "texts"])
                    h.clear()
                    d.clear()

            for batch in slices(batches, "text"):
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    own = found(text)
                    hits[toxic].update(own)
                    texts_with[toxic].update(own.keys())
                if len(hits[0]) + len(hits[1]) > 300_000:
                    yield from rows_of()
            yield from rows_of()

        return run

    def counted(found) -> DataFrame:
        """term with n and texts of each label, in columns n1, n0, texts1, texts0."""
        each = distinct.select("text", "toxic").mapInArrow(count(found), "term string, toxic int, n long, texts long")
        of = lambda c, y: F.sum(F.when(F.col("toxic") == y, F.col(c)).otherwise(0)).alias(f"{c}{y}")
        return each.groupBy("term").agg(of("n", 1), of("n", 0), of("texts", 1), of("texts", 0))

    # one row of the sample a sketch and label; at most `sample` texts are shuffled, once
    distinct = rows.mapInArrow(folded, "sketch long, toxic int, text string").groupBy("sketch", "toxic").agg(F.min("text").alias("text")).persist()
    totals = {r["toxic"]: r for r in distinct.groupBy("toxic").agg(F.count("*").alias("texts"), F.sum(F.size(F.split(F.trim("text"), " +"))).alias("words")).collect()}
    if 1 not in totals:
        distinct.unpersist()
        return Lexicon({})
    (n1, w1), (n0, w0) = ((totals[y]["texts"], totals[y]["words"]) if y in totals else (0, 0) for y in (1, 0))
    odds = F.log((F.col("n1") + 0.5) / (w1 + 1.0)) - F.log((F.col("n0") + 0.5) / (w0 + 1.0))
    often = F.col("texts1") * (n0 + 1) > F.col("texts0") * (n1 + 1)
    best = counted(terms).where(often & (F.col("texts1") >= LEAST)).withColumns({"w": odds, "g": surprise(F.col("texts1"), n1, F.col("texts0"), n0)})
    rows = best.where((F.col("g") >= SIGNIFICANT) & (F.col("w") >= ODDS)).select("term", "w", "n1").collect()
    support = {r["term"]: r["n1"] for r in rows}
    # a beginning that one longer term accounts for gives way to it; a longer term that adds nothing goes
    spelt = {t[:k] for t, n in support.items() for k in range(4, len(t)) if n >= 0.9 * support.get(t[:k], 1 << 60)}
    found = {r["term"]: r["w"] for r in rows if r["term"] not in spelt}
    weights = {t: round(w, 6) for t, w in sorted(found.items()) if not any(t[:k] in found and found[t[:k]] >= w - 0.7 for k in range(4, len(t)) if t[:k] != t)}
    if not weights:  # nothing to fit: every score is low
        distinct.unpersist()
        return Lexicon({})
    lexicon = Lexicon(weights)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)
    harmless = counted(lambda text: shared.value.phrases(text)).where((F.col("texts1") == 0) & (F.col("texts0") >= EXCEPT_LEAST))
    lexicon.exceptions = (*lexicon.exceptions, *sorted(r["term"] for r in harmless.select("term").collect()))
    lexicon._automaton = None
    shared = spark.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([shared.value.measure(t) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("toxic")], names=["x", "toxic"])

    pairs = distinct.select("text", "toxic").mapInArrow(measure, "x double, toxic int").collect()  # at most `sample` numbers
    distinct.unpersist()
    lexicon.slope, lexicon.offset = logistic(np.log1p([p[0] for p in pairs]), np.array([float(p[1]) for p in pairs]))
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a one-dimensional logistic regression, by Newton's method; both classes weigh the same."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    a = np.stack([x, np.ones_like(x)], 1)
    b = np.array([1.0, -1.0])
    pull = np.array([[ridge, 0], [0, ridge]]) * len(y) * 0.01
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + pull, a.T @ (weight * (y - p)) - pull @ b)
        b = b + np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return round(float(b[0]), 9), round(float(b[1]), 9)


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (1 from 0.5).

    Null texts score like empty ones; repeated and null doc_ids give a row each (a null one is not
    held out); labels and other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            got = [shared.value.score(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])

    out = texts(docs).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``scores`` of ``docs`` by a lexicon fitted to the labelled rows that are not held out.

    Null labels and labels of ids that no document has are left out; of an id with several labels or
    texts each pair counts; without labels no text scores 0.5; an empty table gives an empty result.
    """
    return scores(docs, fit(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score under 0.5, all columns.

    Null and empty texts stay; repeated rows are decided alike, whatever their ids; without labels
    every row stays; an empty table gives an empty result; other columns are passed on.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array([t is None or shared.value.score(t) < 0.5 for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
