"""Repeated word windows against a plain scan, with sketches so small that they overestimate."""

import hashlib
import random
import re

import numpy as np
import pytest
from graphloom.llm import substring_dedup as sd
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"


def plain(rows, span):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    said = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    gone, seen = [set() for _ in rows], set()
    for k in order:
        for i in range(len(said[k]) - span + 1):
            window = tuple(said[k][i : i + span])
            if window in seen:
                gone[k].update(range(i, i + span))
            seen.add(window)
    kept = [" ".join(w for i, w in enumerate(said[k]) if i not in gone[k]) for k in range(len(rows))]
    return [(rows[k][0], len(said[k]), len(gone[k]), hashlib.sha256(kept[k].encode()).hexdigest()) for k in range(len(rows))], kept


def drawn(seed, n=60, words=2000):
    pick = random.Random(seed)
    word = lambda: f"w{pick.randrange(words)}"
    passages = [[word() for _ in range(pick.randint(15, 90))] for _ in range(6)]
    out = []
    for k in range(n):
        text = []
        for _ in range(pick.randint(0, 5)):
            text += pick.choice(passages) if pick.random() < 0.5 else [word() for _ in range(pick.randint(1, 60))]
        out.append((pick.randrange(n), (" " if k % 2 else "\n\t").join(text)))
    out += [(n + k, out[k % 7][1].replace("\n\t", "  ")) for k in range(20)]  # copies but for white space
    return out


ODD = [
    (4, None), (4, ""), (3, " \n "), (2, "a b c"), (1, "x " * 300), (9, "x " * 70 + "y " * 70), (None, "x " * 50), (5, "one two three four five six seven"),
    (7, "é 日本  non breaking x y z"), (6, "one two three four five six seven"), (6, "one two three four five six seven eight"), (8, " ".join(map(str, range(30_000)))), (10, "0 " + " ".join(map(str, range(100, 400)))),
]


def same(got, rows, span):
    want, kept = plain(rows, span)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


@pytest.mark.parametrize("span, gram", [(5, 2), (20, 8)])
def test_odd_rows(spark, span, gram):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({"num": F.lit(1), "file": F.lit("f"), "kept": F.lit("k"), "digest": F.lit("d")}).repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    same(sd.removal_digests(docs, span, gram).collect(), rows, span)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(spark, seed):
    rows = drawn(seed)
    same(sd.removal_digests(spark.createDataFrame(rows, SCHEMA)).collect(), rows, sd.SPAN)


def test_a_sketch_that_is_too_small_loses_nothing(spark, monkeypatch):
    rows = drawn(3)
    monkeypatch.setattr(sd, "CELLS", 64)
    monkeypatch.setattr(sd, "LOAD", 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    same(sd.removal_digests(docs).collect(), rows, sd.SPAN)


def test_texts_are_cut(spark):
    rows = drawn(4, n=20)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], SCHEMA).withColumn("spans", F.lit(1))
    own = [(k, t) for k, (_, t) in enumerate(rows)]
    want, kept = plain(own, sd.SPAN)
    got = {r["doc_id"]: (r["text"], r["spans"]) for r in sd.drop_repeated_passages(docs).collect()}
    for (k, t), w, text in zip(own, want, kept, strict=True):
        assert got[k] == ((text if w[2] else t), 1)


def test_empty_table(spark):
    assert sd.removal_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_last_least():
    pick = np.random.default_rng(1)
    for n, width in ((0, 3), (2, 3), (40, 1), (40, 13)):
        g = pick.integers(0, 6, n).astype(np.uint64)
        want = [max(j for j in range(i, i + width) if g[j] == min(g[i : i + width])) for i in range(max(0, n - width + 1))]
        assert sd.last_least(g, width)[: len(want)].tolist() == want
