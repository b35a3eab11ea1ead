"""Ranked search and its stopping rule against a plain scorer."""

import math
import random
import re
from collections import Counter

import pytest
from graphloom.llm import lexical
from pyspark.sql import functions as F

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    n, length = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for row, (d, c) in enumerate(own):
            m = 25 + (75 * sum(c.values()) * n) // length if length else 0
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, row, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(str, out))


def got(frame):
    return sorted(str((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in frame.collect())


ODD = [(1, "Red fish, blue fish"), (2, "red  RED red"), (3, None), (4, ""), (5, "... --- !!"), (6, "blue É é x_y 9"), (7, "fish " * 5000 + "end"), (8, "blue sky"), (8, "blue sky"), (None, "blue sky"), (9, "日本語 text")]
ASKED = [(1, "red fish"), (2, "BLUE blue sky"), (3, None), (4, "?!"), (5, "nowhere to be found"), (6, "É 9 y"), (6, "É 9 y"), (7, "日本語")]


@pytest.mark.parametrize("k", [2, 10])
def test_odd_rows(spark, k):
    docs = spark.createDataFrame(ODD, DOCS).withColumns({"n": F.lit("x"), "score": F.lit(1), "row": F.lit(1)})
    assert got(lexical.search(docs, spark.createDataFrame(ASKED, ITEMS).withColumn("doc_id", F.lit(1)), k=k)) == plain(ODD, ASKED, k)


def drawn(n, seed=5):
    pick = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    weight = [1 / (k + 1) for k in range(300)]
    return [(k, " ".join(pick.choices(words, weight, k=pick.randint(1, 60)))) for k in range(n)]


def test_rounds_stop_early_and_lose_nothing(spark):
    docs = drawn(1500)
    items = [(k, " ".join(f"w{j}" for j in range(3 * k, 3 * k + 4))) for k in range(1, 30)]
    watch = []
    found = lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), first=4, growth=2, watch=watch)
    assert got(found) == plain(docs, items)
    assert len(watch) > 2 and watch[-1][1] < watch[0][1]  # some queries were done before others


def test_equal_scores_go_by_id(spark):
    docs = [(k, "same words here") for k in range(200, 0, -1)] + [(k, f"other {k}") for k in range(300, 900)]
    items = [(1, "same here")]
    assert got(lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), first=3, growth=2)) == plain(docs, items)


def test_blocks_of_queries(spark):
    docs, items = drawn(200), [(k, f"w{k} w{k + 1}") for k in range(12)]
    assert got(lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), most=9)) == plain(docs, items)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame(ASKED, ITEMS)
    assert lexical.search(none, some).collect() == []
    assert lexical.search(spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], ITEMS)).collect() == []
