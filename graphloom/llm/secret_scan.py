"""Secret scans: patterns, and Markov models of random strings against ordinary identifiers.

Everything on the main path is a DataFrame expression. The spans of a pattern's matches come from the
lengths of the matches and of what lies between them. Candidates for the models are runs of VALUE_LEAST
or more of the characters that keys are made of. Two first-order character models, one of random
strings and one of ordinary identifiers, are counted from labelled samples; a candidate is a secret if
the logarithm of the likelihood ratio of its best part of VALUE_LEAST characters or more exceeds the
odds against one, so words joined to a key don't hide it. The models are one table of 128 x 128 numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import texts

# The base patterns, and the least lengths of what they must match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, ACCESS_LEAST = r"AKIA[A-Z0-9]+", 18
HEX = r"[0-9a-f]{16,}"  # the runs of 16 or more are just the matches of [0-9a-f]+ that are long enough
VALUE_LEAST = 12
CANDIDATE = r"(?<![\p{L}\p{N}])[A-Za-z0-9+/_=-]{12,}(?![\p{L}\p{N}])"
#: Logarithm of the odds against a candidate being a secret.
ODDS = 12.0
#: Documents from which ordinary identifiers are sampled at most (those with the smallest hash of doc_id).
SAMPLE = 2_000
#: Random strings of each kind among the labelled samples.
RANDOM = 2_000
#: Sampled texts that a word is in at least; how often each library name counts, as words of the texts outnumber them.
COMMON, WEIGHT = 3, 16


_SPAN = "array<struct<start:int,end:int,size:int,match:string>>"
#: Matches whose places are added up together.
_BLOCK = 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, also where it is used inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def spans(text: Column, pattern: str, by_group: bool = False) -> Column:
    """Array of (start, end, size, match) of the pattern's matches, in code points; size is the match's or its first group's length.

    Matches and the gaps between them are found once; places are added up by a fold over each block of
    matches, and where blocks begin by a fold over the blocks, so a text with very many matches is not
    copied once for each of them.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if by_group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    # one gap more than matches: the text's end
    pairs = F.filter(F.arrays_zip(whole.alias("match"), gaps.alias("gap"), group.alias("own")), lambda p: p["match"].isNotNull())

    def placed(p: Column) -> Column:
        last = F.floor(F.greatest(F.size(p) - 1, F.lit(0)) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(p, b * _BLOCK + 1, _BLOCK))
        length = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["gap"] + F.char_length(x["match"]))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int>>").alias("begins"))
        add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["begins"], F.array(F.struct(acc["at"].alias("at")))).alias("begins"))
        begins = F.aggregate(F.transform(blocks, length), none, add, lambda acc: acc["begins"])
        return F.flatten(F.zip_with(blocks, begins, lambda block, begin: F.aggregate(block, F.struct(begin["at"].alias("at"), F.array().cast(_SPAN).alias("found")), step, lambda acc: acc["found"])))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.char_length(p["match"])
        span = F.struct(start.alias("start"), end.alias("end"), F.char_length(p["own"]).alias("size"), p["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    return F.when(text.rlike(pattern), let(pairs, placed)).otherwise(F.array().cast(_SPAN))


def library_names() -> list[str]:
    """Identifiers as people write them: the public names of some of the standard library's modules."""
    import argparse
    import ast
    import asyncio
    import collections
    import concurrent.futures
    import email.message
    import http.client
    import logging
    import os
    import socket
    import ssl
    import subprocess
    import threading
    import unittest
    import urllib.parse

    modules = (argparse, ast, asyncio, collections, concurrent.futures, email.message, http.client, logging, os, socket, ssl, subprocess, threading, unittest, urllib.parse)
    names = {n for m in modules for n in dir(m)} | {n for m in modules for c in vars(m).values() if isinstance(c, type) for n in dir(c)}
    return sorted(n for n in names if n.isascii() and not n.startswith("__"))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """token and random (1 or 0): random strings by rule, and ordinary words of a bounded sample of ``docs``.

    Random strings are base64, base36 and hexadecimal forms of SHA-256 values. Ordinary identifiers are
    names of the standard library, and words of COMMON or more of the sampled texts (so that a key in a
    text does not teach itself), in the ways identifiers are written: in capitals, with a number, joined
    with an underscore, a hyphen, a slash or a capital; also numbers and dates. One text of each sampled
    doc_id counts, so the sample is bounded however often an id is repeated.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    plain = F.regexp_replace(F.base64(F.unhex(digest)), "[=\r\n]", "")
    short = F.upper(F.concat(F.conv(F.substring(digest, 1, 12), 16, 36), F.conv(F.substring(digest, 13, 12), 16, 36)))
    made = spark.range(RANDOM).select(F.explode(F.array(digest, plain, short, F.substring(F.translate(plain, "+/", "_-"), 1, 24))).alias("token"), F.lit(1).alias("random"))
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()
    chosen = texts(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # SAMPLE rows at most
    said = chosen.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("w"))
    words = said.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    pair = words.select("w", F.lead("w", 1, "").over(Window.partitionBy(F.pmod(F.xxhash64("w"), F.lit(64))).orderBy(F.xxhash64("w", F.lit(1)))).alias("v"))
    ordinary = pair.select(F.explode(_written(F.col("w"), F.col("v"))).alias("token"), F.lit(0).alias("random"))
    name = spark.range(1).select(F.explode(F.split(F.lit(",".join(library_names())), ",")).alias("w"))
    names = name.select(F.explode(F.array_repeat(F.concat(F.array("w"), _written(F.col("w"), F.lower("w"))), WEIGHT)).alias("forms")).select(F.explode("forms").alias("token"), F.lit(0).alias("random"))
    n = F.col("id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    numbers = spark.range(RANDOM).select(F.explode(F.array((n * 7919).cast("string"), F.concat_ws("-", n % 900 + 1200, two(n % 12 + 1), two(n % 28 + 1)), F.concat_ws("-", n % 900 + 100, (n * 31) % 900 + 100, (n * 7717) % 9000 + 1000))).alias("token"), F.lit(0).alias("random"))
    return made.union(ordinary).union(names).union(numbers)


def _written(w: Column, v: Column) -> Column:
    """A word, and the next, as identifiers have them."""
    number = F.pmod(F.xxhash64(w), F.lit(100)).cast("string")
    low = [w, F.initcap(w), F.upper(w), F.concat(w, number), F.concat(w, F.initcap(v))]
    both = [F.concat_ws(sep, w, v) for sep in ("_", "-", "/")]
    return F.array(*low, *both, F.upper(F.concat_ws("_", w, v)), F.upper(F.concat(w, F.lit("_"), number)))


def ratios(samples: DataFrame, spark: SparkSession) -> list[float]:
    """log P(random) / P(ordinary) of each pair of ASCII characters, 128 x 128, with add-one smoothing."""
    codes = F.transform(F.split("token", ""), F.ascii)
    pair = F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * 128 + b)
    counts = samples.where("token is not null and random is not null").select("random", F.explode(pair).alias("pair")).where("pair between 0 and 16383").groupBy("random", "pair").count()
    n = [[0] * 16384, [0] * 16384]
    for r in counts.collect():  # two rows for each pair of ASCII characters at most
        n[1 if r["random"] == 1 else 0][r["pair"]] += r["count"]
    letters = 65
    out = []
    for a in range(128):
        t0, t1 = (sum(n[k][a * 128 : a * 128 + 128]) for k in (0, 1))
        out += [math.log((n[1][a * 128 + b] + 1) / (t1 + letters)) - math.log((n[0][a * 128 + b] + 1) / (t0 + letters)) for b in range(128)]
    return out


def likelihood_ratio(token: Column, table: list[float], least: int = VALUE_LEAST) -> Column:
    """The greatest sum of the table's numbers over the pairs of neighbours of a part of ``least`` characters or more.

    One fold: ``last`` is the sum over the last least - 1 pairs, ``more`` the best sum of pairs right
    before those (none: 0), ``best`` the greatest of their sums so far.
    """
    width = least - 1
    numbers = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), F.ascii)
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * 128 + b)
    scores = F.transform(pairs, lambda p: F.get(numbers, p))
    both = let(scores, lambda all_: F.transform(all_, lambda x, i: F.struct(x.alias("x"), F.get(all_, i - width).alias("gone"), i.alias("i"))))

    def step(acc: Column, p: Column) -> Column:
        gone = F.coalesce(p["gone"], F.lit(0.0))
        last, more = acc["last"] + p["x"] - gone, F.greatest(F.lit(0.0), acc["more"] + gone)
        best = F.when(p["i"] >= width - 1, F.greatest(acc["best"], last + more)).otherwise(acc["best"])
        return F.struct(last.alias("last"), more.alias("more"), best.alias("best"))

    none = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("more"), F.lit(float("-inf")).alias("best"))
    return F.aggregate(both, none, step, lambda acc: acc["best"])


def secret_spans(docs: DataFrame, samples: DataFrame | None = None, odds: float = ODDS) -> DataFrame:
    """doc_id, and arrays of (start, end) for each kind: assign, access, hex, random.

    ``random`` are candidates that the models call secrets and that lie in no base span. ``samples``
    (token, random) train the models. Null texts are empty; rows are independent, so repeated and
    null doc_ids give a row each; an empty table gives none; other columns are not read.
    """
    table = ratios(labelled_samples(docs) if samples is None else samples, docs.sparkSession)
    text = F.col("text")
    base = texts(docs).select(
        "doc_id",
        F.filter(spans(text, ASSIGN, True), lambda s: s["size"] >= VALUE_LEAST).alias("assign"),
        F.filter(spans(text, ACCESS), lambda s: s["size"] >= ACCESS_LEAST).alias("access"),
        spans(text, HEX).alias("hex"),
        spans(text, CANDIDATE).alias("candidate"),
    )
    inside = lambda s: F.exists(F.concat("assign", "access", "hex"), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    secret = lambda s: ~inside(s) & (likelihood_ratio(s["match"], table) > odds)
    places = lambda c, name: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(name)
    return base.select("doc_id", *[places(k, k) for k in KINDS[:3]], places(F.filter("candidate", secret), "random"))


KINDS = ("assign", "access", "hex", "random")


def scan(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of each row."""
    found = secret_spans(docs, samples)

    def listed(kinds: tuple[str, ...]) -> Column:
        numbered = lambda n: lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"))
        each = [F.transform(k, numbered(n)) for n, k in enumerate(kinds)]
        names = F.array(*[F.lit(k) for k in kinds])
        ordered = F.array_sort(F.concat(*each))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    size = lambda k: F.size(k).cast("long")
    return found.select("doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"), F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"), listed(KINDS).alias("spans"), size("random").alias("n_random"))
