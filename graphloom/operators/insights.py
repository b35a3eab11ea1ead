"""Texts about symbols, kept by content hash: which are missing, making them, keeping and clamping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import clean, clean_prose, first_words, insight_key, micro_label, why_sentence
from graphloom.operators.delta import delta
from graphloom.sources.files import ship

PROMPT_VERSION = "1"
BATCH = 60
Provider = Callable[[list[dict]], dict[str, dict]]


def keyed(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("key", insight_key(PROMPT_VERSION, "hash", "deps_hash"))


def wanted(symbols: DataFrame, old: DataFrame, entries: DataFrame, force: bool = False, live: bool = False) -> DataFrame:
    """ids to make: added and changed symbols; with a live provider also those without a present entry or with an automatic one; all if forced."""
    if force:
        return symbols.select("id")
    ids = delta(old, symbols).where(F.col("status").isin("added", "changed")).select("id")
    if live:
        valid = keyed(symbols).join(entries.where("source <> 'auto'").select("id", "key"), ["id", "key"], "left_anti").select("id")
        ids = ids.union(valid).distinct()
    return ids


def automatic(symbols: DataFrame) -> DataFrame:
    """id, micro, why, source, key from the facts alone, without Python."""
    why = why_sentence("doc", "kind", "file_path", "line_start", F.size("callers"), F.size("calls"), "complexity", "flags", "is_test")
    return keyed(symbols).select("id", micro_label("doc", "name", "kind").alias("micro"), F.substring(clean(why), 1, 320).alias("why"), F.lit("auto").alias("source"), "key")


def provided(symbols: DataFrame, provider: Provider, name: str, batch: int = BATCH) -> DataFrame:
    """The same with a provider's texts where it gives them: batches within a partition, answers for unknown ids dropped.

    A provider that raises leaves its batch to the automatic texts.
    """
    ship(symbols.sparkSession)
    columns = ["id", "name", "kind", "file_path", "doc"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for at in range(0, len(part), batch):
                asked = part.iloc[at : at + batch].to_dict("records")
                known = {r["id"] for r in asked}
                try:
                    got = provider(asked)
                except Exception:  # noqa: BLE001 - any failure of a provider means its fallback
                    got = {}
                rows += [(i, str(x.get("micro") or ""), str(x.get("why") or "")) for i, x in got.items() if i in known and isinstance(x, dict)]
            yield pd.DataFrame(rows, columns=["id", "p_micro", "p_why"])

    answers = symbols.select(*columns).mapInPandas(run, "id string, p_micro string, p_why string").where("p_micro <> ''").dropDuplicates(["id"])
    rows = automatic(symbols).join(answers, "id", "left")
    own = F.col("p_micro").isNotNull()
    return rows.select("id", F.when(own, first_words("p_micro")).otherwise(F.col("micro")).alias("micro"), F.when(own, F.substring(clean("p_why"), 1, 320)).otherwise(F.col("why")).alias("why"), F.when(own, name).otherwise(F.col("source")).alias("source"), "key")


def refreshed(entries: DataFrame, made: DataFrame, valid: DataFrame) -> DataFrame:
    """Entries with the new ones put over the old and those of gone symbols pruned."""
    rest = entries.join(made.select("id"), "id", "left_anti").join(valid.select("id"), "id", "left_semi")
    return rest.unionByName(made)


def batch_rows(symbols: DataFrame, edges: DataFrame, names: int = 8) -> DataFrame:
    """What a provider is told of each symbol, with at most eight names of callers and callees."""
    n = symbols.select("id", "name")
    side = lambda a, b, c: edges.join(n.withColumnRenamed("id", b), b).groupBy(F.col(a).alias("id")).agg(F.slice(F.array_sort(F.collect_set("name")), 1, names).alias(c))
    return symbols.join(side("dst", "src", "caller_names"), "id", "left").join(side("src", "dst", "callee_names"), "id", "left")


def narrative_hash(digest: DataFrame, version: int, fingerprint: str) -> DataFrame:
    """Of a one-row digest, its version and the tree's fingerprint."""
    text = F.concat(F.lit(f"v{version}|"), F.to_json(F.struct("*")), F.lit(f"|{fingerprint}"))
    return digest.select(F.substring(F.sha2(text, 256), 1, 20).alias("hash"))


def clamped(chapters: DataFrame, most: int = 8, characters: int = 2000) -> DataFrame:
    """Chapters (ord, title, content) cleaned and cut."""
    return chapters.orderBy("ord").limit(most).select("ord", clean_prose("title").alias("title"), F.substring(clean_prose("content"), 1, characters).alias("content"))
