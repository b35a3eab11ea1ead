"""What the routes of the service answer, as relations with nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import fixed
from graphloom.functions.text import split_call
from graphloom.operators import graph

#: The rank of a symbol that is none of the most depended-upon ones.
NO_RANK = 1_000_000


def brief() -> Column:
    """A symbol in short: id, name, qualified, kind, file, line, end."""
    return F.struct("id", "name", "qualified", "kind", F.col("file_path").alias("file"), F.col("line_start").alias("line"), F.col("line_end").alias("end"))


def related(hit: DataFrame, symbols: DataFrame, column: str) -> DataFrame:
    """id and ``column``: the symbols that the wanted ones (id, column of ids) name there, in short and in that order; unknown ids are left out."""
    other = symbols.select(F.col("id").alias("other"), brief().alias("brief"))
    each = hit.select("id", F.posexplode(column).alias("pos", "other")).join(other, "other")
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "brief"))), lambda x: x["brief"]).alias(column))


def context(hit: DataFrame, symbols: DataFrame, insights: DataFrame, flows: DataFrame) -> DataFrame:
    """A row for each wanted symbol (enriched, with source): symbol, callers, calls, children, parent, insight, flows, source.

    Callers, calls and children are symbols in short. The parent is one if the symbol's parent is an id,
    else null. ``insights`` has id, micro and why; ``flows`` has id and flows (entry, chain of names) of
    those that are on one.
    """
    what = F.struct(brief().alias("brief"), "complexity", "flags", "doc", "language", F.col("source").alias("source_kind"), "is_test", "private", "exported")
    out = hit.select("id", what.alias("symbol"), F.col("parent").alias("__up"), "source_text")
    for c in ("callers", "calls", "children"):
        known = related(hit, symbols, c)
        out = out.join(known, "id", "left").withColumn(c, F.coalesce(c, F.array().cast(known.schema[c].dataType)))
    up = symbols.select(F.col("id").alias("__up"), brief().alias("parent"))
    out = out.join(up, "__up", "left").drop("__up").join(insights.select("id", F.struct("micro", "why").alias("insight")), "id", "left")
    out = out.join(flows, "id", "left").withColumn("flows", F.coalesce("flows", F.array().cast(flows.schema["flows"].dataType)))
    return out.select("id", "symbol", "callers", "calls", "children", "parent", "insight", "flows", F.col("source_text").alias("source"))


def usages(hit: DataFrame, symbols: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """A row for each wanted symbol (id, name, ...): symbol, call_site_count (callers) and callers in short, each with its first ``most`` raw calls of that name."""
    target = hit.select(F.col("id").alias("dst"), F.col("name").alias("wanted"))
    into = edges.join(target, "dst").join(symbols.withColumn("brief", brief()).select(F.col("id").alias("src"), "brief", "raw_calls"), "src")
    raw = F.slice(F.filter("raw_calls", lambda r: split_call(r)["tail"] == F.col("wanted")), 1, most)
    found = into.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list(F.struct("brief", raw.alias("raw_calls")))).alias("callers"))
    out = hit.select("id", brief().alias("symbol")).join(found, "id", "left")
    return out.select("id", "symbol", F.coalesce(F.size("callers"), F.lit(0)).cast("long").alias("call_site_count"), F.coalesce("callers", F.array().cast(found.schema["callers"].dataType)).alias("callers"))


def tree_view(files: DataFrame, symbols: DataFrame, ranked: DataFrame, level: int) -> DataFrame:
    """The rows of the tree at a level of detail: node_id, parent_id, kind, label, detail, count, position.

    Files (path, module, symbols) are always there, symbols from level 2 on, tests and private ones at
    level 3 only. A module counts its files' symbols, a file its own; files tell their path, symbols
    their kind. Below a file the most depended-upon symbols (``ranked``: id, rank) come first, then by line.
    """
    places = files.select(F.lit(None).cast("string").alias("id"), F.lit("").alias("name"), "module", F.col("path").alias("file_path"))
    rows = graph.tree_rows(places).where("kind <> 'symbol'")
    counts = files.select(F.concat(F.lit("file:"), "path").alias("node_id"), F.col("path").alias("detail"), F.col("symbols").alias("count")).unionByName(files.groupBy(F.concat(F.lit("module:"), "module").alias("node_id")).agg(F.sum("symbols").alias("count")).withColumn("detail", F.lit(None).cast("string")))
    none = F.lit(None).cast("long")
    out = rows.join(counts, "node_id", "left").withColumns({"rank": none, "line": none})
    if level >= 2:
        shown = symbols if level >= 3 else symbols.where("not is_test and not private")
        own = shown.join(ranked.select("id", "rank"), "id", "left").select(F.concat(F.lit("symbol:"), "id").alias("node_id"), F.concat(F.lit("file:"), "file_path").alias("parent_id"), F.lit("symbol").alias("kind"), F.col("name").alias("label"), F.concat("kind", F.when(F.col("is_test"), " test").otherwise("")).alias("detail"), none.alias("count"), F.coalesce("rank", F.lit(NO_RANK)).cast("long").alias("rank"), F.col("line_start").cast("long").alias("line"))
        out = out.unionByName(own)
    order = F.array_position(F.array(*[F.lit(k) for k in fixed.TREE_KINDS]), F.col("kind"))
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy(order, F.asc_nulls_last("rank"), F.asc_nulls_last("line"), "label", "node_id"))
    return out.withColumn("position", place.cast("long")).select("node_id", "parent_id", "kind", "label", "detail", F.col("count").cast("long").alias("count"), "position")
