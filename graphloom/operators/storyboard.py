"""A property graph of services, routes, functions, models, files and authorship."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import degree
from graphloom.operators.matching import band_pairs, contains_pairs, first_per


def _link(rows: DataFrame, src, dst, kind: str, weight: int) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"))


def node_rows(services: DataFrame, routes: DataFrame, models: DataFrame, functions: DataFrame, popups: DataFrame | None = None) -> DataFrame:
    """id, name, category, file_path in the order services, routes, models, functions, authorship, files."""
    fe = services.select(F.concat_ws(":", F.lit("fe"), "calling_component", "function_name").alias("id"), F.col("function_name").alias("name"), F.lit("frontend").alias("category"), "file_path")
    ro = routes.select(F.concat(F.lit("route:"), "method", F.lit("_"), "path").alias("id"), F.concat_ws(" ", "method", "path").alias("name"), F.lit("route").alias("category"), "file_path")
    mo = models.select(F.concat(F.lit("model:"), "name").alias("id"), "name", F.lit("model").alias("category"), "file_path")
    fn = functions.select(F.concat(F.lit("fn:"), "name").alias("id"), "name", F.lit("function").alias("category"), "file_path")
    parts = [fe, ro, mo, fn]
    if popups is not None:
        parts.append(popups.select(F.concat(F.lit("git:"), "symbol_name").alias("id"), F.col("symbol_name").alias("name"), F.lit("git").alias("category"), F.lit(None).cast("string").alias("file_path")))
    rows = reduce(DataFrame.unionByName, [p.withColumn("ord", F.lit(k)) for k, p in enumerate(parts)])
    return first_per(rows, ["id"], "ord", "file_path")


def links(nodes: DataFrame, services: DataFrame, routes: DataFrame, models: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Distinct (src, dst, type, weight). ``functions`` (name, file_path, line, code), ``calls`` (caller, callee) by name."""
    fe = services.select(F.concat_ws(":", F.lit("fe"), "calling_component", "function_name").alias("text_id"), F.col("target_endpoint").alias("text"))
    ro = routes.select(F.concat(F.lit("route:"), "method", F.lit("_"), "path").alias("rid"), "path", "handler_name", "file_path", F.col("line_start").alias("line"))
    fn = functions.select(F.concat(F.lit("fn:"), "name").alias("fid"), "name", "file_path", "line", "code")
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    same = fe.join(ro, bare(F.col("text")) == bare(F.col("path"))).select("text_id", "rid")
    within = contains_pairs(fe, ro.select(F.col("rid").alias("needle_id"), F.col("path").alias("needle")).distinct()).select("text_id", F.col("needle_id").alias("rid"))
    to_route = _link(same.union(within).distinct(), F.col("text_id"), F.col("rid"), "routes_to", 3)
    handler = ro.select(F.col("rid").alias("text_id"), F.col("handler_name").alias("text"))
    a = contains_pairs(handler, fn.select(F.col("fid").alias("needle_id"), F.col("name").alias("needle")).distinct()).select(F.col("text_id").alias("rid"), F.col("needle_id").alias("fid"))
    b = contains_pairs(fn.select(F.col("fid").alias("text_id"), F.col("name").alias("text")), ro.select(F.col("rid").alias("needle_id"), F.col("handler_name").alias("needle")).distinct()).select(F.col("needle_id").alias("rid"), F.col("text_id").alias("fid"))
    near = band_pairs(ro.select("rid", "file_path", "line"), fn.select("fid", "file_path", "line"), ["file_path"], "line", 30).select("rid", F.col("fid_r").alias("fid"))
    to_function = _link(a.union(b).union(near).distinct(), F.col("rid"), F.col("fid"), "calls", 2)
    known = functions.select("name").distinct()
    between = calls.join(known.withColumnRenamed("name", "caller"), "caller", "left_semi").join(known.withColumnRenamed("name", "callee"), "callee", "left_semi")
    between = _link(between, F.concat(F.lit("fn:"), "caller"), F.concat(F.lit("fn:"), "callee"), "calls", 2)
    low = models.select(F.concat(F.lit("model:"), "name").alias("needle_id"), F.explode(F.array(F.lower("name"), F.lower("table_name"))).alias("needle"))
    code = fn.select(F.col("fid").alias("text_id"), F.lower("code").alias("text"))
    where = ro.select(F.col("rid").alias("text_id"), F.lower(F.concat_ws("\n", "path", "handler_name")).alias("text"))
    to_model = _link(contains_pairs(code.union(where), low), F.col("text_id"), F.col("needle_id"), "persists_to", 2)
    placed = first_per(nodes.where("file_path is not null and file_path <> ''"), ["file_path"], "ord", "id")
    contains = _link(placed, F.concat(F.lit("file:"), "file_path"), F.col("id"), "contains", 1)
    author = nodes.where("category = 'git'").select("id", "name").join(known, "name")
    authored = _link(author, F.col("id"), F.concat(F.lit("fn:"), "name"), "authored_by", 1)
    return reduce(DataFrame.union, [to_route, to_function, between, to_model, contains, authored]).where("src <> dst").dropDuplicates(["src", "dst", "type"])


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    files = nodes.where("file_path is not null and file_path <> ''").select("file_path").distinct().select(F.concat(F.lit("file:"), "file_path").alias("id"), F.substring_index("file_path", "/", -1).alias("name"), F.lit("file").alias("category"), "file_path", F.lit(9).alias("ord"))
    return nodes.unionByName(files).join(degree(edges), "id", "left").fillna({"degree": 0})
