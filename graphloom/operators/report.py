"""The tables behind reports: statistics, risks, rankings, reading order, summaries, at three levels of detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import fixed
from graphloom.functions.text import is_dynamic, percent

# How many rows each section has by level.
CAPS = {1: {"routines": 8, "modules": 8, "risks": 5, "files": 0, "deep": 0}, 2: {"routines": 20, "modules": 15, "risks": 10, "files": 40, "deep": 0}, 3: {"routines": 40, "modules": 30, "risks": 20, "files": 200, "deep": 24}}
HOT = 12


def level(n: int) -> dict[str, int]:
    """The caps of a level; others count as the nearest."""
    return CAPS[max(1, min(3, n))]


def repo_stats(files: DataFrame, symbols: DataFrame, edges: DataFrame, raw_calls: DataFrame) -> DataFrame:
    """One row of counts."""
    kind = lambda *k: F.count_if(F.col("kind").isin(*k))
    function = F.col("kind").isin(*fixed.FUNCTION_KINDS)
    s = symbols.agg(F.count("*").alias("symbols"), kind("function").alias("functions"), kind("method").alias("methods"), kind(*fixed.CLASS_KINDS).alias("classes"), F.count_if(function & F.col("is_test")).alias("test_functions"), F.count_if(function & ~F.col("is_test")).alias("production_functions"), F.count_distinct("module").alias("modules"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    f = files.agg(F.count("*").alias("files"), F.count_if("is_production").alias("production_files"))
    e = edges.agg(F.count("*").alias("resolved_call_edges"))
    r = raw_calls.agg(F.count("*").alias("raw"))
    # four one-row tables become one row
    rows = s.unionByName(f, True).unionByName(e, True).unionByName(r, True)
    one = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    return one.withColumn("unresolved_call_names", F.greatest(F.lit(0), F.col("raw") - F.col("resolved_call_edges"))).drop("raw")


def resolution_rate(stats: DataFrame, *keys: str) -> DataFrame:
    """Resolved call edges of all calls as a percentage, halves to the even one; ``n/a`` without calls. ``keys`` are passed on."""
    total = F.col("resolved_call_edges") + F.col("unresolved_call_names")
    return stats.select(*keys, F.when(total > 0, percent("resolved_call_edges", total)).otherwise("n/a").alias("rate"))


def hotspots(symbols: DataFrame, n: int = 6, least: int = HOT) -> DataFrame:
    """The most complex functions."""
    return symbols.where(F.col("kind").isin(*fixed.FUNCTION_KINDS) & (F.col("complexity") >= least)).orderBy(F.desc("complexity"), "id").limit(n)


def risk_register(symbols: DataFrame, members: DataFrame, groups_limit: int = 8) -> DataFrame:
    """severity, title, weight: cycles, dynamic dispatch, complexity and thin tests, the weightiest first."""
    groups = members.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(groups_limit)
    cycles = groups.select(F.when(F.col("n") >= 3, "danger").otherwise("warn").alias("severity"), F.format_string("Circular dependency across %d symbols", F.col("n")).alias("title"), (F.lit(900) + F.col("n")).alias("weight"))
    functions = symbols.where(F.col("kind").isin(*fixed.FUNCTION_KINDS))
    dynamic = functions.where(is_dynamic("flags")).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("warn").alias("severity"), F.format_string("%d symbols use dynamic dispatch", F.col("n")).alias("title"), (F.lit(700) + F.least("n", F.lit(99))).alias("weight"))
    hot = hotspots(symbols).agg(F.count("*").alias("n")).where("n > 0").select(F.when(F.col("n") < 4, "warn").otherwise("danger").alias("severity"), F.format_string("%d routine(s) at complexity 12 or above", F.col("n")).alias("title"), (F.lit(600) + F.col("n")).alias("weight"))
    tests = functions.agg(F.count_if("is_test").alias("t"), F.count_if(~F.col("is_test")).alias("p")).where("p > 0 and t / p < 0.15").select(F.lit("warn").alias("severity"), F.lit("Thin test surface").alias("title"), F.lit(500).cast("long").alias("weight"))
    return cycles.union(dynamic).union(hot).union(tests).orderBy(F.desc("weight"), "title")


def key_routines(ranked: DataFrame, symbols: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of a ranking that are no tests."""
    own = ranked.join(symbols.where(~F.col("is_test")).select("id", "qualified", "file_path"), "id")
    return own.orderBy("rank").limit(n)


def deep_candidates(ranked: DataFrame, symbols: DataFrame, flagged: DataFrame, n: int, per_file: int = 3) -> DataFrame:
    """id, deep_score: rank score plus 6 on a cycle or dynamic, plus 2 with flags; at most three of a file."""
    marked = flagged.select("id").distinct().withColumn("risky", F.lit(True))
    rows = ranked.select("id", "score").join(symbols.where(~F.col("is_test")).select("id", "file_path", "flags"), "id").join(marked, "id", "left")
    scored = rows.withColumn("deep_score", F.col("score") + F.when(F.col("risky"), 6).otherwise(0) + F.when(F.size("flags") > 0, 2).otherwise(0))
    k = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("deep_score"), "id"))
    return scored.withColumn("k", k).where(F.col("k") <= per_file).orderBy(F.desc("deep_score"), "id").limit(n).select("id", "file_path", "deep_score")


def module_profiles(symbols: DataFrame, ranked: DataFrame, n: int) -> DataFrame:
    """The first ``n`` functions of each module by rank (those without come last), then complexity: module, k, id."""
    rank = F.coalesce("rank", F.lit(1_000_000))
    rows = symbols.where(F.col("kind").isin(*fixed.FUNCTION_KINDS)).select("id", "module", "complexity").join(ranked.select("id", "rank"), "id", "left")
    k = F.row_number().over(Window.partitionBy("module").orderBy(rank, F.desc("complexity"), "id"))
    return rows.withColumn("k", k).where(F.col("k") <= n).select("module", F.col("k").cast("long").alias("k"), "id")


def file_inventory(files: DataFrame, n: int) -> DataFrame:
    layer = F.when(F.col("is_test"), "test").when(F.col("is_production"), "prod").otherwise("support")
    return files.withColumn("layer", layer).orderBy(F.desc("symbols"), "path").limit(n)


def reading_order(entries: DataFrame, routines: DataFrame, models: DataFrame, cyclic: DataFrame, hubs: int = 5) -> DataFrame:
    """step, title: three entry points, the first routines, the data models, the cycles."""
    a = entries.orderBy("ord").limit(3).select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy("ord")).cast("long").alias("ord"), F.concat(F.lit("Start at the entry point "), F.col("name").cast("string")).alias("title"))
    b = routines.orderBy("rank").limit(hubs).select(F.lit(2).alias("part"), F.col("rank").cast("long").alias("ord"), F.concat(F.lit("Read "), "qualified").alias("title"))
    c = models.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(3).alias("part"), F.lit(1).cast("long").alias("ord"), F.lit("Understand the data layer").alias("title"))
    d = cyclic.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(4).alias("part"), F.lit(1).cast("long").alias("ord"), F.lit("Treat the cycle groups as hazardous").alias("title"))
    rows = a.union(b).union(c).union(d)  # a dozen rows
    return rows.select(F.row_number().over(Window.orderBy("part", "ord", "title")).cast("long").alias("step"), "title")


def centre_of_gravity(ranked: DataFrame, symbols: DataFrame, n: int = 3) -> DataFrame:
    """root, held: the first path part that most of the top routines share; the earliest of equals."""
    top = ranked.orderBy("rank").limit(n).join(symbols.select("id", "file_path"), "id").withColumn("root", F.substring_index("file_path", "/", 1))
    return top.groupBy("root").agg(F.count("*").alias("held"), F.min("rank").alias("first")).orderBy(F.desc("held"), "first").limit(1).select("root", "held")


def roadmap(stats: DataFrame, hot: DataFrame, cyclic: DataFrame, dynamic: DataFrame, entries: DataFrame) -> DataFrame:
    """step, kind, n: what to mend first, each with its evidence."""
    count = lambda d, k, o: d.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(o).alias("o"), F.lit(k).alias("kind"), "n")
    thin = stats.where("production_functions > 0 and test_functions / production_functions < 0.15").select(F.lit(4).alias("o"), F.lit("tests").alias("kind"), F.col("test_functions").alias("n"))
    unresolved = stats.where("unresolved_call_names > 0").select(F.lit(6).alias("o"), F.lit("unresolved").alias("kind"), F.col("unresolved_call_names").alias("n"))
    rows = count(cyclic, "cycles", 1).union(count(dynamic, "dynamic", 2)).union(count(hot, "hotspots", 3)).union(thin).union(count(entries, "entries", 5)).union(unresolved)
    return rows.select(F.row_number().over(Window.orderBy("o")).cast("long").alias("step"), "kind", F.col("n").cast("long").alias("n"))


def mermaid(edges: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """One row: a left-to-right diagram of the edges."""
    line = F.concat(F.lit("  "), F.regexp_replace(F.col(a), r"\W", "_"), F.lit(" --> "), F.regexp_replace(F.col(b), r"\W", "_"))
    rows = edges.select(F.struct(*order, line.alias("line")).alias("x"))
    return rows.agg(F.concat(F.lit("graph LR\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")).alias("text"))


def compact_tree(symbols: DataFrame) -> DataFrame:
    """The symbols' columns that a tree view needs, lists and texts cut to their caps."""
    return symbols.select("id", "name", "qualified", "kind", "file_path", "line_start", "line_end", "complexity", F.slice("calls", 1, 40).alias("calls"), F.slice("callers", 1, 40).alias("callers"), F.substring("doc", 1, 200).alias("doc"), F.slice("flags", 1, 6).alias("flags"))


def html(rows: list[tuple[str, DataFrame]], title: str) -> str:
    """Sections as one document; sections are capped tables, so they come to the driver."""
    from html import escape

    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, df in rows:
        got = df.collect()
        if not got:
            continue
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape(str(v)) if v is not None else ''}</td>" for v in r) + "</tr>" for r in got)
        out.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join([*out, "</body></html>"])


def metric_cards(stats: DataFrame, detail: int) -> DataFrame:
    """label, n: the headline numbers of a level; beyond the first four, zeros are left out."""
    names = ["files", "symbols", "resolved_call_edges", "modules"] + (["test_functions", "production_functions", "classes"] if detail >= 2 else []) + (["methods", "unresolved_call_names"] if detail >= 3 else [])
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("label"), F.col(n).cast("long").alias("n")) for k, n in enumerate(names)])
    return stats.select(F.explode(rows).alias("x")).select("x.*").where("ord < 4 or n > 0")


def subsystems(symbols: DataFrame) -> DataFrame:
    """Labels whose words are in some symbol's name or path."""
    pool = F.concat_ws(" ", F.lower("name"), F.lower("file_path"))
    hit = lambda words: F.coalesce(F.bool_or(pool.rlike("|".join(words))), F.lit(False))
    one = symbols.agg(*[hit(w).alias(n) for n, w in fixed.SUBSYSTEMS.items()])
    return one.select(F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in fixed.SUBSYSTEMS]))).alias("subsystem"))


def symbol_evidence(picks: DataFrame, symbols: DataFrame, files: DataFrame, most: int = 12, lines_most: int = 60) -> DataFrame:
    """Picked ids with callers and callees (``most`` each), the file's history and the source."""
    from graphloom.operators.lines import source_slice

    s = symbols.join(picks.select("id"), "id", "left_semi")
    rows = s.join(files.select(F.col("path").alias("file_path"), "content"), "file_path", "left")
    return rows.select("id", "qualified", F.slice("callers", 1, most).alias("callers"), F.slice("calls", 1, most).alias("calls"), source_slice("content", "line_start", "line_end", 0, lines_most).alias("source_text"))
