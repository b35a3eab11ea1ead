"""Graph analytics over ``nodes`` (id, name, kind, file_path, ...) and ``edges`` (src, dst).

Edges are distinct and without self-loops. Every operator is a plan of joins, aggregations and
windows; the loops (components, reach) run over DataFrames, cut lineage with ``checkpoint`` and
collect one number a round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import fixed
from graphloom.functions.text import is_dynamic
from graphloom.operators.components import APART, clean_edges, components, filled  # noqa: F401  (components is an operator of graphs, asked for here)
from graphloom.sources.shared import ensure_checkpoint_dir, settled

#: Nodes with one edge in from which on chains are taken out before a search without a bound.
CHAINED = 1_000


def callers(edges: DataFrame) -> DataFrame:
    """id and callers: for each target the sorted distinct sources."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("callers"))


def fan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out, cross_file_callers (distinct files other than the node's own)."""
    place = nodes.select(F.col("id").alias("src"), F.col("file_path").alias("src_file"))
    target = nodes.select(F.col("id").alias("dst"), F.col("file_path").alias("dst_file"))
    into = edges.join(place, "src", "left").join(target, "dst").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"), F.count_distinct(F.when(F.col("src_file") != F.col("dst_file"), F.col("src_file"))).alias("cross_file_callers"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").select("id", zero("fan_in"), zero("fan_out"), zero("cross_file_callers"))


def scored(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods with fan and impact score."""
    own = nodes.where(F.col("kind").isin(*fixed.FUNCTION_KINDS))
    score = F.col("cross_file_callers") * 3 + F.col("fan_in") * 0.5 + F.least("complexity", F.lit(15)) + F.when(F.size("flags") > 0, 2).otherwise(0)
    return own.join(fan(nodes, edges), "id").withColumn("score", F.round(score.cast("double"), 2))


def pivotal(nodes: DataFrame, edges: DataFrame, limit: int = fixed.PIVOTAL) -> DataFrame:
    """The ``limit`` highest scores with their rank; ties by id. The limit is the feature, planned as a top-k."""
    top = scored(nodes, edges).orderBy(F.desc("score"), "id").limit(limit)
    # a window without partitions over the limit's rows only
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    return top.select("id", "score", "fan_in", "fan_out", "cross_file_callers", F.col("complexity").cast("long").alias("complexity"), rank.cast("long").alias("rank"))


def module_nodes(nodes: DataFrame, cyclic: DataFrame | None = None) -> DataFrame:
    """Per module: symbols, files, languages in first-seen order of id, has_cycle, dynamic."""
    marked = nodes
    if cyclic is not None:
        marked = nodes.join(cyclic.select("id", F.lit(True).alias("in_cycle")), "id", "left")
    else:
        marked = nodes.withColumn("in_cycle", F.lit(False))
    # first-seen order: the least id of each language, so that a module's list stays as small as its languages
    first = nodes.where("language is not null and language <> ''").groupBy("module", "language").agg(F.min("id").alias("seen")).groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "language"))), lambda s: s["language"]).alias("languages"))
    stats = marked.groupBy("module").agg(
        F.count("*").alias("symbols"),
        F.count_distinct("file_path").alias("files"),
        F.coalesce(F.bool_or(F.coalesce("in_cycle", F.lit(False))), F.lit(False)).alias("has_cycle"),
        F.count_if(is_dynamic("flags")).alias("dynamic"),
    )
    return stats.join(first, "module", "left").withColumn("languages", F.coalesce("languages", F.array().cast("array<string>")))


def module_edges(nodes: DataFrame, edges: DataFrame, kind: str = "calls") -> DataFrame:
    """Edges between different modules with the number of symbol edges behind each."""
    a = nodes.select(F.col("id").alias("src"), F.col("module").alias("src_module"))
    b = nodes.select(F.col("id").alias("dst"), F.col("module").alias("dst_module"))
    crossing = edges.join(a, "src").join(b, "dst").where("src_module <> dst_module")
    return crossing.groupBy("src_module", "dst_module").agg(F.count("*").alias("weight")).withColumn("type", F.lit(kind))


def top_module_edges(links: DataFrame, limit: int = fixed.MODULE_EDGES) -> DataFrame:
    return links.orderBy(F.desc("weight"), "src_module", "dst_module", "type").limit(limit)


def blast_radius(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: dependent files, inbound calls from other files, and the impact tier.

    ``files`` has path and is_production; files that only symbols mention count as not production.
    """
    a = nodes.select(F.col("id").alias("src"), F.col("file_path").alias("src_file"))
    b = nodes.select(F.col("id").alias("dst"), F.col("file_path").alias("path"))
    into = edges.join(a, "src").join(b, "dst").where("src_file <> path").groupBy("path").agg(F.count_distinct("src_file").alias("dependents_count"), F.count("*").alias("total_inbound_calls"))
    known = files.select("path", "is_production").unionByName(nodes.select(F.col("file_path").alias("path"), F.lit(False).alias("is_production"))).groupBy("path").agg(F.bool_or("is_production").alias("is_production"))
    n, calls, low = F.col("dependents_count"), F.col("total_inbound_calls"), F.lower("path")
    named = F.contains(low, F.lit("model")) | F.contains(low, F.lit("schema")) | F.contains(low, F.lit("route"))
    hub = (F.col("is_production") & ((n >= 8) | (calls >= 15))) | (named & (n >= 5))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    counted = known.join(into, "path", "left").select("path", "is_production", zero("dependents_count"), zero("total_inbound_calls"))
    tier = F.when((n >= 8) | hub, "red").when(n >= 3, "yellow").otherwise("green")
    label = F.when(F.col("tier") == "red", "High Impact Hub").when(F.col("tier") == "yellow", "Moderate Impact").otherwise("Safe / Isolated")
    return counted.withColumn("tier", tier).withColumn("tier_label", label)


def dependents(nodes: DataFrame, edges: DataFrame, details: int = fixed.CALLER_DETAILS) -> DataFrame:
    """Per file: the sorted dependent files and the first ``details`` callers (by target, then caller)."""
    a = nodes.select(F.col("id").alias("src"), F.col("name").alias("caller_name"), F.col("file_path").alias("caller_file"), F.col("line_start").alias("caller_line"))
    b = nodes.select(F.col("id").alias("dst"), F.col("name").alias("target_symbol"), F.col("file_path").alias("path"))
    rows = edges.join(a, "src").join(b, "dst").where("caller_file <> path")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("dst", "src"))).where(F.col("k") <= details)
    listed = first.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("src").alias("caller_id"), "caller_name", "caller_file", "caller_line", "target_symbol", F.col("dst").alias("target_id")))), lambda s: s.dropFields("k")).alias("callers"))
    return rows.groupBy("path").agg(F.array_sort(F.collect_set("caller_file")).alias("dependent_files")).join(listed, "path", "left")


def tier_summary(radius: DataFrame) -> DataFrame:
    count = lambda t: F.count_if(F.col("tier") == t).alias(f"{t}_count")
    return radius.agg(F.count("*").alias("total_files"), count("green"), count("yellow"), count("red"))


def cluster_classes(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """id and class (independent, cyclic, dynamic; a node may be both of the last two) of functions and methods."""
    own = nodes.where(F.col("kind").isin(*fixed.FUNCTION_KINDS)).select("id", "flags")
    inner = edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi")
    cyclic = own.select("id").join(members.select("id"), "id", "left_semi")
    dynamic = own.where(is_dynamic("flags")).select("id")
    independent = own.select("id").join(inner.select(F.col("src").alias("id")), "id", "left_anti").join(cyclic, "id", "left_anti").join(dynamic, "id", "left_anti")
    named = lambda d, c: d.select("id", F.lit(c).alias("class"))
    return named(independent, "independent").union(named(cyclic, "cyclic")).union(named(dynamic, "dynamic"))


def function_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between functions and methods."""
    own = nodes.where(F.col("kind").isin(*fixed.FUNCTION_KINDS)).select("id")
    return edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def component_groups(members: DataFrame, edges: DataFrame, limit: int = fixed.SCC_GROUPS) -> DataFrame:
    """The largest components: component, size, members by number of callees (most first), then id."""
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    ranked = members.join(degree, "id", "left").select("component", (-F.coalesce("n", F.lit(0))).alias("k"), "id")
    groups = ranked.groupBy("component").agg(F.count("*").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda s: s["id"]).alias("members"))
    return groups.orderBy(F.desc("size"), "component").limit(limit)


# paths


def ranked_callees(nodes: DataFrame, edges: DataFrame, fan_limit: int = fixed.FLOW_FAN) -> DataFrame:
    """Each source's ``fan_limit`` targets with the most callers: src, dst, k."""
    counted = edges.groupBy("dst").agg(F.count("*").alias("callers")).join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    k = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("callers"), "dst"))
    return edges.join(counted, "dst").withColumn("k", k).where(F.col("k") <= fan_limit).select("src", "dst", "k")


def chains(entries: DataFrame, ranked: DataFrame, depth: int = fixed.FLOW_DEPTH) -> DataFrame:
    """All maximal simple paths of at most ``depth`` nodes from each entry (ord, id) along the ranked callees (src, dst, k).

    Columns: ord, path (ids), turns (rank of each step). A path ends at the depth, or where every
    ranked callee is on it already.
    """
    ensure_checkpoint_dir(ranked.sparkSession)
    alive = entries.select("ord", F.array("id").alias("path"), F.array().cast("array<int>").alias("turns"))
    ended = []
    for _ in range(depth - 1):
        tip = F.element_at("path", -1)
        grown = alive.join(ranked, tip == ranked.src, "left").withColumn("fresh", F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst"))).checkpoint()
        ended.append(grown.groupBy("ord", "path", "turns").agg(F.bool_or("fresh").alias("any")).where("not any").select("ord", "path", "turns"))
        alive = grown.where("fresh").select("ord", F.concat("path", F.array("dst")).alias("path"), F.concat("turns", F.array("k")).alias("turns"))
    out = alive
    for e in ended:
        out = out.union(e)
    return out


def flows(entries: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = fixed.FLOWS, depth: int = fixed.FLOW_DEPTH) -> DataFrame:
    """The flows of the first entries: ord, entry_id, path, length.

    Of each entry its two longest chains count (of equal length the one that turned to later-ranked
    callees first), chains of one node and repeated chains are left out, and the first ``limit`` in
    order of entry stay. ``entries`` are (ord, id); those that are no function or method are skipped.
    Callees are ranked once and stored; entries are walked from in order, a growing number at a time,
    until ``limit`` flows are found.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    own = entries.join(nodes.where(F.col("kind").isin(*fixed.FUNCTION_KINDS)).select("id"), "id", "left_semi").select("ord", "id").checkpoint()
    ranked = ranked_callees(nodes, edges).checkpoint()
    later = F.transform("turns", lambda t: -t)
    rank = F.row_number().over(Window.partitionBy("ord").orderBy(F.desc(F.size("path")), later))
    one_each = F.row_number().over(Window.partitionBy("path").orderBy("ord", "rank"))
    found, left, take = None, own, 4 * limit
    while True:
        some = left.orderBy("ord").limit(take).checkpoint()
        best = chains(some, ranked, depth).withColumn("rank", rank).where((F.col("rank") <= fixed.FLOW_CHAINS) & (F.size("path") >= 2)).select("ord", "path", "rank")
        every = best if found is None else found.union(best)
        found = every.withColumn("k", one_each).where("k = 1").drop("k").checkpoint()
        if some.count() < take or found.limit(limit).count() >= limit:
            break
        left, take = left.join(some.select("ord"), "ord", "left_anti"), 4 * take
    return found.orderBy("ord", "rank").limit(limit).select("ord", F.get("path", F.lit(0)).alias("entry_id"), "path", F.size("path").cast("long").alias("length"))


def flow_membership(found: DataFrame, ids: DataFrame, most: int = fixed.CONTEXT_FLOWS) -> DataFrame:
    """id and flows: the first ``most`` flows (ord, entry_id, path) that hold each id, in order."""
    # of each flow its node and place only; flows are capped, their nodes are joined by equality
    step = found.select("ord", "entry_id", "path", F.explode(F.array_distinct("path")).alias("id")).join(ids.select("id").distinct(), "id", "left_semi")
    k = F.row_number().over(Window.partitionBy("id").orderBy("ord", F.col("path").cast("string")))
    kept = step.withColumn("k", k).where(F.col("k") <= most)
    return kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ord", "entry_id", "path"))), lambda x: F.struct(x["ord"].alias("ord"), x["entry_id"].alias("entry_id"), x["path"].alias("path"))).alias("flows"))


def entry_flows(entries: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries (ord, symbol_id, name) with the path of their flow: the first that starts at the symbol, else at one of that name."""
    at = lambda keys: found.groupBy(*keys).agg(F.min_by("path", F.struct("ord", F.col("path").cast("string"))).alias("path"))
    by_id = at([F.col("entry_id").alias("symbol_id")]).withColumnRenamed("path", "own_path")
    named = found.join(nodes.select(F.col("id").alias("entry_id"), F.col("name").alias("flow_name")), "entry_id")
    by_name = named.groupBy(F.col("flow_name").alias("name")).agg(F.min_by("path", F.struct("ord", F.col("path").cast("string"))).alias("name_path"))
    rows = entries.select("ord", "symbol_id", "name").join(by_id, "symbol_id", "left").join(by_name, "name", "left")
    return rows.select("ord", "symbol_id", "name", F.coalesce("own_path", "name_path").alias("path"))


def hub_files(dependents: DataFrame, path: str, least: int = 3) -> DataFrame:
    """Files other than ``path`` with ``least`` dependents or more: dependents (path, dependents_count, ...)."""
    return dependents.where((F.col("dependents_count") >= least) & (F.col("path") != path))


def edge_counts(edges: DataFrame) -> DataFrame:
    """type, n: edges of each type, and of all under ``total``."""
    by_type = edges.groupBy("type").agg(F.count("*").alias("n"))
    return by_type.union(by_type.agg(F.lit("total").alias("type"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")))


def short_name_degree(links: DataFrame, limit: int = 40) -> DataFrame:
    """name, out_degree: the ``limit`` short names (after the last dot or ``::``) that call the most different short names.

    The limit is the feature; links (src, dst) are dotted names, a name's calls of itself don't count.
    """
    short = lambda c: F.regexp_extract(F.col(c).cast("string"), r"([^.:]*)$", 1)
    distinct = links.select(short("src").alias("name"), short("dst").alias("other")).where("name <> other").distinct()
    return distinct.groupBy("name").agg(F.count("*").alias("out_degree")).orderBy(F.desc("out_degree"), "name").limit(limit)


def hubs(nodes: DataFrame, edges: DataFrame, limit: int = fixed.FLOW_HUBS) -> DataFrame:
    """Entries for a graph without entry points: the functions with the most callees, then callers, then least id."""
    own = nodes.where(F.col("kind").isin(*fixed.FUNCTION_KINDS)).join(fan(nodes, edges), "id").where("fan_out > 0")
    top = own.orderBy(F.desc("fan_out"), F.desc("fan_in"), "id").limit(limit)
    return top.select(F.row_number().over(Window.orderBy(F.desc("fan_out"), F.desc("fan_in"), "id")).alias("ord"), "id")


def neighbourhood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, neighbour, side) of the seeds' direct callers and callees."""
    out = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), F.lit("callee").alias("side"))
    into = edges.join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), F.lit("caller").alias("side"))
    return out.union(into)


def _reach_by_level(edges: DataFrame, seeds: DataFrame, most: int | None) -> DataFrame:
    """id and depth, a level a round; what was seen is stored as one table now and then, not each round."""
    seen = front = seeds.select("id").distinct().withColumn("depth", F.lit(0).cast("long")).checkpoint()
    depth, apart = 0, 1
    while most is None or depth < most:
        depth += 1
        step = edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth).cast("long")).checkpoint()
        if not filled(front):
            break
        seen, apart = seen.union(front), apart + 1
        if apart == APART:
            seen, apart = seen.checkpoint(), 1
    return seen


def hung(up: DataFrame, size: int, watch: Callable[[str], None]) -> DataFrame:
    """id, root and dist of each node of ``up`` (id, to: the only node before it): the first node before it that has no row, and how far it is.

    By doubling, so in as many rounds as the longest chain has binary digits. Nodes behind a ring have no root and no row.
    """
    now = settled(up.select("id", "to", F.lit(1).cast("long").alias("dist")))
    for _ in range(size.bit_length() + 1):
        watch("double")
        then = now.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("dist").alias("more"))
        step = settled(now.join(then, "to", "left").select("id", F.coalesce("further", "to").alias("to"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("further").isNotNull().alias("moved")))
        now = step.select("id", "to", "dist")
        if not filled(step.where("moved")):
            break
    return now.join(now.select(F.col("id").alias("to")), "to", "left_anti").select("id", F.col("to").alias("root"), "dist")


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None, watch: Callable[[str], None] = lambda step: None) -> DataFrame:
    """id and depth: everything that the seeds lead to, each node once at its least depth.

    Up to ``most`` levels, a level a round. Without a bound, chains are taken out first: a node with
    one edge in, from ``to``, is one deeper than ``to``, so it hangs on the first node before it that
    has several edges in or is a seed. What is left is relaxed with these lengths until no depth falls,
    and then the chains get theirs. A graph with few such nodes goes level by level at once.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    if most is not None:
        return _reach_by_level(edges, seeds, most)
    start = seeds.select("id").distinct()
    plain = clean_edges(edges)
    up = plain.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("to")).where("n = 1").select(F.col("dst").alias("id"), "to").join(start, "id", "left_anti").checkpoint()
    size = up.count()
    if size < CHAINED or size * 2 < plain.select("dst").distinct().count():
        return _reach_by_level(edges, start, None)
    tree = hung(up, size, watch).checkpoint()
    of = tree.select(F.col("id").alias("src"), "root", "dist")
    into = plain.join(up.select(F.col("id").alias("dst")), "dst", "left_anti").join(of, "src", "left")
    arcs = into.select(F.coalesce("root", "src").alias("src"), "dst", (F.coalesce("dist", F.lit(0)) + 1).alias("length")).groupBy("src", "dst").agg(F.min("length").alias("length")).checkpoint()
    best = front = start.withColumn("depth", F.lit(0).cast("long")).checkpoint()
    while True:
        watch("relax")
        found = arcs.join(front.withColumnsRenamed({"id": "src", "depth": "d"}), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("d") + F.col("length")).alias("new"))
        front = found.join(best, "id", "left").where("depth is null or new < depth").select("id", F.col("new").alias("depth")).checkpoint()
        if not filled(front):
            break
        best = best.join(front.select("id"), "id", "left_anti").union(front).checkpoint()
    chained = tree.join(best.withColumnsRenamed({"id": "root"}), "root").select("id", (F.col("depth") + F.col("dist")).alias("depth"))
    return best.union(chained)


def degree(links: DataFrame) -> DataFrame:
    """id and degree: distinct links at either end."""
    distinct = links.select("src", "dst", "type").where("src <> dst").distinct()
    return distinct.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def raw_coupling(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """id, part (leaf, dynamic) and severity from unresolved call names: symbols (id), calls (id, callee).

    Dynamic are those that call a risky name, with the worst severity; a leaf has no call at all.
    """
    order = {"HIGH": 0, "MED": 1, "LOW": 2}
    rank = F.lit(None).cast("int")
    for name, severity in fixed.RISKY_CALLS.items():
        rank = F.when(F.col("callee") == name, order[severity]).otherwise(rank)
    risky = calls.select("id", rank.alias("rank")).where("rank is not null").groupBy("id").agg(F.min("rank").alias("rank"))
    named = F.get(F.array(*[F.lit(x) for x in order]), F.col("rank"))
    dynamic = risky.select("id", F.lit("dynamic").alias("part"), named.alias("severity"))
    leaves = symbols.select("id").join(calls.select("id"), "id", "left_anti").select("id", F.lit("leaf").alias("part"), F.lit(None).cast("string").alias("severity"))
    return dynamic.union(leaves)


def coupling_score(edges: Column, cycle_symbols: Column) -> Column:
    return F.round(edges / F.greatest(F.lit(1), cycle_symbols), 3)


# hierarchy


def tree_rows(symbols: DataFrame) -> DataFrame:
    """Adjacency rows (node_id, parent_id, kind, label) of module, folder, file and symbol.

    Folders are prefixes below the module; equal prefixes under different modules keep apart by module.
    """
    parts = F.split("file_path", "/")
    files = symbols.select("module", "file_path").distinct()
    modules = files.select(F.concat(F.lit("module:"), "module").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("module").alias("kind"), F.col("module").alias("label")).distinct()
    depth = F.size(parts)
    prefixes = F.when(depth > 2, F.transform(F.sequence(F.lit(2), depth - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    folders = files.select("module", F.explode(prefixes).alias("prefix")).distinct()
    node = lambda p: F.concat_ws(":", F.lit("folder"), F.col("module"), p)
    up = F.regexp_replace("prefix", r"/[^/]*$", "")
    folder_rows = folders.select(node(F.col("prefix")).alias("node_id"), F.when(F.size(F.split("prefix", "/")) > 2, node(up)).otherwise(F.concat(F.lit("module:"), "module")).alias("parent_id"), F.lit("folder").alias("kind"), F.substring_index("prefix", "/", -1).alias("label"))
    file_up = F.regexp_replace("file_path", r"/[^/]*$", "")
    file_rows = files.select(F.concat(F.lit("file:"), "file_path").alias("node_id"), F.when(depth > 2, node(file_up)).otherwise(F.concat(F.lit("module:"), "module")).alias("parent_id"), F.lit("file").alias("kind"), F.substring_index("file_path", "/", -1).alias("label"))
    symbol_rows = symbols.select(F.concat(F.lit("symbol:"), F.col("id").cast("string")).alias("node_id"), F.concat(F.lit("file:"), "file_path").alias("parent_id"), F.lit("symbol").alias("kind"), F.col("name").alias("label"))
    return modules.union(folder_rows).union(file_rows).union(symbol_rows)


def sibling_order(rows: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Tree rows with ``position`` (from 1) among the children of their parent.

    By kind (module, folder, file, symbol); modules with more children first; symbols by the rank of
    ``ranked`` (id, rank) where they have one; then by label and node_id.
    """
    kinds = F.create_map(*[x for k, name in enumerate(("module", "folder", "file", "symbol")) for x in (F.lit(name), F.lit(k))])
    size = rows.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    out = rows.join(size, "node_id", "left").withColumn("children", F.coalesce("children", F.lit(0)).cast("long"))
    by_rank = F.lit(None).cast("long")
    if ranked is not None:
        out = out.join(ranked.select(F.concat(F.lit("symbol:"), F.col("id").cast("string")).alias("node_id"), F.col("rank").cast("long").alias("rank")), "node_id", "left")
        by_rank = F.col("rank")
    many = F.when(F.col("kind") == "module", -F.col("children"))
    own = Window.partitionBy("parent_id").orderBy(kinds[F.col("kind")], F.asc_nulls_last(many), F.asc_nulls_last(by_rank), "label", "node_id")
    return out.withColumn("position", F.row_number().over(own).cast("long")).select(*rows.columns, "children", "position")


def pointers_up(up: DataFrame, watch: Callable[[str], None]) -> list[DataFrame]:
    """Tables (id, to) from each node of ``up`` (id, to: its parent) to its ancestor 1, 2, 4, ... levels above, as far as there are any."""
    now = settled(up.where("to is not null").distinct())
    out, most = [], now.count().bit_length() + 1
    while filled(now) and len(out) < most:  # parents that go round a ring never run out
        watch("double")
        out.append(now)
        now = settled(now.join(now.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").select("id", F.col("further").alias("to")))
    return out


def tree_search(rows: DataFrame, needle: str, watch: Callable[[str], None] = lambda step: None) -> DataFrame:
    """Rows whose label contains the needle in any case, with all their ancestors; a hit without hits below keeps its subtree.

    Ancestors and subtrees are found by doubled parent pointers, in as many rounds as the depth has binary digits.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    hit = rows.where(F.contains(F.lower("label"), F.lit(needle.lower()))).select(F.col("node_id").alias("id")).distinct()
    pointers = pointers_up(rows.select(F.col("node_id").alias("id"), F.col("parent_id").alias("to")), watch)
    keep = hit.checkpoint()
    for p in pointers:
        keep = keep.union(p.join(keep, "id", "left_semi").select(F.col("to").alias("id"))).distinct().checkpoint()
    # hits with no hit among their descendants: everything below them stays
    inner = pointers[0].join(keep, "id", "left_semi").select(F.col("to").alias("id")) if pointers else keep.limit(0)
    below = hit.join(inner, "id", "left_anti").checkpoint()
    for p in pointers:
        below = below.union(p.join(below.select(F.col("id").alias("to")), "to", "left_semi").select("id")).distinct().checkpoint()
    return rows.join(keep.union(below).distinct().withColumnRenamed("id", "node_id"), "node_id", "left_semi")
