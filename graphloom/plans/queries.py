"""The driver's queries: every operator over whole test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import fixed, text
from graphloom.operators import crawl, delta, dynamic, extract, graph, insights, ledger, lines, matching, report, resolve, ripple, storyboard
from graphloom.plans import model as model_plan
from graphloom.plans import standins as st
from graphloom.plans.standins import table, with_
from graphloom.sources import files as sources
from graphloom.sources import history
from graphloom.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def joined(c: str) -> F.Column:
    """A list as text."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# graph


@query(with_("nodes", "edges", "fan", body="SELECT id, fan_in, fan_out, cross_file_callers FROM fan"))
def fan_in_out(spark, sf):
    return graph.fan(st.nodes(spark, sf), st.edges(spark, sf))


@query(with_("nodes", "edges", "fan", "ranked", body="SELECT id, score, fan_in, fan_out, cross_file_callers, complexity, rank FROM ranked"))
def pivotal_rank(spark, sf):
    return graph.pivotal(st.nodes(spark, sf), st.edges(spark, sf))


@query(with_("edges", body="SELECT dst AS id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS callers FROM edges GROUP BY 1"))
def callers_transpose(spark, sf):
    return graph.callers(st.edges(spark, sf)).select("id", joined("callers").alias("callers"))


@query(
    with_("nodes", "edges", "reach", body="""SELECT n.module, count(*) AS symbols, count(DISTINCT file_path) AS files, bool_or(m.id IS NOT NULL) AS has_cycle, count(*) FILTER (flag LIKE 'dynamic:%') AS dynamic,
 (SELECT string_agg(language, ',' ORDER BY seen) FROM (SELECT module, language, min(id) AS seen FROM nodes GROUP BY 1, 2) l WHERE l.module = n.module) AS languages FROM nodes n LEFT JOIN members m ON m.id = n.id GROUP BY n.module""")
)
def module_rollup(spark, sf):
    n, e = st.nodes(spark, sf), st.edges(spark, sf)
    return graph.module_nodes(n, graph.components(e)).withColumn("languages", joined("languages"))


@query(with_("nodes", "edges", body="SELECT a.module AS src_module, b.module AS dst_module, 'calls' AS type, count(*) AS weight FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.module <> b.module GROUP BY 1, 2 ORDER BY weight DESC, 1, 2, 3 LIMIT 400"))
def module_edges(spark, sf):
    return graph.top_module_edges(graph.module_edges(st.nodes(spark, sf), st.edges(spark, sf)))


RADIUS = """radius AS (SELECT path, d AS dependents_count, c AS total_inbound_calls, CASE WHEN d >= 8 OR (prod AND c >= 15) OR (d >= 5 AND (lower(path) LIKE '%model%' OR lower(path) LIKE '%schema%' OR lower(path) LIKE '%route%')) THEN 'red' WHEN d >= 3 THEN 'yellow' ELSE 'green' END AS tier FROM
 (SELECT f.file_path AS path, NOT bool_and(is_test) AS prod, coalesce(any_value(i.d), 0) AS d, coalesce(any_value(i.c), 0) AS c FROM nodes f LEFT JOIN (SELECT b.file_path AS path, count(DISTINCT a.file_path) AS d, count(*) AS c FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.file_path <> b.file_path GROUP BY 1) i ON i.path = f.file_path GROUP BY 1))"""


def _radius(spark, sf):
    n = st.nodes(spark, sf)
    files = n.groupBy(F.col("file_path").alias("path")).agg((~F.bool_and("is_test")).alias("is_production"))
    return graph.blast_radius(files, n, st.edges(spark, sf))


@query(with_("nodes", "edges", body=f", {RADIUS} SELECT path, dependents_count, total_inbound_calls, tier FROM radius").replace(") , radius", "), radius"))
def blast_radius(spark, sf):
    return _radius(spark, sf).select("path", "dependents_count", "total_inbound_calls", "tier")


@query(with_("nodes", "edges", body=f", {RADIUS} SELECT count(*) AS total_files, count(*) FILTER (tier = 'green') AS green_count, count(*) FILTER (tier = 'yellow') AS yellow_count, count(*) FILTER (tier = 'red') AS red_count FROM radius"))
def tier_summary(spark, sf):
    return graph.tier_summary(_radius(spark, sf))


@query(with_("nodes", "edges", body="SELECT file_path AS path, any_value(files) AS dependent_files, string_agg(src || '>' || dst, ',' ORDER BY dst, src) AS callers FROM (SELECT b.file_path, e.src, e.dst, row_number() OVER (PARTITION BY b.file_path ORDER BY e.dst, e.src) AS k, array_to_string(list_sort(list_distinct(list(a.file_path) OVER (PARTITION BY b.file_path))), ',') AS files FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.file_path <> b.file_path) WHERE k <= 25 GROUP BY 1"))
def file_dependents(spark, sf):
    return graph.dependents(st.nodes(spark, sf), st.edges(spark, sf)).select("path", joined("dependent_files").alias("dependent_files"), F.array_join(F.transform("callers", lambda c: F.concat_ws(">", c["caller_id"].cast("string"), c["target_id"].cast("string"))), ",").alias("callers"))


@query(with_("nodes", "edges", "reach", body="SELECT id, component FROM members"))
def scc_members(spark, sf):
    return graph.components(st.edges(spark, sf))


@query(with_("edges", "reach", body="SELECT component, count(*) AS size, string_agg(CAST(m.id AS VARCHAR), ',' ORDER BY coalesce(o.n, 0) DESC, m.id) AS members FROM members m LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) o ON o.src = m.id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40"))
def scc_groups(spark, sf):
    e = st.edges(spark, sf)
    return graph.component_groups(graph.components(e), e).withColumn("members", joined("members"))


@query(with_("best_edges", "reach", body="SELECT id, component FROM members"))
def scc_of_best_links(spark, sf):
    return graph.components(st.best_edges(spark, sf))


@query(with_("best_edges", "reach", body="SELECT component, count(*) AS size, string_agg(CAST(m.id AS VARCHAR), ',' ORDER BY m.id) AS members FROM members m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40"))
def scc_groups_of_best_links(spark, sf):
    e = st.best_edges(spark, sf)
    return graph.component_groups(graph.components(e), e).withColumn("members", joined("members"))


CLASSES = """inner_edges AS (SELECT e.* FROM edges e JOIN nodes a ON a.id = e.src AND a.kind IN ('function', 'method') JOIN nodes b ON b.id = e.dst AND b.kind IN ('function', 'method')),
 hops AS (SELECT src, dst FROM inner_edges UNION SELECT r.src, e.dst FROM hops r JOIN inner_edges e ON e.src = r.dst), cyc AS (SELECT DISTINCT src AS id FROM hops WHERE src = dst),
 dyn AS (SELECT id FROM nodes WHERE kind IN ('function', 'method') AND flag LIKE 'dynamic:%'),
 ind AS (SELECT id FROM nodes WHERE kind IN ('function', 'method') AND id NOT IN (SELECT src FROM inner_edges) AND id NOT IN (SELECT id FROM cyc) AND id NOT IN (SELECT id FROM dyn))"""


def _classes(spark, sf):
    n, e = st.nodes(spark, sf), st.edges(spark, sf)
    return graph.cluster_classes(n, e, graph.components(graph.function_edges(n, e)))


@query(with_("nodes", "edges", body=f", {CLASSES} SELECT id, 'cyclic' AS class FROM cyc UNION ALL SELECT id, 'dynamic' FROM dyn UNION ALL SELECT id, 'independent' FROM ind"))
def cluster_classes(spark, sf):
    return _classes(spark, sf)


@query(with_("nodes", "edges", body=f", {CLASSES} SELECT 'cyclic' AS class, count(*) AS n FROM cyc HAVING count(*) > 0 UNION ALL SELECT 'dynamic', count(*) FROM dyn HAVING count(*) > 0 UNION ALL SELECT 'independent', count(*) FROM ind HAVING count(*) > 0"))
def cluster_counts(spark, sf):
    return delta.source_histogram(_classes(spark, sf), "class")


@query(with_("nodes", "edges", body="SELECT src, dst, k FROM (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY i.n DESC, e.dst) AS k FROM edges e JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) i USING (dst)) WHERE k <= 2"))
def top2_callees(spark, sf):
    return graph.ranked_callees(st.nodes(spark, sf), st.edges(spark, sf)).withColumn("k", F.col("k").cast("long"))


FLOWS_WITH = with_("nodes", "edges", "fan", body=""", entries AS (SELECT id, row_number() OVER (ORDER BY fan_out DESC, fan_in DESC, id) AS ord FROM fan JOIN nodes USING (id) WHERE kind IN ('function', 'method') AND fan_out > 0 QUALIFY ord <= 8),
 step AS (SELECT src, dst, k FROM (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY i.n DESC, e.dst) AS k FROM edges e JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) i USING (dst)) WHERE k <= 2),
 walk AS (SELECT ord, [id] AS path, CAST([] AS BIGINT[]) AS turns FROM entries UNION ALL SELECT w.ord, list_append(w.path, s.dst), list_append(w.turns, s.k) FROM walk w JOIN step s ON s.src = w.path[-1] WHERE len(w.path) < 4 AND NOT list_contains(w.path, s.dst)),
 leaf AS (SELECT w.* FROM walk w WHERE len(path) = 4 OR NOT EXISTS (SELECT 1 FROM step s WHERE s.src = w.path[-1] AND NOT list_contains(w.path, s.dst))),
 best AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY len(path) DESC, list_transform(turns, lambda t: -t)) AS rank FROM leaf),
 firsts AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord, rank) AS k FROM best WHERE rank <= 2 AND len(path) >= 2)""")
FLOW_SQL = FLOWS_WITH + " SELECT ord, path[1] AS entry_id, array_to_string(path, ',') AS path, len(path) AS length FROM firsts WHERE k = 1 ORDER BY ord, rank LIMIT 12"


@query(FLOW_SQL)
def flows_bounded(spark, sf):
    n, e = st.nodes(spark, sf), st.edges(spark, sf)
    return graph.flows(graph.hubs(n, e), n, e).select(F.col("ord").cast("long").alias("ord"), "entry_id", joined("path").alias("path"), "length")


@query(with_("edges", body="SELECT p_partkey AS id, dst AS neighbour, 'callee' AS side FROM edges JOIN part ON src = p_partkey WHERE p_size = 7 UNION ALL SELECT p_partkey, src, 'caller' FROM edges JOIN part ON dst = p_partkey WHERE p_size = 7"))
def neighbourhood(spark, sf):
    return graph.neighbourhood(st.edges(spark, sf), st.nodes(spark, sf).where("complexity = 7").select("id"))


@query(with_("edges", body=", walk AS (SELECT DISTINCT p_partkey AS id, 0 AS depth FROM part WHERE p_size = 7 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE w.depth < 6) SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY 1"))
def reachability_depth(spark, sf):
    return graph.reach(st.edges(spark, sf), st.nodes(spark, sf).where("complexity = 7").select("id"), 6)


@query(with_("edges", body="SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1"))
def link_degree(spark, sf):
    return graph.degree(st.edges(spark, sf).withColumn("type", F.lit("calls")))


@query("""WITH f AS (SELECT DISTINCT p_type AS module, p_brand || '/' || p_type AS file_path FROM part)
 SELECT 'module:' || module AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 'module' AS kind, module AS label FROM (SELECT DISTINCT module FROM f)
 UNION ALL SELECT 'file:' || file_path, 'module:' || module, 'file', module FROM f
 UNION ALL SELECT 'symbol:' || p_partkey, 'file:' || p_brand || '/' || p_type, 'symbol', p_name FROM part""")
def tree_rows(spark, sf):
    return graph.tree_rows(st.nodes(spark, sf))


@query("""WITH hit AS (SELECT * FROM part WHERE lower(p_name) LIKE '%ring%') SELECT 'symbol:' || p_partkey AS node_id, 'symbol' AS kind FROM hit UNION ALL SELECT DISTINCT 'file:' || p_brand || '/' || p_type, 'file' FROM hit UNION ALL SELECT DISTINCT 'module:' || p_type, 'module' FROM hit""")
def tree_search(spark, sf):
    return graph.tree_search(graph.tree_rows(st.nodes(spark, sf)), "RING").select("node_id", "kind")


@query("""WITH f AS (SELECT DISTINCT p_type AS module, p_brand || '/' || p_type AS file_path FROM part), best AS (SELECT p_partkey AS id, p_size AS rank FROM part WHERE p_size < 10),
 t AS (SELECT 'module:' || module AS node_id, NULL AS parent_id, 0 AS k, module AS label, CAST(NULL AS BIGINT) AS rank, (SELECT count(*) FROM f g WHERE g.module = f.module) AS children FROM f GROUP BY module
 UNION ALL SELECT 'file:' || file_path, 'module:' || module, 2, module, NULL, (SELECT count(*) FROM part p WHERE p.p_brand || '/' || p.p_type = f.file_path) FROM f
 UNION ALL SELECT 'symbol:' || p_partkey, 'file:' || p_brand || '/' || p_type, 3, p_name, rank, 0 FROM part LEFT JOIN best ON id = p_partkey)
 SELECT node_id, children, row_number() OVER (PARTITION BY parent_id ORDER BY k, CASE WHEN k = 0 THEN -children END, rank NULLS LAST, label, node_id) AS position FROM t""")
def sibling_order(spark, sf):
    n = st.nodes(spark, sf)
    ranked = n.where("complexity < 10").select("id", F.col("complexity").alias("rank"))
    return graph.sibling_order(graph.tree_rows(n), ranked).select("node_id", "children", "position")


@query("SELECT l_returnflag AS type, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM lineitem")
def edge_type_counts(spark, sf):
    return graph.edge_counts(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("type")))


@query("SELECT p_type AS name, count(DISTINCT o_orderpriority || s_nationkey) AS out_degree FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def short_name_degree(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return graph.short_name_degree(li.select(F.concat_ws(".", "p_brand", "p_type").alias("src"), F.concat(F.lit("a::b."), "o_orderpriority", "s_nationkey").alias("dst")))


@query(FLOWS_WITH + ", flows AS (SELECT ord, rank, path[1] AS entry_id, path FROM firsts WHERE k = 1 ORDER BY ord, rank LIMIT 12), on_ AS (SELECT unnest(list_distinct(path)) AS id, ord, array_to_string(path, ',') AS path FROM flows) SELECT id, string_agg(path, ';' ORDER BY ord, path) AS flows FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, path) AS m FROM on_) WHERE m <= 3 GROUP BY id")
def flow_membership(spark, sf):
    n, e = st.nodes(spark, sf), st.edges(spark, sf)
    found = graph.flows(graph.hubs(n, e), n, e).withColumn("path", F.transform("path", lambda x: x.cast("string")))
    on = graph.flow_membership(found, n.select(F.col("id").cast("string").alias("id")))
    return on.select(F.col("id").cast("long").alias("id"), F.array_join(F.transform("flows", lambda f: F.array_join(f["path"], ",")), ";").alias("flows"))


@query(FLOWS_WITH + ", flows AS (SELECT ord, rank, path[1] AS entry_id, array_to_string(path, ',') AS path FROM firsts WHERE k = 1 ORDER BY ord, rank LIMIT 12), own AS (SELECT entry_id, arg_min(path, (ord, path)) AS path FROM flows GROUP BY 1), named AS (SELECT name, arg_min(path, (ord, path)) AS path FROM flows JOIN nodes ON id = entry_id GROUP BY 1) SELECT n.id AS ord, coalesce(own.path, named.path) AS path FROM nodes n LEFT JOIN own ON own.entry_id = n.id LEFT JOIN named ON named.name = n.name")
def entry_flows(spark, sf):
    n, e = st.nodes(spark, sf), st.edges(spark, sf)
    found = graph.flows(graph.hubs(n, e), n, e).withColumn("path", F.transform("path", lambda x: x.cast("string")))
    entries = n.select(F.col("id").alias("ord"), F.col("id").alias("symbol_id"), "name")
    return graph.entry_flows(entries, found, n).select("ord", joined("path").alias("path"))


@query(with_("nodes", "edges", body=f", {RADIUS} SELECT path, dependents_count FROM radius WHERE dependents_count >= 3 AND path <> (SELECT min(path) FROM radius)").replace(") , radius", "), radius"))
def hub_files(spark, sf):
    r = _radius(spark, sf)
    return graph.hub_files(r, r.agg(F.min("path")).first()[0]).select("path", "dependents_count")


@query("SELECT o_orderkey AS id, 'dynamic' AS part, CASE o_orderstatus WHEN 'F' THEN 'HIGH' ELSE 'MED' END AS severity FROM orders WHERE o_orderstatus IN ('F', 'O') UNION ALL SELECT c_custkey + 100000000, 'leaf', NULL FROM customer")
def raw_coupling(spark, sf):
    o = table(spark, sf, "orders")
    called = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "eval").when(F.col("o_orderstatus") == "O", "getattr").otherwise("plain").alias("callee"))
    leaves = table(spark, sf, "customer").select((F.col("c_custkey") + 100000000).alias("id"))
    return graph.raw_coupling(called.select("id").union(leaves), called)


# resolution


@query(with_("symbols", "calls", body=""", who AS (SELECT c.*, a.parent AS own_parent, a.file_path AS own_file FROM calls c JOIN symbols a ON a.id = c.src),
 stems AS (SELECT DISTINCT stem, file_path FROM symbols), classes AS (SELECT DISTINCT name, file_path FROM symbols WHERE kind = 'class'),
 cand AS (SELECT w.src, w.pos, w.tail, w.receiver, s.id,
   w.receiver = 'self' AND s.parent = w.own_parent AS r1, w.receiver = 'self' AND s.file_path = w.own_file AS r2,
   w.receiver NOT IN ('', 'self') AND CASE WHEN w.receiver IN (SELECT stem FROM stems) THEN s.stem = w.receiver ELSE EXISTS (SELECT 1 FROM classes k WHERE k.name = w.receiver AND k.file_path = s.file_path) END AS r3,
   w.receiver = '' AND s.kind <> 'method' AND s.file_path = w.own_file AS r4, w.receiver = '' AND s.kind <> 'method' AS r5
   FROM who w JOIN symbols s ON s.name = w.tail),
 picks AS (SELECT src, pos, CASE WHEN count(*) FILTER (r1) = 1 THEN max(id) FILTER (r1) WHEN count(*) FILTER (r2) = 1 THEN max(id) FILTER (r2) WHEN count(*) FILTER (r3) = 1 THEN max(id) FILTER (r3) WHEN count(*) FILTER (r4) = 1 THEN max(id) FILTER (r4) WHEN count(*) FILTER (r5) = 1 THEN max(id) FILTER (r5) END AS dst FROM cand GROUP BY src, pos, tail, receiver)
 SELECT src, dst, min(pos) AS pos FROM picks WHERE dst IS NOT NULL AND dst <> src GROUP BY 1, 2"""))
def call_resolution_cascade(spark, sf):
    return resolve.resolve_calls(st.call_symbols(spark, sf), st.calls(spark, sf))


@query("""WITH owner AS (SELECT min(p_partkey) AS id, p_brand || '/' || p_type AS f, p_name AS q FROM part WHERE p_partkey % 4 = 0 GROUP BY 2, 3)
 SELECT o.id, count(*) AS n, string_agg(CAST(p.p_partkey AS VARCHAR), ',' ORDER BY p.p_partkey) AS children FROM part p JOIN owner o ON o.f = p.p_brand || '/' || p.p_type AND o.q = p.p_name WHERE p.p_partkey % 4 <> 0 GROUP BY 1""")
def children_attach(spark, sf):
    p = table(spark, sf, "part")
    top = F.col("p_partkey") % 4 == 0
    s = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.concat_ws("/", "p_brand", "p_type").alias("file_path"), F.when(top, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(".m"), "p_partkey")).alias("qualified"), F.when(~top, F.col("p_name")).alias("parent"))
    return resolve.children(s).select("id", F.size("children").cast("long").alias("n"), joined("children").alias("children"))


@query("SELECT o_orderkey AS ord, coalesce(p_name, CAST(o_custkey AS VARCHAR)) AS name, p_partkey IS NOT NULL AS resolved FROM orders LEFT JOIN part ON p_partkey = o_custkey * 3")
def entrypoint_left(spark, sf):
    o = table(spark, sf, "orders")
    entries = o.select(F.col("o_orderkey").alias("ord"), (F.col("o_custkey") * 3).alias("symbol_id"), F.col("o_custkey").cast("string").alias("own"))
    out = resolve.entry_points(entries, st.nodes(spark, sf))
    return out.select("ord", F.when(F.col("resolved"), F.col("name")).otherwise(F.col("own")).alias("name"), "resolved")


@query(r"""WITH f AS (SELECT 'apps/n' || c_nationkey || '/f' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.go' ELSE '.ts' END AS path, c_custkey AS k, c_nationkey AS n FROM customer)
 SELECT 'python' AS language, 'apps.n' || n || '.f' || k AS import, path FROM f WHERE k % 3 = 0
 UNION ALL SELECT 'python', 'f' || k, path FROM f WHERE k % 3 = 0
 UNION ALL SELECT 'typescript', './apps/n' || n || '/f' || k, path FROM f WHERE k % 3 = 2
 UNION ALL SELECT 'go', 'x/n' || n || '/f' || k, (SELECT min(g.path) FROM f g WHERE g.k % 3 = 1 AND contains(g.path, 'n' || f.n || '/f' || f.k)) FROM f WHERE k % 3 = 1""")
def import_resolution(spark, sf):
    f = st.files(spark, sf)
    base = f.select("path", "k", "n")
    dotted = base.where("k % 3 = 0").select(F.lit("python").alias("language"), F.concat(F.lit("apps.n"), "n", F.lit(".f"), "k").alias("import"))
    stems = base.where("k % 3 = 0").select(F.lit("python").alias("language"), F.concat(F.lit("f"), "k").alias("import"))
    relative = base.where("k % 3 = 2").select(F.lit("typescript").alias("language"), F.concat(F.lit("./apps/n"), "n", F.lit("/f"), "k").alias("import"))
    tails = base.where("k % 3 = 1").select(F.lit("go").alias("language"), F.concat(F.lit("x/n"), "n", F.lit("/f"), "k").alias("import"))
    return resolve.resolve_imports(dotted.union(stems).union(relative).union(tails), base.select("path")).where("path is not null")


@query("""WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS id, lower(p_brand || '.' || p_name) AS q, lower(p_name) AS n FROM part), w AS (SELECT DISTINCT p_brand || '.' || upper(p_name) AS needle FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders),
 t AS (SELECT needle, id, 1 AS tier FROM w JOIN s ON needle = id UNION ALL SELECT needle, id, 2 FROM w JOIN s ON lower(needle) = q UNION ALL SELECT needle, id, 3 FROM w JOIN s ON lower(needle) = n UNION ALL SELECT needle, id, 4 FROM w JOIN s ON lower(needle) = q OR lower(needle) = n),
 c AS (SELECT needle, tier, count(*) AS k, min(id) AS id FROM t GROUP BY 1, 2), b AS (SELECT needle, arg_min(id, tier) AS id FROM c WHERE k = 1 GROUP BY 1)
 SELECT w.needle, b.id, CASE WHEN b.id IS NOT NULL THEN 'found' WHEN EXISTS (SELECT 1 FROM c WHERE c.needle = w.needle AND tier >= 3) THEN 'ambiguous' ELSE 'not found' END AS status FROM w LEFT JOIN b USING (needle)""")
def find_symbol(spark, sf):
    n = st.nodes(spark, sf)
    needles = table(spark, sf, "part").select(F.concat(F.col("p_brand"), F.lit("."), F.upper("p_name")).alias("needle")).union(n.select("name")).union(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string"))).distinct()
    return resolve.find_symbol(n, needles).select("needle", "id", "status")


@query(with_("symbols", "calls", "edges", body=""", said AS (SELECT tail, src, pos, CASE WHEN receiver = '' THEN '' ELSE receiver || '.' END || tail || '(x)' AS raw FROM calls), first5 AS (SELECT tail, src, pos, raw, row_number() OVER (PARTITION BY tail ORDER BY src, pos, raw) AS k FROM said), rows5 AS (SELECT tail, string_agg(raw, ',' ORDER BY k) AS raws FROM first5 WHERE k <= 5 GROUP BY 1), into_ AS (SELECT dst AS id, count(*) AS n, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS callers FROM edges GROUP BY 1)
 SELECT s.id, s.name, coalesce(i.n, 0) AS call_site_count, i.callers, r.raws AS raw_calls FROM symbols s LEFT JOIN into_ i USING (id) LEFT JOIN rows5 r ON r.tail = s.name"""))
def usages(spark, sf):
    s = st.call_symbols(spark, sf)
    out = resolve.usages(s, st.edges(spark, sf), st.calls(spark, sf), s.select("id"))
    return out.select("id", "name", "call_site_count", joined("callers").alias("callers"), joined("raw_calls").alias("raw_calls"))


DOWNSTREAM = with_("symbols", "calls", "edges", body=""", t AS (SELECT id AS target_id, name AS target, file_path AS target_file FROM symbols), meta AS (SELECT p_partkey AS id, p_partkey % 7 = 0 AS is_test FROM part),
 direct AS (SELECT t.target_id, 1 AS branch, s.file_path AS file, s.name AS symbol FROM edges e JOIN t ON t.target_id = e.dst JOIN symbols s ON s.id = e.src),
 implicit AS (SELECT DISTINCT t.target_id, 3 AS branch, s.file_path AS file, s.name AS symbol FROM calls c JOIN t ON t.target = c.tail JOIN symbols s ON s.id = c.src WHERE s.file_path <> t.target_file)
 SELECT * FROM direct UNION ALL SELECT i.* FROM implicit i ANTI JOIN direct d ON d.target_id = i.target_id AND d.file = i.file AND d.symbol = i.symbol""")


@query(DOWNSTREAM)
def downstream_scan(spark, sf):
    n = st.nodes(spark, sf)
    s = st.call_symbols(spark, sf).join(n.select("id", "line_start", "is_test"), "id")
    none = spark.createDataFrame([], "name string, file_path string, line long")
    # names of two words: the last word is what a call is joined by
    raw = st.calls(spark, sf).withColumn("raw", F.replace("raw", F.lit(" "), F.lit("_")))
    s = s.withColumn("name", F.replace("name", F.lit(" "), F.lit("_")))
    out = ripple.downstream(s, s, st.edges(spark, sf), none, raw)
    return out.select("target_id", "branch", "file", F.regexp_replace("symbol", "^([^_]*)_", "$1 ").alias("symbol"))


# windows over ordered rows


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN sha256(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def carry_forward(spark, sf):
    c = table(spark, sf, "conversations")
    return lines.carry_forward(c, F.when(F.col("role") == "user", F.sha2("text", 256)), ["conv_id"], ["turn"], "asked").select("conv_id", "turn", "asked")


@query("SELECT conv_id, turn, first_value(CASE WHEN role = 'assistant' THEN sha256(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS answer FROM conversations")
def look_ahead(spark, sf):
    c = table(spark, sf, "conversations")
    return lines.look_ahead(c, F.when(F.col("role") == "assistant", F.sha2("text", 256)), ["conv_id"], ["turn"], 14, "answer").select("conv_id", "turn", "answer")


@query("SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM events")
def islands(spark, sf):
    e = table(spark, sf, "events")
    return lines.islands(e, F.col("event_type") == "error", ["user_id"], ["ts"]).select("user_id", "event_id", "island")


@query("SELECT user_id AS ledger, event_id AS at, CAST(sum(event_id % 9 + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events")
def ledger_running(spark, sf):
    return ledger.running(st.ledger(spark, sf), ["ledger"], ["at"]).select("ledger", "at", "total")


SETTLE_SQL = """WITH RECURSIVE t AS (SELECT user_id AS ledger, event_id AS "at", event_id % 9 + 1 AS coins, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 f AS (SELECT ledger, "at", coins, k, coins <= 40 AS accepted, CASE WHEN coins <= 40 THEN coins ELSE 0 END AS spent FROM t WHERE k = 1
 UNION ALL SELECT t.ledger, t."at", t.coins, t.k, f.spent + t.coins <= 40, CASE WHEN f.spent + t.coins <= 40 THEN f.spent + t.coins ELSE f.spent END FROM f JOIN t ON t.ledger = f.ledger AND t.k = f.k + 1)
 SELECT ledger, "at", coins, accepted, spent AS total_spent, greatest(0, 40 - spent) AS coins_remaining FROM f"""


@query(SETTLE_SQL)
def ledger_settle(spark, sf):
    return ledger.settle(st.ledger(spark, sf), "ledger", "at").drop("tx_id")


@query("SELECT CAST(sum(event_id % 9 + 1) AS BIGINT) AS coins_spent, greatest(0, 40 - CAST(sum(event_id % 9 + 1) AS BIGINT)) AS coins_remaining, count(*) AS transactions FROM events")
def ledger_totals(spark, sf):
    return ledger.totals(st.ledger(spark, sf))


@query("""WITH r AS (SELECT o_custkey AS agent, o_orderkey % 50 AS symbol, CASE WHEN o_orderstatus = 'F' THEN 'WRITE' ELSE 'READ' END AS intent FROM orders), q AS (SELECT DISTINCT * FROM r), h AS (SELECT DISTINCT * FROM r),
 p AS (SELECT q.agent, q.symbol, q.intent, count(*) FILTER (h.agent IS NOT NULL AND h.agent <> q.agent AND NOT (q.intent = 'READ' AND h.intent = 'READ')) AS conflicts FROM q LEFT JOIN h ON h.symbol = q.symbol GROUP BY 1, 2, 3) SELECT *, max(conflicts) OVER (PARTITION BY agent) = 0 AS granted FROM p""")
def lock_conflicts(spark, sf):
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("agent"), (F.col("o_orderkey") % 50).alias("symbol"), F.when(F.col("o_orderstatus") == "F", "WRITE").otherwise("READ").alias("intent")).distinct()
    return ledger.lock_conflicts(r, r)


@query(with_("edges", "reach", body="SELECT id AS agent FROM members"))
def deadlocked_agents(spark, sf):
    return ledger.deadlocked(st.edges(spark, sf).select(F.col("src").alias("agent"), F.col("dst").alias("holder")))


# snapshots


@query(with_("snapshots", body="SELECT id, status FROM changes"))
def manifest_delta(spark, sf):
    return delta.delta(*st.snapshots(spark, sf))


@query(with_("snapshots", body="SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'unchanged') AS unchanged FROM changes"))
def delta_counts(spark, sf):
    return delta.delta_counts(delta.delta(*st.snapshots(spark, sf)))


@query("SELECT c_custkey AS id, 'kept' AS state FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'stale' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def prune_semi_anti(spark, sf):
    entries, valid = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return delta.kept(entries, valid).withColumn("state", F.lit("kept")).union(delta.stale(entries, valid).withColumn("state", F.lit("stale")))


@query("SELECT event_type AS source, count(*) AS n FROM events GROUP BY 1")
def source_histogram(spark, sf):
    return delta.source_histogram(table(spark, sf, "events").select(F.col("event_type").alias("source")))


@query("SELECT user_id AS path, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY 1")
def latest_version(spark, sf):
    return delta.latest(table(spark, sf, "events").select(F.col("user_id").alias("path"), "event_type", "value", "ts"), "path", "ts").select("path", "event_type", "value")


@query(with_("edges", body="SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = l_partkey AND e.dst = l_suppkey)"))
def discovered_edges(spark, sf):
    return delta.reconcile(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), st.edges(spark, sf))


# expressions


@query("SELECT doc_id, substr(sha256(text), 1, 20) AS hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.sha20("text").alias("hash"))


@query(with_("edges", body="SELECT n.id, substr(sha256(coalesce(o.c, '') || '|' || coalesce(i.c, '')), 1, 20) AS hash FROM (SELECT p_partkey AS id FROM part) n LEFT JOIN (SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY CAST(dst AS VARCHAR)) AS c FROM edges GROUP BY 1) o USING (id) LEFT JOIN (SELECT dst AS id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY CAST(src AS VARCHAR)) AS c FROM edges GROUP BY 1) i USING (id)"))
def deps_hash(spark, sf):
    e = st.edges(spark, sf).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    out, into = e.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("calls")), e.groupBy(F.col("dst").alias("id")).agg(F.collect_list("src").alias("callers"))
    none = F.array().cast("array<string>")
    rows = st.nodes(spark, sf).select(F.col("id").cast("string").alias("id")).join(out, "id", "left").join(into, "id", "left")
    return rows.select(F.col("id").cast("long").alias("id"), text.deps_hash(F.coalesce("calls", none), F.coalesce("callers", none)).alias("hash"))


@query("SELECT page_id, CASE WHEN len(p) >= 3 AND p[1] IN ('tools', 'packages', 'apps', 'services') THEN p[1] || '/' || p[2] WHEN len(p) >= 2 THEN p[1] ELSE 'root' END AS module FROM (SELECT page_id, string_split(CASE page_id % 3 WHEN 0 THEN 'apps/' WHEN 1 THEN '' ELSE 'lib/' END || split_part(url, '//', 2), '/') AS p FROM pages)")
def module_key(spark, sf):
    head = F.when(F.col("page_id") % 3 == 0, "apps/").when(F.col("page_id") % 3 == 1, "").otherwise("lib/")
    return table(spark, sf, "pages").select("page_id", text.module_key(F.concat(head, F.get(F.split("url", "//"), F.lit(1)))).alias("module"))


@query("""WITH p AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'src/tests/a' WHEN 1 THEN 'src/test_b' WHEN 2 THEN 'src/c.spec' WHEN 3 THEN 'Fixtures/d' ELSE 'src/latest' END || o_orderkey || '.py' AS path FROM orders) SELECT k, path, o AS is_test FROM (SELECT k, path, k % 5 IN (0, 1, 3) AS o FROM p)""")
def is_test_path(spark, sf):
    k = F.col("o_orderkey")
    head = F.when(k % 5 == 0, "src/tests/a").when(k % 5 == 1, "src/test_b").when(k % 5 == 2, "src/c.spec").when(k % 5 == 3, "Fixtures/d").otherwise("src/latest")
    return table(spark, sf, "orders").select(k.alias("k"), F.concat(head, k, F.lit(".py")).alias("path")).withColumn("is_test", text.is_test_path("path"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS receiver, p_name AS tail FROM part")
def split_call(spark, sf):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a.b. "), "p_type", F.lit(" ."))).otherwise(""), "p_name", F.lit("(x.y(z))"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.split_call(raw).alias("c")).select("id", "c.receiver", "c.tail")


@query("SELECT p_partkey AS id, p_type || ' ' || split_part(p_name, ' ', 1) || ' ' || CAST(p_size AS VARCHAR) || ' Xml ' || lower(split_part(p_name, ' ', 2)) AS words FROM part")
def split_identifier(spark, sf):
    name = F.concat(F.col("p_type"), F.lit("_"), F.get(F.split("p_name", " "), F.lit(0)), F.lit("-"), F.col("p_size").cast("string"), F.lit("Xml"), F.lit("."), F.lower(F.get(F.split("p_name", " "), F.lit(1))))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.identifier_words(name), " ").alias("words"))


MICRO_SQL = f"""WITH v AS (SELECT * FROM (VALUES {', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in fixed.VERBS.items())}) t(verb, label)), w AS (SELECT verb, label, row_number() OVER (ORDER BY verb) - 1 AS k, count(*) OVER () AS n FROM v WHERE verb <> 'assert_'),
 p AS (SELECT p_partkey AS id, w.label AS label, w.verb, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part JOIN w ON p_partkey % w.n = w.k)
 SELECT id, label || ' ' || a || ' ' || b AS micro FROM p"""


@query(MICRO_SQL)
def micro_label(spark, sf):
    verbs = sorted(v for v in fixed.VERBS if v != "assert_")
    names = F.array(*[F.lit(v) for v in verbs])
    p = table(spark, sf, "part")
    name = F.concat_ws("_", F.get(names, (F.col("p_partkey") % len(verbs)).cast("int")), F.lit("the"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return p.select(F.col("p_partkey").alias("id"), text.micro_label(F.lit(""), name, F.lit("function")).alias("micro"))


POLICY = [*fixed.BUG_FIX, *fixed.EXPLORATION]


@query(f"""WITH w AS (SELECT * FROM (VALUES {', '.join(f'({i}, {quoted(x)})' for i, x in enumerate(POLICY))}) t(k, phrase)), r AS (SELECT o_orderkey AS id, 'Please ' || phrase || ' now' AS prompt FROM orders JOIN w ON w.k = o_orderkey % 20 UNION ALL SELECT o_orderkey, 'Please go on' FROM orders WHERE o_orderkey % 20 >= {len(POLICY)})
 SELECT id, (SELECT arg_min(phrase, k) FROM w WHERE contains(lower(prompt), phrase)) AS phrase, NOT EXISTS (SELECT 1 FROM w WHERE contains(lower(prompt), phrase)) AS approved FROM r""")
def policy_phrases(spark, sf):
    k = (F.col("o_orderkey") % 20).cast("int")
    prompt = F.when(k < len(POLICY), F.concat(F.lit("Please "), F.get(text.strings(POLICY), k), F.lit(" now"))).otherwise("Please go on")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), prompt.alias("prompt"), F.lit("execution").alias("purpose"))
    return ledger.policy(rows).select("id", "phrase", "approved")


@query("SELECT doc_id, CAST(least(25, 1" + "".join(f" + (length(text) - length(replace(text, {quoted(t)}, ''))) // {len(t)}" for t in fixed.TEXT_COMPLEXITY) + ") AS BIGINT) AS complexity FROM documents")
def text_complexity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.text_complexity("text").cast("long").alias("complexity"))


@query(r"SELECT page_id, CAST(least(80, 1 + len(regexp_extract_all(regexp_replace(html, '[^\x00-\x7F]', 'x', 'g'), '\b(if|elif|else\s+if|for|while|case|catch|except|when|&&|\|\||and|or)\b'))) AS BIGINT) AS complexity FROM pages")
def lexical_complexity(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.lexical_complexity(F.regexp_replace("html", r"[^\x00-\x7F]", "x"), unicode=False).cast("long").alias("complexity"))


@query(r"SELECT page_id, sha256(regexp_replace(regexp_replace(html, '/\*[\s\S]*?\*/', '', 'g'), '//[^\n]*', '', 'g')) AS body FROM pages")
def strip_comments(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(text.strip_comments("html", F.lit("go")), 256).alias("body"))


FLAG_TEXT = "replace(text, 'the', CASE doc_id % 4 WHEN 0 THEN 'cache' WHEN 1 THEN 'eval(' WHEN 2 THEN 'timeout' ELSE 'SELECT x' END)"


@query(
    "SELECT doc_id, concat_ws(','"
    + "".join(f", CASE WHEN regexp_matches(t, {quoted(p)}) THEN {quoted(n)} END" for n, p in [(f"dynamic:{n}", p) for n, p in fixed.DYNAMIC_FLAGS] + list(fixed.PLAIN_FLAGS))
    + rf") AS flags FROM (SELECT doc_id, regexp_replace({FLAG_TEXT}, '[^\x00-\x7F]', 'x', 'g') AS t FROM documents)"
)
def capability_flags(spark, sf):
    k = F.col("doc_id") % 4
    word = F.when(k == 0, "cache").when(k == 1, "eval(").when(k == 2, "timeout").otherwise("SELECT x")
    body = F.regexp_replace(F.replace("text", F.lit("the"), word), r"[^\x00-\x7F]", "x")
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.capability_flags(body, unicode=False), ",").alias("flags"))


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


@query(
    "SELECT doc_id, concat_ws('; '"
    + "".join(f", CASE WHEN {_any('lower(text)', w)}{_TRY if w == ('fallback',) else ''} THEN {quoted(n)} END" for n, w in fixed.UNUSUAL_LOGIC for _TRY in [" OR (contains(text, 'try') AND contains(text, 'except'))"])
    + ") AS logic FROM documents"
)
def unusual_logic(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.unusual_logic("text"), "; ").alias("logic"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def html_and_slugs(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_escape("url").alias("escaped"), text.slug("url").alias("slug"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_block(spark, sf):
    return table(spark, sf, "events").select("event_id", text.json_block(F.concat(F.lit("Sure, here: "), "props", F.lit(" - done")), "k long")["k"].alias("k"))


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey = 0 THEN 'DELETION' WHEN c_nationkey IN (1, 2) THEN 'SIGNATURE_AMENDMENT' WHEN c_nationkey IN (3, 4) THEN 'LOGIC_CONTRACT_AMENDMENT' ELSE 'CUSTOM_AMENDMENT' END AS change_type FROM customer")
def change_types(spark, sf):
    n = F.col("c_nationkey")
    scenario = F.when(n == 0, " Delete it").when(n == 1, "Signature").when(n == 2, "new PARAM").when(n == 3, "logic").when(n == 4, "State machine").otherwise("rename")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), ripple.change_type(scenario).alias("change_type"))


# lines and crawlers, over source text written from the tables


@query("SELECT doc_id, len(string_split(text, chr(10))) AS loc FROM documents")
def lines_of_code(spark, sf):
    return table(spark, sf, "documents").select("doc_id", lines.line_count("text").cast("long").alias("loc"))


@query("SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, sha256(line) AS line FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no, len(parts) AS n FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\v\\f\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS parts FROM documents)) WHERE NOT (line_no = n AND line = '')")
def explode_lines(spark, sf):
    out = lines.explode_lines(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.sha2("line", 256).alias("line"))


def _orders_lines(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    method = F.get(text.strings(["get", "post", "route", "delete"]), (F.col("k") % 4).cast("int"))
    body = F.array(F.concat(F.lit("@app."), method, F.lit("('/o/"), "k", F.lit("')")), F.lit("# note"), F.concat(F.lit("def handle_"), "c", F.lit("(self, a: int, b):")), F.lit("    return requests.get('http://x/y')"))
    return o.select(F.concat(F.lit("api/f"), "k", F.lit(".py")).alias("path"), F.posexplode(body).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_no"), "line", F.lit("python").alias("language"))


@query("SELECT CASE o_orderkey % 4 WHEN 1 THEN 'POST' WHEN 3 THEN 'DELETE' ELSE 'GET' END AS method, '/o/' || o_orderkey AS path, 'handle_' || o_custkey AS handler_name, 'api/f' || o_orderkey || '.py' AS file_path, CAST(1 AS BIGINT) AS line_start, CAST(3 AS BIGINT) AS line_end, 'a,b' AS params FROM orders")
def route_extract(spark, sf):
    out = crawl.routes(_orders_lines(spark, sf))
    return out.select("method", "path", "handler_name", "file_path", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), joined("params").alias("params"))


@query("SELECT 'f' || o_orderkey AS function_name, 'http://x/y' AS target_endpoint, 'GET' AS http_method, 'api/f' || o_orderkey || '.py' AS file_path, CAST(4 AS BIGINT) AS line_number FROM orders")
def service_extract(spark, sf):
    return crawl.service_calls(_orders_lines(spark, sf)).select("function_name", "target_endpoint", "http_method", "file_path", F.col("line_number").cast("long").alias("line_number"))


@query("""SELECT 'M' || c_custkey AS name, 'm' || c_custkey || 's' AS table_name, 'Prisma' AS orm_type, CAST(2 AS BIGINT) AS fields, 'M' || c_custkey || ' -> N' || c_nationkey || '(id)' AS relationships FROM customer
 UNION ALL SELECT 'P' || c_custkey, 't' || c_nationkey, 'SQLAlchemy/Django', 2, 'P' || c_custkey || '.owner -> n.id' FROM customer
 UNION ALL SELECT 'E' || c_custkey, 'e' || c_custkey || 's', 'TypeORM', 0, '' FROM customer""")
def model_extract(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    prisma = c.select(F.concat(F.lit("p"), "k", F.lit(".prisma")).alias("path"), F.concat(F.lit("model M"), "k", F.lit(" {\n  id Int @id\n  // no\n  owner N"), "n", F.lit(" @relation(fields: [x], references: [id])\n}\n")).alias("content"), F.lit("prisma").alias("language"))
    py = c.select(F.concat(F.lit("m"), "k", F.lit(".py")).alias("path"), F.concat(F.lit("import x\nclass P"), "k", F.lit("(Base):\n    __tablename__ = 't"), "n", F.lit("'\n    id = Column(Integer, primary_key=True)\n\n    owner = Column(Integer, ForeignKey('n.id'))\nx = Column(1)\n")).alias("content"), F.lit("python").alias("language"))
    ts = c.select(F.concat(F.lit("e"), "k", F.lit(".ts")).alias("path"), F.concat(F.lit("@Entity()\n\nexport class E"), "k", F.lit(" {\n}\n")).alias("content"), F.lit("typescript").alias("language"))
    every = prisma.union(py).union(ts)
    exploded = lines.explode_lines(every).join(every.select("path", "language"), "path")
    return crawl.models(every, exploded).select("name", "table_name", "orm_type", F.size("fields").cast("long").alias("fields"), joined("relationships").alias("relationships"))


@query("SELECT CASE o_orderkey % 5 WHEN 0 THEN 'eval' WHEN 1 THEN 'event_emitter' WHEN 2 THEN 'env_conditional' WHEN 3 THEN 'reflection' ELSE 'dynamic_import' END AS pattern_type, 'o' || o_orderkey AS file_path, CAST(2 AS BIGINT) AS line_number, CASE o_orderkey % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 WHEN 2 THEN 0.9 WHEN 3 THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence FROM orders")
def dynamic_scan(spark, sf):
    code = text.strings(["x = eval(s)", "bus.emit('go')", "k = os.getenv('K')", "reflect.ValueOf(x)", "const m = require(name)"])
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("path"), F.posexplode(F.array(F.lit("# eval(x)"), F.get(code, (F.col("o_orderkey") % 5).cast("int")))).alias("n", "line"))
    out = dynamic.line_findings(o.select("path", (F.col("n") + 1).alias("line_no"), "line"))
    return out.select("pattern_type", "file_path", F.col("line_number").cast("long").alias("line_number"), "confidence")


@query(r"WITH t AS (SELECT 'api/f' || o_orderkey || '.py' AS path, string_split('def start():' || chr(10) || '    handle_' || o_custkey || '(a, b)', chr(10)) AS lines FROM orders) SELECT regexp_extract(lines[2], '(\w+)\(', 1) AS name, path, CAST(len(lines) AS BIGINT) AS line_no, replace(regexp_extract(lines[2], '\(([^)]*)\)', 1), ' ', '') AS arguments, regexp_extract(lines[1], 'def (\w+)', 1) AS enclosing_symbol FROM t")
def call_site_scan(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("api/f"), "o_orderkey", F.lit(".py")).alias("path"), F.posexplode(F.array(F.lit("def start():"), F.concat(F.lit("    handle_"), "o_custkey", F.lit("(a, b)")))).alias("n", "line"))
    names = table(spark, sf, "orders").select(F.concat(F.lit("handle_"), "o_custkey").alias("name"), F.lit("lib.py").alias("definition_file")).distinct()
    out = lines.call_sites(o.select("path", (F.col("n") + 1).alias("line_no"), "line"), names)
    return out.select("name", "path", F.col("line_no").cast("long").alias("line_no"), joined("arguments").alias("arguments"), "enclosing_symbol")


@query("SELECT 'f' || o_orderkey AS path, CAST(3 AS BIGINT) AS line_no, 'About ' || o_custkey || ' // more' AS doc FROM orders")
def leading_docs(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("f"), "o_orderkey").alias("path"), F.posexplode(F.array(F.concat(F.lit("// About "), "o_custkey"), F.lit("// more"), F.lit("func x() {"))).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_no"), "line")
    out = lines.leading_docs(o, o.where("line like 'func%'").select("path", "line_no"))
    return out.select("path", F.col("line_no").cast("long").alias("line_no"), "doc")


@query("SELECT 'f' || (o_orderkey % 100) || '.py' AS path, arg_max('c' || o_orderkey, o_orderkey) AS last_commit, arg_max('s' || o_custkey, o_orderkey) AS last_subject, count(*) AS commits FROM orders GROUP BY 1")
def file_history(spark, sf):
    o = table(spark, sf, "orders")
    newest = -F.col("o_orderkey") * 2
    head = o.select(newest.alias("ord"), F.concat(F.lit("@@c"), "o_orderkey", F.lit("|2024-01-01T00:00|s"), "o_custkey").alias("line"), (F.col("o_orderkey") % 16).alias("log"))
    body = o.select((newest + 1).alias("ord"), F.concat(F.lit("f"), F.col("o_orderkey") % 100, F.lit(".py")).alias("line"), (F.col("o_orderkey") % 16).alias("log"))
    return sources.file_history(head.union(body)).select("path", "last_commit", "last_subject", "commits")


# joins on more than equality


@query("SELECT d.doc_id AS text_id, b.item_id AS needle_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def theta_contains(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return matching.contains_pairs(docs.select(F.col("doc_id").alias("text_id"), "text"), items.select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle")))


@query("SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND abs(a.value - b.value) < 2.5 AND a.event_id < b.event_id")
def band_join(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    return matching.band_pairs(e, e, ["user_id"], "value", 2.5).where("event_id < event_id_r").select(F.col("event_id").alias("left_id"), F.col("event_id_r").alias("right_id"))


# reports


@query(with_("nodes", "edges", body="SELECT count(*) AS symbols, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'method') AS methods, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind IN ('function', 'method') AND is_test) AS test_functions, count(*) FILTER (kind IN ('function', 'method') AND NOT is_test) AS production_functions, count(DISTINCT module) AS modules, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, count(DISTINCT file_path) AS files, (SELECT count(*) FROM edges) AS resolved_call_edges, greatest(0, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM edges)) AS unresolved_call_names FROM nodes"))
def repo_stats(spark, sf):
    n = st.nodes(spark, sf)
    files = n.select("file_path").distinct().select(F.col("file_path").alias("path"), F.lit(True).alias("is_production"))
    return report.repo_stats(files, n, st.edges(spark, sf), table(spark, sf, "lineitem")).drop("production_files")


@query(with_("nodes", "edges", "reach", body=""", g AS (SELECT component, count(*) AS n FROM members GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8), d AS (SELECT count(*) AS n FROM nodes WHERE kind IN ('function', 'method') AND flag LIKE 'dynamic:%'), h AS (SELECT least(6, count(*)) AS n FROM nodes WHERE kind IN ('function', 'method') AND complexity >= 12), t AS (SELECT count(*) FILTER (is_test) AS t, count(*) FILTER (NOT is_test) AS p FROM nodes WHERE kind IN ('function', 'method'))
 SELECT CASE WHEN n >= 3 THEN 'danger' ELSE 'warn' END AS severity, 'Circular dependency across ' || n || ' symbols' AS title, 900 + n AS weight FROM g UNION ALL SELECT 'warn', n || ' symbols use dynamic dispatch', 700 + least(n, 99) FROM d WHERE n > 0 UNION ALL SELECT CASE WHEN n < 4 THEN 'warn' ELSE 'danger' END, n || ' routine(s) at complexity 12 or above', 600 + n FROM h WHERE n > 0 UNION ALL SELECT 'warn', 'Thin test surface', 500 FROM t WHERE p > 0 AND t / p < 0.15"""))
def risk_register(spark, sf):
    return report.risk_register(st.nodes(spark, sf), graph.components(st.edges(spark, sf)))


DEEP = with_("nodes", "edges", "fan", "ranked", body=f", {CLASSES}, s AS (SELECT r.id, n.file_path, r.score + CASE WHEN r.id IN (SELECT id FROM cyc UNION SELECT id FROM dyn) THEN 6 ELSE 0 END + CASE WHEN n.flag IS NOT NULL THEN 2 ELSE 0 END AS deep_score FROM ranked r JOIN nodes n USING (id) WHERE NOT n.is_test), k AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY deep_score DESC, id) AS k FROM s) SELECT id, file_path, CAST(deep_score AS DOUBLE) AS deep_score FROM k WHERE k <= 3 ORDER BY deep_score DESC, id LIMIT 24")


@query(DEEP)
def deep_candidates(spark, sf):
    n, e = st.nodes(spark, sf), st.edges(spark, sf)
    flagged = _classes(spark, sf).where("class in ('cyclic', 'dynamic')")
    return report.deep_candidates(graph.pivotal(n, e), n, flagged, 24)


@query(with_("nodes", "edges", "fan", "ranked", body=", k AS (SELECT n.module, n.id, row_number() OVER (PARTITION BY n.module ORDER BY coalesce(r.rank, 1000000), n.complexity DESC, n.id) AS k FROM nodes n LEFT JOIN ranked r USING (id) WHERE n.kind IN ('function', 'method')) SELECT module, k, id FROM k WHERE k <= 5"))
def module_profiles(spark, sf):
    n, e = st.nodes(spark, sf), st.edges(spark, sf)
    return report.module_profiles(n, graph.pivotal(n, e), 5)


@query(with_("nodes", "edges", "fan", "ranked", "reach", body=""", e AS (SELECT o_orderkey AS ord, 'order ' || o_orderkey AS name FROM orders ORDER BY 1 LIMIT 3), h AS (SELECT r.rank AS ord, n.qualified FROM ranked r JOIN nodes n USING (id) WHERE NOT n.is_test ORDER BY r.rank LIMIT 5),
 a AS (SELECT 1 AS part, ord, 'Start at the entry point ' || name AS title FROM e UNION ALL SELECT 2, ord, 'Read ' || qualified FROM h UNION ALL SELECT 3, 1, 'Understand the data layer' WHERE EXISTS (SELECT 1 FROM supplier) UNION ALL SELECT 4, 1, 'Treat the cycle groups as hazardous' WHERE EXISTS (SELECT 1 FROM members)) SELECT row_number() OVER (ORDER BY part, ord, title) AS step, title FROM a"""))
def reading_order(spark, sf):
    n, e = st.nodes(spark, sf), st.edges(spark, sf)
    entries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("order "), "o_orderkey").alias("name"))
    return report.reading_order(entries, report.key_routines(graph.pivotal(n, e), n, 5), table(spark, sf, "supplier"), graph.components(e))


@query(with_("nodes", "edges", "fan", "ranked", body=", t AS (SELECT split_part(n.file_path, '/', 1) AS root, r.rank FROM ranked r JOIN nodes n USING (id) WHERE r.rank <= 3) SELECT root, count(*) AS held FROM t GROUP BY 1 ORDER BY 2 DESC, min(rank) LIMIT 1"))
def centre_of_gravity(spark, sf):
    n, e = st.nodes(spark, sf), st.edges(spark, sf)
    return report.centre_of_gravity(graph.pivotal(n, e), n)


@query("SELECT p_brand || '/' || p_type AS path, count(*) AS symbols, CASE WHEN bool_and(p_partkey % 7 = 0) THEN 'test' ELSE 'prod' END AS layer FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def file_inventory(spark, sf):
    f = st.nodes(spark, sf).groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("symbols"), F.bool_and("is_test").alias("is_test")).withColumn("is_production", ~F.col("is_test"))
    return report.file_inventory(f, 200).select("path", "symbols", "layer")


@query(with_("nodes", "edges", body="SELECT 'graph LR' || chr(10) || string_agg('  ' || a || ' --> ' || b, chr(10) ORDER BY a, b) AS text FROM (SELECT DISTINCT a.module AS a, b.module AS b FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.module <> b.module)"))
def module_diagram(spark, sf):
    return report.mermaid(graph.module_edges(st.nodes(spark, sf), st.edges(spark, sf)), "src_module", "dst_module", ["src_module", "dst_module"])


@query("SELECT p_partkey AS id, 'auto' AS source, length(p_name) > 0 AS has_micro FROM part")
def insight_rows(spark, sf):
    n = st.nodes(spark, sf)
    none = F.array().cast("array<string>")
    s = n.withColumns({"doc": F.lit(""), "callers": none, "calls": none, "hash": F.lit("h"), "deps_hash": F.lit("d")})
    return insights.automatic(s).select("id", "source", (F.col("micro") != "").alias("has_micro"))


@query("""WITH s AS (SELECT user_id, event_id % 7 AS c, event_type AS f FROM events) SELECT 'fe:c' || c || ':' || f AS src, 'route:GET_/' || f || '/x' AS dst, 'routes_to' AS type, CAST(3 AS BIGINT) AS weight FROM (SELECT DISTINCT c, f FROM s)
 UNION ALL SELECT DISTINCT 'route:GET_/' || f || '/x', 'fn:' || f, 'calls', 2 FROM s
 UNION ALL SELECT DISTINCT 'file:' || f || '.ts', min('fe:c' || c || ':' || f), 'contains', 1 FROM s GROUP BY f""")
def storyboard_links(spark, sf):
    e = table(spark, sf, "events")
    services = e.select(F.concat(F.lit("c"), F.col("event_id") % 7).alias("calling_component"), F.col("event_type").alias("function_name"), F.concat(F.lit("http://h/"), "event_type", F.lit("/x?y")).alias("target_endpoint"), F.concat(F.col("event_type"), F.lit(".ts")).alias("file_path")).distinct()
    kinds = e.select("event_type").distinct()
    routes = kinds.select(F.lit("GET").alias("method"), F.concat(F.lit("/"), "event_type", F.lit("/x")).alias("path"), F.col("event_type").alias("handler_name"), F.lit(None).cast("string").alias("file_path"), F.lit(1).alias("line_start"))
    functions = kinds.select(F.col("event_type").alias("name"), F.lit(None).cast("string").alias("file_path"), F.lit(900).alias("line"), F.lit("").alias("code"))
    none = spark.createDataFrame([], "name string, table_name string, file_path string")
    nodes = storyboard.node_rows(services, routes, none, functions)
    return storyboard.links(nodes, services, routes, none, functions, spark.createDataFrame([], "caller string, callee string")).withColumn("weight", F.col("weight").cast("long"))


# extraction and the whole model, over source text written from the tables

# The oracle writes the same text in SQL and reads it by lines.
_TEXT_SQL = r"""f AS (SELECT c_custkey AS k, 'apps/n' || c_nationkey || '/f' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.go' ELSE '.ts' END AS path, CASE c_custkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'typescript' END AS language,
 replace(CASE c_custkey % 3 WHEN 0 THEN E'import os\n\n\ndef load_@(key: int) -> str:\n    \"\"\"Loads one row of the table.\"\"\"\n    if key > 1 and key < 9:\n        return os.getenv(''K'')\n    return save_@(key)\n\n\ndef save_@(key):\n    return eval(''key'')  # save\n\n\nclass Box@:\n    def open(self):\n        return self.shut()\n\n    def shut(self):\n        return load_@(1)\n'
 WHEN 1 THEN E'package main\n\nimport \"fmt\"\n\nfunc Start@(n int) error {\n\tfmt.Println(n)\n\treturn stop@(n)\n}\n\nfunc stop@(n int) error {\n\treturn nil\n}\n'
 ELSE E'import ''./base''\n\nexport class Card@ extends Base {\n  render(x) {\n    return draw@(x);\n  }\n}\n\nexport function draw@(x) {\n  return fetch(''/api/@'');\n}\n' END, '@', CAST(c_custkey AS VARCHAR)) AS content FROM customer),
 l AS (SELECT path, language, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM f),
 heads AS (SELECT *, regexp_extract(line, CASE language WHEN 'go' THEN '^func (\w+)' WHEN 'python' THEN '^def (\w+)' ELSE '^(?:export )?function (\w+)' END, 1) AS function, regexp_extract(line, '^(?:export )?class (\w+)', 1) AS class, CASE language WHEN 'python' THEN regexp_extract(line, '^    def (\w+)', 1) WHEN 'typescript' THEN regexp_extract(line, '^  (\w+)\(.*\{$', 1) ELSE '' END AS method FROM l),
 owned AS (SELECT *, last_value(nullif(class, '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) AS owner FROM heads),
 named AS (SELECT *, CASE WHEN function <> '' THEN path || '::' || function WHEN class <> '' THEN path || '::' || class WHEN method <> '' THEN path || '::' || owner || '.' || method END AS id, CASE WHEN function <> '' THEN 'function' WHEN class <> '' THEN 'class' WHEN method <> '' THEN 'method' END AS kind, coalesce(nullif(function, ''), nullif(class, ''), nullif(method, '')) AS name FROM owned)"""


@query(f"WITH {_TEXT_SQL} SELECT id, kind, language FROM named WHERE id IS NOT NULL")
def model_symbols(spark, sf):
    return model_plan.symbols_of(st.files(spark, sf).select("path", "content")).select("id", "kind", "language")


@query(rf"""WITH {_TEXT_SQL}, inside AS (SELECT *, last_value(id IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) AS src, last_value(kind IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) AS own FROM named),
 calls AS (SELECT src, path, language, own, unnest(regexp_extract_all(line, '([\w.]+)\(', 1)) AS called FROM inside WHERE id IS NULL AND src IS NOT NULL AND own <> 'class' AND NOT (language = 'typescript' AND own = 'method'))
 SELECT DISTINCT c.src, n.id AS dst FROM calls c JOIN named n ON n.path = c.path AND n.name = regexp_replace(c.called, '^self\.', '') AND (n.kind <> 'method' OR c.called LIKE 'self.%') WHERE n.id <> c.src""")
def model_edges(spark, sf):
    s = model_plan.symbols_of(st.files(spark, sf).select("path", "content"))
    return model_plan.edges_of(s).select("src", "dst")


@query(rf"""WITH {_TEXT_SQL} SELECT id, exported, complexity FROM (SELECT id, NOT starts_with(name, '_') AND (language = 'python' OR line LIKE 'export %' OR (language = 'go' AND upper(substr(name, 1, 1)) = substr(name, 1, 1))) AS exported, CAST(1 + (SELECT coalesce(sum(len(regexp_extract_all(regexp_replace(b.line, '"[^"]*"|#.*', '', 'g'), '\b(if|for|while|and|or)\b'))), 0) FROM named b WHERE b.path = n.path AND b.line_no > n.line_no AND b.line_no < coalesce((SELECT min(e.line_no) FROM named e WHERE e.path = n.path AND e.id IS NOT NULL AND e.line_no > n.line_no), 1000)) AS BIGINT) AS complexity FROM named n WHERE id IS NOT NULL AND kind <> 'class')""")
def model_complexity(spark, sf):
    s = model_plan.symbols_of(st.files(spark, sf).select("path", "content"))
    return s.where("kind <> 'class'").select("id", (F.col("exported")).alias("exported"), F.col("complexity").cast("long").alias("complexity"))


@query(rf"WITH {_TEXT_SQL}, bare AS (SELECT path, CAST(line_no AS BIGINT) AS line_number, regexp_replace(line, '#.*', '') AS line FROM l WHERE language = 'python') SELECT 'env_conditional' AS pattern_type, path AS file_path, line_number FROM bare WHERE regexp_matches(line, '\bos\.getenv\s*\(') UNION ALL SELECT 'eval', path, line_number FROM bare WHERE regexp_matches(line, '\b(eval|exec)\s*\(')")
def dynamic_detect(spark, sf):
    f = st.files(spark, sf).select("path", "content").where("path like '%.py'")
    return dynamic.detect(f, lines.explode_lines(f)).select("pattern_type", "file_path", F.col("line_number").cast("long").alias("line_number"))


@query(rf"""WITH {_TEXT_SQL} SELECT path, length(content) AS n_chars, replace(regexp_replace(regexp_replace(content, '"{{3}}.*?"{{3}}', '', 'g'), '#[^
]*', '', 'g'), ' ', '') AS code FROM f WHERE language = 'python'""")
def comments_blanked(spark, sf):
    f = st.files(spark, sf).where("path like '%.py'").withColumn("blank", extract.blank_comments("content", F.lit("python")))
    return f.select("path", F.char_length("blank").cast("long").alias("n_chars"), F.replace("blank", F.lit(" "), F.lit("")).alias("code"))


@query("""SELECT 'f' || o_orderkey || '.py' AS definition_file, 'job_' || o_orderkey AS name, CAST(5 AS BIGINT) AS complexity, CAST(1 AS BIGINT) AS occurrences, CAST(1 AS BIGINT) AS fan_in_files, CAST(10 AS BIGINT) AS score, 'job_' || o_orderkey || ',load,save' AS outbound FROM orders""")
def cross_reference(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    body = F.array(F.concat(F.lit("def job_"), "k", F.lit("(x):")), F.lit("    if x and load(x) or save(x):"), F.lit("        retry = 1"), F.lit("    for i in x: pass"))
    own = o.select(F.concat(F.lit("f"), "k", F.lit(".py")).alias("path"), F.posexplode(body).alias("n", "line"))
    other = o.select(F.concat(F.lit("g"), "k", F.lit(".py")).alias("path"), F.lit(0).alias("n"), F.concat(F.lit("job_"), "k", F.lit("(1)")).alias("line"))
    rows = own.union(other).select("path", (F.col("n") + 1).alias("line_no"), "line", F.lit("python").alias("language"))
    out = lines.cross_references(rows)
    return out.select("definition_file", "name", F.col("complexity").cast("long").alias("complexity"), "occurrences", "fan_in_files", F.col("score").cast("long").alias("score"), joined("outbound").alias("outbound"))


@query("SELECT s AS subsystem FROM (VALUES " + ", ".join(f"('{n}', (SELECT count(*) FROM part WHERE regexp_matches(lower(p_name) || ' ' || lower(p_brand || '/' || p_type), '{'|'.join(w)}')))" for n, w in fixed.SUBSYSTEMS.items()) + ") t(s, n) WHERE n > 0")
def subsystem_labels(spark, sf):
    return report.subsystems(st.nodes(spark, sf))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Authored by c' || o_custkey || ' in PR #' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'Source: commit abcdefg' ELSE 'Source: no linked pull request or commit' END AS label FROM orders")
def attribution_labels(spark, sf):
    k = F.col("o_orderkey")
    author, pr, sha = F.when(k % 3 == 0, F.concat(F.lit("c"), "o_custkey")), F.when(k % 3 == 0, k), F.when(k % 3 == 1, "abcdefghij")
    return table(spark, sf, "orders").select(k.alias("id"), text.attribution(author, pr, sha).alias("label"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, CASE l_linenumber WHEN 1 THEN 'one caller' WHEN 2 THEN 'two callers' WHEN 3 THEN 'three callers' WHEN 4 THEN 'four callers' WHEN 5 THEN 'five callers' WHEN 6 THEN 'six callers' ELSE 'seven callers' END AS words FROM lineitem")
def counted_words(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), text.counted("l_linenumber", "caller").alias("words"))


@query("SELECT p_partkey AS id, length(p_type) >= 3 AND lower(p_type) NOT IN (" + ", ".join(quoted(k) for k in fixed.KEYWORDS) + ") AS worth FROM part")
def lookup_guard(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.worth_looking_up("p_type").alias("worth"))


# expressions, reports and sources over whole tables


_IDS_SQL = "ids AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'p/f.py::Box' || o_custkey || '.Inner.run' WHEN 1 THEN 'p/f.py::go' || o_custkey ELSE 'plain' || o_custkey END AS id, 'name' || o_custkey AS name FROM orders)"


@query(f"WITH {_IDS_SQL}, q AS (SELECT k, CASE WHEN contains(id, '::') THEN substr(id, strpos(id, '::') + 2) ELSE name END AS qualified FROM ids) SELECT k AS id, qualified, CASE WHEN contains(qualified, '.') THEN left(qualified, length(qualified) - strpos(reverse(qualified), '.')) END AS parent FROM q")
def qualified_parent(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    sid = F.when(k % 3 == 0, F.concat(F.lit("p/f.py::Box"), "o_custkey", F.lit(".Inner.run"))).when(k % 3 == 1, F.concat(F.lit("p/f.py::go"), "o_custkey")).otherwise(F.concat(F.lit("plain"), "o_custkey"))
    q = o.select(k.alias("id"), text.qualified(sid, F.concat(F.lit("name"), "o_custkey")).alias("qualified"))
    return q.withColumn("parent", text.parent_of("qualified"))


@query(r"WITH t AS (SELECT p_partkey AS id, chr(128512) || '`' || p_name || '`  *' || p_brand || '* _' || chr(10) || p_type || '_ ' AS x FROM part) SELECT id, trim(regexp_replace(translate(replace(x, chr(128512), ''), '_`*', '   '), '\s+', ' ', 'g')) AS cleaned, trim(regexp_replace(replace(replace(replace(x, chr(128512), ''), '`', ''), '*', ''), '\s+', ' ', 'g')) AS prose FROM t")
def cleaned_text(spark, sf):
    x = F.concat(F.lit("\U0001f600`"), "p_name", F.lit("`  *"), "p_brand", F.lit("* _\n"), "p_type", F.lit("_ "))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.clean(x).alias("cleaned"), text.clean_prose(x).alias("prose"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '// ' || p_name || ' ' || what WHEN 1 THEN '/**' || chr(10) || ' * ' || what || chr(10) || ' * @param a int' || chr(10) || ' * @param b ' || p_type || chr(10) || ' * @returns ' || p_brand || chr(10) || ' */'
 ELSE repeat('"', 3) || what || chr(10) || ':param a: int' || chr(10) || ':param b: ' || p_type || chr(10) || ':returns: ' || p_brand || chr(10) || repeat('"', 3) END AS documentation FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'About ' || p_type ELSE CASE WHEN p_partkey % 10 = 0 THEN 'Class' WHEN p_partkey % 3 = 0 THEN 'Method' ELSE 'Function' END || ' `' || p_name || '`.' END AS what FROM part)""")
def documentation_block(spark, sf):
    n = st.nodes(spark, sf)
    param = lambda a, b: F.struct(F.lit(a).alias("name"), b.alias("type"))
    rows = n.select("id", "name", "kind", "language", F.array(param("a", F.lit("int")), param("b", F.col("module"))).alias("parameters"), F.substring_index("qualified", ".", 1).alias("returns"), F.when(F.col("complexity") % 2 == 0, F.concat(F.lit("About "), "module")).otherwise("").alias("doc"))
    return ripple.documentation(rows).select("id", "documentation")


@query("""WITH c AS (SELECT o_orderkey AS k, 'f' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.sql' END AS file, CASE o_orderkey % 3 WHEN 0 THEN '#' WHEN 1 THEN '//' ELSE '--' END AS sign, greatest(1, least(o_custkey % 5, 3)) AS place, 'def f' || o_custkey || '():' || chr(10) AS a, chr(9) || 'g()' || chr(10) AS b FROM orders),
 g AS (SELECT *, sign || ' TODO: verify `g` contract update (DELETION)' || chr(10) AS guard FROM c) SELECT file, CASE place WHEN 1 THEN guard || a || b WHEN 2 THEN a || ' ' || guard || b ELSE a || b || guard END AS patched_content FROM g""")
def patch_lines(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    file = F.concat(F.lit("f"), k, F.when(k % 3 == 0, ".py").when(k % 3 == 1, ".ts").otherwise(".sql"))
    rows = o.select(file.alias("file"), F.lit("f").alias("symbol"), (F.col("o_custkey") % 5).cast("int").alias("line"), F.concat(F.lit("def f"), "o_custkey", F.lit("():\n\tg()\n")).alias("content"))
    return ripple.patches(rows, "g", "DELETION").select("file", "patched_content")


@query(r"""SELECT p_partkey AS id, substr(trim(regexp_replace(translate(' $(`' || p_name || '`)' || chr(10) || chr(9) || '"' || p_brand || '"' || chr(39) || chr(92), '`$\"' || chr(39), ''), '[\x00-\x1f\x7f]+', ' ', 'g')), 1, 18) AS word FROM part""")
def shell_words(spark, sf):
    x = F.concat(F.lit(" $(`"), "p_name", F.lit("`)\n\t\""), "p_brand", F.lit("\"'\\"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.shell_safe(x, 18).alias("word"))


_PATHS_SQL = "paths AS (SELECT c_custkey AS k, 'apps/' || CASE c_nationkey % 4 WHEN 0 THEN 'n' || c_nationkey WHEN 1 THEN 'node_modules' WHEN 2 THEN 'tests' ELSE 'lib' END || '/f' || c_custkey || CASE c_custkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.TSX' WHEN 3 THEN '.txt' ELSE '.js' END AS path FROM customer)"


def _paths(spark, sf):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    folder = F.when(n % 4 == 0, F.concat(F.lit("n"), n)).when(n % 4 == 1, "node_modules").when(n % 4 == 2, "tests").otherwise("lib")
    ext = F.when(k % 5 == 0, ".py").when(k % 5 == 1, ".go").when(k % 5 == 2, ".TSX").when(k % 5 == 3, ".txt").otherwise(".js")
    return table(spark, sf, "customer").select(k.alias("k"), F.concat(F.lit("apps/"), folder, F.lit("/f"), k, ext).alias("path"), F.concat_ws("\n", F.lit("a"), "c_name", F.lit("")).alias("content"))


@query(f"WITH {_PATHS_SQL} SELECT path, CASE regexp_extract(lower(path), '\\.(\\w+)$', 1) WHEN 'py' THEN 'Python' WHEN 'go' THEN 'Go' WHEN 'tsx' THEN 'TypeScript' WHEN 'js' THEN 'JavaScript' ELSE '-' END AS language FROM paths")
def language_names(spark, sf):
    return _paths(spark, sf).select("path", text.language_display("path").alias("language"))


@query(f"WITH {_PATHS_SQL} SELECT path, CASE regexp_extract(lower(path), '\\.(\\w+)$', 1) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'tsx' THEN 'typescript' ELSE 'javascript' END AS language FROM paths WHERE path NOT LIKE '%.txt' AND path NOT LIKE '%/node_modules/%' AND (path LIKE '%.py' OR path LIKE 'apps/n%' OR regexp_matches(path, '/f[^/]*1[.]go$')) AND path NOT LIKE '%7%'")
def wanted_files(spark, sf):
    return extract.wanted_files(_paths(spark, sf), include=["*.py", "apps/n*", "f*1.go"], exclude=["*7*"]).select("path", "language")


@query(f"WITH {_PATHS_SQL} SELECT path FROM paths WHERE lower(path) SIMILAR TO '.*\\.(py|tsx)' AND path NOT LIKE '%/node_modules/%' AND path NOT LIKE '%/tests/%'")
def text_files(spark, sf):
    return sources.source_files(_paths(spark, sf), (".py", ".TSX")).select("path")


@query(f"WITH {_PATHS_SQL} SELECT path, 'apps/' || split_part(path, '/', 2) AS module, CAST(3 AS BIGINT) AS loc, path LIKE '%/tests/%' AS is_test, path NOT LIKE '%/tests/%' AS is_production FROM paths")
def file_metadata(spark, sf):
    return sources.file_meta(_paths(spark, sf)).select("path", "module", "loc", "is_test", "is_production")


@query(rf"WITH {_TEXT_SQL} SELECT path, array_to_string(list_slice(string_split(content, chr(10)), greatest(1, 2 + k % 4 - 1), greatest(1, 2 + k % 4 - 1) + least(4, greatest(0, (4 + k % 7) + 1 - greatest(1, 2 + k % 4 - 1) + 1)) - 1), chr(10)) AS source FROM f")
def source_window(spark, sf):
    rows = st.files(spark, sf).withColumns({"a": (F.lit(2) + F.col("k") % 4).cast("int"), "b": (F.lit(4) + F.col("k") % 7).cast("int")})
    return rows.select("path", lines.source_slice("content", "a", "b", 1, 4).alias("source"))


@query("SELECT p_type AS module, CAST(round(sum(p_size) / greatest(1, count(*) FILTER (p_size > 45)), 3) AS DOUBLE) AS score FROM part GROUP BY 1")
def coupling_scores(spark, sf):
    per = table(spark, sf, "part").groupBy(F.col("p_type").alias("module")).agg(F.sum("p_size").alias("out"), F.count_if(F.col("p_size") > 45).alias("cyclic"))
    return per.select("module", graph.coupling_score(F.col("out"), F.col("cyclic")).cast("double").alias("score"))


# a share in whole numbers: the quotient, and one more past a half or at a half after an odd one
@query("""WITH c AS (SELECT c_custkey, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
 q AS (SELECT *, (100 * a) // greatest(a + b, 1) AS d, 2 * ((100 * a) % greatest(a + b, 1)) AS r FROM c)
 SELECT c_custkey, CASE WHEN a + b = 0 THEN 'n/a' ELSE (d + CASE WHEN r > a + b OR (r = a + b AND d % 2 = 1) THEN 1 ELSE 0 END) || '%' END AS rate FROM q""")
def resolution_rates(spark, sf):
    per = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("resolved_call_edges"), F.count_if(F.col("o_orderstatus") == "O").alias("unresolved_call_names"))
    return report.resolution_rate(per, "c_custkey")


@query("""WITH f AS (SELECT DISTINCT c_custkey AS id, 'f' || (o_orderkey % 4) || '.py' AS file FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NOT NULL), l AS (SELECT id, list(file ORDER BY file) AS files FROM f GROUP BY 1)
 SELECT c_custkey AS target_id, coalesce(array_to_string(files, ','), '') AS files, CASE coalesce(len(files), 0) WHEN 0 THEN 'Notice: Modifying `' || c_name || '` in `' || c_mktsegment || '` has no detected downstream dependents in this workspace. Safe to edit in isolation.' WHEN 1 THEN 'Warning: Modifying `' || c_name || '` in `' || c_mktsegment || '` directly impacts `' || files[1] || '`. Update this dependent to preserve contract integrity.'
 ELSE 'Warning: Amending `' || c_name || '` in `' || c_mktsegment || '` will silently disturb downstream assumptions in ' || array_to_string(list_transform(files[1:3], lambda x: '`' || x || '`'), ', ') || '. Here are the ' || len(files) || ' files you need to update simultaneously.' END AS semantic_warning FROM customer LEFT JOIN l ON id = c_custkey""")
def impact_warnings(spark, sf):
    targets = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("file_path"))
    findings = table(spark, sf, "orders").select(F.col("o_custkey").alias("target_id"), F.concat(F.lit("f"), F.col("o_orderkey") % 4, F.lit(".py")).alias("file"))
    return ripple.warning(findings, targets).withColumn("files", joined("files"))


@query("""WITH r AS (SELECT o_custkey AS c, '- f' || o_orderkey || ' (`' || o_orderpriority || '` at line ' || o_orderkey % 90 || ')' AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), l AS (SELECT c, string_agg(t, chr(10) ORDER BY k) AS places FROM r WHERE k <= 5 GROUP BY 1)
 SELECT c_custkey AS target_id, 'Review the change to `' || c_name || '` in `a.py`.' || chr(10) || 'Type: DELETION' || chr(10) || 'Details: ' || c_mktsegment || chr(10) || 'Files to examine:' || chr(10) || coalesce(places, 'none') AS prompt FROM customer LEFT JOIN l ON c = c_custkey""")
def prompt_texts(spark, sf):
    changes_ = table(spark, sf, "customer").select(F.col("c_custkey").alias("target_id"), F.col("c_name").alias("name"), F.lit("a.py").alias("file_path"), F.lit("DELETION").alias("change_type"), F.col("c_mktsegment").alias("description"))
    contexts = table(spark, sf, "orders").select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("f"), "o_orderkey").alias("file"), F.col("o_orderpriority").alias("symbol"), (F.col("o_orderkey") % 90).alias("line"))
    return ripple.prompts(changes_, contexts)


@query("SELECT p_partkey AS id, CASE WHEN regexp_matches(lower(p_name), 'cold|hot') THEN 'heat' WHEN lower(p_name) LIKE '%ring%' THEN 'round' ELSE 'none' END AS answer FROM part")
def canned_answers(spark, sf):
    ladder = ((("COLD", "hot"), "heat"), (("ring",), "round"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.answer(F.upper("p_name"), ladder, "none").alias("answer"))


@query("SELECT o_orderkey AS id, substr(sha256(o_custkey || '|' || coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, '') || '|' || CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END), 1, 20) AS fingerprint FROM orders")
def revision_fingerprints(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("head"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("branch"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("dirty"))
    return sources.revision_fingerprint(rows).select("id", "fingerprint")


# the log's text is written from the orders of a customer; SQL says what was written, so the two meet only if the text is read rightly
@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k, o_orderkey % 40 + 1 AS start, o_orderkey % 3 AS grown FROM orders),
 l AS (SELECT * FROM o WHERE k <= 3)
 SELECT c_name AS symbol_name, CAST(k AS BIGINT) AS revision, left(sha256('c' || o_orderkey), 8) AS commit_sha, o_orderpriority AS author, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 5 = 0 THEN 'Merge pull request #' || o_orderkey || ' from x' ELSE 'order ' || o_orderkey END AS subject, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'why ' || o_orderstatus || chr(10) || chr(10) || 'more' END AS body, start || ',2,' || start || ',' || (2 + grown) AS hunk FROM l JOIN customer ON c_custkey = o_custkey""")
def line_history(spark, sf):
    return _line_history(spark, sf).select("symbol_name", F.col("revision").cast("long").alias("revision"), "commit_sha", "author", "date", "subject", "body", F.array_join(F.transform("hunks", lambda h: F.concat_ws(",", h["old_start"], h["old_lines"], h["new_start"], h["new_lines"])), ";").alias("hunk"))


def _line_history(spark, sf):
    o = table(spark, sf, "orders")
    key, grown, start = F.col("o_orderkey"), F.col("o_orderkey") % 3, F.col("o_orderkey") % 40 + 1
    subject = F.when(key % 5 == 0, F.concat(F.lit("Merge pull request #"), key, F.lit(" from x"))).otherwise(F.concat(F.lit("order "), key))
    body = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("why "), "o_orderstatus", F.lit("\n\nmore")))
    patch = F.concat(F.lit("\n\ndiff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -"), start, F.lit(",2 +"), start, F.lit(","), grown + 2, F.lit(" @@\n-old line\n+new line\n"))
    entry = F.concat_ws("\0", F.sha2(F.concat(F.lit("c"), key).cast("binary"), 256), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"), subject, F.concat(body, patch))
    texts = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-key).alias("k"), entry.alias("t")))), lambda x: x["t"]), "\n").alias("log"))
    c = table(spark, sf, "customer")
    logs = c.join(texts, c["c_custkey"] == texts["o_custkey"], "left").select(F.col("c_name").alias("symbol_name"), F.lit(20).alias("line_start"), F.lit(45).alias("line_end"), "log")
    return history.revisions(logs)


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k, o_orderkey % 40 + 1 AS s, o_orderkey % 3 AS g FROM orders),
 m AS (SELECT o_custkey, max(s) FILTER (k = 1) AS s1, max(g) FILTER (k = 1) AS g1, max(s) FILTER (k = 2) AS s2, max(g) FILTER (k = 2) AS g2 FROM o WHERE k <= 2 GROUP BY 1),
 a AS (SELECT *, CASE WHEN 20 >= s1 + 2 + g1 THEN 20 - g1 WHEN 20 >= s1 THEN s1 + least(20 - s1, 1) ELSE 20 END AS x1, CASE WHEN 30 >= s1 + 2 + g1 THEN 30 - g1 WHEN 30 >= s1 THEN s1 + least(30 - s1, 1) ELSE 30 END AS y1 FROM m)
 SELECT c_name AS symbol_name, CAST(x1 AS BIGINT) AS start_1, CAST(y1 AS BIGINT) AS end_1, CAST(CASE WHEN s2 IS NULL THEN -1 WHEN x1 >= s2 + 2 + g2 THEN x1 - g2 WHEN x1 >= s2 THEN s2 + least(x1 - s2, 1) ELSE x1 END AS BIGINT) AS start_2, CAST(CASE WHEN s2 IS NULL THEN -1 WHEN y1 >= s2 + 2 + g2 THEN y1 - g2 WHEN y1 >= s2 THEN s2 + least(y1 - s2, 1) ELSE y1 END AS BIGINT) AS end_2 FROM a JOIN customer ON c_custkey = o_custkey""")
def line_ranges(spark, sf):
    r = _line_history(spark, sf).where("revision <= 2")
    at = lambda c, k: F.coalesce(F.max(F.when(F.col("revision") == k, F.col(c))), F.lit(-1))
    return r.groupBy("symbol_name").agg(at("start_before", 1).alias("start_1"), at("end_before", 1).alias("end_1"), at("start_before", 2).alias("start_2"), at("end_before", 2).alias("end_2"))


@query("""WITH a AS (SELECT c_name AS n, 'pr' || c_nationkey AS t FROM customer WHERE c_acctbal > 5000), b AS (SELECT c_name AS n, 'log' AS t FROM customer) SELECT b.n AS symbol_name, coalesce(a.t, b.t) AS title FROM b LEFT JOIN a USING (n)""")
def history_tiers(spark, sf):
    c = table(spark, sf, "customer")
    first = c.where("c_acctbal > 5000").select(F.col("c_name").alias("symbol_name"), F.concat(F.lit("pr"), "c_nationkey").alias("title"))
    return sources.best_history(first, c.select(F.col("c_name").alias("symbol_name"), F.lit("log").alias("title"))).select("symbol_name", "title")


@query("""SELECT p_partkey AS id, array_to_string(list_transform(range(1, least(40, p_size + 20) + 1), lambda i: 'c' || i), ',') AS calls, left(repeat(p_name, 30), 200) AS doc, CAST(least(6, p_size % 9) AS BIGINT) AS flags FROM part""")
def tree_payload(spark, sf):
    n = st.nodes(spark, sf)
    many = lambda size: F.transform(F.sequence(F.lit(1), size.cast("int")), lambda i: F.concat(F.lit("c"), i))
    rows = n.withColumns({"calls": many(F.col("complexity") + 20), "callers": many(F.lit(2)), "line_end": F.col("line_start"), "doc": F.repeat("name", 30), "flags": F.slice(many(F.lit(9)), 1, (F.col("complexity") % 9).cast("int"))})
    return report.compact_tree(rows).select("id", joined("calls").alias("calls"), "doc", F.size("flags").cast("long").alias("flags"))


@query("""SELECT label, CAST(n AS BIGINT) AS n FROM (SELECT 0 AS k, 'files' AS label, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 1, 'symbols', (SELECT count(*) FROM part) UNION ALL SELECT 2, 'resolved_call_edges', 0 UNION ALL SELECT 3, 'modules', 0 UNION ALL SELECT 4, 'test_functions', 0 UNION ALL SELECT 5, 'production_functions', (SELECT count(*) FROM supplier) UNION ALL SELECT 6, 'classes', (SELECT count(*) FROM nation)) WHERE k < 4 OR n > 0""")
def headline_cards(spark, sf):
    count = lambda name, c: table(spark, sf, name).agg(F.count("*").alias(c))
    rows = count("customer", "files").unionByName(count("part", "symbols"), True).unionByName(count("supplier", "production_functions"), True).unionByName(count("nation", "classes"), True)
    zero = [F.lit(0).alias(c) for c in ("resolved_call_edges", "modules", "test_functions")]
    return report.metric_cards(rows.agg(*[F.max(c).alias(c) for c in rows.columns], *zero), 2).select("label", "n")


@query("""SELECT 8 - least(8, greatest(0, 8)) + row_number() OVER (ORDER BY o_orderkey) AS n, trim(o_orderpriority) AS title, substr(regexp_replace(repeat(o_orderpriority || ' ', 300), ' +$', ''), 1, 2000) AS content FROM orders ORDER BY o_orderkey LIMIT 8""")
def narrative_chapters(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("`"), "o_orderpriority", F.lit("`  ")).alias("title"), F.repeat(F.concat("o_orderpriority", F.lit("  ")), 300).alias("content"))
    return insights.clamped(rows).select(F.row_number().over(Window.orderBy("ord")).cast("long").alias("n"), "title", "content")


@query("""WITH d AS (SELECT count(*) AS n FROM part WHERE p_partkey % 13 = 0 AND p_partkey % 10 <> 0), h AS (SELECT least(6, count(*)) AS n FROM part WHERE p_size >= 12 AND p_partkey % 10 <> 0), e AS (SELECT count(*) AS n FROM supplier)
 SELECT row_number() OVER (ORDER BY o) AS step, kind, CAST(n AS BIGINT) AS n FROM (SELECT 2 AS o, 'dynamic' AS kind, n FROM d UNION ALL SELECT 3, 'hotspots', n FROM h UNION ALL SELECT 4, 'tests', 1 UNION ALL SELECT 5, 'entries', n FROM e UNION ALL SELECT 6, 'unresolved', 7) WHERE n > 0""")
def road_map(spark, sf):
    n = st.nodes(spark, sf)
    stats = spark.range(1).select(F.lit(100).alias("production_functions"), F.lit(1).alias("test_functions"), F.lit(7).alias("unresolved_call_names"))
    own = n.where(F.col("kind").isin(*fixed.FUNCTION_KINDS))
    return report.roadmap(stats, report.hotspots(n), n.limit(0), own.where(text.is_dynamic("flags")), table(spark, sf, "supplier"))


# streams, run to their end over the table as files


def _event_stream(spark, sf):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, sf, "events").schema)
    return changes.file_stream(spark, f"{sf}/events.parquet*", schema)


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    out = changes.run_to_end(changes.windowed(_event_stream(spark, sf), "ts", "1 day", None, "10 minutes", ["event_type"], "value"), "event_windows", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf):
    out = changes.run_to_end(changes.sessions(_event_stream(spark, sf), "ts", "2 hours", "10 minutes", ["user_id"]), "event_sessions", "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT ledger, \"at\", coins, accepted, total_spent FROM (" + SETTLE_SQL + ")")
def ledger_stream(spark, sf):
    txns = _event_stream(spark, sf).select(F.col("user_id").alias("ledger"), F.col("event_id").alias("at"), (F.col("event_id") % 9 + 1).cast("long").alias("coins"))
    return changes.run_to_end(changes.ledger_stream(txns), "ledger_stream", "append")
