"""Nodes, edges, calls, lines, snapshots and ledgers out of the test tables, in Spark and as SQL.

``SQL`` has the same relations as common table expressions for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"),
        F.col("p_name").alias("name"),
        F.concat_ws(".", "p_brand", "p_name").alias("qualified"),
        F.concat_ws("/", "p_brand", "p_type").alias("file_path"),
        F.col("p_type").alias("module"),
        F.col("p_size").cast("long").alias("complexity"),
        F.when(k % 10 == 0, "class").when(k % 3 == 0, "method").otherwise("function").alias("kind"),
        (k % 7 == 0).alias("is_test"),
        F.when(k % 13 == 0, F.array(F.lit("dynamic:eval"))).when(k % 5 == 0, F.array(F.lit("cache"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.when(k % 4 == 0, "go").when(k % 4 == 1, "typescript").otherwise("python").alias("language"),
        (k % 500 + 1).cast("long").alias("line_start"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order: a window within the order, whose lines are few."""
    rows = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return rows.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null and src <> dst").distinct()


def best_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge a part: to the part after it in the order of its dearest line. Cycles are few and short."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), "l_extendedprice", "l_orderkey").where("dst is not null and src <> dst")
    return rows.groupBy("src").agg(F.max_by("dst", F.struct("l_extendedprice", "l_orderkey", "dst")).alias("dst"))


def call_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols whose names are often, not always, unique."""
    n = nodes(spark, sf_dir)
    name = F.concat_ws("_", "name", "complexity")
    return n.select("id", name.alias("name"), "kind", "file_path", F.concat(F.col("module"), F.lit("K"), (F.col("complexity") % 5).cast("string")).alias("parent"), "language")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw calls: bare, on self and on the file stem, by line number."""
    li = table(spark, sf_dir, "lineitem")
    s = call_symbols(spark, sf_dir).select(F.col("id").alias("callee"), F.col("name").alias("callee_name"), F.substring_index("file_path", "/", -1).alias("stem"))
    pair = li.select(F.col("l_partkey").alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_partkey") * 3)).alias("pick"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_linenumber").alias("n"))
    pair = pair.withColumn("callee", F.col("pick") % F.lit(table(spark, sf_dir, "part").count()))
    named = pair.join(s, "callee")
    raw = F.when(F.col("n") % 3 == 0, F.col("callee_name")).when(F.col("n") % 3 == 1, F.concat(F.lit("self."), "callee_name")).otherwise(F.concat("stem", F.lit("."), "callee_name"))
    return named.select("src", "pos", F.concat(raw, F.lit("(x)")).alias("raw"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The newest event of each user before two points in time."""
    e = table(spark, sf_dir, "events")

    def at(cut: str) -> DataFrame:
        own = e.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz"))
        newest = own.groupBy(F.col("user_id").alias("id")).agg(F.max_by(F.concat_ws("|", "event_type", F.col("value").cast("string"), "props"), "ts").alias("body"))
        return newest.select("id", F.substring(F.sha2("body", 256), 1, 20).alias("hash"), F.lit("").alias("deps_hash"))

    return at("2024-01-05 00:00:00"), at("2024-01-15 00:00:00")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("ledger"), F.col("event_id").alias("at"), (F.col("event_id") % 9 + 1).cast("long").alias("coins"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files written from customers and their nations: Python, Go and TypeScript that call each other."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    py = F.concat(F.lit("import os\n\n\ndef load_"), "k", F.lit("(key: int) -> str:\n    \"\"\"Loads one row of the table.\"\"\"\n    if key > 1 and key < 9:\n        return os.getenv('K')\n    return save_"), "k", F.lit("(key)\n\n\ndef save_"), "k", F.lit("(key):\n    return eval('key')  # save\n\n\nclass Box"), "k", F.lit(":\n    def open(self):\n        return self.shut()\n\n    def shut(self):\n        return load_"), "k", F.lit("(1)\n"))
    go = F.concat(F.lit("package main\n\nimport \"fmt\"\n\nfunc Start"), "k", F.lit("(n int) error {\n\tfmt.Println(n)\n\treturn stop"), "k", F.lit("(n)\n}\n\nfunc stop"), "k", F.lit("(n int) error {\n\treturn nil\n}\n"))
    ts = F.concat(F.lit("import './base'\n\nexport class Card"), "k", F.lit(" extends Base {\n  render(x) {\n    return draw"), "k", F.lit("(x);\n  }\n}\n\nexport function draw"), "k", F.lit("(x) {\n  return fetch('/api/"), "k", F.lit("');\n}\n"))
    ext = F.when(F.col("k") % 3 == 0, "py").when(F.col("k") % 3 == 1, "go").otherwise("ts")
    content = F.when(F.col("k") % 3 == 0, py).when(F.col("k") % 3 == 1, go).otherwise(ts)
    return c.select(F.concat(F.lit("apps/n"), "n", F.lit("/f"), "k", F.lit("."), ext).alias("path"), content.alias("content"), "k", "n")


SQL = {
    "nodes": """nodes AS (SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS qualified, p_brand || '/' || p_type AS file_path, p_type AS module, CAST(p_size AS BIGINT) AS complexity,
 CASE WHEN p_partkey % 10 = 0 THEN 'class' WHEN p_partkey % 3 = 0 THEN 'method' ELSE 'function' END AS kind, p_partkey % 7 = 0 AS is_test,
 CASE WHEN p_partkey % 13 = 0 THEN 'dynamic:eval' WHEN p_partkey % 5 = 0 THEN 'cache' END AS flag,
 CASE WHEN p_partkey % 4 = 0 THEN 'go' WHEN p_partkey % 4 = 1 THEN 'typescript' ELSE 'python' END AS language, CAST(p_partkey % 500 + 1 AS BIGINT) AS line_start FROM part)""",
    "edges": """edges AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)""",
    "best_edges": """edges AS (SELECT src, arg_max(dst, (l_extendedprice, l_orderkey, dst)) AS dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_extendedprice, l_orderkey FROM lineitem) WHERE dst IS NOT NULL AND src <> dst GROUP BY 1)""",
    "fan": """fan AS (SELECT n.id, coalesce(i.fan_in, 0) AS fan_in, coalesce(o.fan_out, 0) AS fan_out, coalesce(i.cross_file_callers, 0) AS cross_file_callers FROM nodes n
 LEFT JOIN (SELECT e.dst AS id, count(*) AS fan_in, count(DISTINCT CASE WHEN a.file_path <> b.file_path THEN a.file_path END) AS cross_file_callers FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY 1) i ON i.id = n.id
 LEFT JOIN (SELECT src AS id, count(*) AS fan_out FROM edges GROUP BY 1) o ON o.id = n.id)""",
    "ranked": """ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT n.id, CAST(round(f.cross_file_callers * 3 + f.fan_in * 0.5 + least(n.complexity, 15) + CASE WHEN n.flag IS NOT NULL THEN 2 ELSE 0 END, 2) AS DOUBLE) AS score, f.fan_in, f.fan_out, f.cross_file_callers, n.complexity FROM nodes n JOIN fan f USING (id) WHERE n.kind IN ('function', 'method')) QUALIFY rank <= 200)""",
    "reach": """reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON e.src = r.dst), members AS (SELECT a.src AS id, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1 HAVING count(*) > 1)""",
    "snapshots": """cuts AS (SELECT TIMESTAMP '2024-01-05 00:00:00' AS cut, 1 AS k UNION ALL SELECT TIMESTAMP '2024-01-15 00:00:00', 2),
 newest AS (SELECT k, user_id AS id, substr(sha256(arg_max(event_type || '|' || CAST(value AS VARCHAR) || '|' || props, ts)), 1, 20) AS hash FROM events JOIN cuts ON ts < cut GROUP BY 1, 2),
 changes AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS status FROM (SELECT * FROM newest WHERE k = 1) a FULL JOIN (SELECT * FROM newest WHERE k = 2) b ON a.id = b.id)""",
    "symbols": """symbols AS (SELECT p_partkey AS id, p_name || '_' || p_size AS name, CASE WHEN p_partkey % 10 = 0 THEN 'class' WHEN p_partkey % 3 = 0 THEN 'method' ELSE 'function' END AS kind, p_brand || '/' || p_type AS file_path, p_type AS stem, p_type || 'K' || (p_size % 5) AS parent FROM part)""",
    "calls": """calls AS (SELECT src, pos, s.name AS tail, CASE WHEN n % 3 = 0 THEN '' WHEN n % 3 = 1 THEN 'self' ELSE s.stem END AS receiver FROM (SELECT l_partkey AS src, (l_suppkey * 7 + l_partkey * 3) % (SELECT count(*) FROM part) AS callee, l_orderkey * 10 + l_linenumber AS pos, l_linenumber AS n FROM lineitem) l JOIN symbols s ON s.id = l.callee)""",
}


def with_(*names: str, body: str) -> str:
    """A query over the named relations."""
    return f"WITH RECURSIVE {', '.join(SQL[n] for n in names)} {body}"
