"""Report tables, insights and ledgers on a few rows."""

import pytest
from graphloom.functions import text
from graphloom.operators import insights, ledger, report, ripple
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [("a", "load_user", "m.load_user", "function", "m/a.py", "m", 20, False, ["dynamic:eval"], "Loads one user from the table.", "h1", "d", ["b"], []), ("b", "save", "m.save", "method", "m/b.py", "m", 3, True, [], "", "h2", "d", [], ["a"]), ("c", "Box", "Box", "class", "root.py", "root", 1, False, [], "", "h3", "d", [], [])]
    return spark.createDataFrame(rows, "id string, name string, qualified string, kind string, file_path string, module string, complexity int, is_test boolean, flags array<string>, doc string, hash string, deps_hash string, calls array<string>, callers array<string>").withColumns({"line_start": F.lit(1), "line_end": F.lit(2), "language": F.lit("python")})


def test_stats_cards_and_roadmap(spark, symbols):
    files = spark.createDataFrame([("m/a.py", True), ("root.py", False)], "path string, is_production boolean")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    stats = report.repo_stats(files, symbols, edges, spark.range(5))
    s = stats.first()
    assert (s["files"], s["symbols"], s["functions"], s["methods"], s["classes"], s["unresolved_call_names"]) == (2, 3, 1, 1, 1, 4)
    assert report.resolution_rate(stats).first()["rate"] == "20%"
    sizes = [report.metric_cards(stats, k).count() for k in (1, 2, 3)]
    assert sizes == [4, 7, 9]
    ids = symbols.select("id")
    steps = [(r["step"], r["kind"]) for r in report.roadmap(stats, report.hotspots(symbols), ids, ids.limit(0), ids).collect()]
    assert steps == [(1, "cycles"), (2, "hotspots"), (3, "entries"), (4, "unresolved")]


def test_evidence_and_tree(spark, symbols):
    files = spark.createDataFrame([("m/a.py", "x\ny\nz")], "path string, content string")
    row = report.symbol_evidence(symbols.where("id = 'a'").select("id"), symbols, files).first()
    assert row["source_text"] == "x\ny" and row["calls"] == ["b"]
    assert report.compact_tree(symbols).count() == 3


def test_insights_by_hash(spark, symbols):
    none = spark.createDataFrame([], "id string, hash string, deps_hash string")
    entries = spark.createDataFrame([], "id string, micro string, why string, source string, key string")
    wanted = insights.wanted(symbols, none, entries)
    assert wanted.count() == 3
    made = insights.automatic(symbols)
    rows = {r["id"]: r for r in made.collect()}
    assert rows["a"]["micro"] == "Loads one user from the" and rows["b"]["micro"] == "Saves" and "Method defined in" in rows["b"]["why"]
    old = symbols.select("id", "hash", "deps_hash")
    assert insights.wanted(symbols, old, made).count() == 0
    assert insights.wanted(symbols, old, made, live=True).count() == 3
    assert insights.wanted(symbols, old, made, force=True).count() == 3
    kept = insights.refreshed(made, made.where("id = 'a'"), symbols.where("id <> 'c'"))
    assert {r["id"] for r in kept.collect()} == {"a", "b"}


def test_providers_fall_back(spark, symbols):
    def provider(batch):
        return {"a": {"micro": "one two three four five six", "why": "because"}, "zz": {"micro": "x"}}

    def broken(batch):
        raise RuntimeError

    got = {r["id"]: (r["micro"], r["source"]) for r in insights.provided(symbols, provider, "llm").collect()}
    assert got["a"] == ("one two three four five", "llm") and got["b"][1] == "auto" and set(got) == {"a", "b", "c"}
    assert {r["source"] for r in insights.provided(symbols, broken, "llm").collect()} == {"auto"}


def test_ledger_boundaries(spark):
    rows = [(1, 1, 39), (1, 2, 2), (1, 3, 1), (1, 4, 1), (2, 1, 41), (3, 1, 40)]
    got = [(r["ledger"], r["at"], r["accepted"], r["total_spent"]) for r in ledger.settle(spark.createDataFrame(rows, "ledger long, at long, coins long"), "ledger", "at").orderBy("ledger", "at").collect()]
    assert got == [(1, 1, True, 39), (1, 2, False, 39), (1, 3, True, 40), (1, 4, False, 40), (2, 1, False, 0), (3, 1, True, 40)]


def test_prompts_and_answers(spark):
    changes = spark.createDataFrame([("t", "f", "a.py", "DELETION", "Removal.")], "target_id string, name string, file_path string, change_type string, description string")
    contexts = spark.createDataFrame([("t", k, f"f{k}.py", "g", k) for k in range(8)], "target_id string, ord int, file string, symbol string, line int")
    prompt = ripple.prompts(changes, contexts).first()["prompt"]
    assert prompt.count("- f") == 5 and "DELETION" in prompt
    ladder = [(["road map", "roadmap"], "later"), (["cycle"], "cut")]
    got = [r[0] for r in spark.createDataFrame([("The Roadmap of cycles",), ("Cycle",), ("else",)], "p string").select(text.answer("p", ladder, "none")).collect()]
    assert got == ["later", "cut", "none"]


def test_warnings(spark):
    targets = spark.createDataFrame([("t", "f", "a.py"), ("u", "g", "b.py")], "id string, name string, file_path string")
    found = spark.createDataFrame([("t", "x.py"), ("t", "y.py")], "target_id string, file string")
    got = {r["target_id"]: r["semantic_warning"] for r in ripple.warning(found, targets).collect()}
    assert "`x.py`, `y.py`. Here are the 2 files" in got["t"] and got["u"].startswith("Notice")
