"""Extraction from sources with decorators, nesting, receivers, generics and broken text, against what they hold."""

import hashlib

import pytest
from graphloom.operators import dynamic, extract, graph, ledger, lines, matching, resolve
from graphloom.plans.model import ROUTES, Model, symbols_of
from graphloom.sources import files as sources
from pyspark.sql import functions as F

PYTHON = '''"""Doc of the module."""
import os, sys as system
from a.b import c
from . import d

LIMIT: int = 3
_hidden = other = 1


@app.route("/x")
@cached(size=2)
async def fetch(key: str, /, *rest: int, flag: bool = True, **more) -> "list[int]":
    """Fetches."""
    async for x in source.stream(key):
        while x and key or flag:
            x = await helper(x)
    try:
        return [y for y in x if y] if x else None
    except (ValueError, KeyError):
        return os.path.join(system.prefix, str(key))


class Outer(Base, metaclass=Meta):
    """Outer doc."""

    class Inner:
        def deep(self):
            return deep_call()

    @property
    def value(self):
        def local():
            return nested_call()
        return self.compute(local())


def main():
    match 3:
        case 1: first()
        case _: second()


if __name__ == '__main__':
    main()
'''
GO = '''package main

import (
	"fmt"
	str "strings"
)

import "os"

type Server struct {
	name string
}

type Store interface { Get(k string) error }

func (s *Server) Serve(ctx context.Context, n int) (int, error) {
	if n > 1 {
		for i := range items { s.step(i) }
	}
	return fmt.Sprint(n), nil
}

func helper[T any](x T) T { return x }

func plain(a, b int) int { return append(a, os.Getenv("X")) }

func main() {
	srv.Serve(nil, 1); plain(1, 2)
}

func broken(x int) {
	if x { never_closed(
'''
TS = '''import { a } from './a';
import b from "b-lib/x";
const c = require('c');

export interface Shape<T> extends Base, Other { area(): number }
type Alias = string | number;
export abstract class Box<T> extends Base implements Shape, Other {
  private async load(id: string): Promise<void> {
    return fetchRow(id);
  }
  constructor() { super(); }
  get size() { return 1; }
}
class Plain extends Base implements Shape, Other {
}
export async function draw(x) {
  if (x) { render(x).then(y => y.done()); }
}
export const long = async (x) => {
  return this.service.run(x);
};
let arrow = y => y;
app.get('/users', handler);
router.POST('/x', handler);
const short = (x) => paint(x);
'''


def records(path, lang, source):
    rows = extract.records_of(path, lang, source)
    symbols = {r["id"]: r for r in rows if r["record"] in ("symbol", "method")}
    edges = {(r["src"], r["dst"], r["edge"]) for r in rows if r["record"] == "edge"}
    entries = {(r["id"], r["entry"]) for r in rows if r["record"] == "entry"}
    return symbols, edges, entries


def test_python():
    s, edges, entries = records("m.py", "python", PYTHON)
    assert set(s) == {"m.py::LIMIT", "m.py::_hidden", "m.py::other", "m.py::fetch", "m.py::Outer", "m.py::Outer.value", "m.py::main"}
    fetch = s["m.py::fetch"]
    assert [(p["name"], p["type"]) for p in fetch["parameters"]] == [("key", "str"), ("flag", "bool"), ("rest", "int"), ("more", "")]
    assert fetch["return_type"] == "'list[int]'" and fetch["doc"] == "Fetches." and fetch["exported"]
    assert fetch["imports"] == ["os", "sys", "a.b"]
    assert {"source.stream", "helper", "os.path.join", "str"} <= set(fetch["calls"])
    # async for, while, two boolean operators of two values each, a conditional, an except clause
    assert fetch["complexity"] == 1 + 1 + 1 + 2 + 1 + 1
    assert s["m.py::main"]["complexity"] == 3 and s["m.py::main"]["calls"] == ["first", "second"]
    assert not s["m.py::_hidden"]["exported"] and s["m.py::LIMIT"]["return_type"] == "int"
    assert s["m.py::Outer.value"]["type"] == "method" and {"nested_call", "self.compute"} <= set(s["m.py::Outer.value"]["calls"])
    assert {("m.py::Outer", "Base", "extends"), ("m.py::fetch", "os", "imports"), ("m.py::main", "first", "calls")} <= edges
    assert entries == {("m.py::main", "main"), ("m.py::__main__", "dunder_main")}


@pytest.mark.parametrize("source", ["def (:\n", "class A(\n", "x = '\x00'", "  indented\n", "(" * 5000, "﻿def f(): pass\n\tg"])
def test_broken_python_gives_nothing(source):
    assert extract.records_of("b.py", "python", source) == []


def test_go():
    s, edges, entries = records("m.go", "go", GO)
    # a type parameter is beyond the pattern of a function's head
    assert {k: r["type"] for k, r in s.items()} == {"m.go::Server": "class", "m.go::Store": "interface", "m.go::Server.Serve": "method", "m.go::plain": "function", "m.go::main": "function", "m.go::broken": "function"}
    serve = s["m.go::Server.Serve"]
    assert serve["parameters"] == [{"name": "ctx", "type": "context.Context"}, {"name": "n", "type": "int"}]
    assert serve["return_type"] == "(int, error)" and (serve["line_start"], serve["line_end"]) == (16, 21)
    assert serve["calls"] == ["s.step", "fmt.Sprint"] and serve["imports"] == ["fmt", "strings", "os"]
    assert s["m.go::plain"]["calls"] == ["os.Getenv"] and not s["m.go::plain"]["exported"]
    assert s["m.go::broken"]["calls"] == [] and s["m.go::broken"]["line_end"] == s["m.go::broken"]["line_start"]
    assert ("m.go", "fmt", "imports") in edges and ("m.go::main", "srv.Serve", "calls") in edges
    assert entries == {("m.go::main", "main")}


def test_typescript():
    s, edges, entries = records("m.ts", "typescript", TS)
    kinds = {k.removeprefix("m.ts::"): r["type"] for k, r in s.items()}
    assert kinds == {"Shape": "interface", "Alias": "type", "Box": "class", "Plain": "class", "draw": "function", "short": "function", "long": "function", "arrow": "function", "Box.load": "method", "Box.size": "method"}
    assert "render" in s["m.ts::draw"]["calls"] and "if" not in s["m.ts::draw"]["calls"]
    # an arrow's own expression, where no block begins soon after it
    assert s["m.ts::short"]["calls"] == ["paint"] and s["m.ts::long"]["calls"] == ["this.service.run"] and s["m.ts::arrow"]["calls"] == []
    assert s["m.ts::draw"]["exported"] and not s["m.ts::short"]["exported"]
    # the pattern of imports wants the quote right after the word, so those with names are not seen
    assert s["m.ts::draw"]["imports"] == ["c"]
    # a class with type parameters shows no bases: its pattern ends at the name
    assert {("m.ts::Plain", "Base", "extends"), ("m.ts::Plain", "Shape", "implements"), ("m.ts::Plain", "Other", "implements")} <= edges
    line = next(k for k, x in enumerate(TS.split("\n"), 1) if x.startswith("app.get"))
    assert entries == {(f"m.ts::route_get_{line}", "route"), (f"m.ts::route_post_{line + 1}", "route")}


@pytest.mark.parametrize("lang", ["go", "typescript", "javascript"])
@pytest.mark.parametrize("source", ["", "{", "}}}{{{", "func", "func (", "func ( ) f() {", "function", "class", "const x = (", "=>", "func f() {" * 300, "é" * 100 + "\nfunc é() {}"])
def test_odd_braces_do_not_stop_it(lang, source):
    extract.records_of("x", lang, source)


def test_no_symbol_is_dropped(spark):
    """More symbols than a display would show, all kept unless a cap is asked for."""
    files = spark.range(2100).select(F.concat(F.lit("p/f"), "id", F.lit(".py")).alias("path"), F.concat(*[F.concat(F.lit(f"def g{k}_"), "id", F.lit("():\n    pass\n\n")) for k in range(10)]).alias("content"))
    s = symbols_of(files)
    assert s.count() == 21_000
    assert symbols_of(files, cap=20_000).count() == 20_000


def test_deep_trees_keep_all_ancestors(spark):
    rows = [("n0", None, "module", "top")] + [(f"n{k}", f"n{k - 1}", "folder", f"level {k}") for k in range(1, 90)] + [("x", "n3", "symbol", "other")]
    got = {r["node_id"] for r in graph.tree_search(spark.createDataFrame(rows, "node_id string, parent_id string, kind string, label string"), "LEVEL 89").collect()}
    assert got == {f"n{k}" for k in range(90)}
    got = {r["node_id"] for r in graph.tree_search(spark.createDataFrame(rows, "node_id string, parent_id string, kind string, label string"), "top").collect()}
    assert got == {f"n{k}" for k in range(90)} | {"x"}


def test_containment_by_one_automaton_and_by_many(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, "xyz"), (3, ""), (4, None), (5, "ab\nçd")], "text_id long, text string")
    needles = spark.createDataFrame([("a", "abc"), ("b", "bca"), ("c", "z"), ("d", ""), ("e", None), ("f", "\nç"), ("g", "abc"), ("h", "abcabcabc")], "needle_id string, needle string")
    want = {(1, "a"), (1, "b"), (1, "g"), (2, "c"), (5, "f")}
    assert {tuple(r) for r in matching.contains_pairs(texts, needles).collect()} == want
    assert {tuple(r) for r in matching.contains_pairs(texts, needles, most=0).collect()} == want
    assert matching.contains_pairs(texts, needles.limit(0)).count() == 0


def test_settling_is_a_fold_in_order(spark):
    rows = [("a", 1, 30), ("a", 2, 20), ("a", 3, 10), ("a", 4, None), ("a", 5, 1), ("b", 1, 41), ("b", 2, 40), (None, 1, 5)]
    got = {(r["who"], r["at"]): (r["accepted"], r["total_spent"], r["coins_remaining"], r["tx_id"]) for r in ledger.settle(spark.createDataFrame(rows, "who string, at long, coins long"), "who", "at").collect()}
    assert got == {("a", 1): (True, 30, 10, "tx_0001"), ("a", 2): (False, 30, 10, None), ("a", 3): (True, 40, 0, "tx_0002"), ("a", 4): (False, 40, 0, None), ("a", 5): (False, 40, 0, None), ("b", 1): (False, 0, 40, None), ("b", 2): (True, 40, 0, "tx_0001"), (None, 1): (True, 5, 35, "tx_0001")}


def test_go_imports_without_a_slash(spark):
    files = spark.createDataFrame([("z/util/a.go",), ("b/myutils/x.go",), ("b/other.go",), ("util.py",)], "path string")
    imports = spark.createDataFrame([("go", "util"), ("go", "x/y/other"), ("go", "b/other"), ("go", "none"), ("go", "")], "language string, import string")
    got = {(r["import"], r["path"]) for r in resolve.resolve_imports(imports, files).collect()}
    assert got == {("util", "b/myutils/x.go"), ("b/other", "b/other.go")}


def test_context_has_flows(spark):
    tree = {"a.go": "package a\n\nfunc main() {\n\trun()\n}\n\nfunc run() {\n\tstop()\n}\n\nfunc stop() {\n}\n", "b.py": "def alone():\n    pass\n"}
    model = Model(spark.createDataFrame(sorted(tree.items()), "path string, content string"))
    flows = [list(f["path"]) for f in model.context("run").first()["flows"]]
    assert flows == [["a.go::main", "a.go::run", "a.go::stop"]]
    assert model.context("alone").first()["flows"] == []
    assert {(r["symbol_id"], tuple(r["path"])) for r in model.entry_flows().collect()} == {("a.go::main", ("a.go::main", "a.go::run", "a.go::stop"))}


def test_every_route_answers(spark, tmp_path):
    tree = {"a.py": "def load(k):\n    return save(k)\n\n\ndef save(k):\n    return k\n", "b.py": "class Box:\n    pass\n"}
    model = Model(spark.createDataFrame(sorted(tree.items()), "path string, content string"))
    answers = {route: model.payload(route, "save").count() for route in ROUTES}
    assert len(answers) == 12 and all(answers.values())
    assert model.payload("health").first()["symbols"] == 3 and model.payload("doc", "save").first()["documentation"].startswith('"""')
    assert model.payload("usages", "save").first()["call_site_count"] == 1 and model.payload("usages", "nobody").count() == 0
    with pytest.raises(ValueError):
        model.payload("nowhere")
    model.write_json(str(tmp_path / "model"))
    assert spark.read.json(str(tmp_path / "model" / "symbols")).count() == 3
    model.refresh(spark.createDataFrame([("c.py", "def only():\n    pass\n")], "path string, content string"))
    assert [r["id"] for r in model.symbols.collect()] == ["c.py::only"]


def test_revisions_and_ledgers(spark, tmp_path):
    rows = spark.createDataFrame([("abc", "main", False), ("abc", "main", True), (None, None, None), ("", "", False)], "head string, branch string, dirty boolean")
    got = [r["fingerprint"] for r in sources.revision_fingerprint(rows).collect()]
    assert got[0] != got[1] and got[2] == got[3] and got[0] == hashlib.sha256(b"abc|main|False").hexdigest()[:20]
    (tmp_path / "a.json").write_text('{"max_coins": 40,\n "coins_spent": 7, "transactions": [{"id": "tx_0001", "coins": 7}]}')
    (tmp_path / "b.json").write_text("{broken")
    found = {r["ledger"]: (r["coins_spent"], len(r["transactions"])) for r in sources.read_ledgers(spark, str(tmp_path / "*.json")).collect()}
    assert found == {"a.json": (7, 1), "b.json": (0, 0)}


def test_flows_of_many_entries(spark):
    """Entries without a flow are passed over until enough are found."""
    nodes = spark.range(300).select("id", F.concat(F.lit("f"), "id").alias("name"), F.lit("function").alias("kind"))
    edges = spark.createDataFrame([(k, 0) for k in range(100, 300)], "src long, dst long")
    entries = nodes.select(F.col("id").alias("ord"), "id")
    got = [(r["entry_id"], list(r["path"])) for r in graph.flows(entries, nodes, edges).orderBy("ord").collect()]
    assert got == [(k, [k, 0]) for k in range(100, 112)]


DEEP = {
    "sum": "def f():\n    return " + " + ".join(f"g{k}()" for k in range(1500)) + "\n",
    "chain": "def f(x):\n    return x" + "".join(f".m{k}()" for k in range(1200)) + "\n",
    "union": "def f(x: " + " | ".join(f"T{k}" for k in range(1500)) + "):\n    getattr(x, 'y')\n",
    "branches": "def f(x):\n    if x == 0:\n        pass\n" + "".join(f"    elif x == {k}:\n        h{k}()\n" for k in range(1, 1200)),
}


@pytest.mark.parametrize("name", sorted(DEEP))
def test_deep_expressions_are_read(name):
    rows = extract.records_of("a.py", "python", DEEP[name])
    symbols = [r for r in rows if r["record"] == "symbol"]
    dynamic.parsed_findings("a.py", DEEP[name])
    if not symbols:  # beyond the parser itself: nothing, and no error
        assert extract.parsed(DEEP[name]) is None
        return
    calls = symbols[0]["calls"]
    if name == "sum":
        assert calls == [f"g{k}" for k in range(1500)]
    if name == "union":
        assert symbols[0]["parameters"][0]["type"].split(" | ") == [f"T{k}" for k in range(1500)] and calls == ["getattr"]
    if name == "branches":
        assert calls == [f"h{k}" for k in range(1, 1200)]
    if name == "chain":
        assert calls == [*(f"m{k}" for k in range(1199, 0, -1)), "x.m0"]


def test_a_deep_file_does_not_stop_the_job(spark):
    files = spark.createDataFrame([("good.py", "def a():\n    b()\n"), *[(f"{n}.py", t) for n, t in DEEP.items()]], "path string, content string")
    got = {r["id"] for r in symbols_of(files).select("id").collect()}
    assert "good.py::a" in got and "sum.py::f" in got
    assert dynamic.detect(files, lines.explode_lines(files)).where("symbol_id = 'union.f'").count() == 1


def test_scopes_lose_a_suffix_not_letters(spark):
    assert dynamic.parsed_findings("pkg/happy.py", "eval('1')")[0]["symbol_id"] == "pkg.happy"
