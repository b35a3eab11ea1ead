"""A small tree in three languages: extraction, resolution and everything derived from it."""

import pytest
from graphloom.operators import delta, dynamic, graph, lines, ripple
from graphloom.plans.model import Model, symbols_of

TREE = {
    "app.py": '''from pkg import helpers


class UserService:
    """Loads and saves users."""

    def load_user(self, key):
        return helpers.fetch_row(key)

    def save_user(self, key):
        return helpers.write_row(key)


def audit(x):
    if x:
        return _emit(x)


def _emit(x):
    return audit(x)


def dynamic_dispatch(name):
    return globals()[name]()
''',
    "pkg/__init__.py": "",
    "pkg/helpers.py": "def fetch_row(key):\n    return key\n\n\ndef write_row(key):\n    return key\n",
    "ui.ts": "export class UserCard {\n  render(x) {\n    return formatName(x);\n  }\n}\n\nexport function formatName(x) {\n  return x;\n}\n",
    "runner.go": "package main\n\nfunc main() {\n\tstart()\n}\n\nfunc start() {\n\tprintln()\n}\n",
    "tests/test_app.py": "from app import audit\n\n\ndef test_load():\n    audit(1)\n",
    "broken.py": "def (:\n",
    "empty.py": "   \n",
    "vendor.txt": "no code",
}


@pytest.fixture(scope="module")
def model(spark):
    return Model(spark.createDataFrame(sorted(TREE.items()), "path string, content string"))


def ids(df, column="id"):
    return {r[column] for r in df.select(column).collect()}


def test_symbols(model):
    got = {r["id"]: r for r in model.symbols.collect()}
    assert {"app.py::UserService", "app.py::UserService.load_user", "pkg/helpers.py::fetch_row", "ui.ts::UserCard.render", "ui.ts::formatName", "runner.go::start"} <= set(got)
    assert sum(r["is_test"] and r["kind"] == "function" for r in got.values()) == 1
    assert got["app.py::UserService"]["doc"] == "Loads and saves users."
    assert got["app.py::audit"]["complexity"] == 2
    assert "dynamic:namespace" in got["app.py::dynamic_dispatch"]["flags"]
    assert got["ui.ts::UserCard.render"]["source"] == "regex"
    assert got["app.py::UserService.load_user"]["parent"] == "UserService"


def test_calls_resolve_and_transpose(model):
    edges = {(r["src"], r["dst"]) for r in model.edges.collect()}
    assert ("app.py::UserService.load_user", "pkg/helpers.py::fetch_row") in edges
    assert ("runner.go::main", "runner.go::start") in edges
    assert ("tests/test_app.py::test_load", "app.py::audit") in edges
    known = ids(model.symbols)
    assert all(a in known and b in known for a, b in edges)
    callers = {(c, r["id"]) for r in graph.callers(model.edges).collect() for c in r["callers"]}
    assert callers == edges


def test_cycles_and_classes(model):
    assert {r["id"] for r in model.components.collect()} == {"app.py::audit", "app.py::_emit"}
    classes = {(r["id"], r["class"]) for r in model.classes.collect()}
    assert ("app.py::dynamic_dispatch", "dynamic") in classes
    assert ("pkg/helpers.py::fetch_row", "independent") in classes


def test_entries_and_flows(model):
    entries = {(r["symbol_id"], r["kind"], r["resolved"]) for r in model.entries.collect()}
    assert ("runner.go::main", "main", True) in entries
    flows = [list(r["path"]) for r in model.flows.collect()]
    assert ["runner.go::main", "runner.go::start"] in flows


def test_lookup(model):
    def find(x):
        r = model.find(x).first()
        return r["status"], r["id"]

    assert find("app.py::audit") == ("found", "app.py::audit")
    assert find("LOAD_USER") == ("found", "app.py::UserService.load_user")
    assert find("nothing")[0] == "not found"
    got = model.context("fetch_row").first()
    assert got["callers"] == ["app.py::UserService.load_user"] and got["source_text"].startswith("def fetch_row")
    assert model.usages("fetch_row").first()["call_site_count"] == 1


def test_ripple_and_radius(model):
    found = model.ripple("audit").collect()
    assert {(r["file"], r["impact_type"]) for r in found} >= {("app.py", "DIRECT_CALLER_BREAKAGE"), ("tests/test_app.py", "TEST_BREAKAGE")}
    tiers = {r["path"]: r["tier"] for r in model.dependencies().collect()}
    assert tiers["pkg/helpers.py"] == "green"


def test_reports_grow_with_level(model):
    sizes = [len(model.dossier(k)) for k in (1, 2, 3)]
    assert sizes[0] < sizes[1] < sizes[2]
    assert model.dossier(9) == model.dossier(3) and model.dossier(0) == model.dossier(1)


def test_empty_model(spark):
    empty = Model(spark.createDataFrame([], "path string, content string"))
    assert empty.symbols.count() == 0 and empty.edges.count() == 0 and empty.pivotal.count() == 0
    assert "<html>" in empty.dossier(3)


def test_delta_sequence(spark):
    def snapshot(tree):
        s = symbols_of(spark.createDataFrame(sorted(tree.items()), "path string, content string"))
        return s.select("id", "hash", s["name"].alias("deps_hash"))

    first = snapshot(TREE)
    counts = lambda a, b: delta.delta_counts(delta.delta(a, b)).first().asDict()
    none = first.limit(0)
    assert counts(none, first)["added"] == first.count()
    assert counts(first, first)["unchanged"] == first.count()
    edited = snapshot(TREE | {"pkg/helpers.py": TREE["pkg/helpers.py"].replace("return key\n\n", "return key + 1\n\n")})
    assert counts(first, edited)["changed"] == 1
    gone = snapshot({k: v for k, v in TREE.items() if k != "pkg/helpers.py"})
    assert counts(first, gone)["removed"] == 2


def test_dynamic_families(spark):
    source = "\n".join(["import importlib, os", "getattr(x, 'y')", "importlib.import_module(n)", "eval('1')", "bus.emit('go')", "os.environ['K']", "handlers[key](1)", "# eval(2)"])
    files = spark.createDataFrame([("dyn.py", source)], "path string, content string")
    got = dynamic.detect(files, lines.explode_lines(files)).collect()
    assert {r["pattern_type"] for r in got} == {"reflection", "dynamic_import", "eval", "event_emitter", "env_conditional", "string_dispatch"}
    assert all(0 <= r["confidence"] <= 1 for r in got) and all(r["line_number"] < 8 for r in got)
    only = dynamic.detect(files, lines.explode_lines(files), ("eval",)).collect()
    assert {r["pattern_type"] for r in only} == {"eval"}


def test_patches(spark):
    rows = spark.createDataFrame([("a.py", "f", 2, "def f():\n    g()\n"), ("b.ts", "h", 9, "")], "file string, symbol string, line int, content string")
    got = {r["file"]: r for r in ripple.patches(rows, "g", "DELETION").collect()}
    assert got["a.py"]["patched_content"].splitlines()[1].startswith("    # TODO: verify")
    assert got["b.ts"]["patched_content"].startswith("// TODO") and "+" in got["a.py"]["diff"]
