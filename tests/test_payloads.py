"""What the routes answer for a small tree."""

import pytest
from graphloom.plans.model import Model

TREE = {
    "app/a.py": "def load(k):\n    return save(k)\n\n\ndef save(k):\n    save2(k)\n    return k\n\n\ndef _hidden():\n    save(1)\n    x.save(2)\n",
    "app/deep/b.py": "class Box:\n    def put(self):\n        save2(1)\n\n\ndef save2(k):\n    pass\n",
    "app/empty.py": "",
    "tests/test_a.py": "def test_load():\n    load(1)\n",
}


@pytest.fixture(scope="module")
def model(spark):
    return Model(spark.createDataFrame(sorted(TREE.items()), "path string, content string"))


def test_context(model):
    r = model.payload("context", "save").first()
    assert r["symbol"]["brief"]["file"] == "app/a.py" and r["symbol"]["brief"]["line"] == 5 and r["symbol"]["source_kind"] == "ast"
    assert [c["name"] for c in r["callers"]] == ["_hidden", "load"] and [c["name"] for c in r["calls"]] == ["save2"]
    assert r["children"] == [] and r["parent"] is None and r["source"].startswith("def save(k):") and r["insight"]["micro"]
    assert all(f["entry"] == f["chain"][0] and "save" in f["chain"] for f in r["flows"])
    box = model.payload("context", "Box").first()
    assert [c["name"] for c in box["children"]] == ["put"] and box["callers"] == []
    assert model.payload("context", "nobody").count() == 0


def test_usages(model):
    r = model.payload("usages", "save").first()
    assert r["call_site_count"] == 2
    assert {c["brief"]["name"]: list(c["raw_calls"]) for c in r["callers"]} == {"_hidden": ["save", "x.save"], "load": ["save"]}
    assert model.payload("usages", "Box").first()["callers"] == []


def test_tree_by_level(model):
    rows = {level: {r["node_id"]: r for r in model.payload("tree", detail=level).collect()} for level in (1, 2, 3)}
    assert {r["kind"] for r in rows[1].values()} == {"module", "folder", "file"}
    names = lambda level: {r["label"] for r in rows[level].values() if r["kind"] == "symbol"}
    assert names(2) == {"load", "save", "Box", "put", "save2"} and names(3) == names(2) | {"_hidden", "test_load"}
    assert rows[1]["module:app"]["count"] == 6 and rows[1]["file:app/empty.py"]["count"] == 0 and rows[1]["file:app/a.py"]["detail"] == "app/a.py"
    assert rows[3]["symbol:tests/test_a.py::test_load"]["detail"] == "function test"
    under = sorted((r["position"], r["label"]) for r in rows[2].values() if r["parent_id"] == "file:app/a.py")
    assert [x for _, x in under] == ["load", "save"]  # load has callers in other files


def test_dossier_grows_with_its_level(model):
    got = [model.payload("dossier", detail=k).first() for k in (1, 3)]
    assert [r["level"] for r in got] == [1, 3] and len(got[0]["html"]) < len(got[1]["html"])
    assert {c["label"] for c in got[0]["cards"]} == {"files", "symbols", "resolved_call_edges", "modules"}
