"""A model after edits equals one that is built anew, and only what an edit can change is resolved again."""

import pytest
from graphloom.operators import resolve
from graphloom.plans.model import Model
from pyspark.sql import functions as F

SCHEMA = "path string, content string"
START = {
    "a.py": "def run():\n    save()\n    b.load()\n    help()\n\ndef other():\n    only()\n",
    "b.py": "def save():\n    pass\n\ndef load():\n    save()\n",
    "c.py": "class Store:\n    def put(self):\n        self.get()\n    def get(self):\n        pass\n\ndef only():\n    pass\n",
    "d.py": "def far():\n    near()\n\ndef near():\n    Store.put()\n",
}
EDITS = {
    "edit": {"b.py": "def save():\n    load()\n\ndef fetch():\n    save()\n"},
    "add": {"e.py": "def help():\n    near()\n\ndef only():\n    pass\n"},
    "delete": {"b.py": None},
    "move": {"b.py": None, "pkg/b.py": START["b.py"]},
    "class": {"e.py": "class Store:\n    def put(self):\n        pass\n"},
    "nothing": {},
    "all at once": {"a.py": START["a.py"] + "\ndef more():\n    far()\n", "c.py": None, "f.py": "def save():\n    run()\n"},
}


def frame(spark, files):
    return spark.createDataFrame([(p, t) for p, t in files.items() if t is not None], SCHEMA)


def state(model):
    edges = {(r["src"], r["dst"], r["pos"]) for r in model.edges.collect()}
    symbols = {(r["id"], r["hash"], tuple(r["raw_calls"])) for r in model.symbols.collect()}
    records = {(r["record"], r["file_path"], r["id"], r["src"], r["dst"]) for r in model.records.collect()}
    return symbols, edges, records


@pytest.mark.parametrize("name", sorted(EDITS))
def test_refresh_equals_a_new_model(spark, name):
    model = Model(frame(spark, START))
    assert model.edges.count()
    after = START | EDITS[name]
    model.refresh(frame(spark, after))
    assert {"symbols", "edges"} <= set(model.__dict__)
    assert state(model) == state(Model(frame(spark, after)))


def test_calls_that_an_edit_leaves_alone_are_not_resolved_again(spark):
    old, new = Model(frame(spark, START)), Model(frame(spark, START | EDITS["edit"]))
    calls = new.symbols.select(F.col("id").alias("src"), F.posexplode("raw_calls").alias("pos", "raw"))
    paths = spark.createDataFrame([("b.py",)], "path string")
    again = {(r["src"], r["raw"]) for r in resolve.affected(old.symbols, new.symbols, calls, paths).collect()}
    assert ("a.py::run", "save") in again and ("a.py::run", "b.load") in again and ("b.py::fetch", "save") in again
    assert not again & {("a.py::other", "only"), ("d.py::far", "near"), ("d.py::near", "Store.put"), ("c.py::Store.put", "self.get")}
