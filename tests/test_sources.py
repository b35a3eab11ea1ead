"""Trees, histories, caches and streams on the local disk."""

import datetime
import time

import pytest
from graphloom.functions import text
from graphloom.operators import matching
from graphloom.plans import queries as plans
from graphloom.sources import files as sources
from graphloom.streaming import changes
from pyspark.sql import functions as F


def test_read_tree(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1\n\xff\n")
    (tmp_path / "src" / "test_b.py").write_text("y")
    (tmp_path / "src" / "node_modules" / "c.py").write_text("z")
    tree = sources.read_tree(spark, str(tmp_path))
    got = {r["path"]: r for r in tree.collect()}
    assert set(got) == {"src/a.py", "src/test_b.py", "src/node_modules/c.py"}
    assert "�" in got["src/a.py"]["content"] and got["src/a.py"]["size"] == 8
    assert {r["path"] for r in sources.source_files(tree, (".PY",)).collect()} == {"src/a.py"}
    assert {r["path"] for r in sources.source_files(tree, include_tests=True).collect()} == {"src/a.py", "src/test_b.py"}
    before = sources.tree_fingerprint(tree).first()["fingerprint"]
    assert sources.tree_fingerprint(sources.read_tree(spark, str(tmp_path))).first()["fingerprint"] == before
    meta = {r["path"]: r for r in sources.file_meta(tree).collect()}
    assert meta["src/a.py"]["loc"] == 3 and meta["src/test_b.py"]["is_test"]


def test_cache_swaps_whole_tables(spark, tmp_path):
    at, schema = str(tmp_path / "cache"), "id string, n long"
    assert sources.read_cache(spark, at, schema, 1).count() == 0
    sources.write_cache(spark.createDataFrame([("a", 1)], schema), at, 1)
    old = sources.read_cache(spark, at, schema, 1)
    sources.write_cache(spark.createDataFrame([("b", 2), ("c", 3)], schema), at, 1)
    assert old.count() == 1
    assert {r["id"] for r in sources.read_cache(spark, at, schema, 1).collect()} == {"b", "c"}
    assert sources.read_cache(spark, at, schema, 2).count() == 0


def test_history_tiers(spark):
    schema = "symbol_name string, title string"
    first, second = spark.createDataFrame([("a", "pr")], schema), spark.createDataFrame([("a", "log"), ("b", "log")], schema)
    got = {r["symbol_name"]: r["title"] for r in sources.best_history(first, second).collect()}
    assert got == {"a": "pr", "b": "log"}


def index_batches(spark, tmp_path, batches, buckets, seen=None):
    schema, source, at = "path string, hash string, mtime long", str(tmp_path / "in"), str(tmp_path / "index")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.01)
        changes.index_stream(changes.file_stream(spark, source, schema), at, str(tmp_path / "ck"), schema, seen=seen, buckets=buckets).awaitTermination()
    return at, schema


def test_index_stream_keeps_the_newest(spark, tmp_path):
    seen = []
    batches = ([("a", "1", 1), ("b", "1", 1)], [("a", "2", 2), ("b", "0", 0), ("c", "1", 2), (None, "n", 1)])
    at, schema = index_batches(spark, tmp_path, batches, 1, lambda d, _: seen.append(sorted((r["id"] or "", r["status"]) for r in d.collect())))
    assert seen[0] == [("a", "added"), ("b", "added")]
    assert seen[1] == [("", "added"), ("a", "changed"), ("b", "unchanged"), ("c", "added")]
    assert {(r["path"], r["hash"]) for r in changes.read_index(spark, at, schema).collect()} == {("a", "2"), ("b", "1"), ("c", "1"), (None, "n")}


def test_a_batch_rewrites_the_buckets_that_it_touches(spark, tmp_path):
    whole = [(f"p{k}", "1", 1) for k in range(400)]
    at, schema = index_batches(spark, tmp_path, [whole], 8)
    before = changes.index_places(spark, at)
    index_batches(spark, tmp_path, [[("p7", "2", 2)]], 8)
    after = changes.index_places(spark, at)
    assert len(before) == 8 and sum(before[b] != after[b] for b in after) == 1
    want = {(p, "2" if p == "p7" else "1") for p, _, _ in whole}
    assert {(r["path"], r["hash"]) for r in changes.read_index(spark, at, schema).collect()} == want
    # the same rows again, as after a failure, give the same index
    index_batches(spark, tmp_path, [[("p7", "2", 2)]], 8)
    assert {(r["path"], r["hash"]) for r in changes.read_index(spark, at, schema).collect()} == want


def test_index_without_batches(spark, tmp_path):
    assert changes.read_index(spark, str(tmp_path / "none"), "path string, hash string, mtime long").collect() == []


def event_files(spark, at, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.05 if k + 1 < len(batches) else 0)
    return changes.file_stream(spark, at, schema, per_batch=1)


def test_sessions_in_a_running_query_drop_late_rows(spark, tmp_path):
    schema = "user_id long, ts timestamp_ntz"
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    batches = [[(1, at(1)), (1, at(1, 30)), (2, at(2))], [(1, at(9)), (2, at(2, 20))], [(4, at(9, 5))], [(1, at(1, 10)), (2, at(23))], [(3, at(23, 59))]]
    stream = event_files(spark, str(tmp_path / "in"), batches, schema)
    out = changes.run_to_end(changes.sessions(stream, "ts", "1 hour", "10 minutes", ["user_id"]), "sessions_test", "append", at=str(tmp_path / "out"))
    got = sorted((r["user_id"], r["start"].hour, r["n"]) for r in out.collect())
    # the row of 1:10 comes after the mark of 8:50 and is dropped; the last sessions are still open
    assert got == [(1, 1, 2), (1, 9, 1), (2, 2, 2), (4, 9, 1)]


def test_ledger_stream_takes_nulls(spark, tmp_path):
    schema = "ledger long, at long, coins long"
    stream = event_files(spark, str(tmp_path / "in"), [[(1, 1, 30), (1, 2, None), (2, 1, 5)], [(1, 3, 20), (1, 4, 10)]], schema)
    out = changes.run_to_end(changes.ledger_stream(stream), "ledger_test", at=str(tmp_path / "out"))
    got = sorted((r["ledger"], r["at"], r["coins"], r["accepted"], r["total_spent"]) for r in out.collect())
    assert got == [(1, 1, 30, True, 30), (1, 2, None, False, 30), (1, 3, 20, False, 30), (1, 4, 10, True, 40), (2, 1, 5, True, 5)]


def test_contains_pairs(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, ""), (3, None), (4, "zab")], "text_id long, text string")
    needles = spark.createDataFrame([(1, "abc"), (2, "b"), (3, ""), (4, "abcabcd"), (5, None), (6, "ab")], "needle_id long, needle string")
    got = {tuple(r) for r in matching.contains_pairs(texts, needles).collect()}
    assert got == {(1, 1), (1, 2), (1, 6), (4, 2), (4, 6)}


@pytest.mark.parametrize(("name", "words"), [("HTTPServerError2", "HTTP Server Error2"), ("load_user-data", "load user data"), ("", "")])
def test_identifier_words(spark, name, words):
    assert spark.createDataFrame([(name,)], "n string").select(F.array_join(text.identifier_words("n"), " ").alias("w")).first()["w"] == words


def test_micro_and_why(spark):
    rows = spark.createDataFrame([("Loads the user. More.", "x", "function"), ("", "is_ready", "function"), ("", "Foo", "class"), ("", "fetch_the_row", "method"), ("ok", "", "function")], "doc string, name string, kind string")
    assert [r["m"] for r in rows.select(text.micro_label("doc", "name", "kind").alias("m")).collect()] == ["Loads the user", "Checks ready", "Type Foo", "Fetches row", "Core routine"]


def test_globs_and_paths(spark):
    rows = spark.createDataFrame([("a/b.py",), ("a/c.go",), ("x.ts",)], "path string")
    assert [r[0] for r in rows.select(text.glob_match("path", ["*.py", "x.*"])).collect()] == [True, False, True]
    assert [r[0] for r in rows.select(text.language("path")).collect()] == ["python", "go", "typescript"]
    assert [r[0] for r in rows.select(text.module_key("path")).collect()] == ["a", "a", "root"]


def test_theta_contains_reads_texts_once(spark, sf_dir, monkeypatch):
    """The benchmark has fewer characters than a shard holds, so the query makes one automaton."""
    shards = []
    plain = matching._with_automaton
    monkeypatch.setattr(matching, "_with_automaton", lambda texts, shard, schema, kept: shards.append(len(shard)) or plain(texts, shard, schema, kept))
    plans.QUERIES["theta_contains"](spark, sf_dir)
    assert len(shards) == 1
