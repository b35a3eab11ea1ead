"""The pipeline and the queries over the smallest tables, against plain versions and SQL."""

import re

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from graphloom.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, oracle, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), oracle.execute(SQL[name]).df()
    columns = sorted(got.columns)
    rows = lambda f: sorted(map(tuple, f[columns].astype(str).values.tolist()))
    assert columns == sorted(want.columns) and rows(got) == rows(want)


def test_all_ten_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline_takes_each_decision(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    toxic = {r["doc_id"] for r in QUERIES["op10_toxicity"](spark, sf_dir).where("predicted = 1").collect()}
    leaks = {r["doc_id"] for r in QUERIES["op1_decontamination"](spark, sf_dir).collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r["doc_id"] for r in got}
    assert len(got) == len(kept) and kept <= left - toxic - leaks
    # of what toxicity leaves, each class of equal or similar texts keeps one row unless it leaks
    clean = docs.where(~docs.doc_id.isin(list(toxic)))
    from graphloom.llm.exact_dedup import exact_duplicates

    first = {r["doc_id"] for r in exact_duplicates(clean).where("kept").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in clean.collect() if r["doc_id"] in first}
    near = first_of_similar(texts)
    assert len(near) < len(first) and kept == near - leaks


def first_of_similar(texts):
    """The smallest doc_id of each class of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = {}
    for d, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = sets[a] | sets[b]
            if not both or len(sets[a] & sets[b]) / len(both) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(d) for d in ids}


@pytest.mark.parametrize("stage", range(4))
def test_stages_with_odd_tables(spark, stage):
    """String ids, nulls, empty and very long texts, repeated rows, extra columns with clashing names, and no rows."""
    long = " ".join(f"w{k * 7919 % 4001}" for k in range(40_000))
    rows = [("a", "plain words of a text that stands alone here", 1, "x"), ("a", "plain words of a text that stands alone here", 1, "x"), ("b", None, 2, None), (None, "", 3, "y"), (None, None, None, None), ("c", long, 4, "z"), ("d", " \t\n", 5, "q")]
    schema = "doc_id string, text string, __row long, _metadata string"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 as copies", "'n' as node", "2 as row", "'d' as digest", "0 as score", "'i' as item_id")
    import tempfile

    with tempfile.TemporaryDirectory() as at:
        spark.createDataFrame([("zz", 1, 1)], "doc_id string, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([("i", "an item of the benchmark that nobody has")], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
        name, run = corpus_pipeline.STAGES[stage]
        got = run(spark, docs, at)
        left = {"toxicity": 7, "exact_dedup": 3, "simhash_dedup": 3, "decontamination": 7}[name]
        assert got.columns == docs.columns and got.count() == left
        assert run(spark, docs.limit(0), at).count() == 0


def test_stage_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
