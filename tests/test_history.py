"""Line histories read from a log's text, odd texts included."""

from graphloom.sources import files, history

PATCH = "diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n@@ -3,2 +3,4 @@\n-a\n+b\n@@ -20 +22 @@\n-c\n+d\n"
SCHEMA = "symbol_name string, line_start int, line_end int, log string"


def entry(k, body="", patch=PATCH):
    return "\0".join([f"{k}" * 40, "Ann", "2024-01-0" + str(k), f"subject {k}", f"{body}\n\n{patch}"])


ROWS = [
    ("two", 5, 40, entry(1, "Why.\n\nMore.") + "\n" + entry(2)),
    ("five", 1, 3, "\n".join(entry(k) for k in range(1, 6))),
    ("merged", 30, 31, entry(1, "Merge pull request #104 from x", "")),
    ("prose", 9, 9, entry(1, "--- is a marker only at the start of a line, so a --- b stays", "")),
    ("none", 1, 2, ""),
    ("null", 1, 2, None),
    ("short", 1, 2, "abc\0Ann\0today"),
]


def found(spark):
    return history.revisions(spark.createDataFrame(ROWS, SCHEMA)).orderBy("symbol_name", "revision").collect()


def test_revisions(spark):
    got = {}
    for r in found(spark):
        got.setdefault(r["symbol_name"], []).append(r)
    assert {n: len(x) for n, x in got.items()} == {"two": 2, "five": 3, "merged": 1, "prose": 1}
    one, two = got["two"]
    assert (one["commit_sha"], one["author"], one["date"], one["subject"], one["body"]) == ("11111111", "Ann", "2024-01-01", "subject 1", "Why.\n\nMore.")
    assert [tuple(h) for h in one["hunks"]] == [(3, 2, 3, 4), (20, 1, 22, 1)] and (two["commit_sha"], two["body"]) == ("22222222", "")
    assert [r["commit_sha"][0] for r in got["five"]] == ["1", "2", "3"]
    assert got["prose"][0]["body"] == "" and got["merged"][0]["hunks"] == []


def test_lines_are_mapped_through_hunks(spark):
    one, two = [r for r in found(spark) if r["symbol_name"] == "two"]
    # ten lines after line 5; line 5 is in the first hunk, whose old side ends at line 4, and line 15 lies two lines further up before it
    assert (one["line_start"], one["line_end"], one["start_before"], one["end_before"]) == (5, 15, 4, 13)
    assert (two["line_start"], two["line_end"], two["start_before"], two["end_before"]) == (4, 13, 4, 11)


def test_backstories_are_a_tier(spark):
    rows = history.revisions(spark.createDataFrame(ROWS, SCHEMA))
    flags = spark.createDataFrame([("two", ["dynamic:eval"])], "symbol_name string, flags array<string>")
    got = {r["symbol_name"]: r for r in history.backstories(rows, flags).collect()}
    assert got["two"]["why_it_was_written"] == "Added by Ann (subject 1). Why.\n\nMore. Note: Contains dynamic:eval."
    assert got["merged"]["pr_number"] == 104 and got["two"]["pr_number"] is None
    assert got["five"]["raw_discussion_excerpts"] == ["subject 1"] and got["two"]["discussion_summary"] == "Commit 11111111 by Ann: subject 1"
    first = spark.createDataFrame([("two", "from a request")], "symbol_name string, pr_title string")
    best = {r["symbol_name"]: r["pr_title"] for r in files.best_history(first, history.backstories(rows)).collect()}
    assert best["two"] == "from a request" and best["five"] == "subject 1"
