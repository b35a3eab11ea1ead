"""The history of a symbol's lines from the text of a log that follows them, as column expressions over one row a symbol.

The text has, for each revision, five fields parted by NUL (hash, author, date, subject, body); after the
body comes the patch, and after the patch, without a NUL, the next revision's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Revisions that are kept of a symbol.
REVISIONS = 3
#: Where the prose of a body ends, the head of a hunk, and how a merged request is named.
PATCH = r"(?m)^(?:diff --git |index [0-9a-f]{7,}\.\.|--- |\+\+\+ |@@ )"
HUNK = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
MERGED = r"Merge pull request #(\d+)"


def hunks(patch: Column) -> Column:
    """The hunks of a patch in order: old_start, old_lines, new_start, new_lines (one line where the head names none)."""
    part = lambda k: F.regexp_extract_all(patch, F.lit(HUNK), F.lit(k))
    lines = lambda x: F.when(x == "", 1).otherwise(x.try_cast("long"))
    found = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d"))
    return F.transform(found, lambda h: F.struct(h["a"].try_cast("long").alias("old_start"), lines(h["b"]).alias("old_lines"), h["c"].try_cast("long").alias("new_start"), lines(h["d"]).alias("new_lines")))


def line_before(line: Column, found: Column) -> Column:
    """Where a line stood before a patch: hunks above it shift it, in a hunk it keeps its distance from the top as far as the old lines go."""

    def step(at: Column, h: Column) -> Column:
        above, inside = line >= h["new_start"] + h["new_lines"], line >= h["new_start"]
        shifted = at + h["old_lines"] - h["new_lines"]
        within = h["old_start"] + F.least(line - h["new_start"], F.greatest(h["old_lines"] - 1, F.lit(0)))
        return F.when(above, shifted).when(inside, within).otherwise(at)

    return F.aggregate(found, line.cast("long"), step)


def revisions(logs: DataFrame, most: int = REVISIONS) -> DataFrame:
    """A row for each of the newest ``most`` revisions of a symbol: logs (symbol_name, line_start, line_end, log).

    revision (from 1, the newest), commit_sha, author, date, subject, body (prose without the patch),
    hunks, and the symbol's lines after and before it: line_end is cut at ten lines after line_start, as
    the log follows no more; each revision's lines are mapped through its hunks to the next older one's.
    A text with fewer than five fields, empty or null, has no revision; a last one that is cut off counts
    without its missing fields only if it has all five.
    """
    pieces = F.split("log", "\0", -1)
    count = F.when(F.col("log").isNull(), 0).otherwise(F.floor((F.size(pieces) - 1) / 4)).cast("int")
    last_line = lambda x: F.regexp_extract(x, r"([^\n]*)\n?$", 1)

    def revision(k: Column) -> Column:
        head, tail = F.get("pieces", 4 * k), F.get("pieces", 4 * k + 4)
        body = F.when(k < F.col("count") - 1, F.regexp_replace(tail, r"[^\n]*\n?$", "")).otherwise(tail)
        sha = F.trim(F.when(k == 0, head).otherwise(last_line(head)))
        prose = F.regexp_replace(F.get(F.split(body, PATCH, 2), F.lit(0)), r"^\s+|\s+$", "")
        return F.struct((k + 1).alias("revision"), F.substring(sha, 1, 8).alias("commit_sha"), F.trim(F.get("pieces", 4 * k + 1)).alias("author"), F.trim(F.get("pieces", 4 * k + 2)).alias("date"), F.trim(F.get("pieces", 4 * k + 3)).alias("subject"), prose.alias("body"), hunks(body).alias("hunks"))

    rows = logs.select("symbol_name", "line_start", "line_end", pieces.alias("pieces"), count.alias("count")).where("count > 0")
    each = F.transform(F.sequence(F.lit(0), F.least(F.col("count"), F.lit(most)) - 1), revision)
    first = F.struct(F.col("line_start").cast("long").alias("start"), F.least(F.col("line_end"), F.col("line_start") + 10).cast("long").alias("end"))

    def traced(done: Column, r: Column) -> Column:
        now = F.element_at(done, -1)["before"]
        before = F.struct(line_before(now["start"], r["hunks"]).alias("start"), line_before(now["end"], r["hunks"]).alias("end"))
        return F.concat(done, F.array(F.struct(now.alias("after"), before.alias("before"))))

    begun = F.array(F.struct(first.alias("after"), first.alias("before")))
    rows = rows.withColumn("found", each).withColumn("lines", F.slice(F.aggregate("found", begun, traced), 2, most))
    out = rows.select("symbol_name", F.explode(F.arrays_zip("found", "lines")).alias("x")).select("symbol_name", "x.found.*", "x.lines.*")
    return out.select("symbol_name", "revision", "commit_sha", "author", "date", "subject", "body", "hunks", F.col("after.start").alias("line_start"), F.col("after.end").alias("line_end"), F.col("before.start").alias("start_before"), F.col("before.end").alias("end_before"))


def backstories(found: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """What the newest revision (of ``revisions``) tells of a symbol, as a tier for ``best_history``: ``flags`` (symbol_name, flags) are named in the reason."""
    top = found.where("revision = 1")
    top = top.join(flags.select("symbol_name", "flags"), "symbol_name", "left") if flags is not None else top.withColumn("flags", F.array().cast("array<string>"))
    number = F.regexp_extract(F.concat_ws(" ", "subject", "body"), MERGED, 1)
    why = F.concat(F.lit("Added by "), "author", F.lit(" ("), "subject", F.lit(")."), F.when(F.col("body") != "", F.concat(F.lit(" "), F.substring("body", 1, 150))).otherwise(""), F.when(F.size("flags") > 0, F.concat(F.lit(" Note: Contains "), F.array_join("flags", ", "), F.lit("."))).otherwise(""))
    excerpts = F.when(F.col("body") != "", F.array(F.col("subject"), F.substring("body", 1, 200))).otherwise(F.array("subject"))
    return top.select("symbol_name", F.when(number != "", number).try_cast("long").alias("pr_number"), F.col("subject").alias("pr_title"), "author", "date", "commit_sha", F.concat(F.lit("Commit "), "commit_sha", F.lit(" by "), "author", F.lit(": "), "subject").alias("discussion_summary"), why.alias("why_it_was_written"), F.lit("Tier 2: Local Git History").alias("data_source_tier"), excerpts.alias("raw_discussion_excerpts"))
