"""Ordered text lines: exploding, carrying forward, looking ahead, runs and call sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import fixed
from graphloom.functions.text import outbound_calls, text_complexity, unusual_logic

#: Line ends as Python's splitlines has them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def explode_lines(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """key, line_no (from 1), line. A text's last empty piece is no line."""
    pieces = F.split(text, LINE_END, -1)
    kept = F.when(F.get(pieces, F.size(pieces) - 1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return files.select(key, F.posexplode(kept).alias("k", "line")).select(key, (F.col("k") + 1).alias("line_no"), "line")


def line_count(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit("\n")) + 1


def carry_forward(rows: DataFrame, value: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The last non-null value up to and including each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def look_ahead(rows: DataFrame, value: Column, keys: list[str], order: list[str], most: int, name: str) -> DataFrame:
    """The first non-null value in the next ``most`` rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, most)
    return rows.withColumn(name, F.first(value, ignorenulls=True).over(w))


def islands(rows: DataFrame, breaks: Column, keys: list[str], order: list[str], name: str = "island") -> DataFrame:
    """Numbers runs of rows: a new one begins at each row where ``breaks`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w).cast("long"))


def leading_docs(lines: DataFrame, starts: DataFrame, most: int = 400) -> DataFrame:
    """The comment block right above each start (path, line_no): path, line_no, doc.

    A run of comment lines ends at the first line that is none; its text is joined, freed of the
    first and last comment signs, and cut at ``most`` characters.
    """
    comment = F.trim("line").rlike(r"^(//|\*|/\*|#)")
    marked = islands(lines.withColumn("is_doc", comment), ~F.col("is_doc"), ["path"], ["line_no"])
    block = marked.where("is_doc").groupBy("path", "island").agg(F.max("line_no").alias("last"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("t")))), lambda s: s["t"]).alias("parts"))
    text = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.array_join("parts", " "), r"^(//|/\*|\*+|#)\s*", "")), r"\*/\s*$", ""))
    return starts.join(block.select("path", (F.col("last") + 1).alias("line_no"), F.substring(text, 1, most).alias("doc")), ["path", "line_no"])


def enclosing(lines: DataFrame) -> DataFrame:
    """Each line with the last definition or class at or above it."""
    d = F.regexp_extract("line", r"^\s*(?:async\s+)?(?:def|function|func)\s+([a-zA-Z_]\w*)", 1)
    c = F.regexp_extract("line", r"^\s*class\s+([a-zA-Z_]\w*)", 1)
    here = F.when(d != "", d).when(c != "", F.concat(F.lit("class "), c))
    return carry_forward(lines, here, ["path"], ["line_no"], "enclosing_symbol").withColumn("enclosing_symbol", F.coalesce("enclosing_symbol", F.lit("module_level")))


def call_sites(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Lines that call a wanted name: name, path, line_no, enclosing_symbol, snippet, arguments.

    Called names are taken out of each line and joined by equality. ``names`` has name and
    definition_file; the lines there that define the name are no call sites. Of several calls of a
    name in a line the first counts.
    """
    found = enclosing(lines).select("path", "line_no", "line", "enclosing_symbol", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_]\w*)\s*\([^)]*\)"), F.lit(1)))).alias("name"))
    rows = found.join(names, "name")
    defines = F.exists(F.transform(F.array(*[F.lit(f"{w} ") for w in ("def", "function", "func", "class", "const", "let", "var")]), lambda w: F.concat(w, F.col("name"))), lambda d: F.contains(F.col("line"), d))
    rows = rows.where(~((F.col("path") == F.col("definition_file")) & defines))
    args = F.expr(r"regexp_extract(line, concat('\\b', name, '\\s*\\(([^)]*)\\)'), 1)")
    return rows.select("name", "path", "line_no", "enclosing_symbol", F.trim("line").alias("snippet"), F.filter(F.transform(F.split(args, ","), lambda x: F.trim(x)), lambda a: a != "").alias("arguments"))


def source_slice(content: Column | str, start: Column | str, end: Column | str, pad: int = 0, most: int = 120) -> Column:
    """Lines start - pad to end + pad, at most ``most``."""
    pieces = F.split(content, LINE_END, -1)
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    first = F.greatest(F.lit(1), s - pad)
    n = F.greatest(F.lit(0), F.least(F.lit(most), e + pad - first + 1))
    return F.array_join(F.slice(pieces, first, n), "\n")


def text_functions(lines: DataFrame, most: int = fixed.DEFINITION_LINES) -> DataFrame:
    """Functions found by their first line: name, path, line_start, line_end, code (``most`` lines at most).

    ``lines`` has language; JavaScript counts as TypeScript. The code is the next lines of the file, as
    far as there are any.
    """
    lang = F.when(F.col("language") == "javascript", "typescript").otherwise(F.col("language"))
    name = F.lit("")
    for k, pattern in fixed.TEXT_FUNCTION.items():
        name = F.when(lang == k, F.regexp_extract("line", pattern, 1)).otherwise(name)
    starts = lines.withColumn("name", name).where("name <> ''").select("path", "name", F.col("line_no").alias("line_start"))
    # a start asks for its lines by number, so only lines of functions come together
    wanted = starts.withColumn("line_no", F.explode(F.sequence("line_start", F.col("line_start") + (most - 1))))
    code = wanted.join(lines.select("path", "line_no", "line"), ["path", "line_no"]).groupBy("path", "line_start", "name").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("block"))
    return code.select("name", "path", "line_start", F.element_at("block", -1)["line_no"].alias("line_end"), F.array_join(F.transform("block", lambda x: x["line"]), "\n").alias("code"))


def cross_references(lines: DataFrame, least: int = 4) -> DataFrame:
    """Complex or unusual functions with their call sites, best first by score; of equal names the best stays.

    score is three for each other file that calls it, plus complexity up to twenty, plus two for
    unusual logic.
    """
    found = text_functions(lines).where(~F.col("name").rlike(r"^__.*__$"))
    known = found.withColumn("complexity", text_complexity("code")).withColumn("logic", unusual_logic("code")).where((F.col("complexity") >= least) | (F.size("logic") > 0))
    sites = call_sites(lines, known.select("name", F.col("path").alias("definition_file")).distinct())
    per = sites.join(known.select("name", F.col("path").alias("definition_file"), "line_start"), "name").groupBy("name", "definition_file", "line_start").agg(F.count("*").alias("occurrences"), F.count_distinct(F.when(F.col("path") != F.col("definition_file"), F.col("path"))).alias("fan_in_files"))
    rows = known.withColumnRenamed("path", "definition_file").join(per, ["name", "definition_file", "line_start"], "left").fillna({"occurrences": 0, "fan_in_files": 0})
    score = F.col("fan_in_files") * fixed.FAN_IN_WEIGHT + F.least("complexity", F.lit(fixed.MOST_COMPLEXITY)) + F.when(F.size("logic") > 0, fixed.UNUSUAL_BONUS).otherwise(0)
    best = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), F.desc("fan_in_files"), "definition_file", "line_start"))
    scored = rows.withColumn("score", score).withColumn("k", best).where("k = 1").drop("k")
    return scored.withColumn("outbound", outbound_calls("code"))
