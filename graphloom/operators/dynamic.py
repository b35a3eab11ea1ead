"""Dynamic invocation patterns: the first pattern of each family in a line, and what Python's parser sees."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import fixed
from graphloom.functions.text import python_regex
from graphloom.operators.extract import parsed
from graphloom.sources.files import ship

FINDING = "pattern_type string, file_path string, line_number int, symbol_id string, confidence double, description string"


def first_match(line: Column | str, family: str, unicode: bool = True) -> Column:
    """(description, confidence) of the family's first pattern in the line, null without one.

    One conditional expression a family: the patterns are tried in order inside generated code, with
    no join of lines and patterns.
    """
    c = F.col(line) if isinstance(line, str) else line
    rx = python_regex if unicode else (lambda p: p)
    out = F.lit(None).cast("struct<description:string,confidence:double>")
    for name, pattern, text, confidence in reversed(fixed.DYNAMIC_PATTERNS):
        if name == family:
            out = F.when(c.rlike(rx(pattern)), F.struct(F.lit(text).alias("description"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def line_findings(lines: DataFrame, families: tuple[str, ...] = fixed.FAMILIES, unicode: bool = True) -> DataFrame:
    """Findings in lines (path, line_no, line) that don't begin as comments."""
    code = lines.where(~F.trim("line").rlike(r"^(//|#|/\*|\*)"))
    found = F.array(*[F.struct(F.lit(f).alias("pattern_type"), first_match("line", f, unicode).alias("hit")) for f in fixed.FAMILIES if f in families])
    rows = code.select("path", "line_no", F.explode(F.filter(found, lambda x: x["hit"].isNotNull())).alias("x"))
    return rows.select("x.pattern_type", F.col("path").alias("file_path"), F.col("line_no").cast("int").alias("line_number"), F.col("path").alias("symbol_id"), "x.hit.confidence", "x.hit.description")


def parsed_findings(path: str, source: str, wanted: str | None = None) -> list[dict]:
    """Findings in Python's syntax tree, each with the dotted name of where it stands, outer ones first; however deep the tree is."""
    tree = parsed(source)
    if tree is None:
        return []
    out: list[dict] = []
    waiting: list[tuple[ast.AST, str]] = [(tree, path.replace("/", ".").removesuffix(".py"))]
    while waiting:
        node, own = waiting.pop()
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            own = f"{own}.{node.name}"
        hit = None
        if isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            hit = fixed.DYNAMIC_CALLS.get(name)
        elif isinstance(node, ast.Subscript) and isinstance(node.value, ast.Attribute) and node.value.attr == "environ":
            hit = fixed.DYNAMIC_ENVIRON
        if hit and (wanted is None or wanted.startswith(own)):
            family, confidence, text = hit
            out.append({"pattern_type": family, "file_path": path, "line_number": node.lineno, "symbol_id": own, "confidence": confidence, "description": text})
        waiting += [(child, own) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


def detect(files: DataFrame, lines: DataFrame, families: tuple[str, ...] | None = None, symbol_id: str | None = None) -> DataFrame:
    """Findings of files (path, content) and their lines: parsed ones first, one for each family and line."""
    ship(files.sparkSession)
    chosen = tuple(f for f in (families or fixed.FAMILIES) if f in fixed.FAMILIES)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r | {"prio": k} for p, c in zip(part["path"], part["content"], strict=True) for k, r in enumerate(parsed_findings(p, c or "", symbol_id))]
            yield pd.DataFrame(rows, columns=["pattern_type", "file_path", "line_number", "symbol_id", "confidence", "description", "prio"]).astype({"line_number": "int32", "prio": "int32"})

    parsed = files.where(F.lower("path").endswith(".py")).select("path", "content").mapInPandas(run, FINDING + ", prio int")
    scanned = line_findings(lines, chosen).withColumn("prio", F.lit(1 << 30))
    if symbol_id is not None:
        scanned = scanned.withColumn("symbol_id", F.lit(symbol_id))
    both = parsed.where(F.col("pattern_type").isin(*chosen)).unionByName(scanned)
    first = F.row_number().over(Window.partitionBy("file_path", "pattern_type", "line_number").orderBy("prio"))
    return both.withColumn("k", first).where("k = 1").drop("k", "prio")
