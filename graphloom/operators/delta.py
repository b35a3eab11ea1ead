"""Snapshots, their differences, and what is kept by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(symbols: DataFrame) -> DataFrame:
    return symbols.select("id", "hash", "deps_hash", F.col("file_path").alias("file"), "kind", "name", "qualified", "is_test")


def delta(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ("hash", "deps_hash")) -> DataFrame:
    """id and status (added, changed, removed, unchanged): a full outer join on id, null-safe on the hashes."""
    a = old.select("id", F.lit(True).alias("was"), *[F.col(c).alias(f"old_{c}") for c in by])
    b = new.select("id", F.lit(True).alias("is"), *[F.col(c).alias(f"new_{c}") for c in by])
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, "id", "full_outer").select("id", status.alias("status"))


def delta_counts(changes: DataFrame) -> DataFrame:
    """One row: added, changed, removed, unchanged."""
    return changes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "changed", "removed", "unchanged")])


def kept(entries: DataFrame, valid: DataFrame) -> DataFrame:
    """Entries whose id is still there."""
    return entries.join(valid.select("id"), "id", "left_semi")


def stale(entries: DataFrame, valid: DataFrame) -> DataFrame:
    return entries.join(valid.select("id"), "id", "left_anti")


def current(symbols: DataFrame, entries: DataFrame) -> DataFrame:
    """Symbols with the insight stored for their present key (id, key), null where there is none."""
    return symbols.join(entries, ["id", "key"], "left")


def source_histogram(entries: DataFrame, by: str = "source") -> DataFrame:
    return entries.groupBy(by).agg(F.count("*").alias("n"))


def latest(versions: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, "v.*")


def reconcile(found: DataFrame, static: DataFrame) -> DataFrame:
    """Edges seen at run time that the static graph lacks."""
    return found.select("src", "dst").distinct().join(static, ["src", "dst"], "left_anti")
