"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where none is set (local sessions)."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` whose size Spark knows.

    A plain checkpoint keeps the size that was estimated before, which for a join is the product of both
    sides: a table joined with itself again and again gets a size with twice as many digits each round,
    until the estimate takes longer than the join. That of a filled cache is measured, so rows pass
    through one.
    """
    kept = df.persist()
    kept.count()
    out = kept.select("*").checkpoint()
    kept.unpersist()
    return out
