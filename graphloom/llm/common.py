"""What the operators of this subpackage share: the shared folder, code shipping and cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver's working folder is."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is missing (a local session, as in tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(at)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: lineage ends here.

    Lost executors cost only the unfinished tasks of the write; later stages read the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` dealt out by ``key`` to a table in the shared folder with a bucket for each shuffle partition.

    Joins and aggregations by the key read the buckets as they are: only what they are joined with moves.
    """
    spark = df.sparkSession
    unique, buckets = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_dir(spark)}/{unique}").option("compression", "zstd").saveAsTable(unique)
    swept(spark)  # the shuffle's files are not needed any more
    return spark.table(unique)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for at in roots:
        path = jvm.org.apache.hadoop.fs.Path(at)
        if path.toString().startswith(shared_dir(spark)) or path.toUri().getPath().startswith(shared_dir(spark).removeprefix("file://")):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Have the driver forget what nothing refers to any more, so that shuffle files that are done with go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: The name of the column that names rows: one that no table has by chance.
ROW = "__row_of_8f3a61c2d94e"


def with_row(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of ``df`` (all by default) with ROW, which names each row, the same at every reading.

    A frame read straight from Parquet files has file and row number as metadata; any other frame is
    stored once, numbered.
    """
    columns = columns or ("*",)
    try:
        of = df.metadataColumn("_metadata")
        return df.select(*columns, F.struct(of["file_path"].alias("file"), of["row_index"].alias("at")).alias(ROW))
    except AnalysisException:
        number = F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at"))
        return stored(df.select(*columns).withColumn(ROW, number), "numbered")


def only(df: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``df`` (made by ``with_row``) whose ROW is in ``kept``, without it."""
    by = [df[ROW]["file"] == kept[ROW]["file"], df[ROW]["at"] == kept[ROW]["at"]]
    return df.join(kept, by, "left_semi").drop(ROW)


#: Keys that are broadcast at most, because each has a large part of all rows; rows of a key under which none is hot.
HOT_KEYS, HOT_LEAST = 4_096, 64


def joined_evenly(rows: DataFrame, by_key: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with ``by_key``, which has one row a key and the number of rows with it in ``size``.

    Keys with more than a HOT_KEYS-th of ``total`` rows, of which there are fewer than HOT_KEYS, are
    broadcast, and their rows stay where they are. Only rows of other keys are dealt out by key, so
    no task gets the rows of a hot key, whatever its share.
    """
    hot = F.col(size) > max(HOT_LEAST, -(-total // HOT_KEYS))
    few = F.broadcast(by_key.where(hot))
    usual = rows.join(F.broadcast(by_key.where(hot).select(*keys)), keys, "left_anti").join(by_key.where(~hot), keys)
    return rows.join(few, keys).unionByName(usual)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, null text as the empty text."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
