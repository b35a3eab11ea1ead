"""Streams: the newest version of each file, incremental deltas, windows, ledgers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from graphloom.functions import fixed
from graphloom.operators.delta import delta, latest
from graphloom.sources.files import point, pointer, read_cache, ship, write_cache
from graphloom.sources.shared import ensure_checkpoint_dir


def file_stream(spark: SparkSession, at: str, schema: str, fmt: str = "parquet", per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(at)


#: Buckets of an index: a batch rewrites those that its keys fall into.
BUCKETS = 64
_BUCKET = "__bucket"


def index_stream(versions: DataFrame, at: str, checkpoint: str, schema: str, key: str = "path", order: str = "mtime", by: tuple[str, ...] = ("hash",), seen: Callable[[DataFrame, int], None] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the newest row of each key in the index at ``at`` (read it with ``read_index``).

    The index is a folder for each bucket of keys and one small file that says which folder is a
    bucket's present one. A batch reads and writes only the buckets that its keys fall into, and is
    there for readers when that file is replaced; one that runs again after a failure gives the same
    index. ``seen`` gets the delta (id, status) of the buckets that each batch touched. Of equal
    places in ``order`` the greatest row stays; a null key is a key.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
        fresh = latest(batch, key, order).withColumn(_BUCKET, bucket).persist()
        touched = sorted(r[0] for r in fresh.select(_BUCKET).distinct().collect())  # at most as many as there are buckets
        if touched:
            places = index_places(spark, at)
            held = [places[b] for b in touched if b in places]
            old = spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)
            both = latest(old.unionByName(fresh.drop(_BUCKET)), key, order).withColumn(_BUCKET, bucket)
            folder = f"{at}/v-{uuid.uuid4().hex}"
            both.repartition(len(touched), _BUCKET).write.partitionBy(_BUCKET).parquet(folder)
            if seen is not None:
                new = spark.read.schema(schema).parquet(*[f"{folder}/{_BUCKET}={b}" for b in touched])
                named = lambda d: d.withColumnRenamed(key, "id")
                seen(delta(named(old), named(new), by), number)
            places |= {b: f"{folder}/{_BUCKET}={b}" for b in touched}
            point(spark, at, "\n".join(f"{b}\t{places[b]}" for b in sorted(places)))
        fresh.unpersist()

    return versions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_places(spark: SparkSession, at: str) -> dict[int, str]:
    """The present folder of each bucket of an index; none where there is no index."""
    try:
        lines = pointer(spark, at).splitlines()
    except (AnalysisException, FileNotFoundError):
        return {}
    return {int(b): place for b, place in (x.split("\t") for x in lines)}


def read_index(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """The newest row of each key."""
    places = index_places(spark, at)
    return spark.read.schema(schema).parquet(*places.values()) if places else spark.createDataFrame([], schema)


def windowed(events: DataFrame, time: str, length: str, slide: str | None, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums by tumbling or sliding window and keys, rows later than ``late`` dropped."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return stamped.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Sessions of each key, ended by a pause of ``gap``."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def ledger_stream(txns: DataFrame, cap: int = fixed.LEDGER_CAP) -> DataFrame:
    """(ledger, at, coins, accepted, total_spent) for each transaction, the sum of each ledger held as state.

    As in ``ledger.settle``: a null amount is refused, and goes first of those at one place.
    """
    ship(txns.sparkSession)
    columns = ["ledger", "at", "coins", "accepted", "total_spent"]

    def settle(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts))
        rows = rows.assign(at=rows["at"].astype("Int64"), coins=rows["coins"].astype("Int64")).sort_values(["at", "coins"], na_position="first")
        out = []
        for at, coins in zip(rows["at"], rows["coins"], strict=True):
            at, coins = (None if pd.isna(x) else int(x) for x in (at, coins))
            ok = coins is not None and spent + coins <= cap
            spent += coins if ok else 0
            out.append((key[0], at, coins, ok, spent))
        state.update((spent,))
        yield pd.DataFrame(out, columns=columns).astype({"at": "Int64", "coins": "Int64"})

    return txns.groupBy("ledger").applyInPandasWithState(settle, "ledger long, at long, coins long, accepted boolean, total_spent long", "spent long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, at: str | None = None) -> DataFrame:
    """The stream's output over what is there now, written to files at ``at`` (a new folder below the shared one by default).

    In append mode the files grow by each batch's rows; in complete mode a batch replaces the table
    before. Either is whole after a batch that failed and ran again.
    """
    spark = stream.sparkSession
    base = at or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    out, schema = f"{base}/out", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    writer = stream.writeStream.queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{base}/state")
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        try:
            return spark.read.schema(schema).parquet(out)
        except AnalysisException:  # no batch, no folder
            return spark.createDataFrame([], schema)
    writer.foreachBatch(lambda batch, _: write_cache(batch, out, 1)).start().awaitTermination()
    return read_cache(spark, out, schema, 1)
