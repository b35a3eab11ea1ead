"""A spending ledger with a cap, and locks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import fixed
from graphloom.functions.text import policy_hit
from graphloom.sources.files import ship
from graphloom.sources.shared import ensure_checkpoint_dir

#: Transactions in a partition at most (about).
MOST_ROWS = 1_000_000
_INTERVALS = pa.list_(pa.struct([("high", pa.int64()), ("adds", pa.int64()), ("accepts", pa.int64())]))


def policy(requests: DataFrame) -> DataFrame:
    """Requests (prompt, purpose) with the phrase that refuses them, and whether they may go on."""
    return requests.withColumn("phrase", policy_hit("prompt", "purpose")).withColumn("approved", F.col("phrase").isNull())


def running(txns: DataFrame, keys: list[str], order: list[str], amount: str = "coins") -> DataFrame:
    """Plain running total."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return txns.withColumn("total", F.sum(amount).over(w))


class Block:
    """What a block of transactions does to any amount spent before it: for each interval of amounts what it adds and how many it accepts.

    Intervals are (low, high] side by side, the last one up to the cap; one transaction splits at most
    one amount off each, so there are no more of them than amounts from the lowest to the cap, nor
    many more than transactions.
    """

    def __init__(self, cap: int, low: int):
        self.cap, self.parts = cap, [(low - 1, cap, 0, 0)]

    def add(self, coins: int | None) -> None:
        if coins is None or not self.parts or coins > self.cap - min(a + 1 + d for a, _, d, _ in self.parts):
            return
        out: list[tuple[int, int, int, int]] = []
        for a, b, d, n in self.parts:
            most = self.cap - coins - d  # up to this much spent, it is accepted
            for part in ((a, min(b, most), d + coins, n + 1), (max(a, most), b, d, n)):
                if part[0] < part[1]:
                    if out and out[-1][2:] == part[2:]:
                        out[-1] = (out[-1][0], *part[1:])
                    else:
                        out.append(part)
        self.parts = out


def settle(txns: DataFrame, key: str, order: str, cap: int = fixed.LEDGER_CAP, amount: str = "coins", rows_each: int = 20_000) -> DataFrame:
    """key, order, coins, accepted, total_spent, coins_remaining, tx_id.

    In order, a transaction that would pass the cap is refused and spends nothing, so a smaller one
    may follow. Transactions at equal places go by amount; a null amount is refused; a negative one is
    accepted and gives back; a null key is a ledger.

    Transactions are range-sorted into partitions, so that a ledger with any share of them is in many.
    Where a ledger goes on from one partition to the next, the first pass reduces the part that began
    before to a ``Block``; the driver takes these one after the other, one a partition, and so knows
    with which amount each partition begins. The second pass reads every partition in order with two
    running numbers.
    """
    spark = txns.sparkSession
    ship(spark)
    ensure_checkpoint_dir(spark)
    rows = txns.select(F.col(key), F.col(order), F.col(amount).cast("long").alias("coins"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.least("coins", F.lit(0))), F.lit(0)).alias("low")).first()
    low = min(0, size["low"])
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // rows_each)), -(-size["n"] // MOST_ROWS))
    # the row's number splits transactions that are repeated so often that they fill partitions
    by = [F.col(c).asc_nulls_first() for c in (key, order, "coins", "__tie")]
    placed = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = placed.drop("__tie").withColumn("__pid", F.spark_partition_id()).checkpoint()
    kind = rows.schema[key].dataType.simpleString()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen, first, now, spent, n, pid, kind_of = Block(cap, low), False, None, None, 0, 0, 0, None
        for batch in batches:
            pid, kind_of = batch.column("__pid")[0].as_py() if batch.num_rows else pid, batch.schema.field(key).type
            for own, coins in zip(batch.column(key).to_pylist(), batch.column("coins").to_pylist(), strict=True):
                if not seen:
                    seen, first, now = True, own, own
                if own != now:
                    now, spent, n = own, 0, 0
                if now == first:
                    block.add(coins)
                elif coins is not None and spent + coins <= cap:
                    spent, n = spent + coins, n + 1
        if seen:
            intervals = [{"high": b, "adds": d, "accepts": c} for _, b, d, c in block.parts]
            columns = [pa.array([pid], pa.int32()), pa.array([first], kind_of), pa.array([now], kind_of), pa.array([intervals], _INTERVALS), pa.array([spent], pa.int64()), pa.array([n], pa.int64())]
            yield pa.record_batch(columns, names=["pid", "first", "last", "intervals", "spent", "n"])

    blocks = placed.select("__pid", key, "coins").mapInArrow(reduce, f"pid int, first {kind}, last {kind}, intervals array<struct<high:long,adds:long,accepts:long>>, spent long, n long")
    starts: dict[int, tuple[int, int]] = {}
    last, state = object(), (0, 0)
    for r in blocks.orderBy("pid").toLocalIterator():  # one row a partition
        starts[r["pid"]] = state if r["first"] == last else (0, 0)
        spent, n = starts[r["pid"]]
        if r["last"] == r["first"]:
            part = next(x for x in r["intervals"] if spent <= x["high"])
            state = (spent + part["adds"], n + part["accepts"])
        else:
            state = (r["spent"], r["n"])
        last = r["last"]
    begun = {pid: s for pid, s in starts.items() if s != (0, 0)}
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spent, n, fresh = None, 0, 0, True
        for batch in batches:
            out: list[tuple[bool, int, str | None]] = []
            if fresh and batch.num_rows:
                now, fresh = batch.column(key)[0].as_py(), False
                spent, n = begun.get(batch.column("__pid")[0].as_py(), (0, 0))
            for own, coins in zip(batch.column(key).to_pylist(), batch.column("coins").to_pylist(), strict=True):
                if own != now:
                    now, spent, n = own, 0, 0
                ok = coins is not None and spent + coins <= cap
                if ok:
                    spent, n = spent + coins, n + 1
                out.append((ok, spent, f"tx_{n:04d}" if ok else None))
            more = [pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.int64()), pa.array([max(0, cap - o[1]) for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())]
            yield pa.record_batch([*batch.columns[:3], *more], names=[*batch.schema.names[:3], "accepted", "total_spent", "coins_remaining", "tx_id"])

    return placed.mapInArrow(run, ", ".join([*kinds, "accepted boolean, total_spent long, coins_remaining long, tx_id string"]))


def totals(txns: DataFrame, cap: int = fixed.LEDGER_CAP) -> DataFrame:
    spent = F.coalesce(F.sum("coins"), F.lit(0)).cast("long")
    return txns.agg(spent.alias("coins_spent"), F.greatest(F.lit(0), F.lit(cap) - spent).cast("long").alias("coins_remaining"), F.count("*").alias("transactions"))


def lock_conflicts(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Requests (agent, symbol, intent) with the number of locks (agent, symbol, intent) of others in their way, and whether all of an agent's are free.

    Readers share; any other pair conflicts. An agent gets all its symbols or none.
    """
    # counts instead of pairs: all locks on the symbol less the agent's own, of writers or of any
    counts = lambda d, *by: d.groupBy(*by).agg(F.count("*").alias("locks"), F.count_if(F.col("intent") != "READ").alias("writes"))
    known = held.where("agent is not null and symbol is not null")
    every = counts(known, "symbol")
    own = counts(known, "symbol", "agent").withColumnsRenamed({"locks": "own_locks", "writes": "own_writes"})
    rows = requests.select("agent", "symbol", "intent").distinct().join(every, "symbol", "left").join(own, ["symbol", "agent"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    conflicts = F.when(F.col("intent") == "READ", zero("writes") - zero("own_writes")).otherwise(zero("locks") - zero("own_locks"))
    per = rows.select("agent", "symbol", "intent", conflicts.alias("conflicts"))
    return per.withColumn("granted", F.max("conflicts").over(Window.partitionBy("agent")) == 0)


def deadlocked(waits: DataFrame) -> DataFrame:
    """Agents that wait, directly or through others, for themselves: waits (agent, holder)."""
    from graphloom.operators.graph import components

    return components(waits.select(F.col("agent").alias("src"), F.col("holder").alias("dst"))).select(F.col("id").alias("agent"))
