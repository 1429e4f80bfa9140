"""Partitioning: round-robin, strided (rank = id mod n), partition 0 only,
per-partition counts, a global row index, seeded mini-batches and keyed
permutations of row numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.session import checkpoint_root, shared_dir


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def repartition_n(df: DataFrame, n: int) -> DataFrame:
    """Round-robin into exactly ``n`` partitions."""
    return df.repartition(n)


def strided(df: DataFrame, n: int, id_col, spread: int = 1) -> DataFrame:
    """Row with id ``i`` goes to rank ``i mod n`` (the ``i += size`` loop).

    With ``spread = k`` there are ``n * k`` partitions and partition ``p``
    holds the ids with ``i mod (n * k) == p``, so rank ``r`` owns partitions
    ``r, r + n, r + 2n, ...`` (``rank_of_partition``): the split stays exact
    while no single task has to hold a whole rank's rows."""
    parts = n * max(1, spread)
    return df.repartitionById(parts, F.pmod(_c(id_col), F.lit(parts)).cast("int"))


def rank_of_partition(n: int):
    """The rank (0..n-1) of the current partition of a ``strided`` frame."""
    return (F.spark_partition_id() % F.lit(n)).cast("int")


def rank_of(id_col, n: int) -> Column:
    """The rank (0..n-1) of a row in the strided split, from its id: what a
    rank would hold can be filtered or grouped without moving rows."""
    return F.pmod(_c(id_col), F.lit(n)).cast("int")


def rank_rows(df: DataFrame, n: int, id_col, rank: int) -> DataFrame:
    """The rows of one rank of the strided split, filtered at the scan."""
    return df.filter(rank_of(id_col, n) == rank)


def partition_zero(df: DataFrame) -> DataFrame:
    """Rows of partition 0 only."""
    return df.filter(F.spark_partition_id() == 0)


def partition_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition_id")).agg(
        F.count(F.lit(1)).alias("n_rows"))


def global_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Append a 0-based index in the frame's current order, without a
    single-partition window: the frame is checkpointed (shared folder, so it
    survives lost executors and both passes see the same rows), partition
    sizes are counted (one small row per partition), and each partition
    numbers its rows from its offset as a stream."""
    checkpoint_root(df.sparkSession)
    fixed = df.checkpoint(eager=True)
    counts = dict(partition_counts(fixed).collect())
    offsets, acc = {}, 0
    for pid in sorted(counts):
        offsets[pid] = acc
        acc += counts[pid]
    schema = StructType(fixed.schema.fields + [StructField(name, LongType(), False)])
    bc = df.sparkSession.sparkContext.broadcast(offsets)

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        start = bc.value.get(pid, 0)
        for b in batches:          # other columns pass through as Arrow, untouched
            yield b.append_column(name, pa.array(np.arange(start, start + b.num_rows, dtype=np.int64)))
            start += b.num_rows

    return fixed.mapInArrow(number, schema)


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows by ``order``, as their own small table.

    Planned alone, ``orderBy().limit(k)`` is a top-k per partition and a merge
    of those (``TakeOrderedAndProject``); with a Python UDF stacked on top,
    Catalyst instead range-shuffles and sorts every row.  So the top-k is
    written out first (reliable checkpoint, k rows) and later operators start
    from it."""
    checkpoint_root(df.sparkSession)
    return df.orderBy(*order).limit(k).checkpoint(eager=True)


def minibatches(df: DataFrame, batch_size: int = 100, seed: int = 0) -> DataFrame:
    """Seeded random order, then consecutive batches of ``batch_size``:
    ``batch_id = position div batch_size``.  The rows are written and numbered
    once; the order is a keyed permutation of the numbers, so nothing is
    sorted."""
    path = shared_dir(df.sparkSession, "minibatches")
    size, starts = write_numbered(df, path)
    rows = read_numbered(df.sparkSession, path, starts).withColumn("position", permuted("position", size, seed))
    return rows.withColumn("batch_id", F.floor(F.col("position") / F.lit(batch_size)).cast("bigint"))


# A permutation of 0..n-1 by a Feistel network: fixed values, the SQL uses them too.
PRIME, MULTIPLIER, ROUND_STEP, ROUNDS = 2_147_483_647, 48_271, 16_807, 6
SEED_STEP, EPOCH_STEP = 1_000_003, 7_919
WALKS = 256


def permuted(position, size: int, seed: int = 0, epoch=0) -> Column:
    """Where a row of number ``position`` (0..size-1) stands in the random order
    of (seed, epoch): a permutation computed from the number alone, so no order
    is ever sorted or stored.

    Numbers are pairs (l, r) with l < a and r < b, a * b the first such product
    from ``size`` on with a about sqrt(size); six rounds add a function of one
    half to the other.  A result of ``size`` or more (there are fewer than a of
    them) is put through again until it falls inside."""
    a = math.isqrt(max(size, 1) - 1) + 1
    b = -(-max(size, 1) // a)
    key = (F.lit(seed * SEED_STEP).cast("long") + (_c(epoch) if isinstance(epoch, (str, Column)) else F.lit(epoch)).cast(
        "long") * EPOCH_STEP) % PRIME

    def mixed(v: Column, i: Column) -> Column:
        t = (v * MULTIPLIER + key + i * ROUND_STEP) % PRIME
        return (t * t + v) % PRIME

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
        step = lambda s, i: F.when(i % 2 == 0, F.struct(
            ((s["l"] + mixed(s["r"], i)) % a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(
                s["l"].alias("l"), ((s["r"] + mixed(s["l"], i)) % b).alias("r")))
        return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), start, step,
                           lambda s: s["l"] * b + s["r"])
    n = F.lit(size).cast("long")
    again = lambda v: F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), v, lambda x, _: F.when(x < n, x).otherwise(once(x)),
        lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit(f"no place found in {WALKS} walks")).cast("long")))
    first = F.array(once(_c(position).cast("long")))
    return F.get(F.transform(first, lambda v: F.when(v < n, v).otherwise(again(v))), 0)


def write_numbered(df: DataFrame, path: str, name: str = "position") -> tuple[int, list[tuple[int, int]]]:
    """Write ``df`` once, with what numbers its rows, and return its size and
    the first number of each written partition (one small row each)."""
    df.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    counts = (df.sparkSession.read.parquet(path).groupBy(F.shiftright(name, 33).alias("p"))
              .agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect())
    starts, at = [], 0
    for r in counts:
        starts.append((r.p, at))
        at += r.n
    return at, starts


def read_numbered(spark, path: str, starts: list[tuple[int, int]], name: str = "position") -> DataFrame:
    """The rows of ``write_numbered`` with their numbers 0..size-1, in written
    order.  The starts, one row per written partition, are joined by broadcast."""
    first = spark.createDataFrame([(int(p), int(s)) for p, s in starts], "p_ long, start_ long")
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(first), F.shiftright(name, 33) == F.col("p_")).withColumn(
        name, F.col(name).bitwiseAND((1 << 33) - 1) + F.col("start_")).drop("p_", "start_")


def epoch_batches(numbered: DataFrame, size: int, batch_size: int, epochs: int, seed: int = 0,
                  name: str = "position") -> DataFrame:
    """Each row once per epoch with its place in the epoch's random order and
    its batch: a projection of the numbered rows, without a shuffle."""
    rows = numbered.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = rows.withColumn("place", permuted(name, size, seed, F.col("epoch")))
    return rows.withColumn("batch_id", F.floor(F.col("place") / batch_size).cast("long"))


def minibatch_sizes(batched: DataFrame) -> DataFrame:
    return batched.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"))


__all__ = ["repartition_n", "strided", "rank_of_partition", "rank_of", "rank_rows", "partition_zero", "partition_counts",
           "global_index", "top_k", "minibatches", "minibatch_sizes", "permuted", "write_numbered",
           "read_numbered", "epoch_batches"]
