"""Gang stages: all tasks start together (barrier mode), can wait for each
other and exchange small messages; a failing task fails the whole stage.

``fn(ctx, batches)`` runs once per rank with the ``BarrierTaskContext`` and
that rank's Arrow batches, and yields pandas frames.  Every rank must make
the same sequence of ``barrier``/``allGather`` calls, so loop counts come
from arguments, never from the rank's data.  ``allGather`` goes through the
driver: keep messages small (partials, gradients), never rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.operators.partitions import strided


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gang(df: DataFrame, world: int, fn, schema, key=None, arrow: bool = False) -> DataFrame:
    """Run ``fn`` on ``world`` ranks at once. With ``key``, rank r gets the rows
    with ``key mod world == r``; otherwise rows are dealt round-robin.
    ``arrow`` hands ``fn`` Arrow record batches (and takes batches back)
    instead of pandas frames: no per-row objects for vector columns."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if world > slots:
        raise ValueError(f"a gang of {world} needs {world} free task slots; the cluster has {slots}")
    parts = strided(df, world, key) if key is not None else df.repartition(world)

    def run(batches):
        ctx = BarrierTaskContext.get()
        yield from fn(ctx, batches)

    # Spark reruns a failed barrier stage only when it is a shuffle-map stage
    # (a failed barrier result stage aborts the job), so the gang's output
    # always goes through an exchange; gangs emit partials, so it is small.
    mapper = parts.mapInArrow if arrow else parts.mapInPandas
    return mapper(run, schema, barrier=True).repartition(world)


def encode_array(a: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(a, np.float64).tobytes()).decode("ascii")


def decode_array(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), np.float64)


def all_reduce_sum(ctx, a: np.ndarray) -> np.ndarray:
    """Element-wise sum over all ranks; every rank gets the result."""
    parts = ctx.allGather(encode_array(np.asarray(a, np.float64).ravel()))
    return np.sum([decode_array(p) for p in parts], axis=0).reshape(np.shape(a))


def rank_partials(df: DataFrame, world: int, key, *aggs: Column) -> DataFrame:
    """Pre-aggregate what each rank would reduce: with ``key`` the rank of a
    row is ``key mod world`` (the strided split) and the result has one row
    per rank; without, one row per input partition (dealt round-robin to the
    ranks later).  Spark combines map-side, so only these partials shuffle."""
    if key is not None:
        return df.groupBy(F.pmod(_c(key), F.lit(world)).cast("int").alias("_rank")).agg(*aggs)
    return df.groupBy(F.spark_partition_id().alias("_part")).agg(*aggs)


def _partial_key(key):
    return "_rank" if key is not None else None


def gang_sum(df: DataFrame, col: str, world: int, key=None) -> DataFrame:
    """Each rank's partial sum (pre-aggregated by Spark over the rows of that
    rank), reduced in the gang: the partials are all-gathered (itself a
    barrier: it returns once every rank has sent) and rank 0 alone yields
    ``(world, total)``."""
    partials = rank_partials(df, world, key, F.sum(_c(col).cast("bigint")).alias("s"))

    def fn(ctx, batches):
        local = 0
        for pdf in batches:
            local += int(pdf["s"].fillna(0).astype("int64").sum())
        total = sum(int(p) for p in ctx.allGather(str(local)))
        if ctx.partitionId() == 0:
            yield pd.DataFrame({"world": [len(ctx.getTaskInfos())], "total": [total]})

    return gang(partials, world, fn, "world int, total bigint", _partial_key(key))


def gang_members(df: DataFrame, world: int, key=None) -> DataFrame:
    """One row per rank: its row count (pre-aggregated), the gang size and
    whether every peer reported an address."""
    partials = rank_partials(df, world, key, F.count(F.lit(1)).alias("n"))

    def fn(ctx, batches):
        n = sum(int(pdf["n"].sum()) for pdf in batches)
        peers = [t.address for t in ctx.getTaskInfos()]
        ctx.barrier()
        yield pd.DataFrame({"rank": [ctx.partitionId()], "world": [len(peers)],
                            "n_rows": [n], "peers_known": [all(bool(a) for a in peers)]})

    return gang(partials, world, fn, "rank int, world int, n_rows bigint, peers_known boolean",
                _partial_key(key))


def gang_count_report(df: DataFrame, predicate, world: int, key=None,
                      fmt: str = K.REPORT_PI_FORMAT, scale: float = 4.0) -> DataFrame:
    """The parallel-estimate pattern: every rank counts the rows of its share
    that pass ``predicate``, the counts are all-gathered, and rank 0 alone
    yields ``n, hits`` and the report line (``fmt`` of the gang size and
    ``scale * hits / n``; timing left out).

    A Column predicate is counted by Spark before the gang (only per-rank
    counts move); a Python ``predicate(pandas batch) -> bool array`` runs in
    the ranks over their rows."""
    if isinstance(predicate, Column):
        src = rank_partials(df, world, key, F.count(F.lit(1)).alias("n"),
                            F.count_if(predicate).cast("bigint").alias("hits"))
        gang_key = _partial_key(key)

        def count(pdf):
            return int(pdf["n"].sum()), int(pdf["hits"].sum())
    else:
        src, gang_key = df, key

        def count(pdf):
            return len(pdf), int(np.count_nonzero(predicate(pdf)))

    def fn(ctx, batches):
        n = hits = 0
        for pdf in batches:
            a, b = count(pdf)
            n, hits = n + a, hits + b
        parts = [p.split(",") for p in ctx.allGather(f"{n},{hits}")]
        tn, th = sum(int(a) for a, _ in parts), sum(int(b) for _, b in parts)
        if ctx.partitionId() == 0:
            size = len(ctx.getTaskInfos())
            yield pd.DataFrame({"n": [tn], "hits": [th], "report": [
                fmt % (size, scale * th / tn if tn else float("nan"))]})

    return gang(src, world, fn, "n bigint, hits bigint, report string", gang_key)


def gang_vector_mean(df: DataFrame, col: str, width: int, world: int) -> DataFrame:
    """Element-wise mean of a vector column by all-reduce: each input
    partition's vector sum and row count are computed in NumPy (one partial
    per partition), the ranks add their partials, all-gather the sums
    (model-sized messages) and rank 0 yields ``(pos, mean)``: the averaging
    a data-parallel optimizer does with gradients."""
    from tessera.operators.layers import list_matrix

    def partial(batches):
        import pyarrow as pa
        total, n = np.zeros(width), 0
        for b in batches:
            if b.num_rows:
                total += list_matrix(b.column(col), width).sum(axis=0)
                n += b.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"s": pa.array([total.tolist()], pa.list_(pa.float64())),
                                              "n": pa.array([n], pa.int64())})

    partials = df.select(col).mapInArrow(partial, "s array<double>, n bigint")

    def fn(ctx, batches):
        from tessera.operators.layers import stack_column
        total, n = np.zeros(width), 0
        for pdf in batches:
            if len(pdf):
                total += stack_column(pdf["s"], width).sum(axis=0)
                n += int(pdf["n"].sum())
        red = all_reduce_sum(ctx, np.concatenate([total, [n]]))
        if ctx.partitionId() == 0 and red[-1] > 0:
            yield pd.DataFrame({"pos": np.arange(width, dtype=np.int32), "mean": red[:-1] / red[-1]})

    return gang(partials, world, fn, "pos int, mean double")


BLOCK = 8192                   # values of a vector that one task reduces together


def block_reduce(df: DataFrame, col: str, width: int, block: int = BLOCK) -> DataFrame:
    """Element-wise sum and row count of a vector column -> (pos, total, n), as
    a reduce-scatter: each task adds its vectors and sends the sum in blocks,
    each block is added up by one task, and the result stays distributed.
    Neither the driver nor any rank holds what all ranks send; a task holds one
    vector or one block."""
    from tessera.operators.layers import list_matrix

    def partial(batches):
        import pyarrow as pa
        total, n = np.zeros(width), 0
        for b in batches:
            for i in range(0, b.num_rows, max(1, (1 << 22) // width)):
                part = b.slice(i, max(1, (1 << 22) // width))
                total += list_matrix(part.column(0), width).sum(axis=0)
                n += part.num_rows
        if n:
            for i in range(0, width, block):
                yield pa.RecordBatch.from_arrays([
                    pa.array([i // block], pa.int32()), pa.array([total[i:i + block].tolist()], pa.list_(pa.float64())),
                    pa.array([n], pa.int64())], names=["block", "s", "n"])

    def added(batches):
        import pyarrow as pa

        def done():
            return pa.RecordBatch.from_arrays([
                pa.array(np.arange(at * block, at * block + len(total), dtype=np.int32)), pa.array(total),
                pa.array(np.full(len(total), n))], names=["pos", "total", "n"])
        at, total, n = None, None, 0
        for b in batches:
            for k, s, m in zip(*(c.to_pylist() for c in b.columns)):
                if k != at:
                    if at is not None:
                        yield done()
                    at, total, n = k, np.zeros(len(s)), 0
                total += s
                n += m
        if at is not None:
            yield done()
    parts = df.where(F.col(col).isNotNull()).select(col).mapInArrow(partial, "block int, s array<double>, n bigint")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(added, "pos int, total double, n bigint")
