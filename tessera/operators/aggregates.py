"""Reductions: sums, predicate counts, pi estimates, metrics, vector means.

All are ordinary Spark aggregates, so they run as a partial aggregate per
task and a final one after a small shuffle (map-side combine).
"""

from __future__ import annotations

import math
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions import tensor
from tessera.functions.scalars import uniform


BUFFER_VALUES = 1 << 21        # sums and counts held in a task by vector_mean_wide


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def global_sum(df: DataFrame, col, name: str = "total") -> DataFrame:
    """Sum as 64-bit (the 32-bit C sum would wrap past 2^31)."""
    return df.agg(F.sum(_c(col).cast("bigint")).alias(name))


def partial_sums(df: DataFrame, col, rank: Column, name: str = "partial") -> DataFrame:
    """Sum per rank: the values each worker holds before the final reduce."""
    return df.groupBy(rank.alias("rank")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_c(col).cast("bigint")).alias(name))


def count_if(df: DataFrame, predicate: Column, name: str = "hits") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.count_if(predicate).cast("bigint").alias(name))


def inside_unit_circle(x: Column, y: Column) -> Column:
    """The strict test ``x*x + y*y < 1``."""
    return x * x + y * y < F.lit(1.0)


def pi_estimate(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``4 * hits / n`` over a table of points in the unit square."""
    return count_if(points, inside_unit_circle(F.col(x), F.col(y))) \
        .withColumn("pi", F.lit(4.0) * F.col("hits") / F.col("n"))


def random_points(df: DataFrame, *keys, seed: int = 7) -> DataFrame:
    """One uniform point in [0,1)^2 per input row, fixed by its keys and the
    seed; the two axes and all rows have streams of their own."""
    return df.select(uniform(*keys, F.lit(seed), F.lit("x")).alias("x"),
                     uniform(*keys, F.lit(seed), F.lit("y")).alias("y"))


def pi_monte_carlo(df: DataFrame, *keys, seed: int = 7) -> DataFrame:
    """Monte Carlo pi with one random point per row of ``df``, plus a check
    that the estimate lies within 4 standard deviations of pi."""
    est = pi_estimate(random_points(df, *keys, seed=seed))
    sd = F.lit(4.0 * math.sqrt((math.pi / 4) * (1 - math.pi / 4))) / F.sqrt(F.col("n"))
    return est.select("n", "hits", "pi",
                      (F.abs(F.col("pi") - F.lit(math.pi)) < F.lit(4.0) * sd).alias("within_4sd"))


def accuracy(df: DataFrame, label, prediction, name: str = "accuracy") -> DataFrame:
    return df.agg(F.avg((_c(label).cast("double") == _c(prediction).cast("double"))
                        .cast("double")).alias(name))


def evaluate(df: DataFrame, logits, label) -> DataFrame:
    """Accuracy (argmax vs label) and mean softmax cross-entropy in one pass."""
    z, y = _c(logits), _c(label)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((tensor.argmax(z) == y.cast("int")).cast("double")).alias("accuracy"),
        F.avg(tensor.cross_entropy(z, y)).alias("mean_ce"))


def vector_mean(df: DataFrame, col, by: list[str] | None = None,
                long_format: bool = True) -> DataFrame:
    """Element-wise mean of an array column, optionally per group.

    ``posexplode`` then a partial/final aggregate on ``(by, pos)``: each task
    emits at most ``groups x width`` partial rows, whatever the data size or
    skew.  ``long_format=False`` regathers each group's ``width`` means
    (bounded by the vector width) into one array.
    """
    by = by or []
    long = df.select(*by, F.posexplode(_c(col)).alias("pos", "v")) \
        .groupBy(*by, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))
    if long_format:
        return long
    return long.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))),
                    lambda s: s["mean"]).alias("mean"))


def vector_mean_wide(df: DataFrame, col, by: list[str] | None = None) -> DataFrame:
    """Element-wise mean of an array column per group -> (by..., pos, mean),
    without a row per element: a task adds its vectors into one buffer of sums
    and counts per group and sends one row per group; the rows of a group meet
    in one task, which adds them as they come.  Groups seen by a task are sent
    early when their buffers pass ``BUFFER_VALUES`` values.  Null vectors and
    null elements count for nothing; vectors may differ in length."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType
    by = by or []
    src = df.select(*by, _c(col).cast("array<double>").alias("v_"))
    keys = [src.schema[b] for b in by]
    partial = StructType([*keys, StructField("s_", ArrayType(DoubleType())), StructField("n_", ArrayType(LongType()))])
    final = StructType([*keys, StructField("pos", IntegerType()), StructField("mean", DoubleType())])

    def add(held: dict, key: tuple, s: np.ndarray, n: np.ndarray) -> int:
        old = held.get(key)
        if old is None:
            held[key] = [s.astype(np.float64), n.astype(np.int64)]
            return 2 * len(s)
        grown = max(0, len(s) - len(old[0]))
        if grown:
            old[0], old[1] = np.pad(old[0], (0, grown)), np.pad(old[1], (0, grown))
        old[0][:len(s)] += s
        old[1][:len(n)] += n
        return 2 * grown

    def sums(batches):
        held, size = {}, 0

        def sent():
            rows = [(*k, s.tolist(), n.tolist()) for k, (s, n) in held.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([
                    *(pa.array(c, t) for c, t in zip(list(zip(*rows))[:len(by)], types)),
                    pa.array([r[-2] for r in rows], pa.list_(pa.float64())),
                    pa.array([r[-1] for r in rows], pa.list_(pa.int64()))], names=[*by, "s_", "n_"])
        for b in batches:
            types = [b.schema.field(i).type for i in range(len(by))]
            codes, known = np.zeros(b.num_rows, np.int64), {(): 0}
            if by:
                known = {}
                pairs = zip(*(b.column(i).to_pylist() for i in range(len(by))))
                codes = np.array([known.setdefault(k, len(known)) for k in pairs], np.int64)
            v = b.column(len(by))
            off, flat = v.offsets.to_numpy(), v.values
            # a null vector has no elements, whatever its offsets say
            size_of = np.where(v.is_valid().to_numpy(zero_copy_only=False), np.diff(off), 0)
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            for width in np.unique(size_of[size_of > 0]).tolist():
                rows = np.flatnonzero(size_of == width)
                rows = rows[np.argsort(codes[rows], kind="stable")]
                cut = np.flatnonzero(np.diff(codes[rows], prepend=-1))
                names = list(known)
                for lo, hi in zip(cut.tolist(), [*cut.tolist()[1:], len(rows)]):
                    at = off[rows[lo:hi]][:, None] + np.arange(width)
                    ok = there[at]
                    size += add(held, names[codes[rows[lo]]], np.where(ok, x[at], 0.0).sum(0), ok.sum(0))
            if size > BUFFER_VALUES:
                yield from sent()
                held, size = {}, 0
        yield from sent()

    def means(batches):
        at, held, types = None, {}, []

        def done():
            for k, (s, n) in held.items():
                ok = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([
                    *(pa.array([x] * len(ok), t) for x, t in zip(k, types)), pa.array(ok.astype(np.int32)),
                    pa.array(s[ok] / n[ok])], names=[*by, "pos", "mean"])
        for b in batches:
            types = [b.schema.field(i).type for i in range(len(by))]
            for row in zip(*(c.to_pylist() for c in b.columns)):
                key = tuple(row[:len(by)])
                if key != at:
                    yield from done()
                    at, held = key, {}
                add(held, key, np.array(row[-2]), np.array(row[-1]))
        yield from done()
    parts = src.mapInArrow(sums, partial)
    parts = parts.repartition(*by).sortWithinPartitions(*by) if by else parts.repartition(1)
    return parts.mapInArrow(means, final)


def observed_report(df: DataFrame, rank: Column, value, act, fmt: str = K.REPORT_SUM_FORMAT) -> dict:
    """Run ``act(frame)`` on ``df`` and report what passed through it, from
    metrics gathered on the running query: the number of ranks seen, the sum,
    the time taken in seconds and the report line."""
    seen = Observation(f"report-{uuid.uuid4().hex[:8]}")
    began = time.perf_counter()
    act(df.observe(seen, F.size(F.collect_set(rank)).alias("np"), F.sum(_c(value).cast("bigint")).alias("total")))
    took = time.perf_counter() - began
    got = seen.get
    return {"np": got["np"], "total": got["total"], "seconds": took, "report": fmt.replace("%0.", "%.") % (got["np"], got["total"])}


def report_row(df: DataFrame, np_col, value_col, fmt: str = K.REPORT_SUM_FORMAT) -> DataFrame:
    """The report line without the timing: ``np= 3;    sum=45``.  (Java's
    formatter wants ``%.4f`` where C accepts ``%0.4f``; the output is the same.)"""
    fmt = fmt.replace("%0.", "%.")
    return df.select(F.format_string(fmt, _c(np_col), _c(value_col)).alias("report"))
