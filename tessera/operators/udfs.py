"""User-code forms: a scalar Python UDF (Arrow-batched), partition maps over
pandas and Arrow batches, and an external program per partition."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def rank0_label(rank: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """``a:b`` where the row's rank is 0, null elsewhere (only rank 0
    reports); whole columns at a time."""
    out = a.astype("string") + ":" + b.astype("string")
    return out.where(rank == 0, None)


def udf_two_columns(df: DataFrame, a, b, rank: Column, name: str = "result", keep: tuple = ()) -> DataFrame:
    """``keep`` and the label of two columns; ``rank`` comes from the row's
    key, so no row moves."""
    return df.select(*keep, rank0_label(rank, _c(a), _c(b)).alias(name))


def map_partitions(df: DataFrame, fn, schema) -> DataFrame:
    """``fn(pandas batch) -> pandas frame`` of 0..n rows per batch."""

    def run(batches):
        for pdf in batches:
            out = fn(pdf)
            if out is not None and len(out):
                yield out

    return df.mapInPandas(run, schema)


def to_pandas(df: DataFrame, arrow: bool = True, limit: int = 1_000_000) -> pd.DataFrame:
    """A bounded result as a pandas frame, moved as Arrow batches or (``arrow``
    off) row by row; the switch holds for this call only.  More than ``limit``
    rows are an error: larger results are written, not collected."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.pyspark.enabled"
    old = conf.get(key)
    conf.set(key, str(arrow).lower())
    try:
        out = df.limit(limit + 1).toPandas()
    finally:
        conf.set(key, old)
    if len(out) > limit:
        raise ValueError(f"more than {limit} rows; write the frame instead of collecting it")
    return out


def arrow_passthrough(df: DataFrame) -> DataFrame:
    """Arrow batches in, the same batches out (measures the JVM<->Python hop)."""
    return df.mapInArrow(lambda batches: batches, df.schema)


def pandas_passthrough(df: DataFrame) -> DataFrame:
    return df.mapInPandas(lambda batches: batches, df.schema)


# awk keeps numbers as doubles: "%.0f" prints a partial sum exactly up to 2^53
# (plain print and "%d" would give 3e+09 or cap at 2^31 - 1 in some awks).
SUM_PROGRAM = "awk 'BEGIN {s = 0} {for (i = 1; i <= NF; i++) s += $i} END {printf \"%.0f\\n\", s}'"


def pipe_partitions(df: DataFrame, col, program: str, lines_per_batch: int = 10_000) -> DataFrame:
    """Each partition's values, one per line, go to the stdin of one run of an
    external program; every stdout line becomes a row ``line string``.

    A writer thread streams the Arrow batches into stdin while the task
    yields stdout in batches of ``lines_per_batch`` lines, so neither side is
    held in memory and a chatty program cannot deadlock.  A non-zero exit
    fails the task with the end of the program's stderr."""
    src = df.select(_c(col).cast("string").alias("value"))

    def run(batches):
        import subprocess
        import threading

        import pyarrow as pa
        import pyarrow.compute as pc

        from tessera.sources.writers import _joined_lines
        proc = subprocess.Popen(program, shell=True, stdin=subprocess.PIPE,
                                stdout=subprocess.PIPE, stderr=subprocess.PIPE)
        failure: list[BaseException] = []
        err: list[bytes] = []

        def feed():
            try:
                for b in batches:
                    if b.num_rows:
                        proc.stdin.write(_joined_lines(pc.fill_null(b.column("value"), "")))
            except BrokenPipeError:
                pass                              # the program stopped reading
            except BaseException as e:            # surfaced in the task below
                failure.append(e)
            finally:
                try:
                    proc.stdin.close()
                except BrokenPipeError:
                    pass

        threads = [threading.Thread(target=feed, daemon=True),
                   threading.Thread(target=lambda: err.append(proc.stderr.read()), daemon=True)]
        for t in threads:
            t.start()
        try:
            chunk: list[str] = []
            for raw in proc.stdout:
                chunk.append(raw.decode("utf-8").rstrip("\n"))
                if len(chunk) == lines_per_batch:
                    yield pa.RecordBatch.from_pydict({"line": pa.array(chunk, pa.string())})
                    chunk = []
            for t in threads:
                t.join()
            code = proc.wait()
            if failure:
                raise failure[0]
            if code != 0:
                raise RuntimeError(f"{program!r} exited with {code}: "
                                   f"{b''.join(err).decode('utf-8', 'replace')[-2000:]}")
            if chunk:
                yield pa.RecordBatch.from_pydict({"line": pa.array(chunk, pa.string())})
        finally:                                  # also when the task stops early
            if proc.poll() is None:
                proc.kill()
                proc.wait()

    return src.mapInArrow(run, "line string")


REPORT = "rank int, exit_code int, n_lines bigint, output string, error string"
TAIL = 2000


def pipe_report(df: DataFrame, col, program: str, world: int, key, fail: bool = False) -> DataFrame:
    """Run an external program on ``world`` ranks and return how each ended:
    exit code, number of output lines, and the ends (``TAIL`` characters) of
    what it printed and of its error stream.

    Rank r (``$RANK`` of ``$WORLD`` in the program's environment) reads the
    values whose key is r modulo ``world``, one per line.  A program that fails,
    is killed (a negative code) or stops reading early does not fail the job:
    its row says so.  With ``fail`` the first bad rank fails the job instead,
    with its code and error."""
    src = df.select(F.pmod(_c(key), F.lit(world)).cast("int").alias("rank"), _c(col).cast("string").alias("value"))

    def run(batches):
        import os
        import subprocess
        import threading

        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        from tessera.sources.writers import _joined_lines
        rank = TaskContext.get().partitionId()
        proc = subprocess.Popen(program, shell=True, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE,
                                env={**os.environ, "RANK": str(rank), "WORLD": str(world)})
        ends, lines = {"out": b"", "err": b""}, [0]

        def drain(name, stream):
            for chunk in iter(lambda: stream.read1(1 << 16), b""):
                ends[name] = (ends[name] + chunk)[-8 * TAIL:]
                if name == "out":
                    lines[0] += chunk.count(b"\n")
        readers = [threading.Thread(target=drain, args=(n, s), daemon=True)
                   for n, s in (("out", proc.stdout), ("err", proc.stderr))]
        for t in readers:
            t.start()
        try:
            for b in batches:
                if b.num_rows and proc.poll() is None:
                    try:
                        proc.stdin.write(_joined_lines(pc.fill_null(b.column("value"), "")))
                    except BrokenPipeError:
                        pass                          # the program stopped reading
            try:
                proc.stdin.close()
            except BrokenPipeError:
                pass
            code = proc.wait()
            for t in readers:
                t.join()
        finally:                                      # also when the task stops early
            if proc.poll() is None:
                proc.kill()
                proc.wait()
        text = {k: v.decode("utf-8", "replace")[-TAIL:] for k, v in ends.items()}
        if fail and code:
            raise RuntimeError(f"rank {rank}: {program!r} exited with {code}: {text['err']}")
        yield pa.RecordBatch.from_arrays([
            pa.array([rank], pa.int32()), pa.array([code], pa.int32()), pa.array([lines[0]], pa.int64()),
            pa.array([text["out"]]), pa.array([text["err"]])], names=["rank", "exit_code", "n_lines", "output", "error"])
    return src.repartitionById(world, F.col("rank")).select("value").mapInArrow(run, REPORT)


def pipe_sum(df: DataFrame, col, program: str = SUM_PROGRAM) -> DataFrame:
    """Per-partition partial sums by an external program, added up by Spark."""
    partials = pipe_partitions(df, col, program).select(
        F.trim("line").cast("bigint").alias("partial"))
    return partials.agg(F.count(F.lit(1)).alias("n_partials"),
                        F.sum("partial").alias("total"))


__all__ = ["udf_two_columns", "rank0_label", "map_partitions", "to_pandas", "arrow_passthrough",
           "pandas_passthrough", "pipe_partitions", "pipe_report", "pipe_sum", "SUM_PROGRAM"]
