"""Readers: every one returns a lazily evaluated, partitioned DataFrame.

Files written by ``tessera.sources.writers`` are found through their
manifest (one row per file) and each file is opened by one task."""

from __future__ import annotations

import fnmatch
import io
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StringType,
                               StructField, StructType)

from tessera.sources import fs

__all__ = ["scan_parquet", "scan_libsvm", "int_range", "slice_of", "scan_int_text",
           "scan_feature_files", "scan_arrow", "arrow_schema_of", "read_whole_text",
           "read_binary", "synth_vectors"]


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; selecting columns here lets the scan read only those."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_libsvm(spark: SparkSession, path: str, num_features: int) -> DataFrame:
    """``label double, features array<double>`` (dense, width ``num_features``)."""
    df = spark.read.format("libsvm").option("numFeatures", num_features).load(path)
    return df.select("label", vector_to_array("features").alias("features"))


def int_range(spark: SparkSession, start: int, end: int, slices: int,
              inclusive: bool = False) -> DataFrame:
    """Integers ``start..end`` in ``slices`` partitions; slice ``i`` starts at
    ``start + floor(i * n / slices)``, as a parallelized range does."""
    return spark.range(start, end + 1 if inclusive else end, 1, slices)


def slice_of(value, start: int, end: int, slices: int):
    """The slice of ``int_range(start, end, slices)`` that holds a value."""
    v = F.col(value) if isinstance(value, str) else value
    return F.floor(((v - start + 1) * slices - 1) / F.lit(end - start)).cast("int")


def scan_int_text(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated integer tokens: ``value bigint`` (null for a token
    that is not an integer, so bad input is counted, not silently cut)."""
    tokens = spark.read.text(path).select(
        F.explode(F.split(F.trim(F.col("value")), r"\s+")).alias("token"))
    return tokens.filter(F.col("token") != "").select(
        "token", F.expr("try_cast(token AS bigint)").alias("value"))


FEATURE_ROW = StructType([
    StructField("file_id", StringType(), False),
    StructField("line", LongType(), False),
    StructField("features", ArrayType(DoubleType()), True),
    StructField("label", DoubleType(), True),
])


def scan_feature_files(manifest: DataFrame, spread: int | None = None) -> DataFrame:
    """Read the (features CSV, labels text) file pairs listed in a manifest.

    The two files of a pair were written by one task, line by line, so the
    n-th feature line belongs to the n-th label: each pair is read by one task,
    both files streamed in step, and every row keeps ``(file_id, line)``.
    """
    n = spread or max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    files = manifest.select("featureArrayFile", "labelsFile").repartition(n)

    def read_pairs(batches):
        for b in batches:
            for feat_uri, lab_uri in zip(b.column("featureArrayFile").to_pylist(),
                                         b.column("labelsFile").to_pylist()):
                yield from _read_pair(feat_uri, lab_uri)

    return files.mapInArrow(read_pairs, FEATURE_ROW)


def _read_pair(feat_uri: str, lab_uri: str, chunk: int = 4096):
    file_id = feat_uri.rsplit("/", 1)[-1].split(".")[0]
    with fs.open_input_stream(feat_uri) as ff, fs.open_input_stream(lab_uri) as lf:
        ft = io.TextIOWrapper(io.BufferedReader(ff), encoding="utf-8")
        lt = io.TextIOWrapper(io.BufferedReader(lf), encoding="utf-8")
        line = 0
        for features, labels in _chunks_in_step(ft, lt, chunk):
            yield _pair_batch(file_id, line, [x.rstrip("\n") for x in features],
                              np.array(labels).astype(np.float64))
            line += len(labels)


def _parse_vectors(lines: list[str]) -> pa.ListArray:
    """Comma-separated numbers per line into an Arrow list column built from
    offsets, with no per-row objects; an empty line is an empty vector.

    Rows of one width go through Arrow's CSV parser, ragged chunks through
    one NumPy call; both parse correctly rounded, like ``float``."""
    widths = np.array([line.count(",") + 1 if line else 0 for line in lines], dtype=np.int32)
    if len(widths) and widths[0] > 0 and np.all(widths == widths[0]):
        flat = _parse_rectangular(lines, int(widths[0]))
    else:
        text = ",".join(line for line in lines if line)
        flat = np.fromstring(text, dtype=np.float64, sep=",") if text else np.zeros(0)
    if len(flat) != widths.sum():
        raise ValueError("feature file has a value that is not a number")
    offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _parse_rectangular(lines: list[str], width: int) -> np.ndarray:
    import pyarrow.csv as pcsv
    names = [f"c{i}" for i in range(width)]
    tbl = pcsv.read_csv(
        io.BytesIO(("\n".join(lines) + "\n").encode("utf-8")),
        read_options=pcsv.ReadOptions(column_names=names, use_threads=False),
        parse_options=pcsv.ParseOptions(newlines_in_values=False),
        convert_options=pcsv.ConvertOptions(column_types={n: pa.float64() for n in names}))
    if tbl.num_rows != len(lines):
        raise ValueError("feature file chunk did not parse row for row")
    return np.column_stack([c.to_numpy() for c in tbl.columns]).ravel()


def _pair_batch(file_id, start, lines, labels) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays(
        [pa.array([file_id] * n, pa.string()),
         pa.array(np.arange(start, start + n, dtype=np.int64)),
         _parse_vectors(lines), pa.array(labels, pa.float64())],
        names=["file_id", "line", "features", "label"])


def _chunks_in_step(a, b, n: int):
    """Up to ``n`` lines of both files at a time; an error when one is longer."""
    while True:
        x, y = list(islice(a, n)), list(islice(b, n))
        if len(x) != len(y):
            raise ValueError("feature and label files have different line counts")
        if not x:
            return
        yield x, y


BATCHES_PER_RUN = 16


def arrow_schema_of(uri: str) -> pa.Schema:
    """The schema in one Arrow IPC file's footer (read on the driver, no rows)."""
    with fs.open_input(uri) as f:
        return ipc.open_file(f).schema


def scan_arrow(spark: SparkSession, manifest: DataFrame, schema,
               spread: int | None = None) -> DataFrame:
    """Stream the record batches of the Arrow IPC files named in
    ``manifest.path``, one batch at a time.  Where the manifest counts the
    batches (``n_batches``), a file's batches are dealt in runs of
    ``BATCHES_PER_RUN``, so a large file is read by several tasks."""
    n = spread or max(1, spark.sparkContext.defaultParallelism)
    if "n_batches" in manifest.columns:
        first = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_batches") - 1, F.lit(0)), F.lit(BATCHES_PER_RUN)))
        files = manifest.select("path", first.alias("first"), F.lit(BATCHES_PER_RUN).alias("run")).repartition(n)
    else:
        files = manifest.select("path", F.lit(0).alias("first"), F.lit(2**31 - 1).alias("run")).repartition(n)
    names = [f.name for f in schema.fields]

    def read_files(batches):
        for b in batches:
            for uri, first, run in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input(uri) as f:
                    reader = ipc.open_file(f)
                    for i in range(first, min(first + run, reader.num_record_batches)):
                        yield reader.get_batch(i).select(names)

    return files.mapInArrow(read_files, schema)


def _empty_files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """(path, modified) of the zero-length files under a folder, which Spark's
    file scans leave out; folders are listed by tasks, and nothing comes to the
    driver."""
    from tessera.sources.packed import list_files
    found = list_files(spark, path).where("length = 0")
    if glob:
        pattern = fnmatch.translate(glob).replace(r"\Z", r"\z")
        found = found.where(F.regexp_extract("path", "[^/]*$", 0).rlike(f"^(?:{pattern})"))
    return found.select("path", "modified")


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file ``(path, value)`` with the whole UTF-8 text, empty
    files included; an empty frame when the path does not exist (the helper
    returned null).  The folders of a partitioned write become columns."""
    try:
        df = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], "path string, value string")
        raise
    df = df.select(F.input_file_name().alias("path"), "*")
    more = _empty_files(spark, path, None).select("path", F.lit("").alias("value"))
    for f in df.schema.fields[2:]:
        folder = F.url_decode(F.regexp_extract("path", rf"/{f.name}=([^/]*)/", 1))
        more = more.withColumn(f.name, folder.cast(f.dataType))
    return df.unionByName(more)


def read_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, modificationTime, length, content`` per file, empty files
    included.  Content is only read when that column is selected."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    empty = _empty_files(spark, path, glob).select(
        "path", F.col("modified").alias("modificationTime"), F.lit(0).cast("long").alias("length"),
        F.lit(b"").alias("content"))
    return df.unionByName(empty)


def synth_vectors(keys: DataFrame, dim: int = 784, seed: int = 42,
                  key: str = "id", spread: int | None = None) -> DataFrame:
    """Uniform random ``features array<double>`` of width ``dim`` and a uniform
    ``label`` for every row of ``keys`` (generated in the JVM).

    Element i of a row depends on its key, i and the seed alone (a 53-bit
    hash), so no two rows share a stream, however they are partitioned.

    Each key grows to ``8 * dim`` bytes, so ``spread=n`` deals the narrow keys
    over ``n`` partitions first (a cheap shuffle) rather than widening them
    in however few partitions the key table was read in."""
    if spread:
        keys = keys.repartition(spread)

    def unit(i):
        h = F.xxhash64(F.col(key).cast("long"), i.cast("long"), F.lit(seed).cast("long"))
        return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)
    return keys.select(
        key, F.transform(F.sequence(F.lit(1), F.lit(dim)), unit).alias("features"),
        unit(F.lit(0)).alias("label"))
