"""Writers.  Every file name is unique (task attempt + uuid) and lands under a
shared folder through a temporary name, so retries and lost executors leave
no partial or colliding files.  Writers that return a manifest yield one row
per file from the tasks that wrote them."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (IntegerType, LongType, StringType, StructField,
                               StructType)

from tessera.functions.scalars import vector_to_csv
from tessera.sources import fs

__all__ = ["write_libsvm", "write_text", "export_feature_files", "export_arrow",
           "write_binary_files", "MANIFEST_SCHEMA"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _unique(prefix: str) -> str:
    ctx = TaskContext.get()
    pid = ctx.partitionId() if ctx else 0
    return f"{prefix}-{pid:05d}-{uuid.uuid4().hex}"


def write_libsvm(df: DataFrame, path: str, features="features", label="label") -> None:
    df.select(_c(label).cast("double").alias("label"),
              array_to_vector(_c(features).cast("array<double>")).alias("features")).write.format("libsvm").mode("errorifexists").save(path)


def write_text(df: DataFrame, col, path: str) -> None:
    """One value per line, one file per partition."""
    df.select(_c(col).cast("string").alias("value")).write.mode("errorifexists").text(path)


MANIFEST_SCHEMA = StructType([
    StructField("featureArrayFile", StringType(), False),
    StructField("labelsFile", StringType(), False),
    StructField("partition_id", IntegerType(), False),
    StructField("n_rows", LongType(), False),
])


def _joined_lines(arr) -> bytes:
    """A string column as newline-terminated lines, joined in Arrow (C++)."""
    import pyarrow.compute as pc
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    one_list = pa.ListArray.from_arrays(pa.array([0, len(arr)], pa.int32()), arr)
    return pc.binary_join(one_list, "\n")[0].as_buffer().to_pybytes() + b"\n"


def export_feature_files(df: DataFrame, path: str, features="features",
                         label="label") -> DataFrame:
    """Per partition, a features CSV (one vector per line) and a labels file
    (one label per line); yields the manifest row of that file pair.

    The text is formatted in the JVM (``vector_to_csv``) and joined into
    lines by Arrow, so Python only moves buffers to the files."""
    lines = df.select(vector_to_csv(_c(features)).alias("f"),
                      _c(label).cast("double").cast("string").alias("l"))

    def write(batches):
        name = _unique("part")
        feat_uri, lab_uri = fs.join(path, name + ".features.csv"), fs.join(path, name + ".labels.txt")
        fs.ensure_dir(path)
        n = 0
        with fs.atomic_output(feat_uri) as ff, fs.atomic_output(lab_uri) as lf:
            for b in batches:
                if b.num_rows:
                    f, lab = b.column("f"), b.column("l")
                    if f.null_count or lab.null_count:
                        raise ValueError("export_feature_files: null features or label")
                    ff.write(_joined_lines(f))
                    lf.write(_joined_lines(lab))
                    n += b.num_rows
        yield pa.RecordBatch.from_pydict({
            "featureArrayFile": [feat_uri], "labelsFile": [lab_uri],
            "partition_id": pa.array([TaskContext.get().partitionId()], pa.int32()),
            "n_rows": pa.array([n], pa.int64())})

    return lines.mapInArrow(write, MANIFEST_SCHEMA)


ARROW_MANIFEST = "path string, partition_id int, n_rows bigint, n_batches int"


def export_arrow(df: DataFrame, path: str) -> DataFrame:
    """Each partition's record batches, all of them, into one Arrow IPC file."""
    schema = df.schema

    def write(batches):
        uri = fs.join(path, _unique("part") + ".arrow")
        fs.ensure_dir(path)
        n = nb = 0
        writer = None
        with fs.atomic_output(uri) as out:
            for b in batches:
                if writer is None:
                    writer = ipc.new_file(out, b.schema)
                writer.write_batch(b)
                n += b.num_rows
                nb += 1
            if writer is None:  # empty partition: still a valid, empty file
                from pyspark.sql.pandas.types import to_arrow_schema
                writer = ipc.new_file(out, to_arrow_schema(schema))
            writer.close()
        yield pa.RecordBatch.from_pydict({
            "path": [uri], "partition_id": pa.array([TaskContext.get().partitionId()], pa.int32()),
            "n_rows": pa.array([n], pa.int64()), "n_batches": pa.array([nb], pa.int32())})

    return df.mapInArrow(write, ARROW_MANIFEST)


def write_binary_files(df: DataFrame, name_col, content_col, path: str, make_folders: bool = False) -> DataFrame:
    """One file per row, ``path/<name>``, with the row's bytes (null: none);
    yields ``(name, n_bytes)`` per file written.  ``make_folders``: names may
    hold folders."""
    src = df.select(_c(name_col).cast("string").alias("name"),
                    _c(content_col).cast("binary").alias("content"))

    def write(batches):
        fs.ensure_dir(path)
        for b in batches:
            names = b.column("name").to_pylist()
            sizes = []
            for name, content in zip(names, b.column("content").to_pylist()):
                if make_folders and "/" in name:
                    fs.ensure_dir(fs.join(path, name.rsplit("/", 1)[0]))
                content = content or b""
                with fs.atomic_output(fs.join(path, name)) as out:
                    out.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_pydict({"name": names,
                                              "n_bytes": pa.array(sizes, pa.int64())})

    return src.mapInArrow(write, "name string, n_bytes bigint")

