"""Many small binary values in few large objects, and folder listings in tasks.

``write_packed`` appends the values of a task to container files of about
``object_bytes`` and keeps an index table (name, container, offset, length);
the number of objects depends on the bytes, not on the rows.  The index is
written last, so containers of lost attempts are never read.  ``read_packed``
reads names or all of them by ranges, neighbours together.

``list_files`` walks a folder tree level by level: the folders of a level are a
table, listed by tasks; the driver holds only the path of the top."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir
from tessera.sources import fs
from tessera.sources.writers import _unique

OBJECT_BYTES = 128 << 20
JOINED = 8 << 20               # ranges are read together up to this many bytes
INDEX = "name string, container string, offset bigint, length bigint"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def write_packed(df: DataFrame, name_col, content_col, path: str, object_bytes: int = OBJECT_BYTES) -> DataFrame:
    """Write the values into containers under ``path`` -> their index, read
    back.  A null value is an empty one; a value larger than ``object_bytes``
    is a container of its own."""
    src = df.select(_c(name_col).cast("string").alias("name"), _c(content_col).cast("binary").alias("content"))

    def write(batches):
        fs.ensure_dir(path)
        out = target = None
        at, rows = 0, []

        def ended():
            out.__exit__(None, None, None)
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                                               pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                                              names=["name", "container", "offset", "length"])
        try:
            for b in batches:
                for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                    content = content or b""
                    if out is not None and rows and at + len(content) > object_bytes:
                        yield ended()
                        out, rows, at = None, [], 0
                    if out is None:
                        target = _unique("pack") + ".bin"
                        out = fs.atomic_output(fs.join(path, target))
                        stream = out.__enter__()
                    stream.write(content)
                    rows.append((name, target, at, len(content)))
                    at += len(content)
            if out is not None:
                done, out = ended(), None
                yield done
        except BaseException as e:
            if out is not None:
                out.__exit__(type(e), e, None)
            raise
    src.mapInArrow(write, INDEX).write.parquet(fs.join(path, "_index"))
    return df.sparkSession.read.schema(INDEX).parquet(fs.join(path, "_index"))


def read_packed(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(name, length, content) of all values or of the names in ``wanted.name``."""
    index = spark.read.schema(INDEX).parquet(fs.join(path, "_index"))
    if wanted is not None:
        index = index.join(wanted.select("name").distinct(), "name", "left_semi")
    stretch = F.floor(F.col("offset") / JOINED)        # a container is read by several tasks
    rows = index.repartition("container", stretch).sortWithinPartitions("container", "offset")

    def read(batches):
        at, f = None, None
        try:
            for b in batches:
                cols = list(zip(*(c.to_pylist() for c in b.columns)))
                i = 0
                while i < len(cols):
                    _, container, lo, _ = cols[i]
                    j, end = i, lo
                    while j < len(cols) and cols[j][1] == container and cols[j][2] == end and (
                            j == i or end + cols[j][3] - lo <= JOINED):
                        end += cols[j][3]
                        j += 1
                    if container != at:
                        if f is not None:
                            f.close()
                        at, f = container, fs.open_input(fs.join(path, container))
                    f.seek(lo)
                    data = f.read(end - lo)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([x[0] for x in cols[i:j]], pa.string()), pa.array([x[3] for x in cols[i:j]], pa.int64()),
                        pa.array([data[x[2] - lo:x[2] - lo + x[3]] for x in cols[i:j]], pa.binary())],
                        names=["name", "length", "content"])
                    i = j
        finally:
            if f is not None:
                f.close()
    return rows.mapInArrow(read, "name string, length bigint, content binary")


FILES = "path string, folder boolean, length bigint, modified timestamp"


def list_files(spark: SparkSession, path: str, levels: int = 64) -> DataFrame:
    """(path, length, modified) of every file under a folder, empty ones
    included (a path that is a file: that file); names that begin with a dot or underscore are left out, as
    Spark's file scans leave them.  One job a level, at most ``levels``."""
    def listed(batches):
        import pyarrow.fs as pafs
        for b in batches:
            for folder in b.column("path").to_pylist():
                store, root = fs.resolve(folder)
                own = store.get_file_info(root)
                if own.type == pafs.FileType.File:
                    found = [(folder, own)]
                else:
                    found = [(fs.join(folder, x.base_name), x) for x in store.get_file_info(
                        pafs.FileSelector(root, allow_not_found=True)) if x.base_name[:1] not in "._"]
                for i in range(0, len(found), 10_000):
                    names, part = zip(*found[i:i + 10_000])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(names, pa.string()),
                        pa.array([x.type == pafs.FileType.Directory for x in part], pa.bool_()),
                        pa.array([x.size or 0 for x in part], pa.int64()),
                        pa.array([x.mtime for x in part], pa.timestamp("us", "UTC"))],
                        names=["path", "folder", "length", "modified"])
    level = spark.createDataFrame([(path.rstrip("/"),)], "path string")
    out = None
    for _ in range(levels):
        table = shared_dir(spark, "listing")
        level.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(listed, FILES).write.parquet(table)
        rows = spark.read.schema(FILES).parquet(table)
        files = rows.where("not folder").drop("folder")
        out = files if out is None else out.unionByName(files)
        level = rows.where("folder").select("path")
        if level.isEmpty():
            return out
    raise ValueError(f"{path} is more than {levels} levels deep")


__all__ = ["write_packed", "read_packed", "list_files", "OBJECT_BYTES"]
