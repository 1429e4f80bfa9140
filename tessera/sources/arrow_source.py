"""Arrow IPC files as a Spark data source, ``tessera_arrow``, for reading and
for committed writing.

Reading: the footers name the record batches of each file; a partition is a run
of batches of about ``partitionBytes``, so one large file is read by many tasks.
Only the fields of the schema at hand are read; ``scan_arrow_files`` makes it
from the columns asked for.

Writing: each task writes one file under a name of its own and reports it; the
driver then commits by renaming one manifest into place.  Readers of a folder
with a manifest read the files it names and no others, so what a killed or
repeated task has left, or a job that failed, is never seen.  An overwrite
replaces the manifest, and the old files go after that."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from tessera.sources import fs
from tessera.sources.writers import _unique

MANIFEST = "_manifest.json"
PARTITION_BYTES = 64 << 20


def committed(path: str) -> list[dict] | None:
    """The files of a folder's manifest (None: it has none)."""
    if not fs.exists(fs.join(path, MANIFEST)):
        return None
    with fs.open_input_stream(fs.join(path, MANIFEST)) as f:
        return json.loads(f.read())


def files_of(path: str) -> list[str]:
    """The Arrow files to read: of the manifest, of a folder without one, or the one named."""
    found = committed(path)
    if found is not None:
        return [fs.join(path, x["file"]) for x in found]
    if path.endswith(".arrow"):
        return [path]
    return [fs.join(path, n) for n in fs.names(path) if n.endswith(".arrow")]


@dataclass
class Batches(InputPartition):
    path: str
    first: int
    last: int


class ArrowReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.path = schema, options["path"]
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self):
        out = []
        for path in files_of(self.path):
            with fs.open_input(path) as f:
                n, size = ipc.open_file(f).num_record_batches, f.size()
            step = max(1, int(self.bytes * n / max(size, 1)))
            out += [Batches(path, i, min(n, i + step)) for i in range(0, n, step)]
        return out or [Batches("", 0, 0)]

    def read(self, partition):
        names, want = self.schema.fieldNames(), to_arrow_schema(self.schema)
        if not partition.path:
            return
        with fs.open_input(partition.path) as f:
            have = ipc.open_file(f).schema
            index = [have.get_field_index(n) for n in names]
            if -1 in index:
                raise ValueError(f"{partition.path} has no column {names[index.index(-1)]}")
            reader = ipc.open_file(f, options=ipc.IpcReadOptions(included_fields=index))
            for i in range(partition.first, partition.last):
                b = reader.get_batch(i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index(n)).cast(t.type) for n, t in zip(names, want)], schema=want)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    batches: int
    size: int


class ArrowSink(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options, overwrite: bool):
        self.schema, self.path, self.overwrite = schema, options["path"], overwrite
        self.rows = int(options.get("rowsPerBatch", 0))

    def write(self, iterator):
        fs.ensure_dir(self.path)
        name = _unique("part") + ".arrow"
        rows = batches = 0
        schema = to_arrow_schema(self.schema)
        with fs.atomic_output(fs.join(self.path, name)) as out:
            with ipc.new_file(out, schema) as writer:
                for b in iterator:
                    b = b if b.schema == schema else b.cast(schema)
                    for i in range(0, b.num_rows, self.rows or max(1, b.num_rows)):
                        part = b.slice(i, self.rows or b.num_rows)
                        writer.write_batch(part)
                        rows += part.num_rows
                        batches += 1
            size = out.tell()
        return Written(name, rows, batches, size)

    def commit(self, messages):
        new = [{"file": m.file, "rows": m.rows, "batches": m.batches, "bytes": m.size} for m in messages if m]
        old = committed(self.path) or []
        fs.ensure_dir(self.path)
        with fs.atomic_output(fs.join(self.path, MANIFEST)) as f:
            f.write(json.dumps(new if self.overwrite else old + new).encode())
        if self.overwrite:
            for x in old:
                fs.remove(fs.join(self.path, x["file"]))

    def abort(self, messages):
        for m in messages:
            if m:
                fs.remove(fs.join(self.path, m.file))


class ArrowFiles(DataSource):
    @classmethod
    def name(cls):
        return "tessera_arrow"

    def schema(self):
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no Arrow files in {self.options['path']}")
        with fs.open_input(files[0]) as f:
            return from_arrow_schema(ipc.open_file(f).schema)

    def reader(self, schema):
        return ArrowReader(schema, self.options)

    def writer(self, schema, overwrite):
        return ArrowSink(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowFiles)


def scan_arrow_files(spark: SparkSession, path: str, columns: list[str] | None = None,
                     partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The rows of the Arrow files under a path; ``columns`` are all that is read."""
    register(spark)
    reader = spark.read.format("tessera_arrow").option("partitionBytes", partition_bytes)
    if columns is not None:
        files = files_of(path)
        with fs.open_input(files[0]) as f:
            full = from_arrow_schema(ipc.open_file(f).schema)
        reader = reader.schema(StructType([full[c] for c in columns]))
    return reader.load(path)


def write_arrow(df: DataFrame, path: str, mode: str = "append", rows_per_batch: int = 0) -> None:
    """Write a frame as committed Arrow files: one per task."""
    register(df.sparkSession)
    df.write.format("tessera_arrow").mode(mode).option("rowsPerBatch", rows_per_batch).save(path)


__all__ = ["ArrowFiles", "register", "scan_arrow_files", "write_arrow", "committed", "files_of", "MANIFEST"]
