"""Helpers shared by the corpus operators: words and hashes of one text as
NumPy arrays, Arrow iteration, cutting lineage, connected components."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir

U64 = np.uint64
# Word characters are every character but the space and U+0009..U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def random_table(name: str, dtype=U64) -> np.ndarray:
    """One fixed random value per byte, drawn for this name alone: equal in
    every process, whichever modules it has imported and in whatever order."""
    seed = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")
    return np.random.Generator(np.random.PCG64(seed)).integers(
        1, np.iinfo(dtype).max, 256, dtype=dtype, endpoint=True)


# One fixed random 64-bit value per byte; the folded table gives A-Z the values of a-z.
BYTE = random_table("byte") | U64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 2**64)
_POW = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (kept and grown per worker)."""
    if _POW["n"] < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("p", BASE), ("q", BASE_INV)):
            out = np.ones(size, U64)
            out[1:] = U64(base)
            np.multiply.accumulate(out, out=out)
            _POW[name] = out
        _POW["n"] = size
    return _POW["p"], _POW["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """c with c[j] - c[i] = hash of data[i:j] times BASE**i."""
    p, _ = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * p[:len(data)], out=c[1:])
    return c


def range_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, q = powers(len(c))
    return mix((c[end] - c[start]) * q[start] + (end - start).astype(U64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of one text."""
    w = np.zeros(len(data) + 2, bool)
    w[1:-1] = ~SPACE[data]
    edges = np.flatnonzero(w[1:] != w[:-1])
    return edges[0::2], edges[1::2]


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of all runs of ``n`` words (empty when there are fewer)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for i in range(n):
        out *= U64(BASE)
        out += words[i:i + m]
    return mix(out + U64(n))


def utf8(text) -> np.ndarray:
    """Bytes of a text (None: empty)."""
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def rows_of(batches: Iterable[pa.RecordBatch], *names: str, chunk: int = 512) -> Iterator[list[tuple]]:
    """Rows of Arrow batches as lists of tuples, ``chunk`` rows at a time, so
    that outputs are sent on in small batches."""
    for b in batches:
        cols = [b.column(b.schema.get_field_index(n)) for n in names]
        for i in range(0, b.num_rows, chunk):
            yield list(zip(*(c.slice(i, chunk).to_pylist() for c in cols)))


def per_row(fn: Callable[[tuple], tuple | None], names: list[str], schema: pa.Schema,
            chunk: int = 512) -> Callable:
    """A ``mapInArrow`` function from a function of one row (its columns
    ``names``) to one output row, or None for no row."""
    def run(batches):
        for rows in rows_of(batches, *names, chunk=chunk):
            out = [r for r in map(fn, rows) if r is not None]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_WRITTEN: dict[int, tuple] = {}


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the cluster's shared folder and read it back: later
    jobs start from the files, also when executors are lost.  The JVM is asked
    to collect garbage, so that Spark's cleaner frees the shuffle files of
    jobs that are over."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (out, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of settled frames that no later step reads."""
    for df in frames:
        _, path = _WRITTEN.pop(id(df))
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) -> (id, component), one
    row per id that has an edge; component is the smallest id reachable.

    Alternating large-star and small-star steps (O(log^2 n) rounds; stars, as
    leader links make them, settle at once).  Each step takes a minimum per
    node, combined map-side, and one join on the node, which AQE splits when
    a node holds very many edges.  Every round is written to the shared
    folder.  Nothing but a count and a checksum comes to the driver."""
    e = settle(edges.where(F.col("a") != F.col("b"))
               .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    stamp = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = last_low = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-low")
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a != b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        last, e = e, settle(star.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        release(last, last_low)
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                  F.max("a")).first()
        if tuple(r) == stamp:
            break
        stamp = tuple(r)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return (e.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()))


def runs(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Groups of equal ``keys`` from batches sorted by them.  Holds one batch
    and the group that crosses its end, so groups must be bounded."""
    held: list[pa.RecordBatch] = []

    def key(b, i):
        return tuple(b.column(b.schema.get_field_index(k))[i].as_py() for k in keys)

    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            v = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        if held and key(held[-1], held[-1].num_rows - 1) != key(b, 0):
            yield pa.Table.from_batches(held)
            held = []
        for s, e in zip(cuts[:-2], cuts[1:-1]):
            yield pa.Table.from_batches([*held, b.slice(s, e - s)])
            held = []
        held.append(b.slice(cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)


def ragged(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a list column."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = a.offsets.to_numpy()
    return a.values.to_numpy()[off[0]:off[-1]], off - off[0]


def whole_groups(batches: Iterable[pa.RecordBatch], rows: int, *keys: str) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows, or one larger group, from batches sorted
    by ``keys``, that end where a group does.  Holds such a table and a batch."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        change[0] = bool(held)
        starts = []
        for k in keys:
            v = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            starts.append(v[0])
        if held:
            last = held[-1]
            change[0] = any(last.column(last.schema.get_field_index(k))[last.num_rows - 1].as_py() != v
                            for k, v in zip(keys, starts))
        at = 0
        for c in np.flatnonzero(change).tolist():
            if n + c - at >= rows:
                yield pa.Table.from_batches([*held, b.slice(at, c - at)])
                held, n, at = [], 0, c
        held.append(b.slice(at))
        n += b.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column laid end to end (null: none) and the
    bounds of its rows in them."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds - bounds[0]


def list_fields(col: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row of each element of a column of lists of structs, and its fields."""
    size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return (np.repeat(np.arange(len(col)), size),
            [f.to_numpy(zero_copy_only=False) for f in col.flatten().flatten()])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ordered_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, doc_id, text): (doc, tag) orders the documents, by id with
    nulls last; the tag, a 31-bit hash of the text, tells rows that share an
    id apart."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"),
                       F.pmod(F.xxhash64(text_col), F.lit(1 << 31)).alias("tag"),
                       F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def cut_out(texts: DataFrame, ranges: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """``ordered_texts`` without the byte ranges (doc, tag, ranges: array of
    start, end) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])."""
    rows = texts.join(ranges, ["doc", "tag"], "left").select("doc_id", "text", "ranges")
    schema = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
              ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep_bytes:
        schema, out = [*schema, ("kept", pa.binary())], out + ", kept binary"

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                data, bounds = text_bytes(b.column("text"))
                n = np.diff(bounds)
                row, (start, end) = list_fields(b.column("ranges"))
                gap = np.arange(b.num_rows)            # one place between texts: their ranges do not touch
                base = bounds[:-1] + gap
                s, e = base[row] + start, base[row] + np.minimum(end, n[row])
                order = np.argsort(s)
                s, reach, row = s[order], np.maximum.accumulate(e[order]), row[order]
                first = np.flatnonzero(np.concatenate(([True], s[1:] > reach[:-1]))[:len(s)])
                last = np.append(first[1:], len(s))[:len(first)] - 1
                row = row[first]
                s, e = s[first] - gap[row], reach[last] - gap[row]
                removed, spans = np.zeros(len(n), np.int64), np.bincount(row, minlength=len(n))
                np.add.at(removed, row, e - s)
                # what is left of each text: from its start or a range to the next range or its end
                view, s, e, at, kept, digest = memoryview(data), s.tolist(), e.tolist(), 0, [], []
                for lo, hi, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), spans.tolist()):
                    left = [view[x:y] for x, y in zip([lo, *e[at:at + k]], [*s[at:at + k], hi])]
                    at += k
                    if keep_bytes:
                        kept.append(b"".join(left))
                    sha = hashlib.sha256()
                    for x in left:
                        sha.update(x)
                    digest.append(sha.hexdigest())
                cols = [b.column("doc_id"), n, removed, spans, digest] + ([kept] if keep_bytes else [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema)], schema=pa.schema(schema))
    return rows.mapInArrow(run, out)
