"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text (each step shifts left and adds the
byte's random value, so it depends on the last 32 bytes).  A chunk ends where
the hash is the least within REACH bytes to both sides.  That rule looks only
at nearby content: inserting or deleting bytes moves the cuts near the edit
and no others, and a passage shared by two texts is cut alike in both, but for
its ends.  Chunks have more than REACH bytes (the end of a text and what forced
cuts leave may have fewer), twice that on average; stretches without a least
value, such as one repeated byte, are cut every MOST bytes.

Chunks of at least ``shortest`` bytes with equal digests (128 bits) are copies:
the one in the earliest document (and earliest place there) stays, the others
are cut out.  The query op4_chunking compares all chunks (``shortest`` 1), so an
exact copy goes whole, short texts too; by default, those of up to REACH bytes
stay.  Digests are counted with map-side combining, so frequent ones cost
one row per task; only chunks that occur twice go on.

Defined results: null and empty texts have no chunks; rows that share id and
text are one document and get the same result; rows that share only the id are
ordered by a hash of their text; null ids come last; an empty table gives no
rows; other columns are not read.  Texts are chunked whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

REACH = 32
MOST = 1024
GEAR = C.random_table("gear", np.uint32)
SECOND = C.random_table("chunk digest")


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: sum over the last 32 bytes, the one j bytes
    back shifted left by j, built up by doubling."""
    h, have = GEAR[data], 1
    while have < 32:
        older = h[:-have] << np.uint32(have) if len(h) > have else h[:0]
        h = h.copy()
        h[have:] += older
        have *= 2
    return h


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = gear(data).astype(np.int64)
    edge = np.full(REACH, -1)                          # no cut within REACH of an end
    least, have = np.concatenate((edge, h, edge)), 1
    while have < 2 * REACH + 1:
        step = min(have, 2 * REACH + 1 - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = np.flatnonzero(least == h) + 1
    ends = [0]
    for e in [*at.tolist(), n]:                        # equal least values: the first one counts
        if e != n and e - ends[-1] <= REACH:
            continue
        while e - ends[-1] > MOST:
            ends.append(ends[-1] + MOST)
        if e > ends[-1]:
            ends.append(e)
    return np.array(ends[1:])


CHUNKS = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()),
                    ("start", pa.int64()), ("end", pa.int64())])


def chunk_rows(texts: DataFrame, shortest: int = REACH + 1) -> DataFrame:
    """(d1, d2, doc, tag, start, end) of each chunk that can be a copy."""
    def run(batches):
        for rows in C.rows_of(batches, "doc", "tag", "text"):
            for doc, tag, text in rows:
                data = C.utf8(text)
                end = cuts(data)
                start = np.concatenate(([0], end[:-1])) if len(end) else end
                wide = end - start >= shortest
                start, end = start[wide], end[wide]
                if len(end):
                    d = [C.range_hash(C.prefix_hash(data, t), start, end).view(np.int64) for t in (C.BYTE, SECOND)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                        *d, np.full(len(end), doc), np.full(len(end), tag), start, end)], schema=CHUNKS)
    return texts.select("doc", "tag", "text").mapInArrow(
        run, "d1 long, d2 long, doc long, tag long, start long, `end` long")


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep_bytes: bool = False, shortest: int = REACH + 1) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row."""
    src = C.ordered_texts(docs, id_col, text_col)
    rows = C.settle(chunk_rows(src, shortest), "chunks")
    twice = C.settle(rows.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1"), "chunk-twice")
    copies = C.settle(rows.join(twice, "d1"), "chunk-copies")
    C.release(rows, twice)
    first = copies.groupBy("d1", "d2").agg(F.min(F.struct("doc", "tag", "start")).alias("first"),
                                           F.count("*").alias("n"))
    first = C.settle(first.where("n > 1").drop("n"), "chunk-first")
    late = copies.join(first, ["d1", "d2"]).where(F.struct("doc", "tag", "start") > F.col("first"))
    ranges = C.settle(late.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "chunk-ranges")
    C.release(copies, first)
    return C.cut_out(src, ranges, keep_bytes)
