"""Ranked lexical search with norm buckets.

A document's impact vector has one coordinate per query term, weight times
term-frequency impact; a query's has the numbers of its terms; a score is their
inner product.

1. One pass over the whole texts gives each document's number of terms and its
   hits: the query terms it holds, with their frequencies.  Statistics (N, L, df)
   are aggregates over all documents.
2. Impact vectors are ordered by length inside each partition (a local sort, no
   shuffle) and cut into buckets of neighbours, the longest first.
3. A bucket is skipped for a query when length of the query times the greatest
   length in the bucket stays below the query's k-th best score so far
   (Cauchy-Schwarz).  Inside a bucket the same bound gives the least cosine a
   document needs; documents whose coordinates at the query's ``FOCUS`` greatest
   ones do not allow it are skipped.  Survivors are scored in 64-bit integers.
4. Each task returns its k best documents per query, and a window over these
   ranks them.  To begin with, the k-th best score among ``FIRST`` of the longest
   vectors of the corpus is a bound for all tasks (any documents' scores are one).

Terms are compared by 64-bit hashes.  Queries are taken in blocks of up to
``BLOCK`` bytes of text (or one longer text), so that what is broadcast and the
vocabulary whose frequencies reach the driver are bounded; each block is
searched in all documents.

Defined results: documents without terms, with null or empty texts, count for
nothing and are never found; queries without terms give no rows; query rows
that share id and text are one query, those that share the id alone are ranked
one by one; repeated document rows are further documents; equal scores are
ordered by id, nulls last; empty tables give no rows; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

K = 10
BUCKET = 2048
FOCUS = 4
FIRST = 1024
BLOCK = 1 << 20
CHUNK = 1 << 20                # bytes of text hashed at once (or one longer text)
TERM = np.ones(256, bool)      # bytes of terms: digits, letters and all of non-ASCII
TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
SAFE = 1e-9                    # bounds are relaxed by this share for rounding


def term_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each term of several texts that stand one after the
    other in ``data``; ``starts``: where each begins, and the end of the last."""
    inside = TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = starts[(starts > 0) & (starts < len(data))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, C.U64)
    size = b - a
    p, _ = C.powers(int(size.max()) + 1)
    at = np.flatnonzero(inside)
    begin = np.cumsum(size) - size
    value = C.BYTE_LOWER[data[at]] * p[np.arange(len(at)) - np.repeat(begin, size)]
    h = C.mix(np.add.reduceat(value, begin) + size.astype(C.U64))
    return np.searchsorted(starts, a, "right") - 1, h


def chunks_of(texts: list) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first, bytes, starts) of stretches of texts of about CHUNK bytes."""
    out, held, size, first = [], [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "replace")
        held.append(b)
        size += len(b)
        if size >= CHUNK or i == len(texts) - 1:
            starts = np.concatenate(([0], np.cumsum([len(x) for x in held])))
            out.append((first, np.frombuffer(b"".join(held), np.uint8), starts))
            held, size, first = [], 0, i + 1
    return out


class Queries:
    """A block of queries over its sorted vocabulary of term hashes."""

    def __init__(self, rows: list[tuple]):
        found = []
        for _, text in rows:
            data = C.utf8(text)
            found.append(np.unique(term_hashes(data, np.array([0, len(data)]))[1], return_counts=True))
        self.ids = [i for i, _ in rows]
        self.vocabulary = np.unique(np.concatenate([h for h, _ in found])) if found else np.zeros(0, C.U64)
        self.terms = [np.searchsorted(self.vocabulary, h) for h, _ in found]
        self.times = [n.astype(np.int64) for _, n in found]


HITS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])


def hit_rows(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, terms, tf) of each document: its number of terms, and the
    query terms that it holds with their frequencies."""
    def run(batches):
        vocabulary = shared.value
        for rows in C.rows_of(batches, "doc_id", "text", chunk=1024):
            for first, data, starts in chunks_of([t for _, t in rows]):
                size = len(starts) - 1
                text, h = term_hashes(data, starts)
                n = np.bincount(text, minlength=size)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = vocabulary[at] == h
                key, tf = np.unique(text[hit] * len(vocabulary) + at[hit], return_counts=True)
                off = np.searchsorted(key, np.arange(size + 1) * len(vocabulary)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([d for d, _ in rows[first:first + size]], pa.int64()), pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(off), pa.array((key % len(vocabulary)).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(tf.astype(np.int64)))], schema=HITS)
    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


class Vectors:
    """Impact vectors of some documents as term-sorted postings."""

    def __init__(self, ids, norms, off, terms, impacts):
        self.ids, self.norms = ids, norms
        row = np.repeat(np.arange(len(ids)), np.diff(off))
        order = np.argsort(terms, kind="stable")
        self.row, self.impact = row[order], impacts[order]
        self.term, first = np.unique(terms[order], return_index=True)
        self.first = np.append(first, len(terms))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        i = int(np.searchsorted(self.term, term))
        if i == len(self.term) or self.term[i] != term:
            return self.row[:0], self.impact[:0]
        s = slice(self.first[i], self.first[i + 1])
        return self.row[s], self.impact[s]


class Best:
    """The k best documents of each query so far, and the score to reach."""

    def __init__(self, queries: Queries, weights: np.ndarray, bound: np.ndarray, k: int):
        self.k, self.bound = k, bound.copy()
        self.top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries.ids)
        self.queries = []
        for terms, times in zip(queries.terms, queries.times):
            keep = weights[terms] > 0
            terms, times = terms[keep], times[keep]
            order = np.lexsort((-weights[terms], -times))      # the focus coordinates come first
            self.queries.append((terms[order], times[order], float(np.sqrt((times.astype(np.float64)**2).sum()))))

    def add(self, v: Vectors) -> None:
        """One bucket of vectors for all queries."""
        longest = float(v.norms.max())
        for q, (terms, times, length) in enumerate(self.queries):
            need = max(1, int(self.bound[q]))
            if not len(terms) or length * longest * (1 + SAFE) < need:
                continue                               # Cauchy-Schwarz: nobody here can reach it
            alive = self.within(v, terms, times, length, need)
            if not alive.any():
                continue
            score = np.zeros(len(v.ids), np.int64)
            for t, times_ in zip(terms.tolist(), times.tolist()):
                row, impact = v.postings(t)
                score[row] += times_ * impact
            at = np.flatnonzero(alive & (score >= need))
            if len(at):
                self.offer(q, v.ids[at], score[at])

    @staticmethod
    def within(v: Vectors, terms, times, length: float, need: int) -> np.ndarray:
        """Which vectors can reach the cosine that ``need`` asks for, by their
        focus coordinates one after the other: what these give, and at most
        the product of both lengths in the coordinates left."""
        cos = need / (length * v.norms) - SAFE
        alive = cos <= 1
        dot, own, asked = np.zeros(len(v.ids)), np.ones(len(v.ids)), 1.0
        for t, n in zip(terms[:FOCUS].tolist(), times[:FOCUS].tolist()):
            x, q = np.zeros(len(v.ids)), n / length
            row, impact = v.postings(t)
            x[row] = impact / v.norms[row]
            dot += x * q
            own, asked = np.maximum(own - x * x, 0), max(asked - q * q, 0.0)
            alive &= dot + np.sqrt(own * asked) + SAFE >= cos
            if not alive.any():
                break
        return alive

    def offer(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        ids, score = np.concatenate((self.top[q][0], ids)), np.concatenate((self.top[q][1], score))
        order = np.lexsort((ids, -score))[:self.k]
        self.top[q] = ids[order], score[order]
        if len(order) == self.k:
            self.bound[q] = max(self.bound[q], int(score[order[-1]]))


NULL_ID = np.iinfo(np.int64).max                       # null ids come last


def impacts_of(rows: list[tuple], weights: np.ndarray, n_docs: int, n_terms: int):
    """(ids, norms, off, terms, impacts) from (doc_id, n, terms, tf) rows."""
    m = np.array([100 - 75 + (75 * n * n_docs) // n_terms for _, n, *_ in rows], np.int64)
    off = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows])))
    terms = np.concatenate([np.asarray(r[2], np.int64) for r in rows])
    tf = np.concatenate([np.asarray(r[3], np.int64) for r in rows])
    impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(off))))
    norms = np.sqrt(np.add.reduceat(impact.astype(np.float64)**2, off[:-1]))
    ids = np.array([NULL_ID if r[0] is None else r[0] for r in rows], np.int64)
    return ids, norms, off, terms, impact


def _search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame | None:
    """(q, doc_id, score): each task's best documents for a block of queries."""
    spark = docs.sparkSession
    queries = Queries(items)
    size = len(queries.vocabulary)
    if not size:
        return None
    hits = C.settle(hit_rows(docs, spark.sparkContext.broadcast(queries.vocabulary)), "search-hits")
    total = hits.where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    if not total.n:
        return None
    n_docs, n_terms = int(total.n), int(total.l)
    frequency = hits.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2)) / (2 * F.col("df") + 1))).alias("w")
    weights = np.zeros(size, np.int64)
    for r in frequency.select("t", weight).collect():  # at most the block's vocabulary
        weights[r.t] = r.w
    plan = spark.sparkContext.broadcast((queries, weights, n_docs, n_terms))
    found = hits.where(F.size("terms") > 0)

    def with_norms(batches):
        _, w, n, length = plan.value
        schema = pa.schema([*HITS, ("norm", pa.float64())])
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                t = b.slice(i, 4096)
                rows = next(C.rows_of([t], "doc_id", "n", "terms", "tf", chunk=4096))
                norms = impacts_of(rows, w, n, length)[1]
                yield pa.RecordBatch.from_arrays([*(t.column(c) for c in HITS.names), pa.array(norms)], schema=schema)
    vectors = C.settle(found.mapInArrow(
        with_norms, "doc_id long, n long, terms array<int>, tf array<long>, norm double").where("norm > 0"), "search-vectors")
    # lengths by class (16 to a doubling: a few hundred rows), then FIRST of the vectors in the highest ones
    length = F.floor(16 * F.log2("norm"))
    have, least = 0, None
    for r in sorted(vectors.groupBy(length.alias("c")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if have < FIRST:
            have, least = have + r.n, r.c
    longest = vectors.where(length >= least).limit(FIRST).collect() if have else []
    bound = np.zeros(len(items), np.int64)
    if longest:
        best = Best(queries, weights, bound, k)
        for i in range(0, len(longest), BUCKET):
            best.add(Vectors(*impacts_of(longest[i:i + BUCKET], weights, n_docs, n_terms)))
        bound = best.bound
    bounds = spark.sparkContext.broadcast(bound)

    def search(batches):
        q, w, n, length = plan.value
        best = Best(q, w, bounds.value, k)
        for rows in C.rows_of(batches, "doc_id", "n", "terms", "tf", chunk=BUCKET):
            best.add(Vectors(*impacts_of(rows, w, n, length)))
        out = [(i, None if d == NULL_ID else d, s) for i, (ids, score) in enumerate(best.top)
               for d, s in zip(ids.tolist(), score.tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["q", "doc_id", "score"])
    rows = vectors.sortWithinPartitions(F.col("norm").desc()).select("doc_id", "n", "terms", "tf")
    top = rows.mapInArrow(search, "q long, doc_id long, score long")
    place = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = top.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(queries.ids)], "q long, item_id long")
    out = C.settle(top.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"), "search-top")
    C.release(hits, vectors)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each
    query with a score above 0."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("i"), F.col(query_col).alias("t")).where(
        "t is not null").distinct().orderBy("i", "t")
    parts, held, size = [], [], 0

    def flush():
        got = _search_block(src, held, k) if held else None
        if got is not None:
            parts.append(got)
    for r in asked.toLocalIterator():                  # the driver holds one block of queries
        if held and size + len(r.t) > BLOCK:
            flush()
            held, size = [], 0
        held.append((r.i, r.t))
        size += len(r.t)
    flush()
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
g AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM f, g GROUP BY term, nd),
q AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT item_id, f.doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN d ON d.doc_id = f.doc_id, g
  GROUP BY item_id, f.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
