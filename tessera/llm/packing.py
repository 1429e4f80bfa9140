"""Packing documents into sequences by cutting-stock column generation.

A document is its token ids and an end id.  Stretches of ``CAPACITY`` ids from
its start fill a sequence each; what is left is one more piece.  Pieces are
counted by length class (``UNIT`` tokens wide, rounded up), so the problem has
at most ``CAPACITY / UNIT`` kinds of items, whatever the corpus.

1. Linear program over patterns (how many pieces of each class share a
   sequence): minimise the sequences that cover the histogram.  It starts from
   greedy patterns; further columns are generated: the duals of the current basis price the classes, an unbounded
   knapsack by dynamic programming finds the best pattern, and it enters by a
   simplex step, until the duals prove that at most a share ``GAP`` of the
   sequences, or half a one, could still be saved.
2. Patterns are used as often as the solution says, rounded down; the pieces
   left over (at most a few per class) are put together first-fit decreasing.
3. The pieces of a class are ranked, and the patterns' places of that class are
   given out by rank.  A rank is a place in a salted group (``GROUP`` pieces on
   average) plus the number of pieces in earlier groups, so a class that holds
   most of the corpus is ranked by many tasks.
4. Places of pieces inside a sequence come from running sums of their lengths;
   a sequence holds at most ``CAPACITY / UNIT`` pieces.

What reaches the driver is the histogram (at most 512 rows), and what it sends
out are the patterns (at most two per class and the rounding's rest).  A piece
wastes less than ``UNIT`` tokens, 0.5 % of a sequence with six documents.

Tokens: white space never joins two tokens of the tokenizer at hand (it splits
there before merging, as it does between letters, digits and signs), so each
distinct run of characters between spaces or line ends is put together from its
parts, which the library encodes once per worker; both are remembered
(``KEPT_WORDS``).  Ids equal the library's on the whole text.

Sequences are padded to ``CAPACITY``, but for those whose length is a power of
two.

Defined results: a null or empty text is its end id alone; rows are packed as
they come, so repeated rows are packed repeatedly; a null id stays null; an
empty table gives no rows; other columns are not read.  Texts are encoded whole.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
MAX_MODEL_BYTES = 64 << 20     # a tokenizer file is broadcast up to this size
CAPACITY = 4096
UNIT = 8
END = 2
PAD = 0
GROUP = 1 << 14
GAP = 1e-4
STEPS = 6000                   # simplex steps at most; any basis on the way is feasible
KEPT_WORDS = 1 << 19           # runs between spaces, and parts of them, remembered per worker
# The parts that the tokenizer splits an ASCII run into, after lowering it; merges stay inside a part.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"      # ASCII signs but the apostrophe, <, >


# ---- the linear program, on the driver, of fixed size ----

def knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best value of any number of items of each size, and their numbers."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), "right")
    for w in range(1, room + 1):
        total = best[w - sizes[:upto[w]]] + values[:upto[w]]
        best[w] = best[w - 1]                          # a unit left empty
        if len(total) and total.max() > best[w] + 1e-12:
            last[w] = total.argmax()
            best[w] = total[last[w]]
    count, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            count[last[w]] += 1
            w -= sizes[last[w]]
    return float(best[room]), count


def greedy_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis, and how often its patterns are used: the pattern that
    takes the greatest classes first, until one of its classes is used up, then
    the same without that class.  Each pattern ends another class, so the
    columns, in that order, are triangular."""
    m = len(sizes)
    columns, x, left, active = np.zeros((m, m)), np.zeros(m), demand.astype(np.float64), list(range(m - 1, -1, -1))
    while active:
        free, pattern = room, np.zeros(m)
        for i in active:
            pattern[i] = free // sizes[i]
            free -= int(pattern[i]) * sizes[i]
        used = np.flatnonzero(pattern)
        ratio = left[used] / pattern[used]
        out = used[ratio.argmin()]
        x[out], columns[:, out] = ratio.min(), pattern
        left = np.maximum(left - x[out] * pattern, 0)
        active.remove(out)
    return columns, x


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse, by elimination in plain NumPy: threads of a linear algebra
    library can wait for each other for ever in a driver that has forked."""
    n = len(a)
    both = np.concatenate((a, np.eye(n)), 1)
    for i in range(n):
        p = i + int(np.abs(both[i:, i]).argmax())
        if p != i:
            both[[i, p]] = both[[p, i]]
        both[i] /= both[i, i]
        others = both[:, i].copy()
        others[i] = 0
        rows = np.flatnonzero(others)
        both[rows] -= others[rows, None] * both[i]
    return both[:, n:]


def times_vector(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", a, x)


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each is used) that cover the demand of
    each size in sequences of ``room``: the simplex method on the columns that
    the knapsack prices below zero."""
    m = len(sizes)
    exact = demand
    # ties between classes would let steps of length zero follow each other for ever
    demand = demand + 1e-3 * np.random.Generator(np.random.PCG64(1)).random(m)
    columns, x = greedy_basis(sizes, demand, room)
    inverse, bound = inverted(columns), 0.0
    for step in range(STEPS):
        if step % 256 == 255:                          # against the drift of repeated updates
            inverse = inverted(columns)
            x = np.maximum(times_vector(inverse, demand), 0)
        duals = inverse.sum(0)
        value, count = knapsack(sizes, duals, room)
        # prices under which no pattern is worth more than 1 bound the sequences from below
        bound = max(bound, float((np.maximum(duals, 0) * demand).sum()) / max(value, 1.0))
        if value <= 1 + 1e-9 or x.sum() <= max(bound * (1 + GAP), bound + 0.5):
            break
        entering = times_vector(inverse, count.astype(np.float64))
        ok = entering > 1e-9
        ratio = np.full(m, np.inf)
        ratio[ok] = x[ok] / entering[ok]
        out = int(ratio.argmin())
        t = ratio[out]
        x = np.maximum(x - t * entering, 0)
        x[out] = t
        columns[:, out] = count
        row = inverse[out] / entering[out]
        inverse = inverse - np.outer(entering, row)
        inverse[out] = row
    return np.rint(columns).astype(np.int64), np.maximum(times_vector(inverted(columns), exact.astype(np.float64)), 0)


def patterns(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each class, sequences)] that hold the histogram exactly."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes.tolist()])
    columns, x = column_generation(sizes, demand.astype(np.float64), room)
    out, left = [], demand.copy()
    for j in np.argsort(-x, kind="stable"):
        used = columns[:, j] > 0
        times = min(int(x[j] + 1e-6), int((left[used] // columns[used, j]).min()))
        if times > 0:
            out.append(({int(s): int(a) for s, a in zip(sizes[used], columns[used, j])}, times))
            left -= times * columns[:, j]
    # first-fit decreasing on the few pieces of each class that are left
    open_: list[list] = []                             # [room, pieces]
    for i in range(len(sizes) - 1, -1, -1):
        n, s = int(left[i]), int(sizes[i])
        for seq in open_:
            k = min(n, seq[0] // s)
            if k:
                seq[1][s] = k
                seq[0] -= k * s
                n -= k
        while n > 0:
            k = min(n, room // s)
            open_.append([room - k * s, {s: k}])
            n -= k
    return out + [(p, 1) for _, p in open_]


def places(found: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank after the last, pieces a sequence, first
    sequence) of each pattern's places."""
    out, at, seq = [], {}, 0
    for pattern, times in found:
        for c, a in pattern.items():
            first = at.get(c, 0)
            out.append((c, first, first + a * times, a, seq))
            at[c] = first + a * times
        seq += times
    return out


# ---- tokens ----

class Tokens:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_buffer(model)
        self.known: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}

    def part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            got = np.array(self.model.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
            if len(self.parts) < KEPT_WORDS and len(part) <= 64:
                self.parts[part] = got
        return got

    def word(self, word: str) -> bytes:
        """Ids of a run of characters between spaces."""
        if "<|" in word:                               # may hold a special token
            got = self.part(word)
        elif word.isascii():
            got = b"".join([self.part(p) for p in PARTS.findall(word.lower())])
        else:
            core = word.rstrip(SIGNS)                  # signs after a Latin letter are a part of their own
            last = core[-1].lower()
            plain = len(last) == 1 and last < "\u0250" and last.isalpha()
            got = self.part(core) + self.part(word[len(core):]) if plain else self.part(word)
        if len(self.known) < KEPT_WORDS and len(word) <= 64:
            self.known[word] = got
        return got

    def encode(self, text: str | None) -> bytes:
        known, word = self.known, self.word
        return b"".join([known[w] if w in known else word(w)
                         for w in (text or "").encode("utf-8", "replace").decode().replace("\n", " ").split(" ")])


_TOKENS: list = []


def _tokens(shared) -> Tokens:
    """The worker's encoder of a broadcast tokenizer file."""
    if not _TOKENS or _TOKENS[0] != shared.value:
        _TOKENS[:] = [shared.value, Tokens(shared.value)]
    return _TOKENS[1]


def load(spark: SparkSession, path: str):
    """A tokenizer file as a broadcast of checked size."""
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} has over {MAX_MODEL_BYTES} bytes")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


PIECE = [("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
         ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
           capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, tag, start, length, ids_crc32, doc_tokens[, ids]) of each piece;
    the tag, a hash of the text, tells rows that share an id apart."""
    shared = load(docs.sparkSession, tokenizer)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"),
                      F.col(text_col).alias("text"))
    schema = pa.schema([*PIECE, *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        enc = _tokens(shared)
        for rows in C.rows_of(batches, "doc_id", "tag", "text"):
            out = []
            for doc, tag, text in rows:
                ids = enc.encode(text) + end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s:4 * (s + capacity)]
                    out.append((doc, tag, s, len(part) // 4, zlib.crc32(part), n,
                                *([np.frombuffer(part, "<i4")] if keep_ids else [])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return src.mapInArrow(run, "doc_id long, tag long, start long, length long, ids_crc32 long, doc_tokens long"
                          + (", ids array<int>" if keep_ids else ""))


def assign(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (a settled frame with doc_id, tag, start, length) with
    sequence_id and offset."""
    spark = found.sparkSession
    unit = next(u for u in range(min(UNIT, capacity), 0, -1) if capacity % u == 0)
    rows = found.withColumn("c", F.ceil(F.col("length") / unit).cast("int"))
    histogram = {r.c: r.n for r in rows.groupBy("c").agg(F.count("*").alias("n")).collect()}
    table = places(patterns(histogram, capacity // unit))
    kinds = spark.createDataFrame([(c, -(-n // GROUP)) for c, n in histogram.items()], "c int, groups long")
    table = spark.createDataFrame(table, "c int, first long, after long, each long, seq long")
    # at most capacity / UNIT classes, and a few patterns with each of them
    rows = rows.join(F.broadcast(kinds), "c").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "tag", "start"), F.col("groups"))).drop("groups")
    counts = rows.groupBy("c", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("c").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("c", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("c", "salt").orderBy(F.col("length").desc(), "doc_id", "tag", "start")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["c", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("begin")).drop("begin", "salt").join(
        F.broadcast(table).withColumnRenamed("c", "pc"),
        (F.col("c") == F.col("pc")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")))
    at = F.col("rank") - F.col("first")
    ranked = ranked.withColumn("sequence_id", F.col("seq") + F.floor(at / F.col("each"))).withColumn(
        "slot", at % F.col("each"))
    upto = Window.partitionBy("sequence_id").orderBy(F.col("c").desc(), "slot").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("offset", F.coalesce(F.sum("length").over(upto), F.lit(0))).select(
        *found.columns, "sequence_id", "offset")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
         capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, tag, start, length, ids_crc32, doc_tokens[, ids], sequence_id,
    offset) of each piece."""
    found = C.settle(pieces(docs, id_col, text_col, tokenizer, capacity, keep_ids), "packing-pieces")
    return assign(found, capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad: int = PAD) -> DataFrame:
    """(sequence_id, n_tokens, ids): the padded sequences of ``pack`` with
    ``keep_ids``.  A sequence is one row of at most ``capacity`` ids."""
    rows = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x.ids)).alias("ids"))
    n = F.col("n_tokens")
    missing = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(F.lit(capacity) - n).cast("int")
    return rows.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad), missing)))
