"""Grouping spelling variants with k-d trees over letter counts.

Words are counted over the whole corpus (partial counts per task, then one sum
per word).  Two words are near when they differ by one inserted, deleted or
replaced letter.  An insertion changes one letter's count by one, a replacement
two letters' by one each: so near words of equal length have letter-count
vectors at L1 distance 2, those whose lengths differ by one at distance 1.  The
vectors have ``DIMS`` coordinates: a to z, and the other letters folded into the
rest, which can only lower distances.

1. For each length a k-d tree over the count vectors of the words of that length
   cuts space into cells: median splits of the most spread letter, planned on a
   bounded sample (about ``SAMPLE`` words by hash; it only shapes the cells).
   Lengths with up to ``SHARD`` words have one cell.
2. A word belongs to one cell of its length.  It asks the cells of the next
   smaller length whose box lies within the distance, and of its own length those
   that come after its cell in order; what it finds there counts for both words.
   It asks its own cell for itself.  A cell with more than ``SHARD`` words (anagrams cannot be split) is dealt to
   several tasks by hash, and the questions go to each.
3. Inside a cell a k-d tree with tight boxes is searched for batches of words:
   at each node the words whose distance from the box is too great are dropped;
   at a leaf the counts are compared, and the order of letters is verified.
4. A cell returns, per word, how many near words were found and the most
   frequent of them, never pairs; sums and maxima over the cells follow.
5. A form has at least twice the count of its word, so chains of forms are at
   most log2(n) long; roots come from pointer doubling, joins only.

Defined results: null and empty texts have no words; a null id is written as the
empty string before the colon; repeated rows count repeatedly; words are distinct, so there are no ties
but in counts, where the smallest word in code-point order wins; empty tables
give no rows; other columns are not read.  Words of any length are taken whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

SHORTEST = 5
LEAST = 3
DROP = 97                      # one run in so many loses a letter
SHARD = 4096
SAMPLE = 4096
CELLS = 1024
LEAF = 24
HELD = 1 << 18                 # words counted in a task before they are sent on
ASKED = 8192                   # words searched for together
DATA, ASKER, BOTH = 0, 1, 2    # rows of a cell: its words; questions that count for the asking word, or for both words
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)
LETTER = np.zeros(256, np.int64)                       # the coordinate of a letter's code point
DIMS = 32
LETTER[97:123] = np.arange(26)
LETTER[0xC0:0x100] = 26 + np.arange(64) % (DIMS - 26)
MOST = 8192                    # counts above are taken as this


# ---- counting ----

def words_of(doc_id, text) -> Counter:
    """The words of a document, after deletions, with their numbers."""
    text = (text or "").encode("utf-8", "replace").translate(LOWER).decode()
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        h = zlib.crc32(run.encode(), prefix)
        if h % DROP == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
            if len(run) < SHORTEST:
                continue
        out[run] += n
    return out


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that occur often enough."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        held: Counter = Counter()

        def sent():
            for i in range(0, len(items := list(held.items())), 1 << 16):
                w, n = zip(*items[i:i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])
        for rows in C.rows_of(batches, "doc_id", "text"):
            for doc, text in rows:
                held.update(words_of(doc, text))
            if len(held) >= HELD:
                yield from sent()
                held.clear()
        yield from sent()
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


# ---- trees ----

def counts_of(words: list[str]) -> np.ndarray:
    """Letter-count vectors, one row per word."""
    size = np.array([len(w) for w in words])
    letters = LETTER[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    out = np.bincount(np.repeat(np.arange(len(words)), size) * DIMS + letters, minlength=len(words) * DIMS)
    return np.minimum(out, MOST).astype(np.int16).reshape(-1, DIMS)


def split(x: np.ndarray) -> tuple[int, int] | None:
    """(letter, count) that cuts points in two halves by count <= and >, as
    even as possible, at the letter with the widest spread of the most varied
    ones; None when all points are equal."""
    spread = x.max(0) - x.min(0)
    if not spread.any():
        return None
    best = None
    for d in np.argsort(-x.var(0), kind="stable")[:4].tolist():
        if spread[d]:
            v = np.sort(x[:, d])
            for s in {int(v[(len(v) - 1) // 2]), int(v[(len(v) - 1) // 2]) - 1}:
                left = int(np.searchsorted(v, s, "right"))
                if 0 < left < len(v) and (best is None or abs(2 * left - len(v)) < best[0]):
                    best = (abs(2 * left - len(v)), d, s)
    if best is None:
        d = int(spread.argmax())
        return d, int(x[:, d].min())
    return best[1], best[2]


class Cells:
    """A k-d tree that cuts space into numbered cells by split planes."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list = []                          # (letter, count, left, right) or a cell's number
        self.n = 0
        self._grow(sample, cells)

    def _grow(self, x: np.ndarray, cells: int) -> int:
        at = len(self.nodes)
        cut = split(x) if cells > 1 and len(x) > 1 else None
        if cut is None:
            self.nodes.append(self.n)
            self.n += 1
            return at
        self.nodes.append(None)
        left = x[:, cut[0]] <= cut[1]
        self.nodes[at] = (*cut, self._grow(x[left], cells - cells // 2), self._grow(x[~left], cells // 2))
        return at

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        return self.near(x, 0)[1]

    def near(self, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) for all cells whose box is within an L1 distance."""
        points, cells = [], []
        # node, points, their distance so far, and its share by letter that was crossed
        stack = [(0, np.arange(len(x)), np.zeros(len(x), np.int64), {})]
        while stack:
            at, own, far, crossed = stack.pop()
            node = self.nodes[at]
            if not isinstance(node, tuple):
                points.append(own)
                cells.append(np.full(len(own), node))
                continue
            d, s, left, right = node
            v, before = x[own, d], crossed.get(d)
            before = np.zeros(len(own), np.int64) if before is None else before
            for child, miss in ((left, v - s), (right, s + 1 - v)):
                share = np.maximum(before, miss)
                total = far + share - before
                keep = total <= reach
                if keep.any():
                    stack.append((child, own[keep], total[keep], {k: c[keep] for k, c in {**crossed, d: share}.items()}))
        points, cells = np.concatenate(points), np.concatenate(cells)
        order = np.argsort(points, kind="stable")
        return points[order], cells[order]


def ranks(words, n: np.ndarray) -> np.ndarray:
    """Places in the order of falling n, equal ones in code-point order."""
    out = np.empty(len(words), np.int64)
    out[np.lexsort((np.array(words), -n))] = np.arange(len(words))
    return out


class Tree:
    """A k-d tree over the words of one length, with tight boxes."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n, self.x = words, n, counts_of(words)
        self.bytes = np.array([list(w.encode("latin-1")) for w in words], np.uint8)
        self.rank = ranks(words, n)

    def search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index into words, index of a near word of the tree) pairs; all words
        have one length."""
        q = counts_of(words)
        asked = np.array([list(w.encode("latin-1")) for w in words], np.uint8)
        reach = 2 if asked.shape[1] == self.bytes.shape[1] else 1
        a, b = [], []
        stack = [(np.arange(len(self.words)), np.arange(len(words)))]
        while stack:
            points, who = stack.pop()
            x = self.x[points]
            lo, hi = x.min(0), x.max(0)
            own = q[who]
            who = who[(own - np.clip(own, lo, hi) != 0).sum(1) <= reach]       # cheap: letters outside
            if len(who):
                own = q[who]
                who = who[np.abs(own - np.clip(own, lo, hi)).sum(1) <= reach]
            if not len(who):
                continue
            cut = split(x) if len(points) > LEAF else None
            if cut is not None:
                left = x[:, cut[0]] <= cut[1]
                stack += [(points[left], who), (points[~left], who)]
                continue
            for lo in range(0, len(points), 256):
                some = points[lo:lo + 256]
                far = np.zeros((len(who), len(some)), np.int16)
                x, own = self.x[some], q[who]
                for d in np.flatnonzero(x.any(0) | own.any(0)):
                    far += np.minimum(np.abs(own[:, d, None] - x[:, d]), 8)
                i, j = np.nonzero(far <= reach)
                i, j = who[i], some[j]
                ok = one_edit(asked[i], self.bytes[j])
                a.append(i[ok])
                b.append(j[ok])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one edit; all of a, and all of b, have
    one length."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    if a.shape[1] < b.shape[1]:
        a, b = b, a
    n = b.shape[1]
    ahead = np.logical_and.accumulate(a[:, :n] == b, 1).sum(1)
    behind = np.logical_and.accumulate((a[:, 1:] == b)[:, ::-1], 1).sum(1)
    return ahead + behind >= n


# ---- the operator ----

def plan(words: DataFrame) -> dict[int, Cells]:
    """The cells of each length that has more than SHARD words."""
    sizes = {r.len: r.n for r in words.groupBy("len").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).collect()}
    if not sizes:
        return {}
    share = F.coalesce(*[F.when(F.col("len") == k, F.lit(SAMPLE / n)) for k, n in sorted(sizes.items())])
    picked = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share * (1 << 20)).select("len", "word").collect()
    found: dict[int, list] = {}
    for r in sorted(picked):
        found.setdefault(r.len, []).append(r.word)
    return {k: Cells(counts_of(found[k]), min(CELLS, -(-2 * sizes[k] // SHARD))) for k in found}


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): the number of near words, and the most frequent as
    (-n, word), of each word that has any; ``words`` (word, n, len) settled."""
    cells = words.sparkSession.sparkContext.broadcast(plan(words))

    def by_length(rows):
        out: dict[int, list] = {}
        for w, n, k in rows:
            out.setdefault(k, []).append((w, n))
        return out.items()

    def homes(batches):
        for rows in C.rows_of(batches, "word", "n", "len", chunk=4096):
            for k, own in by_length(rows):
                tree = cells.value.get(k)
                cell = tree.home(counts_of([w for w, _ in own])) if tree else np.zeros(len(own), np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([w for w, _ in own]), pa.array([n for _, n in own], pa.int64()),
                    pa.array([k] * len(own), pa.int32()), pa.array(cell, pa.int32())], names=["word", "n", "len", "cell"])

    def questions(batches):
        for rows in C.rows_of(batches, "word", "n", "len", chunk=4096):
            for k, own in by_length(rows):
                x = counts_of([w for w, _ in own])
                for target, reach in ((k - 1, 1), (k, 2)):
                    tree = cells.value.get(target)
                    i, cell = tree.near(x, reach) if tree else (np.arange(len(own)), np.zeros(len(own), np.int64))
                    asks = np.full(len(i), BOTH)
                    if target == k:
                        home = tree.home(x)[i] if tree else cell
                        asks[cell == home] = ASKER
                        i, cell, asks = i[cell >= home], cell[cell >= home], asks[cell >= home]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([own[j][0] for j in i.tolist()], pa.string()), pa.array([own[j][1] for j in i.tolist()], pa.int64()),
                        pa.array([target] * len(i), pa.int32()), pa.array(cell, pa.int32()), pa.array(asks, pa.int32())],
                        names=["word", "n", "len", "cell", "asks"])
    src = words.select("word", "n", "len")
    home = C.settle(src.mapInArrow(homes, "word string, n long, len int, cell int"), "spelling-homes")
    sizes = home.groupBy("len", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    sizes = C.settle(sizes, "spelling-sizes")
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    data = home.join(sizes, ["len", "cell"]).select("len", "cell", part.alias("part"), F.lit(DATA).alias("asks"), "word", "n")
    asks = src.mapInArrow(questions, "word string, n long, len int, cell int, asks int").join(sizes, ["len", "cell"]).select(
        "len", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "asks", "word", "n")
    rows = data.unionByName(asks).repartition("len", "cell", "part").sortWithinPartitions(
        "len", "cell", "part", "asks", F.length("word"))

    def told(a, words_a, b, words_b, n_b, rank_b):
        """Per word of a that was found with words of b: how many, and the most frequent."""
        order = np.lexsort((rank_b[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        return pa.RecordBatch.from_arrays([
            pa.array([words_a[j] for j in a[first].tolist()]), pa.array(np.diff(np.append(first, len(a))), pa.int64()),
            pa.array(n_b[b[first]], pa.int64()), pa.array([words_b[j] for j in b[first].tolist()])],
            names=["word", "n_near", "form_n", "form"])

    def answers(tree, asked, both):
        for i in range(0, len(asked), ASKED):
            some = asked[i:i + ASKED]
            for size in sorted({len(w) for w, _ in some}):
                words, n = zip(*[x for x in some if len(x[0]) == size])
                a, b = tree.search(words)
                if not len(a):
                    continue
                yield told(a, words, b, tree.words, tree.n, tree.rank)
                if both:
                    yield told(b, tree.words, a, words, np.array(n), ranks(words, np.array(n)))

    def run(batches):
        at, held, tree = None, [], None                # the cell at hand, its words, its tree
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:]):
                cell = tuple(key[:3, s].tolist())
                own = list(zip(b.column(4).slice(s, e - s).to_pylist(), b.column(5).slice(s, e - s).to_pylist()))
                if cell != at:
                    at, held, tree = cell, [], None
                if key[3, s] == DATA:
                    held += own
                    continue
                if tree is None:
                    tree = Tree([w for w, _ in held], np.array([n for _, n in held]))
                yield from answers(tree, own, key[3, s] == BOTH)
    found = rows.mapInArrow(run, "word string, n_near long, form_n long, form string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("neg"), "form")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; ``forms`` (word, form), where
    chains end.  Each round doubles the length of the chains followed."""
    now = C.settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = C.settle(now.join(up, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = not new.where("moved").isEmpty()
        C.release(now)
        now = new.select("word", "root")
        if not moved:
            return now
        now = C.settle(now, "spelling-roots")
        C.release(new)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the corpus."""
    words = C.settle(counted(docs, id_col, text_col).withColumn("len", F.length("word")), "spelling-words")
    near = C.settle(near_words(words), "spelling-near")
    rows = words.select("word", "n").join(near, "word", "left")
    better = -F.col("best.neg") >= 2 * F.col("n")
    rows = C.settle(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                F.when(better, F.col("best.form")).alias("form"),
                                F.when(better, -F.col("best.neg")).alias("form_n")), "spelling-forms")
    C.release(words, near)
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
