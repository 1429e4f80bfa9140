"""Exact removal of repeated substrings with common-prefix interval trees.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts
earlier (smaller document id, or same document and earlier position).

1. Anchors.  The K-byte strings whose hash is least in some window of LENGTH
   bytes: every LENGTH-byte string holds one, and equal strings hold the same
   one at the same place.  About one byte in 32 starts an anchor.  An anchor's
   context is the bytes that any LENGTH-byte string over it can reach.
2. Anchors whose hash occurs once are dropped (map-side combined count, then a
   join that AQE splits on hot hashes).
3. Occurrences with equal contexts (by 64-bit hash) are copies: all but the
   earliest are marked whole.  This settles the inside of long copies without
   moving text.
4. Where an anchor has several contexts, at the ends of copies and at edits,
   the earliest occurrence of each is fetched and dealt by hash.  An anchor
   with more than GROUP contexts (say, at the end of a passage that a third of
   all documents share) is dealt by the EDGE bytes before and after it as well;
   strings that reach less than EDGE bytes to one side, at most 2 EDGE per
   context, are compared by hash instead.  Should such a group still exceed
   GROUP, it is dealt to several by document.
5. In a group the anchors' suffixes are sorted into an enhanced suffix array
   (order and longest common prefixes), and the left contexts, read backwards,
   into another.  Contexts whose neighbours in both orders share less than
   LENGTH bytes in all are in no repeat.  For the others, and each L from 0 to
   the whole left context, the tree of common-prefix intervals is cut at depth
   LENGTH - L, that of the left contexts at depth L: the contexts in the same
   interval of both are all the occurrences of one string of LENGTH bytes that
   starts L bytes before the anchor.  All of them but the earliest are marked;
   a context returns the bytes marked around its anchor as one range.
6. Strings near the edges of hot anchors, and those of groups dealt by document
   that no earlier one in the own group covers, meet by hash (128 bits).
7. Marked ranges are joined to the documents, merged and cut out.

Defined results: null and empty texts have no bytes; texts under LENGTH bytes
lose none; rows that share id and text are one document and get the same
result; rows that share only the id are ordered by a hash of their text; null
ids come last in the order.  An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

LENGTH = 100
K = 32
LEFT, RIGHT = LENGTH - K, LENGTH       # context before and from the anchor
GROUP = 1 << 15                # contexts compared in one group
EDGE = 6                       # bytes beside the anchor that split the contexts of a hot one
CHUNK = 1 << 13                # contexts of small groups worked on together
SEGMENT = 1 << 15              # bytes whose anchors are sought at once
BLOCK = 1 << 17                # bytes of texts worked on together
TABLE2 = C.random_table("substring context")


def _sliding(h: np.ndarray, w: int, best) -> np.ndarray:
    """best(h[i:i+w]) for every full window, by doubling."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of texts laid end to end, the i-th
    being data[bounds[i]:bounds[i + 1]]."""
    pos, val = [], []
    w = LENGTH - K + 1
    edge = np.zeros(w - 1, C.U64)
    for lo in range(0, max(1, len(data) - LENGTH + 1), SEGMENT):
        part = data[lo:lo + SEGMENT + LENGTH - 1]
        if len(part) < LENGTH:
            continue
        c = C.prefix_hash(part)
        _, q = C.powers(len(c))
        h = C.mix((c[K:] - c[:-K]) * q[:len(c) - K] + C.U64(K))
        least = _sliding(h, w, np.minimum)
        for e in (bounds[np.searchsorted(bounds, lo, "right"):np.searchsorted(bounds, lo + len(part))] - lo).tolist():
            least[max(0, e - LENGTH + 1):e] = 0        # strings across the end of a text
        most = _sliding(np.concatenate((edge, least, edge)), w, np.maximum)
        at = np.flatnonzero(most == h)
        pos.append(at + lo)
        val.append(h[at])
    if not pos:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, first = np.unique(np.concatenate(pos), return_index=True)
    return p, np.concatenate(val)[first].view(np.int64)


ANCHORS = pa.schema([("h", pa.int64()), ("ch", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(h, ch, doc, at): hashes of anchor and context; at = tag and position in
    one number, so that (doc, at) orders all positions."""
    def run(batches):
        for batch in batches:
            every, ends = C.text_bytes(batch.column("text"))
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            i = 0
            while i < len(doc):                        # texts of about BLOCK bytes at once
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
                data, bounds = every[ends[i]:ends[j]], ends[i:j + 1] - ends[i]
                p, h = anchors(data, bounds)
                row = np.searchsorted(bounds, p, "right") - 1
                first = bounds[row]
                a, b = np.maximum(first, p - LEFT), np.minimum(bounds[row + 1], p + RIGHT)
                ch = C.mix(C.range_hash(C.prefix_hash(data, TABLE2), a, b) + (p - a).astype(C.U64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ch), pa.array(doc[i + row]),
                                                  pa.array(p - first + (tag[i + row] << 32))], schema=ANCHORS)
                i = j
    return docs.select("doc", "tag", "text").mapInArrow(run, "h long, ch long, doc long, at long")


CONTEXTS = pa.schema([("h", pa.int64()), ("hot", pa.bool_()), ("doc", pa.int64()),
                      ("tag", pa.int64()), ("pos", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])


def _pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] of each pair, as a binary column."""
    off = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=off[1:])
    index = np.repeat(start - off[:-1], end - start) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(data[index])])


def context_rows(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Contexts of the anchors (h, hot, doc, tag, pos), cut from whole texts."""
    per = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("pos", "h", "hot")).alias("at"))
    rows = C.settle(per, "substring-wanted").join(docs.select("doc", "tag", "text"), ["doc", "tag"])

    def run(batches):
        for batch in batches:
            data, bounds = C.text_bytes(batch.column("text"))
            row, (pos, h, hot) = C.list_fields(batch.column("at"))
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for i in range(0, len(row), CHUNK):
                r, p = row[i:i + CHUNK], pos[i:i + CHUNK]
                at = bounds[r] + p
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h[i:i + CHUNK], hot[i:i + CHUNK], doc[r], tag[r], p)]
                    + [_pieces(data, np.maximum(bounds[r], at - LEFT), at),
                       _pieces(data, at, np.minimum(bounds[r + 1], at + RIGHT))], schema=CONTEXTS)
    return rows.select("doc", "tag", "text", "at").mapInArrow(
        run, "h long, hot boolean, doc long, tag long, pos long, `left` binary, `right` binary")


def window_hashes(left, right, index: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the LENGTH bytes from ``reach`` bytes before the anchor of
    the contexts ``index``; ``left`` (backwards) and ``right``: byte rows."""
    rows, at = np.unique(index, return_inverse=True)
    data = np.concatenate((left[rows, ::-1], right[rows]), 1)
    p, q = C.powers(LEFT + RIGHT)
    out = []
    for table in (C.BYTE, TABLE2):
        c = np.zeros((len(rows), LEFT + RIGHT + 1), C.U64)
        np.cumsum(table[data] * p[:LEFT + RIGHT], axis=1, out=c[:, 1:])
        start = LEFT - reach
        out.append(C.mix((c[at, start + LENGTH] - c[at, start]) * q[start] + C.U64(LENGTH)).view(np.int64))
    return out


def window_rows(doc, tag, pos, left, right, index, reach):
    """MARKS batches of the windows ``reach`` before the anchors ``index``."""
    cuts = np.flatnonzero(np.diff(index // CHUNK)) + 1     # bounded arrays of contexts
    for i, el in zip(np.split(index, cuts), np.split(reach, cuts)):
        if len(i):
            start = pos[i] - el
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                doc[i], tag[i], start, start + LENGTH, *window_hashes(left, right, i, el))], schema=MARKS)


def edge_windows(contexts: DataFrame) -> DataFrame:
    """The strings over a hot anchor that reach less than EDGE bytes to its
    left or right: (doc, tag, start, end, w1, w2)."""
    def run(batches):
        near = np.array([el for el in range(LEFT + 1) if el < EDGE or LEFT - el < EDGE])
        for b in batches:
            doc, tag, pos = (b.column(n).to_numpy() for n in ("doc", "tag", "pos"))
            (lb, ls), (rb, rs) = _padded(b.column("left"), LEFT, True), _padded(b.column("right"), RIGHT, False)
            index, at = np.nonzero((ls[:, None] >= near) & (rs[:, None] >= LENGTH - near))
            yield from window_rows(doc, tag, pos, lb, rb, index, near[at])
    return contexts.select("doc", "tag", "pos", "left", "right").mapInArrow(
        run, "doc long, tag long, start long, `end` long, w1 long, w2 long")


def _padded(col: pa.Array, width: int, flip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte rows padded with zeros (``flip``: last byte first) and lengths."""
    raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    o = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    size = np.diff(o)
    o, grid = o.astype(np.int32), np.arange(width, dtype=np.int32)
    index = (o[1:, None] - 1 - grid) if flip else (o[:-1, None] + grid)
    ok = grid < size[:, None]
    out = np.zeros((len(col), width), np.uint8)
    out[ok] = raw[index[ok]]
    return out, size


def _common(a, b, size_a, size_b) -> np.ndarray:
    """Length of the common prefix of byte rows."""
    differs = a != b
    first = np.where(differs.any(1), differs.argmax(1), a.shape[1])
    return np.minimum(first, np.minimum(size_a, size_b))


def _keys(rows: np.ndarray) -> list[np.ndarray]:
    """The columns of byte rows as big-endian words, for ordering."""
    pad = -rows.shape[1] % 8
    wide = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8")
    return [wide[:, i].astype(C.U64) for i in range(wide.shape[1])]


def intervals(lcp) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first, last) of a sorted array, from
    the common prefixes of neighbours, by one stack scan."""
    out, stack = [], []                                # stack: (depth, first)
    for i, d in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            out.append((depth, first, i))
        if d and (not stack or stack[-1][0] < d):
            stack.append((d, first))
    return out


def cut_tree(lcp: np.ndarray, depth: int) -> np.ndarray:
    """The interval of each suffix when the tree of common-prefix intervals is
    cut at ``depth``: the widest of ``intervals`` of that depth at least, or the
    suffix alone, numbered in order.  ``lcp``: common prefixes of neighbours, -1
    between groups."""
    out = np.zeros(len(lcp) + 1, np.int64)
    np.cumsum(lcp < depth, out=out[1:])
    return out


def mark_groups(h, salt, hot, doc, tag, pos, left, right):
    """Marked bytes within groups of equal (h, salt).

    ``left`` (backwards) and ``right`` are (byte rows, lengths).  Returns, per
    context, how far its marked bytes reach to the left and right of the anchor
    (all of its ranges hold the anchor, so they join up), and the strings over
    hot anchors that no earlier context of the group has: (index, bytes before
    the anchor)."""
    (lb, ls), (rb, rs) = left, right
    reach_l, reach_r = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((pos, tag, doc))] = np.arange(len(h))
    order = np.lexsort((rank, ls, *_keys(lb)[::-1], rs, *_keys(rb)[::-1], salt, h))
    a, b = order[:-1], order[1:]
    group = (h[a] == h[b]) & (salt[a] == salt[b])
    same = group & (ls[a] == ls[b]) & (rs[a] == rs[b]) & (lb[a] == lb[b]).all(1) & (rb[a] == rb[b]).all(1)
    other = (doc[a] != doc[b]) | (tag[a] != tag[b]) | (pos[a] != pos[b])
    full = b[same & other & (ls[b] + rs[b] >= LENGTH)]
    reach_l[full], reach_r[full] = ls[full], rs[full]
    own = order[np.concatenate(([True], ~same))] if len(order) else order      # the earliest of each distinct context
    seek = own[hot[own]]                               # hot: strings not met in the group are sought beyond it
    place = np.full(len(h), -1)
    place[seek] = np.arange(len(seek))
    reach = np.arange(LEFT + 1)
    free = (ls[seek, None] >= reach) & (rs[seek, None] >= LENGTH - reach)

    def neighbours(rows, size, x):
        """Common lengths of neighbours of one group, -1 between groups."""
        a, b = x[:-1], x[1:]
        near = (h[a] == h[b]) & (salt[a] == salt[b])
        return np.where(near, _common(rows[a], rows[b], size[a], size[b]), -1)

    def backwards(x):
        return x[np.lexsort((ls[x], *_keys(lb[x])[::-1], salt[x], h[x]))]

    def greatest(common):
        return np.maximum(np.append(common, -1), np.append(-1, common))
    # nobody shares more with a context than its neighbours in each order: contexts that fall
    # short of LENGTH even so are in no repeat, and only the others go on
    if len(own):
        most = np.empty(len(h), np.int64)
        back = backwards(own)
        most[back] = greatest(neighbours(lb, ls, back))
        own = own[(most[own] >= 0) & (most[own] + greatest(neighbours(rb, rs, own)) >= LENGTH)]
    if len(own):
        back, early = backwards(own), own[np.argsort(rank[own])]
        lcp_r, lcp_l = neighbours(rb, rs, own), neighbours(lb, ls, back)
        at_r, at_l, most_r, most_l = (np.empty(len(h), np.int64) for _ in range(4))
        at_r[own] = at_l[back] = np.arange(len(own))
        most_r[own], most_l[back] = greatest(lcp_r), greatest(lcp_l)
        at_r, at_l, most_r, most_l = (x[early] for x in (at_r, at_l, most_r, most_l))
        bits = len(own).bit_length()                   # groups are bounded: three numbers fit 64 bits
        if 3 * bits > 63:
            raise ValueError(f"{len(own)} contexts in one group")
        for el in range(LEFT + 1):
            # contexts with a string from el bytes before the anchor in common: one interval of the
            # suffixes from the anchor, cut at the rest of LENGTH, and one of those backwards, cut at el
            i = np.flatnonzero((most_r >= LENGTH - el) & (most_l >= el))
            if len(i) < 2:
                continue
            key = np.sort((cut_tree(lcp_r, LENGTH - el)[at_r[i]] << 2 * bits) | (cut_tree(lcp_l, el)[at_l[i]] << bits) | i)
            i = early[key[1:][key[1:] >> bits == key[:-1] >> bits] & ((1 << bits) - 1)]   # all but the earliest
            reach_l[i], reach_r[i] = el, np.maximum(reach_r[i], LENGTH - el)
            free[place[i[hot[i]]], el] = False
    k, el = np.nonzero(free)
    return reach_l, reach_r, seek[k], el


MARKS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                   ("w1", pa.int64()), ("w2", pa.int64())])


def group_rows(contexts: DataFrame) -> DataFrame:
    """(doc, tag, start, end, w1, w2): marked ranges, and, with hashes, windows
    of hot anchors still to be compared across their groups."""
    rows = contexts.repartition("h", "salt").sortWithinPartitions("h", "salt")

    def work(t):
        t = t.combine_chunks()
        col = lambda n: t.column(n).to_numpy()
        h, salt, hot, doc, tag, pos = (col(n) for n in ("h", "salt", "hot", "doc", "tag", "pos"))
        left, right = _padded(t.column("left").combine_chunks(), LEFT, True), _padded(
            t.column("right").combine_chunks(), RIGHT, False)
        reach_l, reach_r, index, el = mark_groups(h, salt, hot, doc, tag, pos, left, right)
        i = np.flatnonzero(reach_r)
        none = pa.nulls(len(i), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (doc[i], tag[i], pos[i] - reach_l[i], pos[i] + reach_r[i])] + [none, none], schema=MARKS)
        yield from window_rows(doc, tag, pos, left[0], right[0], index, el)

    def run(batches):
        for t in C.whole_groups(batches, CHUNK, "h", "salt"):
            yield from work(t)
    return rows.mapInArrow(run, "doc long, tag long, start long, `end` long, w1 long, w2 long")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row;
    ``kept``: the remaining bytes."""
    src = C.ordered_texts(docs, id_col, text_col)
    long = src.where(F.octet_length("text") >= LENGTH).select("doc", "tag", "text")
    found = C.settle(anchor_rows(long), "substring-anchors")
    twice = C.settle(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "substring-twice")
    hits = C.settle(found.join(twice, "h"), "substring-hits")
    C.release(found, twice)
    kinds = C.settle(hits.groupBy("h", "ch").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")),
                     "substring-kinds")
    tag, pos = F.shiftright("at", 32), F.col("at").bitwiseAND((1 << 32) - 1)
    copies = C.settle(kinds.where("n > 1").select("h", "ch", "first"), "substring-copies")
    whole = hits.join(copies, ["h", "ch"]).where(F.struct("doc", "at") > F.col("first")).select(
        "doc", tag.alias("tag"), F.greatest(pos - LEFT, F.lit(0)).alias("start"), (pos + RIGHT).alias("end"))
    whole = C.settle(whole, "substring-whole")         # ends beyond the text are clipped when cut
    C.release(hits, copies)
    several = C.settle(kinds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "substring-several")
    wanted = kinds.select("h", "first.*").join(several, "h").select(
        "h", "doc", tag.alias("tag"), pos.alias("pos"), (F.col("n") > GROUP).alias("hot"))
    contexts = C.settle(context_rows(wanted, long), "substring-contexts")
    near = F.xxhash64("h", F.expr(f"substring(`left`, greatest(1, length(`left`) - {EDGE - 1}), {EDGE})"),
                      F.substring("right", 1, K + EDGE))
    deep = C.settle(contexts.where("hot").withColumn("h", near), "substring-deep")
    sizes = C.settle(deep.groupBy("h").agg(F.count("*").alias("n")), "substring-sizes")
    deep = deep.join(sizes.where("n > 1"), "h").withColumn("hot", F.col("n") > GROUP).withColumn(
        "salt", F.pmod(F.xxhash64("doc", "pos"), F.ceil(F.col("n") / GROUP)).cast("int")).drop("n")
    plain = contexts.where("not hot").withColumn("salt", F.lit(0))
    marks = C.settle(group_rows(plain.unionByName(deep)), "substring-marks")
    edges = C.settle(edge_windows(contexts.where("hot")), "substring-edges")
    C.release(kinds, several, contexts, sizes)
    windows = marks.where("w1 is not null").union(edges)
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "tag", "start")).alias("first"), F.count("*").alias("n"))
    first = C.settle(first.where("n > 1").drop("n"), "substring-windows")
    late = windows.join(first, ["w1", "w2"]).where(
        F.struct("doc", "tag", "start") > F.col("first")).select("doc", "tag", "start", "end")
    ranges = (marks.where("w1 is null").select("doc", "tag", "start", "end").union(whole).union(late)
              .groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("ranges")))
    ranges = C.settle(ranges, "substring-ranges")
    C.release(whole, marks)
    return C.cut_out(src, ranges, keep_bytes)
