"""Near-duplicate documents from bottom-k sketches of one hash function.

Words are maximal runs of non-space characters with A-Z lowered; a document's
set holds the 64-bit hashes of its distinct n-word shingles (with fewer words:
the whole sequence as one).  Two documents are linked when the Jaccard
similarity of their sets is at least ``THRESHOLD`` percent.

1. Documents with equal sets form a class, found by size and a 128-bit sum of
   the set; its smallest id stands for it from here on.
2. A sketch keeps the K smallest hashes of a set.  Inverted lists of the
   retained values generate overlaps.  A linked pair shares 80 % of the K
   smallest values of its union on average, and fewer than half of K only with
   a chance below 1e-7 (6 standard deviations; sets of under 0.8 K shingles
   are whole in their sketch, where the bound is exact).  So in the order
   (document frequency, value) each document lists only its K - K/2 + 1 rarest
   values: a pair sharing K/2 must meet in one of them.  A value that a third
   of all documents hold comes last in that order and is listed only where
   half of a document consists of such values.
3. Hub round: in each list every member is paired with one hub, the member
   whose retained values are the most frequent ones (a copy differs from its
   original by rare values).  That is one pair per list entry, and joins a
   family of copies of any size to its original.
4. Rest round: only lists whose members are still in different components go
   on.  Lists of up to BLOCK members give the pairs across components whose
   overlap is high enough.  The members of longer lists, which are mostly the
   same documents in list after list, are put into blocks of BLOCK documents
   by the hub of their longest list; block pairs that meet in some list are
   compared once: by the overlap of all sketches first, then the documents with
   a possible partner by a matrix product over their full sets, which returns
   at most one link per component.  A block holds sets of one size class (a factor
   of ``STEP``) and meets blocks of the same and the next class only; sketches
   travel once per tile of ``TILE`` blocks, not once per pair of blocks.  Documents of the
   hub's own component are not compared with each other.  No pair that could
   add a link between components is left out.
5. Pairs of the hub round and of short lists are candidates when the sketch of
   the union estimates a similarity of half or more, and are verified on the
   full sets made from whole texts.  A task reads the text of one document of
   many pairs once, followed by those of its partners.

A family whose copies do not link with its hub is compared in blocks, in time
quadratic in the number of such copies.

Defined results: a null, empty or blank text has the empty set and no links;
a null id gets a null component and is kept; repeated rows are equal sets;
rows that share an id are taken as one document holding either text; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

K = 64
THRESHOLD = 80
BLOCK = 256
TILE = 16                      # blocks that go to one task together, on each side
STEP = 1.25                    # sizes of linked sets differ by at most 100 / THRESHOLD: one class
FEW = 1 << 20                  # ids are broadcast up to this number (8 bytes each), rows of groups up to half of it (28 bytes)


def tidy(fn):
    """A task's function that gives unused Arrow memory back when it ends:
    Python workers stay for the next task, whatever stage it belongs to."""
    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
    return run


def shingles(text, n: int) -> np.ndarray:
    """Sorted distinct hashes (int64) of the n-word shingles of a text."""
    data = C.utf8(text)
    start, end = C.word_bounds(data)
    if not len(start):
        return np.zeros(0, np.int64)
    words = C.range_hash(C.prefix_hash(data, C.BYTE_LOWER), start, end)
    return np.unique(C.ngram_hash(words, min(n, len(words))).view(np.int64))


def sketches(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sketch) of each row."""
    def row(r):
        s = shingles(r[1], n)
        u = s.view(C.U64)
        f = [int(C.mix(u ^ C.U64(x)).sum().view(np.int64)) if len(u) else 0 for x in (0, 0x5851F42D4C957F2D)]
        return r[0], len(s), *f, s[:K].tolist()
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()),
                        ("f2", pa.int64()), ("sketch", pa.list_(pa.int64()))])
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(C.per_row(row, ["doc_id", "text"], schema),
                          "doc_id long, n_shingles long, f1 long, f2 long, sketch array<long>")


def least_overlap(s):
    """Retained values that a document with ``s`` of them shares with any
    linked one (NumPy or Column arithmetic)."""
    if isinstance(s, np.ndarray):
        return np.where(s < 0.8 * K, -(-THRESHOLD * s // 100), K // 2)
    return F.when(s < 0.8 * K, F.ceil(s * THRESHOLD / 100)).otherwise(K // 2)


def may_link(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sketch of the union allows a link: the share of its K
    smallest values that both sketches hold is the similarity itself for sets
    that are whole in their sketches, and an estimate of it for others."""
    both = np.sort(np.concatenate((a, b)))
    same = np.concatenate((both[1:] == both[:-1], [False]))
    if len(a) < K and len(b) < K:
        return 100 * int(same.sum()) >= THRESHOLD * (len(both) - int(same.sum()))
    first = np.concatenate(([True], both[1:] != both[:-1]))
    return 2 * int(same[first][:K].sum()) >= min(K, int(first.sum()))


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (hub, doc_id) whose sizes and union sketch allow a link."""
    side = lambda x, k: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias("n" + k),
                                    short("sketch").alias("s" + k))
    rows = pairs.join(side("hub", "a"), "hub").join(side("doc_id", "b"), "doc_id").where(
        "100 * least(na, nb) >= {0} * greatest(na, nb)".format(THRESHOLD))

    def run(batches):
        for t in batches:
            for i in range(0, t.num_rows, 1024):
                p = t.slice(i, 1024)
                (va, oa), (vb, ob) = C.ragged(p.column("sa")), C.ragged(p.column("sb"))
                ok = [may_link(va[oa[j]:oa[j + 1]], vb[ob[j]:ob[j + 1]]) for j in range(p.num_rows)]
                yield p.select(["hub", "doc_id"]).filter(pa.array(ok, pa.bool_()))
    return rows.select("hub", "doc_id", "sa", "sb").mapInArrow(run, "hub long, doc_id long")


def texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted ids (settled, distinct).  Few ids are broadcast,
    so that no text moves; more are joined."""
    few = wanted.count() <= FEW
    return texts.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The pairs (hub, doc_id; settled) whose full sets, from whole texts, are
    similar enough, as (a, b) with a < b.  The partners of a hub are dealt to
    groups of about BLOCK, each of which gets the hub's text first."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    members = pairs.join(sizes, "hub").select(
        "hub", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("salt"), "doc_id", F.lit(1).alias("member"))
    hubs = members.select("hub", "salt", F.col("hub").alias("doc_id"), F.lit(0).alias("member")).distinct()
    rows = C.settle(members.union(hubs), "near-groups")
    if rows.count() <= FEW // 2:                       # each text moves once, to its groups
        rows = texts.join(F.broadcast(rows), "doc_id")
    else:
        wanted = C.settle(rows.select("doc_id").distinct(), "near-wanted")
        rows = rows.join(texts_of(texts, wanted), "doc_id")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")

    def run(batches):
        at, centre = None, []                          # rows that share an id are several centres
        for chunk in C.rows_of(batches, "hub", "salt", "member", "doc_id", "text"):
            out = []
            for hub, salt, member, doc, text in chunk:
                if (hub, salt) != at:
                    at, centre = (hub, salt), []
                x = shingles(text, n)
                if not member:
                    centre.append(x)
                    continue
                for y in centre:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= THRESHOLD * (len(x) + len(y) - both):
                        out.append((min(hub, doc), max(hub, doc)))
                        break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
    return rows.select("hub", "salt", "member", "doc_id", "text").mapInArrow(tidy(run), "a long, b long")


def listed(reps: DataFrame) -> DataFrame:
    """(value, doc_id, rare): each document's entries in the inverted lists of
    its rarest retained values; rare falls with their average frequency."""
    entries = reps.select("doc_id", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    # settled, so that AQE can split the join on a frequent value
    counts = C.settle(entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "near-counts")
    shared = (entries.join(counts, "value").groupBy("doc_id")
              .agg(F.first("s").alias("s"), F.sum("df").alias("total"),
                   F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v")))
    own = F.col("s") - F.size("v")
    room = F.col("s") - least_overlap(F.col("s")) + 1 - own
    return (shared.where(room > 0)
            .select("doc_id", (-F.col("total") / F.col("s")).alias("rare"),
                    F.explode(F.slice("v", 1, room.cast("int"))).alias("e"))
            .select(F.col("e.value").alias("value"), "doc_id", "rare"))


def short(sketch: str):
    """The upper halves of retained values: enough to estimate overlaps."""
    return F.transform(sketch, lambda x: F.shiftright(x, 32).cast("int"))


def candidates(values, off, c, size) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sketches (rows of a ragged array) in different components
    whose overlap and set sizes allow a link."""
    column = np.unique(values, return_inverse=True)[1]
    m = np.zeros((len(size), int(column.max()) + 1), np.float32)
    m[np.repeat(np.arange(len(size)), np.diff(off)), column] = 1
    need = least_overlap(np.diff(off))
    x, y = np.nonzero(np.triu(m @ m.T >= np.maximum(need[:, None], need), 1))
    ok = (c[x] != c[y]) & (100 * np.minimum(size[x], size[y]) >= THRESHOLD * np.maximum(size[x], size[y]))
    return x[ok], y[ok]


def rest_pairs(entries: DataFrame, reps: DataFrame) -> DataFrame:
    """Candidate pairs of members of one short list in different components;
    ``entries`` (value, doc_id, c)."""
    e = entries.join(reps.select("doc_id", "n_shingles", short("sketch").alias("sketch")), "doc_id")
    e = e.repartition("value").sortWithinPartitions("value")

    def run(batches):
        for g in C.runs(batches, "value"):
            if g.num_rows < 2:
                continue
            ids, c, size = (g.column(x).to_numpy() for x in ("doc_id", "c", "n_shingles"))
            values, off = C.ragged(g.column("sketch"))
            x, y = candidates(values, off, c, size)
            ok = np.array([may_link(values[off[i]:off[i + 1]], values[off[j]:off[j + 1]])
                           for i, j in zip(x.tolist(), y.tolist())], bool)
            x, y = x[ok], y[ok]
            a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["hub", "doc_id"])
    return e.mapInArrow(tidy(run), "hub long, doc_id long").distinct()


def linked_sets(values: np.ndarray, off: np.ndarray, c: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of linked sets (rows of a ragged array) in different
    components c, as many as join components."""
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    order = np.argsort(values, kind="stable")
    v = values[order]
    first = np.concatenate(([True], v[1:] != v[:-1]))
    column = np.cumsum(first) - 1
    often = np.bincount(column) > 1                    # values that two sets share
    keep = often[column]
    row, column = row[order][keep], (np.cumsum(often) - 1)[column[keep]]
    both = np.zeros((len(size), len(size)), np.float32)
    for lo in range(0, int(often.sum()), 8192):
        part = (column >= lo) & (column < lo + 8192)
        m = np.zeros((len(size), 8192), np.float32)
        m[row[part], column[part] - lo] = 1
        both += m @ m.T
    linked = 100 * both >= THRESHOLD * (size[:, None] + size - both)
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i
    out = []
    for x, y in zip(*np.nonzero(np.triu(linked & (c[:, None] != c), 1))):
        p, q = find(int(c[x])), find(int(c[y]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(x), int(y)))
    return out


def block_links(entries: DataFrame, hubs: DataFrame, reps: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Links between members of long lists in different components; ``entries``
    (value, doc_id, c, n) and ``hubs`` (value, hub, hub_c)."""
    home = (entries.join(hubs, "value").groupBy("doc_id", "c")
            .agg(F.max(F.struct("n", "hub", "hub_c")).alias("h")).select("doc_id", "c", "h.hub", "h.hub_c"))
    home = home.join(reps.select("doc_id", "n_shingles"), "doc_id").select(
        "doc_id", "c", "hub", (F.col("c") == F.col("hub_c")).alias("joined"),
        F.floor(F.log("n_shingles") / float(np.log(STEP))).alias("cls"))
    home = C.settle(home, "near-homes")
    sizes = C.settle(home.groupBy("hub", "joined", "cls").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "near-home-sizes")
    block = F.xxhash64("hub", "joined", "cls", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    members = C.settle(home.join(sizes, ["hub", "joined", "cls"]).select("doc_id", "c", "cls", block.alias("block"), F.when(
        F.col("joined"), F.col("c")).alias("bc")), "near-members")
    # blocks of a class go to tiles; one row per class is joined
    blocks = members.select("block", "cls").distinct()
    tiles = blocks.groupBy("cls").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    blocks = C.settle(blocks.join(tiles, "cls").select(
        "block", F.xxhash64("cls", F.pmod(F.xxhash64("block"), F.col("tiles"))).alias("tile")), "near-blocks")
    met = C.settle(entries.join(members, "doc_id").select("value", "block", "bc", "cls").distinct(), "near-met")
    pairs = (met.alias("x").join(met.alias("y"), F.col("x.value") == F.col("y.value"))
             .where("x.block <= y.block and abs(x.cls - y.cls) <= 1 and (x.bc is null or y.bc is null or x.bc != y.bc)")
             .select(F.col("x.block").alias("i"), F.col("y.block").alias("j")).distinct())
    tile = lambda k, t: blocks.select(F.col("block").alias(k), F.col("tile").alias(t))
    pairs = pairs.join(tile("i", "ti"), "i").join(tile("j", "tj"), "j").select(
        F.least("ti", "tj").alias("p"), F.greatest("ti", "tj").alias("q"), "i", "j")
    pairs = C.settle(pairs, "near-block-pairs")
    C.release(home, sizes, met, blocks)

    # sketches first: only documents with a possible partner in the other block go on
    sides = C.settle(members.select("doc_id", "c", "block").join(reps.select(
        "doc_id", "n_shingles", short("sketch").alias("sketch")), "doc_id"), "near-sides")
    there = pairs.select("p", "q", F.col("i").alias("block")).union(pairs.select("p", "q", "j")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    rows = pairs.select("p", "q", F.lit(0).alias("kind"), "i", "j", none("long").alias("c"), none("long").alias("n_shingles"),
                        none("array<int>").alias("sketch"))
    rows = rows.union(there.join(sides, "block").select(
        "p", "q", F.lit(1), "block", "doc_id", "c", "n_shingles", "sketch"))

    def possible(batches):
        for g in C.runs(batches, "p", "q"):
            kind = g.column("kind").to_numpy()
            own = g.filter(pa.array(kind == 1)).combine_chunks()
            asked = g.filter(pa.array(kind == 0))
            home = own.column("i").to_numpy()
            order = np.argsort(home, kind="stable")
            for i, j in zip(asked.column("i").to_pylist(), asked.column("j").to_pylist()):
                at = np.concatenate([order[slice(*np.searchsorted(home[order], [b, b + 1]))] for b in ({i, j})])
                t = own.take(pa.array(at))
                c, size = t.column("c").to_numpy(), t.column("n_shingles").to_numpy()
                hit = np.unique(np.concatenate(candidates(*C.ragged(t.column("sketch")), c, size)))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(hit), i)), pa.array(np.full(len(hit), j)),
                        t.column("j").combine_chunks().take(pa.array(hit)), pa.array(c[hit])], names=["i", "j", "doc_id", "c"])
    met = rows.repartition("p", "q").sortWithinPartitions("p", "q", "kind").mapInArrow(
        tidy(possible), "i long, j long, doc_id long, c long")
    met = C.settle(met, "near-possible")
    C.release(members, pairs, sides)

    def sets(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("values", pa.list_(pa.int64()))])
        yield from C.per_row(lambda r: (r[0], shingles(r[1], n).tolist()), ["doc_id", "text"], schema)(batches)
    wanted = C.settle(met.select("doc_id").distinct(), "near-wanted")
    full = texts_of(texts, wanted).mapInArrow(tidy(sets), "doc_id long, values array<long>")
    rows = met.join(C.settle(full, "near-sets"), "doc_id")
    rows = rows.repartition("i", "j").sortWithinPartitions("i", "j")

    def run(batches):
        for g in C.runs(batches, "i", "j"):
            ids, c = g.column("doc_id").to_numpy(), g.column("c").to_numpy()
            got = linked_sets(*C.ragged(g.column("values")), c)
            if got:
                a, b = ids[[x for x, _ in got]], ids[[y for _, y in got]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
    return rows.mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    rows = C.settle(sketches(docs, n, id_col, text_col), "near-sketches")
    classes = rows.where("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    classes = C.settle(classes, "near-classes")
    reps = C.settle(rows.select("doc_id", "n_shingles", "sketch").join(
        classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "near-reps")
    wide, rows = rows, C.settle(rows.drop("sketch"), "near-rows")
    C.release(wide)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    entries = C.settle(listed(reps), "near-lists")
    hubs = entries.groupBy("value").agg(F.min(F.struct("rare", "doc_id")).alias("h"), F.count("*").alias("m"))
    hubs = C.settle(hubs.where("m > 1").select("value", F.col("h.doc_id").alias("hub")), "near-hubs")
    first = entries.join(hubs, "value").where("doc_id != hub").select("hub", "doc_id").distinct()
    first = C.settle(estimated(first, reps), "near-first")
    links = C.settle(verified(first, texts, n), "near-links")
    found = C.settle(C.components(links), "near-found")
    C.release(links)

    open_ = C.settle(entries.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "value", "doc_id", F.coalesce("component", "doc_id").alias("c")), "near-entries")
    open_lists = open_.groupBy("value").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    open_lists = C.settle(open_lists.where("lo < hi").select("value", "n"), "near-open-lists")
    C.release(entries)
    entries = C.settle(open_.join(open_lists, "value"), "near-open")
    C.release(open_)
    known = first.union(first.select("doc_id", "hub"))
    rest = rest_pairs(entries.where(F.col("n") <= BLOCK).drop("n"), reps).join(known, ["hub", "doc_id"], "left_anti")
    rest = C.settle(rest, "near-rest")
    C.release(first)
    more = C.settle(verified(rest, texts, n), "near-more")
    C.release(rest)
    long_hubs = hubs.join(open_lists.where(F.col("n") > BLOCK).select("value"), "value", "left_semi").join(
        found.withColumnRenamed("id", "hub"), "hub", "left").select(
        "value", "hub", F.coalesce("component", "hub").alias("hub_c"))
    long_hubs = C.settle(long_hubs, "near-long-hubs")
    blocks = C.settle(block_links(entries.where(F.col("n") > BLOCK), long_hubs, reps, texts, n), "near-block-links")
    C.release(entries, open_lists, hubs, long_hubs, reps)
    # the first round's components, as stars, and the links found after them
    found = C.components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more).union(blocks))

    same = ["n_shingles", "f1", "f2"]
    out = rows.join(classes, same, "left").join(
        found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id").alias("component_id")
    out = out.select("doc_id", "n_shingles", component)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id."""
    gone = near_duplicates(docs, n, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col))
    return docs.join(gone.distinct(), id_col, "left_anti").select(*docs.columns)
