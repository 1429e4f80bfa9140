"""Packing, ranked search and spelling variants against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import SF
from tests.llm.test_text_operators import EDGE, texts
from tessera.llm import common, packing, queries, search, spelling


# ---- packing ----

def library_ids(items):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(packing.TOKENIZER)
    return [model.encode(t or "", add_special_tokens=False).ids + [packing.END] for t in items]


def odd_texts():
    rng = random.Random(5)
    parts = ["Word", "it's", "I'LL", " ", "  ", "\n", "\t", "\r\n", " ", " ", "é", "é", " ́", "İ", "ΣΑΣ", "中文字", "🙂", "a,b.c!",
             "x" * 80, "12345", "<|endoftext|>", "<|startoftext|>", "'s", "\x00", "\x1c", "!\x1c!", "ß", "½", "ﬁ", "Å", "Å"]
    letters = [chr(i) for i in range(1, 0x250)] + [chr(rng.randrange(0x250, 0xD800)) for _ in range(300)] + ["'", ",", ".", " "] * 30
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for pool in (parts, letters) for _ in range(3000)]


def test_tokens_equal_the_library(spark):
    items = [*texts(spark).values(), *EDGE, *odd_texts()]
    with open(packing.TOKENIZER, "rb") as f:
        enc = packing.Tokens(f.read())
    for _ in range(2):                                 # from the library, then from memory
        for t, want in zip(items, library_ids(items)):
            assert np.frombuffer(enc.encode(t), "<u4").tolist() + [packing.END] == want, t


def checked_packing(rows, items, capacity):
    """Every id in one piece, no gaps, nothing over capacity -> (padding, sequences)."""
    ids = library_ids([t for _, t in items])
    want = Counter()
    for (doc, _), x in zip(items, ids):
        want[doc, tuple(x)] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, rs in by_doc.items():
        docs = [x for (d, x), n in want.items() for _ in range(n) if d == doc]
        assert sum(r.length for r in rs) == sum(map(len, docs))
        expected = Counter((s, len(x[s:s + capacity]), zlib.crc32(np.array(x[s:s + capacity], "<u4").tobytes()), len(x))
                           for x in docs for s in range(0, len(x), capacity))
        assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rs) == expected
    assert set(by_doc) == {d for d, _ in items}
    padding = 0
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, len(by_sequence)


def test_packing_of_the_table(spark):
    items = sorted(texts(spark).items())
    rows = queries.op11_packing(spark, SF).collect()
    padding, n = checked_packing(rows, items, packing.CAPACITY)
    total = sum(r.length for r in rows)
    assert n <= -(-total // packing.CAPACITY) * 1.03 + 2 and padding <= 0.03 * total + 2 * packing.CAPACITY


@pytest.mark.parametrize("capacity", [64, 100])
def test_packing_edge_cases(docs, frame, capacity, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 16)
    rng = random.Random(2)
    word = ["the", "quick", "fox", "jumps"]
    items = [*EDGE, *(" ".join(rng.choices(word, k=rng.randint(0, 150))) for _ in range(300))]
    rows = [(i, t) for i, t in enumerate(items)] + [(None, "the fox"), (5, "the fox"), (7, "same id"), (8, "copy"), (8, "copy")]
    src = docs([(i, t) for i, t in rows]).withColumnRenamed("lang", "tag")
    packed = common.settle(packing.pack(src, capacity=capacity, keep_ids=True), "test")
    got = packed.collect()
    padding, n = checked_packing(got, rows, capacity)
    total = sum(r.length for r in got)
    assert n * capacity - total <= 0.25 * total + 2 * capacity
    seqs = packing.sequences(packed, capacity).collect()
    assert len(seqs) == n and sum(r.n_tokens for r in seqs) == total
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for r in seqs:
        want = [i for p in sorted(by[r.sequence_id], key=lambda p: p.offset) for i in p.ids]
        assert r.ids[:r.n_tokens] == want and set(r.ids[r.n_tokens:]) <= {packing.PAD}
        assert len(r.ids) == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else capacity)
    assert packing.pack(frame([], "doc_id long, text string, tag int, c int, rank int")).count() == 0


def test_knapsack_and_patterns():
    rng = random.Random(4)
    for _ in range(40):
        room = rng.randint(5, 25)
        sizes = np.array(sorted(rng.sample(range(1, room + 1), rng.randint(1, min(5, room)))))
        values = np.array([rng.random() for _ in sizes])
        best = max(float(values @ c) for c in itertools.product(*[range(room // s + 1) for s in sizes])
                   if int(sizes @ np.array(c)) <= room)
        got, count = packing.knapsack(sizes, values, room)
        assert got == pytest.approx(best) and sizes @ count <= room and values @ count == pytest.approx(best)
    for _ in range(20):
        room = rng.choice([32, 64, 512])
        histogram = {s: rng.randint(1, 400) for s in rng.sample(range(1, room + 1), rng.randint(1, room // 2))}
        found = packing.patterns(histogram, room)
        held = Counter()
        for p, times in found:
            assert sum(s * a for s, a in p.items()) <= room and times > 0
            for s, a in p.items():
                held[s] += a * times
        assert held == Counter(histogram)
        # weak duality: prices under which no pattern is worth more than 1 bound the sequences from below
        sizes, demand = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)])
        prices = np.maximum(packing.inverted(packing.column_generation(sizes, demand, room)[0].astype(float)).sum(0), 0)
        bound = float(prices @ demand) / max(1.0, packing.knapsack(sizes, prices, room)[0])
        assert bound - 1e-6 <= sum(t for _, t in found) <= 1.01 * bound + len(histogram) / 2 + 2
    assert packing.patterns({}, 8) == []


def test_packing_is_near_the_bound_for_many_documents():
    rng = np.random.default_rng(3)
    lengths = np.minimum(np.exp(rng.normal(6.3, 1.0, 200_000)).astype(int) + 1, 4095)
    histogram = Counter((-(-lengths // packing.UNIT)).tolist())
    n = sum(t for _, t in packing.patterns(dict(histogram), packing.CAPACITY // packing.UNIT))
    assert n * packing.CAPACITY <= 1.012 * lengths.sum()


# ---- ranked search ----

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def search_brute(rows, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // length
            s = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found_rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_search_of_the_tables(spark):
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    got = queries.op12_search(spark, SF)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert found_rows(got) == search_brute(sorted(texts(spark).items()), items)


@pytest.mark.parametrize("bucket,first,block", [(3, 2, 30), (7, 1, 1 << 20), (2048, 4096, 1 << 20)])
def test_search_against_brute_force(frame, docs, bucket, first, block, monkeypatch):
    for name, x in (("BUCKET", bucket), ("FIRST", first), ("BLOCK", block), ("CHUNK", 40)):
        monkeypatch.setattr(search, name, x)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "naïve", "ÀB", "x_y", "A1", "中文", "z\x00z"]
    draw = lambda n: " ".join(rng.choice(vocabulary[:max(1, int(len(vocabulary) * rng.random()))]) for _ in range(n))
    rows = [(i, draw(rng.randint(0, 60))) for i in range(150)]
    rows += [(200 + i, "w1 w2 w3 tie") for i in range(30)] + [(300, None), (301, ""), (302, "- _"), (None, "w5 tie w1"), (303, "W7 w7" * 3000)]
    items = [(i, draw(rng.randint(1, 12))) for i in range(12)] + [(50, "tie tie w1"), (51, None), (52, "?!"), (53, "unheard of"),
                                                                  (None, "w3 é É"), (54, "w7w7")]
    src = docs([(i, t) for i, t in rows])
    asked = frame([(i, t, 1) for i, t in [*items, items[0]]], "item_id long, text string, score int")
    assert found_rows(search.search(src, asked)) == search_brute(rows, items)
    assert search.search(docs([]), asked).count() == 0
    assert search.search(src, frame([], "item_id long, text string")).count() == 0


def test_search_prunes(monkeypatch):
    """The bounds never lose a result, and skip most documents of a skewed corpus."""
    rng = random.Random(1)
    rows = [(i, 5, sorted(rng.sample(range(200), 5)), [1 + (rng.random() < 0.02) * 400] * 5) for i in range(4000)]
    q = search.Queries([(0, " ".join(f"t{i}" for i in range(200)))])
    weights = np.full(len(q.vocabulary), 1000)
    q.terms, q.times = [np.array([3, 4, 5])], [np.array([1, 1, 1])]
    seen = []
    monkeypatch.setattr(search.Best, "within", staticmethod(
        lambda v, *a, f=search.Best.within: (seen.append(int((x := f(v, *a)).sum())), x)[1]))
    ids, norms, off, t, impact = search.impacts_of(rows, weights, 4000, 20_000)
    best, all_ = search.Best(q, weights, np.zeros(1, np.int64), 10), np.zeros(4000, np.int64)
    order = np.argsort(-norms, kind="stable")
    for i in range(0, 4000, 100):
        best.add(search.Vectors(*search.impacts_of([rows[j] for j in order[i:i + 100]], weights, 4000, 20_000)))
    row = np.repeat(np.arange(4000), 5)
    np.add.at(all_, row, np.isin(t, [3, 4, 5]) * impact)
    want = sorted(((-int(s), i) for i, s in enumerate(all_) if s))[:10]
    assert sorted(zip((-best.top[0][1]).tolist(), best.top[0][0].tolist())) == want
    assert sum(seen) < 1000


# ---- spelling variants ----

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def spelling_brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    by = defaultdict(list)
    for w in n:                                        # near words share one with a gap
        for i in range(len(w)):
            by[w[:i] + "_" + w[i + 1:]].append(w)
        by[w].append(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1:]].append(w)
    nears = defaultdict(set)
    for ws in by.values():
        for a, b in itertools.combinations(set(ws), 2):
            if near(a, b):
                nears[a].add(b)
                nears[b].add(a)
    form = {}
    for w in n:
        best = min(nears[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(nears[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def spelled(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def test_spelling_of_the_table(spark):
    got = queries.op13_spelling(spark, SF)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint",
                                "form_n": "bigint"}
    assert spelled(got) == spelling_brute(sorted(texts(spark).items()))


@pytest.mark.parametrize("shard,cells", [(16, 64), (50, 4), (4096, 1024)])
def test_spelling_against_brute_force(docs, shard, cells, monkeypatch):
    for name, x in (("SHARD", shard), ("CELLS", cells), ("SAMPLE", 200), ("LEAF", 5), ("HELD", 50), ("ASKED", 17)):
        monkeypatch.setattr(spelling, name, x)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 9))) for _ in range(150)]
    words += ["".join(rng.sample("listen", 6)) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "×÷×÷×", "x" * 3000, "x" * 3001]
    for w in list(words[:120]):
        for _ in range(3):
            i = rng.randrange(len(w) + 1)
            words.append(rng.choice([w[:i] + "a" + w[i:], w[:i] + w[i + 1:], w[:i] + "b" + w[i + 1:]]))
    rows = [(i if i % 50 else None, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, k=80)))
            for i in range(150)]
    rows += [(900, None), (901, ""), (902, "-12"), (903, "aaaaa " * 500), (903, "aaaaa " * 500), (904, " ".join(["x" * 3000] * 5 + ["x" * 3001] * 2 + ["ÀÀÀÀÀ"] * 3))]
    got = spelled(spelling.variants(docs(rows)))
    want = spelling_brute(rows)
    assert got == want and any(r[1] != r[2] and r[1] for r in want)


def test_spelling_of_nothing(docs, frame):
    assert spelling.variants(docs([])).count() == 0
    assert spelling.variants(docs([None, "", "abc abc abc abc"])).count() == 0
    one = frame([(1, "hello hello hello", "a", 2)], "doc_id long, text string, word string, n int")
    assert spelled(spelling.variants(one)) == [("hello", None, "hello", 3, 0, None)]


def test_one_edit():
    rng = random.Random(9)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    for a in words:
        for b in words:
            if abs(len(a) - len(b)) <= 1:
                x, y = (np.array([list(w.encode("latin-1"))], np.uint8) for w in (a, b))
                assert spelling.one_edit(x, y)[0] == near(a, b), (a, b)
