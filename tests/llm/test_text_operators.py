"""Operators on texts against brute force, and their defined edge cases."""

import hashlib
import html
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import DOCS, SF
from tessera.llm import chunks, common, mixing, near, pages, pieces, private, quality, queries, substrings

WORDS = "[^\x20\x09-\x0d]+"
EDGE = [None, "", " \n\t", "one", "a b", "é ü", "x" * 5000, "\x00 \x00", "same words here " * 40]


def texts(spark):
    return {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect()}


# ---- quality rules ----

def base_quality(text):
    t = text or ""
    words = re.findall(WORDS, t)
    lines = [x for x in t.split("\n") if re.search(WORDS, x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t),
            len(lines) - len(set(lines)), len(hit), failed)


def shares(text):
    """Characters in n-grams seen before, by length, and in lines seen before."""
    words = re.findall(WORDS, text or "")
    out = {}
    for n in quality.MAX_NGRAM:
        seen, hit = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i:i + n])
            if g in seen:
                hit.update(range(i, i + n))
            seen.add(g)
        out[n] = sum(len(words[i]) for i in hit)
    seen, line = set(), 0
    for x in (text or "").split("\n"):
        if re.search(WORDS, x):
            line += sum(map(len, re.findall(WORDS, x))) if x in seen else 0
            seen.add(x)
    return out, line


def test_quality_against_brute_force(spark, docs):
    rows = {**texts(spark), **{10_000 + i: t for i, t in enumerate(EDGE + ["a b c d e f g h\n" * 9, "l1 x\nl1 x\n\nl2 #$"])}}
    got = {r.doc_id: r for r in quality.quality(docs(list(rows.items()))).collect()}
    assert len(got) == len(rows)
    for i, t in rows.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_quality(t)
        dup, line = shares(t)
        assert (r.dup_line_chars, *[r[f"dup_chars_{n}"] for n in dup]) == (line, *dup.values())
        assert r.kept == (not r.base_failed and line <= quality.MAX_LINE * r.word_chars and all(
            dup[n] <= quality.MAX_NGRAM[n] * r.word_chars for n in dup))


def test_quality_filter_keeps_rows_as_they_are(spark):
    src = common.table(spark, SF, "documents")
    kept = quality.filter_quality(src)
    assert kept.schema.names == src.schema.names
    ids = {r.doc_id for r in quality.quality(src).where("kept").collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(ids)


# ---- mixing ----

def test_mixing_targets_and_copies(docs):
    rng = random.Random(3)
    items = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice("aaaaaaabcdef") if i % 17 else None)
             for i in range(3000)] + [(5, "x y", "a"), (5, "x y", "a"), (None, None, "zz"), (None, "q", None)]
    rows = mixing.mix(docs(items)).collect()
    again = mixing.mix(docs(items[::-1])).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert len(rows) == len(items)
    per = {}
    for r in rows:
        per.setdefault(r.source, []).append(r)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    order = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(r.size for r in x) for s, x in per.items()}
    total, open_, target = sum(size.values()), set(per), {}
    while True:                                        # reshare the excess until none is above
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not above:
            break
        target.update({s: 3 * size[s] for s in above})
        open_ -= above
    target.update({s: level * weight[s] for s in open_})
    for s, x in per.items():
        assert x[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in x) - target[s]) <= 60


def test_mixed_rows(docs):
    items = [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(200)] + [(1, "w", "b")] * 2
    src = docs(items)
    copies = Counter()
    for r in mixing.mix(src).collect():
        copies[r.doc_id] += r.copies
    got = mixing.mixed(src)
    assert got.schema.names == src.schema.names
    assert Counter(r.doc_id for r in got.collect()) == +copies


# ---- near-duplicates ----

def near_brute(rows, n):
    sets = {}
    for d, t in rows:
        w = re.findall(WORDS, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    for _ in range(size):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        yield " ".join(t)


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_against_brute_force(spark, docs, n, monkeypatch):
    rng = random.Random(n)
    monkeypatch.setattr(near, "BLOCK", 16)             # several blocks a list
    passage = " ".join(f"p{i}" for i in range(50))
    items = [*list(texts(spark).values())[:150], *family(rng, 60, 90, 9), *family(rng, 40, 30, 4),
             *(f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(5, 40))) for _ in range(50)),
             *EDGE, "A b", "ONE", *(" ".join(f"r{j}" for j in range(i, i + 45)) for i in range(0, 60, 2))]
    rng.shuffle(items)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(docs(items), n).collect()}
    assert got == near_brute(list(enumerate(items)), n)


def test_near_rest_round_finds_links_between_components(docs):
    # a chain in which the hub of a list reaches only its neighbours
    items = [" ".join(f"c{j}" for j in range(i * 4, i * 4 + 60)) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(docs(items), 2).collect()}
    assert got == near_brute(list(enumerate(items)), 2)


def test_near_dedup_keeps_null_ids_and_columns(docs):
    t = " ".join(f"w{i}" for i in range(30))
    src = docs([(None, t), (3, t), (7, t), (7, t), (9, "other words")])
    got = near.drop_near_duplicates(src)
    assert got.schema.names == src.schema.names
    assert sorted((r.doc_id for r in got.collect()), key=str) == [3, 9, None]


# ---- exact substrings ----

def cut_brute(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def shared_passages(rng):
    letters = "abcdefg é"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(rng.choice([95, 99, 100, 101, 130, 168, 169, 300, 900])) for _ in range(30)]
    out = []
    for _ in range(160):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(text(rng.randint(0, 120)))
            p = rng.choice(passages)
            a = rng.randint(0, 3)
            parts.append(p[a:len(p) - rng.randint(0, 3)])
        out.append("".join(parts))
    return out + out[:5]


@pytest.mark.parametrize("group", [substrings.GROUP, 8])
def test_substrings_against_brute_force(spark, docs, group, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", group)    # 8: hot anchors in several groups
    monkeypatch.setattr(substrings, "SEGMENT", 500)
    rng = random.Random(group)
    items = [*shared_passages(rng), *EDGE, "ab" * 400, "x" * 5000, "y" + "x" * 300,
             *list(texts(spark).values())[:60]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in substrings.dedup_substrings(docs(items)).collect()}
    assert got == cut_brute(list(enumerate(items)))


def test_substring_repeated_rows_and_null_ids(docs):
    t = "".join(random.Random(1).choices("abcdef ", k=300))
    rows = substrings.dedup_substrings(docs([(4, t), (4, t), (None, t), (9, "zz" + t)]), keep_bytes=True).collect()
    assert sorted((str(r.doc_id), r.n_removed, bytes(r.kept).decode()) for r in rows) == sorted(
        [("4", 0, t), ("4", 0, t), ("None", 300, ""), ("9", 300, "zz")])


def test_intervals():
    # suffixes a, ana, anana, banana, na, nana
    assert sorted(substrings.intervals([1, 3, 0, 0, 2])) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_cut_tree_takes_the_last_intervals_above():
    rng = random.Random(3)
    for _ in range(50):
        lcp = [rng.choice([-1, 0, 1, 2, 3, 5]) for _ in range(rng.randint(0, 12))]
        for depth in range(1, 6):
            got = substrings.cut_tree(np.array(lcp, np.int64), depth).tolist()
            tree = [(f, e) for d, f, e in substrings.intervals([max(0, x) for x in lcp]) if d >= depth]
            for i in range(len(lcp) + 1):
                first, last = min([(f, e) for f, e in tree if f <= i <= e], key=lambda x: x[0] - x[1], default=(i, i))
                assert [j for j, x in enumerate(got) if x == got[i]] == list(range(first, last + 1))


def test_anchors_of_texts_end_to_end(monkeypatch):
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 3, n).astype(np.uint8) for n in (100, 99, 700, 0, 101, 300, 1)]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    one = [substrings.anchors(x, np.array([0, len(x)])) for x in parts]
    want = [(p + b, h) for (at, hs), b in zip(one, bounds.tolist()) for p, h in zip(at.tolist(), hs.tolist())]
    for segment in (1, 64, 500, 1 << 15):
        monkeypatch.setattr(substrings, "SEGMENT", segment)
        at, hs = substrings.anchors(np.concatenate(parts), bounds)
        assert list(zip(at.tolist(), hs.tolist())) == want


def test_contexts_of_a_frequent_anchor_are_compared_without_window_rows(docs, monkeypatch):
    # 2,000 texts share 80 bytes, pairs of them 160: one group, no strings to compare by hash
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefgh", k=n))
    shared, pairs, sizes, settle = text(80), [text(40) for _ in range(1000)], {}, common.settle
    items = [text(90) + pairs[i // 2] + shared + pairs[i // 2] + text(90) for i in range(2000)]

    def counted(df, name):
        out = settle(df, name)
        if name in ("substring-marks", "substring-edges"):
            sizes[name] = out.where("w1 is not null").count()
        return out
    monkeypatch.setattr(common, "settle", counted)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup_substrings(docs(items)).collect()}
    assert got == cut_brute(list(enumerate(items)))
    assert sum(n > 0 for _, n, _, _ in got.values()) == 1000
    assert sizes == {"substring-marks": 0, "substring-edges": 0}


def test_whole_groups_end_where_a_group_does():
    rng = random.Random(6)
    for rows in (1, 3, 10, 1000):
        keys = sorted((rng.randint(0, 9), rng.randint(0, 2)) for _ in range(200))
        t = pa.table({"a": [k[0] for k in keys], "b": [k[1] for k in keys], "n": list(range(200))})
        got = list(common.whole_groups(t.to_batches(max_chunksize=rng.randint(1, 40)), rows, "a", "b"))
        assert [n for g in got for n in g["n"].to_pylist()] == list(range(200))
        ends = [tuple(g.select(["a", "b"]).slice(i, 1).to_pylist()[0].values()) for g in got for i in (0, g.num_rows - 1)]
        assert all(x != y for x, y in zip(ends[1::2], ends[2::2]))
        assert len(got) == 1 if rows == 1000 else len(got) > 1


def test_cut_out_of_overlapping_and_touching_ranges(spark, frame):
    rng = random.Random(7)
    src, want, ranges = [], {}, []
    for i in range(1300):
        t = rng.choice([None, "", "é🙂", "a" * 30, "".join(rng.choices("xyzé🙂", k=rng.randint(1, 60)))])
        b = (t or "").encode()
        cuts = [(a, a + rng.randint(1, 20)) for a in (rng.randrange(len(b)) for _ in range(rng.randint(0, 5)))] if b else []
        gone = np.zeros(len(b), bool)
        for a, e in cuts:
            gone[a:e] = True
        src.append((i, 0, i, t))
        if cuts:
            ranges.append((i, 0, cuts))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()),
                   hashlib.sha256(kept).hexdigest(), kept)
    rows = common.cut_out(frame(src, "doc long, tag long, doc_id long, text string"),
                          frame(ranges, "doc long, tag long, ranges array<struct<start: long, `end`: long>>"), keep_bytes=True)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in rows.collect()} == want


# ---- chunks ----

def test_gear_is_the_rolling_hash():
    data = np.frombuffer(random.Random(2).randbytes(500), np.uint8)
    h, out = 0, []
    for b in data.tolist():
        h = (h << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
        out.append(h)
    assert chunks.gear(data).tolist() == out


def test_cuts_move_only_near_an_insertion():
    data = random.Random(5).randbytes(20_000)
    cuts = lambda b: chunks.cuts(np.frombuffer(b, np.uint8)).tolist()
    a, b = cuts(data), cuts(data[:7000] + b"inserted" + data[7000:])
    same = set(a) & ({x for x in b if x <= 7000} | {x - 8 for x in b if x > 7000})
    assert len(set(a) - same) <= 4 and a[-1] == 20_000
    assert all(y - x > chunks.REACH for x, y in zip(a, a[1:-1]))
    assert max(np.diff([0, *cuts(b"x" * 5000)])) <= chunks.MOST and cuts(b"") == []


def test_chunk_dedup_against_brute_force(spark, docs):
    items = [*shared_passages(random.Random(9)), *EDGE, *texts(spark).values()]
    seen, want = set(), {}
    for d, t in enumerate(items):
        b = (t or "").encode()
        start, left, gone = 0, [], 0
        for e in chunks.cuts(np.frombuffer(b, np.uint8)).tolist():
            c = b[start:e]
            if len(c) > chunks.REACH and c in seen:
                gone += len(c)
            else:
                left.append(c)
            seen.add(c)
            start = e
        want[d] = (len(b), gone, hashlib.sha256(b"".join(left)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in chunks.dedup_chunks(docs(items)).collect()}
    assert got == want


def test_chunks_find_planted_passages(docs):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [say(55) for _ in range(40)]
    items = [f"{say(rng.randint(30, 200))} {p} {say(rng.randint(30, 200))}" for p in passages for _ in range(2)]
    clean = [say(200) for _ in range(100)]
    got = {r.doc_id: r.n_removed for r in chunks.dedup_chunks(docs(items + clean)).collect()}
    assert all(got[2 * i + 1] > 0 for i in range(40))
    assert all(got[80 + i] == 0 for i in range(100)) and all(got[2 * i] == 0 for i in range(40))


def test_chunk_query_takes_exact_copies_whole(spark, docs, monkeypatch):
    rng = random.Random(13)
    ends = [b for b in (rng.randbytes(300).hex() for _ in range(3000))
            if np.diff([0, *chunks.cuts(np.frombuffer(b.encode(), np.uint8))])[-1] == chunks.REACH][:5]
    items = [*ends, "a", "x" * 32, "two words", "é"] * 3 + ["one of its own"]
    monkeypatch.setattr(queries.C, "table", lambda *_: docs(items))
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in queries.op4_chunking(spark, SF).collect()}
    n = len(ends) + 4
    assert n == 9 and got == {d: (len(t.encode()), len(t.encode()) if n <= d < 3 * n else 0) for d, t in enumerate(items)}


def test_chunk_query_against_brute_force(spark):
    seen, want = set(), {}
    for d, t in sorted(texts(spark).items()):
        b = (t or "").encode()
        start, left = 0, []
        for e in chunks.cuts(np.frombuffer(b, np.uint8)).tolist():
            left += [] if b[start:e] in seen else [b[start:e]]
            seen.add(b[start:e])
            start = e
        want[d] = hashlib.sha256(b"".join(left)).hexdigest()
    assert {r.doc_id: r.kept_sha256 for r in queries.op4_chunking(spark, SF).collect()} == want


# ---- sentencepiece ----

def test_pieces_equal_the_library(spark, tmp_path):
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb
    rng = random.Random(4)
    items = [*texts(spark).values(), *EDGE[1:], "  a  b ", "x" * 700, "foo_bar(baz) => {x:1}    indent\n\n\tend",
             *("".join(rng.choice("ab \n\té中🙂thein12  ") for _ in range(rng.randint(0, 60))) for _ in range(400))]
    model = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = pieces.UNIGRAM     # the same pieces as a unigram model
    for p in model.pieces:
        p.score = max(p.score, -40000.0)
    unigram = tmp_path / "unigram.model"
    unigram.write_bytes(model.SerializeToString())
    for path in (pieces.MODEL, str(unigram)):
        enc = pieces.Encoder(pieces.pieces(path))
        ids = enc.encode(items)
        assert [x.tolist() for x in ids] == sp.SentencePieceProcessor(model_file=path).encode(items)
        assert [enc.decode(x.tolist()) for x in ids] == items


def test_remembered_words_stay_within_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_BYTES", 1 << 14, raising=False)
    model = pieces.pieces(pieces.MODEL)
    enc = pieces.Encoder(model)
    lists = [[f"the w{i}x{j} of" for j in range(40)] for i in range(60)]
    got = [[x.tolist() for x in enc.encode(t)] for t in lists]
    assert len(enc.words) + len(getattr(enc, "before", {})) < 300      # of 2,400 met
    assert got == [[x.tolist() for x in pieces.Encoder(model).encode(t)] for t in lists]
    assert [x.tolist() for x in enc.encode(lists[0])] == got[0]        # forgotten words are encoded again


def test_blocks_hold_all_rows_and_few_characters(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(pieces, "BLOCK", 100)
    texts = ["x" * 30, None, "é" * 40, "y" * 500, "", "z" * 60, "a", None] * 5
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts = [b.column("text").to_pylist() for b in pieces.blocks(batch, 4)]
    assert sum(parts, []) == texts and max(map(len, parts)) <= 4
    assert all(len(x) == 1 or sum(len((t or "").encode()) for t in x) <= 100 for x in parts)
    assert list(pieces.blocks(batch.slice(0, 0))) == []


def test_encode_and_decode_frames(docs):
    src = docs([(1, "hello world"), (2, None), (3, ""), (None, "a\nb")])
    enc = pieces.encode(src)
    rows = {r.doc_id: r for r in enc.collect()}
    assert rows[2].ids == [] and rows[3].n_tokens == 0 and all(r.round_trip for r in rows.values())
    back = {r.doc_id: r.text for r in pieces.decode(enc).collect()}
    assert back == {1: "hello world", 2: "", 3: "", None: "a\nb"}


# ---- personal data ----

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def base_spans(text):
    out = []
    for m in re.finditer(EMAIL, text):
        out.append(("email", *m.span()))
    for m in re.finditer(IP, text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(CARD, text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(PHONE, text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def private_texts():
    rng = random.Random(8)
    alphabet = ["a", "b", "@", ".", "..", "-", "+", " ", "1", "25", "4", "(", ")", "é", "🙂", "_", "\n", "a@b.c", "1.2.3.4",
                "+1 (988) 555-2485", "4111 1111 1111 1111", "4111-1111-1111-1111-", "5500005555555559", "255.255.0.1"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    return out + ["a@b.c_d@e.f", "a@b..c", "a@b.c..d@e.f", "foo@bar@x.com", "1.2.3.4.5.6.7.8", "256.1.1.1 0000.1.1.1",
                  "x@" + "b." * 20000 + "c", "1-" * 20000 + "1", "1." * 9999, "+" + "1 " * 9999, "a" * 200_000, "9" * 100_000,
                  "call me: 212-555-0147 or mail me at jane (at) example (dot) org", None, ""]


def test_private_base_spans(docs):
    items = private_texts()
    got = {r.doc_id: r for r in private.find_private(docs(items)).collect()}
    assert len(got) == len(items)
    for i, t in enumerate(items):
        want = base_spans(t or "")
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in private.KINDS], t[:80]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t[:80]
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_private_loose_spans(docs):
    base = [f"please mail user{i}@site{i}.com or call +1 (212) 555-01{i:02d} today" for i in range(60)]
    spoken = [f"call me: 212-555-01{i:02d} or mail me at jane{i} (at) example (dot) org now" for i in range(20)]
    odd = [f"the order x123-456-78{i:02d}y and version 112-345-67{i:02d}z of it" for i in range(20)]
    got = {r.doc_id: r for r in private.find_private(docs(base + spoken + odd)).collect()}
    assert all(got[i].n_email == got[i].n_phone == 1 and got[i].spans.count(":") == 4 for i in range(60))
    assert all({x.split(":")[0] for x in got[60 + i].spans.split(",")} == {"email", "phone"} for i in range(20))
    assert all(got[60 + i].n_email == got[60 + i].n_phone == 0 for i in range(20))      # the base is unchanged
    assert all(got[80 + i].spans == "" for i in range(20))


def test_private_compressed_ipv6(docs):
    found = ["2001:db8::1", "fe80::1", "::1", "2001:db8::", "1:2:3:4:5:6:7::", "2001:db8:85a3::8a2e:370:7334", "1:2:3:4:5:6:7:8"]
    items = [f"the server address {a} is up" for a in found]
    none = ["std::vector", "a ::", "1:2:3:4:5:6:7:8:9::1", ":::1", "::ffff:1.2.3.4", "12345::1", "Foo::Bad"]
    rows = private.candidates(common.ordered_texts(docs(items + none), "doc_id", "text").select("doc", "tag", "text"))
    got = {(r.doc, r.start, r.end, r.form) for r in rows.where("kind = 'ip' AND NOT strict").collect()}
    assert got == {(i, 19, 19 + len(a), 1) for i, a in enumerate(found)}


def test_em_tells_good_labelers_from_bad():
    rng = random.Random(6)
    rows = Counter()
    for _ in range(20_000):
        z = rng.random() < 0.5
        good = lambda p: (1 if z else -1) if rng.random() < p else (-1 if z else 1)  # noqa: E731,B023
        rows["phone", False, (good(0.95), 1 if z and rng.random() < 0.8 else 0, good(0.9), good(0.5))] += 1
    rates, share, _ = private.reliabilities([(*k, n) for k, n in rows.items()])
    assert rates[1, 1, 1] == pytest.approx(0.95, abs=0.03) and rates[3, 1, 1] == pytest.approx(0.9, abs=0.03)
    assert rates[4, 1, 1] == pytest.approx(0.5, abs=0.05) and share["phone", False] == pytest.approx(0.5, abs=0.05)


def test_redact(docs):
    src = docs([(1, "mail a@b.cd now, 1.2.3.4"), (2, "nothing"), (3, None), (None, "é +12 345 678 90!"), (2, "nothing")])
    got = private.redact(src)
    assert got.schema.names == src.schema.names
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(1, "mail [email] now, [ip]"), (2, "nothing"), (2, "nothing"), (3, None), (None, "é [phone]!")], key=str)


# ---- pages ----

def article(h):
    a = re.search(r"<article>(.*?)</article>", h, re.S)[1]
    a = re.sub(r"<!--.*?-->", "", a, flags=re.S)
    a = re.sub(r"</?(p|h1)[^>]*>", "\x01", a)
    a = re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", a)
    return "\n\n".join(y for y in (" ".join(html.unescape(z).split()) for z in a.split("\x01")) if y)


def test_pages_keep_the_article(spark):
    rows = common.table(spark, SF, "pages").collect()
    got = {r.page_id: r for r in queries.op5_html(spark, SF).collect()}
    for p in rows:
        assert got[p.page_id].text == article(p.html) and got[p.page_id].n_chars == len(got[p.page_id].text)


LONG = "Some paragraph that is long enough, with commas, and with more words than a menu has."


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<p>", ""), ("plain &amp; text", "plain & text"), ("<script>x</script>", ""),
    (f"<div class=wrap><header><h1>Site</h1></header><div id=c><h2>T</h2><p>{LONG}</p><p>short</p></div>"
     f"<div class='comments'><p>{LONG}</p></div><div class='cookie-notice'>{LONG}</div></div>", f"T\n\n{LONG}\n\nshort"),
    (f"<body class='has-sidebar'><main><p>{LONG} <a href=x>link</a>&nbsp;end<br>line<form>f</form>", f"{LONG} link end line"),
    (f"<div><div>{LONG}</div><div>{LONG}</div><ul><li><a>one</a><li><a>two</a></ul></div>", f"{LONG}\n\n{LONG}"),
    (f"<article><header><h1>Head</h1></header><p>{LONG}<aside>{LONG}</aside><ul><li>a<li>b</ul></article>",
     f"Head\n\n{LONG}\n\na\n\nb"),
    ("<div>" * 20000 + LONG, LONG),
])
def test_pages_cases(page, want):
    assert pages.main_text(page) == want


@pytest.mark.parametrize("page,want", [
    *((f"<body><div class=ad>Buy</div><article class='{c}'><h1>T</h1><p>{LONG}</article><div>x</div>", f"T\n\n{LONG}")
      for c in ("post category-social", "post tag-search", "search")),
    *((f"<div class='{c}'><article><p>{LONG}</article></div><div class=sidebar><p>{LONG}</div>", LONG)
      for c in ("content-with-sidebar", "layout sidebar-left", "main search")),
    *((f"<div class='{c}'><div class=c><p>{LONG}<p>{LONG}</div></div><div>Somebody, somewhere, all rights reserved</div>",
       f"{LONG}\n\n{LONG}") for c in ("content-with-sidebar", "layout sidebar-left")),
    (f"<main><div class='layout sidebar-left'><div><p>{LONG}</div><div class=sidebar><p>{LONG}</div></div></main>", LONG),
    (f"<article><p>{LONG}<section id=related-work><h2 id=related>R</h2><p>few</section><h2 id=search>S</h2><p>{LONG}"
     f"<section id=related-work><p>{LONG}</section></article>", f"{LONG}\n\nR\n\nfew\n\nS\n\n{LONG}\n\n{LONG}"),
    (f"<div class=side><div class=widget><p>{LONG}</div></div>", LONG),
    (f"<div id=comments><p>{LONG}</p></div>", LONG),
    # boxes stay out, however long
    (f"<article><p>{LONG}<div class=share><a>one</a> <a>two</a></div><div id=sidebar><p>{LONG}</div><div class=comments>"
     f"<article class=comment><p>{LONG * 9}</article></div></article><div class=comment-list><article><p>{LONG * 9}"
     f"</article></div><section class=related><article><h3><a>{LONG}</a></h3><p>teaser</article></section>", LONG),
])
def test_pages_names_are_hints(page, want):
    assert pages.main_text(page) == want


LINKS = "<ul><li><a>First source</a><li><a>Second source</a></ul>"
LISTED = "First source\n\nSecond source"


@pytest.mark.parametrize("page,want", [
    (f"<article><p>{LONG}{LINKS}<table><tr><td><a>cell</a></table></article>{LINKS}", f"{LONG}\n\n{LISTED}\n\ncell"),
    (f"<main><p>{LONG}<section><h2>Read</h2>{LINKS}</section></main>", f"{LONG}\n\nRead\n\n{LISTED}"),
    (f"<div>{LINKS}<p>{LONG}<p>{LONG}<h3>Sources</h3>{LINKS}<div><h3>More</h3>{LINKS}</div></div>",
     f"{LONG}\n\n{LONG}\n\nSources\n\n{LISTED}\n\nMore\n\n{LISTED}"),
    (f"<body>{LINKS}<h1>Title</h1><article><p>{LONG * 9}</article><article><p>Second.</article><p>After.<ul><li><a>x</a></ul>",
     f"Title\n\n{LONG * 9}\n\nSecond.\n\nAfter."),
    (f"<div><section><article><p>{LONG}</article></section><section><article><p>B {LONG}</article></section></div>"
     f"<div><article><p>C {LONG}</article></div>", f"{LONG}\n\nB {LONG}\n\nC {LONG}"),
    (f"<div><div><p>{LONG * 9}<p>{LONG * 9}</div><div><p>{'word ' * 60}, a, b</p></div><div><a>{LONG}</a></div>Loose <b>end</b>.</div>",
     f"{LONG * 9}\n\n{LONG * 9}\n\n{'word ' * 60}, a, b\n\nLoose end."),
    (f"<div><div><p>{LONG}</div><div><p>Another short paragraph here</div><div>Home</div></div>",
     f"{LONG}\n\nAnother short paragraph here"),
    (LINKS, LISTED),
])
def test_pages_keep_whole_articles(page, want):
    assert pages.main_text(page) == want


# ---- all of them ----

@pytest.mark.parametrize("fn", [quality.quality, mixing.mix, mixing.mixed, near.near_duplicates, near.drop_near_duplicates,
                                substrings.dedup_substrings, chunks.dedup_chunks, pieces.encode, private.find_private,
                                private.redact, quality.filter_quality])
def test_empty_tables_and_clashing_columns(frame, fn):
    empty = frame([], DOCS)
    assert fn(empty).count() == 0
    names = "doc_id long, text string, source string, size long, doc long, tag long, kept boolean, a long, value long, n int"
    t = "mail x@y.zz " + " ".join(f"w{i}" for i in range(30))
    rows = frame([(1, t, "s", 5, 6, 7, True, 8, 9, 1), (2, t, None, None, None, None, None, None, None, None),
                  (None, None, None, None, None, None, None, None, None, None)], names)
    assert fn(rows).count() >= 0


# ---- equal results in every process and order ----

def test_random_tables_do_not_depend_on_import_order():
    import subprocess
    import sys
    code = ("import importlib; [importlib.import_module('tessera.llm.' + m) for m in %r]; "
            "from tessera.llm import chunks, common, substrings; import hashlib; "
            "print(*(hashlib.sha256(t.tobytes()).hexdigest() for t in "
            "(common.BYTE, chunks.GEAR, chunks.SECOND, substrings.TABLE2)))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(common.__file__ + "/..")))
    got = {subprocess.run([sys.executable, "-c", code % (order,)], cwd=root, capture_output=True, text=True, check=True).stdout
           for order in (["chunks", "substrings", "near"], ["substrings", "chunks"], ["near", "vectors", "substrings"])}
    assert len(got) == 1 and len(set(next(iter(got)).split())) == 4


def test_chunks_after_substrings_in_one_session(docs):
    src = docs([*shared_passages(random.Random(9)), *EDGE])
    key = lambda rows: sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in rows)
    first = key(chunks.dedup_chunks(src).collect())
    substrings.dedup_substrings(src).collect()         # the workers have imported the other module now
    assert key(chunks.dedup_chunks(src).collect()) == first


def redacted(text, spans):
    """The plain way: from left to right, one span after the other."""
    at, out = 0, []
    for s, e, k in sorted(spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"[{k}]"]
        at = e
    return "".join([*out, text[at:]])


def test_redact_many_spans_in_one_text(docs):
    import time
    line = "mail user{0}@site{0}.com or call +1 (212) 555-01{1:02d}, é🙂 from 10.0.{1}.1 now\n"
    long = "".join(line.format(i, i % 100) for i in range(30_000))
    items = [long, "plain", None, "", "a@b.co", "x" * 256 + "a@b.co", "a@b.co" + "y" * 506, "y" * 250 + "a@b.co 1.2.3.4"]
    src = docs(items)
    t = time.time()
    got = {r.doc_id: r.text for r in private.redact(src).collect()}
    assert time.time() - t < 60
    spans = {r.doc_id: r.spans for r in private.find_private(src).collect()}
    for i, text in enumerate(items):
        found = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in (spans[i] or "").split(",") if x)]
        assert got[i] == (None if text is None else redacted(text, found))
    assert got[0].count("[email]") == got[0].count("[phone]") == got[0].count("[ip]") == 30_000


def test_clashing_names_stay(frame):
    cols = "doc_id long, text string, lang string, source string, n_chars long, k1 string, `__key` string, tag string, Found string"
    rows = [(i, "mail me at a@b.com and on", "en", "s", 5, f"a{i}", f"k{i}", f"t{i}", f"f{i}") for i in range(4)]
    src = frame(rows, cols)
    out = private.redact(src)
    assert out.columns == src.columns
    assert sorted(map(tuple, out.collect())) == [(r[0], "mail me at [email] and on", *r[2:]) for r in rows]
    out = mixing.mixed(src)
    assert out.columns == src.columns and out.schema == src.schema
    assert {tuple(r) for r in out.collect()} == set(rows)


def test_mixing_of_very_large_sources(frame):
    sizes = [("a", 5 * 10**15), ("b", 10**12), (None, 7), ("z", 0)] + [(f"s{i:04d}", 10**12 + i) for i in range(1000)]
    got = {r.source: r for r in mixing.targets(frame(sizes, "source string, source_size long")).collect()}
    total = sum(n for _, n in sizes)
    assert abs(sum(r.target for r in got.values()) - total) < 1e-6 * total or all(
        abs(r.target - 3 * r.source_size) < 1 for r in got.values())
    assert all(r.target <= 3 * r.source_size for r in got.values()) and got["z"].target == 0


# ---- pages that are not well formed ----

ARTICLE = "<article><h1>Title</h1><p>" + "A long sentence, with commas, and some words. " * 8 + "</p></article>"


def test_pages_with_bogus_declarations():
    assert pages.main_text("<p>x <![foo[bar]]> and more</p><![ x") == "x and more"
    assert pages.main_text("<!DOCTYPE a [ <!ELEMENT b c> ]><p>hello world</p><!-- open <p>gone</p>") == "hello world"
    rng = random.Random(3)
    parts = ["<", "![", "<!", "<!--", "-->", "]]>", "[", ">", "<p", "</p>", "<a href=", "'", '"', "&#", "&#x1;", "&amp", "text ",
             "<?", "<!doctype ", "<script>", "</script", "<svg>", "</", "/>", "<form>", "cdata[", "temp[", "if", "\x00", "\ud800"]
    for _ in range(5000):
        pages.main_text("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))))
        pages.main_text("".join(chr(rng.choice([60, 33, 91, 93, 62, 45, 47, 38, 35, 97, 32, 34, 39, 63])) for _ in range(20)))


def test_pages_inside_a_form_or_hidden_body():
    want = pages.main_text(f"<body>{ARTICLE}</body>")
    assert want.startswith("Title\n\nA long sentence, with")
    assert pages.main_text(f"<body><form id=f><nav>menu</nav>{ARTICLE}<button>go</button></form></body>") == want
    assert pages.main_text(f"<body aria-hidden='true'>{ARTICLE}</body>") == want
    assert pages.main_text(f"<body><div aria-hidden='true'>{ARTICLE}</div></body>") == want
    assert pages.main_text(f"<body>{ARTICLE}<form><p>Sign up here, for news, and more news.</p></form></body>") == want


def test_pages_edge_rows(frame):
    cols = "page_id long, url string, html string, text int, n_chars string"
    assert pages.extract(frame([], cols)).count() == 0
    rows = [(None, None, None, 1, "a"), (1, "u", "", None, None), (2, "u", ARTICLE, 2, "b"), (2, "u", ARTICLE, 2, "b"),
            (None, "v", "<p>x</p>" * 5000, 3, "c")]
    out = sorted(map(tuple, pages.extract(frame(rows, cols)).collect()), key=str)
    text = pages.main_text(ARTICLE)
    assert out == sorted([(None, None, "", 0), (1, "u", "", 0), (2, "u", text, len(text)), (2, "u", text, len(text)),
                          (None, "v", "\n\n".join("x" * 5000), 14998)], key=str)


LONG = "This is a sentence of the article, long enough to count, with commas and words. "


def commented(items, box="ol", head="<h2>3 Responses</h2>", after=""):
    return (f"<body><main><h1>Title</h1><p>{LONG * 3}</p><p>{LONG * 2}</p><section id='responses'>{head}<{box}>"
            + "".join(items) + f"</{box}></section>{after}</main></body>")


def test_pages_comments_by_place_and_repetition():
    text = " ".join((LONG * 3).split()), " ".join((LONG * 2).split())
    want = "\n\n".join(["Title", *text])
    dated = [f"<li class='c'><div>Jane {i}</div><p>I liked this one, really.</p></li>" for i in range(3)]
    timed = [f"<div class='eintrag'><span>{n}</span><time>heute</time><p>Das sehe ich anders, ganz anders.</p></div>" for n in ("Anna", "Max")]
    labelled = [f"<li><b>{n}</b><p>Well said, thank you for this.</p><p><a href='#'>Antworten</a></p></li>" for n in ("Anna", "Max", "Eva")]
    assert pages.main_text(commented(dated)) == want
    assert pages.main_text(commented(timed, "div", "")) == want
    assert pages.main_text(commented(labelled)) == want
    # not comments: questions and answers, bios without dates, lists before the text ends, one element
    faq = [f"<li><p>How many are there in {i}?</p><p>As many as you like, we think.</p></li>" for i in range(3)]
    bios = [f"<li><p>{n} Doe</p><p>{n} works on the roof, in the sun.</p></li>" for n in ("Jane", "John")]
    steps = [f"<div class='step'><h3>Step {i}</h3><p>Do this, and then that, slowly.</p></div>" for i in range(3)]
    for items, box in ((faq, "ol"), (bios, "ul"), (steps, "div"), (dated[:1], "ol")):
        got = pages.main_text(commented(items, box))
        assert all(" ".join(re.sub("<[^>]*>", " ", x).split())[-20:] in got.replace("\n\n", " ") for x in items)
    got = pages.main_text(commented(dated, after=f"<p>{LONG * 2}</p>"))
    assert got.count("I liked this one") == 3 and got.endswith(text[1])
