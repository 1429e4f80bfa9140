"""Chats and vectors against brute force, and their defined edge cases."""

import itertools
import random

import numpy as np
import pytest

from tessera.llm import chat, common, vectors

TURNS = "conv_id long, turn long, role string, text string, part int"


def best_cost(roles):
    """Least cost over every choice of moves."""
    codes = [chat.code(r) for r in roles]
    best = None
    for path in itertools.product(*[chat.moves(c) for c in codes]):
        s = chat.START
        for m in path:
            if m[0] != s:
                break
            s = m[1]
        else:
            c = sum(m[2] for m in path)
            best = c if best is None else min(best, c)
    return best


def legal(text):
    """The roles of a rendered conversation."""
    roles = [x.split("|>\n")[0] for x in text.split("<|end|>\n")[:-1]]
    roles = [r.removeprefix("<|") for r in roles]
    s = chat.START
    for r in roles:
        assert chat.ROLES.index(r) in chat.NEXT[s]
        s = chat.ROLES.index(r)
    return roles


@pytest.mark.parametrize("partitions", [1, 7])
def test_chats_are_repaired_at_least_cost(spark, frame, partitions):
    rng = random.Random(1)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 3)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "bot", None, "user"]), f"t{turn}", 0))
    long = [(None, i, rng.choice(["user", "assistant", "system"]), None if i % 50 == 0 else f"x{i}", 0) for i in range(2000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        out = chat.format_chats(frame(rows + long, TURNS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(out) == len(rows) + len(long)
    got = {}
    for r in sorted(out, key=lambda r: (r.conv_id is None, r.conv_id, r.part, r.seq)):
        got.setdefault(r.conv_id, []).append(r)
    for conv, rs in got.items():
        text = "".join(r.piece for r in rs)
        legal(text)
        src = sorted((x for x in rows + long if x[0] == conv), key=lambda x: x[1])
        assert [r.turn for r in rs] == [x[1] for x in src]
        at = 0
        for x in src:
            at = text.index(x[3] or "", at)
        cost = sum(r.cost for r in rs)
        if conv is None:
            assert len({r.part for r in rs}) == (1 if partitions == 1 else len({r.part for r in rs}))
            assert cost == int(chat.stretch([chat.code(x[2]) for x in src])[chat.START].min())
        else:
            assert cost == best_cost([x[2] for x in src])


def test_legal_chats_stay(frame):
    rows = [(1, 0, "system", "s", 0), (1, 1, "user", "u", 0), (1, 2, "assistant", "a", 0), (2, 0, "user", "x", 0)]
    out = chat.format_chats(frame(rows, TURNS)).collect()
    assert all(r.action == "keep" and r.cost == 0 for r in out)
    one = "".join(r.piece for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: (r.part, r.seq)))
    assert one == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"
    assert chat.format_chats(frame([], TURNS)).count() == 0


def vectors_brute(rows, c=0.95):
    ok = {}
    for i, (k, v) in enumerate(rows):
        if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            ok[i] = x / np.sqrt((x * x).sum())
    links, root = {i: 0 for i in range(len(rows))}, {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(ok, 2):
        if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= c:
            links[a] += 1
            links[b] += 1
            p, q = find(rows[a][0]), find(rows[b][0])
            root[max(p, q)] = min(p, q)
    return sorted((str(k), links[i], str(None if k is None else find(k))) for i, (k, _) in enumerate(rows))


def vector_rows(seed, n=400, dim=12):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist()) for i in range(n)]
    centre = rng.normal(size=dim)
    for r in (0.02, 0.1, 0.3):                         # balls of near copies: all, most and some linked
        n = len(rows)
        rows += [(n + i, (centre + r * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(120)]
        centre = centre + 0.6 * rng.normal(size=dim)
    n = len(rows)
    rows += [(n + i, rows[-1][1]) for i in range(30)]
    rows += [(9000, (2 * np.array(rows[3][1])).tolist()), (9001, None), (9002, []), (9003, [0.0] * dim),
             (9004, [float("nan")] + [1.0] * (dim - 1)), (9005, [float("inf")] * dim), (9006, [None] + [1.0] * (dim - 1)),
             (9007, [1.0, 0.0]), (9008, [1.0, 0.01]), (None, rows[3][1]), (9009, [3e38] * dim), (9010, [-0.0] * (dim - 1) + [1.0]),
             (9011, [0.0] * (dim - 1) + [1.0])]
    rng.shuffle(rows)
    return [(k if k is None else int(k), v) for k, v in rows]


@pytest.mark.parametrize("shard,cell", [(8192, 4096), (64, 100)])
def test_vectors_against_brute_force(frame, shard, cell, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "PER_CELL", cell)
    monkeypatch.setattr(vectors, "DIRECT", shard)
    rows = vector_rows(shard)
    src = frame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, v int")
    out = vectors.near_vectors(src).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out) == vectors_brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


@pytest.mark.parametrize("direct", [1, 64, 1 << 20])
def test_cover_tree_covers_and_nests(direct, monkeypatch):
    monkeypatch.setattr(vectors, "DIRECT", direct)
    rng = np.random.default_rng(2)
    x = vectors.unit(np.concatenate([rng.normal(size=(200, 5)), 1 + 0.01 * rng.normal(size=(200, 5))]))
    t = vectors.CoverTree.load(vectors.CoverTree(x).dump())
    assert sorted(t.points.tolist()) == list(range(400))
    for i in range(len(t.lo)):
        d = np.sqrt(((x[t.under(i)] - x[t.centre[i]]) ** 2).sum(1))
        assert d.max() <= t.radius[i] + 1e-7
        if t.last[i]:
            assert sorted(p for k in t.kids(i) for p in t.under(k)) == sorted(t.under(i))
    for a, b in ((x, None), (x[:150], x[150:])):
        links = vectors.traverse(vectors.CoverTree(a), None if b is None else vectors.CoverTree(b),
                                 np.ones(400, np.int64), 0.95)
        g = x @ x.T >= 0.95
        if b is not None:
            g[:150, :150] = g[150:, 150:] = False
        np.fill_diagonal(g, False)
        assert links.count.tolist() == g.sum(1).tolist()


def test_empty_vectors(frame):
    assert vectors.near_vectors(frame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(frame):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.id: r.component for r in common.components(frame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert common.components(frame([], "a long, b long")).count() == 0


def test_tied_turns_do_not_depend_on_partitions(spark, frame):
    rng = random.Random(3)
    rows = [(c, t // 4, "user", f"text {rng.randrange(10**6)}", 0) for c in range(3) for t in range(40)]
    rows += [(9, 0, "user", f"x {i}", 0) for i in range(40)] + [(9, 0, "user", "x 1", 0)]
    old, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in (1, 7, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            out = chat.format_chats(frame(rows, TURNS)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        out.sort(key=lambda r: (r.conv_id, r.part, r.seq))
        got.append([(r.conv_id, r.turn, r.action, r.cost, r.piece) for r in out])
    assert got[0] == got[1] == got[2]


def test_vectors_with_extreme_components(frame):
    tiny = 5e-324
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1e-200]), (2, [0.0, 1e200]), (3, [1.0, 1.0]), (4, [tiny, 0.0]), (5, [-1e308, 1e308]),
            (6, [-1.0, 1.0]), (7, [1e308, 1e308])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in
           vectors.near_vectors(frame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {0: (1, 0), 4: (1, 0), 1: (1, 1), 2: (1, 1), 3: (1, 3), 7: (1, 3), 5: (1, 5), 6: (1, 5)}
