"""SentencePiece encoding and decoding by batched Viterbi in NumPy.

A model file gives the pieces with their scores.  Texts are split where no
piece can cross (before a run of spaces, and around line breaks when no piece
holds one); a worker remembers the ids of the words it met last, within
``KEPT_BYTES``, and works on blocks of ``BLOCK`` characters, so what it holds
does not grow with the rows it has seen.  Words of equal
length advance together, one position at a time: hashes of all substrings up to
the longest piece probe the sorted piece keys, the maximum over the pieces that
end at a position is taken for all words at once, and its piece is stored as
the backpointer.

* Unigram models: the path score is the sum of the piece scores; the longest
  piece wins ties.
* BPE models are no sum of scores (the most probable path differs from the
  merge order's on most words).  Here a path is admissible when merging each
  pair of neighbouring pieces alone gives just this pair.  The merge order's
  segmentation is the only admissible path, since merges on both sides of a
  boundary do not depend on each other until one crosses it.  So the last piece
  of each prefix is the one whose pair with the prefix before it is admissible;
  the maximum runs over these.  Pairs are judged in batches by replaying the
  merges of both pieces in order, and remembered.

Ids equal those of the reference library for both kinds.  Characters outside
the vocabulary become their UTF-8 bytes (byte fallback) or the unknown id.

Defined results: null and empty texts have no ids; U+2581 counts as a space;
decoding gives back the text (without byte fallback, unknown characters become
U+2047).  Repeated rows give repeated results; an empty table gives no rows;
other columns are not read.  Words of any length are encoded whole.

The model is read on the driver and broadcast; its size is checked
(``MAX_PIECES``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_PIECES = 1 << 20
MARK = "▁"
KEPT_BYTES = 1 << 25           # of words remembered per worker, twice: those met last and those before
KEPT_PAIRS = 1 << 21
BLOCK = 1 << 22                # characters of texts encoded at once, or one longer text
CELLS = 1 << 21                # substrings probed at once
FILTER = 1 << 22
UNIGRAM, BPE = 1, 2
ENTRY = 100                    # bytes of a dictionary for an entry
NONE = -np.inf


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _char(points: np.ndarray) -> np.ndarray:
    return C.mix(points.astype(C.U64) + C.U64(0x632BE59BD9B4E019))


class Pieces:
    """The tables of a model file: piece keys, scores, merges of each piece."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if len(model.pieces) > MAX_PIECES:
            raise ValueError(f"{len(model.pieces)} pieces; at most {MAX_PIECES} are broadcast")
        spec = model.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.bytes = np.full(256, -1, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self.fallback = bool((self.bytes >= 0).all())
        normal = np.array([i for i, p in enumerate(model.pieces) if p.type == 1])
        n = len(self.pieces)
        self.none = n                                  # stands for a character outside the vocabulary
        self.score = np.full(n + 1, 0, np.float32)
        self.score[:n] = [p.score for p in model.pieces]
        self.unknown_score = np.float32(self.score[normal].min() - 10.0)
        self.longest = max(len(self.pieces[i]) for i in normal)
        # unmixed hashes and lengths, so that two pieces' concatenation can be looked up
        self.raw, self.size = np.zeros(n + 1, C.U64), np.ones(n + 1, np.int64)
        p, _ = C.powers(self.longest + 1)
        for i in normal:
            c = _char(_points(self.pieces[i]))
            self.raw[i], self.size[i] = (c * p[:len(c)]).sum(dtype=C.U64), len(c)
        self.raw[n] = C.U64(0x1B873593CC9E2D51)
        keys = C.mix(self.raw[normal] + self.size[normal].astype(C.U64))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], normal[order].astype(np.int32)
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        # the low bits that some key has: most substrings are no piece and need no search
        self.filter = np.zeros(min(FILTER, 32 << len(normal).bit_length()), bool)
        self.filter[self.keys & C.U64(len(self.filter) - 1)] = True
        crossing = any(MARK in self.pieces[i].lstrip(MARK) for i in normal)
        lines = any("\n" in self.pieces[i] for i in normal)
        self.pattern = ("(?s).+" if crossing else f"{MARK}+[^{MARK}]*|[^{MARK}]+" if lines
                        else f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        if self.kind == BPE:
            self._merges(normal)

    def _merges(self, normal) -> None:
        """For each piece, the scores of its merges in order and its first and
        last symbol before each; pieces that merging does not give back are
        never used."""
        at = {self.pieces[i]: i for i in normal.tolist()}
        score = self.score.tolist()
        steps, firsts, lasts, offset = [], [], [], [0]
        self.usable = np.zeros(self.none + 1, bool)
        for i in range(self.none + 1):
            parts = list(self.pieces[i]) if i < self.none and self.pieces[i] in at else []
            ids = [at.get(x, self.none) for x in parts] or [i]
            done = []
            firsts.append(ids[0])
            lasts.append(ids[-1])
            while len(parts) > 1:
                joined = [at.get(x + y) for x, y in zip(parts, parts[1:])]
                best = max((score[j], -k) for k, j in enumerate(joined) if j is not None) if any(
                    j is not None for j in joined) else None
                if best is None:
                    break
                k = -best[1]
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
                ids[k:k + 2] = [joined[k]]
                done.append(best[0])
                firsts.append(ids[0])
                lasts.append(ids[-1])
            steps += [*done, NONE]
            offset.append(len(steps))
            self.usable[i] = i == self.none or (len(parts) == 1 and ids[0] == i)
        self.steps, self.offset = np.array(steps), np.array(offset[:-1])
        self.firsts, self.lasts = np.array(firsts), np.array(lasts)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these keys, -1 where there is none."""
        out = np.full(keys.shape, -1, np.int32)
        may = self.filter[keys & C.U64(len(self.filter) - 1)]
        keys = keys[may]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out[may] = np.where(self.keys[at] == keys, self.ids[at], np.int32(-1))
        return out

    def admissible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a and b gives back (a, b)."""
        p, _ = C.powers(self.longest + 1)
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        i, j = self.offset[a].copy(), self.offset[b].copy()
        while len(live):
            x, y = self.lasts[i[live]], self.firsts[j[live]]
            size = self.size[x] + self.size[y]
            joined = self.probe(C.mix(self.raw[x] + self.raw[y] * p[self.size[x]] + size.astype(C.U64)))
            cross = np.where(joined >= 0, self.score[joined], NONE)
            left, right = self.steps[i[live]], self.steps[j[live]]
            bad = (cross > left) & (cross >= right) & (joined >= 0)
            out[live[bad]] = False
            go_left = left >= right
            more = ~bad & (np.maximum(left, right) > NONE)
            i[live[more & go_left]] += 1
            j[live[more & ~go_left]] += 1
            live = live[more]
        return out


class Encoder:
    """Encodes texts; remembers words and pairs (one per Python worker)."""

    def __init__(self, model: Pieces):
        self.m = model
        self.split = re.compile(model.pattern).findall
        self.words: dict[str, bytes] = {}    # ids as int32 bytes, which join fast
        self.before: dict[str, bytes] = {}   # words remembered until they are met again
        self.held = 0                        # bytes of the words met last
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.plain = [x.replace(MARK, " ").encode() for x in model.pieces]
        for b, i in enumerate(model.bytes.tolist()):
            if i >= 0:
                self.plain[i] = bytes([b])
        self.plain[model.unknown] = "⁇".encode()

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * (self.m.none + 1) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
        known = self.pair_keys[at] == key if len(self.pair_keys) else np.zeros(len(key), bool)
        if not known.all():
            new = np.unique(key[~known])
            ok = self.m.admissible(new // (self.m.none + 1), new % (self.m.none + 1))
            if len(self.pair_keys) + len(new) > KEPT_PAIRS:
                new = np.unique(key)
                ok = self.m.admissible(new // (self.m.none + 1), new % (self.m.none + 1))
                self.pair_keys, self.pair_ok = new, ok
            else:
                into = np.searchsorted(self.pair_keys, new)
                self.pair_keys = np.insert(self.pair_keys, into, new)
                self.pair_ok = np.insert(self.pair_ok, into, ok)
            at = np.searchsorted(self.pair_keys, key)
        return self.pair_ok[at]

    def viterbi(self, points: np.ndarray) -> list[tuple[np.ndarray, bool]]:
        """Ids of words of one length (rows of code points), and whether they
        have characters outside the vocabulary."""
        m = self.m
        n, length = points.shape
        p, q = C.powers(length + 1)
        c = np.zeros((n, length + 1), C.U64)
        np.cumsum(_char(points) * p[:length], axis=1, out=c[:, 1:])
        spans = min(m.longest, length)
        # piece[s][:, i]: id of the substring of s + 1 characters from i
        piece = [m.probe(C.mix((c[:, s:] - c[:, :-s]) * q[:length + 1 - s] + C.U64(s)))
                 for s in range(1, spans + 1)]
        piece[0] = np.where(piece[0] < 0, np.int32(m.none), piece[0])
        best = np.zeros((n, length + 1), np.float32)
        back = np.full((n, length + 1), -1, np.int32)
        rows = np.arange(n)
        for e in range(1, length + 1):
            # candidates that end here, the longest first
            sizes = range(min(spans, e), 0, -1)
            cand = np.stack([piece[s - 1][:, e - s] for s in sizes], axis=1)
            begin = e - np.array(sizes)
            if m.kind == UNIGRAM:
                own = np.where(cand == m.none, m.unknown_score, m.score[cand])
                total = np.where(cand >= 0, best[:, begin] + own, np.float32(NONE))
            else:
                last = back[:, begin]
                ok = (cand >= 0) & m.usable[cand] & ((last >= 0) | (begin == 0))
                r, k = np.nonzero(ok & (begin > 0))
                ok[r, k] = self._pairs(last[r, k], cand[r, k])
                total = np.where(ok, np.float32(0), np.float32(NONE))
            top = total.argmax(axis=1)
            best[:, e] = total[rows, top]
            back[:, e] = np.where(best[:, e] > NONE, cand[rows, top], -1)
        # follow the backpointers of all words together
        out, at = [], np.full(n, length)
        while (at > 0).any():
            ids = np.where(at > 0, back[rows, at], -1)
            if (ids[at > 0] < 0).any():
                raise AssertionError("a word without a segmentation")
            out.append(ids)
            at = at - np.where(ids >= 0, np.where(ids == m.none, 1, m.size[ids]), 0)
        grid = np.array(out[::-1], np.int32).T
        unknown = (grid == m.none).any(axis=1)
        return [(g[g >= 0], u) for g, u in zip(grid, unknown.tolist())]

    def _finish(self, word: str, ids: np.ndarray) -> np.ndarray:
        """Characters outside the vocabulary as bytes, or as the unknown id."""
        out, at = [], 0
        for i in ids.tolist():
            if i != self.m.none:
                out.append(i)
                at += int(self.m.size[i])
            else:
                if self.m.fallback:
                    out += self.m.bytes[list(word[at].encode("utf-8", "replace"))].tolist()
                elif not (out and out[-1] == self.m.unknown):
                    out.append(self.m.unknown)
                at += 1
        return np.array(out, np.int32)

    def _keep(self, word: str, ids: bytes) -> None:
        self.words[word] = ids
        self.held += getsizeof(word) + getsizeof(ids) + ENTRY

    def recall(self, word: str) -> bytes | None:
        """The remembered ids of a word."""
        ids = self.words.get(word)
        if ids is None:
            ids = self.before.get(word)
            if ids is not None:
                self._keep(word, ids)
        return ids

    def learn(self, words) -> None:
        """Encode words that are not remembered, equal lengths together."""
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for length, group in by.items():
            step = max(1, CELLS // (length * min(self.m.longest, length)))
            for i in range(0, len(group), step):
                part = group[i:i + step]
                points = _points("".join(part)).reshape(len(part), length)
                for w, (ids, unknown) in zip(part, self.viterbi(points)):
                    self._keep(w, (self._finish(w, ids) if unknown else ids).tobytes())

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each text."""
        if self.held > KEPT_BYTES:
            self.before, self.words, self.held = self.words, {}, 0
        known, recall, new, rows = self.words.get, self.recall, {}, []
        for t in texts:
            t = (t or "").encode("utf-8", "replace").decode().replace(" ", MARK)
            # of each word the remembered ids, or the one copy of the word itself until it is learnt
            rows.append([known(w) or recall(w) or new.setdefault(w, w)
                         for w in (self.split(MARK + t if self.m.prefix else t) if t else [])])
        self.learn(new)
        at = self.words.__getitem__
        return [np.frombuffer(b"".join([x if type(x) is bytes else at(x) for x in ws]), np.int32) for ws in rows]

    def decode(self, ids) -> str:
        plain = self.plain
        text = b"".join([plain[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.m.prefix and text[:1] == " " else text


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder of a broadcast model."""
    if shared.value is not getattr(_ENCODERS.get(0), "m", None):
        _ENCODERS[0] = Encoder(shared.value)
    return _ENCODERS[0]


def blocks(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of up to ``rows`` rows and ``BLOCK`` characters (in UTF-8 bytes)
    of text, or of one row with a longer text."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        full = int(np.searchsorted(end, end[at] - size[at] + BLOCK, side="right"))
        to = min(max(full, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, round_trip) for each row:
    round_trip tells whether decoding the ids gives the text."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces(model))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())),
                        ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])

    def run(batches):
        enc = _encoder(shared)
        for b in batches:
            for rows in blocks(b):
                texts = rows.column("text").to_pylist()
                ids = enc.encode(texts)
                off = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=off[1:])
                digest, same = [], []
                for x, t in zip(ids, texts):
                    back = enc.decode(x.tolist())
                    digest.append(hashlib.sha256(back.encode()).hexdigest())
                    same.append(back == (t or ""))
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), pa.array(np.diff(off).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids))),
                    pa.array(digest), pa.array(same)], schema=schema)
        pa.default_memory_pool().release_unused()
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) from token ids (null ids: null text)."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces(model))
    src = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        enc = _encoder(shared)
        yield from C.per_row(lambda r: (r[0], None if r[1] is None else enc.decode(r[1])),
                             ["doc_id", "ids"], schema)(batches)
    return src.mapInArrow(run, "doc_id long, text string")
