"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths, as NumPy arrays over one
whole text, show how many of its characters lie inside n-grams, or lines,
that stood in the same text before.  A text is rejected by the base rules
(too few words; too many words inside repeated 8-word windows) or when the
share of characters in repeated n-grams of any length, or in repeated lines,
is above that length's limit.

Every document is judged alone, so the job is a scan with one Arrow pass and
no shuffle.

Defined results: a null or empty text, or one of white space, has no words and
is rejected (fewer than ``MIN_WORDS``).  Rows are kept as they come: repeated
rows give repeated results, an empty table gives none, other columns of the
input are not read.  A text of any length is measured whole; memory is a few
dozen bytes per byte of the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

MIN_WORDS = 20
WINDOW = 8                     # base rule: words in windows of this length ...
MAX_REPEAT_PERCENT = 30        # ... that occur twice or more
# Largest share of word characters in n-grams seen before, by length, and in lines seen before.
MAX_NGRAM = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
MAX_LINE = 0.20
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in MAX_NGRAM)
          + ", base_failed boolean, kept boolean")


def _covered(first: np.ndarray, n: int, m: int) -> np.ndarray:
    """Which of m words lie in an n-gram whose start is marked in ``first``."""
    step = np.zeros(m + 1, np.int64)
    step[:len(first)] += first
    step[n:n + len(first)] -= first
    return np.cumsum(step[:m]) > 0


def repeated(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seen elsewhere too, seen before) for each value of ``h``."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    twice, later = np.empty(len(h), bool), np.empty(len(h), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def measure(text) -> tuple:
    """The measures of one text, in the order of ``SCHEMA``."""
    data = C.utf8(text)
    start, end = C.word_bounds(data)
    m = len(start)
    points = np.zeros(len(data) + 1, np.int64)        # code points before each byte
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[end] - points[start]
    word_chars = int(chars.sum())
    c = C.prefix_hash(data)
    words = C.range_hash(c, start, end)

    breaks = np.flatnonzero(data == 10)
    ls, le = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(data)]))
    first = np.searchsorted(start, ls)                # words of each line
    last = np.searchsorted(start, le)
    full = last > first
    _, dup_line = repeated(C.range_hash(c, ls[full], le[full]))
    in_line = np.concatenate(([0], np.cumsum(chars)))
    line_chars = int((in_line[last[full]] - in_line[first[full]])[dup_line].sum())

    repeat_words, dup = 0, {}
    for n in MAX_NGRAM:
        if m < n:
            dup[n] = 0
            continue
        twice, later = repeated(C.ngram_hash(words, n))
        dup[n] = int(chars[_covered(later, n, m)].sum()) if later.any() else 0
        if n == WINDOW:
            repeat_words = int(_covered(twice, n, m).sum())
    failed = m < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PERCENT * m
    kept = not failed and line_chars <= MAX_LINE * word_chars and all(
        dup[n] <= MAX_NGRAM[n] * word_chars for n in MAX_NGRAM)
    return (m, word_chars, int(SYMBOL[data].sum()), int(dup_line.sum()), repeat_words,
            line_chars, *dup.values(), failed, kept)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measures, base_failed, kept) for each row of ``docs``."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = "doc_id long, " + SCHEMA
    arrow = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.bool_())
                       for f in out.split(", ")])
    fn = C.per_row(lambda r: (r[0], *measure(r[1])), ["doc_id", "text"], arrow)
    return src.mapInArrow(fn, out)


def filter_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, unchanged, with their own columns."""
    schema = docs.schema

    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index(text_col))
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield part.filter(pa.array([measure(t)[-1] for t in col.slice(i, 512).to_pylist()], pa.bool_()))
    return docs.mapInArrow(run, schema)
