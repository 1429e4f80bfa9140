"""String, list, map, base64 and array helpers as JVM-side Column expressions.

Each keeps the exact semantics noted next to it; none runs Python per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "base64_encode", "base64_decode", "list_join", "jvm_trim", "split_trim", "split_first",
    "array_index_of", "map_first", "map_join", "random_name", "uniform", "double_to_string",
    "vector_to_csv", "csv_to_vector", "to_float_array", "check_width",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base64_encode(b) -> Column:
    """Standard base64 on one line (Spark's ``base64`` wraps every 76 chars)."""
    return F.regexp_replace(F.base64(_c(b)), r"[\r\n]", "")


def base64_decode(s, strict: bool = True) -> Column:
    """Decode standard base64 text, padding optional, as the JVM's basic
    decoder: any character outside the alphabet (spaces and line breaks
    included, which Spark's decoder would skip) is an error.  ``strict``
    raises on bad input; otherwise the result is null."""
    col = _c(s)
    well_formed = col.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z")    # \z: no final line break
    if strict:
        return F.when(well_formed | col.isNull(), F.to_binary(col, F.lit("base64"))).otherwise(
            F.raise_error(F.concat(F.lit("illegal base64 input: "), F.substring(col, 1, 40))))
    return F.when(well_formed, F.try_to_binary(col, F.lit("base64")))


def list_join(arr, sep: str) -> Column:
    """Join a list with ``sep``; a null element prints as ``null``."""
    return F.array_join(_c(arr), sep, "null")


# Characters a JVM String.trim() removes: every code point up to U+0020.
_JVM_SPACE = r"[\x00-\x20]"


def jvm_trim(s) -> Column:
    """Trim as the JVM's ``String.trim``: control characters and spaces."""
    return F.regexp_replace(_c(s), rf"\A{_JVM_SPACE}+|{_JVM_SPACE}+\z", "")


def split_trim(s, sep: str = ",") -> Column:
    """Trim, split on a literal separator and trim every part, as the JVM's
    ``s.trim().split(sep).map(_.trim())``: trailing empty parts are dropped
    (``"a,b,,"`` gives ``[a, b]``, ``",,"`` gives ``[]``, ``""`` gives ``[""]``)."""
    t = jvm_trim(s)
    stripped = F.regexp_replace(t, rf"(?:{re.escape(sep)})+\z", "")
    parts = F.when((stripped == "") & (t != ""), F.array().cast("array<string>")) \
        .otherwise(F.split(stripped, re.escape(sep)))
    return F.transform(parts, jvm_trim)


def split_first(s, sep: str = ":") -> Column:
    """The text before the first ``sep`` (all of it when there is none)."""
    return F.split_part(_c(s), F.lit(sep), F.lit(1))


def array_index_of(arr, key) -> Column:
    """0-based index of the first element equal to ``key``; -1 if absent."""
    k = key if isinstance(key, Column) else F.lit(key)
    return (F.array_position(_c(arr), k) - 1).cast("int")


def _map_value(m, key) -> Column:
    k = key if isinstance(key, Column) else F.lit(key)
    return F.try_element_at(_c(m), k)


def map_first(m, key) -> Column:
    """First element of the list under ``key``; null if absent or empty."""
    return F.get(_map_value(m, key), 0)


def map_join(m, key, sep: str) -> Column:
    """The list under ``key`` joined with ``sep``; null if absent or empty."""
    v = _map_value(m, key)
    return F.when(F.size(v) > 0, F.array_join(v, sep, "null"))


def random_name(prefix: str) -> Column:
    """``prefix`` followed by a random 64-bit integer, new per row."""
    return F.concat(F.lit(prefix), F.xxhash64(F.expr("uuid()")).cast("string"))


def uniform(*parts) -> Column:
    """A number in [0, 1) fixed by the parts (keys, positions, seeds): the
    first 48 bits of the md5 of their texts joined by colons.  Unlike a seeded
    generator it does not depend on how rows are partitioned, and streams with
    different parts are independent."""
    text = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def double_to_string(c) -> Column:
    """Shortest text that reads back to the same double (``1.0``, ``1.0E-8``)."""
    return _c(c).cast("double").cast("string")


def vector_to_csv(arr) -> Column:
    """One CSV line per vector: elements as doubles joined by commas."""
    return F.array_join(_c(arr).cast("array<double>").cast("array<string>"), ",")


def csv_to_vector(line) -> Column:
    """Parse a CSV line of numbers into ``array<double>`` (empty line -> [])."""
    parts = F.split(_c(line), ",")
    return F.when(F.length(_c(line)) == 0, F.array().cast("array<double>")) \
        .otherwise(parts.cast("array<double>"))


def to_float_array(arr) -> Column:
    return _c(arr).cast("array<float>")


def check_width(arr, width: int) -> Column:
    """The array itself, or a task error when its length is not ``width``."""
    a = _c(arr)
    return F.when(F.size(a) == width, a).otherwise(
        F.raise_error(F.concat(F.lit(f"expected width {width}, got "),
                               F.size(a).cast("string"))))
