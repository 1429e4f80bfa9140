"""Model operators on array columns as Column expressions (no Python).

Arrays are flat and row-major, channel last, like the NumPy kernels in
``tessera.operators.layers``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalars import uniform

__all__ = [
    "softmax", "one_hot", "argmax", "relu", "cross_entropy", "log_sum_exp",
    "max_pool2x2", "dropout",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once: a lambda variable is bound,
    where a Column used inside another lambda would be computed per element."""
    return F.get(F.transform(F.array(value), fn), 0)


def _shifted_exp(z: Column) -> Column:
    """(e, s, m): exponentials of the scores less their maximum m, and their sum."""
    return _bind(F.struct(z.alias("z"), F.array_max(z).alias("m")), lambda v: _bind(
        F.transform(v["z"], lambda x: F.exp(x - v["m"])), lambda e: F.struct(
            e.alias("e"), F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x).alias("s"), v["m"].alias("m"))))


def log_sum_exp(z) -> Column:
    return _bind(_shifted_exp(_c(z)), lambda v: F.log(v["s"]) + v["m"])


def softmax(z) -> Column:
    """Numerically stable softmax of a score vector, linear in its length."""
    return _bind(_shifted_exp(_c(z)), lambda v: F.transform(v["e"], lambda x: x / v["s"]))


def one_hot(label, depth: int) -> Column:
    lab = _c(label).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)),
                       lambda i: (i == lab).cast("int"))


def argmax(z) -> Column:
    """0-based position of the largest score; the first one on ties."""
    z = _c(z)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def relu(z) -> Column:
    return F.transform(_c(z), lambda x: F.greatest(x, F.lit(0.0)))


def cross_entropy(z, label) -> Column:
    """Softmax cross-entropy of scores ``z`` against an integer class label."""
    z = _c(z)
    return log_sum_exp(z) - F.element_at(z, _c(label).cast("int") + 1)


def _div(a: Column, n: int) -> Column:
    return F.floor(a / F.lit(n)).cast("int")


def dropout(x, rate: float, key, seed: int = 0) -> Column:
    """Training-time dropout: each element is kept with probability
    ``1 - rate`` and scaled up by its inverse.  The choice depends on the
    row's key, the position and the seed alone."""
    keep = 1.0 - rate
    return F.transform(_c(x), lambda v, i: F.when(uniform(key, i, F.lit(seed)) < keep, v / keep).otherwise(F.lit(0.0)))


def max_pool2x2(x, height: int, width: int, channels: int = 1) -> Column:
    """2x2 max pooling, stride 2, of a flat HxWxC image (odd edges dropped)."""
    x = _c(x)
    h2, w2, c = height // 2, width // 2, channels

    def cell(i):
        pr = _div(i, w2 * c)
        pc = _div(i, c) % w2
        ch = i % c
        base = ((pr * 2) * width + pc * 2) * c + ch + 1  # element_at is 1-based
        return F.greatest(
            F.element_at(x, base), F.element_at(x, base + c),
            F.element_at(x, base + width * c), F.element_at(x, base + width * c + c))

    return F.transform(F.sequence(F.lit(0), F.lit(h2 * w2 * c - 1)), cell)
