"""Neural-network layers: NumPy kernels for one Arrow batch, and the Spark
operators that run them over a whole table.

Images are flat ``array<float|double>`` columns, row-major with the channel
last, reshaped per batch to ``(batch, height, width, channels)``.  Weights are
broadcast once (size checked) and each batch is a few NumPy calls, so the
Python cost is per batch, never per row.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tessera.functions import tensor

# Weights larger than this are not broadcast: a model this size belongs in a
# file every worker reads itself.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Convolutions work on sliding windows of (rows, h, w, c, kh, kw); a batch is
# cut into chunks so that this intermediate stays under about this many bytes, as
# do the outputs of a layer over a batch.
CONV_CHUNK_BYTES = 64 * 1024 * 1024


def _chunks(n_rows: int, per_row_elems: int):
    step = max(1, CONV_CHUNK_BYTES // max(1, per_row_elems * 8))
    return [slice(i, min(n_rows, i + step)) for i in range(0, n_rows, step)] or [slice(0, 0)]


# ---------------------------------------------------------------- kernels

def dense(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    """``x @ kernel + bias``; kernel is ``(inputs, units)``."""
    out = x @ kernel
    return out + bias if bias is not None else out


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def log_softmax(z: np.ndarray) -> np.ndarray:
    m = z.max(axis=1, keepdims=True)
    return z - m - np.log(np.exp(z - m).sum(axis=1, keepdims=True))


def conv2d_same(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    """2-D cross-correlation, stride 1, "same" zero padding.

    ``x`` is ``(batch, h, w, c)``, ``kernel`` ``(kh, kw, c, filters)``.
    """
    kh, kw = kernel.shape[:2]
    ph, pw = (kh - 1) // 2, (kw - 1) // 2
    xp = np.pad(x, ((0, 0), (ph, kh - 1 - ph), (pw, kw - 1 - pw), (0, 0)))
    win = np.lib.stride_tricks.sliding_window_view(xp, (kh, kw), axis=(1, 2))
    # win: (batch, h, w, c, kh, kw), a view; einsum copies it, so chunk the batch
    out = np.empty(x.shape[:3] + (kernel.shape[3],))
    for sl in _chunks(len(x), int(np.prod(x.shape[1:])) * kh * kw):
        out[sl] = np.einsum("bhwcij,ijcf->bhwf", win[sl], kernel, optimize=True)
    return out + bias if bias is not None else out


def conv2d_kernel_grad(x: np.ndarray, g: np.ndarray, ksize: tuple[int, int]) -> np.ndarray:
    """Gradient of a "same" convolution w.r.t. its kernel: ``(kh, kw, c, f)``."""
    kh, kw = ksize
    ph, pw = (kh - 1) // 2, (kw - 1) // 2
    xp = np.pad(x, ((0, 0), (ph, kh - 1 - ph), (pw, kw - 1 - pw), (0, 0)))
    win = np.lib.stride_tricks.sliding_window_view(xp, (kh, kw), axis=(1, 2))
    out = np.zeros((kh, kw, x.shape[3], g.shape[3]))
    for sl in _chunks(len(x), int(np.prod(x.shape[1:])) * kh * kw):
        out += np.einsum("bhwcij,bhwf->ijcf", win[sl], g[sl], optimize=True)
    return out


def conv2d_input_grad(g: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Gradient of a "same" convolution w.r.t. its input: correlate the
    output gradient with the spatially flipped, channel-swapped kernel."""
    kh, kw = kernel.shape[:2]
    ph, pw = (kh - 1) // 2, (kw - 1) // 2
    gp = np.pad(g, ((0, 0), (kh - 1 - ph, ph), (kw - 1 - pw, pw), (0, 0)))
    win = np.lib.stride_tricks.sliding_window_view(gp, (kh, kw), axis=(1, 2))
    flipped = kernel[::-1, ::-1].transpose(0, 1, 3, 2)          # (kh, kw, f, c)
    out = np.empty(g.shape[:3] + (kernel.shape[2],))
    for sl in _chunks(len(g), int(np.prod(g.shape[1:])) * kh * kw):
        out[sl] = np.einsum("bhwfij,ijfc->bhwc", win[sl], flipped, optimize=True)
    return out


def max_pool2x2_grad(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Route each pooled gradient to the first maximum of its 2x2 window."""
    b, h, w, c = x.shape
    h2, w2 = h // 2, w // 2
    win = x[:, : 2 * h2, : 2 * w2, :].reshape(b, h2, 2, w2, 2, c) \
        .transpose(0, 1, 3, 5, 2, 4).reshape(b, h2, w2, c, 4)
    hot = np.eye(4)[win.argmax(axis=-1)] * g[..., None]          # (b, h2, w2, c, 4)
    out = np.zeros_like(x)
    out[:, : 2 * h2, : 2 * w2, :] = hot.reshape(b, h2, w2, c, 2, 2) \
        .transpose(0, 1, 4, 2, 5, 3).reshape(b, 2 * h2, 2 * w2, c)
    return out


def max_pool2x2(x: np.ndarray) -> np.ndarray:
    """2x2 max pooling with stride 2 over ``(batch, h, w, c)``."""
    b, h, w, c = x.shape
    x = x[:, : h - h % 2, : w - w % 2, :]
    return x.reshape(b, h // 2, 2, w // 2, 2, c).max(axis=(2, 4))


def dropout(x: np.ndarray, rate: float, rng: np.random.Generator) -> np.ndarray:
    """Training-time dropout: keep with probability ``1 - rate``, scale up."""
    keep = 1.0 - rate
    return x * (rng.random(x.shape) < keep) / keep


# ---------------------------------------------------------------- helpers

def stack_column(series: pd.Series, width: int | None = None) -> np.ndarray:
    """An Arrow batch of array cells as one ``(rows, width)`` float64 matrix."""
    if len(series) == 0:
        return np.zeros((0, width or 0))
    m = np.stack(series.to_numpy()).astype(np.float64, copy=False)
    if width is not None and m.shape[1] != width:
        raise ValueError(f"expected width {width}, got {m.shape[1]}")
    return m


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    buf = io.BytesIO()
    np.savez(buf, **arrays)
    return buf.getvalue()


def unpack_arrays(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


# Arrays unpacked on this Python worker, by a key made when they were shipped.
_WORKER_ARRAYS: dict[str, dict[str, np.ndarray]] = {}
KEPT_PAYLOADS = 4              # payloads kept per worker; an older one is unpacked again


def worker_arrays(bc, key: str) -> dict[str, np.ndarray]:
    """The arrays of a payload, unpacked once per worker."""
    got = _WORKER_ARRAYS.get(key)
    if got is None:
        while len(_WORKER_ARRAYS) >= KEPT_PAYLOADS:
            _WORKER_ARRAYS.pop(next(iter(_WORKER_ARRAYS)))
        got = _WORKER_ARRAYS[key] = unpack_arrays(bc.value)
    return got


class SharedBlob:
    """A payload too large to broadcast, kept as one file in the shared
    folder; each Python worker reads it once (``.value``, like a Broadcast)."""

    _cache: dict[str, bytes] = {}

    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size

    @property
    def value(self) -> bytes:
        blob = SharedBlob._cache.get(self.uri)
        if blob is None:
            from tessera.sources import fs
            with fs.open_input_stream(self.uri) as f:
                blob = f.read()
            if len(blob) != self.size:
                raise OSError(f"{self.uri}: read {len(blob)} of {self.size} bytes")
            SharedBlob._cache.clear()          # keep one large payload per worker
            SharedBlob._cache[self.uri] = blob
        return blob


def broadcast_arrays(spark, arrays: dict[str, np.ndarray]):
    """Ship a dict of arrays to the tasks: a broadcast when its measured size
    is within ``MAX_BROADCAST_BYTES``, otherwise a file in the shared folder
    that each worker reads itself (``SharedBlob``).  Either has ``.value``."""
    blob = pack_arrays(arrays)
    if len(blob) <= MAX_BROADCAST_BYTES:
        return spark.sparkContext.broadcast(blob)
    from tessera.session import shared_dir
    from tessera.sources import fs
    uri = shared_dir(spark, "arrays") + "/arrays.npz"
    fs.ensure_dir(uri.rsplit("/", 1)[0])
    with fs.atomic_output(uri) as out:
        out.write(blob)
    return SharedBlob(uri, len(blob))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- operators

def list_matrix(arr, width: int) -> np.ndarray:
    """An Arrow list column of equal-width rows as a ``(rows, width)`` float64
    matrix, read from the values buffer (no per-row objects)."""
    import pyarrow as pa
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        raise ValueError("null vector in a layer input")
    values = arr.flatten().to_numpy(zero_copy_only=False)
    if len(values) != len(arr) * width:
        raise ValueError(f"expected vectors of width {width}")
    return values.astype(np.float64, copy=False).reshape(len(arr), width)


def matrix_list(m: np.ndarray):
    """A ``(rows, width)`` matrix as an Arrow ``list<double>`` column built
    from offsets over the flat values."""
    import pyarrow as pa
    rows, width = m.shape
    offsets = pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m, np.float64).ravel()))


def map_vectors(df: DataFrame, col: str, width: int, fn, out_col: str, out_width: int = 0) -> DataFrame:
    """Append ``fn(matrix) -> matrix`` of a vector column as ``array<double>``,
    at most ``CONV_CHUNK_BYTES`` of output at a time; the other columns pass
    through untouched."""
    from pyspark.sql.types import StructField, StructType
    schema = StructType([f for f in df.schema.fields if f.name != out_col]
                        + [StructField(out_col, ArrayType(DoubleType()))])

    def run(batches):
        for b in batches:
            if out_col in b.schema.names:
                b = b.drop_columns([out_col])
            for sl in _chunks(b.num_rows, max(width, out_width)):
                part = b.slice(sl.start, sl.stop - sl.start)
                out = fn(list_matrix(part.column(col), width)) if part.num_rows else np.zeros((0, 1))
                yield part.append_column(out_col, matrix_list(out.reshape(part.num_rows, -1)))

    return df.mapInArrow(run, schema)


def dense_layer(df: DataFrame, col: str, kernel: np.ndarray, bias: np.ndarray | None = None,
                activation: str | None = None, out_col: str = "dense") -> DataFrame:
    """Append ``activation(x @ kernel + bias)`` as ``array<double>``."""
    bc = broadcast_arrays(df.sparkSession, {"k": np.asarray(kernel, np.float64),
                                            "b": np.zeros(kernel.shape[1]) if bias is None
                                            else np.asarray(bias, np.float64)})

    key = uuid.uuid4().hex

    def fn(x):
        w = worker_arrays(bc, key)
        out = dense(x, w["k"], w["b"])
        return relu(out) if activation == "relu" else out

    return map_vectors(df, col, kernel.shape[0], fn, out_col, kernel.shape[1])


def conv2d_layer(df: DataFrame, col: str, shape: tuple[int, int, int], kernel: np.ndarray,
                 bias: np.ndarray | None = None, activation: str | None = None,
                 out_col: str = "conv") -> DataFrame:
    """Append a "same" 2-D convolution of a flat HxWxC image as flat HxWxF."""
    h, w, c = shape
    bc = broadcast_arrays(df.sparkSession, {"k": np.asarray(kernel, np.float64),
                                            "b": np.zeros(kernel.shape[3]) if bias is None
                                            else np.asarray(bias, np.float64)})

    key = uuid.uuid4().hex

    def fn(x):
        wts = worker_arrays(bc, key)
        out = conv2d_same(x.reshape(-1, h, w, c), wts["k"], wts["b"])
        return (relu(out) if activation == "relu" else out).reshape(len(x), -1)

    return map_vectors(df, col, h * w * c, fn, out_col, h * w * kernel.shape[3])


def max_pool_layer(df: DataFrame, col, shape: tuple[int, int, int],
                   out_col: str = "pooled") -> DataFrame:
    """2x2/2 max pooling as a Column expression (no Python)."""
    h, w, c = shape
    return df.withColumn(out_col, tensor.max_pool2x2(_c(col), h, w, c))

