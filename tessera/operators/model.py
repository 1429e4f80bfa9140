"""Pluggable NumPy models with ``forward`` and ``grad``, and their parameter
table ``(layer, shape, values)`` for saving, loading and broadcasting.

``SoftmaxRegression`` trains data-parallel in a gang (``operators.training``);
``ConvNet`` is the two-convolution network (conv 5x5 -> pool -> conv 5x5 ->
pool -> dense+relu -> dropout -> dense) for scoring and gradient checks.
"""

from __future__ import annotations

import numpy as np

from tessera import constants as K
from tessera.operators import layers as L


def fixture_matrix(rows: int, cols: int) -> np.ndarray:
    """Closed-form test weights ``w[k][j] = ((7k + 3j) % 11 - 5) / 10``."""
    k = np.arange(rows)[:, None]
    j = np.arange(cols)[None, :]
    return ((7 * k + 3 * j) % 11 - 5) / 10.0


class Model:
    """Base of the pluggable models: a subclass sets ``kind``, ``config()``,
    ``from_config``, ``forward`` and (to train) ``grad_sums``; defining it
    registers it, so its parameter tables and broadcasts rebuild it by kind
    (ship its module to the workers like any UDF code)."""

    kind = "model"
    registry: dict[str, type] = {}

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        # Only a class that names its own kind registers; a class rebuilt by
        # value on a worker gets its attributes after creation, so it would
        # otherwise claim its parent's kind.
        if "kind" in cls.__dict__:
            Model.registry[cls.kind] = cls

    @classmethod
    def _for_kind(cls, kind: str) -> type:
        return cls if getattr(cls, "kind", None) == kind else Model.registry[kind]

    def __init__(self, params: dict[str, np.ndarray]):
        self.params = {k: np.asarray(v, np.float64) for k, v in params.items()}

    # -- parameter table ---------------------------------------------------
    def to_rows(self) -> list[tuple[str, list[int], list[float]]]:
        rows = [("__kind__", [len(self.kind)], [float(ord(ch)) for ch in self.kind])]
        rows += [("__config__", [len(self.config())], [float(v) for v in self.config()])]
        for name, v in sorted(self.params.items()):
            rows.append((name, list(v.shape), v.ravel().tolist()))
        return rows

    @classmethod
    def from_rows(cls, rows) -> "Model":
        d = {r[0]: (tuple(int(s) for s in r[1]), np.asarray(r[2], np.float64)) for r in rows}
        kind = "".join(chr(int(c)) for c in d.pop("__kind__")[1])
        config = d.pop("__config__")[1].tolist()
        params = {k: v.reshape(shape) for k, (shape, v) in d.items()}
        return cls._for_kind(kind).from_config(config, params)

    def to_arrays(self) -> dict[str, np.ndarray]:
        out = dict(self.params)
        out["__kind__"] = np.array([ord(ch) for ch in self.kind])
        out["__config__"] = np.array(self.config())
        return out

    @classmethod
    def from_arrays(cls, arrays: dict[str, np.ndarray]) -> "Model":
        kind = "".join(chr(int(c)) for c in arrays["__kind__"])
        config = np.asarray(arrays["__config__"], np.float64).tolist()
        params = {k: v for k, v in arrays.items() if not k.startswith("__")}
        return cls._for_kind(kind).from_config(config, params)

    def n_params(self) -> int:
        return int(sum(v.size for v in self.params.values()))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Class index per row: argmax of the scores, first on ties."""
        return self.forward(x).argmax(axis=1)

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        lp = L.log_softmax(self.forward(x))
        return float(-lp[np.arange(len(y)), y.astype(int)].mean()) if len(y) else 0.0


class SoftmaxRegression(Model):
    """Scores ``z = x @ W.T + b``; W is ``(classes, dim)``."""

    kind = "softmax"

    def __init__(self, dim: int, classes: int = K.CLASSES, params=None):
        self.dim, self.classes = dim, classes
        super().__init__(params or {"W": np.zeros((classes, dim)), "b": np.zeros(classes)})

    def config(self):
        return [self.dim, self.classes]

    @classmethod
    def from_config(cls, config, params):
        return cls(int(config[0]), int(config[1]), params)

    @classmethod
    def fixture(cls, dim: int, classes: int = K.CLASSES) -> "SoftmaxRegression":
        return cls(dim, classes, {"W": fixture_matrix(classes, dim), "b": np.zeros(classes)})

    def forward(self, x: np.ndarray) -> np.ndarray:
        return x @ self.params["W"].T + self.params["b"]

    def grad_sums(self, x: np.ndarray, y: np.ndarray, rng=None) -> tuple[dict[str, np.ndarray], float]:
        """Sum (not mean) over the rows of the cross-entropy gradient, and of the loss."""
        z = self.forward(x)
        p = L.softmax(z)
        idx = np.arange(len(y)), y.astype(int)
        loss_sum = float(-L.log_softmax(z)[idx].sum())
        p[idx] -= 1.0
        return {"W": p.T @ x, "b": p.sum(axis=0)}, loss_sum


class ConvNet(Model):
    """conv(k x k, f1, relu) -> pool -> conv(k x k, f2, relu) -> pool ->
    dense(hidden, relu) -> dropout (training only) -> dense(classes)."""

    kind = "convnet"

    def __init__(self, height=K.IMAGE_SHAPE[0], width=K.IMAGE_SHAPE[1],
                 channels=K.IMAGE_SHAPE[2], f1=K.CONV_FILTERS[0], f2=K.CONV_FILTERS[1],
                 hidden=K.DENSE_UNITS, classes=K.CLASSES, ksize=K.KERNEL_SIZE, params=None,
                 dropout_rate=K.DROPOUT_RATE):
        self.shape = (height, width, channels)
        self.f1, self.f2, self.hidden, self.classes, self.ksize = f1, f2, hidden, classes, ksize
        self.dropout_rate = dropout_rate
        flat = (height // 4) * (width // 4) * f2
        if params is None:
            rng = np.random.default_rng(0)

            def init(*shape):
                fan_in = int(np.prod(shape[:-1]))
                return rng.normal(0.0, np.sqrt(2.0 / fan_in), size=shape)
            params = {
                "conv1/kernel": init(ksize, ksize, channels, f1), "conv1/bias": np.zeros(f1),
                "conv2/kernel": init(ksize, ksize, f1, f2), "conv2/bias": np.zeros(f2),
                "dense/kernel": init(flat, hidden), "dense/bias": np.zeros(hidden),
                "logits/kernel": init(hidden, classes), "logits/bias": np.zeros(classes),
            }
        super().__init__(params)

    def config(self):
        return [*self.shape, self.f1, self.f2, self.hidden, self.classes, self.ksize, self.dropout_rate]

    @classmethod
    def from_config(cls, config, params):
        *sizes, rate = config
        return cls(*map(int, sizes), params=params, dropout_rate=rate)

    @classmethod
    def fixture(cls, height, width, channels=1, f1=4, f2=8, hidden=16, classes=K.CLASSES,
                ksize=K.KERNEL_SIZE):
        """Closed-form weights: the fixture rule over (filter, flat offset)."""
        flat = (height // 4) * (width // 4) * f2

        def kern(c_in, f):
            # rule over (filter, offset) with offset = flat (dy, dx, channel) index
            return fixture_matrix(f, ksize * ksize * c_in).T.reshape(ksize, ksize, c_in, f)
        params = {
            "conv1/kernel": kern(channels, f1), "conv1/bias": np.zeros(f1),
            "conv2/kernel": kern(f1, f2), "conv2/bias": np.zeros(f2),
            "dense/kernel": fixture_matrix(hidden, flat).T, "dense/bias": np.zeros(hidden),
            "logits/kernel": fixture_matrix(classes, hidden).T, "logits/bias": np.zeros(classes),
        }
        return cls(height, width, channels, f1, f2, hidden, classes, ksize, params)

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None) -> np.ndarray:
        p = self.params
        a = x.reshape(-1, *self.shape)
        a = L.max_pool2x2(L.relu(L.conv2d_same(a, p["conv1/kernel"], p["conv1/bias"])))
        a = L.max_pool2x2(L.relu(L.conv2d_same(a, p["conv2/kernel"], p["conv2/bias"])))
        a = L.relu(L.dense(a.reshape(len(a), -1), p["dense/kernel"], p["dense/bias"]))
        if rng is not None:
            a = L.dropout(a, self.dropout_rate, rng)
        return L.dense(a, p["logits/kernel"], p["logits/bias"])

    def grad_sums(self, x: np.ndarray, y: np.ndarray, rng=None) -> tuple[dict[str, np.ndarray], float]:
        """Backpropagation through the whole network; dropout is applied when
        ``rng`` is given (training), as in the forward pass."""
        p = self.params
        k = (self.ksize, self.ksize)
        a0 = x.reshape(-1, *self.shape)
        z1 = L.conv2d_same(a0, p["conv1/kernel"], p["conv1/bias"])
        a1 = L.relu(z1)
        p1 = L.max_pool2x2(a1)
        z2 = L.conv2d_same(p1, p["conv2/kernel"], p["conv2/bias"])
        a2 = L.relu(z2)
        p2 = L.max_pool2x2(a2)
        flat = p2.reshape(len(p2), -1)
        z3 = L.dense(flat, p["dense/kernel"], p["dense/bias"])
        a3 = L.relu(z3)
        keep = np.ones_like(a3)
        if rng is not None:
            keep = (rng.random(a3.shape) < 1.0 - self.dropout_rate) / (1.0 - self.dropout_rate)
        d3 = a3 * keep
        z4 = L.dense(d3, p["logits/kernel"], p["logits/bias"])
        idx = np.arange(len(y)), y.astype(int)
        loss_sum = float(-L.log_softmax(z4)[idx].sum())
        g4 = L.softmax(z4)
        g4[idx] -= 1.0
        g = {"logits/kernel": d3.T @ g4, "logits/bias": g4.sum(0)}
        gz3 = (g4 @ p["logits/kernel"].T) * keep * (z3 > 0)
        g["dense/kernel"], g["dense/bias"] = flat.T @ gz3, gz3.sum(0)
        gp2 = (gz3 @ p["dense/kernel"].T).reshape(p2.shape)
        gz2 = L.max_pool2x2_grad(a2, gp2) * (z2 > 0)
        g["conv2/kernel"] = L.conv2d_kernel_grad(p1, gz2, k)
        g["conv2/bias"] = gz2.sum((0, 1, 2))
        gp1 = L.conv2d_input_grad(gz2, p["conv2/kernel"])
        gz1 = L.max_pool2x2_grad(a1, gp1) * (z1 > 0)
        g["conv1/kernel"] = L.conv2d_kernel_grad(a0, gz1, k)
        g["conv1/bias"] = gz1.sum((0, 1, 2))
        return g, loss_sum
