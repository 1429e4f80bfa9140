"""Data-parallel training over whole tables, full-batch gradients.

``train`` runs mini-batch SGD with momentum on ``world`` ranks.  Rows are
numbered once; every epoch is a keyed permutation of the numbers, cut into
batches; batch g belongs to step ``g div world`` of rank ``g mod world``, so
each row is drawn once per epoch, wherever it is stored and however long the
run is.  ``sync_every`` steps form a round, one Spark job: each rank takes its
steps on the rows of its batches, and what the ranks return is averaged.

The rounds of a stretch (about an epoch) are shuffled together, a partition per
round and rank; a round's job then only runs the tasks of its own partitions
and the driver averages their small states.  Where the states of all ranks
exceed ``STATE_BYTES``, or a batch ``BATCH_BYTES``, a round shuffles its own rows
and a grouped aggregate over blocks of the parameters averages: no task and no
driver step then holds more than one copy of the model (a rank's own, or the
average).  Both ways give the same parameters, bit for bit.

A round is committed when its averaged state has been renamed into place in
the run's folder; a lost task is simply run again.  A run whose driver was
lost is called again with the same ``path``: it checks that data and arguments
are the same (a fingerprint of both is stored), starts from the last committed
round and ends with the same parameters as an uncut run.  Ranks need not run
at the same time, so ``world`` may exceed the task slots.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import pickle
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.operators import layers as L
from tessera.operators import partitions as P
from tessera.operators.model import Model
from tessera.session import shared_dir
from tessera.sources import fs

BLOCK_VALUES = 65_536          # parameters averaged together by one task
BUCKETS = 256                  # folders of an epoch table at most
STATE_BYTES = 1 << 24          # parameters and momentum of all ranks that the driver averages itself
BATCH_BYTES = 1 << 22          # a batch that is shuffled as one value
STRETCH_PARTS = 1024           # partitions (one per round and rank) shuffled together at most
STRETCH_ROWS = 1 << 16         # rows shuffled together: those of an epoch, or this many
# kind: param | velocity (a block of values) | loss (of one step) | read (rows drawn) | prob (values of one row)
ROUND_ROWS = ("kind string, name string, block int, rank int, values array<double>, "
              "step int, loss double, n long, epoch int, key_sum decimal(38,0)")
LOG_ROWS = "kind string, round int, rank int, values array<double>, step int, loss double, n long, epoch int, key_sum decimal(38,0)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


class EpochTables:
    """The batches of the epochs, dealt by rounds into tables in the shared
    folder.  Rows are numbered once (one write); an epoch's order is a keyed
    permutation of the numbers, so making an epoch's table is one exchange by
    round and no sort.  A round's new epochs are made together; tables that no
    later round reads are deleted."""

    def __init__(self, rows: DataFrame, batch: int, seed: int, path: str, size: int | None = None, span: int = 1):
        self.rows, self.batch, self.seed, self.path, self.span = rows, batch, seed, path, max(1, span)
        self.size = rows.count() if size is None else size
        self.per_epoch = -(-self.size // batch)
        self.made: int | None = None                   # epochs are made up to here
        self.kept: list[tuple[int, str, int]] = []     # (last epoch, table, batches per folder)
        self.numbered: DataFrame | None = None

    def _rows(self) -> DataFrame:
        """The numbered rows; numbers once written are used again after a restart."""
        if self.numbered is None:
            spark, mark, table = self.rows.sparkSession, f"{self.path}/rows.json", f"{self.path}/rows"
            if not fs.exists(mark):
                fs.remove(table)
                size, starts = P.write_numbered(self.rows, table)
                if size != self.size:
                    raise RuntimeError(f"the table had {self.size} rows and now has {size}")
                with fs.atomic_output(mark) as f:
                    f.write(json.dumps(starts).encode())
            with fs.open_input_stream(mark) as f:
                self.numbered = P.read_numbered(spark, table, json.loads(f.read()))
            for old in fs.names(self.path):            # of a run that was cut
                if old.startswith("epochs-"):
                    fs.remove(f"{self.path}/{old}")
        return self.numbered

    def _make(self, first: int, upto: int) -> None:
        out = f"{self.path}/epochs-{first:06d}"
        span = max(self.span, -(-(upto - first + 1) * self.per_epoch // BUCKETS))
        copies = self._rows().withColumn("epoch", F.explode(F.sequence(F.lit(first), F.lit(upto))))
        place = F.floor(P.permuted("position", self.size, self.seed, F.col("epoch")) / self.batch)
        dealt = copies.withColumn("g", F.col("epoch").cast("long") * self.per_epoch + place).withColumn(
            "bucket", F.floor(F.col("g") / span))
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(out)
        self.kept.append((upto, out, span))
        self.made = upto

    def batches(self, lo: int, hi: int) -> DataFrame:
        """Rows of the batches lo <= g < hi, counted over all epochs."""
        first, last = lo // self.per_epoch, (hi - 1) // self.per_epoch
        if self.made is None or last > self.made:
            self._make(first if self.made is None else self.made + 1, last)
        for old in [k for k in self.kept if k[0] < first]:
            self.kept.remove(old)
            fs.remove(old[1])
        out = None
        for _, path, span in self.kept:
            part = self.rows.sparkSession.read.parquet(path).where(
                F.col("bucket").between(lo // span, (hi - 1) // span) & F.col("g").between(lo, hi - 1)).drop("bucket")
            out = part if out is None else out.unionByName(part)
        return out

    def close(self) -> None:
        for _, path, _ in self.kept:
            fs.remove(path)
        self.kept.clear()
        fs.remove(f"{self.path}/rows")
        fs.remove(f"{self.path}/rows.json")
        self.made = self.numbered = None


@dataclass
class TrainResult:
    model_path: str
    model: Model
    history: DataFrame         # (step, loss) of the logged steps
    reads: DataFrame           # (epoch, round, rank, n, key_sum) as the ranks drew rows
    rounds: list[str] = field(default_factory=list)
    probabilities: DataFrame | None = None     # (step, key, probabilities) of rank 0's rows at the logged steps
    resumed_from: int = 0      # rounds that were found committed


def _blocks(kind: str, arrays: dict[str, np.ndarray]):
    for name, v in sorted(arrays.items()):
        flat = np.asarray(v, np.float64).ravel()
        for b in range(0, max(1, len(flat)), BLOCK_VALUES):
            yield kind, name, b // BLOCK_VALUES, flat[b:b + BLOCK_VALUES]


def _average(rows: DataFrame) -> DataFrame:
    """Mean over the ranks of each block of parameters and momentum; a task
    holds one block of every rank.  Log rows pass as they are."""
    def mean(t):
        import pyarrow as pa
        if t.column("kind")[0].as_py() not in ("param", "velocity"):
            return t
        t = t.sort_by("rank")                          # one order of summation
        v = t.column("values").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        at = t.schema.get_field_index("values")
        return t.slice(0, 1).set_column(at, t.schema.field(at), pa.array([v.mean(axis=0).tolist()], t.schema.field(at).type))
    return rows.groupBy("kind", "name", "block").applyInArrow(mean, ROUND_ROWS)


def _state(rows, model: Model):
    """The averaged state, one copy of the model, in the shapes of ``model``."""
    got: dict = {}
    for r in sorted((r for r in rows if r.kind in ("param", "velocity")), key=lambda r: (r.kind, r.name, r.block)):
        got.setdefault((r.kind, r.name), []).append(np.asarray(r["values"], np.float64))
    return {f"{kind}:{name}": np.concatenate(v).reshape(model.params[name].shape) for (kind, name), v in got.items()}


def _with_state(model: Model, state: dict):
    fixed = {k: v for k, v in model.to_arrays().items() if k.startswith("__")}
    part = lambda kind: {k.split(":", 1)[1]: v for k, v in state.items() if k.startswith(kind + ":")}
    return type(model).from_arrays({**part("param"), **fixed}), part("velocity")


class RoundLog:
    """The committed rounds of a run in its folder: per round a file of log rows
    and then, renamed into place last, the state."""

    def __init__(self, path: str, fingerprint: dict):
        self.path = path
        fs.ensure_dir(f"{path}/log")
        manifest, text = f"{path}/manifest.json", json.dumps(fingerprint, sort_keys=True)
        if fs.exists(manifest):
            with fs.open_input_stream(manifest) as f:
                old = json.loads(f.read())
            new = json.loads(text)
            if old != new:
                differ = sorted(k for k in old.keys() | new.keys() if old.get(k) != new.get(k))
                raise ValueError(f"{path} holds another run; different: {', '.join(differ)}")
        else:
            with fs.atomic_output(manifest) as f:
                f.write(text.encode())
        self.done = sum(n.startswith("state-") for n in fs.names(path))

    def state_path(self, i: int) -> str:
        return f"{self.path}/state-{i:06d}.npz"

    def commit(self, i: int, state: dict, logs: list[dict]) -> None:
        with fs.atomic_output(f"{self.path}/log/round-{i:06d}.json") as f:
            f.write("".join(json.dumps({**x, "round": i}) + "\n" for x in logs).encode())
        out = io.BytesIO()
        np.savez(out, **state)
        with fs.atomic_output(self.state_path(i)) as f:
            f.write(out.getvalue())
        self.done = i + 1

    def last(self) -> dict:
        with fs.open_input_stream(self.state_path(self.done - 1)) as f, np.load(
                io.BytesIO(f.read()), allow_pickle=False) as z:
            return dict(z)


def _fingerprint(rows: DataFrame, model: Model, **args) -> dict:
    """What makes a run this run: the rows (in any order), the start, the arguments."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
    start = hashlib.sha256()
    for name, v in sorted(model.to_arrays().items()):
        start.update(name.encode() + np.asarray(v, np.float64).tobytes())
    return {"rows": r.n, "row_hash": str(r.h), "model": model.kind, "start": start.hexdigest(), **args}


def _rank_steps(m: Model, vel: dict, rows, rank: int, first_g: int, world: int, lr: float, momentum: float,
                log_steps, seed):
    """One rank's steps of a round over its sorted rows (g, epoch, keys, X, y).
    At logged steps rank 0 records its rows' probabilities before the step."""
    rng = np.random.default_rng([*seed, rank])         # dropout masks
    names = sorted(m.params)
    logs, reads, probs = [], {}, []
    for g, epoch, keys, X, y in rows:
        if rank == 0 and g // world in log_steps:
            probs += [(g // world, int(k), p) for k, p in zip(keys, L.softmax(m.forward(X)).tolist())]
        grads, loss = m.grad_sums(X, y, rng=rng)
        for k in names:
            vel[k] = momentum * vel[k] + grads[k] / len(y)
            m.params[k] = m.params[k] - lr * vel[k]
        step = g // world
        if step in log_steps:
            logs.append((step, loss, len(y)))
        n, total = reads.get(epoch, (0, 0))
        reads[epoch] = (n + len(y), total + sum(keys))
    return logs, reads, probs


def _batches_of(arrow, width: int):
    """(rank, g, epoch, keys, X, y) of each batch from sorted Arrow batches;
    holds the rows of one batch."""
    held, at = [], None

    def whole():
        X = np.vstack([h[0] for h in held])
        y = np.concatenate([h[1] for h in held])
        return (*at, [k for h in held for k in h[2]], X, y)
    for b in arrow:
        if not b.num_rows:
            continue
        rank, g, epoch = (b.column(c).to_numpy() for c in ("rank", "g", "epoch"))
        X = L.list_matrix(b.column("features"), width)
        y = b.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
        key = b.column("key").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        for s, e in zip(cuts, cuts[1:]):
            now = int(rank[s]), int(g[s]), int(epoch[s])
            if at is not None and now != at:
                yield whole()
                held = []
            at = now
            held.append((X[s:e], y[s:e], key[s:e].tolist()))
    if held:
        yield whole()


def _packed(data: DataFrame, lo: int, per_round: int, rounds: int, world: int, width: int):
    """The batches from ``lo`` on as an RDD of pickled (g, epoch, keys, X, y),
    a partition per round and rank.  Made by one shuffle of rows and one of
    batches; a job on some of the partitions reads only these."""
    def pack(arrow):
        import pyarrow as pa
        for rank, g, *batch in _batches_of(arrow, width):
            part = (g - lo) // per_round * world + rank
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([g], pa.int64()),
                                              pa.array([pickle.dumps((g, *batch))], pa.binary())],
                                             names=["part", "g", "batch"])
    rows = data.repartition("g").sortWithinPartitions("g", "position")
    dealt = rows.mapInArrow(pack, "part int, g long, batch binary").repartitionById(rounds * world, F.col("part"))
    return (dealt.sortWithinPartitions("g") if per_round > world else dealt).select("batch").rdd


def _round_by_driver(spark, packed, at: int, world: int, model: Model, velocity: dict, steps):
    """One round on ``world`` partitions of the packed batches from ``at`` on:
    (averaged state, log rows).  ``steps(model, velocity, batches, rank)`` takes
    a rank's steps."""
    model_cls, start = type(model), (model.to_arrays(), velocity)

    def run(rows):
        batches = (pickle.loads(r[0]) for r in rows)
        head = next(batches, None)
        if head is None:
            return
        arrays, vel = start
        m, rank = model_cls.from_arrays({k: v.copy() for k, v in arrays.items()}), head[0] % world
        vel = {k: v.copy() for k, v in vel.items()}
        out = steps(m, vel, itertools.chain([head], batches), rank)
        yield rank, m.params, vel, *out
    got = sorted(spark.sparkContext.runJob(packed, run, range(at, at + world)), key=lambda r: r[0])
    logs = []
    for rank, _, _, losses, reads, probs in got:
        row = {"kind": None, "rank": rank, "values": None, "step": None, "loss": None, "n": None, "epoch": None, "key_sum": None}
        logs += [{**row, "kind": "loss", "step": s, "loss": float(x), "n": n} for s, x, n in losses]
        logs += [{**row, "kind": "read", "n": n, "epoch": e, "key_sum": int(t)} for e, (n, t) in reads.items()]
        logs += [{**row, "kind": "prob", "values": p, "step": s, "key_sum": k} for s, k, p in probs]
    state = {}
    for kind, j in (("param", 1), ("velocity", 2)):
        for name in model.params:
            state[f"{kind}:{name}"] = np.stack([r[j][name] for r in got]).mean(axis=0)
    return state, logs


def default_world(rows: int, batch: int, slots: int) -> int:
    """Ranks of a run that names none: one per task slot, but no more than an
    epoch has batches."""
    return max(1, min(slots, -(-rows // batch)))


def train(df: DataFrame, model: Model, world: int | None = None, steps: int | None = None, features: str = "features",
          label: str = "label", key: str | None = None, batch: int = K.BATCH_SIZE, lr: float = K.LEARNING_RATE,
          momentum: float = K.MOMENTUM, seed: int = 0, log_every: int = K.LOG_EVERY_STEPS,
          sync_every: int = 1, epochs: int | None = None, path: str | None = None,
          stop_after: int | None = None, slots: int | None = None) -> TrainResult:
    """Train ``model`` (it must offer ``grad_sums``) for ``steps // world``
    steps per rank at learning rate ``lr * world``, like the reference's
    scaling, or for whole ``epochs`` of the table.

    ``sync_every=1`` averages after every step, which equals synchronous
    gradient averaging; larger values run that many local steps between
    averages (local SGD).  Each round is one Spark job.  At every
    ``log_every``-th step and the last the loss is kept, and the probabilities
    that rank 0 computes for its rows.  ``key`` (a long column) lets the result
    report which rows were read.

    ``path`` names the run's folder; called again with the same one, data and
    arguments, a run goes on after its last committed round.  ``stop_after``
    ends the call after so many committed rounds.  Without ``world`` there is a
    rank for each of the ``slots`` task slots (default: those of the cluster), as
    far as an epoch has batches for them; a run that is called again keeps the
    number it began with only if these are the same, so name one there."""
    spark = df.sparkSession
    path = (path or shared_dir(spark, "train")).rstrip("/")
    rows = df.select(_c(features).alias("features"), _c(label).cast("double").alias("label"),
                     (_c(key).cast("long") if key else F.lit(0).cast("long")).alias("key"))
    sync = max(1, sync_every)
    world = world or default_world(rows.count(), batch, slots or spark.sparkContext.defaultParallelism)
    print_ = _fingerprint(rows, model, world=world, batch=batch, lr=lr, momentum=momentum, seed=seed, log_every=log_every,
                          sync_every=sync, steps=steps, epochs=epochs)
    per_round = sync * world
    width = int(np.prod(model.shape)) if hasattr(model, "shape") else model.dim
    small = 16 * model.n_params() * world <= STATE_BYTES and 8 * batch * width <= BATCH_BYTES
    stretch = max(1, min(STRETCH_PARTS // world, -(-max(print_["rows"], STRETCH_ROWS) // (per_round * batch)))) if small else 1
    table = EpochTables(rows, batch, seed, path, size=print_["rows"], span=stretch * per_round)
    total = epochs * table.per_epoch if epochs else (steps or 0) // world * world
    per_worker = -(-total // world)
    if per_worker < 1:
        raise ValueError(f"steps // world is {per_worker}; need at least one step")
    log = RoundLog(path, print_)
    resumed = log.done
    velocity = {k: np.zeros_like(v) for k, v in model.params.items()}
    if log.done:
        model, velocity = _with_state(model, log.last())
    model_cls = type(model)          # referenced so the worker imports the model's module
    log_steps = {*range(0, per_worker, log_every), per_worker - 1}
    n_rounds = -(-per_worker // sync)
    upto = n_rounds if stop_after is None else min(n_rounds, stop_after)
    packed, begun, ended = None, 0, 0
    for i in range(log.done, upto):
        first = i * sync
        lo, hi = first * world, min(total, (first + sync) * world)
        if small and i >= ended:
            begun, ended = i, min(upto, (i // stretch + 1) * stretch)
            data = table.batches(lo, min(total, ended * per_round)).withColumn("rank", (F.col("g") % world).cast("int"))
            packed = _packed(data.select("rank", "g", "epoch", "position", "key", "features", "label"),
                             lo, per_round, ended - begun, world, width)
        if small:
            def steps(m, vel, batches, rank, first=first):
                return _rank_steps(m, vel, batches, rank, 0, world, lr * world, momentum, log_steps, (seed, first))
            state, logs = _round_by_driver(spark, packed, (i - begun) * world, world, model, velocity, steps)
            log.commit(i, state, logs)
            model, velocity = _with_state(model, state)
            continue
        data = table.batches(lo, hi).withColumn("rank", (F.col("g") % world).cast("int"))
        data = data.select("rank", "g", "epoch", "position", "key", "features", "label") \
            .repartitionById(world, F.col("rank")).sortWithinPartitions("rank", "g", "position")
        bc = L.broadcast_arrays(spark, {**{"p:" + k: v for k, v in model.to_arrays().items()},
                                        **{"v:" + k: v for k, v in velocity.items()}})

        def run(arrow, bc=bc, lo=lo, first=first):
            import pyarrow as pa
            for rank, own in itertools.groupby(_batches_of(arrow, width), key=lambda b: b[0]):
                arrays = L.unpack_arrays(bc.value)
                m = model_cls.from_arrays({k[2:]: v for k, v in arrays.items() if k.startswith("p:")})
                vel = {k[2:]: v for k, v in arrays.items() if k.startswith("v:")}
                logs, reads, probs = _rank_steps(m, vel, (b[1:] for b in own), rank, lo, world, lr * world, momentum,
                                                 log_steps, (seed, first))
                out = [(kind, n, b, rank, v, None, None, None, None, None)
                       for kind, arrs in (("param", m.params), ("velocity", vel)) for kind, n, b, v in _blocks(kind, arrs)]
                out += [("loss", None, None, rank, None, s, float(x), n, None, None) for s, x, n in logs]
                out += [("read", None, None, rank, None, None, None, n, e, t) for e, (n, t) in reads.items()]
                out += [("prob", None, s, rank, p, s, None, None, None, k) for s, k, p in probs]
                types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int32(),
                         pa.float64(), pa.int64(), pa.int32(), pa.decimal128(38, 0))
                names = [x.split()[0] for x in ROUND_ROWS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        got = _average(data.mapInArrow(run, ROUND_ROWS)).collect()     # one copy of the state, and the log
        state = _state(got, model) or {**{"param:" + k: v for k, v in model.params.items()},
                                       **{"velocity:" + k: v for k, v in velocity.items()}}
        log.commit(i, state, [
            {"kind": r.kind, "rank": r["rank"], "values": r["values"], "step": r.step, "loss": r.loss, "n": r.n,
             "epoch": r.epoch, "key_sum": None if r.key_sum is None else int(r.key_sum)}
            for r in got if r.kind not in ("param", "velocity")])
        model, velocity = _with_state(model, state)
    if log.done == n_rounds:
        table.close()
    logs = spark.read.schema(LOG_ROWS).json(f"{path}/log")
    history = logs.where("kind = 'loss'").groupBy("step").agg((F.sum("loss") / F.sum("n")).alias("loss"))
    reads = logs.where("kind = 'read'").select("epoch", "round", "rank", "n", "key_sum")
    probs = logs.where("kind = 'prob'").select("step", F.col("key_sum").cast("long").alias("key"),
                                               F.col("values").alias("probabilities"))
    from tessera.operators.scoring import save_model
    model_path = save_model(spark, model, f"{path}/model-{log.done:06d}-{uuid.uuid4().hex[:8]}")
    return TrainResult(model_path, model, history, reads, [log.state_path(i) for i in range(log.done)], probs, resumed)


def gradient_step(df: DataFrame, model: Model, features: str = "features",
                  label: str = "label") -> DataFrame:
    """Full-batch mean gradient of the cross-entropy, one row per parameter
    element ``(param, k, j, grad)``: each task sums its rows' gradients in
    NumPy and emits one partial per element; Spark adds the partials."""
    bc = L.broadcast_arrays(df.sparkSession, model.to_arrays())
    width = int(np.prod(model.shape)) if hasattr(model, "shape") else model.dim
    model_cls = type(model)
    key = uuid.uuid4().hex

    def partial(batches):
        import pyarrow as pa

        from tessera.operators.scoring import worker_model
        m = worker_model(bc, key, model_cls)
        acc, n = {k: np.zeros_like(v) for k, v in m.params.items()}, 0
        for b in batches:
            if b.num_rows:
                g, _ = m.grad_sums(L.list_matrix(b.column(features), width),
                                   b.column(label).to_numpy(zero_copy_only=False).astype(np.float64))
                for k in acc:
                    acc[k] += g[k]
                n += b.num_rows
        if n == 0:
            return
        for name, g in acc.items():
            g2 = g.reshape(g.shape[0], -1)
            k, j = np.meshgrid(np.arange(g2.shape[0]), np.arange(g2.shape[1]), indexing="ij")
            yield pa.RecordBatch.from_pydict({
                "param": pa.array([name] * g2.size, pa.string()),
                "k": pa.array(k.ravel().astype(np.int32)), "j": pa.array(j.ravel().astype(np.int32)),
                "s": pa.array(g2.ravel()), "n": pa.array(np.full(g2.size, n, np.int64))})

    parts = df.select(features, F.col(label).cast("double").alias(label)).mapInArrow(
        partial, "param string, k int, j int, s double, n bigint")
    return parts.groupBy("param", "k", "j").agg(
        (F.sum("s") / F.sum("n")).alias("grad"))


__all__ = ["train", "default_world", "gradient_step", "TrainResult", "EpochTables"]
