"""Restartable training, keyed permutations, wide means, program reports."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import partitions as P
from tessera.operators import training as TR
from tessera.operators import udfs as U
from tessera.operators.model import SoftmaxRegression
from tessera.session import shared_dir
from tessera.sources import fs
from tests.conftest import SF01


def emb(spark):
    return spark.read.parquet(f"{SF01}/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("features"))


# ---- keyed permutations ----

@pytest.mark.parametrize("n", [1, 2, 3, 10, 16, 17, 101, 1000])
def test_permuted_is_a_permutation(spark, n):
    for seed, epoch in ((0, 0), (5, 3)):
        got = [r[0] for r in spark.range(n).select(P.permuted("id", n, seed, epoch)).collect()]
        assert sorted(got) == list(range(n))


def test_orders_differ_and_are_spread(spark):
    n = 5000
    rows = spark.range(n).select(*[P.permuted("id", n, s, e).alias(f"p{s}{e}") for s in (1, 2) for e in (0, 1)]).toPandas()
    x = rows.to_numpy()
    for i in range(4):
        assert abs(np.corrcoef(np.arange(n), x[:, i])[0, 1]) < 0.06 and abs(np.corrcoef(x[:-1, i], x[1:, i])[0, 1]) < 0.06
        assert (np.abs(np.diff(x[:, i])) == 1).sum() < 20
        for j in range(i):
            assert (x[:, i] == x[:, j]).sum() < 20 and abs(np.corrcoef(x[:, i], x[:, j])[0, 1]) < 0.06
    counts = np.histogram(x[:500, 0], 10, (0, n))[0]   # the first tenth lands everywhere
    assert counts.min() > 20


def test_epoch_batches_are_a_projection(spark):
    path = f"{shared_dir(spark, 'test-numbered')}/rows"
    size, starts = P.write_numbered(spark.range(0, 1000, 1, 7).selectExpr("id * 3 as k"), path)
    numbered = P.read_numbered(spark, path, starts)
    assert size == 1000 and sorted(r.position for r in numbered.collect()) == list(range(1000))
    assert [r.k for r in numbered.orderBy("position").collect()] == [3 * i for i in range(1000)]
    out = P.epoch_batches(numbered, size, 64, 2, seed=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Exchange range" not in plan and "Sort" not in plan
    per = {(r.epoch, r.batch_id): r.n for r in out.groupBy("epoch", "batch_id").agg(F.count("*").alias("n")).collect()}
    assert per == {(e, b): 64 if b < 15 else 40 for e in (0, 1) for b in range(16)}


# ---- a run that is cut goes on ----

ARGS = dict(world=2, steps=24, lr=0.05, sync_every=3, log_every=4, seed=9, batch=60, key="vec_id")


def same(a, b):
    return all(np.array_equal(a.params[k], b.params[k]) for k in a.params)


def test_a_cut_run_ends_like_an_uncut_one(spark):
    whole = TR.train(emb(spark), SoftmaxRegression(64), **ARGS)
    path = shared_dir(spark, "test-cut")
    for stop, found in ((1, 0), (3, 1), (None, 3), (None, 4)):
        res = TR.train(emb(spark), SoftmaxRegression(64), path=path, stop_after=stop, **ARGS)
        assert res.resumed_from == found and len(res.rounds) == (stop or 4)
    assert same(whole.model, res.model)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(whole.history) == key(res.history) and key(whole.reads) == key(res.reads)
    assert key(whole.probabilities) == key(res.probabilities)
    assert not [n for n in fs.names(path) if n.startswith(("epochs-", "rows"))]      # nothing but the log is left


def test_a_round_without_a_state_is_run_again(spark):
    path = shared_dir(spark, "test-torn")
    TR.train(emb(spark), SoftmaxRegression(64), path=path, stop_after=2, **ARGS)
    fs.remove(f"{path}/state-000001.npz")              # the driver was lost between log and state
    fs.remove(f"{path}/rows.json")                     # and the numbering was not complete
    res = TR.train(emb(spark), SoftmaxRegression(64), path=path, **ARGS)
    whole = TR.train(emb(spark), SoftmaxRegression(64), **ARGS)
    assert res.resumed_from == 1 and same(whole.model, res.model)
    steps = [r.step for r in res.history.collect()]
    assert len(steps) == len(set(steps))


def test_another_run_is_not_continued(spark):
    path = shared_dir(spark, "test-other")
    TR.train(emb(spark), SoftmaxRegression(64), path=path, stop_after=1, **ARGS)
    with pytest.raises(ValueError, match="different: lr$"):
        TR.train(emb(spark), SoftmaxRegression(64), path=path, **{**ARGS, "lr": 0.1})
    with pytest.raises(ValueError, match="row_hash, rows"):
        TR.train(emb(spark).where("vec_id > 3"), SoftmaxRegression(64), path=path, **ARGS)
    with pytest.raises(ValueError, match="start"):
        TR.train(emb(spark), SoftmaxRegression.fixture(64), path=path, **ARGS)


def test_recorded_probabilities_are_rank_zeros(spark):
    res = TR.train(emb(spark), SoftmaxRegression(64), **{**ARGS, "steps": 8, "sync_every": 1})
    rows = res.probabilities.collect()
    per = {}
    for r in rows:
        per.setdefault(r.step, []).append(r)
        assert math.isclose(sum(r.probabilities), 1.0, abs_tol=1e-12)
    assert sorted(per) == [0, 3] and all(len(v) == 60 for v in per.values())
    assert all(p == 0.1 for r in per[0] for p in r.probabilities)
    assert any(p != 0.1 for r in per[3] for p in r.probabilities)


def test_rounds_of_a_stretch_are_shuffled_together(spark, monkeypatch):
    """A round of small states and batches is a job on partitions that one
    shuffle made for the whole stretch."""
    calls, made = [], TR.EpochTables.batches

    def batches(self, lo, hi):
        calls.append((lo, hi))
        return made(self, lo, hi)
    monkeypatch.setattr(TR.EpochTables, "batches", batches)
    kw = dict(world=2, epochs=2, batch=60, lr=0.05, seed=4, log_every=3, key="vec_id")
    for sync in (1, 2):
        calls.clear()
        quick = TR.train(emb(spark), SoftmaxRegression(64), sync_every=sync, **kw)
        assert calls == [(0, 18)] and len(quick.rounds) == (9 if sync == 1 else 5)
        with monkeypatch.context() as m:
            m.setattr(TR, "STRETCH_ROWS", 0)           # stretches of an epoch
            calls.clear()
            cut = TR.train(emb(spark), SoftmaxRegression(64), sync_every=sync, **kw)
            assert len(calls) == 2
            m.setattr(TR, "STATE_BYTES", 0)            # averaged by blocks, a shuffle per round
            calls.clear()
            blocks = TR.train(emb(spark), SoftmaxRegression(64), sync_every=sync, **kw)
            assert len(calls) == len(blocks.rounds) == len(quick.rounds)
        key = lambda df: sorted(map(str, df.collect()))
        for other in (cut, blocks):
            assert same(quick.model, other.model) and key(quick.probabilities) == key(other.probabilities)
            assert key(quick.history) == key(other.history) and key(quick.reads) == key(other.reads)


def test_ranks_without_batches_do_not_hold_up_a_round(spark):
    few = emb(spark).where("vec_id < 50")
    res = TR.train(few, SoftmaxRegression(64), 4, epochs=3, batch=40, key="vec_id")
    assert sum(r.n for r in res.reads.collect()) == 150 and len(res.rounds) == 2


# ---- means without a row per element ----

def test_wide_means(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 2), None if rng.random() < 0.1 else
             [None if rng.random() < 0.1 else rng.uniform(-5, 5) for _ in range(rng.choice([0, 3, 5]))]) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, h int, v array<double>").repartition(5)
    want = {}
    for g, h, v in rows:
        for by in ((g,), (g, h), ()):
            for i, x in enumerate(v or []):
                if x is not None:
                    want.setdefault((*by, i), []).append(x)
    for limit in (8, 1 << 20):
        monkeypatch.setattr(A, "BUFFER_VALUES", limit)
        for by in (["g"], ["g", "h"], []):
            out = A.vector_mean_wide(df, "v", by)
            got = {tuple(r[:-1]): r["mean"] for r in out.collect()}
            expected = {k: sum(x) / len(x) for k, x in want.items() if len(k) == len(by) + 1}
            assert got.keys() == expected.keys()
            assert all(math.isclose(got[k], expected[k], abs_tol=1e-12) for k in got)
            assert out.columns == [*by, "pos", "mean"]
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert A.vector_mean_wide(df.limit(0), "v", ["g"]).count() == 0


def test_wide_mean_sends_one_row_per_task_and_group(spark):
    df = spark.range(0, 4000, 1, 4).selectExpr("id % 3 as g", "array_repeat(cast(id as double), 50) as v")
    rows = A.vector_mean_wide(df, "v", ["g"])
    shuffled = rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert shuffled.count("Exchange") == 1 and shuffled.count("MapInArrow") == 2    # the first one sends partial sums
    got = {(r.g, r.pos): r["mean"] for r in rows.collect()}
    assert all(got[g, p] == np.arange(g, 4000, 3).mean() for g in range(3) for p in range(50))


def test_observed_report(spark):
    out = f"{shared_dir(spark, 'test-report')}/rows"
    got = A.observed_report(spark.range(10), F.col("id") % 3, "id", lambda df: df.write.parquet(out))
    assert got["np"] == 3 and got["total"] == 45 and got["seconds"] > 0 and got["report"] == "np= 3;    sum=45"
    assert spark.read.parquet(out).count() == 10


# ---- programs that fail on some ranks ----

def test_program_reports(spark):
    df = spark.range(0, 1000, 1, 5).selectExpr("id", "case when id = 7 then null else id end as v")
    ok = {r["rank"]: r for r in U.pipe_report(df, "v", "wc -l", 3, "id").collect()}
    assert {k: (r.exit_code, r.n_lines, int(r.output), r.error) for k, r in ok.items()} == {
        0: (0, 1, 334, ""), 1: (0, 1, 333, ""), 2: (0, 1, 333, "")}
    died = U.pipe_report(df, "v", 'if [ "$RANK" = 1 ]; then kill -9 $$; fi; cat > /dev/null; echo "$RANK of $WORLD"', 3, "id").collect()
    assert {r["rank"]: (r.exit_code, r.output.strip()) for r in died} == {0: (0, "0 of 3"), 1: (-9, ""), 2: (0, "2 of 3")}
    early = U.pipe_report(df, "v", "head -1; echo done >&2; exit 4", 2, "id").collect()
    assert {(r.exit_code, r.n_lines, r.error) for r in early} == {(4, 1, "done\n")}
    chatty = U.pipe_report(df, "v", "seq 1 200000; seq 1 100000 >&2", 1, "id").first()
    assert chatty.n_lines == 200000 and chatty.output.endswith("200000\n") and len(chatty.output) == len(chatty.error) == U.TAIL
    empty = U.pipe_report(df.where("id < 0"), "v", "wc -l", 2, "id").collect()
    assert all(r.exit_code == 0 and int(r.output) == 0 for r in empty)


def test_a_failing_rank_fails_the_job_if_asked(spark):
    df = spark.range(10)
    with pytest.raises(Exception, match="rank 1: .*exited with 3: no luck"):
        U.pipe_report(df, "id", '[ "$RANK" = 1 ] && { echo no luck >&2; exit 3; }; cat', 2, "id", fail=True).collect()


def test_ranks_come_from_the_data_and_the_slots(spark):
    assert [TR.default_world(n, 100, s) for n, s in ((0, 8), (99, 8), (250, 8), (10**9, 1000))] == [1, 1, 3, 1000]
    res = TR.train(emb(spark), SoftmaxRegression(64), epochs=1, batch=100, slots=3, key="vec_id")
    reads = res.reads.collect()
    assert {r["rank"] for r in reads} == {0, 1, 2} and sum(r.n for r in reads) == 500
