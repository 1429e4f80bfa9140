"""Plan shapes that the scale design relies on: pruned scans, partial
aggregation before every shuffle, no shuffle around scoring, top-k before
Python, ranks from keys, and epochs that are sorted once."""

import re

import pytest

from tests.conftest import SF01
from tessera.operators import gang as G
from tessera.plans.queries import QUERIES, table


def plan(df) -> str:
    df.collect()                      # final adaptive plan
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.sub(r"#\d+L?", "", text)


def test_scan_reads_only_projected_columns(spark):
    p = plan(QUERIES["scan_parquet"](spark, SF01))
    assert "FileScan parquet [l_orderkey,l_linenumber,l_quantity,l_extendedprice,l_returnflag]" in p


@pytest.mark.parametrize("name,partial", [
    ("partial_sums", "partial_sum"), ("global_sum", "partial_sum"),
    ("vector_mean", "partial_avg"), ("gradient_step", "partial_sum"),
    ("pi_lattice", "partial_count"), ("read_whole_text", "partial_sum"),
])
def test_partial_aggregate_before_exchange(spark, name, partial):
    p = plan(QUERIES[name](spark, SF01))
    assert partial in p
    # every exchange sits above a partial aggregate (map-side combine)
    body = p[p.index("Exchange"):] if "Exchange" in p else p
    assert partial in body


@pytest.mark.parametrize("name", ["score_table", "conv2d", "dense_layer", "max_pool",
                                  "score_softmax", "flatten_vectors", "feature_csv"])
def test_row_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF01))


def test_top_k_is_taken_before_scoring(spark):
    from tessera.operators.partitions import top_k
    emb = table(spark, SF01, "embeddings")
    assert "TakeOrderedAndProject" in plan(emb.orderBy("vec_id").limit(10))
    p = plan(QUERIES["top_predictions"](spark, SF01))
    assert "Exchange" not in p and "ArrowEvalPython" in p     # scores the 10 stored rows only
    assert [r.vec_id for r in top_k(emb, 3, "vec_id").collect()] == [0, 1, 2]


def test_scan_pushes_filters(spark):
    df = table(spark, SF01, "lineitem").filter("l_quantity > 45").select("l_orderkey")
    p = plan(df)
    assert "GreaterThan(l_quantity,45.0)" in p


@pytest.mark.parametrize("name", ["partition_zero", "strided_partials", "udf_two_columns"])
def test_ranks_come_from_keys_without_moving_rows(spark, name):
    p = plan(QUERIES[name](spark, SF01))
    # only partial aggregates are exchanged, never rows
    assert p.count("Exchange") == p.count("partial_sum") > 0 if name != "udf_two_columns" else "Exchange" not in p
    assert "BatchEvalPython" not in p


def test_partition_zero_filters_at_the_scan(spark):
    p = plan(QUERIES["partition_zero"](spark, SF01))
    assert p.index("Filter") < p.index("FileScan") and "SPARK_PARTITION_ID" not in p


def test_gang_makes_one_exchange_and_no_job(spark):
    import pandas as pd
    data = table(spark, SF01, "lineitem").select("l_linenumber")

    def fn(ctx, batches):
        yield pd.DataFrame({"n": [sum(len(b) for b in batches)]})
    tracker, group = spark.sparkContext.statusTracker(), "gang-plan"
    spark.sparkContext.setJobGroup(group, group)
    out = G.gang(data, 2, fn, "n long")
    assert not tracker.getJobIdsForGroup(group)            # building it runs nothing
    assert sum(r.n for r in out.collect()) == 60000


def test_training_sorts_a_round_of_epochs_once(spark):
    from pyspark.sql import functions as F

    from tessera.operators import training as TR
    from tessera.session import shared_dir
    rows = table(spark, SF01, "embeddings").select(
        F.col("embedding").alias("features"), F.col("label").cast("double").alias("label"), F.col("vec_id").alias("key"))
    t = TR.EpochTables(rows, 100, 1, shared_dir(spark, "test-epochs"))
    assert t.batches(0, 7).count() == 700 and len(t.kept) == 1     # batches 0-6 span two epochs
    p = plan(t.batches(3, 9))
    assert "Exchange" not in p and len(t.kept) == 1               # read back, not shuffled again


@pytest.mark.parametrize("name", ["dense_layer", "conv2d", "score_softmax", "accuracy"])
def test_python_layer_runs_once(spark, name):
    p = plan(QUERIES[name](spark, SF01))
    assert sum(p.count(k) for k in ("ArrowEvalPython", "MapInArrow", "MapInPandas")) == 1


@pytest.mark.parametrize("name", ["gang_sum", "gang_members", "gang_pi"])
def test_gang_input_is_pre_aggregated(spark, name):
    p = plan(QUERIES[name](spark, SF01))
    first_exchange = p.index("Exchange", p.index("MapInPandas"))
    assert "partial_" in p[first_exchange:]     # per-rank partials combine map-side
