"""Values stated or implied by the reference and checked in both engines."""

import math

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF01
from tessera.functions import scalars as S
from tessera.operators import aggregates as A
from tessera.operators import udfs as U
from tessera.plans import queries as Q
from tessera.sources import readers as R


def test_range_0_to_9_in_3_slices_sums_to_45(spark):
    rng = R.int_range(spark, 0, 10, 3)
    assert A.global_sum(rng, "id").first().total == 45
    slices = rng.groupBy(F.spark_partition_id().alias("p")).agg(
        F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("p").collect()
    assert [(r.lo, r.hi) for r in slices] == [(0, 2), (3, 5), (6, 9)]


def test_inclusive_range_1_to_3(spark):
    assert [r.id for r in R.int_range(spark, 1, 3, 3, inclusive=True).collect()] == [1, 2, 3]


def test_pipe_partials_3_12_30(spark):
    rng = R.int_range(spark, 0, 10, 3)
    partials = [int(r.line) for r in U.pipe_partitions(rng, "id", U.SUM_PROGRAM).collect()]
    assert sorted(partials) == [3, 12, 30]
    assert U.pipe_sum(rng, "id").first().total == 45


def test_base64_of_200_bytes_is_268_chars_on_one_line(spark):
    row = spark.range(1).select(S.base64_encode(F.expr("cast(repeat('a', 200) as binary)")).alias("b")).first()
    assert len(row.b) == 268 and "\n" not in row.b


def test_linenumber_sum_sf001(spark):
    assert Q.q_global_sum(spark, SF01).first().total == 240315


def test_lattice_on_a_million_points(spark):
    pts = spark.range(1_000_000).select(
        ((F.col("id") % 1000 + 0.5) / 1000).alias("x"),
        ((F.floor(F.col("id") / 1000) + 0.5) / 1000).alias("y"))
    r = A.pi_estimate(pts).first()
    assert r.hits == 785419 and abs(r.pi - 3.141676) < 1e-9


def test_fixture_model_metrics_sf001(spark):
    r = Q.q_accuracy(spark, SF01).first()
    assert r.n == 500 and abs(r.accuracy - 0.08) < 1e-9 and abs(r.mean_ce - 2.3856) < 1e-4


def test_gradient_step_golden_sf001(spark):
    g = {(r.param, r.k, r.j): r.grad for r in Q.q_gradient_step(spark, SF01).collect()}
    assert abs(g[("W", 0, 0)] - (-0.000639)) < 5e-7
    assert abs(g[("W", 0, 1)] - (-0.001911)) < 5e-7


def test_report_row_format(spark):
    df = spark.createDataFrame([(3, 45)], "np int, total bigint")
    assert A.report_row(df, "np", "total").first().report == "np= 3;    sum=45"
    pi = spark.createDataFrame([(3, math.pi)], "np int, pi double")
    assert A.report_row(pi, "np", "pi", fmt="np=%2d;    PI=%0.4f").first().report == "np= 3;    PI=3.1416"


def test_fixture_matrix_rule():
    from tessera.operators.model import fixture_matrix
    w = fixture_matrix(10, 64)
    assert w[0, 0] == -0.5 and w[1, 1] == ((7 + 3) % 11 - 5) / 10 and w.shape == (10, 64)
    assert np.all(np.abs(w) <= 0.5)
