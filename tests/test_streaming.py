"""Streaming scoring: files are picked up as they arrive, each exactly once,
and a restarted query resumes from its checkpoint."""

import shutil

from pyspark.sql import functions as F

from tests.conftest import SF01
from tessera.operators.model import SoftmaxRegression
from tessera.operators.scoring import score_table
from tessera.plans.queries import _emb
from tessera.streaming import score_stream


def test_stream_scores_new_files_once(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet")
    parts = emb.withColumn("part", F.col("vec_id") % 3)
    stage = tmp_path / "stage"
    parts.write.partitionBy("part").parquet(str(stage))

    def publish(i):
        for j, f in enumerate(sorted((stage / f"part={i}").glob("*.parquet"))):
            shutil.copy(f, src / f"embeddings-{i}-{j}.parquet")

    model = SoftmaxRegression.fixture(64)
    sink = str(tmp_path / "sink")
    publish(0)
    publish(1)
    first = score_stream(spark, str(src), "embeddings", model, sink=sink, files_per_trigger=1)
    n_first = first.count()
    publish(2)                                   # arrives after the first run
    second = score_stream(spark, str(src), "embeddings", model, sink=sink, files_per_trigger=1)
    got = {r.vec_id: r.prediction for r in second.collect()}
    assert n_first == emb.filter("vec_id % 3 != 2").count()
    assert second.count() == emb.count() == len(got)      # each row once
    want = {r.vec_id: r.prediction for r in score_table(_emb(spark, SF01), model).collect()}
    assert got == want


def test_tables_in_folders_are_streamed_whole(spark, tmp_path):
    """A table may be a folder of part files, also one with partition columns,
    beside other tables and numbered arrivals."""
    src = tmp_path / "src"
    emb = spark.range(0, 60, 1, 5).selectExpr(
        "id as vec_id", "cast(id % 3 as int) as label",
        "transform(sequence(1, 64), i -> cast((id * i) % 7 as float)) as embedding")
    emb.where("vec_id < 40").repartition(5).write.parquet(str(src / "embeddings.parquet"))
    emb.where("vec_id >= 40").repartition(2).write.parquet(str(src / "embeddings-1.parquet"))
    emb.selectExpr("vec_id as other").write.parquet(str(src / "embeddings-old.parquet"))
    emb.selectExpr("vec_id as other").write.parquet(str(src / "labels.parquet"))
    model = SoftmaxRegression.fixture(64)
    want = {(r.vec_id, r.label, r.prediction) for r in score_table(emb.withColumnRenamed("embedding", "features"), model).collect()}

    def got(path, name, files):
        rows = score_stream(spark, path, "embeddings", model, sink=str(tmp_path / name), files_per_trigger=files).collect()
        assert len(rows) == 60
        return {(r.vec_id, r.label, r.prediction) for r in rows}
    assert got(str(src), "sink", 3) == want
    assert got(f"{src}/", "sink-slash", 100) == want

    parted = tmp_path / "parted"
    emb.write.partitionBy("label").parquet(str(parted / "embeddings.parquet"))
    assert got(str(parted), "sink-parted", 2) == want
