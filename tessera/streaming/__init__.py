"""Scoring a table that arrives as files, with Structured Streaming.

New Parquet files of the table are picked up as micro-batches
(``maxFilesPerTrigger``), scored with the broadcast model, and appended to
a Parquet sink; the checkpoint and the sink live in the shared folder, so a
restarted query resumes where it stopped and writes each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import scoring as SC
from tessera.operators.model import Model
from tessera.session import shared_dir


def score_stream(spark: SparkSession, source_dir: str, table: str, model: Model,
                 sink: str | None = None, files_per_trigger: int = 8) -> DataFrame:
    """Score ``<table>.parquet`` and the numbered ``<table>-N.parquet`` of
    ``source_dir``, each a file or a folder of part files, as a stream (run
    until all present files are done) and return the sink as a table."""
    source_dir = source_dir.rstrip("/")
    names = f"{source_dir}/{table}{{,-[0-9]*}}.parquet"
    schema = spark.read.option("basePath", source_dir).parquet(names).schema
    stream = (spark.readStream.schema(schema)
              .option("basePath", source_dir)          # partition columns of a folder are read from its paths
              .option("maxFilesPerTrigger", files_per_trigger)
              .parquet(names))
    feats = stream.select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))
    scored = SC.score_table(feats, model).drop("features")
    sink = sink or shared_dir(spark, f"stream-{table}")
    q = (scored.writeStream.format("parquet")
         .option("checkpointLocation", f"{sink}/_checkpoint")
         .option("path", f"{sink}/data")
         .outputMode("append")
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return spark.read.parquet(f"{sink}/data")


__all__ = ["score_stream"]
