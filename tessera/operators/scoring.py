"""Model save/load (parameter table in Parquet) and whole-table scoring.

Scoring forms, all batched through Arrow with the model broadcast once and
built once per Python worker:
  * ``score_table``        ``predict_batch_udf`` (the default)
  * ``score_pandas``       a scalar ``pandas_udf``
  * ``score_map_in_pandas`` ``mapInPandas`` appending the prediction column
"""

from __future__ import annotations

import time
import uuid

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)

from tessera.operators import layers as L
from tessera.operators.model import Model
from tessera.session import shared_dir

PARAM_SCHEMA = StructType([
    StructField("layer", StringType(), False),
    StructField("shape", ArrayType(IntegerType()), False),
    StructField("values", ArrayType(DoubleType()), False),
])


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def save_model(spark: SparkSession, model: Model, path: str | None = None) -> str:
    """Write the parameter table to a new versioned folder; return its path."""
    path = path or shared_dir(spark, f"model/{int(time.time())}")
    spark.createDataFrame(model.to_rows(), PARAM_SCHEMA).coalesce(1) \
        .write.mode("errorifexists").parquet(path)
    return path


def load_model(spark: SparkSession, path: str) -> Model:
    """Read a parameter table (model-sized, so it comes to the driver once)."""
    rows = spark.read.parquet(path).select("layer", "shape", "values").collect()
    return Model.from_rows([(r.layer, r.shape, r["values"]) for r in rows])


def _broadcast_model(spark: SparkSession, model: Model):
    return L.broadcast_arrays(spark, model.to_arrays())


# Models rebuilt on this Python worker, by a key made when the model was
# broadcast: workers are reused across tasks, so a model is unpacked once per
# worker, not once per task.
_WORKER_MODELS: dict[str, Model] = {}


def worker_model(bc, key: str, model_cls=Model) -> Model:
    m = _WORKER_MODELS.get(key)
    if m is None:
        if len(_WORKER_MODELS) >= 4:
            _WORKER_MODELS.clear()
        m = _WORKER_MODELS[key] = model_cls.from_arrays(L.unpack_arrays(bc.value))
    return m


def _width(model: Model) -> int:
    return int(np.prod(model.shape)) if hasattr(model, "shape") else model.dim


def batch_rows(model: Model) -> int:
    """Rows scored at once, so that a layer's output stays near 64 MB."""
    per_row = 8 * max([_width(model), *(int(np.prod(model.shape[:2])) * v.shape[-1]
                                        for v in model.params.values() if v.ndim == 4)])
    return max(16, min(4096, L.CONV_CHUNK_BYTES // per_row))


def prediction_udf(spark: SparkSession, model: Model, batch_size: int | None = None,
                   output: str = "class"):
    """A ``predict_batch_udf`` giving the class (double), the score vector
    (``logits``) or the ``record``: classes and probabilities from one pass."""
    bc = _broadcast_model(spark, model)
    width = _width(model)
    model_cls = type(model)          # referenced so the worker imports the model's module

    def make_predict_fn():
        m = model_cls.from_arrays(L.unpack_arrays(bc.value))

        def predict(x: np.ndarray):
            x = x.astype(np.float64, copy=False).reshape(len(x), width)
            if output == "class":
                return m.predict(x).astype(np.float64)
            z = m.forward(x)
            if output == "record":
                return {"classes": z.argmax(axis=1), "probabilities": L.softmax(z)}
            return z
        return predict

    rtype = {"class": DoubleType(), "logits": ArrayType(DoubleType()),
             "record": StructType([StructField("classes", LongType()),
                                   StructField("probabilities", ArrayType(DoubleType()))])}[output]
    return predict_batch_udf(make_predict_fn, return_type=rtype, batch_size=batch_size or batch_rows(model),
                             input_tensor_shapes=[[width]])


def score_table(df: DataFrame, model: Model, features="features",
                out_col: str = "prediction", batch_size: int | None = None) -> DataFrame:
    """Append the predicted class as ``double`` (dropout off, as in scoring)."""
    udf = prediction_udf(df.sparkSession, model, batch_size, "class")
    return df.withColumn(out_col, udf(_c(features)))


def score_record(df: DataFrame, model: Model, features="features", out_col: str = "record",
                 batch_size: int | None = None) -> DataFrame:
    """Append the prediction record, a struct of classes and probabilities."""
    udf = prediction_udf(df.sparkSession, model, batch_size, "record")
    return df.withColumn(out_col, udf(_c(features)))


def logits_column(spark: SparkSession, model: Model, features="features",
                  batch_size: int | None = None) -> Column:
    return prediction_udf(spark, model, batch_size, "logits")(_c(features))


def score_pandas(df: DataFrame, model: Model, features="features",
                 out_col: str = "prediction") -> DataFrame:
    """Scalar pandas UDF ``array -> double``; the model is built once per worker."""
    bc = _broadcast_model(df.sparkSession, model)
    width = _width(model)
    model_cls = type(model)
    key = uuid.uuid4().hex

    @F.pandas_udf("double")
    def infer(s: pd.Series) -> pd.Series:
        m = worker_model(bc, key, model_cls)
        return pd.Series(m.predict(L.stack_column(s, width)).astype(np.float64))

    return df.withColumn(out_col, infer(_c(features)))


def score_map_in_pandas(df: DataFrame, model: Model, features: str = "features",
                        out_col: str = "prediction", keep: list[str] | None = None) -> DataFrame:
    """Partition map: each pandas batch gets a prediction column appended.
    ``keep`` limits the columns handed back (all by default): returning a
    wide vector column costs a pandas -> Arrow conversion per row."""
    bc = _broadcast_model(df.sparkSession, model)
    width = _width(model)
    kept = [f for f in df.schema.fields if keep is None or f.name in keep]
    schema = StructType(kept + [StructField(out_col, DoubleType())])
    names = [f.name for f in kept]
    model_cls = type(model)
    key = uuid.uuid4().hex

    def infer(batches):
        m = worker_model(bc, key, model_cls)
        for pdf in batches:
            pred = m.predict(L.stack_column(pdf[features], width)) if len(pdf) else []
            yield pdf[names].assign(**{out_col: np.asarray(pred, np.float64)})

    return df.mapInPandas(infer, schema)
