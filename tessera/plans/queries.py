"""The registered queries: one per operator of the inventory, each taking
``(spark, sf_dir)``, reading whole tables, and returning a DataFrame whose
column names and types match the oracle SQL in ``tessera.plans.oracle``.

Floating results are rounded (6 decimals) or reduced to integer micro-units
so that both engines give the same values whatever their summation order.
"""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions import scalars as S
from tessera.functions import tensor as T
from tessera.operators import aggregates as A
from tessera.operators import gang as G
from tessera.operators import layers as L
from tessera.operators import partitions as P
from tessera.operators import scoring as SC
from tessera.operators import training as TR
from tessera.operators import udfs as U
from tessera.operators.model import ConvNet, SoftmaxRegression, fixture_matrix
from tessera.session import shared_dir
from tessera.sources import arrow_source as AS
from tessera.sources import packed as PK
from tessera.sources import readers as R
from tessera.sources import writers as W

DIM, CLASSES = 64, 10          # embeddings: 64 wide (8x8x1), labels 0..9
IMAGE = (8, 8, 1)
WORLD = 3                      # default gang size of the gang queries
RANKS = 4                      # ranks of the partial-sum queries
ROWS_PER_SLICE = 5_000_000     # int_range: more slices as the table grows


def _world(spark) -> int:
    """Gang size: ``tessera.gang.world``; the default 3 is what the oracle SQL
    names.  A barrier stage needs that many task slots at once; ``gang``
    raises when there are fewer."""
    return int(spark.conf.get("tessera.gang.world", str(WORLD)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


def _r(c, d: int) -> F.Column:
    """Round half-up to ``d`` decimals, folding -0.0 into 0.0."""
    return F.round(c, d) + F.lit(0.0)


def _micro(arr) -> F.Column:
    """Sum of ``floor(x * 1e6)`` over an array: exact and order-free."""
    return F.aggregate(F.transform(arr, lambda x: F.floor(x * F.lit(1e6))),
                       F.lit(0).cast("bigint"), lambda a, x: a + x)


def _vector_summary(df, label="label", features="features") -> DataFrame:
    return df.select(F.col(label).cast("int").alias("label"),
                     F.size(features).alias("dim"), _micro(F.col(features)).alias("micro"))


def _stored(spark, sf):
    """Embeddings as stored (float32): the model widens them in NumPy, so the
    JVM sends Python half the bytes of a double array."""
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("features"))


def _fixture_model() -> SoftmaxRegression:
    return SoftmaxRegression.fixture(DIM, CLASSES)


def _scored(spark, sf):
    return SC.score_table(_stored(spark, sf), _fixture_model())


def _with_logits(spark, sf):
    emb = _stored(spark, sf)
    return emb.withColumn("z", SC.logits_column(spark, _fixture_model(), "features"))


# ----------------------------------------------------------------- sources / sinks

def q_scan_parquet(spark, sf):
    return R.scan_parquet(spark, f"{sf}/lineitem.parquet",
                          ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                           "l_returnflag"])


def q_scan_libsvm(spark, sf):
    path = shared_dir(spark, "libsvm")
    emb = table(spark, sf, "embeddings")
    W.write_libsvm(emb, path, features="embedding", label="label")
    return _vector_summary(R.scan_libsvm(spark, path, DIM))


def q_int_range(spark, sf):
    """The range of lineitem's order keys, both ends included, in slices, with
    the rows whose key lies in each slice."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    lo, hi = li.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    slices = max(RANKS, -(-(hi - lo + 1) // ROWS_PER_SLICE))       # bounded ids per slice
    ids = R.int_range(spark, lo, hi, slices, inclusive=True)
    ids = ids.groupBy(F.spark_partition_id().alias("slice")).agg(
        F.min("id").alias("lo"), F.max("id").alias("hi"),
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
    rows = li.groupBy(R.slice_of("l_orderkey", lo, hi + 1, slices).alias("slice")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    return ids.join(rows, "slice", "left").select(
        "slice", "lo", "hi", "n", "total", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("quantity", F.lit(0)).alias("quantity"))


def q_scan_int_text(spark, sf):
    path = shared_dir(spark, "int-text")
    W.write_text(table(spark, sf, "lineitem"), "l_linenumber", path)
    toks = R.scan_int_text(spark, path)
    return toks.agg(F.count("value").alias("n_values"),
                    F.count_if(F.col("value").isNull()).cast("bigint").alias("n_bad"),
                    F.sum("value").alias("total"))


def q_write_text(spark, sf):
    path = shared_dir(spark, "text")
    W.write_text(table(spark, sf, "lineitem"), "l_linenumber", path)
    return spark.read.text(path).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("value").cast("bigint")).alias("total"))


def _exported_features(spark, sf):
    path = shared_dir(spark, "feature-files")
    manifest = W.export_feature_files(_emb(spark, sf), path)
    mpath = shared_dir(spark, "feature-manifest")
    manifest.write.parquet(mpath)          # run the export once, keep its manifest
    return spark.read.parquet(mpath)


def q_export_feature_files(spark, sf):
    return _exported_features(spark, sf).agg(F.sum("n_rows").alias("n_rows"))


def q_scan_feature_text(spark, sf):
    rows = R.scan_feature_files(_exported_features(spark, sf))
    return _vector_summary(rows)


def _exported_arrow(spark, sf):
    path = shared_dir(spark, "arrow")
    mpath = shared_dir(spark, "arrow-manifest")
    W.export_arrow(_emb(spark, sf), path).write.parquet(mpath)
    return spark.read.parquet(mpath)


def q_export_arrow(spark, sf):
    return _exported_arrow(spark, sf).agg(F.sum("n_rows").alias("n_rows"))


def q_scan_arrow(spark, sf):
    manifest = _exported_arrow(spark, sf)
    schema = _emb(spark, sf).schema
    rows = R.scan_arrow(spark, manifest, schema)
    return rows.select("vec_id", F.col("label").cast("int").alias("label"),
                       F.size("features").alias("dim"), _micro(F.col("features")).alias("micro"))


def q_scan_arrow_source(spark, sf):
    """One Arrow file read by several tasks, and of its columns only two."""
    path = shared_dir(spark, "arrow-source")
    AS.write_arrow(_emb(spark, sf).repartition(1), path, rows_per_batch=50)
    rows = AS.scan_arrow_files(spark, path, ["vec_id", "label"], partition_bytes=100_000)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


def q_arrow_sink(spark, sf):
    """Committed Arrow files: an overwritten table, then appended rows."""
    path = shared_dir(spark, "arrow-sink")
    emb = _emb(spark, sf)
    AS.write_arrow(emb.where("vec_id % 5 = 0"), path)
    AS.write_arrow(emb.where("vec_id % 2 = 0").repartition(3), path, "overwrite")
    AS.write_arrow(emb.where("vec_id % 2 = 1").repartition(2), path)
    rows = AS.scan_arrow_files(spark, path)
    return rows.select("vec_id", F.col("label").cast("int").alias("label"),
                       F.size("features").alias("dim"), _micro(F.col("features")).alias("micro"))


def q_packed_objects(spark, sf):
    """Pages in container objects, read back by ranges."""
    path = shared_dir(spark, "packed")
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("name"),
                                             F.col("html").cast("binary").alias("content"))
    PK.write_packed(pages, "name", "content", path, object_bytes=1 << 20)
    return PK.read_packed(spark, path).select(F.col("name").cast("bigint").alias("page_id"), F.col("length").alias("n_bytes"),
                                              F.sha2("content", 256).alias("digest"))


def q_list_files(spark, sf):
    """Files of a folder tree, empty ones included, listed in tasks."""
    path = shared_dir(spark, "tree")
    docs = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    rows = docs.select(F.concat_ws("/", F.md5("lang"), F.md5("source"), F.lit("n.txt")).alias("name"),
                       F.when(F.col("n") % 2 == 0, F.repeat(F.lit("x"), F.col("n").cast("int"))).cast("binary").alias("content"))
    W.write_binary_files(rows, "name", "content", path, make_folders=True).write.format("noop").mode("overwrite").save()
    return PK.list_files(spark, path).select(
        F.regexp_extract("path", "([0-9a-f]{32})/[0-9a-f]{32}/n.txt$", 1).alias("lang_md5"),
        F.regexp_extract("path", "([0-9a-f]{32})/n.txt$", 1).alias("source_md5"), "length")


def q_read_whole_text(spark, sf):
    path = shared_dir(spark, "whole-text")
    # Capped rows per file keep each whole-text row bounded, whatever the skew of ``lang``.
    table(spark, sf, "documents").select("text", "lang").write \
        .option("maxRecordsPerFile", 500).partitionBy("lang").text(path)
    # The text writer ends each row with a line break; cut the whole texts at
    # those breaks again and compare every line with the table's own.
    files = R.read_whole_text(spark, path)
    lines = files.select(F.col("lang").cast("string").alias("lang"), F.octet_length("value").alias("size"),
                         F.explode(F.split("value", "\n")).alias("line"), "path")
    per_file = lines.groupBy("lang", "path").agg(
        F.first("size").alias("size"), _line_sum("line").alias("lines"))
    return per_file.groupBy("lang").agg(
        F.sum("size").cast("bigint").alias("n_bytes"), F.sum("lines").cast("bigint").alias("line_sum"))


def _line_sum(line) -> F.Column:
    """Sum over lines of the first 28 bits of their md5: the lines' content,
    whatever their order (empty lines count nothing)."""
    part = F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("bigint")
    return F.sum(F.when(F.length(line) > 0, part).otherwise(F.lit(0)))


def q_read_whole_text_files(spark, sf):
    """One whole text per event type, empty for purchases: an empty file has
    its row, and a missing folder gives an empty frame."""
    path = shared_dir(spark, "whole-text-files")
    ev = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    text = F.when(F.col("event_type") == "purchase", "").otherwise(
        F.concat(F.col("event_type"), F.lit("\n"), F.col("n").cast("string")))
    W.write_binary_files(ev, F.concat("event_type", F.lit(".txt")), text.cast("binary"), path) \
        .write.format("noop").mode("overwrite").save()
    files = R.read_whole_text(spark, path).unionByName(R.read_whole_text(spark, path + "-missing"))
    return files.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("event_type"), "value")


def q_read_binary(spark, sf):
    path = shared_dir(spark, "binary")
    pages = table(spark, sf, "pages")
    written = W.write_binary_files(
        pages, F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")),
        F.col("html").cast("binary"), path)
    written.write.format("noop").mode("overwrite").save()   # run the writes once
    files = R.read_binary(spark, path, "page-*.html")
    return files.select(
        F.regexp_extract("path", r"page-(\d+)\.html$", 1).cast("bigint").alias("page_id"),
        F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


def q_write_binary(spark, sf):
    """One file per page with its HTML bytes; the writer's per-file report."""
    written = W.write_binary_files(
        table(spark, sf, "pages"),
        F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")),
        F.col("html").cast("binary"), shared_dir(spark, "binary-out"))
    return written.select(
        F.regexp_extract("name", r"page-(\d+)\.html$", 1).cast("bigint").alias("page_id"), "n_bytes")


def q_synth_vectors(spark, sf):
    keys = table(spark, sf, "embeddings").select("vec_id")
    v = R.synth_vectors(keys, dim=784, seed=42, key="vec_id")
    return v.select("vec_id", F.size("features").alias("dim"),
                    F.forall("features", lambda x: (x >= 0) & (x < 1)).alias("all_in_unit"),
                    (F.size(F.array_distinct("features")) == 784).alias("all_differ"),
                    ((F.col("label") >= 0) & (F.col("label") < 1)).alias("label_in_unit"))


def q_model_roundtrip(spark, sf):
    path = SC.save_model(spark, _fixture_model())
    model = SC.load_model(spark, path)
    return SC.score_table(_stored(spark, sf), model).select("vec_id", "prediction")


def q_top_predictions(spark, sf):
    return SC.score_table(P.top_k(_stored(spark, sf), 10, "vec_id"), _fixture_model()) \
        .select("vec_id", "label", "prediction")


# ----------------------------------------------------------------- projections / filters

def q_partition_zero(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return P.rank_rows(li, RANKS, "l_orderkey", 0).agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.col("l_linenumber").cast("bigint")).alias("total"))


def _lattice_xy():
    """A point of the 1000 x 1000 lattice per lineitem row, from its keys."""
    a = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729, F.lit(1000))
    b = F.pmod(F.col("l_orderkey") * 104729 + F.col("l_linenumber") * 7919, F.lit(1000))
    return (a + 0.5) / 1000.0, (b + 0.5) / 1000.0


def _lattice_points(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    x, y = _lattice_xy()
    return li.select(x.alias("x"), y.alias("y"))


def q_pi_lattice(spark, sf):
    est = A.pi_estimate(_lattice_points(spark, sf))
    return est.select("n", "hits", _r("pi", 6).alias("pi"))


def q_pi_monte_carlo(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return A.pi_monte_carlo(li, "l_orderkey", "l_linenumber") \
        .select("n", "hits", _r("pi", 6).alias("pi"), "within_4sd")


# ----------------------------------------------------------------- aggregates

def q_global_sum(spark, sf):
    return A.global_sum(table(spark, sf, "lineitem"), "l_linenumber")


def _partials(spark, sf):
    li = table(spark, sf, "lineitem")
    return A.partial_sums(li, "l_linenumber",
                          F.pmod(F.col("l_orderkey"), F.lit(RANKS)).cast("int"))


def q_partial_sums(spark, sf):
    return _partials(spark, sf)


def q_report_row(spark, sf):
    totals = _partials(spark, sf).agg(F.count(F.lit(1)).alias("np"),
                                      F.sum("partial").alias("total"))
    return A.report_row(totals, "np", "total")


def q_report_observed(spark, sf):
    """The report line from metrics of the running query, with its time."""
    out = f"{shared_dir(spark, 'report')}/rows"
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    began = time.perf_counter()
    got = A.observed_report(li, P.rank_of("l_orderkey", RANKS), "l_linenumber", lambda df: df.write.parquet(out))
    wall = time.perf_counter() - began
    return spark.createDataFrame([(got["report"], got["total"], 0 < got["seconds"] <= wall)],
                                 "report string, total long, timed boolean")


def q_accuracy(spark, sf):
    ev = A.evaluate(_with_logits(spark, sf), "z", "label")
    return ev.select("n", _r("accuracy", 6).alias("accuracy"),
                     _r("mean_ce", 6).alias("mean_ce"))


def q_mean_cross_entropy(spark, sf):
    df = _with_logits(spark, sf)
    return df.agg(_r(F.avg(T.cross_entropy("z", "label")), 6).alias("mean_ce"))


def q_vector_mean(spark, sf):
    m = A.vector_mean(_stored(spark, sf), "features", by=["label"])   # cast per element
    return m.select("label", F.col("pos").cast("int").alias("pos"),
                    _r("mean", 6).alias("mean"))


def q_vector_mean_wide(spark, sf):
    return A.vector_mean_wide(_stored(spark, sf), "features", by=["label"]).select(
        "label", "pos", _r("mean", 6).alias("mean"))


# ----------------------------------------------------------------- sort / limit / batches

def q_minibatch_epochs(spark, sf):
    """Batch of every row in three epochs of keyed random orders; the rows are
    numbered once, in key order."""
    out = shared_dir(spark, "numbered")
    size, starts = P.write_numbered(table(spark, sf, "embeddings").select("vec_id").orderBy("vec_id"), out)
    numbered = P.read_numbered(spark, out, starts)
    return P.epoch_batches(numbered, size, 100, 3, seed=11).select("vec_id", "epoch", "batch_id")


def q_minibatch_assign(spark, sf):
    batched = P.minibatches(_emb(spark, sf).select("vec_id"), batch_size=100, seed=11)
    sizes = P.minibatch_sizes(batched)
    return sizes.agg(F.count(F.lit(1)).alias("n_batches"),
                     F.count_if(F.col("rows") == 100).cast("bigint").alias("n_full"),
                     F.min("rows").alias("min_rows"), F.sum("rows").alias("n_rows"))


# ----------------------------------------------------------------- scalar functions

def q_base64_encode(spark, sf):
    docs = table(spark, sf, "documents")
    enc = S.base64_encode(F.col("text").cast("binary"))
    return docs.select("doc_id", F.length(enc).alias("enc_len"), F.md5(enc).alias("enc_md5"))


def q_base64_decode(spark, sf):
    docs = table(spark, sf, "documents")
    dec = S.base64_decode(S.base64_encode(F.col("text").cast("binary")))
    return docs.select("doc_id", F.octet_length(dec).alias("n_bytes"),
                       (dec.cast("string") == F.col("text")).alias("roundtrip"))


def q_list_join(spark, sf):
    ev = table(spark, sf, "events")
    arr = F.array("event_type", F.when(F.col("value") >= 50, F.col("user_id").cast("string")),
                  "props")
    return ev.select("event_id", S.list_join(arr, ",").alias("joined"))


def q_split_trim(spark, sf):
    parts = S.split_trim(F.concat_ws(" , ", "lang", "source"), ",")
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(parts, "|").alias("parts"), F.size(parts).alias("n_parts"))


def _host_port():
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return F.concat(host, F.lit(":8080"))


def q_split_first(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.split_first(_host_port(), ":").alias("host"))


def q_array_index_of(spark, sf):
    words = F.split("text", " ")
    return table(spark, sf, "documents").select(
        "doc_id", S.array_index_of(words, "the").alias("idx"))


def _doc_map():
    return F.create_map(F.col("lang"), F.split("text", "\n"))


def q_map_first(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", S.map_first(_doc_map(), "en").alias("first_line"))


def q_map_join(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(S.map_join(_doc_map(), "fr", " / ")).alias("joined_md5"))


def q_random_name(spark, sf):
    name = S.random_name("doc_")
    return table(spark, sf, "documents").select(
        "doc_id", name.rlike(r"^doc_-?[0-9]+$").alias("ok"))


def q_feature_csv(spark, sf):
    emb = _emb(spark, sf)
    parsed = S.csv_to_vector(S.vector_to_csv("features"))
    return emb.select("vec_id", F.size(parsed).alias("n_fields"),
                      (parsed == F.col("features")).alias("roundtrip"),
                      _micro(parsed).alias("micro"))


def q_flatten_vectors(spark, sf):
    emb = _emb(spark, sf)
    return emb.select("vec_id", F.posexplode(S.check_width("features", DIM)).alias("pos", "v")) \
        .select("vec_id", F.col("pos").cast("int").alias("pos"), "v")


# ----------------------------------------------------------------- model operators

def q_score_softmax(spark, sf):
    df = _with_logits(spark, sf).withColumn("probabilities", T.softmax("z"))
    return df.select("vec_id",
                     _r(F.element_at("probabilities", F.col("label") + 1), 6).alias("p_label"),
                     _r(F.array_max("probabilities"), 6).alias("p_max"))


def q_one_hot(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.array_join(T.one_hot("label", CLASSES), ",").alias("one_hot"))


def q_argmax_class(spark, sf):
    return _with_logits(spark, sf).select("vec_id", T.argmax("z").alias("class"))


def q_relu(spark, sf):
    r = T.relu(F.col("z"))
    return _with_logits(spark, sf).select(
        "vec_id", F.size(F.filter(r, lambda x: x > 0)).alias("n_pos"),
        _r(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), 6).alias("relu_sum"))


DENSE_UNITS = 16


def q_dense_layer(spark, sf):
    kernel = fixture_matrix(DENSE_UNITS, DIM).T          # (inputs, units)
    out = L.dense_layer(_stored(spark, sf), "features", kernel, None, "relu", "dense")
    # The layer always yields DENSE_UNITS values; the _outer form keeps Catalyst
    # from inferring a size filter that would run the Python layer twice.
    return out.select("vec_id", F.posexplode_outer("dense").alias("unit", "value")) \
        .select("vec_id", F.col("unit").cast("int").alias("unit"), _r("value", 6).alias("value"))


CONV_FILTERS, KSIZE = 4, 5


def conv_kernel(filters=CONV_FILTERS, ksize=KSIZE, channels=1) -> np.ndarray:
    """Fixture kernel: rule over (filter, offset = (dy*k + dx)*c + ch)."""
    return fixture_matrix(filters, ksize * ksize * channels).T.reshape(ksize, ksize, channels, filters)


def q_conv2d(spark, sf):
    out = L.conv2d_layer(_stored(spark, sf), "features", IMAGE, conv_kernel(), None, "relu", "conv")
    # Per filter, sum and max over the row's own output array: no explode, no shuffle.
    per_filter = F.transform(
        F.sequence(F.lit(0), F.lit(CONV_FILTERS - 1)),
        lambda f: F.struct(
            f.alias("filter"),
            F.aggregate(F.filter("conv", lambda x, i: i % CONV_FILTERS == f),
                        F.lit(0.0), lambda a, x: a + x).alias("act_sum"),
            F.array_max(F.filter("conv", lambda x, i: i % CONV_FILTERS == f)).alias("act_max")))
    return out.select("vec_id", F.inline(per_filter)).select(
        "vec_id", "filter", _r("act_sum", 6).alias("act_sum"), _r("act_max", 6).alias("act_max"))


def q_max_pool(spark, sf):
    out = L.max_pool_layer(_emb(spark, sf), "features", IMAGE, "pooled")
    return out.select("vec_id", F.posexplode_outer("pooled").alias("cell", "value")) \
        .select("vec_id", F.col("cell").cast("int").alias("cell"), "value")


def q_gradient_step(spark, sf):
    zero = SoftmaxRegression(DIM, CLASSES)
    g = TR.gradient_step(_stored(spark, sf), zero)
    return g.select("param", "k", "j", _r("grad", 9).alias("grad"))


def q_gradient_step_fixture(spark, sf):
    """The same full-batch gradient at the closed-form (non-zero) weights."""
    g = TR.gradient_step(_stored(spark, sf), _fixture_model())
    return g.select("param", "k", "j", _r("grad", 9).alias("grad"))


# ----------------------------------------------------------------- training / scoring

def q_score_table(spark, sf):
    return _scored(spark, sf).select("vec_id", "label", "prediction")


def q_score_convnet(spark, sf):
    """The two-convolution network (closed-form fixture weights) scoring the
    whole table: conv 5x5 x4 -> pool -> conv 5x5 x8 -> pool -> dense 16 -> 10."""
    return SC.score_table(_stored(spark, sf), ConvNet.fixture(*IMAGE)) \
        .select("vec_id", "label", "prediction")


def q_score_table_pandas(spark, sf):
    return SC.score_pandas(_stored(spark, sf), _fixture_model()).select("vec_id", "label", "prediction")


def q_score_map_in_pandas(spark, sf):
    return SC.score_map_in_pandas(_stored(spark, sf), _fixture_model(), keep=["vec_id", "label"]) \
        .select("vec_id", "label", "prediction")


TRAIN_ARGS = dict(batch=K.BATCH_SIZE, lr=0.05, momentum=K.MOMENTUM, seed=5)


def _train_world(spark) -> int:
    """Ranks of a training run: ``tessera.train.world``.  Ranks are tasks that
    need not run at once, so any number works on any cluster; more ranks take
    larger steps together.  The default 4 is what the oracle SQL names."""
    return int(spark.conf.get("tessera.train.world", "4"))


def q_train_model(spark, sf):
    res = TR.train(_stored(spark, sf), SoftmaxRegression(DIM, CLASSES), _train_world(spark), steps=120,
                   sync_every=10, **TRAIN_ARGS)
    return _beats_majority(SC.score_table(_stored(spark, sf), res.model), res.model)


CONVNET = dict(height=8, width=8, channels=1, f1=4, f2=8, hidden=32, classes=CLASSES, ksize=5)


def q_train_convnet(spark, sf):
    """The two-convolution network, trained data-parallel with dropout, long
    enough to be well past the majority class (0.30 against 0.13 on sf0.001)."""
    emb = _stored(spark, sf)
    res = TR.train(emb, ConvNet(**CONVNET), _train_world(spark), steps=960, sync_every=20,
                   **{**TRAIN_ARGS, "seed": 3})
    return _beats_majority(SC.score_table(emb, res.model), res.model)


def _beats_majority(scored, model):
    per_class = scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.col("prediction") == F.col("label")).cast("bigint")).alias("hits"))
    return per_class.agg(
        F.lit(model.n_params()).alias("n_params"),
        (F.sum("hits") / F.sum("rows") > F.max("rows") / F.sum("rows")).alias("beats_majority"))


def q_train_history(spark, sf):
    """The logged losses of 20 steps per rank: the first from zero weights is
    ln 10, the last is lower."""
    res = TR.train(_stored(spark, sf), SoftmaxRegression(DIM, CLASSES), _train_world(spark),
                   steps=20 * _train_world(spark), sync_every=5, log_every=5, **TRAIN_ARGS)
    start = F.lit(float(np.log(CLASSES)))
    return res.history.select("step", F.when(F.col("step") == 0, F.abs(F.col("loss") - start) < 1e-9)
                              .otherwise(F.col("loss") < start).alias("loss_ok"))


def q_train_coverage(spark, sf):
    """Rows the ranks read in three epochs of several rounds each: every epoch
    reads the whole table once."""
    res = TR.train(_stored(spark, sf), SoftmaxRegression(DIM, CLASSES), _train_world(spark), epochs=3,
                   sync_every=1, key="vec_id", **{**TRAIN_ARGS, "batch": 40})
    return res.reads.groupBy("epoch").agg(
        F.sum("n").alias("n_rows"), F.sum("key_sum").cast("bigint").alias("key_sum"),
        (F.count_distinct("round") > 1).alias("several_rounds"))


EXACT = dict(lr=0.05, momentum=K.MOMENTUM, seed=7, key="vec_id", log_every=1)


def _parameters(spark, path):
    """(param, k, j, value) of a parameter table."""
    p = spark.read.parquet(path).where("layer in ('W', 'b')").select("layer", F.posexplode("values").alias("i", "value"))
    wide = F.col("layer") == "W"
    return p.select(F.col("layer").alias("param"),
                    F.when(wide, F.floor(F.col("i") / DIM)).otherwise(F.col("i")).cast("int").alias("k"),
                    F.when(wide, F.col("i") % DIM).otherwise(0).cast("int").alias("j"), _r("value", 9).alias("value"))


def _full_batches(spark, sf, world, **kw):
    """Three synchronous momentum steps whose batches are the whole table."""
    emb = _stored(spark, sf)
    return TR.train(emb, SoftmaxRegression(DIM, CLASSES), world, steps=3 * world, batch=-(-emb.count() // world),
                    **EXACT, **kw)


def q_train_exact(spark, sf):
    """Parameters after three steps on one and on two ranks."""
    one, two = (_parameters(spark, _full_batches(spark, sf, w).model_path).withColumn("world", F.lit(w)) for w in (1, 2))
    return one.unionByName(two)


def q_train_resume(spark, sf):
    """A run whose driver stops after its first round, called again: it goes
    on from there and ends with the parameters of an uncut run."""
    path = shared_dir(spark, "cut")
    _full_batches(spark, sf, 2, path=path, stop_after=1)
    res = _full_batches(spark, sf, 2, path=path)
    return _parameters(spark, res.model_path).withColumn("resumed_from", F.lit(res.resumed_from)).withColumn(
        "rounds", F.lit(len(res.rounds)))


def q_train_log(spark, sf):
    """The probabilities that rank 0 records at each step."""
    res = _full_batches(spark, sf, 1)
    return res.probabilities.select("step", F.col("key").alias("vec_id"), F.posexplode("probabilities").alias("class", "p")) \
        .select("step", "vec_id", "class", _r("p", 9).alias("p"))


def q_predict_record(spark, sf):
    """Class and probabilities of each row from one pass through the model."""
    rec = SC.score_record(_stored(spark, sf), _fixture_model())
    return rec.select("vec_id", F.col("record.classes").cast("int").alias("class"),
                      _r(F.array_max("record.probabilities"), 6).alias("p_max"),
                      F.size("record.probabilities").alias("n_classes"))


def q_dropout(spark, sf):
    """Dropout over the whole table: elements kept and their scaled sum."""
    out = _emb(spark, sf).select("vec_id", T.dropout("features", K.DROPOUT_RATE, "vec_id").alias("d"))
    return out.select("vec_id", F.size(F.filter("d", lambda x: x != 0)).alias("n_kept"), _micro(F.col("d")).alias("micro"))


def q_float_arrays(spark, sf):
    """Doubles cut to single precision: a third of each element."""
    third = F.transform("features", lambda x: x / 3)
    return _emb(spark, sf).select("vec_id", F.size("features").alias("dim"), _micro(
        S.to_float_array(third).cast("array<double>")).alias("micro"))


def q_shipped_file(spark, sf):
    """Customers per nation, the names looked up in a file shipped to every
    worker (one row per nation, a bounded table)."""
    import uuid

    from tessera.sources import fs
    folder = shared_dir(spark, "shipped")
    fs.ensure_dir(folder)
    name = f"nations-{uuid.uuid4().hex}.csv"
    with fs.atomic_output(fs.join(folder, name)) as out:
        for r in table(spark, sf, "nation").select("n_nationkey", "n_name").collect():
            out.write(f"{r.n_nationkey},{r.n_name}\n".encode())
    spark.sparkContext.addFile(fs.join(folder, name))

    def look_up(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import SparkFiles
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            rows = [line.rstrip("\n").split(",", 1) for line in f]
        keys, names = pa.array([int(k) for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.string())
        for b in batches:
            at = pc.index_in(b.column("c_nationkey").cast(pa.int64()), keys)
            yield pa.RecordBatch.from_arrays([pc.take(names, at)], names=["nation"])
    cust = table(spark, sf, "customer").select("c_nationkey").mapInArrow(look_up, "nation string")
    return cust.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- partitions / gang / UDF forms

def q_repartition_counts(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey")
    n_in = li.rdd.getNumPartitions()
    n = max(5, -(-li.count() // ROWS_PER_SLICE))          # partitions grow with the table
    counts = P.partition_counts(P.repartition_n(li, n))
    return counts.agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_parts"),
                      ((F.max("n_rows") - F.min("n_rows")) <= n_in).alias("balanced"))


def q_strided_partials(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return ev.groupBy(P.rank_of("event_id", WORLD).alias("rank")).agg(
        F.count(F.lit(1)).alias("n"), _r(F.sum("value"), 4).alias("total"))


def q_gang_sum(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return G.gang_sum(li, "l_linenumber", _world(spark), key="l_orderkey")


def q_gang_pi(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    pts = li.select("l_orderkey", *[c.alias(n) for c, n in zip(_lattice_xy(), ("x", "y"))])
    inside = A.inside_unit_circle(F.col("x"), F.col("y"))
    return G.gang_count_report(pts, inside, _world(spark), key="l_orderkey")


def q_gang_vector_mean(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    out = G.gang_vector_mean(emb, "features", DIM, _world(spark))
    return out.select("pos", _r("mean", 6).alias("mean"))


def q_block_reduce_mean(spark, sf):
    emb = table(spark, sf, "embeddings").select(F.col("embedding").alias("features"))
    out = G.block_reduce(emb, "features", DIM, block=10)
    return out.select("pos", _r(F.col("total") / F.col("n"), 6).alias("mean"))


def q_gang_members(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey")
    return G.gang_members(li, _world(spark), key="l_orderkey")


def q_udf_two_columns(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    return U.udf_two_columns(ev, "event_type", "user_id", P.rank_of("event_id", WORLD), keep=("event_id",))


def _purchases(pdf):
    p = pdf[pdf["event_type"] == "purchase"]
    return p.assign(value_cents=(p["value"] * 100).round().astype("int64"))[
        ["event_id", "user_id", "value_cents"]]


def q_map_partitions(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return U.map_partitions(ev, _purchases, "event_id long, user_id long, value_cents long")


def q_arrow_passthrough(spark, sf):
    out = U.arrow_passthrough(_emb(spark, sf))
    return out.select("vec_id", F.col("label").cast("int").alias("label"),
                      F.size("features").alias("dim"), _micro(F.col("features")).alias("micro"))


def q_pipe_sum(spark, sf):
    return U.pipe_sum(table(spark, sf, "lineitem"), "l_linenumber").select("total")


FAILING = """awk -v r="$RANK" '{s += $1} END {if (r == 2) {print "rank " r " gives up" > "/dev/stderr"; exit 3} printf "%.0f\\n", s}'"""


def q_pipe_failure(spark, sf):
    """How a program ended on each rank when it fails on one of them."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    got = U.pipe_report(li, "l_linenumber", FAILING, RANKS, "l_orderkey")
    return got.select("rank", "exit_code", "n_lines", F.expr("try_cast(trim(output) as bigint)").alias("partial"),
                      F.trim(F.regexp_replace("error", "\n", "")).alias("error"))


def q_arrow_switch(spark, sf):
    """A bounded result collected with the Arrow switch on and off."""
    per = table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))
    rows = [(arrow, r.event_type, int(r.n), int(r.users)) for arrow in (True, False)
            for r in U.to_pandas(per, arrow=arrow, limit=1000).itertuples()]
    return spark.createDataFrame(rows, "arrow boolean, event_type string, n long, users long")


def q_stream_score(spark, sf):
    from tessera.streaming import score_stream
    return score_stream(spark, sf, "embeddings", _fixture_model()) \
        .select("vec_id", "label", "prediction")


QUERIES = {
    # sources and sinks
    "scan_parquet": q_scan_parquet,
    "scan_libsvm": q_scan_libsvm,
    "int_range": q_int_range,
    "scan_int_text": q_scan_int_text,
    "write_text": q_write_text,
    "export_feature_files": q_export_feature_files,
    "scan_feature_text": q_scan_feature_text,
    "export_arrow": q_export_arrow,
    "scan_arrow": q_scan_arrow,
    "scan_arrow_source": q_scan_arrow_source,
    "arrow_sink": q_arrow_sink,
    "packed_objects": q_packed_objects,
    "list_files": q_list_files,
    "read_whole_text": q_read_whole_text,
    "read_whole_text_files": q_read_whole_text_files,
    "read_binary": q_read_binary,
    "write_binary": q_write_binary,
    "synth_vectors": q_synth_vectors,
    "model_roundtrip": q_model_roundtrip,
    "top_predictions": q_top_predictions,
    # projections and filters
    "partition_zero": q_partition_zero,
    "pi_lattice": q_pi_lattice,
    "pi_monte_carlo": q_pi_monte_carlo,
    # aggregates
    "global_sum": q_global_sum,
    "partial_sums": q_partial_sums,
    "report_row": q_report_row,
    "report_observed": q_report_observed,
    "accuracy": q_accuracy,
    "mean_cross_entropy": q_mean_cross_entropy,
    "vector_mean": q_vector_mean,
    "vector_mean_wide": q_vector_mean_wide,
    "minibatch_assign": q_minibatch_assign,
    "minibatch_epochs": q_minibatch_epochs,
    # scalar functions
    "base64_encode": q_base64_encode,
    "base64_decode": q_base64_decode,
    "list_join": q_list_join,
    "split_trim": q_split_trim,
    "split_first": q_split_first,
    "array_index_of": q_array_index_of,
    "map_first": q_map_first,
    "map_join": q_map_join,
    "random_name": q_random_name,
    "feature_csv": q_feature_csv,
    "flatten_vectors": q_flatten_vectors,
    # model operators
    "score_softmax": q_score_softmax,
    "one_hot": q_one_hot,
    "argmax_class": q_argmax_class,
    "relu": q_relu,
    "dense_layer": q_dense_layer,
    "conv2d": q_conv2d,
    "max_pool": q_max_pool,
    "gradient_step": q_gradient_step,
    "gradient_step_fixture": q_gradient_step_fixture,
    # training and scoring
    "score_table": q_score_table,
    "score_convnet": q_score_convnet,
    "score_table_pandas": q_score_table_pandas,
    "score_map_in_pandas": q_score_map_in_pandas,
    "train_model": q_train_model,
    "train_history": q_train_history,
    "train_convnet": q_train_convnet,
    "train_coverage": q_train_coverage,
    "train_exact": q_train_exact,
    "train_resume": q_train_resume,
    "train_log": q_train_log,
    "predict_record": q_predict_record,
    "dropout": q_dropout,
    "float_arrays": q_float_arrays,
    "shipped_file": q_shipped_file,
    # partitioning, gang, UDF forms
    "repartition_counts": q_repartition_counts,
    "strided_partials": q_strided_partials,
    "gang_sum": q_gang_sum,
    "gang_members": q_gang_members,
    "gang_pi": q_gang_pi,
    "gang_vector_mean": q_gang_vector_mean,
    "block_reduce_mean": q_block_reduce_mean,
    "udf_two_columns": q_udf_two_columns,
    "map_partitions": q_map_partitions,
    "arrow_passthrough": q_arrow_passthrough,
    "pipe_sum": q_pipe_sum,
    "pipe_failure": q_pipe_failure,
    "arrow_switch": q_arrow_switch,
    "stream_score": q_stream_score,
}
