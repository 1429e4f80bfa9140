"""DuckDB SQL with the same answer as each registered query, on the same
Parquet tables.  Model queries use the closed-form fixture weights
``w[k][j] = ((7k + 3j) % 11 - 5) / 10`` in relational form (pixels joined to
weights, summed by row and unit)."""

from __future__ import annotations

EMB = "emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)"
PX = "px AS (SELECT vec_id, label, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS j FROM emb)"
WTS = ("w AS (SELECT i // 64 AS k, i % 64 AS j, ((7 * (i // 64) + 3 * (i % 64)) % 11 - 5) / 10.0 AS w "
       "FROM (SELECT unnest(range(640)) AS i))")
Z = "z AS (SELECT px.vec_id, px.label, w.k, sum(px.x * w.w) AS z FROM px JOIN w ON px.j = w.j GROUP BY 1, 2, 3)"
ZM = "zm AS (SELECT vec_id, label, max(z) AS m FROM z GROUP BY 1, 2)"
LOGITS = f"WITH {EMB}, {PX}, {WTS}, {Z}, {ZM}"
PRED = ("pred AS (SELECT vec_id, label, CAST(arg_max(k, z) AS DOUBLE) AS prediction "
        "FROM z GROUP BY 1, 2)")
MICRO = "CAST(list_sum(list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1e6))) AS BIGINT)"
VEC_SUMMARY = (f"SELECT label, CAST(len(embedding) AS INTEGER) AS dim, {MICRO} AS micro "
               "FROM embeddings")
SCORES = f"{LOGITS}, {PRED} SELECT vec_id, label, prediction FROM pred"
LATTICE = ("pts AS (SELECT (CAST((l_orderkey * 7919 + l_linenumber * 104729) % 1000 AS DOUBLE) + 0.5) / 1000.0 AS x, "
           "(CAST((l_orderkey * 104729 + l_linenumber * 7919) % 1000 AS DOUBLE) + 0.5) / 1000.0 AS y FROM lineitem)")
PARTIALS = ("SELECT CAST(l_orderkey % 4 AS INTEGER) AS rank, count(*) AS n, "
            "CAST(sum(l_linenumber) AS BIGINT) AS partial FROM lineitem GROUP BY 1")
CE = ("ce AS (SELECT z.vec_id, z.label, ln(sum(exp(z.z - zm.m))) + zm.m "
      "- max(CASE WHEN z.k = z.label THEN z.z END) AS ce FROM z JOIN zm ON z.vec_id = zm.vec_id "
      "GROUP BY z.vec_id, z.label, zm.m)")

# The fixture two-convolution network, one row at a time with list lambdas.
# Flat index layouts are row-major, channel last: (r * W + c) * C + ch.
_FIX = "(((7 * ({k}) + 3 * ({j})) % 11 - 5) / 10.0)"           # w[k][j]
CONVNET = (
    f"WITH {EMB}, "
    # conv1: 8x8x1 -> 8x8x4, ReLU; q = (r * 8 + c) * 4 + f, o = dy * 5 + dx
    "c1 AS (SELECT vec_id, label, list_transform(range(256), lambda q: greatest(list_sum("
    "list_transform(range(25), lambda o: CASE WHEN (q // 32) + (o // 5) - 2 BETWEEN 0 AND 7 "
    "AND ((q // 4) % 8) + (o % 5) - 2 BETWEEN 0 AND 7 "
    "THEN f[((q // 32) + (o // 5) - 2) * 8 + ((q // 4) % 8) + (o % 5) - 2 + 1] * "
    + _FIX.format(k="q % 4", j="o") + " ELSE 0.0 END)), 0.0)) AS a FROM emb), "
    # pool1: 8x8x4 -> 4x4x4; q = (r * 4 + c) * 4 + ch
    "p1 AS (SELECT vec_id, label, list_transform(range(64), lambda q: greatest("
    "a[((2 * (q // 16)) * 8 + 2 * ((q // 4) % 4)) * 4 + q % 4 + 1], "
    "a[((2 * (q // 16)) * 8 + 2 * ((q // 4) % 4) + 1) * 4 + q % 4 + 1], "
    "a[((2 * (q // 16) + 1) * 8 + 2 * ((q // 4) % 4)) * 4 + q % 4 + 1], "
    "a[((2 * (q // 16) + 1) * 8 + 2 * ((q // 4) % 4) + 1) * 4 + q % 4 + 1])) AS a FROM c1), "
    # conv2: 4x4x4 -> 4x4x8, ReLU; q = (r * 4 + c) * 8 + f, t = (dy * 5 + dx) * 4 + ci
    "c2 AS (SELECT vec_id, label, list_transform(range(128), lambda q: greatest(list_sum("
    "list_transform(range(100), lambda t: CASE WHEN (q // 32) + ((t // 4) // 5) - 2 BETWEEN 0 AND 3 "
    "AND ((q // 8) % 4) + ((t // 4) % 5) - 2 BETWEEN 0 AND 3 "
    "THEN a[(((q // 32) + ((t // 4) // 5) - 2) * 4 + ((q // 8) % 4) + ((t // 4) % 5) - 2) * 4 + t % 4 + 1] * "
    + _FIX.format(k="q % 8", j="t") + " ELSE 0.0 END)), 0.0)) AS a FROM p1), "
    # pool2: 4x4x8 -> 2x2x8 = 32 features; q = (r * 2 + c) * 8 + ch
    "p2 AS (SELECT vec_id, label, list_transform(range(32), lambda q: greatest("
    "a[((2 * (q // 16)) * 4 + 2 * ((q // 8) % 2)) * 8 + q % 8 + 1], "
    "a[((2 * (q // 16)) * 4 + 2 * ((q // 8) % 2) + 1) * 8 + q % 8 + 1], "
    "a[((2 * (q // 16) + 1) * 4 + 2 * ((q // 8) % 2)) * 8 + q % 8 + 1], "
    "a[((2 * (q // 16) + 1) * 4 + 2 * ((q // 8) % 2) + 1) * 8 + q % 8 + 1])) AS a FROM c2), "
    # dense 32 -> 16, ReLU; then logits 16 -> 10
    "h AS (SELECT vec_id, label, list_transform(range(16), lambda u: greatest(list_sum("
    "list_transform(range(32), lambda i: a[i + 1] * " + _FIX.format(k="u", j="i") + ")), 0.0)) AS a FROM p2), "
    "z AS (SELECT vec_id, label, list_transform(range(10), lambda k: list_sum("
    "list_transform(range(16), lambda u: a[u + 1] * " + _FIX.format(k="k", j="u") + "))) AS z FROM h) "
    "SELECT vec_id, label, CAST(list_position(z, list_max(z)) - 1 AS DOUBLE) AS prediction FROM z"
)

# A number in [0, 1) from the first 48 bits of a text's md5.
UNIT = "('0x' || substr(md5({t}), 1, 12))::BIGINT::DOUBLE / 281474976710656.0"

# The keyed permutation of row numbers, round by round, for three epochs (see partitions.permuted):
# i counts rounds; after every sixth the number is l * b + r, and one of n or more goes through again.
MINIBATCHES = """
WITH RECURSIVE n AS (
  SELECT count(*)::BIGINT AS n, ceil(sqrt(count(*)))::BIGINT AS a, ceil(count(*) / ceil(sqrt(count(*))))::BIGINT AS b
  FROM embeddings),
e AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS x FROM embeddings),
w AS (
  SELECT vec_id, epoch, (11 * 1000003 + epoch * 7919) % 2147483647 AS key, x // b AS l, x % b AS r, 0 AS i
  FROM e, n, (SELECT unnest([0, 1, 2])::BIGINT AS epoch)
  UNION ALL
  SELECT vec_id, epoch, key, CASE WHEN i % 2 = 0 THEN (l + (t * t + r) % 2147483647) % a ELSE l END,
    CASE WHEN i % 2 = 1 THEN (r + (t * t + l) % 2147483647) % b ELSE r END, i + 1
  FROM (SELECT *, (CASE WHEN i % 2 = 0 THEN r ELSE l END * 48271 + key + (i % 6) * 16807) % 2147483647 AS t FROM w), n
  WHERE i % 6 <> 0 OR i = 0 OR l * b + r >= n)
SELECT vec_id, epoch::INTEGER AS epoch, ((l * b + r) // 100)::BIGINT AS batch_id
FROM w, n WHERE i > 0 AND i % 6 = 0 AND l * b + r < n
"""


def _steps(n: int) -> str:
    """Tables w0, p0, w1 ... of n momentum steps of softmax regression on the
    whole table, from zero weights, for one and two ranks (lr times ranks); the
    bias is the weight of a 65th input that is 1."""
    out = [EMB, "x AS (SELECT vec_id, label, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS j FROM emb "
                "UNION ALL SELECT vec_id, label, 1.0, 64 FROM emb)",
           "w0 AS (SELECT world, (i // 65)::INTEGER AS k, (i % 65)::INTEGER AS j, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v "
           "FROM (SELECT unnest(range(650)) AS i), (VALUES (1), (2)) t(world))"]
    for t in range(n):
        out += [f"z{t} AS (SELECT w.world, x.vec_id, x.label, w.k, sum(x.x * w.w) AS z FROM x JOIN w{t} w ON x.j = w.j GROUP BY ALL)",
                f"p{t} AS (SELECT world, vec_id, label, k, e / sum(e) OVER (PARTITION BY world, vec_id) AS p FROM (SELECT *, "
                f"exp(z - max(z) OVER (PARTITION BY world, vec_id)) AS e FROM z{t}))",
                f"g{t} AS (SELECT p.world, p.k, x.j, sum((p.p - CASE WHEN p.k = p.label THEN 1 ELSE 0 END) * x.x) "
                f"/ (SELECT count(*) FROM emb) AS g FROM p{t} p JOIN x ON p.vec_id = x.vec_id GROUP BY ALL)",
                f"w{t + 1} AS (SELECT w.world, w.k, w.j, w.w - 0.05::DOUBLE * w.world * (0.9::DOUBLE * w.v + g.g) AS w, "
                f"0.9::DOUBLE * w.v + g.g AS v FROM w{t} w JOIN g{t} g ON w.world = g.world AND w.k = g.k AND w.j = g.j)"]
    return "WITH " + ", ".join(out)


def _params(n: int) -> str:
    return (f"SELECT world, CASE WHEN j = 64 THEN 'b' ELSE 'W' END AS param, k, CASE WHEN j = 64 THEN 0 ELSE j END AS j, "
            f"w AS value FROM w{n}")


ORACLE_SQL: dict[str, str] = {
    # sources and sinks
    "scan_parquet": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem",
    "scan_libsvm": VEC_SUMMARY,
    "int_range": (
        "WITH k AS (SELECT min(l_orderkey) AS a, max(l_orderkey) AS b FROM lineitem), "
        "c AS (SELECT a, b - a + 1 AS cnt, greatest(4, CAST(ceil((b - a + 1) / 5000000.0) AS BIGINT)) AS s FROM k), "
        "r AS (SELECT unnest(range(cnt)) AS i, a, cnt, s FROM c), "
        "ids AS (SELECT CAST(((i + 1) * s - 1) // cnt AS INTEGER) AS slice, min(i + a) AS lo, max(i + a) AS hi, "
        "count(*) AS n, CAST(sum(i + a) AS BIGINT) AS total FROM r GROUP BY 1), "
        "li AS (SELECT CAST(((l_orderkey - a + 1) * s - 1) // cnt AS INTEGER) AS slice, count(*) AS n_rows, "
        "CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem, c GROUP BY 1) "
        "SELECT ids.*, coalesce(n_rows, 0) AS n_rows, coalesce(quantity, 0) AS quantity "
        "FROM ids LEFT JOIN li ON ids.slice = li.slice"),
    "scan_int_text": ("SELECT count(*) AS n_values, CAST(0 AS BIGINT) AS n_bad, "
                      "CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem"),
    "write_text": "SELECT count(*) AS n_lines, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem",
    "export_feature_files": "SELECT count(*) AS n_rows FROM embeddings",
    "scan_feature_text": VEC_SUMMARY,
    "export_arrow": "SELECT count(*) AS n_rows FROM embeddings",
    "scan_arrow": (f"SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim, {MICRO} AS micro "
                   "FROM embeddings"),
    "scan_arrow_source": "SELECT label, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings GROUP BY label",
    "arrow_sink": (f"SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim, {MICRO} AS micro "
                   "FROM embeddings"),
    "packed_objects": ("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, "
                       "sha256(html) AS digest FROM pages"),
    "list_files": ("SELECT md5(lang) AS lang_md5, md5(source) AS source_md5, "
                   "CAST(CASE WHEN count(*) % 2 = 0 THEN count(*) ELSE 0 END AS BIGINT) AS length "
                   "FROM documents GROUP BY lang, source"),
    "read_whole_text": (
        "WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents), "
        "m AS (SELECT lang, sum(('0x' || substr(md5(line), 1, 7))::BIGINT) AS line_sum FROM l WHERE line <> '' GROUP BY lang) "
        "SELECT d.lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, CAST(any_value(m.line_sum) AS BIGINT) AS line_sum "
        "FROM documents d JOIN m ON d.lang = m.lang GROUP BY d.lang"),
    "read_whole_text_files": (
        "SELECT event_type, CASE WHEN event_type = 'purchase' THEN '' ELSE event_type || chr(10) || count(*) END AS value "
        "FROM events GROUP BY event_type"),
    "read_binary": ("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, "
                    "sha256(html) AS digest FROM pages"),
    "write_binary": "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes FROM pages",
    "synth_vectors": ("SELECT vec_id, 784 AS dim, true AS all_in_unit, true AS all_differ, true AS label_in_unit "
                      "FROM embeddings"),
    "model_roundtrip": f"{LOGITS}, {PRED} SELECT vec_id, prediction FROM pred",
    "top_predictions": f"{SCORES} ORDER BY vec_id LIMIT 10",
    # projections and filters
    "partition_zero": ("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total "
                       "FROM lineitem WHERE l_orderkey % 4 = 0"),
    "pi_lattice": (
        f"WITH {LATTICE} SELECT count(*) AS n, count(*) FILTER (WHERE x * x + y * y < 1.0) AS hits, "
        "round(4.0::DOUBLE * count(*) FILTER (WHERE x * x + y * y < 1.0) / count(*), 6) + 0.0 AS pi "
        "FROM pts"),
    "pi_monte_carlo": (
        f"WITH p AS (SELECT {UNIT.format(t='l_orderkey || chr(58) || l_linenumber || chr(58) || 7 || chr(58) || chr(120)')} AS x, "
        f"{UNIT.format(t='l_orderkey || chr(58) || l_linenumber || chr(58) || 7 || chr(58) || chr(121)')} AS y FROM lineitem), "
        "c AS (SELECT count(*) AS n, count(*) FILTER (WHERE x * x + y * y < 1.0) AS hits FROM p) "
        "SELECT n, hits, round(4.0::DOUBLE * hits / n, 6) + 0.0 AS pi, "
        "abs(4.0::DOUBLE * hits / n - pi()) < 4.0 * 4.0 * sqrt((pi() / 4) * (1 - pi() / 4)) / sqrt(n) AS within_4sd FROM c"),
    # aggregates
    "global_sum": "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem",
    "partial_sums": PARTIALS,
    "report_row": (f"SELECT printf('np=%2d;    sum=%d', count(*), CAST(sum(partial) AS BIGINT)) AS report "
                   f"FROM ({PARTIALS})"),
    "report_observed": ("SELECT printf('np=%2d;    sum=%d', count(DISTINCT l_orderkey % 4), CAST(sum(l_linenumber) AS BIGINT)) "
                        "AS report, CAST(sum(l_linenumber) AS BIGINT) AS total, true AS timed FROM lineitem"),
    "accuracy": (
        f"{LOGITS}, {PRED}, {CE} SELECT count(*) AS n, "
        "round(avg(CASE WHEN pred.prediction = pred.label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy, "
        "round(avg(ce.ce), 6) + 0.0 AS mean_ce FROM pred JOIN ce ON pred.vec_id = ce.vec_id"),
    "mean_cross_entropy": f"{LOGITS}, {CE} SELECT round(avg(ce), 6) + 0.0 AS mean_ce FROM ce",
    "vector_mean": (f"WITH {EMB}, {PX} SELECT label, CAST(j AS INTEGER) AS pos, "
                    "round(avg(x), 6) + 0.0 AS mean FROM px GROUP BY 1, 2"),
    "vector_mean_wide": (f"WITH {EMB}, {PX} SELECT label, CAST(j AS INTEGER) AS pos, "
                         "round(avg(x), 6) + 0.0 AS mean FROM px GROUP BY 1, 2"),
    "minibatch_epochs": MINIBATCHES,
    "minibatch_assign": (
        "WITH c AS (SELECT count(*) AS cnt FROM embeddings) "
        "SELECT CAST(ceil(cnt / 100.0) AS BIGINT) AS n_batches, CAST(cnt // 100 AS BIGINT) AS n_full, "
        "CAST(CASE WHEN cnt % 100 = 0 THEN 100 ELSE cnt % 100 END AS BIGINT) AS min_rows, "
        "cnt AS n_rows FROM c"),
    # scalar functions
    "base64_encode": ("SELECT doc_id, CAST(length(to_base64(encode(text))) AS INTEGER) AS enc_len, "
                      "md5(to_base64(encode(text))) AS enc_md5 FROM documents"),
    "base64_decode": ("SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes, "
                      "true AS roundtrip FROM documents"),
    "list_join": ("SELECT event_id, event_type || ',' || coalesce(CASE WHEN value >= 50 "
                  "THEN CAST(user_id AS VARCHAR) END, 'null') || ',' || props AS joined FROM events"),
    "split_trim": (
        # JVM semantics: trim chars <= U+0020, drop trailing empty parts, trim parts
        "WITH t AS (SELECT doc_id, regexp_replace(concat_ws(' , ', lang, source), "
        "'^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS t FROM documents), "
        "s AS (SELECT doc_id, t, regexp_replace(t, '(?:,)+$', '') AS st FROM t), "
        "p AS (SELECT doc_id, CASE WHEN st = '' AND t <> '' THEN []::VARCHAR[] ELSE string_split(st, ',') END "
        "AS parts FROM s) "
        "SELECT doc_id, array_to_string(list_transform(parts, lambda x: regexp_replace(x, "
        "'^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')), '|') AS parts, "
        "CAST(len(parts) AS INTEGER) AS n_parts FROM p"),
    "split_first": ("SELECT page_id, split_part(split_part(split_part(url, '://', 2), '/', 1) "
                    "|| ':8080', ':', 1) AS host FROM pages"),
    "array_index_of": ("SELECT doc_id, CAST(coalesce(list_position(string_split(text, ' '), 'the'), 0) - 1 "
                       "AS INTEGER) AS idx FROM documents"),
    "map_first": ("SELECT doc_id, CASE WHEN lang = 'en' THEN string_split(text, chr(10))[1] END "
                  "AS first_line FROM documents"),
    "map_join": ("SELECT doc_id, md5(CASE WHEN lang = 'fr' THEN replace(text, chr(10), ' / ') END) "
                 "AS joined_md5 FROM documents"),
    "random_name": "SELECT doc_id, true AS ok FROM documents",
    "feature_csv": (f"SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n_fields, true AS roundtrip, "
                    f"{MICRO} AS micro FROM embeddings"),
    "flatten_vectors": (f"WITH {EMB} SELECT vec_id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos, "
                        "unnest(f) AS v FROM emb"),
    # model operators
    "score_softmax": (
        f"{LOGITS} SELECT z.vec_id, "
        "round(max(CASE WHEN z.k = z.label THEN exp(z.z - zm.m) END) / sum(exp(z.z - zm.m)), 6) + 0.0 AS p_label, "
        "round(1.0 / sum(exp(z.z - zm.m)), 6) + 0.0 AS p_max "
        "FROM z JOIN zm ON z.vec_id = zm.vec_id GROUP BY z.vec_id"),
    "one_hot": ("SELECT vec_id, array_to_string(list_transform(range(10), "
                "lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), ',') AS one_hot FROM embeddings"),
    "argmax_class": f"{LOGITS} SELECT vec_id, CAST(arg_max(k, z) AS INTEGER) AS class FROM z GROUP BY 1",
    "relu": (f"{LOGITS} SELECT vec_id, CAST(count(*) FILTER (WHERE z > 0) AS INTEGER) AS n_pos, "
             "round(sum(greatest(z, 0.0)), 6) + 0.0 AS relu_sum FROM z GROUP BY 1"),
    "dense_layer": (
        f"WITH {EMB}, {PX}, "
        "dw AS (SELECT i // 64 AS u, i % 64 AS j, ((7 * (i // 64) + 3 * (i % 64)) % 11 - 5) / 10.0 AS w "
        "FROM (SELECT unnest(range(1024)) AS i)) "
        "SELECT px.vec_id, CAST(dw.u AS INTEGER) AS unit, round(greatest(sum(px.x * dw.w), 0.0), 6) + 0.0 AS value "
        "FROM px JOIN dw ON px.j = dw.j GROUP BY 1, 2"),
    "conv2d": (
        # Per row: output cell q = (r * 8 + c) * 4 + filter, summing the 5x5
        # offsets o = dy * 5 + dx whose input pixel lies inside the image.
        f"WITH {EMB}, conv AS (SELECT vec_id, list_transform(range(256), lambda q: greatest(list_sum("
        "list_transform(range(25), lambda o: CASE WHEN (q // 32) + (o // 5) - 2 BETWEEN 0 AND 7 "
        "AND ((q // 4) % 8) + (o % 5) - 2 BETWEEN 0 AND 7 "
        "THEN f[((q // 32) + (o // 5) - 2) * 8 + ((q // 4) % 8) + (o % 5) - 2 + 1] "
        "* (((7 * (q % 4) + 3 * o) % 11 - 5) / 10.0) ELSE 0.0 END)), 0.0)) AS a FROM emb), "
        "cells AS (SELECT vec_id, unnest(a) AS v, generate_subscripts(a, 1) - 1 AS q FROM conv) "
        "SELECT vec_id, CAST(q % 4 AS INTEGER) AS filter, round(sum(v), 6) + 0.0 AS act_sum, "
        "round(max(v), 6) + 0.0 AS act_max FROM cells GROUP BY 1, 2"),
    "max_pool": (f"WITH {EMB}, {PX} SELECT vec_id, CAST(((j // 8) // 2) * 4 + (j % 8) // 2 AS INTEGER) AS cell, "
                 "max(x) AS value FROM px GROUP BY 1, 2"),
    "gradient_step": (
        # From zero weights every class has probability 0.1, so the mean
        # gradient is (0.1 * sum(x_j) - sum of x_j over rows of class k) / n.
        f"WITH {EMB}, {PX}, n AS (SELECT count(*) AS cnt FROM emb), "
        "s AS (SELECT j, sum(x) AS sx FROM px GROUP BY j), "
        "t AS (SELECT label AS k, j, sum(x) AS tx FROM px GROUP BY label, j), "
        "c AS (SELECT label AS k, count(*) AS ck FROM emb GROUP BY label) "
        "SELECT 'W' AS param, CAST(t.k AS INTEGER) AS k, CAST(t.j AS INTEGER) AS j, "
        "round((0.1 * s.sx - t.tx) / (SELECT cnt FROM n), 9) + 0.0 AS grad FROM t JOIN s ON t.j = s.j "
        "UNION ALL "
        "SELECT 'b' AS param, CAST(k AS INTEGER) AS k, 0 AS j, "
        "round((0.1 * (SELECT cnt FROM n) - ck) / (SELECT cnt FROM n), 9) + 0.0 AS grad FROM c"),
    "gradient_step_fixture": (
        f"{LOGITS}, p AS (SELECT z.vec_id, z.label, z.k, exp(z.z - zm.m) / "
        "sum(exp(z.z - zm.m)) OVER (PARTITION BY z.vec_id) AS p FROM z JOIN zm ON z.vec_id = zm.vec_id), "
        "r AS (SELECT vec_id, k, p - CASE WHEN k = label THEN 1 ELSE 0 END AS r FROM p), "
        "n AS (SELECT count(*) AS cnt FROM emb) "
        "SELECT 'W' AS param, CAST(r.k AS INTEGER) AS k, CAST(px.j AS INTEGER) AS j, "
        "round(sum(r.r * px.x) / (SELECT cnt FROM n), 9) + 0.0 AS grad "
        "FROM r JOIN px ON r.vec_id = px.vec_id GROUP BY r.k, px.j "
        "UNION ALL "
        "SELECT 'b' AS param, CAST(k AS INTEGER) AS k, 0 AS j, "
        "round(sum(r) / (SELECT cnt FROM n), 9) + 0.0 AS grad FROM r GROUP BY k"),
    # training and scoring
    "score_table": SCORES,
    "score_convnet": CONVNET,
    "score_table_pandas": SCORES,
    "score_map_in_pandas": SCORES,
    "train_model": "SELECT 650 AS n_params, true AS beats_majority",
    "train_convnet": "SELECT 2298 AS n_params, true AS beats_majority",
    "train_history": "SELECT CAST(unnest([0, 5, 10, 15, 19]) AS INTEGER) AS step, true AS loss_ok",
    "train_coverage": ("SELECT CAST(e AS INTEGER) AS epoch, count(*) AS n_rows, CAST(sum(vec_id) AS BIGINT) AS key_sum, "
                       "true AS several_rounds FROM embeddings, range(3) AS r(e) GROUP BY e"),
    "train_exact": f"{_steps(3)} SELECT param, k, j, round(value, 9) + 0.0 AS value, world FROM ({_params(3)})",
    "train_resume": (f"{_steps(3)} SELECT param, k, j, round(value, 9) + 0.0 AS value, 1 AS resumed_from, 3 AS rounds "
                     f"FROM ({_params(3)}) WHERE world = 2"),
    "train_log": (f"{_steps(3)} " + " UNION ALL ".join(
        f"SELECT {t} AS step, vec_id, k AS class, round(p, 9) + 0.0 AS p FROM p{t} WHERE world = 1" for t in range(3))),
    "predict_record": (
        f"{LOGITS}, {PRED}, s AS (SELECT z.vec_id, 1.0 / sum(exp(z.z - zm.m)) AS p FROM z JOIN zm ON z.vec_id = zm.vec_id "
        "GROUP BY z.vec_id) SELECT pred.vec_id, CAST(prediction AS INTEGER) AS class, round(p, 6) + 0.0 AS p_max, "
        "10 AS n_classes FROM pred JOIN s ON pred.vec_id = s.vec_id"),
    "dropout": (
        f"WITH {EMB}, d AS (SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN "
        f"{UNIT.format(t='vec_id || chr(58) || i || chr(58) || 0')} < 0.6::DOUBLE THEN f[i + 1] / 0.6::DOUBLE ELSE 0.0 END) AS d "
        "FROM emb) SELECT vec_id, CAST(len(list_filter(d, lambda x: x <> 0)) AS INTEGER) AS n_kept, "
        "CAST(list_sum(list_transform(d, lambda x: floor(x * 1e6))) AS BIGINT) AS micro FROM d"),
    "float_arrays": (
        f"WITH {EMB} SELECT vec_id, CAST(len(f) AS INTEGER) AS dim, CAST(list_sum(list_transform(f, "
        "lambda x: floor(CAST(CAST(x / 3 AS FLOAT) AS DOUBLE) * 1e6))) AS BIGINT) AS micro FROM emb"),
    "shipped_file": ("SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey "
                     "GROUP BY n_name"),
    # partitioning, gang, UDF forms
    "repartition_counts": ("SELECT count(*) AS n_rows, greatest(5, CAST(ceil(count(*) / 5000000.0) AS BIGINT)) "
                           "AS n_parts, true AS balanced FROM lineitem"),
    "strided_partials": ("SELECT CAST(event_id % 3 AS INTEGER) AS rank, count(*) AS n, "
                         "round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1"),
    "gang_sum": "SELECT 3 AS world, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem",
    "gang_pi": (f"WITH {LATTICE}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE x * x + y * y < 1.0) AS hits FROM pts) "
                "SELECT n, hits, printf('np=%2d;    PI=%.4f', 3, 4.0::DOUBLE * hits / n) AS report FROM c"),
    "block_reduce_mean": (f"WITH {EMB}, {PX} SELECT CAST(j AS INTEGER) AS pos, "
                          "round(avg(x), 6) + 0.0 AS mean FROM px GROUP BY 1"),
    "gang_vector_mean": (f"WITH {EMB}, {PX} SELECT CAST(j AS INTEGER) AS pos, "
                         "round(avg(x), 6) + 0.0 AS mean FROM px GROUP BY 1"),
    "gang_members": ("SELECT CAST(l_orderkey % 3 AS INTEGER) AS rank, 3 AS world, count(*) AS n_rows, "
                     "true AS peers_known FROM lineitem GROUP BY 1"),
    "udf_two_columns": ("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ':' || "
                        "CAST(user_id AS VARCHAR) END AS result FROM events"),
    "map_partitions": ("SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS value_cents "
                       "FROM events WHERE event_type = 'purchase'"),
    "arrow_passthrough": (f"SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim, {MICRO} AS micro "
                          "FROM embeddings"),
    "pipe_sum": "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem",
    "pipe_failure": (
        "SELECT CAST(l_orderkey % 4 AS INTEGER) AS rank, CASE WHEN l_orderkey % 4 = 2 THEN 3 ELSE 0 END AS exit_code, "
        "CAST(CASE WHEN l_orderkey % 4 = 2 THEN 0 ELSE 1 END AS BIGINT) AS n_lines, "
        "CASE WHEN l_orderkey % 4 <> 2 THEN CAST(sum(l_linenumber) AS BIGINT) END AS partial, "
        "CASE WHEN l_orderkey % 4 = 2 THEN 'rank 2 gives up' ELSE '' END AS error FROM lineitem GROUP BY l_orderkey % 4"),
    "arrow_switch": ("SELECT a AS arrow, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users "
                     "FROM events, (VALUES (true), (false)) v(a) GROUP BY 1, 2"),
    "stream_score": SCORES,
}
