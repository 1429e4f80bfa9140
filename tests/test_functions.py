"""Scalar and tensor function semantics (nulls, ties, errors)."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import tensor as T


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_list_join_prints_null(spark):
    assert one(spark, S.list_join(F.array(F.lit("a"), F.lit(None).cast("string"), F.lit("b")), ",")) == "a,null,b"


@pytest.mark.parametrize("text,sep,want", [
    (" a , b,c ", ",", ["a", "b", "c"]),
    ("a,b,,", ",", ["a", "b"]),            # trailing empty parts dropped
    ("a, ,", ",", ["a", ""]),              # dropped before the parts are trimmed
    (",,", ",", []),
    ("", ",", [""]),
    ("\thadoop0,\nhadoop1 ,hadoop2\r\n", ",", ["hadoop0", "hadoop1", "hadoop2"]),
    ("x::y::", "::", ["x", "y"]),
])
def test_split_trim_jvm_semantics(spark, text, sep, want):
    assert one(spark, S.split_trim(F.lit(text), sep)) == want


def test_split_trim_and_first(spark):
    assert one(spark, S.split_trim(F.lit(" a , b,c "), ",")) == ["a", "b", "c"]
    assert one(spark, S.split_trim(F.lit("x.y"), ".")) == ["x", "y"]      # literal, not regex
    assert one(spark, S.split_first(F.lit("host1:8080"), ":")) == "host1"
    assert one(spark, S.split_first(F.lit("host1"), ":")) == "host1"


def test_array_index_of(spark):
    arr = F.array(F.lit("a"), F.lit("b"), F.lit("b"))
    assert one(spark, S.array_index_of(arr, "b")) == 1
    assert one(spark, S.array_index_of(arr, "z")) == -1


def test_map_first_and_join(spark):
    m = F.create_map(F.lit("k"), F.array(F.lit("x"), F.lit("y")),
                     F.lit("e"), F.array().cast("array<string>"))
    assert one(spark, S.map_first(m, "k")) == "x"
    assert one(spark, S.map_first(m, "e")) is None
    assert one(spark, S.map_first(m, "absent")) is None
    assert one(spark, S.map_join(m, "k", "/")) == "x/y"
    assert one(spark, S.map_join(m, "e", "/")) is None
    assert one(spark, S.map_join(m, "absent", "/")) is None


@pytest.mark.parametrize("bad", ["a!b@", "YW I=", "YWJj\n", "Y", "YQ=x"])
def test_base64_decode_rejects_what_the_jvm_decoder_rejects(spark, bad):
    with pytest.raises(Exception):
        one(spark, S.base64_decode(F.lit(bad)))
    assert one(spark, S.base64_decode(F.lit(bad), strict=False)) is None


def test_base64_decode_padding_optional(spark):
    assert bytes(one(spark, S.base64_decode(F.lit("YWI")))) == b"ab"
    assert bytes(one(spark, S.base64_decode(F.lit("YWI=")))) == b"ab"


def test_strict_base64_decode_raises_tolerant_gives_null(spark):
    with pytest.raises(Exception):
        one(spark, S.base64_decode(F.lit("a!b@")))
    assert one(spark, S.base64_decode(F.lit("a!b@"), strict=False)) is None


@settings(max_examples=20, deadline=None)
@given(st.binary(min_size=0, max_size=300))
def test_base64_roundtrip(spark, b):
    df = spark.createDataFrame([(bytearray(b),)], "b binary")
    out = df.select(S.base64_decode(S.base64_encode("b")).alias("d")).first().d
    assert bytes(out) == b


def test_double_to_string_forms(spark):
    assert one(spark, S.double_to_string(F.lit(1.0))) == "1.0"
    assert one(spark, S.double_to_string(F.lit(1e-8))) == "1.0E-8"
    assert one(spark, S.vector_to_csv(F.array(F.lit(1.0), F.lit(2.5)))) == "1.0,2.5"
    assert one(spark, S.csv_to_vector(F.lit(""))) == []


def test_random_name_prefix(spark):
    v = one(spark, S.random_name("p_"))
    assert v.startswith("p_") and int(v[2:]) is not None


def test_check_width_raises(spark):
    with pytest.raises(Exception):
        one(spark, S.check_width(F.array(F.lit(1.0)), 2))


def test_softmax_argmax_properties(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.normal(size=10).tolist(),) for _ in range(50)]
    df = spark.createDataFrame(rows, "z array<double>")
    out = df.select("z", T.softmax("z").alias("p"), T.argmax("z").alias("a"),
                    T.argmax(T.softmax("z")).alias("ap")).collect()
    for r in out:
        assert abs(sum(r.p) - 1) < 1e-12
        assert r.a == r.ap == int(np.argmax(r.z))


def test_argmax_first_on_ties_and_one_hot_and_relu(spark):
    z = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))
    assert one(spark, T.argmax(z)) == 1
    assert one(spark, T.one_hot(F.lit(2), 4)) == [0, 0, 1, 0]
    assert one(spark, T.relu(F.array(F.lit(-1.0), F.lit(2.0)))) == [0.0, 2.0]


def test_cross_entropy_matches_numpy(spark):
    z = [0.5, -1.0, 2.0]
    ce = one(spark, T.cross_entropy(F.array(*[F.lit(v) for v in z]), F.lit(1)))
    zz = np.array(z)
    assert abs(ce - (np.log(np.exp(zz).sum()) - zz[1])) < 1e-12


def test_max_pool_expression_matches_numpy(spark):
    from tessera.operators.layers import max_pool2x2
    x = np.random.default_rng(1).normal(size=(4 * 6 * 2)).tolist()
    got = one(spark, T.max_pool2x2(F.array(*[F.lit(v) for v in x]), 4, 6, 2))
    want = max_pool2x2(np.array(x).reshape(1, 4, 6, 2)).ravel().tolist()
    assert got == want


def test_jvm_trim(spark):
    assert one(spark, S.jvm_trim(F.lit("\t\n a b \r\x00"))) == "a b"
    assert one(spark, S.jvm_trim(F.lit("   "))) == ""
    assert one(spark, S.jvm_trim(F.lit("\u00a0x\u00a0"))) == "\u00a0x\u00a0"   # U+00A0 is kept: only chars <= U+0020 go


def test_to_float_array_and_label_cast(spark):
    df = spark.createDataFrame([([0.1, 2.5, -1.0], 3.0)], "x array<double>, label double")
    row = df.select(S.to_float_array("x").alias("f"), T.one_hot("label", 5).alias("h")).first()
    assert df.select(S.to_float_array("x")).schema.fields[0].dataType.simpleString() == "array<float>"
    assert [round(v, 6) for v in row.f] == [0.1, 2.5, -1.0] and row.h == [0, 0, 0, 1, 0]
