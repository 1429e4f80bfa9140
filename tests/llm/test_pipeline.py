"""The pipeline, the registered queries and the SQL that exists."""

import re

import pytest

import corpus_pipeline as P
from tests.llm.conftest import SF
from tessera.llm import common, near, pieces, private, quality, queries
from tests.llm.test_text_operators import base_quality, base_spans, near_brute, shares
from tools.compare import compare, duck


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_with_sql(spark, name):
    msg, ok = compare(spark, duck(SF), name, queries.QUERIES[name], queries.SQL[name], SF)
    assert ok, msg


def test_registered():
    from __spark_entry__ import oracle_sql
    from __spark_entry__ import queries as registered
    names = set(registered())
    assert {*queries.QUERIES, "pipeline"} <= names and set(oracle_sql()) <= names
    for n in range(1, 14):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1


def test_stages_and_run_agree_with_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    assert 4 <= len(P.STAGES) <= 5
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = common.settle(stage(spark, docs, SF), "test")
        assert out.schema.names == docs.schema.names
        got = [(r.doc_id, r.text) for r in out.collect()]
        if name == "quality rules":
            want = {}
            for i, t in rows.items():
                n, chars, *_, failed = base_quality(t)
                dup, line = shares(t)
                if not failed and line <= quality.MAX_LINE * chars and all(
                        dup[k] <= quality.MAX_NGRAM[k] * chars for k in dup):
                    want[i] = t
            assert dict(got) == want and len(got) == len(want)
        elif name == "near-duplicates":
            keep = near_brute(list(rows.items()), 5)
            assert sorted(i for i, _ in got) == sorted(i for i, x in keep.items() if x[2])
        elif name == "personal data":
            for i, t in got:
                assert not base_spans(t) and (base_spans(rows[i]) or t == rows[i])
        elif name == "mixing":
            assert {i for i, _ in got} <= set(rows)
        rows, docs = dict(got), out
    enc = pieces.Encoder(pieces.pieces(pieces.MODEL))
    for r in P.STAGES[-1][1](spark, docs, SF).collect():
        assert r.round_trip and enc.decode(r.ids) == rows[r.doc_id]
    assert sorted(r.doc_id for r in P.run(spark, SF).select("doc_id").collect()) == sorted(
        r.doc_id for r in docs.select("doc_id").collect())


def test_stages_take_nulls_and_repeats(spark, docs):
    t = " ".join(f"word{i}" for i in range(40))
    src = docs([(None, t), (1, t), (1, t), (2, None), (3, ""), (4, t + " mail me a@b.cc", None)])
    for _, stage in P.STAGES:
        src = common.settle(stage(spark, src, SF), "test")
    assert src.count() >= 1


@pytest.mark.parametrize("op", [near.near_duplicates, private.find_private, quality.quality])
def test_rows_without_documents_columns(frame, op):
    assert op(frame([(1, "x")], "doc_id long, text string")).count() == 1
