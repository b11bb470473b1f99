"""Every registered query against its SQL on the same tables; ``ORACLE_SF_DIR`` names other tables."""

from __future__ import annotations

import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from palimpsest.plans import checklist_queries, citation_queries, html_queries, interface_queries, interval_queries, plain_text_queries, record_queries, registry, retrieval_queries, review_queries, section_queries, stream_queries, version_queries  # noqa: F401

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Kinds of types that both engines must agree in.
KINDS = {"int": "int", "bigint": "int", "smallint": "int", "integer": "int", "double": "double", "float": "double", "string": "text", "varchar": "text", "boolean": "bool", "timestamp_ntz": "timestamp"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else f"{float(value) + 0.0:.5f}"
    if isinstance(value, int):
        return f"{value:.5f}"
    if isinstance(value, (date, datetime)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in value.items()) + "}"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    ours = {c: KINDS.get(t, t) for c, t in df.dtypes}
    theirs = {c: KINDS.get(str(t).lower(), str(t).lower()) for c, t in zip(rel.columns, rel.types)}
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert len(got) == len(want)
    differing = [(g, w) for g, w in zip(got, want) if g != w]
    assert not differing, f"{len(differing)} rows differ, first: {differing[0]}"
    assert ours == theirs


def test_all_registered_queries_have_rows(spark):
    without = sorted(set(registry.QUERIES) - set(registry.ORACLES))
    for name in without:
        assert registry.QUERIES[name](spark, SF_DIR).count() > 0, name
