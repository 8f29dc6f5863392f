"""Every catalogue query against its DuckDB SQL on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

from spanlake.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return str([plain(v) for v in value])
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return "" if math.isnan(value) else repr(round(float(value), 9) + 0.0)
    return "" if value is None else str(value)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, tables, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    expected = tables.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_all_sentences(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    expected = set()
    for key, text in texts.items():
        at = 0
        for i, sentence in enumerate(re.split("[.!?;]", text) if text is not None else []):
            share = lambda x: math.floor(60000.0 * x / len(text)) if text else 0  # noqa: B023, E731
            expected.add((key, i + 1, share(at), max(share(at + len(sentence)), share(at) + 100)))
            at += len(sentence) + 1
    got = QUERIES["F36_align_sentences"](spark, sf_dir).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert max(i for _, i, _, _ in expected) > 50
