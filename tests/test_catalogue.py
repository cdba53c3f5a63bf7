"""Every catalogue query at the smallest scale against its oracle in DuckDB."""

import math
import os

import duckdb
import pytest

from graphloom.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else f"{v:.6g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_has_the_rows_of_its_oracle(spark, con, name):
    df = QUERIES[name](spark, DATA)
    rel = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_the_inference_check_reads_the_kept_graph_as_it_is(spark, monkeypatch):
    from graphloom import catalogue
    from graphloom.operators import reasoning as rs

    class Reached(Exception):
        pass

    def first(df, name, by=None):
        raise Reached(name)

    monkeypatch.setattr(rs, "stored", first)
    with pytest.raises(Reached, match="fresh"):  # the first table written is a round of the fixpoint, not the graph again
        catalogue.QUERIES["check_inference"](spark, "/root/testdata/sf0.001")
