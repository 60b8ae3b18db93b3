"""Queries of the subpackage against their SQL."""

import duckdb
import pytest

from corvane.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(d[0] for d in found.description) == order
    names = [d[0] for d in found.description]
    theirs = sorted(tuple(r[names.index(c)] for c in order) for r in found.fetchall())
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == theirs
