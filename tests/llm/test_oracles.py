"""Corpus operators against their SQL."""

import duckdb
import pytest

from photolake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, f"/root/testdata/{sf}")
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=str) == sorted(want, key=str)
