"""Queries with SQL against it, on the smallest tables."""

import os

import duckdb
import pytest

from tidelog.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = QUERIES[name](spark, FOLDER)
    wanted = con.sql(f"SELECT {', '.join(found.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, wanted))


def test_all_ten_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
