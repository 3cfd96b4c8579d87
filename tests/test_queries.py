"""Every query of the log against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tidelog.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return out


def plain(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


def test_all_have_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    found, expected = QUERIES[name](spark, FOLDER), con.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    wanted = con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert plain(rows) == plain(wanted)


def test_every_event_is_named(spark):
    assert QUERIES["type_names"](spark, FOLDER).where("name is not null").count() == spark.read.parquet(f"{FOLDER}/events.parquet").count()


def test_list_fold_has_every_event(spark):
    sizes = [len(r["types"].split(",")) for r in QUERIES["fold_list"](spark, FOLDER).collect()]
    assert sum(sizes) == spark.read.parquet(f"{FOLDER}/events.parquet").count() and max(sizes) > 5


def test_every_error_gives_a_command(spark):
    errors = spark.read.parquet(f"{FOLDER}/events.parquet").where("event_type = 'error'")
    assert QUERIES["process_events"](spark, FOLDER).select("command_id").distinct().count() == errors.count()


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
