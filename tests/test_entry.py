import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["expand_in", "optional_match", "pattern_comprehension", "varlen_fixed", "having", "arithmetic"]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    found = con.sql(entry.oracle_sql()[name])
    order = [found.columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, (tuple(r[i] for i in order) for r in found.fetchall())))


def test_entry_and_sql_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """The tables with the event numbers of a 60 times larger events table."""
    d = tmp_path_factory.mktemp("late")
    for t in os.listdir(SF):
        if t != "events.parquet":
            os.symlink(f"{SF}/{t}", d / t)
    spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.col("event_id") * 6000).write.parquet(f"{d}/events.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["duration_parts", "epoch"])
def test_late_events_against_sql(spark, late, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{late}/events.parquet/*.parquet'")
    df = entry.queries()[name](spark, late)
    found = con.sql(entry.oracle_sql()[name])
    order = [found.columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, (tuple(r[i] for i in order) for r in found.fetchall())))
