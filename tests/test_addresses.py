"""Addresses that tables number on past 255, and hosts of large tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from otspark.functions import net
from otspark.plans import catalog
from tests.test_queries import SF, plain


def test_numbers_over_255(spark):
    rows = spark.createDataFrame([("10.20.255.7",), ("10.20.351.7",), ("192.168.1.300",), ("8.8.8.8",), ("8.8.300.8",), ("256.1.1.1",), ("10.20.03.7",), ("10.20.3",), (None,)], "ip string")
    got = rows.select("ip", net.is_private(F.col("ip")).alias("private"), net.is_public(F.col("ip")).alias("public"), net.subnet(F.col("ip")).alias("subnet")).collect()
    assert [(r.private, r.public, r.subnet) for r in got] == [
        (True, False, "10.20.255.0/24"), (True, False, "10.20.351.0/24"), (True, False, "192.168.1.0/24"), (False, True, "8.8.8.0/24"), (False, True, "8.8.300.0/24"),
        (False, False, "unknown"), (False, False, "unknown"), (False, False, "unknown"), (False, False, "unknown"),
    ]


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """The events of sf0.01 with twice as many users, half of them beyond 65,535."""
    where = str(tmp_path_factory.mktemp("users"))
    spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id") + 70_000).otherwise(F.col("user_id"))).write.parquet(f"{where}/events.parquet")
    return where


@pytest.mark.parametrize("name", ["cross_boundary", "crossing_flows", "survey_addressing", "zones"])
def test_as_sql(spark, many_users, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{many_users}/events.parquet/*.parquet'")
    theirs = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in theirs.description]
    df = catalog.queries()[name](spark, many_users)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(theirs.fetchall(), names)
