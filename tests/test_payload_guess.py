"""Frames of S7 and DNP3 have a length that the protocol can have: their two first bytes alone are none."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from otspark.operators import decode
from otspark.plans import catalog
from tests.test_queries import SF, plain


def test_lengths_decide(spark):
    given = [("s7 length 0", "030000000006010300000001"), ("s7", "0300001611e00000000600c1020100c2020102c0010a"), ("dnp3 length 0", "056400000006010300000001"), ("dnp3", "05640fc401000200000000c0c1040c01170100")]
    rows = spark.createDataFrame([(n, 50000, port, "TCP", bytearray.fromhex(p)) for n, p in given for port in (3389, 102 if n.startswith("s7") else 20000)], "name string, src_port int, dst_port int, transport string, payload binary")
    got = sorted((r["name"], r.dst_port, r.protocol_slug) for r in decode.decode(rows).select("name", "dst_port", "protocol_slug").collect())
    assert got == [("dnp3", 3389, "dnp3"), ("dnp3", 20000, "dnp3"), ("dnp3 length 0", 3389, "modbus"), ("s7", 102, "s7"), ("s7", 3389, "omron_fins"), ("s7", 3389, "s7"), ("s7 length 0", 3389, "modbus"), ("s7 length 0", 3389, "omron_fins")]


def test_distribution_as_sql(spark, tmp_path):
    """Modbus requests whose transaction numbers, 768 and 1380, begin as S7 and DNP3 do."""
    where = f"{tmp_path}/events.parquet"
    e = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 2000")
    kind = F.when(F.col("event_id") == 768, "view").when(F.col("event_id") == 1380, "signup").otherwise(F.col("event_type"))  # ports 102 and 3389
    e.withColumn("event_type", kind).write.parquet(where)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{where}/*.parquet'")
    theirs = duck.execute(catalog.oracles()["protocol_distribution"])
    names = [d[0] for d in theirs.description]
    df = catalog.queries()["protocol_distribution"](spark, str(tmp_path))
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(theirs.fetchall(), names)
