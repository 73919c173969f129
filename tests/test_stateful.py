"""A stream replayed in several batches gives what the operators give for the table."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from otspark.operators import baseline, flows
from otspark.sources.packets import FLOW
from otspark.streaming import stateful

PACKETS = "src_ip string, dst_ip string, src_port int, dst_port int, transport string, file_idx int, packet_number long, ts_us long, length long"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng, clock, rows = random.Random(9), 10**12, []
    for n in range(1, 1501):
        clock += rng.choice([0, -30, 900, 40_000, 3_700_000_000])
        k = rng.choice([0, 0, 0, rng.randrange(45)])
        a, b = f"10.0.0.{k}", f"10.0.1.{k % 7}"
        a, b = (b, a) if rng.random() < 0.3 else (a, b)
        rows.append((a if n % 97 else None, b, 1000 + k, 502, "TCP", 0, n, clock, rng.randrange(60, 1500)))
    path = str(tmp_path_factory.mktemp("packets"))
    df = spark.createDataFrame(rows, PACKETS)
    for i in range(3):  # three files, one a batch
        df.where(F.floor((F.col("packet_number") - 1) / 500) == i).coalesce(1).write.mode("append").parquet(path)
    return df, path


def replayed(spark, path, operator, tmp_path, mode, keep, **options):
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a state store for each
    try:
        return played(spark, path, operator, tmp_path, mode, keep, **options)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def played(spark, path, operator, tmp_path, mode, keep, **options):
    stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(path)
    out = operator(keep(stream), **{"quiet": None, **options}).writeStream.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/out"))
    out = out.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state")
    if options.get("quiet"):  # works on until it is stopped
        query, end = out.trigger(processingTime="1 second").start(), time.time() + 100
        while sum(p["numInputRows"] for p in query.recentProgress) < 1500 and time.time() < end:
            time.sleep(0.5)
        query.stop()
    else:
        assert out.trigger(availableNow=True).start().awaitTermination(100)
    return spark.read.parquet(f"{tmp_path}/out")


def test_flow_moments(spark, table, tmp_path):
    df, path = table
    got = replayed(spark, path, stateful.flow_moments, tmp_path, "update", lambda s: s)
    last = got.groupBy(*FLOW).agg(F.max_by(F.struct(*[c for c in got.columns if c not in (*FLOW, "batch")]), "batch").alias("s"), F.max("batch").alias("b")).select(*FLOW, "s.*", "b").collect()
    assert max(r.b for r in last) >= 2
    want = {tuple(r[c] for c in FLOW): r for r in flows.flow_build(df).collect()}
    assert len(last) == len(want)
    for r in last:
        w = want[tuple(r[c] for c in FLOW)]
        assert all(r[c] == w[c] for c in ("packet_count", "byte_count", "start_us", "end_us", "ipt_count"))
        assert all(r[c] == pytest.approx(w[c]) for c in ("packet_length_std", "avg_inter_packet_time", "jitter"))


def test_new_pairs(spark, table, tmp_path):
    df, path = table
    got = replayed(spark, path, stateful.new_pairs, tmp_path, "append", lambda s: s)
    want = sorted((r.pair, r.packet_number) for r in baseline.new_pairs(df).collect())
    assert sorted((r.pair, r.packet_number) for r in got.collect()) == want and len(want) > 10


def test_new_pairs_are_bounded(spark, table, tmp_path):
    df, path = table
    got = replayed(spark, path, stateful.new_pairs, tmp_path, "append", lambda s: s, known=5, most=30)
    want = sorted((r.packet_number, r.pair) for r in baseline.new_pairs(df, known=5).collect())[:24]  # 30 known in all, the first six unsaid
    assert sorted((r.packet_number, r.pair) for r in got.collect()) == want


def frames(packets):
    code = F.when(F.col("packet_number").isin(50, 700, 701, 1400), 90).when(F.col("packet_number") == 1200, 91).otherwise(F.col("packet_number") % 3)
    return packets.select(F.lit("modbus").alias("protocol"), "file_idx", "packet_number", F.when(F.col("packet_number") % 11 != 5, code).cast("int").alias("function_code"), (F.col("packet_number") % 2 == 0).alias("is_write_operation"), F.lit("modbus").alias("protocol_slug"), F.lit(0).alias("parser_idx"), "src_ip", "dst_ip", "ts_us")


def test_rare_codes(spark, table, tmp_path):
    df, path = table
    got = replayed(spark, path, stateful.rare_codes, tmp_path, "append", frames, quiet=3_600_000)
    want = sorted((r.packet_number, r.function_code, r.severity) for r in flows.rare_function_codes(frames(df).where("function_code is not null")).collect())
    assert sorted((r.packet_number, r.function_code, r.severity) for r in got.collect()) == want and len(want) >= 1
