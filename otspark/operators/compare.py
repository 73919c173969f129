"""Two runs compared: hosts, edges, protocols, traffic and writes of a baseline and of now.

A run is a set of tables (snapshot()); they are compared by anti joins and scalars, so runs of any size compare without
meeting on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otspark.operators import baseline, decode

#: Ratio of the mean packets a second from which traffic is alarming, and the least mean of the baseline for a ratio.
TRAFFIC_RATIO, LEAST_MEAN = 2.0, 0.5
#: Times the writes of the baseline that are alarming, and the least number of writes now.
WRITE_RATIO, LEAST_WRITES = 2, 5
#: New pairs that a report shows.
SHOWN_PAIRS = 500


@dataclass
class Snapshot:
    """edges: src_ip, dst_ip, packets, bytes; seconds: sec, pps, bps; requests: src_ip, function_code, category."""

    edges: DataFrame
    seconds: DataFrame
    requests: DataFrame


def snapshot(packets: DataFrame) -> Snapshot:
    return Snapshot(baseline.edges(packets), baseline.per_second(packets), decode.modbus_requests(packets).select("src_ip", "function_code", "category"))


def hosts(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src_ip").alias("ip")).unionByName(edges.select(F.col("dst_ip").alias("ip"))).where("ip is not null").distinct()


def new_hosts(before: Snapshot, now: Snapshot) -> DataFrame:
    return hosts(now.edges).join(hosts(before.edges), "ip", "left_anti").orderBy("ip")


def new_pairs(before: Snapshot, now: Snapshot, most: int = SHOWN_PAIRS) -> DataFrame:
    """The first new pairs of addresses, and how many there are in all."""
    keys = ["src_ip", "dst_ip"]
    rows = now.edges.select(*keys).distinct().join(before.edges.select(*keys).distinct(), keys, "left_anti")
    return rows.orderBy(*keys).limit(most)


def new_values(before: DataFrame, now: DataFrame, column: str) -> DataFrame:
    """value, change: what only one of two tables has in a column; composite labels count as they are."""
    of = lambda df: df.select(F.col(column).alias("value")).where("value is not null and value <> ''").distinct()
    only = lambda a, b, name: of(a).join(of(b), "value", "left_anti").withColumn("change", F.lit(name))
    return only(now, before, "new").unionByName(only(before, now, "gone")).orderBy("change", "value")


def traffic(before: Snapshot, now: Snapshot, ratio: float = TRAFFIC_RATIO) -> DataFrame:
    """One row: mean packets a second of both, their ratio where the baseline is busy enough, and whether it is alarming."""
    mean = lambda s, name: s.seconds.agg(F.avg("pps").alias(name))
    told = mean(before, "mean_before").join(mean(now, "mean_now"))  # one row each
    told = told.withColumn("ratio", F.when(F.col("mean_before") > LEAST_MEAN, F.round(F.col("mean_now") / F.col("mean_before"), 4)))
    return told.withColumn("alarming", F.coalesce(F.col("mean_now") / F.nullif("mean_before", F.lit(0.0)) >= ratio, F.lit(False)) & F.col("ratio").isNotNull())


def writers(s: Snapshot) -> DataFrame:
    return s.requests.where("category = 'write'").select("src_ip").distinct()


def writes(before: Snapshot, now: Snapshot) -> DataFrame:
    """One row: writing sources and writes of both, new writers, and whether that is alarming."""
    of = lambda s, name: s.requests.where("category = 'write'").agg(F.count("*").alias(f"writes_{name}"), F.countDistinct("src_ip").alias(f"writers_{name}"))
    fresh = writers(now).join(writers(before), "src_ip", "left_anti").agg(F.array_sort(F.collect_list("src_ip")).alias("new_writers"))
    told = of(before, "before").join(of(now, "now")).join(fresh)  # one row each
    grown = (F.col("writes_now") > F.col("writes_before") * WRITE_RATIO) & (F.col("writes_now") > LEAST_WRITES)
    return told.withColumn("alarming", grown | (F.size("new_writers") > 0))


def learned(frames: DataFrame) -> DataFrame:
    """protocol, frames, mean_size, size_std and distinct codes: what a run teaches of each protocol."""
    size = F.coalesce(F.length("payload"), F.lit(0)).cast("long")
    rows = frames.groupBy("protocol").agg(F.count("*").alias("frames"), F.sum(size).alias("_s"), F.sum(size * size).alias("_s2"), F.countDistinct("function_code").alias("codes"))
    n, s, s2 = (F.col(c).cast("double") for c in ("frames", "_s", "_s2"))
    std = F.when(F.col("frames") > 1, F.sqrt(F.greatest(F.lit(0.0), (n * s2 - s * s) / (n * (n - 1))))).otherwise(0.0)
    return rows.select("protocol", "frames", (s / n).alias("mean_size"), std.alias("size_std"), "codes")
