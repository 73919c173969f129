"""A baseline made of flows alone, for runs whose packets are gone: edges, hosts, rare edges, traffic by minute, commands.

Flows know which function codes they hold and not how often: their packets are shared among their codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otspark.operators import sketches

RARE_PERCENT = 10.0
PEERS, SHOWN_PEERS, SOURCES = 8, 16, 8
#: A minute stands out from this many times the mean of all minutes, if that is at least so many packets.
SPIKE, LEAST_MEAN = 3, 5
RARE_SHARE, UNCOMMON_PERCENT = 0.002, 1.0


def edges(flows: DataFrame) -> DataFrame:
    return flows.where("src_ip is not null and dst_ip is not null").groupBy("src_ip", "dst_ip").agg(F.sum("packet_count").alias("packets"), F.sum("byte_count").alias("bytes"))


def rare_edges(found: DataFrame, percent: float = RARE_PERCENT, most: int = 200) -> DataFrame:
    """Edges of at most as many packets as the percentile by nearest rank."""
    bound = sketches.ranks(found, "packets", [percent]).select("value")  # one row
    return found.join(F.broadcast(bound), how="inner").where((F.col("packets") <= F.col("value")) & (F.col("packets") > 0)).drop("value").orderBy("packets", "src_ip", "dst_ip").limit(most)


def hosts(found: DataFrame, most: int = 50) -> DataFrame:
    """ip, bytes sent and received, distinct destinations; those with most bytes."""
    ends = found.select(F.explode(F.array(F.struct(F.col("src_ip").alias("ip"), "bytes", F.lit(1).alias("peer")), F.struct(F.col("dst_ip").alias("ip"), "bytes", F.lit(0).alias("peer")))).alias("e")).select("e.*")
    return ends.groupBy("ip").agg(F.sum("bytes").alias("bytes"), F.sum("peer").alias("peers")).orderBy(F.desc("bytes"), "ip").limit(most)


def one_to_many(found: DataFrame, least: int = PEERS, most: int = 40) -> DataFrame:
    rows = found.groupBy("src_ip").agg(F.count("*").alias("peers"), F.array_sort(F.collect_list("dst_ip")).alias("_p")).where(F.col("peers") >= least)
    return rows.orderBy(F.desc("peers"), "src_ip").limit(most).select("src_ip", "peers", F.slice("_p", 1, SHOWN_PEERS).alias("sample"))


def minutes(timeline: DataFrame) -> DataFrame:
    """Packets of minutes (column packets, in the order of `place`) with packets a second and whether they stand out."""
    mean = timeline.agg(F.avg("packets").alias("_mean"))  # one row
    told = timeline.join(F.broadcast(mean))
    return told.select("place", "packets", F.floor(F.col("packets") / 60).alias("packets_per_second"), ((F.col("_mean") >= LEAST_MEAN) & (F.col("packets") >= SPIKE * F.col("_mean"))).alias("spike"))


def commands(flows: DataFrame) -> DataFrame:
    """function_code, requests (estimated), percent, rare, uncommon, sources: every flow gives each of its codes a share of its packets, and its writing codes another."""
    share = lambda c: F.greatest(F.lit(1), F.floor(F.col("packet_count") / F.greatest(F.lit(1), F.size(c)))).cast("long")
    part = lambda c: flows.select("src_ip", F.explode(c).alias("function_code"), share(c).alias("n"))
    shares = part("function_codes_seen").unionByName(part("modbus_write_fcs_seen")).groupBy("function_code", "src_ip").agg(F.sum("n").alias("n"))
    place = Window.partitionBy("function_code").orderBy(F.desc("n"), "src_ip")
    first = shares.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= SOURCES).groupBy("function_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "src_ip"))), lambda x: x["src_ip"]).alias("sources"))
    counts = shares.groupBy("function_code").agg(F.sum("n").alias("requests"))
    total = counts.agg(F.sum("requests").alias("_total"))  # one row
    told = counts.join(F.broadcast(total)).join(first, "function_code")
    percent = 100.0 * F.col("requests") / F.col("_total")
    rare = F.col("requests") <= F.greatest(F.lit(1), F.floor(F.col("_total") * RARE_SHARE))
    return told.select("function_code", "requests", F.round(percent, 4).alias("percent"), rare.alias("rare"), (percent < UNCOMMON_PERCENT).alias("uncommon"), "sources")


def command_totals(flows: DataFrame) -> DataFrame:
    """One row: packets of flows that write, only read, or are Modbus without a known code; writing sources."""
    writes, reads, modbus = F.size("modbus_write_fcs_seen") > 0, F.size("function_codes_seen") > 0, F.array_contains("ics_protocols", "Modbus")
    part = lambda test: F.coalesce(F.sum(F.when(test, F.col("packet_count"))), F.lit(0))
    return flows.agg(part(writes).alias("write_like"), part(~writes & reads).alias("read_like"), part(~writes & ~reads & modbus).alias("other_like"), F.countDistinct(F.when(writes | F.col("has_write_operations"), F.col("src_ip"))).alias("write_sources"))
