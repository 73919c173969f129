"""Queries over decoded frames of the packet view: Modbus fields, dispatch, function codes, writes, statistics.

The view's payloads are bytes; the SQL selects the integers that they were made of, so it checks the decoding.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from otspark.functions.dims import HEURISTIC
from otspark.operators import decode, flows
from otspark.plans.catalog import register
from otspark.plans.flow_queries import KEYS
from otspark.sources.packets import PACKETS, packets, polling

# fixed values: Modbus codes that write
WRITES = "(5, 6, 15, 16, 21, 22, 23)"
#: The Modbus decoder alone takes all packets: those of port 502 by it, the others by their payload.
MODBUS = "modbus AS (SELECT * FROM packets)"


def modbus_frames(spark, sf_dir, **options):
    return decode.decode(packets(spark, sf_dir), ["modbus"], **options)


@register("modbus_decode", f"WITH {PACKETS}, {MODBUS} SELECT packet_number, fc AS function_code, fc IN {WRITES} AS is_write_operation, false AS is_exception FROM modbus")
def modbus_decode(spark, sf_dir):
    return modbus_frames(spark, sf_dir).select("packet_number", "function_code", "is_write_operation", "is_exception")


@register("dispatch", f"WITH {PACKETS} SELECT packet_number, CASE dst_port WHEN 502 THEN 'modbus' WHEN 102 THEN 's7' WHEN 20000 THEN 'dnp3' WHEN 44818 THEN 'enip' END AS protocol_slug FROM packets WHERE dst_port <> 3389 UNION ALL SELECT packet_number, unnest({list(HEURISTIC)}) FROM packets WHERE dst_port = 3389")
def dispatch(spark, sf_dir):
    """The decoders that look at each packet: those of its ports, else all that go by payload."""
    return packets(spark, sf_dir).select("packet_number", F.explode(decode.dispatch(list(decode.DECODERS))).alias("protocol_slug"))


@register("command_profile", f"WITH {PACKETS} SELECT fc AS function_code, CASE WHEN fc IN (1, 2, 3, 4) THEN 'read' WHEN fc IN (5, 6, 15, 16, 22, 24) THEN 'write' ELSE 'other' END AS category, count(*) AS requests, count(DISTINCT src_ip) AS sources FROM packets WHERE dst_port = 502 GROUP BY ALL")
def command_profile(spark, sf_dir):
    """Modbus requests and their sources by function code."""
    return decode.modbus_requests(packets(spark, sf_dir)).groupBy("function_code", "category").agg(F.count("*").alias("requests"), F.countDistinct("src_ip").alias("sources"))


@register(
    "rare_function_code",
    f"WITH {PACKETS}, {MODBUS}, seen AS (SELECT packet_number, fc, count(*) OVER (ORDER BY packet_number) AS total, count(*) OVER (PARTITION BY fc ORDER BY packet_number) AS times FROM modbus) "
    f"SELECT packet_number, fc AS function_code, CASE WHEN fc IN {WRITES} THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM seen WHERE total >= 100 AND times < 3 AND times / total < 0.001",
)
def rare_function_code(spark, sf_dir):
    return flows.rare_function_codes(modbus_frames(spark, sf_dir)).select("packet_number", "function_code", "severity")


@register(
    "flow_frames",
    f"WITH {PACKETS}, {MODBUS} SELECT src_ip, src_port, dst_ip, array_to_string(list_sort(list(DISTINCT fc)), ',') AS function_codes, coalesce(array_to_string(list_sort(list(DISTINCT fc) FILTER (fc IN {WRITES})), ','), '') AS write_codes, bool_or(fc IN {WRITES}) AS has_write_operations FROM modbus GROUP BY {KEYS}",
)
def flow_frames(spark, sf_dir):
    """What the frames of a flow say of it."""
    built = flows.with_frames(flows.flow_build(packets(spark, sf_dir)), modbus_frames(spark, sf_dir))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return built.select("src_ip", "src_port", "dst_ip", joined("function_codes_seen").alias("function_codes"), joined("modbus_write_fcs_seen").alias("write_codes"), "has_write_operations")


@register(
    "multi_target_sources",
    f"WITH {PACKETS} SELECT src_ip, count(DISTINCT dst_ip) AS targets FROM packets WHERE dst_port IN (502, 102, 20000, 44818) GROUP BY src_ip HAVING count(DISTINCT dst_ip) >= 4",
)
def multi_target_sources(spark, sf_dir):
    return flows.multi_target_sources(flows.flow_build(packets(spark, sf_dir)))


@register("it_edge_flows", f"WITH {PACKETS} SELECT src_ip, src_port, dst_port AS port, 'RDP' AS label, count(*) AS packets FROM packets WHERE dst_port = 3389 GROUP BY ALL")
def it_edge_flows(spark, sf_dir):
    return flows.it_edge_flows(flows.flow_build(packets(spark, sf_dir))).select("src_ip", "src_port", "port", "label", F.col("packet_count").alias("packets"))


@register("cross_boundary", f"WITH {PACKETS} SELECT src_ip, dst_ip, count(*) AS packets FROM packets WHERE dst_ip = '8.8.8.8' GROUP BY ALL")
def cross_boundary(spark, sf_dir):
    """Pairs of a private and a public address."""
    return flows.comm_matrix(flows.cross_boundary(flows.flow_build(packets(spark, sf_dir))))


@register("new_edges", f"WITH {PACKETS}, parts AS (SELECT *, packet_number * 20 < (SELECT max(packet_number) FROM packets) AS early FROM packets) SELECT src_ip, dst_ip FROM parts GROUP BY ALL HAVING NOT bool_or(early)")
def new_edges(spark, sf_dir):
    """Edges that the first twentieth of the packets lacks."""
    rows = packets(spark, sf_dir)
    last = rows.agg(F.max("packet_number").alias("_last"))
    early = F.col("packet_number") * 20 < F.col("_last")
    told = rows.join(F.broadcast(last), how="inner").withColumn("_early", early)  # one row: the aggregate
    return flows.new_edges(told.where("_early"), told.where("not _early"))


@register("traffic_per_second", "WITH s AS (SELECT CASE WHEN event_id % 2400 < 60 THEN (event_id // 2400) * 200 WHEN event_id % 2400 BETWEEN 1200 AND 1210 THEN event_id // 12 + 1 ELSE event_id // 12 END AS sec FROM events) SELECT CAST(sec AS BIGINT) AS sec, count(*) AS packets FROM s GROUP BY ALL")
def traffic_per_second(spark, sf_dir):
    return polling(spark, sf_dir).groupBy(F.col("sec").cast("long").alias("sec")).agg(F.count("*").alias("packets"))
