"""Queries over the graph of addresses and over behaviour in time: packet, polling and lineitem views."""

from __future__ import annotations

from pyspark.sql import functions as F

from otspark.functions.dims import ports
from otspark.functions.net import pseudonym
from otspark.operators import baseline, decode, flows, graph, topology
from otspark.plans.asset_queries import WITH as WITH_ASSETS
from otspark.plans.asset_queries import found, inventory
from otspark.plans.catalog import register
from otspark.plans.frame_queries import MODBUS, WRITES, modbus_frames
from otspark.plans.flow_queries import WITH
from otspark.sources.packets import PACKETS, POLLING, packets, polling, table

#: Suppliers to parts of lineitem as an edge list, quantities as bytes.
SUPPLY = "supply AS (SELECT 's' || l_suppkey AS src_ip, 'p' || l_partkey AS dst_ip, CAST(l_quantity AS BIGINT) AS length FROM lineitem)"
EDGES = "edges AS (SELECT src_ip, dst_ip, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM supply GROUP BY ALL)"
SECONDS = "seconds AS (SELECT CAST(sec AS BIGINT) AS sec, count(*) AS pps FROM packets GROUP BY ALL)"


def supply(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.concat(F.lit("s"), "l_suppkey").alias("src_ip"), F.concat(F.lit("p"), "l_partkey").alias("dst_ip"), F.col("l_quantity").cast("long").alias("length"))


def framed(spark, sf_dir):
    return flows.with_frames(flows.flow_build(packets(spark, sf_dir)), modbus_frames(spark, sf_dir))


@register("comm_graph_links", WITH + ", l AS (SELECT src_ip, dst_ip, CAST(sum(packet_count) AS BIGINT) AS packets, CAST(sum(byte_count) AS BIGINT) AS bytes, count(*) AS flows FROM flows GROUP BY ALL) SELECT src_ip, dst_ip, packets, bytes, flows, false AS bidirectional, 'Modbus' AS protocols FROM l ORDER BY packets DESC, src_ip, dst_ip LIMIT 600")
def comm_graph_links(spark, sf_dir):
    return graph.links(framed(spark, sf_dir)).withColumn("protocols", F.array_join("ics_protocols", ",")).drop("ics_protocols")


#: An edge for each flow of the packet view, all of them Modbus; and the first flow of each pair.
TOPOLOGY = """edges AS (SELECT src_ip, dst_ip, flow_id, 'Modbus' AS protocol, packet_count, byte_count, strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN start_us % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(start_us % 1000000 AS VARCHAR), 6, '0') END AS first_seen,
    strftime(make_timestamp(end_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN end_us % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(end_us % 1000000 AS VARCHAR), 6, '0') END AS last_seen, first_packet FROM flows),
 codes AS (SELECT src_ip, src_port, dst_ip, array_to_string(list_sort(list(DISTINCT fc)), ',') AS codes FROM packets GROUP BY ALL)"""


@register("topology_edges", WITH + f", {TOPOLOGY} SELECT e.src_ip, e.dst_ip, e.flow_id, protocol, e.packet_count, e.byte_count, first_seen, last_seen, codes FROM edges e JOIN flows f USING (flow_id) JOIN codes c ON c.src_ip = f.src_ip AND c.src_port = f.src_port AND c.dst_ip = f.dst_ip")
def topology_edges(spark, sf_dir):
    """An edge for each flow, with its protocol, times and codes."""
    codes = F.array_join(F.col("function_codes_used").cast("array<string>"), ",").alias("codes")
    return topology.edges(framed(spark, sf_dir)).select("src_ip", "dst_ip", "flow_id", "protocol", "packet_count", "byte_count", "first_seen", "last_seen", codes)


@register("topology_merged", WITH + f", {TOPOLOGY} SELECT src_ip, dst_ip, 'Modbus' AS protocols, CAST(sum(packet_count) AS BIGINT) AS packet_count, CAST(sum(byte_count) AS BIGINT) AS byte_count, count(*) AS flows, arg_min(first_seen, first_packet) AS first_seen, arg_min(last_seen, first_packet) AS last_seen FROM edges GROUP BY src_ip, dst_ip")
def topology_merged(spark, sf_dir):
    """Edges merged by pair: sums, and the times of the pair's first flow."""
    of = topology.merged(topology.edges(framed(spark, sf_dir)))
    return of.select("src_ip", "dst_ip", F.array_join("protocols", ",").alias("protocols"), "packet_count", "byte_count", "flows", "first_seen", "last_seen")


#: Risk from which on the packet view has ends of paths.
LEAST = 1.5


@register("critical_paths", WITH_ASSETS + f", high AS (SELECT ip_address AS ip, (SELECT min(struct_pack(n := packet_number, side := CASE WHEN src_ip = ip_address THEN 0 ELSE 1 END)) FROM packets WHERE ip_address IN (src_ip, dst_ip)) AS first FROM assets WHERE risk_score >= {LEAST}) SELECT DISTINCT s.ip AS source, d.ip AS ip, 1 AS hops, s.ip || '>' || d.ip AS path FROM high s JOIN packets p ON p.src_ip = s.ip JOIN high d ON p.dst_ip = d.ip WHERE s.first < d.first")
def critical_paths(spark, sf_dir):
    """Shortest paths between risky addresses, from the one seen earlier: in the packet view none is longer than an edge."""
    rows = packets(spark, sf_dir)
    of = rows.select("src_ip", "dst_ip").distinct()
    return topology.critical_paths(of, inventory(spark, sf_dir), topology.first_seen(rows), LEAST).select("source", "ip", "hops", F.array_join("path", ">").alias("path"))


@register("zones", WITH_ASSETS + ", z AS (SELECT regexp_replace(ip_address, '\\.\\d+$', '.0/24') AS subnet, count(*) AS members FROM assets GROUP BY 1) SELECT printf('ZONE-%03d', row_number() OVER (ORDER BY subnet)) AS zone_id, subnet, members, 'Modbus' AS primary_protocol FROM z")
def zones(spark, sf_dir):
    return graph.zones(inventory(spark, sf_dir))


@register("graph_stats", f"WITH {PACKETS}, e AS (SELECT DISTINCT src_ip, dst_ip FROM packets), n AS (SELECT src_ip AS ip FROM e UNION SELECT dst_ip FROM e), c AS (SELECT count(*) AS n FROM n), m AS (SELECT count(*) AS m FROM e) SELECT n AS total_nodes, m AS total_edges, round(m / (CAST(n AS DOUBLE) * (n - 1)), 4) AS density, true AS is_connected FROM c, m")
def graph_stats(spark, sf_dir):
    return graph.graph_stats(packets(spark, sf_dir))


@register("comm_edges", f"WITH {SUPPLY}, {EDGES} SELECT * FROM edges")
def comm_edges(spark, sf_dir):
    return baseline.edges(supply(spark, sf_dir))


@register("top_hosts", f"WITH {SUPPLY}, {EDGES}, h AS (SELECT src_ip AS ip, bytes, 1 AS s FROM edges UNION ALL SELECT dst_ip, bytes, 0 FROM edges) SELECT ip, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(s) AS BIGINT) AS peers_as_source FROM h GROUP BY ip ORDER BY 2 DESC, ip LIMIT 50")
def top_hosts(spark, sf_dir):
    return baseline.top_hosts(baseline.edges(supply(spark, sf_dir)))


@register("rare_edges_p10", f"WITH {SUPPLY}, {EDGES} SELECT * FROM edges WHERE packets <= (SELECT quantile_cont(packets, 0.1) FROM edges)")
def rare_edges_p10(spark, sf_dir):
    return baseline.rare_edges(baseline.edges(supply(spark, sf_dir)))


@register("one_to_many", f"WITH {SUPPLY}, {EDGES} SELECT src_ip, count(*) AS destinations FROM edges GROUP BY src_ip HAVING count(*) >= 8 ORDER BY 2 DESC, 1 LIMIT 40")
def one_to_many(spark, sf_dir):
    return baseline.one_to_many(baseline.edges(supply(spark, sf_dir)))


@register("transport_split", f"WITH {PACKETS} SELECT lower(transport) AS l4, count(*) AS packets, count(*) * 100.0 / (SELECT count(*) FROM packets)::DOUBLE AS percent FROM packets GROUP BY 1")
def transport_split(spark, sf_dir):
    return baseline.transport_split(packets(spark, sf_dir))


@register("it_flags", f"WITH {PACKETS} SELECT src_ip, dst_ip, dst_port AS port, count(*) AS packets, 'rdp' AS service FROM packets WHERE dst_port = 3389 GROUP BY ALL")
def it_flags(spark, sf_dir):
    return baseline.service_flags(packets(spark, sf_dir))


@register("industrial_hits", f"WITH {PACKETS} SELECT CASE dst_port WHEN 502 THEN 'modbus' WHEN 102 THEN 's7' ELSE 'dnp3' END AS protocol, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets WHERE dst_port IN (502, 102, 20000) GROUP BY 1")
def industrial_hits(spark, sf_dir):
    return baseline.industrial_hits(packets(spark, sf_dir))


@register("packets_per_second", f"WITH {PACKETS} SELECT (ts_us - (SELECT min(ts_us) FROM packets)) // 1000000 AS sec, count(*) AS pps, CAST(sum(length) AS BIGINT) AS bps FROM packets GROUP BY 1")
def packets_per_second(spark, sf_dir):
    return baseline.per_second(packets(spark, sf_dir))


@register("rolling_spikes", f"WITH {POLLING}, {SECONDS}, r AS (SELECT sec, pps, CAST(sum(pps) OVER w AS DOUBLE) / count(*) OVER w AS rolling_mean FROM seconds WINDOW w AS (ORDER BY sec ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), k AS (SELECT *, CASE WHEN rolling_mean >= 5 AND pps >= 3 * rolling_mean THEN 'spike' WHEN rolling_mean >= 10 AND pps <= 0.1 * rolling_mean THEN 'drop' END AS kind FROM r) SELECT * FROM k WHERE kind IS NOT NULL")
def rolling_spikes(spark, sf_dir):
    seconds = polling(spark, sf_dir).groupBy(F.col("sec").cast("long").alias("sec")).agg(F.count("*").alias("pps"))
    return baseline.rolling_anomalies(seconds)


@register(
    "interval_sampler",
    f"WITH {POLLING}, d AS (SELECT *, ts_us - lag(ts_us) OVER w AS d, row_number() OVER w AS n FROM packets WINDOW w AS (PARTITION BY src_ip, src_port ORDER BY packet_number)), k AS (SELECT *, row_number() OVER (PARTITION BY src_ip, src_port ORDER BY packet_number) AS k FROM d WHERE n >= 12 AND d > 0), "
    "a AS (SELECT src_ip, count(*) AS samples, median(d) / 1e6 AS median_s, CAST(sum(d) AS HUGEINT) AS s, sum(CAST(d AS HUGEINT) * d) AS s2 FROM k WHERE k <= 400 GROUP BY src_ip), "
    "c AS (SELECT *, sqrt(greatest(CAST(samples * s2 - s * s AS DOUBLE), 0)) / samples / 1e6 / (median_s + 1e-9) AS cv FROM a WHERE samples >= 8) SELECT src_ip, samples, median_s, round(cv, 9) AS cv, cv < 0.25 AND median_s >= 0.05 AS likely_periodic FROM c",
)
def interval_sampler(spark, sf_dir):
    return baseline.intervals(polling(spark, sf_dir)).select("src_ip", "samples", "median_s", F.round("cv", 9).alias("cv"), "likely_periodic")


#: Flows of the packet view by source and destination, of which twenty are sampled: more than that come to an interval.
_BY_PAIR = f"WITH packets AS (WITH {PACKETS} SELECT * REPLACE (0 AS src_port, 0 AS dst_port) FROM packets), d AS (SELECT *, ts_us - lag(ts_us) OVER w AS d, row_number() OVER w AS n FROM packets WINDOW w AS (PARTITION BY src_ip, dst_ip, transport ORDER BY packet_number)), "


@register(
    "admitted_intervals",
    _BY_PAIR + "q AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, transport ORDER BY packet_number) AS k FROM d WHERE n >= 12 AND d > 0), f AS (SELECT src_ip, dst_ip, transport FROM q GROUP BY ALL ORDER BY min(packet_number) LIMIT 20), "
    "a AS (SELECT src_ip, dst_ip, transport, count(*) AS samples, median(d) / 1e6 AS median_s, CAST(sum(d) AS HUGEINT) AS s, sum(CAST(d AS HUGEINT) * d) AS s2 FROM q JOIN f USING (src_ip, dst_ip, transport) WHERE k <= 5 GROUP BY ALL) "
    "SELECT src_ip, dst_ip, transport, samples, median_s, round(sqrt(greatest(CAST(samples * s2 - s * s AS DOUBLE), 0)) / samples / 1e6 / (median_s + 1e-9), 9) AS cv FROM a WHERE samples >= 2",
)
def admitted_intervals(spark, sf_dir):
    """Intervals of the first twenty of more flows, five for each."""
    rows = packets(spark, sf_dir).withColumns({"src_port": F.lit(0), "dst_port": F.lit(0)})
    return baseline.intervals(rows, most=5, least=2, tracked=20).select("src_ip", "dst_ip", "transport", "samples", "median_s", F.round("cv", 9).alias("cv"))


@register("command_sources", f"WITH {PACKETS}, b AS (SELECT fc AS function_code, src_ip, count(*) AS requests FROM packets WHERE dst_port = 502 GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY function_code ORDER BY requests DESC, src_ip) AS place FROM b) SELECT function_code, src_ip, requests, CAST(place AS INTEGER) AS place FROM p WHERE place <= 8")
def command_sources(spark, sf_dir):
    return baseline.command_sources(decode.modbus_requests(packets(spark, sf_dir)))


@register("baseline_diff", f"WITH {PACKETS}, p AS (SELECT *, packet_number * 20 < (SELECT max(packet_number) FROM packets) AS early FROM packets), e AS (SELECT src_ip AS ip, early FROM p UNION ALL SELECT dst_ip, early FROM p) SELECT ip, CASE WHEN bool_or(early) THEN 'gone' ELSE 'new' END AS change FROM e GROUP BY ip HAVING bool_and(early) OR NOT bool_or(early)")
def baseline_diff(spark, sf_dir):
    """Hosts of the first twentieth of the packets against those of the rest."""
    rows = packets(spark, sf_dir)
    told = rows.join(F.broadcast(rows.agg(F.max("packet_number").alias("_last"))), how="inner")  # one row: the aggregate
    early = F.col("packet_number") * 20 < F.col("_last")
    return baseline.compare(told.where(early), told.where(~early))


@register("new_pair", f"WITH {PACKETS}, f AS (SELECT least(src_ip, dst_ip) || '|' || greatest(src_ip, dst_ip) AS pair, 0 AS file_idx, min(packet_number) AS packet_number FROM packets GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY packet_number) AS k FROM f) SELECT pair, file_idx, packet_number FROM n WHERE k > 21")
def new_pair(spark, sf_dir):
    return baseline.new_pairs(packets(spark, sf_dir))


@register("port_lookup", f"WITH {PACKETS} SELECT dst_port AS port, CASE dst_port WHEN 502 THEN 'Modbus TCP' WHEN 102 THEN 'Siemens S7 (COTP/TPKT)' WHEN 20000 THEN 'DNP3' WHEN 44818 THEN 'EtherNet/IP (TCP)' WHEN 3389 THEN 'RDP' END AS service, count(*) AS packets FROM packets GROUP BY ALL")
def port_lookup(spark, sf_dir):
    known = ports(spark).select("port", "service")  # 24 rows: fixed values
    return packets(spark, sf_dir).groupBy(F.col("dst_port").alias("port")).agg(F.count("*").alias("packets")).join(F.broadcast(known), "port", "left")


@register("timeline_minutes", f"WITH {PACKETS} SELECT ts_us // 60000000 AS minute, count(*) AS packets FROM packets GROUP BY 1")
def timeline_minutes(spark, sf_dir):
    return packets(spark, sf_dir).groupBy(F.expr("ts_us div 60000000").alias("minute")).agg(F.count("*").alias("packets"))


@register("survey_uniques", f"WITH {PACKETS} SELECT count(*) AS packets, count(DISTINCT src_ip) AS sources, count(DISTINCT dst_ip) AS destinations, count(DISTINCT dst_port) AS ports FROM packets")
def survey_uniques(spark, sf_dir):
    return packets(spark, sf_dir).agg(F.count("*").alias("packets"), F.countDistinct("src_ip").alias("sources"), F.countDistinct("dst_ip").alias("destinations"), F.countDistinct("dst_port").alias("ports"))


@register("anonymize_ips", f"WITH {PACKETS}, h AS (SELECT packet_number, sha256(src_ip) AS s FROM packets) SELECT packet_number, concat_ws('.', '10', CAST(('0x' || s[1:2]) AS INTEGER), CAST(('0x' || s[3:4]) AS INTEGER), CAST(('0x' || s[5:6]) AS INTEGER)) AS src_ip FROM h")
def anonymize_ips(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_number", pseudonym(F.col("src_ip")).alias("src_ip"))


@register("subset_packets", f"WITH {PACKETS} SELECT packet_number, md5(unhex(printf('%04X00000006%02X%02X%04X%04X', txn, unit, fc, addr, qty))) AS digest FROM packets WHERE fc IN (5, 6, 15, 16) AND unit = 255")
def subset_packets(spark, sf_dir):
    """Packets that set off a rule."""
    keys = found(spark, sf_dir).select("file_idx", "packet_number").distinct()
    return packets(spark, sf_dir).join(keys, ["file_idx", "packet_number"], "left_semi").select("packet_number", F.md5("payload").alias("digest"))
