"""Queries over flows of the packet and polling views."""

from __future__ import annotations

from pyspark.sql import functions as F

from otspark.operators import flows, views
from otspark.plans.catalog import register
from otspark.sources.packets import PACKETS, POLLING, packets, polling

KEYS = "src_ip, dst_ip, src_port, dst_port, transport"


def std_sql(n: str, s: str, s2: str) -> str:
    return f"CASE WHEN {n} > 1 THEN sqrt(greatest(CAST(CAST({n} AS HUGEINT) * {s2} - CAST({s} AS HUGEINT) * {s} AS DOUBLE), 0.0) / (CAST({n} AS DOUBLE) * ({n} - 1))) ELSE 0.0 END"


#: Flows in DuckDB, behind a view named packets.
FLOWS = f"""gaps AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY {KEYS} ORDER BY file_idx, packet_number) AS gap FROM packets),
agg AS (SELECT {KEYS}, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count, min(ts_us) AS start_us, max(ts_us) AS end_us,
    sum(CAST(length AS HUGEINT) * length) AS l2, count(CASE WHEN gap > 0 AND gap < 3600000000 THEN 1 END) AS ipt_count,
    coalesce(sum(CASE WHEN gap > 0 AND gap < 3600000000 THEN gap END), 0) AS i, coalesce(sum(CASE WHEN gap > 0 AND gap < 3600000000 THEN CAST(gap AS HUGEINT) * gap END), 0) AS i2,
    min(packet_number) AS first_packet FROM gaps GROUP BY ALL),
flows AS (SELECT substring(md5(src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port || '/' || transport), 1, 12) AS flow_id, {KEYS},
    packet_count, byte_count, start_us, end_us, (end_us - start_us) / 1e6 AS duration_seconds,
    CASE WHEN end_us > start_us THEN packet_count / ((end_us - start_us) / 1e6) ELSE 0.0 END AS packets_per_second,
    CASE WHEN end_us > start_us THEN byte_count / ((end_us - start_us) / 1e6) ELSE 0.0 END AS bytes_per_second,
    CAST(byte_count AS DOUBLE) / packet_count AS avg_packet_size, {std_sql("packet_count", "byte_count", "l2")} AS packet_length_std,
    ipt_count, CASE WHEN ipt_count > 0 THEN CAST(i AS DOUBLE) / ipt_count / 1e6 ELSE 0.0 END AS avg_inter_packet_time,
    {std_sql("ipt_count", "i", "i2")} / 1e6 AS jitter, 0 AS first_file, first_packet FROM agg)"""

WITH = f"WITH {PACKETS}, {FLOWS} "
WITH_POLLING = f"WITH {POLLING}, {FLOWS} "
MATRIX = "matrix AS (SELECT src_ip, dst_ip, CAST(sum(packet_count) AS BIGINT) AS packets FROM flows GROUP BY ALL)"


def built(spark, sf_dir):
    return flows.flow_build(packets(spark, sf_dir))


def built_polling(spark, sf_dir):
    return flows.flow_build(polling(spark, sf_dir))


@register("flow_build", WITH + "SELECT flow_id, src_ip, dst_ip, src_port, dst_port, transport, packet_count, byte_count, start_us, end_us, ipt_count, first_packet FROM flows")
def flow_build(spark, sf_dir):
    return built(spark, sf_dir).select("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "transport", "packet_count", "byte_count", "start_us", "end_us", "ipt_count", "first_packet")


@register("flow_rates", WITH + "SELECT flow_id, duration_seconds, packets_per_second, bytes_per_second, avg_packet_size, packet_length_std, avg_inter_packet_time, jitter FROM flows")
def flow_rates(spark, sf_dir):
    return built(spark, sf_dir).select("flow_id", "duration_seconds", "packets_per_second", "bytes_per_second", "avg_packet_size", "packet_length_std", "avg_inter_packet_time", "jitter")


@register("inter_packet_time", f"WITH {PACKETS}, gaps AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY {KEYS} ORDER BY file_idx, packet_number) AS gap FROM packets) SELECT packet_number, CASE WHEN gap > 0 AND gap < 3600000000 THEN gap END AS ipt_us FROM gaps")
def inter_packet_time(spark, sf_dir):
    return flows.with_gaps(packets(spark, sf_dir)).select("packet_number", "ipt_us")


#: Every second packet belongs to one flow.
HOT = f"WITH packets AS (WITH {PACKETS} SELECT * REPLACE (" + ", ".join(f"CASE WHEN packet_number % 2 = 0 THEN {v} ELSE {c} END AS {c}" for c, v in {"src_ip": "'10.99.0.1'", "dst_ip": "'10.99.0.2'", "src_port": "1", "dst_port": "502", "transport": "'TCP'"}.items()) + f") FROM packets), {FLOWS} "


def hot(spark, sf_dir):
    one = {"src_ip": "10.99.0.1", "dst_ip": "10.99.0.2", "src_port": 1, "dst_port": 502, "transport": "TCP"}
    return packets(spark, sf_dir).withColumns({c: F.when(F.col("packet_number") % 2 == 0, v).otherwise(F.col(c)) for c, v in one.items()})


@register("hot_flow_rates", HOT + "SELECT flow_id, packet_count, start_us, end_us, packet_length_std, ipt_count, avg_inter_packet_time, jitter, first_packet FROM flows")
def hot_flow_rates(spark, sf_dir):
    """Flows of which one has half of all packets."""
    return flows.flow_build(hot(spark, sf_dir)).select("flow_id", "packet_count", "start_us", "end_us", "packet_length_std", "ipt_count", "avg_inter_packet_time", "jitter", "first_packet")


@register("hot_inter_packet_time", HOT + "SELECT packet_number, src_port, CASE WHEN gap > 0 AND gap < 3600000000 THEN gap END AS ipt_us FROM gaps")
def hot_inter_packet_time(spark, sf_dir):
    return flows.with_gaps(hot(spark, sf_dir)).select("packet_number", "src_port", "ipt_us")


@register("top_talkers", WITH + "SELECT src_ip, CAST(sum(packet_count) AS BIGINT) AS packets FROM flows GROUP BY src_ip ORDER BY packets DESC, min(first_packet) LIMIT 25")
def top_talkers(spark, sf_dir):
    return flows.top_talkers(built(spark, sf_dir))


@register("top_flows", WITH + "SELECT flow_id, src_ip, dst_ip, packet_count, byte_count FROM flows ORDER BY packet_count DESC, first_packet LIMIT 40")
def top_flows(spark, sf_dir):
    return flows.top_flows(built(spark, sf_dir)).select("flow_id", "src_ip", "dst_ip", "packet_count", "byte_count")


@register("comm_matrix", WITH + f", {MATRIX} SELECT * FROM matrix")
def comm_matrix(spark, sf_dir):
    return flows.comm_matrix(built(spark, sf_dir))


@register(
    "matrix_trim",
    WITH + f", {MATRIX}, ends AS (SELECT src_ip AS ip, packets FROM matrix UNION ALL SELECT dst_ip, packets FROM matrix), keep AS (SELECT ip FROM ends GROUP BY ip ORDER BY sum(packets) DESC, ip LIMIT 30) SELECT * FROM matrix WHERE src_ip IN (SELECT ip FROM keep) AND dst_ip IN (SELECT ip FROM keep)",
)
def matrix_trim(spark, sf_dir):
    return flows.matrix_trim(flows.comm_matrix(built(spark, sf_dir)), 30)


@register("temporal_heatmap", WITH + "SELECT CAST(start_us // 60000000 * 60 AS BIGINT) AS bucket, CAST(sum(packet_count) AS BIGINT) AS packets FROM flows GROUP BY ALL")
def temporal_heatmap(spark, sf_dir):
    return flows.temporal_heatmap(built(spark, sf_dir), 60)


@register("flow_stats", WITH + "SELECT count(*) AS flows, CAST(sum(packet_count) AS BIGINT) AS packets, CAST(sum(byte_count) AS BIGINT) AS bytes, count(DISTINCT src_ip) AS sources, count(DISTINCT dst_ip) AS destinations FROM flows")
def flow_stats(spark, sf_dir):
    return flows.flow_stats(built(spark, sf_dir))


@register("periodic_flows", WITH_POLLING + "SELECT flow_id, src_ip, ipt_count, jitter / avg_inter_packet_time AS cv FROM flows WHERE packet_count >= 10 AND ipt_count >= 9 AND avg_inter_packet_time > 0 AND jitter / avg_inter_packet_time < 0.3")
def periodic_flows(spark, sf_dir):
    return flows.periodic_flows(built_polling(spark, sf_dir)).select("flow_id", "src_ip", "ipt_count", "cv")


@register("timing_irregular", WITH_POLLING + "SELECT flow_id, src_ip, jitter / avg_inter_packet_time AS cv FROM flows WHERE ipt_count >= 20 AND packet_count > 40 AND avg_inter_packet_time > 0 AND jitter / avg_inter_packet_time > 2.5")
def timing_irregular(spark, sf_dir):
    return flows.timing_irregular(built_polling(spark, sf_dir)).select("flow_id", "src_ip", "cv")


@register("size_dispersion", WITH_POLLING + "SELECT flow_id, src_ip, packet_length_std / avg_packet_size AS cv FROM flows WHERE packet_count > 30 AND packet_length_std / avg_packet_size > 0.85")
def size_dispersion(spark, sf_dir):
    return flows.size_dispersion(built_polling(spark, sf_dir)).select("flow_id", "src_ip", "cv")


@register("comm_pivot", WITH + f", {MATRIX}, first AS (SELECT DISTINCT src_ip FROM matrix ORDER BY src_ip LIMIT 35) SELECT src_ip, " + ", ".join(f"coalesce(CAST(sum(CASE WHEN dst_ip = '{ip}' THEN packets END) AS BIGINT), 0) AS \"{ip}\"" for ip in ("192.168.1.10", "192.168.1.11", "192.168.2.20", "192.168.2.21", "8.8.8.8")) + " FROM matrix JOIN first USING (src_ip) GROUP BY src_ip")
def comm_pivot(spark, sf_dir):
    """The operator finds the destinations; the SQL names those of the view."""
    return views.pivot(built(spark, sf_dir))
