"""Queries over assets and rule events of the packet view, with its frames taken as Modbus."""

from __future__ import annotations

from pyspark.sql import functions as F

from otspark.operators import assets, rules, sketches
from otspark.plans.catalog import register
from otspark.plans.frame_queries import WRITES, modbus_frames
from otspark.sources.packets import PACKETS, packets

ASSETS = f"""ends AS (SELECT src_ip AS ip_address, dst_ip AS partner, src_port AS port, 1 AS sent, length, ts_us, NULL AS unit, CASE WHEN fc IN {WRITES} THEN fc END AS wfc FROM packets
  UNION ALL SELECT dst_ip, src_ip, dst_port, 0, 0, ts_us, unit, NULL FROM packets),
built AS (SELECT ip_address, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us, CAST(sum(sent) AS BIGINT) AS packet_count, CAST(sum(length) AS BIGINT) AS bytes_total,
    array_to_string(list_sort(list(DISTINCT port)), ',') AS open_ports, count(DISTINCT partner) AS partner_count, CAST(sum(sent) AS BIGINT) AS i, CAST(sum(1 - sent) AS BIGINT) AS r,
    bool_or(port IN (502, 102)) AS plc_port, count(DISTINCT CASE WHEN port = 3389 THEN port END) AS risky, count(DISTINCT unit) AS units, count(DISTINCT wfc) AS writes FROM ends GROUP BY ip_address),
scored AS (SELECT *, 2 * CAST(units > 0 AS INTEGER) + CAST(plc_port AS INTEGER) + CAST(r > 2 * i AS INTEGER) AS plc, CAST(i > r AS INTEGER) + CAST(partner_count >= 3 AS INTEGER) + 1 AS hmi,
    CAST(partner_count >= 5 AS INTEGER) + 2 * CAST(i > 3 * r AS INTEGER) AS eng FROM built),
assets AS (SELECT *, CASE WHEN plc >= 3 THEN 'PLC' WHEN hmi >= 3 THEN 'HMI' WHEN eng >= 3 THEN 'ENG_STATION' WHEN r > i THEN 'PLC' ELSE 'HMI' END AS role,
    CAST(least(10.0, writes * 1.0 + risky * 1.5 + CASE WHEN partner_count > 20 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS risk_score FROM scored)"""
WITH = f"WITH {PACKETS}, {ASSETS} "
EVENTS = f"WITH {PACKETS}, events_of AS (SELECT packet_number, ts_us, src_ip, dst_ip, 'MB-001' AS rule_id, 'HIGH' AS severity, fc, unit FROM packets WHERE fc IN (5, 6, 15, 16) AND unit = 255) "


def inventory(spark, sf_dir):
    return assets.inventory(packets(spark, sf_dir), modbus_frames(spark, sf_dir))


def found(spark, sf_dir, **options):
    return rules.events(modbus_frames(spark, sf_dir, typed=True), **options)


@register("asset_inventory", WITH + "SELECT ip_address, first_seen_us, last_seen_us, packet_count, bytes_total, open_ports, partner_count, i AS initiated_connections, r AS received_connections, units AS unit_count FROM assets")
def asset_inventory(spark, sf_dir):
    ports = F.array_join(F.col("open_ports").cast("array<string>"), ",").alias("open_ports")
    return inventory(spark, sf_dir).select("ip_address", "first_seen_us", "last_seen_us", "packet_count", "bytes_total", ports, "partner_count", "initiated_connections", "received_connections", F.size("modbus_unit_ids").cast("long").alias("unit_count"))


@register("asset_roles", WITH + "SELECT ip_address, role FROM assets")
def asset_roles(spark, sf_dir):
    return inventory(spark, sf_dir).select("ip_address", "role")


@register("asset_risk", WITH + "SELECT ip_address, risk_score FROM assets")
def asset_risk(spark, sf_dir):
    return inventory(spark, sf_dir).select("ip_address", "risk_score")


@register("asset_partners", f"WITH {PACKETS} SELECT ip_address, partner, count(*) AS packets FROM (SELECT src_ip AS ip_address, dst_ip AS partner FROM packets UNION ALL SELECT dst_ip, src_ip FROM packets) GROUP BY ALL")
def asset_partners(spark, sf_dir):
    return assets.asset_partners(packets(spark, sf_dir))


@register("role_counts", WITH + "SELECT role, count(*) AS assets, CAST(count(CASE WHEN risk_score > 0 THEN 1 END) AS BIGINT) AS with_risk FROM assets GROUP BY role")
def role_counts(spark, sf_dir):
    return assets.role_counts(inventory(spark, sf_dir))


@register(
    "ot_signals",
    WITH + "SELECT ip_address, concat_ws(';', 'ics_protocol:Modbus', CASE ip_address WHEN '192.168.1.10' THEN 'ics_port:502:Modbus TCP' WHEN '192.168.1.11' THEN 'ics_port:102:Siemens S7 (COTP/TPKT)' WHEN '192.168.2.20' THEN 'ics_port:20000:DNP3' WHEN '192.168.2.21' THEN 'ics_port:44818:EtherNet/IP (TCP)' END, CASE WHEN units > 0 THEN 'field_hint:modbus_unit_ids' END, 'inferred_role:' || role) AS signals FROM assets",
)
def ot_signals(spark, sf_dir):
    return assets.ot_assets(inventory(spark, sf_dir)).select("ip_address", F.array_join("ot_signals", ";").alias("signals"))


@register("rules_eval", EVENTS + "SELECT packet_number, rule_id, severity, fc AS function_code, CAST(unit AS VARCHAR) AS unit_id FROM events_of")
def rules_eval(spark, sf_dir):
    return found(spark, sf_dir).select("packet_number", "rule_id", "severity", "function_code", F.try_element_at("evidence", F.lit("unit_id")).alias("unit_id"))


@register("severity_filter", EVENTS + "SELECT severity, count(*) AS events FROM events_of GROUP BY severity")
def severity_filter(spark, sf_dir):
    return found(spark, sf_dir, min_severity="HIGH").groupBy("severity").agg(F.count("*").alias("events"))


_RULE = next(r for r in rules.RULES if r.id == "MB-001")


@register("event_details", EVENTS + f"SELECT packet_number, rule_id, '{_RULE.description} — ' || src_ip || ' → ' || dst_ip || ' (Modbus, FC=0x' || printf('%02X', fc) || ')' AS description, '{','.join(_RULE.tags)}' AS tags, src_ip || ',' || dst_ip AS affected_assets, printf('0x%02X', fc) AS code, dst_ip AS evidence_target FROM events_of")
def event_details(spark, sf_dir):
    """What an event says in words, whom it concerns and what it shows."""
    of = lambda k: F.try_element_at("evidence", F.lit(k))
    return found(spark, sf_dir).select("packet_number", "rule_id", "description", F.array_join("tags", ",").alias("tags"), F.array_join("affected_assets", ",").alias("affected_assets"), of("function_code").alias("code"), of("dst_ip").alias("evidence_target"))


@register("event_timeline", EVENTS + "SELECT row_number() OVER (ORDER BY ts_us, rule_id, packet_number) AS place, packet_number, rule_id FROM events_of")
def event_timeline(spark, sf_dir):
    """All events, numbered in their order."""
    told = found(spark, sf_dir).select("ts_us", "rule_id", "packet_number")
    return sketches.numbered(told, [F.asc_nulls_first("ts_us"), F.col("rule_id"), F.col("packet_number")]).select("place", "packet_number", "rule_id")


@register("rule_count_deltas", EVENTS + ", half AS (SELECT max(packet_number) AS last FROM packets) SELECT rule_id, CAST(count(CASE WHEN packet_number * 2 < last THEN 1 END) AS BIGINT) AS before, CAST(count(CASE WHEN packet_number * 2 >= last THEN 1 END) AS BIGINT) AS now, CAST(count(CASE WHEN packet_number * 2 >= last THEN 1 END) - count(CASE WHEN packet_number * 2 < last THEN 1 END) AS BIGINT) AS delta FROM events_of, half GROUP BY rule_id")
def rule_count_deltas(spark, sf_dir):
    """Events by rule in the two halves of the packets."""
    last = packets(spark, sf_dir).agg(F.max("packet_number").alias("_last"))
    told = found(spark, sf_dir).join(F.broadcast(last), how="inner")  # one row: the aggregate
    early = F.col("packet_number") * 2 < F.col("_last")
    return rules.rule_deltas(told.where(early), told.where(~early))
