"""Assets: one row per address with its ports, partners, protocols, role, risk and signs of industrial use.

Ports, unit ids, protocols and risk factors of an address are sets of bounded size and are held as arrays; its partners
are counted, and asset_partners() has them as rows, so that a hub of many partners is never gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otspark.functions.dims import OT_PROTOCOLS, OT_ROLES, PORTS, RISKY_PORTS, ROLE_PROTOCOLS, VENDORS
from otspark.functions.net import ip_number, oui
from otspark.sources.packets import ORDER

#: Partners over which an address counts as risky, and the most that risk can be.
MANY_PARTNERS, MOST_RISK = 20, 10.0
SERVICES = {p: name for p, _, name, _, _, _ in PORTS}
ICS_SERVICES = {p: name for p, _, name, _, ics, _ in PORTS if ics}


def literal_map(of: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])


def endpoints(packets: DataFrame) -> DataFrame:
    """Each packet as its source and as its destination see it; the source comes first in the order."""

    def side(me: str, other: str, sent: bool) -> Column:
        mac = F.col(f"{me}_mac") if f"{me}_mac" in packets.columns else F.lit(None).cast("string")
        return F.struct(F.col(f"{me}_ip").alias("ip_address"), mac.alias("mac"), F.col(f"{other}_ip").alias("partner"), F.col(f"{me}_port").alias("port"), F.lit(sent).alias("sent"))

    both = F.posexplode(F.array(side("src", "dst", True), side("dst", "src", False))).alias("_side", "_e")
    return packets.select(*ORDER, "ts_us", "length", both).select(*ORDER, "ts_us", "length", "_side", "_e.*").where("ip_address is not null")


def asset_partners(packets: DataFrame) -> DataFrame:
    """Pairs of an address and one that it sent to or received from, with the packets of both ways."""
    return endpoints(packets).where("partner is not null").groupBy("ip_address", "partner").agg(F.count("*").alias("packets"))


def asset_build(packets: DataFrame) -> DataFrame:
    """Counts, ports and hardware of each address: the last MAC address, the vendor of the first one that has any."""
    order = [*ORDER, "_side"]
    told = endpoints(packets).withColumn("_vendor", F.try_element_at(literal_map(dict(VENDORS)), oui(F.col("mac"))))
    with_partner = F.col("partner").isNotNull()
    return told.groupBy("ip_address").agg(
        F.max(F.when(F.col("mac").isNotNull(), F.struct(*order, "mac")))["mac"].alias("mac_address"),
        F.min(F.when(F.col("_vendor").isNotNull(), F.struct(*order, "_vendor")))["_vendor"].alias("vendor"),
        F.min("ts_us").alias("first_seen_us"),
        F.max("ts_us").alias("last_seen_us"),
        F.count_if("sent").alias("packet_count"),
        F.coalesce(F.sum(F.when(F.col("sent"), F.col("length"))), F.lit(0)).alias("bytes_total"),
        F.array_sort(F.collect_set(F.when(F.col("port") != 0, F.col("port")))).alias("open_ports"),
        F.countDistinct("partner").alias("partner_count"),
        F.count_if(F.col("sent") & with_partner).alias("initiated_connections"),
        F.count_if(~F.col("sent") & with_partner).alias("received_connections"),
    )


def frame_facts(frames: DataFrame) -> DataFrame:
    """What frames say of an address: protocols of both ends, unit ids of the one asked, the last DNP3 address, risky acts of the sender."""
    value = lambda k: F.try_element_at("fields", F.lit(k)).try_cast("int")
    act = F.when(F.col("is_control_command"), F.struct(F.concat(F.lit("control: "), F.coalesce("function_name", F.lit(""))).alias("factor"), F.lit(2.0).alias("weight")))
    act = act.when(F.col("is_write_operation"), F.struct(F.concat(F.lit("write: "), F.coalesce("function_name", F.lit(""))).alias("factor"), F.lit(1.0).alias("weight")))
    modbus, dnp3 = F.col("protocol") == "Modbus", F.col("protocol") == "DNP3"
    sender = F.struct(F.col("src_ip").alias("ip_address"), F.lit(None).cast("int").alias("unit"), F.when(dnp3, value("dl_source")).alias("dnp3"), act.alias("act"))
    asked = F.struct(F.col("dst_ip").alias("ip_address"), F.when(modbus, value("unit_id")).alias("unit"), F.when(dnp3, value("dl_destination")).alias("dnp3"), F.lit(None).cast("struct<factor:string,weight:double>").alias("act"))
    both = frames.select(*ORDER, "protocol", F.posexplode(F.array(asked, sender)).alias("_side", "_e")).select(*ORDER, "protocol", "_side", "_e.*")
    return both.where("ip_address is not null and ip_address != ''").groupBy("ip_address").agg(
        F.array_sort(F.collect_set("protocol")).alias("protocols_seen"),
        F.array_sort(F.collect_set("unit")).alias("modbus_unit_ids"),
        F.max(F.when(F.col("dnp3").isNotNull(), F.struct(*ORDER, "_side", "dnp3")))["dnp3"].alias("dnp3_address"),
        F.collect_set("act").alias("_acts"),
    )


def role(protocols: Column, ports: Column, units: Column, dnp3: Column, partners: Column, sent: Column, received: Column) -> Column:
    """The likely role of a device; the first that fits counts."""
    has = lambda *names: F.arrays_overlap(protocols, F.array(*map(F.lit, names)))
    port = lambda *of: F.arrays_overlap(ports, F.array(*map(F.lit, of)))
    points = lambda test, n=1: F.when(test, n).otherwise(0)
    plc = points(has("Modbus") & (F.size(units) > 0), 2) + points(port(502, 102)) + points(received > sent * 2)
    hmi = points(sent > received) + points(partners >= 3) + points(has("Modbus", "S7", "OPC UA", "BACnet", "MQTT")) + points(port(80, 443))
    eng = points(has("S7", "EtherNet/IP")) + points(partners >= 5) + points(sent > received * 3, 2)
    return (
        F.when(plc >= 3, "PLC")
        .when(has("DNP3") & dnp3.isNotNull() & (received > sent), "RTU")
        .when(hmi >= 3, "HMI")
        .when(eng >= 3, "ENG_STATION")
        .when(port(1433, 3306) & (has("OPC UA") | (partners >= 5)), "HISTORIAN")
        .when(has("IEC 104") & (sent > received), "SCADA_SERVER")
        .when(F.size(protocols) >= 3, "GATEWAY")
        .when(has(*ROLE_PROTOCOLS) & (received > sent), "PLC")
        .when(has(*ROLE_PROTOCOLS), "HMI")
        .otherwise("UNKNOWN")
    )


def inventory(packets: DataFrame, frames: DataFrame) -> DataFrame:
    """Assets with what their frames say, their role, risk factors and risk score."""
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    built = asset_build(packets)
    out = built.join(frame_facts(frames), "ip_address", "left").select(*built.columns, none("protocols_seen", "string"), none("modbus_unit_ids", "int"), "dnp3_address", none("_acts", "struct<factor:string,weight:double>"))
    out = out.withColumn("role", role(*map(F.col, ("protocols_seen", "open_ports", "modbus_unit_ids", "dnp3_address", "partner_count", "initiated_connections", "received_connections"))))
    factor = lambda text, weight: F.struct(text.alias("factor"), F.lit(weight).alias("weight"))
    service = lambda p: F.coalesce(F.try_element_at(literal_map(SERVICES), p), F.concat(F.lit("port "), p.cast("string")))
    risky = F.transform(F.array_intersect("open_ports", F.array(*map(F.lit, RISKY_PORTS))), lambda p: factor(F.concat(F.lit("risky service: "), service(p)), 1.5))
    shared = F.array_intersect("protocols_seen", F.array(*map(F.lit, ROLE_PROTOCOLS)))
    more = F.array_compact(
        F.array(
            F.when(F.col("partner_count") > MANY_PARTNERS, factor(F.concat(F.lit("many partners: "), F.col("partner_count").cast("string")), 1.0)),
            F.when(F.size(shared) >= 3, factor(F.concat(F.lit("several industrial protocols: "), F.array_join(shared, ", ")), 0.5)),
        )
    )
    out = out.withColumn("_acts", F.concat(F.array_sort("_acts"), risky, more))
    score = F.least(F.lit(MOST_RISK), F.aggregate("_acts", F.lit(0.0), lambda got, a: got + a["weight"]))
    return out.select(*[c for c in out.columns if c != "_acts"], score.alias("risk_score"), F.transform("_acts", lambda a: a["factor"]).alias("risk_factors"))


def ot_signals() -> Column:
    """Why an asset of the inventory counts as industrial: protocols, ports, field hints, role, in that order."""
    names = literal_map(ICS_SERVICES)
    of = lambda *c: F.array_compact(F.array(*c))
    return F.concat(
        F.transform(F.filter("protocols_seen", lambda p: p.isin(*OT_PROTOCOLS)), lambda p: F.concat(F.lit("ics_protocol:"), p)),
        F.transform(F.filter("open_ports", lambda p: p.isin(*ICS_SERVICES)), lambda p: F.concat(F.lit("ics_port:"), p.cast("string"), F.lit(":"), F.try_element_at(names, p))),
        of(F.when(F.size("modbus_unit_ids") > 0, "field_hint:modbus_unit_ids"), F.when(F.col("dnp3_address").isNotNull(), "field_hint:dnp3_address"), F.when(F.col("role").isin(*OT_ROLES), F.concat(F.lit("inferred_role:"), F.col("role")))),
    )


def ot_assets(assets: DataFrame) -> DataFrame:
    """Assets with any sign of industrial use, by address as a number; what is no IPv4 address comes last."""
    return assets.withColumn("ot_signals", ot_signals()).where(F.size("ot_signals") > 0).orderBy(ip_number(F.col("ip_address")).asc_nulls_last(), "ip_address")


def protocol_hosts(assets: DataFrame) -> DataFrame:
    """protocol, hosts: addresses by what they speak."""
    return assets.select(F.explode("protocols_seen").alias("protocol")).groupBy("protocol").agg(F.count("*").alias("hosts"))


def active(assets: DataFrame) -> DataFrame:
    """Seconds between the first and the last packet of each asset."""
    return assets.select("ip_address", ((F.col("last_seen_us") - F.col("first_seen_us")) / 1e6).alias("active_seconds"))


def role_counts(assets: DataFrame) -> DataFrame:
    return assets.groupBy("role").agg(F.count("*").alias("assets"), F.count_if(F.col("risk_score") > 0).alias("with_risk"))
