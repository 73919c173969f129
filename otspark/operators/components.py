"""Parts of a plant that assets stand for: a catalog, tags by role, protocol and port, and what of the catalog was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: id, name, layer and Purdue levels of the parts of a plant
CATALOG = [
    ("physical_process", "Physical process", "process", "0"),
    ("field_device", "Field device", "field", "0"),
    ("smart_field_instrument", "Smart field instrument", "field", "0,1"),
    ("remote_io", "Remote I/O", "control", "1"),
    ("plc_pac", "PLC / PAC", "control", "1"),
    ("rtu", "RTU", "control", "1,2"),
    ("dcs_controller", "DCS controller", "control", "1,2"),
    ("sis_safety_controller", "SIS / safety controller", "control", "1"),
    ("hmi_station", "HMI", "supervisory", "2"),
    ("scada_server", "SCADA server", "supervisory", "2,3"),
    ("batch_engine", "Batch / sequence engine", "supervisory", "2"),
    ("historian", "Historian", "operations", "3"),
    ("mes_connector", "MES / plant IT interface", "operations", "3"),
    ("engineering_workstation", "Engineering workstation (EWS)", "operations", "3"),
    ("operator_client", "Operator client / thin client", "supervisory", "2,3"),
    ("protocol_gateway", "Protocol gateway", "boundary", "2,3"),
    ("iiot_edge_mqtt", "IIoT / MQTT edge", "boundary", "2,3,4"),
    ("industrial_dmz", "Industrial DMZ", "security", "3.5"),
    ("industrial_firewall", "Industrial firewall", "security", "3"),
    ("network_switch_l2", "Managed L2 switch", "network", "1,2,3"),
    ("network_router_l3", "L3 router", "network", "2,3,4"),
    ("wireless_gateway", "Wireless / IIoT gateway", "network", "1,2"),
    ("domain_identity", "Domain / identity services", "enterprise_bridge", "3,4,5"),
    ("database_server", "Database server", "operations", "3"),
    ("ntp_time", "Time synchronization (NTP/SNTP)", "infrastructure", "1,2,3"),
    ("remote_access", "Remote access", "security", "3,4,5"),
    ("snmp_management", "SNMP / NMS", "operations", "3"),
    ("building_automation", "Building automation (BMS)", "building", "2,3"),
    ("ups_electrical_monitoring", "Electrical / UPS monitoring", "infrastructure", "1,2"),
]
# fixed values: tags of roles, protocols and ports
OF_ROLE = {
    "PLC": ("plc_pac",), "HMI": ("hmi_station", "operator_client"), "HISTORIAN": ("historian",), "ENG_STATION": ("engineering_workstation",), "RTU": ("rtu",),
    "GATEWAY": ("protocol_gateway",), "SWITCH": ("network_switch_l2",), "SCADA_SERVER": ("scada_server",), "IO_MODULE": ("remote_io",),
}
OF_PROTOCOL = {"MQTT": "iiot_edge_mqtt", "SNMP": "snmp_management", "BACnet": "building_automation"}
OF_PORTS = [
    ((502, 102, 44818), "plc_pac"), ((20000, 2404), "rtu"), ((4840,), "scada_server"), ((4840,), "operator_client"), ((1883, 8883, 8884, 9001), "iiot_edge_mqtt"), ((47808,), "building_automation"),
    ((161, 162), "snmp_management"), ((1433, 3306, 5432), "database_server"), ((123,), "ntp_time"), ((22, 3389, 5900), "remote_access"), ((88, 389, 636), "domain_identity"),
]
CONTROLLER_PROTOCOLS = ("Modbus", "S7", "DNP3", "OPC UA", "EtherNet/IP", "IEC 104")
#: Stations on these ports that mostly ask are masters.
MASTER_PORTS = (20000, 2404)


def catalog(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(CATALOG, "component_id string, name string, layer string, levels string")
    return rows.withColumn("levels", F.split("levels", ","))


def tags() -> Column:
    """Sorted component ids of an asset of the inventory."""
    role, protocols, ports = F.col("role"), F.col("protocols_seen"), F.col("open_ports")
    on = lambda of: F.arrays_overlap(ports, F.array(*map(F.lit, of)))
    when = lambda test, tag: F.when(F.coalesce(test, F.lit(False)), F.lit(tag))
    found = [when(role == r, t) for r, names in OF_ROLE.items() for t in names]
    found += [when(F.array_contains(protocols, p), t) for p, t in OF_PROTOCOL.items()]
    found += [when(on(of), t) for of, t in OF_PORTS]
    found.append(when(on(MASTER_PORTS) & (F.col("initiated_connections") > F.col("received_connections")), "scada_server"))
    every = F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    controller = F.arrays_overlap(protocols, F.array(*map(F.lit, CONTROLLER_PROTOCOLS)))
    return F.when((F.size(every) == 0) & (role == "UNKNOWN") & F.coalesce(controller, F.lit(False)), F.array(F.lit("plc_pac"))).otherwise(every)


def tagged(assets: DataFrame) -> DataFrame:
    """The inventory with component_tags and labels (id and catalog name)."""
    names = F.create_map(*[F.lit(x) for c in CATALOG for x in c[:2]])
    out = assets.withColumn("component_tags", tags())
    return out.withColumn("component_labels", F.transform("component_tags", lambda t: F.concat(t, F.lit(": "), F.coalesce(F.try_element_at(names, t), t))))


def tag_counts(assets: DataFrame) -> DataFrame:
    """component_id, assets: the most frequent first, ties by id."""
    return tagged(assets).select(F.explode("component_tags").alias("component_id")).groupBy("component_id").agg(F.count("*").alias("assets")).orderBy(F.desc("assets"), "component_id")


def not_seen(assets: DataFrame) -> DataFrame:
    """Catalog rows that no asset stands for."""
    return catalog(assets.sparkSession).join(F.broadcast(tag_counts(assets)), "component_id", "left_anti").orderBy("component_id")


def summary(assets: DataFrame) -> DataFrame:
    """One row: assets with tags, kinds seen, kinds in the catalog."""
    rows = tagged(assets).agg(F.count_if(F.size("component_tags") > 0).alias("assets_with_tags"), F.size(F.array_distinct(F.flatten(F.collect_set("component_tags")))).alias("kinds_seen"))
    return rows.withColumn("kinds_in_catalog", F.lit(len(CATALOG)))
