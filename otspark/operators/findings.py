"""Findings of a capture: flows that stand out, numbered findings of an audit, an exposure index.

Lists are DataFrames, ordered and cut where a report cuts them. The scalars that findings depend on are aggregated in a few
one-row jobs (metrics()); the findings themselves are a short list made of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otspark.functions.dims import ICS_APP_PORTS, IT_EDGE
from otspark.functions.net import is_private, is_public
from otspark.operators import cleartext, flows as flow_ops, survey

#: Rows of the lists of a report.
MOST = {"writes": 60, "s7": 60, "it": 80, "targets": 25, "reads": 40, "exceptions": 50, "crossing": 40, "valuable": 15, "writers": 40, "samples": 80}
#: SYN segments that stand out: alone, and with their share of segments with payload.
SYN_NOISE, SYN_SCAN, SYN_SHARE = 100, 200, 0.15
#: ARP frames and broadcast packets that are a storm.
ARP_STORM, BROADCAST_STORM = 5_000, 2_000

# fixed values: S7 services that change a device, protocols of valuable targets, ports of remote administration, weights of severities
S7_CRITICAL = {0x05: "writes variables", 0x1A: "program download", 0x1B: "program download", 0x1C: "program download", 0x1D: "program download", 0x28: "control of the run mode", 0x29: "control of the run mode"}
VALUABLE = ("Modbus", "S7", "DNP3", "OPC UA", "EtherNet/IP", "IEC 104", "Omron FINS", "GE SRTP")
ADMIN_PORTS = (22, 3389, 5900)
WEIGHTS = {"CRITICAL": 22, "HIGH": 12, "MEDIUM": 6, "LOW": 2, "INFO": 1}
MOST_EXPOSURE = 100

# fixed values: techniques of public attack matrices
TECHNIQUES = {
    "T0855": ("Unauthorized Command Message", "ICS"), "T0869": ("Standard Application Layer Protocol", "ICS"), "T0886": ("Exploitation of Remote Services", "ICS"), "T0846": ("Remote System Discovery", "ICS"),
    "T0807": ("Command-Line Interface", "ICS"), "T0822": ("External Remote Services", "ICS"), "T1071": ("Application Layer Protocol", "Enterprise"), "T1021": ("Remote Services", "Enterprise"), "T1040": ("Network Sniffing", "Enterprise"),
}


def busiest(rows: DataFrame, most: int) -> DataFrame:
    """The first rows by packets; ties by the first packet in processing order."""
    return rows.orderBy(F.desc("packet_count"), "first_file", "first_packet").limit(most)


def label() -> Column:
    return F.coalesce("ics_protocol", "transport")


# ---- lists ----


def write_flows(flows: DataFrame, most: int = MOST["writes"]) -> DataFrame:
    """Modbus flows that write, with what their codes may do."""
    rows = flows.where(F.size("modbus_write_fcs_seen") > 0).withColumn("meaning", flow_ops.write_meaning())
    return busiest(rows, most).select("flow_id", "src_ip", "dst_ip", "dst_port", F.col("modbus_write_fcs_seen").alias("codes"), "meaning", "packet_count")


def s7_critical_flows(flows: DataFrame, most: int = MOST["s7"]) -> DataFrame:
    """S7 flows that write, download or stop."""
    known = F.create_map(*[F.lit(x) for pair in S7_CRITICAL.items() for x in pair])
    hit = F.filter("s7_service_codes_seen", lambda c: c.isin(*S7_CRITICAL))
    rows = flows.withColumn("codes", hit).where(F.size("codes") > 0)
    return busiest(rows, most).select("flow_id", "src_ip", "dst_ip", "codes", F.array_distinct(F.transform("codes", lambda c: F.try_element_at(known, c))).alias("acts"), "packet_count")


def exception_flows(flows: DataFrame, most: int = MOST["exceptions"]) -> DataFrame:
    rows = flows.where("exception_count > 0").orderBy(F.desc("exception_count"), "first_file", "first_packet").limit(most)
    return rows.select("flow_id", "src_ip", "dst_ip", "dst_port", label().alias("protocol"), "exception_count")


def crossing_flows(flows: DataFrame, most: int = MOST["crossing"]) -> DataFrame:
    """The first flows between a private and a public address."""
    rows = flow_ops.cross_boundary(flows).orderBy("first_file", "first_packet").limit(most)
    return rows.select("src_ip", "dst_ip", "dst_port", label().alias("protocol"))


def valuable_targets(assets: DataFrame, most: int = MOST["valuable"]) -> DataFrame:
    """Of the assets with most risk, those that have any or speak an industrial protocol. The cut comes before the test."""
    first = assets.orderBy(F.desc("risk_score"), "first_seen_us", "ip_address").limit(most)
    rows = first.where((F.col("risk_score") > 0) | F.arrays_overlap("protocols_seen", F.array(*map(F.lit, VALUABLE))))
    return rows.select("ip_address", F.round("risk_score", 2).alias("risk_score"), "role", "protocols_seen", F.slice("risk_factors", 1, 8).alias("risk_factors"))


def write_sources(flows: DataFrame, most: int = MOST["writers"]) -> DataFrame:
    return flows.where("has_write_operations").select("src_ip").distinct().orderBy("src_ip").limit(most)


def many_target_sources(flows: DataFrame, assets: DataFrame, most: int = MOST["targets"], least: int = 4, shown: int = 12) -> DataFrame:
    """Addresses with many industrial peers, some of these, and their role."""
    asks = flows.where(F.col("dst_port").isin(*ICS_APP_PORTS)).select("src_ip", F.col("dst_ip").alias("peer"))
    answered = flows.where(F.col("src_port").isin(*ICS_APP_PORTS)).select(F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("peer"))
    rows = asks.unionByName(answered).distinct().groupBy("src_ip").agg(F.count("*").alias("peers"), F.array_sort(F.collect_set("peer")).alias("_peers")).where(F.col("peers") >= least)
    first = rows.orderBy(F.desc("peers"), "src_ip").limit(most).withColumn("sample", F.slice("_peers", 1, shown)).drop("_peers")
    return first.join(assets.select(F.col("ip_address").alias("src_ip"), "role"), "src_ip", "left").withColumn("role", F.coalesce("role", F.lit("UNKNOWN"))).orderBy(F.desc("peers"), "src_ip")


def write_samples(flows: DataFrame, most: int = MOST["samples"]) -> DataFrame:
    return busiest(flows.where("has_write_operations"), most).select("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "transport", "ics_protocol", "packet_count", "byte_count")


def public_assets(assets: DataFrame) -> DataFrame:
    return assets.where(is_public(F.col("ip_address"))).select("ip_address", "role", F.round("risk_score", 2).alias("risk_score"), "protocols_seen").orderBy("ip_address")


def admin_assets(assets: DataFrame) -> DataFrame:
    ports = F.array_intersect("open_ports", F.array(*map(F.lit, ADMIN_PORTS)))
    return assets.withColumn("open_ports", ports).where(F.size("open_ports") > 0).select("ip_address", "role", "open_ports").orderBy("ip_address")


# ---- scalars ----


@dataclass
class Metrics:
    """What findings depend on."""

    write_flows: int = 0
    writers: int = 0
    exception_flows: int = 0
    crossing: int = 0
    modbus_writes: int = 0
    s7_critical: int = 0
    it_flows: int = 0
    many_targets: int = 0
    admin_assets: int = 0
    public_assets: int = 0
    snmp_assets: int = 0
    critical_events: int = 0
    high_events: int = 0
    syn_only: int = 0
    with_payload: int = 0
    arp: int = 0
    broadcasts: int = 0
    marks: int = 0
    credentials: int = 0
    repeats: int = 0
    hints: dict | None = None
    observed: dict | None = None
    high_observed: int = 0

    @property
    def syn_share(self) -> float:
        return round(self.syn_only / max(self.with_payload, 1), 4)


def figures(flows: DataFrame, assets: DataFrame, events: DataFrame, packets: DataFrame) -> DataFrame:
    """One row with the columns of Metrics: aggregates of one row each over flows, assets, events and packets, put side by side."""
    src, dst = F.col("src_ip"), F.col("dst_ip")
    crossing = (is_private(src) & is_public(dst)) | (is_public(src) & is_private(dst))
    it = F.col("dst_port").isin(*IT_EDGE) | F.col("src_port").isin(*IT_EDGE)
    on = lambda *of: F.arrays_overlap("open_ports", F.array(*map(F.lit, of)))
    counts = lambda df, key, n: df.agg(F.map_from_entries(F.collect_list(F.struct(key, n))).alias("_m"))  # noqa: E731  a few kinds
    tcp = survey.tcp_behaviour(packets)
    seen = cleartext.observations(survey.on_network(packets)).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("sensitivity") == "HIGH").alias("high"))
    parts = [
        flows.agg(
            F.count_if("has_write_operations").alias("write_flows"), F.countDistinct(F.when(F.col("has_write_operations"), src)).alias("writers"), F.count_if(F.col("exception_count") > 0).alias("exception_flows"), F.count_if(crossing).alias("crossing"),
            F.count_if(F.size("modbus_write_fcs_seen") > 0).alias("modbus_writes"), F.count_if(F.exists("s7_service_codes_seen", lambda c: c.isin(*S7_CRITICAL))).alias("s7_critical"), F.count_if(it).alias("it_flows"),
        ),
        flow_ops.multi_target_sources(flows).agg(F.count("*").alias("many_targets")),
        assets.agg(F.count_if(on(*ADMIN_PORTS)).alias("admin_assets"), F.count_if(is_public(F.col("ip_address"))).alias("public_assets"), F.count_if(F.array_contains("protocols_seen", "SNMP") | on(161, 162)).alias("snmp_assets")),
        events.agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical_events"), F.count_if(F.col("severity") == "HIGH").alias("high_events")),
        tcp.select(F.col("syn_without_ack").alias("syn_only"), "with_payload"),
        packets.agg(F.count_if(F.col("eth_type") == 0x0806).alias("arp"), F.count_if(dst == "255.255.255.255").alias("broadcasts")),
        survey.tool_marks(packets).agg(F.coalesce(F.sum("packets"), F.lit(0)).alias("marks")),
        survey.credentials(packets).agg(F.count("*").alias("credentials")),
        survey.repeated_payloads(packets).agg(F.count("*").alias("repeats")),
        counts(survey.hints(packets), "hint", "packets").withColumnRenamed("_m", "hints"),
        seen.agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("observed"), F.coalesce(F.sum("high"), F.lit(0)).alias("high_observed")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), how="inner")  # one row each
    return out


def metrics(figures: DataFrame) -> Metrics:
    """The figures as plain values, by one job."""
    return Metrics(**figures.first().asDict())


# ---- findings ----


def technique(code: str) -> dict[str, str]:
    """Name, matrix and address of a technique; a part of one (T1.002) has a path of its own."""
    name, matrix = TECHNIQUES[code]
    return {"id": code, "name": name, "matrix": matrix, "url": "https://attack.mitre.org/techniques/" + code.replace(".", "/") + "/"}


def insights(m: Metrics) -> list[dict[str, str]]:
    """Short findings on flows and packets: severity, title, detail."""
    hints, observed = m.hints or {}, m.observed or {}
    risky = bool(set(cleartext.RISKY) & set(observed)) or m.high_observed > 0
    every = [
        (m.writers > 0, "HIGH", "Devices are written to", f"{m.writers} addresses sent requests that write"),
        (m.exception_flows > 0, "MEDIUM", "Devices refuse requests", f"{min(m.exception_flows, MOST['exceptions'])} flows hold exceptions"),
        (m.crossing > 0, "HIGH", "Private and public addresses talk", "flows cross the border of the private network"),
        (m.syn_only > SYN_NOISE, "LOW", "Many connection attempts", f"{m.syn_only} segments only ask for a connection"),
        (hints.get("telnet_port", 0) > 0, "CRITICAL", "Telnet is in use", "a remote shell that anyone on the way can read"),
        (hints.get("ftp_banner", 0) > 0, "MEDIUM", "FTP is in use", "files and passwords travel readably"),
        (bool(observed), "HIGH" if risky else "MEDIUM", "Industrial messages are readable", f"{sum(observed.values())} packets of {len(observed)} kinds"),
    ]
    return [{"severity": s, "title": t, "detail": d} for on, s, t, d in every if on]


def threats(m: Metrics) -> list[dict[str, str]]:
    """Findings of patterns that attackers leave; they stand before insights() in a report."""
    every = [
        (m.modbus_writes > 0, "CRITICAL", "Modbus writes", f"{m.modbus_writes} flows"),
        (m.s7_critical > 0, "CRITICAL", "S7 writes, downloads or stops", f"{m.s7_critical} flows"),
        (m.it_flows > 0, "HIGH", "Remote administration in the plant", f"{m.it_flows} flows on ports of office services"),
        (m.many_targets > 0, "HIGH", "One address asks many devices", f"{m.many_targets} addresses"),
        (m.syn_only > SYN_SCAN and m.syn_share > SYN_SHARE, "MEDIUM", "Connection attempts like a scan", f"{m.syn_only} attempts, {m.syn_share} of the segments with payload"),
        (m.marks > 0, "HIGH", "Marks of scanning tools", f"{m.marks} packets"),
        (m.credentials > 0, "HIGH", "Readable credentials", f"{m.credentials} samples"),
        (m.repeats > 0, "LOW", "Payloads that repeat", f"{m.repeats} beginnings"),
        (m.arp > ARP_STORM or m.broadcasts > BROADCAST_STORM, "MEDIUM", "Broadcasts in masses", f"{m.arp} ARP frames, {m.broadcasts} broadcasts"),
    ]
    return [{"severity": s, "title": t, "detail": d} for on, s, t, d in every if on]


def catalog() -> list[tuple[Column, Column | None, Column | str, str, str, list[str], str]]:
    """The audit's findings in order: whether one holds, of how many, severity, category, of what, techniques, what to do; columns of figures()."""
    n = F.col
    readable = F.when(F.exists(F.map_keys("observed"), lambda c: c.isin(*cleartext.RISKY)) | (n("high_observed") > 0), "HIGH").otherwise("MEDIUM")
    detection = F.when(n("critical_events") > 0, "HIGH").otherwise("MEDIUM")
    hint = lambda name: F.coalesce(F.try_element_at("hints", F.lit(name)), F.lit(0)) > 0
    of = lambda c, *rest: (c > 0, c, *rest)
    yes = lambda c, *rest: (c, None, *rest)
    return [
        of(n("write_flows"), "HIGH", "WRITE_SURFACE", "flows that write to devices", ["T0855"], "allow writes from named stations alone"),
        of(n("exception_flows"), "MEDIUM", "PROTOCOL_HEALTH", "flows with exceptions", ["T0869"], "find out which requests devices refuse"),
        of(n("crossing"), "HIGH", "SEGMENTATION", "flows between private and public addresses", ["T0886", "T0846"], "end such flows at a border station"),
        yes(hint("telnet_port"), "CRITICAL", "CLEARTEXT_REMOTE", "Telnet", ["T0807"], "replace Telnet by an encrypted shell"),
        yes(hint("ftp_banner"), "MEDIUM", "CLEARTEXT_REMOTE", "FTP", ["T0869"], "replace FTP by an encrypted transfer"),
        yes(hint("ssh_banner"), "LOW", "REMOTE_ACCESS_VISIBILITY", "SSH", ["T1021"], "compare with the list of allowed stations"),
        yes(hint("http_like"), "LOW", "IT_PROTOCOL_IN_OT", "web requests", ["T1071"], "find out what serves web pages"),
        yes(F.size("observed") > 0, readable, "CLEARTEXT_OT_PAYLOAD", "readable industrial messages", ["T1040", "T0869"], "encrypt or separate the way"),
        yes(n("syn_only") > SYN_NOISE, "LOW", "DISCOVERY_NOISE", "connection attempts", ["T0846"], "find who tries to connect"),
        of(n("admin_assets"), "HIGH", "REMOTE_ADMIN_EXPOSURE", "assets with ports of remote administration", ["T0822"], "put them behind a jump station"),
        of(n("public_assets"), "HIGH", "EXTERNAL_FACING", "assets with public addresses", ["T0886", "T0846"], "check what they are for"),
        of(n("snmp_assets"), "MEDIUM", "MANAGEMENT_PLANE", "assets that are managed by SNMP", ["T0869"], "use version 3 with encryption"),
        of(n("critical_events") + n("high_events"), detection, "DETECTION_ENGINE", "grave events of rules", ["T0855"], "look at the events"),
        of(n("modbus_writes"), "CRITICAL", "MODBUS_WRITE_TRAFFIC", "Modbus flows that write", ["T0855"], "compare with planned changes"),
        of(n("s7_critical"), "CRITICAL", "S7_CRITICAL_SERVICES", "S7 flows that write, download or stop", ["T0855"], "compare with planned changes"),
        of(n("it_flows"), "HIGH", "IT_REMOTE_IN_OT_CAPTURE", "flows on ports of office services", ["T0886", "T0846"], "separate office and plant"),
        of(n("many_targets"), "HIGH", "ICS_MULTI_TARGET_SOURCE", "addresses that ask many devices", ["T0846"], "find out whether they may"),
    ]


def _holding() -> Column:
    """The findings of the catalog that hold, in its order."""
    as_column = lambda s: F.lit(s) if isinstance(s, str) else s
    entry = lambda on, n, severity, category, what, codes, do: F.struct(
        on.alias("on"), as_column(severity).alias("severity"), F.lit(category).alias("category"), (F.lit(what) if n is None else F.concat(n.cast("string"), F.lit(f" {what}"))).alias("evidence"),
        F.array(*map(F.lit, codes)).alias("techniques"), F.lit(do).alias("remediation"),
    )
    return F.filter(F.array(*[entry(*x) for x in catalog()]), lambda x: x["on"])


def audit(figures: DataFrame) -> DataFrame:
    """A row for each finding that holds, numbered in the order of the catalog."""
    rows = figures.select(F.posexplode(_holding()).alias("_i", "_f"))
    return rows.select(F.format_string("AUD-%03d", F.col("_i") + 1).alias("finding_id"), "_f.severity", "_f.category", "_f.evidence", "_f.techniques", "_f.remediation")


def exposure(figures: DataFrame) -> DataFrame:
    """One row: weights of the findings' severities, a hundred at most."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    total = F.aggregate(_holding(), F.lit(0), lambda got, x: got + F.coalesce(F.try_element_at(weight, x["severity"]), F.lit(0)))
    return figures.select(F.least(F.lit(MOST_EXPOSURE), total).cast("long").alias("exposure"))


def summary_counts(m: Metrics, valuable: int) -> dict[str, int]:
    """Sizes of the lists as a report shows them, after their cut."""
    return {
        "endpoints_with_writes": m.writers, "flows_with_exceptions": min(m.exception_flows, MOST["exceptions"]), "cross_segment_flows_sampled": min(m.crossing, MOST["crossing"]), "high_value_targets_listed": valuable,
        "cleartext_ot_packet_hits": sum((m.observed or {}).values()), "modbus_write_flows": m.modbus_writes, "s7_critical_flows": m.s7_critical, "it_remote_protocol_flows": m.it_flows, "sequential_ics_sources": m.many_targets,
    }

