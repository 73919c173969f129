"""Queries over decoders, components, findings, comparison, privacy and report views."""

from __future__ import annotations

from pyspark.sql import functions as F

from otspark.functions import codes
from otspark.operators import assets, baseline, bundle, compare, components, decode, findings, flows, graph, guess, privacy, rules, views
from otspark.plans.asset_queries import ASSETS, inventory
from otspark.plans.catalog import register
from otspark.plans.flow_queries import KEYS
from otspark.plans.frame_queries import MODBUS, WRITES, modbus_frames
from otspark.sources.packets import PACKETS, TALK_SQL, WIRE, WIRE_SQL, packets, talk, wire

#: A field of each protocol's frames that the packet's number decides.
FIELDS = {
    "s7": ("s7_pdu_reference", "n % 65536"), "dnp3": ("dl_destination", "n % 1000"), "opcua": ("secure_channel_id", "n % 65536"), "enip": ("session_handle", "n % 65536"), "iec104": ("send_sequence", "n % 1000"), "bacnet": ("service_choice", "c"),
    "mqtt": ("topic", "'t/' || (n % 10)"), "snmp": ("community_len", "4"), "omron_fins": ("fins_command_word", "c"), "ge_srtp": ("srtp_sequence", "n % 65536"),
}


def _decoder(k: int, slug: str):
    field, value = FIELDS[slug]
    writes, diagnostics, controls, _ = codes.SETS[slug]
    if slug == "bacnet":
        writes, diagnostics, controls = codes.BACNET_WRITES, codes.BACNET_DIAGNOSTICS, codes.BACNET_CONTROLS
    among = lambda of: f"c IN ({', '.join(map(str, of))})" if of else "false"
    sql = f"WITH {WIRE_SQL} SELECT packet_number, c AS function_code, {'false' if slug == 'omron_fins' else 'true'} AS is_request, {among(writes)} AS is_write_operation, {among(diagnostics)} AS is_diagnostic, {among(controls)} AS is_control_command, CAST({value} AS VARCHAR) AS field FROM wire WHERE slug = '{slug}'"

    @register(f"decode_{slug}", sql)
    def query(spark, sf_dir):
        frames = decode.decode(wire(spark, sf_dir).where(F.col("k") == k), [slug])
        return frames.select("packet_number", "function_code", "is_request", "is_write_operation", "is_diagnostic", "is_control_command", F.try_element_at("fields", F.lit(field)).alias("field"))

    return query


for _k, _w in enumerate(WIRE):
    _decoder(_k, _w[0])


@register("decode_all", f"WITH {WIRE_SQL} SELECT slug AS protocol_slug, count(*) AS frames, count(DISTINCT c) AS codes FROM wire GROUP BY slug")
def decode_all(spark, sf_dir):
    """All decoders in one plan, each packet going to those of its ports."""
    return decode.decode(wire(spark, sf_dir)).groupBy("protocol_slug").agg(F.count("*").alias("frames"), F.countDistinct("function_code").alias("codes"))


#: Frames of the packet view by all decoders: by port for Modbus; by payload on the port that no protocol has.
ALL_FRAMES = """frames_of AS (SELECT *, packet_number % 65536 // 256 AS b0 FROM packets),
 labels AS (SELECT *, 'Modbus' AS protocol FROM frames_of WHERE dst_port IN (502, 3389) UNION ALL SELECT *, 'Omron FINS' FROM frames_of WHERE dst_port = 3389 AND b0 IN (0, 1, 2, 3, 128, 129, 130, 131)
   UNION ALL SELECT *, 'IEC 104' FROM frames_of WHERE dst_port = 3389 AND b0 = 104 UNION ALL SELECT *, 'BACnet' FROM frames_of WHERE dst_port = 3389 AND b0 = 129)"""


@register(
    "protocol_distribution",
    f"WITH {PACKETS}, {ALL_FRAMES}, counted AS (SELECT {KEYS}, count(*) AS n FROM packets GROUP BY {KEYS}), of AS (SELECT DISTINCT {KEYS}, protocol FROM labels) SELECT coalesce(protocol, transport) AS protocol, CAST(sum(n) AS BIGINT) AS packets FROM counted LEFT JOIN of USING ({KEYS}) GROUP BY 1",
)
def protocol_distribution(spark, sf_dir):
    """Packets by label, with the frames of all decoders; a flow counts under each of its labels."""
    rows = packets(spark, sf_dir)
    return flows.protocol_distribution(flows.with_frames(flows.flow_build(rows), decode.decode(rows)))


def framed(spark, sf_dir):
    rows = packets(spark, sf_dir)
    return flows.with_frames(flows.flow_build(rows), modbus_frames(spark, sf_dir))


@register("unauthorized_reads", f"WITH {PACKETS}, {MODBUS}, told AS (SELECT * REPLACE (src_port + 1000 * (packet_number % 64) AS src_port) FROM modbus) SELECT src_ip, src_port, dst_ip, count(*) AS packets FROM told GROUP BY src_ip, src_port, dst_ip, dst_port HAVING bool_or(fc IN (3, 4)) AND NOT bool_or(fc IN {WRITES}) AND src_ip NOT IN (SELECT src_ip FROM modbus WHERE src_port % 2 = 0)")
def unauthorized_reads(spark, sf_dir):
    """Flows of reads by stations that an earlier capture (of the even ones) doesn't know; those that it knows are stations of operators."""
    seen = F.col("src_port") % 2 == 0
    known = graph.cut(assets.inventory(packets(spark, sf_dir).where(seen), modbus_frames(spark, sf_dir).where(seen)))
    dealt = lambda df: df.withColumn("src_port", F.col("src_port") + 1000 * (F.col("packet_number") % 64).cast("int"))  # noqa: E731  short flows: some write, some only read
    some = flows.with_frames(flows.flow_build(dealt(packets(spark, sf_dir))), dealt(modbus_frames(spark, sf_dir)))
    return flows.unauthorized_reads(some, known).select("src_ip", "src_port", "dst_ip", F.col("packet_count").alias("packets"))


TAGS = f"""WITH {PACKETS}, {ASSETS}, tags AS (SELECT ip_address, unnest([CASE WHEN role = 'PLC' OR has(open_ports, '502') OR has(open_ports, '102') OR has(open_ports, '44818') THEN 'plc_pac' END, CASE WHEN role = 'HMI' THEN 'hmi_station' END, CASE WHEN role = 'HMI' THEN 'operator_client' END,
  CASE WHEN role = 'ENG_STATION' THEN 'engineering_workstation' END, CASE WHEN has(open_ports, '20000') THEN 'rtu' END, CASE WHEN has(open_ports, '20000') AND i > r THEN 'scada_server' END, CASE WHEN has(open_ports, '3389') THEN 'remote_access' END]) AS tag FROM assets)""".replace(
    "has(open_ports, ", "list_contains(string_split(open_ports, ','), "
)


@register("component_tags", TAGS + " SELECT ip_address, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM tags WHERE tag IS NOT NULL GROUP BY ip_address")
def component_tags(spark, sf_dir):
    return components.tagged(inventory(spark, sf_dir)).select("ip_address", F.array_join("component_tags", ",").alias("tags")).where("tags <> ''")


@register("component_counts", TAGS + " SELECT tag AS component_id, count(DISTINCT ip_address) AS assets FROM tags WHERE tag IS NOT NULL GROUP BY tag")
def component_counts(spark, sf_dir):
    return components.tag_counts(inventory(spark, sf_dir))


_CATALOG = ", ".join(f"('{c[0]}', '{c[2]}')" for c in components.CATALOG)


@register("components_not_seen", TAGS + f", catalog(component_id, layer) AS (VALUES {_CATALOG}) SELECT component_id, layer FROM catalog WHERE component_id NOT IN (SELECT tag FROM tags WHERE tag IS NOT NULL)")
def components_not_seen(spark, sf_dir):
    return components.not_seen(inventory(spark, sf_dir)).select("component_id", "layer")


FLOWS = f"flows AS (SELECT {KEYS}, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count, min(packet_number) AS f, list_sort(list(DISTINCT fc) FILTER (fc IN {WRITES})) AS codes FROM packets GROUP BY {KEYS})"


@register("write_flows", f"WITH {PACKETS}, {FLOWS} SELECT src_ip, dst_ip, dst_port, array_to_string(codes, ',') AS codes, array_to_string(list_transform(codes, lambda c: 'FC' || c || ' write (coil/register)'), '; ') AS meaning, packet_count FROM flows WHERE len(codes) > 0 ORDER BY packet_count DESC, f LIMIT 60")
def write_flows(spark, sf_dir):
    return findings.write_flows(framed(spark, sf_dir)).select("src_ip", "dst_ip", "dst_port", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), "meaning", "packet_count")


@register("write_samples", f"WITH {PACKETS}, {FLOWS} SELECT src_ip, dst_ip, src_port, packet_count, byte_count FROM flows WHERE len(codes) > 0 ORDER BY packet_count DESC, f LIMIT 80")
def write_samples(spark, sf_dir):
    return findings.write_samples(framed(spark, sf_dir)).select("src_ip", "dst_ip", "src_port", "packet_count", "byte_count")


@register("write_sources", f"WITH {PACKETS} SELECT DISTINCT src_ip FROM packets WHERE fc IN {WRITES} ORDER BY src_ip LIMIT 40")
def write_sources(spark, sf_dir):
    return findings.write_sources(framed(spark, sf_dir))


@register("crossing_flows", f"WITH {PACKETS}, {FLOWS} SELECT src_ip, dst_ip, dst_port FROM flows WHERE dst_ip = '8.8.8.8' ORDER BY f LIMIT 40")
def crossing_flows(spark, sf_dir):
    return findings.crossing_flows(framed(spark, sf_dir)).drop("protocol")


@register("s7_critical_flows", f"WITH {WIRE_SQL}, f AS (SELECT src_ip, src_port, min(packet_number) AS f, count(*) AS packet_count, list_sort(list(DISTINCT c) FILTER (c IN (5, 26, 40, 41))) AS codes FROM wire JOIN packets USING (packet_number) WHERE slug = 's7' GROUP BY src_ip, dst_ip, src_port) SELECT src_ip, array_to_string(codes, ',') AS codes, packet_count FROM f WHERE len(codes) > 0 ORDER BY packet_count DESC, f LIMIT 60")
def s7_critical_flows(spark, sf_dir):
    rows = wire(spark, sf_dir).where("k = 0")
    found = flows.with_frames(flows.flow_build(rows), decode.decode(rows, ["s7"]))
    return findings.s7_critical_flows(found).select("src_ip", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), "packet_count")


@register("exception_flows", f"WITH {PACKETS} SELECT dst_ip AS src_ip, src_ip AS dst_ip, src_port AS dst_port, count(*) AS exception_count FROM packets WHERE dst_port = 502 AND packet_number % 3 = 0 GROUP BY ALL ORDER BY count(*) DESC, min(packet_number) LIMIT 50")
def exception_flows(spark, sf_dir):
    """Answers that refuse every third request."""
    refused = packets(spark, sf_dir).where("dst_port = 502 and packet_number % 3 = 0")
    answer = F.unhex(F.format_string("000100000003%02X%02X02", (F.col("packet_number") % 200).cast("int"), (F.col("fc") + 128).cast("int")))
    swapped = {"src_ip": "dst_ip", "dst_ip": "src_ip", "src_port": "dst_port", "dst_port": "src_port"}
    rows = refused.withColumn("payload", answer).select(*[F.col(c).alias(swapped.get(c, c)) for c in refused.columns])
    found = flows.with_frames(flows.flow_build(rows), decode.decode(rows, ["modbus"]))
    return findings.exception_flows(found).select("src_ip", "dst_ip", "dst_port", "exception_count")


@register("many_target_sources", f"WITH {PACKETS}, {ASSETS}, t AS (SELECT src_ip, count(DISTINCT dst_ip) AS peers, array_to_string(list_sort(list(DISTINCT dst_ip)), ',') AS sample FROM packets WHERE dst_port IN (502, 102, 20000, 44818) GROUP BY src_ip HAVING count(DISTINCT dst_ip) >= 4 ORDER BY peers DESC, src_ip LIMIT 25) SELECT src_ip, peers, sample, role FROM t JOIN assets ON ip_address = src_ip")
def many_target_sources(spark, sf_dir):
    return findings.many_target_sources(framed(spark, sf_dir), inventory(spark, sf_dir)).select("src_ip", "peers", F.array_join("sample", ",").alias("sample"), "role")


@register("valuable_targets", f"WITH {PACKETS}, {ASSETS} SELECT ip_address, round(risk_score, 2) AS risk_score, role FROM assets ORDER BY assets.risk_score DESC, first_seen_us, ip_address LIMIT 15")
def valuable_targets(spark, sf_dir):
    """Every asset of the view speaks Modbus, so the test after the cut leaves all."""
    return findings.valuable_targets(inventory(spark, sf_dir)).select("ip_address", "risk_score", "role")


@register("admin_assets", f"WITH {PACKETS}, {ASSETS} SELECT ip_address, role, '3389' AS ports FROM assets WHERE list_contains(string_split(open_ports, ','), '3389')")
def admin_assets(spark, sf_dir):
    return findings.admin_assets(inventory(spark, sf_dir)).select("ip_address", "role", F.array_join(F.col("open_ports").cast("array<string>"), ",").alias("ports"))


@register("public_assets", f"WITH {PACKETS}, {ASSETS} SELECT ip_address, role FROM assets WHERE ip_address = '8.8.8.8'")
def public_assets(spark, sf_dir):
    return findings.public_assets(inventory(spark, sf_dir)).select("ip_address", "role")


#: What holds in the packet view (flows, assets, events) and in the talk view (payloads), by position in the audit catalog.
HELD = f"""WITH {TALK_SQL}, n AS (SELECT count(*) FILTER (tcp_flags = 2 AND transport = 'TCP') AS syn FROM ip), e AS (SELECT count(*) AS events FROM packets WHERE fc IN (5, 6, 15, 16) AND unit = 255),
 held AS (SELECT * FROM (VALUES (1, 'HIGH', 'WRITE_SURFACE', true), (3, 'HIGH', 'SEGMENTATION', true), (4, 'CRITICAL', 'CLEARTEXT_REMOTE', true), (5, 'MEDIUM', 'CLEARTEXT_REMOTE', true), (6, 'LOW', 'REMOTE_ACCESS_VISIBILITY', true), (7, 'LOW', 'IT_PROTOCOL_IN_OT', true),
  (8, 'HIGH', 'CLEARTEXT_OT_PAYLOAD', true), (9, 'LOW', 'DISCOVERY_NOISE', (SELECT syn FROM n) > 100), (10, 'HIGH', 'REMOTE_ADMIN_EXPOSURE', true), (11, 'HIGH', 'EXTERNAL_FACING', true), (13, 'MEDIUM', 'DETECTION_ENGINE', (SELECT events FROM e) > 0),
  (14, 'CRITICAL', 'MODBUS_WRITE_TRAFFIC', true), (16, 'HIGH', 'IT_REMOTE_IN_OT_CAPTURE', true), (17, 'HIGH', 'ICS_MULTI_TARGET_SOURCE', true)) AS t(place, severity, category, holds) WHERE holds)"""


def _figures(spark, sf_dir):
    """Frames are worked out once, for flows, assets and events."""
    rows = packets(spark, sf_dir)
    frames = graph.cut(modbus_frames(spark, sf_dir))
    found = flows.with_frames(flows.flow_build(rows), frames)
    return findings.figures(graph.cut(found), assets.inventory(rows, frames), rules.events(frames), talk(spark, sf_dir))


@register("audit_findings", HELD + " SELECT printf('AUD-%03d', row_number() OVER (ORDER BY place)) AS finding_id, severity, category FROM held")
def audit_findings(spark, sf_dir):
    return findings.audit(_figures(spark, sf_dir)).select("finding_id", "severity", "category")


@register("exposure_index", HELD + " SELECT CAST(least(100, sum(CASE severity WHEN 'CRITICAL' THEN 22 WHEN 'HIGH' THEN 12 WHEN 'MEDIUM' THEN 6 ELSE 2 END)) AS BIGINT) AS exposure FROM held")
def exposure_index(spark, sf_dir):
    return findings.exposure(_figures(spark, sf_dir))


#: Figures of groups of events: the n-th counts those of its own remainder with a small value, so that in each group other findings hold.
_COUNTED = ("write_flows", "exception_flows", "crossing", "telnet_port", "ftp_banner", "ssh_banner", "http_like", "readable", "syn_only", "admin_assets", "public_assets", "snmp_assets", "critical_events", "high_events", "modbus_writes", "s7_critical", "it_flows", "many_targets", "high_observed")
_GROUPED = "g AS (SELECT user_id % 211 AS grp, " + ", ".join(f"count(*) FILTER (event_id % 19 = {i} AND value < 12) AS {c}" for i, c in enumerate(_COUNTED)) + " FROM events GROUP BY 1)"
#: The catalog in SQL: condition, severity, category.
_CATALOG_SQL = (
    ("write_flows > 0", "'HIGH'", "WRITE_SURFACE"), ("exception_flows > 0", "'MEDIUM'", "PROTOCOL_HEALTH"), ("crossing > 0", "'HIGH'", "SEGMENTATION"), ("telnet_port > 0", "'CRITICAL'", "CLEARTEXT_REMOTE"), ("ftp_banner > 0", "'MEDIUM'", "CLEARTEXT_REMOTE"), ("ssh_banner > 0", "'LOW'", "REMOTE_ACCESS_VISIBILITY"),
    ("http_like > 0", "'LOW'", "IT_PROTOCOL_IN_OT"), ("readable > 0", "CASE WHEN high_observed > 0 THEN 'HIGH' ELSE 'MEDIUM' END", "CLEARTEXT_OT_PAYLOAD"), ("syn_only * 60 > 100", "'LOW'", "DISCOVERY_NOISE"), ("admin_assets > 0", "'HIGH'", "REMOTE_ADMIN_EXPOSURE"), ("public_assets > 0", "'HIGH'", "EXTERNAL_FACING"),
    ("snmp_assets > 0", "'MEDIUM'", "MANAGEMENT_PLANE"), ("critical_events + high_events > 0", "CASE WHEN critical_events > 0 THEN 'HIGH' ELSE 'MEDIUM' END", "DETECTION_ENGINE"), ("modbus_writes > 0", "'CRITICAL'", "MODBUS_WRITE_TRAFFIC"), ("s7_critical > 0", "'CRITICAL'", "S7_CRITICAL_SERVICES"), ("it_flows > 0", "'HIGH'", "IT_REMOTE_IN_OT_CAPTURE"), ("many_targets > 0", "'HIGH'", "ICS_MULTI_TARGET_SOURCE"),
)
_GROUP_HELD = f"WITH {_GROUPED}, held AS (" + " UNION ALL ".join(f"SELECT grp, {i} AS place, {severity} AS severity, '{category}' AS category FROM g WHERE {on}" for i, (on, severity, category) in enumerate(_CATALOG_SQL)) + ")"


def _group_figures(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    told = events.groupBy((F.col("user_id") % 211).alias("grp")).agg(*[F.count_if((F.col("event_id") % 19 == i) & (F.col("value") < 12)).alias(c) for i, c in enumerate(_COUNTED)])
    hints = F.create_map(*[x for c in ("telnet_port", "ftp_banner", "ssh_banner", "http_like") for x in (F.lit(c), F.col(c))])
    observed = F.when(F.col("readable") > 0, F.create_map(F.lit("readable"), F.col("readable"))).otherwise(F.create_map().cast("map<string,bigint>"))
    return told.withColumn("hints", hints).withColumn("observed", observed).withColumn("syn_only", F.col("syn_only") * 60)


@register("audit_of_groups", _GROUP_HELD + " SELECT finding_id, severity, category, count(*) AS groups FROM (SELECT *, printf('AUD-%03d', row_number() OVER (PARTITION BY grp ORDER BY place)) AS finding_id FROM held) GROUP BY 1, 2, 3")
def audit_of_groups(spark, sf_dir):
    """All findings of the catalog, each holding in some of many groups."""
    return findings.audit(_group_figures(spark, sf_dir)).groupBy("finding_id", "severity", "category").agg(F.count("*").alias("groups"))


@register("exposure_of_groups", _GROUP_HELD + " SELECT exposure, count(*) AS groups FROM (SELECT g.grp, CAST(least(100, coalesce(sum(CASE severity WHEN 'CRITICAL' THEN 22 WHEN 'HIGH' THEN 12 WHEN 'MEDIUM' THEN 6 WHEN 'LOW' THEN 2 END), 0)) AS BIGINT) AS exposure FROM g LEFT JOIN held ON g.grp = held.grp GROUP BY g.grp) GROUP BY exposure")
def exposure_of_groups(spark, sf_dir):
    """Indexes on both sides of the cap."""
    return findings.exposure(_group_figures(spark, sf_dir)).groupBy("exposure").agg(F.count("*").alias("groups"))


# ---- comparison ----

_HALF = f"WITH {PACKETS}, parts AS (SELECT *, packet_number * 20 < (SELECT max(packet_number) FROM packets) AS early, ts_us // 1000000 - (SELECT min(ts_us) FROM packets) // 1000000 AS s FROM packets)"


def _runs(spark, sf_dir):
    """The first twentieth of the packets as a baseline, the rest as the run of now."""
    rows = packets(spark, sf_dir)
    last = rows.agg(F.max("packet_number")).first()[0] or 0
    early = F.col("packet_number") * 20 < last
    return compare.snapshot(rows.where(early)), compare.snapshot(rows.where(~early))


@register("compare_hosts", _HALF + ", h AS (SELECT src_ip AS ip, early FROM parts UNION ALL SELECT dst_ip, early FROM parts) SELECT ip FROM h GROUP BY ip HAVING NOT bool_or(early)")
def compare_hosts(spark, sf_dir):
    return compare.new_hosts(*_runs(spark, sf_dir))


@register("compare_pairs", _HALF + " SELECT src_ip, dst_ip FROM parts GROUP BY ALL HAVING NOT bool_or(early) ORDER BY src_ip, dst_ip LIMIT 500")
def compare_pairs(spark, sf_dir):
    return compare.new_pairs(*_runs(spark, sf_dir))


@register("compare_writes", _HALF + ", w AS (SELECT * FROM parts WHERE dst_port = 502 AND fc IN (5, 6, 15, 16, 22, 24)), s AS (SELECT count(*) FILTER (early) AS writes_before, count(DISTINCT src_ip) FILTER (early) AS writers_before, count(*) FILTER (NOT early) AS writes_now, count(DISTINCT src_ip) FILTER (NOT early) AS writers_now FROM w), n AS (SELECT coalesce(array_to_string(list_sort(list(src_ip)), ','), '') AS new_writers FROM (SELECT src_ip FROM w GROUP BY src_ip HAVING NOT bool_or(early))) SELECT s.*, new_writers, (writes_now > 2 * writes_before AND writes_now > 5) OR new_writers <> '' AS alarming FROM s, n")
def compare_writes(spark, sf_dir):
    return compare.writes(*_runs(spark, sf_dir)).withColumn("new_writers", F.array_join("new_writers", ","))


@register("compare_traffic", f"WITH {PACKETS}, m AS (SELECT max(packet_number) AS z FROM packets), t AS (SELECT ts_us, packet_number * 20 < z AS early FROM packets, m), f AS (SELECT early, min(ts_us) AS a FROM t GROUP BY early), s AS (SELECT early, (ts_us - a) // 1000000 AS sec, count(*) AS n FROM t JOIN f USING (early) GROUP BY ALL), g AS (SELECT early, sum(n) / count(*) AS mean FROM s GROUP BY early) SELECT a.mean > 0.5 AS comparable, b.mean / a.mean >= 2 AS alarming FROM (SELECT mean FROM g WHERE early) a, (SELECT mean FROM g WHERE NOT early) b")
def compare_traffic(spark, sf_dir):
    return compare.traffic(*_runs(spark, sf_dir)).select(F.col("ratio").isNotNull().alias("comparable"), "alarming")


@register("learned_sizes", f"WITH {PACKETS} SELECT 'Modbus' AS protocol, count(*) AS frames, CAST(12 AS DOUBLE) AS mean_size, CAST(0 AS DOUBLE) AS size_std, count(DISTINCT fc) AS codes FROM packets")
def learned_sizes(spark, sf_dir):
    return compare.learned(modbus_frames(spark, sf_dir))


@register("rare_codes", f"WITH {PACKETS}, c AS (SELECT fc AS function_code, count(*) AS n FROM packets WHERE dst_port = 502 GROUP BY fc) SELECT function_code FROM c WHERE n <= greatest(1, CAST(floor((SELECT sum(n) FROM c) * 0.002) AS BIGINT))")
def rare_codes(spark, sf_dir):
    return baseline.rare_codes(decode.modbus_requests(packets(spark, sf_dir))).select("function_code")


# ---- privacy and views ----


@register("anonymous_texts", "SELECT doc_id, length(text) - length(regexp_replace(text, '\\b((25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})\\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})\\b', '', 'g')) > 0 AS had, false AS kept FROM documents")
def anonymous_texts(spark, sf_dir):
    """Texts in which an address was found, and whether it is still there; texts without one are as they were."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    told = rows.withColumn("clean", privacy.without_addresses(F.col("text"))).withColumn("first", F.regexp_extract("text", privacy.ADDRESS, 0))
    return told.select("doc_id", (F.col("clean") != F.col("text")).alias("had"), ((F.col("first") != "") & F.regexp_like("clean", F.concat(F.lit(r"(?<![0-9.])\Q"), "first", F.lit(r"\E(?![0-9.])")))).alias("kept"))


@register("searched_flows", f"WITH {PACKETS}, {FLOWS} SELECT src_ip, src_port, dst_ip FROM flows WHERE dst_ip = '192.168.2.20'")
def searched_flows(spark, sf_dir):
    return views.holding(flows.flow_build(packets(spark, sf_dir)), " 192.168.2.20 ").select("src_ip", "src_port", "dst_ip")


@register("busiest_write_flows", f"WITH {PACKETS}, {FLOWS} SELECT src_ip, dst_ip, byte_count FROM flows WHERE len(codes) > 0 ORDER BY byte_count DESC, f LIMIT 60")
def busiest_write_flows(spark, sf_dir):
    return views.subset(framed(spark, sf_dir), "write").select("src_ip", "dst_ip", "byte_count")


@register("spoken_protocols", "SELECT 'Modbus' AS protocol")
def spoken_protocols(spark, sf_dir):
    return views.ot_protocols(framed(spark, sf_dir))


@register("report_figures", f"WITH {PACKETS}, {FLOWS} SELECT count(DISTINCT src_ip) + count(DISTINCT dst_ip) AS hosts, count(*) AS flows, CAST(sum(packet_count) AS BIGINT) AS packets, CAST(sum(byte_count) AS BIGINT) AS bytes, count(*) FILTER (len(codes) > 0) AS write_flows FROM flows")
def report_figures(spark, sf_dir):
    return views.figures(framed(spark, sf_dir)).select("hosts", "flows", "packets", "bytes", "write_flows")


@register("alerts", f"WITH {PACKETS}, p AS (SELECT DISTINCT src_ip, dst_ip FROM packets), r AS (SELECT src_ip, dst_ip, dst_port AS port FROM packets WHERE dst_port = 3389 GROUP BY ALL) SELECT * FROM (SELECT 'new_pair' AS source, src_ip || ' > ' || dst_ip AS subject, '' AS detail FROM p ORDER BY 2 LIMIT 15) UNION ALL SELECT * FROM (SELECT 'service', src_ip || ' > ' || dst_ip, CAST(port AS VARCHAR) FROM r ORDER BY 2, 3 LIMIT 20)")
def alerts(spark, sf_dir):
    rows = packets(spark, sf_dir)
    pairs = rows.select("src_ip", "dst_ip").distinct()
    nothing = pairs.limit(0)
    services = flows.it_edge_flows(flows.flow_build(rows)).select("src_ip", "dst_ip", "port").distinct()
    return views.alerts(nothing.select(F.col("src_ip").alias("ip")), pairs, nothing.withColumn("packets", F.lit(0)), services)


@register("edge_table", f"WITH {PACKETS} SELECT src_ip, dst_ip, count(*) AS packets FROM packets WHERE dst_ip LIKE '192.168.1.%' GROUP BY ALL ORDER BY packets DESC, src_ip, dst_ip LIMIT 500")
def edge_table(spark, sf_dir):
    return views.edge_table(baseline.edges(packets(spark, sf_dir)), "192.168.1.").select("src_ip", "dst_ip", "packets")


# ---- flows alone, guesses, exports ----


@register("bundle_rare_edges", f"WITH {PACKETS}, e AS (SELECT src_ip, dst_ip, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY ALL), t AS (SELECT list_sort(list(packets)) AS l FROM e) SELECT src_ip, dst_ip, packets, bytes FROM e, t WHERE packets <= l[least(CAST(floor(len(l) * 0.1) AS BIGINT), len(l) - 1) + 1] ORDER BY packets, src_ip, dst_ip LIMIT 200")
def bundle_rare_edges(spark, sf_dir):
    return bundle.rare_edges(bundle.edges(flows.flow_build(packets(spark, sf_dir))))


@register("bundle_hosts", f"WITH {PACKETS}, e AS (SELECT src_ip, dst_ip, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY ALL), h AS (SELECT src_ip AS ip, bytes, 1 AS peer FROM e UNION ALL SELECT dst_ip, bytes, 0 FROM e) SELECT ip, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(peer) AS BIGINT) AS peers FROM h GROUP BY ip ORDER BY 2 DESC, ip LIMIT 50")
def bundle_hosts(spark, sf_dir):
    return bundle.hosts(bundle.edges(flows.flow_build(packets(spark, sf_dir))))


@register("bundle_minutes", f"WITH {PACKETS}, m AS (SELECT ts_us // 60000000 AS place, count(*) AS packets FROM packets GROUP BY 1), a AS (SELECT sum(packets) / count(*) AS mean FROM m) SELECT place, packets, packets // 60 AS packets_per_second, mean >= 5 AND packets >= 3 * mean AS spike FROM m, a")
def bundle_minutes(spark, sf_dir):
    by = packets(spark, sf_dir).groupBy(F.floor(F.col("ts_us") / 60_000_000).alias("place")).agg(F.count("*").alias("packets"))
    return bundle.minutes(by)


_CODES = f"f AS (SELECT {KEYS}, count(*) AS n, list_sort(list(DISTINCT fc)) AS codes, coalesce(list_sort(list(DISTINCT fc) FILTER (fc IN {WRITES})), []) AS writes FROM packets GROUP BY {KEYS})"


@register("bundle_commands", f"WITH {PACKETS}, {_CODES}, s AS (SELECT unnest(codes) AS function_code, greatest(1, n // greatest(1, len(codes))) AS k FROM f UNION ALL SELECT unnest(writes), greatest(1, n // greatest(1, len(writes))) FROM f), c AS (SELECT function_code, CAST(sum(k) AS BIGINT) AS requests FROM s GROUP BY 1), t AS (SELECT sum(requests) AS total FROM c) SELECT function_code, requests, requests <= greatest(1, CAST(floor(total * 0.002) AS BIGINT)) AS rare, 100.0 * requests / total < 1 AS uncommon FROM c, t")
def bundle_commands(spark, sf_dir):
    return bundle.commands(framed(spark, sf_dir)).select("function_code", "requests", "rare", "uncommon")


@register("bundle_totals", f"WITH {PACKETS}, {_CODES} SELECT CAST(coalesce(sum(n) FILTER (len(writes) > 0), 0) AS BIGINT) AS write_like, CAST(coalesce(sum(n) FILTER (len(writes) = 0), 0) AS BIGINT) AS read_like, CAST(0 AS BIGINT) AS other_like, count(DISTINCT src_ip) FILTER (len(writes) > 0) AS write_sources FROM f")
def bundle_totals(spark, sf_dir):
    return bundle.command_totals(framed(spark, sf_dir))


@register("guessed_protocols", f"WITH {WIRE_SQL} SELECT packet_number, slug AS port_guess, CASE slug WHEN 'snmp' THEN 'mqtt' ELSE slug END AS payload_guess FROM wire WHERE slug NOT IN ('ge_srtp', 'omron_fins')")
def guessed_protocols(spark, sf_dir):
    """A short SNMP request has the shape of an MQTT packet too, which is tried first."""
    rows = guess.guessed(wire(spark, sf_dir).where("k < 8"))
    return rows.select("packet_number", "port_guess", "payload_guess")


@register("flow_frame_stats", f"WITH {PACKETS}, {_CODES} SELECT count(*) AS ics_flows, count(*) FILTER (len(writes) > 0) AS write_flows, CAST(0 AS BIGINT) AS exception_flows FROM f")
def flow_frame_stats(spark, sf_dir):
    return flows.frame_stats(framed(spark, sf_dir))


@register("protocol_hosts", f"WITH {PACKETS} SELECT 'Modbus' AS protocol, count(DISTINCT ip) AS hosts FROM (SELECT src_ip AS ip FROM packets UNION ALL SELECT dst_ip FROM packets)")
def protocol_hosts(spark, sf_dir):
    return assets.protocol_hosts(inventory(spark, sf_dir))


@register("exported_flows", f"WITH {PACKETS} SELECT src_ip, src_port, dst_ip, strftime(make_timestamp(min(ts_us)), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS start_time, strftime(make_timestamp(max(ts_us)), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS end_time FROM packets GROUP BY {KEYS}")
def exported_flows(spark, sf_dir):
    return flows.exported(flows.flow_build(packets(spark, sf_dir))).select("src_ip", "src_port", "dst_ip", "start_time", "end_time")


@register("active_assets", f"WITH {PACKETS}, h AS (SELECT src_ip AS ip_address, ts_us FROM packets UNION ALL SELECT dst_ip, ts_us FROM packets) SELECT ip_address, (max(ts_us) - min(ts_us)) / 1e6 AS active_seconds FROM h GROUP BY 1")
def active_assets(spark, sf_dir):
    return assets.active(assets.asset_build(packets(spark, sf_dir)))
