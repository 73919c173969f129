"""Queries over the talk view: what packets show openly, and the tables of the survey.

The SQL knows the kind of payload of each packet and says what an inspector must find in it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from otspark.functions.dims import PORTS, values
from otspark.operators import cleartext, graph, sketches, survey
from otspark.plans.catalog import register
from otspark.sources.packets import PACKETS, POLLING, TALK, TALK_SQL, packets, polling, talk

OBSERVED = f"""{TALK_SQL},
 seen AS (SELECT *, CASE k WHEN 0 THEN 'modbus_tcp_cleartext' WHEN 1 THEN 'modbus_port_cleartext_non_mbap' WHEN 2 THEN 'iec104_cleartext' WHEN 4 THEN 'http_cleartext_ot_context' WHEN 9 THEN 'snmp_cleartext_community' WHEN 11 THEN 'ics_tcp_port_cleartext_payload' END AS category,
    CASE WHEN k IN (2, 9) OR (k = 0 AND fc IN (5, 6, 15, 16)) THEN 'HIGH' ELSE 'MEDIUM' END AS sensitivity,
    CASE k WHEN 0 THEN 'mb' || fc WHEN 1 THEN '502unk' WHEN 2 THEN '104' WHEN 4 THEN 'httpot' WHEN 9 THEN 'snmp' WHEN 11 THEN 'gen9600' END AS dedupe_key,
    CASE WHEN k = 9 THEN 'p****c' END AS community FROM ip WHERE k IN (0, 1, 2, 4, 9, 11))"""
REGISTRY = f"registry(port, slug, service, kind, ics, risk) AS (VALUES {values(PORTS)})"
TOP_PORTS = "SELECT c.port, packets, service, coalesce(ics, false) AS ics, risk FROM (SELECT {port} AS port, count(*) AS packets, min(packet_number) AS f FROM ip WHERE transport = '{transport}' GROUP BY ALL ORDER BY packets DESC, f LIMIT 25) c LEFT JOIN registry USING (port)"


@register("cleartext_observations", f"WITH {OBSERVED} SELECT packet_number, category, sensitivity, dedupe_key, community FROM seen")
def cleartext_observations(spark, sf_dir):
    return cleartext.observations(survey.on_network(talk(spark, sf_dir))).select("packet_number", "category", "sensitivity", "dedupe_key", "community")


@register("cleartext_samples", f"WITH {OBSERVED}, one AS (SELECT *, row_number() OVER (PARTITION BY category, src_ip, dst_ip, dst_port, src_port, dedupe_key ORDER BY packet_number) AS n FROM seen) SELECT packet_number, category, src_ip, dst_ip FROM one WHERE n = 1 ORDER BY packet_number, category LIMIT 40")
def cleartext_samples(spark, sf_dir):
    return cleartext.samples(cleartext.observations(survey.on_network(talk(spark, sf_dir)))).select("packet_number", "category", "src_ip", "dst_ip")


@register("cleartext_excerpts", f"WITH {TALK_SQL} SELECT packet_number, 'GET /plc/status HTTP/1.1 Host: h' || (u % 7) || '.plant.example User-Ag' AS excerpt FROM ip WHERE k = 4")
def cleartext_excerpts(spark, sf_dir):
    """What stands around the first token of a web request: 24 characters before it and 48 after it."""
    found = cleartext.observations(survey.on_network(talk(spark, sf_dir))).where("category = 'http_cleartext_ot_context'")
    return found.select("packet_number", "excerpt")


@register("payload_fingerprints", f"WITH {TALK_SQL} SELECT md5(CASE k WHEN 4 THEN substr('GET /plc/status HTTP/1.1' || chr(13) || chr(10) || 'Host: h' || (u % 7) || '.plant.example', 1, 48) WHEN 10 THEN substr('POST /login HTTP/1.1' || chr(13) || chr(10) || 'Authorization: Basic YWJj' || chr(13), 1, 48) ELSE repeat('abcdefghij', 4) END) AS fingerprint, count(*) AS packets FROM ip WHERE k IN (4, 10, 11) GROUP BY ALL")
def payload_fingerprints(spark, sf_dir):
    """Digests of the beginnings of payloads of 32 to 1400 bytes that are no TLS."""
    return cleartext.fingerprints(survey.over(talk(spark, sf_dir), "TCP")).drop("first")


@register("short_payload_fingerprints", "SELECT '' AS fingerprint, CAST(0 AS BIGINT) AS packets WHERE false")
def short_payload_fingerprints(spark, sf_dir):
    """Payloads of the packet view have 12 bytes: too short for a fingerprint."""
    return cleartext.fingerprints(packets(spark, sf_dir)).drop("first")


@register("dns_names", f"WITH {TALK_SQL} SELECT 'n' || (u % 9) || '.example.org' AS qname, count(*) AS packets FROM ip WHERE k = 8 GROUP BY ALL")
def dns_names(spark, sf_dir):
    return survey.names(talk(spark, sf_dir))


@register("http_hosts", f"WITH {TALK_SQL}, first AS (SELECT * FROM ip WHERE k = 4 ORDER BY packet_number LIMIT 200) SELECT 'h' || (u % 7) || '.plant.example' AS host, count(*) AS packets FROM first GROUP BY ALL")
def http_hosts(spark, sf_dir):
    return survey.hosts(talk(spark, sf_dir))


@register("tls_ports", f"WITH {TALK_SQL} SELECT 443 AS port, count(*) AS packets FROM ip WHERE k = 3")
def tls_ports(spark, sf_dir):
    return survey.tls(talk(spark, sf_dir))


@register("cleartext_hints", f"WITH {TALK_SQL} SELECT CASE WHEN k = 5 THEN 'ftp_banner' WHEN k = 6 THEN 'ssh_banner' WHEN k = 7 THEN 'telnet_port' WHEN k IN (4, 10) THEN 'http_like' ELSE 'snmp_udp' END AS hint, count(*) AS packets FROM ip WHERE k IN (4, 5, 6, 7, 9, 10) GROUP BY ALL")
def cleartext_hints(spark, sf_dir):
    return survey.hints(talk(spark, sf_dir))


@register("banner_samples", f"WITH {TALK_SQL}, f AS (SELECT * FROM ip WHERE k IN (5, 6) ORDER BY packet_number LIMIT 40) SELECT CASE k WHEN 5 THEN 'FTP' ELSE 'SSH' END AS protocol, CASE k WHEN 5 THEN '220 plant FTP server ready' ELSE 'SSH-2.0-OpenSSH' END AS sample FROM f")
def banner_samples(spark, sf_dir):
    return survey.banners(talk(spark, sf_dir))


@register("tool_marks", f"WITH {TALK_SQL} SELECT 'Nmap' AS mark, count(*) AS packets FROM ip WHERE k = 4")
def tool_marks(spark, sf_dir):
    return survey.tool_marks(talk(spark, sf_dir))


@register("credential_hints", f"WITH {TALK_SQL} SELECT 'http_basic_auth' AS kind, src_ip, dst_ip, packet_number FROM ip WHERE k = 10 ORDER BY packet_number LIMIT 24")
def credential_hints(spark, sf_dir):
    return survey.credentials(talk(spark, sf_dir)).select("kind", "src_ip", "dst_ip", "packet_number")


@register("repeated_payloads", f"WITH {TALK_SQL}, c AS (SELECT CASE k WHEN 4 THEN 'h' || (u % 7) ELSE 'k' || k END AS what, count(*) AS packets, min(packet_number) AS f FROM ip WHERE k IN (4, 10, 11) GROUP BY ALL ORDER BY packets DESC, f LIMIT 40) SELECT packets FROM c WHERE packets >= 4 ORDER BY packets DESC LIMIT 20")
def repeated_payloads(spark, sf_dir):
    return survey.repeated_payloads(talk(spark, sf_dir)).select("packets")


@register("survey_window", f"WITH {TALK_SQL}, w AS (SELECT min_by(ts_us, packet_number) AS first_us, max_by(ts_us, packet_number) AS last_us, count(*) AS packets_total, count(*) FILTER (packet_number % 50 <> 0) AS packets_with_ipv4 FROM talk) SELECT *, packets_total - packets_with_ipv4 AS non_ip_frames, round((last_us - first_us) / 1e6, 3) AS span_seconds FROM w")
def survey_window(spark, sf_dir):
    return survey.window(talk(spark, sf_dir)).drop("avg_packets_per_second")


@register("survey_addressing", f"WITH {TALK_SQL} SELECT count(DISTINCT src_ip) AS src_ipv4, count(DISTINCT dst_ip) AS dst_ipv4, count(*) AS src_private_hits, CAST(0 AS BIGINT) AS src_public_hits, count(*) FILTER (dst_ip <> '8.8.8.8') AS dst_private_hits, count(*) FILTER (dst_ip = '8.8.8.8') AS dst_public_hits FROM ip")
def survey_addressing(spark, sf_dir):
    return survey.addressing(talk(spark, sf_dir))


@register("survey_hardware", f"WITH {TALK_SQL} SELECT count(DISTINCT src_mac) AS src_mac, CAST(1 AS BIGINT) AS dst_mac, count(*) FILTER (eth_type = 2054) AS arp_frames FROM talk")
def survey_hardware(spark, sf_dir):
    return survey.hardware(talk(spark, sf_dir))


@register("survey_ip_protocols", f"WITH {TALK_SQL} SELECT transport AS protocol, count(*) AS packets FROM ip GROUP BY ALL")
def survey_ip_protocols(spark, sf_dir):
    return survey.ip_protocols(talk(spark, sf_dir))


@register("survey_ethertypes", f"WITH {TALK_SQL} SELECT CASE eth_type WHEN 2054 THEN '0x806' ELSE '0x800' END AS ethertype, count(*) AS packets FROM talk GROUP BY ALL")
def survey_ethertypes(spark, sf_dir):
    return survey.ethertypes(talk(spark, sf_dir))


@register("survey_tcp", f"WITH {TALK_SQL} SELECT count(*) FILTER (tcp_flags = 2) AS syn_without_ack, count(*) FILTER (tcp_flags = 4) AS rst, count(*) FILTER (tcp_flags = 17) AS fin, count(*) AS with_payload FROM ip WHERE transport = 'TCP'")
def survey_tcp(spark, sf_dir):
    return survey.tcp_behaviour(talk(spark, sf_dir))


def _ports(side: str, transport: str):
    sql = f"WITH {TALK_SQL}, {REGISTRY} " + TOP_PORTS.format(port=f"{side}_port", transport=transport)

    @register(f"survey_{side}_{transport.lower()}_ports", sql)
    def query(spark, sf_dir):
        return survey.top_ports(talk(spark, sf_dir), side, transport)

    return query


for _side in ("src", "dst"):
    for _transport in ("TCP", "UDP"):
        _ports(_side, _transport)


@register(
    "survey_ics_ports",
    f"WITH {TALK_SQL}, {REGISTRY}, hit AS (SELECT packet_number, 'dst_' || lower(transport) AS observation, dst_port AS port, transport FROM ip UNION ALL SELECT packet_number, 'src_' || lower(transport), src_port, transport FROM ip) "
    "SELECT observation, port, service AS label, count(*) AS packets, risk FROM hit JOIN registry USING (port) WHERE ics AND kind IN (lower(transport), 'both') GROUP BY ALL ORDER BY count(*) DESC, min(packet_number) LIMIT 40",
)
def survey_ics_ports(spark, sf_dir):
    return survey.ics_visibility(talk(spark, sf_dir))


#: Bins of the polling view, which has over 200 minutes from 12,000 events on.
BINS = "counted AS (SELECT ts_us // 60000000 AS m, count(*) AS n FROM packets GROUP BY ALL), e AS (SELECT min(m) AS a, max(m) AS z, count(*) AS c FROM counted), w AS (SELECT a, CASE WHEN c <= {points} THEN 1 ELSE greatest(1, (z - a + 1) // {points}) END AS w FROM e)"


@register("survey_timeline", f"WITH {POLLING}, {BINS.format(points=20)} SELECT strftime(make_timestamp((any_value(a) + (m - a) // w.w * any_value(w.w)) * 60000000), '%m-%d %H:%M') AS label, CAST(sum(n) AS BIGINT) AS packets FROM counted, w GROUP BY (m - a) // w.w")
def survey_timeline(spark, sf_dir):
    """Packets by minutes, in about 20 bins."""
    return survey.timeline(polling(spark, sf_dir), points=20)


@register("nearest_rank", f"WITH {POLLING}, s AS (SELECT list_sort(list(length)) AS l FROM packets) SELECT p AS percent, CAST(l[least(CAST(floor(len(l) * p / 100) AS BIGINT), len(l) - 1) + 1] AS DOUBLE) AS value FROM s, (VALUES (10), (50), (90), (100)) AS t(p)")
def nearest_rank(spark, sf_dir):
    return sketches.ranks(polling(spark, sf_dir), "length", (10, 50, 90, 100)).select(F.col("percent").cast("int").alias("percent"), "value")


@register("sketched_uniques", f"WITH {PACKETS}, r AS (SELECT *, packet_number % 3 AS part FROM packets) SELECT part, count(*) AS packets, count(DISTINCT src_ip) AS sources, count(DISTINCT least(src_ip, dst_ip) || '|' || greatest(src_ip, dst_ip)) AS pairs, true AS sources_close, true AS pairs_close, true AS median_close FROM r GROUP BY part UNION ALL SELECT -1, count(*), count(DISTINCT src_ip), count(DISTINCT least(src_ip, dst_ip) || '|' || greatest(src_ip, dst_ip)), true, true, true FROM r")
def sketched_uniques(spark, sf_dir):
    """Sketches of three captures, and of their union (part -1), against exact counts: within five percent, the median within five percent of the ranks."""
    rows = packets(spark, sf_dir).withColumn("file_idx", (F.col("packet_number") % 3).cast("int"))
    kept = graph.cut(sketches.of_captures(rows))
    every = sketches.merged(kept.withColumn("part", F.lit(-1)), "part").unionByName(sketches.merged(kept.withColumnRenamed("file_idx", "part"), "part"))
    told = sketches.estimates(every, "part", percents=(50,))
    pair = F.concat_ws("|", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip"))
    dealt = rows.select(F.explode(F.array(F.lit(-1), "file_idx")).alias("part"), "src_ip", pair.alias("pair"), "length")
    exact = dealt.groupBy("part").agg(F.countDistinct("src_ip").alias("_s"), F.countDistinct("pair").alias("_p"), F.percentile("length", 0.45).alias("_low"), F.percentile("length", 0.55).alias("_high"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.05 * F.col(b)
    return told.join(exact, "part").select("part", "packets", F.col("_s").alias("sources"), F.col("_p").alias("pairs"), close("sources", "_s").alias("sources_close"), close("pairs", "_p").alias("pairs_close"), F.col("length_p50").between(F.floor("_low"), F.ceil("_high")).alias("median_close"))


assert len(TALK) == 12  # the SQL counts on it
