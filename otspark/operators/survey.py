"""What a capture holds, as short tables: window, addresses, protocols, ports, names, hosts, hints, timeline.

Every table comes from one grouping; the scalars of a capture come from one row. Packets without both addresses count as
frames of layer two only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otspark.functions.dims import PORTS
from otspark.functions.net import byte_array, is_private, is_public, size
from otspark.operators import cleartext, sketches
from otspark.sources.packets import ORDER

#: Rows of the tables of ports, protocols, ethertypes, names, hosts, TLS ports, industrial ports.
TOP = {"ports": 25, "ip_protocols": 32, "ethertypes": 12, "names": 40, "hosts": 40, "tls": 15, "ics": 40, "fingerprints": 40}
#: Points of a timeline, about.
POINTS = 200
#: Least number of like payload beginnings that a report shows, and how many of them.
REPEATS, SHOWN_REPEATS = 4, 20

# fixed values: names of IP protocols
IP_PROTOCOLS = {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6"}


def most_common(rows: DataFrame, by: list[str], most: int, count: str = "packets") -> DataFrame:
    """The most frequent values, of those that tie the one seen first in processing order first."""
    counted = rows.groupBy(*by).agg(F.count("*").alias(count), F.min(F.struct(*ORDER)).alias("_first"))
    return counted.orderBy(F.desc(count), "_first").limit(most).drop("_first")


def on_network(packets: DataFrame) -> DataFrame:
    return packets.where("src_ip IS NOT NULL AND dst_ip IS NOT NULL")


def over(packets: DataFrame, transport: str) -> DataFrame:
    return on_network(packets).where((F.col("transport") == transport) & (F.coalesce("src_port", F.lit(0)) != 0) & (F.coalesce("dst_port", F.lit(0)) != 0))


def window(packets: DataFrame) -> DataFrame:
    """One row: first and last time in processing order, span, packets, packets a second."""
    place = F.struct(*ORDER)
    both = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
    row = packets.agg(F.min_by("ts_us", place).alias("first_us"), F.max_by("ts_us", place).alias("last_us"), F.count("*").alias("packets_total"), F.count_if(both).alias("packets_with_ipv4"))
    span = F.greatest(F.coalesce(F.col("last_us") - F.col("first_us"), F.lit(0)), F.lit(0)) / 1e6
    row = row.withColumn("non_ip_frames", F.col("packets_total") - F.col("packets_with_ipv4")).withColumn("span_seconds", F.round(span, 3))
    return row.withColumn("avg_packets_per_second", F.when(span > 0, F.round(F.col("packets_total") / span, 3)).otherwise(0.0))


def addressing(packets: DataFrame) -> DataFrame:
    """One row: distinct addresses of each side, packets of private and public ones."""
    rows = on_network(packets)
    hits = [F.count_if(of(F.col(f"{side}_ip"))).alias(f"{side}_{kind}_hits") for side in ("src", "dst") for kind, of in (("private", is_private), ("public", is_public))]
    return rows.agg(F.countDistinct("src_ip").alias("src_ipv4"), F.countDistinct("dst_ip").alias("dst_ipv4"), *hits)


def hardware(packets: DataFrame) -> DataFrame:
    """One row: distinct MAC addresses of each side, ARP frames."""
    return packets.agg(F.countDistinct("src_mac").alias("src_mac"), F.countDistinct("dst_mac").alias("dst_mac"), F.count_if(F.col("eth_type") == 0x0806).alias("arp_frames"))


def ip_protocols(packets: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in IP_PROTOCOLS.items() for x in pair])
    rows = most_common(on_network(packets).where("ip_proto IS NOT NULL"), ["ip_proto"], TOP["ip_protocols"])
    return rows.select(F.coalesce(F.try_element_at(names, "ip_proto"), F.concat(F.lit("proto_"), F.col("ip_proto").cast("string"))).alias("protocol"), "packets")


def ethertypes(packets: DataFrame) -> DataFrame:
    rows = most_common(packets.where("eth_type IS NOT NULL"), ["eth_type"], TOP["ethertypes"])
    return rows.select(F.concat(F.lit("0x"), F.lower(F.hex("eth_type"))).alias("ethertype"), "packets")


def tcp_behaviour(packets: DataFrame) -> DataFrame:
    """One row: SYN without ACK, RST, FIN, segments with payload."""
    flag = lambda mask: F.coalesce(F.col("tcp_flags").bitwiseAND(mask) != 0, F.lit(False))
    return over(packets, "TCP").agg(F.count_if(flag(2) & ~flag(16)).alias("syn_without_ack"), F.count_if(flag(4)).alias("rst"), F.count_if(flag(1)).alias("fin"), F.count_if(size(F.col("payload")) > 0).alias("with_payload"))


def _registry(of: int) -> Column:
    return F.create_map(*[F.lit(x) for row in PORTS for x in (row[0], row[of])])


def top_ports(packets: DataFrame, side: str, transport: str, most: int = TOP["ports"]) -> DataFrame:
    """port, packets, service, ics, risk of the busiest ports; service and risk are null for ports that aren't registered."""
    rows = most_common(over(packets, transport).select(F.col(f"{side}_port").alias("port"), *ORDER), ["port"], most)
    get = lambda i: F.try_element_at(_registry(i), F.col("port"))
    return rows.select("port", "packets", get(2).alias("service"), F.coalesce(get(4), F.lit(False)).alias("ics"), get(5).alias("risk"))


def ics_visibility(packets: DataFrame, most: int = TOP["ics"]) -> DataFrame:
    """observation (dst_tcp, src_tcp, dst_udp, src_udp), port, label, packets, risk of registered industrial ports, by transport."""
    seen = []
    for transport in ("TCP", "UDP"):
        fitting = [p for p in PORTS if p[4] and p[3] in (transport.lower(), "both")]
        for side in ("dst", "src"):
            port = F.col(f"{side}_port")
            hit = F.when((F.col("transport") == transport) & port.isin(*[p[0] for p in fitting]), F.struct(F.lit(f"{side}_{transport.lower()}").alias("observation"), port.alias("port")))
            seen.append(hit)
    rows = over(packets, "TCP").unionByName(over(packets, "UDP")).select(*ORDER, F.inline(F.array_compact(F.array(*seen))))
    get = lambda i: F.try_element_at(_registry(i), F.col("port"))
    return most_common(rows, ["observation", "port"], most).select("observation", "port", get(2).alias("label"), "packets", get(5).alias("risk"))


def names(packets: DataFrame, most: int = TOP["names"]) -> DataFrame:
    return most_common(cleartext.dns_names(over(packets, "UDP")), ["qname"], most)


def hosts(packets: DataFrame, most: int = TOP["hosts"], extracts: int = cleartext.HOSTS) -> DataFrame:
    """Host headers of the first `extracts` web requests that have one, most frequent first."""
    first = over(packets, "TCP").withColumn("host", cleartext.web_host()).where("host IS NOT NULL").select("host", *ORDER).orderBy(*ORDER).limit(extracts)
    return most_common(first, ["host"], most)


def tls(packets: DataFrame, most: int = TOP["tls"]) -> DataFrame:
    """port, packets: TLS handshake records by destination port."""
    rows = over(packets, "TCP").where(size(F.col("payload")) >= 4).withColumn("_bytes", byte_array(F.substring("payload", 1, 4))).where(cleartext.is_tls(F.col("_bytes")))
    return most_common(rows.select(F.col("dst_port").alias("port"), *ORDER), ["port"], most)


def hints(packets: DataFrame) -> DataFrame:
    """hint, packets: ssh_banner, ftp_banner, telnet_port, http_like, snmp_udp."""
    snmp = (F.col("transport") == "UDP") & (size(F.col("payload")) > 0) & ((F.col("src_port") == 161) | (F.col("dst_port") == 161))
    web = F.when(cleartext.is_web() & (size(F.col("payload")) >= 4), "http_like")
    every = F.array_compact(F.array(cleartext.hint(F.lit(None)), web, F.when(snmp, "snmp_udp")))
    return over(packets, "TCP").unionByName(over(packets, "UDP")).select(F.explode(every).alias("hint")).groupBy("hint").agg(F.count("*").alias("packets"))


def banners(packets: DataFrame, most: int = cleartext.BANNERS) -> DataFrame:
    """protocol, sample: the first SSH and FTP banners, 120 bytes of each."""
    label = cleartext.hint(F.lit(None))
    rows = over(packets, "TCP").withColumn("_h", label).where(F.col("_h").isin("ssh_banner", "ftp_banner")).orderBy(*ORDER).limit(most)
    return rows.select(F.when(F.col("_h") == "ssh_banner", "SSH").otherwise("FTP").alias("protocol"), F.translate(cleartext.text_of(F.col("payload"), 120), "\r\n", "  ").alias("sample"))


def tool_marks(packets: DataFrame) -> DataFrame:
    return over(packets, "TCP").withColumn("mark", cleartext.tool_mark()).where("mark IS NOT NULL").groupBy("mark").agg(F.count("*").alias("packets"))


def credentials(packets: DataFrame, most: int = cleartext.CREDENTIALS) -> DataFrame:
    """kind and place of the first credentials that were sent readably."""
    rows = over(packets, "TCP").withColumn("kind", cleartext.credential()).where("kind IS NOT NULL")
    return rows.orderBy(*ORDER).limit(most).select("kind", "src_ip", "dst_ip", "dst_port", *ORDER)


def repeated_payloads(packets: DataFrame) -> DataFrame:
    """Of the most frequent payload beginnings those that occur four times or more."""
    rows = cleartext.fingerprints(over(packets, "TCP")).orderBy(F.desc("packets"), "first").limit(TOP["fingerprints"])
    return rows.where(F.col("packets") >= REPEATS).orderBy(F.desc("packets"), "first").limit(SHOWN_REPEATS).drop("first")


def timeline(packets: DataFrame, points: int = POINTS) -> DataFrame:
    """label (month-day hour:minute), packets: by minute, or by wider bins where there are more minutes than points."""
    by = packets.groupBy(F.floor(F.col("ts_us") / 60_000_000).alias("_minute")).agg(F.count("*").alias("_n"))
    ends = by.agg(F.min("_minute").alias("_from"), F.max("_minute").alias("_to"), F.count("*").alias("_minutes"))  # one row
    width = F.when(F.col("_minutes") <= points, 1).otherwise(F.greatest(F.lit(1), F.floor((F.col("_to") - F.col("_from") + 1) / points)))
    told = by.join(F.broadcast(ends.withColumn("_width", width))).withColumn("_bin", F.floor((F.col("_minute") - F.col("_from")) / F.col("_width")))
    start = F.timestamp_seconds((F.first("_from") + F.col("_bin") * F.first("_width")) * 60)
    return told.groupBy("_bin").agg(F.date_format(start, "MM-dd HH:mm").alias("label"), F.sum("_n").alias("packets")).orderBy("_bin").select("label", "packets")


def nearest_rank(values: DataFrame, column: str, percent: float) -> float:
    """One value of sketches.ranks(); 0 for none."""
    found = sketches.ranks(values, column, [percent]).first()
    return found.value if found else 0.0
