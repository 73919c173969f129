"""Readable payloads: industrial requests, banners, web and name requests, tool marks and credentials that nobody encrypted.

observations() gives a row for each thing that a packet shows of an industrial process; the other functions give labels
and values as Column expressions or short DataFrames. Nothing is decrypted or reassembled: a packet is looked at alone.

Packets have the columns of sources.capture.packets(); null payloads and addresses show nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otspark.functions import codes
from otspark.functions.dims import CLEARTEXT_WRITES, PORTS
from otspark.functions.net import byte_array, either_port, size, u8, u16, u16le
from otspark.sources.packets import ORDER

#: Lengths in BER beyond this are no SNMP request.
LONGEST_SNMP, LONGEST_COMMUNITY = 512, 64
#: Bytes that tool marks, credentials and tokens are looked for in.
MARK_BYTES, HEAD_BYTES, HOST_BYTES = 2048, 4096, 2048
#: Samples of a kind that a report shows.
SAMPLES, CREDENTIALS, BANNERS, HOSTS = 40, 24, 40, 200
#: Payloads whose beginning is fingerprinted: shortest, longest, bytes taken.
FINGERPRINT = (32, 1400, 48)

# fixed values: marks of scanning tools, in the order in which they are looked for
MARKS = ("Nmap", "nmap.org", "Masscan", "masscan", "Nuclei/", "Zmap", "plcscan", "s7-scan", "PLC-Scan")
# fixed values: words in web requests that point at industrial devices
TOKENS = r"(?i)(?:modbus|opc[\s_-]?ua|opcua|/plc|plc[/._]|dnp3|iec[\s_-]?104|s7comm|siemens|rockwell|allen[\s_-]?bradley|scada|historian|/hmi|hmi[/._]|mqtt|sparkplug|profinet|bacnet|iec[\s_-]?61850|goose|mms\b)"
# fixed values: the categories that make a cleartext finding a high one
RISKY = ("modbus_tcp_cleartext", "iec104_cleartext", "snmp_cleartext_community", "s7comm_cleartext", "dnp3_cleartext", "modbus_port_cleartext_non_mbap")

ICS_TCP = {p: service for p, _, service, transport, ics, _ in PORTS if ics and transport in ("tcp", "both")}


def text_of(payload: Column, n: int) -> Column:
    """The first bytes as text; what is no UTF-8 shows as U+FFFD."""
    return F.make_valid_utf8(F.substring(payload, 1, n).cast("string"))


def begins_with(payload: Column, *heads: str) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | F.coalesce(F.substring(payload, 1, len(h)) == F.lit(h.encode()), F.lit(False))
    return out


def holds(payload: Column, word: bytes) -> Column:
    return F.coalesce(F.contains(payload, F.lit(word)), F.lit(False))


def is_tls(b: Column) -> Column:
    """A TLS record of a handshake: 22, 3, and a minor version of 1 to 4. `b` is a byte_array."""
    return F.coalesce((u8(b, 0) == 0x16) & (u8(b, 1) == 3) & u8(b, 2).between(1, 4), F.lit(False))


def ber(b: Column, at: Column) -> Column:
    """Length at a position and where its value begins; a length of 0 where it can't be read."""
    first = u8(b, at)
    n = first.bitwiseAND(127)
    long = F.when(n == 1, u8(b, at + 1)).when(n == 2, u16(b, at + 1)).otherwise(F.lit(0))
    return F.struct(F.coalesce(F.when(first < 128, first).otherwise(long), F.lit(0)).alias("length"), (at + 1 + F.when(first < 128, 0).otherwise(n)).alias("at"))


def redacted(name: Column) -> Column:
    """First and last character of a community, stars between."""
    n = F.length(name)
    return F.when(n == 0, "**").when(n <= 2, F.concat(name.substr(1, 1), F.lit("*"))).when(n <= 4, F.concat(name.substr(1, 1), F.lit("**"), F.right(name, F.lit(1)))).otherwise(F.concat(name.substr(1, 1), F.repeat(F.lit("*"), F.least(F.lit(8), n - 2)), F.right(name, F.lit(1))))


def with_community(packets: DataFrame) -> DataFrame:
    """Adds _community: the redacted community of an SNMP request over UDP port 161; null where there is none."""
    b, p = F.col("_bytes"), F.col("payload")
    asked = (F.col("transport") == "UDP") & either_port(F.col("src_port"), F.col("dst_port"), (161,)) & (size(p) >= 12) & (u8(b, 0) == 0x30)
    told = packets.withColumn("_whole", F.when(asked, ber(b, F.lit(1))))
    i = F.col("_whole.at")
    told = told.withColumn("_end", F.when((F.col("_whole.length") > 0) & (F.col("_whole.length") <= LONGEST_SNMP) & (i + F.col("_whole.length") <= size(p)), i + F.col("_whole.length")))
    ok = (i + 3 <= F.col("_end")) & (u8(b, i) == 2) & (u8(b, i + 1) == 1) & (u8(b, i + 2) <= 3) & (i + 5 <= F.col("_end")) & (u8(b, i + 3) == 4)
    told = told.withColumn("_name", F.when(ok, ber(b, i + 4)))
    n, at = F.col("_name.length"), F.col("_name.at")
    raw = F.when((n > 0) & (n <= LONGEST_COMMUNITY) & (at + n <= F.col("_end")), F.trim(F.make_valid_utf8(p.substr(at + 1, n).cast("string"))))
    return told.withColumn("_community", redacted(raw)).drop("_whole", "_end", "_name")


def observations(packets: DataFrame) -> DataFrame:
    """Packet columns and category, sensitivity, summary, preview_hex, dedupe_key, excerpt, community: none or some rows a packet."""
    p, b = F.col("payload"), F.col("_bytes")
    src, dst = F.col("src_port"), F.col("dst_port")
    on = lambda *ports: either_port(src, dst, ports)
    n = size(p)
    no = F.lit(None).cast("string")

    def seen(category: str, when: Column, sensitivity, summary, key, *, bytes_: int = 36, excerpt: Column = no, community: Column = no) -> Column:
        of = lambda x: x if isinstance(x, Column) else F.lit(x)
        preview = F.lower(F.hex(F.substring(p, 1, bytes_)))
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(category).alias("category"), of(sensitivity).alias("sensitivity"), of(summary).alias("summary"), preview.alias("preview_hex"), of(key).alias("dedupe_key"), excerpt.alias("excerpt"), community.alias("community")))

    tcp = (F.col("transport") == "TCP") & (n >= 4) & ~is_tls(b)
    code = u8(b, 7)
    known = F.create_map(*[F.lit(x) for pair in codes.MODBUS_CLEARTEXT.items() for x in pair])
    whole = (n >= 8) & (u16(b, 2) == 0) & code.isin(*codes.MODBUS_CLEARTEXT)
    modbus = tcp & on(502) & whole & u16(b, 4).between(2, 260)
    writes = code.isin(*CLEARTEXT_WRITES)
    told = F.concat(F.format_string("readable Modbus request of unit %d: function %d, %s", u8(b, 6), code, F.try_element_at(known, code)), F.when(writes, ", which writes").otherwise(""))
    first = F.coalesce(
        seen("modbus_tcp_cleartext", modbus, F.when(writes, "HIGH").otherwise("MEDIUM"), told, F.concat(F.lit("mb"), code.cast("string"))),
        seen("iec104_cleartext", tcp & (n >= 6) & (u8(b, 0) == 0x68) & u8(b, 1).between(4, 253), F.when(on(2404), "HIGH").otherwise("MEDIUM"), F.when(on(2404), "readable IEC 104 telecontrol frame").otherwise("bytes shaped like an IEC 104 frame, on another port"), "104"),
        seen("s7comm_cleartext", tcp & on(102) & (n >= 7) & (u16(b, 0) == 0x0300) & u16(b, 2).between(7, 2048), "HIGH", "readable S7 envelope (TPKT)", "s7"),
        seen("dnp3_cleartext", tcp & on(20000) & (n >= 10) & (u16(b, 0) == 0x0564), "HIGH", "readable DNP3 link frame", "dnp3"),
        seen("opcua_cleartext", tcp & on(4840) & (n >= 8) & begins_with(p, "HEL"), "MEDIUM", "readable OPC UA greeting", "opcua"),
        seen("enip_cleartext", tcp & on(44818) & (u16le(b, 0) == 0x0065), "MEDIUM", "readable EtherNet/IP session request", "enip65"),
    )
    other = seen("modbus_port_cleartext_non_mbap", tcp & on(502) & ~F.coalesce(modbus, F.lit(False)) & ~F.coalesce(whole, F.lit(False)), "MEDIUM", "readable bytes on the Modbus port that are no Modbus request", "502unk")
    port = F.when(dst.isin(*ICS_TCP), dst).when(src.isin(*ICS_TCP), src)
    service = F.try_element_at(F.create_map(*[F.lit(x) for pair in ICS_TCP.items() for x in pair]), port)
    some = seen("ics_tcp_port_cleartext_payload", tcp & (n >= 12) & port.isNotNull() & F.isnull(first) & F.isnull(other), "MEDIUM", F.format_string("readable bytes on port %d (%s)", port, service), F.concat(F.lit("gen"), port.cast("string")))
    head = text_of(p, HEAD_BYTES)
    around = F.regexp_extract(head, r"(?s)(.{0,24}" + TOKENS + r".{0,48})", 1)
    web = seen("http_cleartext_ot_context", tcp & begins_with(p, "GET ", "POST ", "PUT ", "HTTP/") & head.rlike(TOKENS), "MEDIUM", "web request or answer that names industrial devices", "httpot", bytes_=24, excerpt=F.substring(F.trim(F.regexp_replace(around, r"\s+", " ")), 1, 220))
    udp = F.col("transport") == "UDP"
    bacnet = seen("bacnet_ip_cleartext", udp & on(47808) & (n >= 4) & (u8(b, 0) == 0x81), "MEDIUM", "readable BACnet/IP message", "bacnet")
    snmp = seen("snmp_cleartext_community", F.col("_community").isNotNull(), "HIGH", "readable SNMP community (shown redacted)", "snmp", community=F.col("_community"))
    told = with_community(packets.where(n > 0).withColumn("_bytes", byte_array(p)))
    return told.select(*packets.columns, F.inline(F.array_compact(F.array(first, other, some, web, bacnet, snmp))))


def samples(found: DataFrame, most: int = SAMPLES) -> DataFrame:
    """The first observations of each (category, endpoints, key) in processing order, the first `most` of these."""
    one = Window.partitionBy("category", "src_ip", "dst_ip", "dst_port", "src_port", "dedupe_key").orderBy(*ORDER)
    return found.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n").orderBy(*ORDER, "category").limit(most)


def hint(b: Column) -> Column:
    """ssh_banner, ftp_banner or telnet_port, the first that holds; null for none. For TCP packets of four bytes or more."""
    p = F.col("payload")
    ftp = begins_with(p, "220 ") & F.lower(text_of(p, 80)).contains("ftp")
    label = F.when(begins_with(p, "SSH-2.0", "SSH-1.99"), "ssh_banner").when(ftp, "ftp_banner").when(either_port(F.col("src_port"), F.col("dst_port"), (23,)), "telnet_port")
    return F.when((F.col("transport") == "TCP") & (size(p) >= 4), label)


def is_web() -> Column:
    return (F.col("transport") == "TCP") & begins_with(F.col("payload"), "GET ", "POST ", "HTTP/")


def web_host() -> Column:
    """Value of the Host header of a web request; null without one."""
    host = F.substring(F.trim(F.regexp_extract(text_of(F.col("payload"), HOST_BYTES), r"(?i)Host:\s*([^\r\n]+)", 1)), 1, 255)
    return F.when(is_web(), F.nullif(host, F.lit("")))


def tool_mark() -> Column:
    """The first mark of a scanning tool in a TCP payload."""
    head = F.substring("payload", 1, MARK_BYTES)
    out = None
    for m in MARKS:
        out = F.when(holds(head, m.encode()), m) if out is None else out.when(holds(head, m.encode()), m)
    return F.when((F.col("transport") == "TCP") & (size(F.col("payload")) >= 4), out)


def credential() -> Column:
    """http_basic_auth or ftp_user_line; null for none."""
    head = F.substring("payload", 1, HEAD_BYTES)
    user = holds(head, b"\r\nUSER ") | F.upper(text_of(F.col("payload"), 5)).eqNullSafe("USER ")
    return F.when((F.col("transport") == "TCP") & (size(F.col("payload")) >= 4), F.when(holds(head, b"Authorization: Basic "), "http_basic_auth").when(user, "ftp_user_line"))


def fingerprints(packets: DataFrame) -> DataFrame:
    """fingerprint, packets, first: digest of the first 48 bytes of TCP payloads of 32 to 1400 bytes that are no TLS."""
    least, most, taken = FINGERPRINT
    told = packets.where((F.col("transport") == "TCP") & size(F.col("payload")).between(least, most)).withColumn("_bytes", byte_array(F.substring("payload", 1, 4))).where(~is_tls(F.col("_bytes")))
    return told.groupBy(F.md5(F.substring("payload", 1, taken)).alias("fingerprint")).agg(F.count("*").alias("packets"), F.min(F.struct(*ORDER)).alias("first"))


def dns_names(packets: DataFrame) -> DataFrame:
    """Packet columns and qname: the first question of DNS messages over UDP port 53, labels joined by dots.

    Labels are walked by an aggregate over at most 128 steps (a name has no more labels); a pointer is followed, and a name
    that runs out of the message is none.
    """
    p, b = F.col("payload"), F.col("_bytes")
    asked = (F.col("transport") == "UDP") & either_port(F.col("src_port"), F.col("dst_port"), (53,)) & (size(p) > 12)
    told = packets.where(asked).withColumn("_bytes", byte_array(p)).where(u16(b, 4) > 0)
    begin = F.struct(F.lit(12).alias("at"), F.array().cast("array<binary>").alias("labels"), F.lit(0).alias("state"))

    def step(got: Column, _: Column) -> Column:
        at, n = got["at"], u8(b, got["at"])
        broken = n.isNull() | ((n >= 64) & (n < 192)) | ((n < 64) & (at + 1 + n > size(p)))
        pointer = F.struct(F.coalesce(u16(b, at).bitwiseAND(0x3FFF), F.lit(1 << 20)).alias("at"), got["labels"].alias("labels"), F.lit(0).alias("state"))
        label = F.struct((at + 1 + n).alias("at"), F.array_append(got["labels"], p.substr(at + 2, n)).alias("labels"), F.lit(0).alias("state"))
        over = lambda state: F.struct(at.alias("at"), got["labels"].alias("labels"), F.lit(state).alias("state"))
        return F.when(got["state"] != 0, got).when(broken, over(2)).when(n == 0, over(1)).when(n >= 192, pointer).otherwise(label)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(128)), begin, step)
    told = told.withColumn("_walk", walked).where("_walk.state = 1")
    name = F.array_join(F.transform(F.col("_walk.labels"), lambda x: F.make_valid_utf8(x.cast("string"))), ".")
    return told.withColumn("qname", name).where("qname <> ''").select(*packets.columns, "qname")
