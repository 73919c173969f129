"""Capture files: pcap and pcapng, plain or gzip, from any store that Spark reads.

records() cuts files into their packets (one row each, in Python: the format is a chain of lengths); packets() decodes
Ethernet, 802.1Q, Linux cooked and raw IP frames with IPv4 or IPv6, TCP and UDP as columns. Files of stores that workers can
open are read as streams and by byte ranges (sources.ranged). Those of other stores come as rows of Spark's binaryFile
source: one file in one task, and at most 2 GB.

Packet numbers count from 1 in each file, and number what cannot be decoded too. Files are numbered in the order of the paths
given. A file that is no capture, or has no bytes, gives one row with `error` and no packet; a cut-off last packet ends its file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from otspark.functions.net import byte_array, u8, u16
from otspark.sources import ranged

#: Bytes of a packet that hold all headers: link, tags, IPv4 with options or IPv6, TCP with options.
HEADERS = 192

# fixed values: link types
ETHERNET, RAW, COOKED = 1, (12, 14, 101), 113


def cut_records(batches: Iterator[pa.RecordBatch], most: int, files: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of whole files (path, content), numbered by their place in `files`."""
    at = {p: i for i, p in enumerate(files or [])}
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            held = []
            for row in ranged.rows_of(ranged.Range(at.get(path.as_py(), 0), path.as_py(), most=most), content.as_py() or b""):
                held.append(row)
                if len(held) == ranged.BATCH:
                    yield ranged.batch_of(held)
                    held = []
            if held:
                yield ranged.batch_of(held)


def records(spark: SparkSession, path: str | list[str], most: int = 0, range_bytes: int = ranged.RANGE) -> DataFrame:
    """The packets of capture files; `most` keeps the first so many of each file (0: all), and cuts no more of it."""
    files = ranged.listed(spark, path)
    if all(ranged.reachable(p) for p, _ in files):
        return ranged.records(spark, files, most, range_bytes)
    whole = spark.read.format("binaryFile").load([p for p, n in files if n])
    found = whole.select("path", "content").mapInArrow(partial(cut_records, most=most, files=[p for p, _ in files]), ranged.SCHEMA)
    empty = [(i, p.rsplit("/", 1)[-1], p, None, None, None, None, None, "no bytes") for i, (p, n) in enumerate(files) if not n]
    return found.unionByName(spark.createDataFrame(empty, ranged.SCHEMA)) if empty else found


def errors(found: DataFrame) -> DataFrame:
    return found.where("error is not null").select("pcap_file", "path", "error")


def evidence(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Name, size and SHA-256 of the files."""
    listed = ranged.listed(spark, path)
    if all(ranged.reachable(p) for p, _ in listed):
        return ranged.evidence(spark, listed)
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def packets(found: DataFrame) -> DataFrame:
    """Decoded packets: addresses, ports, flags and payload; null where a layer is missing. file_idx follows the order of the paths."""
    raw, octets, link = F.col("raw"), F.col("_octets"), F.col("linktype")
    tagged = (link == ETHERNET) & (u16(octets, 12) == 0x8100)
    told = found.where("packet_number is not null").withColumn("_octets", byte_array(F.substring(raw, 1, HEADERS))).withColumn("eth_type", F.when(tagged, u16(octets, 16)).when(link == ETHERNET, u16(octets, 12)).when(link == COOKED, u16(octets, 14)))
    start = F.when(tagged, 18).when(link == ETHERNET, 14).when(link == COOKED, 16).when(link.isin(*RAW), 0)
    told = told.withColumn("_l3", start).withColumn("_v", F.shiftright(u8(octets, F.col("_l3")), 4))
    is_ip = link.isin(*RAW) | F.col("eth_type").isin(0x0800, 0x86DD)
    told = told.withColumn("ip_version", F.when(is_ip & F.col("_v").isin(4, 6), F.col("_v")))
    at, v4 = F.col("_l3"), F.col("ip_version") == 4
    told = told.withColumn("ip_proto", F.when(v4, u8(octets, at + 9)).when(F.col("ip_version") == 6, u8(octets, at + 6)))
    told = told.withColumn("_l4", F.when(v4, at + u8(octets, at).bitwiseAND(15) * 4).when(F.col("ip_version") == 6, at + 40))
    told = told.withColumn("l3_length", F.when(v4, u16(octets, at + 2)).when(F.col("ip_version") == 6, u16(octets, at + 4) + 40))
    first = v4.isNull() | ~v4 | (u16(octets, at + 6).bitwiseAND(0x1FFF) == 0)  # later fragments have no ports
    transport = F.when(first & (F.col("ip_proto") == 6), "TCP").when(first & (F.col("ip_proto") == 17), "UDP")
    told = told.withColumn("transport", transport)
    l4 = F.col("_l4")
    body = F.when(F.col("transport") == "TCP", l4 + F.shiftright(u8(octets, l4 + 12), 4) * 4).when(F.col("transport") == "UDP", l4 + 8)
    end = F.least(F.length(raw), at + F.col("l3_length"))  # padding of short frames is no payload
    payload = F.when(end > body, F.substring(raw, body + 1, end - body)).otherwise(F.lit(b""))
    mac = lambda i: F.when(link == ETHERNET, F.concat_ws(":", *[F.lower(F.hex(raw.substr(i + k + 1, 1))) for k in range(6)]))
    return told.select(
        "file_idx", "pcap_file", "packet_number", "ts_us", F.timestamp_micros("ts_us").alias("ts"), "length", mac(6).alias("src_mac"), mac(0).alias("dst_mac"), "eth_type", "ip_version",
        address(octets, at, 12, 8).alias("src_ip"), address(octets, at, 16, 24).alias("dst_ip"), "ip_proto", F.when(v4, u8(octets, at + 8)).when(F.col("ip_version") == 6, u8(octets, at + 7)).alias("ttl"), "l3_length",
        F.when(F.col("transport").isNotNull(), u16(octets, l4)).alias("src_port"), F.when(F.col("transport").isNotNull(), u16(octets, l4 + 2)).alias("dst_port"), "transport",
        F.when(F.col("transport") == "TCP", u8(octets, l4 + 13)).alias("tcp_flags"), F.when(F.col("transport").isNotNull(), payload).alias("payload"),
    ).withColumn("payload_length", F.coalesce(F.length("payload"), F.lit(0)))


#: Bytes of a payload that a light record keeps.
LIGHT_PAYLOAD = 4096


def light(packets: DataFrame, most: int = LIGHT_PAYLOAD) -> DataFrame:
    """Light records for behaviour over time: packets with an IP layer, its length, ports of TCP and UDP, the first bytes of the payload and its whole length."""
    proto = F.when(F.col("transport") == "TCP", "tcp").when(F.col("transport") == "UDP", "udp").when(F.col("ip_proto").isin(1, 58), "icmp").otherwise("other")
    return packets.where("ip_version in (4, 6)").select("file_idx", "packet_number", "ts_us", (F.col("ts_us") / 1e6).alias("ts"), "src_ip", "dst_ip", "ip_version", proto.alias("proto"), "ip_proto", F.col("l3_length").alias("length"), "src_port", "dst_port", "transport", F.substring("payload", 1, most).alias("payload"), F.coalesce(F.length("payload"), F.lit(0)).alias("payload_length"))


def address(octets: Column, l3: Column, v4: int, v6: int) -> Column:
    """IPv4 as dotted text; IPv6 as eight groups of hex digits without leading zeros."""
    four = F.concat_ws(".", *[u8(octets, l3 + v4 + i).cast("string") for i in range(4)])
    six = F.concat_ws(":", *[F.lower(F.hex(u16(octets, l3 + v6 + 2 * i))) for i in range(8)])
    return F.when(F.col("ip_version") == 4, four).when(F.col("ip_version") == 6, six)
