"""Packets as they come: files of captures or packet tables as streams, traffic and flows by windows of event time, new pairs.

Streams have the columns of sources.capture.packets(). Windows close when the watermark passes them; packets later than that
are left out. State is bounded by the watermark: open windows, and pairs seen within it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otspark.operators import decode, rules
from otspark.sources import capture, ranged
from otspark.sources.packets import FLOW

LATE, WINDOW, QUIET = "10 minutes", "1 minute", "5 minutes"


def captures(spark: SparkSession, folder: str, most: int = 0) -> DataFrame:
    """Packets of capture files as they arrive in a folder; file_idx is 0, as there is no last file to count up to."""
    arrived = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder).select("path", "content")
    records = arrived.mapInArrow(partial(capture.cut_records, most=most), ranged.SCHEMA)
    return capture.packets(records)


def tables(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Packets of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def timed(packets: DataFrame, late: str = LATE) -> DataFrame:
    return packets.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def traffic(packets: DataFrame, window: str = WINDOW, late: str = LATE, slide: str | None = None) -> DataFrame:
    """Packets and bytes of each window."""
    return timed(packets, late).groupBy(F.window("ts", window, slide)).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "packets", "bytes")


def flow_sessions(packets: DataFrame, quiet: str = QUIET, late: str = LATE) -> DataFrame:
    """Flows cut where nothing came for a while: 5-tuple, start, end, packets, bytes."""
    keyed = timed(packets, late).where(" AND ".join(f"{c} IS NOT NULL" for c in FLOW))
    rows = keyed.groupBy(*FLOW, F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))
    return rows.select(*FLOW, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "packets", "bytes")


def new_pairs(packets: DataFrame, late: str = "1 day") -> DataFrame:
    """The first packet of each unordered pair of addresses within the watermark."""
    pair = F.concat_ws(" ", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip"))
    return timed(packets, late).where("src_ip IS NOT NULL AND dst_ip IS NOT NULL").withColumn("pair", pair).dropDuplicatesWithinWatermark(["pair"]).select("pair", "ts", "src_ip", "dst_ip")


def rule_events(packets: DataFrame, protocols: list[str] | None = None, min_severity: str = "INFO") -> DataFrame:
    """Events of rules as packets come; there is no state in it."""
    return rules.events(decode.decode(packets, protocols, typed=True), min_severity=min_severity)
