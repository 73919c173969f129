"""Flows: directional 5-tuples with counts, rates, packet-length and inter-packet moments.

Moments come from integer sums (n, sum, sum of squares), which partial aggregation adds exactly in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from otspark.functions.dims import ENGINEERING_ROLES, ICS_APP_PORTS, IT_EDGE
from otspark.functions.net import flow_id, is_private, is_public
from otspark.sources.packets import FLOW, ORDER

#: Gaps of an hour or more are no inter-packet times.
LONGEST_GAP_US = 3_600_000_000
#: Packet numbers that one running count spans.
BLOCK = 100_000


#: Packet numbers of one piece of a flow: a flow of any length is worked out in pieces, and its pieces are put together in order.
PIECE = 16_384
PIECES = [*FLOW, "file_idx", "_piece"]


def within() -> WindowSpec:
    """The packets of a piece in processing order."""
    return Window.partitionBy(*PIECES).orderBy("packet_number")


def among() -> WindowSpec:
    """The pieces of a flow in processing order."""
    return Window.partitionBy(*FLOW).orderBy("file_idx", "_piece")


def in_pieces(packets: DataFrame) -> DataFrame:
    """Packets with a whole 5-tuple, and their _piece: flow, file and piece together have PIECE packets at most."""
    return packets.where(" AND ".join(f"{c} IS NOT NULL" for c in FLOW)).withColumn("_piece", F.floor(F.col("packet_number") / PIECE))


def proper(gap: Column) -> Column:
    """A gap that is an inter-packet time: over 0 and under an hour, else null."""
    return F.when((gap > 0) & (gap < LONGEST_GAP_US), gap)


def with_gaps(packets: DataFrame) -> DataFrame:
    """Adds ipt_us: time since the packet before in the flow, in processing order, where it is over 0 and under an hour.

    The first packet of a piece takes the last time of the piece before from the table of pieces.
    """
    rows = in_pieces(packets)
    last = rows.groupBy(*PIECES).agg(F.max_by("ts_us", "packet_number").alias("_last"))
    last = last.withColumn("_last", F.lag("_last").over(among())).where("_last is not null")
    told = rows.withColumn("_before", F.lag("ts_us").over(within())).join(last, PIECES, "left")
    gap = F.col("ts_us") - F.coalesce("_before", "_last")
    return told.withColumn("ipt_us", proper(gap)).select(*packets.columns, "ipt_us")


def moments(packets: DataFrame) -> DataFrame:
    """One row per flow: counts and integer sums of lengths and inter-packet times, first and last times, first packet.

    A piece gives the sums of its own gaps, its first and last time; what lies between two pieces is added when a flow's
    pieces are folded in order. So a flow with all packets of a capture is the work of many tasks.
    """
    dec = lambda c: c.cast("decimal(38,0)")
    rows = in_pieces(packets).withColumn("_gap", proper(F.col("ts_us") - F.lag("ts_us").over(within())))
    pieces = rows.groupBy(*PIECES).agg(
        F.count("*").alias("_n"), F.sum("length").alias("_l"), F.sum(dec(F.col("length")) * dec(F.col("length"))).alias("_l2"), F.min("ts_us").alias("_start"), F.max("ts_us").alias("_end"),
        F.count("_gap").alias("_k"), F.sum("_gap").alias("_i"), F.sum(dec(F.col("_gap")) * dec(F.col("_gap"))).alias("_i2"),
        F.min_by("ts_us", "packet_number").alias("_first"), F.max_by("ts_us", "packet_number").alias("_last"), F.min("packet_number").alias("_from"),
    )
    joined = pieces.withColumn("_gap", proper(F.col("_first") - F.lag("_last").over(among())))
    gap = F.coalesce("_gap", F.lit(0))
    both = lambda own, between: F.sum(F.coalesce(F.col(own), F.lit(0)) + between)
    return joined.groupBy(*FLOW).agg(
        F.sum("_n").alias("packet_count"), F.sum("_l").alias("byte_count"), F.sum("_l2").alias("_l2"), F.min("_start").alias("start_us"), F.max("_end").alias("end_us"),
        both("_k", F.col("_gap").isNotNull().cast("long")).alias("ipt_count"), both("_i", gap).alias("_i"), both("_i2", dec(gap) * dec(gap)).alias("_i2"),
        F.min(F.struct("file_idx", F.col("_from").alias("packet_number"))).alias("_first"),
    )


def deviation(n: Column, s: Column, s2: Column) -> Column:
    """Sample standard deviation from integer sums; 0 under two values."""
    dec = lambda c: c.cast("decimal(38,0)")
    n_, rough = n.cast("double"), n.cast("double") * s2.cast("double") - s.cast("double") * s.cast("double")
    top = F.coalesce(F.try_subtract(F.try_multiply(dec(n), dec(s2)), F.try_multiply(dec(s), dec(s))).cast("double"), rough)  # beyond 38 digits: as doubles
    return F.when(n > 1, F.sqrt(F.greatest(top, F.lit(0.0)) / (n_ * (n_ - 1)))).otherwise(0.0)


def flow_build(packets: DataFrame) -> DataFrame:
    """One row per flow; first_seq is its first packet in processing order."""
    agg = moments(packets)
    seconds = (F.col("end_us") - F.col("start_us")) / 1e6
    per = lambda c: F.when(seconds > 0, F.col(c) / seconds).otherwise(0.0)
    return agg.select(
        flow_id(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("transport")).alias("flow_id"), *FLOW, "packet_count", "byte_count", "start_us", "end_us",
        seconds.alias("duration_seconds"), per("packet_count").alias("packets_per_second"), per("byte_count").alias("bytes_per_second"),
        (F.col("byte_count") / F.col("packet_count")).alias("avg_packet_size"),
        deviation(F.col("packet_count"), F.col("byte_count"), F.col("_l2")).alias("packet_length_std"),
        "ipt_count", F.coalesce(F.try_divide("_i", "ipt_count") / 1e6, F.lit(0.0)).alias("avg_inter_packet_time"),
        F.coalesce(deviation(F.col("ipt_count"), F.col("_i"), F.col("_i2")) / 1e6, F.lit(0.0)).alias("jitter"),
        F.col("_first.file_idx").alias("first_file"), F.col("_first.packet_number").alias("first_packet"),
    )


def with_frames(flows: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds what frames say of their flow: protocols, function codes, writes, exceptions."""
    protocol, fc = F.col("protocol"), F.col("function_code")
    rolled = frames.groupBy(*FLOW).agg(
        F.array_sort(F.collect_set("protocol")).alias("ics_protocols"),
        F.array_sort(F.collect_set(fc)).alias("function_codes_seen"),
        F.array_sort(F.collect_set(F.when((protocol == "Modbus") & F.col("is_write_operation"), fc))).alias("modbus_write_fcs_seen"),
        F.array_sort(F.collect_set(F.when(protocol == "S7", fc))).alias("s7_service_codes_seen"),
        F.bool_or("is_write_operation").alias("has_write_operations"),
        F.count_if("is_exception").alias("exception_count"),
    )
    none = lambda t: F.array().cast(f"array<{t}>")
    out = flows.join(rolled, FLOW, "left")
    for c, t in (("ics_protocols", "string"), ("function_codes_seen", "int"), ("modbus_write_fcs_seen", "int"), ("s7_service_codes_seen", "int")):
        out = out.withColumn(c, F.coalesce(c, none(t)))
    return out.withColumn("ics_protocol", F.when(F.size("ics_protocols") > 0, F.array_join("ics_protocols", ", "))).fillna({"has_write_operations": False, "exception_count": 0})


def top_talkers(flows: DataFrame, n: int = 25) -> DataFrame:
    """Sources by packets; ties go to the one seen first."""
    by = flows.groupBy("src_ip").agg(F.sum("packet_count").alias("packets"), F.min(F.struct("first_file", "first_packet")).alias("_first"))
    return by.orderBy(F.desc("packets"), "_first").limit(n).select("src_ip", "packets")


def top_flows(flows: DataFrame, n: int = 40) -> DataFrame:
    return flows.orderBy(F.desc("packet_count"), "first_file", "first_packet").limit(n)


def protocol_distribution(flows: DataFrame) -> DataFrame:
    """Packets by protocol label; a flow counts under each of its labels, without any under its transport."""
    return flows.select(F.explode_outer("ics_protocols").alias("_p"), "transport", "packet_count").groupBy(F.coalesce("_p", "transport").alias("protocol")).agg(F.sum("packet_count").alias("packets"))


def comm_matrix(flows: DataFrame) -> DataFrame:
    return flows.groupBy("src_ip", "dst_ip").agg(F.sum("packet_count").alias("packets"))


def matrix_trim(matrix: DataFrame, endpoints: int) -> DataFrame:
    """Only edges between the busiest endpoints (packets in and out; ties by address)."""
    both = matrix.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"), "packets")
    keep = both.groupBy("ip").agg(F.sum("packets").alias("_n")).orderBy(F.desc("_n"), "ip").limit(endpoints).select("ip")
    return matrix.join(F.broadcast(keep.withColumnRenamed("ip", "src_ip")), "src_ip", "left_semi").join(F.broadcast(keep.withColumnRenamed("ip", "dst_ip")), "dst_ip", "left_semi").select("src_ip", "dst_ip", "packets")


def temporal_heatmap(flows: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Packets of flows by the bucket in which the flow starts."""
    size = bucket_seconds * 1_000_000
    return flows.groupBy((F.floor(F.col("start_us") / size) * bucket_seconds).cast("long").alias("bucket")).agg(F.sum("packet_count").alias("packets"))


def flow_stats(flows: DataFrame) -> DataFrame:
    return flows.agg(F.count("*").alias("flows"), F.coalesce(F.sum("packet_count"), F.lit(0)).alias("packets"), F.coalesce(F.sum("byte_count"), F.lit(0)).alias("bytes"), F.countDistinct("src_ip").alias("sources"), F.countDistinct("dst_ip").alias("destinations"))


def frame_stats(flows: DataFrame) -> DataFrame:
    """One row: flows with industrial frames, with writes, with exceptions."""
    return flows.agg(F.count_if(F.size("ics_protocols") > 0).alias("ics_flows"), F.count_if("has_write_operations").alias("write_flows"), F.count_if(F.col("exception_count") > 0).alias("exception_flows"))


def exported(flows: DataFrame) -> DataFrame:
    """Flows as rows of an export: rounded figures, times as text in UTC."""
    places = {"duration_seconds": 3, "packets_per_second": 2, "bytes_per_second": 2, "avg_packet_size": 1, "packet_length_std": 2, "avg_inter_packet_time": 6, "jitter": 6}
    time = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    told = flows.withColumns({c: F.round(c, n) for c, n in places.items()})
    return told.withColumn("start_time", time("start_us")).withColumn("end_time", time("end_us")).drop("start_us", "end_us", "first_file", "first_packet")


def periodic_flows(flows: DataFrame, min_packets: int = 10, cv: float = 0.3) -> DataFrame:
    mean, std = F.col("avg_inter_packet_time"), F.col("jitter")
    return flows.where((F.col("packet_count") >= min_packets) & (F.col("ipt_count") >= min_packets - 1) & (mean > 0)).withColumn("cv", std / mean).where(F.col("cv") < cv)


def timing_irregular(flows: DataFrame) -> DataFrame:
    """Flows whose inter-packet times vary by over 2.5 times their mean."""
    cv = F.col("jitter") / F.col("avg_inter_packet_time")
    return flows.where((F.col("ipt_count") >= 20) & (F.col("packet_count") > 40) & (F.col("avg_inter_packet_time") > 0)).withColumn("cv", cv).where(F.col("cv") > 2.5)


def size_dispersion(flows: DataFrame) -> DataFrame:
    """Flows whose packet lengths vary by over 0.85 times their mean."""
    return flows.where((F.col("packet_count") > 30) & (F.col("avg_packet_size") > 0)).withColumn("cv", F.col("packet_length_std") / F.col("avg_packet_size")).where(F.col("cv") > 0.85)


def rare_function_codes(frames: DataFrame) -> DataFrame:
    """Frames whose code is rare so far: under three times and under a thousandth of its protocol's frames, from the hundredth on.

    A code's first two frames are few, so the running total is taken for them alone: frames are counted by blocks of
    processing order, and a frame's total is that of the blocks before and of its place in its own block.
    """
    by_code = Window.partitionBy("protocol", "function_code").orderBy(*ORDER)
    early = frames.withColumn("_times", F.row_number().over(by_code)).where("_times < 3")
    place = Window.partitionBy("protocol", "file_idx", "_block").orderBy("packet_number")
    blocks = frames.withColumn("_block", F.floor(F.col("packet_number") / BLOCK))
    numbered = blocks.withColumn("_in", F.count("*").over(place)).select("protocol", *ORDER, "_block", "_in")
    sums = blocks.groupBy("protocol", "file_idx", "_block").agg(F.count("*").alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("protocol").orderBy("file_idx", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = numbered.join(early.select("protocol", *ORDER).distinct(), ["protocol", *ORDER], "left_semi").join(before, ["protocol", "file_idx", "_block"])
    totals = totals.select("protocol", *ORDER, (F.col("_before") + F.col("_in")).alias("_total"))
    rare = early.join(totals, ["protocol", *ORDER]).where((F.col("_total") >= 100) & (F.col("_times") / F.col("_total") < 0.001))
    return rare.withColumn("severity", F.when(F.col("is_write_operation"), "MEDIUM").otherwise("LOW"))


def multi_target_sources(flows: DataFrame, least: int = 4) -> DataFrame:
    """Addresses with at least so many peers on the ports of industrial protocols: destinations they ask, and sources that answer them."""
    asks = flows.where(F.col("dst_port").isin(*ICS_APP_PORTS)).select("src_ip", "dst_ip")
    answered = flows.where(F.col("src_port").isin(*ICS_APP_PORTS)).select(F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"))
    return asks.union(answered).groupBy("src_ip").agg(F.countDistinct("dst_ip").alias("targets")).where(F.col("targets") >= least)


def unauthorized_reads(flows: DataFrame, assets: DataFrame) -> DataFrame:
    """Modbus flows that read (codes 3, 4) and never write, from an address whose role is none of engineering."""
    reads = F.array_contains("ics_protocols", "Modbus") & (F.size("modbus_write_fcs_seen") == 0) & F.arrays_overlap("function_codes_seen", F.array(F.lit(3), F.lit(4)))
    told = flows.where(reads).join(assets.select(F.col("ip_address").alias("src_ip"), F.col("role").alias("src_role")), "src_ip", "left")
    return told.fillna({"src_role": "UNKNOWN"}).where(~F.col("src_role").isin(*ENGINEERING_ROLES))


def write_meaning(codes: str = "modbus_write_fcs_seen") -> Column:
    """What the Modbus writes of a flow may do, code by code."""
    kind = lambda c: F.when(c.isin(5, 6, 15, 16), " write (coil/register)").when(c.isin(20, 21), " file record").when(c.isin(22, 23), " mask or read-write registers").otherwise(" write family")
    return F.array_join(F.transform(codes, lambda c: F.concat(F.lit("FC"), c.cast("string"), kind(c))), "; ")


def it_edge_flows(flows: DataFrame) -> DataFrame:
    """Flows on ports of office services, with port and label (the destination's before the source's)."""
    names = F.create_map(*[F.lit(x) for pair in IT_EDGE.items() for x in pair])
    of = lambda c: F.when(F.col(c).isin(*IT_EDGE), F.col(c))
    out = flows.withColumn("port", F.coalesce(of("dst_port"), of("src_port"))).where("port is not null")
    return out.withColumn("label", F.try_element_at(names, "port"))


def cross_boundary(flows: DataFrame) -> DataFrame:
    """Flows between a private and a public address."""
    a, b = F.col("src_ip"), F.col("dst_ip")
    return flows.where((is_private(a) & is_public(b)) | (is_public(a) & is_private(b)))


def new_edges(before: DataFrame, now: DataFrame) -> DataFrame:
    """Pairs of addresses that are in the second and not in the first."""
    return now.select("src_ip", "dst_ip").distinct().join(before.select("src_ip", "dst_ip").distinct(), ["src_ip", "dst_ip"], "left_anti")
