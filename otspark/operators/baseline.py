"""Behaviour of a network over time: edges and hosts, rare and one-to-many edges, traffic per second with spikes and drops, polling intervals, comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otspark.functions.dims import BASELINE_ICS, BASELINE_IT
from otspark.operators import flows
from otspark.operators.assets import literal_map
from otspark.sources.packets import FLOW, ORDER

#: Seconds of the rolling mean that one block holds before it is cut with an overlap.
SPAN = 86_400


def edges(packets: DataFrame) -> DataFrame:
    return packets.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


def top_hosts(found: DataFrame, n: int = 50) -> DataFrame:
    """Hosts by the bytes that they sent or received, with their distinct destinations; from edges()."""
    ends = found.select(F.explode(F.array(F.struct(F.col("src_ip").alias("ip"), F.lit(1).alias("_s")), F.struct(F.col("dst_ip").alias("ip"), F.lit(0).alias("_s")))).alias("_e"), "bytes")
    return ends.groupBy("_e.ip").agg(F.sum("bytes").alias("total_bytes"), F.sum("_e._s").alias("peers_as_source")).orderBy(F.desc("total_bytes"), "ip").limit(n)


def rare_edges(found: DataFrame, percentile: float = 10.0) -> DataFrame:
    """Edges of at most so many packets as the percentile (linear between ranks) of all edges."""
    bound = found.agg(F.percentile("packets", F.lit(percentile / 100)).alias("_p"))
    return found.join(F.broadcast(bound), how="inner").where("packets <= _p").drop("_p")  # one row: the aggregate


def one_to_many(found: DataFrame, least: int = 8, n: int = 40) -> DataFrame:
    """Sources of at least so many destinations; edges() has one row for each pair."""
    return found.groupBy("src_ip").agg(F.count("*").alias("destinations")).where(F.col("destinations") >= least).orderBy(F.desc("destinations"), "src_ip").limit(n)


def transport_split(packets: DataFrame) -> DataFrame:
    """Packets by transport with their share in percent."""
    by = packets.groupBy(F.coalesce(F.lower("transport"), F.lit("other")).alias("l4")).agg(F.count("*").alias("packets"))
    total = by.agg(F.sum("packets").alias("_t"))
    return by.join(F.broadcast(total), how="inner").select("l4", "packets", (F.col("packets") * 100.0 / F.col("_t")).alias("percent"))  # one row: the aggregate


def service_flags(packets: DataFrame) -> DataFrame:
    """Distinct (source, destination, port) of office services, the destination's port before the source's."""
    of = lambda c: F.when(F.col(c).isin(*BASELINE_IT), F.col(c))
    told = packets.withColumn("port", F.coalesce(of("dst_port"), of("src_port"))).where("port is not null")
    return told.groupBy("src_ip", "dst_ip", "port").agg(F.count("*").alias("packets")).withColumn("service", F.try_element_at(literal_map(BASELINE_IT), "port"))


def industrial_hits(packets: DataFrame) -> DataFrame:
    """Packets and bytes by industrial protocol of either port; a packet's bytes are shared among its protocols."""
    names = literal_map(BASELINE_ICS)
    slugs = F.array_compact(F.array_distinct(F.array(F.try_element_at(names, "src_port"), F.try_element_at(names, "dst_port"))))
    told = packets.where("transport = 'TCP'").select("length", slugs.alias("_s")).where("size(_s) > 0")
    return told.select(F.explode("_s").alias("protocol"), F.expr("length div size(_s)").alias("_b")).groupBy("protocol").agg(F.count("*").alias("packets"), F.sum("_b").alias("bytes"))


def per_second(packets: DataFrame) -> DataFrame:
    """Packets and bytes by whole second since the first packet; seconds without packets have no row."""
    first = packets.agg(F.min("ts_us").alias("_t0"))
    told = packets.join(F.broadcast(first), how="inner")  # one row: the aggregate
    return told.groupBy(F.expr("(ts_us - _t0) div 1000000").alias("sec")).agg(F.count("*").alias("pps"), F.sum("length").alias("bps"))


def rolling_anomalies(seconds: DataFrame, window: int = 30, spike: float = 3.0, drop: float = 0.1) -> DataFrame:
    """Seconds (sec, pps) that stand out from the mean of the last `window` seconds present, themselves included.

    Rows are numbered by blocks of time, and a block takes the rows before it that its means need from the block or
    blocks before, so no window runs over the whole series.
    """
    blocks = seconds.select("sec", "pps", F.floor(F.col("sec") / SPAN).alias("_b"))
    sizes = blocks.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a day
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("sec")) - 1
    numbered = blocks.join(F.broadcast(before), "_b").select("sec", "pps", place.alias("_i"))
    # each row goes to the chunk of its number and, where it is among the last rows of a chunk, to the next one too
    chunk = F.floor(F.col("_i") / SPAN)
    late = F.col("_i") % SPAN >= SPAN - (window - 1)
    dealt = numbered.select("*", F.explode(F.when(late, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))).alias("_c")).withColumn("_own", F.col("_c") == chunk)
    span = Window.partitionBy("_c").orderBy("_i").rowsBetween(-(window - 1), 0)
    mean = (F.sum("pps").over(span) / F.count("*").over(span)).alias("rolling_mean")
    rolled = dealt.select("sec", "pps", "_own", mean).where("_own")
    kind = F.when((F.col("rolling_mean") >= 5) & (F.col("pps") >= spike * F.col("rolling_mean")), "spike").when((F.col("rolling_mean") >= 10) & (F.col("pps") <= drop * F.col("rolling_mean")), "drop")
    return rolled.select("sec", "pps", "rolling_mean", kind.alias("kind")).where("kind is not null")


def steady(seconds: DataFrame) -> DataFrame:
    """Variation of the packets of active seconds, and whether it hints at polling (under 0.35, over five seconds)."""
    cv = F.stddev_pop("pps") / (F.avg("pps") + 1e-9)
    return seconds.where("pps > 0").agg(F.count("*").alias("active_seconds"), cv.alias("cv")).withColumn("steady", (F.col("active_seconds") > 5) & (F.col("cv") < 0.35))


def intervals(packets: DataFrame, warm_up: int = 12, most: int = 400, least: int = 8, tracked: int = 8_000) -> DataFrame:
    """Median and variation of the times between packets of each flow, from the warm_up-th packet on, over the first `most` times above 0.

    Only the first `tracked` flows are sampled, in the order in which they come to their first such time (0: all). A flow's packets
    are numbered, and its times counted, piece by piece (flows.PIECE) with what the pieces before it have, so no task holds a
    whole flow; what is left of a flow at last is `most` rows.
    """
    none = {"src_port": -1, "dst_port": -1, "src_ip": "", "dst_ip": "", "transport": ""}  # flows without ports are flows too
    rows = flows.in_pieces(packets.select(*[F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()], *ORDER, "ts_us"))
    place, before = F.row_number().over(flows.within()), flows.among().rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_in", place).withColumn("_prev", F.lag("ts_us").over(flows.within()))
    pieces = rows.groupBy(*flows.PIECES).agg(F.count("*").alias("_n"), F.max_by("ts_us", "packet_number").alias("_last"))
    pieces = pieces.select(*flows.PIECES, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_done"), F.lag("_last").over(flows.among()).alias("_last"))
    timed = numbered.join(pieces, flows.PIECES).withColumn("_d", F.col("ts_us") - F.coalesce("_prev", "_last")).where((F.col("_in") + F.col("_done") >= warm_up) & (F.col("_d") > 0))
    timed = timed.withColumn("_k", place).where(F.col("_k") <= most)
    if tracked:
        admitted = timed.groupBy(*FLOW).agg(F.min(F.struct(*ORDER)).alias("_at")).orderBy("_at").limit(tracked).select(*FLOW)
        timed = timed.join(F.broadcast(admitted), FLOW, "left_semi")
    counted = timed.groupBy(*flows.PIECES).agg(F.count("*").alias("_n"))
    counted = counted.select(*flows.PIECES, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_had")).where(F.col("_had") < most)
    taken = timed.join(counted, flows.PIECES).where(F.col("_k") + F.col("_had") <= most)
    by = taken.groupBy(*FLOW).agg(F.count("*").alias("samples"), (F.median("_d") / 1e6).alias("median_s"), F.sum("_d").alias("_s"), F.sum(F.col("_d").cast("decimal(38,0)") * F.col("_d")).alias("_s2"))
    n = F.col("samples").cast("decimal(38,0)")
    deviation = F.sqrt(F.greatest((n * F.col("_s2") - F.col("_s").cast("decimal(38,0)") * F.col("_s")).cast("double"), F.lit(0.0))) / F.col("samples") / 1e6
    out = by.where(F.col("samples") >= least).withColumn("cv", deviation / (F.col("median_s") + 1e-9)).drop("_s", "_s2")
    out = out.withColumns({c: F.nullif(c, F.lit(v)) for c, v in none.items()})
    return out.withColumn("likely_periodic", (F.col("cv") < 0.25) & (F.col("median_s") >= 0.05))


def command_sources(requests: DataFrame, n: int = 8) -> DataFrame:
    """The sources that sent most of each function code, n for each."""
    by = requests.groupBy("function_code", "src_ip").agg(F.count("*").alias("requests"))
    place = F.row_number().over(Window.partitionBy("function_code").orderBy(F.desc("requests"), "src_ip"))
    return by.withColumn("place", place).where(F.col("place") <= n)


def rare_codes(requests: DataFrame) -> DataFrame:
    """Function codes seen at most max(1, two thousandths of all requests) times."""
    by = requests.groupBy("function_code").agg(F.count("*").alias("requests"))
    total = by.agg(F.sum("requests").alias("_t"))
    return by.join(F.broadcast(total), how="inner").where("requests <= greatest(1, cast(_t * 0.002 as bigint))").drop("_t")  # one row: the aggregate


def compare(before: DataFrame, now: DataFrame) -> DataFrame:
    """Hosts of two packet views that only one has: ip and change (new or gone)."""
    hosts = lambda df: df.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).where("ip is not null").distinct()
    both = hosts(before).withColumn("_b", F.lit(True)).join(hosts(now).withColumn("_n", F.lit(True)), "ip", "full_outer")
    return both.where("_b is null or _n is null").select("ip", F.when(F.col("_b").isNull(), "new").otherwise("gone").alias("change"))


def new_pairs(packets: DataFrame, known: int = 20) -> DataFrame:
    """The first packet of each unordered pair of addresses, from the pair on by which over `known` pairs were there before."""
    key = F.concat_ws("|", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip"))
    first = packets.where("src_ip is not null and dst_ip is not null").groupBy(key.alias("pair")).agg(F.min(F.struct(*ORDER)).alias("_f")).select("pair", "_f.*")
    early = first.orderBy(*ORDER).limit(known + 1)  # the pairs that only make the others known
    return first.join(F.broadcast(early.select("pair")), "pair", "left_anti")
