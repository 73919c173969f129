"""Who talks to whom as a graph: links of pairs, zones by subnet, statistics, weak components, shortest paths."""

from __future__ import annotations

import tempfile
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otspark.functions.net import subnet

#: Links that a picture shows, at most (0: all).
MAX_EDGES = 600


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once, behind a reliable checkpoint in the folder of spark.checkpoint.dir (a new one where it is unset)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()


def links(flows: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """One row per pair of addresses with packets, bytes and flows; the busiest links are kept, and a link is bidirectional if the kept ones hold its reverse.

    Flows need ics_protocols (with_frames adds them). Sessions of a link are rows of sessions().
    """
    labels = flows.select("src_ip", "dst_ip", F.explode_outer("ics_protocols").alias("_p"), "flow_id", "packet_count", "byte_count", F.coalesce(F.get("ics_protocols", F.lit(0)), F.lit("")).alias("_one"))
    once = F.coalesce("_p", F.lit("")) == F.col("_one")
    pairs = labels.groupBy("src_ip", "dst_ip").agg(
        F.sum(F.when(once, F.col("packet_count"))).alias("packets"), F.sum(F.when(once, F.col("byte_count"))).alias("bytes"), F.count_if(once).alias("flows"), F.array_sort(F.collect_set("_p")).alias("ics_protocols")
    )
    kept = pairs.orderBy(F.desc("packets"), "src_ip", "dst_ip").limit(max_edges) if max_edges else pairs
    back = kept.select(F.col("src_ip").alias("dst_ip"), F.col("dst_ip").alias("src_ip"), F.lit(True).alias("_back"))
    return kept.join(back, ["src_ip", "dst_ip"], "left").withColumn("bidirectional", F.coalesce("_back", F.lit(False))).drop("_back")


def sessions(flows: DataFrame) -> DataFrame:
    """The flows of each link as rows: what is spoken, ports, volume, codes."""
    spoken = F.when(F.size("ics_protocols") > 0, F.array_join("ics_protocols", ", ")).otherwise(F.concat("transport", F.lit(":"), F.col("dst_port").cast("string")))
    return flows.select("src_ip", "dst_ip", "flow_id", spoken.alias("protocols_display"), (F.size("ics_protocols") > 0).alias("is_ics_traffic"), "transport", "src_port", "dst_port", "packet_count", "byte_count", F.slice("function_codes_seen", 1, 24).alias("function_codes"), "has_write_operations")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()


def link_nodes(kept: DataFrame, assets: DataFrame) -> DataFrame:
    """The ends of links with what is known of them."""
    known = assets.select(F.col("ip_address").alias("ip"), "role", "vendor", "mac_address", "risk_score", "protocols_seen", F.slice("open_ports", 1, 16).alias("open_ports_sample"))
    out = nodes(kept).join(known, "ip", "left")
    return out.fillna({"role": "UNKNOWN", "vendor": "", "mac_address": "", "risk_score": 0.0})


def zones(assets: DataFrame) -> DataFrame:
    """Subnets of 256 addresses (else "unknown") with their members and the protocol that most members speak; ids in text order of the subnets."""
    placed = assets.select("ip_address", subnet(F.col("ip_address")).alias("subnet"), "protocols_seen")
    size = placed.groupBy("subnet").agg(F.count("*").alias("members"))
    spoken = placed.select("subnet", F.explode("protocols_seen").alias("_p")).groupBy("subnet", "_p").agg(F.count("*").alias("_n"))
    first = spoken.groupBy("subnet").agg(F.min(F.struct((-F.col("_n")).alias("_n"), "_p"))["_p"].alias("primary_protocol"))
    # one row per subnet: the ids need one order over these
    place = F.row_number().over(Window.orderBy("subnet"))
    return size.join(first, "subnet", "left").withColumn("zone_id", F.format_string("ZONE-%03d", place))


def smallest_reachable(edges: DataFrame, a: str = "src_ip", b: str = "dst_ip") -> DataFrame:
    """Weak components: each node with the smallest node of its component, by alternating large-star and small-star steps."""
    pairs = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v").distinct())
    everyone = nodes(edges.select(F.col(a).alias("src_ip"), F.col(b).alias("dst_ip"))).where("ip is not null")
    before = None
    while True:
        both = pairs.union(pairs.select("v", "u")).distinct()
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        pairs = cut(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            break
        before = state
    return everyone.join(pairs.select(F.col("u").alias("ip"), "v"), "ip", "left").select("ip", F.coalesce("v", "ip").alias("component"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes, distinct edges, density m/(n(n-1)) and whether all nodes are one weak component."""
    distinct = edges.select("src_ip", "dst_ip").distinct()
    parts = smallest_reachable(distinct).agg(F.count("*").alias("total_nodes"), F.countDistinct("component").alias("_c"))
    n, m = F.col("total_nodes"), F.col("total_edges")
    one = distinct.agg(F.count("*").alias("total_edges")).join(F.broadcast(parts), how="inner")  # two aggregates of one row
    return one.select("total_nodes", "total_edges", F.when(n > 1, F.round(m / (n * (n - 1)), 4)).otherwise(0.0).alias("density"), (F.col("_c") == 1).alias("is_connected"))


def hops(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """source, ip, hops, path: a shortest directed path from each source (column ip) to each address it reaches; of equal paths the first in text order.

    A frontier is joined with the edges until nothing new is reached (or for max_hops steps); sources are few (critical addresses).
    """
    step = cut(edges.select("src_ip", "dst_ip").distinct())
    seen = cut(sources.select(F.col("ip").alias("source"), "ip", F.lit(0).alias("hops"), F.array("ip").alias("path")).distinct())
    frontier = seen
    for n in count(1):
        if max_hops is not None and n > max_hops:
            break
        reached = frontier.join(step, frontier["ip"] == step["src_ip"]).select("source", F.col("dst_ip").alias("ip"), F.concat("path", F.array("dst_ip")).alias("path"))
        new = reached.join(seen.select("source", "ip"), ["source", "ip"], "left_anti").groupBy("source", "ip").agg(F.min("path").alias("path"))
        frontier = cut(new.select("source", "ip", F.lit(n).alias("hops"), "path"))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return seen


def critical_paths(edges: DataFrame, assets: DataFrame, least: float = 7.0) -> DataFrame:
    """Shortest paths between addresses of high risk, from the earlier to the later in text order."""
    high = assets.where(F.col("risk_score") >= least).select(F.col("ip_address").alias("ip"))
    ends = high.select(F.col("ip").alias("_to"))
    return hops(edges, high).join(ends, F.col("ip") == F.col("_to"), "left_semi").where("source < ip")


def graphml_rows(edges: DataFrame) -> DataFrame:
    """The node and edge elements of a GraphML document as lines of text, nodes first by `kind`."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    q = F.lit('"')
    points = nodes(edges).select(F.lit(0).alias("kind"), F.concat(F.lit("<node id="), q, safe(F.col("ip")), q, F.lit("/>")).alias("line"))
    lines = edges.select(F.lit(1).alias("kind"), F.concat(F.lit("<edge source="), q, safe(F.col("src_ip")), q, F.lit(" target="), q, safe(F.col("dst_ip")), q, F.lit("/>")).alias("line"))
    return points.union(lines)


def pair_key(a: Column, b: Column) -> Column:
    """The same for both directions of a pair."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))
