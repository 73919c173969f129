"""The topology of a run: an edge for each flow, these merged by direction of a pair, shortest paths between risky addresses, GraphML of all.

What comes first is what the packets show first: an edge takes protocol and times from the first flow of its pair, and a path goes
from the address seen earlier to the later one. Edges without an end are left out; an address without an asset is a node with its
address alone. Nothing is cut at a number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otspark.operators import assets as asset_ops
from otspark.operators import graph
from otspark.sources.packets import ORDER

#: Risk from which on an address is an end of critical paths.
HIGH_RISK = 7.0
FIRST = ["first_file", "first_packet"]


def moment(us: Column) -> Column:
    """Microseconds as ISO text in UTC, with a fraction where there is one, whatever the session's time zone is."""
    utc = F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(us % 1_000_000 == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0")))


def edges(flows: DataFrame) -> DataFrame:
    """An edge for each flow (flows.with_frames): what is spoken or else the transport, volume, first and last time, codes in order."""
    ends = flows.where("src_ip is not null and dst_ip is not null")
    return ends.select(
        "src_ip", "dst_ip", "flow_id", F.coalesce("ics_protocol", "transport").alias("protocol"), "packet_count", "byte_count",
        moment(F.col("start_us")).alias("first_seen"), moment(F.col("end_us")).alias("last_seen"), F.col("function_codes_seen").alias("function_codes_used"), *FIRST,
    )


def merged(of: DataFrame) -> DataFrame:
    """One edge for each direction of a pair: sums, all protocols in text order, the other values of the pair's first flow."""
    first = F.min_by(F.struct("protocol", "first_seen", "last_seen"), F.struct(*FIRST, "flow_id"))
    out = of.groupBy("src_ip", "dst_ip").agg(first.alias("_f"), F.sum("packet_count").alias("packet_count"), F.sum("byte_count").alias("byte_count"), F.array_sort(F.collect_set("protocol")).alias("protocols"), F.count("*").alias("flows"))
    return out.select("src_ip", "dst_ip", "_f.*", "packet_count", "byte_count", "protocols", "flows")


def first_seen(packets: DataFrame) -> DataFrame:
    """ip, first: where in the order of packets an address shows first; of one packet the source comes before the destination."""
    return asset_ops.endpoints(packets).groupBy(F.col("ip_address").alias("ip")).agg(F.min(F.struct(*ORDER, "_side")).alias("first"))


def critical_paths(of: DataFrame, assets: DataFrame, order: DataFrame, least: float = HIGH_RISK) -> DataFrame:
    """source, ip, hops, path: the shortest directed path from each risky address to each one seen later, where there is one; of equal ones the first in text order.

    Addresses that the order lacks come last, in text order.
    """
    high = assets.where(F.col("risk_score") >= least).select(F.col("ip_address").alias("ip")).join(order, "ip", "left")
    high = graph.cut(high.select("ip", F.struct(F.col("first").isNull().alias("late"), "first", "ip").alias("_at")))
    found = graph.hops(of, high.select("ip")).where("hops > 0")
    ends = found.join(high, "ip").join(high.select(F.col("ip").alias("source"), F.col("_at").alias("_from")), "source")
    return ends.where("_from < _at").select("source", "ip", "hops", "path")


# ---- GraphML ----

# fixed values: what GraphML calls the types
XML_TYPES = {"bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean"}
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'


def xml(c: Column) -> Column:
    """Text that XML may hold: marks as references, characters that XML has no way to write left out."""
    out = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def _values(df: DataFrame, ends: list[str], letter: str) -> tuple[list[str], Column]:
    """The keys of a table's columns, and their values as elements; lists are joined by commas, nulls left out."""
    keys, parts = [], []
    for i, (name, kind) in enumerate((n, k) for n, k in df.dtypes if n not in ends):
        keys.append(f'<key id="{letter}{i}" for="{"node" if letter == "n" else "edge"}" attr.name="{name}" attr.type="{XML_TYPES.get(kind, "string")}"/>')
        text = F.array_join(F.col(f"`{name}`").cast("array<string>"), ",") if kind.startswith("array") else F.col(f"`{name}`").cast("string")
        parts.append(F.when(text.isNotNull(), F.concat(F.lit(f'<data key="{letter}{i}">'), xml(text), F.lit("</data>"))))
    return keys, F.concat_ws("", *parts) if parts else F.lit("")


def graphml(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """part, line: the lines of a GraphML document in the order of part and line: 0 its head, 1 nodes (by ip), 2 edges (by src_ip, dst_ip), 3 its end."""
    node_keys, node_data = _values(nodes, ["ip"], "n")
    edge_keys, edge_data = _values(of, ["src_ip", "dst_ip"], "e")
    head = "\n".join([HEAD, *node_keys, *edge_keys, '<graph edgedefault="directed">'])
    q = lambda c: F.concat(F.lit('"'), xml(F.col(c)), F.lit('"'))
    points = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("<node id="), q("ip"), F.lit(">"), node_data, F.lit("</node>")).alias("line"))
    lines = of.select(F.lit(2).alias("part"), F.concat(F.lit("<edge source="), q("src_ip"), F.lit(" target="), q("dst_ip"), F.lit(">"), edge_data, F.lit("</edge>")).alias("line"))
    around = nodes.sparkSession.createDataFrame([(0, head), (3, "</graph>\n</graphml>")], "part int, line string")
    return around.unionByName(points).unionByName(lines)


def nodes(of: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets and the ends of edges as nodes."""
    known = assets.select(F.col("ip_address").alias("ip"), "mac_address", F.col("role").alias("device_role"), "vendor", F.col("protocols_seen").alias("ics_protocols"), "risk_score")
    return known.join(graph.nodes(of), "ip", "full_outer")


def write_graphml(nodes: DataFrame, of: DataFrame, where: str) -> None:
    """The whole graph as a folder of text files, each written by its task; put together in the order of their names they are one GraphML document."""
    graphml(nodes, of).orderBy("part", "line").select("line").write.mode("overwrite").text(where)
