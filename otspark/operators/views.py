"""What readers of a report ask of its tables: search, subsets, alerts, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otspark.operators.flows import comm_matrix

#: Rows of a subset, of alerts by source, of an edge table, of a pivot.
SUBSET = 60
ALERTS = {"new_host": 25, "new_pair": 15, "rare_edge": 12, "service": 20}
EDGES = 500
PIVOT_ROWS, PIVOT_COLUMNS = 35, 40
TRANSPORTS = ("TCP", "UDP", "ICMP")


def holding(rows: DataFrame, text: str) -> DataFrame:
    """Rows of which any value holds the text, whatever its case; an empty text is held by all."""
    if not text.strip():
        return rows
    return rows.where(F.lower(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).contains(text.strip().lower()))


def ot_protocols(flows: DataFrame) -> DataFrame:
    """Distinct industrial protocols of flows, without plain transports."""
    return flows.select(F.explode("ics_protocols").alias("protocol")).distinct().where(~F.upper("protocol").isin(*TRANSPORTS)).orderBy("protocol")


def subset(flows: DataFrame, kind: str, most: int = SUBSET) -> DataFrame:
    """Flows of a kind (ics, write, exception), those with most bytes first."""
    test = {"ics": F.size("ics_protocols") > 0, "write": F.col("has_write_operations"), "exception": F.col("exception_count") > 0}[kind]
    return flows.where(test).orderBy(F.desc("byte_count"), "first_file", "first_packet").limit(most)


def risky_assets(assets: DataFrame, most: int = SUBSET) -> DataFrame:
    return assets.where("risk_score > 0").orderBy(F.desc("risk_score"), "ip_address").limit(most)


def links_shown(links: DataFrame, *, ics_only: bool = False, text: str = "") -> DataFrame:
    """Links of a graph whose sessions are industrial, or any, and that hold the text."""
    rows = links.where(F.col("ics_protocols").isNotNull() & (F.size("ics_protocols") > 0)) if ics_only else links
    return holding(rows, text)


def nodes_shown(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes at the ends of the links."""
    ends = links.select(F.col("src_ip").alias("ip")).unionByName(links.select(F.col("dst_ip").alias("ip"))).distinct()
    return nodes.join(ends, "ip", "left_semi")


def alerts(new_hosts: DataFrame, new_pairs: DataFrame, rare_edges: DataFrame, services: DataFrame) -> DataFrame:
    """source, subject, detail: the first alerts of each source. Inputs: ip; src_ip, dst_ip; the same with packets; src_ip, dst_ip, port."""
    pair = F.concat("src_ip", F.lit(" > "), "dst_ip")

    def part(rows: DataFrame, source: str, subject: Column, detail: Column) -> DataFrame:
        told = rows.select(F.lit(source).alias("source"), subject.alias("subject"), detail.cast("string").alias("detail"))
        return told.orderBy("subject", "detail").limit(ALERTS[source])

    return (
        part(new_hosts, "new_host", F.col("ip"), F.lit(""))
        .unionByName(part(new_pairs, "new_pair", pair, F.lit("")))
        .unionByName(part(rare_edges, "rare_edge", pair, F.col("packets")))
        .unionByName(part(services, "service", pair, F.col("port")))
    )


def edge_table(edges: DataFrame, text: str = "", by: str = "packets", most: int = EDGES) -> DataFrame:
    return holding(edges, text).orderBy(F.desc(by), "src_ip", "dst_ip").limit(most)


def pivot(flows: DataFrame, rows: int = PIVOT_ROWS, columns: int = PIVOT_COLUMNS) -> DataFrame:
    """Packets of the first sources by the first destinations, in text order: a column for each destination."""
    matrix = comm_matrix(flows)
    kept = [r.dst_ip for r in matrix.select("dst_ip").distinct().orderBy("dst_ip").limit(columns).collect()]  # at most `columns`
    first = matrix.select("src_ip").distinct().orderBy("src_ip").limit(rows)
    return matrix.join(F.broadcast(first), "src_ip", "left_semi").groupBy("src_ip").pivot("dst_ip", kept).agg(F.sum("packets")).fillna(0)


def figures(flows: DataFrame) -> DataFrame:
    """One row: distinct sources and destinations added, flows, packets, bytes, industrial, writing and refused flows."""
    return flows.agg(
        (F.countDistinct("src_ip") + F.countDistinct("dst_ip")).alias("hosts"), F.count("*").alias("flows"), F.coalesce(F.sum("packet_count"), F.lit(0)).alias("packets"), F.coalesce(F.sum("byte_count"), F.lit(0)).alias("bytes"),
        F.count_if(F.size("ics_protocols") > 0).alias("ics_flows"), F.count_if("has_write_operations").alias("write_flows"), F.count_if(F.col("exception_count") > 0).alias("exception_flows"),
    ).withColumn("bytes_shown", readable("bytes"))


def readable(column: str) -> Column:
    """A number of bytes with one digit after the point and its unit."""
    n = F.col(column).cast("double")
    out = F.when(n < 1024, F.concat(F.col(column).cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024.0 ** (i + 1), F.format_string(f"%.1f {unit}", n / F.lit(1024.0**i)))
    return out.otherwise(F.format_string("%.1f TB", n / F.lit(1024.0**4)))
