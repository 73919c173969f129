"""Topology: edges of flows, merged edges, critical paths in order of appearance, whole GraphML documents."""

from __future__ import annotations

import glob
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from otspark.operators import topology

FLOWS = "src_ip string, dst_ip string, flow_id string, ics_protocol string, transport string, packet_count long, byte_count long, start_us long, end_us long, function_codes_seen array<int>, first_file int, first_packet long"
X = "{http://graphml.graphdrawing.org/xmlns}"


def flows(spark):
    rows = [
        ("b", "a", "f1", None, "TCP", 2, 20, 1_000_000, 2_500_001, [], 0, 9),
        ("b", "a", "f2", "Modbus", "TCP", 3, 30, 500_000, 600_000, [3, 16], 0, 4),
        ("b", "a", "f3", None, "UDP", 1, 10, None, None, [], 1, 1),
        ("a", "b", "f4", None, "TCP", 1, 10, 0, 0, [], 0, 5),
        (None, "b", "f5", None, "TCP", 1, 10, 0, 0, [], 0, 6),
    ]
    return spark.createDataFrame(rows, FLOWS)


def test_edges_and_merged(spark):
    of = topology.edges(flows(spark))
    told = {r.flow_id: r for r in of.collect()}
    assert set(told) == {"f1", "f2", "f3", "f4"} and told["f2"].protocol == "Modbus" and told["f1"].protocol == "TCP"
    assert (told["f1"].first_seen, told["f1"].last_seen, told["f3"].first_seen) == ("1970-01-01T00:00:01", "1970-01-01T00:00:02.500001", None)
    both = {(r.src_ip, r.dst_ip): r for r in topology.merged(of).collect()}
    one = both["b", "a"]
    assert (one.protocol, one.first_seen, one.packet_count, one.byte_count, one.protocols, one.flows) == ("Modbus", "1970-01-01T00:00:00.500000", 6, 60, ["Modbus", "TCP", "UDP"], 3)
    assert both["a", "b"].packet_count == 1 and topology.merged(of.limit(0)).count() == 0


def test_paths_go_from_the_earlier_address(spark):
    packets = spark.createDataFrame([(0, 1, "z", "m"), (0, 2, "m", "a"), (0, 3, "a", "z"), (0, 4, "q", "z")], "file_idx int, packet_number long, src_ip string, dst_ip string").withColumns({"ts_us": F.lit(0), "length": F.lit(1), "src_port": F.lit(1), "dst_port": F.lit(2)})
    assets = spark.createDataFrame([("z", 9.0), ("a", 7.0), ("m", 1.0), ("q", 8.0), ("w", 8.0)], "ip_address string, risk_score double")
    found = topology.critical_paths(packets.select("src_ip", "dst_ip"), assets, topology.first_seen(packets)).collect()
    assert [(r.source, r.ip, r.path) for r in found] == [("z", "a", ["z", "m", "a"])]  # q is reached by nobody, and comes after z
    assert topology.critical_paths(packets.select("src_ip", "dst_ip").limit(0), assets, topology.first_seen(packets)).count() == 0


def test_the_whole_graph_is_written(spark, tmp_path):
    many = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("ip"), (F.col("id") % 7).alias("risk"), F.when(F.col("id") == 3, '<&">\x01').alias("vendor"), F.array(F.lit("a"), F.lit("b")).alias("of"))
    lines = spark.range(4000).select(F.concat(F.lit("n"), "id").alias("src_ip"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst_ip"), F.col("id").alias("packets"))
    topology.write_graphml(many, lines, f"file://{tmp_path}/g")
    parts = sorted(glob.glob(f"{tmp_path}/g/part-*"))
    root = ET.fromstring("".join(open(p, encoding="utf-8").read() for p in parts).encode())
    keys = {k.get("attr.name"): k.get("id") for k in root.iter(f"{X}key")}
    points, links = root.findall(f"{X}graph/{X}node"), root.findall(f"{X}graph/{X}edge")
    assert len(points) == 5000 and len(links) == 4000 and {k.get("attr.type") for k in root.iter(f"{X}key")} == {"long", "string"}
    (three,) = [n for n in points if n.get("id") == "n3"]
    assert {d.get("key"): d.text for d in three} == {keys["risk"]: "3", keys["vendor"]: '<&">', keys["of"]: "a,b"}
    topology.write_graphml(many.limit(0), lines.limit(0), f"file://{tmp_path}/none")
    assert ET.fromstring("".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/none/part-*"))).encode()).tag == f"{X}graphml"
