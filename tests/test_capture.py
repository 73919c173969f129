"""Capture files written here byte by byte are read back packet by packet; graph and rule helpers on small tables."""

from __future__ import annotations

import gzip
import struct

from otspark.operators import decode, flows, graph, rules
from otspark.sources import capture

BODY = bytes.fromhex("000100000006ff0500010001")


def frame(payload=BODY, sport=40000, dport=502, tag=b"", pad=b""):
    tcp = struct.pack(">HHIIBBHHH", sport, dport, 1, 1, 0x50, 0x18, 100, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 1, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    return bytes.fromhex("080006000001" + "000054aabbcc") + tag + b"\x08\x00" + ip + tcp + pad


def pcap(frames, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1000 + i, 5000 if nano else 5, len(f), len(f)) + f
    return out


def pcapng(frames):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for i, f in enumerate(frames):
        t = (1000 + i) * 10**6 + 5
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out


def test_formats(spark, tmp_path):
    frames = [frame(), frame(b"", pad=b"\0" * 6), frame(tag=b"\x81\x00\x00\x05"), b"\x01\x02"]
    files = {"a.pcap": pcap(frames), "b.pcap": pcap(frames, ">"), "c.pcap": pcap(frames, "<", True), "d.pcapng": pcapng(frames), "e.pcap.gz": gzip.compress(pcap(frames)), "f.pcap": pcap(frames)[:-1], "g.pcap": b"text", "h.pcap": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = capture.records(spark, f"file://{tmp_path}")
    got = {}
    for r in capture.packets(found).orderBy("file_idx", "packet_number").collect():
        got.setdefault(r.pcap_file, []).append((r.packet_number, r.ts_us, r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.transport, r.tcp_flags, None if r.payload is None else bytes(r.payload), r.src_mac))
    one = lambda i, p: (i + 1, (1000 + i) * 10**6 + 5, "10.0.0.1", "10.0.0.2", 40000, 502, "TCP", 0x18, p, "00:00:54:aa:bb:cc")
    whole = [one(0, BODY), one(1, b""), one(2, BODY)]
    for name in ("a.pcap", "b.pcap", "c.pcap", "d.pcapng", "e.pcap.gz"):
        assert got[name][:3] == whole and len(got[name]) == 4 and got[name][3][2] is None
    assert got["f.pcap"] == whole
    assert {r.pcap_file: r.error for r in capture.errors(found).collect()} == {"g.pcap": "no capture file", "h.pcap": "no bytes"}
    assert capture.records(spark, f"file://{tmp_path}/a.pcap", most=2).count() == 2
    kept = graph.cut(capture.packets(capture.records(spark, f"file://{tmp_path}/a.pcap")))
    framed = decode.decode(kept, ["modbus"])
    assert [r.rule_id for r in rules.events(framed).collect()] == ["MB-001", "MB-001"]
    assert flows.flow_build(kept).first().packet_count == 3
    small = capture.light(kept, 4).where("payload_length > 0").first()
    assert (bytes(small.payload), small.payload_length, small.proto, small.length) == (BODY[:4], 12, "tcp", 52)
    assert flows.exported(flows.flow_build(kept)).first().start_time == "1970-01-01T00:16:40.000005+00:00"


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("z", "z"), ("a", "c")], "src_ip string, dst_ip string")
    assert {r.ip: r.component for r in graph.smallest_reachable(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}
    paths = {r.ip: r.path for r in graph.hops(edges, spark.createDataFrame([("a",)], "ip string")).collect()}
    assert paths == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"], "d": ["a", "c", "d"]}
    assert graph.smallest_reachable(edges.limit(0)).count() == 0
    long = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(12)], "src_ip string, dst_ip string")
    ends = graph.hops(long, spark.createDataFrame([("n000",)], "ip string"))
    assert ends.agg({"hops": "max"}).first()[0] == 12
    assert graph.hops(long, spark.createDataFrame([("n000",)], "ip string"), max_hops=3).count() == 4


def test_rule_clauses(spark):
    rows = [(0, 1, 1, 0, "modbus", "Modbus", 5, {"unit_id": "255", "n": "7"}), (0, 2, 2, 0, "modbus", "Modbus", None, {}), (0, 3, 3, 0, "modbus", "Modbus", 0, {})]
    frames = spark.createDataFrame(rows, "file_idx int, packet_number bigint, ts_us bigint, parser_idx int, protocol_slug string, protocol string, function_code int, fields map<string,string>")
    hit = lambda c: [r.packet_number for r in frames.where(rules.matches(c)).orderBy("packet_number").collect()]
    assert hit({"function_code": {"in": [5, 6]}}) == [1]
    assert hit({"function_code": {"not_in": [5]}}) == [2, 3]
    assert hit({"function_code": {"range": [-1, 0]}}) == [2, 3]
    assert hit({"unit_id": 255, "protocol": "MODBUS"}) == [1]
    assert hit({"payload_field": {"name": "n", "greater_than": 6, "less_than": 8}}) == [1]
    assert hit({}) == [1, 2, 3]
    got = rules.load("rules:\n  - {id: R, name: n, severity: high, category: x, condition: {protocol: s7}}\n  - {id: B}\n")
    assert [r.id for r in got.rules] == ["R"] and got.errors
