"""A capture written here goes through the whole analysis, its exports, the command line, comparison and streams."""

from __future__ import annotations

import dataclasses
import json
import pathlib
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from otspark import analysis, cli, config
from otspark.operators import cleartext, compare, components, findings, flows, graph, privacy, survey, views
from otspark.sinks import files
from otspark.sources import capture
from otspark.streaming import traffic
from tests.test_capture import BODY, frame, pcap

WRITE = bytes.fromhex("000100000006010600010001")
TAG = ["json", "csv", "ndjson", "html", "map", "graphml"]


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    folder = tmp_path_factory.mktemp("captures")
    (folder / "a.pcap").write_bytes(pcap([frame(BODY), frame(WRITE), frame(BODY, dport=3389), frame(b"GET /plc HTTP/1.1\r\nHost: 10.0.0.9\r\n\r\n", dport=80)]))
    (folder / "b.pcap").write_bytes(b"no capture")
    return folder


@pytest.fixture(scope="module")
def found(spark, place):
    return analysis.analyse(spark, config.Settings(inputs=(f"file://{place}",), output=f"file://{place}/out", subset=f"file://{place}/subset.pcap", suffix=""))


def test_report(found):
    d = analysis.report(found)
    assert d["summary"]["flows_analyzed"] == 3 and d["summary"]["anomalies_detected"] == 2 and "Modbus" in d["summary"]["protocols_seen"]
    assert [e["pcap_file"] for e in d["metadata"]["read_errors"]] == ["b.pcap"]
    categories = {f["category"] for f in d["statistics"]["audit_workbook"]["findings"]}
    assert {"WRITE_SURFACE", "MODBUS_WRITE_TRAFFIC", "CLEARTEXT_OT_PAYLOAD", "REMOTE_ADMIN_EXPOSURE", "IT_PROTOCOL_IN_OT"} <= categories
    ids = [f["finding_id"] for f in d["statistics"]["audit_workbook"]["findings"]]
    assert ids == [f"AUD-{i:03d}" for i in range(1, len(ids) + 1)]
    assert 0 < d["statistics"]["audit_workbook"]["passive_exposure_index"] <= 100
    steps = {x["step"]: x for x in d["metadata"]["steps"]}
    assert list(steps) == ["packets", "frames", "flows", "assets", "events"] and d["metadata"]["version"] and d["metadata"]["started"].endswith("+00:00")
    assert steps["packets"]["rows"] == 4 and steps["flows"]["rows"] == 3 and steps["flows"]["packets"] == 4 and "Modbus" in steps["frames"]["protocols"] and sum(steps["events"][k] for k in ("LOW", "MEDIUM", "HIGH", "CRITICAL")) <= 2
    assert d["statistics"]["deep_survey"]["http_hosts_top"] == [{"host": "10.0.0.9", "packets": 1}]
    json.dumps(d)


def test_exports(spark, place, found):
    out = analysis.export(found)
    local = {k: v.removeprefix("file://") for k, v in out.items()}
    assert set(local) == {"json", "assets", "ot_assets", "flows", "anomalies", "audit_findings", "ndjson", "html", "map", "graphml", "subset"}
    document = json.loads(open(local["json"]).read())
    kept, none = analysis.kept_keys(spark, document), analysis.kept_keys(spark, {})
    assert sorted(r.value for r in analysis.report_diff(none, kept).where("change = 'new asset'").collect()) == ["10.0.0.1", "10.0.0.2"]
    assert analysis.report_diff(kept, kept).count() == 0
    listed = analysis.kept_keys(spark, {k: v for k, v in document.items() if k != "tables"})  # a document with lists alone
    assert analysis.report_diff(listed, kept).count() == 0
    flows_ = spark.read.csv(out["flows"], header=True)
    assert flows_.count() == 3 and flows_.columns == sorted(flows_.columns)
    assert spark.read.json(out["ndjson"]).where("rule_id = 'MB-001'").count() == 2
    page = open(local["html"]).read()
    assert page.startswith("<!DOCTYPE html>") and "</script><" not in page.split("application/json")[1].split("</script>")[0]
    assert "<svg" in open(local["map"]).read()
    root = ET.parse(local["graphml"]).getroot()
    assert len(root.findall(".//{*}node")) == 2 and len(root.findall(".//{*}edge")) == 1
    again = capture.records(spark, out["subset"])
    assert [(r.packet_number, bytes(r.raw)) for r in again.orderBy("packet_number").collect()] == [(1, frame(BODY)), (2, frame(BODY, dport=3389))]


def test_a_graph_that_a_document_cuts_is_written_whole(found, tmp_path, monkeypatch):
    monkeypatch.setattr(analysis, "SHOWN", 1)
    of = dataclasses.replace(found, settings=dataclasses.replace(found.settings, formats=("graphml",), subset=None, anonymise=True, output=f"file://{tmp_path}"))
    out = {k: v.removeprefix("file://") for k, v in analysis.export(of).items()}
    root = ET.fromstring("".join(p.read_text() for p in sorted(pathlib.Path(out["graphml_whole"]).glob("part-*"))))
    ids = {n.get("id") for n in root.findall(".//{*}node")}
    assert ids == {privacy.pseudonym_of("10.0.0.1"), privacy.pseudonym_of("10.0.0.2")} and {e.get("source") for e in root.findall(".//{*}edge")} <= ids


def test_empty_exports(spark, tmp_path):
    none = spark.createDataFrame([], "b array<string>, a int")
    files.write_csv(none, f"file://{tmp_path}/none.csv")
    assert "".join(p.read_text() for p in (tmp_path / "none.csv").glob("part-*")).strip() == "a,b"
    assert files.write_capture(spark.createDataFrame([], "file_idx int, packet_number bigint, ts_us bigint, length bigint, linktype int, raw binary"), f"file://{tmp_path}/none.pcap") == 0
    assert files.read_json(spark, f"file://{tmp_path}/missing.json") is None
    (tmp_path / "bad.json").write_text("{")
    assert files.read_json(spark, f"file://{tmp_path}/bad.json") is None
    assert files.named("x", "csv", "_1") == "x_1.csv" and len(files.suffix()) == 16


def test_modes_and_settings(spark, place):
    s = config.Settings(inputs=(f"file://{place}/a.pcap",), mode="asset-only", protocols=("modbus",), most_packets=1)
    a = analysis.analyse(spark, s)
    assert a.events.count() == 0 and a.packets.count() == 1
    assert config.Settings(inputs=("a.pcap",)).problems() == []
    wrong = config.Settings(inputs=("a.txt",), mode="x", min_severity="y", protocols=("z",), formats=("w",), most_flows=-1).problems()
    assert len(wrong) == 6
    assert config.formats_of("json, csv,json") == ("json", "csv") and config.formats_of(None) == config.FORMATS == tuple(TAG)


def test_command_line(spark, place, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    for folder, severity in ((good, "HIGH"), (bad, "nope")):
        folder.mkdir()
        (folder / "r.yaml").write_text(f"rules:\n  - {{id: R, name: n, severity: {severity}, category: x, condition: {{protocol: modbus}}}}\n")
    assert cli.main(["rules", f"file://{good}"], spark) == 0 and cli.main(["rules", f"file://{bad}"], spark) == 2
    assert cli.main(["analyse", f"file://{place}/a.pcap", "-o", f"file://{tmp_path}/out", "--formats", "json", "--rules", f"file://{good}", "--anonymise"], spark) == 0
    text = next((tmp_path / "out").glob("*.json")).read_text()
    assert '"R"' in text and "10.0.0.1" not in text and privacy.pseudonym_of("10.0.0.1") in text
    assert cli.main(["analyse", f"file://{place}/a.pcap", "--mode", "x"], spark) == 1
    assert cli.main(["analyse", f"file://{place}/a.pcap", "--rules", f"file://{bad}"], spark) == 1
    assert cli.main(["baseline", f"file://{place}/a.pcap", "-o", f"file://{tmp_path}/base"], spark) == 0
    assert cli.main(["baseline", f"file://{place}/a.pcap", "-o", f"file://{tmp_path}/next", "--before", f"file://{tmp_path}/base/packets.parquet"], spark) == 0
    told = json.loads((tmp_path / "next" / "comparison.json").read_text())
    assert told["new_devices"] == [] and told["new_communication_pairs"] == [] and not told["modbus_writes"]["alarming"]
    assert {p.name for p in (tmp_path / "base").iterdir() if p.suffix == ".json"} == {"communication_map.json", "protocol_baseline.json", "command_profile.json", "traffic_profile.json"}


def test_inspectors_on_null_and_short_payloads(spark):
    rows = [(0, 1, None, None, None, None, None, None, None, None), (0, 2, "10.0.0.1", "10.0.0.2", 1, 502, "TCP", 2048, 6, bytearray(b"abc")), (0, 3, "10.0.0.1", "10.0.0.2", 161, 161, "UDP", 2048, 17, bytearray.fromhex("302902010104067075")), (0, 4, "10.0.0.1", "10.0.0.2", 53, 53, "UDP", 2048, 17, bytearray.fromhex("000101000001000000000000c00c"))]
    packets = spark.createDataFrame(rows, "file_idx int, packet_number bigint, src_ip string, dst_ip string, src_port int, dst_port int, transport string, eth_type int, ip_proto int, payload binary").withColumn("ts_us", F.lit(0).cast("long"))
    assert cleartext.observations(packets).count() == 0
    assert cleartext.dns_names(packets).count() == 0  # a pointer to itself is no name
    assert survey.hints(packets).collect() == [("snmp_udp", 1)]
    assert survey.window(packets).first().non_ip_frames == 1
    assert [r.packets for r in survey.timeline(packets).collect()] == [4]
    assert survey.nearest_rank(packets.limit(0), "ts_us", 10) == 0.0
    text = [cleartext.redacted(F.lit(x)).alias("x") for x in ("", "ab", "abcd", "public")]
    assert [spark.range(1).select(t).first().x for t in text] == ["**", "a*", "a**d", "p****c"]


def test_components_and_views(spark, found):
    tagged = {r.ip_address: r.component_tags for r in components.tagged(found.assets).collect()}
    assert "plc_pac" in tagged["10.0.0.2"] and components.summary(found.assets).first().kinds_in_catalog == 29
    assert components.not_seen(found.assets).count() + components.tag_counts(found.assets).count() == 29
    assert views.figures(found.flows).first().bytes_shown.endswith(" B")
    sizes = spark.createDataFrame([(512,), (2048,), (3 * 1024**2,), (5 * 1024**4,)], "n long")
    assert [r.x for r in sizes.select(views.readable("n").alias("x")).collect()] == ["512 B", "2.0 KB", "3.0 MB", "5.0 TB"]
    links = graph.links(found.flows)
    assert views.links_shown(links, ics_only=True).count() == 1 and views.links_shown(links, text="nowhere").count() == 0
    assert views.nodes_shown(graph.link_nodes(links, found.assets), links).count() == 2
    assert views.risky_assets(found.assets).first().ip_address == "10.0.0.1"
    assert findings.technique("T0855")["url"].endswith("T0855/")


def test_privacy(spark):
    df = spark.createDataFrame([("from 192.168.1.1 to 192.168.1.2.", ["a 8.8.8.8", None], bytearray(b"x")), (None, None, None), ("300.1.1.1", [], bytearray(b""))], "t string, l array<string>, payload binary")
    a, b, c = privacy.masked(privacy.anonymised(df)).collect()
    one = privacy.pseudonym_of
    assert a.t == f"from {one('192.168.1.1')} to {one('192.168.1.2')}." and a.l == [f"a {one('8.8.8.8')}", None] and a.payload == privacy.HIDDEN
    assert (b.t, b.l, b.payload) == (None, None, None) and c.t == "300.1.1.1"
    d = {"payload": "ff", "x": ["1.2.3.4", {"excerpt": "y"}]}
    assert privacy.document(d, anonymise=True, mask=True) == {"payload": privacy.HIDDEN, "x": [one("1.2.3.4"), {"excerpt": privacy.HIDDEN}]} and d["payload"] == "ff"


def test_comparison(spark, found):
    run = compare.snapshot(found.packets)
    more = compare.snapshot(found.packets.unionByName(found.packets.withColumn("src_ip", F.lit("10.0.0.7"))))
    assert [r.ip for r in compare.new_hosts(run, more).collect()] == ["10.0.0.7"]
    assert compare.writes(run, more).first().new_writers == ["10.0.0.7"] and compare.writes(run, more).first().alarming
    assert not compare.traffic(run, run).first().alarming
    labels = compare.new_values(found.flows.where("dst_port = 80"), found.flows, "ics_protocol")
    assert {(r.value, r.change) for r in labels.collect()} == {("Modbus", "new"), ("Modbus, Omron FINS", "new")}  # a label of two protocols is one value


def test_streams(spark, place, found, tmp_path):
    def rows(stream, mode="append"):
        name = f"s{abs(hash((id(stream), mode))) % 10**9}"
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
        query.awaitTermination(180)
        return spark.table(name).collect()

    got = rows(traffic.captures(spark, f"file://{place}/[ab].pcap"))
    assert len(got) == 4 and {r.dst_port for r in got} == {502, 3389, 80}
    found.packets.write.parquet(f"file://{tmp_path}/packets")
    stream = lambda: traffic.tables(spark, f"file://{tmp_path}/packets", found.packets.schema)
    assert sum(r.packets for r in rows(traffic.traffic(stream()), "complete")) == 4
    assert len(rows(traffic.new_pairs(stream()))) == 1
    assert {r.rule_id for r in rows(traffic.rule_events(stream(), ["modbus"]))} == {"MB-001"}
    assert sum(r.packets for r in rows(traffic.flow_sessions(stream()), "complete")) == 4


def test_flow_exports(found):
    assert files.exported_flows(found.flows, 1).count() == 1 and files.exported_flows(found.flows, 0).count() == 3
    assert flows.write_meaning() is not None


def test_reports_of_many_assets_are_compared_whole(spark, found, tmp_path):
    import dataclasses

    def with_more(name, first, last, rules):
        more = spark.range(first, last).select(F.concat(F.lit("10.9."), F.floor(F.col("id") / 250).cast("string"), F.lit("."), (F.col("id") % 250).cast("string")).alias("ip_address"))
        events = found.events.select("rule_id").limit(0).unionByName(spark.range(rules).select(F.lit("MB-001").alias("rule_id")))
        events = found.events.limit(0).unionByName(events, allowMissingColumns=True)
        a = dataclasses.replace(found, assets=found.assets.unionByName(more, allowMissingColumns=True), events=events)
        return dataclasses.replace(a, settings=dataclasses.replace(a.settings, output=f"file://{tmp_path}/{name}", formats=("json",), subset=None, compare=None if name == "a" else f"file://{tmp_path}/a/analysis_report.json"))

    analysis.export(with_more("a", 0, 5000, 1500))
    out = analysis.export(with_more("b", 40, 5010, 2700))
    told = spark.read.csv(out["baseline_diff"], header=True).groupBy("change").count().collect()
    assert {r.change: r["count"] for r in told} == {"new asset": 10, "removed asset": 40, "rule count": 1}
    diff = json.loads(open(out["json"].removeprefix("file://")).read())["statistics"]["baseline_diff"]
    assert diff["anomaly_rule_count_deltas"] == [{"value": "MB-001", "before": 1500, "now": 2700, "delta": 1200}]
    assert len(diff["removed_asset_ips"]) == 40 and {"value": "10.9.0.0"} in diff["removed_asset_ips"]


def test_no_limit_of_flows_is_all(spark):
    many = spark.range(1_000_050).select(F.col("id").alias("packet_count"), F.lit(0).alias("first_file"), F.col("id").alias("first_packet"))
    assert files.exported_flows(many).count() == 1_000_050 and files.exported_flows(many, 7).count() == 7


def test_addresses_with_leading_zeros_are_replaced(spark):
    texts = ["at 192.168.001.010 and 10.0.0.1.", "version 1.2.3.4.5", "300.1.1.1", "010.000.000.255!", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("clean", privacy.without_addresses(F.col("text")))
    got = {r.text: r.clean for r in df.collect()}
    assert "192.168.001.010" not in got[texts[0]] and "10.0.0.1" not in got[texts[0]] and "010.000.000.255" not in got[texts[3]]
    assert got[None] is None
