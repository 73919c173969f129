"""The whole analysis of captures: packets to assets, flows, events, survey, graph, findings, and the report of them.

Packets and frames are computed once, behind a reliable checkpoint; every table is a DataFrame of them. Only the short lists
of a report come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otspark.config import Settings
from otspark.errors import ConfigurationError, RuleError
from otspark.operators import assets as asset_ops
from otspark.operators import baseline, cleartext, compare, components, decode, findings, flows, graph, privacy, rules, survey, topology
from otspark.progress import Progress
from otspark.sinks import files
from otspark.sources import capture

#: Rows that a report document shows of a table, at most; its tables and the exports have all.
SHOWN = 1_000


@dataclass
class Analysis:
    settings: Settings
    records: DataFrame | None
    packets: DataFrame
    frames: DataFrame
    flows: DataFrame
    assets: DataFrame
    events: DataFrame
    read_errors: DataFrame | None
    progress: Progress

    @property
    def spark(self) -> SparkSession:
        return self.packets.sparkSession


def load_rules(spark: SparkSession, folder: str | None) -> list[rules.Rule]:
    """The rules given with the package, and those of the YAML files of a folder, by file name; a file with a bad rule is an error."""
    out = list(rules.RULES)
    if folder:
        texts = spark.read.text(folder, wholetext=True, pathGlobFilter="*.y*ml").select("value", F.input_file_name().alias("name")).orderBy("name").collect()
        for r in texts:
            got = rules.load(r.value)
            if got.errors:
                raise RuleError(f"{r.name}: {'; '.join(got.errors)}")
            out += got.rules
    return out


def statistical_events(found: DataFrame) -> DataFrame:
    """Events of flows: irregular timing and dispersed sizes."""
    one = lambda rows, rule, name, confidence: rows.select(
        F.lit("LOW").alias("severity"), F.lit(3).alias("severity_score"), F.lit("BEHAVIORAL").alias("category"), F.lit(rule).alias("rule_id"), F.lit(name).alias("rule_name"), F.lit(confidence).alias("confidence"),
        "src_ip", "dst_ip", F.col("start_us").alias("ts_us"), F.col("flow_id"),
    )
    return one(flows.timing_irregular(found), "STAT-003", "irregular timing", 0.6).unionByName(one(flows.size_dispersion(found), "STAT-004", "dispersed sizes", 0.55))


def events_of(frames: DataFrame, found: DataFrame, wanted: list[rules.Rule], least: str) -> DataFrame:
    """Events of rules, of rare codes and of flows, of at least the severity."""
    score = F.create_map(*[F.lit(x) for p in rules.SCORES.items() for x in p])
    by_rule = rules.events(frames, wanted, least)
    rare = flows.rare_function_codes(frames).select("file_idx", "packet_number", "parser_idx", "src_ip", "dst_ip", "ts_us", "protocol", "function_code", "severity", score[F.col("severity")].alias("severity_score"), F.lit("BEHAVIORAL").alias("category"), F.lit("STAT-002").alias("rule_id"), F.lit("rare function code").alias("rule_name"), F.lit(0.7).alias("confidence"))
    every = by_rule.unionByName(rare, allowMissingColumns=True).unionByName(statistical_events(found), allowMissingColumns=True)
    return every.where(F.col("severity").isin(*[s for s, n in rules.SEVERITIES.items() if n >= rules.SEVERITIES[least]]))


def of_packets(packets: DataFrame, settings: Settings, records: DataFrame | None = None, read_errors: DataFrame | None = None, progress: Progress | None = None) -> Analysis:
    """The analysis of packets that are a table already; what the report counts is observed while the tables are made."""
    progress, rows = progress or Progress(), F.count("*")
    frames = progress.cut(decode.decode(packets, list(settings.protocols), typed=True), "frames", rows=rows, protocols=F.array_sort(F.collect_set("protocol")))
    found = progress.cut(flows.with_frames(flows.flow_build(packets), frames), "flows", rows=rows, packets=F.coalesce(F.sum("packet_count"), F.lit(0)))
    inventory = progress.cut(asset_ops.inventory(packets, frames), "assets", rows=rows)
    events = events_of(frames, found, load_rules(packets.sparkSession, settings.rules), settings.min_severity)
    events = progress.cut(events if settings.with_rules else events.limit(0), "events", rows=rows, **{s: F.count_if(F.col("severity") == s) for s in rules.SEVERITIES})
    return Analysis(settings, records, packets, frames, found, inventory, events, read_errors, progress)


def analyse(spark: SparkSession, settings: Settings) -> Analysis:
    wrong = settings.problems()
    if wrong:
        raise ConfigurationError("; ".join(wrong))
    records = capture.records(spark, list(settings.inputs), settings.most_packets)
    progress = Progress()
    packets = progress.cut(capture.packets(records), "packets", rows=F.count("*"), bytes=F.coalesce(F.sum("length"), F.lit(0)), first_us=F.min("ts_us"), last_us=F.max("ts_us"))
    return of_packets(packets, settings, records, capture.errors(records), progress)


def survey_document(packets: DataFrame) -> dict:
    one = lambda df: files.rows_of(df)[0]
    seen = cleartext.observations(survey.on_network(packets))
    ports = {f"top_{side}_{t.lower()}_ports": files.rows_of(survey.top_ports(packets, side, t)) for side in ("dst", "src") for t in ("TCP", "UDP")}
    return {
        "capture_window": one(survey.window(packets)), "addressing": one(survey.addressing(packets)), "hardware": one(survey.hardware(packets)), "ip_protocols": files.rows_of(survey.ip_protocols(packets)), "ethertypes": files.rows_of(survey.ethertypes(packets)),
        "tcp_behavior": one(survey.tcp_behaviour(packets)), **ports, "dns_qnames_top": files.rows_of(survey.names(packets)), "tls": files.rows_of(survey.tls(packets)), "http_hosts_top": files.rows_of(survey.hosts(packets)),
        "cleartext_hints": {r["hint"]: r["packets"] for r in files.rows_of(survey.hints(packets))}, "banner_samples": files.rows_of(survey.banners(packets)),
        "cleartext_ot_sensitive": {"hits_by_category": {r["category"]: r["count"] for r in files.rows_of(seen.groupBy("category").count())}, "samples": files.rows_of(cleartext.samples(seen).drop("payload"))},
        "ics_port_visibility": files.rows_of(survey.ics_visibility(packets)), "timeline": files.rows_of(survey.timeline(packets)),
        "threat_hints": {"scanner_tool_string_hits": files.rows_of(survey.tool_marks(packets)), "credential_exposure_samples": files.rows_of(survey.credentials(packets)), "repeated_tcp_payload_fingerprints": files.rows_of(survey.repeated_payloads(packets))},
    }


def report(a: Analysis) -> dict:
    """The report: metadata, summary, assets, flows, topology, anomalies, statistics, components. Tables are cut at SHOWN rows."""
    s, rows = a.settings, files.rows_of
    short = lambda df: rows(df.limit(SHOWN))
    figures = graph.cut(findings.figures(a.flows, a.assets, a.events, a.packets))
    m = findings.metrics(figures)
    valuable = rows(findings.valuable_targets(a.assets))
    found = rows(findings.audit(figures).orderBy("finding_id"))
    links = graph.links(a.flows, s.most_edges)
    matrix = flows.comm_matrix(a.flows)
    severity = {r["severity"]: r["count"] for r in rows(a.events.groupBy("severity").count())}
    total = a.flows.count()
    exported = min(total, s.most_flows or total)
    out = {
        "metadata": {"inputs": list(s.inputs), "mode": s.mode, "protocols": list(s.protocols) or list(decode.DECODERS), **a.progress.metadata(), "read_errors": rows(a.read_errors) if a.read_errors is not None else [], "evidence": rows(capture.evidence(a.spark, list(s.inputs))) if s.inputs else []},
        "summary": {"assets_discovered": a.assets.count(), "ot_assets_discovered": asset_ops.ot_assets(a.assets).count(), "flows_analyzed": total, "flows_exported": exported, "flows_omitted_from_export": total - exported, "anomalies_detected": sum(severity.values()), "critical_anomalies": severity.get("CRITICAL", 0), "protocols_seen": [r["protocol"] for r in rows(a.frames.select("protocol").distinct().orderBy("protocol"))]},
        "assets": short(components.tagged(a.assets).orderBy("ip_address")), "ot_assets": short(asset_ops.ot_assets(a.assets)), "flows": short(files.exported_flows(a.flows, s.most_flows)), "anomalies": short(rules.ordered(a.events)),
        "components": {"catalog": rows(components.catalog(a.spark)), "summary": rows(components.summary(a.assets))[0], "observed": rows(components.tag_counts(a.assets)), "not_observed": [r["component_id"] for r in rows(components.not_seen(a.assets))]},
        "statistics": {
            "asset_stats": rows(asset_ops.role_counts(a.assets)), "flow_stats": rows(flows.flow_stats(a.flows))[0], "protocol_distribution": rows(flows.protocol_distribution(a.flows)), "top_talkers": rows(flows.top_talkers(a.flows)), "temporal_heatmap": short(flows.temporal_heatmap(a.flows)),
            "communication_matrix": short(flows.matrix_trim(matrix, s.most_matrix) if s.most_matrix else matrix), "communication_graph": short(links), "periodic_flows": short(flows.periodic_flows(a.flows)), "top_flows_detailed": rows(flows.top_flows(a.flows)), "deep_survey": survey_document(a.packets), "learned": rows(compare.learned(a.frames)),
            "pentest_insights": {"passive_findings": findings.threats(m) + findings.insights(m), "summary_counts": findings.summary_counts(m, len(valuable)), "write_sources": [r["src_ip"] for r in rows(findings.write_sources(a.flows))], "flows_with_exceptions": rows(findings.exception_flows(a.flows)), "segmentation_observations": rows(findings.crossing_flows(a.flows)), "high_value_targets": valuable, "anomaly_severity_distribution": severity},
            "threat_patterns": {"modbus_write_flows": rows(findings.write_flows(a.flows)), "s7_critical_flows": rows(findings.s7_critical_flows(a.flows)), "it_remote_protocol_flows": rows(findings.busiest(flows.it_edge_flows(a.flows), findings.MOST["it"])), "sequential_ics_access_hints": rows(findings.many_target_sources(a.flows, a.assets)), "modbus_read_non_engineering_hints": rows(findings.busiest(flows.unauthorized_reads(a.flows, a.assets), findings.MOST["reads"])), "executive_findings": findings.threats(m)},
            "audit_workbook": {"findings": found, "finding_counts_by_severity": {k: sum(f["severity"] == k for f in found) for k in findings.WEIGHTS}, "passive_exposure_index": findings.exposure(figures).first()[0], "write_flow_samples": rows(findings.write_samples(a.flows)), "external_facing_assets": rows(findings.public_assets(a.assets)), "assets_with_remote_admin_ports": rows(findings.admin_assets(a.assets)), "techniques": [findings.technique(t) for t in sorted({t for f in found for t in f["techniques"]})]},
            "event_timeline": short(rules.timeline(a.events)), "anomaly_stats": {"total_anomalies": sum(severity.values()), "severity_distribution": severity},
        },
        "topology": {"nodes": short(graph.link_nodes(links, a.assets)), "edges": short(links), "zones": short(graph.zones(a.assets)), "stats": rows(graph.graph_stats(links))[0]} if s.with_topology else {},
    }
    return privacy.document(out, anonymise=s.anonymise, mask=s.mask)


def export(a: Analysis) -> dict[str, str]:
    """Writes what the settings ask for; returns the places."""
    s, spark, out = a.settings, a.spark, {}
    at = files.suffix() if s.suffix is None else s.suffix
    place = lambda stem, tail: f"{s.output}/{files.named(stem, tail, at)}"
    hide = lambda df: privacy.masked(privacy.anonymised(df) if s.anonymise else df) if s.mask else privacy.anonymised(df) if s.anonymise else df
    document = report(a)
    keys = {k: hide(v) for k, v in report_keys(a).items()}
    if s.compare:
        before = files.read_json(spark, s.compare) or {}
        told = report_diff(kept_keys(spark, before), keys)
        document["statistics"]["baseline_diff"] = {"counts": files.rows_of(told.groupBy("change").count().orderBy("change")), **{name: files.rows_of(told.where(F.col("change") == change).orderBy("value").limit(SHOWN).select(*columns)) for name, (change, columns) in CHANGES.items()}}
        out["baseline_diff"] = place("baseline_diff", "csv")
        files.write_csv(told.orderBy("change", "value"), out["baseline_diff"])
    if "json" in s.formats:
        out["json"] = place("analysis_report", "json")
        document["tables"] = {k: place(f"report_{k}", "parquet") for k in keys}
        for k, v in keys.items():
            v.write.mode("overwrite").parquet(document["tables"][k])
        files.write_json(spark, document, out["json"])
    if "csv" in s.formats:
        audit = spark.createDataFrame(document["statistics"]["audit_workbook"]["findings"] or [], "finding_id string, severity string, category string, evidence string, techniques array<string>, remediation string")
        tables = {"assets": components.tagged(a.assets), "ot_assets": asset_ops.ot_assets(a.assets), "flows": files.exported_flows(a.flows, s.most_flows), "anomalies": rules.ordered(a.events), "audit_findings": audit}
        out |= files.write_bundle({k: hide(v) for k, v in tables.items()}, s.output, at)
    if "ndjson" in s.formats:
        out["ndjson"] = place("anomalies", "ndjson")
        files.write_lines(hide(a.events), out["ndjson"])
    if "html" in s.formats:
        out["html"] = place("report", "html")
        files.write_page(spark, out["html"], "Capture analysis", {k: document[k] for k in ("assets", "flows", "anomalies")} | {"findings": document["statistics"]["audit_workbook"]["findings"]}, document["summary"])
    if "map" in s.formats and document["topology"]:
        out["map"] = place("communication_map", "html")
        files.write_bytes(spark, out["map"], [files.communication_map(document["topology"]["nodes"], document["topology"]["edges"]).encode()])
    if "graphml" in s.formats and s.graph and document["topology"]:
        out["graphml"] = place("topology", "graphml")
        files.write_bytes(spark, out["graphml"], files.graphml(document["topology"]["nodes"], document["topology"]["edges"]))
        shown = [len(document["topology"][k]) for k in ("nodes", "edges")]
        if max(shown) >= SHOWN or shown[1] == s.most_edges:  # the document may lack some: the whole graph beside it
            out["graphml_whole"] = place("topology_whole", "graphml")
            of = topology.merged(topology.edges(a.flows))
            topology.write_graphml(hide(topology.nodes(of, a.assets)), hide(of), out["graphml_whole"])
    if s.subset and a.records is not None:
        keyed = a.events.join(a.packets.select("file_idx", "packet_number", "pcap_file"), ["file_idx", "packet_number"])
        if files.write_capture(files.subset(a.records, keyed), s.subset):
            out["subset"] = s.subset
    return out


#: What a comparison of reports lists, by kind of change.
CHANGES = {"new_asset_ips": ("new asset", ["value"]), "removed_asset_ips": ("removed asset", ["value"]), "new_ics_protocols_in_flows": ("new protocol", ["value"]), "removed_ics_protocols_in_flows": ("removed protocol", ["value"]), "anomaly_rule_count_deltas": ("rule count", ["value", "before", "now", "delta"])}


def report_keys(a: Analysis) -> dict[str, DataFrame]:
    """What later reports are compared by, whole: addresses, protocol labels of flows, events of each rule."""
    return {
        "assets": a.assets.select("ip_address").where("ip_address is not null").distinct(),
        "protocols": a.flows.select("ics_protocol").where("ics_protocol is not null").distinct(),
        "rules": a.events.where("rule_id is not null").groupBy("rule_id").agg(F.count("*").alias("events")),
    }


def kept_keys(spark: SparkSession, document: dict) -> dict[str, DataFrame]:
    """The same of a report written before: its tables, or the lists of a document that has none."""
    if document.get("tables"):
        return {k: spark.read.parquet(path) for k, path in document["tables"].items()}
    of = lambda name, key: spark.createDataFrame([(x[key],) for x in document.get(name) or [] if x.get(key)], f"{key} string")
    return {"assets": of("assets", "ip_address").distinct(), "protocols": of("flows", "ics_protocol").distinct(), "rules": of("anomalies", "rule_id").groupBy("rule_id").agg(F.count("*").alias("events"))}


def report_diff(before: dict[str, DataFrame], now: dict[str, DataFrame]) -> DataFrame:
    """change, value, before, now, delta: addresses and labels that only one report has, and rules whose number of events differs.

    Labels of several protocols count as they are.
    """
    only = lambda a, b, kind, key: a.select(key).subtract(b.select(key)).select(F.lit(kind).alias("change"), F.col(key).alias("value"), *[F.lit(None).cast("long").alias(c) for c in ("before", "now", "delta")])
    both = before["rules"].select("rule_id", F.col("events").alias("b")).join(now["rules"].select("rule_id", F.col("events").alias("n")), "rule_id", "full_outer")
    b, n = F.coalesce("b", F.lit(0)), F.coalesce("n", F.lit(0))
    counts = both.where(b != n).select(F.lit("rule count").alias("change"), F.col("rule_id").alias("value"), b.alias("before"), n.alias("now"), (n - b).alias("delta"))
    out = counts
    for kind, key in (("asset", "ip_address"), ("protocol", "ics_protocol")):
        old, new = before[f"{kind}s"], now[f"{kind}s"]
        out = out.unionByName(only(new, old, f"new {kind}", key)).unionByName(only(old, new, f"removed {kind}", key))
    return out


# ---- behaviour over time ----


def baseline_documents(packets: DataFrame) -> dict[str, dict]:
    """The four documents of a baseline: communication, protocols, commands, timing."""
    rows = files.rows_of
    edges = graph.cut(baseline.edges(packets))
    requests = graph.cut(decode.modbus_requests(packets).select("src_ip", "function_code", "category", "file_idx", "packet_number"))
    seconds = graph.cut(baseline.per_second(packets))
    total = {r["category"]: r["count"] for r in rows(requests.groupBy("category").count())}
    mean = seconds.agg(F.avg("pps").alias("mean")).first().mean
    return {
        "communication_map": {"edges": rows(edges.orderBy(F.desc("packets"), "src_ip", "dst_ip").limit(SHOWN)), "top_hosts": rows(baseline.top_hosts(edges)), "rare_edges": rows(baseline.rare_edges(edges).orderBy("packets", "src_ip", "dst_ip").limit(200)), "one_to_many": rows(baseline.one_to_many(edges))},
        "protocol_baseline": {"transport": rows(baseline.transport_split(packets)), "industrial": rows(baseline.industrial_hits(packets)), "services": rows(baseline.service_flags(packets).limit(500))},
        "command_profile": {"totals": total, "write_source_ips": [r["src_ip"] for r in rows(requests.where("category = 'write'").select("src_ip").distinct().orderBy("src_ip"))], "sources": rows(baseline.command_sources(requests)), "rare_codes": rows(baseline.rare_codes(requests))},
        "traffic_profile": {"aggregate": {"mean_packets_per_second": mean}, "anomalies": rows(baseline.rolling_anomalies(seconds.select("sec", "pps")).limit(400)), "steady": rows(baseline.steady(seconds)), "intervals": rows(baseline.intervals(packets).limit(30))},
    }


def write_baseline(spark: SparkSession, packets: DataFrame, folder: str) -> dict[str, str]:
    """The documents as JSON files and a summary in words; returns the places."""
    documents = baseline_documents(packets)
    out = {}
    for name, d in documents.items():
        out[name] = f"{folder}/{name}.json"
        files.write_json(spark, d, out[name])
    c, p = documents["communication_map"], documents["command_profile"]
    lines = [f"edges shown: {len(c['edges'])}", f"hosts shown: {len(c['top_hosts'])}", f"requests: {p['totals']}", f"writing sources: {len(p['write_source_ips'])}", f"spikes and drops: {len(documents['traffic_profile']['anomalies'])}"]
    out["summary"] = f"{folder}/summary.txt"
    files.write_bytes(spark, out["summary"], ["\n".join(lines).encode() + b"\n"])
    return out
