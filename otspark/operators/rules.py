"""Rules over frames: each rule is compiled to one condition, and all rules are tried in one pass over the frames.

A condition is a mapping as rule files have it; its clauses are joined by AND:
protocol; function_code (a number, or in / range / not_in); unit_id; message_type; service_code (a number or in);
payload_field (name with equals, greater_than, less_than). A missing code matches no number and no `in`, passes `not_in`,
and counts as -1 in a range, as a code of 0 does.

Over typed frames (decode(typed=True)) a field is compared as what it is: a number with numbers, a text with texts; `equals`
with nothing asks for a field that is missing. Over frames with text alone a field is read as the rule's value is.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otspark.functions.dims import SCORES, SEVERITIES
from otspark.operators import typed
from otspark.sources.packets import ORDER


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    category: str
    condition: dict
    confidence: float = 0.9
    tags: tuple[str, ...] = ()
    enabled: bool = True
    description: str = ""
    evidence_fields: tuple[str, ...] = ()


# fixed values: the rules that come with the engine
RULES = (
    Rule("DNP3-001", "DNP3 Cold or Warm Restart", "HIGH", "PROTOCOL", {"protocol": "dnp3", "function_code": {"in": [13, 14]}}, tags=("restart", "operational-impact")),
    Rule("DNP3-002", "DNP3 Direct Operate / Operate", "MEDIUM", "PROTOCOL", {"protocol": "dnp3", "function_code": {"in": [4, 5, 6]}}, tags=("control", "write")),
    Rule("GEN-001", "New Communication Pair", "LOW", "NETWORK", {"protocol": "modbus", "message_type": "request"}, enabled=False),
    Rule("MB-001", "Modbus Broadcast Write", "HIGH", "PROTOCOL", {"protocol": "modbus", "function_code": {"in": [5, 6, 15, 16]}, "unit_id": 255}, evidence_fields=("unit_id",)),
    Rule("S7-001", "S7 PLC control / STOP", "CRITICAL", "PROTOCOL", {"protocol": "s7", "service_code": {"in": [40, 41]}}),
    Rule("S7-002", "S7 Job Write Variable", "CRITICAL", "PROTOCOL", {"protocol": "s7", "service_code": {"in": [5]}}, enabled=False),
    Rule("S7-003", "S7 program download (block transfer)", "CRITICAL", "PROTOCOL", {"protocol": "s7", "service_code": {"in": [26, 27, 28, 29]}}, enabled=False),
)


def problems(rule: dict) -> list[str]:
    """What is wrong with a rule as a rule file has it; nothing if it can be used."""
    if not isinstance(rule, dict):
        return ["a rule must be a mapping"]
    out = [f"missing: {k}" for k in ("id", "name", "severity", "category", "condition") if k not in rule]
    if "severity" in rule and str(rule["severity"]).upper() not in SEVERITIES:
        out.append(f"unknown severity: {rule['severity']}")
    if "condition" in rule and not isinstance(rule["condition"], dict):
        out.append("condition must be a mapping")
    return out


@dataclass
class Loaded:
    rules: list[Rule] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def load(text: str) -> Loaded:
    """Rules of a YAML document with a list `rules`; those that cannot be used are told in errors."""
    import yaml

    out = Loaded()
    document = yaml.safe_load(text) or {}
    for r in document.get("rules") or [] if isinstance(document, dict) else []:
        wrong = problems(r)
        if wrong:
            out.errors += wrong
            continue
        out.rules.append(Rule(str(r["id"]), str(r["name"]), str(r["severity"]).upper(), str(r["category"]).upper(), r["condition"], float(r.get("confidence", 0.9)), tuple(r.get("tags") or ()), bool(r.get("enabled", True)), str(r.get("description", "")), tuple(r.get("evidence_fields") or ())))
    return out


def _number_clause(of: Column, wanted) -> list[Column]:
    no = lambda c: F.coalesce(c, F.lit(False))
    if isinstance(wanted, int):
        return [no(of == wanted)]
    out = []
    if "in" in wanted:
        out.append(no(of.isin(*wanted["in"])))
    if "range" in wanted:
        low, high = wanted["range"]
        out.append(F.when(F.coalesce(of, F.lit(0)) == 0, F.lit(-1)).otherwise(of).between(low, high))
    if "not_in" in wanted:
        out.append(F.coalesce(~of.isin(*wanted["not_in"]), F.lit(True)))
    return out


def matches(condition: dict, by_type: bool = False) -> Column:
    """The condition as one Column over frames, typed ones or not; clauses of unusable types never match."""
    value = lambda k: F.try_element_at("fields", F.lit(k))
    code = F.col("function_code")
    tests: list[Column] = []
    try:
        if "protocol" in condition:
            tests.append(F.lower("protocol_slug") == str(condition["protocol"]).lower())
        if "function_code" in condition and not isinstance(condition["function_code"], list):
            tests += _number_clause(code, condition["function_code"])
        if "unit_id" in condition:
            tests.append(typed.equals("unit_id", condition["unit_id"]) if by_type else value("unit_id").try_cast("long") == condition["unit_id"])
        if "message_type" in condition:
            tests.append(F.col("message_type") == condition["message_type"])
        if "service_code" in condition:
            wanted = condition["service_code"]
            s7 = typed.number("s7_function_code", "int") if by_type else value("s7_function_code").try_cast("int")
            tests += _number_clause(F.coalesce(s7, code), wanted if isinstance(wanted, int) else {"in": wanted["in"]})
        if "payload_field" in condition and (name := condition["payload_field"].get("name")):
            f = condition["payload_field"]
            if by_type:
                tests += [typed.TESTS[k](name, f[k]) for k in typed.TESTS if k in f]
                f = {}
            if "equals" in f:
                tests.append(value(name) == (str(f["equals"]).lower() if isinstance(f["equals"], bool) else str(f["equals"])))
            if "greater_than" in f:
                tests.append(value(name).try_cast("double") > float(f["greater_than"]))
            if "less_than" in f:
                tests.append(value(name).try_cast("double") < float(f["less_than"]))
    except (TypeError, KeyError, ValueError):
        return F.lit(False)
    return reduce(and_, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


def possible(conditions: list[dict]) -> Column:
    """What frames must have to meet one of the conditions, by protocol and code alone: asked before any field is worked out."""
    plain = [matches({k: c[k] for k in ("protocol", "function_code") if k in c}) for c in conditions]
    return reduce(or_, plain, F.lit(False))


def events(frames: DataFrame, rules: tuple[Rule, ...] | list[Rule] = RULES, min_severity: str = "INFO") -> DataFrame:
    """One row per frame and enabled rule that it meets, of at least the given severity; ids follow from rule and packet."""
    used = [(i, r) for i, r in enumerate(rules) if r.enabled and SEVERITIES[r.severity] >= SEVERITIES[min_severity]]
    frames = frames.where(possible([r.condition for _, r in used]))
    code, no = F.concat(F.lit("0x"), F.lpad(F.hex("function_code"), 2, "0")), F.create_map().cast("map<string,string>")
    code = F.when(F.col("function_code") > 255, F.concat(F.lit("0x"), F.hex("function_code"))).otherwise(code)
    known = F.col("function_code").isNotNull()
    where = F.concat(F.coalesce("src_ip", F.lit("None")), F.lit(" → "), F.coalesce("dst_ip", F.lit("None")), F.lit(" ("), F.coalesce("protocol", F.lit("None")), F.when(known, F.concat(F.lit(", FC="), code)).otherwise(""), F.lit(")"))
    basic = F.map_concat(F.create_map(F.lit("src_ip"), F.col("src_ip"), F.lit("dst_ip"), F.col("dst_ip"), F.lit("protocol"), F.col("protocol")), F.when(known, F.create_map(F.lit("function_code"), code, F.lit("function_name"), F.coalesce("function_name", F.lit("")))).otherwise(no))
    own = ("src_ip", "dst_ip", "protocol", "function_code", "function_name")
    hit = lambda i, r: F.struct(
        F.lit(r.severity).alias("severity"), F.lit(SCORES[r.severity]).alias("severity_score"), F.lit(r.category).alias("category"), F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"),
        F.lit(r.confidence).alias("confidence"), F.lit(i).alias("rule_position"),
        # a field that a rule asks for stands before what every event tells
        F.map_concat(F.map_filter(basic, lambda k, v: ~(k.isin(*r.evidence_fields) & F.array_contains(F.map_keys(F.coalesce("fields", no)), k)) if set(own) & set(r.evidence_fields) else F.lit(True)), F.coalesce(F.map_filter("fields", lambda k, v: k.isin(*r.evidence_fields) if r.evidence_fields else F.lit(False)), no)).alias("evidence"),
        F.concat(F.lit(f"{r.description} — "), where).alias("description"), F.array(*map(F.lit, r.tags)).cast("array<string>").alias("tags"), F.array("src_ip", "dst_ip").alias("affected_assets"),
    )
    none = "array<struct<severity:string,severity_score:int,category:string,rule_id:string,rule_name:string,confidence:double,rule_position:int,evidence:map<string,string>,description:string,tags:array<string>,affected_assets:array<string>>>"
    hits = F.array_compact(F.array(*[F.when(matches(r.condition, typed.DATA in frames.columns), hit(i, r)) for i, r in used])) if used else F.array().cast(none)
    out = frames.select(*ORDER, "ts_us", "parser_idx", "src_ip", "dst_ip", "protocol", "function_code", "function_name", F.explode(hits).alias("_h")).select("*", "_h.*").drop("_h")
    key = F.concat_ws("|", "rule_id", "rule_position", *ORDER, "parser_idx")
    return out.withColumn("event_id", F.concat(F.lit("ANO-"), F.substring(F.md5(key), 1, 16)))


def histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "category", "rule_id").agg(F.count("*").alias("events"))


def ordered(found: DataFrame) -> DataFrame:
    """Events by severity, the gravest first; ties as they came."""
    return found.orderBy(F.desc("severity_score"), *ORDER, "parser_idx", "rule_position")


def timeline(found: DataFrame) -> DataFrame:
    """Events by time, those without one first; ties by rule."""
    return found.orderBy(F.asc_nulls_first("ts_us"), "rule_id", *ORDER)


def rule_deltas(before: DataFrame, now: DataFrame) -> DataFrame:
    """Events of each rule in two runs, and the difference."""
    count = lambda df, name: df.groupBy("rule_id").agg(F.count("*").alias(name))
    both = count(before, "before").join(count(now, "now"), "rule_id", "full_outer").fillna(0, ["before", "now"])
    return both.withColumn("delta", F.col("now") - F.col("before"))
