"""Settings of an analysis, and what is wrong with them."""

from __future__ import annotations

from dataclasses import dataclass, field

from otspark.functions.dims import SEVERITIES
from otspark.operators.decode import DECODERS

MODES = ("full", "anomaly-only", "asset-only", "topology-only")
FORMATS = ("json", "csv", "ndjson", "html", "map", "graphml")
ENDINGS = (".pcap", ".pcapng", ".gz")


def formats_of(text: str | None) -> tuple[str, ...]:
    """Formats of a comma-separated list, each once; all for nothing or 'all'."""
    if not text or not text.strip() or text.strip().lower() == "all":
        return FORMATS
    return tuple(dict.fromkeys(p.strip().lower() for p in text.split(",") if p.strip()))


def protocols_of(text: str | None) -> tuple[str, ...]:
    """Protocols of a comma-separated list; none means all."""
    return tuple(dict.fromkeys(p.strip().lower() for p in (text or "").split(",") if p.strip()))


@dataclass(frozen=True)
class Settings:
    """inputs: paths of captures (any store); most_packets: of each file, 0 for all; most_*: rows of exports, 0 for all."""

    inputs: tuple[str, ...] = ()
    output: str = "results"
    mode: str = "full"
    protocols: tuple[str, ...] = ()
    formats: tuple[str, ...] = FORMATS
    min_severity: str = "INFO"
    rules: str | None = None
    compare: str | None = None
    subset: str | None = None
    most_packets: int = 0
    most_flows: int = 0
    most_matrix: int = 0
    most_edges: int = 0
    anonymise: bool = False
    mask: bool = False
    graph: bool = True
    suffix: str | None = None
    extra: dict = field(default_factory=dict)

    def problems(self) -> list[str]:
        out = []
        if not self.inputs:
            out.append("no capture given")
        out += [f"not a capture by its name: {p}" for p in self.inputs if not p.lower().rstrip("/*").endswith(ENDINGS) and "." in p.rsplit("/", 1)[-1]]
        if self.mode not in MODES:
            out.append(f"unknown mode: {self.mode} (one of {', '.join(MODES)})")
        if self.min_severity not in SEVERITIES:
            out.append(f"unknown severity: {self.min_severity} (one of {', '.join(SEVERITIES)})")
        out += [f"unknown protocol: {p}" for p in self.protocols if p not in DECODERS]
        out += [f"unknown format: {f} (of {', '.join(FORMATS)})" for f in self.formats if f not in FORMATS]
        if not self.formats:
            out.append("no format given")
        out += [f"{name} is under 0" for name in ("most_packets", "most_flows", "most_matrix", "most_edges") if getattr(self, name) < 0]
        return out

    @property
    def with_rules(self) -> bool:
        return self.mode in ("full", "anomaly-only")

    @property
    def with_topology(self) -> bool:
        return self.mode != "anomaly-only"
