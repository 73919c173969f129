"""Results as files: CSV, JSON lines, a JSON document, GraphML, HTML, capture files.

Tables are written by Spark, in as many parts as they have partitions. Documents (the report, the graph, a page) hold short
tables only; they are put together on the driver and written through Spark's file systems, so any store will do.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from otspark.sources import pcap, ranged

#: Packets that a capture file is written of at a time.
CHUNK = 10_000


def suffix(now: datetime | None = None) -> str:
    """_YYYYMMDD_HHMMSS in UTC, for names of exports."""
    return (now or datetime.now(timezone.utc)).strftime("_%Y%m%d_%H%M%S")


def named(stem: str, tail: str, at: str | None = None) -> str:
    return f"{stem}{suffix() if at is None else at}.{tail}"


def flat(df: DataFrame) -> DataFrame:
    """Arrays as texts joined by ';', structs and maps as JSON: what a CSV file can hold. Columns in text order."""

    def one(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType):
            plain = not isinstance(f.dataType.elementType, (ArrayType, MapType, StructType))
            return (F.array_join(c.cast("array<string>"), ";") if plain else F.to_json(c)).alias(f.name)
        return F.to_json(c).alias(f.name) if isinstance(f.dataType, (MapType, StructType)) else c

    return df.select(*[one(f) for f in sorted(df.schema, key=lambda f: f.name)])


def write_csv(df: DataFrame, path: str, *, parts: int | None = None) -> None:
    """A folder of CSV files with a header; an empty table has one file with the header alone."""
    rows = flat(df)
    (rows.coalesce(parts) if parts else rows).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_bundle(tables: dict[str, DataFrame], folder: str, at: str | None = None) -> dict[str, str]:
    """Each table as CSV under its name; returns the folders."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{folder}/{named(name, 'csv', at)}"
        write_csv(df, out[name])
    return out


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def exported_flows(flows: DataFrame, most: int = 0) -> DataFrame:
    """The flows with most packets, `most` of them; 0 is all."""
    return flows.orderBy(F.desc("packet_count"), "first_file", "first_packet").limit(most) if most else flows


def write_bytes(spark: SparkSession, path: str, parts: Iterable[bytes]) -> int:
    """Bytes to a file of any store that Spark writes; returns how many."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    n = 0
    try:
        for p in parts:
            out.write(bytearray(p))
            n += len(p)
    finally:
        out.close()
    return n


def rows_of(df: DataFrame) -> list[dict]:
    """A short table as plain values."""
    return [json.loads(r._json) for r in df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("_json")).collect()]


def write_json(spark: SparkSession, document: dict, path: str) -> int:
    return write_bytes(spark, path, [json.dumps(document, indent=2, ensure_ascii=False, default=str).encode()])


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A document written before; None where it is missing or no JSON. A store that fails is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        return json.loads(text)
    except ValueError:
        return None


def graphml(nodes: Iterable[dict], edges: Iterable[dict]) -> Iterator[bytes]:
    """A directed graph: nodes by `ip`, edges by `src_ip` and `dst_ip`; other values as text, lists joined by commas, none as nothing."""
    nodes, edges = list(nodes), list(edges)
    text = lambda v: "" if v is None else ",".join(map(str, v)) if isinstance(v, (list, tuple, set)) else str(v)
    keys = {("node", k): f"n{i}" for i, k in enumerate(sorted({k for n in nodes for k in n} - {"ip"}))}
    keys |= {("edge", k): f"e{i}" for i, k in enumerate(sorted({k for e in edges for k in e} - {"src_ip", "dst_ip"}))}
    yield b'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
    for (kind, k), i in keys.items():
        yield f'<key id="{i}" for="{kind}" attr.name={quoteattr(k)} attr.type="string"/>\n'.encode()
    yield b'<graph edgedefault="directed">\n'
    for n in nodes:
        data = "".join(f'<data key="{keys["node", k]}">{escape(text(v))}</data>' for k, v in n.items() if k != "ip")
        yield f"<node id={quoteattr(n['ip'])}>{data}</node>\n".encode()
    for e in edges:
        data = "".join(f'<data key="{keys["edge", k]}">{escape(text(v))}</data>' for k, v in e.items() if k not in ("src_ip", "dst_ip"))
        yield f"<edge source={quoteattr(e['src_ip'])} target={quoteattr(e['dst_ip'])}>{data}</edge>\n".encode()
    yield b"</graph>\n</graphml>\n"


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> int:
    return write_bytes(nodes.sparkSession, path, graphml(rows_of(nodes), rows_of(edges)))


def page(title: str, tables: dict[str, list[dict]], data: dict | None = None) -> str:
    """An HTML page of short tables; `data` is embedded as JSON that no markup can end."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>table{{border-collapse:collapse}}td,th{{border:1px solid #999;padding:2px 6px;text-align:left}}</style></head><body><h1>{html.escape(title)}</h1>"]
    for name, rows in tables.items():
        columns = list(dict.fromkeys(k for r in rows for k in r))
        out.append(f"<h2>{html.escape(name)} ({len(rows)})</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in columns)}</tr>")
        show = lambda v: "" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v)
        out += ["<tr>" + "".join(f"<td>{html.escape(show(r.get(c)))}</td>" for c in columns) + "</tr>" for r in rows]
        out.append("</table>")
    if data is not None:
        out.append('<script type="application/json" id="data">' + json.dumps(data, default=str).replace("<", "\\u003c") + "</script>")
    return "".join(out) + "</body></html>"


def write_page(spark: SparkSession, path: str, title: str, tables: dict[str, list[dict]], data: dict | None = None) -> int:
    return write_bytes(spark, path, [page(title, tables, data).encode()])


def communication_map(nodes: list[dict], links: list[dict]) -> str:
    """A page with the graph drawn in a circle (SVG) and its links as a table."""
    import math

    at = {n["ip"]: (400 + 340 * math.cos(2 * math.pi * i / max(1, len(nodes))), 400 + 340 * math.sin(2 * math.pi * i / max(1, len(nodes)))) for i, n in enumerate(nodes)}
    lines = "".join(f'<line x1="{at[e["src_ip"]][0]:.0f}" y1="{at[e["src_ip"]][1]:.0f}" x2="{at[e["dst_ip"]][0]:.0f}" y2="{at[e["dst_ip"]][1]:.0f}" stroke="#888"/>' for e in links if e["src_ip"] in at and e["dst_ip"] in at)
    dots = "".join(f'<circle cx="{x:.0f}" cy="{y:.0f}" r="5"/><text x="{x + 7:.0f}" y="{y:.0f}" font-size="11">{html.escape(ip)}</text>' for ip, (x, y) in at.items())
    return page("Communication map", {"links": links}, {"nodes": nodes, "links": links}).replace("<h2>", f'<svg width="820" height="820">{lines}{dots}</svg><h2>', 1)


# ---- capture files ----


def subset(records: DataFrame, events: DataFrame) -> DataFrame:
    """Raw records (sources.capture.records) of the packets that events point at, by file and number; events without either point at none."""
    keys = events.where("pcap_file is not null and packet_number is not null").select("pcap_file", "packet_number").distinct()
    return records.where("raw is not null").join(keys, ["pcap_file", "packet_number"], "left_semi")


def capture_bytes(rows: Iterable, linktype: int) -> Iterator[bytes]:
    """A pcap file of rows with ts_us, length and raw."""
    yield pcap.file_head(linktype)
    held = []
    for r in rows:
        held.append(pcap.record(r.ts_us, r.length, bytes(r.raw)))
        if len(held) == CHUNK:
            yield b"".join(held)
            held = []
    yield b"".join(held)


def write_capture(records: DataFrame, path: str, parts: int | None = None) -> int:
    """The records as a folder of pcap files in their order, each written by its task; returns their number, and writes nothing for none.

    A file has one link type: a part has a file for each that its records have. `parts=1` gives one file for each link type.
    """
    spark = records.sparkSession
    place = ["file_idx", "packet_number"]
    rows = records.select(*place, "ts_us", "linktype", "length", "raw")
    rows = (rows.repartitionByRange(parts, *place) if parts else rows.repartitionByRange(*place)).sortWithinPartitions(*place)
    if ranged.reachable(path):
        written = Observation()
        spark.dataSource.register(ranged.CaptureSource)
        rows.observe(written, F.count("*").alias("n")).write.format("capture").mode("overwrite").save(path)
        return written.get["n"]
    n = 0  # a store that only Spark reaches: streamed, a file for each link type
    for r in rows.groupBy("linktype").count().orderBy("linktype").collect():
        mine = rows.where(F.col("linktype") == r.linktype).orderBy(*place).select("ts_us", "length", "raw")
        write_bytes(spark, f"{path}/part-00000-link{r.linktype}.pcap", capture_bytes(mine.toLocalIterator(), r.linktype))
        n += r["count"]
    return n
