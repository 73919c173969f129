"""Decoders that need loops, as plug-ins over Arrow batches: beside those that are Column expressions (operators.decode).

A plug-in gets the payloads and ports of a batch of packets and gives frames: a record batch (or table) with `row`, the place
of the packet in the batch, and any of the columns of a frame; a packet may have several frames or none. Packets go to a
plug-in by its ports, only their payload, ports and transport travel to Python, and frames come back to the other columns of
their packet by place: the packet's columns travel along in the same batch, nothing is joined.

Cases: packets without a payload are not shown; columns that a plug-in leaves out are null (flags: false; those that follow from the
code come from its lists); a frame whose `row` is none of the batch is an error of the plug-in, and raised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from otspark.functions import codes
from otspark.functions.net import either_port
from otspark.operators.decode import COLUMNS, DATA, DECODERS, as_map, decode, member

#: What a plug-in may give of a frame.
GIVEN = "function_code int, function_name string, message_type string, is_request boolean, is_exception boolean, is_write_operation boolean, is_diagnostic boolean, is_control_command boolean, risk_note string, fields map<string,string>"
FLAGS = ("is_request", "is_exception", "is_write_operation", "is_diagnostic", "is_control_command")
ARROW = {"function_code": pa.int32(), "function_name": pa.string(), "message_type": pa.string(), **dict.fromkeys(FLAGS, pa.bool_()), "risk_note": pa.string(), "fields": pa.map_(pa.string(), pa.string())}


@dataclass(frozen=True)
class Plugin:
    """frames: from a record batch with payload, src_port, dst_port, transport to frames; ports: none takes all packets."""

    slug: str
    name: str
    frames: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table]
    ports: tuple[int, ...] = ()
    writes: tuple[int, ...] = ()
    diagnostics: tuple[int, ...] = ()
    controls: tuple[int, ...] = ()
    names: tuple[tuple[int, str], ...] = ()


def decode_with(packets: DataFrame, plugin: Plugin) -> DataFrame:
    """Frames of one plug-in, with the columns of decode(); parser_idx is after those of the decoders of columns."""
    seen = ["payload", "src_port", "dst_port", "transport"]
    shown = packets.where(F.coalesce(F.length("payload"), F.lit(0)) > 0)
    if plugin.ports:
        shown = shown.where(F.coalesce(either_port(F.col("src_port"), F.col("dst_port"), list(plugin.ports)), F.lit(False)))
    schema = StructType([*shown.schema.fields, *[f for f in StructType.fromDDL(GIVEN).fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = plugin.frames(batch.select(seen))
            got = (pa.Table.from_batches([got]) if isinstance(got, pa.RecordBatch) else got).combine_chunks()
            row = np.asarray(got["row"].cast(pa.int64()))
            if len(row) and (row.min() < 0 or row.max() >= batch.num_rows):
                raise IndexError(f"{plugin.slug}: a frame of a packet that is not in the batch")
            own = batch.take(pa.array(row))
            given = [got[c].cast(t).combine_chunks() if c in got.column_names else pa.nulls(len(row), t) for c, t in ARROW.items()]
            given = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else pa.nulls(0, t) if isinstance(c, pa.ChunkedArray) else c for c, t in zip(given, ARROW.values())]
            yield pa.RecordBatch.from_arrays([*own.columns, *given], names=schema.names)

    found = shown.mapInArrow(run, schema)
    code = F.col("function_code")
    by_code = {"is_write_operation": plugin.writes, "is_diagnostic": plugin.diagnostics, "is_control_command": plugin.controls}
    told = found.withColumns({c: F.coalesce(c, member(code, by_code.get(c, ())) if by_code.get(c) else F.lit(False), F.lit(False)) for c in FLAGS})
    if plugin.names:
        told = told.withColumn("function_name", F.coalesce("function_name", F.try_element_at(F.create_map(*[F.lit(x) for kv in plugin.names for x in kv]), code)))
    note = F.when(F.col("is_control_command"), codes.NOTE_CONTROL).when(F.col("is_write_operation"), codes.NOTE_WRITE).when(F.col("is_diagnostic"), codes.NOTE_DIAGNOSTIC)
    told = told.withColumn("risk_note", F.coalesce("risk_note", note)).withColumn("protocol", F.lit(plugin.name)).withColumn("protocol_slug", F.lit(plugin.slug)).withColumn("parser_idx", F.lit(len(DECODERS)))
    return told.select(*packets.columns, "parser_idx", *COLUMNS)


def decode_all(packets: DataFrame, plugins: list[Plugin], protocols: list[str] | None = None, *, typed: bool = False) -> DataFrame:
    """Frames of the decoders of columns and of plug-ins, which are numbered after them in their order; typed fields of plug-ins are texts."""
    out = decode(packets, protocols, typed=typed)
    for i, p in enumerate(plugins):
        own = decode_with(packets, p).withColumn("parser_idx", F.lit(len(DECODERS) + i))
        out = out.unionByName(own.withColumn(DATA, F.to_variant_object(as_map(F.col("fields"), "variant"))) if typed else own)
    return out
