"""A plug-in that walks over the units of a segment, against the decoder of Column expressions and by hand."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from otspark.operators import decode, rules
from otspark.operators.arrow_decode import Plugin, decode_all, decode_with
from otspark.sources.packets import packets


def modbus_units(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Every unit of a segment, one after the other."""
    row, code, unit = [], [], []
    for i, p in enumerate(batch.column("payload").to_pylist()):
        at = 0
        while at + 8 <= len(p) and p[at + 2 : at + 4] == b"\0\0":
            row.append(i)
            code.append(p[at + 7] & 0x7F)
            unit.append([("unit_id", str(p[at + 6]))])
            at += 6 + int.from_bytes(p[at + 4 : at + 6], "big")
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(code, pa.int32()), pa.array(unit, pa.map_(pa.string(), pa.string()))], names=["row", "function_code", "fields"])


LOOP = Plugin("loop", "Modbus units", modbus_units, ports=(502,), writes=(5, 6, 15, 16), diagnostics=(8, 43), names=((3, "read"),))


def test_as_the_decoder_of_columns(spark):
    rows = packets(spark, "/root/testdata/sf0.01").where("dst_port = 502")
    key = ["packet_number", "function_code", "is_write_operation"]
    mine = decode_with(rows, LOOP).select(*key, F.col("fields")["unit_id"].alias("unit"), "src_ip").orderBy("packet_number").collect()
    theirs = decode.decode(rows, ["modbus"]).select(*key, F.col("fields")["unit_id"].alias("unit"), "src_ip").orderBy("packet_number").collect()
    assert mine == theirs and len(mine) > 1000


def test_several_frames_none_and_mistakes(spark):
    one = bytes.fromhex("000100000006ff0600010001")
    rows = [(0, 1, one * 3, 502, 40000), (0, 2, b"\1\2\3", 502, 40000), (0, 3, None, 502, 40000), (0, 4, one, 40000, 80), (0, 5, one[:7] + b"\3" + one[8:], None, 502)]
    df = spark.createDataFrame(rows, "file_idx int, packet_number long, payload binary, src_port int, dst_port int").withColumn("transport", F.lit("TCP")).withColumn("ts_us", F.lit(0).cast("long")).withColumn("src_ip", F.lit("a")).withColumn("dst_ip", F.lit("b"))
    got = decode_with(df, LOOP)
    assert [(r.packet_number, r.function_code, r.function_name, r.is_write_operation, r.is_request, r.protocol) for r in got.orderBy("packet_number").collect()] == [(1, 6, None, True, False, "Modbus units")] * 3 + [(5, 3, "read", False, False, "Modbus units")]
    assert got.where("risk_note is not null").count() == 3
    every = decode_all(df, [LOOP], ["modbus"])
    assert every.columns == decode.decode(df, ["modbus"]).columns and {r.parser_idx for r in every.collect()} == {0, len(decode.DECODERS)}
    wanted = rules.load("rules:\n  - {id: L, name: n, severity: HIGH, category: x, description: unit writes, tags: [a, b], evidence_fields: [unit_id], condition: {protocol: loop, function_code: 6}}\n").rules
    event = rules.events(every, wanted).first()
    assert event.description == "unit writes — a → b (Modbus units, FC=0x06)" and event.tags == ["a", "b"] and event.affected_assets == ["a", "b"]
    assert event.evidence == {"src_ip": "a", "dst_ip": "b", "protocol": "Modbus units", "function_code": "0x06", "function_name": "", "unit_id": "255"}
    none = Plugin("none", "None", lambda b: pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["row"]))
    assert decode_with(df, none).count() == 0
    wrong = Plugin("wrong", "Wrong", lambda b: pa.RecordBatch.from_arrays([pa.array([99], pa.int64())], names=["row"]))
    with pytest.raises(Exception, match="not in the batch"):
        decode_with(df, wrong).count()
