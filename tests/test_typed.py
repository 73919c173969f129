"""Typed fields of frames: comparisons by type, rules over them, tables that are shredded."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from otspark.operators import decode, rules, typed
from otspark.operators.arrow_decode import decode_all
from otspark.sources.packets import packets, wire

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    rows = [(1, 7, 1.5, "7", True, None), (2, 2**60 + 1, 0.0, "abc", False, "x"), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, n long, d double, t string, f boolean, `it's` string")
    return df.select("id", F.to_variant_object(decode.as_map({c: F.col(f"`{c}`") for c in df.columns if c != "id"}, "variant")).alias("data"))


def test_comparisons(made):
    hit = lambda c: [r.id for r in made.where(c).orderBy("id").collect()]
    assert hit(typed.equals("n", 7)) == hit(typed.equals("n", 7.0)) == [1]
    assert hit(typed.equals("n", "7")) == [] and hit(typed.equals("t", "7")) == [1] and hit(typed.equals("t", 7)) == []
    assert hit(typed.equals("n", 2**60 + 1)) == [2] and hit(typed.equals("n", 2**60)) == []
    assert hit(typed.equals("f", True)) == hit(typed.equals("f", 1)) == [1] and hit(typed.greater("f", False)) == [1]
    assert hit(typed.equals("n", None)) == [3] and hit(typed.equals("it's", None)) == [1, 3] and hit(typed.equals("it's", "x")) == [2]
    assert hit(typed.greater("n", 6.5)) == [1, 2] and hit(typed.less("d", 1)) == [2] and hit(typed.greater("t", 1)) == [] and hit(typed.greater("t", "9")) == [2]
    assert hit(typed.less("missing", 1)) == []
    with pytest.raises(ValueError):
        typed.path("a'b\"")
    with pytest.raises(TypeError):
        typed.greater("n", None)


def test_rules_by_type(spark):
    frames = decode.decode(packets(spark, SF), ["modbus"], typed=True)
    n = lambda **f: frames.where(rules.matches({"payload_field": f}, True)).count()
    on_text = frames.where("cast(fields['quantity'] as int) > 99").count()
    assert n(name="quantity", greater_than=99) == on_text > 0
    assert n(name="quantity", greater_than="99") == 0 and n(name="unit_id", equals="255") == 0
    assert n(name="unit_id", equals=255) == n(name="unit_id", equals=255.0) == frames.where("fields['unit_id'] = '255'").count() > 0
    assert frames.where(rules.matches({"unit_id": "255"}, True)).count() == 0
    assert n(name="quantity", greater_than=[1]) == n(name="quantity", less_than=None) == n(name="a'b\"", equals=1) == 0
    plain = frames.drop("data")
    told = lambda df: sorted((r.event_id, sorted(r.evidence.items())) for r in rules.events(df).collect())
    assert told(frames) == told(plain) != []


def test_every_field_is_there_in_both_forms(spark):
    frames = decode.decode(wire(spark, SF), typed=True)
    told = frames.select("fields", F.try_variant_get("data", "$", "map<string,string>").alias("typed"))
    assert told.where("size(fields) != size(typed)").isEmpty()
    odd = told.select(F.explode(F.map_keys("fields")).alias("k"), "fields", "typed").where("fields[k] is distinct from typed[k]")
    assert odd.isEmpty()
    kinds = {r.protocol_slug: r.s for r in frames.groupBy("protocol_slug").agg(F.schema_of_variant_agg("data").alias("s")).collect()}
    assert "dl_primary: BOOLEAN" in kinds["dnp3"] and "s7_pdu_reference: BIGINT" in kinds["s7"] and "topic: STRING" in kinds["mqtt"]


def test_tables_are_shredded_and_filtered_in_the_scan(spark, tmp_path):
    frames = decode.decode(wire(spark, SF), typed=True)
    where = f"file://{tmp_path}/frames"
    typed.write_frames(frames, where)
    (one, *_) = glob.glob(f"{tmp_path}/frames/protocol_slug=s7/*.parquet")
    columns = {c.path for c in pq.ParquetFile(one).schema}
    assert "data.typed_value.s7_function_code.typed_value" in columns and "fields" not in " ".join(columns)
    back = typed.read_frames(spark, where)
    key = ["packet_number", "protocol_slug", "function_code"]
    pairs = lambda df: df.select(*key, F.explode("fields"))
    assert pairs(back).exceptAll(pairs(frames)).isEmpty() and pairs(frames).exceptAll(pairs(back)).isEmpty()
    asked = back.where("protocol_slug = 's7'").where(typed.value("s7_function_code", "int") > 200)
    assert asked.count() == frames.where("function_code > 200 and protocol_slug = 's7'").count() > 0
    plan = asked.select("packet_number")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(data.`0`,200)" in plan and "PartitionFilters: [isnotnull(protocol_slug" in plan
    typed.write_frames(frames.limit(0), f"file://{tmp_path}/none")


def test_plug_ins_and_own_maps(spark):
    assert "data" in decode_all(packets(spark, SF), [], ["modbus"], typed=True).columns
    own = spark.range(1).select(F.to_variant_object(decode.as_map(F.create_map(F.lit("a"), F.lit("1")), "variant")).alias("data"))
    assert own.where(typed.equals("a", "1")).count() == 1
    assert spark.range(1).select(F.size(decode.as_map({}))).first()[0] == 0
