"""Rows that are numbered are worked out once, and fields of frames only where a rule can be met."""

from __future__ import annotations

from pyspark.sql import functions as F

from otspark.operators import rules, sketches


def test_numbered_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(0, 1000, 1, 4).mapInPandas(counted, "id long")
    got = sketches.numbered(rows, [F.col("id").desc()]).collect()
    assert sorted((r.place, r.id) for r in got) == [(i + 1, 999 - i) for i in range(1000)]
    assert seen.value == 1000


def test_possible_is_no_narrower_than_a_rule(spark):
    frames = spark.createDataFrame([("modbus", 5, {"unit_id": "255"}), ("modbus", 3, {"unit_id": "255"}), ("modbus", None, {}), ("s7", 41, {}), ("s7", None, {"s7_function_code": "41"}), ("dnp3", 13, {}), (None, 13, {})], "protocol_slug string, function_code int, fields map<string,string>").withColumn("message_type", F.lit("request"))
    conditions = [r.condition for r in rules.RULES] + [{"function_code": {"not_in": [5]}}, {"function_code": {"range": [-1, 4]}}, {"function_code": [5]}, {"protocol": "s7", "unit_id": 1}, {}, {"function_code": {"in": 5}}]
    for c in conditions:
        met, may = (frames.where(w).collect() for w in (rules.matches(c), rules.possible([c])))
        assert all(r in may for r in met), c
    assert frames.where(rules.possible([rules.RULES[3].condition])).count() == 1 and frames.where(rules.possible([])).count() == 0
