"""Typed fields of frames: conditions and values over the VARIANT column `data`, and tables of such frames.

A value is what its decoder made: numbers compare as numbers (a flag counts as 0 or 1), texts as texts, and never one with
the other. A field that a frame lacks, or that has another type, compares to nothing; `equals` with None asks for a missing field.

Tables are Parquet, a folder for each protocol: Spark shreds a VARIANT by the fields that a file's rows have in common, so the frames
of one protocol become typed columns, and a comparison reaches the scan as a filter on one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from otspark.operators.decode import DATA

NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def path(name: str) -> str:
    """The path of a field in a VARIANT; a name with both kinds of quotes is none."""
    if "'" not in name:
        return f"$['{name}']"
    if '"' in name:
        raise ValueError(f"a field can't be named {name!r}")
    return f'$["{name}"]'


def value(name: str, of: str, data: str = DATA) -> Column:
    """A field cast to a type; null where it is missing or can't be cast."""
    return F.try_variant_get(F.col(data), path(name), of)


def kind(name: str, data: str = DATA) -> Column:
    """The type of a field as Spark names it; null where it is missing."""
    return F.schema_of_variant(value(name, "variant", data))


def number(name: str, of: str = "double", data: str = DATA) -> Column:
    """A field that is a number or a flag; null for texts and missing fields."""
    told = kind(name, data)
    return F.when(told.rlike(NUMBERS), value(name, of, data)).when(told == "BOOLEAN", value(name, "boolean", data).cast(of))


def text(name: str, data: str = DATA) -> Column:
    """A field that is a text; null for others."""
    return F.when(kind(name, data) == "STRING", value(name, "string", data))


def _same_kind(name: str, wanted, data: str) -> tuple[Column, Column]:
    """The field and the value to compare it with, both numbers or both texts."""
    if isinstance(wanted, str):
        return text(name, data), F.lit(wanted)
    if isinstance(wanted, bool | int | float):
        whole = isinstance(wanted, int) and abs(wanted) >= 2**53  # beyond what doubles tell apart
        return number(name, "decimal(38,0)" if whole else "double", data), F.lit(str(int(wanted))).cast("decimal(38,0)") if whole else F.lit(float(wanted))
    raise TypeError(f"no value to compare with: {wanted!r}")


def equals(name: str, wanted, data: str = DATA) -> Column:
    if wanted is None:
        return value(name, "variant", data).isNull()
    mine, other = _same_kind(name, wanted, data)
    return F.coalesce(mine == other, F.lit(False))


def greater(name: str, wanted, data: str = DATA) -> Column:
    mine, other = _same_kind(name, wanted, data)
    return F.coalesce(mine > other, F.lit(False))


def less(name: str, wanted, data: str = DATA) -> Column:
    mine, other = _same_kind(name, wanted, data)
    return F.coalesce(mine < other, F.lit(False))


#: The clauses of a rule's payload_field.
TESTS = {"equals": equals, "greater_than": greater, "less_than": less}


def write_frames(frames: DataFrame, where: str) -> None:
    """Typed frames as a table with a folder for each protocol; the map of text is left out, as `data` has all of it.

    Rows are rebalanced by protocol: a protocol with most of the rows goes to many files, rare ones to one each.
    """
    frames.drop("fields").hint("rebalance", "protocol_slug").write.mode("overwrite").partitionBy("protocol_slug").parquet(where)


def read_frames(spark: SparkSession, where: str) -> DataFrame:
    """Frames written before, with the map of text worked out from the typed fields where it is asked for."""
    out = spark.read.parquet(where)
    return out.withColumn("fields", F.try_variant_get(DATA, "$", "map<string,string>"))
