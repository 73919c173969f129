"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that ends a word: the six ASCII characters 0x20 and 0x09-0x0D.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows in each batch that goes to Python than Spark's default, where the session leaves the default: rows here are whole texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader (any store that Spark knows)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset (local runs, tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, **options) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage is cut, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Freed memory back to the system: workers wait for their next task with what they hold, and there are more of them than cores."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches whose worker gives memory back at the end of the task."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def lean_group(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function of a group whose worker gives memory back after each."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        out = f(b)
        give_back()
        return out

    return run


def whole(df: DataFrame, name: str = "_doc") -> Column:
    """All columns of a row as one struct: what an operator adds beside it clashes with none of them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def words_of(text: Column, lower: bool = True) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text, A-Z in lower case."""
    if lower:
        text = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of a value's text, modulo a number; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("null")).cast("binary")) % F.lit(modulus)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds each row's number, from 0, in the given order: sorted range partitions, written, and the counts of those before.

    No task sees more than a range of rows. What is read again has the same numbers after a lost task, as they are written.
    """
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    parts = parts.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_at", "_before")


def join_weighed(rows: DataFrame, keys: DataFrame, key: str, weight: str, most: int = 1000) -> DataFrame:
    """Inner join of rows with keys (one row a key, `weight`: its number of rows), without a task that meets a hot key's rows.

    Keys with at least 1/most of all rows are no more than `most`, so these are broadcast; each other key has less than that
    share. Both frames are read twice: give written ones.
    """
    least = max(1.0, (keys.agg(F.sum(weight)).first()[0] or 0) / most)
    hot, cold = keys.where(F.col(weight) >= least), keys.where(F.col(weight) < least)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))
