"""Running totals and exact ranks without a task that sees all rows; sketches that are stored for each capture and merged later.

running() deals rows by ranges of their order, remembers (behind a checkpoint) where each went, and adds the totals of the
ranges before to the running total within a range. ranks() finds values at positions of the sorted values from that, all at once
and without the driver. Sketches (HyperLogLog for distinct addresses and pairs, KLL for lengths and gaps) are columns of a row for
each capture: as small as their parameters say, whatever the capture's size, and their union is the sketch of all captures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otspark.operators.flows import with_gaps
from otspark.operators.graph import cut

#: Size of the HyperLogLog sketches (2**12 registers: 1.6 % standard error), and of the KLL sketches (rank error under 1.4 %).
REGISTERS, ITEMS = 12, 200


def running(df: DataFrame, order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """Adds the total of `weight` up to each row, itself included; the order is to be total.

    The rows are cut first: ranges are found by a pass over them, which would work all of them out a second time.
    """
    dealt = cut(cut(df.withColumn("_weight", weight)).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum("_weight").alias("_sum"))  # a row for each range
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("_weight").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + own).drop("_range", "_weight", "_before")


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Rows with their number, from 1."""
    return running(df, order, F.lit(1).cast("long"), name)


def ranks(values: DataFrame, column: str, percents: Sequence[float]) -> DataFrame:
    """percent, value: the value at position int(n * percent / 100) of the sorted values, the last at most; no row for no values."""
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("_n"))
    told = running(counted, [F.col("value")], F.col("_n"), "_upto")
    wanted = values.sparkSession.createDataFrame([(float(p),) for p in percents], "percent double")
    total = values.agg(F.count(column).alias("_all"))  # one row
    at = wanted.join(F.broadcast(total), how="inner").withColumn("_at", F.least(F.floor(F.col("_all") * F.col("percent") / 100), F.col("_all") - 1))
    return told.join(F.broadcast(at), (F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at"))).select("percent", F.col("value").cast("double").alias("value"))


def of_captures(packets: DataFrame) -> DataFrame:
    """A row for each file: packets, and sketches of its sources, destinations, unordered pairs, lengths and inter-packet times."""
    pair = F.concat_ws("|", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip"))
    hll = lambda c: F.hll_sketch_agg(c, REGISTERS)
    seen = packets.groupBy("file_idx").agg(F.count("*").alias("packets"), hll("src_ip").alias("sources"), hll("dst_ip").alias("destinations"), hll(pair).alias("pairs"), F.kll_sketch_agg_bigint(F.col("length").cast("long"), ITEMS).alias("lengths"))
    gaps = with_gaps(packets).where("ipt_us is not null").groupBy("file_idx").agg(F.kll_sketch_agg_bigint("ipt_us", ITEMS).alias("gaps"))
    return seen.join(gaps, "file_idx", "left")


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of all rows, or of those with the same `by`: of captures of several runs, for instance."""
    hll = [F.hll_union_agg(c).alias(c) for c in ("sources", "destinations", "pairs")]
    kll = [F.kll_merge_agg_bigint(c, ITEMS).alias(c) for c in ("lengths", "gaps")]
    return sketches.groupBy(*by).agg(F.sum("packets").alias("packets"), *hll, *kll)


def estimates(sketches: DataFrame, *by: str, percents: Sequence[float] = (10, 50, 90)) -> DataFrame:
    """What sketches tell: distinct sources, destinations and pairs, and lengths and gaps at the percents (null without any)."""
    told = [F.hll_sketch_estimate(c).alias(c) for c in ("sources", "destinations", "pairs")]
    at = lambda c, p: F.when(F.col(c).isNotNull() & (F.kll_sketch_get_n_bigint(c) > 0), F.kll_sketch_get_quantile_bigint(c, F.lit(p / 100.0)))
    return sketches.select(*by, "packets", *told, *[at(c, p).alias(f"{c[:-1]}_p{p:g}") for c in ("lengths", "gaps") for p in percents])
