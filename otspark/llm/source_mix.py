"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources get targets by their weights, no more than a set multiple of their size.
Each source is cut into shards by a seeded hash of its documents; a shard's words
form one stream of equal blocks. The blocks of the mix go to sources, and then
to the shards of a source, by highest quotients (votes over 1, 3, 5, ...), found
as the divisor at which the rounded quotients add up. Within a shard a seeded
permutation says which blocks are taken once more than the others, so a document's
share follows from its place in the stream alone.

Everything is DataFrame operations. Sources are ranked by a range partitioning
with counts per partition, and divisors by a bisection of which each step is one
sum over the (written) table of shards, so that neither sources nor shards meet
in one task or on the driver.

Cases: null and empty texts have size 0 and nothing is taken of them; the null
source is one source, ranked last; rows that are alike have the same hash and
stand next to each other; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otspark.llm.common import text_of, whole, written

#: Words of a block.
BLOCK = 16
#: Words that a shard shall hold, about.
SHARD_WORDS = 100_000


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ of a text."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds _rank, from 0, by code point of _source and null last; no single task sees all sources."""
    order = [F.col("_source").isNull(), F.col("_source")]
    parts = written(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    parts = parts.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("_rank", F.col("_before") + F.col("_in")).drop("_part", "_in", "_at", "_before")


def with_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds _target: weight times one level, stopped at `most` times the source's size, adding up to `share` of all."""
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % n + 1).cast("int"))
    sources = written(ranked(sources).withColumn("_weight", weight))
    cap = F.col("_size") * float(most)
    level, stopped = 0.0, -1
    whole = share * float(sources.agg(F.sum("_size")).first()[0] or 0)
    while True:  # each turn one sum over the sources; a source that has stopped stays so
        held = cap <= F.lit(level) * F.col("_weight")
        x = sources.agg(F.sum(F.when(held, cap)).alias("held"), F.count(F.when(held, 1)).alias("n"), F.sum(F.when(~held, F.col("_weight"))).alias("weight")).first()
        if x.n == stopped or not x.weight:
            break
        stopped = x.n
        level = max(level, (whole - (x.held or 0.0)) / x.weight)
    return sources.withColumn("_target", F.least(cap, F.lit(level) * F.col("_weight")) if stopped >= 0 else cap)


def divisor(parties: DataFrame, votes: str, seats: int) -> float:
    """The Sainte-Lague divisor: at it the rounded quotients votes/d of all parties add up to the seats.

    A party has as many seats as it has quotients votes/(2i+1) above half the divisor. Each pass tries 64 divisors at
    once, as sums that the tasks form first; seven passes reach the last digits of a double.
    """
    if seats <= 0:
        return 1.0
    low, high = 1e-9, 2.0 * float(parties.agg(F.max(votes)).first()[0] or 0.0) + 1.0
    for _ in range(7):
        tries = [low * (high / low) ** (i / 63) for i in range(64)]
        sums = parties.agg(*[F.sum(F.floor(F.col(votes) / F.lit(d) + F.lit(0.5))).alias(f"_s{i}") for i, d in enumerate(tries)]).first()
        at = max([i for i in range(64) if (sums[i] or 0) >= seats], default=0)
        low, high = tries[at], tries[min(at + 1, 63)]
        if sums[at] == seats or low == high:
            break
    return low


def mixed(
    docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = 11, row_col: str | None = None
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words, repeats counted); row_col is kept beside."""
    kept = [row_col] if row_col else []
    rows = written(docs.select(*kept, docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("_source"), word_count(text_of(docs, text_col)).alias("size"), F.xxhash64(docs[id_col], text_of(docs, text_col), F.lit(seed)).alias("_hash")))
    sources = rows.groupBy("_source").agg(F.sum("size").alias("_size"))
    sources = written(with_targets(sources, weights, share, most).withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("_size") / F.lit(shard_words)))))
    # the hash is of id and text: rows of one id (or none) do not pile up in a shard
    plan = sources.select(F.col("_source").alias("_of"), F.col("_size").alias("source_size"), F.col("_target").alias("target"), "_shards")
    placed = rows.join(plan, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("_shard", F.pmod(F.col("_hash"), F.col("_shards")))
    sized = placed.where("size > 0").groupBy("_source", "_shard", "target", "source_size").agg(F.sum("size").alias("_words"))
    unlike = F.lit(1.0) + F.lit(2.0**-40) * F.pmod(F.xxhash64("_source", "_shard", F.lit(seed)), F.lit(4096))  # breaks ties by the seed
    shards = written(sized.withColumn("_votes", F.col("target") * F.col("_words") / F.col("source_size") * unlike))
    total = float(shards.agg(F.sum("_votes")).first()[0] or 0.0)
    d = divisor(shards, "_votes", round(total / block))
    blocks = F.ceil(F.col("_words") / F.lit(block))
    quota = F.least(F.floor(F.col("_votes") / F.lit(d) + F.lit(0.5)), F.lit(int(most)) * blocks)
    # primes under 2**31, each without a common factor with any number of blocks: fixed values
    primes = F.array(*[F.lit(p) for p in (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)])
    key = F.xxhash64("_source", "_shard", F.lit(seed + 1))
    quotas = shards.select(F.col("_source").alias("_of"), F.col("_shard").alias("_shard2"), blocks.alias("_blocks"), quota.alias("_quota"), F.element_at(primes, (F.pmod(key, F.lit(8)) + 1).cast("int")).cast("long").alias("_prime"), F.pmod(key, blocks).alias("_shift"))
    stream = Window.partitionBy("_source", "_shard").orderBy("_hash", "doc_id", "size", *kept)
    at = placed.withColumn("_from", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    at = at.join(quotas, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_shard") == F.col("_shard2")), "left")
    b, end = F.lit(block), F.col("_from") + F.col("size")
    times = lambda j: F.floor(F.col("_quota") / F.col("_blocks")) + F.when(F.pmod(j * F.col("_prime") + F.col("_shift"), F.col("_blocks")) < F.pmod(F.col("_quota"), F.col("_blocks")), 1).otherwise(0)
    part = lambda j: (F.least(end, (j + 1) * b) - F.greatest(F.col("_from"), j * b)) * times(j)
    run = F.sequence(F.floor(F.col("_from") / b), F.floor((end - 1) / b))
    taken = F.when((F.col("size") > 0) & F.col("_quota").isNotNull(), F.aggregate(run, F.lit(0).cast("long"), lambda got, j: got + part(j))).otherwise(F.lit(0).cast("long"))
    return at.select(*kept, "doc_id", "size", "source_size", "target", taken.alias("taken"))


def selected(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of which the mix takes any words: all columns as they are, and size, source_size, target, taken.

    The rows are written with a number each, by which they meet their share again: rows that are alike are told apart, and
    reruns of a lost task read the same numbers. An added column whose name the caller has itself gets mix_ before it.
    """
    source = options.pop("source_col", "source")
    keyed = written(docs.select(whole(docs), F.monotonically_increasing_id().alias("_n"), docs[id_col].alias("_id"), docs[source].alias("_source"), docs[text_col].alias("_text")))
    # the number decides between rows alike in id and text alone: a row's place in the stream goes by a hash of id and text
    share = mixed(keyed, text_col="_text", id_col="_id", source_col="_source", row_col="_n", **options).where("taken > 0")
    rows = keyed.select("_doc", "_n").join(share, "_n")
    added = {c: c for c in ("size", "source_size", "target", "taken")}
    while set(added.values()) & set(docs.columns):
        added = {c: "mix_" + name if name in docs.columns else name for c, name in added.items()}
    return rows.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns], *[F.col(c).alias(name) for c, name in added.items()])
