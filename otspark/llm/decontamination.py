"""Benchmark decontamination with DataFrame operations only.

Windows of a text that are as long as a benchmark item get SimHash fingerprints,
which meet the fingerprints of the items whose shingles they hold through
multi-index Hamming blocks: RADIUS + 1 blocks, of which at least one must be equal
in any two fingerprints within the radius. Candidates within the radius are then verified by
the exact weighted similarity of their shingles (weights: how often each occurs;
sum of minima over sum of maxima).

Windows start where a shingle of five words that the text shares with any item
lines up with it, and up to SLACK words beside that: a window without such a
shingle has similarity zero. What can be missed: of an item of over a hundred words
with words both cut at its ends and put into its middle the best window may lie
further from every shingle, and about one in a thousand windows at similarity 0.8
lies beyond the radius. Texts are read twice, once to find
the shared shingles and once, for texts that have any, to form windows; only keys
and numbers are shuffled. The benchmark's shingles are broadcast while they are at
most BROADCAST_ROWS (8 bytes each and an item number), and joined by a shuffle beyond.

Cases: null and empty texts and items match nothing; items under five words are
one shingle and match only word for word; repeated rows give equal rows; of
windows that tie the first counts; empty tables give empty results; other columns
are ignored (clean() keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otspark.llm.common import text_of, whole, written

SHINGLE = 5
SIMILARITY = 0.8
#: Two sets of shingles at similarity 0.8 differ in about 10 of 64 bits; this is over three standard deviations more.
RADIUS = 19
SLACK = 2
BROADCAST_ROWS = 500_000


def word_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, in lower case."""
    return F.transform(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(hashes: Column, size: Column | int = SHINGLE) -> Column:
    """Hashes of the runs of `size` words."""
    size = F.lit(size) if isinstance(size, int) else size
    return let(hashes, lambda h: F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - size + 1)), lambda i: F.xxhash64(F.slice(h, i, size)))).otherwise(F.array().cast("array<bigint>")))


def simhash(of: Column) -> Column:
    """64-bit fingerprint of an array of hashes: a bit is 1 where more than half have it."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda got, b: got.bitwiseOR(F.when(F.size(F.filter(of, lambda x: F.expr("1").cast("long") == shift(x, b).bitwiseAND(F.lit(1).cast("long")))) * 2 > F.size(of), left(b)).otherwise(F.lit(0).cast("long"))),
    )


def shift(x: Column, b: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, b)


def left(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), b)


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """Array of (block, bits): radius + 1 stretches of the 64 bits."""
    n = radius + 1
    cut = [64 * i // n for i in range(n + 1)]
    part = lambda a, b: F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(i).alias("block"), part(cut[i], cut[i + 1]).alias("bits")) for i in range(n)])


def similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of how often each hash occurs."""
    times = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    common = F.aggregate(F.array_distinct(b), F.lit(0), lambda got, x: got + F.least(times(a, x), times(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def items_of(benchmark: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """item_id, its length in words, shingle size, shingles and fingerprint; items without words are left out."""
    h = benchmark.select(benchmark[id_col].alias("item_id"), word_hashes(text_of(benchmark, text_col)).alias("_h")).where("size(_h) > 0")
    s = h.select("item_id", F.size("_h").alias("length"), F.least(F.size("_h"), F.lit(SHINGLE)).alias("width"), "_h")
    s = s.select("item_id", "length", "width", shingles(F.col("_h"), F.col("width")).alias("item_shingles"))
    return s.withColumn("item_print", simhash(F.col("item_shingles")))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", least: float = SIMILARITY, radius: int = RADIUS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start_word, n_words, similarity (best window), _key."""
    items = written(items_of(benchmark, item_text, item_id).withColumn("_no", F.monotonically_increasing_id()))
    key = F.xxhash64(docs[id_col], text_of(docs, text_col))
    base = docs.select(docs[id_col].alias("doc_id"), key.alias("_key"), word_hashes(text_of(docs, text_col)).alias("_h"))
    sizes = items.groupBy("width").agg(F.count("*").alias("n"), F.sum(F.size("item_shingles")).alias("shingles")).collect()  # at most SHINGLE rows
    small = sum(r.shingles for r in sizes) <= broadcast_rows
    seeds = None
    for width in sorted(r.width for r in sizes):
        at = items.where(F.col("width") == width).select("_no", "length", F.posexplode("item_shingles").alias("_q", "_s"))
        runs = base.select("doc_id", "_key", F.size("_h").alias("_n"), F.posexplode(shingles(F.col("_h"), width)).alias("_p", "_s"))
        found = runs.join(F.broadcast(at) if small else at, "_s").select("doc_id", "_key", "_no", "length", F.lit(width).alias("width"), "_n", (F.col("_p") - F.col("_q")).alias("_at"))
        seeds = found if seeds is None else seeds.unionByName(found)
    if seeds is None:
        return base.select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"), "_key").limit(0)
    offset = F.greatest(F.lit(0), F.least(F.col("_at"), F.col("_n") - F.col("length")))
    spans = seeds.select("doc_id", "_key", "_no", "length", "width", "_n", offset.alias("_at")).distinct()
    slack = F.explode(F.sequence(F.lit(-SLACK), F.lit(SLACK))).alias("_d")
    near = spans.select("*", slack).withColumn("_at", F.greatest(F.lit(0), F.least(F.col("_at") + F.col("_d"), F.col("_n") - F.col("length"))))
    pairs = written(near.select("doc_id", "_key", "_no", "length", "width", "_at").distinct())
    places = pairs.select("doc_id", "_key", "length", "width", "_at").distinct()
    starts = written(places.groupBy("doc_id", "_key").agg(F.collect_list(F.struct("length", "width", F.col("_at").alias("at"))).alias("_w")))
    wanted = starts if starts.count() > broadcast_rows // 10 else F.broadcast(starts)
    # one row of each (id, text): copies of a row have equal windows
    texts = base.withColumnRenamed("doc_id", "_id").join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (base["_key"] == starts["_key"])).select(starts["_key"].alias("_key"), "_h", "_w")
    windows = texts.select("_key", "_h", F.explode("_w").alias("_w")).select(
        "_key", F.col("_w.length").alias("length"), F.col("_w.at").alias("_at"), shingles(F.slice("_h", F.col("_w.at") + 1, F.col("_w.length")), F.col("_w.width")).alias("_s")
    )
    windows = written(windows.where("size(_s) > 0").dropDuplicates(["_key", "length", "_at"]).withColumn("_f", simhash(F.col("_s"))))
    # blocks meet within the seeded pairs of window and item alone: a window has as many candidates as items whose shingles it holds
    place = ["_key", "length", "_at"]
    seeded = pairs.join(windows.select(*place, "_f"), place)
    probes = seeded.select("doc_id", *place, "_no", "_f", F.inline(blocks(F.col("_f"), radius)))
    known = items.select("_no", "item_print", F.inline(blocks(F.col("item_print"), radius)))
    if sum(r.n for r in sizes) * (radius + 1) <= broadcast_rows:
        known = F.broadcast(known)
    met = probes.join(known, ["_no", "block", "bits"]).where(F.bit_count(F.col("_f").bitwiseXOR(F.col("item_print"))) <= radius).select("doc_id", *place, "_no").distinct()
    shown = items.select("_no", "item_id", "item_shingles")
    full = met.join(windows.select(*place, "_s"), place).join(F.broadcast(shown) if small else shown, "_no")
    scored = full.withColumn("similarity", similarity(F.col("_s"), F.col("item_shingles"))).where(F.col("similarity") >= least)
    best = scored.groupBy("doc_id", "_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("_at")).alias("_at"), "length")).alias("_b"))
    return best.select("doc_id", "item_id", (-F.col("_b._at")).alias("start_word"), F.col("_b.length").alias("n_words"), F.col("_b.similarity").alias("similarity"), "_key")


def found_items(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """contaminated() without the inner key; repeated rows of one id and text give one row."""
    return contaminated(docs, benchmark, **options).drop("_key")


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents in which no item was found, all columns as they are."""
    bad = written(contaminated(docs, benchmark, text_col=text_col, id_col=id_col, **options).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_bad")).distinct())
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    rows = docs.select(whole(docs), docs[id_col].alias("_of"), F.xxhash64(docs[id_col], text_of(docs, text_col)).alias("_key"))
    return rows.join(bad, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_bad")), "left_anti").select("_doc.*")
