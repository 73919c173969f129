"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root's. Turn by turn a class splits into
those of its members whose next turn is the same; a class of one conversation
retires, and the rest of that conversation becomes a chain of nodes without
branches, written down from its length alone. What the nodes gather below them is
folded back from the deepest turns to the root.

A job refines several turns at once (4, then 8, 16, 32, then 64 each), so that
the jobs grow with the logarithm of the shared depth and only conversations that
still share their prefix are read again. A class is known by a chain of SHA-256
over its turns, which each conversation works out for itself: no join brings the
members of a class together, and all that is gathered for a class is a count, a
least and a largest value, which tasks form before the shuffle. The fold runs
along each conversation: a node's own figures stand with its smallest member, are
summed from the end of that conversation to its start, and then over the members
of a class. Texts are read once, for their digests and words; they never move.

Hot keys: a conversation with a large share of all turns is cut by range
partitions (its turns get their places by counts) and held in pieces of at most 64
turns; a node with a large share of all children is broadcast to them (at most a
thousand nodes are that large). The ids of conversations that end at one node are
joined to text in pieces of neighbouring ids, and hashed piece by piece.

Cases: rows without conversation id take no part; a null turn stands first; turns
that tie stand in the order of their digests; rows that are alike are turns like
any other; null role and text are empty; conversations without a turn (after
rebuilding) are members of the root; an empty table gives no node; other columns
are ignored. c - c % n follows the sign of c, as in SQL.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from otspark.llm.common import join_weighed, numbered, shared_folder, text_of, written
from otspark.llm.source_mix import word_count

#: Last depth of the first jobs, and the number of turns of each later one.
FIRST, WIDTH = (4, 12, 28, 60), 64
#: Neighbouring ids in one piece of text to be hashed; turns in one piece of a chain.
IDS, CHAIN = 4096, 4096


def block_of(depth: Column) -> Column:
    """The job that refines a depth (from 1)."""
    later = F.lit(len(FIRST)) + F.floor((depth - FIRST[-1] - 1) / F.lit(WIDTH))
    out = F.when(depth <= FIRST[0], 0)
    for i, last in enumerate(FIRST[1:], 1):
        out = out.when(depth <= last, i)
    return out.otherwise(later).cast("long")


def last_of(block: int) -> int:
    """The last depth of a job."""
    return FIRST[block] if block < len(FIRST) else FIRST[-1] + WIDTH * (block - len(FIRST) + 1)


def placed_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(turns: _c, _n (number over all turns), _d (digest), _w (words); conversations: _c, _first (its first number), _own (its turns))."""
    role, text = text_of(conversations, role_col), text_of(conversations, text_col)
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(conversations[conv_col].cast("long").alias("_c"), conversations[turn_col].alias("_t"), digest.alias("_d"), word_count(text).alias("_w"))
    rows = numbered(rows.where("_c IS NOT NULL"), [F.col("_c"), F.col("_t").asc_nulls_first(), F.col("_d")], "_n").drop("_t")
    return rows, written(rows.groupBy("_c").agg(F.min("_n").alias("_first"), F.count("*").alias("_own")))


def rebuilt(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of the first of their group of ids (h = crc32 of the id, modulo heads), then go on with their own after the first h.

    Gives (pieces: _c, _b, _turns, an array of (depth, digest, words); conversations: _c, _len). heads=1 leaves all as they are.
    """
    rows, convs = placed_turns(conversations, conv_col, turn_col, role_col, text_col)
    base = convs.where(F.col("_c") % group == 0).select(F.col("_c").alias("_base"), F.col("_own").alias("_base_own"))  # at most 2 * group - 1 meet one
    convs = convs.withColumn("_base", F.col("_c") - F.col("_c") % group).join(base, "_base", "left")
    h = F.crc32(F.col("_c").cast("string").cast("binary")) % heads
    convs = convs.withColumn("_h", h).withColumn("_use", F.least("_h", F.coalesce("_base_own", F.lit(0))))
    convs = written(convs.withColumn("_len", F.col("_use") + F.greatest(F.lit(0), F.col("_own") - F.col("_h"))))
    at = join_weighed(rows, convs.select("_c", "_own", "_first", "_h", "_use"), "_c", "_own").withColumn("_at", F.col("_n") - F.col("_first"))
    own = at.where("_at >= _h").select("_c", (F.col("_at") - F.col("_h") + F.col("_use") + 1).alias("depth"), "_d", "_w")
    first = at.where((F.col("_c") % group == 0) & (F.col("_at") < heads - 1)).select(F.col("_c").alias("_base"), "_at", "_d", "_w")  # heads - 1 turns of each base
    first = first.join(convs.select("_c", "_base", "_use"), "_base").where("_at < _use").select("_c", (F.col("_at") + 1).alias("depth"), "_d", "_w")
    turns = own.unionByName(first).withColumn("_b", block_of(F.col("depth")))
    pieces = turns.groupBy("_c", "_b").agg(F.array_sort(F.collect_list(F.struct("depth", "_d", "_w"))).alias("_turns"))  # 64 at most
    return written(pieces), convs.select("_c", "_len")


def along(pieces: DataFrame, active: DataFrame, block: int) -> DataFrame:
    """_c, _len, depth, _key (of the class at this depth), _up (at the depth before), _w for the turns of one job; the root comes with the first."""
    turns = pieces.where(F.col("_b") == block).select("_c", "_turns")
    rows = active.join(turns, "_c", "left" if block == 0 else "inner").withColumn("_turns", F.coalesce("_turns", F.array()))
    step = lambda keys, t: F.concat(keys, F.array(F.unhex(F.sha2(F.concat(F.element_at(keys, -1), t["_d"]), 256))))
    rows = rows.withColumn("_keys", F.aggregate("_turns", F.array("_key"), step))
    steps = F.transform("_turns", lambda t, i: F.struct(t["depth"].alias("depth"), F.get("_keys", i + 1).alias("_key"), F.get("_keys", i).alias("_up"), t["_w"].alias("_w")))
    if block == 0:
        root = F.struct(F.lit(0).cast("long").alias("depth"), F.col("_key"), F.lit(None).cast("binary").alias("_up"), F.lit(0).cast("long").alias("_w"))
        steps = F.concat(F.array(root), steps)
    return rows.select("_c", "_len", F.explode(steps).alias("_s")).select("_c", "_len", "_s.*")


def hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, joined by commas; rows come in the order of key and piece."""
    key, state = None, None
    for batch in batches:
        keys, texts, done = batch.column("_key").to_pylist(), batch.column("_text").to_pylist(), []
        for k, t in zip(keys, texts):
            if k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(t.encode())
            else:
                state.update(b"," + t.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["_key", "_ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["_key", "_ends"])


def ends_of(rows: DataFrame) -> DataFrame:
    """_key and _ends, the hash of the ids of all conversations (_c) that end at it."""
    parts = rows.groupBy("_key", F.floor(F.col("_c") / F.lit(IDS)).alias("_piece")).agg(F.array_sort(F.collect_list("_c")).alias("_ids"))  # IDS at most
    parts = parts.select("_key", "_piece", F.array_join(F.transform("_ids", lambda c: c.cast("string")), ",").alias("_text"))
    return parts.repartition("_key").sortWithinPartitions("_key", "_piece").select("_key", "_text").mapInArrow(hashed_ids, "_key binary, _ends string")


def trie_nodes(conversations: DataFrame, **options) -> DataFrame:
    """One row for each distinct sequence of the first turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node's last turn is turn number `depth` of the rebuilt conversation conv_id. Options are those of rebuilt().
    """
    spark = conversations.sparkSession
    pieces, convs = rebuilt(conversations, **options)
    home = f"{shared_folder(spark)}/llm-trie-{uuid.uuid4().hex}"

    def kept(df: DataFrame, what: str, block: int) -> DataFrame:
        df.write.parquet(path := f"{home}/{what}/_b={block}")
        return spark.read.schema(df.schema).parquet(path)

    # down: split the classes, retire those of one conversation
    active = convs.withColumn("_key", F.unhex(F.sha2(F.lit("root"), 256)))
    block, jobs = 0, []
    while True:
        rows = kept(along(pieces, active, block), "rows", block)
        gathered = (F.min("_c").alias("_node"), F.count("*").alias("_members"), F.max("_w").alias("_w"), F.max("_up").alias("_up"), F.max("_len").alias("_longest"))
        classes = kept(rows.groupBy("_key", "depth").agg(*gathered), "classes", block)
        alone = kept(classes.where("_members = 1").groupBy(F.col("_node").alias("_c")).agg(F.min("depth").alias("_alone"), F.max("_longest").alias("_len")), "alone", block)
        jobs.append((rows, classes, alone))
        active = kept(rows.where((F.col("depth") == last_of(block)) & (F.col("_len") > last_of(block))).select("_c", "_len", "_key").join(alone, "_c", "left_anti"), "active", block)
        if active.isEmpty():
            break
        block += 1
    # up: sums from the end of each conversation to its start, then over the members of a class
    carried = None
    for block in range(len(jobs) - 1, -1, -1):
        rows, classes, alone = jobs[block]
        own = classes.select(F.col("_node").alias("_c"), "depth", "_members", "_longest", (F.col("_w") * (F.col("_members") - 1)).alias("_own"))
        at = rows.select("_c", "depth", "_key").join(own, ["_c", "depth"], "left").join(alone.select("_c", "_alone"), "_c", "left")
        leaf = F.when(F.col("_members") == 1, F.col("depth") == F.col("_alone")).otherwise(F.col("_longest") == F.col("depth"))
        at = at.select("_c", "depth", "_key", F.coalesce(leaf.cast("long"), F.lit(0)).alias("_leaf"), F.coalesce("_own", F.lit(0)).alias("_own"))
        if carried is not None:
            below = carried.select("_c", F.lit(last_of(block)).cast("long").alias("depth"), F.col("_leaf").alias("_leaf2"), F.col("_own").alias("_own2"))
            at = at.join(below, ["_c", "depth"], "left").select("_c", "depth", "_key", (F.col("_leaf") + F.coalesce("_leaf2", F.lit(0))).alias("_leaf"), (F.col("_own") + F.coalesce("_own2", F.lit(0))).alias("_own"))
        up = Window.partitionBy("_c").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)  # 64 turns at most
        summed = at.select("_c", "depth", "_key", F.sum("_leaf").over(up).alias("_leaf"), F.sum("_own").over(up).alias("_own"))
        summed = kept(summed, "summed", block)
        carried = summed.where(F.col("depth") == last_of(block - 1) + 1) if block else None

    every = lambda what, of: spark.read.schema(of.schema).parquet(f"{home}/{what}")
    rows, classes, alone, summed = every("rows", jobs[0][0]), every("classes", jobs[0][1]), every("alone", jobs[0][2]), every("summed", summed)
    shared = classes.where("_members > 1")
    retired = alone.select("_c", "_alone")
    single = classes.where("_members = 1").join(retired, (F.col("_node") == F.col("_c")) & (F.col("depth") == F.col("_alone")), "left_semi")
    found = shared.unionByName(single)
    children = found.where("_up IS NOT NULL").groupBy(F.col("_up").alias("_key")).agg(F.count("*").alias("_children"))
    folded = summed.groupBy("_key").agg(F.sum("_leaf").alias("n_leaves"), F.sum("_own").alias("saved_tokens"))
    ends = ends_of(rows.where("depth = _len").select("_key", "_c").join(retired, "_c", "left_anti"))
    none, one = F.sha2(F.lit(""), 256), F.sha2(F.col("_node").cast("string"), 256)
    found = found.join(folded, "_key").join(children, "_key", "left").join(ends, "_key", "left")
    longer = (F.col("_longest") > F.col("depth")).cast("long")  # a retired conversation goes on in a chain
    found = found.select(
        F.col("_node").alias("conv_id"), "depth", "_key", "_up", F.col("_members").alias("n_convs"),
        F.when(F.col("_members") == 1, longer).otherwise(F.coalesce("_children", F.lit(0))).alias("n_children"), "n_leaves", "saved_tokens",
        F.when(F.col("_members") > 1, F.coalesce("_ends", none)).when(longer == 1, none).otherwise(one).alias("ends_sha256"),
    )
    found = written(found)
    above = found.where("n_convs > 1").select(F.col("_key").alias("_up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_weight"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = join_weighed(found.where("_up IS NOT NULL"), above, "_up", "_weight").select(*columns)
    top = found.where("_up IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns)
    # the chains of those that retired, in pieces that are dealt out before they unfold
    longest = alone.where("_len > _alone").select(F.col("_c").alias("conv_id"), "_len", F.explode(F.sequence(F.col("_alone") + 1, "_len", F.lit(CHAIN).cast("long"))).alias("_from"))
    chain = longest.repartition("conv_id", "_from").select("conv_id", "_len", F.explode(F.sequence("_from", F.least("_len", F.col("_from") + CHAIN - 1))).alias("depth"))
    last = F.col("depth") == F.col("_len")
    chain = chain.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return top.unionByName(inner).unionByName(chain)
