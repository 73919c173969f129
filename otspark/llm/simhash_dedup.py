"""SimHash near-duplicates, found exactly by vantage-point trees.

Every text gets a 64-bit fingerprint. The distinct fingerprints are dealt to
shards by a vantage-point tree over a bounded sample: a node sends a fingerprint
to its near or far side by its Hamming distance from a vantage point. A query
goes to every shard that the triangle bound leaves open (the sides within the
radius of a boundary), so no pair within the radius is missed. Shards that turn out too large are dealt again, by trees of
their own. Each shard builds
its own vantage-point tree over its home fingerprints, searches it for its
queries, and gives out a spanning forest of the links it found, never all pairs
of a group. Components come from rounds of neighbour contraction on the
distinct fingerprints; copies hang on their fingerprint and are never paired.

Cases: null and empty texts have fingerprint zero, linked like any other;
fewer than three words make one shingle; repeated rows share their component;
a null id stays null and is never the smallest unless its group has no other;
rows that share an id, or have none, are rows of their own where one of a group is kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otspark.llm.common import text_of, whole, written

#: Fingerprints that the tree over the shards is built from, at most (a bounded, seeded sample of the distinct ones).
SAMPLE = 4096
#: Distinct fingerprints that a shard shall hold.
SHARD = 20000
#: Points of an oversized shard that its own tree is built from, about.
NODE_SAMPLE = 512
#: Below this many points a node of a shard's own tree is searched as a whole.
LEAF = 192


def fingerprint(text: str, size: int = 3) -> int:
    """Bit set where more than half of the XXH64 (seed 42) of the word shingles have it, as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    hashes = np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(42))), np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", size: int = 3, beside: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and its fingerprint as a signed long; columns to keep beside them."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return docs.select(docs[id_col].alias("doc_id"), of(text_of(docs, text_col)).alias("fp"), *beside)


def distances(points: np.ndarray, to: int | np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int16)


def grow(points: np.ndarray, rows: np.ndarray, leaf: int, depth: int, rng: np.random.Generator):
    """A node (vantage, cut, near, far), or the rows of a leaf; near holds distances up to the cut."""
    if len(rows) <= leaf or depth == 0:
        return rows
    for _ in range(3):
        vantage = points[rng.choice(rows)]
        d = distances(points[rows], vantage)
        cut = int(np.median(d))
        near = d <= cut
        if 0 < near.sum() < len(rows):
            return (vantage, cut, grow(points, rows[near], leaf, depth - 1, rng), grow(points, rows[~near], leaf, depth - 1, rng))
    return rows  # all alike


def top_tree(sample: np.ndarray, shards: int, seed: int):
    """A tree whose leaves are shard numbers."""
    depth = max(0, int(np.ceil(np.log2(max(shards, 1)))))
    tree = grow(sample, np.arange(len(sample)), 1, depth, np.random.default_rng(seed)) if len(sample) else np.arange(0)
    n = 0

    def number(node):
        nonlocal n
        if isinstance(node, tuple):
            return (node[0], node[1], number(node[2]), number(node[3]))
        n += 1
        return n - 1

    return number(tree)


def dealt(points: np.ndarray, tree, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and shards: each point's own, and those beyond a boundary that it lies within the radius of.

    Two points within the radius have distances from a vantage that differ by no more than it. If a cut parts them, the
    near one lies within the radius of the cut and goes to the far side too: so both always meet in some shard.
    """
    rows, shards = [], []
    waiting = [(tree, np.arange(len(points)))]
    while waiting:
        node, at = waiting.pop()
        if not len(at):
            continue
        if not isinstance(node, tuple):
            rows.append(at)
            shards.append(np.full(len(at), node, np.int32))
            continue
        vantage, cut, near, far = node
        d = distances(points[at], vantage)
        waiting.append((near, at[d <= cut]))
        waiting.append((far, at[d > cut - radius]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(rows), np.concatenate(shards)


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def linked(points: np.ndarray, radius: int, seed: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links between the points of a shard, by vantage-point cuts down to small leaves."""
    rng = np.random.default_rng(seed)
    forest, out = Forest(len(points)), []
    waiting = [np.arange(len(points))]
    while waiting:
        at = waiting.pop()
        if len(at) > LEAF:
            d = distances(points[at], points[rng.choice(at)])
            cut = int(np.median(d))
            near, far = at[d <= cut], at[d > cut - radius]
            if max(len(near), len(far)) < 0.9 * len(at):
                waiting += [near, far]
                continue
        for i in range(0, len(at), 512):
            part = at[i : i + 512]
            q, p = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[at[i:]][None, :]) <= radius)
            a, b = part[q], at[i + p]
            for x, y in zip(a[a != b].tolist(), b[a != b].tolist()):
                if forest.join(x, y):
                    out.append((x, y))
    return out


def split_again(shards: DataFrame, radius: int, seed: int, shard: int, rounds: int = 12) -> DataFrame:
    """Shards of over twice `shard` points are dealt by a tree of their own, until there are none.

    Each such shard's tree comes from about NODE_SAMPLE of its points, which travel as one row a shard (beside its points by a
    join), never to the driver. A round makes shards smaller by a constant factor; points within a few bits of each other,
    which no cut parts, are at most a few thousand.
    """
    for turn in range(rounds):
        sizes = shards.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard)
        if sizes.isEmpty():
            break
        few = F.pmod(F.xxhash64("fp", F.lit(seed + turn)), F.ceil(F.col("n") / NODE_SAMPLE)) == 0
        trees = written(shards.join(sizes, "shard").where(few).groupBy("shard").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("fp")).alias("points")))

        def deal(batches: Iterator[pd.DataFrame], turn: int = turn) -> Iterator[pd.DataFrame]:
            known: dict[int, object] = {}
            for b in batches:
                for at, part in b.groupby("shard"):
                    points = part.fp.to_numpy(np.int64).view(np.uint64)
                    of = part.points.iloc[0]
                    if of is None:
                        yield pd.DataFrame({"shard": part.shard, "fp": part.fp})
                        continue
                    if at not in known:
                        known = {at: top_tree(np.array(of, np.int64).view(np.uint64), min(NODE_SAMPLE // 4, -(-int(part.n.iloc[0]) // shard)), seed + turn)}
                    rows, leaves = dealt(points, known[at], radius)
                    name = xxhash.xxh64_intdigest(f"{at}/{turn}") >> 1
                    yield pd.DataFrame({"shard": (name + leaves.astype(np.int64)), "fp": points[rows].view(np.int64)})

        shards = written(shards.join(trees, "shard", "left").select("shard", "fp", "n", "points").mapInPandas(deal, "shard long, fp long"))
    return shards


def links(distinct: DataFrame, *, radius: int = 2, seed: int = 7, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """a < b: links between distinct fingerprints (column fp) whose closure is that of all links within the radius.

    The driver gets a count and a sample of at most `sample` fingerprints; the tree over the first shards is built from it and
    goes to the workers. Fingerprints need not be like the sample: the bounds hold for any point, and shards that turn out
    too large are split again.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    some = distinct.where(F.pmod(F.xxhash64("fp", F.lit(seed)), F.lit(max(1, n // sample))) == 0).limit(sample) if n else distinct.limit(0)
    points = np.sort(np.array([r.fp for r in some.collect()], np.int64)).view(np.uint64)
    tree = spark.sparkContext.broadcast(top_tree(points, min(-(-n // shard), max(1, sample // 4)), seed))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            points = b.fp.to_numpy(np.int64).view(np.uint64)
            rows, shards = dealt(points, tree.value, radius)
            yield pd.DataFrame({"shard": shards.astype(np.int64), "fp": points[rows].view(np.int64)})

    def search(b: pd.DataFrame) -> pd.DataFrame:
        points = b.fp.to_numpy(np.int64).view(np.uint64)
        found = linked(points, radius, seed)
        ends = points[np.array(found, np.int64).reshape(-1, 2)].view(np.int64)
        return pd.DataFrame({"a": ends.min(1), "b": ends.max(1)})

    shards = split_again(written(distinct.mapInPandas(deal, "shard long, fp long")), radius, seed, shard)
    return shards.groupBy("shard").applyInPandas(search, "a long, b long")


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable, for every node of the edges (columns a, b).

    Alternates two contractions: every node's larger neighbours move to its smallest neighbour, then its smaller
    ones do. The longest chain shrinks by a constant factor a round; each round's edges are written to the shared folder.
    """
    star = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if star.isEmpty():
        return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(max_rounds):
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        star = written(small)
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def simhash_components(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", size: int = 3, radius: int = 2, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links)."""
    prints = written(fingerprints(docs, text_col=text_col, id_col=id_col, size=size))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(distinct.select("fp"), radius=radius, seed=seed))
    member = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    of_root = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_print = member.join(of_root, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", size: int = 3, radius: int = 2, seed: int = 7) -> DataFrame:
    """The documents with one row of each component: the one with the smallest id, null last.

    Rows of one id go by a hash of their columns, rows alike in those by a number that is written beside them: so every
    row has a key of its own, unlike rows without an id or with the same one do not stand for each other, and reruns keep
    the same rows.
    """
    numbered = docs.select(whole(docs), F.monotonically_increasing_id().alias("_n"), text_of(docs, text_col).alias("_text"))
    prints = fingerprints(numbered, text_col="_text", id_col="_n", size=size, beside=("_doc",))
    rows = written(prints.withColumnRenamed("doc_id", "_n"))
    key = F.col("_doc").getField(id_col)
    hashed = [F.col("_doc").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    order = F.struct(key.isNull().alias("none"), key.alias("id"), F.xxhash64(*hashed).alias("h"), F.col("_n").alias("n"))
    distinct = rows.groupBy("fp").agg(F.min(order).alias("least"))
    roots = components(links(rows.select("fp").distinct(), radius=radius, seed=seed))
    member = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("least", F.coalesce("root", "fp").alias("root"))
    keep = member.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.n").alias("_n"))
    return rows.join(keep, "_n", "left_semi").select("_doc.*")
