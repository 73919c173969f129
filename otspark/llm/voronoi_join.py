"""Exact top-k search by inner product: a Voronoi join of queries with all vectors.

Vectors become whole numbers (floor of `scale` times each component). Pivots, a
seeded sample of the distinct vectors, cut the space into Voronoi cells; queries and
data belong to the cell of their nearest pivot. From a summary of each cell (number of
vectors, largest distance from its pivot, largest norm, the k + 1 smallest distances)
follow bounds: with p, r a cell's pivot and radius, q.x is at most q.p + |q| r and at
most |q| times the largest norm, and a vector at distance d from p scores at least
q.p - |q| d. The k + 1 best of these lower bounds over all cells say what the k best
partners have at least (the query itself may be one of them), first for a group of
queries by its own radius, then for each query. Only to cells that can reach that are
queries copied; of the two sides it is the queries that travel, as they are the smaller.
Cells of many vectors are cut into shelves by a hash. A task holds one shelf at a time
and lets its queries pass by, in batches; the best of all shelves are merged by rank.

Scores are exact: products are summed as doubles only while every sum stays below 2**53,
else as Python's whole numbers. A vector that many rows have is held once, with the k + 1
smallest ids (no query can need more), so copies neither crowd a shelf nor a cell.

Bounds: pivots are at most `most_pivots`, and what reaches the driver or is broadcast is
the pivots and a summary row for each. A shelf holds about `shelf` vectors. On vectors
without clusters the bounds exclude no cell and every query meets every vector, in blocks.

Cases: null vectors, and those with null or non-finite components, take no part; shorter
vectors are filled up with zeros (an empty one scores 0 with all); components whose product
with the scale lies beyond a long, and scores beyond a long, are set to the nearest long;
ties go to the smaller id, a null id last (it is a candidate, never a query), then to the row
numbered first; rows that are alike are candidates of each other, as only a query's own row is
left out; each row of a repeated query id gets its own answers; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otspark.llm.common import written

#: Numbers of a block of scores that a task works out at once.
BLOCK = 2_000_000
LONG = 2**63 - 1
RESULT = "query_id long, rank int, vec_id long, score long"


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """_row (a number of the written row), vec_id, _v (whole numbers) of the rows that take part."""
    v = vectors[vec_col]
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return written(vectors.where(fine).select(F.monotonically_increasing_id().alias("_row"), vectors[id_col].cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("_v")))


def packed(rows: DataFrame, dim: int, kind: str) -> DataFrame:
    """_row, vec_id, _vec: the whole numbers as bytes, filled up to dim."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            ends, flat = np.asarray(v.offsets), np.asarray(v.values)
            out = np.zeros((batch.num_rows, dim), kind)
            width = np.diff(ends)
            out[np.repeat(np.arange(batch.num_rows), width), np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], width)] = flat[ends[0] : ends[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in out], pa.binary())], names=["_row", "vec_id", "_vec"])

    return rows.mapInArrow(pack, "_row long, vec_id long, _vec binary")


def matrix(column: list[bytes], dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), dim).astype(np.float64)


def in_cells(rows: DataFrame, pivots: np.ndarray, kind: str) -> DataFrame:
    """Adds _cell (nearest pivot), _dist (to it) and _norm."""
    dim, squares = pivots.shape[1], (pivots**2).sum(1)
    schema = rows.withColumn("_cell", F.lit(0)).withColumn("_dist", F.lit(0.0)).withColumn("_norm", F.lit(0.0)).schema
    at = rows.columns.index("_vec")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(at).to_pylist(), dim, kind)
            cell = (squares - 2 * (v @ pivots.T)).argmin(1)
            dist = np.sqrt(((v - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(dist), pa.array(np.sqrt((v**2).sum(1)))], names=schema.names)

    return rows.mapInArrow(assign, schema)


class Cells:
    """What the summaries say: for each group of queries the cells it may need, and the same for a single query."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, norm: np.ndarray, nearest: list[list[float]], query_radius: np.ndarray, query_norm: np.ndarray, k: int) -> None:
        self.pivots, self.radius, self.norm, self.k = pivots, radius, norm, k
        self.of = np.repeat(np.arange(len(pivots)), [len(x) for x in nearest])  # the cell of each of the smallest distances
        self.near = np.array([d for x in nearest for d in x])
        dots, length = pivots @ pivots.T, np.sqrt((pivots**2).sum(1))
        u = query_radius[:, None]
        low = dots[:, self.of] - length[:, None] * self.near - u * length[self.of] - u * self.near
        high = np.minimum(dots + length[:, None] * radius + u * length + u * radius, query_norm[:, None] * norm)
        self.reach = high >= self.least(low)[:, None] - self.slack(high)

    def least(self, low: np.ndarray) -> np.ndarray:
        """What the k best partners score at least: the k + 1 highest of the lower bounds."""
        at = low.shape[1] - self.k - 1
        return np.partition(low, at, axis=1)[:, at] if at >= 0 else np.full(len(low), -np.inf)

    @staticmethod
    def slack(x: np.ndarray) -> np.ndarray:
        return 1 + 1e-9 * np.abs(x)

    def needed(self, queries: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """For each query (in a group) and cell, whether it can hold one of the query's best."""
        dots, length = queries @ self.pivots.T, np.sqrt((queries**2).sum(1))[:, None]
        high = np.minimum(dots + length * self.radius, length * self.norm)
        low = dots[:, self.of] - length * self.near
        return self.reach[groups] & (high >= self.least(low)[:, None] - self.slack(high))


def best_of(scores: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` highest scores of a row; of those that tie the first ones."""
    if len(scores) <= most:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - most)[len(scores) - most]
    over = np.flatnonzero(scores > least)
    return np.concatenate([over, np.flatnonzero(scores == least)[: most - len(over)]])


def answers(shelf: list[tuple[bytes, list[dict]]], queries: list[tuple[int, int, bytes]], dim: int, kind: str, k: int, exact: bool) -> Iterator[tuple[int, int, int, int, int]]:
    """(query's row, query's id, score, id, row) of the k best of a shelf for each query; the shelf is in the order of its ids."""
    data = matrix([v for v, _ in shelf], dim, kind)
    asked = matrix([v for _, _, v in queries], dim, kind)
    if not exact:  # sums that a double may not hold
        whole = lambda vs: np.frombuffer(b"".join(vs), kind).reshape(len(vs), dim).astype(object)
        data, asked = whole([v for v, _ in shelf]), whole([v for _, _, v in queries])
    step = max(1, BLOCK // max(1, len(shelf)))
    for at in range(0, len(queries), step):
        scores = asked[at : at + step] @ data.T if dim else np.zeros((len(asked[at : at + step]), len(shelf)))
        if not exact:
            scores = np.maximum(np.minimum(scores, LONG), -LONG - 1)
        for i, (row, name, _) in enumerate(queries[at : at + step]):
            found = [(-int(scores[i, j]), x["vec_id"] is None, x["vec_id"] or 0, x["_row"]) for j in best_of(scores[i], k + 1) for x in shelf[j][1] if x["_row"] != row]
            for score, no_id, vec_id, other in sorted(found)[:k]:
                yield row, name, -score, None if no_id else vec_id, other


def solved(rows: DataFrame, dim: int, kind: str, k: int, exact: bool) -> DataFrame:
    """Answers of each shelf; rows come shelf by shelf, a shelf's vectors before its queries."""
    names = ["_row", "query_id", "score", "vec_id", "_other"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shelf, in_order = None, [], False
        for batch in batches:
            shelves, kinds = np.asarray(batch.column("_shelf")), np.asarray(batch.column("_asks"))
            cuts = [0, *(np.flatnonzero((np.diff(shelves) != 0) | (np.diff(kinds) != 0)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if shelves[a] != number:
                    number, shelf, in_order = shelves[a], [], False
                if not kinds[a]:
                    shelf += zip(part.column("_vec").to_pylist(), part.column("_ids").to_pylist())
                    continue
                if not in_order:
                    shelf.sort(key=lambda x: (x[1][0]["vec_id"] is None, x[1][0]["vec_id"] or 0, x[1][0]["_row"]))
                    in_order = True
                found = list(answers(shelf, list(zip(part.column("_row").to_pylist(), part.column("query_id").to_pylist(), part.column("_vec").to_pylist())), dim, kind, k, exact)) if shelf else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=names)

    return rows.mapInArrow(solve, "_row long, query_id long, score long, vec_id long, _other long")


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", queries: Column | None = None, k: int = 5, scale: int = 256, pivots: int | None = None, most_pivots: int = 1024, shelf: int = 32_768, seed: int = 13) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the highest inner products for each query (ids that 50 divides, unless told otherwise)."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vec_col, scale)
    most = rows.agg(F.max(F.size("_v")).alias("dim"), F.max(F.array_max(F.transform("_v", lambda x: F.greatest(x, F.bitwise_not(x))))).alias("top")).first()
    if most.dim is None:
        return spark.createDataFrame([], RESULT)
    dim, top = most.dim, (most.top or 0) + 1
    kind = "<i2" if top <= 2**15 else "<i4" if top <= 2**31 else "<i8"
    exact = dim * top * top < 2**53
    rows = written(packed(rows, dim, kind))
    ids = Window.partitionBy("_vec").orderBy(F.col("vec_id").asc_nulls_last(), "_row")
    distinct = rows.withColumn("_nth", F.row_number().over(ids)).where(F.col("_nth") <= k + 1)
    distinct = written(distinct.groupBy("_vec").agg(F.array_sort(F.collect_list(F.struct("_nth", "vec_id", "_row"))).alias("_ids")))
    n = distinct.count()
    count = min(most_pivots, pivots or max(4, round(n**0.5 / 4)))
    chosen = [r[0] for r in distinct.select("_vec").orderBy(F.xxhash64("_vec", F.lit(seed)), "_vec").limit(count).collect()]
    points = matrix([bytes(x) for x in chosen], dim, kind)
    asks = F.col("vec_id") % 50 == 0 if queries is None else queries
    data = written(in_cells(distinct, points, kind))
    asked = written(in_cells(rows.where(asks).select("_row", F.col("vec_id").alias("query_id"), "_vec"), points, kind))

    # summaries: a row for each cell
    nearest = data.withColumn("_nth", F.row_number().over(Window.partitionBy("_cell").orderBy("_dist"))).where(F.col("_nth") <= k + 1).groupBy("_cell").agg(F.collect_list("_dist").alias("near"))
    found = {r["_cell"]: r for r in data.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_dist").alias("radius"), F.max("_norm").alias("norm")).join(nearest, "_cell").collect()}
    groups = {r["_cell"]: r for r in asked.groupBy("_cell").agg(F.max("_dist").alias("radius"), F.max("_norm").alias("norm")).collect()}
    get = lambda of, name: np.array([of[j][name] if j in of else 0.0 for j in range(len(points))])
    cells = Cells(points, get(found, "radius"), get(found, "norm"), [list(found[j].near) if j in found else [] for j in range(len(points))], get(groups, "radius"), get(groups, "norm"), k)
    shelves = np.array([-(-found[j].n // shelf) if j in found else 0 for j in range(len(points))])
    first = np.concatenate([[0], np.cumsum(shelves)])

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = cells.needed(matrix(batch.column("_vec").to_pylist(), dim, kind), np.asarray(batch.column("_cell"))) if exact else np.ones((batch.num_rows, 1), bool)  # scores set to the nearest long may tie anywhere
            need = need & (shelves > 0)
            at, cell = np.nonzero(need)
            part = batch.select(["_row", "query_id", "_vec"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(first[cell], pa.int64()), pa.array(first[cell + 1] - 1, pa.int64())], names=["_row", "query_id", "_vec", "_from", "_to"])

    copied = asked.mapInArrow(copies, "_row long, query_id long, _vec binary, _from long, _to long")
    copied = copied.select(F.explode(F.sequence("_from", "_to")).alias("_shelf"), F.lit(1).alias("_asks"), "_row", "query_id", "_vec", F.lit(None).cast(data.schema["_ids"].dataType).alias("_ids"))
    plan = F.broadcast(spark.createDataFrame([(j, int(first[j]), int(shelves[j])) for j in range(len(points))], "_cell int, _first long, _shelves long"))
    shelved = data.join(plan, "_cell").select((F.col("_first") + F.pmod(F.xxhash64("_vec"), "_shelves")).alias("_shelf"), F.lit(0).alias("_asks"), F.lit(None).cast("long").alias("_row"), F.lit(None).cast("long").alias("query_id"), "_vec", "_ids")
    met = shelved.unionByName(copied).repartition("_shelf").sortWithinPartitions("_shelf", "_asks")
    best = Window.partitionBy("_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "_other")
    ranked = solved(met, dim, kind, k, exact).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
