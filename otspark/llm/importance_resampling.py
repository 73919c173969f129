"""Resampling of documents towards a target corpus, by hashed n-gram features.

Each partition has a DuckDB of its own: SQL unnests a text's words, windows over
them give the runs of one to three, and a registered function (zlib's CRC-32)
puts each into a bucket. What comes out is spilled to Parquet in the shared
folder: for each document its buckets and how often each occurs, and now and then
a row with the totals of all buckets so far. Spark merges the totals (as many
numbers as there are buckets), works out each bucket's gain, scores the spilled
documents without their texts, and ranks the scores by range partitions. Drawing
the highest of weight plus Gumbel noise is drawing without replacement with
probabilities in proportion to the weights.

Bounds: a writer holds a row group of ROW_GROUP bytes; DuckDB sees at most PIECE code points at once (rows are gathered up to
that, and longer texts come in pieces, each with the two words that follow it, so
that no run is lost); only a single word can be longer. A row that is spilled has
at most as many numbers as there are buckets.

Cases: a null or empty text has no words, no features and weight 0; bytes that
are not UTF-8 count as U+FFFD; rows that are alike are documents like any other
and tie; ties go to the smaller id, a null id last (its noise is that of the id
'null'), then to the row that was spilled first; an empty corpus gives no row, an
empty target counts nothing; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from otspark.llm.common import numbered, text_of, written

#: Number of buckets of the features.
BUCKETS = 10_000
#: Code points that DuckDB sees at once.
PIECE = 200_000
#: Bytes of a row group of what is spilled.
ROW_GROUP = 16 << 20
#: Texts with so many code points together give one row of totals.
TOTAL = 4_000_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text whose capital letters are not small ones yet, and the characters that end such a word.
_WORDS, _CUT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

FEATURES = f"""
WITH words AS (
  SELECT doc, own, unnest(ws) AS word, generate_subscripts(ws, 1) AS nth
  FROM (SELECT doc, own, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM pieces)
), runs AS (
  SELECT doc, own, nth, word, lead(word, 1) OVER piece AS word2, lead(word, 2) OVER piece AS word3 FROM words WINDOW piece AS (PARTITION BY doc ORDER BY nth)
), features AS (
  SELECT doc, unnest([word, word || ' ' || word2, word || ' ' || word2 || ' ' || word3]) AS feature FROM runs WHERE nth <= own
), hashed AS (
  SELECT doc, unnest(crc32_of(string_agg(feature, chr(10)))) AS crc FROM features WHERE feature IS NOT NULL GROUP BY doc
)
SELECT doc, CAST(crc % $buckets AS INTEGER) AS bucket, count(*) AS n FROM hashed GROUP BY ALL
"""


def crc32_of(features: pa.ChunkedArray) -> pa.Array:
    """CRC-32 of the UTF-8 bytes of each feature; a text's features come as lines (no word holds a line feed), so that DuckDB calls for a text at a time."""
    found, ends = [], [0]
    for lines in features.cast(pa.large_binary()).to_pylist():
        found += map(zlib.crc32, lines.split(b"\n"))
        ends.append(len(found))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(found, np.uint32)))


def database() -> duckdb.DuckDBPyConnection:
    """One thread, little memory, nothing on disk."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    con.create_function("crc32_of", crc32_of, ["VARCHAR"], "UINTEGER[]", type="arrow")
    return con


def pieces_of(text: str, most: int) -> Iterator[tuple[str, int]]:
    """(piece with the two words after it, number of its own words) for each piece of a text; pieces end where a word ends."""
    if len(text) <= most:
        yield text, len(text)
        return
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + most)
        end = cut.start() if cut else len(text)
        own, stop = sum(1 for _ in _WORDS.finditer(text[at:end])), end
        for _ in range(2):
            word = _WORDS.search(text, stop)
            stop = word.end() if word else stop
        yield text[at:stop], own
        at = end


def bucket_counts(texts: list[str], con: duckdb.DuckDBPyConnection, buckets: int = BUCKETS, piece: int = PIECE) -> list[dict[str, np.ndarray]]:
    """For each text its buckets, ascending, and how often each occurs."""
    found = [[] for _ in texts]
    gathered, size = [], 0

    def run() -> None:
        nonlocal gathered, size
        if not gathered:
            return
        con.register("pieces", pa.table({"doc": pa.array(range(len(gathered)), pa.int32()), "text": pa.array([t for _, t, _ in gathered], pa.string()), "own": pa.array([o for _, _, o in gathered], pa.int64())}))
        got = con.execute(FEATURES, {"buckets": buckets}).fetchnumpy()
        con.unregister("pieces")
        order = np.lexsort((got["bucket"], got["doc"]))
        docs, bucket, n = got["doc"][order], got["bucket"][order], got["n"][order]
        starts = np.searchsorted(docs, np.arange(len(gathered) + 1))
        for i, (doc, _, _) in enumerate(gathered):
            if starts[i] < starts[i + 1]:
                found[doc].append((bucket[starts[i] : starts[i + 1]], n[starts[i] : starts[i + 1]]))
        gathered, size = [], 0

    for doc, text in enumerate(texts):
        for part, own in pieces_of(text, piece):
            if size and size + len(part) > piece:
                run()
            gathered.append((doc, part, own))
            size += len(part)
            if size >= piece:
                run()
    run()
    out = []
    for parts in found:
        if len(parts) > 1:
            dense = np.zeros(buckets, np.int64)
            for b, n in parts:
                dense[b] += n
            at = np.flatnonzero(dense)
            out.append((at, dense[at]))
        else:
            out.append(parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return out


def spilled(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", buckets: int = BUCKETS, piece: int = PIECE) -> DataFrame:
    """The written rows of all partitions: doc_id, n_words, buckets, counts for a document; totals (and no n_words) for what a task has seen."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.make_valid_utf8(text_of(docs, text_col)).alias("text"))
    kind = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *StructType.fromDDL("n_words long, buckets array<int>, counts array<long>, totals array<long>").fields])

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, totals, seen = database(), np.zeros(buckets, np.int64), 0
        lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), kind))

        def sums(id_type: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())), pa.array([totals.tolist()], pa.list_(pa.int64()))], names=kind.names)

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                got = bucket_counts(texts, con, buckets, piece)
                for b, n in got:
                    totals[b] += n
                features = np.array([int(n.sum()) for _, n in got], np.int64)
                words = np.where(features > 1, (features + 3) // 3, features)  # n words make 3n - 3 runs
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), lists([b for b, _ in got], pa.int32()), lists([n for _, n in got], pa.int64()), pa.nulls(part.num_rows, pa.list_(pa.int64()))], names=kind.names)
                seen += sum(map(len, texts))
                if seen >= TOTAL:
                    yield sums(id_type)
                    totals[:], seen = 0, 0
        if id_type is not None:
            yield sums(id_type)
        con.close()

    return written(rows.mapInArrow(spill, kind), **{"parquet.block.size": ROW_GROUP})  # what a writer holds before it reaches the disk


def merged(spill: DataFrame, buckets: int) -> np.ndarray:
    """Totals of all buckets; `buckets` rows reach the driver."""
    sums = spill.where("totals IS NOT NULL").select(F.posexplode("totals").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in sums:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ((t+1)(S+n) / ((s+1)(T+n)))) for each of n buckets."""
    all_s, all_t, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (all_s + n) / ((float(s) + 1) * (all_t + n)))) for s, t in zip(corpus, target)], np.int64)


def weighed(spill: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight for each spilled document."""
    kind = StructType([spill.schema["doc_id"], *StructType.fromDDL("n_words long, n_features long, weight long").fields])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, n = batch.column(2), batch.column(3)
            ends = np.asarray(b.offsets)
            value, times = gain[np.asarray(b.values)], np.asarray(n.values)
            value, times = np.concatenate([[0], np.cumsum(value * times)]), np.concatenate([[0], np.cumsum(times)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(times[ends[1:]] - times[ends[:-1]], pa.int64()), pa.array(value[ends[1:]] - value[ends[:-1]], pa.int64())], names=kind.names)

    return spill.where("totals IS NULL").select("doc_id", "n_words", "buckets", "counts").mapInArrow(weigh, kind)


def resampled(docs: DataFrame, target: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", target_text: str = "text", target_id: str = "item_id", percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, piece: int = PIECE) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null if not drawn)."""
    spill = spilled(docs, text_col=text_col, id_col=id_col, buckets=buckets, piece=piece)
    aim = spilled(target, text_col=target_text, id_col=target_id, buckets=buckets, piece=piece)
    rows = weighed(spill, gains(merged(spill, buckets), merged(aim, buckets)))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("_row"))
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    rows = numbered(rows, [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")], "_rank")
    drawn = percent * rows.where(able).count() // 100
    rank = F.when(F.col("_rank") < drawn, F.col("_rank") + 1)
    return rows.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def selected(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of the ids that are drawn, all columns as they are."""
    ids = resampled(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(F.col("_drawn")), "left_semi")
