"""State kept by key on streams of packets and frames: moments of flows, rare codes, known pairs.

Each is a stateful processor behind transformWithState: what a key has learned lives in the state store (RocksDB, so it
need not fit into memory), is written with each batch and found again after a restart or on another executor. Rows of a batch
are taken in processing order (file, packet number), so a stream that is replayed gives what the same operator gives for the
table. `quiet` bounds the state: keys for which nothing came for so long (processing time) are forgotten; None forgets nothing.

Cases: packets without a whole 5-tuple, frames without a code and packets without two addresses change nothing; repeated
packets count again; an empty batch gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from otspark.operators.flows import LONGEST_GAP_US
from otspark.sources.packets import FLOW, ORDER

#: A key is forgotten after so many milliseconds without rows (a day).
QUIET_MS = 24 * 3600 * 1000
#: Pairs that are known at most, and those that only make the others known.
MOST_PAIRS, KNOWN = 400_000, 20
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that these operators need; a session that names another one is told so."""
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name)
    if held != STORE:
        if "RocksDB" not in held and not held.endswith("HDFSBackedStateStoreProvider"):
            raise ValueError(f"{name} is {held}; keyed state needs {STORE}")
        spark.conf.set(name, STORE)
    return spark


def mode_of(quiet: int | None) -> str:
    """Expiry goes by processing time, for which a query works on in empty batches: with a trigger that ends, give no `quiet`."""
    return "None" if quiet is None else "ProcessingTime"


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one batch in processing order."""
    parts = list(rows)
    return pd.concat(parts).sort_values(ORDER, kind="stable") if parts else pd.DataFrame()


class Moments(StatefulProcessor):
    """Counts and integer sums of a flow's lengths and inter-packet times, so far."""

    FIELDS = "packets string, bytes string, l2 string, ipt_count string, i string, i2 string, start_us string, end_us string, last_us string"

    def __init__(self, quiet: int | None) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", self.FIELDS, self.quiet)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, total, l2, k, i, i2, start, end, last = map(int, self.sums.get()) if self.sums.exists() else (0, 0, 0, 0, 0, 0, 2**62, -(2**62), None)
        batch = in_order(rows)
        for ts, length in zip(batch.ts_us.tolist(), batch.length.tolist()):
            if last is not None and 0 < ts - last < LONGEST_GAP_US:
                k, i, i2 = k + 1, i + ts - last, i2 + (ts - last) ** 2
            n, total, l2, start, end, last = n + 1, total + length, l2 + length * length, min(start, ts), max(end, ts), ts
        self.sums.update(tuple(map(str, (n, total, l2, k, i, i2, start, end, last))))  # as text: sums of squares outgrow a long
        dev = lambda n, s, s2: math.sqrt(max(n * s2 - s * s, 0) / (n * (n - 1))) if n > 1 else 0.0
        yield pd.DataFrame([[*key, n, total, start, end, dev(n, total, l2), k, i / k / 1e6 if k else 0.0, dev(k, i, i2) / 1e6]], columns=[*FLOW, "packet_count", "byte_count", "start_us", "end_us", "packet_length_std", "ipt_count", "avg_inter_packet_time", "jitter"])

    def close(self) -> None:
        pass


def flow_moments(packets: DataFrame, quiet: int | None = QUIET_MS) -> DataFrame:
    """After each batch the flows that it changed, with their moments over all batches (flows.flow_build has the same of a table)."""
    with_store(packets.sparkSession)
    keyed = packets.where(" AND ".join(f"{c} IS NOT NULL" for c in FLOW)).select(*FLOW, *ORDER, F.col("ts_us").cast("long"), F.col("length").cast("long"))
    types = {f.name: f.dataType.simpleString() for f in keyed.schema}
    out = ", ".join(f"{c} {types[c]}" for c in FLOW) + ", packet_count long, byte_count long, start_us long, end_us long, packet_length_std double, ipt_count long, avg_inter_packet_time double, jitter double"
    return keyed.groupBy(*FLOW).transformWithStateInPandas(Moments(quiet), out, "Update", mode_of(quiet))


class Codes(StatefulProcessor):
    """How often each code of a protocol came, and how many frames."""

    def __init__(self, quiet: int | None) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "code int", "n long", self.quiet)
        self.total = handle.getValueState("total", "n long", self.quiet)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        total = self.total.get()[0] if self.total.exists() else 0
        held, out, batch = {}, [], in_order(rows)
        for row in batch.itertuples(index=False):
            code = int(row.function_code)
            if code not in held:
                held[code] = self.counts.getValue((code,))[0] if self.counts.containsKey((code,)) else 0
            held[code] += 1
            total += 1
            if total >= 100 and held[code] < 3 and held[code] * 1000 < total:
                out.append((*key, row.file_idx, row.packet_number, code, held[code], total, "MEDIUM" if row.is_write_operation else "LOW"))
        for code, n in held.items():
            self.counts.updateValue((code,), (n,))
        self.total.update((total,))
        if out:
            yield pd.DataFrame(out, columns=["protocol", "file_idx", "packet_number", "function_code", "times", "total", "severity"])

    def close(self) -> None:
        pass


def rare_codes(frames: DataFrame, quiet: int | None = QUIET_MS) -> DataFrame:
    """Frames whose code is rare so far: under three times and under a thousandth of its protocol's frames, from the hundredth on."""
    with_store(frames.sparkSession)
    rows = frames.where("function_code IS NOT NULL").select("protocol", *ORDER, F.col("function_code").cast("int"), F.coalesce("is_write_operation", F.lit(False)).alias("is_write_operation"))
    out = "protocol string, file_idx int, packet_number long, function_code int, times long, total long, severity string"
    return rows.groupBy("protocol").transformWithStateInPandas(Codes(quiet), out, "Append", mode_of(quiet))


class Pairs(StatefulProcessor):
    """The pairs of addresses known so far, `most` of them; one that was quiet for long is new again."""

    def __init__(self, known: int, most: int, quiet: int | None) -> None:
        self.known, self.most, self.quiet = known, most, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairs = handle.getMapState("pairs", "pair string", "at long", self.quiet)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        n = self.count.get()[0] if self.count.exists() else 0
        out, seen = [], set()
        for row in in_order(rows).itertuples(index=False):
            if row.pair in seen:
                continue
            seen.add(row.pair)
            if not self.pairs.containsKey((row.pair,)):
                if n >= self.most:  # full: as many are still known as have not expired
                    n = sum(1 for _ in self.pairs.keys())
                if n >= self.most:
                    continue
                if n > self.known:
                    out.append((row.pair, row.file_idx, row.packet_number, row.src_ip, row.dst_ip))
                n += 1
            self.pairs.updateValue((row.pair,), (int(row.packet_number),))
        self.count.update((n,))
        if out:
            yield pd.DataFrame(out, columns=["pair", "file_idx", "packet_number", "src_ip", "dst_ip"])

    def close(self) -> None:
        pass


def new_pairs(packets: DataFrame, known: int = KNOWN, most: int = MOST_PAIRS, quiet: int | None = QUIET_MS, buckets: int = 1) -> DataFrame:
    """The first packet of each unordered pair of addresses, once over `known` pairs are there (baseline.new_pairs has the same of a table).

    What is known is known of all pairs, so with one bucket it is one key's state; more buckets spread the pairs over as
    many keys, each of which learns `known` pairs of its own and keeps its part of `most`.
    """
    with_store(packets.sparkSession)
    pair = F.concat_ws("|", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip"))
    rows = packets.where("src_ip IS NOT NULL AND dst_ip IS NOT NULL").select(pair.alias("pair"), *ORDER, "src_ip", "dst_ip").withColumn("bucket", F.pmod(F.crc32(F.col("pair").cast("binary")), F.lit(buckets)))
    out = "pair string, file_idx int, packet_number long, src_ip string, dst_ip string"
    return rows.groupBy("bucket").transformWithStateInPandas(Pairs(known, -(-most // buckets), quiet), out, "Append", mode_of(quiet))
