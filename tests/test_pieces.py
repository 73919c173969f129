"""Flows worked out in pieces give what one pass over each flow gives."""

from __future__ import annotations

import random
import statistics

import pytest

from pyspark.sql import functions as F

from otspark.operators import baseline, flows, sketches

COLUMNS = "src_ip string, dst_ip string, src_port int, dst_port int, transport string, file_idx int, packet_number long, ts_us long, length long"


def rows_of(seed, ports=True):
    rng, clock, out = random.Random(seed), 10**12, []
    for n in range(600):
        clock += rng.choice([0, 0, -50, 1_000, 50_000, 3_600_000_000, 70_000])
        k = 0 if n % 2 else rng.randrange(5)  # one flow has over half of all packets
        out.append((f"10.0.0.{k}", "10.0.1.1", 1000 + k if ports or k else None, 502, "TCP" if ports or k else None, n // 350, n % 350 + 1, clock, rng.randrange(60, 1500)))
    return out


@pytest.mark.parametrize("piece", [1, 7, 64, 16_384])
def test_moments_of_a_hot_flow(spark, monkeypatch, piece):
    monkeypatch.setattr(flows, "PIECE", piece)
    rows = rows_of(1)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    by, last, gaps = {}, {}, {}
    for r in rows:
        gap = r[7] - last[r[:5]] if r[:5] in last else None
        last[r[:5]] = r[7]
        gaps[r[5:7]] = gap if gap is not None and 0 < gap < 3_600_000_000 else None
        by.setdefault(r[:5], []).append((r[5:7], r[7], r[8]))
    assert {(r.file_idx, r.packet_number): r.ipt_us for r in flows.with_gaps(df).collect()} == gaps
    got = flows.flow_build(df).collect()
    assert len(got) == len(by)
    for r in got:
        mine = by[r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.transport]
        found = [gaps[k] for k, _, _ in mine if gaps[k] is not None]
        assert (r.packet_count, r.ipt_count, r.byte_count, (r.first_file, r.first_packet)) == (len(mine), len(found), sum(x[2] for x in mine), mine[0][0])
        assert (r.start_us, r.end_us) == (min(x[1] for x in mine), max(x[1] for x in mine))
        assert r.avg_inter_packet_time == pytest.approx(statistics.mean(found) / 1e6) and r.jitter == pytest.approx(statistics.stdev(found) / 1e6)
        assert r.packet_length_std == pytest.approx(statistics.stdev(x[2] for x in mine))


@pytest.mark.parametrize("piece", [3, 50, 16_384])
@pytest.mark.parametrize("tracked", [0, 2, 4])
def test_intervals(spark, monkeypatch, piece, tracked):
    monkeypatch.setattr(flows, "PIECE", piece)
    rows = rows_of(3, ports=False)
    count, last, taken = {}, {}, {}
    for r in rows:
        k = r[:5]
        count[k] = count.get(k, 0) + 1
        gap = r[7] - last[k] if k in last else 0
        last[k] = r[7]
        if count[k] >= 12 and gap > 0 and (k in taken or not tracked or len(taken) < tracked):
            taken.setdefault(k, [])
            if len(taken[k]) < 40:
                taken[k].append(gap)
    want = {k: (len(v), statistics.median(v) / 1e6) for k, v in taken.items() if len(v) >= 8}
    got = baseline.intervals(spark.createDataFrame(rows, COLUMNS).repartition(5), most=40, tracked=tracked).collect()
    assert {(r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.transport): (r.samples, pytest.approx(r.median_s)) for r in got} == want
    assert any(r.src_port is None for r in got)
    for r in got:
        v = taken[r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.transport]
        assert r.cv == pytest.approx(statistics.pstdev(v) / 1e6 / (r.median_s + 1e-9))


def test_running_totals_and_ranks(spark):
    rng = random.Random(2)
    values = [rng.choice([1, 1, 1, 7, rng.randrange(10**12)]) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(4)
    for percents in ([0, 10, 50, 90, 99.9, 100], [50]):
        got = {r.percent: r.value for r in sketches.ranks(df, "v", percents).collect()}
        assert got == {float(p): float(sorted(values)[min(int(len(values) * p / 100), len(values) - 1)]) for p in percents}
    assert sketches.ranks(df.limit(0), "v", [10]).count() == 0
    placed = sketches.numbered(df, [F.col("v").desc(), F.col("i")]).collect()
    want = {(i, v): n for n, (v, i) in enumerate(sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (-x[0], x[1])), 1)}
    assert {(r.i, r.v): r.place for r in placed} == want


def test_sketches_merge(spark):
    rows = [r for r in rows_of(5) if r[2]]
    df = spark.createDataFrame(rows, COLUMNS)
    kept = sketches.of_captures(df)
    assert kept.count() == 2
    (one,) = sketches.estimates(sketches.merged(kept)).collect()
    assert (one.packets, one.sources, one.destinations, one.pairs) == (600, 5, 1, 5)
    lengths = sorted(r[8] for r in rows)
    for p in (10, 50, 90):
        assert lengths[max(0, 6 * p - 20)] <= one[f"length_p{p}"] <= lengths[min(599, 6 * p + 20)]
    (none,) = sketches.estimates(sketches.of_captures(df.where("packet_number = 1 AND file_idx = 0"))).collect()
    assert none.gap_p50 is None and none.length_p50 == rows[0][8]
