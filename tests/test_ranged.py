"""A capture read by many ranges has the rows of one walk over it."""

from __future__ import annotations

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from otspark.sinks import files
from otspark.sources import capture, pcap, ranged
from tests.test_capture import frame, pcap as pcap_file, pcapng


def frames_of(seed, n=300):
    rng = random.Random(seed)
    return [frame(rng.randbytes(rng.randrange(0, 200))) for _ in range(n)]


def block(kind, body, order="<"):
    return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))


def sections(seed):
    """Two sections, the second with the big end first; interfaces that come late; packets of interfaces that are not there (yet); simple packets."""
    rng, out = random.Random(seed), b""
    for order in "<>":
        out += block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
        for i in range(200):
            if i in (0, 60, 61, 150):
                option = struct.pack(order + "HHB3x", 9, 1, rng.choice([6, 9])) + bytes(4)
                out += block(1, struct.pack(order + "HHI", rng.choice([1, 101]), 0, 0) + option, order)
            f, t = frame(rng.randbytes(rng.randrange(99)))[:-1], (1000 + i) * 10**6 + 5
            if i % 7 == 3:
                out += block(3, struct.pack(order + "I", len(f)) + f + b"\0" * (-len(f) % 4), order)
            else:
                out += block(6, struct.pack(order + "IIIII", rng.randrange(4), t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * (-len(f) % 4), order)
            if i % 50 == 20:
                out += block(5, bytes(8), order)
    return out


FILES = {
    "plain.pcap": pcap_file(frames_of(1)),
    "big.pcap": pcap_file(frames_of(2), ">", True),
    "within.pcap": pcap_file([f + pcap_file(frames_of(4, 12))[24:] for f in frames_of(3, 60)]),  # packets that hold records
    "long.pcap": pcap_file([frame(), frame(bytes(5000)), frame(bytes(30)), frame(bytes(9000))] * 4),  # longer than some ranges
    "cut.pcap": pcap_file(frames_of(5))[:-7],
    "damaged.pcap": (lambda d: d[: len(d) // 2] + b"\xff" * 40 + d[len(d) // 2 + 40 :])(pcap_file(frames_of(6))),
    "one.pcapng": pcapng(frames_of(7)),
    "sections.pcapng": sections(8),
    "zipped.pcap.gz": gzip.compress(pcap_file(frames_of(9))) + gzip.compress(pcap_file(frames_of(10))[24:]),
    "empty.pcap": b"",
    "text.pcap": b"no capture at all" * 99,
    "nothing.pcap": pcap_file([]),
}


def rows(df):
    return sorted((r.file_idx, r.pcap_file, r.packet_number or 0, r.ts_us, r.linktype, r.length, None if r.raw is None else bytes(r.raw), r.error) for r in df.collect())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("captures")
    for name, data in FILES.items():
        (out / name).write_bytes(data)
    (out / ".hidden").write_bytes(b"x")
    return out


def test_ranges_give_the_rows_of_one_walk(spark, folder):
    whole = rows(capture.records(spark, f"file://{folder}"))
    by_file = {}
    for r in whole:
        by_file.setdefault(r[1], []).append(r)
    assert [r[6] for r in by_file["plain.pcap"]] == frames_of(1) and [r[2] for r in by_file["plain.pcap"]] == list(range(1, 301))
    assert [r[6] for r in by_file["zipped.pcap.gz"]] == frames_of(9) + frames_of(10)
    assert [r[6] for r in by_file["within.pcap"]] == [f + pcap_file(frames_of(4, 12))[24:] for f in frames_of(3, 60)]
    assert len(by_file["cut.pcap"]) == 299 and 100 < len(by_file["sections.pcapng"]) < 400
    assert {n: by_file[n][0][7] for n in ("empty.pcap", "text.pcap")} == {"empty.pcap": "no bytes", "text.pcap": "no capture file"}
    assert "nothing.pcap" not in by_file and ".hidden" not in by_file
    for size in (3_000, 40_000):
        found = capture.records(spark, f"file://{folder}", range_bytes=size)
        assert rows(found) == whole
    assert capture.records(spark, f"file://{folder}", range_bytes=3_000).rdd.getNumPartitions() > 3 * len(FILES)
    few = capture.records(spark, f"file://{folder}", most=50, range_bytes=3_000)
    assert rows(few) == [r for r in whole if r[2] <= 50]
    assert rows(few.select("file_idx", "packet_number", "pcap_file", "ts_us", "linktype", "length", "raw", "error")) == rows(few)


def test_a_wrong_place_is_walked_again(spark, folder, monkeypatch):
    """The search finds records within packets; the ranges put together show it."""
    path = f"file:{folder}/within.pcap"
    size = len(FILES["within.pcap"])
    cuts = [(24, 9_000), (9_000, 18_000), (18_000, size)]
    found = [ranged.walked(path, a, b, "" if a == 24 else None) for a, b in cuts]
    ranges, wrong = ranged.put_together(cuts, found)
    assert wrong is not None and wrong[0] == len(ranges)
    parts = ranged.planned(spark, [(path, size)], 0, 9_000)
    assert [p.number for p in parts][0] == 1 and len(parts) == -(-size // 9_000)


def test_order_of_paths_and_the_source_alone(spark, folder):
    paths = [f"file://{folder}/{n}" for n in ("one.pcapng", "big.pcap", "cut.pcap")]
    got = {(r.file_idx, r.pcap_file) for r in capture.records(spark, paths).select("file_idx", "pcap_file").distinct().collect()}
    assert got == {(0, "one.pcapng"), (1, "big.pcap"), (2, "cut.pcap")}
    spark.dataSource.register(ranged.CaptureSource)
    assert rows(spark.read.format("capture").load(str(folder))) == rows(capture.records(spark, f"file://{folder}"))
    with pytest.raises(FileNotFoundError):
        capture.records(spark, f"file://{folder}/none.pcap")


def test_other_stores_and_damaged_gzip(spark, folder, tmp_path, monkeypatch):
    whole = rows(capture.records(spark, f"file://{folder}"))
    monkeypatch.setattr(ranged, "STORES", {})
    assert rows(capture.records(spark, f"file://{folder}")) == whole
    monkeypatch.undo()
    data = gzip.compress(pcap_file(frames_of(11)))
    (tmp_path / "half.pcap.gz").write_bytes(data[: len(data) // 2])
    got = rows(capture.records(spark, f"file://{tmp_path}"))
    assert got[0][7].startswith("gzip: ") and 50 < len(got) < 299 and [r[6] for r in got[1:]] == frames_of(11)[: len(got) - 1]


def test_evidence(spark, folder):
    import hashlib

    got = {r.filename: (r.size, r.sha256) for r in capture.evidence(spark, f"file://{folder}").collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in FILES.items()}


def test_stream_keeps_little():
    data = random.Random(1).randbytes(5 << 20)
    at = [0]

    def read(n):
        at[0] += n
        return data[at[0] - n : at[0]]

    stream, place = pcap.Stream(read), 0
    while (got := stream.take(place, 1000)) is not None:
        assert got == data[place : place + 1000] and len(stream.held) < 2 * pcap.PIECE + 2000
        place += 1500
    assert stream.take(place, pcap.RECORD + 1) is None


def test_written_by_its_tasks(spark, folder, tmp_path):
    found = capture.records(spark, f"file://{folder}").where("raw is not null")
    path = f"file://{tmp_path}/some/subset.pcap"
    want = [(r.linktype, r.ts_us, r.length, bytes(r.raw)) for r in found.orderBy("file_idx", "packet_number").collect()]
    for parts in (5, 1):
        assert files.write_capture(found, path, parts=parts) == len(want)
        names = sorted(p.name for p in (tmp_path / "some/subset.pcap").iterdir())
        assert all(n.startswith("part-") for n in names) and len({n.split("-link")[1].split("-")[0] for n in names}) == 2
        assert len(names) == 2 if parts == 1 else len(names) >= 5
        got = [(r.linktype, r.ts_us, r.length, bytes(r.raw)) for r in capture.records(spark, path).orderBy("file_idx", "packet_number").collect()]
        for link in (1, 101):
            assert [g for g in got if g[0] == link] == [w for w in want if w[0] == link]
    assert files.write_capture(found.limit(0), f"file://{tmp_path}/none") == 0 and not (tmp_path / "none").exists()


def test_a_failed_write_leaves_nothing(spark, folder, tmp_path):
    found = capture.records(spark, f"file://{folder}").where("raw is not null").withColumn("length", F.expr("if(packet_number = 100, raise_error('no'), length)"))
    with pytest.raises(Exception, match="no"):
        files.write_capture(found, f"file://{tmp_path}/failed", parts=4)
    assert not list((tmp_path / "failed").glob("*")) if (tmp_path / "failed").exists() else True
