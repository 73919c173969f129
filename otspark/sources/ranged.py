"""Capture files read by byte ranges, as streams: spark.read.format("capture").

A long file is cut into ranges, and a range has the records whose header begins in it. First an index is made, by a job over
the ranges: each looks for its first record (four headers in a row that agree, or that end the file), walks to the first record
of the next range and tells where it began and ended, how many packets it has, and which sections and interfaces it met. Then the
ranges are put together in order: a range must begin where the one before ended. One that does not (a capture within a capture
can deceive the search) is walked again from the right place, so the rows are those of one walk over the whole file. What is then
known (place, number of the first packet, sections) makes an input partition of each range.

Nothing holds a file: bytes come in pieces, gzip is unpacked as they come, and a record of over pcap.RECORD bytes ends its file, as a
cut-off one does. A gzip file cannot be cut and is one partition; where it is damaged its packets end, with a row that has `error`.

Files are listed by Spark's own file systems, in the order given, a folder's by name, hidden ones left out; they are opened by
Arrow's. A file without bytes, or one that is no capture, gives one row with `error`. The index's rows, some numbers for each
range, are what comes to the driver.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import partial

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from otspark.sources import pcap

SCHEMA = "file_idx int, pcap_file string, path string, packet_number bigint, ts_us bigint, linktype int, length bigint, raw binary, error string"
ARROW = pa.schema([("file_idx", pa.int32()), ("pcap_file", pa.string()), ("path", pa.string()), ("packet_number", pa.int64()), ("ts_us", pa.int64()), ("linktype", pa.int32()), ("length", pa.int64()), ("raw", pa.binary()), ("error", pa.string())])
#: Bytes of a range; rows of an Arrow batch, and bytes of its packets.
RANGE, BATCH, BATCH_BYTES = 64 << 20, 4096, 8 << 20
#: Stores that workers can open, and Arrow's names of them.
STORES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def listed(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of each file, in the order of the paths; a folder's files by name, but for hidden ones."""
    out = []
    for p in [paths] if isinstance(paths, str) else paths:
        pattern = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
        found = fs.globStatus(pattern)
        if not found:
            raise FileNotFoundError(p)
        for status in sorted(found, key=lambda s: s.getPath().toString()):
            files = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            out += sorted((s.getPath().toString(), s.getLen()) for s in files if s.isFile() and not s.getPath().getName().startswith((".", "_")))
    return out


def reachable(path: str) -> bool:
    """Whether workers can open it."""
    return path.split(":", 1)[0] in STORES


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system and its name of a reachable path."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(f"{STORES[scheme]}:{rest}")


def opened(path: str) -> pa.NativeFile:
    store, name = store_of(path)
    return store.open_input_file(name)


# ---- the index ----


def walked(path: str, start: int, stop: int, before: str | None) -> dict:
    """What a range has, from its first record; `before`: the sections before `start`, where that is known to be a record."""
    with opened(path) as file:
        form = pcap.form_of(file.read(pcap.Head.size))
        blocks = isinstance(form, pcap.Sections)
        first = start if before is not None else None
        for order in [form.order, "<" if form.order == ">" else ">"] if blocks else [form.order]:
            if first is None:
                form.order = order
                file.seek(start)
                first = pcap.first_record(form, pcap.Stream(file.read, start), start, stop)
        out = {"first": first, "end": first, "packets": 0, "open": {}, "reset": False, "raw": ""}
        if first is None:
            return out
        if blocks and before is not None:
            form = pcap.Sections.of(base64.b64decode(before))
        elif blocks:
            form.known = False
        file.seek(first)
        for at, packet in form.walk(pcap.Stream(file.read, first), first, stop):
            out["packets"] += packet is not None
            out["end"] = at
    if blocks:
        out |= {"open": {str(k): n for k, n in form.open.items()}, "reset": form.known, "raw": base64.b64encode(form.raw).decode()}
    return out


def index_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            found = json.dumps(walked(r["path"], r["start"], r["stop"], r["before"]))
            yield pa.RecordBatch.from_arrays([pa.array([r["n"]], pa.int64()), pa.array([found])], names=["n", "found"])


@dataclass
class Range(InputPartition):
    """Records of a file from one that begins at `start` to the last that begins before `stop` (none: all)."""

    file_idx: int
    path: str
    start: int = 0
    stop: int | None = None
    number: int = 1
    most: int = 0
    sections: str = ""


def put_together(cuts: list[tuple[int, int]], found: list[dict]) -> tuple[list[tuple[int, int, int, str]], tuple[int, int, str] | None]:
    """((start, stop, number of the first packet, sections before) of the ranges that have records, or the first range to be walked again, from where, and the sections before)."""
    out, number, end, before = [], 1, cuts[0][0], b""
    for i, ((_, stop), r) in enumerate(zip(cuts, found)):
        if end >= stop:  # a record of a range before reaches beyond this one
            continue
        if r["first"] != end:
            return out, (i, end, base64.b64encode(before).decode())
        out.append((end, stop, number, base64.b64encode(before).decode()))
        known = len(pcap.Sections.of(before).faces) if r["open"] else 0
        number += r["packets"] + sum(n for k, n in r["open"].items() if int(k) < known)
        raw = base64.b64decode(r["raw"])
        before = raw if r["reset"] else before + raw
        end = r["end"]
        if end < stop:  # cut off or damaged: the file ends here
            break
    return out, None


def planned(spark: SparkSession, files: list[tuple[str, int]], most: int, range_bytes: int) -> list[Range]:
    """A partition for each range of a long file, and for each other file."""
    whole, cuts = {}, {}
    for i, (path, size) in enumerate(files):
        whole[i] = [Range(i, path, most=most)]
        if size > range_bytes and not path.endswith(".gz"):
            with opened(path) as file:
                form = pcap.form_of(file.read(pcap.Head.size))
            if form is not None:
                at = [form.size, *range(range_bytes, size, range_bytes)]
                cuts[i] = list(zip(at, [*at[1:], size]))
    ask = [(i, k, cut[0], cut[1], None if k else "") for i, c in cuts.items() for k, cut in enumerate(c)]
    found: dict[int, list[dict]] = {i: [{}] * len(c) for i, c in cuts.items()}
    while ask:
        rows = spark.createDataFrame([(n, files[i][0], start, stop, before) for n, (i, _, start, stop, before) in enumerate(ask)], "n long, path string, start long, stop long, before string")
        for r in rows.repartitionByRange(len(ask), "n").mapInArrow(index_ranges, "n long, found string").collect():
            i, k = ask[r.n][:2]
            found[i][k] = json.loads(r.found)
        again, ask = {i: put_together(c, found[i]) for i, c in cuts.items()}, []
        for i, (ranges, wrong) in again.items():
            if wrong:
                ask.append((i, wrong[0], wrong[1], cuts[i][wrong[0]][1], wrong[2]))
            else:
                whole[i] = [Range(i, files[i][0], start, stop, number, most, before) for start, stop, number, before in ranges if not most or number <= most]
    return [r for ranges in whole.values() for r in ranges]


# ---- the source ----


class CaptureSource(DataSource):
    """Option `ranges`: partitions as JSON (records() makes them); without it each file of `path` is one partition."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options["path"], overwrite)


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Range]:
        if "ranges" in self.options:
            return [Range(**r) for r in json.loads(self.options["ranges"])]
        path = self.options["path"]
        store, name = pyarrow.fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        info = store.get_file_info(name)
        found = sorted(f.path for f in store.get_file_info(pyarrow.fs.FileSelector(name)) if f.is_file and not f.base_name.startswith((".", "_"))) if info.type == pyarrow.fs.FileType.Directory else [name]
        scheme = path.partition(":")[0] if ":" in path else "file"
        return [Range(i, f"{scheme}:{'//' if scheme != 'file' else ''}{f}") for i, f in enumerate(found)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows_of(partition):
            held.append(row)
            size += len(row[7] or b"")
            if len(held) == BATCH or size >= BATCH_BYTES:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def rows_of(r: Range, content: bytes | None = None) -> Iterator[tuple]:
    """The rows of a range; of a whole file's content where it is given."""
    name = (r.file_idx, r.path.rsplit("/", 1)[-1], r.path)
    wrong = lambda e: (*name, None, None, None, None, None, e)
    with opened(r.path) if content is None else pa.BufferReader(content) as file:
        start = file.read(pcap.Head.size)
        file.seek(0)
        read = file.read
        zipped = start[:2] == pcap.GZIP
        if zipped:
            read = pcap.unzipped(file.read)
        stream = pcap.Stream(read)
        try:
            if zipped:
                start = stream.take(0, pcap.Head.size) or stream.held
            form = pcap.form_of(start)
            if form is None:
                yield wrong(pcap.refused(start))
                return
            at = r.start or form.size
            if r.start:
                file.seek(r.start)
                stream = pcap.Stream(file.read, r.start)
                form = pcap.Sections.of(base64.b64decode(r.sections)) if isinstance(form, pcap.Sections) else form
            number = r.number
            for _, packet in form.walk(stream, at, float("inf") if r.stop is None else r.stop):
                if r.most and number > r.most:
                    return
                if packet:
                    yield *name, number, *packet, None
                    number += 1
        except (zlib.error, EOFError) as e:
            yield wrong(f"gzip: {e}")


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written: (name in the temporary folder, name in the end)."""

    files: list[tuple[str, str]]


class CaptureWriter(DataSourceArrowWriter):
    """Rows with ts_us, linktype, length and raw as pcap files of a folder: in each partition one for each link type, with its own head.

    Tasks write into a folder of this job's own, so what a lost or repeated attempt has left is never seen; commit moves the files
    of the attempts that count, and removes that folder, as abort does.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path if ":" in path else f"file:{path}", overwrite, uuid.uuid4().hex

    @property
    def _own(self) -> str:
        return f"{store_of(self.path)[1]}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, part, files = store_of(self.path)[0], TaskContext.get().partitionId(), {}
        attempt = uuid.uuid4().hex[:8]
        try:
            for batch in iterator:
                columns = [batch.column(c).to_pylist() for c in ("linktype", "ts_us", "length", "raw")]
                for link, ts_us, length, raw in zip(*columns):
                    if link not in files:
                        store.create_dir(self._own, recursive=True)
                        files[link] = store.open_output_stream(f"{self._own}/{part}-{link}-{attempt}", buffer_size=pcap.PIECE)
                        files[link].write(pcap.file_head(link))
                    files[link].write(pcap.record(ts_us, length, raw))
        finally:
            for f in files.values():
                f.close()
        return Written([(f"{part}-{link}-{attempt}", f"part-{part:05d}-link{link}-{self.job[:8]}.pcap") for link in files])

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.path)
        mine = [f for m in messages if m for f in m.files]
        old = []
        if self.overwrite and store.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
            old = [f.path for f in store.get_file_info(pyarrow.fs.FileSelector(folder)) if f.is_file and f.base_name.startswith("part-")]
        for name, end in mine:
            store.move(f"{self._own}/{name}", f"{folder}/{end}")
        for path in old:
            store.delete_file(path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store = store_of(self.path)[0]
        if store.get_file_info(self._own).type == pyarrow.fs.FileType.Directory:
            store.delete_dir(self._own)


def records(spark: SparkSession, files: list[tuple[str, int]], most: int = 0, range_bytes: int = RANGE) -> DataFrame:
    """The packets of listed() files, all of them reachable."""
    ranges = planned(spark, files, most, range_bytes)
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("ranges", json.dumps([asdict(r) for r in ranges])).load()


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total = hashlib.sha256()
            with opened(path) as file:
                for part in iter(partial(file.read, pcap.PIECE), b""):
                    total.update(part)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (path, path.rsplit("/", 1)[-1], size, total.hexdigest())], names=["path", "filename", "size", "sha256"])


def evidence(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """Name, size and SHA-256 of listed() files, each read as a stream by one task."""
    rows = spark.createDataFrame(files, "path string, size long")
    return rows.repartitionByRange(max(1, len(files)), "path").mapInArrow(digest, "path string, filename string, size long, sha256 string")
