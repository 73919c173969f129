"""FLAC media columns: texts stored as 8-bit samples, decoded into seekable PCM blocks.

The decoder reads STREAMINFO, checks the CRC-8 of each frame header, the CRC-16
of each frame and the MD5 of all samples, and undoes constant, verbatim, fixed and
linear (LPC) predictors with Rice-coded residuals, wasted bits and stereo
decorrelation. A residual's codes follow one another: the jump from each set bit
to the next code's stop bit is an array, and starts come from composing it, so
that nothing runs per sample in Python but the recursion of general LPC.

The encoder writes one channel of 8-bit samples in blocks of BLOCK, with the
best of constant, verbatim and fixed predictors (or a given linear one).

Cases: null and empty texts become 64 zero bytes; a payload's length is a
positive multiple of 64; damaged or cut media raise FlacError; repeated rows
give equal values; an empty table gives an empty result; null media give no
blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otspark.llm.common import text_of

BLOCK = 4096
RATE = 8000


class FlacError(ValueError):
    """The bytes are no intact FLAC stream."""


@cache
def _crc_step(width: int, poly: int) -> np.ndarray:
    """CRC of each single byte."""
    out = []
    for b in range(256):
        c = b << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (width - 1) else c << 1) & ((1 << width) - 1)
        out.append(c)
    return np.array(out, np.uint16)


@cache
def _crc16_far() -> tuple[np.ndarray, np.ndarray]:
    """What each byte adds to the CRC-16 when i bytes follow it (CRCs without an initial value are linear), row by row; and where the rows begin."""
    step = _crc_step(16, 0x8005)
    rows = [step]
    while len(rows) < 8192:
        c = rows[-1]
        rows.append(((c << 8) & 0xFFFF) ^ step[c >> 8])
    return np.concatenate(rows), np.arange(8191, -1, -1) * 256


def crc16(data: bytes) -> int:
    (table, rows), out = _crc16_far(), 0
    for at in range(0, len(data), 8192):
        part = np.frombuffer(data, np.uint8, min(8192, len(data) - at), at)
        if out:  # what came before acts as if added to the next two bytes
            part = part.copy()
            part[0] ^= out >> 8
            if len(part) > 1:
                part[1] ^= out & 255
        carry = (out & 255) << 8 if len(part) == 1 else 0
        out = int(np.bitwise_xor.reduce(table.take(rows[8192 - len(part) :] + part))) ^ carry
    return out


def crc8(data: bytes) -> int:
    step, c = _crc_step(8, 0x07), 0
    for b in data:
        c = int(step[c ^ b])
    return c


# ---- writing ----


def _number(n: int) -> bytes:
    """A frame number in FLAC's form of UTF-8 (up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    k = 2
    while n >> (5 * k + 1):
        k += 1
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(k - 2, -1, -1)]
    return bytes([(0xFF00 >> k) & 0xFF | (n >> (6 * (k - 1))), *tail])


def _bits_of(value: int, width: int) -> np.ndarray:
    return np.array([(value >> i) & 1 for i in range(width - 1, -1, -1)], np.uint8)


def _rice(residual: np.ndarray) -> tuple[int, int]:
    """Best parameter and the bits that the codes take."""
    u = (residual << 1) ^ (residual >> 31)
    n = len(u)
    total = int(u.sum())
    k0 = max(0, (2 * total // (3 * max(n, 1))).bit_length() - 1)
    costs = {k: int((u >> k).sum() if k else total) + n * (1 + k) for k in range(max(0, k0 - 1), min(14, k0 + 1) + 1)}
    k = min(costs, key=costs.get)
    return k, costs[k]


def _rice_bits(residual: np.ndarray, k: int) -> np.ndarray:
    u = (residual << 1) ^ (residual >> 31)
    ends = np.cumsum((u >> k) + (1 + k))
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - (k + 1)
    out[at] = 1
    for j in range(k):
        at += 1
        out[at] = (u >> (k - 1 - j)) & 1
    return out


def predicted(x: np.ndarray, coefs: list[int], shift: int) -> np.ndarray:
    """Residuals of a linear predictor; the first len(coefs) samples are left out."""
    n = len(coefs)
    s = sum(c * x[n - 1 - i : len(x) - 1 - i] for i, c in enumerate(coefs))
    return x[n:] - (s >> shift)


def _subframe(x: np.ndarray, lpc: tuple[list[int], int, int] | None) -> list[np.ndarray]:
    """Bits of the subframe of 8-bit samples; lpc: coefficients, their bits, shift."""
    if (x == x[0]).all():
        return [_bits_of(0, 8), _bits_of(int(x[0]) & 255, 8)]
    if lpc and len(x) > len(lpc[0]):
        coefs, width, shift = lpc
        res, n = predicted(x, coefs, shift), len(coefs)
        k, _ = _rice(res)
        head = [_bits_of(0b01000000 | (n - 1) << 1, 8), *[_bits_of(int(v) & 255, 8) for v in x[:n]], _bits_of(width - 1, 4), _bits_of(shift, 5), *[_bits_of(c & ((1 << width) - 1), width) for c in coefs]]
        return [*head, _bits_of(0, 6), _bits_of(k, 4), _rice_bits(res, k)]
    first = np.diff(x)
    second = np.diff(first)
    order, res = min(enumerate((x, first, second)), key=lambda d: int(np.abs(d[1]).sum()))
    k, bits = _rice(res)
    bits += 8 * order
    if bits + 10 >= 8 * len(x):
        return [_bits_of(0b00000010, 8), np.unpackbits((x & 255).astype(np.uint8))]
    return [_bits_of(0b00010000 | order << 1, 8), *[_bits_of(int(v) & 255, 8) for v in x[:order]], _bits_of(0, 6), _bits_of(k, 4), _rice_bits(res, k)]


def encode(payload: bytes, lpc: tuple[list[int], int, int] | None = None) -> bytes:
    """A FLAC stream of the payload as signed 8-bit samples (byte - 128), one channel."""
    x = (np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8)
    wide, frames = x.astype(np.int32), []
    for number, at in enumerate(range(0, len(x), BLOCK)):
        part = wide[at : at + BLOCK]
        head = b"\xff\xf8\x74\x02" + _number(number) + (len(part) - 1).to_bytes(2, "big")
        head += bytes([crc8(head)])
        body = head + np.packbits(np.concatenate(_subframe(part, lpc))).tobytes()
        frames.append(body + crc16(body).to_bytes(2, "big"))
    sizes = [len(f) for f in frames] or [0]
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(x.tobytes()).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)


# ---- reading ----


class Bits:
    """The bits of a frame, with what finding Rice codes needs."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self._bits = self._count = self._ones = None
        self._jumps: dict[int, list[np.ndarray]] = {}

    def take(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise FlacError("the stream ends within a frame")
        v = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n) & ((1 << n) - 1)
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if v >> (n - 1) else v

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self.data, np.uint8))
        return self._bits

    def many(self, count: int, width: int) -> np.ndarray:
        """Signed numbers of one width."""
        if self.at + count * width > 8 * len(self.data):
            raise FlacError("the stream ends within a frame")
        rows = self.bits[self.at : self.at + count * width].reshape(count, width).astype(np.int64)
        self.at += count * width
        v = rows @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
        return v - (rows[:, 0] << width) if width else v

    def rice(self, count: int, k: int) -> np.ndarray:
        """Residuals of a partition. jumps[j][i]: the set bit that is the stop bit 2**j codes after that at set bit i."""
        if self._ones is None:
            self._ones = np.flatnonzero(self.bits)
            self._count = np.zeros(len(self.bits) + 1, np.int64)
            np.cumsum(self.bits, out=self._count[1:])
        ones, n = self._ones, len(self._ones)
        if not count:
            return np.zeros(0, np.int64)
        if k not in self._jumps:
            jumps = [np.append(self._count.take(ones + (k + 1), mode="clip"), n)]  # n: beyond the last
            for _ in range(4):
                jumps.append(jumps[-1].take(jumps[-1]))
            self._jumps[k] = jumps
        jumps = self._jumps[k]
        i = int(self._count[self.at])
        step, heads = jumps[4].item, []
        for _ in range(-(-count // 16)):
            heads.append(i)
            i = step(i)
        at = np.array(heads)
        for j in (3, 2, 1, 0):
            both = np.empty((len(at), 2), np.int64)
            both[:, 0] = at
            jumps[j].take(at, out=both[:, 1])
            at = both.reshape(-1)
        at = at[:count]
        if at[-1] >= n or int(ones[at[-1]]) + k >= 8 * len(self.data):
            raise FlacError("the stream ends within a residual")
        stop = ones.take(at)
        u = stop.copy()
        u[0] -= self.at
        u[1:] -= stop[:-1] + (1 + k)
        for j in range(1, k + 1):
            u <<= 1
            u |= self.bits.take(stop + j)
        self.at = int(stop[-1]) + 1 + k
        return (u >> 1) ^ -(u & 1)


def _residual(b: Bits, n: int, order: int) -> np.ndarray:
    method, parts = b.take(2), b.take(4)
    if method > 1 or n >> parts << parts != n or (n >> parts) < order:
        raise FlacError("bad residual")
    width, out = 4 + method, []
    for i in range(1 << parts):
        count, k = (n >> parts) - (order if i == 0 else 0), b.take(width)
        if k == (1 << width) - 1:
            raw = b.take(5)
            out.append(b.many(count, raw) if raw else np.zeros(count, np.int64))
        else:
            out.append(b.rice(count, k))
    return np.concatenate(out)


def _restored(b: Bits, n: int, bps: int) -> np.ndarray:
    """Samples of a subframe."""
    if b.take(1):
        raise FlacError("bad subframe")
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = 1
        while not b.take(1):
            wasted += 1
    bps -= wasted
    if kind == 0:
        x = np.full(n, b.signed(bps), np.int64)
    elif kind == 1:
        x = b.many(n, bps)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = np.array([b.signed(bps) for _ in range(order)], np.int64)
        x = _residual(b, n, order)
        for o in range(order, 0, -1):  # sums undo differences, one order at a time
            x = np.diff(warm, o - 1)[-1] + np.cumsum(x)
        x = np.concatenate([warm, x])
    elif kind >= 32:
        order = kind - 31
        x = [b.signed(bps) for _ in range(order)]
        width, shift = b.take(4) + 1, b.take(5)
        coefs = [b.signed(width) for _ in range(order)]
        for r in _residual(b, n, order).tolist():
            x.append(r + (sum(c * v for c, v in zip(coefs, x[: -order - 1 : -1])) >> shift))
        if any(abs(v) >> 40 for v in x):
            raise FlacError("samples out of range")
        x = np.array(x, np.int64)
    else:
        raise FlacError("reserved subframe")
    return x << wasted


def stream_info(data: bytes) -> tuple[dict, int]:
    """STREAMINFO, and where the frames begin."""
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, info = 4, None
    while True:
        if at + 4 > len(data):
            raise FlacError("the stream ends within its metadata")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            v = data[at + 4 : at + 4 + size]
            packed = int.from_bytes(v[10:18], "big")
            info = {"max_block": int.from_bytes(v[2:4], "big"), "max_frame": int.from_bytes(v[7:10], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bps": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": v[18:34]}
        at += 4 + size
        if last:
            break
    if info is None:
        raise FlacError("no STREAMINFO")
    return info, at


def frames(data: bytes, check_md5: bool = True, start: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first sample, first byte, samples by channel) of each frame, checksums verified; from the frame at byte `start` on, with sample numbers from there, if it is given."""
    info, at = stream_info(data)
    if start is not None:
        at, check_md5 = start, False
    sizes = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
    widths = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
    md5, done = hashlib.md5(), 0
    while at < len(data):
        most = info["max_frame"] or 64 + 2 * info["max_block"] * info["channels"] * (info["bps"] + 1) // 8
        b = Bits(data[at : at + most])
        if b.take(15) != 0x7FFC:
            raise FlacError("no frame where one should be")
        b.take(1)
        size, rate, channels, width = b.take(4), b.take(4), b.take(4), b.take(3)
        b.take(1)
        lead = b.take(8)
        while lead & 0xC0 == 0xC0:
            b.take(8)
            lead = (lead << 1) & 0xFF
        n = b.take(8) + 1 if size == 6 else b.take(16) + 1 if size == 7 else sizes.get(size)
        b.take(8 if rate == 12 else 16 if rate in (13, 14) else 0)
        bps = widths.get(width, info["bps"])
        if n is None or crc8(b.data[: b.at >> 3]) != b.take(8):
            raise FlacError("a frame header's checksum is wrong")
        if channels < 8:
            x = [_restored(b, n, bps) for _ in range(channels + 1)]
        else:
            x = [_restored(b, n, bps + (channels == 9)), _restored(b, n, bps + (channels != 9))]
            if channels == 8:
                x[1] = x[0] - x[1]
            elif channels == 9:
                x[0] = x[0] + x[1]
            else:
                mid = (x[0] << 1) | (x[1] & 1)
                x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
        end = (b.at + 7) >> 3
        if end + 2 > len(b.data) or crc16(b.data[:end]) != int.from_bytes(b.data[end : end + 2], "big"):
            raise FlacError("a frame's checksum is wrong")
        samples = np.stack(x)
        if check_md5:
            md5.update(pcm_of(samples, bps))
        yield done, at, samples
        done += n
        at += end + 2
    if start is None and info["samples"] and done != info["samples"] or check_md5 and any(info["md5"]) and md5.digest() != info["md5"]:
        raise FlacError("the samples are not those that were stored")


def pcm_of(samples: np.ndarray, bps: int) -> bytes:
    """Interleaved little-endian PCM."""
    width = (bps + 7) // 8
    return samples.T.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :width].tobytes() if width != 1 else samples.T.astype(np.int8).tobytes()


def decode_payload(data: bytes) -> tuple[bytes, int]:
    """The bytes that encode() stored, and the number of frames."""
    parts = [x[0].astype(np.int8) for _, _, x in frames(data)]
    return (np.concatenate(parts).view(np.uint8) ^ 0x80).tobytes() if parts else b"", len(parts)


# ---- on tables ----


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def media(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, media: each text's payload as a FLAC stream."""

    @F.pandas_udf("binary")
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([encode(payload_of(t)) for t in texts], dtype=object)

    return docs.select(docs[id_col].alias("doc_id"), stored(text_of(docs, text_col)).alias("media"))


def pcm_blocks(df: DataFrame, *, media_col: str = "media", id_col: str = "doc_id", beside: tuple[str, ...] = ()) -> DataFrame:
    """One row per frame, those of a row one after the other: doc_id, block, last, sample_offset, byte_offset, n_samples, channels, bits, rate, pcm; columns to keep beside them."""
    kept = [df.schema[c] for c in (id_col, *beside)]
    names = ["doc_id", *beside, "block", "last", "sample_offset", "byte_offset", "n_samples", "channels", "bits", "rate", "pcm"]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, held = [], 0
            for *key, data in b.itertuples(index=False):
                if data is None:
                    continue
                data = bytes(data)
                info, _ = stream_info(data)
                found = frames(data)
                now, i = next(found, None), 0
                while now is not None:
                    (first, at, x), now = now, next(found, None)
                    rows.append((*key, i, now is None, first, at, x.shape[1], x.shape[0], info["bps"], info["rate"], pcm_of(x, info["bps"])))
                    i, held = i + 1, held + len(rows[-1][-1])
                    if held >= 4_000_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, kept))
    return df.select(id_col, *beside, media_col).mapInPandas(blocks, schema + ", block long, last boolean, sample_offset long, byte_offset long, n_samples long, channels int, bits int, rate int, pcm binary")


class Feature:
    """Frames, sum, sum of squares and sign changes of 8-bit samples that come block by block."""

    def __init__(self):
        self.frames = self.sum = self.squares = self.crossings = 0
        self.before: int | None = None

    def add(self, samples: np.ndarray) -> None:
        x, low = samples.astype(np.int64), samples < 0
        self.frames += 1
        self.sum += int(x.sum())
        self.squares += int((x * x).sum())
        self.crossings += int((low[1:] != low[:-1]).sum()) + int(self.before is not None and bool(low[0]) != self.before)
        self.before = bool(low[-1])

    def __str__(self) -> str:
        return f"frames={self.frames};sum={self.sum};squares={self.squares};crossings={self.crossings}"


def block_digests(blocks: DataFrame, *, id_type: str) -> DataFrame:
    """One row for each run of blocks from the first to the last: doc_id, n_bytes, media_bytes, media_sha256, and digests of the bytes that their 8-bit samples stand for."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, tail, size, feature = hashlib.sha256(), b"", 0, Feature()
        for b in batches:
            rows = []
            for key, n_bytes, media_bytes, media_sha256, block, last, pcm in b.itertuples(index=False):
                if block == 0:
                    whole, tail, size, feature = hashlib.sha256(), b"", 0, Feature()
                raw = (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()
                whole.update(raw)
                tail, size = (tail + raw)[-64:], size + len(raw)
                feature.add(np.frombuffer(pcm, np.int8))
                if last:
                    rows.append((key, n_bytes, size, whole.hexdigest(), zlib.crc32(tail), media_bytes, media_sha256, str(feature)))
            yield pd.DataFrame(rows, columns=names)

    asked = blocks.select("doc_id", "_n_bytes", "_media_bytes", "_media_sha256", "block", "last", "pcm")
    return asked.mapInPandas(digest, f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digests(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its payload stored as FLAC, read back from the stored bytes block by block, and digests of both.

    The stored column, its PCM blocks and their digests are steps of one task each, without a shuffle: a task holds a batch.
    """

    @F.pandas_udf("binary")
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([encode(payload_of(t)) for t in texts], dtype=object)

    text = text_of(docs, text_col)
    kept = docs.select(docs[id_col].alias("doc_id"), F.octet_length(text).cast("long").alias("_n_bytes"), stored(text).alias("media"))
    kept = kept.select("doc_id", "_n_bytes", F.octet_length("media").cast("long").alias("_media_bytes"), F.sha2("media", 256).alias("_media_sha256"), "media")
    return block_digests(pcm_blocks(kept, beside=("_n_bytes", "_media_bytes", "_media_sha256")), id_type=docs.schema[id_col].dataType.simpleString())
