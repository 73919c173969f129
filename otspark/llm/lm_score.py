"""LM scoring with a log-frequency Bloom filter.

Counts of words are exact (one row per word, summed after a sum in each task);
counts of word pairs are of their hashes, summed in each task, packed and dealt to
groups whose number grows with the corpus. A count c is quantised to level
1 + floor(log_B(c)), and a filter holds (n-gram, j) for each j up to that level; a
reader probes j = 1, 2, ... until one is absent. Filters have BITS bits an entry.

A filter of the common n-grams is broadcast: of each order, the levels from the
lowest one that keeps it within FILTER_BYTES. That bound decides only where an
n-gram is probed, not whether. Every group of pairs also has a filter of its own of
all its pairs, seen once or often, which stays in a table: the probes that the
broadcast filter leaves open are dealt to the groups and answered there. Rare words
outside the broadcast filter get their counts by joins. So texts have the same model
at every size, and what is broadcast has a fixed bound.

Base score: add-one unigrams with exact counts. The commonest words (HEAD of them
at most) are broadcast with their counts; all other words of the texts are joined
with the counts by a shuffle.

Model: with c~ the count that a level stands for, D the absolute discount
n1/(n1+2n2), p(w) = (c~(w)-D)/N for words of the training texts and D V/N for any
other, and P(w|u) = f c~(u,w)/c~(u) + (1-f) p(w), f the share of pair tokens of the
training texts whose pair is seen more than once.

Cases: null and empty texts are one end token; without training texts N and V
are 0 and both scores 0; repeated rows have equal scores; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otspark.llm.common import crc_mod, lean, lean_group, text_of, written

#: Base of the count levels, bits an entry, probes an entry.
BASE, BITS, PROBES = 1.5, 14, 7
#: Most bytes of the broadcast filters: of words, of pairs.
FILTER_BYTES = (40_000_000, 16_000_000)
#: Pieces that a filter is built in.
PIECES = 64
#: Words that are broadcast with their exact counts, at most.
HEAD = 600_000
#: Pair tokens of a group.
GROUP = 3_000_000
#: Pair tokens that a task sums at a time.
FLUSH = 1_000_000
#: What a writer of spilled rows holds before it reaches the disk.
ROW_GROUP = {"parquet.block.size": 16 << 20}
#: Words that a worker remembers; beyond that it starts afresh.
REMEMBERED = 150_000
#: Probes that are answered at a time.
PROBES_AT_ONCE = 200_000
#: Characters of text that are scored at a time.
CHARS = 500_000

START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(u * np.uint64(0x9E3779B97F4A7C15) + mixed(w))


def level(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(c, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def estimate(j: np.ndarray) -> np.ndarray:
    """Count that a level stands for; 0 for none."""
    low = np.ceil(BASE ** (np.maximum(j, 1) - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** np.maximum(j, 1.0) - 1e-9) - 1)
    return np.where(j > 0, (low + high) / 2, 0.0)


#: estimate() of every level that there is.
ESTIMATES = estimate(np.arange(112))


def keyed(x: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each pair hash, and 32 further bits that tell the pairs of a group apart (about one in 10^4 falls together with another)."""
    with np.errstate(over="ignore"):
        return (x % np.uint64(groups)).astype(np.int64), (x // np.uint64(groups)).astype(np.uint32)


def spread(g: np.ndarray | int, r: np.ndarray) -> np.ndarray:
    """One 64-bit number for a group and its 32 bits."""
    with np.errstate(over="ignore"):
        return mixed(np.asarray(g).astype(np.uint64) * np.uint64(1 << 32) + r.astype(np.uint64))


class Filter:
    """Bits in pieces."""

    def __init__(self, pieces: list[bytes], least: int = 1):
        sizes = [len(p) for p in pieces]
        self.bits = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array(sizes, np.uint64) * np.uint64(8)
        self.start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.uint64) * np.uint64(8)
        self.least = least  # lowest level held

    @staticmethod
    def places(h: np.ndarray, j: int, size: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            a = mixed(h + np.uint64(j) * np.uint64(0xD6E8FEB86659FD93))
            b = (a >> np.uint64(32)) | (a << np.uint64(32)) | np.uint64(1)
            for i in range(PROBES):  # the upper half, scaled to the size (below 2^32): cheaper than a remainder
                yield ((a + np.uint64(i) * b) >> np.uint64(32)) * size >> np.uint64(32)

    def levels(self, h: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Quantised count of each n-gram, by repeated membership probes in its piece; 0 where it isn't held."""
        out = np.zeros(len(h), np.uint8)
        at, j = np.arange(len(h)), self.least
        size, start = self.size[piece], self.start[piece]
        going = size > 0
        at, h, size, start = at[going], h[going], size[going], start[going]
        while len(at) and j < len(ESTIMATES):
            with np.errstate(over="ignore"):
                a = mixed(h + np.uint64(j) * np.uint64(0xD6E8FEB86659FD93))
                b = (a >> np.uint64(32)) | (a << np.uint64(32)) | np.uint64(1)
            held, n, first = None, size, start  # which of these pass the probes so far
            for _ in range(PROBES):
                p = first + ((a >> np.uint64(32)) * n >> np.uint64(32))
                in_ = np.flatnonzero((self.bits[(p >> np.uint64(3)).view(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1)
                if len(in_) < len(a):
                    held = in_ if held is None else held[in_]
                    n, first, a, b = n[in_], first[in_], a[in_], b[in_]
                with np.errstate(over="ignore"):
                    a = a + b
            if held is not None:
                at, h, size, start = at[held], h[held], n, first
            out[at] = j
            j += 1
        return out


def piece_bits(h: np.ndarray, c: np.ndarray, least: int) -> bytes:
    """The bits of a piece that holds these n-grams with their counts."""
    q = level(c)
    h, q = h[q >= least], q[q >= least]
    if not len(h):
        return b""
    size = max(1, -(-int((q - least + 1).sum()) * BITS // 8))
    bits = np.zeros(size * 8, bool)
    for j in range(least, int(q.max()) + 1):
        for p in Filter.places(h[q >= j], j, np.uint64(size * 8)):
            bits[p.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def word_counts(train: DataFrame) -> DataFrame:
    """word, c: exact counts over the training texts (column text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                held.update(words_of(t.as_py()))
                if len(held) > 200_000:
                    yield from frames(held)
                    held.clear()
        yield from frames(held)

    def frames(held: Counter) -> Iterator[pa.RecordBatch]:
        words, counts = list(held), list(held.values())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()).cast(pa.string()), pa.array(counts[at : at + 50_000], pa.int64())], ["word", "c"])

    return train.select("text").mapInArrow(lean(count), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Hashes(dict):
    """Hash of each word, kept."""

    def __missing__(self, w: bytes) -> int:
        self[w] = h = xxhash.xxh64_intdigest(w, 42)
        return h


def summed(h: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and their counts."""
    if c is None:
        h = np.sort(h)
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        return h[first], np.diff(np.append(first, len(h)))
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(first) else c


def packed(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> pd.DataFrame:
    """A row for each group: its hashes and counts as bytes."""
    order = np.argsort(g, kind="stable")
    g, h, c = g[order], h[order], c[order]
    which, first = np.unique(g, return_index=True)
    cut = np.append(first, len(g))
    return pd.DataFrame({"g": which, "h": [h[a:b].tobytes() for a, b in zip(cut, cut[1:])], "c": [c[a:b].astype(np.uint32).tobytes() for a, b in zip(cut, cut[1:])]}, columns=["g", "h", "c"])


def unpacked(b: pd.DataFrame, kind: type) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(b.h), kind), np.frombuffer(b"".join(b.c), np.uint32).astype(np.int64)


def pair_counts(train: DataFrame, groups: int) -> DataFrame:
    """g, h, c, bits: of each group the packed counts of the pairs that occur twice or more, and the filter of all its pairs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, parts, held = Hashes(), [], 0

        def flush() -> pd.DataFrame:
            x, c = summed(np.concatenate(parts))
            parts.clear()
            g, h = keyed(x, groups)
            return packed(g, h, c)

        for b in batches:
            for t in b.text:
                w = words_of(t)
                h = np.empty(len(w) + 2, np.uint64)
                h[0], h[-1] = START, END
                h[1:-1] = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
                parts.append(pair(h[:-1], h[1:]))
                held += len(w) + 1
                if held > FLUSH:
                    yield flush()
                    held = 0
                if len(known) > REMEMBERED:
                    known.clear()
        if parts:
            yield flush()

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        h, c = summed(*unpacked(b, np.uint32))
        g, more = int(b.g.iloc[0]), c > 1
        return pd.DataFrame({"g": [g], "h": [h[more].tobytes()], "c": [np.minimum(c[more], 2**32 - 1).astype(np.uint32).tobytes()], "bits": [piece_bits(spread(g, h), c, 1)]})

    return train.select("text").mapInPandas(lean(count), "g long, h binary, c binary").groupBy("g").applyInPandas(lean_group(merge), "g long, h binary, c binary, bits binary")


def word_groups(counts: DataFrame) -> DataFrame:
    """The word counts in the packed form; their groups are the pieces of the filter."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = b.h.to_numpy(np.int64).view(np.uint64)
            yield packed((h % np.uint64(PIECES)).astype(np.int64), h, np.minimum(b.c.to_numpy(np.int64), 2**32 - 1))

    return counts.select(F.xxhash64("word").alias("h"), "c").mapInPandas(lean(pack), "g long, h binary, c binary")


def built(entries: DataFrame, kind: type, most: int, lowest: int) -> tuple[Filter, np.ndarray]:
    """The broadcast filter of packed counts (each n-gram in one row), and (level, n-grams, tokens) as it counts them."""

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, c = unpacked(b, kind)
            q = level(c)
            yield pd.DataFrame({"q": np.arange(201), "n": np.bincount(q, minlength=201)[:201], "t": np.bincount(q, c, 201)[:201].astype(np.int64)}).query("n > 0")

    seen = entries.mapInPandas(lean(levels), "q long, n long, t long").groupBy("q").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()
    table = np.array(sorted((r.q, r.n, r.t) for r in seen), np.int64).reshape(-1, 3)
    least = lowest
    while (np.maximum(table[:, 0] - least + 1, 0) * table[:, 1]).sum() * BITS > 8 * most:
        least += 1

    def piece(b: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([spread(g, np.frombuffer(x, kind)) if kind is np.uint32 else np.frombuffer(x, kind) for g, x in zip(b.g, b.h)])
        return pd.DataFrame({"piece": [int(b.piece.iloc[0])], "bits": [piece_bits(h, unpacked(b, kind)[1], least)]})

    def fitting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Leaves out, before the shuffle, what is below the lowest level."""
        for b in batches:
            rows = []
            for g, h, c in zip(b.g, b.h, b.c):
                c2 = np.frombuffer(c, np.uint32)
                ok = level(c2) >= least
                rows.append((g % PIECES, g, np.frombuffer(h, kind)[ok].tobytes(), c2[ok].tobytes()))
            yield pd.DataFrame(rows, columns=["piece", "g", "h", "c"])

    pieces = {r.piece: bytes(r.bits) for r in entries.mapInPandas(lean(fitting), "piece long, g long, h binary, c binary").groupBy("piece").applyInPandas(lean_group(piece), "piece long, bits binary").collect()}
    return Filter([pieces.get(i, b"") for i in range(PIECES)], least), table


class Model:
    """The numbers of the model."""

    def __init__(self, n: int, v: int, texts: int, discount: float, share: float):
        self.n, self.v, self.texts, self.discount, self.share = n, v, texts, discount, share

    def logs(self, qu: np.ndarray, qw: np.ndarray, both: np.ndarray | int) -> np.ndarray:
        """log10 P(w|u) from the levels of u, w and (u, w)."""
        c, cu = ESTIMATES[qw], ESTIMATES[qu]
        p = np.where(c > 0, np.maximum(c - self.discount, 1e-3), self.discount * self.v) / self.n
        seen = np.minimum(ESTIMATES[both], np.minimum(c, cu))
        return np.log10(np.minimum(np.where(cu > 0, self.share * seen / np.maximum(cu, 1) + (1 - self.share) * p, p), 1.0))


class Scorer:
    """What the workers need: the numbers, both broadcast filters, and hashes and counts of the head of the vocabulary."""

    def __init__(self, model: Model, words: Filter, pairs: Filter, groups: int, head: np.ndarray, head_counts: np.ndarray):
        self.model, self.words, self.pairs, self.groups, self.head, self.head_counts = model, words, pairs, groups, head, head_counts


class Vocabulary(dict):
    """Row of each word in growing arrays: its hash, level, log10 of exact count + 1 (NaN outside the head)."""

    def __init__(self, s: Scorer):
        self.s, self.fresh = s, []
        self.h = np.array([START, END], np.uint64)
        self.q = np.full(2, level(np.array(s.model.texts)) if s.model.texts else 0, np.uint8)
        self.exact = np.array([np.nan, math.log10(s.model.texts + 1)])
        self.count = 2

    def __missing__(self, w: bytes) -> int:
        self[w] = i = self.count
        self.count += 1
        self.fresh.append(w)
        return i

    def settle(self) -> None:
        if self.fresh:
            h = np.array(list(map(xxhash.xxh64_intdigest, self.fresh, repeat(42))), np.uint64)
            self.h = np.concatenate([self.h, h])
            self.q = np.concatenate([self.q, self.s.words.levels(h, (h % np.uint64(PIECES)).astype(np.int64))])
            at = np.minimum(np.searchsorted(self.s.head, h), max(0, len(self.s.head) - 1))
            got = self.s.head[at] == h if len(self.s.head) else np.zeros(len(h), bool)
            exact = np.full(len(h), np.nan)
            exact[got] = np.log10(self.s.head_counts[at[got]] + 1)
            self.exact = np.concatenate([self.exact, exact])
            self.fresh = []


def open_probes(first: np.ndarray, g: np.ndarray, r: np.ndarray, qu: np.ndarray, qw: np.ndarray, doc: np.ndarray) -> pd.DataFrame:
    """A row for each run of texts (named by its first row) and group: the probes that the broadcast filter leaves open, in the order of their texts."""
    order = np.lexsort((doc, g, first))
    first, g, r, qu, qw, doc = first[order], g[order], r[order], qu[order].astype(np.uint8), qw[order].astype(np.uint8), doc[order].astype(np.uint32)
    start = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (first[1:] != first[:-1]))) if len(g) else np.zeros(0, np.int64)
    cut = np.append(start, len(g))
    rows = [(int(g[a]), int(first[a]), r[a:b].tobytes(), qu[a:b].tobytes(), qw[a:b].tobytes(), doc[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
    return pd.DataFrame(rows, columns=["g", "_first", "m_h", "m_u", "m_w", "m_d"])


def filled(df: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """The columns asked for; those that there are not are null."""
    return df.assign(**{c: None for c in names if c not in df})[names]


def scored(texts: list[str], vocab: Vocabulary, first_row: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """For each text: n_tokens, score so far, sums over the head, words outside the head with how often they occur, tokens with
    a word that neither filter nor head tells of; and the open probes."""
    s, m = vocab.s, vocab.s.model
    rows = [list(map(vocab.__getitem__, words_of(t))) for t in texts]
    names = {i: w for w, i in zip(vocab.fresh, range(vocab.count - len(vocab.fresh), vocab.count))}
    vocab.settle()
    sizes = np.array([len(r) + 1 for r in rows], np.int64)
    ends = np.cumsum(sizes)
    at = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)  # 1: the end token
    inner = np.ones(len(at), bool)
    inner[ends - 1] = False
    at[inner] = np.fromiter(chain.from_iterable(rows), np.int64, int(inner.sum()))
    before = np.concatenate([[0], at[:-1]])
    before[ends[:-1]] = 0  # 0: the start
    doc = np.repeat(np.arange(len(texts)), sizes)
    unsure = np.zeros(len(at), bool)
    probes = pd.DataFrame(columns=["g", "_first", "m_h", "m_u", "m_w", "m_d"])
    logs = np.zeros(len(at))
    if m.n:
        qu, qw = vocab.q[before], vocab.q[at]
        unsure = ((qu == 0) | (qw == 0)) if s.words.least > 1 else unsure
        here = np.flatnonzero((qu > 0) & (qw > 0) & ~unsure)
        once, back = np.unique(before[here] * np.int64(vocab.count) + at[here], return_inverse=True)  # each pair is probed once
        g, r = keyed(pair(vocab.h[once // vocab.count], vocab.h[once % vocab.count]), s.groups)
        both = np.zeros(len(at), np.uint8)
        both[here] = s.pairs.levels(spread(g, r), g % PIECES)[back]
        g, r = g[back], r[back]
        logs = np.where(unsure, 0.0, m.logs(qu, qw, both))
        left = both[here] == 0
        where = here[left]
        probes = open_probes(np.full(len(where), first_row), g[left], r[left], qu[where], qw[where], doc[where])
    exact = vocab.exact[at]
    head = ~np.isnan(exact)
    out = pd.DataFrame({"n_tokens": sizes, "score": np.bincount(doc, logs, len(texts)), "head_sum": np.bincount(doc[head], exact[head], len(texts)), "head_known": np.bincount(doc[head], exact[head] > 0, len(texts)).astype(np.int64)})
    rest = np.flatnonzero(~head)
    where, times = np.unique(doc[rest] * np.int64(vocab.count) + at[rest], return_counts=True)
    whose, which = where // vocab.count, where % vocab.count
    cut = np.searchsorted(whose, np.arange(len(texts) + 1))
    need = set(which.tolist()) - names.keys()
    if need:
        names.update((i, w) for w, i in vocab.items() if i in need)
    tails = [names[i].decode("utf-8", "replace") for i in which.tolist()]
    out["words"] = [tails[a:b] for a, b in zip(cut, cut[1:])]
    out["times"] = [times[a:b] for a, b in zip(cut, cut[1:])]
    rare = np.flatnonzero(unsure)
    cut = np.searchsorted(doc[rare], np.arange(len(texts) + 1))
    for name, of in (("rare_u", before), ("rare_w", at)):
        h = vocab.h[of[rare]].view(np.int64)
        out[name] = [h[a:b] for a, b in zip(cut, cut[1:])]
    return out, probes


def corrections(asked: DataFrame, pairs: DataFrame, model: Model) -> DataFrame:
    """_first, d, v: what the pairs of the open probes add to the scores of texts (packed: number of the text after _first, value).

    Filters and probes of a group stand one after the other in a sorted stream: a task holds one filter at a time.
    """
    asked = asked.select("g", F.lit(1).alias("kind"), "_first", "m_h", "m_u", "m_w", "m_d", F.lit(None).cast("binary").alias("bits"))
    null = F.lit(None).cast("binary")
    filters = pairs.select("g", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("_first"), null.alias("m_h"), null.alias("m_u"), null.alias("m_w"), null.alias("m_d"), "bits")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, of = None, -1
        for b in batches:
            packs: list[tuple] = []
            out: list[pd.DataFrame] = []
            n = 0

            def settle() -> None:
                """Answers the packs that wait, all of one group."""
                nonlocal n
                if packs:
                    r, qu, qw, doc = (np.frombuffer(b"".join(p[i] for p in packs), k) for i, k in ((1, np.uint32), (2, np.uint8), (3, np.uint8), (4, np.uint32)))
                    which = np.repeat(np.arange(len(packs)), [len(p[2]) for p in packs])
                    both = held.levels(spread(of, r), np.zeros(len(r), np.int64))
                    seen = np.flatnonzero(both)
                    gain = model.logs(qu[seen], qw[seen], both[seen]) - model.logs(qu[seen], qw[seen], 0)
                    place, back = np.unique(which[seen] << 32 | doc[seen].astype(np.int64), return_inverse=True)
                    total, docs = np.bincount(back, gain, len(place)).astype(np.float32), (place & 0xFFFFFFFF).astype(np.uint32)
                    cut = np.searchsorted(place >> 32, np.arange(len(packs) + 1))
                    out.append(pd.DataFrame([(p[0], of, docs[i:j].tobytes(), total[i:j].tobytes()) for p, i, j in zip(packs, cut, cut[1:])], columns=["_first", "g", "d", "v"]))
                packs.clear()
                n = 0

            for g, kind, first, h, u, w, d, bits in b.itertuples(index=False):
                if g != of or n > PROBES_AT_ONCE:
                    settle()
                if kind == 0:
                    held, of = Filter([bits]), g
                elif of == g:
                    packs.append((int(first), h, u, w, d))
                    n += len(u)
            settle()
            yield pd.concat(out) if out else pd.DataFrame(columns=["_first", "g", "d", "v"])

    return asked.unionByName(filters).repartition("g").sortWithinPartitions("g", "kind").mapInPandas(lean(answer), "_first long, g long, d binary, v binary")


def added(b: pd.DataFrame) -> pd.DataFrame:
    """Sums for each text of a run of texts."""
    b = b.sort_values(["g", "d"])
    doc = np.frombuffer(b"".join(b.d), np.uint32).astype(np.int64)
    docs, back = np.unique(doc, return_inverse=True)
    return pd.DataFrame({"_row": docs + int(b._first.iloc[0]), "more": np.bincount(back, np.frombuffer(b"".join(b.v), np.float32).astype(float), len(docs))})


def rare_tokens(first: DataFrame, counts: DataFrame, groups: int, model: Model) -> DataFrame:
    """Tokens with a word outside the broadcast filter: their words' levels by joins, the score without the pair, and the open probe."""
    tokens = first.where("size(rare_u) > 0").select("_row", "_first", F.explode(F.arrays_zip("rare_u", "rare_w")).alias("_t")).select("_row", "_first", F.col("_t.rare_u").alias("u"), F.col("_t.rare_w").alias("w"))
    known = counts.select(F.xxhash64("word").alias("h"), "c").groupBy("h").agg(F.max("c").alias("c"))
    ends = {int(x.view(np.int64)): model.texts for x in (START, END)}
    for side in ("u", "w"):
        tokens = tokens.join(known.select(F.col("h").alias(side), F.col("c").alias("c" + side)), side, "left")
        fixed = F.when(F.col(side).isin(list(ends)), model.texts)
        tokens = tokens.withColumn("c" + side, F.coalesce(fixed, "c" + side, F.lit(0)).cast("long"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            qu, qw = (np.where(c > 0, level(c), 0).astype(np.uint8) for c in (b.cu.to_numpy(np.int64), b.cw.to_numpy(np.int64)))
            yield filled(pd.DataFrame({"_row": b._row, "more": model.logs(qu, qw, 0)}), names)
            here = np.flatnonzero((qu > 0) & (qw > 0))
            if len(here):
                g, r = keyed(pair(b.u.to_numpy(np.int64)[here].view(np.uint64), b.w.to_numpy(np.int64)[here].view(np.uint64)), groups)
                row, run = b._row.to_numpy(np.int64)[here], b._first.to_numpy(np.int64)[here]
                yield filled(open_probes(run, g, r, qu[here], qw[here], row - run), names)

    schema = "_row long, more double, g long, _first long, m_h binary, m_u binary, m_w binary, m_d binary"
    names = [x.split()[0] for x in schema.split(", ")]
    return tokens.repartition("_first").sortWithinPartitions("_first", "_row").mapInPandas(lean(settle), schema)


def lm_scores(docs: DataFrame, train: Column | None = None, *, text_col: str = "text", id_col: str = "doc_id", filter_bytes: tuple[int, int] = FILTER_BYTES, head_words: int = HEAD, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where `train` holds: by default those whose crc32 of the id's text mod 7 is not 2.
    """
    spark = docs.sparkSession
    held_out = crc_mod(docs[id_col], 7) == 2 if train is None else ~F.coalesce(train, F.lit(False))
    rows = docs.select(docs[id_col].alias("doc_id"), held_out.alias("held_out"), text_of(docs, text_col).alias("text"))
    learn = rows.where("not held_out")
    counts = written(word_counts(learn))
    stat = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("n1"), F.count(F.when(F.col("c") == 2, 1)).alias("n2")).first()
    texts = learn.count()
    n, v = int(stat.n) + texts, int(stat.v) + (texts > 0)
    groups = PIECES * max(1, -(-n // (group * PIECES)))
    words, _ = built(word_groups(counts), np.uint64, filter_bytes[0], 1)
    pair_table = written(pair_counts(learn, groups), **ROW_GROUP)
    pairs, held = built(pair_table.select("g", "h", "c"), np.uint32, filter_bytes[1], 2)
    share = float(held[:, 2].sum()) / n if n else 0.0
    # the head: words at or above the lowest power of two that leaves at most head_words of them
    by = counts.groupBy(F.floor(F.log2("c")).alias("k")).count().collect()
    least, total = 63, 0
    for r in sorted(by, key=lambda r: -r.k):
        if total + r["count"] > head_words:
            break
        least, total = int(r.k), total + r["count"]
    common = counts.where(F.col("c") >= F.lit(1 << least)).select(F.xxhash64("word").alias("h"), "c").mapInPandas(lambda bs: (pd.DataFrame({"h": [b.h.to_numpy(np.int64).tobytes()], "c": [b.c.to_numpy(np.int64).tobytes()]}) for b in bs), "h binary, c binary").collect() if total else []
    head, head_counts = np.frombuffer(b"".join(bytes(r.h) for r in common), np.uint64), np.frombuffer(b"".join(bytes(r.c) for r in common), np.int64)
    order = np.argsort(head)
    discount = stat.n1 / (stat.n1 + 2 * stat.n2) if stat.n1 else 0.5
    model = Model(n, v, texts, discount, min(0.9, max(0.01, share)))
    shared = spark.sparkContext.broadcast(Scorer(model, words, pairs, groups, head[order], head_counts[order]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = Vocabulary(shared.value)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            at, size = 0, 0
            sizes = b.text.str.len().tolist()
            for i, k in enumerate(sizes):
                size += k
                if size > CHARS or i == len(sizes) - 1:
                    part = b.iloc[at : i + 1].reset_index(drop=True)
                    if vocab.count > REMEMBERED:
                        vocab = Vocabulary(shared.value)
                    out, probes = scored(part.text.tolist(), vocab, row)
                    ids = pd.DataFrame({"_row": np.arange(row, row + len(part)), "_first": row})
                    yield filled(pd.concat([ids, part[["doc_id", "held_out"]], out], axis=1), names)
                    for k in range(0, len(probes), 64):
                        yield filled(probes.iloc[k : k + 64], names)
                    at, size, row = i + 1, 0, row + len(part)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"_row long, _first long, doc_id {id_type}, held_out boolean, n_tokens long, score double, head_sum double, head_known long, words array<string>, times array<long>, rare_u array<long>, rare_w array<long>, g long, m_h binary, m_u binary, m_w binary, m_d binary"
    names = [x.split()[0] for x in schema.split(", ")]
    both = written(rows.mapInPandas(lean(score), schema), **ROW_GROUP)
    first = both.where("_row is not null")
    tail = first.where("size(words) > 0").select("_row", F.explode(F.arrays_zip("words", "times")).alias("_t")).select("_row", F.col("_t.words").alias("word"), F.col("_t.times").alias("times"))
    tail = tail.join(counts, "word").groupBy("_row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("tail_sum"), F.sum("times").alias("tail_known"))
    packs = ["g", "_first", "m_h", "m_u", "m_w", "m_d"]
    asked = both.where("g is not null").select(packs)
    more = None
    if words.least > 1:  # else the filter holds every word, and no token has a word that it can't tell of
        rare = written(rare_tokens(first, counts, groups, model), **ROW_GROUP)
        asked = asked.unionByName(rare.where("g is not null").select(packs))
        more = rare.where("g is null").select("_row", "more")
    gains = corrections(asked, pair_table, model).groupBy("_first").applyInPandas(added, "_row long, more double")
    more = gains if more is None else gains.unionByName(more)
    more = more.groupBy("_row").agg(F.sum("more").alias("more"))
    out = first.drop("words", "times", "rare_u", "rare_w", *packs).join(tail, "_row", "left").join(more, "_row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce(F.col("tail_known"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce(F.col("tail_sum"), F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("more"), F.lit(0.0))).alias("score"),
    )
