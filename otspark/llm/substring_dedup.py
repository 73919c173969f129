"""Fuzzy shared passages by collinear chaining of k-mer seeds.

Equal texts are one text, of which each further document is a member: its row names the
document with the smallest id and the whole text. Seeds are k-mers of words, sampled by
minimizers (a run of K + W - 1 equal words always shares one). All pairs of texts that
share a seed of at most MOST texts are compared.

A seed of more texts is frequent. All pairs of its texts are compared around it: blocks of
BLOCK texts meet two by two, each pair of blocks in a task of its own, and a pair of texts
meets the threshold where a stretch of `words` words that the seed stands in has `identity`
of them in equal runs of three or more. Of the pairs that do, a spanning forest of the
likest ones goes on, and all pairs with a third of that and another frequent seed near by
on another diagonal (words put in or left out) that it leaves apart. So two texts that are alike around a frequent seed have one class_id,
be it by way of others. Nothing here depends on how the table is partitioned.

The seeds that two linked texts share, frequent ones too, are merged into segments of one
diagonal and chained with gap costs by a tree of the best chains by position, of which
those too far behind are taken out. Around every chain both texts' words (as 32-bit hashes) are then fetched and aligned:
equal runs on the chain's diagonals, within a margin, are chained in the same
way, and passages of at least `words` words with `identity` of them equal are
given out. class_id is the smallest doc_id that passages and equal texts lead to.

Cases: null, empty and short texts have no seeds; texts of fewer than K words
have no passages; within one text a seed counts where it stands first; rows alike
in id and text are one text; ties go by the order of the hash; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otspark.llm.common import text_of, words_of, written
from otspark.llm.simhash_dedup import components

#: Words of a seed; k-mers of which the smallest hash is a seed.
K, W = 8, 16
#: Words whose seeds a task packs together.
FLUSH = 2_000_000
#: Texts of a share: a seed's texts are gathered within shares, and where they are few there, over all shares.
SHARE = 2_000_000
#: Texts of a seed, at most, of which all pairs are compared as they are; texts of a frequent seed that meet others at a time.
MOST, BLOCK = 12, 8192
#: Words between two segments of a chain, at most; words around a chain that are aligned.
GAP, MARGIN = 48, 64
#: Cost of a word that a chain skips.
SKIP = 0.25
REMEMBERED = 300_000


class Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        self[w] = h = xxhash.xxh64_intdigest(w, 42)
        return h


def hashes_of(text: str, known: Hashes) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+, A-Z in lower case."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(known.__getitem__, w), np.uint64, len(w))


def kmers(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position."""
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + n]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def minimizers(h: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of the seeds of a text's words; a hash counts where it stands first."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = kmers(h, k)
    if len(x) <= w:
        at = np.array([int(x.argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(x, w)
        at = np.unique(np.arange(len(view)) + view.argmin(1))
    v, first = np.unique(x[at], return_index=True)
    return at[first], v


def together(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, known: np.ndarray, most: int) -> tuple[pd.DataFrame, tuple, tuple]:
    """Links of all pairs of texts that share a seed; seeds, texts and positions of the frequent ones and of the others."""
    order = np.lexsort((pos, doc, h))
    h, doc, pos = h[order], doc[order], pos[order]
    if len(h):  # equal texts
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        h, doc, pos = h[new], doc[new], pos[new]
    _, which, size = np.unique(h, return_inverse=True, return_counts=True)
    left = np.cumsum(size)[which] - np.arange(len(h))  # of the seed's texts, this one and those after it
    frequent = (size[which] > most) | np.isin(h, known)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, most):
        a.append(np.flatnonzero(~frequent & (left > d)))
        b.append(a[-1] + d)
    i, j = np.concatenate(a), np.concatenate(b)
    links = pd.DataFrame({"a": doc[i], "b": doc[j], "x": pos[i].astype(np.int32), "y": pos[j].astype(np.int32)})
    return links, (h[frequent], doc[frequent], pos[frequent]), (h[~frequent], doc[~frequent], pos[~frequent])


def seeds(docs: DataFrame, groups: int, shares: int) -> DataFrame:
    """Packed rows: of group g (by the seed's hash) and share s (by the text's) seeds, their texts and positions."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, parts, held = Hashes(), [], 0

        def flush() -> pd.DataFrame:
            h = np.concatenate([p[1] for p in parts])
            pos = np.concatenate([p[0] for p in parts]).astype(np.int32)
            doc = np.concatenate([np.full(len(p[0]), p[2], np.int64) for p in parts])
            parts.clear()
            g = ((h >> np.uint64(20)) % np.uint64(groups)).astype(np.int64) * shares + (doc.view(np.uint64) % np.uint64(shares)).astype(np.int64)
            order = np.argsort(g, kind="stable")
            which, start = np.unique(g[order], return_index=True)
            rows = [(int(k) // shares, int(k) % shares, h[i].tobytes(), doc[i].tobytes(), pos[i].tobytes()) for k, i in zip(which, np.split(order, start[1:])) if len(i)]
            return pd.DataFrame(rows, columns=["g", "s", "h", "doc", "pos"])

        for b in batches:
            for key, text in zip(b._key, b.text):
                h = hashes_of(text, known)
                at, v = minimizers(h)
                if len(at):
                    parts.append((at, v, key))
                held += len(h)
                if held > FLUSH and parts:
                    yield flush()
                    held = 0
                if len(known) > REMEMBERED:
                    known.clear()
        if parts:
            yield flush()

    return docs.select("_key", "text").mapInPandas(find, "g long, s long, h binary, doc binary, pos binary")


#: Kinds of rows: a link, a text of a frequent seed, a text that waits for those of other shares, a seed that one share finds frequent.
LINK, FREQUENT, WAITING, NAMED = range(4)


def linked(found: DataFrame, shares: int, most: int) -> DataFrame:
    """kind, a, b, x, y, h: links (a, b, x, y), and texts (a) of frequent seeds (h) with their positions (x)."""
    links = "kind int, a long, b long, x int, y int, h long"

    def rows(kind: int, h: np.ndarray, doc: np.ndarray, pos: np.ndarray, g: int) -> pd.DataFrame:
        return pd.DataFrame({"kind": kind, "a": doc, "b": 0, "x": pos.astype(np.int32), "y": np.int32(0), "h": h.view(np.int64), "g": g})

    def within(b: pd.DataFrame) -> pd.DataFrame:
        h, doc, pos = np.frombuffer(b"".join(b.h), np.uint64), np.frombuffer(b"".join(b.doc), np.int64), np.frombuffer(b"".join(b.pos), np.int32)
        g = int(b.g.iloc[0])
        out, frequent, others = together(h, doc, pos, np.zeros(0, np.uint64), most)
        if shares == 1:
            return pd.concat([out.assign(kind=LINK, h=0, g=g)[names], rows(FREQUENT, *frequent, g)[names]])
        seen = np.unique(frequent[0])
        none = np.zeros(len(seen), np.int64)
        return pd.concat([rows(FREQUENT, *frequent, g), rows(WAITING, *others, g), rows(NAMED, seen, none, none, g)])[names]

    def between(b: pd.DataFrame) -> pd.DataFrame:
        kind, h = b.kind.to_numpy(), b.h.to_numpy(np.int64).view(np.uint64)
        w = kind == WAITING
        out, frequent, _ = together(h[w], b.a.to_numpy(np.int64)[w], b.x.to_numpy(np.int32)[w], h[kind == NAMED], most)
        return pd.concat([out.assign(kind=LINK, h=0)[names[:-1]], rows(FREQUENT, *frequent, 0)[names[:-1]]])

    names = ["kind", "a", "b", "x", "y", "h", "g"]
    first = written(found.groupBy("g", "s").applyInPandas(within, links + ", g long"))
    if shares == 1:
        return first.drop("g")
    rest = first.where(F.col("kind").isin(WAITING, NAMED)).groupBy("g").applyInPandas(between, links)
    return first.where(F.col("kind") == FREQUENT).drop("g").unionByName(written(rest))


def agreement(u: np.ndarray, v: np.ndarray, span: int, tile: int = 256) -> np.ndarray:
    """For each row of u and of v the most words in equal runs of three or more, position by position, of a stretch of `span`."""
    out = np.zeros((len(u), len(v)), np.uint8 if span < 256 else np.uint16)
    n = u.shape[1]
    for i in range(0, len(u), tile):
        for j in range(0, len(v), tile):
            if u is v and j < i:
                out[i : i + tile, j : j + tile] = out[j : j + tile, i : i + tile].T
                continue
            x, y = np.where(u[i : i + tile] == 0, 1, u[i : i + tile]).T[:, :, None], v[j : j + tile].T[:, None, :]  # 0: no word
            now = np.zeros((x.shape[1], y.shape[2]), out.dtype)
            most = out[i : i + tile, j : j + tile].copy()
            nothing = np.zeros(now.shape, np.uint8)
            same = [(x[k] == y[k]).view(np.uint8) for k in range(2)]
            three, runs = [nothing, nothing], []
            for k in range(n):
                same.append((x[k + 2] == y[k + 2]).view(np.uint8) if k + 2 < n else nothing)
                new = same[0] & same[1]
                new &= same[2]
                three.append(new)
                run = three[0] | three[1]
                run |= new
                runs.append(run)
                del same[0], three[0]
                now += run
                if len(runs) > span:
                    now -= runs.pop(0)
                np.maximum(most, now, out=most)
            out[i : i + tile, j : j + tile] = most
    return out


def forest(likeness: np.ndarray, same: bool, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the likest pairs with at least `least`, by Prim; columns are the rows again, or numbered on after them."""
    p, q = likeness.shape
    if same:
        likeness[np.arange(p), np.arange(p)] = 0
    n, links = p if same else p + q, []
    able = likeness.max(1) >= least
    waiting = able if same else np.concatenate([able, likeness.max(0) >= least])
    best, back = np.where(waiting, 0, -1).astype(np.int32), np.full(n, -1)
    for _ in range(int(waiting.sum())):
        i = int(best.argmax())
        if best[i] >= least:
            links.append((int(back[i]), i))
        best[i] = -1
        near, at = (likeness[i], 0) if same else (likeness[i], p) if i < p else (likeness[:, i - p], 0)
        of = best[at : at + len(near)]
        more = np.flatnonzero((near > of) & (of >= 0))
        of[more] = near[more]
        back[at + more] = i
    return links


def shifted(likeness: np.ndarray, one: pd.DataFrame, two: pd.DataFrame, same: bool, links: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Pairs that the forest leaves apart and that have another frequent seed near by on another diagonal: words put in or left out between them."""
    p, n = len(one), len(one) + (0 if same else len(two))
    if n == 0:
        return []
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in links:
        root[top(a)] = top(b)
    tree = np.array([top(i) for i in range(n)])

    def others(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = [np.frombuffer(x, np.int64) for x in f.others]
        return np.concatenate(h), np.concatenate([np.frombuffer(x, np.int64) for x in f.away]), np.repeat(np.arange(len(f)), list(map(len, h)))

    (g, away, i), (g2, away2, j) = others(one), others(two)
    order, order2 = np.argsort(g, kind="stable"), np.argsort(g2, kind="stable")
    found = [np.zeros(0, np.int64)]
    for h in np.intersect1d(g, g2):
        x, y = (o[np.searchsorted(of, h, "left", o) : np.searchsorted(of, h, "right", o)] for of, o in ((g, order), (g2, order2)))
        if away[x].min() == away2[y].max() and away[x].max() == away2[y].min():
            continue
        for part in np.array_split(x, -(-len(x) // 1024)):
            r, c = np.nonzero((away[part][:, None] != away2[y]) & (tree[i[part]][:, None] != tree[j[y] + (0 if same else p)]) & (likeness[i[part]][:, j[y]] >= least))
            a, b = i[part][r], j[y][c]
            found.append(np.unique(np.minimum(a, b) * np.int64(n) + np.maximum(a, b) if same else a * np.int64(n) + b + p))
    return [(int(k) // n, int(k) % n) for k in np.unique(np.concatenate(found))]


def alike(frequent: DataFrame, rows: DataFrame, keyed: DataFrame, words: int, identity: float, block: int) -> DataFrame:
    """a, b: pairs of texts that meet the threshold around a frequent seed (h, doc, pos), as spanning forests of pairs of blocks."""
    wide = 2 * words + K
    of_text = frequent.groupBy("doc").agg(F.collect_list(F.struct("h", "pos")).alias("at"))
    texts = of_text.join(keyed.select(F.col("_key").alias("doc"), "rid"), "doc").join(rows.select("rid", "text"), "rid").select("doc", "text", "at")

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, none = Hashes(), np.zeros(words, np.uint32)
        for b in batches:
            out = []
            for doc, text, at in b.itertuples(index=False):
                w = np.concatenate([none, hashes_of(text, known).astype(np.uint32), none])
                h, pos = np.array([r["h"] for r in at], np.int64), np.array([r["pos"] for r in at], np.int64)
                for k, x in zip(h.tolist(), pos.tolist()):
                    by = (np.abs(pos - x) <= words + GAP) & (pos != x)
                    out.append((k, doc, w[x : x + wide].tobytes(), h[by].tobytes(), (pos[by] - x).tobytes()))
            if len(known) > REMEMBERED:
                known.clear()
            yield pd.DataFrame(out, columns=["h", "doc", "near", "others", "away"])

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("doc").sort_values("doc")  # rows alike in id and text
        same = bool(b.i.iloc[0] == b.j.iloc[0])
        one, two = b[b.block == b.i], b[b.block == b.j]
        u = np.frombuffer(b"".join(one.near), np.uint32).reshape(len(one), wide)
        v = u if same else np.frombuffer(b"".join(two.near), np.uint32).reshape(len(two), wide)
        if not len(u) or not len(v):
            return pd.DataFrame(columns=["a", "b"])
        docs = one.doc.to_numpy() if same else np.concatenate([one.doc.to_numpy(), two.doc.to_numpy()])
        likeness, least = agreement(u, v, words), math.ceil(identity * words - 1e-9)
        links = forest(likeness, same, least)
        links += shifted(likeness, one, one if same else two, same, links, -(-least // 3))
        at = np.array(links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": docs[at[:, 0]], "b": docs[at[:, 1]]})

    sizes = frequent.groupBy("h").agg(F.ceil(F.count("*") / block).alias("blocks"))
    near = texts.mapInPandas(around, "h long, doc long, near binary, others binary, away binary").join(sizes, "h").withColumn("block", F.expr("pmod(doc, blocks)"))
    meets = F.expr("inline(transform(sequence(0L, blocks - 1), k -> struct(least(k, block) AS i, greatest(k, block) AS j)))")
    return near.select("h", "doc", "near", "others", "away", "block", meets).groupBy("h", "i", "j").applyInPandas(meet, "a long, b long")


Segment = tuple[int, int, int]  # first position in a, one after the last, and the diagonal (position in a minus that in b)


def segments_of(x: np.ndarray, y: np.ndarray, k: int, near: int = K + W) -> list[Segment]:
    """Seeds of one diagonal, each within reach of the one before, as one segment."""
    order = np.lexsort((x, x - y))
    x, d = x[order], (x - y)[order]
    new = np.append(True, (d[1:] != d[:-1]) | (x[1:] - x[:-1] > near))
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(x)) - 1
    return [(int(x[s]), int(x[e]) + k, int(d[s])) for s, e in zip(start, end)]


class Window:
    """Best value, and whose it is, over a range of positions; what is there can be taken out again."""

    def __init__(self, n: int):
        self.n = n
        self.at: list[list[tuple[float, int]]] = [[] for _ in range(n)]  # heaps of (-value, who)
        self.gone: set[int] = set()
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (2 * n)

    def settle(self, at: int) -> None:
        heap = self.at[at]
        while heap and heap[0][1] in self.gone:
            heappop(heap)
        i = at + self.n
        self.best[i] = (-heap[0][0], heap[0][1]) if heap else (-1e18, -1)
        while i > 1:
            i //= 2
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1], key=lambda b: b[0])

    def put(self, at: int, value: float, who: int) -> None:
        heappush(self.at[at], (-value, who))
        self.settle(at)

    def take(self, at: int, who: int) -> None:
        self.gone.add(who)
        self.settle(at)

    def get(self, start: int, end: int) -> tuple[float, int]:
        out = (-1e18, -1)
        lo, hi = start + self.n, end + self.n
        while lo < hi:
            if lo & 1:
                out = max(out, self.best[lo], key=lambda b: b[0])
                lo += 1
            if hi & 1:
                hi -= 1
                out = max(out, self.best[hi], key=lambda b: b[0])
            lo, hi = lo // 2, hi // 2
        return out


def chains(segments: list[Segment], skip: float = SKIP, gap: int = GAP) -> list[list[Segment]]:
    """Collinear chains, best first, that share no segment.

    A chain's score is the words of its segments less `skip` for each word passed over in either text. With ends
    e = x + y the best chain before a segment is the largest score + skip * e among those that end at most `gap` words
    before it in b (a range of the window) and in a (put in by then, and taken out when they are further behind).
    """
    segments = sorted(segments)
    n = len(segments)
    if n == 1:
        return [segments]
    ends_b = sorted({e - d for _, e, d in segments})
    place = [bisect_left(ends_b, e - d) for _, e, d in segments]
    window = Window(len(ends_b))
    by_end = sorted(range(n), key=lambda i: segments[i][1])
    score, back, put, taken = [0.0] * n, [-1] * n, 0, 0
    for i, (x, e, d) in enumerate(segments):
        while put < n and segments[by_end[put]][1] <= x:
            j = by_end[put]
            _, ej, dj = segments[j]
            window.put(place[j], score[j] + skip * (2 * ej - dj), j)
            put += 1
        while taken < put and segments[by_end[taken]][1] < x - gap:
            window.take(place[by_end[taken]], by_end[taken])
            taken += 1
        value, j = window.get(bisect_left(ends_b, x - d - gap), bisect_left(ends_b, x - d + 1))
        score[i] = float(e - x)
        if j >= 0 and value - skip * (2 * x - d) > 0:
            score[i] += value - skip * (2 * x - d)
            back[i] = j
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        if used[i]:
            continue
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(segments[i])
            i = back[i]
        out.append(path[::-1])
    return out


def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chains of each pair, by the seeds of its links and the frequent seeds that both texts have."""
    names = ["a", "b", "x0", "x1", "y0", "y1", "diagonals"]
    for f in batches:
        rows = []
        for a, b, at, of_a, of_b in f.itertuples(index=False):
            seen = [(r["x"], r["y"]) for r in at]
            if of_a is not None and of_b is not None:
                there = {r["h"]: r["pos"] for r in of_b}
                seen += [(r["pos"], there[r["h"]]) for r in of_a if r["h"] in there]
            xy = np.array(seen, np.int64).reshape(-1, 2)
            for c in chains(segments_of(xy[:, 0], xy[:, 1], K)):
                rows.append((a, b, c[0][0], c[-1][1], c[0][0] - c[0][2], c[-1][1] - c[-1][2], list(dict.fromkeys(d for _, _, d in c))))
        yield pd.DataFrame(rows, columns=names)


def aligned(u: np.ndarray, v: np.ndarray, x0: int, y0: int, diagonals: list[int], words: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """(start a, end a, start b, end b, equal words) of passages; u and v are words from x0 in a and y0 in b."""
    found: list[Segment] = []
    for d in diagonals:
        lo, hi = max(x0, y0 + d), min(x0 + len(u), y0 + d + len(v))
        if hi <= lo:
            continue
        same = np.concatenate([[False], u[lo - x0 : hi - x0] == v[lo - d - y0 : hi - d - y0], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        found += [(lo + int(s), lo + int(e), d) for s, e in zip(edge[::2], edge[1::2]) if e - s >= 3]
    out = []
    waiting = chains(found) if found else []
    while waiting:
        c = waiting.pop()
        a0, a1, b0, b1 = c[0][0], c[-1][1], c[0][0] - c[0][2], c[-1][1] - c[-1][2]
        equal = sum(e - s for s, e, _ in c)
        if min(a1 - a0, b1 - b0) < words:
            continue
        if equal >= identity * max(a1 - a0, b1 - b0):
            out.append((a0, a1, b0, b1, equal))
        elif len(c) > 1:  # too unlike as a whole: the parts on both sides of its widest gap
            gaps = [max(q[0] - p[1], q[0] - q[2] - p[1] + p[2]) for p, q in zip(c, c[1:])]
            at = gaps.index(max(gaps)) + 1
            waiting += [c[:at], c[at:]]
    return out


def shared_passages(
    docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", words: int = 50, identity: float = 0.8, share_rows: int = SHARE, most: int = MOST, block: int = BLOCK
) -> DataFrame:
    """One row per passage and pair of linked texts, and per document with the text of another: doc_id, start_word, end_word, other_id,
    other_start, other_end, equal_words, class_id."""
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("_key"), F.xxhash64(docs[id_col], text).alias("rid"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    groups, shares = max(64, -(-(size.bytes or 0) // 4_000_000)), max(1, -(-size.n // share_rows))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    keyed = written(rows.groupBy("_key").agg(least.alias("_l"), (F.min("rid") != F.max("rid")).alias("several")).select("_key", "_l.doc_id", "_l.rid", "several"))
    links = linked(seeds(rows, groups, shares), shares, most)
    frequent = links.where(F.col("kind") == FREQUENT).select("h", F.col("a").alias("doc"), F.col("x").alias("pos"))
    lower, upper = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    at = F.when(F.col("a") > F.col("b"), F.struct("x", "y")).otherwise(F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    pairs = links.where(F.col("kind") == LINK).select(upper, lower, at.alias("at"))
    close = alike(frequent, rows, keyed, words, identity, block).select(upper, lower, F.lit(None).cast("struct<x:int,y:int>").alias("at"))
    has = frequent.groupBy("doc").agg(F.collect_list(F.struct("h", "pos")).alias("at"))
    pairs = pairs.unionByName(close).groupBy("a", "b").agg(F.collect_list("at").alias("at"))
    pairs = pairs.join(has.select(F.col("doc").alias("a"), F.col("at").alias("of_a")), "a", "left").join(has.select(F.col("doc").alias("b"), F.col("at").alias("of_b")), "b", "left").select("a", "b", "at", "of_a", "of_b")
    chain = written(pairs.mapInPandas(chained, "a long, b long, x0 int, x1 int, y0 int, y1 int, diagonals array<int>").withColumn("cid", F.xxhash64("a", "b", "x0", "y0", "x1", "y1")))
    part = lambda key, a, b, side: chain.select("cid", F.col(key).alias("_key"), F.lit(side).alias("side"), F.greatest(F.lit(0), F.col(a) - MARGIN).alias("from"), (F.col(b) + MARGIN).alias("to"))
    wanted = part("a", "x0", "x1", 0).unionByName(part("b", "y0", "y1", 1)).join(keyed.select("_key", "rid"), "_key").drop("_key")

    @F.pandas_udf("binary")
    def word_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Hashes()
        for texts in batches:
            yield pd.Series([hashes_of(t, known).astype(np.uint32).tobytes() for t in texts], dtype=object)
            if len(known) > REMEMBERED:
                known.clear()

    texts = rows.select("rid", word_bytes("text").alias("words"))
    bits = F.expr("substring(words, 4 * from + 1, 4 * (to - from))")
    pieces = texts.join(wanted, "rid").select("cid", "side", "from", bits.alias("piece"))
    both = pieces.groupBy("cid").agg(
        F.max(F.when(F.col("side") == 0, F.struct("from", "piece"))).alias("u"), F.max(F.when(F.col("side") == 1, F.struct("from", "piece"))).alias("v")
    )
    met = chain.join(both, "cid").select("a", "b", F.col("u.from").alias("x0"), F.col("v.from").alias("y0"), F.col("u.piece").alias("u"), F.col("v.piece").alias("v"), "diagonals")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for a, b, x0, y0, u, v, d in f.itertuples(index=False):
                out += [(a, b, *p) for p in aligned(np.frombuffer(u, np.uint32), np.frombuffer(v, np.uint32), x0, y0, list(d), words, identity)]
            yield pd.DataFrame(out, columns=["a", "b", "start_word", "end_word", "other_start", "other_end", "equal_words"])

    passages = written(met.mapInPandas(align, "a long, b long, start_word int, end_word int, other_start int, other_end int, equal_words int").distinct())
    roots = components(passages.select("a", "b"))
    of_key = keyed.join(roots, F.col("_key") == F.col("node"), "left").select("_key", "doc_id", "rid", "several", F.coalesce("root", "_key").alias("root"))
    of_key = of_key.join(of_key.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root")
    names = ["doc_id", "start_word", "end_word", "other_id", "other_start", "other_end", "equal_words", "class_id"]
    named = passages.join(of_key.select(F.col("_key").alias("a"), "doc_id", "class_id"), "a").join(keyed.select(F.col("_key").alias("b"), F.col("doc_id").alias("other_id")), "b")
    first = of_key.where("several").select("_key", F.col("doc_id").alias("other_id"), F.col("rid").alias("first_rid"), "class_id")
    members = rows.join(first, "_key").where("rid <> first_rid").withColumn("n", F.size(words_of("text", lower=False))).where(F.col("n") >= words)
    n, zero = F.col("n").cast("int"), F.lit(0)
    members = members.select("doc_id", zero.alias("start_word"), n.alias("end_word"), "other_id", zero.alias("other_start"), n.alias("other_end"), n.alias("equal_words"), "class_id").distinct()
    return named.select(names).unionByName(members.select(names))
