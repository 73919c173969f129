"""Token counts by rank-synchronous array merging.

Texts are cut where no piece of the vocabulary can reach across. The distinct
pre-tokens of a batch lie end to end in ragged numpy arrays; in every round each
sequence applies its lowest-rank pair, all sequences at the same time, until no
pair is left. What survives is counted, a symbol outside the vocabulary as its
UTF-8 bytes.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are
counted each for itself; an empty table gives an empty result; columns besides
the id and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otspark.llm.common import text_of

SPACE = "▁"
#: Pre-tokens whose counts a worker remembers; beyond that it starts afresh.
REMEMBERED = 1_000_000


class MergeTable:
    """Pair ranks of a byte-fallback BPE vocabulary, as sorted arrays."""

    def __init__(self, pieces: list[tuple[str, float]]):
        symbols = {p: i for i, (p, _) in enumerate(pieces)}
        score = {p: s for p, s in pieces}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {p: order[s] for p, s in pieces}
        held = np.bincount(list(rank.values()), minlength=len(order))
        keys, ranks, made = [], [], []
        #: A piece that a piece of the same or a lower rank extends must merge alone, leftmost first.
        alone = np.zeros(len(pieces), bool)
        for p, i in symbols.items():
            alone[i] = held[rank[p]] > 1
        for p, i in symbols.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is None or b is None:
                    continue
                keys.append(a * len(pieces) + b)
                ranks.append(rank[p])
                made.append(i)
                for part in (p[:k], p[k:]):
                    if rank[part] >= rank[p]:
                        alone[symbols[part]] = True
        by = np.argsort(np.array(keys, np.int64))
        self.n = len(pieces)
        self.keys = np.array(keys, np.int64)[by]
        self.ranks = np.array(ranks, np.int32)[by]
        self.made = np.array(made, np.int32)[by]
        self.alone = alone
        self.none = np.int32(len(order))
        self.chars = {ord(p): i for p, i in symbols.items() if len(p) == 1}
        inner = {c for p in symbols for c in p.lstrip(SPACE)}
        if SPACE in inner:
            raise ValueError("a piece holds a space after another character; texts can't be cut at spaces")
        self.newline = any("\n" in p for p in symbols)

    def table(self) -> np.ndarray:
        """Symbol by code point; minus the UTF-8 length where there is none."""
        out = np.full(0x110000, -4, np.int32)
        out[:0x10000], out[:0x800], out[:0x80] = -3, -2, -1
        out[list(self.chars)] = list(self.chars.values())
        return out

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; rank `none` where the two don't merge."""
        key = left.astype(np.int64) * self.n + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], self.none), np.where(hit, self.made[at], -1)


def sentencepiece_table(model_file: str) -> MergeTable:
    """The merge table of a sentencepiece BPE model."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return MergeTable([(m.id_to_piece(i), m.get_score(i)) for i in plain])


def merged_counts(words: list[str], merges: MergeTable, table: np.ndarray) -> np.ndarray:
    """Tokens of each pre-token (none is empty)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbols = table[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(words)), sizes)
    counts = np.zeros(len(words), np.int64)
    rank, made = merges.lookup(symbols, np.append(symbols[1:], -1))
    ends = np.append(owner[1:] != owner[:-1], True)
    rank[ends] = merges.none
    while len(symbols):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.minimum.reduceat(rank, starts)
        length = np.diff(np.append(starts, len(symbols)))
        each = np.repeat(lowest, length)
        over = each == merges.none
        if over.any():  # finished sequences: what is left of them is counted
            counts += np.bincount(owner[over], np.maximum(1, -symbols[over]), len(words)).astype(np.int64)
            going = ~over
            symbols, owner, rank, made, each = symbols[going], owner[going], rank[going], made[going], each[going]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == each)
        first = np.append(True, owner[at[1:]] != owner[at[:-1]])
        run = np.append(True, (np.diff(at) != 1) | first[1:])
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        alone = merges.alone[made[at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]]]
        at = at[np.where(alone, first, place % 2 == 0)]
        symbols[at] = made[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        new = np.cumsum(keep)[at] - 1
        symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
        near = np.zeros(len(symbols), bool)
        near[new] = near[np.maximum(new - 1, 0)] = True
        touched = np.flatnonzero(near)
        after = np.minimum(touched + 1, len(symbols) - 1)
        r, m = merges.lookup(symbols[touched], symbols[after])
        r[(owner[touched] != owner[after]) | (touched == after)] = merges.none
        rank[touched], made[touched] = r, m
    return counts


def text_counter(merges: MergeTable):
    """A function from a list of whole texts to their token counts; it remembers pre-tokens between calls."""
    table = merges.table()
    cut = re.compile(" *[^ ]+| +" if merges.newline else " *[^ \n]+| +|\n").findall
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        if len(known) > REMEMBERED:
            known.clear()
        out, waiting, fresh = [0] * len(texts), [], set()

        def settle() -> None:
            new = [w for w in fresh if w not in known]
            if new:
                known.update(zip(new, merged_counts([w.replace(" ", SPACE) for w in new], merges, table).tolist()))
            for i, words in waiting:
                out[i] = sum(map(known.__getitem__, words))
            waiting.clear()
            fresh.clear()

        held = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            words = cut(" " + text.replace(SPACE, " "))
            waiting.append((i, words))
            fresh.update(words)
            held += len(words)
            if held > 1_000_000:
                settle()
                held = 0
        settle()
        return out

    return count


def count_tokens(docs: DataFrame, model_file: str, *, text_col: str = "text", id_col: str = "doc_id", limit: int = 4096) -> DataFrame:
    """One row per document: its id, n_bytes (UTF-8), n_tokens as the model's library gives them, over_limit.

    The model file is read on the driver; its merge table (bounded by the vocabulary) goes to the workers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sentencepiece_table(model_file))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = text_counter(shared.value)
        for texts in batches:
            yield pd.Series(count(texts.tolist()), dtype="int64")

    text = text_of(docs, text_col)
    out = docs.select(docs[id_col].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
