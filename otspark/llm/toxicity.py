"""Toxicity by a linear-chain conditional random field over the words of a sentence.

Labels come by document, so words are labelled first: a word model with hashed
word and affix features is fitted to the documents of the sample by a noisy-or
(a document is toxic when one of its words is), and words it holds toxic in toxic
documents are the labelled tokens. The field (two tags, transitions, the same
features) is trained on those sentences by likelihood. Forward-backward marginals
of all sentences of a text add up to its score, by a logistic fit on the sample;
words with a marginal of a half or more are the offending offsets.

Fitting uses at most SAMPLE documents of each label with SAMPLE_CHARS characters
together, the first by a seeded hash of the id, from the rows outside the held-out
fold, in one task; a text that does not fit into what is left of them is not learned
from, the next ones are. The field learns from all sentences with a toxic word and from
as many without (CLEAN at least). The bounds are parameters. Of rows that share an id one text is
learned from, that with the least hash. The
ratio of the labels in all rows of the training folds corrects for the sampling.
Only texts and labels.toxic are read.

Cases: null and empty texts have the score of a text without words; a table
without labels, or with one label only, gives every text the ratio of the labels
(a half without any); repeated rows and ties give equal scores; an empty table
gives an empty result; a document labelled with both labels counts once for each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otspark.llm.chain_crf import marginals, step, trained
from otspark.llm.common import crc_mod, text_of, whole

#: Documents of each label that the model is fitted on, at most.
SAMPLE = 1500
#: Characters of the documents of a label that it is fitted on, at most; documents that would go beyond are not learned from.
SAMPLE_CHARS = 30_000_000
#: Sentences without a toxic word that the field is trained on: so many, or as many as there are with one.
CLEAN = 3000
FOLDS = 5
HASHED = 1 << 17
FEATURES = 9
#: Types of words whose score a worker remembers; beyond that it starts afresh.
REMEMBERED = 200_000

UNITS = re.compile(r"[^\W_]+|[.!?\n]")
ENDS = frozenset(".!?\n")


def features(word: str) -> list[int]:
    """Hashed features of a word in lower case: itself, beginnings, ends, length, nothing."""
    names = ["w" + word, *("p" + word[:k] for k in (3, 4, 5, 6)), "s" + word[-3:], "s" + word[-5:], f"n{min(len(word), 12)}", "b"]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % HASHED for n in names]


def units_of(text: str) -> list[str]:
    return UNITS.findall(lowered(text))


class Model:
    """Weights of the field and of the fit of its marginals."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, fit: np.ndarray):
        self.weights, self.transitions, self.fit = weights, transitions, fit


def word_model(docs: list[np.ndarray], toxic: np.ndarray, feats: np.ndarray, epochs: int = 6) -> np.ndarray:
    """Weights by the noisy-or likelihood; docs hold the distinct word types of each text."""
    seen = np.full(HASHED, 1e-2)
    inside = np.zeros((2, HASHED))
    for d, y in zip(docs, toxic):
        inside[int(y), np.unique(feats[d])] += 1
    n = np.bincount(toxic, minlength=2)
    odds = np.log((inside[1] + 0.5) / (n[1] + 1)) - np.log((inside[0] + 0.5) / (n[0] + 1))
    weights = np.where(inside[1] >= 4, np.clip(odds - 1, 0, 4) / 2, 0.0)  # where the search begins
    weights[features("")[-1]] = -9.0
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            f = feats[docs[i]]
            if not len(f):
                continue
            p = 1 / (1 + np.exp(-np.clip(weights[f].sum(1), -30, 30)))
            none = np.exp(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
            g = p * none / max(1e-9, 1 - none) if toxic[i] else -p
            near = np.abs(g) > 1e-5
            if near.any():
                step(weights, seen, f[near], np.repeat(g[near], f.shape[1]), 0.3)
    return weights


def summaries(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """What the score of each of n texts is made of: one, log-odds that any word is toxic, expected toxic words."""
    none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n)
    any_ = np.clip(-np.expm1(none), 1e-6, 1 - 1e-6)
    return np.stack([np.ones(n), np.log(any_ / (1 - any_)), np.log1p(np.bincount(doc, p, n))], axis=1)


def fitted(x: np.ndarray, y: np.ndarray, shift: float) -> np.ndarray:
    """Logistic regression by Newton steps, with a small penalty; `shift` moves the sample's label ratio to that of all rows."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    w[0] += shift
    return w


def sentences(units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words stand among the units of texts that lie end to end (True marks an end), words of each sentence, the text of each word."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    real = ~units
    begins = np.append(True, (doc[1:] != doc[:-1]) | units[:-1]) if len(units) else np.zeros(0, bool)
    _, lengths = np.unique(np.cumsum(begins)[real], return_counts=True)
    return real, lengths, doc[real]


def train(rows: Iterable[tuple[str, int]], positive: float, clean: int = CLEAN) -> Model:
    """A model of (whole text, label) rows; positive: ratio of label 1 in all rows of the training folds; clean: sentences without a toxic word.

    Texts are read once and kept as word numbers, so that memory goes with 4 bytes a word.
    """
    prior = float(np.log(positive / (1 - positive)))
    ids: dict[str, int] = {}
    parts, labels = [], []
    for t, y in rows:
        u = units_of(t)
        labels.append(y)
        parts.append(np.fromiter((-1 if w in ENDS else ids.setdefault(w, len(ids)) for w in u), np.int32, len(u)))
    toxic = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(HASHED), np.zeros((2, 2)), np.array([prior, 0.0, 0.0]))
    feats = np.array([features(w) for w in ids] or [features("")], np.int32)
    held = word_model([np.unique(w[w >= 0]) for w in parts], toxic, feats)
    units, sizes = np.concatenate(parts), np.array([len(w) for w in parts])
    parts.clear()
    ids.clear()
    real, lengths, doc = sentences(units < 0, sizes)
    words = units[real]
    tags = ((held[feats].sum(1) > 0)[words] & (toxic == 1)[doc]).astype(np.int64)
    of = np.repeat(np.arange(len(lengths)), lengths)  # the sentence of each word
    marked = np.bincount(of, tags, len(lengths)) > 0
    plain = np.random.default_rng(3).permutation(np.flatnonzero(~marked))[: max(clean, int(marked.sum()))]
    use = np.zeros(len(lengths), bool)
    use[plain] = use[marked] = True
    inside = use[of]
    weights, transitions = trained(feats[words[inside]], lengths[use], tags[inside], HASHED, epochs=8)
    model = Model(weights, transitions, np.zeros(3))
    p, _, _ = marginals(weights[feats].sum(1)[words], lengths, transitions)
    ratio = float(np.mean(toxic))
    model.fit = fitted(summaries(p, doc, len(sizes)), toxic.astype(float), prior - float(np.log(ratio / (1 - ratio))))
    return model


def tagger(model: Model):
    """A function from whole texts to the marginals of their words; it remembers word scores between calls."""
    known: dict[str, float] = {}

    def fresh(words: set[str]) -> None:
        if len(known) > REMEMBERED:
            known.clear()
        known.update(dict.fromkeys(ENDS, np.nan))
        new = [w for w in words if w not in known]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            f = np.array([features(w) for w in part], np.int32)
            known.update(zip(part, model.weights[f].sum(1).tolist()))

    def tag(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Groups of texts, the marginals of all their words, and the text of each word."""
        for group in grouped(texts):
            units = [units_of(t) for t in group]
            every = [w for u in units for w in u]
            types = set(every)
            if not types <= known.keys():
                fresh(types)
            e = np.fromiter(map(known.__getitem__, every), float, len(every))
            real, lengths, doc = sentences(np.isnan(e), np.array([len(u) for u in units], np.int64))
            yield group, marginals(e[real], lengths, model.transitions)[0], doc

    return tag


def lowered(text: str) -> str:
    """The text in lower case with every character in its place: the few that would grow stay as they are."""
    small = text.lower()
    return small if len(small) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def grouped(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    part, held = [], 0
    for t in texts:
        part.append(t or "")
        held += len(part[-1])
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def offsets(text: str, p: np.ndarray) -> list[str]:
    """start:end (code points of the text) of runs of words with a marginal of a half or more."""
    out, i = [], 0
    run = None
    for m in UNITS.finditer(lowered(text)):
        if m[0] in ENDS:
            run = None
            continue
        if p[i] >= 0.5:
            if run is None:
                run = [m.start(), m.end()]
                out.append(run)
            run[1] = m.end()
        else:
            run = None
        i += 1
    return [f"{a}:{b}" for a, b in out]


def fit(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE, chars: int = SAMPLE_CHARS, clean: int = CLEAN) -> Model:
    """Trains in one task on a bounded sample; the driver gets the weights (a megabyte), never a text."""
    known = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_y")).where("_y in (0, 1)").where(crc_mod(F.col("_id"), FOLDS) != 0)
    n = {r._y: r["count"] for r in known.groupBy("_y").count().collect()}
    positive = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    first = F.xxhash64("_id", F.lit(17))
    some = known.where("_y = 1").orderBy(first, "_id").limit(sample).union(known.where("_y = 0").orderBy(first, "_id").limit(sample))
    rows = docs.select(docs[id_col].alias("_id"), text_of(docs, text_col).alias("_text")).join(F.broadcast(some), "_id")
    one = rows.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_text"), "_text")).alias("_t")).select("_id", "_y", F.col("_t._text").alias("_text"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room = {0: chars, 1: chars}

        def labelled() -> Iterator[tuple[str, int]]:
            for b in batches:
                for y, t in zip(b._y.tolist(), b._text):
                    if len(t) <= room[y]:  # a text that does not fit takes no room from the others
                        room[y] -= len(t)
                        yield t, y

        m = train(labelled(), positive, clean)
        yield pd.DataFrame({"weights": [m.weights.tobytes()], "transitions": [m.transitions.tobytes()], "fit": [m.fit.tobytes()]})

    made = one.repartition(1).sortWithinPartitions(first, "_id", "_y").mapInPandas(task, "weights binary, transitions binary, fit binary").collect() if n else []
    if not made:
        return train([], positive)
    return Model(np.frombuffer(made[0].weights), np.frombuffer(made[0].transitions).reshape(2, 2), np.frombuffer(made[0].fit))


def toxicity(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE, chars: int = SAMPLE_CHARS, clean: int = CLEAN) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted, spans (offending offsets)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col, id_col=id_col, label_col=label_col, sample=sample, chars=chars, clean=clean))
    scored = scorer(shared)
    out = docs.select(docs[id_col].alias("doc_id"), (crc_mod(docs[id_col], FOLDS) == 0).alias("held_out"), scored(text_of(docs, text_col)).alias("_s"))
    return out.select("doc_id", "held_out", F.col("_s.score").alias("score"), F.when(F.col("_s.score") >= 0.5, 1).otherwise(0).alias("predicted"), F.col("_s.spans").alias("spans"))


def scorer(shared):
    @F.pandas_udf("score double, spans string")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tag, fit_ = tagger(shared.value), shared.value.fit
        for texts in batches:
            scores, spans = [np.zeros(0)], []
            for group, p, doc in tag(texts.tolist()):
                n = len(group)
                scores.append(1 / (1 + np.exp(-np.clip(summaries(p, doc, n) @ fit_, -30, 30))))
                cut = np.searchsorted(doc, np.arange(n + 1))
                marked = np.bincount(doc, p >= 0.5, n) > 0
                spans += [",".join(offsets(t, p[a:b])) if m else "" for t, m, a, b in zip(group, marked, cut, cut[1:])]
            yield pd.DataFrame({"score": np.concatenate(scores), "spans": spans})

    return scored


def accepted(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that are not rejected (score under a half), all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col, id_col=id_col))
    scored = scorer(shared)
    return docs.select(whole(docs), scored(text_of(docs, text_col)).alias("_s")).where("_s.score < 0.5").select("_doc.*")
