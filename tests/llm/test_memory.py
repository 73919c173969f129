"""What the language model's tasks hold: small row groups in what is spilled, and workers that give memory back."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from otspark.llm import common, lm_score


def test_spilled_in_small_row_groups(docs, monkeypatch):
    sizes = []

    def spied(df, **options):
        sizes.append(int(options.get("parquet.block.size", 128 << 20)))
        return common.written(df, **options)

    monkeypatch.setattr(lm_score, "written", spied)
    assert lm_score.lm_scores(docs.limit(50), filter_bytes=(1000, 1000)).count() == 50
    assert sizes.count(16 << 20) == 3  # pairs, scored rows, rare tokens


def test_workers_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.lean(lambda bs: (b + 1 for b in bs))(iter([1, 2]))) == [2, 3] and len(calls) == 1
    with pytest.raises(ZeroDivisionError):
        list(common.lean(lambda bs: (1 // b for b in bs))(iter([0])))
    assert len(calls) == 2
    assert common.lean_group(lambda b: b * 2)(3) == 6 and len(calls) == 3


def test_each_pair_is_probed_once(monkeypatch):
    """A pair that comes many times in a run of texts costs one probe, and levels are those put in, but for false positives."""
    h = lm_score.mixed(np.arange(1, 40_001, dtype=np.uint64))
    c = np.arange(40_000) % 50 + 1
    held = lm_score.Filter([lm_score.piece_bits(h[:20_000], c[:20_000], 1), lm_score.piece_bits(h[20_000:], c[20_000:], 1)])
    got, true = held.levels(h, (np.arange(40_000) >= 20_000).astype(np.int64)), lm_score.level(c)
    assert (got >= true).all() and (got > true).mean() < 0.005
    assert (held.levels(lm_score.mixed(h + np.uint64(10**9)), np.zeros(40_000, np.int64)) > 0).mean() < 0.005
    probed, levels = [], lm_score.Filter.levels
    monkeypatch.setattr(lm_score.Filter, "levels", lambda f, h, piece: probed.append(len(h)) or levels(f, h, piece))
    words = lm_score.Filter([lm_score.piece_bits(np.array([xxhash.xxh64_intdigest(w, 42) for w in (b"one", b"two")], np.uint64), np.array([9, 9]), 1)] * lm_score.PIECES)
    s = lm_score.Scorer(lm_score.Model(19, 3, 1, 0.5, 0.5), words, lm_score.Filter([b""] * lm_score.PIECES, 2), 64, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    out, _ = lm_score.scored(["one two " * 50] * 20, lm_score.Vocabulary(s), 0)
    assert out.n_tokens.tolist() == [101] * 20 and probed == [2, 4]  # the words; start-one, one-two, two-one, two-end
