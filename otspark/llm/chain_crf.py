"""A linear-chain conditional random field with two tags over hashed features."""

from __future__ import annotations

import numpy as np


def step(weights: np.ndarray, seen: np.ndarray, at: np.ndarray, by: np.ndarray, rate: float) -> None:
    """Adaptive gradient ascent on some of the weights."""
    which, inverse = np.unique(at, return_inverse=True)
    g = np.bincount(inverse.reshape(-1), by.reshape(-1), len(which)) - 1e-5 * weights[which]
    seen[which] += g * g
    weights[which] += rate * g / np.sqrt(seen[which])


def marginals(emission: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(tag 1) of each item of the chains that lie end to end, expected transitions (2x2) and log Z of each chain.

    emission: score of tag 1 over tag 0. Chains of like length run side by side.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    out, pairs, log_z = np.zeros(len(emission)), np.zeros((2, 2)), np.zeros(len(lengths))
    t = np.exp(transitions)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    by_length = lengths[order]
    at = 0
    while at < len(order):
        longest = by_length[at] * 5 // 4 + 2  # chains up to this length share a batch
        end = min(at + max(1, 400_000 // int(longest)), int(np.searchsorted(by_length, longest, side="right")))
        end = max(end, at + 1)
        which = order[at:end]
        at = end
        n, size = len(which), int(lengths[which].max())
        index = starts[which][None, :] + np.minimum(np.arange(size)[:, None], (lengths[which] - 1)[None, :])
        inside = np.arange(size)[:, None] < lengths[which][None, :]
        e = np.exp(np.clip(emission[index], -40, 40))
        a0, a1, scale = np.empty((size, n)), np.empty((size, n)), np.ones((size, n))
        z = 1 + e[0]
        a0[0], a1[0], scale[0] = 1 / z, e[0] / z, z
        for i in range(1, size):
            u0 = a0[i - 1] * t[0, 0] + a1[i - 1] * t[1, 0]
            u1 = (a0[i - 1] * t[0, 1] + a1[i - 1] * t[1, 1]) * e[i]
            z = u0 + u1
            a0[i], a1[i], scale[i] = u0 / z, u1 / z, z
        b0, b1 = np.ones(n), np.ones(n)
        p = np.empty((size, n))
        p[size - 1] = a1[size - 1]
        for i in range(size - 2, -1, -1):
            go = inside[i + 1]
            f0, f1 = b0 / scale[i + 1], b1 * e[i + 1] / scale[i + 1]
            q0, q1 = np.where(go, a0[i], 0.0), np.where(go, a1[i], 0.0)
            pairs += t * np.array([[q0 @ f0, q0 @ f1], [q1 @ f0, q1 @ f1]])
            b0, b1 = np.where(go, t[0, 0] * f0 + t[0, 1] * f1, 1.0), np.where(go, t[1, 0] * f0 + t[1, 1] * f1, 1.0)
            w = a1[i] * b1
            p[i] = w / (w + a0[i] * b0)
        out[index[inside]] = p[inside]
        log_z[which] = np.where(inside, np.log(scale), 0).sum(0)
    return out, pairs, log_z


def trained(feats: np.ndarray, lengths: np.ndarray, tags: np.ndarray, hashed: int, *, epochs: int = 12, batch: int = 400, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transitions by likelihood; feats has a row of features for each item, chains lie end to end."""
    weights, seen = np.zeros(hashed), np.full(hashed, 1e-1)
    transitions, seen_t = np.zeros((2, 2)), np.full((2, 2), 1.0)
    rng = np.random.default_rng(2)
    chains = [np.arange(e - n, e) for e, n in zip(np.cumsum(lengths), lengths)]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // batch)):
            at = np.concatenate([chains[i] for i in part])
            y, n, f = tags[at], lengths[part], feats[at]
            p, pairs, _ = marginals(weights[f].sum(1), n, transitions)
            inner = np.ones(len(at), bool)
            inner[0] = inner[np.cumsum(n)[:-1]] = False
            later = np.flatnonzero(inner)
            true = np.bincount(2 * y[later - 1] + y[later], minlength=4).reshape(2, 2)
            g = y - p
            near = np.abs(g) > 1e-4
            step(weights, seen, f[near], np.repeat(g[near], f.shape[1]), rate)
            gt = (true - pairs) / len(part) - 1e-3 * transitions
            seen_t += gt * gt
            transitions += 0.3 * gt / np.sqrt(seen_t)
    return weights, transitions


def viterbi(emission: list[float], transitions: list[list[float]]) -> list[int]:
    """The best tags of one chain."""
    if not emission:
        return []
    (t00, t01), (t10, t11) = transitions
    s0, s1, back = 0.0, emission[0], []
    for e in emission[1:]:
        b0, b1 = s1 + t10 > s0 + t00, s1 + t11 > s0 + t01
        s0, s1 = (s1 + t10 if b0 else s0 + t00), (s1 + t11 if b1 else s0 + t01) + e
        back.append((b0, b1))
    tag = int(s1 > s0)
    out = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        out.append(tag)
    return out[::-1]
