"""Language mixtures: the selected set against a search through all sets, each with its own proportions to convergence."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from veldspar.llm import langid


def _text(rng, p, shares, n):
    return rng.multinomial(n, shares @ p)


def _best_set(logp, counts):
    """The set of highest penalised likelihood, and its proportions."""
    p, total = np.exp(logp), counts.sum()
    best = None
    for size in range(1, len(p) + 1):
        for own in combinations(range(len(p)), size):
            pi = np.full(size, 1 / size)
            for _ in range(300):
                part = pi[:, None] * p[list(own)]
                pi = (part / part.sum(0) * counts).sum(1) / total
            value = langid.TEMPER * (counts * np.log(np.maximum((pi[:, None] * p[list(own)]).sum(0), 1e-300))).sum() - 0.5 * np.log(max(total, 2)) * size
            if best is None or value > best[0] + 1e-9:
                best = (value, own, pi)
    return best


@pytest.mark.parametrize("langs", [1, 2, 4])
def test_selected_sets(langs):
    rng = np.random.default_rng(langs)
    p = rng.dirichlet(np.full(60, 0.15), langs) * 0.98 + 0.02 / 60
    logp = np.log(p)
    texts = []
    for k in range(40):
        shares = np.zeros(langs)
        some = rng.permutation(langs)[: 1 + k % min(3, langs)]
        shares[some] = rng.dirichlet(np.full(len(some), 3.0))
        texts.append(_text(rng, p, shares, int(rng.choice([1, 30, 400, 3000]))))
    row, bucket = np.nonzero(np.stack(texts))
    pi, has = langid.infer(logp, row, bucket, np.stack(texts)[row, bucket], len(texts))
    assert has.all() and np.allclose(pi.sum(0), 1, atol=1e-6)
    same = 0
    for k, counts in enumerate(texts):
        value, own, want = _best_set(logp, counts)
        got = tuple(np.flatnonzero(pi[:, k] > 0))
        if got == own:
            same += 1
            assert np.abs(pi[list(own), k] - want).max() < 0.03
        else:  # a step down may end beside the best set, but never far below it
            q = pi[list(got), k]
            ours = langid.TEMPER * (counts * np.log((q[:, None] * p[list(got)]).sum(0))).sum() - 0.5 * np.log(max(counts.sum(), 2)) * len(got)
            assert ours > value - 0.5 * np.log(max(counts.sum(), 2))
    assert same >= 38


def test_small_shares_stay_when_they_pay():
    """A language of one part in a hundred is found where its n-grams are its own."""
    p = np.full((2, 40), 1e-6)
    p[0, :20], p[1, 20:] = 0.05, 0.05
    p /= p.sum(1, keepdims=True)
    counts = np.r_[np.full(20, 990), np.full(20, 10)]
    pi, _ = langid.infer(np.log(p), np.zeros(40, int), np.arange(40), counts, 1)
    assert pi[1, 0] == pytest.approx(0.01, abs=2e-3)


def test_no_text_and_no_gram():
    logp = np.log(np.full((3, 8), 1 / 8))
    pi, has = langid.infer(logp, np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 2)
    assert pi.shape == (3, 2) and not has.any()
    pi, has = langid.infer(logp, np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 0)
    assert pi.shape == (3, 0)
    tied, _ = langid.infer(logp, np.zeros(1, int), np.zeros(1, int), np.array([50]), 1)
    assert (tied[:, 0] > 0).sum() == 1
