"""Language sets against all subsets."""

from itertools import combinations

import numpy as np
import pytest

from scoreline.llm import langid


def mixed(random, n_lang, n_docs, parts):
    """Words' likelihoods for documents whose words come from ``parts`` languages each."""
    doc, rows = [], []
    for d in range(n_docs):
        own = random.choice(n_lang, parts, replace=False)
        for _ in range(int(random.integers(5, 60 * parts))):
            p = np.exp(-random.exponential(2.0, n_lang))
            p[random.choice(own)] = 1.0
            doc.append(d)
            rows.append(p)
    return np.array(doc), np.array(rows), random.integers(1, 4, len(doc))


@pytest.mark.parametrize("n_lang, parts", [(1, 1), (3, 1), (5, 2), (5, 4), (6, 5)])
def test_sets_against_all_subsets(n_lang, parts):
    random = np.random.default_rng(n_lang * 10 + parts)
    doc, p, times = mixed(random, n_lang, 30, parts)
    words = np.bincount(doc, times)
    first, _ = langid.mixture(doc, p, times, 30, np.ones((30, n_lang)))
    shares = langid.chosen(doc, p, times, first)
    assert shares.sum(axis=1) == pytest.approx(1)

    def value(sets):
        _, fit = langid.mixture(doc, p, times, 30, sets.astype(float))
        return fit - langid.PENALTY * np.log(1 + words) * (sets.sum(axis=1) - 1)

    best = np.full(30, -np.inf)
    for k in range(1, n_lang + 1):
        for chosen in combinations(range(n_lang), k):
            sets = np.zeros((30, n_lang), bool)
            sets[:, chosen] = True
            best = np.maximum(best, value(sets))
    got = value(shares > 0)
    # Backward elimination finds the best set, or, where sets are nearly alike, one within a fraction of the penalty.
    assert (got >= best - 1e-9).mean() >= 0.9
    assert (got >= best - 0.5 * langid.PENALTY * np.log(1 + words)).all()
    if parts > 3:
        assert ((shares > 0).sum(axis=1) > 3).any()


def test_negligible_shares_lose_less_than_the_penalty():
    random = np.random.default_rng(8)
    doc, p, times = mixed(random, 6, 40, 2)
    words = np.bincount(doc, times)
    first, fit = langid.mixture(doc, p, times, 40, np.ones((40, 6)), rounds=400)
    gone = langid.negligible(first, langid.PENALTY * np.log(1 + words) / words)
    _, left = langid.mixture(doc, p, times, 40, (~gone).astype(float), rounds=400)
    assert gone.any() and (~gone).any(axis=1).all()
    assert (fit - left <= gone.sum(axis=1) * langid.PENALTY * np.log(1 + words) + 1e-6).all()
