"""The maximum-entropy scores against a model worked out word by word, and its probabilities against 1."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.llm import maxent

PART = 20_000


def solved(counts, total, penalty=maxent.WORD_PENALTY):
    """Weights at which n = total * exp(w) / Z + penalty * w for each count n, by bisection of Z and of each weight."""

    def weights(z):
        out = []
        for n in counts:
            low, high = -60.0, 60.0
            for _ in range(80):
                w = (low + high) / 2
                low, high = (w, high) if n > total * math.exp(w) / z + penalty * w else (low, w)
            out.append(low)
        return out

    low, high = 1.0, 1e9
    for _ in range(80):
        z = math.sqrt(low * high)
        low, high = (z, high) if 1 + sum(map(math.exp, weights(z))) > z else (low, z)
    return weights(low)


@pytest.fixture(scope="module")
def fitted(spark, data):
    """Scores of the smallest table with few known words and several parts, and the vocabulary and class model behind them."""
    held = {}
    vocabulary, fit, word_gains, frequent_contexts = maxent.vocabulary, maxent.fit, maxent.word_gains, maxent.frequent_contexts
    docs = spark.read.parquet(f"{data}/documents.parquet")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(maxent, "vocabulary", lambda counts: held.setdefault("v", vocabulary(counts, 3000)))
        patch.setattr(maxent, "fit", lambda docs, v: held.setdefault("log_p", fit(docs, v)))
        patch.setattr(maxent, "SHARE", 2000)
        patch.setattr(maxent, "word_gains", lambda rows, v, tokens, met: word_gains(rows, v, held.setdefault("tokens", tokens), met, part_tokens=PART))
        patch.setattr(maxent, "frequent_contexts", lambda *args: held.setdefault("frequent", frequent_contexts(*args)))
        rows = {r.doc_id: r for r in maxent.score(docs, F.col("doc_id") % 5 != 1).collect()}
    return held, rows, {r.doc_id: r.text for r in docs.collect()}


def test_scores_against_brute_force(fitted):
    held, rows, texts = fitted
    v, log_p = held["v"], held["log_p"]
    assert -(-held["tokens"] // PART) > 3
    assert len(held["frequent"].contexts) > 3 and len(held["frequent"].records) > 0
    words = {d: [*(t or "").encode().lower().split(), maxent.END] for d, t in texts.items()}
    place = {w: int(v.place(np.array([maxent.hash_of(w)], np.uint64))[0]) for ws in words.values() for w in ws}
    cls = {w: int(v.classes[p]) for w, p in place.items()}
    often = Counter(w for d, ws in words.items() if rows[d].training for w in ws)
    shares = v.shares()
    share = {w: shares[p] if p >= 0 else (often[w] + v.prior) / v.rare_mass for w, p in place.items()}

    def contexts(ws):
        for i, w in enumerate(ws):
            yield w, (*(ws[i - k] if i >= k else None for k in (2, 1)), cls[w])

    seen, total = defaultdict(Counter), Counter()
    for d, ws in words.items():
        if rows[d].training:
            for w, x in contexts(ws):
                seen[x][w] += 1
                total[x] += 1
    model, solutions = {}, {}
    for x, counts in seen.items():
        kept = {w: n for w, n in counts.items() if n >= maxent.LEAST and place[w] >= 0}
        if kept:
            key = (tuple(kept.values()), total[x])
            if key not in solutions:
                solutions[key] = [math.exp(w) for w in solved(*key)]
            model[x] = dict(zip(kept, solutions[key], strict=True))
    assert len(model) > 100
    changed = 0
    for d, ws in words.items():
        classes = [cls[w] for w in ws]
        want = 0.0
        for i, (w, x) in enumerate(contexts(ws)):
            c = 0
            for k in (1, 2, 3):
                c = c * maxent.SYMBOLS + (classes[i - k] if i >= k else maxent.CLASSES)
            weights = model.get(x, {})
            p = (weights.get(w, 0.0) + share[w]) / (1 + sum(weights.values()))
            want += log_p[c, classes[i]] / math.log(10) + math.log10(p)
            changed += bool(weights)
        assert rows[d].score == pytest.approx(want, rel=2e-4, abs=1e-3)
    assert changed > 1000


def test_shares_of_each_class_sum_to_one(fitted):
    """With the words of a class and one unknown word, each class is shared out whole; so are the classes of a context."""
    held, rows, texts = fitted
    v, log_p = held["v"], held["log_p"]
    share = v.shares()
    sums = np.bincount(v.classes[:-1], share[:-1], maxent.CLASSES)
    often = Counter(w for d, t in texts.items() if rows[d].training for w in [*(t or "").encode().lower().split(), maxent.END])
    others = [n for w, n in often.items() if v.place(np.array([maxent.hash_of(w)], np.uint64))[0] < 0]
    assert len(others) > 100
    sums[maxent.RARE] += sum((n + v.prior) / v.rare_mass for n in [*others, 0])
    used = np.unique(v.classes)
    assert sums[used] == pytest.approx(1)
    assert np.exp(log_p).sum(axis=1) == pytest.approx(1)


def test_texts_that_occur_twice_score_apart(spark):
    """Of texts of like words, those that training holds twice score higher a token than those it holds once."""
    random = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(random.choice(vocabulary, 80)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in maxent.score(docs, F.lit(True)).collect()}
    assert min(got[i] for i in range(30)) > max(got[i] for i in range(30, 120))


def test_rows_in_another_order_are_an_error(spark, monkeypatch):
    calls = []
    numbered = maxent.numbered

    def other(batches):
        for part, row, seen in numbered(batches):
            yield part, row, seen + 1

    word_gains = maxent.word_gains

    def gains(*args):
        monkeypatch.setattr(maxent, "numbered", other)
        calls.append(1)
        return word_gains(*args)

    monkeypatch.setattr(maxent, "word_gains", gains)
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 3}x{k}" for k in range(50))) for i in range(30)], "doc_id long, text string")
    with pytest.raises(Exception, match="another order"):
        maxent.score(docs, F.lit(True)).collect()
    assert calls


def test_the_prior_of_the_rare_class_is_the_likeliest():
    random = np.random.default_rng(2)
    n, words = np.unique(random.geometric(0.6, 5000), return_counts=True)

    def likelihood(prior):
        total, types = n @ words, words.sum() + 1
        return sum(w * c * math.log((c - 1 + prior) / (total - 1 + prior * types)) for c, w in zip(n, words, strict=True))

    best = maxent.best_prior(n, words)
    assert likelihood(best) >= max(likelihood(p) for p in np.geomspace(0.02, 500, 200)) - 1e-6
    assert maxent.best_prior(np.zeros(0), np.zeros(0)) == 0.5


def test_scores_do_not_depend_on_how_contexts_are_dealt(spark, data, monkeypatch):
    """The same rows whether a table is one part or two thousand; in the second case many contexts, and words in them, are frequent."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    word_gains, frequent_contexts, fit, found, fitted = maxent.word_gains, maxent.frequent_contexts, maxent.fit, [], {}
    monkeypatch.setattr(maxent, "frequent_contexts", lambda *args: found.append(frequent_contexts(*args)) or found[-1])
    monkeypatch.setattr(maxent, "fit", lambda docs, v: fitted.setdefault("p", fit(docs, v)) if not fitted else fitted["p"])
    scores = []
    monkeypatch.setattr(maxent, "SHARE", 64)
    for tokens in (maxent.PART_TOKENS, maxent.PART_TOKENS // 2000):
        monkeypatch.setattr(maxent, "word_gains", lambda *args, tokens=tokens: word_gains(*args, part_tokens=tokens))
        scores.append({r.doc_id: r.score for r in maxent.score(docs, F.col("doc_id") % 5 != 1).collect()})
    assert len(found[0].contexts) == 0 and len(found[1].contexts) > 20 and len(found[1].records) > 5
    assert scores[1] == pytest.approx(scores[0], abs=1e-6)
