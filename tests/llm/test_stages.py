"""The pipeline's language, toxicity and mixing stages, each on what the one before kept, against plain versions of their rules."""

import math
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from scoreline.llm import langid, mixing, toxicity
from scoreline.llm.common import stored, table

from .test_toxic_learning import cascade


@pytest.fixture(scope="module")
def kept(spark, data):
    """What goes into each stage, and out of the last of them."""
    docs = [table(spark, data, "documents")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs.append(stored(stage(spark, docs[-1], data)))
    return docs


def em(words, sets):
    """Shares of the languages of a set and the log likelihood, word by word."""
    total = sum(n for _, n in words)
    shares = {lang: 1 / len(sets) for lang in sets}
    for _ in range(langid.ITERATIONS):
        new = dict.fromkeys(sets, 0.0)
        for p, n in words:
            whole = sum(shares[lang] * p[lang] for lang in sets)
            for lang in sets:
                new[lang] += n * shares[lang] * p[lang] / max(whole, 1e-300)
        shares = {lang: x / total for lang, x in new.items()}
    return shares, sum(n * math.log(max(sum(shares[lang] * p[lang] for lang in sets), 1e-300)) for p, n in words)


def test_language_stage_against_all_sets_of_languages(spark, kept, data):
    docs = kept[0].limit(60).cache()
    model = langid.train(kept[0])
    languages = range(len(model.languages))
    assert len(model.languages) == 4
    found = {r.doc_id for r in langid.keep_identified(docs, model).collect()}
    agree, rows = 0, docs.collect()
    for r in rows:
        words = []
        for word, n in Counter((r.text or "").lower().split()).items():
            bucket, _ = langid.trigrams([word])
            log_p = [langid.SHARPNESS * sum(model.log_p[b, k] for b in bucket) for k in languages]
            words.append(([math.exp(x - max(log_p)) for x in log_p], n))
        keep = False
        if words and langid.LETTER.search(r.text):
            whole, penalty = em(words, tuple(languages))[0], langid.PENALTY * math.log(1 + sum(n for _, n in words))
            best = max((s for k in range(1, 5) for s in combinations(languages, k)), key=lambda s: em(words, s)[1] - penalty * (len(s) - 1))
            shares = em(words, best)[0]
            top = max(best, key=lambda k: shares[k])
            keep = min(whole[top], shares[top]) >= 0.4
        agree += keep == (r.doc_id in found)
    assert agree >= len(rows) - 1


def test_toxicity_stage_against_the_rules_word_by_word(spark, kept, data):
    model = toxicity.train(kept[1], table(spark, data, "labels"))
    codes = toxicity.Codes(model)

    def score(text):
        sums = dict.fromkeys(toxicity.KINDS, 0.0)
        for line in (text or "").split("\n"):
            clause = []
            for word in [*line.split(), None]:
                if word is not None:
                    clause.append(codes[word] >> 1)
                if word is None or word.rstrip("\"')]}»”’").endswith(toxicity.CLAUSE_ENDS):
                    for entry, kind, factor in zip(clause, *cascade([int(model.symbols[e]) for e in clause]), strict=True):
                        if kind in sums:
                            sums[kind] += factor * model.weights[entry]
                    clause = []
        z = model.coefficients[0] + sum(c * math.log1p(sums[k]) for c, k in zip(model.coefficients[1:], toxicity.KINDS, strict=True))
        return 1 / (1 + math.exp(-z))

    want = {r.doc_id for r in kept[1].collect() if score(r.text) < toxicity.THRESHOLD}
    assert {r.doc_id for r in kept[2].collect()} == want


def test_mixing_stage_against_sql(kept, tmp_path):
    kept[3].coalesce(1).write.parquet(f"{tmp_path}/documents")
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    rows = connection.sql(mixing.MIX_SQL + "select doc_id, whole + case when size > 0 and 2 * before + size <= 2 * rest then 1 else 0 end as copies from b").fetchall()
    assert Counter(r.doc_id for r in kept[4].collect()) == Counter({doc_id: int(n) for doc_id, n in rows if n})
    assert np.ptp([n for _, n in rows]) > 0
