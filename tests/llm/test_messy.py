"""Every operator on a table with nulls, empty and long texts, ties, repeated rows and clashing columns, and on an empty one."""

import math
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from scoreline.llm import langid, maxent, mixing, neighbours, packing, perplexity, quality, simhash, tokens, toxicity
from scoreline.llm.common import stored

from .test_near_copies import brute_copies
from .test_operators import TOKENIZER, WORDS


def test_perplexity(messy, nothing):
    rows = perplexity.judge(messy).collect()
    assert len(rows) == messy.count()
    assert all(r.base_failed for r in rows if r.n_words < 20) and not any(r.kept for r in rows if r.base_failed)
    assert [r.log_perplexity for r in rows if r.doc_id == 4] == [None]
    assert perplexity.judge(nothing).count() == 0


def test_packing(messy, nothing):
    rows = packing.pack_documents(messy, capacity=256).collect()
    words = messy.select(F.sum(F.size(F.expr("filter(split(text, '[ \\\\t-\\\\r]+'), w -> w <> '')"))).alias("n")).first().n
    assert sum(r.n_words for r in rows) == words
    assert {r.doc_id for r in rows} == {r.doc_id for r in messy.collect()}
    assert packing.pack_documents(nothing).count() == 0


def test_langid(messy, nothing):
    model = langid.train(messy)
    rows = langid.identify(messy, model).collect()
    assert len(rows) == messy.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {None, 4, 5, 6, 10}
    assert all(0 <= r.score <= 1 for r in rows)
    assert set(langid.keep_identified(messy, model).columns) == set(messy.columns)
    assert langid.identify(nothing, langid.train(nothing)).count() == 0
    assert {r.lang_pred for r in langid.identify(messy, langid.train(nothing)).collect()} == {"und"}


def test_simhash(messy, nothing):
    rows = simhash.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert {(r.fp, r.component_id) for r in rows if r.doc_id in (4, 5, 6)} == {(0, 4)}
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id in (1, 2, 4, 5, 6)) == [1, 4]
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_one(nothing).count() == 0


def test_mixing(messy, nothing):
    rows = mixing.mix_sources(messy).collect()
    assert len(rows) == messy.count()
    assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in rows)
    assert mixing.mix_sources(nothing).count() == 0
    assert mixing.repeat_rows(messy, mixing.mix_sources(messy)).columns == messy.columns


def test_maxent(messy, nothing):
    rows = maxent.score(messy, F.col("doc_id") % 2 == 0).collect()
    assert len(rows) == messy.count()
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) and r.n_known <= r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (4, 5, 6)} == {1}
    assert maxent.score(nothing, F.lit(True)).count() == 0


def test_tokens(messy, nothing):
    rows = tokens.encode_and_read(messy, TOKENIZER, 2).collect()
    assert len(rows) == messy.count()
    assert {r.n_tokens for r in rows if r.doc_id in (4, 5, 6)} == {1}
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    assert [r.doc_id for r in ordered[2:]] == sorted(r.doc_id for r in ordered[2:])
    assert tokens.encode_and_read(nothing, TOKENIZER, 2).count() == 0


def test_toxicity(messy, nothing, labels):
    model = toxicity.train(messy, labels)
    rows = toxicity.score(messy, model).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.keep_clean(messy, model).columns == messy.columns
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0
    assert toxicity.train(messy, labels.limit(0)).stems == {}


def test_quality(messy, nothing, labels):
    rows = quality.classify(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(nothing, labels).count() == 0
    assert {r.score for r in quality.classify(messy, labels.limit(0)).collect()} == {0.5}


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5 + 1), float(i % 3), 1.0]) for i in range(1, 30)]
    bad = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [nan, 1.0, 1.0]), (103, [inf, 1.0, 1.0]), (104, [None, 1.0, 1.0]), (105, []), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad + good[:1]], "vec_id long, embedding array<float>, node string, score int")
    rows = neighbours.nearest(df, F.col("vec_id") % 10 == 0, top=5).collect()
    assert {r.query_id for r in rows} == {10, 20}
    assert not {r.vec_id for r in rows} & {100, 101, 102, 103, 104, 105, None}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") > 0).count() == 0


def test_pipeline_stages(spark, messy, nothing, data):
    docs = messy
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert set(docs.columns) == set(messy.columns)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.count() >= docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, data).count() == 0


def test_pipeline_against_brute_force(spark, data):
    """Each stage on what the one before kept: what goes, what stays, and that no word is lost in the end."""
    docs, kept = spark.read.parquet(f"{data}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, data))
        kept.append({r.doc_id: r.text for r in docs.collect()})
    known, clean, single, mixed = kept
    assert set(known) >= set(clean) >= set(single) >= set(mixed)
    want = brute_copies(clean)  # the rule for stages: five words, similarity 0.8 or more
    assert set(single) == set(want.values())
    copies = Counter(r.doc_id for r in docs.collect())
    assert max(copies.values()) <= 2
    words = sum(n * len(WORDS.findall(single[d])) for d, n in copies.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert sum(r.n_words for r in packed) == words
    assert sorted((r.doc_id, r.piece, r.n_words) for r in packed) == sorted((r.doc_id, r.piece, r.n_words) for r in corpus_pipeline.run(spark, data).collect())
