"""Rows that are alike in their keys: ties, repeats, and rows without an id."""

from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from scoreline.llm import mixing, neighbours, packing, tokens

from .conftest import prose


def test_pieces_of_rows_that_tie_lie_alike_in_any_partitioning(spark):
    rows = [(i % 3, prose(i % 2), "abcd"[i % 4]) for i in range(40)] + [(None, prose(i % 5), "ab"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def placed(df):
        return Counter((r.doc_id, r.n_words, r.bin_id, r.bin_start) for r in packing.pack_documents(df.filter("doc_id is not null"), capacity=200).collect())

    assert placed(docs) == placed(docs.repartition(7, "source")) == placed(docs.orderBy(F.col("source").desc()))
    every = packing.pack_documents(docs, capacity=200).collect()
    assert len(every) == 80 and sum(r.doc_id is None for r in every) == 40


def test_rows_without_an_id_are_ranked_by_text_and_repeated_as_one_id(spark):
    rows = [(None, prose(i), "a") for i in range(200)] + [(i, prose(i), "b") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs)
    taken = mixed.filter("source = 'a'").agg(F.sum("taken"), F.max("target"), F.max("size")).first()
    assert abs(taken[0] - taken[1]) <= taken[2]
    copies = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.max("copies").alias("n")).collect()}
    got = Counter(r.doc_id for r in mixing.repeat_rows(docs, mixed).collect())
    assert got == Counter({d: n * (200 if d is None else 1) for d, n in copies.items() if n})


def test_rows_of_one_id_or_none_fill_several_files(spark):
    rows = [(None if i % 2 else 7, prose(i)) for i in range(400)] + [(1, "first"), (9, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = f"{tokens.shared_path(spark)}/hot-{id(rows)}"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    segments = spark.read.parquet(folder)
    assert segments.select("part").distinct().count() > 2
    found = sorted(tokens.read_tokens(segments).collect(), key=lambda r: r.start)
    assert [r.start for r in found] == list(np.cumsum([0, *(r.n_tokens for r in found[:-1])]))
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)


def test_settings_meet_the_recall_however_far_neighbours_are():
    random = np.random.default_rng(6)
    queries, others = (neighbours.directions(random.normal(size=(60, 64))) for _ in range(2))
    row = np.arange(60)
    for n in (100, 20_000, 3_000_000):
        axes, probes = neighbours.fitted(n, queries, row, others, neighbours.TABLES)
        hit = np.zeros(60, bool)
        for t in range(neighbours.TABLES):
            hit |= (neighbours.buckets(queries, t, probes, axes) == neighbours.buckets(others, t, 1, axes)).any(axis=1)
        assert hit.mean() >= neighbours.RECALL


def test_a_query_of_huge_length(spark):
    random = np.random.default_rng(2)
    vectors = {i: [float(x) for x in random.normal(size=4)] for i in range(200)} | {1002: [1e200] * 4}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, F.col("vec_id") == 1002, top=5).orderBy("rank").collect()
    want = sorted((i for i in vectors if i != 1002), key=lambda i: -sum(vectors[i]))[:5]
    assert [r.vec_id for r in found] == want
