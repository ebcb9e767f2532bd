"""The quality classifier against the same sums made at once in one place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.llm import quality
from scoreline.llm.common import sum_vectors


def test_scores_against_brute_force(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.score for r in quality.classify(docs.repartition(5), labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    ids = list(texts)
    x = np.array([np.array(quality.statistics(texts[i]), np.float32) for i in ids], float)
    scale = np.sqrt(np.maximum((x * x).mean(axis=0) - x.mean(axis=0) ** 2, 0))
    random = np.random.default_rng(9)
    w, b = random.normal(size=(x.shape[1], quality.FREQUENCIES)) / quality.BANDWIDTH, random.uniform(0, 2 * np.pi, quality.FREQUENCIES)
    z = np.clip((x - x.mean(axis=0)) / np.where(scale > 1e-9, scale, 1), -quality.CLIP, quality.CLIP)
    z = np.column_stack((np.ones(len(z)), np.sqrt(2 / quality.FREQUENCIES) * np.cos(z @ w + b)))
    row = {i: k for k, i in enumerate(ids)}
    used = [i for i in ids if i in y]
    half = {r.doc_id: r.half for r in spark.createDataFrame([(i,) for i in used], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")).collect()}

    def ridge(some):
        a, t = z[[row[i] for i in some]], np.array([y[i] for i in some], float)
        penalty = np.full(a.shape[1], quality.RIDGE)
        penalty[0] = 1e-9
        return np.linalg.solve(a.T @ a + np.diag(penalty) * len(a), a.T @ t)

    other = [ridge([i for i in used if half[i] != side]) for side in (0, 1)]
    bins = quality.bin_of(np.array([z[row[i]] @ other[half[i]] for i in used]))
    held = np.unique(bins)
    share = np.array([np.mean([y[i] for i, k in zip(used, bins, strict=True) if k == v]) for v in held])
    steps = quality.isotonic(share, np.array([(bins == v).sum() for v in held]))
    assert (np.diff(steps) >= -1e-12).all()
    want = np.clip(np.interp(z @ ridge(used), (held + 0.5) / quality.BINS * 2 - 0.5, steps), 0, 1)
    close = np.abs(want - np.array([got[i] for i in ids])) < 1e-3
    assert close.mean() >= 0.97  # a score at the edge of a bin may fall in the next


@pytest.mark.parametrize("partitions", [1, 7, 150])
def test_sums_of_many_partitions(spark, partitions):
    df = spark.range(1000).repartition(partitions)
    got = sum_vectors(df, lambda batch: np.array([batch.num_rows, *np.outer([1, 2, 3], [np.sum(batch.column(0).to_numpy())]).ravel()], float), 4, 2)
    assert got.tolist() == [1000, 499500, 999000, 1498500]


def test_a_group_holds_a_bounded_number_of_sums(spark, monkeypatch):
    from scoreline.llm import common

    rows = [(i % 2, i, np.array([i, 1.0]).tobytes()) for i in range(600)]
    df = spark.createDataFrame(rows, "part long, lane long, sums binary")
    got = {r.part: np.frombuffer(r.sums).tolist() for r in common.tree_sum(df, 600, np.float64, 5).collect()}
    assert got == {0: [sum(range(0, 600, 2)), 300], 1: [sum(range(1, 600, 2)), 300]}
