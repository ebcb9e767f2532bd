import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreline.llm import spelling
from scoreline.llm.queries import op11_spelling_variants


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    found = {}
    for word, n in counts.items():
        others = [w for w in counts if near(word, w)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        form = best if best and counts[best] >= 2 * n else None
        found[word] = [n, len(others), form, form and counts[form]]
    for word, row in found.items():
        root = word
        while found[root][2]:
            root = found[root][2]
        row.append(root)
    return found


def result(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in rows}


def joined(spark, counts):
    return result(spelling.with_roots(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=5, max_size=8), max_size=80), st.sampled_from([1, 2, 1 << 18]))
def test_every_pair_comes_once_from_one_of_the_parts(words, block):
    whole, spelling.BLOCK = spelling.BLOCK, block
    try:
        found = Counter()
        for length in range(5, 9):
            for behind in (False, True):
                parts = {}
                for w in words:
                    if len(w) in (length, length + 1):
                        laid = w[::-1] if behind else w
                        parts.setdefault(laid[: length - length // 2 if behind else length // 2], []).append(laid)
                laid = sorted(w for part in parts.values() for w in part)
                for word, n in ((r["word"], r["n_near"]) for r in spelling.join_part(laid, [1] * len(laid), length, behind).to_pylist()):
                    found[word] += n
    finally:
        spelling.BLOCK = whole
    assert found == Counter({w: k for w in words if (k := sum(near(w, o) for o in words))})


def test_random_vocabulary_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abcéÿ"), rng.integers(5, 9))) for _ in range(700)}
    counts = {w: int(2 ** rng.integers(2, 9) + rng.integers(3)) for w in words} | {"z" * 300: 9, "z" * 301: 40, "z" * 150 + "y" + "z" * 150: 3}
    want = brute(counts)
    assert sum(r[2] is not None for r in want.values()) > 100
    assert joined(spark, counts) == want
    monkeypatch.setattr(spelling, "CHUNK", 10)
    monkeypatch.setattr(spelling, "BLOCK", 7)
    assert joined(spark, counts) == want


def test_ties_and_chains(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaaac": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbbb": 192, "ccccc": 5, "cccccc": 9, "ddddd": 7}
    found = joined(spark, counts)
    assert found == brute(counts)
    assert found["aaaaa"] == [3, 2, "aaaab", 6, "bbbbbb"] and found["ccccc"][2:] == [None, None, "ccccc"] and found["ddddd"][1] == 0


def test_typos_and_counts(spark):
    texts = [(i, "Hello helloÉ, hellô\thello_world x ÀÉÿ×÷é" * 3) for i in range(300)] + [(None, "HELLO Hello hello"), (7, None), (8, ""), (8, "hello"), (8, "hello")]
    docs = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, n string").withColumn("run", F.lit(1)).withColumn("word", F.lit(2))
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    runs = spelling.runs(docs)
    words = runs.select(spelling.typos(F.col("run"), F.col("doc_id")).alias("word"))
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert {r.word: r.n for r in spelling.vocabulary(words).collect()} == want
    assert len(want) > 5


def test_messy_tables(spark, messy, nothing, tmp_path):
    messy.write.parquet(f"{tmp_path}/a/documents.parquet")
    nothing.write.parquet(f"{tmp_path}/b/documents.parquet")
    counts = Counter()
    for r in messy.collect():
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")):
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = brute({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    assert result(op11_spelling_variants(spark, f"{tmp_path}/a")) == want
    assert op11_spelling_variants(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize("pair", [("abcde", "bbcde"), ("abcde", "abcd"), ("aaaaa", "aaaaaa"), ("abcde", "xabcde"), ("abcdé", "abcdè")])
def test_single_edits(spark, pair):
    counts = {pair[0]: 3, pair[1]: 9}
    if min(map(len, pair)) >= 5:
        assert joined(spark, counts)[pair[0]] == [3, 1, pair[1], 9, pair[1]]
