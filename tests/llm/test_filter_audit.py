from itertools import permutations

import numpy as np
import pytest

from scoreline.llm import filter_audit

from .conftest import prose


def brute(docs, labels):
    """Every order applied to every document, one by one: rows of audit() as a dict."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for doc_id, text, lang in docs:
        fails = {f for bit, f in enumerate("ABCD") if filter_audit.failures(text) >> bit & 1}
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == (text or "") for i, t, _ in docs):
            fails.add("E")
        rows.append((lang or "", fails, doc_id in good, doc_id in toxic))
    found = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in mine) - len(removed)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(removed)
                found[part, "".join(order), step] = [len(left), len(removed), redundant, sum(r[1] == {f} for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed)]
        for (p, order, step), counts in found.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return found


def as_dict(frame):
    assert frame.columns == ["part", "filter_order", "step", *filter_audit.COUNTS[:3], "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {tuple(r)[:3]: list(r)[3:] for r in frame.collect()}
    assert len(found) == frame.count()
    return found


def test_audit_equals_every_order_applied_one_by_one(messy, labels):
    docs = [(r.doc_id, r.text, r.lang) for r in messy.collect()]
    want = brute(docs, [tuple(r) for r in labels.collect()])
    assert as_dict(filter_audit.audit(messy, labels)) == want
    assert as_dict(filter_audit.audit(messy.repartition(7), labels.repartition(3))) == want


def test_copies_fail_by_id_not_by_order_of_rows(spark, labels):
    rows = [(9, "same", "en"), (3, "same", "de"), (3, "same", "de"), (None, "same", "en"), (5, "Same", "en"), (4, None, "en"), (6, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert as_dict(filter_audit.audit(docs, labels)) == brute(rows, [tuple(r) for r in labels.collect()])
    bits = filter_audit.all_bits(docs, labels.limit(0))
    assert sorted(r.part for r in bits.filter("bits & 16 > 0").collect()) == ["", "en"]


def test_random_tables(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), prose(int(rng.integers(40)), int(rng.integers(60, 160))) + "#$AB "[int(rng.integers(5))] * int(rng.integers(0, 120)), [None, "a", "b"][rng.integers(3)]) for i in rng.permutation(300)]
    marks = [(int(i), *map(int, rng.integers(0, 2, 2))) for i in rng.integers(0, 320, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = filter_audit.audit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    want = brute(rows, marks)
    assert as_dict(found) == want
    assert all(any(c[k] for c in want.values()) for k in range(7))


@pytest.mark.parametrize(("text", "bits"), [("a " * 99, 3), (" ".join(f"w{i}" for i in range(100)), 0), (None, 1), ("B" * 11 + " " + "b" * 88 + " x" * 0, 1 | 4), ("x|", 1 | 8), ("\x1c ", 1)])
def test_bounds_of_each_filter(text, bits):
    assert filter_audit.failures(text) == bits


def test_bitsets_of_any_length_equal_counting():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 63, 64, 65, 1000):
        bits = rng.integers(0, 128, n)
        for (before, f), counts in zip(filter_audit.STEPS, filter_audit.count_steps(bits), strict=True):
            gone, fails = bits & before > 0, bits >> f & 1 > 0
            here = fails & ~gone
            assert list(counts) == [(~gone & ~fails).sum(), here.sum(), (fails & gone).sum(), (here & (bits & 32 > 0)).sum(), (here & (bits & 64 > 0)).sum()]


def test_nothing(nothing, labels):
    assert filter_audit.audit(nothing, labels).count() == 0
