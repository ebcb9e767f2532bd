from itertools import combinations

import numpy as np
import pytest

from scoreline.llm import simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_copies(texts):
    """component of each id, by exact Jaccard of all pairs"""
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    return root


@pytest.fixture(scope="module")
def varied():
    """Texts of 80 to 300 words with one to six words changed: similarities on both sides of 0.8."""
    random, texts = np.random.default_rng(5), {}
    for base in range(25):
        words = [f"w{x}" for x in random.integers(0, 5000, random.integers(80, 300))]
        for changed in (0, 1, 2, 4, 6):
            own = list(words)
            for at in random.choice(len(own), changed, replace=False):
                own[at] = f"X{random.integers(0, 10**6)}"
            texts[len(texts)] = " ".join(own)
    return texts


@pytest.mark.parametrize("part_bytes", [simhash.PART_BYTES, 3000])
def test_near_copies_against_exact_similarity(spark, varied, part_bytes):
    docs = spark.createDataFrame(list(varied.items()), "doc_id long, text string").repartition(3)
    want = brute_copies(varied)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs, part_bytes=part_bytes).collect()} == want
    if part_bytes == simhash.PART_BYTES:
        assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(want.values())


def test_similar_against_brute_force():
    random = np.random.default_rng(6)
    base = random.integers(0, 2**63, (4, 40), np.uint64)
    sets = [np.unique(np.concatenate((random.choice(base[i % 4], random.integers(30, 41), replace=False), random.integers(0, 2**63, i % 5, np.uint64)))) for i in range(60)]
    root = simhash.similar(sets)
    held = [set(s.tolist()) for s in sets]
    group = list(range(60))
    for a, b in combinations(range(60), 2):
        if len(held[a] & held[b]) / len(held[a] | held[b]) >= 0.8:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    assert len({(r, g) for r, g in zip(root.tolist(), group)}) == len(set(group)) == len(set(root.tolist()))


def test_hubs_chains_and_missing_ids(spark):
    """Hubs go by broadcast; the result is the least id of the component, wherever it lies in it."""
    star = [(900, i) for i in range(1000, 3000)]  # 900 is the least
    hub = [(5000, i) for i in range(3001, 4500)] + [(3001, 7)]  # 7 hangs on one leaf
    chain = [(i, i + 1) for i in range(6000, 6040)]
    edges = [((a, f"n{a}"), (b, f"n{b}")) for a, b in star + hub + chain]
    unknown = (simhash.NO_ID, "nobody")
    edges += [(unknown, (8000, "n8000")), ((simhash.NO_ID, "x"), (simhash.NO_ID, "y"))]
    kind = "struct<i: long, n: string>"
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(4)
    ids = {x[1]: x[0] for e in edges for x in e} | {"alone": 9000}
    nodes = spark.createDataFrame([(n, None if i == simhash.NO_ID else i) for n, i in ids.items()], "name string, least_id long")
    got = {r.name: r.component_id for r in simhash.labelled(nodes, "name", df).collect()}
    want = {f"n{b}": 900 for _, b in star} | {f"n{b}": 7 for _, b in hub} | {f"n{b}": 6000 for _, b in chain}
    want |= {"n900": 900, "n5000": 7, "n3001": 7, "n6000": 6000, "n8000": 8000, "nobody": 8000, "x": None, "y": None, "alone": 9000}
    assert got == want


def test_keep_one_takes_candidates_by_fingerprints(spark, varied, monkeypatch):
    """With no band of MinHash, copies within a few bits are still found, and none below 0.8 is."""
    monkeypatch.setattr(simhash, "signature", lambda shingles: [1 + hash(shingles.tobytes())] if len(shingles) else [])
    texts = {d: t for d, t in varied.items() if d % 5 < 2} | {1000: None, 1001: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    fps = {d: simhash.majority(simhash.shingle_hashes(t)) for d, t in texts.items()}
    near = {b for a, b in combinations(sorted(texts), 2) if texts[a] and texts[b] and (fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS}
    assert len(near) > 2
    exact = brute_copies({d: t or "" for d, t in texts.items()})
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert not {d for d in near if exact[d] != d} & kept and set(exact.values()) <= kept


def test_fingerprints_in_reach_are_candidates_without_components(spark, varied, monkeypatch):
    """Each two fingerprints within the radius share a star; components are computed once, of confirmed links alone."""
    texts = {d: t for d, t in varied.items() if d % 5 < 2 and t}
    fps = {d: simhash.majority(simhash.shingle_hashes(t)) for d, t in texts.items()}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps.values()}
    nodes = spark.createDataFrame([(signed[f], min(d for d in fps if fps[d] == f)) for f in set(fps.values())], "fp long, least_id long")
    stars = {f: set() for f in signed.values()}
    for r in simhash.fingerprint_stars(nodes, simhash.RADIUS).collect():
        stars[r.fp].add(r.k)
    near = [(a, b) for a, b in combinations(signed, 2) if (a ^ b).bit_count() <= simhash.RADIUS]
    assert near and all(stars[signed[a]] & stars[signed[b]] for a, b in near) and all(f in own for f, own in stars.items())
    calls, found = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: calls.append(1) or found(edges))
    simhash.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(calls) == 1


def test_buckets_are_cut_into_parts_without_the_sets(spark, varied, monkeypatch):
    """in_parts joins by bucket, so what it is given is shuffled once more."""
    seen, cut = [], simhash.in_parts
    monkeypatch.setattr(simhash, "in_parts", lambda met, large, node: seen.append(met.columns) or cut(met, large, node))
    simhash.near_copies(spark.createDataFrame(list(varied.items()), "doc_id long, text string"))
    assert seen and not any("shingles" in columns for columns in seen)
