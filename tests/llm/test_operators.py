"""Every operator against brute force, an exact round trip, or held-out labels."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreline.llm import langid, maxent, mixing, neighbours, packing, perplexity, quality, queries, simhash, tokens, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(data):
    return dict(duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall())


# Quality rules


@given(st.lists(st.text(alphabet="ab \n\t.#|\xa0", max_size=80) | st.none(), max_size=6))
@settings(max_examples=60, deadline=None)
def test_base_counts(batch):
    got = perplexity.base_counts(batch)
    for i, text in enumerate(batch):
        text = text or ""
        words = WORDS.findall(text)
        seen, repeated = set(), 0
        for line in text.split("\n"):
            if WORDS.search(line):
                repeated += line in seen
                seen.add(line)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often = Counter(windows)
        inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeated, len(inside))
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_kneser_ney_sums_to_one_and_backs_off():
    keys, lengths = perplexity.grams(["the cat sat on the mat, the end.", "A DOG | sat"] * 3)
    assert list(lengths) == [32, 11] * 3 and len(keys) == lengths.sum()
    gram, count = np.unique(keys, return_counts=True)
    model = perplexity.KneserNey.estimate(gram, count)
    for context in [*gram[:20] // perplexity.A, 0, 12345, perplexity.A**3 - 1]:
        assert np.exp(model.log_probability(context * perplexity.A + np.arange(perplexity.A))).sum() == pytest.approx(1, abs=1e-5)
    assert model.log_probability(keys).mean() > model.log_probability(np.random.default_rng(1).integers(0, perplexity.A**4, 500)).mean()
    assert (np.diff(model.hashes.astype(object)) > 0).all()


def test_bands_keep_clean_documents(spark, data):
    rows = queries.op1_perplexity_rules(spark, data).collect()
    clean = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1").collect()}
    judged = [r for r in rows if r.doc_id in clean and not r.base_failed]
    assert sum(r.kept for r in judged) >= 0.97 * len(judged)


# Packing


@given(st.lists(st.tuples(st.integers(0, 25), st.sampled_from([None, "a", "b"]), st.sampled_from([None, 1, 2, 3])), max_size=30), st.sampled_from([0.1, 0.5, 1.0]))
@settings(max_examples=150, deadline=None)
def test_best_fit_against_brute_force(rows, share):
    sizes, sources, clusters = ([r[i] for r in rows] for i in range(3))
    got = packing.pack_shard(sizes, sources, clusters, 10, share)
    of = {s: sum(n % 10 for n, x in zip(sizes, sources, strict=True) if x == s) for s in set(sources) - {None}}
    most = {s: 10 * min(1.0, max(share, 1.25 * n / max(1, sum(of.values())), 1.25 / len(of))) for s, n in of.items()}
    bins = [(10, [i]) for i, n in enumerate(sizes) for _ in range(n // 10)]
    whole = len(bins)
    bins = [None] * whole
    want = [(i, k * 10) for i, n in enumerate(sizes) for k in range(n // 10)]
    places = dict(zip(want, range(whole), strict=True))
    for i in sorted((i for i, n in enumerate(sizes) if n % 10 or n == 0), key=lambda i: (-(sizes[i] % 10), i)):
        size = sizes[i] % 10
        fits = []
        for b in range(whole, len(bins)):
            left, inside = bins[b]
            if left > 0 and left >= size:
                same = [sizes[j] % 10 for j in inside if sources[j] == sources[i]] if sources[i] is not None else []
                twin = clusters[i] is not None and any(clusters[j] == clusters[i] for j in inside)
                if not (same and sum(same) >= most[sources[i]]) and not twin:
                    fits.append((left, b))
        b = min(fits)[1] if fits else len(bins)
        if b == len(bins):
            bins.append((10, []))
        bins[b] = (bins[b][0] - size, [*bins[b][1], i])
        places[i, sizes[i] - size] = b
    assert {(i, start): b for i, start, b, _ in got} == places
    for i, start, b, place in got:
        assert 0 <= place and place + min(10, sizes[i] - start) <= 10


def test_packing_covers_every_word(spark, data, docs):
    rows = queries.op2_pack_best_fit(spark, data).collect()
    held, inside = defaultdict(int), defaultdict(list)
    for r in rows:
        held[r.doc_id] += r.n_words
        inside[r.bin_id].append((r.bin_start, r.n_words))
    assert held == {d: len(WORDS.findall(t or "")) for d, t in docs.items()}
    for pieces in inside.values():
        pieces.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= packing.CAPACITY


@pytest.mark.parametrize("low, high, sources, least", [(20, 60, 1, 0.97), (20, 60, 3, 0.97), (50, 400, 1, 0.97), (1, 30, 2, 0.97), (50, 3000, 8, 0.9)])
def test_bins_are_full_whatever_the_texts_and_sources(low, high, sources, least):
    random = np.random.default_rng(2)
    sizes = random.integers(low, high, 4096).tolist()
    pieces = packing.pack_shard(sizes, random.choice(sources, 4096, p=np.arange(1, sources + 1) / sum(range(1, sources + 1))).tolist(), [None] * 4096)
    assert sum(sizes) >= least * packing.CAPACITY * len({b for _, _, b, _ in pieces})


# Language


def test_languages_of_held_out_documents(spark, data):
    rows = queries.op3_language_mixture(spark, data).filter("held_out").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_mixtures_have_both_languages(spark):
    one, two = "the house of this tree with that bird", "das haus und der baum mit dem vogel"
    df = spark.createDataFrame([(1, one * 20, "en"), (2, two * 20, "de")], "doc_id long, text string, lang string")
    model = langid.train(df)
    mixed = spark.createDataFrame([(1, f"{one} {one} {two}"), (2, two)], "doc_id long, text string")
    found = {r.doc_id: r for r in langid.identify(mixed, model).collect()}
    assert found[1].lang_pred == "en" and set(found[1].languages) == {"en", "de"} and 0.4 < found[1].score < 0.9
    assert set(found[2].languages) == {"de"}


# Near-duplicates


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash_against_brute_force(spark, data, docs):
    fps = {d: brute_fingerprint(t) for d, t in docs.items()}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, data).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in docs}


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=8), st.lists(st.lists(st.integers(0, 63), max_size=6), min_size=1, max_size=150), st.integers(0, 7))
@settings(max_examples=40, deadline=None)
def test_bit_slices_against_popcount(seeds, flips, radius):
    fps = np.array([seeds[i % len(seeds)] ^ sum({1 << b for b in bits}) for i, bits in enumerate(flips)], np.uint64)
    root = simhash.forest(fps, np.full(len(fps), len(fps)), radius)
    want = brute_components({i: int(f) for i, f in enumerate(fps)}, radius)
    assert [int(r) for r in root] == [want[i] for i in range(len(fps))]


def test_parts_of_large_buckets_lose_no_link(spark):
    random = np.random.default_rng(3)
    fps = {int(v) for v in (random.integers(0, 2**63, 40, np.uint64)[:, None] ^ (np.uint64(1) << random.integers(0, 40, (40, 5)).astype(np.uint64))).ravel()}
    df = spark.createDataFrame([(f, f) for f in fps], "fp long, least_id long")
    found = simhash.labelled(df, "fp", simhash.links(df, len(fps), part=7)).collect()
    assert {r.fp: r.component_id for r in found} == brute_components({f: f for f in fps})


def test_long_chains(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(df).collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


# Mixing


def test_mix_meets_targets(spark, data):
    rows = queries.op5_mix_sources(spark, data).collect()
    again = queries.op5_mix_sources(spark, data).collect()
    assert sorted(rows) == sorted(again)
    by_source = defaultdict(list)
    for r in mixing.mix_sources(spark.read.parquet(f"{data}/documents.parquet")).collect():
        by_source[r.source].append(r)
    total = sum(r["size"] for own in by_source.values() for r in own)
    assert sum(own[0].target for own in by_source.values()) == pytest.approx(1.5 * total)
    for own in by_source.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
        assert all(r.taken <= 2 * r["size"] for r in own)


def test_mix_is_the_same_in_sql(spark, data):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{data}/documents.parquet'")
    want = duck.sql(mixing.OP5_SQL).fetchall()
    got = [tuple(r) for r in queries.op5_mix_sources(spark, data).collect()]
    assert sorted(got) == sorted(want)


def test_shares_are_reshared_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, None: 40}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weight, left, want = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2])), 1.5 * sum(sizes.values()), {}
    while True:
        level = left / sum(weight[s] for s in sizes if s not in want)
        above = [s for s in sizes if s not in want and level * weight[s] > 2 * sizes[s]]
        if not above:
            break
        for s in above:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
    assert got == pytest.approx(want | {s: level * weight[s] for s in sizes if s not in want})


# LM scores


def test_base_scores_and_gain(spark, data, docs):
    rows = {r.doc_id: r for r in queries.op6_maxent_scores(spark, data).collect()}
    words = {d: [w.encode() if isinstance(w, str) else w for w in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())] + [None] for d, t in docs.items()}
    training = {d for d in docs if zlib.crc32(str(d).encode()) % 5 != 1}
    counts = Counter(w for d in training for w in words[d])
    n, v = sum(counts.values()), len(counts)
    for d, r in rows.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d not in training, len(words[d]), sum(counts[w] > 0 for w in words[d]), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words[d]), rel=1e-9)
    held_out = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)


def test_rare_tokens_go_by_the_join(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    training = F.col("doc_id") % 3 != 0
    want = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in maxent.score(docs, training).collect()}
    counts = maxent.stored(maxent.count_tokens(docs.filter(training)))
    small = maxent.vocabulary(counts, known=200)
    assert 0 < len(small.hashes) <= 200
    monkeypatch.setattr(maxent, "vocabulary", lambda c, known=200, f=maxent.vocabulary: f(c, 200))
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in maxent.score(docs, training).collect()} == want


def test_class_probabilities_sum_to_one():
    rows = maxent.feature_rows()
    p = np.exp(maxent.log_softmax(np.random.default_rng(1).normal(size=(maxent.ROWS, maxent.CLASSES)), rows[:, :500]))
    assert p.sum(axis=1) == pytest.approx(1)
    doc, cls = np.array([0, 0, 0, 1, 1]), np.array([3, 4, 5, 6, 7], np.uint8)
    s, none = maxent.SYMBOLS, maxent.CLASSES
    assert maxent.contexts(doc, cls).tolist() == [(a * s + b) * s + c for a, b, c in [(none, none, none), (3, none, none), (4, 3, none), (none, none, none), (6, none, none)]]


# Token files


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(max_examples=80, deadline=None)
def test_packing_bits_round_trip(width, ids):
    ids = np.array([i % 2**width for i in ids], np.uint32)
    packed = tokens.pack(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    assert tokens.unpack(packed, width, len(ids)).tolist() == ids.tolist()


@given(st.lists(st.tuples(st.integers() .filter(lambda x: abs(x) < 2**62) | st.none(), st.lists(st.integers(0, 2**17 - 1), max_size=40)), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_segments_give_random_access(rows):
    data = tokens.write_segment([d for d, _ in rows], [np.array(i, np.uint32) for _, i in rows], 17, block=16)
    segment = tokens.Segment(data)
    assert [(d, ids.tolist()) for d, _, ids in segment.documents()] == [(d, i) for d, i in rows]
    flat = [x for _, i in rows for x in i]
    for a in range(0, len(flat), 7):
        assert segment.ids(a, min(len(flat), a + 20)).tolist() == flat[a : a + 20]


def test_token_files_are_those_of_whole_texts(spark, data, docs):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(TOKENIZER), 0
    rows = {r.doc_id: r for r in queries.op7_pack_tokens(spark, data).collect()}
    for d in sorted(docs):
        ids = np.array([*tokenizer.encode(docs[d] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("text", ["It's été  a b", "<|endoftext|> x<|startoftext|>y", "A\x0bB\x1cCİΣσ", "12½€ a's 'll", "퟿\U0001f600 z"])
def test_words_make_up_the_text(text):
    from tokenizers import Tokenizer

    words = text.encode().split()
    ids = b"".join(tokens.word_ids(TOKENIZER)(words)[w] for w in words)
    assert np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_tokenizers_that_do_not_cut_at_white_space_are_refused(spark, data):
    import glob

    docs, refused = spark.createDataFrame([(1, "two  words\nand  more")], "doc_id long, text string"), 0
    for path in sorted(glob.glob("/opt/tokenizers/*.json")):
        try:
            whole = Tokenizer.from_file(path).encode("two  words\nand  more", add_special_tokens=False).ids
            parts = [i for w in ("two", "words", "and", "more") for i in Tokenizer.from_file(path).encode(w, add_special_tokens=False).ids]
        except Exception:  # not a tokenizer
            continue
        if whole != parts:
            refused += 1
            with pytest.raises(Exception, match="white space"):
                tokens.encode_and_read(docs, path, 2).collect()
    assert tokens.encode_and_read(docs, TOKENIZER, 2).count() == 1


# Toxicity


def test_grammar_weighs_clauses():
    model = toxicity.ToxicityModel()
    codes = toxicity.Codes(model)
    x = toxicity.sums(["you idiot", "the idiot", "not an idiot", "he said idiot", "idiot you", "I will kill you", "you said. kill", "nothing here", None, "not here. idiot", "idiot, he said"], model, codes)
    kinds = [{toxicity.KINDS[i] for i in np.flatnonzero(row)} for row in x]
    T = toxicity
    assert kinds == [{T.AIMED}, {T.INSULT}, {T.DENIED}, {T.REPORTED}, {T.AIMED}, {T.AIMED_THREAT}, {T.THREAT}, set(), set(), {T.INSULT}, {T.REPORTED}]
    assert x[0].sum() > x[1].sum() > x[2].sum()


def test_composition_is_the_cascade():
    one, two = toxicity.negation(), toxicity.target()
    table = one.then(two).compiled()
    random, state, states = np.random.default_rng(2), 0, [one.start, two.start]
    for symbol in random.integers(0, 6, 400):
        states[0], middle, f1 = one.step(states[0], int(symbol))
        states[1], out, f2 = two.step(states[1], middle)
        assert (table[1][state, symbol], table[2][state, symbol]) == (out, f1 * f2)
        state = table[0][state, symbol]


def test_toxic_labels(spark):
    data = "/root/testdata/sf0.01"
    rows = queries.op8_toxic_grammar(spark, data).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    found = [(r.predicted, label[r.doc_id]) for r in rows if r.doc_id in label]
    assert sum(p for p, y in found if y == 0) <= 0.02 * len(found)
    assert sum(p for p, y in found if y == 1) >= 0.6 * sum(y for _, y in found)


# Quality


def test_quality_labels_of_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    rows = queries.op9_quality_kernel(spark, data).filter("held_out").collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    found = [r.predicted == label[r.doc_id] for r in rows if r.doc_id in label]
    assert sum(found) >= 0.95 * len(found)


@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0.1, 5)), min_size=1, max_size=30))
@settings(max_examples=80, deadline=None)
def test_isotonic(points):
    value, weight = (np.array(x) for x in zip(*points, strict=True))
    got = quality.isotonic(value, weight)
    assert (np.diff(got) >= -1e-12).all()
    assert (got * weight).sum() == pytest.approx((value * weight).sum())
    best = ((got - value) ** 2 * weight).sum()
    for shift in (0.01, -0.01):
        assert ((np.maximum.accumulate(got + shift) - value) ** 2 * weight).sum() >= best - 1e-9


# Neighbours


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.linalg.norm(neighbours.turn(x, 0, 0), axis=1) == pytest.approx(np.linalg.norm(x, axis=1))
    assert neighbours.hadamard(np.eye(4)).tolist() == [[0.5, 0.5, 0.5, 0.5], [0.5, -0.5, 0.5, -0.5], [0.5, 0.5, -0.5, -0.5], [0.5, -0.5, -0.5, 0.5]]


def test_recall(spark, data):
    rows = queries.op10_cross_polytope(spark, data).collect()
    frame = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    want = neighbours.exact_nearest(frame, frame.vec_id[frame.vec_id % 20 == 0].to_numpy())
    got = defaultdict(dict)
    x = dict(zip(frame.vec_id, np.array(frame.embedding.tolist(), float), strict=True))
    for r in rows:
        got[r.query_id][r.rank] = r.vec_id
        assert r.score == pytest.approx(float((x[r.query_id] * x[r.vec_id]).sum()), abs=1e-12)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    assert sum(len(set(want[q]) & set(got[q].values())) for q in want) >= 0.9 * 20 * len(want)


def test_ties_of_many_different_vectors(spark):
    """More different vectors tie than results are asked for: the smallest ids win, wherever the rows lie."""
    random = np.random.default_rng(11)
    order = random.permutation(400)
    vectors = {int(i): [1.0, float(a), float(b), 0.0] for i, (a, b) in zip(order, ((a, b) for a in range(20) for b in range(20)), strict=True)}
    vectors |= {1000: [1.0, 0.0, 0.0, 0.0], 1001: [2.0, 0.0, 0.0, 0.0], 1002: [float("1e200")] * 4}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").filter("vec_id < 1002")
    rows = neighbours.nearest(df, F.col("vec_id") == 1000, top=20, probes=16).orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [1001, *range(19)]
    assert [r.score for r in rows] == [2.0] + [1.0] * 19
    huge = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    far = neighbours.nearest(huge, F.col("vec_id") == 1002, top=2).orderBy("rank").collect()
    assert [r.vec_id for r in far] == sorted(vectors, key=lambda i: (-sum(vectors[i]) * (i != 1002), i))[:2]


def test_copies_ties_and_parts(spark):
    random = np.random.default_rng(4)
    base = random.normal(size=(30, 8)).round(2)
    vectors = [base[i % 30].tolist() for i in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    x = np.array(vectors)
    rows = neighbours.nearest(df, F.col("vec_id") % 50 == 0, top=15, tables=30, probes=16, part=5).collect()
    for q in range(0, 300, 50):
        score = (x * x[q]).sum(axis=1)
        want = [int(i) for i in np.lexsort((np.arange(300), -score)) if i != q][:15]
        assert [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] == want


@pytest.mark.parametrize("lengths", ["equal", "lognormal", "one long", "one very long", "two bands"])
def test_recall_with_unequal_norms(spark, lengths):
    random = np.random.default_rng(12)
    x = random.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "lognormal":
        x *= random.lognormal(0, 1, (len(x), 1))
    elif lengths == "two bands":
        x[::2] *= 3
    elif lengths != "equal":
        x[77] *= 10 if lengths == "one long" else 1000
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    rows = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    frame = df.toPandas()
    want = neighbours.exact_nearest(frame, np.arange(0, 3000, 20))
    got = defaultdict(set)
    for r in rows:
        got[r.query_id].add(r.vec_id)
    assert all(len(got[q]) == 20 for q in want)
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("n", [2, 15, 21, 60])
def test_small_tables_give_every_query_its_rows(spark, n):
    random = np.random.default_rng(n)
    df = spark.createDataFrame([(i, random.normal(size=6).tolist()) for i in range(n)], "vec_id long, embedding array<float>")
    rows = neighbours.nearest(df, F.col("vec_id") >= 0).collect()
    assert len(rows) == n * min(20, n - 1)


def test_large_buckets_and_busy_groups(spark):
    """All vectors point nearly one way, so one bucket holds most of them and most queries."""
    random = np.random.default_rng(5)
    x = np.array([1.0, *[0.0] * 7]) + 0.05 * random.normal(size=(600, 8))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    rows = neighbours.nearest(df, F.col("vec_id") % 2 == 0, part=50, turn_of=20, recall=1.0).collect()
    want = neighbours.exact_nearest(df.toPandas(), np.arange(0, 600, 2))
    got = defaultdict(set)
    for r in rows:
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.95 * 20 * len(want)
