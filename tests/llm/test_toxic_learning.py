import numpy as np
import pytest

from scoreline.llm import toxicity


def test_texts_that_share_words_are_all_learnt_from(spark):
    """Every text shares its common words with others, of either label; only copies count once."""
    rows = [(i, f"the and of Word{i} more", int(i % 4 == 0)) for i in range(200)]
    rows += [(1000 + i, "The and  of word8 more", 1) for i in range(5)] + [(2000, rows[1][1], 1)]
    found = toxicity.distinct_texts(spark.createDataFrame(rows, "doc_id long, text string, y int")).collect()
    assert sorted((r.text, r.y, r.n) for r in found if r.n > 1) == [("the and of Word8 more", 1, 6)]
    assert len(found) == 201 and sum(r.n for r in found) == len(rows)
    assert {r.half for r in found} == {True, False}


def test_insults_come_from_the_labels_alone(spark):
    """Words that are in no list are learnt, and listed ones that the labels don't show as insults have no weight."""
    random = np.random.default_rng(8)
    words = [f"plain{i}" for i in range(300)]
    rows = [(i, " ".join([*random.choice(words, 30), *(["grobnik"] if i % 6 == 0 else ["clown", "idiot"] if i % 6 == 1 else [])]), int(i % 6 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.drop("text"))
    x = toxicity.sums(["the grobnik", "the clown", "the idiot"], model, toxicity.Codes(model))
    assert x[0].any() and not x[1:].any()
    p = toxicity.probabilities(x, model.coefficients)
    assert p[0] >= toxicity.THRESHOLD > p[1]


@pytest.mark.parametrize(
    "aimed, plain, denied, reported, threat",
    [
        ("you grobnik", "the grobnik", "not a grobnik", "said grobnik", "you kill"),
        ("du grobnik", "das grobnik", "kein grobnik", "sagte grobnik", "dich töten"),
        ("toi grobnik", "le grobnik", "pas un grobnik", "dit grobnik", "te tuer"),
        ("tú grobnik", "el grobnik", "nunca un grobnik", "dijo grobnik", "usted matar"),
    ],
)
def test_the_grammar_fires_in_every_language(aimed, plain, denied, reported, threat):
    model = toxicity.ToxicityModel({"grobnik": 2.0})
    x = toxicity.sums([aimed, plain, denied, reported, threat], model, toxicity.Codes(model))
    kinds = [[toxicity.KINDS[i] for i in np.flatnonzero(row)] for row in x]
    assert kinds == [[toxicity.AIMED], [toxicity.INSULT], [toxicity.DENIED], [toxicity.REPORTED], [toxicity.AIMED_THREAT]]


def cascade(symbols):
    """The rules of the grammar one after another over a whole clause, without transducers."""
    T, out, factor = toxicity, list(symbols), [1.0] * len(symbols)

    def near(mark, reach, ahead, i):
        """The places of the marks within reach before i, or after it; marks are never changed by a rule."""
        places = range(i + 1, min(len(symbols), i + 1 + reach)) if ahead else range(max(0, i - reach), i)
        return any(symbols[k] == mark for k in places)

    rules = [
        (T.NEGATION, T.NEGATION_REACH, False, T.INSULT, T.DENIED, 0.6), (T.REPORT, 10**6, False, T.INSULT, T.REPORTED, 0.6), (T.TARGET, T.TARGET_REACH, False, T.INSULT, T.AIMED, 1.5),
        (T.TARGET, T.TARGET_REACH, False, T.THREAT, T.AIMED_THREAT, 2.0), (T.REPORT, 10**6, True, T.INSULT, T.REPORTED, 0.6), (T.TARGET, T.TARGET_REACH, True, T.INSULT, T.AIMED, 1.5),
        (T.TARGET, T.TARGET_REACH, True, T.THREAT, T.AIMED_THREAT, 2.0),
    ]
    for mark, reach, ahead, old, new, f in rules:
        for i, s in enumerate(out):
            if s == old and near(mark, reach, ahead, i):
                out[i], factor[i] = new, factor[i] * f
    return out, factor


def test_clauses_against_the_rules_one_by_one():
    model, random = toxicity.ToxicityModel(), np.random.default_rng(6)
    for _ in range(500):
        symbols = random.choice(6, random.integers(1, 14), p=[0.4, 0.25, 0.1, 0.1, 0.1, 0.05]).tolist()
        want = cascade(symbols)
        assert toxicity.parsed(list(symbols), model) == want


def labelled(n=500):
    """Texts in two invented languages; toxic ones aim the insult at somebody, clean ones deny it."""
    random, rows = np.random.default_rng(9), []
    plain = [[f"{a}{i}" for i in range(150)] for a in ("lo", "ve")]
    insults, targets, denials = (("grobnik", "skarn"), ("zhu", "omu")), ("tebi", "vosto"), ("nikak", "nolle")
    for i in range(n):
        side, y = i % 2, int(i % 5 == 0)
        words = random.choice(plain[side], 30).tolist()
        at = int(random.integers(5, 25))
        if y:
            words[at : at + 2] = [targets[side], str(random.choice(insults[side]))]
        elif i % 50 in (1, 2):
            words[at : at + 2] = [denials[side], str(random.choice(insults[side]))]
        else:
            words[at] = targets[side]
        rows.append((i, " ".join(words), y))
    return rows


def test_words_beside_insults_are_learnt_in_every_language(spark):
    df = spark.createDataFrame(labelled(3000), "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.drop("text"))
    assert model.beside == {"tebi": toxicity.TARGET, "vosto": toxicity.TARGET, "nikak": toxicity.NEGATION, "nolle": toxicity.NEGATION}
    x = toxicity.sums(["lo1 tebi grobnik", "lo1 nikak grobnik", "ve1 vosto omu", "ve1 nolle omu"], model, toxicity.Codes(model))
    assert [[toxicity.KINDS[i] for i in np.flatnonzero(row)] for row in x] == [[toxicity.AIMED], [toxicity.DENIED]] * 2
    p = toxicity.probabilities(x, model.coefficients)
    assert min(p[0], p[2]) > max(p[1], p[3])


def test_scores_do_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = [sorted((r.doc_id, r.score) for r in toxicity.score(d, toxicity.train(d, labels)).collect()) for d in (docs, docs.repartition(7))]
    assert got[0] == got[1]


@pytest.mark.parametrize("text", ["you.\ngrobnik", "you\ngrobnik", "you。 grobnik", 'you." grobnik', "you… grobnik", "you؟ grobnik", "you a b c d grobnik", "you\r\ngrobnik", "grobnik\nyou"])
def test_what_parts_an_insult_from_its_target(text):
    model = toxicity.ToxicityModel({"grobnik": 2.0})
    row = toxicity.sums([text], model, toxicity.Codes(model))[0]
    assert [toxicity.KINDS[i] for i in np.flatnonzero(row)] == [toxicity.INSULT]


def test_a_threat_is_aimed_within_reach_alone():
    model = toxicity.ToxicityModel({"grobnik": 2.0})
    x = toxicity.sums(["you kill", "you a b c d kill", "kill a b c d you", "kill you"], model, toxicity.Codes(model))
    assert [[toxicity.KINDS[i] for i in np.flatnonzero(row)] for row in x] == [[toxicity.AIMED_THREAT], [toxicity.THREAT], [toxicity.THREAT], [toxicity.AIMED_THREAT]]


def test_no_coefficient_has_the_wrong_sign():
    random = np.random.default_rng(1)
    x = random.random((400, len(toxicity.KINDS))) * (random.random((400, len(toxicity.KINDS))) < 0.3)
    for slopes in ([2, 1, 0, 1, -3, -2], [2, -1, -1, 5, 1, 4], [-1, -1, -1, -1, -1, -1]):
        y = (random.random(400) < 1 / (1 + np.exp(1 - x @ np.array(slopes, float)))).astype(float)
        _, plain, denied, reported, aimed, threatened, aimed_threat = toxicity.signed_logistic(x, y, np.ones(400))
        assert min(plain, denied, reported, threatened) >= 0 and aimed >= plain and aimed_threat >= threatened
    y = (random.random(400) < 1 / (1 + np.exp(1 - x @ np.array([2.0, 1, 1, 4, 1, 3])))).astype(float)
    assert toxicity.signed_logistic(x, y, np.ones(400)) == pytest.approx(toxicity.logistic(x, y, np.ones(400)), abs=0.3)


@pytest.mark.parametrize(("aim", "deny", "say"), [("you", "not", "said"), ("dich", "kein", "sagte"), ("toi", "pas", "dit"), ("tú", "nunca", "dijo")])
def test_clauses_decide_where_labels_follow_them(spark, monkeypatch, aim, deny, say):
    """Where aimed insults are toxic and denied or reported ones are not, scoring without the cascades costs a tenth of the held-out F1."""
    random = np.random.default_rng(4)
    words, stems = [f"plain{i}" for i in range(200)], [f"{c}robnik" for c in "bgkmptvz"]

    def text(*clause):
        filler = [" ".join(random.choice(words, 8)) for _ in range(2)]
        return f"{filler[0]}. {' '.join(clause)}. {filler[1]}."

    rows = []
    for i in range(2600):
        stem, held_out = stems[random.integers(len(stems))], i >= 2000
        kind = ("aimed", "other", "plain")[i % 3] if held_out else "other" if i % 20 == 0 else ("aimed", "plain")[i % 2]
        other = (deny, "a", stem) if random.random() < 0.5 else (say, stem)
        rows.append((i, text(*{"aimed": (aim, stem), "other": other, "plain": random.choice(words, 3)}[kind]), int(kind == "aimed")))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")

    learnt = toxicity.learn_stems(df.filter("doc_id < 2000").selectExpr("text", "toxic as y"), 1.0)
    seen, asked = ([r for r in rows if (r[0] >= 2000) == held_out] for held_out in (False, True))

    def f1():
        model = toxicity.ToxicityModel(learnt)
        codes, y = toxicity.Codes(model), np.array([r[2] for r in asked])
        w = toxicity.signed_logistic(toxicity.sums([r[1] for r in seen], model, codes), np.array([r[2] for r in seen], float), np.ones(len(seen)))
        found = toxicity.probabilities(toxicity.sums([r[1] for r in asked], model, codes), w) >= 0.5
        return 2 * (found & (y == 1)).sum() / (found.sum() + y.sum())

    whole = f1()
    monkeypatch.setattr(toxicity, "FORWARDS", (lambda: toxicity.Transducer((), lambda state, symbol: (state, symbol, 1.0)),))
    monkeypatch.setattr(toxicity, "BACKWARDS", toxicity.FORWARDS)
    assert whole > 0.95 and f1() < whole - 0.1
