"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech, other. Insults are stems with weights, of all
languages, learnt from labelled texts alone; a short fixed list serves only where no stem could be learnt. Threats and
the other symbols are fixed lists in four languages, to which words are added that labelled clauses show to be telling
beside an insult. The grammar is two cascades of transducers from symbols to symbols. The first reads a clause forwards:

    negation      insults after a negation, up to NEGATION_REACH words on, become denied insults
    report        insults after a verb of saying become reported insults
    target        insults up to TARGET_REACH words after a target become aimed insults
    threat        threats up to TARGET_REACH words after a target become aimed threats

and the second reads what came out backwards:

    report        insults before a verb of saying become reported insults
    target        insults up to TARGET_REACH words before a target become aimed insults
    threat        threats up to TARGET_REACH words before a target become aimed threats

Each cascade is composed to one table, which runs over the symbols of each clause that holds an insult or a threat; the kinds
that come out, with their stems' weights, are summed over the document, and a logistic model of these sums gives the
score; its coefficients are not below 0, and being aimed at someone makes neither an insult nor a threat count less. A word by itself decides nothing: its weight enters by the kind that its clause gives it.

Learning. At most SAMPLE labelled rows of each label are used, chosen by a hash of the id. A stem (a word or its first
4 to 6 letters) is taken as an insult if its share of toxic texts is above the sample's by more than chance allows
for as many stems as were tried; up to ROUNDS times more, stems are looked for in the texts that hold none yet. Texts of
one label with the same words in the same order count once, so that copies of one text don't turn its words into insults.
With the stems known, the words up to TARGET_REACH places from an insult in its clause are counted. What is expected of a
word's texts is the share of toxic ones among those of the same stem, so that words of a language whose stems are surer
are not taken for telling: words with more toxic texts than chance allows become targets, those with fewer negations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, slices, texts

SAMPLE = 12_000
ROUNDS = 3
STEMS = (4, 5, 6)
NEGATION_REACH = 3
TARGET_REACH = 4
THRESHOLD = 0.3
CACHE_WORDS = 1 << 20
EDGES = ".,;:!?\"'()[]{}<>«»…|*$%&#-_"
#: Marks that end a clause in one script or another, what may follow them, and the mark that line ends are read as.
CLAUSE_ENDS = (".", "!", "?", ";", ":", "…", "。", "！", "？", "；", "：", "؟", "؛", "۔", "।", "॥", "።")
CLOSERS = "\"')]}»”’"
LINE_END = "¶"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, DENIED, REPORTED, AIMED, AIMED_THREAT = range(10)
KINDS = (INSULT, DENIED, REPORTED, AIMED, THREAT, AIMED_THREAT)

# Words of each symbol, in English, German, French and Spanish. Scoring doesn't know a text's language, so a
# word that is common with another sense in one of the others (German die, French du) is left out. The insults are a
# general list, for models without learnt stems only.
WORDS = {
    INSULT: "idiot fool jerk coward imbecile bastard creep dimwit",
    THREAT: "kill hurt beat destroy shoot stab "
    "töten töte umbringen verletzen verprügeln schlagen schlage zerstören erschießen erstechen "
    "tuer tuerai tuerais blesser frapper frapperai détruire abattre poignarder "
    "matar mataré mataría herir golpear golpearé destruir disparar apuñalar",
    TARGET: "you your you're u he she him her they them their "
    "du dich dir dein deine euch ihr er ihn ihm sie ihnen "
    "tu te toi vous votre vos il elle ils elles lui leur "
    "tú ti usted ustedes vosotros él ella ellos ellas",
    NEGATION: "not never no isn't aren't wasn't don't doesn't nobody "
    "nicht nie niemals kein keine keinen keiner niemand "
    "pas jamais aucun aucune personne n'est n'es "
    "nunca jamás ningún ninguna nadie tampoco",
    REPORT: "said says say wrote writes claimed called calls quoted told "
    "sagte sagt sagten schrieb schreibt behauptete behauptet nannte nennt zitierte "
    "dit disait écrit écrivait affirme affirmait appelait cité "
    "dijo dice decía escribió escribe afirmó llamó llama citó",
}
FIXED_WEIGHT = 2.0


@dataclass
class Transducer:
    """step(state, symbol) gives the next state, the symbol put out, and a factor on the symbol's weight."""

    start: tuple
    step: Callable[[tuple, int], tuple[tuple, int, float]]

    def then(self, other: Transducer) -> Transducer:
        def step(state, symbol):
            first, out, factor = self.step(state[0], symbol)
            second, out, more = other.step(state[1], out)
            return (first, second), out, factor * more

        return Transducer((self.start, other.start), step)

    def compiled(self, symbols: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables [state, symbol] of next state, output and factor for all states that can be reached from 0, the start."""
        states, rows = {self.start: 0}, []
        todo = [self.start]
        for state in todo:
            row = []
            for symbol in range(symbols):
                after, out, factor = self.step(state, symbol)
                if after not in states:
                    states[after] = len(states)
                    todo.append(after)
                row.append((states[after], out, factor))
            rows.append(row)
        table = np.array(rows)
        return table[..., 0].astype(int), table[..., 1].astype(int), table[..., 2]


def negation(reach: int = NEGATION_REACH, factor: float = 0.6) -> Transducer:
    def step(left, symbol):
        if symbol == NEGATION:
            return reach, symbol, 1.0
        if symbol == INSULT and left:
            return left - 1, DENIED, factor
        return max(0, left - 1), symbol, 1.0

    return Transducer(0, step)


def report(factor: float = 0.6) -> Transducer:
    def step(seen, symbol):
        if symbol == REPORT:
            return True, symbol, 1.0
        return seen, REPORTED if symbol == INSULT and seen else symbol, factor if symbol == INSULT and seen else 1.0

    return Transducer(False, step)


def target(reach: int = TARGET_REACH, factor: float = 1.5) -> Transducer:
    def step(left, symbol):
        if symbol == TARGET:
            return reach, symbol, 1.0
        if symbol == INSULT and left:
            return left - 1, AIMED, factor
        return max(0, left - 1), symbol, 1.0

    return Transducer(0, step)


def threat(reach: int = TARGET_REACH, factor: float = 2.0) -> Transducer:
    def step(left, symbol):
        if symbol == TARGET:
            return reach, symbol, 1.0
        if symbol == THREAT and left:
            return left - 1, AIMED_THREAT, factor
        return max(0, left - 1), symbol, 1.0

    return Transducer(0, step)


FORWARDS = (negation, report, target, threat)
BACKWARDS = (report, target, threat)


@dataclass
class ToxicityModel:
    stems: dict[str, float] = field(default_factory=dict)
    beside: dict[str, int] = field(default_factory=dict)  # words learnt beside insults, TARGET or NEGATION
    coefficients: np.ndarray = field(default_factory=lambda: np.array([-4.0, 2.0, 1.0, 1.0, 2.0, 1.0, 2.0]))

    def __post_init__(self) -> None:
        self.forwards, self.backwards = (reduce(Transducer.then, (part() for part in cascade)).compiled() for cascade in (FORWARDS, BACKWARDS))
        fixed = {w: (symbol, FIXED_WEIGHT) for symbol, words in WORDS.items() if symbol != INSULT or not self.stems for w in words.split()}
        self.entries = [(OTHER, 0.0)]
        self.places: dict[str, int] = {}
        beside = {w: (symbol, 0.0) for w, symbol in self.beside.items()}
        for stem, (symbol, weight) in (beside | fixed | {s + "*": (INSULT, w) for s, w in self.stems.items()}).items():
            self.places[stem] = len(self.entries)
            self.entries.append((symbol, weight))
        self.symbols = np.array([e[0] for e in self.entries])
        self.weights = np.array([e[1] for e in self.entries])

    def __getstate__(self):
        return {"stems": self.stems, "beside": self.beside, "coefficients": self.coefficients}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()


class Codes(dict):
    """Word to 2 * entry, plus 1 if the word ends a clause."""

    def __init__(self, model: ToxicityModel) -> None:
        super().__init__()
        self.places = model.places

    def __missing__(self, word: str) -> int:
        bare = word.strip(EDGES).lower()
        places = self.places
        entry = places.get(bare) or places.get(bare + "*") or next((e for n in STEMS if len(bare) > n and (e := places.get(bare[:n] + "*"))), 0)
        if len(self) >= CACHE_WORDS:
            self.clear()
        code = self[word] = 2 * entry + (word == LINE_END or word.rstrip(CLOSERS).endswith(CLAUSE_ENDS))
        return code


def marked_clauses(text: str, model: ToxicityModel, codes: Codes) -> Iterator[tuple[list[str], np.ndarray, list[int]]]:
    """Words, entries and symbols of each clause of the text that holds an insult or a threat; clauses end at marks and at line ends."""
    words = (text.replace("\n", f" {LINE_END} ") if "\n" in text else text).split()
    code = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    entry = code >> 1
    symbol = model.symbols[entry]
    marked = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    if not len(marked):
        return
    ends = np.flatnonzero(code & 1)
    for c in np.unique(np.searchsorted(ends, marked)).tolist():
        first = int(ends[c - 1]) + 1 if c else 0
        last = int(ends[c]) + 1 if c < len(ends) else len(words)
        yield words[first:last], entry[first:last], symbol[first:last].tolist()


def parsed(symbols: list[int], model: ToxicityModel) -> tuple[list[int], list[float]]:
    """The symbols that both cascades put out for a clause, and the factors on their weights."""
    factors, places = [1.0] * len(symbols), range(len(symbols))
    for (after, out, factor), order in ((model.forwards, places), (model.backwards, reversed(places))):
        state = 0
        for i in order:
            s = symbols[i]
            symbols[i], factors[i] = int(out[state, s]), factors[i] * float(factor[state, s])
            state = int(after[state, s])
    return symbols, factors


def sums(batch_texts: list[str | None], model: ToxicityModel, codes: Codes) -> np.ndarray:
    """(texts, kinds) log(1 + sum of weights) of what the grammar puts out."""
    out = np.zeros((len(batch_texts), len(KINDS)))
    column = {kind: i for i, kind in enumerate(KINDS)}
    for row, text in enumerate(batch_texts):
        for _, entry, symbols in marked_clauses(text, model, codes) if text else ():
            for kind, factor, e in zip(*parsed(symbols, model), entry.tolist(), strict=True):
                if kind in column:
                    out[row, column[kind]] += factor * model.weights[e]
    return np.log1p(out)


def probabilities(features: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(coefficients[0] + features @ coefficients[1:], -50, 50)))


def nested(features: np.ndarray) -> np.ndarray:
    """Columns whose weights, none below 0, make an aimed insult count no less than a plain one, and an aimed threat than a threat."""
    plain, denied, reported, aimed, threatened, aimed_threat = features.T
    return np.stack((plain + aimed, denied, reported, aimed, threatened + aimed_threat, aimed_threat), axis=1)


def signed_logistic(features: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """An intercept and a coefficient of each of KINDS, of the signs that the kinds have: those of ``nested`` that come out below 0 are left out, the lowest first."""
    x, used = nested(features), list(range(len(KINDS)))
    while True:
        w = logistic(x[:, used], y, weight)
        if not used or w[1:].min() >= 0:
            break
        used.pop(int(w[1:].argmin()))
    found = np.zeros(len(KINDS))
    found[used] = w[1:]
    plain, denied, reported, aimed, threatened, aimed_threat = found
    return np.array([w[0], plain, denied, reported, plain + aimed, threatened, threatened + aimed_threat])


def logistic(features: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps on the penalised likelihood, of an intercept and a coefficient a column."""
    x = np.column_stack((np.ones(len(y)), features))
    w = np.zeros(x.shape[1])
    w[0] = np.log((weight[y == 1].sum() + 0.5) / (weight[y == 0].sum() + 0.5))
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (weight * (y - p)) - penalty * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def stems_of(text: str) -> set[str]:
    bare = {w.strip(EDGES).lower() for w in text.split()}
    bare.discard("")
    return bare | {w[:n] for n in STEMS for w in bare if len(w) > n}


def text_hash(text: str) -> int:
    """Of the lower-cased words in their order."""
    return xxhash.xxh3_64_intdigest(b" ".join(text.lower().encode("utf-8", "surrogatepass").split())) >> 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, text, y of at most ``most`` documents of each label, and how many labelled rows each stands for.

    The labels kept are those with the smallest hashes of their ids; at most 2 * most of them are broadcast.
    """
    one = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(label).cast("int").alias("y"))
    counts = {int(r["y"]): r["count"] for r in one.groupBy("y").count().collect()}

    def least_hashes(y: int) -> DataFrame:
        rows, share = one.filter(F.col("y") == y).withColumn("hash", F.pmod(F.xxhash64("l_id"), F.lit(1 << 40))), 1.2 * (most + 1000) / max(1, counts.get(y, 0))
        rows = rows if share >= 1 else rows.filter(F.col("hash") < int(share * (1 << 40)))  # little more than is kept
        return rows.orderBy("hash", "l_id").limit(most).drop("hash")

    parts = [least_hashes(y) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, F.col("doc_id") == F.col("l_id"))
    return sample.select("doc_id", "text", "y"), {y: max(1.0, n / most) for y, n in counts.items()}


def surprising(t: np.ndarray, f: np.ndarray, base: np.ndarray | float, tried: int) -> np.ndarray:
    """Whether t toxic and f clean texts, where a share of base is expected, are more toxic than chance makes any of the words tried (odds of 1 to 3)."""
    n, base = t + f, np.clip(base, 1e-12, 1 - 1e-12)
    share = np.clip(t / np.maximum(n, 1), 1e-12, 1 - 1e-12)
    divergence = share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base))
    return (share > base) & (n * divergence > np.log(3 * max(1, tried)))


def _counting(known: set[str], wanted):
    def run(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch):
                for text in texts(part):
                    here = stems_of(text)
                    if not known.isdisjoint(here):
                        continue
                    here.add("")  # counts the texts
                    for stem in here if wanted is None else here & wanted.value:
                        counts[stem] = counts.get(stem, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["stem", "n"])

    return run


def learn_stems(rows: DataFrame, rate: float, least_precision: float = 0.8) -> dict[str, float]:
    """Stems and their weights from rows (text, y); a clean row stands for ``rate`` times as many as a toxic one."""
    size = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    stems: dict[str, float] = {}
    if not toxic or not clean:
        return stems

    def counted(y: int, known: set[str], wanted=None) -> DataFrame:
        return rows.filter(F.col("y") == y).select("text").mapInArrow(_counting(known, wanted), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))

    for _ in range(ROUNDS):
        known = set(stems)
        # No stem of fewer toxic texts than this can surprise, so those left are fewer than the sample's words.
        least = max(2, int(np.log(10) / np.log((toxic + clean) / toxic)))
        found = counted(1, known).filter(F.col("n") >= least).toPandas()
        wanted = rows.sparkSession.sparkContext.broadcast(set(found["stem"]))
        found = found.merge(counted(0, known, wanted).toPandas(), on="stem", how="left", suffixes=("", "_clean")).fillna({"n_clean": 0})
        whole = found["stem"] == ""
        if not whole.any():
            break
        left, others = float(found["n"][whole].iloc[0]), float(found["n_clean"][whole].iloc[0])
        found = found[~whole]
        t, f = found["n"].to_numpy(float), found["n_clean"].to_numpy(float)
        found["weight"] = np.log((t + 0.5) / (left + 1)) - np.log((f + 0.5) / (others + 1))
        found = found[surprising(t, f, left / max(1, left + others), len(found)) & (t / (t + f * rate) >= least_precision)]
        if not len(found):
            break
        for stem, weight in sorted(zip(found["stem"], found["weight"], strict=True), key=lambda x: (len(x[0]), x[0])):
            if not any(stem[:n] in stems for n in STEMS):
                stems[stem] = float(weight)
    return stems


def learn_beside(rows: DataFrame, model: ToxicityModel) -> dict[str, int]:
    """Words that stand near insults in toxic texts (targets) or in clean ones (negations) more often than the insults let expect, from rows (text, y)."""
    size = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}
    odds = np.log(size.get(1, 0) + 0.5) - np.log(size.get(0, 0) + 0.5)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        model, counts = shared.value, {}
        codes = Codes(model)
        expected = 1 / (1 + np.exp(-(model.weights + odds)))  # the share of toxic texts among those with a stem
        for batch in batches:
            for part in slices(batch):
                for text, y in zip(texts(part), texts(part, "y"), strict=True):
                    near: dict[str, float] = {}
                    for words, entry, symbols in marked_clauses(text, model, codes):
                        insults = np.flatnonzero(np.array(symbols) == INSULT)
                        for i, w in enumerate(words):
                            if symbols[i] == OTHER and len(insults):
                                at = insults[np.abs(insults - i).argmin()]
                                if abs(at - i) <= TARGET_REACH:
                                    near.setdefault(w.strip(EDGES).lower(), round(float(expected[entry[at]]), 6))
                    for w, share in near.items():
                        held = counts.setdefault(w, [0, 0, 0])
                        held[0] += y
                        held[1] += 1
                        held[2] += int(1e6 * share)  # whole numbers add up alike in any order
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(3))], names=["word", "t", "n", "e"])

    counted = rows.select("text", "y").mapInArrow(count, "word string, t long, n long, e long").groupBy("word")
    found = counted.agg(*(F.sum(c).alias(c) for c in ("t", "n", "e"))).filter("word <> ''").toPandas().sort_values("word")
    t, n, base = (found[c].to_numpy(float) for c in ("t", "n", "e"))
    base = base / np.maximum(n, 1) / 1e6
    out = {str(w): NEGATION for w in found["word"][surprising(n - t, t, 1 - base, len(found))]}
    return out | {str(w): TARGET for w in found["word"][surprising(t, n - t, base, len(found))]}


def learnt(rows: DataFrame, rate: float) -> ToxicityModel:
    model = ToxicityModel(learn_stems(rows, rate))
    return ToxicityModel(model.stems, learn_beside(rows, model)) if model.stems else model


def distinct_texts(sample: DataFrame) -> DataFrame:
    """text, y, n, half: each different text of each label once, as the row with the smallest doc_id has it, and the rows it stands for."""

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([text_hash(t) for t in texts(batch)], pa.int64())], names=["doc_id", "text", "y", "h"])

    # The sample is bounded, so its texts may be shuffled, and need few tasks however many shuffles have.
    once = map_batches(sample, mark, "doc_id long, text string, y int, h long").groupBy("h", "y").agg(F.min(F.struct("doc_id", "text")).alias("r"), F.count("*").alias("n"))
    once = once.coalesce(2 * max(2, sample.sparkSession.sparkContext.defaultParallelism))
    return checkpointed(once.select("r.text", "y", "n", (F.xxhash64("h") % 2 == 0).alias("half")))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> ToxicityModel:
    """Learn stems and coefficients from the rows of labels. Without labels of both kinds, or without rows, the fixed words serve alone.

    Null texts are empty, null ids have no label, and of labels of one id the largest counts. Repeated rows of one text
    and label count once, as many as they are; where hashes of ids tie, the smaller id is taken. Texts are read whole.

    The coefficients are fitted on each half of the sample with the stems of the other half, since stems found
    in a text tell more of that text than of others.
    """
    sample, stands_for = labelled_sample(docs, labels, label, most)

    sample = distinct_texts(sample)
    sizes = sample.groupBy("y").agg(F.sum("n").alias("rows"), F.count("*").alias("texts")).collect()
    stands_for |= {r["y"]: stands_for[r["y"]] * r["rows"] / r["texts"] for r in sizes}
    rate = stands_for.get(0, 1.0) / stands_for.get(1, 1.0)
    model = learnt(sample, rate)
    if not model.stems:
        return model
    halves = [learnt(sample.filter(F.col("half") == side), rate) for side in (False, True)]
    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, own, half = np.zeros((batch.num_rows, len(KINDS))), texts(batch), np.array(batch.column(3).to_pylist(), bool)
        for side, other in ((half, shared.value[0]), (~half, shared.value[1])):
            x[side] = sums([t for t, mine in zip(own, side, strict=True) if mine], other, Codes(other))
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    rows = map_batches(sample, features, "y int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist())
    order = np.lexsort((*x.T, rows["y"]))  # the same sums in any partitioning
    x, y = x[order], rows["y"].to_numpy(float)[order]
    weight = np.where(y == 1, stands_for.get(1, 1.0), stands_for.get(0, 1.0))
    model.coefficients = signed_logistic(x, y, weight)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1) of every row.

    Null and empty texts match nothing; texts are read whole. Repeated rows score alike, and there are no ties to break.
    Only doc_id and text are read, whatever other columns are named. Tables without rows give none.
    """
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scorer(docs, model, None), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold. Repeated rows fare alike; null and empty texts stay; tables without rows give none."""
    return map_batches(docs, _scorer(docs, model, threshold), docs.schema)


def _scorer(docs: DataFrame, model: ToxicityModel, threshold: float | None):
    shared, codes = docs.sparkSession.sparkContext.broadcast(model), []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not codes:
            codes.append(Codes(shared.value))
        p = probabilities(sums(texts(batch), shared.value, codes[0]), shared.value.coefficients)
        if threshold is not None:
            return batch.filter(pa.array(p < threshold))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return run
