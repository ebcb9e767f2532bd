"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(token | those before) = P(class | classes of the three before) * P(token | class, the two words before).

Classes. END, the most frequent words, one class each; the CLASSED most frequent of the others by topic and
by frequency; all other tokens, unknown ones included, are the rare class. A topic is a group of documents with like shares
of the HEAD most frequent words, found by k-means; a word's topic is the one in which it is most over-represented.

P(class | ...) is a softmax of summed weights of features of the three classes before: each n-gram of
them and each skip (the second, the third, the first with the third), hashed to ROWS rows of a weight for each class. What the likelihood needs
of the corpus is how often each class follows each context of three, which Spark counts over all training texts;
training then goes over these counts in distributed steps: tasks sum what the model expects in their contexts, and
each weight moves to where a bound of the likelihood, less a quadratic penalty, is highest.

P(token | class, ...) is a softmax over the features of a context, which is a hash of the two words before and the
class: one weight for each known word that followed there LEAST times or more in training, and a weight of 0 for all else.
All else is shared out as the class is without a context, by count + 0.5, or in the rare class by count and a prior that the counts of
counts choose, with the exact counts of all words. Contexts
are dealt by their hash to parts of about PART_TOKENS tokens; a part counts its n-grams, climbs the penalised likelihood of its
weights by Newton's steps, and scores the tokens of all texts that fall in it, so that this table grows with the corpus and is
never in one place. Which contexts have features does not depend on the size of a table: contexts that hold
a large share of a part are dealt by context and word, since the words of a context share its total and its normaliser alone,
which are worked out first, from the counts of counts of its words. What is so frequent even as a context and a word is looked up where
it is met. Neither list is longer than SHARE * parts.

Counts of all tokens are kept; those of the KNOWN most frequent are broadcast, and tokens beyond them get their counts by
a join on 64-bit hashes; they have no features of their own. Sizes that go to the driver or to each task are bounded by the constants and by SHARE * parts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Numbering, checkpointed, slices, stored, sum_vectors, texts, tree_sum

KNOWN = 1 << 18
CLASSED = 1 << 17
HEAD = 64
TOPICS = 6
SINGLES = 14
BINS = 4
CLASSES = SINGLES + 2 + TOPICS * BINS
RARE, END_CLASS = CLASSES - 1, CLASSES - 2
SYMBOLS = CLASSES + 1  # the last stands before a text
ROWS = 1 << 12
STEPS = 20
PENALTY = 1.0
#: Features of a context that move at once; all seven would be the safe figure, but they overlap.
SHARING = 5.0
END = b" "  # no word holds a space
HELD_WORDS = 1 << 20
#: Documents that k-means takes its first centres from, those with the smallest hashes of their texts.
STARTING = 4096
K_MEANS = 8
LEAST = 2
WORD_PENALTY = 0.3
PART_TOKENS = 1 << 21
#: A context with more than 1 / SHARE of a part's tokens is frequent. Slices tell of contexts that they hold TOLD times.
SHARE = 4
TOLD = 8
WORD_BITS = 19
OTHER_WORD = (1 << WORD_BITS) - 1


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def tokens_of(batch_texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different tokens, and document and number of every token; each text ends with END."""
    numbers, counts, found = Numbering(), [], []
    for text in batch_texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        words.append(END)
        counts.append(len(words))
        found.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    hashes = np.fromiter(map(hash_of, numbers), np.uint64, len(numbers))
    return hashes, np.repeat(np.arange(len(counts)), counts), np.concatenate(found)


def count_tokens(docs: DataFrame) -> DataFrame:
    """h (the token's hash as a signed long) and n of every token of all texts."""

    def run(batches):
        counts: Counter = Counter()

        def rows():
            hashes = np.fromiter(map(hash_of, counts), np.uint64, len(counts))
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["h", "n"])

        for batch in batches:
            for part in slices(batch):
                for text in texts(part):
                    counts.update(text.encode("utf-8", "surrogatepass").lower().split() if text else [])
                    counts[END] += 1
                if len(counts) > HELD_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted
    counts: np.ndarray
    total: int
    distinct: int
    least: int  # all tokens with at least this count are here
    classes: np.ndarray | None = None
    by_count: tuple[np.ndarray, np.ndarray] | None = None  # counts, and how many tokens have each
    class_mass: np.ndarray | None = None
    prior: float = 0.5  # what is added to counts in the rare class
    rare_mass: float = 1.0

    def shares(self) -> np.ndarray:
        """Of each known token in its class, and of one that is not known if its count and the prior came to 1."""
        rare, mass = self.classes == RARE, np.where(self.classes == RARE, self.rare_mass, self.class_mass[self.classes])
        return np.where(rare, np.append(self.counts + self.prior, 1), np.append(self.counts, 0) + 0.5) / np.maximum(mass, 1e-300)

    @property
    def mass(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 if it is not among the known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def head(self) -> np.ndarray:
        """Indices of the HEAD most frequent words."""
        order = np.lexsort((self.hashes, -self.counts))
        return order[self.hashes[order] != np.uint64(hash_of(END))][:HEAD]


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """The most frequent tokens, with all of one count or none, as many as fit in known."""
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).toPandas().sort_values("n", ascending=False)
    fits = by_count[by_count["words"].cumsum() <= known]
    least = int(fits["n"].min()) if len(fits) else 1
    rows = counts.filter(F.col("n") >= least).toPandas() if len(fits) else counts.limit(0).toPandas()
    hashes = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    histogram = by_count["n"].to_numpy(np.int64), by_count["words"].to_numpy(np.int64)
    return Vocabulary(hashes[order], rows["n"].to_numpy(np.int64)[order], int(histogram[0] @ histogram[1]), int(histogram[1].sum()), least, by_count=histogram)


def head_shares(hashes: np.ndarray, doc: np.ndarray, token: np.ndarray, n_docs: int, v: Vocabulary, head: np.ndarray) -> np.ndarray:
    """(documents, HEAD) square roots of the shares of the head words, of unit length."""
    column = np.full(len(v.hashes) + 1, -1)
    column[head] = np.arange(len(head))
    which = column[v.place(hashes)][token]
    used = which >= 0
    x = np.sqrt(np.bincount(doc[used] * HEAD + which[used], minlength=n_docs * HEAD).reshape(n_docs, HEAD).astype(float))
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def nearest_topic(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T).argmax(axis=1)


def topics(docs: DataFrame, v: Vocabulary) -> np.ndarray:
    """Centres of k-means on the head shares of all documents. The first are the farthest apart of STARTING documents."""
    shared = docs.sparkSession.sparkContext.broadcast((v, v.head()))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                own = texts(part)
                x = head_shares(*tokens_of(own), len(own), *shared.value).astype(np.float32)
                hashes = [xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) >> 1 for t in own]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(hashes, pa.int64())], names=["x", "h"])

    x = checkpointed(docs.select("text").mapInArrow(run, "x binary, h long"))
    share = 1.2 * (STARTING + 1000) / max(1, x.count())
    some = x if share >= 1 else x.filter(F.col("h") < int(share * (1 << 63)))
    some = some.orderBy("h", "x").limit(STARTING).toPandas()["x"]
    start = np.frombuffer(b"".join(some), np.float32).reshape(-1, HEAD).astype(float)
    if not len(start):
        return np.zeros((TOPICS, HEAD))
    centres = start[:1]
    while len(centres) < TOPICS:  # the farthest from those chosen
        centres = np.vstack((centres, start[(start @ centres.T).max(axis=1).argmin()]))
    for _ in range(K_MEANS):
        held = centres

        def of(batch: pa.RecordBatch, held=held) -> np.ndarray:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(-1, HEAD).astype(float)
            return (np.eye(TOPICS)[nearest_topic(rows, held)].T @ rows).ravel()

        total = sum_vectors(x.select("x"), of, TOPICS * HEAD, 1).reshape(TOPICS, HEAD)
        length = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, total / np.maximum(length, 1e-12), centres)
    return centres


def set_classes(docs: DataFrame, v: Vocabulary) -> None:
    """Give each known token its class, and each class its mass."""
    centres = topics(docs, v)
    order = np.lexsort((v.hashes, -v.counts))
    order = order[v.hashes[order] != np.uint64(hash_of(END))]
    classed = order[SINGLES:CLASSED]
    column = np.full(len(v.hashes) + 1, -1, np.int64)
    column[classed] = np.arange(len(classed))
    shared = docs.sparkSession.sparkContext.broadcast((v, v.head(), centres, column))
    width = max(1, len(classed)) * TOPICS

    def of(batch: pa.RecordBatch) -> np.ndarray:
        v, head, centres, column = shared.value
        total = np.zeros(width)
        for part in slices(batch):
            own = texts(part)
            hashes, doc, token = tokens_of(own)
            topic = nearest_topic(head_shares(hashes, doc, token, len(own), v, head), centres)
            which = column[v.place(hashes)][token]
            used = which >= 0
            total += np.bincount(which[used] * TOPICS + topic[doc[used]], minlength=width)
        return total

    by_topic = sum_vectors(docs.select("text"), of, width).reshape(-1, TOPICS)[: len(classed)]
    v.classes = np.full(len(v.hashes) + 1, RARE, np.uint8)  # the last for tokens not known
    v.classes[order[:SINGLES]] = np.arange(len(order[:SINGLES]))
    topic = (by_topic / np.maximum(by_topic.sum(axis=0), 1)).argmax(axis=1) if len(classed) else np.zeros(0, int)
    for t in range(TOPICS):
        own = classed[topic == t]
        upto = np.cumsum(v.counts[own])
        if len(own):
            v.classes[own] = SINGLES + t * BINS + np.minimum(BINS - 1, (upto - v.counts[own]) * BINS // upto[-1])
    v.classes[v.place(np.array([hash_of(END)], np.uint64))] = END_CLASS  # rare if there is no training text
    known = np.bincount(v.classes[:-1], v.counts + 0.5, CLASSES)
    known[RARE] += v.mass - known.sum()
    v.class_mass = known
    n, words = v.by_count
    own = v.classes[:-1] != RARE
    left = words - np.bincount(len(n) - 1 - np.searchsorted(n[::-1], v.counts[own]), minlength=len(n))
    v.prior = best_prior(n[left > 0], left[left > 0])
    v.rare_mass = float(n @ left + v.prior * (left.sum() + 1))


def best_prior(n: np.ndarray, words: np.ndarray) -> float:
    """What to add to counts, so that each occurrence is likeliest given all others: n counts, words tokens of each, and one unknown token.

    A golden section of the logarithm of the prior between 0.01 and 1000.
    """
    total, types = float(n @ words), float(words.sum() + 1)
    if total < 2:
        return 0.5

    def likelihood(x: float) -> float:
        prior = np.exp(x)
        return float((n * words) @ np.log(n - 1 + prior) - total * np.log(total - 1 + prior * types))

    low, high, ratio = np.log(0.01), np.log(1000.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (a, high) if likelihood(a) < likelihood(b) else (low, b)
    return float(np.exp((low + high) / 2))


def contexts(doc: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Number of the context of each token: the class before times SYMBOLS**2, and so on."""
    before, out = cls.astype(np.int64), np.zeros(len(cls), np.int64)
    for k in range(1, 4):
        inside = np.concatenate((np.zeros(k, np.int64), before[:-k]))[: len(cls)]
        same = np.concatenate((np.full(k, -1), doc[:-k]))[: len(cls)] == doc
        out = out * SYMBOLS + np.where(same, inside, CLASSES)
    return out


N_CONTEXTS = SYMBOLS**3


def feature_rows() -> np.ndarray:
    """(features, contexts) row of the weights for each feature of each context."""
    every = np.arange(N_CONTEXTS)
    a, b, c = every // SYMBOLS**2, every // SYMBOLS % SYMBOLS, every % SYMBOLS
    none = np.zeros_like(every)
    kinds = [(none, none, none), (a, none, none), (a, b, none), (a, b, c), (none, b, none), (none, none, c), (a, none, c)]
    rows = []
    for kind, parts in enumerate(kinds):
        x = np.full(N_CONTEXTS, kind, np.uint64)
        for part in parts:
            x = (x * np.uint64(SYMBOLS) + part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
        rows.append((x % np.uint64(ROWS)).astype(np.int64))
    return np.stack(rows)


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.zeros((rows.shape[1], CLASSES))
    for row in rows:
        total += weights[row]
    total -= total.max(axis=1, keepdims=True)
    return total - np.log(np.exp(total).sum(axis=1, keepdims=True))


def climb(observed: np.ndarray, expected: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The moves x that solve observed = expected * exp(SHARING * x) + PENALTY * (offset + x), each by Newton's steps."""
    x = np.zeros_like(observed)
    for _ in range(12):
        grown = expected * np.exp(SHARING * x)
        x += np.clip((observed - grown - PENALTY * (offset + x)) / (SHARING * grown + PENALTY), -0.5, 0.5)
    return x


def fit(docs: DataFrame, v: Vocabulary, steps: int = STEPS) -> np.ndarray:
    """(contexts, classes) natural log of P(class | context)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(v)
    cells = N_CONTEXTS * CLASSES
    blocks = 64
    cut = np.linspace(0, N_CONTEXTS, blocks + 1).astype(int)

    def count(batches):
        from pyspark import TaskContext

        v, total = shared.value, np.zeros(cells, np.int64)
        for batch in batches:
            for part in slices(batch):
                hashes, doc, token = tokens_of(texts(part))
                cls = v.classes[v.place(hashes)][token]
                total += np.bincount(contexts(doc, cls) * CLASSES + cls, minlength=cells)
        own, lane = total.reshape(N_CONTEXTS, CLASSES), TaskContext.get().partitionId()
        for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([lane]), pa.array([own[a:b].tobytes()], pa.binary())], names=["part", "lane", "sums"])

    counted = tree_sum(docs.select("text").mapInArrow(count, "part long, lane long, sums binary"), docs.rdd.getNumPartitions(), np.int64)
    counted = checkpointed(counted)
    rows = feature_rows()
    weights = np.zeros((ROWS, CLASSES))
    weights[rows[0, 0]] = np.log(np.maximum(v.class_mass, 1e-9) / v.mass)
    start = weights.copy()
    shared_rows = spark.sparkContext.broadcast(rows)

    def summed(of) -> np.ndarray:
        """Sum over contexts of of(counts of the classes, feature rows), by weight row."""

        def run(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((ROWS, CLASSES))
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = np.frombuffer(data, np.int64).reshape(-1, CLASSES)
                used = np.flatnonzero(seen.sum(axis=1))
                own = shared_rows.value[:, cut[block] : cut[block + 1]][:, used]
                value = of(seen[used], own)
                for row in own if len(used) else ():
                    order = np.argsort(row, kind="stable")
                    at = np.flatnonzero(np.concatenate(([True], np.diff(row[order]) != 0)))
                    out[row[order][at]] += np.add.reduceat(value[order], at)
            return out.ravel()

        return sum_vectors(counted, run, ROWS * CLASSES).reshape(ROWS, CLASSES)

    observed = summed(lambda seen, own: seen.astype(float))
    for _ in range(steps):
        now = spark.sparkContext.broadcast(weights)
        expected = summed(lambda seen, own, now=now: seen.sum(axis=1)[:, None] * np.exp(log_softmax(now.value, own)))
        weights = weights + climb(observed, expected, weights - start)
    return log_softmax(weights, rows)


def before(doc: np.ndarray, values: np.ndarray, k: int, start) -> np.ndarray:
    """The value k tokens before in the same document; start where there is none."""
    out = np.full(len(values), start, values.dtype)
    same = doc[k:] == doc[: len(doc) - k]
    out[k:][same] = values[: len(values) - k][same]
    return out


def contexts_of_words(hashes: np.ndarray, doc: np.ndarray, token: np.ndarray, v: Vocabulary, place: np.ndarray) -> np.ndarray:
    """CONTEXT_BITS of a hash of the two words before each token and its class."""
    own = hashes[token]
    first, second = before(doc, own, 1, np.uint64(1)), before(doc, own, 2, np.uint64(2))
    x = second * np.uint64(0x9E3779B97F4A7C15) ^ (first + v.classes[place][token]) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(WORD_BITS)


def told(context: np.ndarray, token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts that a slice holds TOLD times or more, and how often; each of their words is as frequent, so few tokens come into question."""
    often = np.bincount(token)[token] >= TOLD if len(token) else np.zeros(0, bool)
    used = before(doc, often, 1, True) & before(doc, often, 2, True)
    found, n = np.unique(context[used], return_counts=True)
    return found[n >= TOLD], n[n >= TOLD]


@dataclass
class Frequent:
    """Frequent contexts with their training tokens and normaliser, and frequent records with their training tokens; both sorted."""

    contexts: np.ndarray
    totals: np.ndarray
    wholes: np.ndarray
    records: np.ndarray
    counts: np.ndarray

    def at(self, context: np.ndarray) -> np.ndarray:
        return position(self.contexts, context)


NO_FREQUENT = Frequent(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0))


def position(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value, -1 if it is not there."""
    if not len(sorted_values):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[at] == values, at, -1)


def records(hashes: np.ndarray, doc: np.ndarray, token: np.ndarray, v: Vocabulary) -> np.ndarray:
    """A record for every token: the bits of its context, and WORD_BITS of its place among the known; OTHER_WORD if it is not known."""
    place = v.place(hashes)
    context = contexts_of_words(hashes, doc, token, v, place)
    return context << np.uint64(WORD_BITS) | np.where(place >= 0, place, OTHER_WORD).astype(np.uint64)[token]


def mixed(x: np.ndarray) -> np.ndarray:
    return (x * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)


def part_of(record: np.ndarray, at: np.ndarray, parts: int) -> np.ndarray:
    """The part that a record is dealt to: by its context, or where that is frequent (at) by context and word."""
    context, word = record >> np.uint64(WORD_BITS), record & np.uint64(OTHER_WORD)
    key = np.where(at >= 0, context ^ (word + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), context)
    return (mixed(key) % np.uint64(parts)).astype(np.int64)


def climb_words(n: np.ndarray, context: np.ndarray, total: np.ndarray, penalty: float = WORD_PENALTY, steps: int = 60) -> np.ndarray:
    """The weights of the words of each context at the top of the penalised likelihood.

    n is how often each word followed its context, total how often a context came, context the place of each word's in it.
    Words without a weight share exp(0). Newton's steps; the second derivatives of a context are a diagonal less one product.
    """
    n_contexts = len(total)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.bincount(context, x, n_contexts)[context]

    seen = total[context]
    w = np.log(n / np.maximum(total - np.bincount(context, n, n_contexts), 0.5)[context])
    for _ in range(steps):
        e = np.exp(w)
        p = e / (1 + summed(e))
        gradient, diagonal = n - seen * p - penalty * w, seen * p + penalty
        step = gradient / diagonal
        step += seen * p / diagonal * summed(p * step) / (1 - summed(seen * p * p / diagonal))
        largest = np.zeros(n_contexts)
        np.maximum.at(largest, context, np.abs(step))
        w += step * np.minimum(1, 2 / np.maximum(largest, 1e-300))[context]
        if not len(w) or largest.max() < 1e-9:
            break
    return w


def weight_alone(n: np.ndarray, total: np.ndarray, whole: np.ndarray, penalty: float = WORD_PENALTY) -> np.ndarray:
    """The weights w at which n = total * exp(w) / whole + penalty * w, each by Newton's steps: a word's own, given its context's normaliser."""
    w = np.log(n * whole / total)
    for _ in range(60):
        grown = total * np.exp(w) / whole
        step = (grown + penalty * w - n) / (grown + penalty)
        w -= np.clip(step, -2, 2)
        if not len(w) or np.abs(step).max() < 1e-12:
            break
    return w


def added_to(share: np.ndarray, weighed: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """log10 by which a context changes the probability of a word of this share: (its weight's exponential + share) / whole, over share."""
    return np.log10((weighed / share + 1) / whole)


def gains(record: np.ndarray, row: np.ndarray, training: np.ndarray, shares: np.ndarray, penalty: float = WORD_PENALTY, frequent: Frequent = NO_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the log10 by which the features of their contexts change the probability of their words; rows without a change are left out."""
    order = np.argsort(record, kind="stable")
    record, row, training = record[order], row[order], training[order]
    if not len(record):
        return np.zeros(0, np.int64), np.zeros(0)
    context = record >> np.uint64(WORD_BITS)
    new, new_context = (np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) for x in (record, context))
    n = np.add.reduceat(training.astype(float), new)
    other_word = (record[new] & np.uint64(OTHER_WORD)) == np.uint64(OTHER_WORD)
    kept = np.flatnonzero((n >= LEAST) & ~other_word)
    total = np.add.reduceat(training.astype(float), new_context)
    known = frequent.at(context[new_context])
    whole, weighed = np.ones(len(new_context)), np.zeros(len(new))
    of = np.searchsorted(new_context, new[kept], "right") - 1
    here = known[of] < 0
    used, own = np.unique(of[here], return_inverse=True)
    weighed[kept[here]] = np.exp(climb_words(n[kept[here]], own, total[used], penalty))
    whole[used] += np.bincount(own, weighed[kept[here]], len(used))
    there = known[of[~here]]
    weighed[kept[~here]] = np.exp(weight_alone(n[kept[~here]], frequent.totals[there], frequent.wholes[there], penalty))
    whole[known >= 0] = frequent.wholes[known[known >= 0]]
    size, size_context = np.diff(np.append(new, len(record))), np.diff(np.append(new_context, len(record)))
    by_token = np.repeat(whole, size_context)
    changed = np.flatnonzero(by_token != 1)
    place = record[changed] & np.uint64(OTHER_WORD)
    share = shares[np.minimum(place.astype(np.int64), len(shares) - 1)]
    gain = added_to(share, np.repeat(weighed, size)[changed], by_token[changed])
    rows, which = np.unique(row[changed], return_inverse=True)
    return rows, np.bincount(which, gain)


def frequent_contexts(rows: DataFrame, v: Vocabulary, contexts: np.ndarray, least: float, penalty: float = WORD_PENALTY) -> Frequent:
    """Totals and normalisers of the given contexts, from Spark's counts of their words in training, and the records met ``least`` times or more."""
    contexts = np.sort(contexts)
    if not len(contexts):
        return NO_FREQUENT
    shared = rows.sparkSession.sparkContext.broadcast((v, contexts))

    def count(batches):
        v, contexts = shared.value
        for batch in batches:
            for part in slices(batch):
                hashes, doc, token = tokens_of(texts(part))
                found = records(hashes, doc, token, v)
                used = np.array(part.column("training").to_pylist(), bool)[doc] & (position(contexts, found >> np.uint64(WORD_BITS)) >= 0)
                record, n = np.unique(found[used], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(record.view(np.int64)), pa.array(n.astype(np.int64))], names=["record", "n"])

    counted = stored(rows.mapInArrow(count, "record long, n long").groupBy("record").agg(F.sum("n").alias("n")))
    of = F.shiftrightunsigned("record", WORD_BITS).alias("context")
    keeps = F.when((F.col("n") >= LEAST) & (F.col("record").bitwiseAND(OTHER_WORD) != OTHER_WORD), F.col("n"))
    by_count = counted.groupBy(of, keeps.alias("n")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))
    whole = by_count.groupBy("context").agg(F.sum("tokens").alias("total"), F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "words"))).alias("counts"))

    def solve(batches):
        for batch in batches:
            found = []
            for total, counts in zip(batch.column("total").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = np.repeat([float(c["n"]) for c in counts], [c["words"] for c in counts])
                found.append(1 + np.exp(climb_words(n, np.zeros(len(n), int), np.array([float(total)]), penalty)).sum())
            yield pa.RecordBatch.from_arrays([batch.column("context"), pa.array(batch.column("total").cast(pa.float64())), pa.array(found, pa.float64())], names=["context", "total", "whole"])

    solved = whole.mapInArrow(solve, "context long, total double, whole double").toPandas()
    most = counted.filter(F.col("n") >= least).toPandas()
    order, order_records = np.argsort(solved["context"].to_numpy().view(np.uint64)), np.argsort(most["record"].to_numpy(np.int64).view(np.uint64))
    totals, wholes = np.zeros(len(contexts)), np.ones(len(contexts))  # contexts that training lacks change nothing
    at = position(contexts, solved["context"].to_numpy(np.int64).view(np.uint64)[order])
    totals[at], wholes[at] = solved["total"].to_numpy()[order], solved["whole"].to_numpy()[order]
    return Frequent(contexts, totals, wholes, most["record"].to_numpy(np.int64).view(np.uint64)[order_records], most["n"].to_numpy(float)[order_records])


def met_often(met: DataFrame, least: float) -> np.ndarray:
    """Contexts that the slices together told of so often."""

    def unpack(batches):
        for batch in batches:
            contexts, counts = (np.frombuffer(b"".join(c.to_pylist()), np.int64) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(contexts), pa.array(counts)], names=["context", "n"])

    summed = met.mapInArrow(unpack, "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
    return summed.filter(F.col("n") >= least).toPandas()["context"].to_numpy(np.int64).view(np.uint64)


def at_once(record: np.ndarray, at: np.ndarray, shares: np.ndarray, frequent: Frequent, penalty: float = WORD_PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Which records are frequent as such, and their gains."""
    where = position(frequent.records, record)
    found = np.flatnonzero((where >= 0) & (at >= 0))
    place, whole = record[found] & np.uint64(OTHER_WORD), frequent.wholes[at[found]]
    n = frequent.counts[where[found]]
    weighed = np.zeros(len(found))
    own = (n >= LEAST) & (place != np.uint64(OTHER_WORD))
    weighed[own] = np.exp(weight_alone(n[own], frequent.totals[at[found[own]]], whole[own], penalty))
    return found, added_to(shares[np.minimum(place.astype(np.int64), len(shares) - 1)], weighed, whole)


def word_gains(rows: DataFrame, v: Vocabulary, tokens: int, met: DataFrame, penalty: float = WORD_PENALTY, part_tokens: int = PART_TOKENS) -> DataFrame:
    """``met`` has the contexts that slices told of, as packed numbers and counts. row, seen_again (a hash of the texts read with it) and gain, the log10 that the word features add to a text's score, for rows (training, text) that are read in the same order each time."""
    parts = max(1, -(-tokens // part_tokens))
    spark = rows.sparkSession
    least = part_tokens / SHARE
    frequent = frequent_contexts(rows, v, met_often(met, least / 2) if parts > 1 else np.zeros(0, np.uint64), least, penalty)
    shared = spark.sparkContext.broadcast((v, frequent))

    def dealt(batches):
        v, frequent = shared.value
        shares = v.shares()
        for part, start, seen in numbered(batches):
            hashes, doc, token = tokens_of(texts(part))
            record = records(hashes, doc, token, v)
            at = frequent.at(record >> np.uint64(WORD_BITS))
            if len(frequent.records):
                found, gain = at_once(record, at, shares, frequent, penalty)
                direct, which = np.unique(doc[found], return_inverse=True)
                if len(direct):  # an answer already, of a part below 0
                    columns = [-1 - start % parts, False, start, seen, direct.astype("<u4").tobytes(), np.bincount(which, gain).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], names=["part", "training", "start", "seen", "docs", "records"])
                rest = np.delete(np.arange(len(record)), found)
                record, at, doc = record[rest], at[rest], doc[rest]
            training = np.array(part.column("training").to_pylist(), bool)[doc]
            key = part_of(record, at, parts) * 2 + training
            order = np.argsort(key, kind="stable")  # documents stay in order
            key, doc, record = key[order], doc[order], record[order]
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
            ends = np.append(new[1:], len(key))
            docs = [doc[a:b].astype("<u4").tobytes() for a, b in zip(new, ends, strict=True)]
            found = [record[a:b].tobytes() for a, b in zip(new, ends, strict=True)]
            for i in range(0, len(new), 64):
                at = new[i : i + 64]
                columns = [pa.array(key[at] // 2), pa.array(key[at] % 2 == 1), pa.array(np.full(len(at), start)), pa.array(np.full(len(at), seen)), pa.array(docs[i : i + 64], pa.binary()), pa.array(found[i : i + 64], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "training", "start", "seen", "docs", "records"])

    def respond(batches):
        held, now, shares = [], None, shared.value[0].shares()

        def flush():
            record = np.concatenate([np.frombuffer(h[4], np.uint64) for h in held])
            sizes = [len(h[4]) // 8 for h in held]
            row = np.concatenate([np.frombuffer(h[3], "<u4").astype(np.int64) + h[1] for h in held])
            rows, gain = gains(record, row, np.repeat([h[0] for h in held], sizes), shares, penalty, shared.value[1])
            starts, at = np.unique([h[1] for h in held], return_index=True)
            seen = np.array([h[2] for h in held])[at]
            ends = np.searchsorted(rows, np.append(starts, 1 << 62))
            used = np.flatnonzero(np.diff(ends))
            docs = [(rows[ends[i] : ends[i + 1]] - starts[i]).astype("<u4").tobytes() for i in used]
            added = [gain[ends[i] : ends[i + 1]].tobytes() for i in used]
            return pa.RecordBatch.from_arrays([pa.array(starts[used]), pa.array(seen[used]), pa.array(docs, pa.binary()), pa.array(added, pa.binary())], names=["start", "seen", "docs", "gains"])

        for batch in batches:
            for part, *values in zip(*(batch.column(k).to_pylist() for k in ("part", "training", "start", "seen", "docs", "records")), strict=True):
                if part < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([c]) for c in values[1:]], names=["start", "seen", "docs", "gains"])
                    continue
                if part != now and held:
                    yield flush()
                    held = []
                now = part
                held.append(values)
        if held:
            yield flush()

    def added(batches):
        """The sum of what the parts found for each text of a slice."""
        total, now = np.zeros(0), None

        def flush():
            docs = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(docs + now[0]), pa.array(np.full(len(docs), now[1])), pa.array(total[docs])], names=["row", "seen_again", "gain"])

        for batch in batches:
            for start, seen, docs, found in zip(*(batch.column(k).to_pylist() for k in ("start", "seen", "docs", "gains")), strict=True):
                if now is not None and start != now[0]:
                    yield flush()
                    total = np.zeros(0)
                now, docs = (start, seen), np.frombuffer(docs, "<u4")
                if docs[-1] >= len(total):
                    total = np.append(total, np.zeros(docs[-1] + 1 - len(total)))
                total[docs] += np.frombuffer(found)
        if now is not None:
            yield flush()

    sent = rows.mapInArrow(dealt, "part long, training boolean, start long, seen long, docs binary, records binary")
    tasks = max(1, min(parts, 1 << 16))
    found = sent.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(respond, "start long, seen long, docs binary, gains binary")
    return found.repartition("start").sortWithinPartitions("start").mapInArrow(added, "row long, seen_again long, gain double")


def numbered(batches):
    """Parts of bounded size, the number of their first row, unique over all partitions, and a hash of their texts."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in slices(batch):
            seen = xxhash.xxh3_64()
            for text in texts(part):
                seen.update((text or "").encode("utf-8", "surrogatepass") + b"\0")
            yield part, row, seen.intdigest() >> 1
            row += part.num_rows


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows where training holds.

    Needs doc_id and text; other columns, whatever their names, are not read. Null and empty texts are the end token
    alone; texts are read whole. base_score and score are log10 probabilities of the whole text under the smoothed
    token counts and under the model. Repeated rows are learnt from as often as they come. Without training rows, both
    scores are those of one unknown token type. docs is read several times and has to give its rows in one order, as
    tables do; if it does not, the job fails.
    """
    spark = docs.sparkSession
    training = F.coalesce(training, F.lit(False))
    learn = docs.filter(training)
    counts = stored(count_tokens(learn))
    v = vocabulary(counts)
    set_classes(learn, v)
    log_p = (fit(learn, v) / np.log(10)).astype(np.float32)
    shared = spark.sparkContext.broadcast((v, log_p))

    def run(batches):
        v, log_p = shared.value
        in_class = np.log10(v.shares())
        # The count of a token that is not known comes from the join; here it stands as 1 in the logarithms.
        alone = np.log10(np.append(v.counts, 0) + 0.5) - np.log10(v.mass)
        alone[-1] = -np.log10(v.mass)
        for part, start, seen in numbered(batches):
            own = texts(part)
            hashes, doc, token = tokens_of(own)
            n_docs = part.num_rows
            place = v.place(hashes)
            at, cls = place[token], v.classes[place][token]
            base = np.bincount(doc, alone[at], n_docs)
            full = np.bincount(doc, in_class[at] + log_p[contexts(doc, cls), cls], n_docs)
            known = np.bincount(doc[at >= 0], minlength=n_docs)
            unknown = np.flatnonzero(at < 0)
            pairs, times = np.unique(doc[unknown] * len(hashes) + token[unknown], return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(n_docs + 1) * len(hashes)), pa.int32())
            rare = pa.ListArray.from_arrays(offsets, pa.array(hashes[pairs % len(hashes)].view(np.int64)))
            often = pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))
            contexts_met, times_met = told(contexts_of_words(hashes, doc, token, v, place), token, doc)
            met = [pa.array([x.astype(np.int64).tobytes(), *[None] * (n_docs - 1)], pa.binary()) for x in (contexts_met, times_met)]
            columns = [pa.array(np.arange(start, start + n_docs)), pa.array(np.full(n_docs, seen)), part.column(0), part.column(1), pa.array(np.bincount(doc, minlength=n_docs)), pa.array(known), pa.array(base), pa.array(full), rare, often, *met]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "seen", "doc_id", "training", "n_tokens", "known", "base", "full", "rare", "often", "met", "times_met"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), training.alias("training"), "text")
    rows = stored(read.mapInArrow(run, "row long, seen long, doc_id long, training boolean, n_tokens long, known long, base double, full double, rare array<long>, often array<int>, met binary, times_met binary"))
    seldom = rows.select("row", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.often").alias("times"))
    seldom = seldom.join(counts.filter(F.col("n") < v.least) if len(v.hashes) else counts, "h", "left")
    seldom = seldom.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(v.prior))).alias("more_in_class"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("found")
    )
    tokens = rows.agg(F.sum("n_tokens")).first()[0] or 0
    added = word_gains(read, v, tokens, rows.filter("met is not null").select("met", "times_met"))
    joined = rows.drop("rare", "often", "met", "times_met").join(seldom, "row", "left").join(added, "row", "left")
    other = F.raise_error(F.lit("docs gave its rows in another order when it was read again; write it to a table first")).cast("double")
    gain = F.when(F.col("gain").isNull(), F.lit(0.0)).when(F.col("seen") == F.col("seen_again"), F.col("gain")).otherwise(other)
    return joined.select(
        "doc_id", "training", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("full") + F.coalesce("more_in_class", F.lit(0.0)) + gain).alias("score"),
    )
