"""Language identification as inference of a mixture.

A language is a distribution over the character trigrams of its words (with a space before and after), hashed to
2**16 buckets; Spark counts them over all labelled texts. A document is a mixture of languages: each of its words was
drawn from one of them. Expectation-maximisation estimates the proportions, from all languages at first. The set of
languages is then chosen by the likelihood, less PENALTY * log(words) for each language after the first, going
backwards from all: languages whose shares are so small that the likelihood can't lose as much as the penalty
gives back go at once; where several are left, the one without which the penalised likelihood is highest goes, as long as it
does not fall. The same is done forwards from the best single language, and the better set is taken. No bound is set on
the set's size. The prediction is the largest share of the chosen set.

The model has 2**16 numbers a language, whatever the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Numbering, map_batches, slices, texts

BUCKETS = 1 << 16
ITERATIONS = 12
PENALTY = 2.0
#: Trigrams overlap by two letters, so each tells a third of what independent ones would.
SHARPNESS = 1 / 3
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # (BUCKETS, languages)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram of the words, and the place of its word."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = points == 32
    inner = np.flatnonzero(~space[1:-1])  # a trigram stands for its middle letter
    mixed = points[:-2][inner] * np.uint64(0x9E3779B97F4A7C15) ^ points[1:-1][inner] * np.uint64(0xC2B2AE3D27D4EB4F) ^ points[2:][inner] * np.uint64(0x165667B19E3779F9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    owner = np.cumsum(space)[inner + 1] - 1
    return (mixed >> np.uint64(48)).astype(np.int64), owner


def numbered_words(batch_texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different lower-case words, and document and word number of every word."""
    numbers, counts, found = Numbering(), [], []
    for text in batch_texts:
        words = text.lower().split() if text else []
        counts.append(len(words))
        found.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    return list(numbers), np.repeat(np.arange(len(counts)), counts), np.concatenate(found) if found else np.zeros(0, np.int64)


def train(docs: DataFrame, lang: str = "lang") -> LanguageModel:
    """Count the trigrams of all rows with a language. Needs text and the column lang; null texts count for nothing."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                words, doc, word = numbered_words(texts(part))
                bucket, owner = trigrams(words) if words else (np.zeros(0, np.int64),) * 2
                names = np.array(part.column("lang").to_pylist(), object)
                for name in set(names):
                    times = np.bincount(word[names[doc] == name], minlength=len(words))
                    total = totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                    total += np.bincount(bucket, times[owner], BUCKETS).astype(np.int64)
        for name, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])], names=["lang", "bucket", "n"])

    labelled = docs.filter(F.col(lang).isNotNull()).select("text", F.col(lang).cast("string").alias("lang"))
    counts = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((BUCKETS, len(languages)), 0.1)
    table[counts["bucket"], np.searchsorted(languages, counts["lang"])] += counts["n"]
    return LanguageModel([str(x) for x in languages], np.log(table / table.sum(axis=0, keepdims=True)))


def mixture(doc: np.ndarray, p: np.ndarray, times: np.ndarray, n_docs: int, allowed: np.ndarray, rounds: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Shares (n_docs, languages) among the allowed ones and the log likelihood; p holds each word's likelihoods."""
    shares = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    totals = np.maximum(np.bincount(doc, times, n_docs), 1e-300)
    for _ in range(rounds):
        part = shares[doc] * p
        part *= (times / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        shares = np.stack([np.bincount(doc, column, n_docs) for column in part.T], axis=1) / totals[:, None]
    return shares, np.bincount(doc, times * np.log(np.maximum((shares[doc] * p).sum(axis=1), 1e-300)), n_docs)


def negligible(shares: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Which languages of each document may go at once: without a share of s among the rest, the likelihood loses at most -log(1 - s) a word.

    gain is what the penalty gives back for one language, per word. They go from the smallest share on, each among what is left.
    """
    order = np.argsort(shares, axis=1, kind="stable")
    upto = np.cumsum(np.take_along_axis(shares, order, axis=1), axis=1)
    left = np.maximum(1 - upto, 1e-12)
    fine = np.log(np.column_stack((np.ones(len(left)), left[:, :-1]))) - np.log(left) < gain[:, None]
    fine[:, -1] = False  # one stays
    out = np.zeros(shares.shape, bool)
    np.put_along_axis(out, order, np.logical_and.accumulate(fine, axis=1), axis=1)
    return out


def chosen(doc: np.ndarray, p: np.ndarray, times: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shares of the languages of each document's set; first holds those of all languages."""
    n_docs, n_lang = first.shape
    words = np.bincount(doc, times, n_docs)
    penalty = PENALTY * np.log(1 + words)
    allowed = ~negligible(first, penalty / np.maximum(words, 1))
    open_docs = np.flatnonzero(allowed.sum(axis=1) > 1)
    alone = np.stack([np.bincount(doc, times * np.log(np.maximum(column, 1e-300)), n_docs) for column in p.T], axis=1)
    single = alone.argmax(axis=1)
    shares, fit = np.eye(n_lang)[single], alone.max(axis=1)

    def refit(which: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.full(n_docs, -1)
        place[which] = np.arange(len(which))
        mine = place[doc] >= 0
        got, value = mixture(place[doc[mine]], p[mine], times[mine], len(which), sets.astype(float))
        return got, value - penalty[which] * (sets.sum(axis=1) - 1)

    def stepwise(which: np.ndarray, sets: np.ndarray, present: bool) -> None:
        """Take languages out (present) or add them, the best one at a time, while that helps; keep what beats the sets known so far."""
        got, value = refit(which, sets)
        while len(which):
            better = value > fit[which]
            shares[which[better]], fit[which[better]] = got[better], value[better]
            best, new = np.full(len(which), -np.inf), np.zeros((len(which), n_lang))
            for language in range(n_lang):
                own = np.flatnonzero((sets[:, language] == present) & (sets.sum(axis=1) > present))
                if len(own):
                    other = sets[own].copy()
                    other[:, language] = not present
                    found, v = refit(which[own], other)
                    higher = v > best[own]
                    best[own[higher]], new[own[higher]] = v[higher], found[higher]
            on = best >= value
            which, sets, got, value = which[on], new[on] > 0, new[on], best[on]

    if len(open_docs):
        stepwise(open_docs, allowed[open_docs], True)
        stepwise(open_docs, np.eye(n_lang, dtype=bool)[single[open_docs]], False)
    return shares


def infer(batch_texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its share, and the shares of all languages of the chosen set, for each text."""
    n_docs, n_lang = len(batch_texts), len(model.languages)
    words, doc, word = numbered_words(batch_texts)
    shares = np.zeros((n_docs, n_lang))
    first = np.zeros((n_docs, n_lang))
    if words and n_lang:
        bucket, owner = trigrams(words)
        log_p = SHARPNESS * np.stack([np.bincount(owner, column[bucket], len(words)) for column in model.log_p.T], axis=1)
        likelihood = np.exp(log_p - log_p.max(axis=1, keepdims=True))
        pairs, times = np.unique(doc * len(words) + word, return_counts=True)
        doc, p = pairs // len(words), likelihood[pairs % len(words)]
        first, _ = mixture(doc, p, times, n_docs, np.ones((n_docs, n_lang)))
        some = np.bincount(doc, times, n_docs) > 0
        shares = chosen(doc, p, times, first) * some[:, None]
    known = np.array([bool(t) and bool(LETTER.search(t)) for t in batch_texts], bool) & (shares.sum(axis=1) > 0)
    top = shares.argmax(axis=1) if n_lang else np.zeros(n_docs, int)
    names = [model.languages[i] if k else UNKNOWN for i, k in zip(top, known, strict=True)]
    score = np.where(known, np.minimum(first, shares)[np.arange(n_docs), top], 0.0) if n_lang else np.zeros(n_docs)
    return names, np.clip(score, 0, 1), shares * known[:, None]


def identify(docs: DataFrame, model: LanguageModel, doc_id: Column | str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score, languages (a map from each language of the chosen set to its share) of every row.

    Texts that are null or have no letter are ``und`` with score 0, and so are all if no language was learnt. Texts of
    any length are read whole. Only doc_id and text are read; ties go to the language first in code-point order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score, shares = infer(texts(batch), shared.value)
        sets = [[(name, float(x)) for name, x in zip(shared.value.languages, row, strict=True) if x > 0] for row in shares]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "languages"]
        )

    ids = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return map_batches(docs.select(ids.cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double, languages map<string,double>")


def keep_identified(docs: DataFrame, model: LanguageModel, least_share: float = 0.4) -> DataFrame:
    """The rows of docs, all columns, whose language is known and has at least least_share of the words.

    Null and empty texts and those without a letter go. Texts are read whole; repeated rows fare alike. Of the columns only
    text is read, whatever the others are called. An empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score, _ = infer(texts(batch), shared.value)
        return batch.filter(pa.array([name != UNKNOWN and s >= least_share for name, s in zip(names, score, strict=True)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
