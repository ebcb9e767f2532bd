"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text is described by STATISTICS, standardised over all documents. Cosines at random frequencies approximate a
Gaussian kernel on them. Tasks sum their part of the normal equations of the ridge regression from the labelled rows;
the sums, of a size that depends on FREQUENCIES alone, are added up by Spark and solved on the driver. For calibration, each
half of the labelled rows (by a hash of the id) is scored with the weights of the other half; these scores,
counted in BINS bins, are made monotone by pooling adjacent violators, and the steps turn a score into a probability.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, sum_vectors, texts

FREQUENCIES = 256
BANDWIDTH = 4.0
RIDGE = 1e-3
BINS = 1024
CLIP = 6.0

STATISTICS = (
    "log_words", "log_word_length", "long_words", "different_words", "top_word", "next_to_same", "letters", "capitals", "digits", "marks",
    "symbols", "beyond_ascii", "exclamations", "log_line_words", "repeated_lines", "capital_words", "marked_words", "bars", "bigrams",
)

_LETTER, _CAPITAL, _DIGIT, _SPACE, _MARK, _SYMBOL, _HIGH, _BANG, _BAR, _OTHER = range(10)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("A") : ord("Z") + 1] = _CAPITAL
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[list(b".,;:'\"()-")] = _MARK
_KIND[list(b"#*$%&<>@^~=+\\/_{}[]`")] = _SYMBOL
_KIND[list(b"!?")] = _BANG
_KIND[ord("|")] = _BAR
_KIND[128:] = _HIGH


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of one text; all 0 if it has no word."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=10)
    solid = max(1, len(data) - int(kinds[_SPACE]))
    counts = Counter(words)
    same = sum(map(eq, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    sizes = np.fromiter(map(len, words), np.int64, n)
    capital = sum(map(bytes.isupper, words))
    plain = sum(map(bytes.isalpha, words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(n), np.log(sizes.mean()), float((sizes > 12).mean()), len(counts) / n, max(counts.values()) / n, same / n,
        kinds[_LETTER] / solid, kinds[_CAPITAL] / solid, kinds[_DIGIT] / solid, kinds[_MARK] / solid,
        kinds[_SYMBOL] / solid, kinds[_HIGH] / solid, kinds[_BANG] / solid, np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        capital / n, 1 - plain / n, kinds[_BAR] / solid, pairs / max(1, n - 1),
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics as bytes of float32, of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [np.array(statistics(t), np.float32).tobytes() for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["doc_id", "x"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, x binary")


def as_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, len(STATISTICS)).astype(float)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.column_stack((np.ones(len(x)), np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.weights is None else self.cosines(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.steps is None else np.interp(self.raw(x), *self.steps)


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to value, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _summed(rows: DataFrame, of, width: int) -> np.ndarray:
    """Sum over rows (x, y) of the vectors that of(matrix, y) gives."""
    return sum_vectors(rows.select("x", "y"), lambda batch: of(as_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float)), width)


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 9) -> QualityModel:
    """Fit on rows (doc_id, x) that have a 0 or 1 in labels. Without labelled rows every score is 0.5."""
    d = len(STATISTICS)
    totals = _summed(rows.withColumn("y", F.lit(0)), lambda x, y: np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0))), 2 * d + 1)
    n = max(1.0, totals[0])
    mean = totals[1 : d + 1] / n
    scale = np.sqrt(np.maximum(totals[d + 1 :] / n - mean**2, 0))
    random = np.random.default_rng(seed)
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), random.normal(size=(d, FREQUENCIES)) / BANDWIDTH, random.uniform(0, 2 * np.pi, FREQUENCIES))

    one = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(label).cast("int").alias("y"))
    half = F.pmod(F.xxhash64("l_id"), F.lit(2)).cast("int")
    labelled = checkpointed(rows.join(one, F.col("doc_id") == F.col("l_id")).select("x", (F.col("y") + 2 * half).alias("y")))
    m = FREQUENCIES + 1
    width = 1 + m * m + m

    def normal(x, y):
        z, out = model.cosines(x), []
        for side in (0, 1):
            own = y // 2 == side
            out += [[own.sum()], (z[own].T @ z[own]).ravel(), z[own].T @ (y[own] % 2)]
        return np.concatenate(out)

    def solved(sums: np.ndarray) -> np.ndarray:
        gram, moment = sums[1 : 1 + m * m].reshape(m, m), sums[1 + m * m :]
        ridge = np.diag(np.concatenate(([1e-9], np.full(m - 1, RIDGE)))) * max(1.0, sums[0])
        return np.linalg.solve(gram + ridge, moment)

    sums = _summed(labelled, normal, 2 * width).reshape(2, width)
    if not sums[:, 0].sum():
        return model
    model.weights = solved(sums.sum(axis=0))
    # A half without rows has the weights of all.
    of_other = [solved(sums[1 - side]) if sums[1 - side, 0] else model.weights for side in (0, 1)]

    def counted(x, y):
        side, z = y // 2 == 1, model.cosines(x)
        b = bin_of(np.where(side, z @ of_other[1], z @ of_other[0]))
        return np.concatenate((np.bincount(b, minlength=BINS), np.bincount(b, y % 2, BINS)))

    both = _summed(labelled, counted, 2 * BINS)
    count, good = both[:BINS], both[BINS:]
    used = np.flatnonzero(count)
    model.steps = ((used + 0.5) / BINS * 2 - 0.5, isotonic(good[used] / count[used], count[used]))
    return model


def score(rows: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row of rows (doc_id, x)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p = np.clip(shared.value.probability(as_matrix(batch.column(1))), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id and score (0 to 1, the calibrated probability of label 1) for every row of docs.

    Needs doc_id and text of docs, doc_id and the label of labels; nothing else is read. Null and empty texts have
    statistics of 0 and are scored like others. Labels other than 0 and 1 are not learnt from; a document with several
    counts as the largest. An empty table gives no row.
    """
    rows = checkpointed(described(docs))
    return score(rows, train(rows, labels, label))
