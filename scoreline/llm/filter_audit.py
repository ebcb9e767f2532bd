"""Audit of how filters interact, by a packed bitmap index.

Every document has a bit for each filter that it fails and for each label it bears. Tasks hold these bits by part, one
packed numpy bitset a filter and label, and for each set S of filters applied before and each filter f outside S find
by AND-NOT and popcount how many documents f removes, how many of those bear a label, how many it would have removed if
S had not, and how many stay. A task's counts are sums over its bitsets, so what leaves it is 80 rows a part (for five
filters), and Spark adds the tasks' rows. Every order of the filters is a chain of such sets, and every figure of a step is
one of these counts or a sum of them.

Nulls and the like: a null text is the empty one, a null part the empty string. A null id is no smaller than any, nor is
any smaller than it, so such a row neither fails for being a copy nor makes another one fail; it has no label. Repeated rows count
each; rows of one id and one text are no copies of one another by themselves, since no id is smaller. A label is borne where any row of the
id has a 1. Texts are read whole. Tables without rows give none. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, split_words, stored, texts

#: The filters, in the order of their bits, and the labels, whose bits follow.
FILTERS, LABELS = "ABCDE", ("good", "toxic")
#: Marks of the fourth filter.
SYMBOLS = b"#$%&*|"
#: Each set of filters applied before (bits) with each filter outside it.
STEPS = [(before, f) for before in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not before >> f & 1]
COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")


def failures(text: str | None) -> int:
    """Bits of the filters A to D that a text fails: few words, few different words, many capitals, symbols."""
    words, data = split_words(text), (text or "").encode("utf-8", "surrogatepass")
    capitals = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    fails = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * capitals > 10 * len(text or ""),
        len(data) != len(data.translate(None, SYMBOLS)),
    )
    return sum(fail << bit for bit, fail in enumerate(fails))


def document_bits(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the bits of the filters that look at one text alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                found = texts(rows)
                digests = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in found]
                bits = pa.array([failures(t) for t in found], pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(digests, pa.binary()), bits], names=["doc_id", "part", "digest", "bits"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return found.mapInArrow(read, "doc_id long, part string, digest binary, bits int")


def label_bits(labels: DataFrame) -> DataFrame:
    """doc_id and bits of its labels, one row an id."""
    good, toxic = ((F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")) * (1 << len(FILTERS) + i)).alias(c) for i, c in enumerate(("quality", "toxic")))
    found = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good, toxic)
    return found.select("doc_id", (F.col("quality") + F.col("toxic")).alias("labels"))


def all_bits(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and bits of every document: filters A to E and labels.

    Texts are read once; what is left of them, some 50 bytes a document, is stored. Copies: the smallest id of each text is
    found first, pre-aggregated by tasks; a document fails E unless its own id is that of its text. Joined on id and text,
    a large group of copies is no hot key. Rows without an id take no part in the joins.
    """
    read, later = stored(document_bits(docs)), 1 << FILTERS.index("E")
    found = read.filter(F.col("doc_id").isNotNull())
    firsts = found.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = found.join(firsts, ["doc_id", "digest"], "left").join(label_bits(labels), "doc_id", "left")
    bits = F.col("bits") + F.when(F.col("first"), 0).otherwise(later) + F.coalesce("labels", F.lit(0))
    return known.select("part", bits.alias("bits")).unionAll(read.filter(F.col("doc_id").isNull()).select("part", "bits"))


def count_steps(bits: np.ndarray) -> np.ndarray:
    """COUNTS for each of STEPS over documents of one part, by bitsets."""
    n = len(FILTERS)
    planes = np.packbits(bits[None, :] >> np.arange(n + len(LABELS))[:, None] & 1, axis=1)
    planes = np.pad(planes, ((0, 0), (0, -planes.shape[1] % 8))).view(np.uint64)
    removed_by = np.zeros((1 << n, planes.shape[1]), np.uint64)
    for s in range(1, 1 << n):
        top = s.bit_length() - 1
        removed_by[s] = removed_by[s ^ 1 << top] | planes[top]
    before = removed_by[[s for s, _ in STEPS]]
    fails = planes[[f for _, f in STEPS]]
    here = fails & ~before
    counted = [before | fails, here, fails & before, here & planes[n], here & planes[n + 1]]
    out = np.stack([np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in counted], axis=1)
    out[:, 0] = len(bits) - out[:, 0]
    return out


def count_sets(bits: DataFrame) -> DataFrame:
    """part, before, filter and COUNTS, summed over all tasks: 80 rows a part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            part = batch.column(0).dictionary_encode()
            codes, values = np.asarray(part.indices), np.asarray(batch.column(1))
            order = np.argsort(codes, kind="stable")
            ends = np.cumsum(np.bincount(codes, minlength=len(part.dictionary)))
            for name, rows in zip(part.dictionary.to_pylist(), np.split(values[order], ends[:-1]), strict=True):
                total[name] = total.get(name, 0) + count_steps(rows)
        for name, counts in total.items():
            columns = [pa.array([name] * len(STEPS)), *(pa.array(c, pa.int32()) for c in zip(*STEPS, strict=True)), *(pa.array(c) for c in counts.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "before", "filter", *COUNTS])

    found = bits.mapInArrow(count, "part string, before int, filter int, " + ", ".join(f"{c} long" for c in COUNTS))
    return found.groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step what its filter did there; see the module.

    unique_fails is what a filter removes after all others; shapley sums what it removes over all orders, in which each
    set comes before it as often as both sides of it can be ordered.
    """
    n = len(FILTERS)
    steps = []
    for order in permutations(range(n)):
        for at, f in enumerate(order):
            steps.append(("".join(FILTERS[g] for g in order), at + 1, sum(1 << g for g in order[:at]), f))
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")
    sets = count_sets(all_bits(docs, labels))
    size = F.bit_count("before")
    ways = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), size + 1)
    last = F.sum(F.when(size == n - 1, F.col("removed")))
    whole = sets.groupBy("part", "filter").agg(last.alias("unique_fails"), F.sum(F.col("removed") * ways).alias("shapley"), F.collect_list(F.struct("before", *COUNTS)).alias("sets"))
    found = whole.select("part", "filter", "unique_fails", "shapley", F.inline("sets"))
    found = found.join(F.broadcast(orders), ["before", "filter"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: DuckDB SQL for the rows of op12: every order applied to every document, one by one.
OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), firsts AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(first < doc_id, false) THEN 'E' ELSE '' END AS fails
  FROM texts JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
), seen AS (
  SELECT part, filter_order, step, f, contains(fails, f) AS failed, before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone,
    fails = f AS only_this, good, toxic
  FROM failing, steps
), counted AS (
  SELECT part, filter_order, step, f, count(*) FILTER (WHERE NOT gone AND NOT failed) AS kept, count(*) FILTER (WHERE NOT gone AND failed) AS removed,
    count(*) FILTER (WHERE gone AND failed) AS redundant, count(*) FILTER (WHERE only_this) AS unique_fails,
    count(*) FILTER (WHERE NOT gone AND failed AND good = 1) AS good_lost, count(*) FILTER (WHERE NOT gone AND failed AND toxic = 1) AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
