"""Spelling variants: words one edit apart, found by a self-join of tries with active-node sets.

Two words one edit apart share their first half or, if the edit is there, what follows it. So the vocabulary's trie
is cut into parts by prefix twice, once of the words and once of the words from behind, for pairs of words of ``length``
and that or one more code points: a word goes to at most four parts, of words that agree in a half. A task builds the trie
of the parts dealt to it as sorted arrays, level by level, and carries down each node's active nodes, those within one
edit of it. Of a node itself that is trivial; a node one substitution or one insertion away is made where two
branches part, and goes on only to children of the same character, since no edit is left. Pairs of leaves are the pairs of near
words. Nodes an edit away are carried down in blocks, so a task's memory does not grow with the number of pairs, and
no two words are compared that do not share all but one character of a common path.

Each task already reduces its pairs to a count and the best near word of each word. Roots follow from forms by pointer
jumping: forms at least double the count, so the chains are short, and jumps halve them.

Nulls and the like: a null text has no words; rows without an id count as others do (their id is the empty string where it matters). Repeated rows count
each. Words may be of any length. Ties of count go to the word that comes first in code-point order. Tables without rows give none. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A run of letters once A-Z are lower-cased; all of them are single bytes of Latin-1.
RUN = "[a-zÀ-ÿ]+"
#: Words that a task takes at a time, beside the rest of their last part; pairs of nodes carried down at a time.
CHUNK, BLOCK = 1 << 16, 1 << 18
LEAST_LENGTH = 5
FOUND = "word string, n long, n_near long, best_n long, best string"


def lower_ascii(text: Column | str) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(docs: DataFrame) -> DataFrame:
    """doc_id and each run of letters of its text, A-Z lower-cased."""
    return docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all(lower_ascii("text"), F.lit(RUN), F.lit(0))).alias("run"))


def typos(run: Column, doc_id: Column, one_in: int = 97) -> Column:
    """The run less one code point, in one of so many pairs of document and run, as a hash of both has it."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, least_count: int = 3) -> DataFrame:
    """word and n: words of LEAST_LENGTH code points or more that occur so often."""
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


# -- tries as sorted arrays


class Level(NamedTuple):
    """Nodes of one depth, in order: parent * 256 + character of each, and the first child of each, then the end of all."""

    keys: np.ndarray
    children: np.ndarray


def levels(rows: np.ndarray, root: int) -> list[Level]:
    """Levels of the trie of sorted, different rows of bytes, from depth ``root`` to the leaves, whose numbers are those of the rows."""
    n, width = rows.shape
    parts = np.zeros(n, int)
    parts[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
    parts[:1] = -1
    starts = [np.flatnonzero(parts < depth) for depth in range(root, width + 1)]
    out = []
    for at, depth in enumerate(range(root, width + 1)):
        first = starts[at]
        parent = np.searchsorted(starts[at - 1], first, "right") - 1 if at else np.arange(len(first))
        keys = parent << 8 | (rows[first, depth - 1] if depth else 0)
        below = np.searchsorted(starts[at + 1], np.append(first, n)) if depth < width else np.zeros(len(first) + 1, int)
        out.append(Level(keys, below))
    return out


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, .. of each, so many of them."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def carry(u: np.ndarray, v: np.ndarray, of_u: list[Level], of_v: list[Level], skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Leaves below pairs of nodes, along equal characters alone; ``of_u`` and ``of_v`` are their own levels and those below.

    skip holds for each pair a character that the first step may not take.
    """
    for here, (there, below, below_v) in enumerate(zip(of_u, of_u[1:], of_v[1:], strict=False)):
        counts = here_counts(of_u[here], u)
        child = spread(there.children[u], counts)
        letter, other = below.keys[child] & 255, np.repeat(v, counts)
        wanted = other << 8 | letter
        at = np.minimum(np.searchsorted(below_v.keys, wanted), len(below_v.keys) - 1)
        hit = below_v.keys[at] == wanted
        if skip is not None:
            hit &= letter != np.repeat(skip, counts)
            skip = None
        u, v = child[hit], at[hit]
    return u, v


def here_counts(level: Level, nodes: np.ndarray) -> np.ndarray:
    return level.children[nodes + 1] - level.children[nodes]


def blocks(counts: np.ndarray) -> Iterator[slice]:
    """Stretches of items whose counts come to about BLOCK."""
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK, "right")))
        yield slice(start, end)
        start = end


def substituted(trie: list[Level]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves one substitution apart below the root level: siblings, carried down."""
    for depth in range(1, len(trie)):
        parents = trie[depth].keys >> 8
        later = trie[depth - 1].children[parents + 1] - np.arange(len(parents)) - 1
        for block in blocks(later):
            u = np.repeat(np.arange(len(parents))[block], later[block])
            v = spread(np.arange(len(parents))[block] + 1, later[block])
            yield carry(u, v, trie[depth:], trie[depth:])


def inserted(short: list[Level], long: list[Level], same: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves of two tries, the second one insertion longer; ``same`` gives short's root nodes in long, or -1.

    A character inserted among equal ones counts as the last of them, so that each pair comes once.
    """
    for depth in range(len(short)):
        known = np.flatnonzero(same >= 0)
        counts = here_counts(long[depth], same[known])
        for block in blocks(counts):
            u = np.repeat(known[block], counts[block])
            v = spread(long[depth].children[same[known[block]]], counts[block])
            yield carry(u, v, short[depth:], long[depth + 1 :], long[depth + 1].keys[v] & 255)
        if depth + 1 < len(short):
            parent, letter = short[depth + 1].keys >> 8, short[depth + 1].keys & 255
            wanted = same[parent] << 8 | letter
            at = np.minimum(np.searchsorted(long[depth + 1].keys, wanted), len(long[depth + 1].keys) - 1)
            same = np.where((same[parent] >= 0) & (long[depth + 1].keys[at] == wanted), at, -1)


def near_pairs(short: np.ndarray, long: np.ndarray, root: int, tail: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of numbers of near rows, of which those of ``long`` count on from those of ``short``.

    Rows are sorted and different, one byte longer in long; pairs agree in the first ``root`` bytes, and pairs of rows
    of both that agree in the last ``tail`` bytes, if there is a tail, are left to others.
    """
    if not len(short):
        return
    trie = levels(short, root)
    yield from substituted(trie)
    if not len(long):
        return
    other = levels(long, root)
    heads = [np.ascontiguousarray(rows[:, :root]).view(f"S{root}")[:, 0] for rows in (short, long)]
    ours, theirs = (np.unique(h) for h in heads)
    at = np.minimum(np.searchsorted(theirs, ours), len(theirs) - 1)
    for u, v in inserted(trie, other, np.where(theirs[at] == ours, at, -1)):
        if tail:
            apart = (short[u, -tail:] != long[v, -tail:]).any(axis=1)
            u, v = u[apart], v[apart]
        yield u, v + len(short)


class Best:
    """The number of near words of each word, and the best: most frequent, then first."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, np.array(counts, np.int64)
        # the better of two near words has the smaller rank
        self.order = np.array(sorted(range(len(words)), key=lambda i: (-counts[i], words[i])), int)
        self.rank = np.empty(len(words), int)
        self.rank[self.order] = np.arange(len(words))
        self.near = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), len(words))

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        for a, b in ((u, v), (v, u)):
            self.near += np.bincount(a, minlength=len(self.near))
            np.minimum.at(self.best, a, self.rank[b])

    def rows(self) -> pa.RecordBatch:
        found = np.flatnonzero(self.near)
        best = self.order[self.best[found]]
        columns = [pa.array([self.words[i] for i in found], pa.string()), pa.nulls(len(found), pa.int64()), pa.array(self.near[found]), pa.array(self.counts[best]), pa.array([self.words[i] for i in best], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n", "n_near", "best_n", "best"])


def join_part(words: list[str], counts: list[int], length: int, behind: bool) -> pa.RecordBatch:
    """Near words among words of this length and one more, sorted (from behind, if so), that agree in a half."""
    half = length // 2
    short, long = ([i for i, w in enumerate(words) if len(w) == n] for n in (length, length + 1))
    turned = [words[i][::-1] for i in short + long] if not behind else [words[i] for i in short + long]
    plain = [w[::-1] for w in turned]
    best = Best(plain, [counts[i] for i in short + long])
    laid = turned if behind else plain
    rows = [np.frombuffer("".join(part).encode("latin-1"), np.uint8).reshape(-1, n) for part, n in ((laid[: len(short)], length), (laid[len(short) :], length + 1))]
    for u, v in near_pairs(*rows, length - half, half) if behind else near_pairs(*rows, half):
        best.add(u, v)
    return best.rows()


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, best_n and best for parts of the trie: to be summed up by word."""
    length = F.length("word")
    sizes = F.filter(F.array(length, length - 1), lambda n: n >= LEAST_LENGTH)
    both = vocabulary.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("behind")).select("*", F.explode(sizes).alias("length"))
    laid = F.when(F.col("behind"), F.reverse("word")).otherwise(F.col("word"))
    half = F.floor(F.col("length") / 2).cast("int")
    shared = F.substring(F.col("laid"), F.lit(1), F.when(F.col("behind"), F.col("length") - half).otherwise(half))
    parts = both.select("behind", "length", laid.alias("laid"), "n").select("behind", "length", shared.alias("part"), "laid", "n")
    dealt = parts.repartition("behind", "length", "part").sortWithinPartitions("behind", "length", "laid")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        counts: list[int] = []
        last = None
        for batch in batches:
            for *key, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is not None and (key[:2] != last[:2] or (len(words) >= CHUNK and key != last)):
                    yield join_part(words, counts, last[1], last[0])
                    words, counts = [], []
                words.append(word)
                counts.append(n)
                last = key
        if last is not None:
            yield join_part(words, counts, last[1], last[0])

    return dealt.mapInArrow(join, FOUND)


def variants(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near, form and form_n of each word of a vocabulary (word, n), whose words are letters of Latin-1."""
    none = F.lit(None)
    rows = vocabulary.select("word", "n", F.lit(0).cast("long"), none.cast("long"), none.cast("string")).unionAll(near_words(vocabulary))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))))
    found = rows.toDF("word", "n", "n_near", "best_n", "best").groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= 2 * F.col("n")
    return found.select("word", "n", "n_near", F.when(strong, F.col("best.best")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """Adds root: the last word that forms lead to, the word itself without one. Each round joins the words that have a form and halves the way left."""
    found = stored(found)
    links = found.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if links.filter("moved").isEmpty():
            break
        links = links.select("word", "root")
    return found.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


#: DuckDB SQL for the rows of op11. Near words share a string that each gives by leaving out one code point or none.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
  ) GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM runs, crc
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS MATERIALIZED (
  SELECT word, n, 0 AS pos, word AS cut FROM words
  UNION ALL SELECT word, n, pos, word[1:pos - 1] || word[pos + 1:] FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM words)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.cut = b.cut AND a.word <> b.word
  WHERE a.pos = 0 OR b.pos = 0 OR a.pos = b.pos
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n, any_value(n) AS n FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * words.n THEN other END AS form, CASE WHEN other_n >= 2 * words.n THEN other_n END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word
), ways AS (
  SELECT word, word AS root, form AS ahead FROM forms
  UNION ALL SELECT ways.word, ways.ahead, forms.form FROM ways JOIN forms ON ways.ahead = forms.word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM ways WHERE ahead IS NULL) USING (word)
"""
