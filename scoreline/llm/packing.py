"""Best-fit packing of documents into sequences of a fixed number of words, under conflicts.

Documents are dealt by hash to shards of about SHARD_DOCS; a shard is packed on its own, so a task's memory and time
do not grow with the corpus, and the waste is that of a few open bins a shard. A document longer than a bin fills
whole bins of its own, and what is left of it is packed. In a shard, pieces go largest first. Open bins are held in
order of residual. For a piece, the successor search starts at the smallest residual that holds it and goes on, bin
by bin, until it meets the first one without a conflict, which is the tightest compatible bin; if none is left, a bin is opened.
Each bin carries a bitmap of its duplicate clusters and a bitmap of its sources, in which bit s is set once source s
has its share of the bin: no two documents of one duplicate cluster share a bin, and no more of a source than its
share, which is at least ``source_share`` of a bin's words, and never less than what the source has of the shard's
words or of an even split between the shard's sources, with SLACK to spare; so the conflicts leave the bins fillable whatever
the number of sources and the length of texts. The tightest compatible bin is that of the shard.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbering, checkpointed, word_count

CAPACITY = 2048
SOURCE_SHARE = 0.5
SLACK = 1.25
SHARD_DOCS = 4096


def source_limits(sizes: list[int], sources: list, capacity: int = CAPACITY, source_share: float = SOURCE_SHARE) -> dict:
    """How many words of each source a bin may hold before the source is closed to it."""
    words: Counter = Counter()
    for n, s in zip(sizes, sources, strict=True):
        if s is not None:
            words[s] += n % capacity
    total = sum(words.values())
    return {s: capacity * min(1.0, max(source_share, SLACK * n / max(1, total), SLACK / len(words))) for s, n in words.items()}


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, source_share: float = SOURCE_SHARE) -> list[tuple[int, int, int, int]]:
    """(document, first word, bin, place in the bin) of every piece; None as a source or cluster conflicts with nothing.

    A source is closed to a bin once it has its limit of words there; the piece that reaches the limit may exceed it.
    """
    pieces, rest = [], []
    n_bins = 0
    for i, n in enumerate(sizes):
        for k in range(n // capacity):
            pieces.append((i, k * capacity, n_bins, 0))
            n_bins += 1
        if n % capacity or n == 0:
            rest.append((-(n % capacity), i))
    limits = source_limits(sizes, sources, capacity, source_share)
    source_bits, cluster_bits = Numbering(), Numbering()
    several = {c for c, n in Counter(c for c in clusters if c is not None).items() if n > 1}
    open_bins: list[int] = []  # residual << 32 | bin
    in_clusters: dict[int, int] = {}
    closed: dict[int, int] = {}
    held: dict[tuple[int, int], int] = {}  # words of a source in a bin
    for negative, i in sorted(rest):
        size = -negative
        source = 1 << source_bits[sources[i]] if sources[i] is not None else 0
        cluster = 1 << cluster_bits[clusters[i]] if clusters[i] in several else 0
        at = bisect_left(open_bins, size << 32)
        while at < len(open_bins) and (in_clusters[b := open_bins[at] & 0xFFFFFFFF] & cluster or closed[b] & source):
            at += 1
        if at < len(open_bins):
            residual = open_bins.pop(at) >> 32
        else:
            b, residual = n_bins, capacity
            in_clusters[b] = closed[b] = 0
            n_bins += 1
        pieces.append((i, sizes[i] - size, b, capacity - residual))
        in_clusters[b] |= cluster
        if source:
            held[b, source] = held.get((b, source), 0) + size
            if held[b, source] >= limits[sources[i]]:
                closed[b] |= source
        if residual > size:
            insort(open_bins, (residual - size) << 32 | b)
    return pieces


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, source_share: float = SOURCE_SHARE, shard_docs: int = SHARD_DOCS, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, start_word, n_words, bin_id, bin_start for every piece of every document.

    Needs doc_id, text, source, and the column named by cluster (by default a duplicate cluster is a hash of the text
    with A-Z and other capitals lowered). Every word of every text is in one piece. Documents without words have one piece of 0
    words. Null sources and null clusters conflict with nothing; null texts have no words. Repeated rows are separate
    documents of one cluster. Ties in size go by doc_id, cluster and source, nulls first. Texts are read whole; other columns, whatever their
    names, are not read. An empty table gives no row.
    """
    group = F.col(cluster).cast("string") if cluster else F.when(F.length("text") > 0, F.xxhash64(F.lower("text")).cast("string"))
    rows = checkpointed(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), word_count("text").alias("n"), group.alias("cluster")))
    shards = max(1, -(-rows.count() // shard_docs))
    # Rows without an id that are alike in all else are dealt by their order among them, whichever gets which.
    spread = F.monotonically_increasing_id()
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "n", "source", F.when(F.col("doc_id").isNull(), spread)), F.lit(shards)).cast("long"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "cluster", "source", "n"], na_position="first", kind="stable").reset_index(drop=True)
        sources, clusters = ([None if pd.isna(x) else x for x in frame[k]] for k in ("source", "cluster"))
        sizes = frame["n"].astype(int).tolist()
        pieces = sorted(pack_shard(sizes, sources, clusters, capacity, source_share))
        doc, start, b, place = (list(x) for x in zip(*pieces, strict=True))
        n_words = [min(capacity, sizes[i] - s) for i, s in zip(doc, start, strict=True)]
        ids = frame["doc_id"].astype("Int64")
        return pd.DataFrame(
            {
                "doc_id": ids.take(doc).to_numpy(dtype=object, na_value=None),
                "piece": [s // capacity for s in start],
                "start_word": start,
                "n_words": n_words,
                "bin_id": [int(frame["shard"].iloc[0]) << 32 | x for x in b],
                "bin_start": place,
            }
        ).astype({"doc_id": "Int64"})

    return rows.groupBy("shard").applyInPandas(pack, "doc_id long, piece int, start_word long, n_words int, bin_id long, bin_start int")
