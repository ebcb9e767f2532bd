"""SimHash near-duplicates with bit-sliced comparison, and near copies by exact similarity.

1. Each document's fingerprint is the bitwise majority of the hashes of its word shingles.
2. Documents of one fingerprint are one node from here on, so copies cost nothing more.
3. The 64 bits are cut into m blocks. Two fingerprints that differ in r bits agree in m - r blocks at least, so each
   choice of m - r blocks is a table, and fingerprints meet that agree in all blocks of a choice. m is the smallest
   for which buckets hold BUCKET fingerprints on average; any m finds all pairs.
4. A bucket of more than PART fingerprints is dealt to parts, and each two parts meet in a task of their own.
5. In a task, fingerprints lie in order of their bucket and are turned into bit planes of 64 lanes. A fingerprint is
   compared with the planes that its bucket covers: the differing bits of 64 lanes are summed by carry-save adders
   into vertical counters, and a comparison is abandoned once all lanes exceed the radius.
6. A task passes on a spanning forest of the links found, not the links; the forests are joined to components by
   alternating large-star and small-star steps.

keep_one, for the pipeline's stage, links by the similarity of five-word shingles: rows whose fingerprints step 5 links
are candidates, and, as pairs at 0.8 lie up to 13 bits apart, where block tables no longer cut the work, so are those that
share a band of a MinHash signature. Whole sets of shingles are compared before two texts are linked.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, texts

SHINGLE = 4
SEED = 42
RADIUS = 4
#: The rule of the pipeline's stage: near copies share this much of their sets of shingles of this many words.
COPY_SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
BAND = 4
#: Bytes of shingle sets of a bucket that meet in one part.
PART_BYTES = 16 << 20
ORDER = ["t", "k", "x", "y"]
BUCKET = 64
PART = 2048
#: Rows of one key are dealt to so many places, if it has so many.
SALTS = 1024
#: The rank of nodes without an id: after all others.
NO_ID = (1 << 63) - 1
#: Comparisons (a fingerprint with 64 lanes) held in memory at once.
AT_ONCE = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of the text with A-Z lowered; one shingle if it has fewer words, none if it has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-width])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    n, total = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 255 * 256):
        bits = np.unpackbits(hashes[i : i + 255 * 256].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        for k in range(0, len(bits), 255):
            total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row; null and empty texts have 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([majority(shingle_hashes(t, width)) for t in texts(batch)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def table_masks(blocks: int, radius: int) -> list[int]:
    """A signed 64-bit mask for each choice of blocks - radius blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    chosen = (sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - radius))
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def blocks_for(n: int, radius: int, bucket: int = BUCKET) -> int:
    blocks = radius + 1
    while n / 2 ** (64 * (blocks - radius) / blocks) > bucket and blocks < radius + 5:
        blocks += 1
    return blocks


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, blocks) words: bit j of [b, k] is bit b of fingerprint 64 * k + j."""
    padded = np.zeros(-(-len(fps) // 64) * 64, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(-1, 64, 64)
    packed = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little"))
    return packed.view("<u8").reshape(64, -1)


def within(planes: np.ndarray, block: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare fps[i] with the 64 lanes of block[i]: the i that keep a lane, and the mask of their lanes within radius."""
    alive = np.arange(len(fps))
    ones, twos, fours, over = (np.zeros(len(fps), np.uint64) for _ in range(4))

    def differing(bit: int) -> np.ndarray:
        own = np.uint64(0) - ((fps >> np.uint64(bit)) & np.uint64(1))
        return planes[bit].take(block) ^ own

    def add(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = total ^ a
        return half ^ b, (total & a) | (half & b)

    for bit in range(0, 64, 4):
        ones, carry1 = add(ones, differing(bit), differing(bit + 1))
        ones, carry2 = add(ones, differing(bit + 2), differing(bit + 3))
        twos, carry = add(twos, carry1, carry2)
        over |= fours & carry
        fours = fours ^ carry
        if bit % 16 == 12:
            exceeds = np.zeros_like(ones)
            for k, counter in enumerate((ones, twos, fours)):
                exceeds = exceeds & counter if radius >> k & 1 else exceeds | counter
            exceeds |= over
            stay = exceeds != ALL
            if not stay.all():
                alive, block, fps, ones, twos, fours, over, exceeds = (x[stay] for x in (alive, block, fps, ones, twos, fours, over, exceeds))
    return alive, ~exceeds


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (the smallest index of each tree) after linking a[i] with b[i]."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    return root


def forest(fps: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Root index of each fingerprint after linking i and j, i < j < ends[i], within the radius."""
    n = len(fps)
    root, planes = np.arange(n), bit_planes(fps)
    first = (np.arange(n) + 1) // 64
    count = np.where(ends > np.arange(n) + 1, (ends - 1) // 64 - first + 1, 0)
    upto = np.cumsum(count)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + AT_ONCE, "right")))
        many = count[start:stop]
        row = np.repeat(np.arange(start, stop), many)
        block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        alive, lanes = within(planes, block, fps[row], radius)
        if len(alive):
            bits = np.unpackbits(lanes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            which, lane = np.nonzero(bits)
            i = row[alive[which]]
            j = block[alive[which]] * 64 + lane
            good = (j > i) & (j < ends[i])
            root = join_roots(root, i[good], j[good])
        start = stop
    return root


def in_parts(met: DataFrame, large: DataFrame, node: str) -> DataFrame:
    """met (t, k, node and more) with the pair x, y of parts in which a row is compared; large (t, k, parts) has the buckets that are cut."""
    carried = [c for c in met.columns if c not in ("t", "k")]
    met = met.join(large, ["t", "k"], "left").withColumn("own", F.pmod(F.xxhash64(node), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own"))
    pairs = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(
        F.transform(others, lambda x: F.struct(F.least(x, F.col("own")).alias("x"), F.greatest(x, F.col("own")).alias("y")))
    )
    return met.select(*carried, "t", "k", F.explode(pairs).alias("p")).select(*carried, "t", "k", "p.x", "p.y")


def together(met: DataFrame) -> DataFrame:
    """The rows of in_parts in order of t, k, x, y, those of a pair of parts in one task."""
    return met.repartition(*ORDER).sortWithinPartitions(*ORDER)


def by_bucket(compare):
    """For mapInArrow over rows in order of ORDER: compare(table, starts) of whole buckets, a table of them at a time."""

    def run(batches):
        held: list[pa.Table] = []

        def flush(table: pa.Table):
            keys = [table.column(k).to_numpy() for k in ORDER]
            return compare(table, np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            last = [table.column(k)[-1].as_py() for k in ORDER]
            if held and all(held[0].column(k)[0].as_py() == v for k, v in zip(ORDER, last, strict=True)):
                held.append(table)  # still the bucket that is held
                continue
            table = pa.concat_tables([*held, table]).combine_chunks()
            same = np.logical_and.reduce([table.column(k).to_numpy() == v for k, v in zip(ORDER, last, strict=True)])
            cut = int(np.argmax(same))
            if cut:
                yield flush(table.slice(0, cut).combine_chunks())
            held = [table.slice(cut)]
        if held:
            yield flush(pa.concat_tables(held).combine_chunks())

    return run


def links(fps: DataFrame, n: int, radius: int = RADIUS, bucket: int = BUCKET, part: int = PART) -> DataFrame:
    """a, b (structs of rank i and fingerprint n): links between distinct fingerprints, rows (fp, least_id), that join all pairs within the radius, directly or by others."""
    masks = table_masks(blocks_for(n, radius, bucket), radius)
    met = fps.select("fp", rank(), F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))).alias("m")).select("fp", "i", "m.t", "m.k")
    large = met.groupBy("t", "k").count().filter(F.col("count") > part).select("t", "k", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    met = together(in_parts(met, large, "fp"))

    def compare(table: pa.Table, new: np.ndarray):
        fp = table.column("fp").to_numpy().view(np.uint64)
        ends = np.repeat(np.append(new[1:], len(fp)), np.diff(np.append(new, len(fp))))
        root = forest(fp, ends, radius)
        linked = np.flatnonzero(root != np.arange(len(fp)))
        own = [table.column(k).combine_chunks() for k in ("i", "fp")]
        return pa.RecordBatch.from_arrays([ends_of(*own, linked), ends_of(*own, root[linked])], names=["a", "b"])

    return met.mapInArrow(by_bucket(compare), "a struct<i: long, n: long>, b struct<i: long, n: long>")


def rank() -> Column:
    return F.coalesce("least_id", F.lit(NO_ID)).alias("i")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b): root is the smallest node of its component.

    Large-star and small-star steps alternate until the edges stay the same; each pair of steps is checkpointed.
    The edges of a node are dealt by a salt as well, and its least neighbour goes to the salts that it has, so that no
    task gets all edges of a hub.
    """

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def with_least(df: DataFrame) -> DataFrame:
        """df with m, the least b of each a."""
        df = df.withColumn("salt", salt("b")).repartition("a", "salt")
        least = df.groupBy("a", "salt").agg(F.min("b").alias("m")).groupBy("a").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
        least = least.select(F.col("a").alias("c"), "m", F.explode("salts").alias("z"))
        return df.join(least, (F.col("a") == F.col("c")) & (F.col("salt") == F.col("z"))).select("a", "b", "m")

    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = sign(edges)
    while True:
        sym = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(sym).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).filter("a <> b").distinct()
        small = with_least(large).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.filter("a <> b").distinct())
        now = sign(edges)
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def labelled(nodes: DataFrame, name: str, edges: DataFrame) -> DataFrame:
    """name and component_id, the smallest least_id reached, of every row of nodes (name, least_id).

    The ends of edges are structs (i, n) of the node's rank and its name, so that the least node of a component says
    its result, and nothing is joined on it: one component may hold a large share of all nodes.
    """
    roots = components(edges).select(F.col("node.n").alias("r_name"), F.col("root.i").alias("root_id"))
    rooted = nodes.join(roots, F.col(name) == F.col("r_name"), "left")
    reached = F.when(F.col("root_id") < NO_ID, F.col("root_id"))
    return rooted.select(name, F.when(F.col("r_name").isNull(), F.col("least_id")).otherwise(reached).alias("component_id"))


def ends_of(rank: pa.Array, name: pa.Array, places) -> pa.StructArray:
    places = pa.array(places, pa.int64())
    return pa.StructArray.from_arrays([rank.take(places), name.take(places)], names=["i", "n"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, bucket: int = BUCKET, part: int = PART) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every row.

    Rows whose fingerprints differ in at most radius (0 to 7) bits are linked; component_id is the smallest doc_id reachable.
    Needs doc_id, text. Null and empty texts have fingerprint 0 and are linked like any other; rows without an id
    link others, and have the component_id null if no row they reach has an id. Repeated rows share a component. An
    empty table gives no row.
    """
    marked = checkpointed(fingerprints(docs, width).withColumn("salt", salt("doc_id")))
    nodes = marked.groupBy("fp", "salt").agg(F.min("doc_id").alias("least_id"))
    nodes = checkpointed(nodes.groupBy("fp").agg(F.min("least_id").alias("least_id"), F.collect_list("salt").alias("salts")))
    return with_components(marked, nodes, "fp", links(nodes, nodes.count(), radius, bucket, part))


def salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def with_components(marked: DataFrame, nodes: DataFrame, name: str, edges: DataFrame) -> DataFrame:
    """doc_id, name and component_id of marked (doc_id, name, salt); nodes (name, least_id, salts) says which salts a name has, as one name may have a large share of all rows."""
    held = nodes.select(F.col(name).alias("h_name"), F.explode("salts").alias("z"))
    labels = labelled(nodes, name, edges).withColumnRenamed(name, "l_name")
    labels = labels.join(held, F.col("l_name") == F.col("h_name")).select("l_name", "z", "component_id")
    return marked.join(labels, (F.col(name) == F.col("l_name")) & (F.col("salt") == F.col("z"))).select("doc_id", name, "component_id")


def signature(shingles: np.ndarray) -> list[int]:
    """BANDS hashes of BAND smallest permuted hashes each; none of a text without words."""
    if not len(shingles):
        return []
    random = np.random.default_rng(SEED)
    times, plus = random.integers(0, 2**64, (2, BANDS * BAND, 1), np.uint64)
    least = np.full(BANDS * BAND, ALL)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096] * (times | np.uint64(1)) + plus).min(axis=1))
    return [xxhash.xxh3_64_intdigest(band.tobytes()) - (1 << 63) for band in least.reshape(BANDS, BAND)]


def similar(sets: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """Root index of each set of shingles, none empty, after linking those whose exact Jaccard similarity is at least ``least``."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, root = sizes[order], np.arange(len(sets))
    words, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts, held = np.cumsum(sizes) - sizes, np.zeros(len(words), bool)
    # A set is met by those after it that are not too large, and not at all once all of them are linked with it.
    upto = np.searchsorted(sizes, sizes / least * (1 + 1e-9), "right")
    for i in range(len(sets)):
        a, b = i + 1, int(upto[i])
        if a >= b or (root[a:b] == root[i]).all():
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        held[own] = True
        common = np.add.reduceat(held[ids[starts[a] : starts[b - 1] + sizes[b - 1]]], starts[a:b] - starts[a], dtype=np.int64)
        held[own] = False
        near = a + np.flatnonzero(common / (sizes[i] + sizes[a:b] - common) >= least)
        root = join_roots(root, np.full(len(near), i), near)
    out = np.empty(len(sets), int)
    out[order] = order[root]
    return out


def fingerprint_stars(fps: DataFrame, radius: int) -> DataFrame:
    """fp and k of fps (fp, least_id), some several times: each two fingerprints within radius bits share a k, the root of a tree that links passes on, or are each other's."""
    found = links(fps, fps.count(), radius).select(F.col("a.n").alias("fp"), F.col("b.n").alias("k")).distinct()
    return fps.select("fp", F.col("fp").alias("k")).unionByName(found)


def near_copies(docs: DataFrame, least: float = SIMILARITY, width: int = COPY_SHINGLE, part_bytes: int = PART_BYTES, radius: int | None = None) -> DataFrame:
    """doc_id, node (a hash of the shingle set) and component_id of every row.

    Rows whose sets of ``width``-word shingles have a Jaccard similarity of at least ``least`` are linked; component_id
    is the smallest doc_id reachable. Candidates share a band of a MinHash signature, which two texts at 0.8 miss with
    a probability of 3e-6; each link is confirmed by comparing the whole sets. Rows of equal sets are one node, and so
    are rows without words. With a radius, rows whose fingerprints of four-word shingles differ in so many bits or fewer are candidates as well.
    Nulls, repeated rows and empty tables are as in near_duplicates.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, width)) for t in texts(batch)]
        nodes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
        fps = [0 if radius is None else majority(shingle_hashes(t)) for t in texts(batch)]
        arrays = [batch.column(0), nodes, pa.array([signature(s) for s in sets], pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "node", "bands", "fp"])

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, width)).tobytes() for t in texts(batch)]
        return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["s_node", "shingles"])

    marked = checkpointed(map_batches(own, sketch, "doc_id long, node binary, bands array<long>, fp long").withColumn("salt", salt("doc_id")))
    nodes = marked.groupBy("node", "salt").agg(F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"), F.collect_set("fp").alias("fps"))
    fps = F.array_distinct(F.flatten(F.collect_list("fps"))).alias("fps")
    nodes = checkpointed(nodes.groupBy("node").agg(F.min("least_id").alias("least_id"), F.first("bands").alias("bands"), fps, F.collect_list("salt").alias("salts")))
    met = nodes.select("node", rank(), F.posexplode("bands").alias("t", "k"))
    if radius is not None:
        worded = nodes.filter(F.size("bands") > 0).select("node", rank(), F.explode("fps").alias("fp"))
        stars = fingerprint_stars(checkpointed(worded.groupBy("fp").agg(F.min("i").alias("least_id"))), radius)
        met = met.unionByName(worded.join(stars, "fp").select("node", "i", F.lit(BANDS).alias("t"), "k").distinct())
    # Of the buckets that hold the same nodes, one is enough.
    buckets = met.groupBy("t", "k").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("u"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("v")).filter("n > 1")
    buckets = buckets.groupBy("n", "u", "v").agg(F.min(F.struct("t", "k")).alias("m")).select("m.t", "m.k")
    members = checkpointed(met.join(buckets, ["t", "k"]))
    asked = nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("a_node"), F.col("least_id").alias("a_id"))
    named = own.join(asked.filter("a_id IS NOT NULL").select("a_id"), F.col("doc_id") == F.col("a_id"), "left_semi")
    sets = map_batches(named.unionByName(own.filter("doc_id IS NULL")), whole, "s_node binary, shingles binary").join(asked, F.col("s_node") == F.col("a_node"), "left_semi")
    sets = checkpointed(sets.dropDuplicates(["s_node"]))
    sized = members.join(sets.select("s_node", F.length("shingles").alias("bytes")), F.col("node") == F.col("s_node")).select("t", "k", "node", "bytes")
    large = sized.groupBy("t", "k").agg(F.ceil(F.sum("bytes") / part_bytes).cast("int").alias("parts")).filter("parts > 1")
    # The sets join last, so that of all exchanges by bucket the one that brings the parts together alone has them.
    met = together(in_parts(members, large, "node").join(sets, F.col("node") == F.col("s_node")).select(*ORDER, "node", "i", "shingles"))

    def compare(table: pa.Table, starts: np.ndarray):
        own, data = [table.column(k).combine_chunks() for k in ("i", "node")], table.column("shingles").to_pylist()
        a, b = [], []
        for start, end in zip(starts, np.append(starts[1:], len(data)), strict=True):
            for i, r in enumerate(similar([np.frombuffer(x, np.uint64) for x in data[start:end]], least)):
                if r != i:
                    a.append(start + i)
                    b.append(start + r)
        return pa.RecordBatch.from_arrays([ends_of(*own, a), ends_of(*own, b)], names=["a", "b"])

    return with_components(marked.select("doc_id", "node", "salt"), nodes.select("node", "least_id", "salts"), "node", met.mapInArrow(by_bucket(compare), "a struct<i: long, n: binary>, b struct<i: long, n: binary>"))


def keep_one(docs: DataFrame, least: float = SIMILARITY, width: int = COPY_SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of its component; one row of each id, the first by text.

    Components are those of near_copies, with all pairs of fingerprints within radius bits among its candidates.

    Rows without an id can't be named as a component's document; all of them stay.
    """
    found = near_copies(docs, least, width, radius=radius).filter("doc_id = component_id")
    kept = checkpointed(found.groupBy("doc_id").agg(F.count("*").alias("rows")))
    joined = docs.select(F.struct("*").alias("r")).join(kept, F.col("r.doc_id").cast("long") == F.col("doc_id"))
    if not kept.filter("rows > 1").isEmpty():
        first = Window.partitionBy("doc_id").orderBy("r.text")
        joined = joined.withColumn("place", F.row_number().over(first)).filter("place = 1")
    return joined.select("r.*").unionByName(docs.filter("doc_id IS NULL"))
