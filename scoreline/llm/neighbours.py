"""Approximate nearest neighbours by inner product, by cross-polytope hashing.

Equal vectors are one node. A node keeps the top + 1 smallest ids of its vectors: more can't be in a result, since a
query leaves out no id but its own.

1. Norms. Nodes are dealt to bands of norms within a factor of 2 (unit vectors lie in the middle of one), each with its own tables. The longest nodes, HEAD or
   an eighth of them (top + 1 at least), are also compared with every query, which gives each query a bound: a band
   whose longest vector can't reach it is not probed, and what stays below it is dropped.
2. Hash. A vector's direction, padded with zeros to a power of two, is turned by three rounds of random signs and a fast
   Hadamard transform; its hash is the signed axis nearest to the result. A table takes one or several such hashes,
   the last with as many axes as the size of the band asks for, so that buckets don't grow with the table.
3. Probes. The bucket of each table whose axes are nearest to the query comes first, then the next nearest, and so on.
   How many probes, and how fine the buckets, is fitted for each band on CALIBRATION queries, those with the smallest
   hashes, whose true neighbours are found by comparing them with all rows: the cheapest setting with which RECALL of them are met.
4. Rerank. Buckets are dealt in groups of about GROUP vectors; a query goes once to each group in which it probes
   buckets, and is compared there with their vectors exactly, in double precision. A bucket of more than PART vectors
   is dealt to parts, and queries of a group beyond TURN to turns, each of which meets the group.

Every row is indexed. Sizes on the driver are bounded by the constants: a row a band, the head, the calibration.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed

TABLES = 10
ROUNDS = 3
HEAD = 1024
CALIBRATION = 128
RECALL = 0.95
MOST_PROBES = 256
#: Vectors of a bucket, on average, that are tried as settings.
BUCKETS = (16, 32, 64, 128, 256)
GROUP = 4096
PART = 4096
TURN = 8192
HELD = 1 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of each row; the width is a power of two. Steps of up to 16 lanes are one product."""
    n, width = x.shape
    out, left = x, width
    while left > 1:
        step = min(16, left)
        small = np.array([[1.0]])
        while len(small) < step:
            small = np.block([[small, small], [small, -small]])
        out = np.matmul(out.reshape(n, -1, step), small.astype(x.dtype)).transpose(0, 2, 1)
        left //= step
    # Each step moved its lanes to the front, so the order is the bits' own once all are through.
    return np.ascontiguousarray(out.reshape(n, width)) / np.sqrt(width, dtype=x.dtype)


def turn(x: np.ndarray, table: int, k: int, seed: int = 10) -> np.ndarray:
    random = np.random.default_rng((seed, table, k))
    for _ in range(ROUNDS):
        x = hadamard(x * random.choice([-1.0, 1.0], x.shape[1]).astype(x.dtype))
    return x


def directions(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors of single precision, padded with zeros to a power of two."""
    n, d = x.shape
    largest = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / np.where(largest > 0, largest, 1)  # squares of very long and very short vectors stay finite
    out = np.zeros((n, 1 << max(1, d - 1).bit_length()), np.float32)
    out[:, :d] = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return out


def axes_for(width: int, n: int, bucket: int) -> list[int]:
    """Signed axes of each hash of a table: all 2 * width of each but the last, such that n vectors lie about ``bucket`` in a bucket."""
    wanted, out = max(2.0, n / bucket), []
    while wanted > 1:
        take = 2 * width if wanted >= 2 * width else 1 << int(np.ceil(np.log2(wanted)))
        out.append(take)
        wanted /= take
    return out


def nearest_axes(y: np.ndarray, signed: int) -> np.ndarray:
    """(rows, signed) products with the axes in use; a is the axis of place a // 2, with the other sign if a is odd."""
    y = y[:, : signed // 2]
    return np.stack((y, -y), axis=2).reshape(len(y), -1)


def leading(score: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` largest of each row, the largest first."""
    if score.shape[1] <= most:
        return np.argsort(-score, axis=1, kind="stable")
    best = np.sort(np.argpartition(-score, most - 1, axis=1)[:, :most], axis=1)
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, axis=1), axis=1, kind="stable"), axis=1)


def buckets(x: np.ndarray, table: int, probes: int, axes: list[int]) -> np.ndarray:
    """(rows, probes or fewer) buckets of a table for directions x, the nearest first."""
    score, bucket = np.zeros((len(x), 1), np.float32), np.zeros((len(x), 1), np.int64)
    for k, signed in enumerate(axes):
        products = nearest_axes(turn(x, table, k), signed)
        if probes == 1:
            bucket = bucket * signed + products.argmax(axis=1)[:, None]
            continue
        best = leading(products, probes)
        near = np.take_along_axis(products, best, axis=1)
        score = (score[:, :, None] + near[:, None, :]).reshape(len(x), -1)
        bucket = (bucket[:, :, None] * signed + best[:, None, :]).reshape(len(x), -1)
        best = leading(score, probes)
        score, bucket = np.take_along_axis(score, best, axis=1), np.take_along_axis(bucket, best, axis=1)
    return bucket


def spread(bucket: np.ndarray) -> np.ndarray:
    """A hash below 2**31 of each bucket."""
    return ((bucket.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def best_of(q: np.ndarray, u: np.ndarray, least_id: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best different nodes u of each q: highest score, then smallest id."""
    order = np.lexsort((u, least_id, -score, q))
    q, u = q[order], u[order]
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (u[1:] != u[:-1]))) if len(q) else np.zeros(0, bool)
    order, q = order[new], q[new]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[rank < most]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of a with the same row of b, in an order of summing that does not depend on the rest."""
    return (a * b).sum(axis=1)


def products_of(y: np.ndarray, r: np.ndarray, x: np.ndarray, c: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """products(y[r], x[c]), at_once at a time."""
    return np.concatenate([np.zeros(0), *(products(y[r[i : i + at_once]], x[c[i : i + at_once]]) for i in range(0, len(r), at_once))])


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Band:
    n: int
    longest: float
    axes: list[int]
    probes: int

    @property
    def groups(self) -> int:
        return max(1, -(-self.n // GROUP))


def fitted(n: int, queries: np.ndarray, row: np.ndarray, neighbours: np.ndarray, tables: int, recall: float = RECALL) -> tuple[list[int], int]:
    """Axes and probes of a band of n vectors: the least work that meets ``recall`` of the pairs queries[row], neighbours (directions).

    If no size of BUCKETS does, larger buckets are tried, at last so few that the probes reach all of them, which finds every
    pair. Without pairs, the setting for a cosine of a half.
    """
    if not len(row):
        random = np.random.default_rng(n)
        queries, others = (directions(random.normal(size=(64, queries.shape[1]))) for _ in range(2))
        row, neighbours = np.arange(64), directions(queries / 2 + np.sqrt(0.75) * others)
    found = []
    for bucket in chain(BUCKETS, (BUCKETS[-1] << k for k in count(1))):
        if bucket > BUCKETS[-1] and found:
            break
        axes = axes_for(queries.shape[1], n, bucket)
        first = np.full(len(row), MOST_PROBES)
        for t in range(tables):
            hit = buckets(queries, t, MOST_PROBES, axes)[row] == buckets(neighbours, t, 1, axes)
            first = np.minimum(first, np.where(hit.any(axis=1), hit.argmax(axis=1), MOST_PROBES))
        needed = int(np.sort(first)[min(len(first) - 1, int(np.ceil(recall * len(first))) - 1)]) + 1
        probes = min(needed, MOST_PROBES)
        if float((first < probes).mean()) >= recall:
            found.append((probes * n / np.prod(axes, dtype=float) + probes, axes, probes))
    return min(found, key=lambda x: x[0])[1:]


def nearest(
    vectors: DataFrame, queries: Column, top: int = 20, vec_id: str = "vec_id", vector: str = "embedding", tables: int = TABLES, recall: float = RECALL, probes: int | None = None, part: int = PART, turn_of: int = TURN
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors for which queries holds, its top nearest by inner product.

    Vectors that are null, zero, or hold null or non-finite components take no part. Shorter vectors are as if padded
    with zeros. Rows that repeat an id are one candidate a vector. Ties go to the smaller id. Every query gets ``top``
    rows if there are so many candidates, else all. Other columns, whatever their names, are not read. Tables without
    usable vectors give no row. ``probes`` sets the probes of tables of one hash each, instead of fitting.
    """
    element = vectors.schema[vector].dataType.elementType
    stored = np.float32 if element == T.FloatType() else np.float64
    spark, most = vectors.sparkSession, top + 1
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("query"))
    own = own.filter(F.col("id").isNotNull() & usable(F.col("v")))
    width = own.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def as_rows(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), stored).reshape(-1, width).astype(np.float64)

    def as_bytes(batches):
        for batch in batches:
            column, out = batch.column("v"), np.zeros((batch.num_rows, width), stored)
            lengths = np.diff(column.offsets.to_numpy())
            out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in out], pa.binary()), batch.column("query")], names=["id", "v", "query"])

    def distinct(batches):
        ids: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                held = ids.setdefault(v, [])
                held.append(i)
                if len(held) > 4 * top + 64:
                    ids[v] = sorted(set(held))[:most]
        rows = [(v, sorted(set(held))[:most]) for v, held in ids.items()]
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096]
            x = np.frombuffer(b"".join(r[0] for r in some), stored).reshape(-1, width).astype(np.float64)
            largest = np.abs(x).max(axis=1)
            norm = largest * np.sqrt(((x / largest[:, None]) ** 2).sum(axis=1))
            columns = [pa.array([r[0] for r in some], pa.binary()), pa.array([r[1] for r in some], pa.list_(pa.int64())), pa.array(norm), pa.array(np.round(np.log2(norm)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["v", "ids", "norm", "band"])

    own = own.mapInArrow(as_bytes, "id long, v binary, query boolean")
    nodes = own.select("id", "v").mapInArrow(distinct, "v binary, ids array<long>, norm double, band int")
    nodes = nodes.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"), F.first("norm").alias("norm"), F.first("band").alias("band"))
    nodes = checkpointed(nodes.select(F.monotonically_increasing_id().alias("u"), F.element_at("ids", 1).alias("least_id"), "ids", "v", "norm", "band"))
    asked = own.filter("query").select("id", "v").groupBy("v").agg(F.collect_set("id").alias("query_ids"))
    asked = checkpointed(asked.select(F.monotonically_increasing_id().alias("q"), "query_ids", "v"))

    sizes = {r["band"]: r for r in nodes.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}
    most_head = max(most, min(HEAD, sum(r["n"] for r in sizes.values()) // 8))
    upto, least_band = 0, max(sizes)
    for b in sorted(sizes, reverse=True):
        upto, least_band = upto + sizes[b]["n"], b
        if upto >= most_head:
            break

    def least_hashes(df: DataFrame, n: int, among: int) -> DataFrame:
        """The rows of df, of ``among``, that may be among the n with the smallest hashes of v; little more than n."""
        share = 1.2 * (n + 1000) / max(1, among)
        df = df.withColumn("hash", F.pmod(F.xxhash64("v"), F.lit(1 << 40)))
        return df if share >= 1 else df.filter(F.col("hash") < int(share * (1 << 40)))

    longest = least_hashes(nodes.filter(F.col("band") == least_band), most_head, sizes[least_band]["n"]).unionByName(least_hashes(nodes.filter(F.col("band") > least_band), 1, 1))
    head = longest.orderBy(F.col("band").desc(), "hash", "v").limit(most_head).select("u", "least_id", "v").toPandas()
    tried = least_hashes(asked, CALIBRATION, asked.count()).orderBy("hash", "v").limit(CALIBRATION).select("v").toPandas()

    def rows_of(values) -> np.ndarray:
        return np.frombuffer(b"".join(values), stored).reshape(-1, width).astype(np.float64)

    sample = spark.sparkContext.broadcast(rows_of(tried["v"]))

    def scan(batches):
        q, score, u = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                rough = sample.value @ as_rows(some.column("v")).T
                near = np.argsort(-rough, axis=1, kind="stable")[:, :most]
                q, score = np.concatenate((q, np.repeat(np.arange(len(near)), near.shape[1]))), np.concatenate((score, np.take_along_axis(rough, near, axis=1).ravel()))
                u = np.concatenate((u, some.column("u").to_numpy()[near.ravel()]))
                keep = best_of(q, u, u, score, most)
                q, score, u = q[keep], score[keep], u[keep]
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score), pa.array(u)], names=["q", "score", "near"])

    pairs = pd.DataFrame({"q": np.zeros(0, int), "v": [], "band": []})
    if len(tried):
        ranked = Window.partitionBy("q").orderBy(F.col("score").desc(), "near")
        truth = nodes.select("u", "v").mapInArrow(scan, "q long, score double, near long").withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= most)
        pairs = nodes.join(truth, F.col("u") == F.col("near")).select("q", "v", "band").toPandas().sort_values(["q", "v"])
        pairs = pairs[[v != tried["v"].iloc[q] for q, v in zip(pairs["q"], pairs["v"], strict=True)]]
    asks, near, row = directions(rows_of(tried["v"])), directions(rows_of(pairs["v"])), pairs["q"].to_numpy(int)
    bands = {}
    for b, r in sizes.items():
        mine = (pairs["band"] == b).to_numpy(bool)
        mine = mine if mine.sum() >= 2 * top else np.ones(len(pairs), bool)  # too few to go by: all together
        setting = fitted(r["n"], asks, row[mine], near[mine], tables, recall) if probes is None else ([2 * near.shape[1]], probes)
        bands[b] = Band(r["n"], r["longest"], *setting)
    shared = spark.sparkContext.broadcast((bands, head["u"].to_numpy(np.int64), head["least_id"].to_numpy(np.int64), rows_of(head["v"])))

    def indexed(batches):
        bands = shared.value[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x, band = directions(as_rows(some.column("v"))), some.column("band").to_numpy()
                found, group = np.zeros((2, len(x), tables), np.int64)
                for b in np.unique(band).tolist():
                    mine = np.flatnonzero(band == b)
                    for t in range(tables):
                        found[mine, t] = buckets(x[mine], t, 1, bands[b].axes)[:, 0]
                    group[mine] = spread(found[mine]) % bands[b].groups
                ends = pa.array(np.arange(len(x) + 1) * tables, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (found, group)]
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in ("u", "least_id", "v", "band")), *lists], names=["u", "least_id", "v", "band", "bs", "gs"])

    index = checkpointed(nodes.select("u", "least_id", "v", "band").mapInArrow(indexed, "u long, least_id long, v binary, band int, bs array<long>, gs array<long>"))
    index = index.select("band", "u", "least_id", "v", F.posexplode(F.arrays_zip("bs", "gs")).alias("t", "x")).select("band", "t", F.col("x.bs").alias("b"), F.col("x.gs").alias("g"), "u", "least_id", "v")
    large = checkpointed(index.groupBy("band", "t", "b").count().filter(F.col("count") > part).select("band", "t", "b", F.ceil(F.col("count") / part).cast("int").alias("parts")))

    def asking(batches):
        bands, head_u, head_ids, head_rows = shared.value
        k, norms = min(most, len(head_u)), max(b.longest for b in bands.values())
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                y = as_rows(some.column("v"))
                near = np.argsort(-(y @ head_rows.T), axis=1, kind="stable")[:, :k]
                score = products(np.repeat(y, k, axis=0), head_rows[near.ravel()]).reshape(-1, k)
                # Nodes below the last of most = top + 1 can't be in a result; sums in another order differ by less than the slack.
                norm = np.sqrt((y * y).sum(axis=1))
                least = np.nan_to_num(score.min(axis=1) - 1e-12 * norm * norms, nan=-np.inf, posinf=-np.inf) if k == most else np.full(len(y), -np.inf)
                ends = pa.array(np.arange(len(y) + 1) * k, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (head_u[near].ravel(), head_ids[near].ravel(), score.ravel())]
                none = [pa.nulls(len(y), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([some.column("q"), pa.array(least), *none, *lists], names=names)
                x = directions(y)
                for b, band in bands.items():
                    may = np.flatnonzero(~(band.longest * norm * (1 + 1e-9) < least))
                    for t in range(tables if len(may) else 0):
                        found = buckets(x[may], t, band.probes, band.axes)
                        group, row = (spread(found) % band.groups).ravel(), np.repeat(np.arange(len(may)), found.shape[1])
                        order = np.lexsort((group, row))
                        row, group, found = row[order], group[order], found.ravel()[order]
                        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (group[1:] != group[:-1]))))
                        n, who = len(new), may[row[new]]
                        lot = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), pa.array(found))
                        columns = [some.column("q").take(pa.array(who)), pa.array(least[who]), pa.array(np.full(n, b, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(group[new]), lot]
                        yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, x.type) for x in lists)], names=names)

    names = ["q", "least", "band", "t", "g", "lot", "head_u", "head_ids", "scores"]
    probes = checkpointed(asked.select("q", "v").mapInArrow(asking, "q long, least double, band int, t int, g long, lot array<long>, head_u array<long>, head_ids array<long>, scores array<double>"))
    of_head = probes.filter("t IS NULL").select("q", F.explode(F.arrays_zip("head_u", "head_ids", "scores")).alias("x")).select("q", F.col("x.head_u").alias("u"), F.col("x.head_ids").alias("least_id"), F.col("x.scores").alias("score"))

    # A place is a group of small buckets (slot 0 and up), or a part of a large bucket (slot below 0).
    place = ["band", "t", "slot", "part"]
    index = index.join(large, ["band", "t", "b"], "left")
    index = index.withColumn("slot", F.when(F.col("parts").isNull(), F.col("g")).otherwise(-1 - F.col("b"))).withColumn("part", F.coalesce(F.pmod(F.xxhash64("u"), F.col("parts")), F.lit(0)).cast("int"))
    probes = probes.filter("t IS NOT NULL")
    wide = probes.withColumn("b", F.explode("lot")).join(large, ["band", "t", "b"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    wide = wide.select("q", "least", "band", "t", (-1 - F.col("b")).alias("slot"), "part", F.array("b").alias("lot"))
    probes = probes.select("q", "least", "band", "t", F.col("g").alias("slot"), F.lit(0).alias("part"), "lot").unionByName(wide)
    busy = checkpointed(probes.groupBy(*place).count().filter(F.col("count") > turn_of).select(*place, F.ceil(F.col("count") / turn_of).cast("int").alias("turns")))
    index = index.select(*place, "b", "u", "least_id", "v").join(busy, place, "left").withColumn("turn", F.explode(F.sequence(F.lit(0), F.coalesce("turns", F.lit(1)) - 1)))
    probes = probes.join(busy, place, "left").withColumn("turn", F.coalesce(F.pmod(F.xxhash64("q"), F.col("turns")), F.lit(0)).cast("int")).join(asked.select("q", "v"), "q")
    keys = [*place, "turn"]
    met = index.select(*keys, F.lit(0).alias("kind"), "b", "u", "least_id", "v", F.lit(None).cast("double").alias("least"), F.lit(None).cast("array<long>").alias("lot")).unionByName(
        probes.select(*keys, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("b"), F.col("q").alias("u"), F.lit(0).cast("long").alias("least_id"), "v", "least", "lot")
    )
    met = met.repartition(*keys).sortWithinPartitions(*keys, "kind", "b")

    def search(batches):
        key, held, parts = None, [], []
        own: tuple[np.ndarray, ...] = ()

        def merged():
            q, u, least_id, score = (np.concatenate([h[i] for h in held]) for i in range(4))
            keep = best_of(q, u, least_id, score, most)
            return q[keep], u[keep], least_id[keep], score[keep]

        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in [*keys, "kind"]]
            new = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))))
            for a, e in zip(new, np.append(new[1:], batch.num_rows), strict=True):
                here = tuple(int(c[a]) for c in columns[:-1])
                if here != key:
                    key, parts, own = here, [], ()
                some = batch.slice(a, e - a)
                if columns[-1][a] == 0:
                    parts.append((*(some.column(k).to_numpy() for k in ("b", "u", "least_id")), as_rows(some.column("v"))))
                    continue
                if not parts:
                    continue
                own = own or tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                for at in range(0, len(some), 1024):
                    held.append(compared(some.slice(at, 1024), *own))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [merged()]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["q", "u", "least_id", "score"])

    def compared(some: pa.RecordBatch, b: np.ndarray, u: np.ndarray, least_id: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pairs of queries and vectors of the buckets they probe that may be in a result."""
        y, least, q = as_rows(some.column("v")), some.column("least").to_numpy(), some.column("u").to_numpy()
        lots = some.column("lot")
        row, lot = np.repeat(np.arange(len(y)), np.diff(lots.offsets.to_numpy())), lots.flatten().to_numpy()
        order = np.lexsort((row, lot))
        row, lot = row[order], lot[order]
        starts = np.flatnonzero(np.concatenate(([True], lot[1:] != lot[:-1])))
        first, last = np.searchsorted(b, lot[starts]), np.searchsorted(b, lot[starts], "right")
        rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e, i, j in zip(starts, np.append(starts[1:], len(lot)), first, last, strict=True):
            if i < j:
                asking = row[s:e]
                r, c = np.nonzero(y[asking] @ x[i:j].T >= least[asking, None])
                rows.append(asking[r])
                places.append(c + i)
        r, c = np.concatenate(rows), np.concatenate(places)
        score = products_of(y, r, x, c)
        keep = best_of(r, u[c], least_id[c], score, most)
        return q[r[keep]], u[c[keep]], least_id[c[keep]], score[keep]

    found = met.mapInArrow(search, "q long, u long, least_id long, score double").unionByName(of_head)
    found = found.groupBy("q", "u", "least_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("q").orderBy(F.col("score").desc(), "least_id", "u")
    found = found.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= most).select("q", F.col("u").alias("near"), "score")
    found = found.join(nodes.select("u", "ids"), F.col("near") == F.col("u")).select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= most).select("q", "score", "vec_id")
    results = asked.select("q", F.explode("query_ids").alias("query_id")).join(found, "q").filter("vec_id <> query_id")
    results = results.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return results.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def exact_nearest(frame: pd.DataFrame, wanted: np.ndarray, top: int = 20) -> dict[int, list[int]]:
    """Brute force over a small table (vec_id, embedding), to measure recall against."""
    ids, x = frame["vec_id"].to_numpy(), np.array(frame["embedding"].tolist(), float)
    out = {}
    for q in wanted:
        score = (x * x[ids == q][0]).sum(axis=1)
        order = np.lexsort((ids, -score))
        out[int(q)] = [int(i) for i in ids[order] if i != q][:top]
    return out
