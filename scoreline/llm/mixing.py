"""Mixing sources to target weights by Pareto order sampling.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``share`` times all words;
no target exceeds ``most_copies`` times its source's words, and what is above goes to the others by weight. The
shares that satisfy this are min(cap, level * weight) for one level, found from running sums over the sources.

Copies. Each document of a source gets floor(target / words) whole copies for certain. The rest, a part R of the
source's words, is a sample without replacement of unequal probabilities: a document's inclusion probability is in
proportion to the number of binary digits of its size, up to 1, at a rate that makes the expected words R. Documents
are ranked by (U / (1 - U)) / (p / (1 - p)), U a hash of the document's id, and taken in that order until R words are
reached; the document at the cut is taken if that brings the words nearer to R. The error of a source is thus at most
half of one document.

Running sums over the ranks are never made in one task: words are summed over 1024 bins of the rank, then over 1024
bins of the bin in which the cut falls; only the documents of one such small bin are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BINS = 1024


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most_copies: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) to these and weight and target. One row a source goes through the running sums."""
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    ranked = sources.withColumn("pos", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * most_copies).withColumn("ratio", F.col("cap") / F.col("weight"))
    filling = Window.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(filling), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_weight"))
    )
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "pos", "level"))).over(everything)
    ranked = ranked.withColumn("level", first["level"])
    # Beyond the last source every share is at its cap; that happens only if the budget is above all caps.
    target = F.when(F.col("level").isNull() | (F.col("cap") <= F.col("level") * F.col("weight")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _inclusion(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, size_class, words) to the inclusion probability of each class; at most 64 classes a source."""
    t = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    t = t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    joined = classes.join(t.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    larger = Window.partitionBy("source").orderBy(F.col("size_class").desc()).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("source").orderBy("size_class").rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("certain", F.coalesce(F.sum("words").over(larger), F.lit(0)))
    joined = joined.withColumn("moment", F.sum(F.col("words") * F.col("size_class")).over(smaller))
    joined = joined.withColumn("rate", F.when(F.col("moment") > 0, (F.col("rest") - F.col("certain")) / F.col("moment")).otherwise(F.lit(0.0)))
    fits = F.col("rate") * F.col("size_class") <= 1
    own = Window.partitionBy("source")
    joined = joined.withColumn("top", F.max(F.when(fits, F.col("size_class"))).over(own))
    joined = joined.withColumn("rate", F.max(F.when(F.col("size_class") == F.col("top"), F.col("rate"))).over(own))
    p = F.when(F.col("size_class") > F.col("top"), F.lit(1.0)).otherwise(F.col("rate") * F.col("size_class"))
    return joined.select("source", "size_class", "source_size", "target", "whole", "rest", p.alias("p"))


def _cut(bins: DataFrame, keys: list[str], b: str) -> DataFrame:
    """(keys, rest, b, words) to: the last bin wholly inside rest, the bin that rest falls in, and the rest inside it."""
    w = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("words").over(w))
    edge = (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest"))
    return bins.groupBy(*keys).agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col(b))).alias(f"full_{b}"),
        F.max(F.when(edge, F.col(b))).alias(f"edge_{b}"),
        F.max(F.when(edge, F.col("rest") - (F.col("upto") - F.col("words")))).alias(f"rest_{b}"),
    )


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most_copies: int = MOST_COPIES, seed: int = 5) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (= copies * size) for every row of docs.

    Needs doc_id, text, source; other columns are not touched. Null texts have size 0 and null sources are a source.
    Documents of size 0 take no words. Repeated rows are separate documents of one rank; rows without an id are ranked by
    their texts. An empty table gives no row.
    """
    sizes = checkpointed(
        docs.select("doc_id", "source", word_count("text").alias("size"), uniform(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))), seed).alias("u"))
        .withColumn("size_class", F.length(F.bin("size")))
    )
    classes = sizes.groupBy("source", "size_class").agg(F.sum("size").alias("words"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most_copies)
    p = checkpointed(_inclusion(classes, targets)).withColumnsRenamed({"source": "p_source", "size_class": "p_class"})
    rank = (
        F.when(F.col("p") >= 1, F.lit(0.0))
        .when(F.col("p") <= 0, F.lit(float("inf")))
        .otherwise((F.col("u") * (1 - F.col("p"))) / ((1 - F.col("u")) * F.col("p")))
    )
    ranked = sizes.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size_class") == F.col("p_class"))).withColumn("q", rank)
    place = F.when(F.col("q") == float("inf"), F.lit(1.0)).otherwise(F.col("q") / (1 + F.col("q")))
    cell = F.least(F.floor(place * BINS * BINS), F.lit(BINS * BINS - 1))
    ranked = ranked.withColumn("cell", cell).withColumn("b1", F.floor(F.col("cell") / BINS)).withColumn("b2", F.col("cell") % BINS)

    bins = ranked.groupBy("source", "rest", "b1").agg(F.sum("size").alias("words"))
    cut1 = _cut(bins, ["source"], "b1").withColumnRenamed("source", "c_source")
    ranked = ranked.join(cut1, F.col("source").eqNullSafe(F.col("c_source"))).drop("c_source")
    ranked = checkpointed(ranked.select("doc_id", "source", "size", "source_size", "target", "whole", "q", "b1", "b2", "full_b1", "edge_b1", "rest_b1"))
    at_edge = F.coalesce(F.col("b1") == F.col("edge_b1"), F.lit(False))

    edge = ranked.filter(at_edge)
    bins = edge.withColumn("rest", F.col("rest_b1")).groupBy("source", "rest", "b2").agg(F.sum("size").alias("words"))
    cut2 = _cut(bins, ["source"], "b2").withColumnRenamed("source", "c_source")
    edge = edge.join(cut2, F.col("source").eqNullSafe(F.col("c_source"))).drop("c_source")
    at_inner = F.coalesce(F.col("b2") == F.col("edge_b2"), F.lit(False))
    order = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = edge.filter(at_inner).withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))

    def out(df: DataFrame, more: Column) -> DataFrame:
        copies = (F.col("whole") + more.cast("int")).cast("long")
        return df.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))

    return (
        out(ranked.filter(~at_edge), F.coalesce(F.col("b1") <= F.col("full_b1"), F.lit(False)))
        .unionByName(out(edge.filter(~at_inner), F.coalesce(F.col("b2") <= F.col("full_b2"), F.lit(False))))
        .unionByName(out(inner, 2 * F.col("before") + F.col("size") <= 2 * F.col("rest_b2")))
    )


def repeat_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, all columns, each as often as mixed (doc_id, copies) says; rows of one id as the most taken of them.

    Rows without an id are as one id; their number of copies is one row, which is broadcast, so they are no hot key. Tables
    without rows give none.
    """
    copies = mixed.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("copies").cast("int").alias("times")).filter("times > 0")
    rows, own = docs.select(F.struct("*").alias("r")), F.col("r.doc_id").cast("long")
    known = rows.filter(own.isNotNull()).join(copies, own == F.col("id"))
    unknown = rows.filter(own.isNull()).join(F.broadcast(copies.filter("id is null")), own.eqNullSafe(F.col("id")))
    return known.unionAll(unknown).select("r", F.explode(F.sequence(F.lit(1), F.col("times")))).select("r.*")


MIX_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    (('0x' || substr(md5('5:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as weight,
    row_number() over (order by source asc nulls last) as pos, sum(source_size) over () * 1.5::double as budget from s),
r as (select *, source_size * 2 as cap, (source_size * 2)::double / weight as ratio from w),
f as (select *, ((budget - coalesce(sum(cap) over before, 0)::double) / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double) as lv
  from r window before as (order by ratio, pos rows between unbounded preceding and 1 preceding)),
l as (select *, first_value(case when ratio >= lv then lv end ignore nulls) over (order by ratio, pos rows between unbounded preceding and unbounded following) as level from f),
t as (select source, source_size, case when level is null or cap <= level * weight then cap::double else level * weight end as target from l),
h as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
x as (select *, target - whole * source_size as rest from h),
c as (select source, length(bin(size)) as k, sum(size)::bigint as words from d group by all),
j as (select c.source, c.k, x.source_size, x.target, x.whole, x.rest,
    coalesce(sum(words) over (partition by c.source order by k desc rows between unbounded preceding and 1 preceding), 0)::double as certain,
    sum(words * k) over (partition by c.source order by k rows between unbounded preceding and current row)::double as moment
  from c join x on c.source is not distinct from x.source),
e as (select *, case when moment > 0 then (rest - certain) / moment else 0.0 end as rate from j),
g as (select *, max(case when rate * k <= 1 then k end) over (partition by source) as top from e),
p as (select *, case when k > top then 1.0 else max(case when k = top then rate end) over (partition by source) * k end as p from g),
q as (select d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.rest,
    case when p.p >= 1 then 0.0 when p.p <= 0 then 'infinity'::double else (d.u * (1 - p.p)) / ((1 - d.u) * p.p) end as q
  from d join p on d.source is not distinct from p.source and length(bin(d.size)) = p.k),
b as (select *, coalesce(sum(size) over (partition by source order by q, doc_id, size rows between unbounded preceding and 1 preceding), 0)::double as before from q)
"""

OP5_SQL = (
    MIX_SQL
    + "select doc_id, size, source_size, target, ((whole + case when size > 0 and 2 * before + size <= 2 * rest then 1 else 0 end) * size)::bigint as taken from b"
)
