"""Which way of preparing frames a match is read with, from trials that are on record: a warm-up, then one for good.

Until a match is locked, a frame is read the default way and, where that shows neither a layout nor a score, the other ways in
turn, up to the first that shows a layout of its own (not the generic one). The first frame with such a layout locks the match to what
that layout reads best with; if MISSES frames have gone by without one, it is locked to the default. Frames without trials
(no scoreboard was cut out) count as nothing.

It takes two passes over a match, as windows: what each frame shows while unlocked, and where the lock falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import GENERIC, PARSERS, Parser

#: Frames without a layout of its own after which the default is kept. Fixed value.
MISSES = 5


def lock(trials: DataFrame, strategies: tuple[str, ...] = ("global", "local"), parsers: tuple[Parser, ...] = PARSERS) -> DataFrame:
    """match_id, frame_index, locked (before this frame), strategy and layout of every frame, from trials (match_id, frame_index, strategy,
    layout, runs, wickets); the first of strategies is the default. Of trials of one frame and strategy, one counts, the least.
    """
    default, *others = strategies
    shown = F.struct("layout", "runs", "wickets")
    tried = [F.min(F.when(F.col("strategy") == s, shown)).alias(f"__{i}") for i, s in enumerate(strategies)]
    rows = trials.groupBy("match_id", "frame_index").agg(*tried)

    def own(column: str):
        return F.coalesce(F.col(f"{column}.layout") != GENERIC.name, F.lit(False))

    first = F.col("__0")
    bare = first["layout"].isNull() | ((first["layout"] == GENERIC.name) & first["runs"].isNull() & first["wickets"].isNull())
    used = F.lit(0)
    for i in reversed(range(1, len(strategies))):
        used = F.when(own(f"__{i}"), i).otherwise(used)
    used = F.when(bare, used).otherwise(0)
    rows = rows.withColumn("__used", used)
    layout = F.coalesce(*(F.when(F.col("__used") == i, F.col(f"__{i}.layout")) for i in range(len(strategies))))
    rows = rows.withColumn("__layout", layout).withColumn("__own", F.coalesce(F.col("__layout") != GENERIC.name, F.lit(False)))

    match = Window.partitionBy("match_id")
    missed = F.count_if(~F.col("__own")).over(match.orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__missed", missed)
    found = F.min(F.when(F.col("__own"), F.struct("frame_index", F.col("__layout").alias("layout")))).over(match)
    given_up = F.min(F.when(F.col("__missed") >= MISSES, F.col("frame_index"))).over(match)
    rows = rows.withColumns({"__found": found, "__given_up": given_up})
    at = F.least(F.col("__found.frame_index"), "__given_up")
    best = F.create_map(*(F.lit(x) for p in parsers for x in (p.name, p.strategy if p.strategy in strategies else default)))
    final = F.when(at == F.col("__found.frame_index"), F.coalesce(best[F.col("__found.layout")], F.lit(default))).otherwise(F.lit(default))
    rows = rows.withColumn("locked", F.coalesce(F.col("frame_index") > at, F.lit(False)))
    names = F.array(*map(F.lit, strategies))
    rows = rows.withColumn("strategy", F.when(F.col("locked"), final).otherwise(F.get(names, F.col("__used"))))
    read = F.coalesce(*(F.when(F.col("strategy") == s, F.col(f"__{i}.layout")) for i, s in enumerate(strategies)))
    return rows.select("match_id", "frame_index", "locked", "strategy", read.alias("layout"))
