"""Scene cuts from frame-difference scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 8.0
RATIO = 3.0
KEEP_APART = 3
ELEVATED = 0.25


def adaptive_cuts(scores: DataFrame, floor: float = FLOOR, ratio: float = RATIO, reach: int = 2) -> DataFrame:
    """Frames whose score is at least floor and ratio times the mean of the ``reach`` frames on each side."""
    order = Window.partitionBy("match_id").orderBy("frame_index").rowsBetween(-reach, reach)
    near = (F.sum("score").over(order) - F.col("score")) / (2 * reach)
    whole = F.count("*").over(order) == 2 * reach + 1
    rows = scores.withColumn("__near", near).withColumn("__whole", whole)
    return rows.filter(F.col("__whole") & (F.col("score") >= floor) & (F.col("score") >= ratio * F.col("__near"))).drop("__near", "__whole")


def post_cut(scores: DataFrame, cuts: DataFrame, reach: int = 3) -> DataFrame:
    """cuts with boundary_type and confidence by the share of the next ``reach`` scores that stay elevated."""
    order = Window.partitionBy("match_id").orderBy("frame_index").rowsBetween(1, reach)
    after = scores.select("match_id", "frame_index", F.count("score").over(order).alias("n_after"), F.collect_list("score").over(order).alias("after"))
    rows = cuts.join(after, ["match_id", "frame_index"])
    elevated = F.size(F.filter("after", lambda x: x >= F.col("score") * ELEVATED))
    share = F.try_divide(elevated.cast("double"), F.col("n_after").cast("double"))
    known = (F.col("n_after") > 0) & (F.col("score") > 0)
    replay = known & (elevated >= 2)
    kind = F.when(replay, "REPLAY_TRANSITION").otherwise("ORDINARY_CUT")
    confidence = F.when(~known, 0.5).when(replay, F.least(F.lit(1.0), 0.5 + 0.5 * share)).otherwise(0.5 + 0.5 * (1 - share))
    return rows.withColumns({"boundary_type": kind, "confidence": confidence}).drop("after", "n_after")


def classify(score: float, later: list[float]) -> tuple[str, float]:
    """boundary_type and confidence of one cut by the scores after it, as post_cut has them."""
    hot = sum(x >= score * ELEVATED for x in later)
    if not later or not score > 0:
        return "ORDINARY_CUT", 0.5
    if hot >= 2:
        return "REPLAY_TRANSITION", min(1.0, 0.5 + 0.5 * (hot / len(later)))
    return "ORDINARY_CUT", 0.5 + 0.5 * (1 - hot / len(later))


def suppress_close(cuts: DataFrame, apart: int = KEEP_APART) -> DataFrame:
    """cuts more than ``apart`` frames after the last kept one; what is kept depends on what was, hence a fold of a match's cuts."""
    own = F.array_sort(F.collect_list(F.struct(F.col("frame_index").alias("__at"), F.struct("*").alias("__cut"))))
    none = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("keep"))

    def step(held: Column, x: Column) -> Column:
        far = held["last"].isNull() | (x["__at"] > held["last"] + apart)
        at = x["__at"].cast("long")
        return F.when(far, F.struct(at.alias("last"), F.concat(held["keep"], F.array(at)).alias("keep"))).otherwise(held)

    rows = cuts.groupBy("match_id").agg(own.alias("__own")).withColumn("__kept", F.aggregate("__own", none, step)["keep"])
    rows = rows.select(F.explode(F.filter("__own", lambda x: F.array_contains("__kept", x["__at"].cast("long")))).alias("x"))
    return rows.select("x.__cut.*")


def number_boundaries(cuts: DataFrame) -> DataFrame:
    order = Window.partitionBy("match_id").orderBy("timestamp_seconds", "frame_index")
    return cuts.withColumn("boundary_id", F.row_number().over(order) - 1)
