"""Column expressions; every one stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BALLS_PER_OVER = 6


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded(x: Column, digits: int) -> Column:
    """A double as SQL rounds it: its product with 10^digits to the nearest whole number, halves away from zero, divided again.

    F.round takes the shortest decimal of x instead, which is another number once x has few digits left behind the point.
    """
    scaled = x * F.lit(10.0**digits)
    near = F.rint(scaled)
    whole = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near)
    return F.when(F.isnan(scaled) | (F.abs(scaled) == float("inf")), x).otherwise(whole / F.lit(10.0**digits))


def classify_delivery(description: Column) -> Column:
    """SIX, FOUR or WICKET by the first that the description holds, in this order and case; else null."""
    return F.when(description.contains("SIX"), "SIX").when(description.contains("FOUR"), "FOUR").when(description.rlike(r"\bOUT\b"), "WICKET")


def over_of(ball: Column) -> Column:
    """The over of "19.5"; an error unless there are exactly two whole numbers, as ``over.ball`` is no decimal."""
    return _part(ball, 0)


def ball_of(ball: Column) -> Column:
    return _part(ball, 1)


def _part(ball: Column, i: int) -> Column:
    parts = F.split(ball, r"\.", -1)
    return F.when(F.size(parts) == 2, parts[i].cast("int")).otherwise(F.raise_error(F.concat(F.lit("not over.ball: "), ball)).cast("int"))


# The shape of a name, and the phrases of a dismissal in the order they are tried.
NAME = r"[A-Za-z][A-Za-z .'\-]*?"
DISMISSALS = {
    "CAUGHT": rf"\bc\s+({NAME})\s+b\s+{NAME}",
    "STUMPED": rf"\bst\s+({NAME})\s+b\s+{NAME}",
    "RUN_OUT": rf"(?i)run\s*out\s*\(({NAME})\)",
    "LBW": r"(?i)\blbw\b",
    "HIT_WICKET": r"(?i)hit\s+wicket",
    "BOWLED": rf"\bb\s+{NAME}",
}


def dismissal_type(text: Column) -> Column:
    """The first kind of dismissal whose phrase the text holds; null if none."""
    return F.coalesce(*(F.when(text.rlike(pattern), kind) for kind, pattern in DISMISSALS.items()))


def fielder(text: Column) -> Column:
    """The catcher, stumper or thrower of a dismissal of that kind; else null."""
    kind = dismissal_type(text)
    named = F.coalesce(*(F.when(kind == k, F.regexp_extract(text, DISMISSALS[k], 1)) for k in ("CAUGHT", "STUMPED", "RUN_OUT")))
    return F.nullif(F.trim(named), F.lit(""))


def balls_advanced(over: Column, ball: Column, over_before: Column, ball_before: Column) -> Column:
    """Balls between two positions; null if the over fell or the total is negative."""
    total = (over - over_before) * BALLS_PER_OVER + (ball - ball_before)
    return F.when((over >= over_before) & (total >= 0), total)


def anomalous(runs_delta: Column, wickets_delta: Column, balls: Column) -> Column:
    """More than 11 runs or 1 wicket a ball, or 11 and 3 where no ball was counted."""
    several = F.coalesce(balls > 0, F.lit(False))
    most_runs = F.when(several, balls * 11).otherwise(11)
    most_wickets = F.when(several, balls).otherwise(3)
    return (wickets_delta > most_wickets) | (runs_delta > most_runs)


def single_ball(over: Column, ball: Column, over_before: Column, ball_before: Column) -> Column:
    return ((over == over_before) & (ball == ball_before + 1)) | ((over == over_before + 1) & (ball_before == 5) & (ball == 0))


def event_of(runs_delta: Column, wickets_delta: Column, single: Column) -> Column:
    return F.when(wickets_delta == 1, "WICKET").when(single & (wickets_delta == 0) & (runs_delta == 4), "FOUR").when(single & (wickets_delta == 0) & (runs_delta == 6), "SIX")


def milestones(before: Column, after: Column, interval: int = 50) -> Column:
    """Array of the multiples of interval in (before, after]; empty if there is none."""
    low, high = F.floor(before / interval), F.floor(after / interval)
    return F.when(high > low, F.transform(F.sequence(low + 1, high), lambda i: (i * interval).cast("int"))).otherwise(F.array().cast("array<int>"))


def event_key(innings: Column, over: Column, ball: Column, kind: Column, milestone: Column) -> Column:
    """innings:over.ball:TYPE, and :milestone where there is one."""
    return F.concat_ws(":", innings.cast("string"), F.concat_ws(".", over.cast("string"), ball.cast("string")), kind, milestone.cast("string"))


def frame_rate(fraction: Column) -> Column:
    """ "30000/1001" to a number; null if it is malformed or divides by zero."""
    parts = F.split(fraction, "/")
    return F.when(F.size(parts) == 2, F.try_divide(parts[0].try_cast("double"), parts[1].try_cast("double")))


def concat_line(path: Column) -> Column:
    """A line of a concatenation list, with quotes escaped."""
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


# The least confidence of each level of reading quality.
OCR_LEVELS = (("HIGH", 0.60), ("MEDIUM", 0.35), ("LOW", 0.15))


def ocr_quality(confidence: Column) -> Column:
    """HIGH, MEDIUM, LOW or INSUFFICIENT; UNKNOWN for null."""
    level = F.coalesce(*(F.when(confidence >= least, name) for name, least in OCR_LEVELS), F.lit("INSUFFICIENT"))
    return F.when(confidence.isNull(), "UNKNOWN").otherwise(level)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
