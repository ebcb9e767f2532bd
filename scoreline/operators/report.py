"""Accuracy reports and summaries, in long format: one row a figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alignment import SCORING


def long_format(row: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, value (double) of the other columns of each row."""
    names = [c for c in row.columns if c not in keys]
    return row.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))).alias("m")).select(*keys, "m.metric", "m.value")


def false_positives(reconciled: DataFrame) -> DataFrame:
    """match_id, innings, event_type and event_key of detected scoring events that no event of the commentary was matched with."""
    return reconciled.filter("side = 'detected' and outcome = 'FALSE_POSITIVE'").select("match_id", "innings", "event_type", "event_key")


def _summary(reconciled: DataFrame) -> DataFrame:
    """One row a match that has a commentary: its figures, and its missed events, from one aggregation of both sides."""
    theirs = F.col("side") == "commentary"

    def outcome(name: str):
        return F.count_if(theirs & (F.col("outcome") == name))

    def recall(kind: str):
        of_kind = theirs & (F.col("event_type") == kind)
        return F.try_divide(F.count_if(of_kind & (F.col("outcome") == "TRUE_POSITIVE")).cast("double"), F.count_if(of_kind).cast("double"))

    missed = theirs & (F.col("outcome") != "TRUE_POSITIVE")
    entry = F.struct((F.col("outcome") == "RECOVERABLE_MISS").alias("has_signal"), "innings", "over_number", "ball_in_over", "truth_id", "event_type")
    rows = reconciled.groupBy("match_id").agg(
        F.count_if(theirs).alias("total"),
        outcome("TRUE_POSITIVE").alias("true_positives"),
        outcome("UNRECOVERABLE_MISS").alias("missed_no_signal"),
        outcome("RECOVERABLE_MISS").alias("missed_with_signal"),
        *(recall(k).alias(f"recall_{k.lower()}") for k in SCORING),
        F.count_if(~theirs).alias("n_detected"),
        F.count_if(~theirs & (F.col("outcome") == "FALSE_POSITIVE")).alias("false_positives"),
        F.array_sort(F.collect_list(F.when(missed, entry))).alias("missed"),
    )
    rows = rows.filter("total > 0").withColumn("precision", F.coalesce(F.try_divide(F.col("true_positives").cast("double"), F.col("n_detected").cast("double")), F.lit(0.0)))
    return rows.withColumn("success_rate", F.coalesce(F.try_divide((F.col("true_positives") + F.col("missed_with_signal")).cast("double"), F.col("total").cast("double")), F.lit(0.0)))


def accuracy(reconciled: DataFrame) -> DataFrame:
    """Per match: outcomes, precision, success rate and recall by type (types without events are left out)."""
    return long_format(_summary(reconciled).drop("missed"), ["match_id"]).filter("value is not null")


def as_document(reconciled: DataFrame, digits: int = 6) -> DataFrame:
    """match_id and report, one JSON document a match: its figures by name, and the missed events in their order."""
    rows = _summary(reconciled)
    names = sorted(c for c in rows.columns if c not in ("match_id", "missed"))
    figures = F.map_filter(F.create_map(*(x for c in names for x in (F.lit(c), F.round(F.col(c).cast("double"), digits)))), lambda _, v: v.isNotNull())
    listed = F.transform("missed", lambda m, i: F.struct((i + 1).alias("place"), m["truth_id"].alias("truth_id"), m["event_type"].alias("event_type"), m["has_signal"].alias("has_signal")))
    return rows.select("match_id", F.to_json(F.struct("match_id", figures.alias("figures"), listed.alias("missed_events"))).alias("report"))


def misses(aligned: DataFrame) -> DataFrame:
    """Events of the commentary that were not detected, with their place in the report: those without a signal first."""
    rows = aligned.filter(F.col("outcome") != "TRUE_POSITIVE").withColumn("has_signal", F.col("outcome") == "RECOVERABLE_MISS")
    order = Window.partitionBy("match_id").orderBy("has_signal", "innings", "over_number", "ball_in_over", "truth_id")
    return rows.select("match_id", "truth_id", "event_type", "has_signal", F.row_number().over(order).alias("place"))


def tiers(anchors: DataFrame) -> DataFrame:
    """Counts of anchors by tier, and of candidates out of order: seen, and kept from being taken first."""
    kinds = [F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("HIGH", "MEDIUM", "LOW", "UNRESOLVED")]
    return anchors.groupBy("match_id").agg(*kinds, F.sum("n_violations").alias("violations"), F.sum("n_prevented").alias("prevented"))


def match_summary(readings: DataFrame, events: DataFrame, replays: DataFrame) -> DataFrame:
    """Per match: rows of each table, and events and mean confidence of each type; what has no rows is left out."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("match_id").agg(F.count("*").cast("double").alias("value")).select("match_id", F.lit(name).alias("metric"), "value")

    by_type = events.groupBy("match_id", "event_type").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"))
    of_match = by_type.groupBy("match_id").agg(F.sum("n").alias("n"), F.collect_list(F.struct("event_type", "n", "mean")).alias("types"))

    def figure(name: str | Column, value: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("metric"), value.cast("double").alias("value"))

    def of_type(t: Column) -> Column:
        return F.array(figure(F.concat(F.lit("events_"), t["event_type"]), t["n"]), figure(F.concat(F.lit("confidence_"), t["event_type"]), t["mean"]))

    figures = F.concat(F.array(figure("events", F.col("n"))), F.flatten(F.transform("types", of_type)))
    of_events = of_match.select("match_id", F.explode(figures).alias("f")).select("match_id", "f.metric", "f.value")
    return counted(readings, "readings").unionByName(counted(replays, "replays")).unionByName(of_events)


def summary_text(figures: DataFrame) -> DataFrame:
    """match_id and summary, a line of text for each figure (match_id, metric, value), in order of their names."""
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.format_string("%.3f", "value"))
    line = F.concat(F.translate("metric", "_", " "), F.lit(": "), number)
    lines = F.array_sort(F.collect_list(F.struct("metric", line.alias("line"))))
    return figures.groupBy("match_id").agg(lines.alias("lines")).select("match_id", F.concat_ws("\n", F.concat(F.lit("match: "), F.col("match_id").cast("string")), F.array_join(F.col("lines.line"), "\n")).alias("summary"))
