"""Scoring extractions against labels, leaf by leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import collapse_path, normalise_answer

OUTCOMES = ("correct", "absent_ok", "missed", "hallucinated", "wrong")


def leaf_outcome(expected: Column, actual: Column, text: bool = True) -> Column:
    """correct, absent_ok, missed, hallucinated or wrong; texts compare without case and spacing."""
    same = normalise_answer(expected) == normalise_answer(actual) if text else expected == actual
    return (
        F.when(expected.isNull() & actual.isNull(), "absent_ok")
        .when(actual.isNull(), "missed")
        .when(expected.isNull(), "hallucinated")
        .when(same, "correct")
        .otherwise("wrong")
    )


def passing(outcome: Column) -> Column:
    return outcome.isin("correct", "absent_ok")


def score_leaves(leaves: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    return leaves.withColumn("outcome", leaf_outcome(F.col(expected), F.col(actual)))


def zip_entries(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Entries ``(name, index, value)`` of both sides by position: an entry that one side lacks is null there."""
    e, a = expected.withColumnRenamed("value", "expected"), actual.withColumnRenamed("value", "actual")
    return e.join(a, ["name", "index"], "full_outer")


def tally(scored: DataFrame) -> DataFrame:
    """Counts of each outcome by collapsed path."""
    paths = scored.select(collapse_path(F.col("path")).alias("path"), "outcome")
    return paths.groupBy("path").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def accuracy_by_path(scored: DataFrame) -> DataFrame:
    return scored.groupBy(collapse_path(F.col("path")).alias("path")).agg(F.avg(passing(F.col("outcome")).cast("double")).alias("accuracy")).orderBy("accuracy", "path")


def overall_accuracy(scored: DataFrame) -> DataFrame:
    """Share of passing leaves; 1 when there is none."""
    return scored.agg(F.coalesce(F.avg(passing(F.col("outcome")).cast("double")), F.lit(1.0)).alias("accuracy"))


def routing_accuracy(routed: DataFrame) -> DataFrame:
    """``routed(expected_type, actual_type)``; an unrouted document is a miss."""
    hit = F.col("expected_type").eqNullSafe(F.col("actual_type"))
    return routed.agg(F.coalesce(F.avg(hit.cast("double")), F.lit(1.0)).alias("routing_accuracy"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Leaves whose outcome differs between two runs; ``report_order`` is for the page that shows some of them."""
    b, a = before.select("name", "path", F.col("outcome").alias("before")), after.select("name", "path", F.col("outcome").alias("after"))
    joined = b.join(a, ["name", "path"]).where("before <> after")
    out = joined.withColumns({"regression": passing(F.col("before")) & ~passing(F.col("after")), "improvement": ~passing(F.col("before")) & passing(F.col("after"))})
    return out


def report_order(changed: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` changes, regressions first: a top-k, no sort of them all."""
    return changed.orderBy(F.desc("regression"), "name", "path").limit(limit)


def accuracy_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each path's accuracy; a path one run lacks counts 0 there."""
    b = accuracy_by_path(before).withColumnRenamed("accuracy", "before")
    a = accuracy_by_path(after).withColumnRenamed("accuracy", "after")
    out = b.join(a, "path", "full_outer").select("path", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    return out.withColumn("delta", F.col("after") - F.col("before")).orderBy("delta", "path")


def run_costs(predictions: DataFrame) -> DataFrame:
    """Total and per-document cost and mean latency (whole milliseconds) of each run."""
    out = predictions.groupBy("run").agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(24,6)").alias("total_usd"), F.count("*").alias("documents"), F.floor(F.sum("latency_ms") / F.count("latency_ms")).alias("mean_latency_ms"))
    return out.withColumn("per_document_usd", F.bround(F.col("total_usd") / F.col("documents"), 6).cast("decimal(18,6)"))


def cost_ratio(first: Column, second: Column) -> Column:
    return F.try_divide(second, first)


def compared_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("name", "path").intersect(after.select("name", "path"))


def unlabelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return documents.join(labels, "name", "left_anti")
