"""The job queue as set operations over a state table; streaming wraps them in micro-batches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import backoff_seconds

STALE = dt.timedelta(minutes=15)


def ready(jobs: DataFrame, now: dt.datetime) -> DataFrame:
    return jobs.where((F.col("status") == "queued") & (F.col("run_after") <= F.lit(now)))


def claim(jobs: DataFrame, now: dt.datetime, n: int = 1) -> DataFrame:
    """The n oldest ready jobs as they look once running; a top-k, not a sort of the queue."""
    head = ready(jobs, now).orderBy("run_after", "id").limit(n)
    return head.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "locked_at": F.lit(now)})


def reclaim_stale(jobs: DataFrame, now: dt.datetime) -> DataFrame:
    """Running jobs whose lock is older than the limit are queued again; attempts stay counted."""
    stale = (F.col("status") == "running") & (F.col("locked_at") < F.lit(now - STALE))
    stale = F.coalesce(stale, F.lit(False))
    return jobs.withColumns({"status": F.when(stale, "queued").otherwise(F.col("status")), "locked_at": F.when(~stale, F.col("locked_at"))})


def after_failure(jobs: DataFrame, now: dt.datetime) -> DataFrame:
    """Failed running jobs: again after 4^attempts seconds while attempts remain, else failed for good."""
    again = F.col("attempts") < F.col("max_attempts")
    at = F.lit(now) + F.make_dt_interval(secs=backoff_seconds(F.col("attempts")).cast("decimal(18,6)"))
    return jobs.withColumns({"status": F.when(again, "queued").otherwise("failed"), "run_after": F.when(again, at).otherwise(F.col("run_after")), "locked_at": F.lit(None).cast("timestamp")})


def final_status(jobs: DataFrame) -> DataFrame:
    """What a document becomes when its job fails for good, by stage: unreadable bytes fail, a failed extraction is for a person to see."""
    return jobs.withColumn("document_status", F.when(F.col("kind") == "ocr", "ocr_failed").otherwise("needs_review"))


def settle(jobs: DataFrame, now: dt.datetime) -> DataFrame:
    """Failed running jobs with ``permanent`` (a refusal or unreadable bytes: no retry helps) settled.

    Adds failure: refused, exhausted, or null where the job is queued again; then the
    document keeps its status (document_status is null).
    """
    failure = F.when(F.col("permanent"), "refused").when(F.col("attempts") >= F.col("max_attempts"), "exhausted")
    done = after_failure(jobs.withColumns({"failure": failure, "max_attempts": F.when(F.col("permanent"), 0).otherwise(F.col("max_attempts"))}), now)
    return final_status(done).withColumn("document_status", F.when(F.col("failure").isNotNull(), F.col("document_status")))


def defer_over_cap(jobs: DataFrame, spent: DataFrame, cap, now: dt.datetime) -> DataFrame:
    """When the day's spend reached the cap, running extract jobs wait for tomorrow and get their attempt back.

    ``spent`` is the one-row frame (spent_usd).
    """
    tomorrow = dt.datetime.combine(now.date() + dt.timedelta(days=1), dt.time())
    over = F.broadcast(spent.select((F.col("spent_usd") >= F.lit(cap)).alias("__over")))  # one row
    hit = F.col("__over") & (F.col("kind") == "extract") & (F.col("status") == "running")
    out = jobs.crossJoin(over)
    return out.withColumns({
        "attempts": F.when(hit, F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts")),
        "run_after": F.when(hit, F.lit(tomorrow)).otherwise(F.col("run_after")),
        "status": F.when(hit, "queued").otherwise(F.col("status")),
    }).drop("__over")
