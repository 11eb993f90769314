"""The cost report: what model calls cost, wasted and took."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import usd


def _cost() -> Column:
    return F.coalesce("cost_usd", F.lit(0).cast("decimal(12,6)"))


def window(extractions: DataFrame, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
    """Whole UTC days, both ends included; half-open bounds reach the scan."""
    if since is not None:
        extractions = extractions.where(F.col("created_at") >= F.lit(dt.datetime.combine(since, dt.time())))
    if until is not None:
        extractions = extractions.where(F.col("created_at") < F.lit(dt.datetime.combine(until + dt.timedelta(days=1), dt.time())))
    return extractions


def report(extractions: DataFrame, since=None, until=None) -> DataFrame:
    """One row of totals. Trials are counted beside the rest, never in it.

    One aggregate by document keeps distinct and retried documents out of a second pass.
    """
    rows = window(extractions, since, until)
    real = ~F.col("is_trial")
    failed = real & F.col("raw_json").isNull()
    zero = F.lit(0).cast("decimal(22,6)")
    unpriced = real & (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)) > 0) & (_cost() == 0)
    by_doc = rows.groupBy("document_id").agg(
        F.count_if(real).alias("calls"),
        F.count_if(failed).alias("failed"),
        F.coalesce(F.sum(F.when(real, _cost())), zero).alias("total"),
        F.coalesce(F.sum(F.when(failed, _cost())), zero).alias("wasted"),
        F.count_if(F.col("is_trial")).alias("trials"),
        F.coalesce(F.sum(F.when(F.col("is_trial"), _cost())), zero).alias("trial_usd"),
        F.count_if(unpriced).alias("unpriced"),
        F.sum(F.when(real, F.col("input_tokens"))).alias("input_tokens"),
        F.sum(F.when(real, F.col("output_tokens"))).alias("output_tokens"),
    )
    all_ = by_doc.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "failed")],
        F.count_if(F.col("calls") > 0).alias("documents"),
        F.count_if(F.col("calls") > 1).alias("retried_documents"),
        *[F.coalesce(F.sum(c), zero).cast("decimal(24,6)").alias(f"{c}_usd") for c in ("total", "wasted")],
        F.coalesce(F.sum("trials"), F.lit(0)).alias("trial_calls"),
        F.coalesce(F.sum("trial_usd"), zero).cast("decimal(24,6)").alias("trial_usd"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("unpriced", "input_tokens", "output_tokens")],
    )
    return all_.withColumns({
        "per_document_usd": F.when(F.col("documents") > 0, usd(F.col("total_usd") / F.col("documents"))).otherwise(F.lit(0).cast("decimal(18,6)")),
        "per_call_usd": F.when(F.col("calls") > 0, usd(F.col("total_usd") / F.col("calls"))).otherwise(F.lit(0).cast("decimal(18,6)")),
    })


def latency(extractions: DataFrame, since=None, until=None) -> DataFrame:
    """Nearest-rank percentiles over stated latencies of real calls."""
    rows = window(extractions, since, until).where("not is_trial and latency_ms is not null")
    at = lambda p: F.expr(f"cast(percentile_disc({p}) within group (order by latency_ms) as bigint)")
    return rows.agg(at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))


def slices(extractions: DataFrame, organisations: DataFrame, since=None, until=None) -> DataFrame:
    """By model, type and organisation in one pass of grouping sets, dearest first within each.

    The organisation dimension joins after aggregation, when it meets one row a group.
    """
    rows = window(extractions, since, until).where("not is_trial").withColumn("cost", _cost())
    sets = rows.groupingSets([["model_used"], ["doc_type"], ["organisation_id"]], "model_used", "doc_type", "organisation_id")
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("calls"), F.sum("cost").cast("decimal(24,6)").alias("total_usd"))
    names = organisations.select(F.col("id").alias("organisation_id"), "name")
    kind = F.when(F.col("g") == 3, "model").when(F.col("g") == 5, "doc_type").otherwise("organisation")
    out = out.join(names, "organisation_id", "left")
    return out.select(kind.alias("slice"), F.coalesce("model_used", "doc_type", "name", "organisation_id").alias("key"), "calls", "total_usd").orderBy("slice", F.desc("total_usd"), "key")


def daily_spend(extractions: DataFrame, day: dt.date) -> DataFrame:
    """All organisations, trials included, of one UTC day."""
    return window(extractions, day, day).agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(24,6)").alias("spent_usd"))


def spend_per_day(extractions: DataFrame, cap) -> DataFrame:
    """Every UTC day's spend and whether it reached the cap."""
    out = extractions.groupBy(F.to_date("created_at").alias("day")).agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(24,6)").alias("spent_usd"))
    return out.withColumn("over_cap", F.col("spent_usd") >= F.lit(cap))


def counts_by_type(extractions: DataFrame) -> DataFrame:
    return extractions.where("not is_trial").groupBy("doc_type").agg(F.count("*").alias("extractions"))


def document_costs(extractions: DataFrame) -> DataFrame:
    """Billed and trial cost of each document."""
    part = lambda c: F.coalesce(F.sum(F.when(c, _cost())), F.lit(0)).cast("decimal(24,6)")
    return extractions.groupBy("document_id").agg(part(~F.col("is_trial")).alias("billed_usd"), part(F.col("is_trial")).alias("trial_usd"))


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """cost_usd of ``calls(model, input_tokens, output_tokens, cache_read_tokens)`` from a price list per million tokens.

    A model that is listed by its exact name costs that; otherwise a release date at the
    end is not part of the name. Unknown models cost 0. The amount is exact: six places
    are for storage and display. ``prices(name, input, output, cached)`` is a dimension.
    """
    dated = calls.join(prices.select(F.col("name").alias("model"), F.lit(True).alias("listed")), "model", "left")
    named = dated.withColumn("name", F.when(F.col("listed"), F.col("model")).otherwise(F.regexp_replace("model", r"-\d{8}$", ""))).drop("listed")
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,6)")
    total = sum((F.coalesce(F.col(t), F.lit(0)).cast("decimal(12,0)") * d(p) for t, p in (("output_tokens", "output"), ("cache_read_tokens", "cached"))), F.coalesce("input_tokens", F.lit(0)).cast("decimal(12,0)") * d("input"))
    return named.join(prices, "name", "left").withColumn("cost_usd", (total.cast("decimal(30,6)") * F.lit(Decimal("0.000001"))).cast("decimal(30,12)")).drop("name", "input", "output", "cached")
