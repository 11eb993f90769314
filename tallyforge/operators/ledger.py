"""Questions over the ledger. Amounts are decimals throughout and never cross currencies."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp_limit, month_key

TOTAL = "decimal(24,4)"
UNSTATED = "unstated"


def live(ledger: DataFrame, direction: str | None = "out") -> DataFrame:
    rows = ledger.where("is_current")
    return rows if direction is None else rows.where(F.col("direction") == direction)


def window(rows: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Inclusive bounds on the day; with any bound undated rows drop out."""
    if start is not None:
        rows = rows.where(F.col("occurred_on") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("occurred_on") <= F.lit(end))
    return rows


def by_counterparty(rows: DataFrame, part: str | None) -> DataFrame:
    """Case-blind substring; the caller's % and _ keep their meaning."""
    return rows.where(F.col("counterparty").ilike(f"%{part}%")) if part else rows


def total_spend(ledger: DataFrame, start=None, end=None, counterparty=None, category=None, direction="out") -> DataFrame:
    """Per currency: total and count of amounts, total and count of stated taxes; one partial and one final aggregate."""
    rows = by_counterparty(window(live(ledger, direction), start, end), counterparty)
    if category:
        rows = rows.where(F.col("category") == category)
    return rows.groupBy("currency").agg(
        F.sum("amount").cast(TOTAL).alias("total"),
        F.count("amount").alias("transactions"),
        F.sum("tax_amount").cast(TOTAL).alias("tax"),
        F.count("tax_amount").alias("taxed"),
    ).withColumn("currency", F.coalesce("currency", F.lit(UNSTATED)))


def spend_sources(ledger: DataFrame, **filters) -> DataFrame:
    """The document ids behind ``total_spend``: rows, so that any number of them stays distributed."""
    direction = filters.pop("direction", "out")
    category, part = filters.pop("category", None), filters.pop("counterparty", None)
    rows = by_counterparty(window(live(ledger, direction), **filters), part)
    return (rows.where(F.col("category") == category) if category else rows).select("document_id")


def currency_note(totals: DataFrame) -> DataFrame:
    """One row: the warning that goes with more than one currency, else null."""
    text = "Totals are split by currency and must not be added together."
    return totals.agg(F.when(F.count("*") > 1, F.lit(text)).alias("note"))


def list_transactions(ledger: DataFrame, start=None, end=None, counterparty=None, min_amount: Decimal | None = None, direction="out", limit=20) -> DataFrame:
    """Newest first, undated last, ties by id."""
    rows = by_counterparty(window(live(ledger, direction), start, end), counterparty)
    if min_amount is not None:
        rows = rows.where(F.col("amount") >= F.lit(min_amount))
    rows = rows.orderBy(F.desc_nulls_last("occurred_on"), "transaction_id").limit(clamp_limit(limit))
    return rows.select("transaction_id", "document_id", "occurred_on", "counterparty", "amount", "tax_amount", "currency", "category", "user_verified")


def spend_by_counterparty(ledger: DataFrame, start=None, end=None, direction="out", limit=10) -> DataFrame:
    rows = window(live(ledger, direction), start, end)
    out = rows.groupBy("counterparty", "currency").agg(F.sum("amount").cast(TOTAL).alias("total"), F.count("*").alias("transactions"))
    out = out.orderBy(F.desc("total"), "counterparty", "currency").limit(clamp_limit(limit))
    return out.withColumn("currency", F.coalesce("currency", F.lit(UNSTATED)))


def spend_by_month(ledger: DataFrame, start=None, end=None, direction="out") -> DataFrame:
    rows = window(live(ledger, direction), start, end).withColumn("month", month_key(F.col("occurred_on")))
    out = rows.groupBy("month", "currency").agg(F.sum("amount").cast(TOTAL).alias("total"), F.count("*").alias("transactions"))
    return out.orderBy("month", F.asc_nulls_first("currency")).withColumn("currency", F.coalesce("currency", F.lit(UNSTATED)))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """One row over both directions; currencies as a sorted, comma-joined list."""
    currencies = F.array_sort(F.collect_set(F.coalesce("currency", F.lit(UNSTATED))))
    return live(ledger, None).agg(F.count("*").alias("transactions"), F.min("occurred_on").alias("earliest"), F.max("occurred_on").alias("latest"), F.array_join(currencies, ",").alias("currencies"))


def get_source(ledger: DataFrame, extractions: DataFrame, documents: DataFrame, transaction_id: str) -> DataFrame:
    """The evidence behind one row; what is missing is null, an empty id finds nothing."""
    row = ledger.where(F.col("transaction_id") == transaction_id) if transaction_id else ledger.where("false")
    e = extractions.select(F.col("id").cast("string").alias("source_extraction_id"), "doc_type", "model_used", "raw_json")
    d = documents.select(F.col("id").alias("document_id"), "original_filename", "uploaded_at")
    return row.join(e, "source_extraction_id", "left").join(d, "document_id", "left").select("transaction_id", "document_id", "amount", "currency", "occurred_on", "counterparty", "original_filename", "uploaded_at", "doc_type", "model_used", "raw_json")
