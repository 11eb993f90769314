"""The documents list: filters, keyset pages, summaries and export."""

from __future__ import annotations

import base64
import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp_limit, formula_guard, type_label

# fixed values: status -> outcome
OUTCOMES = {
    "uploaded": "processing", "ocr_done": "processing", "classified": "processing", "extracted": "processing", "reprocessing": "processing",
    "validated": "done", "committed": "done", "synced": "done", "needs_review": "needs_review", "unsupported": "unsupported", "ocr_failed": "failed", "rejected": "failed",
}
OUTCOME_ORDER = ("processing", "done", "needs_review", "unsupported", "failed")
EXPORT_LIMIT = 50_000
SORTS = ("received", "document_date")


def outcome(status: Column) -> Column:
    """The client-facing outcome; a status nobody knows is still processing."""
    known = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    return F.coalesce(F.element_at(known, status), F.lit("processing"))


def statuses_of(name: str) -> list[str]:
    return [s for s, o in OUTCOMES.items() if o == name]


def day_start(day: dt.date, zone: str) -> Column:
    """The instant a calendar day begins in a zone, as UTC (the session's zone is UTC)."""
    return F.to_utc_timestamp(F.lit(dt.datetime.combine(day, dt.time())).cast("timestamp"), zone)


def filters(documents: DataFrame, outcome_name=None, doc_type=None, q=None, received_from=None, received_to=None, zone="UTC") -> DataFrame:
    """Plain predicates that reach the scan; ``q`` is a literal, case-blind substring of supplier or file name."""
    if outcome_name is not None:
        documents = documents.where(F.col("status").isin(statuses_of(outcome_name)))
    if doc_type is not None:
        documents = documents.where(F.col("doc_type") == doc_type)
    if q is not None and q.strip():
        needle = F.lit(q.strip().lower())
        documents = documents.where(F.coalesce(F.contains(F.lower("supplier"), needle), F.lit(False)) | F.coalesce(F.contains(F.lower("original_filename"), needle), F.lit(False)))
    if received_from is not None:
        documents = documents.where(F.col("uploaded_at") >= day_start(received_from, zone))
    if received_to is not None:
        documents = documents.where(F.col("uploaded_at") < day_start(received_to + dt.timedelta(days=1), zone))
    return documents


def encode_cursor(sort: str, uploaded_at: dt.datetime, row_id: str, document_date: dt.date | None = None) -> str:
    body = {"s": sort, "d": document_date.isoformat() if document_date else None, "u": uploaded_at.isoformat(), "i": row_id}
    return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(text: str, sort: str) -> tuple[dt.date | None, dt.datetime, str]:
    try:
        body = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        found = (dt.date.fromisoformat(body["d"]) if body["d"] else None, dt.datetime.fromisoformat(body["u"]), str(body["i"]))
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("the cursor cannot be read") from e
    if body.get("s") != sort:
        raise ValueError("the cursor belongs to another order")
    return found


def page(documents: DataFrame, sort: str = "received", cursor: str | None = None, limit: int = 50) -> DataFrame:
    """One page plus one row more, which says that there is a next page. Plans to a top-k, no global sort."""
    if sort not in SORTS:
        raise ValueError(f"unknown order {sort!r}")
    order = [F.desc("uploaded_at"), F.desc("id")]
    if sort == "document_date":
        order = [F.desc_nulls_last("document_date"), *order]
    if cursor is not None:
        day, at, row_id = decode_cursor(cursor, sort)
        older = (F.col("uploaded_at") < F.lit(at)) | ((F.col("uploaded_at") == F.lit(at)) & (F.col("id") < row_id))
        if sort == "received":
            documents = documents.where(older)
        elif day is None:
            documents = documents.where(F.col("document_date").isNull() & older)
        else:
            date = F.col("document_date")
            documents = documents.where((date < F.lit(day)) | date.isNull() | ((date == F.lit(day)) & older))
    return documents.orderBy(*order).limit(clamp_limit(limit) + 1)


def panel_page(documents: DataFrame, before: dt.datetime | None = None, limit: int = 50) -> DataFrame:
    """The simpler list: its cursor is the instant alone, so rows that tie with a page's last row are passed over."""
    if before is not None:
        documents = documents.where(F.col("uploaded_at") < F.lit(before))
    return documents.orderBy(F.desc("uploaded_at"), F.desc("id")).limit(clamp_limit(limit))


def rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Listing rows: outcome, type with its label (or one made from its name), total only where there is one."""
    named = documents.join(labels.select(F.col("name").alias("doc_type"), F.col("display_name").alias("type_label")), "doc_type", "left")
    return named.select(
        "id", outcome(F.col("status")).alias("outcome"), "doc_type",
        F.when(F.col("doc_type").isNotNull(), F.coalesce("type_label", type_label(F.col("doc_type")))).alias("type_label"),
        "supplier", "document_date",
        F.when(F.col("total_amount").isNotNull(), F.col("total_amount")).alias("amount"),
        F.when(F.col("total_amount").isNotNull(), F.col("total_currency")).alias("currency"),
    )


def newest_labels(document_types: DataFrame) -> DataFrame:
    """Display name of each name's newest version, drafts included."""
    return document_types.groupBy("name").agg(F.max_by("display_name", "version").alias("display_name"))


def summary_by_outcome(documents: DataFrame) -> DataFrame:
    """Every outcome, at zero too: one aggregate of conditional counts, turned into rows."""
    counts = documents.select(outcome(F.col("status")).alias("o")).agg(*[F.count_if(F.col("o") == o).alias(o) for o in OUTCOME_ORDER])
    return counts.select(F.explode(F.create_map(*[x for o in OUTCOME_ORDER for x in (F.lit(o), F.col(o))])).alias("outcome", "documents"))


def summary_totals(documents: DataFrame) -> DataFrame:
    stated = documents.where("total_amount is not null and total_currency is not null")
    return stated.groupBy(F.col("total_currency").alias("currency")).agg(F.sum("total_amount").cast("decimal(24,4)").alias("total")).orderBy("currency")


def distinct_types(documents: DataFrame) -> DataFrame:
    return documents.where("doc_type is not null").select("doc_type").distinct()


def export(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """CSV columns with text guarded against spreadsheet formulas, newest first, capped as the feature asks."""
    newest = documents.orderBy(F.desc("uploaded_at"), F.desc("id")).limit(EXPORT_LIMIT)
    out = rows(newest, labels)
    return out.withColumns({c: formula_guard(F.col(c)) for c in ("doc_type", "type_label", "supplier")})


def document_costs_join(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """Billed cost of every document, 0 where it had no call; the calls are summed before they join."""
    cost = extractions.where("not is_trial").groupBy(F.col("document_id").cast("string").alias("id")).agg(F.sum("cost_usd").alias("c"))
    return documents.join(cost, "id", "left").select("id", F.coalesce("c", F.lit(0)).cast("decimal(24,6)").alias("cost_usd"))


def backfill(documents: DataFrame, summaries: DataFrame) -> DataFrame:
    """Fills the list's columns from ``summaries(id, doc_type, supplier, ...)`` where no type is recorded yet."""
    columns = [c for c in ("doc_type", "supplier", "document_date", "total_amount", "total_currency") if c in summaries.columns]
    new = summaries.select("id", *[F.col(c).alias(f"__{c}") for c in columns])
    joined = documents.join(new, "id", "left")
    empty = F.col("doc_type").isNull()
    return joined.withColumns({c: F.when(empty, F.coalesce(c, f"__{c}")).otherwise(F.col(c)) for c in columns}).select(*documents.columns)


def with_owner(documents: DataFrame, organisations: DataFrame) -> DataFrame:
    return documents.join(organisations.select(F.col("id").alias("organisation_id"), F.col("name").alias("organisation")), "organisation_id")


def inherit_owner(rows_: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows derived from a document carry its organisation."""
    return rows_.drop("organisation_id").join(documents.select(F.col("id").alias("document_id"), "organisation_id"), "document_id")
