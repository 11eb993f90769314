"""Timelines and histories of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def step_durations(events: DataFrame) -> DataFrame:
    """Microseconds from the event before; null for a document's first."""
    w = Window.partitionBy("document_id").orderBy("created_at", "id")
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    return events.select("id", "document_id", "to_status", (at - F.lag(at).over(w)).alias("step_micros"))


def elapsed(events: DataFrame) -> DataFrame:
    """Microseconds from a document's first to its last event, where it has more than one."""
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    return events.groupBy("document_id").agg(F.count("*").alias("events"), F.when(F.count("*") > 1, F.max(at) - F.min(at)).alias("elapsed_micros"))


def corrected_fields(corrections: DataFrame) -> DataFrame:
    """Per document and field: the value before the first correction, and who made the last and when."""
    return corrections.groupBy("document_id", "field").agg(
        F.min_by("was", "revision").alias("was"), F.max_by("now", "revision").alias("now"),
        F.max_by("corrected_by", "revision").alias("corrected_by"), F.max_by("created_at", "revision").alias("corrected_at"),
    )


def read_at(extractions: DataFrame) -> DataFrame:
    """When a document was last read by a model: corrections and trials do not count."""
    return extractions.where("not is_trial and model_used <> 'correction'").groupBy("document_id").agg(F.max("created_at").alias("read_at"))


def merged_history(events: DataFrame, corrections: DataFrame) -> DataFrame:
    """Events and corrections of all documents; sort one document's by created_at, kind and id where they are shown."""
    a = events.select("document_id", F.lit("event").alias("kind"), "id", F.col("to_status").alias("what"), "created_at")
    b = corrections.select("document_id", F.lit("correction").alias("kind"), "id", F.col("field").alias("what"), "created_at")
    return a.unionByName(b)


def document_detail(documents: DataFrame, events: DataFrame, extractions: DataFrame) -> DataFrame:
    """Per document: number of events, total time, attempts, billed and trial cost. Each side is grouped before it joins."""
    from .costs import document_costs

    tries = extractions.groupBy("document_id").agg(F.count("*").alias("attempts"))
    return documents.select(F.col("document_id")).distinct().join(elapsed(events), "document_id", "left").join(tries, "document_id", "left").join(document_costs(extractions), "document_id", "left")
