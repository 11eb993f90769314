"""The document pipeline as Structured Streaming micro-batches.

Two chained queries over file tables: uploads become recognised documents, and those
become routed, checked and booked ones. ``foreachBatch`` with a checkpoint replaces the
claim-and-lock queue: a batch is written under its number, so a batch that is run again
replaces its own output. ``once=True`` drains what is there and ends, otherwise the
queries poll.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import definitions as D

POLL = "2 seconds"


def _start(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool, partition_column: str = "batch") -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        step(batch).withColumn(partition_column, F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_column).parquet(out)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def recognise(spark: SparkSession, uploads: str, schema: str, engine: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Stage one: ``engine`` adds full_text (null where it cannot read) to uploads(document_id, organisation_id, ...)."""
    stream = spark.readStream.schema(schema).parquet(uploads)
    status = F.when(F.col("full_text").isNull(), "ocr_failed").otherwise("ocr_done")
    return _start(stream, lambda b: engine(b).withColumn("status", status), out, checkpoint, once)


def extract_batch(read: DataFrame, definition: D.Definition, extractor: Callable[[DataFrame], DataFrame], today: dt.date, transform=None) -> DataFrame:
    """Stage two on any frame (document_id, organisation_id, full_text): route, extract, process, book.

    ``extractor`` adds ``answer_json`` (null where the model failed). One row a document:
    status, errors, derived, and the ledger row or the reason why there is none.
    """
    routed = read.withColumn("route", D.route_expr([(definition, False)], F.col("full_text")))
    asked = extractor(routed)
    processed = asked.withColumn("p", D.process_expr(definition, F.try_parse_json("answer_json"), today, transform))
    booked = processed.withColumn("booked", D.ledger_expr(definition, F.col("p.values")))
    matched, answered = F.col("route").isNotNull(), F.col("answer_json").isNotNull()
    clean = F.size("p.errors") == 0
    status = F.when(~matched, "unsupported").when(~answered, "needs_review").when(~clean, "needs_review").when(F.col("booked.row").isNull(), "validated").otherwise("committed")
    return booked.select(
        "document_id", "organisation_id", status.alias("status"), F.col("route.name").alias("doc_type"),
        F.when(matched & answered, F.col("p.errors")).alias("errors"), F.when(matched & answered, F.col("p.derived")).alias("derived"),
        F.when(status == "committed", F.col("booked.row")).alias("transaction"), F.when(matched & answered & clean, F.col("booked.reason")).alias("reason"),
    )


def extract(spark: SparkSession, recognised: str, schema: str, definition: D.Definition, extractor, today: dt.date, out: str, checkpoint: str, once: bool = True, transform=None) -> StreamingQuery:
    stream = spark.readStream.schema(schema).parquet(recognised)
    return _start(stream, lambda b: extract_batch(b.where("status = 'ocr_done'"), definition, extractor, today, transform), out, checkpoint, once)


def running_spend(spark: SparkSession, extractions: str, schema: str, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Spend per UTC day, trials included, kept up to date as calls arrive (memory sink ``name``); feeds the spend cap."""
    stream = spark.readStream.schema(schema).parquet(extractions)
    days = stream.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", "2 days")
    totals = days.groupBy(F.window("at", "1 day").alias("w")).agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(24,6)").alias("spent_usd"))
    rows = totals.select(F.to_date("w.start").alias("day"), "spent_usd")
    writer = rows.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def status_events(before: DataFrame, after: DataFrame, at: dt.datetime) -> DataFrame:
    """Transitions to append to the audit log: documents whose status changed."""
    b, a = before.select("document_id", F.col("status").alias("from_status")), after.select("document_id", "organisation_id", F.col("status").alias("to_status"))
    return a.join(b, "document_id", "left").where(~F.col("from_status").eqNullSafe(F.col("to_status"))).withColumn("created_at", F.lit(at))
