"""Uploads: content addressing, the gate, and ingestion without duplicates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fit_filename, sniff_mime, storage_key

MAX_BYTES = 20 * 1024 * 1024
ALLOWED = ("image/jpeg", "image/png", "application/pdf", "image/tiff", "image/webp", "image/heic")


def decode_base64(text: Column) -> Column:
    """Strict: null unless the text is well-formed, padded base64."""
    fine = text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(fine, F.unbase64(F.when(fine, text)))


def gate(uploads: DataFrame, content: str = "content", max_bytes: int = MAX_BYTES, allowed=ALLOWED, existing: DataFrame | None = None) -> DataFrame:
    """Adds size_bytes, mime_type and refusal (an HTTP status, null when accepted).

    With ``existing(organisation_id, sha256)`` the day's spending cap is reached: files that
    would cost a call are refused (429), those that the organisation has sent before are not.
    """
    size = F.octet_length(content)
    mime = sniff_mime(F.col(content))
    refusal = F.when(F.coalesce(size, F.lit(0)) == 0, 400).when(size > max_bytes, 413).when(~F.coalesce(mime.isin(*allowed), F.lit(False)), 415)
    out = uploads.withColumns({"size_bytes": size, "mime_type": mime, "refusal": refusal})
    if existing is None:
        return out
    known = existing.select(F.col("organisation_id").alias("k_org"), F.col("sha256").alias("k_sha"), F.lit(True).alias("k_known")).distinct()
    met = out.join(known, (F.col("organisation_id") == F.col("k_org")) & (F.sha2(F.col(content), 256) == F.col("k_sha")), "left")
    return met.withColumn("refusal", F.when(F.col("refusal").isNotNull(), F.col("refusal")).when(F.col("k_known").isNull(), 429)).drop("k_org", "k_sha", "k_known")


def fingerprint(uploads: DataFrame, content: str = "content") -> DataFrame:
    digest = F.sha2(F.col(content), 256)
    return uploads.withColumn("sha256", digest).withColumn("storage_key", storage_key(F.col("organisation_id"), F.col("sha256")))


def ingest(uploads: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """First upload of each (organisation, digest); what the table holds already is left out.

    ``uploads`` has id, organisation_id and sha256. A grouped minimum keeps a hot digest to one row a task.
    """
    first = uploads.groupBy("organisation_id", "sha256").agg(F.min("id").alias("id"), F.count("*").alias("uploads"))
    return first if existing is None else first.join(existing, ["organisation_id", "sha256"], "left_anti")


def name_columns(uploads: DataFrame) -> DataFrame:
    return uploads.withColumn("original_filename", fit_filename(F.col("original_filename")))


def save_raw(uploads: DataFrame, folder: str, content: str = "content") -> None:
    """Writes new contents once, keyed and partitioned by the digest's first two digits; existing keys are left alone."""
    spark = uploads.sparkSession
    new = uploads.select("storage_key", F.col(content).alias("content"), F.left("sha256", F.lit(2)).alias("prefix")).dropDuplicates(["storage_key"])
    if raw_exists(spark, folder):
        new = new.join(load_raw(spark, folder).select("storage_key"), "storage_key", "left_anti")
    new.write.mode("append").partitionBy("prefix").parquet(folder)


def raw_exists(spark, folder: str) -> bool:
    try:
        load_raw(spark, folder).limit(0).count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def load_raw(spark, folder: str) -> DataFrame:
    return spark.read.schema("storage_key string, content binary, prefix string").parquet(folder)
