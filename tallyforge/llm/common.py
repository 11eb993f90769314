"""Shared helpers: the shared folder, lineage cuts and bounded label samples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_SHARED_DIR = "/tmp/checkpoints"

#: Up to so many counted strata their bounds are broadcast (two columns a row); beyond, the join is left to Spark.
BROADCAST_STRATA = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Only a session on one machine may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        spark.conf.set("spark.checkpoint.dir", DEFAULT_SHARED_DIR)
        found = DEFAULT_SHARED_DIR
    return found.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyforge/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly when a scan would give fewer tasks than cores; otherwise leave the scan alone.

    The number of tasks comes from the scan itself, so a large input is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * 2)


def fold_of(id_col: str, folds: int):
    """crc32 of the decimal id modulo ``folds`` (null ids fall in no fold)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def stratified_rows(df: DataFrame, key: str, stratum: str, rows: int) -> list:
    """At most ``max(rows, strata)`` rows, shared evenly by the values of ``stratum``: those with the lowest hash of ``key``.

    Two passes, whatever the number of strata: one counts them, one lets only rows under
    their stratum's bound of the hash leave the tasks (about three times as many as wanted
    at most). Repeated keys are rows of their own; the cut among them goes by the texts.
    """
    order = F.xxhash64(F.col(key).cast("string"), F.lit(7))
    counts = df.groupBy(stratum).agg(F.count("*").alias("n"))
    strata = counts.count()
    if not strata:
        return []
    each = max(1, rows // strata)
    share = F.least(F.lit(1.0), F.lit(3.0 * each) / F.col("n"))
    bounds = counts.select(F.col(stratum).alias("stratum_"), (F.lit(-(2.0**63)) + F.lit(2.0**64) * share).alias("bound_"))
    if strata <= BROADCAST_STRATA:  # else the join would move every row to its stratum's task before the bound is applied
        bounds = F.broadcast(bounds)
    low = df.join(bounds, F.col(stratum) == F.col("stratum_")).where(order.cast("double") <= F.col("bound_")).withColumn("order_", order)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("order_", key, *[c for c in df.columns if c not in (key, stratum)]))
    found = low.withColumn("place_", place).where(F.col("place_") <= each).orderBy(stratum, "place_").select(*df.columns).collect()  # bounded as said above
    return found


def bounded_rows(df: DataFrame, key: str, limit: int) -> list:
    """At most ``limit`` rows, those with the lowest hash of ``key``: a fixed sample whatever the partitioning.

    A bound on the hash, set from the row count, keeps all but about ``3 * limit`` rows from leaving their tasks.
    """
    order = F.xxhash64(F.col(key).cast("string"), F.lit(7))
    rows = df.count()
    if rows > 3 * limit:
        low = df.where(order <= int(-(2**63) + 2**64 * (3 * limit / rows)))
        found = low.orderBy(order, key).limit(limit).collect()
        if len(found) == limit:
            return found
    return df.orderBy(order, key).limit(limit).collect()
