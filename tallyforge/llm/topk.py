"""Exact top-k by inner product: norm-sorted blocks with SVD-rotated partial sums.

Candidates are dealt into blocks by descending length and are worked through in waves, each
``WAVE_GROWTH`` times as many blocks as all before. After a wave every query has a floor: its
k-th best score so far. A block is skipped for a block of queries when |q| * (longest
length in the block) stays below every floor. Inside a pair of blocks, vectors are rotated
by the right singular vectors of a sample, so that the first few coordinates hold most of
the energy: a candidate survives for a query if the partial sum plus the Cauchy-Schwarz
bound on the rest (the product of the residual lengths) reaches the floor. Survivors are
scored exactly in integers.

The names of the blocks that may matter are paired first; packed blocks of bounded size
then join those pairs on their names, so no key stands for more than a block. No row of
either side is paired with single rows of the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_rows, cut

K = 5
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: The rotation is fitted on this many hash-chosen vectors; only speed depends on it.
ROTATION_SAMPLE = 2048
#: Each wave takes so many times the blocks before it.
WAVE_GROWTH = 8
_EXACT = 2.0**53


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v, norm): v = floor(scale * x) of each component as a double. Unusable vectors and null ids are left out."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.where(v.isNotNull() & ~F.exists(v, bad) & F.col(id_col).isNotNull())
    # Python-side floor would do the same; this stays in the JVM. floor() of a double is a long there, so large ones go unrounded: they are whole already.
    part = lambda x: F.when(F.abs(x * scale) < _EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, part).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def _score_pair(k: int, basis: dict[int, np.ndarray]):
    """Rows of (queries, candidates) blocks -> each query's k best of the block among those that may reach its floor."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                found = _pair(row, k, basis)
                if found:
                    yield pd.DataFrame(found, columns=["query", "query_id", "row", "vec_id", "score"])

    return run


def _pair(row, k: int, basis: dict[int, np.ndarray]) -> list[tuple]:
    queries, rows, names = np.array(row.queries), np.array(row.rows), np.array(row.vec_ids)
    q, c = np.array([np.asarray(v) for v in row.qs]), np.array([np.asarray(v) for v in row.cs])
    floor = np.array(row.floors, dtype=np.float64)
    size = float(np.linalg.norm(q, axis=1).max()) * float(np.linalg.norm(c, axis=1).max()) if q.shape[1] else 0.0
    if not size < _EXACT:  # also for infinities: whole numbers beyond doubles
        return _in_python(row, k)
    if q.shape[1]:
        turn = basis.get(q.shape[1])
        turn = np.eye(q.shape[1]) if turn is None else turn
        head = max(1, q.shape[1] // 4)
        rq, rc = q @ turn, c @ turn
        rest = np.outer(np.linalg.norm(rq[:, head:], axis=1), np.linalg.norm(rc[:, head:], axis=1))
        alive = rq[:, :head] @ rc[:, :head].T + rest + 1e-9 * (1 + size) >= floor[:, None]
        alive &= np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)) * (1 + 1e-12) + 1e-6 >= floor[:, None]
    else:
        alive = np.ones((len(q), len(c)), bool)
    out = []
    for i, query in enumerate(queries):
        at = np.flatnonzero(alive[i] & (rows != query))
        if len(at):
            s = c[at] @ q[i]
            for t in np.lexsort((rows[at], names[at], -s))[:k]:
                out.append((int(query), int(row.query_ids[i]), int(rows[at[t]]), int(names[at[t]]), int(s[t])))
    return out


def _in_python(row, k: int) -> list[tuple]:
    limit = 2**63 - 1
    whole = [[int(x) for x in v] for v in row.cs]
    out = []
    for query, name, v in zip(row.queries, row.query_ids, row.qs):
        v = [int(x) for x in v]
        scored = sorted((-max(-limit - 1, min(limit, sum(a * b for a, b in zip(v, w)))), j, r) for r, j, w in zip(row.rows, row.vec_ids, whole) if r != query)[:k]
        out += [(int(query), int(name), int(r), int(j), -s) for s, j, r in scored]
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; tasks drop what is not among their own k best before the shuffle."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but
    the query's own. Ties go to the smaller id; fewer than k candidates give fewer rows.
    Vectors that are null or hold null or non-finite components, and rows with a null id,
    take no part; only vectors of equal length meet. Rows that repeat an id are candidates
    and queries of their own, each with its own ranks. Scores beyond 64 bits are held at
    the ends of the range.
    """
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, id_col, vector_col, scale).withColumns({"size": F.size("v"), "row": F.monotonically_increasing_id()})
    rows = cut(whole, "integer-vectors")
    basis = _rotations(rows)
    n = rows.count()
    parts = max(1, math.ceil(n / CANDIDATE_BLOCK))
    # ranges are cut from a sample, so they are only roughly even: parts of at most a block's size inside each
    ranged = rows.repartitionByRange(parts, F.desc("norm"), "row").withColumn("range", F.spark_partition_id())
    ranged = cut(ranged.withColumn("part", (F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)) / CANDIDATE_BLOCK).cast("int")), "by-norm")
    packed = ranged.groupBy("size", "range", "part").agg(F.collect_list(F.struct("row", "id", "v")).alias("m"), F.max("norm").alias("longest"))
    packed = packed.select(F.struct("size", "range", "part").alias("block"), "size", "range", "longest", F.col("m.row").alias("rows"), F.col("m.id").alias("vec_ids"), F.col("m.v").alias("cs"))
    blocks = cut(packed, "norm-blocks")
    qparts = max(1, math.ceil(n / every / QUERY_BLOCK))
    queries = ranged.where(F.pmod("id", F.lit(every)) == 0).select("row", "id", "size", "v", "norm", F.pmod(F.xxhash64("row"), F.lit(qparts)).alias("part"))
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("query", "query_id", "row", "vec_id", "score")])
    best = spark.createDataFrame([], schema)
    low, high = 0, 1
    while low < parts:
        wave = blocks.where((F.col("range") >= low) & (F.col("range") < high))
        found = _wave(queries, wave, best, k).mapInPandas(_score_pair(k, basis), schema)
        best = cut(_best(best.unionByName(found), k).select(*schema.names), "best")
        low, high = high, high + WAVE_GROWTH * high
    return _best(best, k).select("query_id", "rank", "vec_id", "score")


def _rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """The right singular vectors of a bounded sample, for each vector length in it."""
    groups: dict[int, list] = {}
    for r in bounded_rows(rows.select("row", "v", "size"), "row", ROTATION_SAMPLE):
        groups.setdefault(r["size"], []).append(r.v)
    basis = {}
    for size, vs in groups.items():
        m = np.array(vs, dtype=np.float64)
        if size and np.abs(m).max() < 1e100:
            basis[size] = np.linalg.svd(m, full_matrices=len(m) < size)[2].T
    return basis


def _wave(queries: DataFrame, wave: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """(query block, candidate block) rows that the lengths do not rule out, with the queries' floors."""
    tops = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    floors = tops.where(F.col("n") >= k).select(F.col("query").alias("row"), F.col("low").cast("double").alias("floor"))
    ready = queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    ready = ready.groupBy("size", "part").agg(F.collect_list(F.struct("row", "id", "v", "floor")).alias("m"), F.max("norm").alias("longest"), F.min("floor").alias("lowest"))
    ready = cut(ready.select(F.struct("size", "part").alias("qblock"), "size", "longest", "lowest", F.col("m.row").alias("queries"), F.col("m.id").alias("query_ids"), F.col("m.v").alias("qs"), F.col("m.floor").alias("floors")), "query-blocks")
    names = ready.select("qblock", "size", F.col("longest").alias("qlong"), "lowest").join(wave.select("block", "size", "longest"), "size")
    pairs = names.where(F.col("qlong") * F.col("longest") * (1 + 1e-12) + 1e-6 >= F.col("lowest")).select("qblock", "block")
    cores = queries.sparkSession.sparkContext.defaultParallelism
    pairs = cut(pairs, "block-pairs")
    met = pairs.join(ready.select("qblock", "queries", "query_ids", "qs", "floors"), "qblock").join(wave.select("block", "rows", "vec_ids", "cs"), "block")
    return met.repartition(4 * cores, "qblock", "block")  # a block that many others meet is many tasks
