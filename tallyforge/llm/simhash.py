"""SimHash near-duplicates by pivot distance tables.

A fingerprint x is described by its Hamming distances to reference fingerprints. Two
families of references are used:

* the zero fingerprint and the 64 one-bit fingerprints, in four groups of 16. The
  differences d(x, e_i) - d(x, 0) over two groups name a *cell*. Two fingerprints that
  differ in at most two bits agree on all references of at least two groups, so they
  share at least one of the six cells. Since that difference is 1 - 2 * (bit i), a cell
  is stored as the masked bits themselves.
* ``N_DENSE`` dense references, whose distances are written beside each fingerprint once.
  By the triangle inequality |d(x,p) - d(y,p)| <= d(x,y), so a pair whose largest
  coordinate difference exceeds the threshold is discarded; the rest are verified.

Equal fingerprints are folded into one before any pairing. A cell with more than
``CELL_LIMIT`` distinct fingerprints is not paired: its members meet in the one-bit balls
around each of them instead (two fingerprints differ in at most two bits exactly when
their balls share a point, and a ball has 65 members at most), which loses no link and
makes no quadratic list.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .components import connected_components

SEED = 42
MAX_BITS = 2
CELL_LIMIT = 48
N_DENSE = 8
GROUPS = [0xFFFF << s for s in (0, 16, 32, 48)]
_CHUNK = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dense_references(n: int = N_DENSE) -> list[int]:
    """Dense reference fingerprints, from a rule: XXH64 of their numbers."""
    return [xxhash.xxh64_intdigest(f"reference {i}".encode(), seed=SEED) for i in range(n)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of the whole text; 0 for null or no word."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=SEED)
    joined = b" ".join(words)
    starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, _CHUNK):
        hashes = np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts[at : min(at + _CHUNK, n)], starts[at + width :])), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([_signed(fingerprint(t)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["id", "fp"])

    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())]))


def _bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Distinct ``fps(fp)`` -> links ``(a, b)``, a > b, that keep every component of the exact link graph."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the four groups of references cover at most two differing bits")
    cells = [F.struct(F.lit(k).cast("byte").alias("g"), F.col("fp").bitwiseAND(F.lit(_signed(a | b))).alias("c")) for k, (a, b) in enumerate(itertools.combinations(GROUPS, 2))]
    table = [_bits(F.col("fp"), F.lit(_signed(p))).cast("byte").alias(f"t{k}") for k, p in enumerate(dense_references())]
    coordinates = [f"t{k}" for k in range(len(table))]
    placed = fps.select("fp", *table, F.explode(F.array(*cells)).alias("cell")).select("fp", *coordinates, "cell.g", "cell.c")
    sizes = placed.groupBy("g", "c").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(placed.join(sizes, ["g", "c"]), "cells")
    small = shared.where(F.col("n") <= cell_limit)
    sides = [small.select("g", "c", F.col("fp").alias(x), *[F.col(t).alias(f"{x}{t}") for t in coordinates]) for x in "ab"]
    pairs = sides[0].join(sides[1], ["g", "c"]).where("a > b")
    close = functools.reduce(Column.__and__, [F.abs(F.col(f"a{t}") - F.col(f"b{t}")) <= max_bits for t in coordinates])
    near = pairs.where(close).where(_bits(F.col("a"), F.col("b")) <= max_bits).select("a", "b")
    hot = shared.where(F.col("n") > cell_limit).select("fp").distinct()
    if max_bits == 2:
        points = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64))]
        balls = hot.select("fp", F.explode(F.array(*points)).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        near = near.unionByName(balls.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a > b"))
    elif max_bits == 1:
        points = [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]
        flips = hot.select(F.col("fp").alias("a"), F.explode(F.array(*points)).alias("b"))
        near = near.unionByName(flips.join(hot.select(F.col("fp").alias("b")), "b").where("a > b").select("a", "b"))
    return near.distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most ``max_bits`` differing
    bits, the document's own included. Null and empty texts (and texts without a word) have
    fingerprint zero and link like any other; a null id keeps its row and is never a
    component's name unless all ids there are null. Repeated rows stay repeated.
    """
    found = cut(with_fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = found.groupBy("fp").agg(F.min("id").alias("low"))
    distinct = cut(distinct, "distinct-fingerprints")
    parts = connected_components(fingerprint_links(distinct.select("fp"), max_bits))
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("part"))
    lows = named.groupBy("part").agg(F.min("low").alias("component_id"))
    multi = cut(named.join(lows, "part").select("fp", "component_id"), "fingerprint-components")
    return found.join(multi, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` a component: the one with the smallest id, null ids last; rows of equal id are told apart by a key of their own."""
    key = "row"
    while key in map(str.lower, docs.columns):
        key += "_"
    number = F.monotonically_increasing_id()
    # written once, so that every later read sees the same keys
    keyed = cut(docs.withColumn(key, F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), number.alias("number"))), "keyed")
    found = simhash_components(keyed, key, text_col, max_bits)
    keep = found.where(F.col(f"{key}.number") == F.col("component_id.number")).select(F.col(f"{key}.number").alias("number"))
    return keyed.join(keep, keyed[key]["number"] == keep["number"], "left_semi").select(*docs.columns)
