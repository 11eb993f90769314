"""Embedding near-duplicates: exact metric range join over pivot cells.

Vectors are scaled to length one, so cosine >= c is Euclidean distance <= r with
r = sqrt(2 - 2c). Every vector's *home* is the cell of its nearest pivot. For a vector x
at home with pivot i and any y within r of x, the triangle inequality gives
d(y, i) <= R_i + r (R_i: the cell's radius) and, from the plane between the two pivots,
(d(y, i)^2 - d(y, home)^2) / (2 d(i, home)) <= r; y *reaches* exactly the cells that
meet both. Vectors are not copied to the cells that they reach: each is stored once, in a block of
its home, and two blocks of different cells meet if each has a vector that reaches the other's
cell; there only those vectors are compared. Every pair is looked at once.

A cell is dealt in blocks of at most ``BLOCK`` vectors, packed as bytes; blocks that follow each
other are a group, and every pair of groups is a key of its own that gets each of its blocks once. So a
crowded cell is many tasks of bounded memory, and what moves is the table times the number of
groups: about the square root of twice the tasks, or more where groups are at their bound.
The number of pivots is held at ``MAX_PIVOTS``.

Where vectors are nearly uncorrelated, most reach most cells and the join stays close to all
pairs, at a matrix product in single precision a pair of blocks.

Equal vectors are folded first, by 128 bits of hash; a fold's size counts as its links, so
a vector that fills a third of the table is one row here. Cosines that fall near c are recomputed
in double precision from the original components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_rows, cut
from .components import connected_components

MIN_COSINE = 0.9
#: Pivots come from a hash-chosen sample of this many distinct vectors; only speed depends on it. Lengths that it misses have one cell each.
PIVOT_SAMPLE = 2048
MAX_PIVOTS = 64
VECTORS_PER_PIVOT = 6000
#: Vectors of a block, at most; longer ones than of ``USUAL_LENGTH`` components count for more.
BLOCK = 16384
USUAL_LENGTH = 64
#: A group is at most this many full blocks: 16 MB in single precision, and a task holds two groups.
BLOCKS_PER_GROUP = 4
#: Rows and columns of a matrix product; its result stays in the processor's cache.
TILE = (512, 2048)
#: Links held before they are joined to components.
HELD_LINKS = 1 << 20
_SLACK = 1e-5


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n spread-out vectors of the sample: each next one is the farthest from those chosen."""
    chosen, near = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        near = np.minimum(near, 2 - 2 * sample @ sample[chosen[-1]])
        if near.max() <= 1e-9:
            break
        chosen.append(int(near.argmax()))
    return sample[chosen]


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # keeps huge and tiny components in range
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _matrix(packed: list[bytes], size: int) -> np.ndarray:
    """The vectors as rows: in single precision if all are packed so, else in double."""
    if all(len(v) == 4 * size for v in packed):
        return np.frombuffer(b"".join(packed), "<f4").reshape(-1, size)
    return np.array([np.frombuffer(v, "<f4" if len(v) == 4 * size else "<f8") for v in packed], dtype=np.float64)


def packed_vectors(rows: DataFrame) -> DataFrame:
    """``rows(v array<double>, ...)`` -> the same rows with v as bytes, and ``size``, its length.

    Components are packed as floats where these hold all of a vector's exactly, else as doubles; equal vectors
    have equal bytes. v is null for null, empty, zero or non-finite vectors; they keep their row.
    """
    others = [c for c in rows.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(len(others))
            size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
            wide = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null components are NaN, -0.0 is 0.0
            with np.errstate(over="ignore", invalid="ignore"):
                narrow = wide.astype(np.float32)
            ends = np.cumsum(size)
            starts = ends - size

            def per_row(flags: np.ndarray, starts=starts, ends=ends) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(flags)])
                return sums[ends] - sums[starts]

            fine = (per_row(~np.isfinite(wide)) == 0) & (per_row(wide != 0) > 0)
            exact = per_row(narrow != wide) == 0
            out = [(narrow if e else wide)[s:t].tobytes() if k else None for k, e, s, t in zip(fine.tolist(), exact.tolist(), starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size, pa.int32()), pa.array(out, pa.binary())], [*others, "size", "v"])

    kinds = [rows.schema[c] for c in others]
    kind = T.StructType([*kinds, T.StructField("size", T.IntegerType()), T.StructField("v", T.BinaryType())])
    return rows.select(*others, "v").mapInArrow(run, kind)


class _Cells:
    """The pivots of each vector length with their cell numbers, and the cells' radii."""

    def __init__(self, radius: float):
        self.radius, self.first, self.pivots, self.reach, self.size = radius, {}, {}, [], []

    def add(self, size: int, pivots: np.ndarray) -> None:
        self.first[size], self.pivots[size] = len(self.size), pivots
        self.size += [size] * len(pivots)
        self.reach += [0.0] * len(pivots)

    def place(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's home and the distance to its pivot; a length without pivots is one cell below zero."""
        size = m.shape[1]
        if size not in self.first:
            return np.full(len(m), -size), np.zeros(len(m))
        d = np.sqrt(np.maximum(0, 2 - 2 * _unit(m) @ self.pivots[size].T))
        home = d.argmin(axis=1)
        return self.first[size] + home, d[np.arange(len(m)), home]

    def reaching(self, unit: np.ndarray, home: int, cells: list[int]) -> np.ndarray:
        """Which of these vectors of one home (rows) have to be looked at in which of these cells (columns)."""
        size = self.size[home]
        pivots, at, own = self.pivots[size], np.array(cells) - self.first[size], home - self.first[size]
        d2, home2 = np.maximum(0, 2 - 2 * unit @ pivots[at].T), np.maximum(0, 2 - 2 * unit @ pivots[own])
        span = np.sqrt(np.maximum(0, 2 - 2 * pivots[at] @ pivots[own]))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(span > 0, (d2 - home2[:, None]) / (2 * span), 0)
        return (plane <= self.radius + _SLACK) & (np.sqrt(d2) <= np.array(self.reach)[cells] + self.radius + _SLACK)

    def neighbours(self, m: np.ndarray, home: int) -> list[int]:
        """The other cells that any of these vectors reaches."""
        if home < 0 or home >= len(self.size):
            return []
        size = self.size[home]
        cells = [c for c in range(self.first[size], self.first[size] + len(self.pivots[size])) if c != home]
        return [c for c, met in zip(cells, self.reaching(_unit(m), home, cells).any(axis=0)) if met] if cells else []


def _place(folds: DataFrame, cells: _Cells) -> DataFrame:
    """``folds(fold, copies, size, v)`` -> (cell, far, fold, copies, size, v): each vector's home and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, v = b.column(2).to_numpy(), b.column(3).to_pylist()
            cell, far = np.zeros(len(v), np.int32), np.zeros(len(v))
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                cell[at], far[at] = cells.place(_matrix([v[k] for k in at.tolist()], s))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far), *b.columns], ["cell", "far", "fold", "copies", "size", "v"])

    return folds.select("fold", "copies", "size", "v").mapInArrow(run, "cell int, far double, fold long, copies long, size int, v binary")


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins i[k] with j[k] in ``label``, which gives every node the smallest of its component."""
    while True:
        p, q = label[i], label[j]
        apart = p != q
        if not apart.any():
            return
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _hits(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, product) of the rows of a and b whose product is at least ``least``; of a itself, those with i < j."""
    high, broad = TILE
    products, marks = np.empty(high * broad, np.float32), np.empty(high * broad, bool)
    for top in range(0, len(a), high):
        left = a[top : top + high]
        for start in range(top // broad * broad if same else 0, len(b), broad):
            right = b[start : start + broad]
            n, w = len(left) * len(right), len(right)
            c, mark = products[:n], marks[:n]
            np.matmul(left, right.T, out=c.reshape(len(left), w))
            np.greater_equal(c, np.float32(least), out=mark)
            even = n // 8 * 8
            word = np.flatnonzero(mark[:even].view(np.uint64))  # eight marks at once: few have one
            at = (word[:, None] * 8 + np.arange(8)).ravel()
            at = np.concatenate([at[mark[at]], even + np.flatnonzero(mark[even:])])
            i, j = top + at // w, start + at % w
            if same:
                i, j, at = i[i < j], j[i < j], at[i < j]
            if len(at):
                yield i, j, c[at]


def _exactly(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Which of these pairs of rows have the cosine in double precision, computed as SQL does: one that is the bound itself links."""

    def scaled(m: np.ndarray) -> np.ndarray:
        m = m.astype(np.float64)
        return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])  # by powers of two: nothing is rounded

    dot = lambda x, y: np.cumsum(x * y, axis=1)[:, -1]  # noqa: E731  (in the order of the components, as SQL adds)
    step, found = max(1, (1 << 22) // a.shape[1]), [np.zeros(0, bool)]
    for k in range(0, len(i), step):
        x, y = scaled(a[i[k : k + step]]), scaled(b[j[k : k + step]])
        found.append(dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) >= cosine)
    return np.concatenate(found)


def _join_groups(cells: _Cells | None, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        blocks = sorted(table.to_pylist(), key=lambda b: b["block"])
        total = 0
        for b in blocks:
            b["fold"], b["copy"] = np.frombuffer(b["folds"], "<i8"), np.frombuffer(b["copies"], "<i8")
            n = len(b["fold"])
            b["m"] = np.frombuffer(b["vs"], "<f4" if len(b["vs"]) == 4 * n * b["size"] else "<f8").reshape(n, b["size"])
            unit = _unit(b["m"])
            # where a block meets another cell: its vectors that reach it
            b["unit"], b["at"], total = unit.astype(np.float32), total, total + n
            others = [c for c in b["reaches"] if any(c == o["cell"] for o in blocks)]
            b["into"] = dict(zip(others, cells.reaching(unit, b["cell"], others).T)) if others else {}
        fold = np.concatenate([b["fold"] for b in blocks])
        links, label = np.zeros(total, np.int64), np.arange(total)
        held, count = [], 0
        for x in blocks:
            for y in blocks:
                if (x["group"], y["group"]) != (x["ga"], x["gb"]) or x["block"] > y["block"] or x["size"] != y["size"]:
                    continue
                a, b, rows, columns = x["unit"], y["unit"], None, None
                if x["cell"] != y["cell"]:
                    if y["cell"] not in x["into"] or x["cell"] not in y["into"]:
                        continue
                    rows, columns = np.flatnonzero(x["into"][y["cell"]]), np.flatnonzero(y["into"][x["cell"]])
                    a, b = a[rows], b[columns]
                slack = _SLACK + 2e-7 * x["size"]  # more than single precision loses
                for i, j, c in _hits(a, b, cosine - slack, x is y):
                    if rows is not None:
                        i, j = rows[i], columns[j]
                    unsure = np.flatnonzero(c < cosine + slack)
                    if len(unsure):
                        keep = np.ones(len(i), bool)
                        keep[unsure] = _exactly(x["m"], y["m"], i[unsure], j[unsure], cosine)
                        i, j = i[keep], j[keep]
                    np.add.at(links, x["at"] + i, y["copy"][j])
                    np.add.at(links, y["at"] + j, x["copy"][i])
                    held.append((x["at"] + i, y["at"] + j))
                    count += len(i)
                    if count > HELD_LINKS:
                        _unite(label, *map(np.concatenate, zip(*held)))
                        held, count = [], 0
        if held:
            _unite(label, *map(np.concatenate, zip(*held)))
        # each vector with the first of its component in these blocks: enough for the components
        near, joined = np.flatnonzero(links), np.flatnonzero(label != np.arange(total))
        a, b = np.concatenate([fold[near], fold[joined]]), np.concatenate([fold[near], fold[label[joined]]])
        return pa.table({"a": a, "b": b, "links": np.concatenate([links[near], np.zeros(len(joined), np.int64)])})

    return run


def _cell_links(placed: DataFrame, tasks: int, radius: float, cosine: float, cells: _Cells | None = None) -> DataFrame:
    """``placed(cell, fold, copies, v)`` of home cells -> ``(a, b, links)``: each block with every block that it meets.

    Without ``cells``, each cell is joined on its own. v is an array or packed, with ``size`` beside it.
    """
    spark = placed.sparkSession
    if "size" not in placed.columns:
        placed = packed_vectors(placed)
    counts = placed.groupBy("cell").agg(F.first("size").alias("length"), F.count("*").alias("n")).collect()  # one row a pivot, or a length that the sample missed
    weigh = lambda row: row["n"] * max(1.0, row["length"] / USUAL_LENGTH)
    group = min(float(BLOCKS_PER_GROUP * BLOCK), math.ceil(sum(map(weigh, counts)) / math.ceil(math.sqrt(2 * tasks))))
    dealt, first, start = [], 0, 0.0
    for row in sorted(counts, key=lambda row: (row["length"], row["cell"])):
        parts = math.ceil(weigh(row) / min(BLOCK, group))
        dealt.append((row["cell"], first, parts, start, weigh(row) / parts))
        first, start = first + parts, start + weigh(row)
    dealt = spark.createDataFrame(dealt, "cell int, first long, parts long, start double, step double")

    def pack(table: pa.Table) -> pa.Table:
        cell, size = table["cell"][0].as_py(), table["size"][0].as_py()
        m = _matrix(table["v"].to_pylist(), size)
        one = {c: [table[c][0].as_py()] for c in ("group", "block", "cell", "size")}
        one |= {"folds": [table["fold"].to_numpy().tobytes()], "copies": [table["copies"].to_numpy().tobytes()], "vs": [m.tobytes()]}
        reaches = pa.array([cells.neighbours(m, cell) if cells else []], pa.list_(pa.int32()))
        return pa.table({**one, "reaches": reaches}, schema=pa.schema([("group", pa.int64()), ("block", pa.int64()), ("cell", pa.int32()), ("size", pa.int32()), ("folds", pa.binary()), ("copies", pa.binary()), ("vs", pa.binary()), ("reaches", pa.list_(pa.int32()))]))

    part = F.pmod(F.xxhash64("fold"), F.col("parts"))
    rows = placed.join(F.broadcast(dealt), "cell").withColumns({"block": F.col("first") + part, "group": F.floor((F.col("start") + part * F.col("step")) / group)})
    rows = rows.select("group", "block", "cell", "size", "fold", "copies", "v")
    blocks = cut(rows.groupBy("group", "block").applyInArrow(pack, "group long, block long, cell int, size int, folds binary, copies binary, vs binary, reaches array<int>"), "blocks")
    names = blocks.select("size", "group", "block", "cell", "reaches")
    others = names.select("size", *[F.col(c).alias(f"other_{c}") for c in ("group", "block", "cell", "reaches")])
    met = F.expr("block <= other_block and (cell = other_cell or array_contains(reaches, other_cell) and array_contains(other_reaches, cell))")
    pairs = names.join(others, "size").where(met).select(F.col("group").alias("ga"), F.col("other_group").alias("gb"), F.explode(F.array("block", "other_block")).alias("block"))
    pairs = cut(pairs.distinct(), "block-pairs")
    keys = pairs.select("ga", "gb").distinct().count()
    work = pairs.join(blocks, "block").repartition(max(tasks, keys), "ga", "gb")
    return work.groupBy("ga", "gb").applyInArrow(_join_groups(cells, cosine), "a long, b long, links long")


def vector_links(folds: DataFrame, cosine: float = MIN_COSINE) -> DataFrame:
    """``folds(fold, copies, size, v)`` of distinct packed vectors -> ``(a, b, links)``.

    Rows with a = b carry (part of) the number of rows linked to fold a, copies counted;
    rows with a <> b connect what is linked.
    """
    cells = _Cells(math.sqrt(max(0.0, 2 - 2 * cosine)))
    n = folds.count()
    if not n:
        return folds.sparkSession.createDataFrame([], "a long, b long, links long")
    groups: dict[int, list] = {}
    for row in bounded_rows(folds.select("fold", "size", "v"), "fold", PIVOT_SAMPLE):
        groups.setdefault(row["size"], []).append(bytes(row["v"]))
    for size in sorted(groups):
        cells.add(size, _pivots(_unit(_matrix(groups[size], size)), max(1, min(MAX_PIVOTS, n // VECTORS_PER_PIVOT))))
    placed = cut(_place(folds, cells), "cells")
    for row in placed.where("cell >= 0").groupBy("cell").agg(F.max("far").alias("far")).collect():  # one row a pivot
        cells.reach[row["cell"]] = row["far"]
    tasks = max(4 * folds.sparkSession.sparkContext.defaultParallelism, n // BLOCK)
    return _cell_links(placed, tasks, cells.radius, cosine, cells)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = MIN_COSINE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    n_links counts the other rows with cosine of at least ``cosine`` (equal vectors
    included), component_id is the smallest id reachable over links, kept says that it is
    the row's own. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different lengths do not link. Repeated ids are rows of their own;
    a null id keeps its row.
    """
    rows = packed_vectors(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")))
    rows = cut(rows.withColumns({"k1": F.xxhash64("size", "v"), "k2": F.xxhash64(F.lit(1), "size", "v"), "fine": F.col("v").isNotNull()}), "vectors")
    folded = rows.where("fine").groupBy("k1", "k2").agg(F.first("size").alias("size"), F.first("v").alias("v"), F.min("id").alias("low"), F.count("*").alias("copies"))
    found = cut(folded.select(F.monotonically_increasing_id().alias("fold"), "low", "copies", "size", "v", "k1", "k2"), "folds")
    links = cut(vector_links(found.select("fold", "copies", "size", "v"), cosine), "links")
    counts = links.where("a = b").groupBy(F.col("a").alias("fold")).agg(F.sum("links").alias("links"))
    parts = connected_components(links.where("a <> b").select("a", "b"))
    named = found.select("fold", "low", "copies", "k1", "k2").join(counts, "fold", "left").join(parts.withColumnRenamed("node", "fold"), "fold", "left")
    named = named.select("k1", "k2", "low", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "fold").alias("part"))
    lows = named.groupBy("part").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "part").select("k1", "k2", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    named = cut(named, "vector-components")
    usable = rows.where("fine").select("id", "k1", "k2").join(named, ["k1", "k2"]).select("id", "n_links", "component_id")
    out = usable.unionByName(rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )
