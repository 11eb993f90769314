"""Page geometry: printed rows rebuilt from recognised boxes."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = "array<struct<text:string,bbox:array<int>,confidence:double,page:int,polygon:array<array<double>>>>"

# fixed values: fraction of a line height that still is the same line, blanks between fragments, pixels from which an outline gives an angle
SAME_LINE, GAP, MIN_SPAN = 0.5, 2, 15


class Fragment(NamedTuple):
    """A printed piece of text: its left edge, width, height and middle, and the slope of its outline if that is long enough."""

    text: str
    left: float
    width: float
    height: float
    middle: tuple[float, float]
    slope: float | None


def _fragment(block) -> Fragment | None:
    text, box, outline = (block["text"] or "").strip(), block["bbox"], block["polygon"]
    if not text or box is None or len(box) != 4:
        return None
    left, top, right, bottom = map(float, box)
    slope = None
    if outline is not None and len(outline) >= 2:
        (ax, ay), (bx, by) = outline[0][:2], outline[1][:2]
        slope = (by - ay) / (bx - ax) if bx - ax >= MIN_SPAN else None
    return Fragment(text, left, right - left, bottom - top, ((left + right) / 2, (top + bottom) / 2), slope)


def _median(values, otherwise: float) -> float:
    values = list(values)
    return median(values) if values else otherwise


def _page_rows(page: list[Fragment]) -> str:
    """One page's fragments as lines of text."""
    reach = SAME_LINE * _median((f.height for f in page if f.height > 0), 1.0)
    pitch = _median((f.width / len(f.text) for f in page if f.width > 0), 1.0)
    tilt = _median((f.slope for f in page if f.slope is not None), 0.0)
    levels = sorted(((f.middle[1] - f.middle[0] * tilt, k) for k, f in enumerate(page)))
    starts, total, count = [], 0.0, 0
    for at, (level, _) in enumerate(levels):
        # a line is as low as its fragments are on average, so it may drift
        if not count or abs(level - total / count) > reach:
            starts.append(at)
            total, count = 0.0, 0
        total, count = total + level, count + 1
    return "\n".join(_printed([page[k] for _, k in levels[a:b]], pitch) for a, b in zip(starts, [*starts[1:], len(levels)]))


def _printed(line: list[Fragment], pitch: float) -> str:
    out = ""
    for f in sorted(line, key=lambda f: f.left):
        column = round(f.left / pitch)
        out = out.ljust(max(column, len(out) + GAP) if out else column) + f.text
    return out.rstrip()


def rows_of(blocks) -> str:
    """Text of a document's blocks laid out as printed, pages apart by an empty line. Malformed and blank blocks are passed over."""
    pages: dict[int, list[Fragment]] = {}
    for block in blocks if blocks is not None else []:
        found = _fragment(block)
        if found is not None:
            pages.setdefault(1 if block["page"] is None else block["page"], []).append(found)
    return "\n\n".join(_page_rows(pages[k]) for k in sorted(pages))


@F.arrow_udf(T.StringType())
def _rows_udf(blocks: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in blocks:
        # one document's blocks as Python objects at a time: whole texts of a batch would not fit in memory
        yield pa.array((rows_of(document.as_py()) for document in a), pa.string())


def to_rows(blocks: Column) -> Column:
    """Arrow-batched: grouping into lines depends on the fragments before, which no built-in expresses."""
    return _rows_udf(blocks)


def extraction_text(blocks: Column, full_text: Column) -> Column:
    """Rebuilt rows where there are any, else the engine's own text."""
    rows = to_rows(blocks)
    return F.when(F.trim(rows) != "", rows).otherwise(full_text)


def parse_blocks(text: Column) -> Column:
    """Stored JSON back as blocks; those without text or a four-number box are left out."""
    return F.filter(F.from_json(text, BLOCKS), lambda b: (b["text"] != "") & (F.size(b["bbox"]) == 4))


def polygon_box(polygon: Column) -> Column:
    x, y = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.array(*[c.cast("int") for c in (F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))])


def mean_confidence(blocks: Column) -> Column:
    """Mean of the stated confidences; null when there is none."""
    stated = F.filter(F.transform(blocks, lambda b: b["confidence"]), lambda c: c.isNotNull())
    return F.try_divide(F.aggregate(stated, F.lit(0.0), lambda s, x: s + x), F.size(stated))


def document_medians(blocks: DataFrame) -> DataFrame:
    """Median line height and character width of each document's ``blocks(document_id, text, x0, y0, x1, y1)``."""
    tall, wide = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    return blocks.groupBy("document_id").agg(
        F.median(F.when(tall > 0, tall)).alias("line_height"),
        F.median(F.when(wide > 0, wide / F.char_length(F.trim("text")))).alias("char_width"),
    )


def parse_word_table(tables: DataFrame, text: str = "tsv") -> DataFrame:
    """Words and page sizes of a tab-separated recogniser output: level 1 is a page, level 5 a word; broken lines are passed over."""
    lines = tables.select("document_id", F.posexplode(F.split(text, "\n")).alias("no", "line"))
    p = F.split("line", "\t", 12)
    n = lambda i: F.get(p, F.lit(i)).try_cast("int")
    rows = lines.where(F.size(p) >= 12).select(
        "document_id", "no", n(0).alias("level"), n(1).alias("page"), n(6).alias("x0"), n(7).alias("y0"), n(8).alias("width"), n(9).alias("height"),
        F.get(p, F.lit(10)).try_cast("double").alias("conf"), F.trim(F.get(p, F.lit(11))).alias("text"),
    ).where("level in (1, 5) and page is not null and x0 is not null and y0 is not null and width is not null and height is not null")
    rows = rows.where("level = 1 or (text <> '' and conf is not null)")
    return rows.select("document_id", "no", F.when(F.col("level") == 1, "page").otherwise("word").alias("kind"), "page", "x0", "y0", (F.col("x0") + F.col("width")).alias("x1"), (F.col("y0") + F.col("height")).alias("y1"), F.when(F.col("conf") >= 0, F.col("conf") / 100).alias("confidence"), "text")


def text_layer_blocks(rects: DataFrame, scale: float = 2.0) -> DataFrame:
    """``rects(document_id, page, left, bottom, right, top, page_height, text)`` in PDF space to top-down boxes."""
    at = lambda c: F.round(c * scale).cast("int")
    up = lambda c: at(F.col("page_height") - F.col(c))
    return rects.select("document_id", "page", "text", F.array(at(F.col("left")), up("top"), at(F.col("right")), up("bottom")).alias("bbox"))


def usable_text_layer(blocks: DataFrame, max_pages: int = 20, min_chars: int = 20) -> DataFrame:
    """Documents whose text layer can stand in for recognition."""
    chars = F.sum(F.char_length(F.regexp_replace("text", r"(?U)\s", "")))
    return blocks.groupBy("document_id").agg(F.max("page").alias("pages"), chars.alias("chars")).where((F.col("pages") <= max_pages) & (F.col("chars") >= min_chars))


