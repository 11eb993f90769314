"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Two lines within ``max_edits`` edits of each other (insert, delete, replace a character)
share at least one of ``max_edits + 1`` even segments of the shorter line, at a place in
the longer line that a bounded number of shifts allows. Every distinct line therefore
files its own segments under (hash, segment number, length) and probes with the
substrings that a line of each admissible shorter or equal length could have as segments
(the multi-match-aware windows). For a line that shares a segment, the places beside it
that may hold the edits are halved again and again: one half of each must agree as well,
so lines that share only a segment drop out before any pair is made.

Rule: a line instance goes when an equal line, or one within ``max_edits`` edits, occurs
first at an earlier place (document id, then line number). Blank lines always stay. Lines
shorter than ``min_chars`` take part by equality only: a few edits there are another line.
So one earlier neighbour suffices: each line is first held against the first line of each
of its groups, one pair a row, which settles a family of lines that are near each other;
only lines still in doubt meet all earlier ones of their groups, and leave the join as a
pair only if the places themselves are near. Pairs are checked with a banded bit-parallel
edit distance: one word holds the ``2 * max_edits + 1`` cells of a
column's band.

No step gathers a line's copies: equal lines are folded by a partial minimum, and a
document learns only which of its own lines stay. What is still compared pairwise, place
by place inside the join, are lines that differ by more than ``max_edits`` edits, but only
in the same two small places.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

MAX_EDITS = 2
MIN_CHARS = 30


def _segment(length: Column, k: int, i: Column) -> tuple[Column, Column]:
    """(start from 1, length) of segment i of k even ones, the longer ones last."""
    base = F.floor(length / k).cast("int")
    extra = (length - base * k).cast("int")
    return i * base + F.greatest(F.lit(0), i - k + extra) + 1, base + (i >= F.lit(k) - extra).cast("int")


def _windows(max_edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift): where a segment of a line shorter by the difference can lie."""
    out = []
    for delta in range(max_edits + 1):
        for i in range(max_edits + 1):
            low, high = max(-i, delta - (max_edits - i)), min(i, delta + (max_edits - i))
            out += [(delta, i, shift) for shift in range(low, high + 1)]
    return out


#: So often the two places that may hold a line's edits are halved before lines meet as pairs.
HALVINGS = 2


#: The low bits of a line's second hash are left clear; a key's row holds its code there and so stays narrow.
_CODE_BITS = 5


def _codes(max_edits: int) -> list[tuple[int, int, int]]:
    """(difference, segment, shift) by code: first the segments a line files, then what it probes with besides those."""
    filed = [(0, i, 0) for i in range(max_edits + 1)]
    return filed + [w for w in _windows(max_edits) if w not in filed]


def segment_keys(lines: DataFrame, max_edits: int, min_chars: int, codes: range) -> DataFrame:
    """(h1, who, key) of ``lines(h1, h2, line, n)``: hashes of the segments that the codes name; who is h2 plus the code."""
    of = _codes(max_edits)
    wanted = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip((code, *of[code]), ("code", "d", "i", "s"))]) for code in codes])
    rows = lines.select("h1", "h2", "line", "n", F.explode(wanted).alias("w")).select("h1", "h2", "line", "n", "w.*", (F.col("n") - F.col("w.d")).alias("m"))
    start, size = _segment(F.col("m"), max_edits + 1, F.col("i"))
    rows = rows.where(F.col("m") >= min_chars).select("h1", "h2", "line", "n", "code", "i", "m", (start + F.col("s")).alias("at"), size.alias("size"))
    return rows.where("at >= 1 and at + size - 1 <= n").select("h1", F.col("h2").bitwiseOR(F.col("code").cast("long")).alias("who"), F.xxhash64(F.substring("line", F.col("at"), F.col("size")), "i", "m").alias("key"))


def opened(hits: DataFrame, max_edits: int) -> DataFrame:
    """``hits(h1, h2, doc, no, line, n, role, code)`` -> rows of the places that may hold the edits.

    Left of segment i are at most i edits, right of it at most ``max_edits - i``. So either
    all lie on one side (``wide``: up to two in u), or at most one in each of u and v. c and
    e say by how much u and v are longer than in the line that filed; key hashes the rest.
    """
    of = _codes(max_edits)
    hits = hits.withColumns({c: F.get(F.array(*[F.lit(x[k]) for x in of]), F.col("code")) for k, c in enumerate("dis")})
    start, size = _segment(F.col("n") - F.col("d"), max_edits + 1, F.col("i"))
    rows = hits.withColumn("at", (start + F.col("s")).cast("int")).withColumn("size", size)
    before, after = F.substring("line", F.lit(1), F.col("at") - 1), F.substring("line", F.col("at") + F.col("size"), F.col("n"))
    wide = (F.col("i") == 0) | (F.col("i") == max_edits)
    d, s = F.col("d"), F.col("s")
    key = F.xxhash64(F.substring("line", F.col("at"), F.col("size")), "i", F.col("n") - F.col("d"))
    parts = {"wide": wide, "u": F.when(wide, F.concat(before, after)).otherwise(before), "v": F.when(wide, "").otherwise(after), "c": F.when(wide, d).otherwise(s), "e": F.when(wide, 0).otherwise(d - s)}
    return rows.select("h1", "h2", "doc", "no", "role", key.alias("key"), *[x.alias(name) for name, x in parts.items()])


def halved(rows: DataFrame) -> DataFrame:
    """Each row of ``opened`` as the rows of the halves that may hold the edits; what is left out goes into the key."""

    def halves(x: Column, c: Column) -> list[tuple[Column, Column]]:
        """(clean, rest) of a place with at most one edit: either half of it is clean."""
        w = F.char_length(x) - c
        h = F.floor(w / 2).cast("int")
        return [(F.left(x, h), F.substring(x, h + 1, F.char_length(x))), (F.right(x, w - h), F.left(x, h + c))]

    def two(u: Column, v: Column, c: Column, e: Column, tag: int) -> list[Column]:
        return [_place(False, tag + 2 * j + k, (cu, cv), (u1, v1), (c, e)) for j, (cu, u1) in enumerate(halves(u, c)) for k, (cv, v1) in enumerate(halves(v, e))]

    u, v, c, e, none = F.col("u"), F.col("v"), F.col("c"), F.col("e"), F.lit("")
    w = F.char_length(u) - c
    h = F.floor(w / 2).cast("int")
    wide = [_place(True, 8 + k, (clean, none), (rest, none), (c, F.lit(0))) for k, (clean, rest) in enumerate(halves(u, c))]
    for x in (-1, 0, 1):  # one edit on each side of the middle, the second half x characters later
        fits = (F.abs(c - x) <= 1) & (h + x >= 0) & (F.col("role") == 1 if x else F.lit(True))
        wide += [F.when(fits, y) for y in two(F.left(u, h + x), F.substring(u, h + x + 1, F.char_length(u)), F.lit(x), c - x, 4)]
    found = F.explode(F.when(F.col("wide"), F.array_compact(F.array(*wide))).otherwise(F.array(*two(u, v, c, e, 0))))
    return rows.select("h1", "h2", "doc", "no", "role", "key", found.alias("x")).select("h1", "h2", "doc", "no", "role", F.xxhash64("key", "x.tag", "x.a", "x.b").alias("key"), "x.wide", "x.u", "x.v", "x.c", "x.e")


def _place(wide: bool, tag: int, clean: tuple, rest: tuple, longer: tuple) -> Column:
    values = (F.lit(wide), F.lit(tag), *clean, *rest, *(x.cast("int") for x in longer))
    return F.struct(*[x.alias(name) for x, name in zip(values, ("wide", "tag", "a", "b", "u", "v", "c", "e"))])


def _others(a: str, b: str) -> Column:
    return (F.col(f"{a}.key") == F.col(f"{b}.key")) & ((F.col(f"{a}.h1") != F.col(f"{b}.h1")) | (F.col(f"{a}.h2") != F.col(f"{b}.h2")))


def _few_edits(wide: Column, u: Column, v: Column, u2: Column, v2: Column, max_edits: int) -> Column:
    """Whether two rows with one key differ in so few characters as their places allow."""
    return F.when(wide, F.levenshtein(u, u2, max_edits) >= 0).otherwise((F.levenshtein(u, u2, 1) >= 0) & (F.levenshtein(v, v2, 1) >= 0))


def _met(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of x whose key another line has in y: a semi-join, so a crowded key makes no pairs."""
    return x.alias("x").join(y.alias("y"), _others("x", "y"), "left_semi")


def _may_be_near(x: Column, y: Column, max_edits: int) -> Column:
    """Necessary for nearness: all but ``max_edits`` of many short segments of x occur in y."""
    k = 4 * (max_edits + 1)
    length = F.char_length(x)
    found = F.lit(0)
    for i in range(k):
        start, size = _segment(length, k, F.lit(i))
        found = found + F.contains(y, F.substring(x, start, size)).cast("int")
    return found >= k - max_edits


def _trimmed(x: Column, y: Column, steps: int = 16) -> Column:
    """struct(x, y) without a common beginning and end, in sixteenths: the edit distance stays the same."""

    def shared(a: Column, b: Column, cut_at) -> Column:
        n = F.least(F.char_length(a), F.char_length(b))
        at = [F.floor(n * i / steps).cast("int") for i in range(1, steps + 1)]
        return F.greatest(F.lit(0), *[F.when(cut_at(a, k) == cut_at(b, k), k).otherwise(0) for k in at])

    def without_end(t: Column) -> Column:
        return _let(shared(t["x"], t["y"], F.right), lambda k: F.struct(*[F.left(t[c], F.char_length(t[c]) - k).alias(c) for c in "xy"]))

    ahead = _let(shared(x, y, F.left), lambda k: F.struct(F.substring(x, k + 1, F.char_length(x) - k).alias("x"), F.substring(y, k + 1, F.char_length(y) - k).alias("y")))
    return _let(ahead, without_end)


def _let(value: Column, body) -> Column:
    """Bind a value once inside an expression."""
    return F.transform(F.array(value), body)[0]


def banded_edit_distance(a: Column, b: Column, max_edits: int = MAX_EDITS) -> Column:
    """Edit distance of two strings if it is at most ``max_edits`` (1..20), else some larger number.

    Bit i of a word stands for row j - max_edits + i of column j; ``vp``/``vn`` mark rows
    one more / one less than the row above. The answer is read along the diagonal of the
    last cell, where a step costs nothing exactly when its diagonal bit is set.
    """
    k, width = max_edits, 2 * max_edits + 1
    full = (1 << width) - 1
    xs, ys = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")

    def distance(pair: Column) -> Column:
        x, y, offset = pair["x"], pair["y"], pair["offset"]
        word = lambda v: F.lit(v).cast("long")

        def step(acc: Column, j: Column) -> Column:
            c = F.get(y, j - 1)
            same = [F.when((j - k + i >= 1) & F.coalesce(F.get(x, F.greatest(j - k + i - 1, F.lit(0))) == c, F.lit(False)), word(1 << i)).otherwise(word(0)) for i in range(width)]
            match = same[0]
            for s in same[1:]:
                match = match.bitwiseOR(s)

            def with_match(m: Column) -> Column:
                vp, vn = acc["vp"], acc["vn"]
                d0 = ((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(word(full))

                def with_diagonal(d: Column) -> Column:
                    hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)).bitwiseAND(word(full)))
                    hn = d.bitwiseAND(vp)
                    down = F.shiftright(d, 1)
                    cost = F.when((j > -offset) & (d.bitwiseAND(pair["cell"]) == 0), 1).otherwise(0)
                    return F.struct(
                        hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(word(full))).alias("vp"),
                        down.bitwiseAND(hp).alias("vn"),
                        (acc["s"] + cost).cast("int").alias("s"),
                    )

                return _let(d0, with_diagonal)

            return _let(match, with_match)

        start = F.struct(word(full ^ ((1 << k) - 1)).alias("vp"), word(0).alias("vn"), F.abs(offset).cast("int").alias("s"))
        columns = F.when(F.size(y) > 0, F.sequence(F.lit(1), F.size(y))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(columns, start, step)["s"]

    offset = F.char_length(a) - F.char_length(b)
    cell = F.call_function("shiftleft", F.lit(1).cast("long"), (offset + k).cast("int"))
    given = F.struct(xs.alias("x"), ys.alias("y"), offset.alias("offset"), cell.alias("cell"))
    return F.when(F.abs(offset) > k, F.abs(offset)).otherwise(_let(given, distance))


def distinct_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, line, n, doc, no, copies): each distinct non-blank line, its first place and how often it occurs.

    A line is known by 64 and 27 bits of two hashes. The table is written in buckets of
    these, as the grouping left it, so that texts are later fetched without moving the table.
    """
    spark = docs.sparkSession
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("no", "line")).where("line rlike '\\\\S'")
    keyed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").bitwiseAND(F.lit((1 << 32) - (1 << _CODE_BITS)).cast("long")).alias("h2"), "line", "doc", "no")
    found = keyed.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.min(F.struct("doc", "no")).alias("first"), F.count("*").alias("copies"))
    found = found.select("h1", "h2", "line", F.char_length("line").alias("n"), "first.doc", "first.no", "copies")
    name = f"tallyforge_lines_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found.write.bucketBy(buckets, "h1", "h2").option("path", f"{shared_dir(spark)}/tallyforge/{name}").saveAsTable(name)
    return spark.table(name)


def _near(pairs: DataFrame, lines: DataFrame, max_edits: int) -> DataFrame:
    """``pairs(h1, h2, e1, e2)`` of a line and one before it -> the (h1, h2) of lines within ``max_edits`` edits of theirs."""
    texts = lines.select("h1", "h2", "line")
    x = pairs.join(texts.withColumnRenamed("line", "x"), ["h1", "h2"]).select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), "x", F.col("e1").alias("h1"), F.col("e2").alias("h2"))
    both = x.join(texts.withColumnRenamed("line", "y"), ["h1", "h2"]).where(_may_be_near(F.col("x"), F.col("y"), max_edits))
    trimmed = cut(both.select(F.col("l1").alias("h1"), F.col("l2").alias("h2"), _trimmed(F.col("x"), F.col("y")).alias("t")), "line-pairs")
    return trimmed.where(banded_edit_distance(F.col("t.x"), F.col("t.y"), max_edits) <= max_edits).select("h1", "h2").distinct()


def later_near_lines(lines: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct ``lines(h1, h2, line, n, doc, no)`` -> (h1, h2) of those with a line within ``max_edits`` edits before them."""
    if max_edits not in (1, 2):
        raise ValueError("one or two edits are supported: the edits are looked for in two places of a line")
    long = lines.where(F.col("n") >= min_chars)
    own = max_edits + 1
    filed, asked = (segment_keys(long, max_edits, min_chars, codes) for codes in (range(own), range(own, len(_codes(max_edits)))))

    def met(x: DataFrame, y: DataFrame, role: int) -> DataFrame:
        apart = (F.col("x.h1") != F.col("y.h1")) | (F.shiftright("x.who", _CODE_BITS) != F.shiftright("y.who", _CODE_BITS))
        found = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & apart, "left_semi")
        mask = F.lit((1 << _CODE_BITS) - 1).cast("long")
        return found.select("h1", F.col("who").bitwiseAND(F.bitwise_not(mask)).alias("h2"), F.lit(role).alias("role"), F.col("who").bitwiseAND(mask).cast("int").alias("code"))

    # lines that share a segment with another; equal segments at equal places meet as both filed and asked
    twins = met(filed, filed, 0)
    hits = twins.unionByName(twins.withColumn("role", F.lit(1))).unionByName(met(filed, asked, 0)).unionByName(met(asked, filed, 1))
    hits = cut(hits.distinct(), "segment-hits")
    rows = opened(hits.join(long.select("h1", "h2", "line", "n", "doc", "no"), ["h1", "h2"]), max_edits)
    for _ in range(HALVINGS):
        rows = cut(halved(rows), "halves")
        rows = _met(rows.where("role = 0"), rows.where("role = 1")).unionByName(_met(rows.where("role = 1"), rows.where("role = 0")))
    rows = cut(rows.select("h1", "h2", "doc", "no", "role", "key", "wide", "u", "v").distinct(), "halves-met")
    place = F.struct("doc", "no", "h1", "h2", "u", "v")
    heads = rows.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, place)).alias(f"first{r}") for r in (0, 1)])
    # first each line against the first one of its group: one pair a row
    first = F.when(F.col("role") == 1, F.col("first0")).otherwise(F.col("first1"))
    tried = rows.join(heads, "key").select("h1", "h2", place.alias("place"), "wide", "u", "v", first.alias("first")).where("first < place and (first.h1 <> h1 or first.h2 <> h2)")
    tried = tried.where(_few_edits(F.col("wide"), F.col("u"), F.col("v"), F.col("first.u"), F.col("first.v"), max_edits))
    done = cut(_near(tried.select("h1", "h2", F.col("first.h1").alias("e1"), F.col("first.h2").alias("e2")).distinct(), lines, max_edits), "near-first")
    # then lines still in doubt against all earlier ones that they share such a key with
    doubt, met_before = rows.join(done, ["h1", "h2"], "left_anti").alias("x"), rows.alias("y")
    earlier = F.struct("y.doc", "y.no", "y.h1", "y.h2") < F.struct("x.doc", "x.no", "x.h1", "x.h2")
    few = _few_edits(F.col("x.wide"), F.col("x.u"), F.col("x.v"), F.col("y.u"), F.col("y.v"), max_edits)
    pairs = doubt.join(met_before, _others("x", "y") & (F.col("x.role") != F.col("y.role")) & earlier & few)
    pairs = pairs.select("x.h1", "x.h2", F.col("y.h1").alias("e1"), F.col("y.h2").alias("e2")).distinct()
    return cut(_near(pairs, lines, max_edits), "near-more").unionByName(done)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text_col`` freed of repeated lines, plus ``n_lines`` and ``n_kept``.

    One row per input row. A null text stays null (0 lines); an empty text has one blank
    line; a document may end up with an empty text. Rows that share an id share their
    lines' places, so what stays in one stays in the other; a null id sorts first. Columns
    of the input named n_lines or n_kept are replaced; all others pass through, whatever
    their names.
    """
    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]  # the caller's names cannot clash with those used here
    docs = docs.toDF(*inner)
    id_col, text_col = (inner[names.index(c)] for c in (id_col, text_col))
    lines = distinct_lines(docs, id_col, text_col)
    later = later_near_lines(lines, max_edits, min_chars)
    stay = lines.join(later, ["h1", "h2"], "left_anti").groupBy("doc").agg(F.array_sort(F.collect_set("no")).alias("stay"))
    joined = docs.join(stay, F.col(id_col).eqNullSafe(F.col("doc")), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    blank = F.filter(F.transform(parts, lambda x, i: F.when(~x.rlike(r"\S"), i)), lambda i: i.isNotNull())
    kept = F.array_sort(F.concat(F.coalesce("stay", F.array().cast("array<int>")), blank))
    out = joined.withColumn("kept", kept).withColumn("parts", parts)
    missing = F.col(text_col).isNull()
    counts = {"n_lines": F.when(missing, 0).otherwise(F.size("parts")).cast("long"), "n_kept": F.when(missing, 0).otherwise(F.size("kept")).cast("long")}
    text = F.array_join(F.transform("kept", lambda i: F.get(F.col("parts"), i)), "\n")
    found = [(text if c == text_col else F.col(c)).alias(name) for c, name in zip(inner, names) if name not in counts]
    return out.select(*found, *[c.alias(name) for name, c in counts.items()])
