"""Scalar functions as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(14,4)"
COST = "decimal(12,6)"


def money_text(value: Column) -> Column:
    """Two decimals unless there are genuinely more: 10 -> 10.00, 10.1230 -> 10.123."""
    text = value.cast(MONEY).cast("string")
    return F.regexp_replace(text, r"(\.\d\d)(\d*?)0+$", "$1$2")


def usd(value: Column, precision: int = 18) -> Column:
    """Six places, half to even."""
    return F.bround(value, 6).cast(f"decimal({precision},6)")


def parse_money(text: Column) -> Column:
    """Decimal of a plain amount with at most two decimals after a point or comma, else null."""
    cleaned = F.trim(text)
    fits = cleaned.rlike(r"^-?\d+([.,]\d{1,2})?$")
    return F.when(fits, F.translate(cleaned, ",", ".").try_cast(MONEY))


def parse_date(text: Column) -> Column:
    cleaned = F.trim(text)
    return F.when(cleaned.rlike(r"^\d{4}-\d{2}-\d{2}$"), cleaned.try_cast("date"))


def clean_text(text: Column, limit: int) -> Column:
    cleaned = F.left(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(limit))
    return F.when(cleaned != "", cleaned)


def clean_currency(text: Column) -> Column:
    cleaned = F.trim(text)
    return F.when(cleaned.rlike("^[A-Za-z]{3}$"), F.upper(cleaned))


def formula_guard(text: Column) -> Column:
    """A leading quote in front of what a spreadsheet would run."""
    return F.regexp_replace(text, r"^([=+\-@\t\r])", "'$1")


def fold_case(text: Column) -> Column:
    """Lower case plus the foldings that lower() lacks."""
    out = F.lower(text)
    for sign, folded in (("ß", "ss"), ("ſ", "s"), ("ς", "σ"), ("ŉ", "ʼn"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        out = F.replace(out, F.lit(sign), F.lit(folded))
    return out


def normalise(text: Column) -> Column:
    """Runs of white space become one blank; case is folded. For routing."""
    return fold_case(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise_answer(text: Column) -> Column:
    """As ``normalise``, trimmed. For scoring."""
    return F.trim(normalise(text))


def java_pattern(pattern: str) -> str:
    """A search pattern written for Unicode-aware, case-blind matching, for the JVM."""
    return "(?iuU)" + pattern


def has_word(haystack: Column, keyword: str) -> Column:
    """The keyword as a whole word or phrase of a normalised text: only letters count as part of a word."""
    folded = " ".join(keyword.split()).casefold()
    escaped = "".join(c if c.isalnum() or c == " " else "\\" + c for c in folded)
    letter = r"[\p{L}\p{Nl}\p{No}]"
    return haystack.rlike(f"(?<!{letter}){escaped}(?!{letter})")


def collapse_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\[\d+\]", "[]")


def type_label(name: Column) -> Column:
    spaced = F.translate(name, "_", " ")
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.lower(F.substring(spaced, 2, 1 << 30)))


def month_key(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("undated"))


def duration_text(seconds: Column) -> Column:
    """340 ms, 2.4 s, 3 min, 1.2 h."""
    return (
        F.when(seconds < 1, F.concat(F.round(seconds * 1000).cast("int").cast("string"), F.lit(" ms")))
        .when(seconds < 60, F.concat(F.format_string("%.1f", F.bround(seconds, 1)), F.lit(" s")))
        .when(seconds < 3600, F.concat(F.round(seconds / 60).cast("int").cast("string"), F.lit(" min")))
        .otherwise(F.concat(F.format_string("%.1f", F.bround(seconds / 3600, 1)), F.lit(" h")))
    )


def backoff_seconds(attempts: Column) -> Column:
    return F.pow(F.lit(4.0), attempts.cast("double")).cast("long")


def clamp_limit(limit: int, most: int = 200) -> int:
    return max(1, min(limit, most))


def fit_filename(name: Column, most: int = 255) -> Column:
    """Keeps the tail of a long name behind an ellipsis."""
    return F.when(F.char_length(name) > most, F.concat(F.lit("…"), F.right(name, F.lit(most - 1)))).otherwise(name)


def storage_key(organisation: Column, digest: Column) -> Column:
    return F.concat_ws("/", F.lit("raw"), organisation, F.left(digest, F.lit(2)), digest)


def sniff_mime(content: Column) -> Column:
    """Media type from the first bytes; null when unknown."""
    head = lambda start, n: F.hex(F.substring(content, start, n))
    brand = head(9, 4)
    heic = F.array(*[F.lit(b.encode().hex().upper()) for b in ("heic", "heix", "hevc", "mif1")])
    return (
        F.when(head(1, 3) == "FFD8FF", "image/jpeg")
        .when(head(1, 8) == "89504E470D0A1A0A", "image/png")
        .when(head(1, 5) == "255044462D", "application/pdf")
        .when(head(1, 4).isin("49492A00", "4D4D002A"), "image/tiff")
        .when((head(1, 4) == "52494646") & (brand == "57454250"), "image/webp")
        .when((head(5, 4) == "66747970") & F.array_contains(heic, brand), "image/heic")
    )
