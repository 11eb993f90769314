"""Document-type definitions compiled to Catalyst expressions.

A definition is a driver-side object. ``coerce_expr`` turns a VARIANT answer into a typed
struct plus messages, ``rules_expr`` checks the typed struct, ``ledger_expr`` and
``summary_expr`` project it, and ``route_expr`` ranks definitions on a text. Everything
runs in the JVM. Amounts are ``decimal(18,4)``; in messages they have two places or as
many as they need.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_currency, clean_text, has_word, java_pattern, normalise

MONEY = "decimal(18,4)"
SPARK_TYPES = {"string": "string", "integer": "bigint", "number": "double", "money": MONEY, "date": "date", "boolean": "boolean"}
EXPECTED = {"integer": "an integer", "number": "a number", "boolean": "true or false"}
NAME = re.compile(r"[a-z][a-z0-9_]{0,48}")
MAX_OPTIONAL = 16


@dataclass(frozen=True)
class Field:
    type: str
    required: bool = False
    items: dict[str, Field] | None = None
    description: str = ""

    def ddl(self) -> str:
        if self.type != "list":
            return SPARK_TYPES[self.type]
        return "array<struct<" + ",".join(f"`{n}`:{f.ddl()}" for n, f in self.items.items()) + ">>"


@dataclass(frozen=True)
class Rule:
    """kind: required, positive, range, sum_equals, line_items_sum, not_future or regex."""

    kind: str
    field: str | None = None
    target: str | None = None
    of: tuple[str, ...] = ()
    list_field: str | None = None
    item_field: str | None = None
    minimum: str | None = None
    maximum: str | None = None
    tolerance: str = "0.02"
    grace_days: int = 1
    pattern: str | None = None
    message: str | None = None

    def reads(self) -> list[str]:
        return [n for n in (self.field, self.target, self.list_field, *self.of) if n]


@dataclass(frozen=True)
class Matchers:
    keywords: tuple[str, ...] = ()
    require_all: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    min_score: float = 0.0


@dataclass(frozen=True)
class Profile:
    tax_ids: tuple[str, ...] = ()
    name_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Canonical:
    amount: str
    direction: str = "out"
    tax_amount: str | None = None
    tax_lines: str | None = None
    occurred_on: str | None = None
    counterparty: str | None = None
    counterparty_tax_id: str | None = None
    currency: str | None = None

    def mapped(self) -> dict[str, str]:
        names = ("amount", "tax_amount", "occurred_on", "counterparty", "counterparty_tax_id", "currency")
        return {n: getattr(self, n) for n in names if getattr(self, n)}

    def reads(self) -> list[str]:
        return list(dict.fromkeys([*self.mapped().values(), *([self.tax_lines] if self.tax_lines else [])]))


@dataclass(frozen=True)
class Definition:
    name: str
    fields: dict[str, Field]
    matches: Matchers = Matchers()
    rules: tuple[Rule, ...] = ()
    profiles: dict[str, Profile] = field(default_factory=dict)
    canonical: Canonical | None = None

    def __post_init__(self):
        if not NAME.fullmatch(self.name):
            raise ValueError(f"bad name {self.name!r}")
        optional = 0
        for n, f in self.fields.items():
            if f.type not in (*SPARK_TYPES, "list"):
                raise ValueError(f"{n}: unknown type {f.type!r}")
            if f.type == "list" and not f.items:
                raise ValueError(f"{n}: a list needs item fields")
            optional += f.type != "list" and not f.required
            optional += sum(not i.required for i in (f.items or {}).values())
        if optional > MAX_OPTIONAL:
            raise ValueError(f"{optional} optional fields; at most {MAX_OPTIONAL}")
        for r in self.rules:
            for n in r.reads():
                if n not in self.fields:
                    raise ValueError(f"rule {r.kind} names no field {n!r}")
            if r.kind == "line_items_sum" and r.item_field not in (self.fields[r.list_field].items or {}):
                raise ValueError(f"{r.list_field} has no item field {r.item_field!r}")
            if r.pattern is not None:
                re.compile(r.pattern)
        for p in self.matches.patterns:
            re.compile(p)
        if self.canonical:
            kinds = {"amount": "money", "tax_amount": "money", "occurred_on": "date"}
            for column, n in self.canonical.mapped().items():
                if n not in self.fields or self.fields[n].type != kinds.get(column, "string"):
                    raise ValueError(f"canonical {column} cannot come from {n!r}")
            if self.canonical.tax_lines and self.fields[self.canonical.tax_lines].type != "list":
                raise ValueError("canonical tax_lines must be a list")

    def ddl(self) -> str:
        return "struct<" + ",".join(f"`{n}`:{f.ddl()}" for n, f in self.fields.items()) + ">"


def json_schema(d: Definition) -> dict:
    """What a model is asked to fill in: absent values are null, except that lists are always lists."""
    plain = {"string": {"type": "string"}, "integer": {"type": "integer"}, "number": {"type": "number"}, "boolean": {"type": "boolean"}, "money": {"type": "string", "pattern": r"^-?\d+([.,]\d{1,2})?$"}, "date": {"type": "string", "format": "date"}}

    def one(f: Field) -> dict:
        if f.type == "list":
            made = {"type": "array", "items": node(f.items)}
        else:
            made = plain[f.type] if f.required else {"anyOf": [plain[f.type], {"type": "null"}]}
        return made | ({"description": f.description} if f.description else {})

    def node(fields: dict[str, Field]) -> dict:
        return {"type": "object", "properties": {n: one(f) for n, f in fields.items()}, "required": list(fields), "additionalProperties": False}

    return node(d.fields)


# ---- rendering values in messages


def quoted(text: Column) -> Column:
    """A string as it would be written in source: single quotes unless only those occur inside."""
    safe = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")], text)
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'")))


def amount_text(value: Column) -> Column:
    return F.regexp_replace(value.cast("decimal(28,4)").cast("string"), r"(\.\d\d)(\d*?)0+$", "$1$2")


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; also keeps the optimizer from copying it into each use."""
    return F.transform(F.array(value), body)[0]


def _schema(v: Column) -> Column:
    return F.when(v.isNotNull(), F.schema_of_variant(v))


def _named(schema: Column) -> Column:
    return (
        F.when(schema == "STRING", "str").when(schema == "BIGINT", "int").when(schema.startswith("OBJECT"), "dict").when(schema.startswith("ARRAY"), "list").when(schema == "BOOLEAN", "bool")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "float")
    )


def _kind(v: Column) -> Column:
    """int, float, bool, str, list, dict; null for an absent or null value."""
    return bind(_schema(v), _named)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _shown(v: Column, kind: Column) -> Column:
    return F.when(kind == "str", quoted(_text(v))).when(kind == "bool", F.initcap(_text(v))).when(kind.isin("list", "dict"), F.to_json(v)).when((kind == "float") & _text(v).rlike(r"^-?\d+$"), F.concat(_text(v), F.lit(".0"))).otherwise(_text(v))


# ---- coercion


def _part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _scalar(f: Field, v: Column, kind: Column, text: Column, path: Column | None = None) -> tuple[Column, Callable[[], Column]]:
    """(value, what makes its message or null) of one answer value; the message is for values that are null."""
    say = lambda *parts: F.concat(path, F.lit(": "), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    if f.type == "string":
        return F.when(kind == "str", text), lambda: F.when(kind != "str", say("expected a string, got ", kind))
    if f.type == "money":
        trimmed = F.trim(text)
        fits = trimmed.rlike(r"^-?\d+([.,]\d{1,2})?$")
        numeric = kind.isin("int", "float")
        value = F.when(numeric, F.try_variant_get(v, "$", MONEY)).when((kind == "str") & fits, F.translate(trimmed, ",", ".").try_cast(MONEY))
        bad = lambda: (
            F.when(kind == "bool", say("expected an amount, got ", _shown(v, kind)))
            .when(kind.isin("list", "dict"), say("expected an amount, got ", kind))
            .when((kind == "str") & ~fits, say("expected an amount like '1234.56' or '1234,56', got ", quoted(text)))
            .otherwise(say("the amount is out of range: ", text))
        )
        return value, bad
    if f.type == "date":
        trimmed = F.trim(text)
        shaped = (kind == "str") & trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$")
        return F.when(shaped, trimmed.try_cast("date")), lambda: F.when(shaped, say(quoted(text), " is not a real date")).otherwise(say("expected a date as YYYY-MM-DD, got ", _shown(v, kind)))
    accepted = {"integer": ("int",), "number": ("int", "float"), "boolean": ("bool",)}[f.type]
    value = F.when(kind.isin(*accepted), F.try_variant_get(v, "$", SPARK_TYPES[f.type]))
    return value, lambda: F.when(~kind.isin(*accepted), say(f"expected {EXPECTED[f.type]}, got ", _shown(v, kind)))


def _field(f: Field, given: Column, path: Column) -> Column:
    """struct(v: value, e: messages). Value, kind, text and result are each bound once: expressions in lambdas are not shared otherwise."""
    none = F.array().cast("array<string>")

    def scalar(v: Column) -> Column:
        def told(k: Column) -> Column:
            value, bad = _scalar(f, v, k["kind"], k["text"], path)
            return bind(value.cast(f.ddl()), lambda x: F.struct(x.alias("v"), F.when(x.isNull() & k["kind"].isNotNull(), F.array_compact(F.array(bad()))).otherwise(none).alias("e")))

        return bind(F.struct(_kind(v).alias("kind"), _text(v).alias("text")), told)

    def entry(e: Column, i: Column) -> Column:
        here = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))

        def parts(kind: Column) -> Column:
            fine = F.coalesce(kind == "dict", F.lit(False))
            wrong = F.concat(here, F.lit(": expected an object, got "), F.coalesce(kind, F.lit("NoneType")))
            made = F.struct(*[_field(g, F.when(fine, _part(e, n)), F.concat(here, F.lit(f".{n}"))).alias(n) for n, g in f.items.items()])
            return bind(made, lambda p: F.struct(F.struct(*[p[n]["v"].alias(n) for n in f.items]).alias("v"), F.when(fine, F.flatten(F.array(*[p[n]["e"] for n in f.items]))).otherwise(F.array(wrong)).alias("e")))

        return bind(_kind(e), parts)

    def listed(v: Column) -> Column:
        def entries(kind: Column) -> Column:
            wrong = F.array(F.concat(path, F.lit(": expected a list of entries, got "), kind))
            done = F.transform(F.when(kind == "list", F.try_variant_get(v, "$", "array<variant>")), entry)
            return bind(done, lambda x: F.struct(
                F.transform(x, lambda y: y["v"]).cast(f.ddl()).alias("v"),
                F.when(kind.isNotNull() & (kind != "list"), wrong).otherwise(F.coalesce(F.flatten(F.transform(x, lambda y: y["e"])), none)).alias("e"),
            ))

        return bind(_kind(v), entries)

    return bind(given, listed if f.type == "list" else scalar)


def coerce_expr(d: Definition, answer: Column) -> Column:
    """struct(values, errors) of a VARIANT answer: never fails, keeps every declared field, drops the rest."""

    def whole_answer(a: Column) -> Column:
        def read(kind: Column) -> Column:
            whole = F.coalesce(kind == "dict", F.lit(False))
            wrong = F.array(F.concat(F.lit("expected an object, got "), F.coalesce(kind, F.lit("NoneType"))))
            parts = F.struct(*[_field(f, F.when(whole, _part(a, n)), F.lit(n)).alias(n) for n, f in d.fields.items()])
            return bind(parts, lambda p: F.struct(
                F.struct(*[p[n]["v"].alias(n) for n in d.fields]).alias("values"),
                F.when(whole, F.flatten(F.array(*[p[n]["e"] for n in d.fields]))).otherwise(wrong).alias("errors"),
            ))

        return bind(_kind(a), read)

    return bind(answer, whole_answer)


def _value(f: Field, given: Column) -> Column:
    """The value of ``_field`` alone. What has no such part, or is no list, gives null."""
    if f.type == "list":
        entry = lambda e: F.struct(*[_value(g, _part(e, n)).alias(n) for n, g in f.items.items()])
        return F.transform(F.try_variant_get(given, "$", "array<variant>"), entry).cast(f.ddl())
    told = lambda v: lambda k: _scalar(f, v, k["kind"], k["text"])[0].cast(f.ddl())
    return bind(given, lambda v: bind(F.struct(_kind(v).alias("kind"), _text(v).alias("text")), told(v)))


def coerce_frame(rows: DataFrame, d: Definition, answer: Column) -> DataFrame:
    """The rows with ``values``, those of ``coerce_expr``; for questions that need no messages.

    Lambdas are interpreted. Here a value is bound by a projection instead, which is compiled and which the optimizer
    keeps apart where its result is used more than once; fields that nobody reads are pruned. A list stays an
    expression in the last projection, so it is coerced only where it is read.
    """
    own = [F.col(f"`{n}`") for n in rows.columns]
    fields = list(enumerate(d.fields.values()))
    lists, scalars = [(k, f) for k, f in fields if f.type == "list"], [(k, f) for k, f in fields if f.type != "list"]
    at = lambda step, k: F.col(f"__{step}{k}")
    parts = [at("part", k) for k, _ in fields]
    steps = [
        [answer.alias("__answer")],
        [_part(F.col("__answer"), n).alias(f"__part{k}") for k, n in enumerate(d.fields)],
        parts + [_schema(at("part", k)).alias(f"__schema{k}") for k, _ in scalars],
        parts + [x for k, _ in scalars for x in (_named(at("schema", k)).alias(f"__kind{k}"), _text(at("part", k)).alias(f"__text{k}"))],
        [at("part", k) for k, _ in lists] + [_scalar(f, at("part", k), at("kind", k), at("text", k))[0].cast(f.ddl()).alias(f"__value{k}") for k, f in scalars],
        [F.struct(*[(_value(f, at("part", k)) if f.type == "list" else at("value", k)).alias(n) for k, (n, f) in enumerate(d.fields.items())]).alias("values")],
    ]
    return reduce(lambda made, step: made.select(*own, *step), steps, rows)


# ---- rules


def _absent(f: Field, v: Column) -> Column:
    return v.isNull() | (F.size(v) == 0) if f.type == "list" else v.isNull()


def _rule(d: Definition, r: Rule, values: Column, today: Column) -> Column:
    """The rule's message, or null when it passes or has nothing to check."""
    of = lambda n: values[n]
    lit = lambda x: F.lit(x).cast(MONEY)
    numeric = lambda n: d.fields[n].type in ("money", "integer", "number")
    say = lambda *parts: F.lit(r.message) if r.message else F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def no_number(names) -> Column | None:
        bad = [n for n in names if not numeric(n)]
        return F.concat_ws("; ", *[F.concat(F.lit(f"{n} is not a number ("), quoted(of(n).cast("string")), F.lit(")")) for n in bad]) if bad else None

    if r.kind == "required":
        f, v = d.fields[r.field], of(r.field)
        missing = _absent(f, v) | (F.trim(v) == "" if f.type == "string" else F.lit(False))
        return F.when(missing, say(f"{r.field} is required but was not extracted"))
    ready = reduce(lambda a, b: a & b, [~_absent(d.fields[n], of(n)) for n in r.reads()])
    if r.kind in ("positive", "range"):
        if r.kind == "range" and r.minimum is None and r.maximum is None:
            return F.lit(None).cast("string")
        problem = no_number([r.field])
        if problem is not None:
            return F.when(ready, say(problem, ", so it cannot be checked " + ("for being positive" if r.kind == "positive" else "against its range")))
        v = of(r.field)
        shown = amount_text(v) if d.fields[r.field].type == "money" else v.cast("string")
        if r.kind == "positive":
            return F.when(ready & (v <= 0), say(f"{r.field} must be greater than 0, got ", shown))
        low = F.when(ready & (v < F.lit(r.minimum).cast(MONEY)), say(f"{r.field} must be at least {r.minimum}, got ", shown)) if r.minimum is not None else F.lit(None)
        high = F.when(ready & (v > F.lit(r.maximum).cast(MONEY)), say(f"{r.field} must be at most {r.maximum}, got ", shown)) if r.maximum is not None else F.lit(None)
        return F.coalesce(low.cast("string"), high.cast("string"))
    if r.kind == "sum_equals":
        label = " + ".join(r.of)
        problem = no_number([r.target, *r.of])
        if problem is not None:
            return F.when(ready, say(f"cannot check {label} = {r.target}: ", problem))
        total = reduce(lambda a, b: a + b, [of(n).cast(MONEY) for n in r.of]).cast("decimal(28,4)")
        target = of(r.target).cast(MONEY)
        return F.when(ready & (F.abs(total - target) > lit(r.tolerance)), say(f"{label} = ", amount_text(total), f", which does not match {r.target} (", amount_text(target), f") within {r.tolerance}"))
    if r.kind == "line_items_sum":
        label, entries = f"{r.list_field}[].{r.item_field}", of(r.list_field)
        amounts = F.transform(entries, lambda e: e[r.item_field].cast(MONEY))
        total = F.aggregate(amounts, F.lit(0).cast("decimal(28,4)"), lambda s, x: (s + F.coalesce(x, F.lit(0).cast(MONEY))).cast("decimal(28,4)"))
        holes = F.array_compact(F.transform(amounts, lambda x, i: F.when(x.isNull(), F.concat(F.lit(f"{r.list_field}["), i.cast("string"), F.lit(f"].{r.item_field} is null")))))
        target = of(r.target).cast(MONEY)
        return F.when(ready & (F.size(holes) > 0), say(f"cannot check {label} = {r.target}: ", F.array_join(holes, "; "))).when(
            ready & (F.abs(total - target) > lit(r.tolerance)), say(f"{label} sums to ", amount_text(total), f", which does not match {r.target} (", amount_text(target), f") within {r.tolerance}")
        )
    if r.kind == "not_future":
        if d.fields[r.field].type != "date":
            return F.when(ready, say(f"{r.field} is not a date, so it cannot be compared to today"))
        return F.when(ready & (of(r.field) > F.date_add(today, r.grace_days)), say(f"{r.field} is ", of(r.field).cast("string"), ", which is after today (", today.cast("string"), f") plus {r.grace_days} day(s) of grace"))
    if r.kind == "regex":
        if d.fields[r.field].type != "string":
            return F.when(ready, say(f"{r.field} is not a string, so it cannot be pattern-matched"))
        return F.when(ready & ~of(r.field).rlike("(?U)" + r.pattern), say(f"{r.field} (", quoted(of(r.field)), ") does not match ", quoted(F.lit(r.pattern))))
    raise ValueError(f"unknown rule {r.kind!r}")


def rules_expr(d: Definition, values: Column, today: dt.date) -> Column:
    """Messages of all rules in declared order."""
    if not d.rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[_rule(d, r, values, F.lit(today)).cast("string") for r in d.rules]))


# ---- routing


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def evidence_expr(d: Definition, text: Column) -> Column:
    """struct(hits, score); both zero below the type's minimum share or without a required term."""
    return bind(F.struct(text.alias("text"), normalise(text).alias("folded")), lambda t: _evidence(d, t["text"], t["folded"]))


def _evidence(d: Definition, text: Column, haystack: Column) -> Column:
    m = d.matches
    signals = len(m.keywords) + len(m.patterns)
    if signals:
        return bind(_signal_hits(m, text, haystack), lambda hits: _counted(m, hits, hits.cast("double") / F.lit(float(signals)), haystack))
    return _counted(m, F.lit(len(m.require_all)), F.lit(1.0 if m.require_all else 0.0), haystack)


def _signal_hits(m: Matchers, text: Column, haystack: Column) -> Column:
    return reduce(lambda a, b: a + b, [has_word(haystack, k).cast("int") for k in m.keywords] + [text.rlike(java_pattern(p)).cast("int") for p in m.patterns], F.lit(0))


def _counted(m: Matchers, hits: Column, score: Column, haystack: Column) -> Column:
    counts = F.coalesce(_all([has_word(haystack, t) for t in m.require_all]) & (score >= m.min_score), F.lit(False))
    return bind(counts, lambda c: F.struct(F.when(c, hits).otherwise(0).alias("hits"), F.when(c, score).otherwise(0.0).alias("score")))


def scores_expr(definitions: list[Definition], text: Column) -> Column:
    """Name -> evidence; the text is normalised once for all definitions."""
    both = F.struct(text.alias("text"), normalise(text).alias("folded"))
    return bind(both, lambda t: F.create_map(*[x for d in definitions for x in (F.lit(d.name), _evidence(d, t["text"], t["folded"]))]))


def route_expr(definitions: list[tuple[Definition, bool]], text: Column) -> Column:
    """struct(name, hits, score, dedicated) of the best of (definition, dedicated); null without a hit.

    Ranked by hits, then score, then dedicated; ties go to the first name.
    """
    ordered = sorted(definitions, key=lambda x: x[0].name, reverse=True)

    def entry(place: int, d: Definition, dedicated: bool, t: Column) -> Column:
        return bind(_evidence(d, t["text"], t["folded"]), lambda e: F.struct(e["hits"].alias("hits"), e["score"].alias("score"), F.lit(dedicated).alias("dedicated"), F.lit(place).alias("place"), F.lit(d.name).alias("name")))

    def best(t: Column) -> Column:
        return F.array_max(F.array(*[entry(place, d, dedicated, t) for place, (d, dedicated) in enumerate(ordered)]))

    both = F.struct(text.alias("text"), normalise(text).alias("folded"))
    return bind(bind(both, best), lambda b: F.when(b["hits"] > 0, F.struct(b["name"].alias("name"), b["hits"].alias("hits"), b["score"].alias("score"), b["dedicated"].alias("dedicated"))))


def profile_expr(d: Definition, text: Column) -> Column:
    """Key of the issuer profile: any tax id of any profile first, then name patterns, each in declared order."""
    haystack, out = normalise(text), F.lit(None).cast("string")
    steps = [(F.contains(haystack, F.lit(" ".join(t.split()).casefold())), k) for k, p in d.profiles.items() for t in p.tax_ids]
    steps += [(text.rlike(java_pattern(n)), k) for k, p in d.profiles.items() for n in p.name_patterns]
    for hit, key in reversed(steps):
        out = F.when(hit, F.lit(key)).otherwise(out)
    return out


# ---- canonical projections


def tax_sum(lines: Column) -> Column:
    """Sum of the entries' amounts; null when there is none or one is unreadable."""
    readable = (F.size(lines) > 0) & F.forall(lines, lambda e: e["amount"].isNotNull())
    return F.when(readable, F.aggregate(lines, F.lit(0).cast("decimal(28,4)"), lambda s, e: (s + e["amount"]).cast("decimal(28,4)")).cast(MONEY))


def ledger_reason(d: Definition, values: Column) -> Column:
    """Why there is no ledger row, or null; only the amount is looked at."""
    c = d.canonical
    if c is None:
        return F.lit(f"{d.name} has no canonical mapping")
    return F.when(values[c.amount].isNull(), f"{c.amount} is null, so there is no amount to record")


def ledger_expr(d: Definition, values: Column) -> Column:
    """struct(row, reason): a ledger row, or why there is none."""
    c, none = d.canonical, lambda kind: F.lit(None).cast(kind)
    get = lambda n, kind: values[n] if n else none(kind)
    amount = get(c.amount if c else None, MONEY)
    tax = get(c.tax_amount if c else None, MONEY)
    if c and c.tax_lines and (d.fields[c.tax_lines].items or {}).get("amount", Field("string")).type == "money":
        tax = F.coalesce(tax, bind(values[c.tax_lines], tax_sum))
    row = F.struct(
        F.lit(d.name).alias("source_type"), F.lit(c.direction if c else None).cast("string").alias("direction"), amount.cast(MONEY).alias("amount"), tax.cast(MONEY).alias("tax_amount"),
        get(c.occurred_on if c else None, "date").alias("occurred_on"), clean_text(get(c.counterparty if c else None, "string"), 200).alias("counterparty"),
        clean_text(get(c.counterparty_tax_id if c else None, "string"), 50).alias("counterparty_tax_id"), clean_currency(get(c.currency if c else None, "string")).alias("currency"),
    )
    reason = ledger_reason(d, values)
    return F.struct(F.when(reason.isNull(), row).alias("row"), reason.alias("reason"))


def summary_expr(d: Definition, values: Column) -> Column:
    """What the documents list shows; gaps where nothing was read."""
    c = d.canonical
    get = lambda n, kind: values[n] if n else F.lit(None).cast(kind)
    return F.struct(
        F.lit(d.name).alias("doc_type"), clean_text(get(c and c.counterparty, "string"), 200).alias("supplier"), get(c and c.occurred_on, "date").alias("document_date"),
        get(c and c.amount, MONEY).alias("total_amount"), clean_currency(get(c and c.currency, "string")).alias("total_currency"),
    )


def derived_columns_expr(d: Definition, values: Column, derived: Column) -> Column:
    """Ledger columns that a transform worked out, given the changed fields."""
    c = d.canonical
    if c is None:
        return F.array().cast("array<string>")
    found = [F.when(F.array_contains(derived, n), F.lit(column)) for column, n in c.mapped().items()]
    if c.tax_lines:
        fell_back = values[c.tax_amount].isNull() if c.tax_amount else F.lit(True)
        direct = F.array_contains(derived, c.tax_amount) if c.tax_amount else F.lit(False)
        found.append(F.when(F.array_contains(derived, c.tax_lines) & fell_back & ~direct, F.lit("tax_amount")))
    return F.array_compact(F.array(*found))


def changed_fields_expr(d: Definition, before: Column, after: Column) -> Column:
    return F.array_compact(F.array(*[F.when(~before[n].eqNullSafe(after[n]), F.lit(n)) for n in d.fields]))


def invoice_total_expr(values: Column) -> Column:
    """The built-in invoice transform as an expression: a missing total is worked out from what was printed."""
    zero = F.lit(0).cast(MONEY)
    lines = values["taxes"]
    none_read = F.coalesce(F.exists(lines, lambda e: e["amount"].isNull()), F.lit(False))
    summed = F.coalesce(F.aggregate(lines, F.lit(0).cast("decimal(28,4)"), lambda s, e: (s + e["amount"]).cast("decimal(28,4)")).cast(MONEY), zero)
    tax = F.coalesce(values["tax_amount"], F.when(~none_read, summed))
    worked_out = (values["subtotal"] - F.coalesce(values["discount"], zero) + tax).cast(MONEY)
    return values.withField("total", F.coalesce(values["total"], worked_out))


def process_expr(d: Definition, answer: Column, today: dt.date, transform=None) -> Column:
    """struct(values, errors, derived): coerce, transform (a values -> values expression), check."""

    def processed(read: Column) -> Column:
        changed = transform(read["values"]) if transform else read["values"]
        return bind(changed, lambda values: F.struct(
            values.alias("values"),
            F.concat(read["errors"], rules_expr(d, values, today)).alias("errors"),
            (changed_fields_expr(d, read["values"], values) if transform else F.array().cast("array<string>")).alias("derived"),
        ))

    return bind(coerce_expr(d, answer), processed)
