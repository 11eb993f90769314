"""What a client sees of a document: its result, and its fields as a page shows them.

All of it is one projection over left joins: documents with their current extraction and
current ledger row. Values are coerced against the version of the type that read them;
each known version is compiled into the projection, so no row calls back to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import money_text
from . import definitions as D
from .listing import outcome

# fixed values: words of field names that are read in capitals, and messages said in other words to clients
ACRONYMS = {
    "id": "ID", "po": "PO", "vat": "VAT", "iva": "IVA", "iban": "IBAN", "bic": "BIC", "swift": "SWIFT", "nif": "NIF", "cif": "CIF",
    "nit": "NIT", "url": "URL", "sku": "SKU", "ean": "EAN", "eori": "EORI", "uk": "UK", "eu": "EU", "us": "US",
}
PLAIN_WORDS = {"is required but was not extracted": "is required, but wasn't found on the document"}

#: (doc_type, version) -> definition
Versions = dict[tuple[str, int], D.Definition]


def field_label(name: Column) -> Column:
    """vendor_tax_id -> Vendor tax ID; a name of underscores only stays as it is."""
    known = F.create_map(*[F.lit(x) for pair in ACRONYMS.items() for x in pair])
    words = F.filter(F.split(name, "_"), lambda w: w != "")
    shown = F.transform(words, lambda w, i: F.coalesce(F.element_at(known, w), F.when(i == 0, F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.char_length(w))))).otherwise(w)))
    return F.when(F.size(words) > 0, F.array_join(shown, " ")).otherwise(name)


# ---- values


def _wire(f: D.Field, v: Column) -> Column:
    if f.type == "money":
        return D.amount_text(v)
    if f.type == "date":
        return v.cast("string")
    if f.type == "list":
        return F.transform(v, lambda e: F.struct(*[_wire(g, e[n]).alias(n) for n, g in f.items.items()]))
    return v


def wire_expr(d: D.Definition, values: Column) -> Column:
    """Typed values as JSON: every declared field, amounts and dates as text, what is missing as null."""
    return F.to_json(F.struct(*[_wire(f, values[n]).alias(n) for n, f in d.fields.items()]), {"ignoreNullFields": "false"})


def _by_version(versions: Versions, doc_type: Column, version: Column, body, otherwise: Column) -> Column:
    out = otherwise
    for (name, number), d in versions.items():
        out = F.when((doc_type == name) & (version == number), body(d)).otherwise(out)
    return out


def normalised_expr(versions: Versions, doc_type: Column, version: Column, raw_json: Column, transformed_json: Column) -> Column:
    """JSON of the values behind the ledger: the transform's output, or what was read, coerced by the version that read it.

    A version that is not known (any more) leaves the values as they are stored.
    """
    stored = F.coalesce(transformed_json, raw_json)
    coerced = lambda d: D.bind(D.coerce_expr(d, F.try_parse_json(stored)), lambda c: wire_expr(d, c["values"]))
    return F.when(stored.isNotNull(), _by_version(versions, doc_type, version, coerced, stored))


def document_results(documents: DataFrame, extractions: DataFrame, transactions: DataFrame, versions: Versions) -> DataFrame:
    """One row a document, whatever state it is in.

    ``extractions`` and ``transactions`` are the current ones, at most one a document.
    Without an extraction everything that comes from one is null, lists are empty.
    """
    e = extractions.select("document_id", F.lit(True).alias("read_"), *[F.col(c).alias(f"e_{c}") for c in ("doc_type", "schema_version", "profile", "raw_json", "transformed_json", "derived_fields", "validation_errors", "created_at")])
    t = transactions.select("document_id", F.struct(
        F.col("transaction_id").alias("id"), "direction", money_text(F.col("amount")).alias("amount"), money_text(F.col("tax_amount")).alias("tax_amount"),
        "currency", F.col("occurred_on").cast("string").alias("occurred_on"), "counterparty").alias("transaction"))
    none = F.array().cast("array<string>")
    rows = documents.select("document_id", "status").join(e, "document_id", "left").join(t, "document_id", "left")
    return rows.select(
        "document_id", "status", outcome(F.col("status")).alias("outcome"),
        F.when(F.col("read_"), F.struct(F.col("e_doc_type").alias("name"), F.col("e_schema_version").alias("version"), F.col("e_profile").alias("profile"))).alias("processor"),
        normalised_expr(versions, F.col("e_doc_type"), F.col("e_schema_version"), F.col("e_raw_json"), F.col("e_transformed_json")).alias("data"),
        F.col("e_raw_json").alias("read"), F.coalesce("e_derived_fields", none).alias("derived"), F.coalesce("e_validation_errors", none).alias("problems"),
        "transaction", F.col("e_created_at").alias("extracted_at"),
    )


# ---- problems


def readable_expr(d: D.Definition, message: Column) -> Column:
    """A message with field names as labels: with a capital where it begins, in lower case inside unless it is an acronym."""
    names = sorted(d.fields, key=lambda n: (-len(n), n))
    # names are marked first and written out afterwards, so a label is never read as a name; each step uses the text once
    text = message
    for k, name in enumerate(names):
        text = F.regexp_replace(F.regexp_replace(text, rf"(?U)^{name}\b", f"\x01{k}\x03"), rf"(?U)\b{name}\b", f"\x01{k}\x02")
    for k, name in enumerate(names):
        label = field_label(F.lit(name))
        inside = F.when(F.substring_index(label, " ", 1).rlike("^[^a-z]+$"), label).otherwise(F.concat(F.lower(F.left(label, F.lit(1))), F.substring(label, F.lit(2), F.char_length(label))))
        text = F.replace(F.replace(text, F.lit(f"\x01{k}\x03"), label), F.lit(f"\x01{k}\x02"), inside)
    for said, meant in PLAIN_WORDS.items():
        text = F.replace(text, F.lit(said), F.lit(meant))
    return D.bind(text, lambda m: F.concat(F.upper(F.left(m, F.lit(1))), F.substring(m, F.lit(2), F.char_length(m))))


def problems_expr(d: D.Definition, errors: Column) -> Column:
    """Array of struct(field, text) in the messages' order; field is null for what is about none."""
    names = F.array(*[F.lit(n) for n in d.fields])

    def one(message: Column) -> Column:
        lead = F.regexp_extract(message, "^[a-z][a-z0-9_]*", 0)
        return F.struct(F.when(F.array_contains(names, lead), lead).alias("field"), readable_expr(d, message).alias("text"))

    return F.transform(F.coalesce(errors, F.array().cast("array<string>")), one)


def problem_of(problems: Column, name: str) -> Column:
    """All messages about a field as one text; null when there is none."""
    mine = F.transform(F.filter(problems, lambda p: p["field"] == name), lambda p: p["text"])
    return F.when(F.size(mine) > 0, F.array_join(mine, " "))


def general_problems(problems: Column) -> Column:
    return F.transform(F.filter(problems, lambda p: p["field"].isNull()), lambda p: p["text"])


# ---- fields


def is_required(d: D.Definition, name: str) -> bool:
    return d.fields[name].required or any(r.kind == "required" and r.field == name for r in d.rules)


def fields_expr(d: D.Definition, data: Column, errors: Column, derived: Column, corrected: Column, places: Column) -> Column:
    """Array of the fields in declared order, as a page shows them.

    ``data`` and ``places`` are JSON (of ``wire_expr`` and ``locate_expr``), ``corrected`` a
    map of name to struct(by, at, was). A derived value has no place: it was not printed.
    A list's rows are replaced whole, so there is no one value it was.
    """

    def entry(name: str, f: D.Field, g: Column) -> Column:
        change = F.element_at(g["corrected"], name)
        was = F.lit(None).cast("string") if f.type == "list" else change["was"]
        worked_out = F.coalesce(F.array_contains(g["derived"], name), F.lit(False))
        place = F.get_json_object(g["places"], f"$.{name}")
        columns = F.array(*[F.struct(F.lit(c).alias("name"), field_label(F.lit(c)).alias("label"), F.lit(x.type).alias("type")) for c, x in (f.items or {}).items()])
        return F.struct(
            F.lit(name).alias("name"), field_label(F.lit(name)).alias("label"), F.lit(f.type).alias("type"), F.lit(is_required(d, name)).alias("required"),
            worked_out.alias("derived"), problem_of(g["problems"], name).alias("problem"),
            F.when(change.isNotNull(), F.struct(change["by"].alias("by"), change["at"].alias("at"), was.alias("was"))).alias("corrected"),
            F.get_json_object(g["data"], f"$.{name}").alias("value"),
            (F.lit(None).cast("string") if f.type == "list" else F.when(~worked_out, place)).alias("location"),
            (columns if f.items else F.lit(None).cast("array<struct<name:string,label:string,type:string>>")).alias("columns"),
        )

    given = F.struct(data.alias("data"), derived.alias("derived"), corrected.alias("corrected"), places.alias("places"), problems_expr(d, errors).alias("problems"))
    return D.bind(given, lambda g: F.array(*[entry(n, f, g) for n, f in d.fields.items()]))


def document_fields(results: DataFrame, versions: Versions, corrections: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """``document_results`` as the page of a document: its fields, the problems about none of them, its currency.

    ``corrections(document_id, field, was, corrected_by, corrected_at)`` has one row a
    corrected field, ``places(document_id, places)`` the located values. A document that
    was not read, or whose version is not known, has no fields.
    """
    kind = "map<string,struct<by:string,at:timestamp_ntz,was:string>>"
    rows = results
    if corrections is not None:
        changes = F.map_from_entries(F.collect_list(F.struct("field", F.struct(F.col("corrected_by").alias("by"), F.col("corrected_at").cast("timestamp_ntz").alias("at"), "was"))))
        rows = rows.join(corrections.groupBy("document_id").agg(changes.cast(kind).alias("corrected")), "document_id", "left")
    else:
        rows = rows.withColumn("corrected", F.lit(None).cast(kind))
    rows = rows.join(places, "document_id", "left") if places is not None else rows.withColumn("places", F.lit(None).cast("string"))
    name, version = F.col("processor.name"), F.col("processor.version")
    made = lambda d: fields_expr(d, F.col("data"), F.col("problems"), F.col("derived"), F.col("corrected"), F.col("places"))
    general = lambda d: general_problems(problems_expr(d, F.col("problems")))
    currency = lambda d: F.get_json_object("data", f"$.{d.canonical.currency}") if d.canonical and d.canonical.currency else F.lit(None).cast("string")
    kind = "array<struct<name:string,label:string,type:string,required:boolean,derived:boolean,problem:string,corrected:struct<by:string,at:timestamp_ntz,was:string>,value:string,location:string,columns:array<struct<name:string,label:string,type:string>>>>"
    return rows.select(
        "document_id", "outcome", "processor", _by_version(versions, name, version, made, F.array().cast(kind)).alias("fields"),
        _by_version(versions, name, version, general, F.array().cast("array<string>")).alias("problems"),
        F.coalesce(_by_version(versions, name, version, currency, F.lit(None).cast("string")), F.col("transaction.currency")).alias("currency"), "extracted_at",
    )
