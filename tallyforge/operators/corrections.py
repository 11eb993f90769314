"""Human corrections: checked, overlaid on what was read, processed again, appended as a new version.

Nothing is edited. A correction that names another revision than the document has, or
holds a value that its field cannot, changes nothing and says why.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import definitions as D
from .results import normalised_expr

TEXT_LIMIT = 2000
PARTS = "map<string,variant>"


def parts_of(json_text: Column) -> Column:
    """An object's values by name; null for anything that is no object."""
    return F.try_variant_get(F.try_parse_json(json_text), "$", PARTS)


def misfit(f: D.Field, v: Column) -> Column:
    """Why a value cannot be what a field holds, or null; null always fits, since a field may be cleared."""
    kind, text = D._kind(v), D._text(v)
    no = F.lit(False)
    if f.type == "money":
        bad, say = ~F.coalesce((kind == "str") & text.rlike(r"^-?[0-9]{1,10}(\.[0-9]{1,4})?$"), no), F.lit('An amount, like "1234.56"')
    elif f.type == "date":
        bad, say = ~F.coalesce((kind == "str") & text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & text.try_cast("date").isNotNull(), no), F.lit("A date, YYYY-MM-DD")
    elif f.type == "list":
        return F.when(kind.isNotNull(), _list_misfit(f, v, kind))
    elif f.type == "string":
        long = F.when(F.char_length(text) > TEXT_LIMIT, F.lit(f"At most {TEXT_LIMIT} characters"))
        return F.when(kind.isNotNull(), F.when(kind != "str", F.lit("Text")).otherwise(long))
    else:
        kinds, words = {"integer": (("int",), "A whole number"), "number": (("int", "float"), "A number"), "boolean": (("bool",), "Yes or no")}[f.type]
        bad, say = ~kind.isin(*kinds), F.lit(words)
    return F.when(kind.isNotNull() & bad, say)


def _list_misfit(f: D.Field, v: Column, kind: Column) -> Column:
    rows = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.try_variant_get(e, "$", PARTS))

    def wrong(row: Column, i: Column) -> Column:
        def cell(e: Column) -> Column:
            here = F.concat(F.lit("Row "), (i + 1).cast("string"))
            unknown = F.concat(here, F.lit(": no column called "), D.quoted(e["key"]))
            known = [(e["key"] == n, F.concat(here, F.lit(", "), e["key"], F.lit(": "), misfit(g, e["value"]))) for n, g in f.items.items()]
            return reduce(lambda out, k: F.when(k[0], k[1]).otherwise(out), known, unknown)

        return F.array_compact(F.transform(F.map_entries(row), cell))

    fine = (kind == "list") & F.forall(rows, lambda r: r.isNotNull())
    return F.when(~F.coalesce(fine, F.lit(False)), F.lit("A list of rows")).otherwise(F.get(F.flatten(F.transform(rows, wrong)), F.lit(0)))


def refusals_expr(d: D.Definition, changes: Column) -> Column:
    """Field name -> why its value is refused; empty when all fit."""

    def one(e: Column) -> Column:
        why = reduce(lambda out, n: F.when(e["key"] == n, misfit(d.fields[n], e["value"])).otherwise(out), d.fields, F.lit("No such field"))
        return F.struct(e["key"].alias("key"), why.alias("value"))

    return F.map_from_entries(F.filter(F.transform(F.map_entries(changes), one), lambda e: e["value"].isNotNull()))


def apply_corrections(documents: DataFrame, corrections: DataFrame, d: D.Definition, version: int, today: dt.date) -> DataFrame:
    """One row a correction: what became of it and, if it was applied, the new extraction.

    ``documents(document_id, revision, raw_json, transformed_json, in_ledger)`` with their
    current extraction (raw_json null: nothing read), ``corrections(document_id, revision,
    changes_json, approve, by)``, at most one a document and revision. outcome is
    nothing_read, stale, refused or applied. Changes lie over what the model read, not over
    what the transform made of it; without changes nothing new is read, only approved.
    status is needs_review if problems stay and nobody approves them (withdraw: its ledger
    row goes), else validated, or committed if there is an amount to record.
    """
    asked = corrections.select("document_id", F.col("revision").alias("seen"), parts_of(F.col("changes_json")).alias("changes"), "approve", "by")
    both = asked.join(documents, "document_id", "left").withColumn("refusals", refusals_expr(d, F.col("changes")))
    outcome = F.when(F.col("raw_json").isNull(), "nothing_read").when(F.col("seen") != F.col("revision"), "stale").when(F.size("refusals") > 0, "refused").otherwise("applied")
    read = parts_of(F.col("raw_json"))
    overlaid = F.map_concat(F.map_filter(read, lambda k, v: ~F.map_contains_key(F.col("changes"), k)), F.col("changes"))
    both = both.withColumns({"outcome": outcome, "answer": F.to_json(overlaid, {"ignoreNullFields": "false"})})
    before = normalised_expr({(d.name, version): d}, F.lit(d.name), F.lit(version), F.col("raw_json"), F.col("transformed_json"))
    both = both.withColumns({"p": D.process_expr(d, F.try_parse_json("answer"), today), "before": before})
    both = both.withColumn("entry", D.ledger_expr(d, F.col("p.values")))
    applied = F.col("outcome") == "applied"
    held = (F.size("p.errors") > 0) & ~F.col("approve")
    status = F.when(held, "needs_review").when(F.col("entry.row").isNull(), "validated").otherwise("committed")
    changed = F.transform(F.map_keys("changes"), lambda n: F.struct(n.alias("field"), F.get(F.transform(F.filter(F.map_entries(parts_of(F.col("before"))), lambda e: e["key"] == n), lambda e: e["value"].cast("string")), F.lit(0)).alias("was"), F.get(F.transform(F.filter(F.map_entries("changes"), lambda e: e["key"] == n), lambda e: e["value"].cast("string")), F.lit(0)).alias("now")))
    return both.select(
        "document_id", "outcome", F.when(F.col("outcome") == "refused", F.col("refusals")).alias("refusals"),
        F.when(applied, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"),
        F.when(applied & (F.size("changes") > 0), F.col("answer")).alias("raw_json"), F.when(applied, F.col("p.errors")).alias("errors"),
        F.when(applied, changed).alias("changes"), F.when(applied, status).alias("status"), F.when(applied, F.coalesce(held & F.col("in_ledger"), F.lit(False))).alias("withdraw"),
        F.when(applied & ~held, F.col("entry.row")).alias("transaction"), F.when(applied, F.col("approve")).alias("approved"), "by",
    )
