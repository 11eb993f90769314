"""Registered queries: the document dataflow - coercion, rules, routing, ledger rows, geometry, transforms, tenancy."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import definitions as D
from ..operators import layout, locate, scope, transform
from .relational import q

TODAY = dt.date(2000, 6, 1)
RECEIPT = D.Definition(
    name="receipt",
    fields={
        "vendor": D.Field("string"), "total": D.Field("money", description="labelled TOTAL"), "issued": D.Field("date"), "quantity": D.Field("integer"),
        "net": D.Field("money"), "vat": D.Field("money"), "currency": D.Field("string"),
        "items": D.Field("list", items={"name": D.Field("string"), "amount": D.Field("money")}),
    },
    matches=D.Matchers(keywords=("license", "public", "version"), patterns=(r"gnu\s+general",), min_score=0.25),
    rules=(
        D.Rule("required", "vendor"), D.Rule("positive", "total"), D.Rule("range", "total", minimum="1000", maximum="400000"), D.Rule("sum_equals", target="total", of=("net", "vat")),
        D.Rule("line_items_sum", target="vat", list_field="items", item_field="amount", tolerance="5"), D.Rule("not_future", "issued"), D.Rule("regex", "vendor", pattern=r"^Shop\s+\d+$", message="an unknown shop"),
    ),
    profiles={"one": D.Profile(tax_ids=("the the",)), "two": D.Profile(name_patterns=(r"licen[sc]e",))},
    canonical=D.Canonical(amount="total", tax_amount="vat", tax_lines="items", occurred_on="issued", counterparty="vendor", currency="currency"),
)
OTHER = D.Definition(name="notice", fields={"total": D.Field("money")}, matches=D.Matchers(keywords=("license", "the", "and"), min_score=0.3))
GATED = D.Definition(name="gated", fields={"total": D.Field("money")}, matches=D.Matchers(require_all=("license",)))

_TOTAL = "CASE WHEN document_id % 5 > 1 THEN CAST(price AS DECIMAL(18,4)) END"
_ISSUED = "CASE WHEN document_id % 7 <> 0 THEN printed END"
_VENDOR = "CASE WHEN document_id % 11 > 2 THEN json_extract_string(answer, '$.vendor') WHEN document_id % 11 = 1 THEN '  ' END"
_VAT = "CAST(CASE WHEN document_id % 4 = 0 THEN 2.00 ELSE 1.01 END AS DECIMAL(18,4))"


def only(*names: str) -> D.Definition:
    """The receipt with the named fields alone (a field's value depends on no other)."""
    return dataclasses.replace(RECEIPT, fields={n: RECEIPT.fields[n] for n in names}, rules=(), canonical=None)


def coerced(t: DataFrame, *names: str) -> DataFrame:
    """Answers with their coerced values, of the named fields only if some are named (a field's value depends on no other; errors then are theirs)."""
    d = only(*names) if names else RECEIPT
    return transform.dealt(t).withColumn("c", D.coerce_expr(d, F.try_parse_json("answer")))


# A filter on what is coerced would be moved below the projection, coerce a second time and leave the dealing out to few tasks; rows that go are dropped by explode instead.


def valued(t: DataFrame, *names: str) -> DataFrame:
    """Answers with the coerced values of the named fields, without messages."""
    return D.coerce_frame(t.select("document_id", "answer"), only(*names), F.try_parse_json("answer"))


def present(value: Column) -> Column:
    """A row for what is not null; compiled, unlike the lambda of array_compact."""
    return F.explode(F.when(value.isNotNull(), F.array(value)))


def checked(t: DataFrame) -> DataFrame:
    """All messages of an answer: coercion's first, then the rules'. One bound expression, so a filter on it copies nothing."""
    return transform.dealt(t).select("document_id", D.process_expr(RECEIPT, F.try_parse_json("answer"), TODAY)["errors"].alias("errors"))


q("C1_coerce", "answers", f"""SELECT document_id, {_VENDOR} AS vendor, {_TOTAL} AS total, {_ISSUED} AS issued, CASE WHEN document_id % 3 <> 0 THEN document_id % 100 END AS quantity,
concat_ws('|', CASE WHEN document_id % 11 = 2 THEN 'vendor: expected a string, got int' END, CASE WHEN document_id % 5 = 0 THEN 'total: expected an amount like ''1234.56'' or ''1234,56'', got ''1,234''' END,
CASE WHEN document_id % 7 = 0 THEN 'issued: ''2026-02-30'' is not a real date' END, CASE WHEN document_id % 3 = 0 THEN 'quantity: expected an integer, got 5.0' END, CASE WHEN document_id % 9 = 0 THEN 'items[2]: expected an object, got int' END) AS errors FROM answers""")(
    lambda t: coerced(t).select("document_id", "c.values.vendor", "c.values.total", "c.values.issued", "c.values.quantity", F.array_join("c.errors", "|").alias("errors")))
q("C2_list_coercion", "answers", "SELECT document_id, CASE WHEN document_id % 9 = 0 THEN 3 ELSE 2 END AS entries, CASE WHEN document_id % 6 = 0 THEN CAST(NULL AS DECIMAL(18,4)) ELSE CAST(2.5 AS DECIMAL(18,4)) END AS second FROM answers")(lambda t: coerced(t, "items").select("document_id", F.size("c.values.items").alias("entries"), F.get("c.values.items", F.lit(1))["amount"].alias("second")))
for _name, _message, _sql in (
    ("C3a_required", "vendor is required but was not extracted", f"trim(coalesce({_VENDOR}, '')) = ''"),
    ("C3c_range", "total must be at", f"{_TOTAL} < 1000 OR {_TOTAL} > 400000"),
    ("C3d_sum_equals", "net + vat = ", f"abs(price - 1 + {_VAT} - {_TOTAL}) > 0.02"),
    ("C3e_line_items_sum", "cannot check items[].amount = vat: items[1].amount is null", "document_id % 6 = 0"),
    ("C3f_not_future", "issued is ", f"{_ISSUED} > DATE '2000-06-02'"),
    ("C3g_regex", "an unknown shop", f"NOT regexp_matches({_VENDOR}, '^Shop\\s+\\d+$')"),
):
    q(_name, "answers", f"SELECT document_id FROM answers WHERE {_sql}")(lambda t, m=_message: checked(t).select(F.explode(F.array_compact(F.array(F.when(F.exists("errors", lambda e: e.startswith(m)), F.col("document_id"))))).alias("document_id")))
q("C3b_positive", "answers", f"SELECT document_id, {_TOTAL} - 100000 <= 0 AS fails FROM answers WHERE {_TOTAL} IS NOT NULL")(
    lambda t: valued(t, "total").select("document_id", F.col("values.total").alias("total")).select("document_id", present(F.col("total")).alias("total")).select("document_id", (F.size(D.rules_expr(D.Definition("p", {"total": D.Field("money")}, rules=(D.Rule("positive", "total"),)), F.struct((F.col("total") - 100000).cast(D.MONEY).alias("total")), TODAY)) > 0).alias("fails")))
q("C3h_error_counts", "answers", f"""SELECT document_id, (CASE WHEN trim(coalesce({_VENDOR}, '')) = '' THEN 1 ELSE 0 END) + (CASE WHEN {_TOTAL} < 1000 OR {_TOTAL} > 400000 THEN 1 ELSE 0 END) + (CASE WHEN abs(price - 1 + {_VAT} - {_TOTAL}) > 0.02 THEN 1 ELSE 0 END)
+ (CASE WHEN document_id % 6 = 0 OR document_id % 9 = 0 THEN 1 ELSE 0 END) + (CASE WHEN {_ISSUED} > DATE '2000-06-02' THEN 1 ELSE 0 END) + (CASE WHEN NOT regexp_matches({_VENDOR}, '^Shop\\s+\\d+$') THEN 1 ELSE 0 END) AS errors FROM answers""")(lambda t: checked(t).select("document_id", F.size(F.filter("errors", lambda e: ~e.rlike(r"^\w+(\[\d+\])?(\.\w+)?: "))).alias("errors")))
q("C13_to_ledger", "answers", f"SELECT document_id, 'receipt' AS source_type, 'out' AS direction, {_TOTAL} AS amount, {_VAT} AS tax_amount, {_ISSUED} AS occurred_on, nullif(trim(regexp_replace({_VENDOR}, '\\s+', ' ', 'g')), '') AS counterparty, CASE WHEN document_id % 6 <> 0 THEN 'EUR' END AS currency FROM answers WHERE document_id % 5 > 1")(
    lambda t: valued(t, *RECEIPT.canonical.reads()).select("document_id", D.ledger_expr(RECEIPT, F.col("values"))["row"].alias("row")).select("document_id", present(F.col("row")).alias("row")).select("document_id", "row.source_type", "row.direction", "row.amount", "row.tax_amount", "row.occurred_on", "row.counterparty", "row.currency"))
q("C13_ledger_reasons", "answers", "SELECT document_id, 'total is null, so there is no amount to record' AS reason FROM answers WHERE document_id % 5 <= 1")(lambda t: valued(t, RECEIPT.canonical.amount).select("document_id", D.ledger_reason(RECEIPT, F.col("values")).alias("reason")).select("document_id", present(F.col("reason")).alias("reason")))
q("C14_to_summary", "answers", f"SELECT document_id, 'receipt' AS doc_type, nullif(trim(regexp_replace({_VENDOR}, '\\s+', ' ', 'g')), '') AS supplier, {_ISSUED} AS document_date, {_TOTAL} AS total_amount, CASE WHEN document_id % 6 <> 0 THEN 'EUR' END AS total_currency FROM answers")(lambda t: coerced(t).select("document_id", D.summary_expr(RECEIPT, F.col("c.values")).alias("s")).select("document_id", "s.*"))
q("A24_tax_line_sum", "answers", "SELECT document_id, CASE WHEN document_id % 6 <> 0 AND document_id % 9 <> 0 THEN CAST(3.5 AS DECIMAL(18,4)) END AS tax FROM answers")(lambda t: coerced(t, "items").select("document_id", D.tax_sum(F.col("c.values.items")).alias("tax")))
q("C15_derived_columns", "answers", "SELECT document_id, CASE WHEN document_id % 2 = 0 THEN 'amount' ELSE '' END AS derived FROM answers")(lambda t: coerced(t).select("document_id", F.array_join(D.derived_columns_expr(RECEIPT, F.col("c.values"), F.when(F.col("document_id") % 2 == 0, F.array(F.lit("total"), F.lit("items"))).otherwise(F.array(F.lit("quantity")))), ",").alias("derived")))
q("C4_process", "answers", f"SELECT document_id, CASE WHEN {_TOTAL} IS NULL THEN price - 1 + {_VAT} ELSE {_TOTAL} END AS total, CASE WHEN {_TOTAL} IS NULL THEN 'total' ELSE '' END AS derived FROM answers")(
    lambda t: t.withColumn("p", D.process_expr(RECEIPT, F.try_parse_json("answer"), TODAY, lambda v: v.withField("total", F.coalesce(v["total"], (v["net"] + v["vat"]).cast(D.MONEY))))).select("document_id", F.col("p.values.total").cast("decimal(19,4)").alias("total"), F.array_join("p.derived", ",").alias("derived")))
INVOICE = D.Definition("invoice", {"total": D.Field("money"), "subtotal": D.Field("money"), "discount": D.Field("money"), "tax_amount": D.Field("money"), "taxes": D.Field("list", items={"amount": D.Field("money")})})
q("X2_invoice_transform", "answers", f"SELECT document_id, CASE WHEN {_TOTAL} IS NOT NULL THEN {_TOTAL} WHEN document_id % 6 <> 0 AND document_id % 9 <> 0 THEN CAST(price - 1 + 3.5 AS DECIMAL(18,4)) END AS total FROM answers")(
    lambda t: coerced(t).select("document_id", D.invoice_total_expr(F.struct(F.col("c.values.total").alias("total"), F.col("c.values.net").alias("subtotal"), F.lit(None).cast(D.MONEY).alias("discount"), F.lit(None).cast(D.MONEY).alias("tax_amount"), F.col("c.values.items").alias("taxes")))["total"].alias("total")))
_L = "[^\\p{L}\\p{Nl}\\p{No}]"
_norm = "lower(regexp_replace(text, '\\s+', ' ', 'g'))"
_word = lambda w: f"CAST(regexp_matches({_norm}, '(^|{_L}){w}({_L}|$)') AS INT)"
_hits = f"({_word('license')} + {_word('public')} + {_word('version')} + CAST(regexp_matches(text, '(?i)gnu\\s+general') AS INT))"
q("C7_match_evidence", "documents", f"SELECT doc_id, CASE WHEN h >= 1 THEN h ELSE 0 END AS hits, CASE WHEN h >= 1 THEN h / 4.0 ELSE 0.0 END AS score FROM (SELECT doc_id, {_hits} AS h FROM documents) x")(lambda t: t.select("doc_id", D.evidence_expr(RECEIPT, F.col("text")).alias("e")).select("doc_id", "e.hits", "e.score"))
_nh = f"({_word('license')} + {_word('the')} + {_word('and')})"
q("C8_route", "documents", f"SELECT doc_id, CASE WHEN r >= n AND r > 0 AND (r > n OR r / 4.0 >= n / 3.0) AND NOT (g AND r < 1) THEN CASE WHEN r = 1 AND g THEN 'gated' ELSE 'receipt' END WHEN n > 0 THEN CASE WHEN n = 1 AND g THEN 'gated' ELSE 'notice' END END AS name FROM (SELECT doc_id, {_hits} AS r, {_nh} AS n, {_word('license')} = 1 AS g FROM documents) x")(lambda t: t.select("doc_id", D.route_expr([(RECEIPT, False), (OTHER, False), (GATED, False)], F.col("text"))["name"].alias("name")))
q("C9_scores", "documents", f"SELECT doc_id, {_word('license')} AS gated_hits, CASE WHEN {_nh} >= 1 THEN {_nh} ELSE 0 END AS notice_hits FROM documents")(lambda t: t.select("doc_id", D.scores_expr([OTHER, GATED], F.col("text")).alias("m")).select("doc_id", F.col("m.gated.hits").alias("gated_hits"), F.col("m.notice.hits").alias("notice_hits")))
q("C11_select_profile", "documents", f"SELECT doc_id, CASE WHEN contains({_norm}, 'the the') THEN 'one' WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'two' END AS profile FROM documents")(lambda t: t.select("doc_id", D.profile_expr(RECEIPT, F.col("text")).alias("profile")))
q("J16_routing_pairs", "documents", f"SELECT doc_id, 'gated' AS name, {_word('license')} AS hits FROM documents UNION ALL SELECT doc_id, 'receipt', CASE WHEN {_hits} >= 1 THEN {_hits} ELSE 0 END FROM documents")(lambda t: t.select("doc_id", F.explode(D.scores_expr([RECEIPT, GATED], F.col("text"))).alias("name", "e")).select("doc_id", "name", "e.hits"))
q("F10_normalise", "documents", "SELECT doc_id, replace(replace(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'ß', 'ss'), 'ς', 'σ') AS folded FROM documents")(lambda t: t.select("doc_id", S.normalise(F.col("text")).alias("folded")))
q("F2_usd", "lineitem", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice / 7, 6) AS DECIMAL(18,6)) AS usd FROM lineitem")(lambda t: t.select("l_orderkey", "l_linenumber", S.usd(F.col("l_extendedprice") / 7).alias("usd")))
q("F5_strict_types", "answers", "SELECT document_id, CASE WHEN document_id % 3 <> 0 THEN document_id % 100 END AS quantity FROM answers")(lambda t: coerced(t, "quantity").select("document_id", "c.values.quantity"))
q("F6_to_wire", "answers", f"SELECT document_id, CAST({_TOTAL} AS STRING) AS total, CAST({_ISSUED} AS STRING) AS issued FROM answers")(lambda t: coerced(t, "total", "issued").select("document_id", F.col("c.values.total").cast("string").alias("total"), F.col("c.values.issued").cast("string").alias("issued")))


# ---- geometry: a block a word, in a grid of ten words a line
def blocks_of(docs: DataFrame) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    block = lambda w, i: F.struct(w.alias("text"), F.array((i % 10 * 100).cast("int"), (F.floor(i / 10) * 30).cast("int"), (i % 10 * 100 + F.char_length(w) * 9).cast("int"), (F.floor(i / 10) * 30 + 20).cast("int")).alias("bbox"), F.lit(0.9).alias("confidence"), F.lit(1).alias("page"), F.lit(None).cast("array<array<double>>").alias("polygon"))
    return docs.select("doc_id", "text", F.transform(words, block).alias("blocks"))


_words = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
#: Rows of the grid: every word starts at its column (nine pixels a character), two blanks from the one before at least.
_row = "list_reduce(ws[j * 10 + 1 : j * 10 + 10], lambda a, w, i: concat(rpad(a, CAST(greatest(round(100 * (i - 1) / 9.0), length(a) + 2) AS INT), ' '), w))"
_grid = f"(SELECT doc_id, text, ws, CASE WHEN len(ws) = 0 THEN '' ELSE array_to_string(list_transform(range(CAST(ceil(len(ws) / 10.0) AS BIGINT)), lambda j: {_row}), chr(10)) END AS rows FROM (SELECT doc_id, text, {_words} AS ws FROM documents) x)"
q("C6_layout_rows", "documents", f"SELECT doc_id, rows FROM {_grid} g")(lambda t: blocks_of(t).select("doc_id", layout.to_rows(F.col("blocks")).alias("rows")))
q("C5_extraction_text", "documents", f"SELECT doc_id, CASE WHEN rows <> '' THEN rows ELSE text END AS extracted FROM {_grid} g")(lambda t: blocks_of(t).select("doc_id", layout.extraction_text(F.col("blocks"), F.col("text")).alias("extracted")))
q("A22_mean_confidence", "documents", f"SELECT doc_id, CASE WHEN len({_words}) > 0 THEN 0.9 END AS confidence FROM documents")(lambda t: blocks_of(t).select("doc_id", F.round(layout.mean_confidence(F.col("blocks")), 9).alias("confidence")))
q("A23_layout_medians", "documents", f"SELECT doc_id AS document_id, 20.0 AS line_height, 9.0 AS char_width FROM documents WHERE len({_words}) > 0")(lambda t: layout.document_medians(blocks_of(t).select(F.col("doc_id").alias("document_id"), F.explode("blocks").alias("b")).select("document_id", "b.text", *[F.col("b.bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])))
q("C35_ocr_view", "documents", f"SELECT doc_id, CAST(len({_words}) AS INT) AS block_count, CASE WHEN len({_words}) > 0 THEN 0.9 END AS confidence, CAST(length(text) AS INT) AS chars, array_to_string({_words}, '|') AS words FROM documents")(
    lambda t: blocks_of(t).select("doc_id", F.size("blocks").alias("block_count"), F.round(layout.mean_confidence(F.col("blocks")), 9).alias("confidence"), F.char_length("text").alias("chars"), F.array_join(F.transform("blocks", lambda b: b["text"]), "|").alias("words")))
q("S15_blocks_json", "documents", f"SELECT doc_id, CAST(len({_words}) AS INT) AS blocks, array_to_string({_words}, '|') AS words, CAST(CASE WHEN len({_words}) > 0 THEN ((len({_words}) - 1) // 10) * 30 + 20 END AS INT) AS bottom FROM documents")(
    lambda t: blocks_of(t).select("doc_id", layout.parse_blocks(F.to_json("blocks")).alias("b")).select("doc_id", F.size("b").alias("blocks"), F.array_join(F.transform("b", lambda x: x["text"]), "|").alias("words"), F.get(F.element_at("b", F.when(F.size("b") > 0, -1))["bbox"], F.lit(3)).alias("bottom")))
q("S14_polygon_box", "orders", "SELECT o_orderkey, CAST(o_orderkey % 50 AS INT) AS x0, CAST(o_orderkey % 7 AS INT) AS y0, CAST(o_orderkey % 50 + 30 AS INT) AS x1, CAST(o_orderkey % 7 + 12 AS INT) AS y1 FROM orders")(
    lambda t: t.withColumn("b", layout.polygon_box(F.array(*[F.array((F.col("o_orderkey") % 50 + dx).cast("double"), (F.col("o_orderkey") % 7 + dy).cast("double")) for dx, dy in ((0, 2), (30, 0), (28, 12), (1, 11))]))).select("o_orderkey", *[F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]))
q("S10_word_table", "orders", "SELECT o_orderkey AS document_id, CAST(count(*) AS BIGINT) AS words, max(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 0.5 END) AS confidence FROM orders GROUP BY 1")(
    lambda t: layout.parse_word_table(t.select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("level\tpage\n1\t1\t0\t0\t0\t0\t0\t0\t600\t800\t-1\t\n5\t1\t1\t1\t1\t1\t10\t20\t30\t12\t"), F.when(F.col("o_orderkey") % 3 == 0, "-1").otherwise("50"), F.lit("\tword\n5\t1\tbroken\n5\t1\t1\t1\t1\t2\t10\t20\t30\t12\t90\t \n")).alias("tsv"))).where("kind = 'word'").groupBy("document_id").agg(F.count("*").alias("words"), F.max("confidence").alias("confidence")))
q("S11_text_layer", "orders", "SELECT o_orderkey AS document_id, CAST(2 * (o_orderkey % 100) AS INT) AS x0, CAST(2 * (800 - 40) AS INT) AS y0 FROM orders")(
    lambda t: layout.text_layer_blocks(t.select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("page"), (F.col("o_orderkey") % 100).cast("double").alias("left"), F.lit(20.0).alias("bottom"), F.lit(200.0).alias("right"), F.lit(40.0).alias("top"), F.lit(800.0).alias("page_height"), F.lit("x").alias("text"))).select("document_id", F.col("bbox")[0].alias("x0"), F.col("bbox")[1].alias("y0")))
q("S12_text_layer_or_ocr", "documents", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(regexp_replace(text, '\\s', '', 'g')) >= 20 THEN 'layer' ELSE 'ocr' END AS source FROM documents")(
    lambda t: t.select("doc_id").join(layout.usable_text_layer(t.where("doc_id % 2 = 0").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")).select(F.col("document_id").alias("doc_id"), F.lit("layer").alias("source")), "doc_id", "left").select("doc_id", F.coalesce("source", F.lit("ocr")).alias("source")))


def _located(t: DataFrame) -> DataFrame:
    number = F.format_string("%d.%02d", 1000 + F.col("o_orderkey"), F.col("o_orderkey") % 100)
    block = lambda text, x, y: F.struct(text.alias("text"), F.array(*[F.lit(v) for v in (x, y, x + 90, y + 20)]).alias("bbox"), F.lit(None).cast("double").alias("confidence"), F.lit(1).alias("page"), F.lit(None).cast("array<array<double>>").alias("polygon"))
    blocks = F.array(block(F.lit("TOTAL"), 10, 700), block(number, 200, 702), block(F.lit("24 Oct 2026"), 10, 40))
    sizes = F.array(F.struct(F.lit(1).alias("page"), F.lit(1000).alias("width"), F.lit(1000).alias("height")))
    data = F.to_json(F.struct(number.alias("total"), F.lit("2026-10-24").alias("issued"), F.lit("nowhere").alias("vendor")))
    return t.select("o_orderkey", locate.locate_expr(RECEIPT, data, blocks, sizes).alias("places"))


q("C19_locate", "orders", "SELECT o_orderkey, 0.196 AS total_x0, 0.698 AS total_y0, 0.036 AS issued_y0, true AS vendor_missing FROM orders")(
    lambda t: _located(t).select("o_orderkey", F.round(F.get_json_object("places", "$.total.box[0]").cast("double"), 9).alias("total_x0"), F.round(F.get_json_object("places", "$.total.box[1]").cast("double"), 9).alias("total_y0"), F.round(F.get_json_object("places", "$.issued.box[1]").cast("double"), 9).alias("issued_y0"), F.get_json_object("places", "$.vendor").isNull().alias("vendor_missing")))
q("X1_transform_host", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'ZeroDivisionError: division by zero (line 3)' END AS error, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderkey * 2 AS STRING) END AS doubled FROM orders")(
    lambda t: transform.dealt(t.select("o_orderkey")).select("o_orderkey", transform.transform_expr("from decimal import Decimal\ndef transform(data):\n    1 / (int(data['k']) % 50)\n    return {'doubled': str(Decimal(data['k']) * 2)}\n", F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("k")))).alias("r")).select("o_orderkey", F.get_json_object("r", "$.error").alias("error"), F.get_json_object("r", "$.ok.doubled").alias("doubled")))

# ---- tenancy and corrections
q("P10_scoped_join", "documents_list ledger", "SELECT d.id, l.amount FROM documents_list d LEFT JOIN ledger l ON l.document_id = d.id AND l.organisation_id = '1' WHERE d.organisation_id = '1'")(lambda d, l: (lambda s: s.table("documents").select("id").join(s.table("transactions").select(F.col("document_id").alias("id"), "amount"), "id", "left"))(scope.ScopedTables({"documents": d, "transactions": l}, scope.Scope("1"))))
q("P11_scoped_sql", "ledger", "SELECT currency, count(*) AS n FROM ledger WHERE organisation_id = '2' GROUP BY 1")(lambda l: scope.ScopedTables({"transactions": l}, scope.Scope("2")).sql(l.sparkSession, "SELECT currency, count(*) AS n FROM {transactions} GROUP BY currency"))
q("P12_everyone", "ledger", "SELECT organisation_id, count(*) AS n FROM ledger GROUP BY 1")(lambda l: scope.ScopedTables({"transactions": l}, scope.Scope(None, everyone=True)).table("transactions").groupBy("organisation_id").agg(F.count("*").alias("n")))
q("C36_tenant_wipe", "ledger", "SELECT transaction_id FROM ledger WHERE organisation_id <> '3'")(lambda l: scope.without_organisation(l, "3").select("transaction_id"))
