"""Registered queries: results and fields as clients see them, corrections, user transforms, publishing, failed attempts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corrections, history, results, transform, versions
from ..operators import definitions as D
from .relational import OUTCOME_SQL, q

TODAY = dt.date(2000, 6, 1)
SLIP = D.Definition(
    "slip", {"vendor": D.Field("string"), "total": D.Field("money"), "vat": D.Field("money"), "issued": D.Field("date"), "currency": D.Field("string")},
    rules=(D.Rule("required", "vendor"), D.Rule("positive", "total")), canonical=D.Canonical(amount="total", counterparty="vendor", currency="currency"),
)
KNOWN = {("slip", 1): SLIP}

_VENDOR = "CASE WHEN document_id % 11 > 2 THEN json_extract_string(answer, '$.vendor') WHEN document_id % 11 = 1 THEN '  ' END"
_TOTAL = "CASE WHEN document_id % 5 > 1 THEN CAST(price AS VARCHAR) END"
_ISSUED = "CASE WHEN document_id % 7 <> 0 THEN CAST(printed AS VARCHAR) END"
_VAT = "CASE WHEN document_id % 4 = 0 THEN '2.00' ELSE '1.01' END"
_TOTAL_PROBLEM = "expected an amount like ''1234.56'' or ''1234,56'', got ''1,234''"


def slips(answers: DataFrame) -> DataFrame:
    """Current extractions: every fourth of a version nobody knows any more, some of them transformed."""
    k, transformed = F.col("document_id"), F.col("document_id") % 10 == 5
    text = lambda v: F.lit(v).cast("string")
    return answers.select(
        "document_id", F.lit("slip").alias("doc_type"), F.when(k % 4 == 0, 2).otherwise(1).alias("schema_version"), text(None).alias("profile"), F.col("answer").alias("raw_json"),
        F.when(transformed, text('{"total": 9.990, "more": 1}')).alias("transformed_json"), F.when(transformed, F.array(F.lit("total"))).alias("derived_fields"),
        D.process_expr(SLIP, F.try_parse_json("answer"), TODAY)["errors"].alias("validation_errors"), F.col("printed").alias("created_at"),
    )


_labels = "CASE o_orderkey % 5 WHEN 0 THEN 'vendor_tax_id' WHEN 1 THEN 'iva' WHEN 2 THEN '__po__number' WHEN 3 THEN '_' ELSE 'total' END"
q("F15_field_label", "orders", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Vendor tax ID' WHEN 1 THEN 'IVA' WHEN 2 THEN 'PO number' WHEN 3 THEN '_' ELSE 'Total' END AS label FROM orders")(
    lambda t: t.select("o_orderkey", results.field_label(F.expr(_labels)).alias("label")))

q("P18_normalised_data", "answers", f"""
SELECT document_id,
 CASE WHEN document_id % 4 = 0 THEN json_extract_string(answer, '$.vendor') WHEN document_id % 10 = 5 THEN NULL ELSE {_VENDOR} END AS vendor,
 CASE WHEN document_id % 4 = 0 THEN json_extract_string(answer, '$.total') WHEN document_id % 10 = 5 THEN '9.99' ELSE {_TOTAL} END AS total,
 CASE WHEN document_id % 4 = 0 THEN json_extract_string(answer, '$.issued') WHEN document_id % 10 = 5 THEN NULL ELSE {_ISSUED} END AS issued,
 document_id % 4 = 0 AS undeclared FROM answers""")(
    lambda t: slips(t).withColumn("data", results.normalised_expr(KNOWN, F.col("doc_type"), F.col("schema_version"), F.col("raw_json"), F.col("transformed_json"))).select(
        "document_id", *[F.get_json_object("data", f"$.{c}").alias(c) for c in ("vendor", "total", "issued")], F.get_json_object("data", "$.extra").isNotNull().alias("undeclared")))


def document_results(documents: DataFrame, answers: DataFrame, ledger: DataFrame) -> DataFrame:
    docs = documents.select(F.col("id").cast("long").alias("document_id"), "status")
    booked = ledger.where("is_current").withColumn("document_id", F.col("document_id").cast("long"))
    return results.document_results(docs, slips(answers).where("document_id % 13 <> 0"), booked, KNOWN)


q("P17_document_result", "documents_list answers ledger", f"""
WITH e AS (SELECT document_id, CASE WHEN document_id % 4 = 0 THEN 2 ELSE 1 END AS version, answer,
  CASE WHEN document_id % 4 = 0 THEN json_extract_string(answer, '$.total') WHEN document_id % 10 = 5 THEN '9.99' ELSE {_TOTAL} END AS total,
  (CASE WHEN document_id % 11 = 2 THEN 2 WHEN document_id % 11 < 2 THEN 1 ELSE 0 END) + (CASE WHEN document_id % 5 = 0 THEN 1 ELSE 0 END) + (CASE WHEN document_id % 7 = 0 THEN 1 ELSE 0 END) AS problems
  FROM answers WHERE document_id % 13 <> 0),
l AS (SELECT document_id, amount, tax_amount, direction FROM ledger WHERE is_current)
SELECT CAST(d.id AS BIGINT) AS document_id, {OUTCOME_SQL} AS outcome, e.version, e.total, e.answer AS read, CASE WHEN e.document_id % 10 = 5 THEN 'total' ELSE '' END AS derived, coalesce(e.problems, 0) AS problems,
 regexp_replace(CAST(l.amount AS VARCHAR), '(\\.\\d\\d)(\\d*?)0+$', '\\1\\2') AS amount, regexp_replace(CAST(l.tax_amount AS VARCHAR), '(\\.\\d\\d)(\\d*?)0+$', '\\1\\2') AS tax_amount, l.direction
FROM documents_list d LEFT JOIN e ON e.document_id = CAST(d.id AS BIGINT) LEFT JOIN l ON l.document_id = d.id""")(
    lambda d, a, l: document_results(d, a, l).select(
        "document_id", "outcome", "processor.version", F.get_json_object("data", "$.total").alias("total"), "read", F.array_join("derived", ",").alias("derived"),
        F.size("problems").alias("problems"), "transaction.amount", "transaction.tax_amount", "transaction.direction"))

_FIELDS = "(VALUES (0, 'vendor', 'Vendor', 'string', true), (1, 'total', 'Total', 'money', false), (2, 'vat', 'VAT', 'money', false), (3, 'issued', 'Issued', 'date', false), (4, 'currency', 'Currency', 'string', false)) f(position, name, label, type, required)"
q("P19_field_view", "documents_list answers ledger", f"""
SELECT document_id, position, name, label, type, required, name = 'total' AND document_id % 10 = 5 AS derived,
 CASE name WHEN 'vendor' THEN CASE WHEN document_id % 11 = 2 THEN 'Vendor: expected a string, got int Vendor is required, but wasn''t found on the document' WHEN document_id % 11 < 2 THEN 'Vendor is required, but wasn''t found on the document' END
  WHEN 'total' THEN CASE WHEN document_id % 5 = 0 THEN 'Total: {_TOTAL_PROBLEM}' END WHEN 'issued' THEN CASE WHEN document_id % 7 = 0 THEN 'Issued: ''2026-02-30'' is not a real date' END END AS problem,
 CASE WHEN document_id % 10 = 5 THEN CASE WHEN name = 'total' THEN '9.99' END WHEN name = 'vendor' THEN {_VENDOR} WHEN name = 'total' THEN {_TOTAL} WHEN name = 'vat' THEN {_VAT} WHEN name = 'issued' THEN {_ISSUED}
  ELSE json_extract_string(answer, '$.currency') END AS value
FROM answers, {_FIELDS} WHERE document_id % 13 <> 0 AND document_id % 4 <> 0""")(
    lambda d, a, l: results.document_fields(document_results(d, a, l), KNOWN).select("document_id", F.posexplode_outer("fields").alias("position", "f")).where("position is not null").select(  # posexplode adds a filter that makes the fields twice more
        "document_id", "position", *[f"f.{c}" for c in ("name", "label", "type", "required", "derived", "problem", "value")]))

MIXED = D.Definition("mixed", {"net": D.Field("money"), "vat": D.Field("money"), "total": D.Field("money"), "vendor": D.Field("string"), "vendor_tax_id": D.Field("string")})
_messages = "CASE o_orderkey % 4 WHEN 0 THEN array('net + vat = 5.00, which does not match total (4.00)', 'net must be greater than 0') WHEN 1 THEN array('vendor_tax_id is required but was not extracted') WHEN 2 THEN array('an unknown vat') ELSE array() END"
q("P20_problem_assignment", "orders", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Net + VAT = 5.00, which does not match total (4.00) Net must be greater than 0' END AS net,
 CASE WHEN o_orderkey % 4 = 1 THEN 'Vendor tax ID is required, but wasn''t found on the document' END AS vendor_tax_id, CASE WHEN o_orderkey % 4 = 2 THEN 'An unknown VAT' ELSE '' END AS general FROM orders""")(
    lambda t: t.select("o_orderkey", results.problems_expr(MIXED, F.expr(_messages)).alias("p")).select(
        "o_orderkey", results.problem_of(F.col("p"), "net").alias("net"), results.problem_of(F.col("p"), "vendor_tax_id").alias("vendor_tax_id"), F.array_join(results.general_problems(F.col("p")), "|").alias("general")))


def fields_page(documents: DataFrame, answers: DataFrame, ledger: DataFrame, changes: DataFrame) -> DataFrame:
    page = results.document_fields(document_results(documents, answers, ledger), KNOWN, history.corrected_fields(changes))
    field = lambda n: F.get(F.filter("fields", lambda f: f["name"] == n), F.lit(0))
    return page.select(
        "document_id", F.size("fields").alias("fields"), field("total")["corrected"]["by"].alias("total_by"), field("vendor")["corrected"]["was"].alias("vendor_was"),
        field("vendor")["corrected"]["at"].alias("vendor_at"), "currency")


q("C20_document_fields", "documents_list answers ledger corrections", """
WITH c AS (SELECT document_id, field, min_by(was, revision) AS was, max_by(corrected_by, revision) AS corrected_by, max_by(created_at, revision) AS corrected_at FROM corrections GROUP BY 1, 2),
l AS (SELECT document_id, currency FROM ledger WHERE is_current),
d AS (SELECT CAST(id AS BIGINT) AS document_id, CAST(id AS BIGINT) % 13 <> 0 AND CAST(id AS BIGINT) % 4 <> 0 AS read FROM documents_list)
SELECT d.document_id, CASE WHEN read THEN 5 ELSE 0 END AS fields, CASE WHEN read THEN t.corrected_by END AS total_by, CASE WHEN read THEN v.was END AS vendor_was, CASE WHEN read THEN v.corrected_at END AS vendor_at,
 coalesce(CASE WHEN read AND d.document_id % 10 <> 5 THEN json_extract_string(a.answer, '$.currency') END, l.currency) AS currency
FROM d LEFT JOIN answers a ON a.document_id = d.document_id LEFT JOIN l ON l.document_id = CAST(d.document_id AS VARCHAR)
LEFT JOIN c t ON t.document_id = d.document_id AND t.field = 'total' LEFT JOIN c v ON v.document_id = d.document_id AND v.field = 'vendor'""")(fields_page)

# ---- corrections
SMALL = D.Definition("small", {"vendor": D.Field("string"), "total": D.Field("money")}, rules=(D.Rule("required", "vendor"), D.Rule("positive", "total")), canonical=D.Canonical(amount="total", counterparty="vendor"))
_changes = """CASE o_orderkey % 5 WHEN 0 THEN '{"total":"x"}' WHEN 1 THEN '{"total":"-3.00"}' WHEN 2 THEN '{}' WHEN 3 THEN '{"colour":"red"}' ELSE '{"total":"9.50"}' END"""


def corrected(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    documents = orders.select(
        k.alias("document_id"), (k % 3).alias("revision"), F.when(k % 17 != 0, '{"vendor":"shop","total":"-1","extra":2}').alias("raw_json"), F.lit(None).cast("string").alias("transformed_json"), (k % 2 == 0).alias("in_ledger"))
    asked = orders.select(k.alias("document_id"), (k % 3 + F.when(k % 4 == 0, 7).otherwise(0)).alias("revision"), F.expr(_changes).alias("changes_json"), (k % 3 == 0).alias("approve"), F.lit("ann").alias("by"))
    return corrections.apply_corrections(documents, asked, SMALL, 1, TODAY)


_outcome = "CASE WHEN k % 17 = 0 THEN 'nothing_read' WHEN k % 4 = 0 THEN 'stale' WHEN k % 5 IN (0, 3) THEN 'refused' ELSE 'applied' END"
_all = f"(SELECT *, outcome = 'applied' AS ok, k % 5 <> 4 AND k % 3 <> 0 AS held FROM (SELECT o_orderkey AS k, {_outcome} AS outcome FROM orders) x)"
q("C17_correct", "orders", f"""
SELECT k AS document_id, outcome, CASE WHEN ok THEN k % 3 + 1 ELSE k % 3 END AS revision, CASE WHEN ok AND k % 5 <> 2 THEN CASE k % 5 WHEN 1 THEN '-3.00' ELSE '9.50' END END AS total,
 CASE WHEN ok AND k % 5 <> 2 THEN '2' END AS extra, CASE WHEN ok THEN CASE k % 5 WHEN 1 THEN 'total must be greater than 0, got -3.00' WHEN 2 THEN 'total must be greater than 0, got -1.00' ELSE '' END END AS errors,
 CASE WHEN ok THEN CASE WHEN held THEN 'needs_review' ELSE 'committed' END END AS status, CASE WHEN ok THEN held AND k % 2 = 0 END AS withdraw,
 CASE WHEN ok AND NOT held THEN CAST(CASE k % 5 WHEN 1 THEN -3 WHEN 2 THEN -1 ELSE 9.5 END AS DECIMAL(18,4)) END AS booked, CASE WHEN ok THEN k % 3 = 0 END AS approved FROM {_all} y""")(
    lambda t: corrected(t).select("document_id", "outcome", "revision", F.get_json_object("raw_json", "$.total").alias("total"), F.get_json_object("raw_json", "$.extra").alias("extra"), F.array_join("errors", "|").alias("errors"), "status", "withdraw", F.col("transaction.amount").alias("booked"), "approved"))
q("C17_refusals", "orders", f"SELECT k AS document_id, CASE WHEN k % 5 = 0 THEN 'total' ELSE 'colour' END AS field, CASE WHEN k % 5 = 0 THEN 'An amount, like \"1234.56\"' ELSE 'No such field' END AS reason FROM {_all} y WHERE outcome = 'refused'")(
    lambda t: corrected(t).where("outcome = 'refused'").select("document_id", F.explode("refusals").alias("field", "reason")))
q("C17_changes", "orders", f"SELECT k AS document_id, 'total' AS field, '-1.00' AS was, CASE k % 5 WHEN 1 THEN '-3.00' ELSE '9.50' END AS now FROM {_all} y WHERE ok AND k % 5 <> 2")(
    lambda t: corrected(t).select("document_id", F.explode("changes").alias("c")).select("document_id", "c.*"))

# ---- user transforms
_CODE = "def transform(data):\n    total = data['total']\n    if total is None:\n        raise ValueError('no total')\n    return dict(data, vendor=5, more=1)\n"
_shape = f"""CASE WHEN document_id % 11 = 2 THEN 'vendor: expected a string, got int' END, CASE WHEN document_id % 5 = 0 THEN 'total: {_TOTAL_PROBLEM}' END, CASE WHEN document_id % 7 = 0 THEN 'issued: ''2026-02-30'' is not a real date' END"""


def transformed(answers: DataFrame) -> DataFrame:
    return transform.process_frame(answers.select("document_id", "answer"), SLIP, "answer", _CODE, TODAY).select(
        "document_id", F.col("processed.values.total").alias("total"), "processed.values.vendor", F.array_join("processed.errors", "|").alias("errors"), F.array_join("processed.derived", ",").alias("derived"))


q("C4_transform_returned", "answers", f"""
SELECT document_id, CAST(price AS DECIMAL(18,4)) AS total, CAST(NULL AS VARCHAR) AS vendor, concat_ws('|', {_shape}, 'transform returned vendor: expected a string, got int', 'vendor is required but was not extracted') AS errors,
 CASE WHEN document_id % 11 > 2 OR document_id % 11 = 1 THEN 'vendor' ELSE '' END AS derived FROM answers WHERE document_id % 5 > 1""")(lambda t: transformed(t).where("document_id % 5 > 1"))
q("C4_transform_failed", "answers", f"""
SELECT document_id, CAST(NULL AS DECIMAL(18,4)) AS total, {_VENDOR} AS vendor, concat_ws('|', {_shape}, CASE WHEN document_id % 11 < 3 THEN 'vendor is required but was not extracted' END, 'transform failed: ValueError: no total (line 4)') AS errors,
 '' AS derived FROM answers WHERE document_id % 5 <= 1""")(lambda t: transformed(t).where("document_id % 5 <= 1"))

# ---- publishing and failed attempts
q("C25_drafts", "document_types", """
WITH r AS (SELECT name, CASE id % 3 WHEN 1 THEN 1 WHEN 2 THEN 99 END AS based_on FROM document_types WHERE version = 1 UNION ALL SELECT 'brand_new', NULL),
k AS (SELECT name, max(version) AS newest, max(CASE WHEN is_published THEN version END) AS latest FROM document_types GROUP BY 1), b AS (SELECT name, version, is_published FROM document_types),
d AS (SELECT r.name, r.based_on, newest, CASE WHEN r.based_on IS NULL AND latest IS NOT NULL THEN concat(r.name, ' already exists; start the draft from v', latest) WHEN r.based_on = 99 THEN concat(r.name, ' has no v99')
  WHEN r.based_on IS NOT NULL AND NOT b.is_published THEN concat('v', r.based_on, ' is a draft; start from a published version instead') END AS refusal FROM r LEFT JOIN k ON k.name = r.name LEFT JOIN b ON b.name = r.name AND b.version = r.based_on)
SELECT name, CAST(based_on AS BIGINT) AS based_on, refusal, CASE WHEN refusal IS NULL THEN coalesce(newest, 0) + 1 END AS version FROM d""")(
    lambda t: versions.drafts(t, t.where("version = 1").select("name", F.expr("CASE id % 3 WHEN 1 THEN 1L WHEN 2 THEN 99L END").alias("based_on")).unionByName(t.sparkSession.sql("SELECT 'brand_new' AS name, CAST(NULL AS BIGINT) AS based_on"))))


def publish_requests(types: DataFrame) -> DataFrame:
    return types.where("version = 4").select("name", "version", F.lit(3).cast("long").alias("based_on"), F.when(F.col("id") % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("failures"))


_decisions = """r AS (SELECT t.name, t.version, t.id, t.is_published, (SELECT max(o.version) FROM document_types o WHERE o.name = t.name AND o.is_published) AS latest FROM document_types t WHERE t.version = 4),
p AS (SELECT name, version, CASE WHEN is_published THEN concat(name, ' v4 is already published') WHEN latest <> 3 THEN concat(name, ' v', latest, ' was published after this draft was started from v3; merge its changes into a new draft from v', latest)
 WHEN id % 5 = 0 THEN 'the transform fails its examples' END AS refusal FROM r)"""
q("C25_publish_decisions", "document_types", f"WITH {_decisions} SELECT name, version, refusal FROM p")(lambda t: versions.publish(t, publish_requests(t))[1])
q("C25_publish", "document_types", f"WITH {_decisions} SELECT t.name, t.version, t.is_published OR (p.name IS NOT NULL AND t.version = 4) AS is_published, CASE WHEN p.name IS NULL THEN t.is_active ELSE t.version = 4 END AS is_active FROM document_types t LEFT JOIN p ON p.name = t.name AND p.refusal IS NULL")(
    lambda t: versions.publish(t, publish_requests(t))[0].select("name", "version", "is_published", "is_active"))
q("C25_retire", "document_types", "SELECT name, version, is_active AND name NOT IN ('type_1', 'type_2') AS is_active FROM document_types")(
    lambda t: versions.retire(t, t.where("name in ('type_1', 'type_2')").select("name")).select("name", "version", "is_active"))
q("T10_failed_attempts", "extractions", """
WITH b AS (SELECT document_id, count(*) AS n FROM extractions WHERE NOT is_trial GROUP BY 1)
SELECT f.id, f.document_id, coalesce(b.n, 0) + row_number() OVER (PARTITION BY f.document_id ORDER BY f.created_at, f.id) AS attempt, 'failed: cut off' AS reason, false AS is_current, cost_usd, raw_json IS NOT NULL AND false AS has_answer
FROM extractions f LEFT JOIN b ON b.document_id = f.document_id WHERE f.id % 9 = 0""")(
    lambda t: versions.failed_attempts(t, t.where("id % 9 = 0").withColumn("reason", F.lit("cut off"))).select("id", "document_id", "attempt", F.array_join("validation_errors", "|").alias("reason"), "is_current", "cost_usd", F.col("raw_json").isNotNull().alias("has_answer")))
