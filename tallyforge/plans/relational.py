"""Registered queries: ledger, costs, listing, versions, history, uploads, people, jobs, scoring."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import costs, history, jobs, ledger, listing, people, scoring, uploads, versions
from ..sources.views import view, with_views
from .registry import register

START, END = dt.date(1997, 1, 1), dt.date(1998, 12, 31)
T0 = "TIMESTAMP '1998-06-01 00:00:00'"
NOW = dt.datetime(2024, 1, 15)
LIVE = "is_current AND direction = 'out'"
OUTCOME_SQL = "CASE WHEN status IN ('validated','committed','synced') THEN 'done' WHEN status = 'needs_review' THEN 'needs_review' WHEN status = 'unsupported' THEN 'unsupported' WHEN status IN ('ocr_failed','rejected') THEN 'failed' ELSE 'processing' END"
PASS_SQL = "('correct','absent_ok')"


def outcome_sql(expected: str, actual: str) -> str:
    n = lambda c: f"trim(lower(regexp_replace({c}, '\\s+', ' ', 'g')))"
    return f"CASE WHEN {expected} IS NULL AND {actual} IS NULL THEN 'absent_ok' WHEN {actual} IS NULL THEN 'missed' WHEN {expected} IS NULL THEN 'hallucinated' WHEN {n(expected)} = {n(actual)} THEN 'correct' ELSE 'wrong' END"


def q(name: str, views: str, sql: str):
    """Registers ``f(**views)``-style queries: f gets one DataFrame per view name."""
    names = views.split()
    made = [v for v in names if v not in ("region", "nation", "orders", "lineitem", "events", "documents", "customer", "labels")]
    ctes = with_views(*made) if made else ""
    oracle = sql.strip()
    if made:
        oracle = f"{ctes}, {oracle[5:]}" if oracle.upper().startswith("WITH ") else f"{ctes}\n{oracle}"

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, n) for n in names])

        run.__doc__ = f.__doc__
        register(name, oracle)(run)
        return f

    return add


# ---- ledger
_spend = "SELECT coalesce(currency, 'unstated') AS currency, CAST(sum(amount) AS DECIMAL(24,4)) AS total, count(amount) AS transactions, CAST(sum(tax_amount) AS DECIMAL(24,4)) AS tax, count(tax_amount) AS taxed FROM ledger WHERE {} GROUP BY 1"
q("A1_total_spend", "ledger", _spend.format(LIVE + " AND occurred_on >= DATE '1997-01-01'"))(lambda t: ledger.total_spend(t, start=START))
q("P1_live_ledger", "ledger", f"SELECT transaction_id, amount FROM ledger WHERE {LIVE}")(lambda t: ledger.live(t).select("transaction_id", "amount"))
q("P2_date_window", "ledger", f"SELECT transaction_id, occurred_on FROM ledger WHERE {LIVE} AND occurred_on BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")(lambda t: ledger.window(ledger.live(t), START, END).select("transaction_id", "occurred_on"))
q("P3_counterparty_substring", "ledger", _spend.format(LIVE + " AND counterparty ILIKE '%customer#00000001_%'"))(lambda t: ledger.total_spend(t, counterparty="customer#00000001_"))
q("P4_category_and_minimum", "ledger", f"SELECT transaction_id, amount FROM ledger WHERE {LIVE} AND category = '5-LOW' AND amount >= 100000.5")(lambda t: ledger.live(t).where((F.col("category") == "5-LOW") & (F.col("amount") >= F.lit(Decimal("100000.5")))).select("transaction_id", "amount"))
q("A1_sources", "ledger", f"SELECT document_id FROM ledger WHERE {LIVE} AND category = '1-URGENT'")(lambda t: ledger.spend_sources(t, category="1-URGENT"))
q("A2_currency_note", "ledger", f"SELECT CASE WHEN count(DISTINCT coalesce(currency, '')) > 1 THEN 'Totals are split by currency and must not be added together.' END AS note FROM ledger WHERE {LIVE}")(lambda t: ledger.currency_note(ledger.total_spend(t)))
q("A3_spend_by_counterparty", "ledger", f"SELECT counterparty, coalesce(currency, 'unstated') AS currency, total, transactions FROM (SELECT counterparty, currency, CAST(sum(amount) AS DECIMAL(24,4)) AS total, count(*) AS transactions FROM ledger WHERE {LIVE} GROUP BY 1, 2 ORDER BY total DESC, counterparty, currency NULLS FIRST LIMIT 10) x")(lambda t: ledger.spend_by_counterparty(t))
q("A4_spend_by_month", "ledger", f"SELECT coalesce(strftime(occurred_on, '%Y-%m'), 'undated') AS month, coalesce(currency, 'unstated') AS currency, CAST(sum(amount) AS DECIMAL(24,4)) AS total, count(*) AS transactions FROM ledger WHERE {LIVE} GROUP BY 1, 2")(lambda t: ledger.spend_by_month(t))
q("A5_ledger_summary", "ledger", "SELECT count(*) AS transactions, min(occurred_on) AS earliest, max(occurred_on) AS latest, array_to_string(list_sort(list(DISTINCT coalesce(currency, 'unstated'))), ',') AS currencies FROM ledger WHERE is_current")(lambda t: ledger.ledger_summary(t))
q("O1_list_transactions", "ledger", f"SELECT transaction_id, document_id, occurred_on, counterparty, amount, tax_amount, currency, category, user_verified FROM ledger WHERE {LIVE} ORDER BY occurred_on DESC NULLS LAST, transaction_id LIMIT 200")(lambda t: ledger.list_transactions(t, limit=500))
q("J10_get_source", "ledger extractions documents_list", "SELECT l.transaction_id, l.document_id, l.amount, l.currency, l.occurred_on, l.counterparty, d.original_filename, d.uploaded_at, e.doc_type, e.model_used, e.raw_json FROM ledger l LEFT JOIN extractions e ON CAST(e.id AS STRING) = l.source_extraction_id LEFT JOIN documents_list d ON d.id = l.document_id WHERE l.transaction_id = '77'")(lambda l, e, d: ledger.get_source(l, e, d, "77"))
q("F1_money_text", "ledger", "SELECT transaction_id, regexp_replace(CAST(tax_amount AS STRING), '(\\.\\d\\d)(\\d*?)0+$', '\\1\\2') AS tax_text FROM ledger")(lambda t: t.select("transaction_id", S.money_text(F.col("tax_amount")).alias("tax_text")))
q("F17_month_key", "ledger", "SELECT transaction_id, coalesce(strftime(occurred_on, '%Y-%m'), 'undated') AS month FROM ledger")(lambda t: t.select("transaction_id", S.month_key(F.col("occurred_on")).alias("month")))

# ---- costs
_c = "coalesce(cost_usd, 0)"
_win = "created_at >= TIMESTAMP '2024-01-03 00:00:00' AND created_at < TIMESTAMP '2024-01-21 00:00:00'"
SINCE, UNTIL = dt.date(2024, 1, 3), dt.date(2024, 1, 20)
q("A8_cost_report", "extractions", f"""
WITH d AS (SELECT document_id, count(*) FILTER (WHERE NOT is_trial) AS n FROM extractions WHERE {_win} GROUP BY 1),
r AS (SELECT count(*) FILTER (WHERE NOT is_trial) AS calls, count(*) FILTER (WHERE NOT is_trial AND raw_json IS NULL) AS failed,
 CAST(coalesce(sum({_c}) FILTER (WHERE NOT is_trial), 0) AS DECIMAL(24,6)) AS total_usd, CAST(coalesce(sum({_c}) FILTER (WHERE NOT is_trial AND raw_json IS NULL), 0) AS DECIMAL(24,6)) AS wasted_usd,
 count(*) FILTER (WHERE is_trial) AS trial_calls, CAST(coalesce(sum({_c}) FILTER (WHERE is_trial), 0) AS DECIMAL(24,6)) AS trial_usd,
 count(*) FILTER (WHERE NOT is_trial AND input_tokens + output_tokens > 0 AND {_c} = 0) AS unpriced,
 CAST(sum(input_tokens) FILTER (WHERE NOT is_trial) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) FILTER (WHERE NOT is_trial) AS BIGINT) AS output_tokens FROM extractions WHERE {_win}),
k AS (SELECT count(*) FILTER (WHERE n > 0) AS documents, count(*) FILTER (WHERE n > 1) AS retried_documents FROM d)
SELECT calls, failed, documents, retried_documents, total_usd, wasted_usd, trial_calls, trial_usd, unpriced, input_tokens, output_tokens FROM r, k""")(lambda t: costs.report(t, SINCE, UNTIL).drop("per_document_usd", "per_call_usd"))
q("A9_cost_ratios", "extractions", f"SELECT CAST(round_even(CAST(sum({_c}) AS DOUBLE) / count(DISTINCT document_id), 6) AS DECIMAL(18,6)) AS per_document_usd, CAST(round_even(CAST(sum({_c}) AS DOUBLE) / count(*), 6) AS DECIMAL(18,6)) AS per_call_usd FROM extractions WHERE NOT is_trial")(lambda t: costs.report(t).select("per_document_usd", "per_call_usd"))
q("A10_latency_percentiles", "extractions", "SELECT CAST(quantile_disc(latency_ms, 0.5) AS BIGINT) AS p50_ms, CAST(quantile_disc(latency_ms, 0.95) AS BIGINT) AS p95_ms FROM extractions WHERE NOT is_trial AND latency_ms IS NOT NULL")(lambda t: costs.latency(t))
q("A11_cost_slices", "extractions organisations", f"""
SELECT 'model' AS slice, model_used AS key, count(*) AS calls, CAST(sum({_c}) AS DECIMAL(24,6)) AS total_usd FROM extractions WHERE NOT is_trial GROUP BY 2
UNION ALL SELECT 'doc_type', doc_type, count(*), CAST(sum({_c}) AS DECIMAL(24,6)) FROM extractions WHERE NOT is_trial GROUP BY 2
UNION ALL SELECT 'organisation', coalesce(o.name, e.organisation_id), count(*), CAST(sum({_c}) AS DECIMAL(24,6)) FROM extractions e LEFT JOIN organisations o ON o.id = e.organisation_id WHERE NOT is_trial GROUP BY 2""")(lambda t, o: costs.slices(t, o))
q("A12_daily_spend", "extractions", "SELECT CAST(created_at AS DATE) AS day, CAST(coalesce(sum(cost_usd), 0) AS DECIMAL(24,6)) AS spent_usd, coalesce(sum(cost_usd), 0) >= 1500 AS over_cap FROM extractions GROUP BY 1")(lambda t: costs.spend_per_day(t, Decimal(1500)))
q("A13_extraction_counts", "extractions", "SELECT doc_type, count(*) AS extractions FROM extractions WHERE NOT is_trial GROUP BY 1")(lambda t: costs.counts_by_type(t))
q("A20_document_costs", "extractions", f"SELECT document_id, CAST(coalesce(sum({_c}) FILTER (WHERE NOT is_trial), 0) AS DECIMAL(24,6)) AS billed_usd, CAST(coalesce(sum({_c}) FILTER (WHERE is_trial), 0) AS DECIMAL(24,6)) AS trial_usd FROM extractions GROUP BY 1")(lambda t: costs.document_costs(t))
q("P9_cost_window", "extractions", f"SELECT id FROM extractions WHERE {_win}")(lambda t: costs.window(t, SINCE, UNTIL).select("id"))
q("J11_organisation_names", "extractions organisations", "SELECT coalesce(o.name, e.organisation_id) AS organisation, count(*) AS calls FROM extractions e LEFT JOIN organisations o ON o.id = e.organisation_id GROUP BY 1")(lambda e, o: e.groupBy("organisation_id").agg(F.count("*").alias("calls")).join(o.select(F.col("id").alias("organisation_id"), "name"), "organisation_id", "left").select(F.coalesce("name", "organisation_id").alias("organisation"), "calls"))
q("C28_price_calls", "extractions", """
WITH p(name, i, o, c) AS (VALUES ('small', 1.0, 5.0, 0.1), ('medium', 3.0, 15.0, 0.3), ('medium-20250101', 4.0, 16.0, 0.4)),
t AS (SELECT id, concat(model_used, CASE WHEN id % 2 = 0 THEN '-20250101' ELSE '' END) AS model, input_tokens, output_tokens, cache_read_tokens FROM extractions),
n AS (SELECT *, CASE WHEN model IN (SELECT name FROM p) THEN model ELSE regexp_replace(model, '-\\d{8}$', '') END AS name FROM t)
SELECT n.id, CAST(coalesce(CAST(input_tokens AS DECIMAL(12,0)) * CAST(i AS DECIMAL(8,2)) + CAST(output_tokens AS DECIMAL(12,0)) * CAST(o AS DECIMAL(8,2)) + CAST(cache_read_tokens AS DECIMAL(12,0)) * CAST(c AS DECIMAL(8,2)), 0) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(30,12)) AS cost_usd FROM n LEFT JOIN p ON p.name = n.name""")(
    lambda t: costs.price_calls(t.select("id", F.concat("model_used", F.when(F.col("id") % 2 == 0, "-20250101").otherwise("")).alias("model"), "input_tokens", "output_tokens", "cache_read_tokens"),
                                t.sparkSession.sql("SELECT * FROM VALUES ('small', 1.0, 5.0, 0.1), ('medium', 3.0, 15.0, 0.3), ('medium-20250101', 4.0, 16.0, 0.4) AS p(name, input, output, cached)")).select("id", "cost_usd"))

# ---- listing
q("P5_list_filters", "documents_list", f"SELECT id FROM documents_list WHERE {OUTCOME_SQL} = 'done' AND doc_type = 'receipt' AND uploaded_at >= TIMESTAMP '1997-03-09 05:00:00' AND uploaded_at < TIMESTAMP '1998-11-01 04:00:00'")(lambda t: listing.filters(t, "done", "receipt", None, dt.date(1997, 3, 9), dt.date(1998, 10, 31), "America/New_York").select("id"))
q("P6_text_search", "documents_list", "SELECT id FROM documents_list WHERE contains(lower(supplier), '100%') OR contains(lower(original_filename), '100%')")(lambda t: listing.filters(t, q="  100% ").select("id"))
q("P7_local_day_bounds", "documents_list", "SELECT id FROM documents_list WHERE uploaded_at >= TIMESTAMP '1997-03-29 23:00:00' AND uploaded_at < TIMESTAMP '1997-03-30 22:00:00'")(lambda t: listing.filters(t, received_from=dt.date(1997, 3, 30), received_to=dt.date(1997, 3, 30), zone="Europe/Madrid").select("id"))
q("P8_outcome_map", "documents_list", f"SELECT id, {OUTCOME_SQL} AS outcome FROM documents_list")(lambda t: t.select("id", listing.outcome(F.col("status")).alias("outcome")))
q("O2_keyset_received", "documents_list", f"SELECT id, uploaded_at FROM documents_list WHERE uploaded_at < {T0} OR (uploaded_at = {T0} AND id < '9') ORDER BY uploaded_at DESC, id DESC LIMIT 51")(lambda t: listing.page(t, "received", listing.encode_cursor("received", dt.datetime(1998, 6, 1), "9")).select("id", "uploaded_at"))
q("O2_keyset_document_date", "documents_list", f"SELECT id, document_date FROM documents_list WHERE document_date < DATE '1996-01-01' OR document_date IS NULL OR (document_date = DATE '1996-01-01' AND (uploaded_at < {T0} OR (uploaded_at = {T0} AND id < '5'))) ORDER BY document_date DESC NULLS LAST, uploaded_at DESC, id DESC LIMIT 201")(lambda t: listing.page(t, "document_date", listing.encode_cursor("document_date", dt.datetime(1998, 6, 1), "5", dt.date(1996, 1, 1)), 1000).select("id", "document_date"))
q("O2_keyset_undated", "documents_list", f"SELECT id, uploaded_at FROM documents_list WHERE document_date IS NULL AND (uploaded_at < {T0} OR (uploaded_at = {T0} AND id < '5')) ORDER BY uploaded_at DESC, id DESC LIMIT 51")(lambda t: listing.page(t, "document_date", listing.encode_cursor("document_date", dt.datetime(1998, 6, 1), "5")).select("id", "uploaded_at"))
q("O3_cursor_walk", "documents_list", "SELECT id FROM documents_list ORDER BY uploaded_at DESC, id DESC LIMIT 40")(lambda t: _walk(t))
q("O4_panel_page", "documents_list", f"SELECT id, uploaded_at FROM documents_list WHERE uploaded_at < {T0} ORDER BY uploaded_at DESC, id DESC LIMIT 50")(lambda t: listing.panel_page(t, dt.datetime(1998, 6, 1)).select("id", "uploaded_at"))
q("O7_export_csv", "documents_list document_types", """
WITH n AS (SELECT name, max_by(display_name, version) AS display_name FROM document_types GROUP BY 1), d AS (SELECT * FROM documents_list ORDER BY uploaded_at DESC, id DESC LIMIT 50000)
SELECT id, """ + OUTCOME_SQL + """ AS outcome, regexp_replace(doc_type, '^([=+\\-@\\t\\r])', '''\\1') AS doc_type,
CASE WHEN doc_type IS NOT NULL THEN coalesce(n.display_name, concat(upper(left(doc_type, 1)), substring(doc_type, 2))) END AS type_label,
regexp_replace(supplier, '^([=+\\-@\\t\\r])', '''\\1') AS supplier, document_date, total_amount AS amount, CASE WHEN total_amount IS NOT NULL THEN total_currency END AS currency
FROM d LEFT JOIN n ON n.name = d.doc_type""")(lambda t, k: listing.export(t, listing.newest_labels(k)))
q("F9_formula_guard", "documents_list", "SELECT id, regexp_replace(supplier, '^([=+\\-@\\t\\r])', '''\\1') AS supplier FROM documents_list")(lambda t: t.select("id", S.formula_guard(F.col("supplier")).alias("supplier")))
q("P16_document_rows", "documents_list document_types", """
WITH n AS (SELECT name, max_by(display_name, version) AS display_name FROM document_types GROUP BY 1)
SELECT id, """ + OUTCOME_SQL + """ AS outcome, doc_type, CASE WHEN doc_type IS NOT NULL THEN coalesce(n.display_name, concat(upper(left(doc_type, 1)), substring(doc_type, 2))) END AS type_label, supplier, document_date,
total_amount AS amount, CASE WHEN total_amount IS NOT NULL THEN total_currency END AS currency FROM documents_list d LEFT JOIN n ON n.name = d.doc_type""")(lambda t, k: listing.rows(t, listing.newest_labels(k)))
q("A6_summary_by_outcome", "documents_list", f"SELECT o.outcome, count(d.id) AS documents FROM (VALUES ('processing'),('done'),('needs_review'),('unsupported'),('failed')) o(outcome) LEFT JOIN (SELECT id, {OUTCOME_SQL} AS outcome FROM documents_list) d ON d.outcome = o.outcome GROUP BY 1")(lambda t: listing.summary_by_outcome(t))
q("A7_summary_totals", "documents_list", "SELECT total_currency AS currency, CAST(sum(total_amount) AS DECIMAL(24,4)) AS total FROM documents_list WHERE total_amount IS NOT NULL AND total_currency IS NOT NULL GROUP BY 1")(lambda t: listing.summary_totals(t))
q("J1_document_owner", "documents_list organisations", "SELECT d.id, o.name AS organisation FROM documents_list d JOIN organisations o ON o.id = d.organisation_id")(lambda t, o: listing.with_owner(t, o).select("id", "organisation"))
q("J2_current_rows", "documents_list extractions ledger", """
SELECT d.id, e.id AS extraction_id, l.transaction_id FROM documents_list d
LEFT JOIN (SELECT document_id, max_by(id, created_at) AS id FROM extractions WHERE NOT is_trial AND raw_json IS NOT NULL GROUP BY 1) e ON CAST(e.document_id AS STRING) = d.id LEFT JOIN ledger l ON l.document_id = d.id AND l.is_current""")(
    lambda d, e, l: d.select("id").join(versions.current_extractions(e).select(F.col("document_id").cast("string").alias("id"), F.col("id").alias("extraction_id")), "id", "left").join(l.where("is_current").select(F.col("document_id").alias("id"), "transaction_id"), "id", "left"))
q("J3_billed_cost_per_document", "documents_list extractions", "SELECT d.id, CAST(coalesce((SELECT sum(cost_usd) FROM extractions e WHERE CAST(e.document_id AS STRING) = d.id AND NOT e.is_trial), 0) AS DECIMAL(24,6)) AS cost_usd FROM documents_list d")(lambda d, e: listing.document_costs_join(d, e))
q("J6_newest_labels", "document_types", "SELECT t.name, t.display_name FROM document_types t JOIN (SELECT name, max(version) AS version FROM document_types GROUP BY 1) m ON m.name = t.name AND m.version = t.version")(lambda t: listing.newest_labels(t))
q("J17_inherit_owner", "ledger documents_list", "SELECT l.transaction_id, d.organisation_id FROM ledger l JOIN documents_list d ON d.id = l.document_id")(lambda l, d: listing.inherit_owner(l, d).select("transaction_id", "organisation_id"))
q("U5_distinct_types", "documents_list", "SELECT DISTINCT doc_type FROM documents_list WHERE doc_type IS NOT NULL")(lambda t: listing.distinct_types(t))
q("C26_backfill", "documents_list ledger", "SELECT d.id, CASE WHEN d.doc_type IS NULL THEN 'ledger' ELSE d.doc_type END AS doc_type, CASE WHEN d.doc_type IS NULL THEN coalesce(d.supplier, l.counterparty) ELSE d.supplier END AS supplier FROM documents_list d LEFT JOIN ledger l ON l.document_id = d.id")(lambda d, l: listing.backfill(d, l.select(F.col("document_id").alias("id"), F.lit("ledger").alias("doc_type"), F.col("counterparty").alias("supplier"))).select("id", "doc_type", "supplier"))


def _walk(documents: DataFrame) -> DataFrame:
    """Two pages of 20 by cursor; the driver sees one page's last row."""
    first = listing.page(documents, "received", None, 20)
    last = first.orderBy(F.desc("uploaded_at"), F.desc("id")).limit(20).collect()[-1]
    second = listing.page(documents, "received", listing.encode_cursor("received", last.uploaded_at, last.id), 19)
    return first.limit(20).select("id").unionByName(second.select("id"))


# ---- versions
q("W3_current_extraction", "extractions", "SELECT id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS r FROM extractions WHERE NOT is_trial AND raw_json IS NOT NULL) x WHERE r = 1")(lambda t: versions.current_extractions(t).select("id", "document_id"))
q("W4_attempt_numbers", "extractions", "SELECT id, document_id, is_trial, row_number() OVER (PARTITION BY document_id, is_trial ORDER BY created_at, id) AS attempt FROM extractions")(lambda t: versions.attempts(t))
q("W7_one_active_version", "document_types", "SELECT name, count(*) FILTER (WHERE is_active) AS active FROM document_types GROUP BY 1 HAVING count(*) FILTER (WHERE is_active) > 1")(lambda t: versions.overactive(t))
q("A14_processor_summaries", "document_types processor_access", """
SELECT t.name, count(*) AS versions, max(CASE WHEN is_active THEN version END) AS active_version, max(CASE WHEN is_published THEN version END) AS published_version,
coalesce(array_to_string(list_sort(list(version) FILTER (WHERE NOT is_published)), ','), '') AS drafts, max_by(display_name, version) AS display_name, coalesce(max(g.n), 0) AS grants
FROM document_types t LEFT JOIN (SELECT processor_name, count(*) AS n FROM processor_access GROUP BY 1) g ON g.processor_name = t.name GROUP BY 1""")(lambda t, a: versions.processor_summaries(t, a))
q("A15_latest_published", "document_types", "SELECT name, max(CASE WHEN is_published THEN version END) AS latest_published FROM document_types GROUP BY 1")(lambda t: versions.latest_published(t))
q("A16_next_numbers", "extractions", "SELECT document_id, is_trial, count(*) + 1 AS next_attempt FROM extractions GROUP BY 1, 2")(lambda t: versions.next_attempt(t))
q("A16_next_version", "document_types", "SELECT name, max(version) + 1 AS next_version FROM document_types GROUP BY 1")(lambda t: versions.next_version(t))
q("J4_active_definitions", "document_types processors", "SELECT t.name, t.version FROM document_types t JOIN processors p ON p.name = t.name WHERE is_active AND is_published")(lambda t, p: versions.active_types(t).join(p, "name").select("name", "version"))
q("J5_candidates", "document_types processors processor_access", "SELECT t.name, t.version, t.display_name, NOT p.available_to_all AS dedicated FROM document_types t JOIN processors p ON p.name = t.name WHERE is_active AND is_published AND (p.available_to_all OR EXISTS (SELECT 1 FROM processor_access a WHERE a.processor_name = t.name AND a.organisation_id = '1'))")(lambda t, p, a: versions.candidates(t, p, a, "1"))
q("C10_candidates_unscoped", "document_types processors processor_access", "SELECT t.name, t.version, t.display_name, false AS dedicated FROM document_types t JOIN processors p ON p.name = t.name WHERE is_active AND is_published")(lambda t, p, a: versions.candidates(t, p, a, None))
q("J18_access_check", "document_types processor_access", "SELECT DISTINCT name FROM document_types t WHERE EXISTS (SELECT 1 FROM processor_access a WHERE a.processor_name = t.name AND a.organisation_id = '2')")(lambda t, a: versions.granted_only(t, a, "2"))
q("J7_organisations_with_access", "processor_access organisations", "SELECT o.id, o.name FROM organisations o JOIN processor_access a ON a.organisation_id = o.id WHERE a.processor_name = 'type_3'")(lambda a, o: versions.organisations_with_access(a, o, "type_3"))
q("J8_grant_changes", "processor_access organisations", "WITH c AS (SELECT organisation_id FROM processor_access WHERE processor_name = 'type_3'), w AS (SELECT id AS organisation_id FROM organisations WHERE id > '1') SELECT organisation_id, 'add' AS change FROM (SELECT * FROM w EXCEPT SELECT * FROM c) x UNION ALL SELECT organisation_id, 'remove' FROM (SELECT * FROM c EXCEPT SELECT * FROM w) y")(lambda a, o: versions.grant_changes(a.where("processor_name = 'type_3'").select("organisation_id"), o.where("id > '1'").select(F.col("id").alias("organisation_id"))))
q("J9_unknown_organisations", "processor_access organisations", "SELECT DISTINCT organisation_id FROM processor_access WHERE organisation_id NOT IN (SELECT id FROM organisations)")(lambda a, o: versions.unknown_organisations(a, o))
q("C18_withdraw", "ledger", "SELECT transaction_id FROM ledger WHERE CAST(transaction_id AS BIGINT) % 5 <> 0")(lambda t: versions.current_transactions(t, t.where("cast(transaction_id as bigint) % 5 = 0").select("document_id", (F.col("created_at") + F.expr("interval 1 day")).alias("at"))).select("transaction_id"))
q("C33_version_history", "document_types", "SELECT version, display_name FROM document_types WHERE name = 'type_4' ORDER BY version DESC")(lambda t: versions.history(t, "type_4").select("version", "display_name"))
q("C32_seeds_to_add", "document_types processors", "SELECT name FROM (SELECT name FROM processors UNION ALL SELECT 'brand_new') s WHERE name NOT IN (SELECT name FROM document_types)")(lambda t, p: versions.seeds_to_add(p.select("name").unionByName(p.limit(1).select(F.lit("brand_new").alias("name"))), t))
q("C30_add_version", "document_types", "SELECT name, version, is_active AND name <> 'type_2' OR (name = 'type_2' AND version = 5) AS is_active FROM (SELECT name, version, is_active FROM document_types UNION ALL SELECT 'type_2', 5, true) x")(lambda t: versions.add_version(t, t.where("name = 'type_2' and version = 1").select("name", "display_name", F.lit(True).alias("is_published"), F.lit(True).alias("is_active"), "created_by", "id")).select("name", "version", "is_active"))

# ---- history
q("W1_step_durations", "document_events", "SELECT id, document_id, to_status, epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY document_id ORDER BY created_at, id) AS step_micros FROM document_events")(lambda t: history.step_durations(t))
q("W2_elapsed", "document_events", "SELECT document_id, count(*) AS events, CASE WHEN count(*) > 1 THEN max(epoch_us(created_at)) - min(epoch_us(created_at)) END AS elapsed_micros FROM document_events GROUP BY 1")(lambda t: history.elapsed(t))
q("W5_corrected_fields", "corrections", "SELECT document_id, field, min_by(was, revision) AS was, max_by(now, revision) AS now, max_by(corrected_by, revision) AS corrected_by, max_by(created_at, revision) AS corrected_at FROM corrections GROUP BY 1, 2")(lambda t: history.corrected_fields(t))
q("W6_read_at", "extractions", "SELECT document_id, max(created_at) AS read_at FROM extractions WHERE NOT is_trial AND model_used <> 'correction' GROUP BY 1")(lambda t: history.read_at(t))
q("W8_merged_history", "document_events corrections", "SELECT document_id, 'event' AS kind, id, to_status AS what, created_at FROM document_events UNION ALL SELECT document_id, 'correction', id, field, created_at FROM corrections")(lambda e, c: history.merged_history(e, c))
q("U6_history_union", "document_events corrections", "SELECT kind, count(*) AS n FROM (SELECT 'event' AS kind FROM document_events UNION ALL SELECT 'correction' FROM corrections) x GROUP BY 1")(lambda e, c: history.merged_history(e, c).groupBy("kind").agg(F.count("*").alias("n")))
q("C34_document_detail", "document_events extractions", f"""
WITH e AS (SELECT document_id, count(*) AS events, CASE WHEN count(*) > 1 THEN max(epoch_us(created_at)) - min(epoch_us(created_at)) END AS elapsed_micros FROM document_events GROUP BY 1),
x AS (SELECT document_id, count(*) AS attempts, CAST(coalesce(sum({_c}) FILTER (WHERE NOT is_trial), 0) AS DECIMAL(24,6)) AS billed_usd, CAST(coalesce(sum({_c}) FILTER (WHERE is_trial), 0) AS DECIMAL(24,6)) AS trial_usd FROM extractions GROUP BY 1)
SELECT e.document_id, events, elapsed_micros, attempts, billed_usd, trial_usd FROM e LEFT JOIN x ON x.document_id = e.document_id""")(lambda e, x: history.document_detail(e, e, x))

# ---- uploads
q("S3_sha256", "uploads", "SELECT id, sha256(text) AS sha256 FROM uploads")(lambda t: t.select("id", F.sha2(F.col("text"), 256).alias("sha256")))
q("S1_storage_key", "uploads", "SELECT id, concat('raw/', organisation_id, '/', left(sha256(text), 2), '/', sha256(text)) AS storage_key FROM uploads")(lambda t: uploads.fingerprint(t, "text").select("id", "storage_key"))
q("S6_ingest_dedup", "uploads", "SELECT organisation_id, sha256(text) AS sha256, min(id) AS id, count(*) AS uploads FROM uploads GROUP BY 1, 2")(lambda t: uploads.ingest(uploads.fingerprint(t, "text")))
q("S6_ingest_against_table", "uploads", "SELECT organisation_id, sha256(text) AS sha256, min(id) AS id, count(*) AS uploads FROM uploads WHERE (organisation_id, sha256(text)) NOT IN (SELECT (organisation_id, sha256(text)) FROM uploads WHERE id % 4 = 0) GROUP BY 1, 2")(lambda t: uploads.ingest(uploads.fingerprint(t, "text"), uploads.fingerprint(t.where("id % 4 = 0"), "text").select("organisation_id", "sha256")))
q("S4_magic_bytes", "uploads", """
WITH b AS (SELECT id, CASE id % 9 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E470D0A1A0A00' WHEN 2 THEN '255044462D312E37' WHEN 3 THEN '49492A0008' WHEN 4 THEN '4D4D002A08' WHEN 5 THEN '524946460000000057454250' WHEN 6 THEN '000000186674797068656963' WHEN 7 THEN '000000186674797061766966' ELSE '' END AS h FROM uploads)
SELECT id, CASE WHEN starts_with(h, 'FFD8FF') THEN 'image/jpeg' WHEN starts_with(h, '89504E470D0A1A0A') THEN 'image/png' WHEN starts_with(h, '255044462D') THEN 'application/pdf' WHEN starts_with(h, '49492A00') OR starts_with(h, '4D4D002A') THEN 'image/tiff'
WHEN starts_with(h, '52494646') AND substring(h, 17, 8) = '57454250' THEN 'image/webp' WHEN substring(h, 9, 8) = '66747970' AND substring(h, 17, 8) IN ('68656963','68656978','68657663','6D696631') THEN 'image/heic' END AS mime_type,
CASE WHEN h = '' THEN 400 WHEN id % 9 = 7 THEN 415 END AS refusal FROM b""")(lambda t: uploads.gate(_headers(t)).select("id", "mime_type", "refusal"))
q("S5_upload_gate", "uploads", "SELECT id, CASE WHEN octet_length(encode(text)) = 0 THEN 400 WHEN octet_length(encode(text)) > 5000 THEN 413 ELSE 415 END AS refusal, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM uploads")(lambda t: uploads.gate(t.withColumn("content", F.col("text").cast("binary")), max_bytes=5000).select("id", "refusal", F.col("size_bytes").cast("long").alias("size_bytes")))
q("T11_gate_at_cap", "uploads", "SELECT id, CASE WHEN id % 9 IN (7, 8) THEN CASE WHEN id % 9 = 8 THEN 400 ELSE 415 END WHEN (organisation_id, id % 9) NOT IN (SELECT (organisation_id, id % 9) FROM uploads WHERE id % 4 = 0) THEN 429 END AS refusal FROM uploads")(
    lambda t: uploads.gate(_headers(t), existing=uploads.fingerprint(_headers(t.where("id % 4 = 0"))).select("organisation_id", "sha256")).select("id", "refusal"))
q("S7_base64_source", "uploads", "SELECT id, CASE WHEN id % 3 <> 0 THEN octet_length(encode(text)) END AS n FROM uploads")(lambda t: t.select("id", F.octet_length(uploads.decode_base64(F.concat(F.translate(F.base64(F.col("text").cast("binary")), "\r\n", ""), F.when(F.col("id") % 3 == 0, "!").otherwise("")))).cast("long").alias("n")))
q("S8_fit_filename", "uploads", "SELECT id, CASE WHEN length(text) > 255 THEN concat('…', right(text, 254)) ELSE text END AS name FROM uploads")(lambda t: t.select("id", S.fit_filename(F.col("text")).alias("name")))


def _headers(t: DataFrame) -> DataFrame:
    heads = ["FFD8FFE0", "89504E470D0A1A0A00", "255044462D312E37", "49492A0008", "4D4D002A08", "524946460000000057454250", "000000186674797068656963", "000000186674797061766966", ""]
    return t.withColumn("content", F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("id") % 9 + 1).cast("int"))))


# ---- people
q("P15_pending_invitations", "invitations", "SELECT id FROM invitations WHERE NOT accepted AND NOT revoked AND expires_at > DATE '2024-01-15'")(lambda t: people.pending_invitations(t, NOW.date()).select("id"))
q("U1_members", "users invitations", "SELECT rank, id, email, role, created_at FROM (SELECT 0 AS rank, id, email, role, created_at FROM users WHERE organisation_id = '2' UNION ALL SELECT 1, id, email, role, created_at FROM invitations WHERE organisation_id = '2' AND NOT accepted AND NOT revoked AND expires_at > DATE '2024-01-15') x")(lambda u, i: people.members(u, i, "2", NOW.date()))
q("O8_members_first", "users invitations", "SELECT id, rank FROM (SELECT 0 AS rank, id, created_at FROM users WHERE organisation_id = '2' UNION ALL SELECT 1, id, created_at FROM invitations WHERE organisation_id = '2' AND NOT accepted AND NOT revoked AND expires_at > DATE '2024-01-15') x ORDER BY rank, created_at, id LIMIT 30")(lambda u, i: people.members(u, i, "2", NOW.date()).limit(30).select("id", "rank"))
q("A21_admin_count", "users", "SELECT organisation_id, count(*) AS admins FROM users WHERE is_active AND role = 'admin' GROUP BY 1")(lambda t: people.admin_count(t))

# ---- jobs
_ready = "status = 'queued' AND run_after <= TIMESTAMP '2024-01-15 00:00:00'"
q("P14_ready_jobs", "jobs", f"SELECT id FROM jobs WHERE {_ready}")(lambda t: jobs.ready(t, NOW).select("id"))
q("O5_head_of_queue", "jobs", f"SELECT id FROM jobs WHERE {_ready} ORDER BY run_after, id LIMIT 1")(lambda t: jobs.claim(t, NOW).select("id"))
q("T1_claim", "jobs", f"SELECT id, 'running' AS status, CAST(attempts + 1 AS INT) AS attempts FROM jobs WHERE {_ready} ORDER BY run_after, id LIMIT 25")(lambda t: jobs.claim(t, NOW, 25).select("id", "status", "attempts"))
q("T2_reclaim_stale", "jobs", "SELECT id, CASE WHEN status = 'running' AND locked_at < TIMESTAMP '2024-01-14 23:45:00' THEN 'queued' ELSE status END AS status, attempts FROM jobs")(lambda t: jobs.reclaim_stale(t, NOW).select("id", "status", "attempts"))
q("T3_retry_with_backoff", "jobs", "SELECT id, CASE WHEN attempts < max_attempts THEN 'queued' ELSE 'failed' END AS status, CASE WHEN attempts < max_attempts THEN TIMESTAMP '2024-01-15 00:00:00' + to_seconds(CAST(pow(4, attempts) AS BIGINT)) ELSE run_after END AS run_after FROM jobs WHERE status = 'running'")(lambda t: jobs.after_failure(t.where("status = 'running'"), NOW).select("id", "status", "run_after"))
q("T4_final_status", "jobs", "SELECT id, CASE WHEN kind = 'ocr' THEN 'ocr_failed' ELSE 'needs_review' END AS document_status FROM jobs WHERE attempts >= max_attempts")(lambda t: jobs.final_status(t.where("attempts >= max_attempts")).select("id", "document_status"))
q("T4_settle_failures", "jobs", """
SELECT id, CASE WHEN id % 3 = 0 OR attempts >= max_attempts THEN 'failed' ELSE 'queued' END AS status, CASE WHEN id % 3 = 0 THEN 'refused' WHEN attempts >= max_attempts THEN 'exhausted' END AS failure,
CASE WHEN id % 3 = 0 OR attempts >= max_attempts THEN CASE WHEN kind = 'ocr' THEN 'ocr_failed' ELSE 'needs_review' END END AS document_status FROM jobs WHERE status = 'running'""")(
    lambda t: jobs.settle(t.where("status = 'running'").withColumn("permanent", F.col("id") % 3 == 0), NOW).select("id", "status", "failure", "document_status"))
q("T7_spend_cap_deferral", "jobs extractions", "WITH s AS (SELECT coalesce(sum(cost_usd), 0) >= 100 AS o FROM extractions WHERE CAST(created_at AS DATE) = DATE '2024-01-15') SELECT id, CASE WHEN o AND kind = 'extract' AND status = 'running' THEN 'queued' ELSE status END AS status, CASE WHEN o AND kind = 'extract' AND status = 'running' THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts FROM jobs, s")(lambda t, e: jobs.defer_over_cap(t, costs.daily_spend(e, NOW.date()), 100, NOW).select("id", "status", "attempts"))
q("F22_backoff", "jobs", "SELECT id, CAST(pow(4, attempts) AS BIGINT) AS seconds FROM jobs")(lambda t: t.select("id", S.backoff_seconds(F.col("attempts")).alias("seconds")))
q("F18_duration_text", "extractions", "SELECT id, CASE WHEN s < 1 THEN concat(CAST(CAST(round(s * 1000) AS INT) AS STRING), ' ms') WHEN s < 60 THEN concat(printf('%.1f', s), ' s') WHEN s < 3600 THEN concat(CAST(CAST(round(s / 60) AS INT) AS STRING), ' min') ELSE concat(printf('%.1f', s / 3600), ' h') END AS took FROM (SELECT id, CAST(id % 7919 AS DOUBLE) / 4 AS s FROM extractions) x")(lambda t: t.select("id", S.duration_text((F.col("id") % 7919).cast("double") / 4).alias("took")))

# ---- scoring
_leaf = f"(SELECT name, path, {outcome_sql('expected', 'actual')} AS outcome FROM label_leaves)"
_leaf2 = f"(SELECT name, path, {outcome_sql('expected', 'second')} AS outcome FROM label_leaves)"
_score = lambda t, side="actual": scoring.score_leaves(t, "expected", side)
q("C21_score_leaves", "label_leaves", f"SELECT name, path, outcome FROM {_leaf} x")(lambda t: _score(t).select("name", "path", "outcome"))
q("A17_field_tally", "label_leaves", f"SELECT regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS path, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in scoring.OUTCOMES) + f" FROM {_leaf} x GROUP BY 1")(lambda t: scoring.tally(_score(t)))
q("A18_field_accuracy", "label_leaves", f"SELECT regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS path, avg(CASE WHEN outcome IN {PASS_SQL} THEN 1.0 ELSE 0.0 END) AS accuracy FROM {_leaf} x GROUP BY 1")(lambda t: scoring.accuracy_by_path(_score(t)))
q("A18_overall_accuracy", "label_leaves", f"SELECT avg(CASE WHEN outcome IN {PASS_SQL} THEN 1.0 ELSE 0.0 END) AS accuracy FROM {_leaf} x")(lambda t: scoring.overall_accuracy(_score(t)))
q("A18_routing_accuracy", "documents_list", "SELECT avg(CASE WHEN doc_type = 'receipt' THEN 1.0 ELSE 0.0 END) AS routing_accuracy FROM (SELECT coalesce(doc_type, '') AS doc_type FROM documents_list) x")(lambda t: scoring.routing_accuracy(t.select(F.lit("receipt").alias("expected_type"), F.col("doc_type").alias("actual_type"))))
q("A19_run_costs", "extractions", "SELECT model_used AS run, CAST(coalesce(sum(cost_usd), 0) AS DECIMAL(24,6)) AS total_usd, count(*) AS documents, CAST(floor(sum(latency_ms) / count(latency_ms)) AS BIGINT) AS mean_latency_ms FROM extractions GROUP BY 1")(lambda t: scoring.run_costs(t.withColumnRenamed("model_used", "run")).drop("per_document_usd"))
q("J12_changes", "label_leaves", f"SELECT a.name, a.path, a.outcome AS before, b.outcome AS after, a.outcome IN {PASS_SQL} AND b.outcome NOT IN {PASS_SQL} AS regression, a.outcome NOT IN {PASS_SQL} AND b.outcome IN {PASS_SQL} AS improvement FROM {_leaf} a JOIN {_leaf2} b ON a.name = b.name AND a.path = b.path WHERE a.outcome <> b.outcome")(lambda t: scoring.changes(_score(t), _score(t, "second")))
_acc = lambda leaf: f"(SELECT regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS path, avg(CASE WHEN outcome IN {PASS_SQL} THEN 1.0 ELSE 0.0 END) AS accuracy FROM {leaf} x GROUP BY 1)"
q("J13_accuracy_deltas", "label_leaves", f"SELECT coalesce(a.path, b.path) AS path, coalesce(a.accuracy, 0.0) AS before, coalesce(b.accuracy, 0.0) AS after, coalesce(b.accuracy, 0.0) - coalesce(a.accuracy, 0.0) AS delta FROM {_acc(_leaf)} a FULL JOIN {_acc(_leaf2.replace('FROM label_leaves', chr(70) + 'ROM label_leaves WHERE path <> ' + chr(39) + 'vendor' + chr(39)))} b ON a.path = b.path")(lambda t: scoring.accuracy_deltas(_score(t), _score(t.where("path <> 'vendor'"), "second")))
q("J14_positional_zip", "lineitem", "SELECT coalesce(a.k, b.k) AS name, coalesce(a.i, b.i) AS index, a.v AS expected, b.v AS actual FROM (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity AS v FROM lineitem WHERE l_linenumber < 4 GROUP BY ALL) a FULL JOIN (SELECT l_orderkey AS k, l_linenumber AS i, l_discount AS v FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL) b ON a.k = b.k AND a.i = b.i")(lambda t: scoring.zip_entries(t.where("l_linenumber < 4").select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("index"), F.col("l_quantity").alias("value")).distinct(), t.where("l_linenumber > 2").select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("index"), F.col("l_discount").alias("value")).distinct()))
q("J15_unlabelled", "documents labels", "SELECT doc_id AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda d, l: scoring.unlabelled(d.select(F.col("doc_id").alias("name")), l.select(F.col("doc_id").alias("name"))))
q("O6_report_order", "label_leaves", f"SELECT path, accuracy FROM {_acc(_leaf)} z ORDER BY accuracy, path LIMIT 2")(lambda t: scoring.accuracy_by_path(_score(t)).limit(2))
q("U2_compared_keys", "label_leaves", "SELECT name, path FROM label_leaves WHERE expected IS NOT NULL INTERSECT SELECT name, path FROM label_leaves WHERE second IS NOT NULL")(lambda t: scoring.compared_keys(t.where("expected is not null"), t.where("second is not null")))
q("U3_union_of_paths", "label_leaves", "SELECT DISTINCT path FROM label_leaves")(lambda t: t.where("name % 2 = 0").select("path").union(t.select("path")).distinct())
q("U4_unknown_fields", "label_leaves", "SELECT DISTINCT path FROM label_leaves WHERE path NOT IN ('total', 'vendor')")(lambda t: t.select("path").distinct().join(t.select("path").where("path in ('total','vendor')").distinct(), "path", "left_anti"))
q("F13_normalised_answers", "uploads", "SELECT id, trim(replace(replace(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'ß', 'ss'), 'ς', 'σ')) AS answer FROM uploads")(lambda t: t.select("id", S.normalise_answer(F.col("text")).alias("answer")))
q("F14_collapse_path", "label_leaves", "SELECT DISTINCT regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS path FROM label_leaves")(lambda t: t.select(S.collapse_path(F.col("path")).alias("path")).distinct())
q("F16_type_label", "document_types", "SELECT DISTINCT name, concat(upper(left(name, 1)), lower(replace(substring(name, 2), '_', ' '))) AS label FROM document_types")(lambda t: t.select("name", S.type_label(F.col("name")).alias("label")).distinct())
q("F11_whole_word", "documents", "SELECT doc_id, regexp_matches(lower(regexp_replace(text, '\\s+', ' ', 'g')), '(^|[^\\p{L}\\p{Nl}\\p{No}])license([^\\p{L}\\p{Nl}\\p{No}]|$)') AS found FROM documents")(lambda t: t.select("doc_id", S.has_word(S.normalise(F.col("text")), "license").alias("found")))
q("F7_text_clean", "documents", "SELECT doc_id, CASE WHEN left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200) <> '' THEN left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200) END AS cleaned FROM documents")(lambda t: t.select("doc_id", S.clean_text(F.col("text"), 200).alias("cleaned")))
q("F8_currency_clean", "documents", "SELECT doc_id, CASE WHEN regexp_matches(trim(s), '^[A-Za-z]{3}$') THEN upper(trim(s)) END AS currency FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat(' ', lang, 'r ') WHEN 1 THEN lang ELSE text END AS s FROM documents) x")(
    lambda t: t.select("doc_id", S.clean_currency(F.expr("CASE doc_id % 3 WHEN 0 THEN concat(' ', lang, 'r ') WHEN 1 THEN lang ELSE text END")).alias("currency")))
q("F3_money_parse", "lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(trim(s), '^-?\\d+([.,]\\d{1,2})?$') THEN TRY_CAST(replace(trim(s), ',', '.') AS DECIMAL(14,4)) END AS amount FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN concat(' ', CAST(CAST(l_quantity AS INT) AS STRING), ',5 ') WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '.25') WHEN 2 THEN '1,234' ELSE '€5' END AS s FROM lineitem) x")(lambda t: t.select("l_orderkey", "l_linenumber", S.parse_money(F.expr("CASE l_linenumber % 4 WHEN 0 THEN concat(' ', string(int(l_quantity)), ',5 ') WHEN 1 THEN concat(string(int(l_quantity)), '.25') WHEN 2 THEN '1,234' ELSE '€5' END")).alias("amount")))
q("F4_date_parse", "lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}$') THEN TRY_CAST(s AS DATE) END AS day FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN '2026-02-30' ELSE strftime(l_shipdate, '%Y%m%d') END AS s FROM lineitem) x")(lambda t: t.select("l_orderkey", "l_linenumber", S.parse_date(F.expr("CASE l_linenumber % 3 WHEN 0 THEN date_format(l_shipdate, 'yyyy-MM-dd') WHEN 1 THEN '2026-02-30' ELSE date_format(l_shipdate, 'yyyyMMdd') END")).alias("day")))
q("F24_utc_day_bounds", "events", "SELECT event_id, date_trunc('day', ts) AS day_start, date_trunc('day', ts) + INTERVAL 1 DAY AS tomorrow FROM events")(lambda t: t.select("event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day_start"), (F.date_trunc("day", "ts") + F.expr("interval 1 day")).cast("timestamp_ntz").alias("tomorrow")))
q("X5_explode_line_items", "lineitem", "SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,4))) AS DECIMAL(24,4)) AS items_total, count(*) AS items FROM lineitem GROUP BY 1")(lambda t: t.select("l_orderkey", F.explode(F.array(F.struct("l_linenumber", F.col("l_extendedprice").cast("decimal(14,4)").alias("amount")))).alias("item")).groupBy("l_orderkey").agg(F.sum("item.amount").cast("decimal(24,4)").alias("items_total"), F.count("*").alias("items")))
