"""Deterministic stand-ins for the domain tables, as SQL over the benchmark tables.

The statements are written in the dialect that Spark and DuckDB share, so the same text
feeds the engine and its oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.transform import dealt

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

STATUSES = ("uploaded", "ocr_done", "ocr_failed", "classified", "unsupported", "extracted", "validated", "needs_review", "rejected", "committed", "synced", "reprocessing")

_status = "CASE o_orderkey % 12 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(STATUSES)) + " END"

VIEWS: dict[str, str] = {
    "ledger": """
SELECT CAST(o_orderkey AS STRING) AS transaction_id, CAST(o_orderkey AS STRING) AS document_id, CAST(n_regionkey AS STRING) AS organisation_id,
  CAST(o_orderkey + 1000000 AS STRING) AS source_extraction_id,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS occurred_on,
  c_name AS counterparty, CASE WHEN o_orderstatus = 'F' THEN 'in' ELSE 'out' END AS direction,
  CAST(o_totalprice AS DECIMAL(14,4)) AS amount,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(14,4)) * CAST(0.21 AS DECIMAL(4,2)) AS DECIMAL(14,4)) END AS tax_amount,
  CASE n_regionkey WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' END AS currency,
  o_orderpriority AS category, (o_orderkey % 3 = 0) AS user_verified, (o_orderkey % 10 <> 3) AS is_current, o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "extractions": """
SELECT event_id AS id, user_id AS document_id, CAST(user_id % 5 AS STRING) AS organisation_id, CASE WHEN event_id % 2 = 0 THEN 'receipt' ELSE 'invoice' END AS doc_type,
  CASE WHEN event_id % 13 = 0 THEN 'correction' WHEN event_id % 3 = 0 THEN 'small' WHEN event_id % 3 = 1 THEN 'medium' ELSE 'large' END AS model_used,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS raw_json, event_type = 'signup' AS is_trial,
  CAST(event_id % 500 AS BIGINT) AS input_tokens, CAST(event_id % 90 AS BIGINT) AS output_tokens, CAST(event_id % 30 AS BIGINT) AS cache_read_tokens,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(CAST(value AS DECIMAL(12,4)) AS DECIMAL(12,6)) END AS cost_usd,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 997 AS BIGINT) END AS latency_ms, ts AS created_at
FROM events""",
    "document_events": """
SELECT event_id AS id, user_id AS document_id, CAST(user_id % 5 AS STRING) AS organisation_id, event_type AS to_status, ts AS created_at FROM events""",
    "documents_list": f"""
SELECT CAST(o_orderkey AS STRING) AS id, CAST(n_regionkey AS STRING) AS organisation_id, {_status} AS status, o_orderdate AS uploaded_at,
  CASE WHEN o_orderkey % 3 = 0 THEN 'receipt' WHEN o_orderkey % 3 = 1 THEN 'invoice' END AS doc_type,
  CASE WHEN o_orderkey % 17 = 0 THEN '=SUM(A1)' WHEN o_orderkey % 5 = 0 THEN NULL ELSE c_name END AS supplier,
  CASE WHEN o_orderkey % 9 = 0 THEN 'scan_100%.pdf' ELSE concat('scan-', CAST(o_orderkey AS STRING), '.pdf') END AS original_filename,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS document_date,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(14,4)) END AS total_amount,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN n_regionkey < 2 THEN 'EUR' ELSE 'USD' END AS total_currency
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "organisations": "SELECT CAST(r_regionkey AS STRING) AS id, r_name AS name FROM region WHERE r_regionkey < 4",
    "processors": "SELECT concat('type_', CAST(n_nationkey AS STRING)) AS name, n_nationkey % 4 = 0 AS available_to_all FROM nation WHERE n_nationkey < 20",
    "processor_access": "SELECT concat('type_', CAST(n_nationkey AS STRING)) AS processor_name, CAST(r_regionkey AS STRING) AS organisation_id FROM nation CROSS JOIN region WHERE (n_nationkey + r_regionkey) % 3 = 0",
    "document_types": """
SELECT concat('type_', CAST(p_partkey % 25 AS STRING)) AS name, CAST(1 + p_partkey / 25 AS BIGINT) AS version, p_name AS display_name,
  (p_partkey % 7 <> 0) AS is_published, (p_partkey >= 50 AND p_partkey < 75 AND p_partkey % 7 <> 0) AS is_active, 'built-in' AS created_by, CAST(p_partkey AS BIGINT) AS id
FROM part WHERE p_partkey < 100 AND p_partkey % 25 < 24""".replace("1 + p_partkey / 25", "1 + floor(p_partkey / 25)"),
    "corrections": """
SELECT event_id AS id, user_id AS document_id, CAST(event_id AS BIGINT) AS revision, CASE event_id % 3 WHEN 0 THEN 'total' WHEN 1 THEN 'vendor' ELSE 'currency' END AS field,
  CAST(value AS STRING) AS was, event_type AS now, concat('user', CAST(event_id % 4 AS STRING)) AS corrected_by, ts AS created_at
FROM events WHERE event_id % 5 = 0""",
    "jobs": """
SELECT event_id AS id, user_id AS document_id, CASE WHEN event_id % 2 = 0 THEN 'ocr' ELSE 'extract' END AS kind,
  CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'queued' ELSE 'running' END AS status,
  CAST(event_id % 4 AS INT) AS attempts, 3 AS max_attempts, ts AS run_after, CASE WHEN event_type IN ('click', 'error') THEN ts END AS locked_at
FROM events""",
    "users": """
SELECT c_custkey AS id, CAST(c_nationkey % 5 AS STRING) AS organisation_id, CASE WHEN c_custkey % 6 = 0 THEN 'admin' ELSE 'member' END AS role, c_custkey % 9 <> 0 AS is_active,
  c_name AS email, DATE '2024-01-01' AS created_at FROM customer""",
    "invitations": """
SELECT s_suppkey AS id, CAST(s_nationkey % 5 AS STRING) AS organisation_id, 'member' AS role, s_name AS email, s_suppkey % 3 = 0 AS accepted, s_suppkey % 7 = 0 AS revoked,
  CASE WHEN s_suppkey % 2 = 0 THEN DATE '2024-02-01' ELSE DATE '2023-12-01' END AS expires_at, DATE '2024-01-02' AS created_at FROM supplier""",
    "answers": """
SELECT o_orderkey AS document_id, CAST(o_orderdate AS DATE) AS printed, CAST(o_totalprice AS DECIMAL(14,2)) AS price,
  concat('{"vendor":', CASE WHEN o_orderkey % 11 = 0 THEN 'null' WHEN o_orderkey % 11 = 1 THEN '"  "' WHEN o_orderkey % 11 = 2 THEN '17' ELSE concat('"Shop  ', CAST(o_custkey AS STRING), '"') END,
  ',"total":', CASE o_orderkey % 5 WHEN 0 THEN '"1,234"' WHEN 1 THEN 'null' ELSE concat('"', CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING), '"') END,
  ',"issued":', CASE WHEN o_orderkey % 7 = 0 THEN '"2026-02-30"' ELSE concat('"', CAST(CAST(o_orderdate AS DATE) AS STRING), '"') END,
  ',"quantity":', CASE WHEN o_orderkey % 3 = 0 THEN '5.0' ELSE CAST(o_orderkey % 100 AS STRING) END,
  ',"net":"', CAST(CAST(o_totalprice AS DECIMAL(14,2)) - 1 AS STRING), '","vat":"', CASE WHEN o_orderkey % 4 = 0 THEN '2.00' ELSE '1.01' END,
  '","currency":"', CASE WHEN o_orderkey % 6 = 0 THEN 'Euros' ELSE ' eur ' END, '","extra":1,"items":[{"name":"a","amount":"1.00"},{"name":"b","amount":', CASE WHEN o_orderkey % 6 = 0 THEN 'null' ELSE '"2,50"' END, '}', CASE WHEN o_orderkey % 9 = 0 THEN ',7' ELSE '' END, ']}') AS answer
FROM orders""",
    "uploads": "SELECT doc_id AS id, CAST(doc_id % 3 AS STRING) AS organisation_id, text, source FROM documents",
    "label_leaves": """
SELECT doc_id AS name, path, CASE WHEN (doc_id + k) % 5 = 0 THEN NULL ELSE concat('v', CAST(quality + k AS STRING)) END AS expected,
  CASE WHEN (doc_id + k) % 7 = 0 THEN NULL WHEN (doc_id * 3 + k) % 4 = 0 THEN 'v9' ELSE concat('V', CAST(quality + k AS STRING), ' ') END AS actual,
  CASE WHEN (doc_id + k) % 6 = 0 THEN NULL WHEN (doc_id + k) % 11 = 0 THEN 'v8' ELSE concat('v', CAST(quality + k AS STRING)) END AS second
FROM labels CROSS JOIN (SELECT 0 AS k, 'total' AS path UNION ALL SELECT 1, 'vendor' UNION ALL SELECT 2, 'items[0].name' UNION ALL SELECT 3, 'items[1].name') AS paths""",
}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table of ``VIEWS`` (or a base table) as a DataFrame."""
    if name in BASE_TABLES:
        return base_table(spark, sf_dir, name)
    import re

    used = [t for t in BASE_TABLES if re.search(rf"\b{t}\b", VIEWS[name])]
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} AS {t}", text)
    frames = {t: base_table(spark, sf_dir, t) for t in used if f"{{{t}}}" in text}
    if name == "answers":  # dealt out as orders, which are a tenth of the answers made of them
        frames = {t: dealt(frame) for t, frame in frames.items()}
    return spark.sql(text, **frames)


def with_views(*names: str) -> str:
    """``WITH name AS (...)`` for an oracle statement."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
