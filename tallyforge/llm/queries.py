"""The registered queries of this package: thin digests over its operators, each on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, langid, linededup, metric_join, packing, simhash, topk, toxicity, warc
from .common import fold_of, read_table

TOXIC_FOLDS, LANG_FOLDS = (5, 0), (4, 2)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; they are installed beside Python, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, folds=TOXIC_FOLDS[0], held_out=TOXIC_FOLDS[1])
    found = toxicity.score_toxicity(docs, model)
    held_out = F.coalesce(fold_of("doc_id", TOXIC_FOLDS[0]) == TOXIC_FOLDS[1], F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(read_table(spark, sf_dir, "pages"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read_table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = langid.train(docs, folds=LANG_FOLDS[0], held_out=LANG_FOLDS[1])
    found = langid.identify_language(docs, net)
    held_out = F.coalesce(fold_of("doc_id", LANG_FOLDS[0]) == LANG_FOLDS[1], F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def pack(docs: DataFrame) -> DataFrame:
    tokens, ranks, pattern = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern()
    return packing.pack_documents(docs, lambda: packing.twin_encoder(tokens, ranks, pattern))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "text")


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash_near_dedup, op2_toxicity, op3_html_extraction, op4_exact_top_k, op5_language_id, op6_best_fit_packing, op7_embedding_near_dedup, op8_warc, op9_line_dedup, op10_byte_level_bpe)
}

#: DuckDB SQL on the same tables. The others have no SQL form and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_exact_top_k": """
WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT vec_id, list_transform(e, lambda x: floor(256 * x)) AS q FROM u
      WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_embedding_near_dedup": """
WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (SELECT vec_id, e FROM u WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
c(a, b) AS (SELECT vec_id, vec_id FROM u UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM c GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT u.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, m.component_id, u.vec_id = m.component_id AS kept
FROM u JOIN m ON m.a = u.vec_id LEFT JOIN n ON n.a = u.vec_id""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS sha FROM p),
t AS (SELECT sha, n, max(page_id) AS top FROM d GROUP BY sha, n)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.sha AS payload_digest,
       CASE WHEN d.n >= 1000 AND d.page_id <> t.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.n >= 1000 AND d.page_id <> t.top THEN t.top END AS refers_to
FROM d JOIN t ON t.sha = d.sha AND t.n = d.n""",
}
