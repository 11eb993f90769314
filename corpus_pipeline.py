"""A corpus pipeline over documents: five stages, each written as Parquet and read again by the next.

Stages, in order: toxicity (rejects go), language ID (rejects go), line dedup, SimHash
near-dedup (one document of each group stays) and best-fit packing. All but the last
return the columns of documents. No stage drops rows that it does not reject; a text may
lose repeated lines, and one that consists of nothing else ends up empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import langid, linededup, simhash, toxicity
from tallyforge.llm.common import cut, read_table
from tallyforge.llm.queries import LANG_FOLDS, TOXIC_FOLDS, pack

#: A language is accepted from this mean probability on; chance is a quarter with four languages.
MIN_LANGUAGE_SCORE = 0.3


def _decided(docs: DataFrame, decide) -> DataFrame:
    """Rows of ``docs`` that ``decide(frame, id_col, text_col, keep)`` returns; column names cannot clash with its own."""
    inner = [f"__c{k}" for k in range(len(docs.columns))]
    of = dict(zip(docs.columns, inner))
    return decide(docs.toDF(*inner), of["doc_id"], of["text"], inner).select(*inner).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), folds=TOXIC_FOLDS[0], held_out=TOXIC_FOLDS[1])
    return _decided(docs, lambda df, i, t, keep: toxicity.score_toxicity(df, model, i, t, keep=keep).where("predicted = 0"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; undetermined and doubtful ones go."""
    net = langid.train(docs, folds=LANG_FOLDS[0], held_out=LANG_FOLDS[1])
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return _decided(docs, lambda df, i, t, keep: langid.identify_language(df, net, i, t, keep=keep).where(known))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts freed of lines that occur earlier in the corpus."""
    return linededup.dedup_lines(docs).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one_per_component(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("best_fit_packing", pack_sequences),
]

#: Trained classifiers and fingerprints have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{name}")
    return docs
