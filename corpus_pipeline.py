"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundmill.llm import decontaminate, langid, packing, pii
from groundmill.llm._store import bounded, cut, release
from groundmill.llm.jaccard import BROADCAST_IDS, jaccard_classes
from groundmill.llm.registry import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language less certain than this is rejected, as is a text without letters.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known with enough certainty; ``lang`` is the predicted one."""
    model = langid.fit(docs)
    found = langid.identify(docs, model, keep=("source", "n_chars"), with_text=True)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` but for some ids: a broadcast while their number is bounded, else a shuffle."""
    dropped = cut(dropped.distinct(), "dropped")
    return docs.join(F.broadcast(dropped) if bounded(dropped, BROADCAST_IDS) else dropped, "doc_id", "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five words, similarity 0.8, the least id."""
    classes = jaccard_classes(docs, k=5, percent=80)
    return _without(docs, classes.where("doc_id <> component_id").select("doc_id"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a verified passage of a test item."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("leak").select("doc_id"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars`` follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0))).select(*COLUMNS)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into token windows."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data), ("windows", windows),
]

#: Neither the models nor the tokenizer can be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir), name)
        release(docs)  # the documents themselves are no table of ours and stay
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
