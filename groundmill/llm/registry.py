"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundmill.llm import decontaminate, langid, media, packing, pii, quality, quotes, toxicity, urls
from groundmill.llm.jaccard import jaccard_classes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def remainder(n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n))


@query
def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of copies of each picture; the tables hold no pictures, so embeddings are drawn as such."""
    return media.find_copies(media.render_vectors(table(spark, sf_dir, "embeddings")))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain over the two labels that the tables have, low quality first, then toxic, over all documents."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    chain = toxicity.fit(docs, labels, ["low_quality", "toxic"])
    return toxicity.predict(docs, chain)


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items that a passage of a document retrieves, verified."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, similarity 0.9."""
    return jaccard_classes(table(spark, sf_dir, "documents"), k=3, percent=90)


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labelled rows whose remainder is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(remainder(3) != 1))
    return quality.score_quality(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from rows whose remainder is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder(4) != 2))
    return langid.identify(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of all conversations, without quotes; the table holds none, so they are drawn from earlier messages."""
    return quotes.link_quotes(quotes.with_quotes(table(spark, sf_dir, "conversations")))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of personal data of all documents."""
    return pii.pii_report(table(spark, sf_dir, "documents"))


@query
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page addresses."""
    return urls.judge_urls(table(spark, sf_dir, "pages"))


_HOST = "translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)"
_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for h, p in (("www.example.com", "/en/"), ("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/"), ("com", "/"))
)
_WORDS = "|".join(urls.WORDS)
ORACLES["op10_urls"] = f"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN {_HOST} ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN {_PATH} ELSE '' END AS path FROM pages),
judged AS (SELECT page_id, host, path, CASE {_FITS} END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])({_WORDS})($|[^A-Za-z0-9])') THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""
