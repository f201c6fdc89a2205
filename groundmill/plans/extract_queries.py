"""Queries that extract spans, contexts and relations, and the document pipeline that joins them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmill.functions import text as T
from groundmill.operators import context, extract, mining, relations, segment
from groundmill.plans import pipeline
from groundmill.plans.registry import query


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Words of the test corpora that play the part of context cues (fixed values).
CUES = [("c1", "not", "NEGATED", "left", 3, 30), ("c2", "was", "HISTORICAL", "bidirectional", 1, 40), ("c3", "or", "POSSIBLE", "right", 2, 25), ("c4", "if", "CONDITIONAL", "left", 2, 40)]
CUE_SCHEMA = "rule_id string, cue string, assertion string, scope string, priority int, most int"


def _concepts(spark, d):
    """The dictionary of these queries: the words of eight letters and more found in 10 documents or more."""
    m = _t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("alias")).where(F.length("alias") >= 8)
    return m.groupBy("alias").agg(F.count("*").alias("n")).where("n >= 10").select(F.col("alias").alias("concept_id"), "alias")


_WORDS = """words AS (SELECT w FROM (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents) WHERE length(w) >= 8 GROUP BY w HAVING count(*) >= 10)"""


@query(
    "dictionary_spans",
    f"""WITH {_WORDS}, t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM documents)
    SELECT doc_id, w AS concept_id, count(*) AS spans FROM t JOIN words USING (w) GROUP BY ALL""",
)
def dictionary_spans(spark, d):
    """Exact spans of the dictionary's words, all through one automaton."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    m = extract.dictionary_matches(docs, _concepts(spark, d), "doc_id", "text").where("exact").join(docs, "doc_id")
    around = F.substr("text", F.greatest("start", F.lit(1)), F.col("end") - F.col("start") + F.when(F.col("start") > 0, 2).otherwise(1))
    whole = around.rlike(r"^[^\p{L}\p{N}]?[\p{L}\p{N}]+[^\p{L}\p{N}]?$")  # an upper-case letter may follow a match, but not a token
    return m.where(whole & (F.length(F.regexp_replace(around, r"[^\p{L}\p{N}]", "")) == F.col("end") - F.col("start"))).groupBy("doc_id", "concept_id").agg(F.count("*").alias("spans"))


@query("resolved_spans")
def resolved_spans(spark, d):
    """Dictionary spans without boundaries, chosen by weighted interval scheduling."""
    m = extract.dictionary_matches(_t(spark, d, "documents"), _concepts(spark, d), "doc_id", "text", boundaries=False)
    m = m.withColumn("weight", extract.match_weight(F.col("end") - F.col("start"), F.lit(False), F.col("exact")).cast("double"))
    return extract.resolve_weighted(m.dropDuplicates(["doc_id", "start", "end"]), "doc_id").select("doc_id", "start", "end", "alias")


@query(
    "sections_by_heading",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS v FROM documents)
    SELECT doc_id, greatest(1, count(CASE WHEN regexp_matches(lower(regexp_replace(v, '^\\s*([0-9]+[.)]\\s*)*', '')), '^(the|and|is)([\\s:]|$)') THEN 1 END)) AS sections FROM l GROUP BY doc_id""",
)
def sections_by_heading(spark, d):
    rules = spark.createDataFrame([("the", "a"), ("and", "b"), ("is", "c")], "alias string, category string")
    s = segment.sections(_t(spark, d, "documents"), "doc_id", "text", rules)
    return s.groupBy("doc_id").agg(F.count("*").alias("sections"))


@query("cue_context")
def cue_context(spark, d):
    """Each dictionary span's assertion within its sentence."""
    docs = _t(spark, d, "documents")
    s = segment.sentences(docs, "doc_id", "text").withColumn("clause", F.col("start"))
    m = extract.dictionary_matches(docs, _concepts(spark, d), "doc_id", "text").where("exact")
    e = relations.contained(m, s.select("doc_id", "start", "end", "clause"), ["doc_id"], "clause")
    e = e.select("doc_id", "clause", F.concat_ws(":", "start", "end").alias("id"), (F.col("start") - F.col("o_start")).alias("start"), (F.col("end") - F.col("o_start")).alias("end"), "concept_id")
    cues = spark.createDataFrame(CUES, CUE_SCHEMA)
    return context.classify(e, s.select("doc_id", "clause", "value"), cues, ["doc_id", "clause"], "value").select("doc_id", "clause", "id", "concept_id", "assertion", "rule_id")


@query(
    "sentence_containment",
    """SELECT doc_id, count(*) AS commas FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\\n]*')) AS s FROM documents) WHERE contains(s, ', ') GROUP BY doc_id""",
)
def sentence_containment(spark, d):
    """Sentences that hold a comma, by a range join of commas and sentences."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    s = segment.sentences(docs, "doc_id", "text").withColumn("name", F.col("start"))
    c = docs.select("doc_id", F.explode(segment.tiles(F.col("text"), ", ")).alias("c")).select("doc_id", "c.start", "c.end")
    return relations.contained(c, s.select("doc_id", "start", "end", "name"), ["doc_id"], "name").groupBy("doc_id").agg(F.count_distinct("name").alias("commas"))


@query("training_chunks")
def training_chunks(spark, d):
    docs = _t(spark, d, "documents")
    m = extract.dictionary_matches(docs, _concepts(spark, d), "doc_id", "text").select("doc_id", "start", "end")
    return segment.chunk_documents(docs, m, "doc_id", "text", 1000)


@query("document_pipeline")
def document_pipeline(spark, d):
    """Documents to entities with contexts, codes and relations: the engine's facade."""
    cues = spark.createDataFrame(CUES, CUE_SCHEMA)
    run = pipeline.Pipeline(_concepts(spark, d).withColumn("code", F.upper("concept_id")).withColumn("semantic_type", F.lit("FINDING")), cues)
    return run.predict(_t(spark, d, "documents")).groupBy("document_id").agg(F.count("*").alias("entities"), F.count_if(F.col("assertion") != "PRESENT").alias("in_context"))


@query(
    "mention_positions",
    f"""WITH {_WORDS}, t AS (SELECT doc_id, string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+') AS a FROM documents), u AS (SELECT doc_id, unnest(a) AS w, unnest(range(0, len(a))) AS i FROM t)
    SELECT a.w AS head, b.w AS tail, count(DISTINCT a.doc_id) AS support, count(*) AS occurrences FROM u a JOIN words x ON x.w = a.w JOIN u b ON a.doc_id = b.doc_id AND a.w < b.w AND abs(a.i - b.i) <= 20 JOIN words y ON y.w = b.w GROUP BY ALL HAVING count(DISTINCT a.doc_id) >= 2""",
)
def mention_positions(spark, d):
    """Dictionary words near each other: support by documents."""
    t = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+", -1)).alias("i", "w"))
    t = t.join(_concepts(spark, d).select(F.col("alias").alias("w")), "w", "left_semi").withColumn("doc", F.col("doc_id"))
    return mining.cooccurrence(t, "doc_id", "doc", "w", "i", support=2, gap=20)


@query("seen_once", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS rank FROM documents")
def seen_once(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.row_number().over(W.partitionBy("lang").orderBy(F.desc(F.length("text")), "doc_id")).cast("long").alias("rank"))
