"""Queries of gates, terminology stores, crosswalks and corpora over the driver's tables.

Inputs are drawn from the tables by expressions that Spark and DuckDB read alike, so a query and its SQL start from the
same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from groundmill.operators import corpora, crosswalk, gates, terminology
from groundmill.plans.registry import query

#: Each input: its table and columns, by expressions that hold in both dialects.
_INPUT = {
    "docs": ("documents", """CAST(doc_id AS STRING) AS document_id, text, lang, source,
        CASE WHEN doc_id % 5 = 0 THEN 'synthetic' ELSE 'source' END AS origin,
        CASE WHEN doc_id % 7 = 0 THEN 'dua' WHEN doc_id % 7 = 1 THEN 'quarantine' ELSE 'open' END AS access_class,
        CASE WHEN doc_id % 11 = 0 THEN 'unknown' WHEN doc_id % 11 = 1 THEN 'non_commercial' ELSE 'allowed' END AS redistribution,
        doc_id % 3 <> 0 AS hosted_processing_allowed"""),
    "anns": ("labels", """CAST(doc_id + doc_id % 2 AS STRING) AS annotation_id, CAST(doc_id + CASE WHEN doc_id % 13 = 0 THEN 1000000 ELSE 0 END AS STRING) AS document_id,
        0 AS start, 1 + doc_id % 2 AS stop, CASE WHEN quality = 1 THEN 'gold' WHEN toxic = 1 THEN 'challenge' ELSE 'silver' END AS layer,
        CASE WHEN doc_id % 4 = 0 THEN 'needs_review' ELSE 'accepted' END AS review_status, 'S' || CAST(doc_id % 3 AS STRING) AS code_system, CAST(doc_id % 50 AS STRING) AS code"""),
    "splits": ("documents", "CAST(doc_id AS STRING) AS document_id, CASE WHEN doc_id % 10 = 0 THEN 'challenge' WHEN doc_id % 10 = 1 THEN 'development' ELSE 'train' END AS split"),
    "concepts": ("part", """'c' || CAST(p_partkey AS STRING) AS concept_id, 'S' || CAST(p_partkey % 3 AS STRING) AS code_system,
        CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey % 700 AS STRING) END AS code, CASE WHEN p_size % 2 = 0 THEN 'DRUG' ELSE 'DISEASE' END AS semantic_type,
        CASE p_partkey % 4 WHEN 0 THEN 'IN' WHEN 1 THEN 'SCD' WHEN 2 THEN 'BN' ELSE 'X' END AS tty"""),
    "aliases": ("part", """'c' || CAST(p_partkey AS STRING) AS concept_id, lower(p_name) AS norm, lower(p_name) AS toneless,
        CASE p_partkey % 5 WHEN 0 THEN 'canonical_name' WHEN 1 THEN 'brand_name' WHEN 2 THEN 'ingredient' WHEN 3 THEN 'odd' ELSE 'synonym' END AS alias_source"""),
    "brands": ("part", "'c' || CAST(p_partkey AS STRING) AS concept_id, lower(p_brand) AS norm, 'brand_name' AS alias_source"),
}


def _in(spark, d, name, *more):
    table, cols = _INPUT[name]
    df = spark.read.parquet(f"{d}/{table}.parquet")
    df.createOrReplaceTempView(f"_{name}_raw")
    return spark.sql(f"SELECT {cols} FROM _{name}_raw")


def _pair(key, value):
    return F.struct(F.lit(key).alias("k"), F.coalesce(value, F.lit("")).alias("v"))


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS (SELECT {_INPUT[n][1]} FROM {_INPUT[n][0]})" for n in names)


def _anns(spark, d):
    """Annotations of one or two characters at the start of a text; their own text is the first character."""
    docs = _in(spark, d, "docs").select("document_id", F.substring("text", 1, 1).alias("first"), "origin")
    held = _in(spark, d, "anns").withColumnRenamed("stop", "end").join(docs, "document_id", "left")
    link = F.array(F.struct("code_system", "code", F.lit("v1").alias("terminology_version")))
    return held.withColumn("text", F.coalesce("first", F.lit("?"))).withColumn("concepts", link).drop("first")


_ANNS = """held AS (SELECT a.*, d.text AS doc_text, d.document_id AS doc, coalesce(substr(d.text, 1, 1), '?') AS text, d.origin FROM anns a LEFT JOIN docs d USING (document_id))"""


@query("quality_issues", f"""{_with("docs", "anns", "concepts")}, {_ANNS},
known AS (SELECT DISTINCT code_system, code FROM concepts WHERE code IS NOT NULL)
SELECT issue, count(*) AS n FROM (
  SELECT 'duplicate_document:' || document_id AS issue FROM docs GROUP BY document_id HAVING count(*) > 1
  UNION ALL SELECT 'duplicate_annotation:' || annotation_id FROM held GROUP BY annotation_id HAVING count(*) > 1
  UNION ALL SELECT 'missing_document:' || annotation_id FROM held WHERE doc IS NULL
  UNION ALL SELECT 'offset:' || annotation_id FROM held WHERE doc IS NOT NULL AND NOT coalesce(start >= 0 AND start < stop AND stop <= length(doc_text) AND substr(doc_text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)) = text, false)
  UNION ALL SELECT 'unreviewed:' || layer || ':' || annotation_id FROM held WHERE doc IS NOT NULL AND layer IN ('gold', 'challenge') AND review_status <> 'accepted'
  UNION ALL SELECT 'synthetic_challenge:' || annotation_id FROM held WHERE doc IS NOT NULL AND layer = 'challenge' AND origin = 'synthetic'
  UNION ALL SELECT 'unknown_concept:' || annotation_id || ':' || h.code_system || ':' || h.code FROM held h LEFT JOIN known k ON k.code_system = h.code_system AND k.code = h.code WHERE doc IS NOT NULL AND k.code IS NULL)
GROUP BY issue""")
def quality_issues(spark, d):
    known = _in(spark, d, "concepts").where("code is not null").select("code_system", "code", F.lit("v1").alias("terminology_version"))
    return gates.quality_issues(_in(spark, d, "docs"), _anns(spark, d), known).groupBy("issue").agg(F.count("*").alias("n"))


@query("challenge_issues", f"""{_with("docs", "anns", "splits")}, {_ANNS}, ids AS (SELECT document_id FROM splits WHERE split = 'challenge')
SELECT issue, count(*) AS n FROM (
  SELECT 'non_gold_challenge:' || annotation_id AS issue FROM held WHERE document_id IN (SELECT document_id FROM ids) AND layer NOT IN ('gold', 'challenge')
  UNION ALL SELECT 'unreviewed_challenge:' || annotation_id FROM held WHERE document_id IN (SELECT document_id FROM ids) AND review_status <> 'accepted'
  UNION ALL SELECT 'synthetic_challenge_document:' || document_id FROM docs WHERE origin = 'synthetic' AND document_id IN (SELECT document_id FROM ids)) GROUP BY issue""")
def challenge_issues(spark, d):
    return gates.challenge_issues(_in(spark, d, "splits"), _anns(spark, d), _in(spark, d, "docs")).groupBy("issue").agg(F.count("*").alias("n"))


@query("synthetic_share", f"""{_with("docs", "splits")} SELECT round(avg(CASE WHEN origin = 'synthetic' THEN 1 ELSE 0 END), 6) AS share
FROM splits JOIN docs USING (document_id) WHERE split = 'train' HAVING round(avg(CASE WHEN origin = 'synthetic' THEN 1 ELSE 0 END), 6) > 0.1""")
def synthetic_share(spark, d):
    return gates.synthetic_share(_in(spark, d, "splits"), _in(spark, d, "docs"), 0.1)


@query("restricted_reasons", f"""{_with("docs")} SELECT DISTINCT 'access:' || access_class AS reason FROM docs WHERE access_class IN ('credentialled', 'dua', 'local_private', 'quarantine')
UNION SELECT DISTINCT 'redistribution:' || redistribution FROM docs WHERE redistribution IN ('non_commercial', 'prohibited', 'unknown')""")
def restricted_reasons(spark, d):
    return gates.restricted_reasons(_in(spark, d, "docs"))


@query("hosted_decisions", f"""{_with("docs")} SELECT document_id, hosted_processing_allowed AND access_class = 'open' AS allowed,
  concat_ws(',', CASE WHEN NOT hosted_processing_allowed THEN 'document_disallows_hosted_processing' END, CASE WHEN access_class <> 'open' THEN 'restricted_access:' || access_class END) AS reasons FROM docs""")
def hosted_decisions(spark, d):
    return gates.hosted_decisions(_in(spark, d, "docs")).withColumn("reasons", F.concat_ws(",", "reasons"))


@query("redistribution_reasons", f"""{_with("docs")} SELECT document_id, redistribution AS reason FROM docs WHERE redistribution IN ('unknown', 'non_commercial')
UNION SELECT document_id, access_class FROM docs WHERE access_class IN ('dua', 'quarantine')""")
def redistribution_reasons(spark, d):
    return gates.redistribution_reasons(_in(spark, d, "docs"))


_SOURCES = "SELECT * FROM (VALUES ('en', 'open', 'L1', 'allowed', 'v1', true), ('de', 'dua', 'L2', 'unknown', 'v2', false), ('fr', 'open', 'L1', 'allowed', 'v1', true)) AS s(source_id, access_class, license_id, redistribution, version, hosted_processing_allowed)"


@query("artifact_decisions", f"""{_with("docs")}, reg AS ({_SOURCES})
SELECT document_id, CASE WHEN r.source_id IS NULL THEN 'unregistered_source:' || d.lang ELSE concat_ws(',',
  CASE WHEN r.version <> 'v1' THEN 'source_version_mismatch' END, CASE WHEN d.access_class <> r.access_class THEN 'access_class_mismatch' END,
  CASE WHEN r.license_id <> 'L1' THEN 'license_mismatch' END, CASE WHEN d.redistribution <> r.redistribution THEN 'redistribution_mismatch' END,
  CASE WHEN d.hosted_processing_allowed <> r.hosted_processing_allowed THEN 'hosted_processing_mismatch' END) END AS reasons
FROM docs d LEFT JOIN reg r ON r.source_id = d.lang""")
def artifact_decisions(spark, d):
    arts = _in(spark, d, "docs").select("document_id", F.col("lang").alias("source_id"), "access_class", "redistribution", "hosted_processing_allowed", F.lit("v1").alias("source_version"), F.lit("L1").alias("license_id"))
    reg = spark.sql(_SOURCES).withColumn("version_policy", F.lit("pinned")).withColumn("license_mode", F.lit("fixed"))
    return gates.artifact_decisions(arts, reg).select("document_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("document_rejections", f"""{_with("docs", "splits")} SELECT document_id, CASE WHEN split <> 'train' THEN 'snapshot_split' WHEN lang IS NULL OR lang NOT IN ('en', 'fr') THEN 'source_id'
  WHEN origin <> 'source' THEN 'metadata' END AS rejection FROM docs JOIN splits USING (document_id)""")
def document_rejections(spark, d):
    docs = _in(spark, d, "docs").withColumn("metadata", F.create_map(F.lit("parser_id"), F.col("lang"), F.lit("origin"), F.col("origin")))
    found = gates.document_rejections(docs, ["en", "fr"], {"origin": ["source"]}, _in(spark, d, "splits").where("split = 'train'"))
    return found.select("document_id", "rejection")


@query("selected_records", f"""{_with("docs", "anns", "splits")} SELECT 'document' AS kind, document_id AS id FROM docs WHERE document_id IN (SELECT document_id FROM splits WHERE split = 'development')
UNION ALL SELECT 'annotation', annotation_id FROM anns WHERE document_id IN (SELECT document_id FROM splits WHERE split = 'development')
UNION ALL SELECT 'unknown', document_id FROM (SELECT DISTINCT document_id FROM anns) WHERE document_id NOT IN (SELECT document_id FROM docs)""")
def selected_records(spark, d):
    docs, anns, ids = _in(spark, d, "docs"), _in(spark, d, "anns"), _in(spark, d, "splits").where("split = 'development'")
    some, own = gates.select_records(docs, anns, ids)
    lost = gates.selection_issues(docs, anns, ids).select(F.lit("unknown").alias("kind"), F.split_part("issue", F.lit(":"), F.lit(2)).alias("id"))
    return some.select(F.lit("document").alias("kind"), F.col("document_id").alias("id")).union(own.select(F.lit("annotation"), "annotation_id")).union(lost)


@query("records_with_metadata", f"""{_with("docs", "anns")} SELECT document_id, count(annotation_id) AS annotations FROM docs LEFT JOIN anns USING (document_id) WHERE source IS NOT NULL AND origin = 'synthetic' GROUP BY document_id""")
def records_with_metadata(spark, d):
    pairs = F.array_compact(F.array(F.when(F.col("source").isNotNull(), _pair("source", "source")), F.when(F.col("origin") == "synthetic", _pair("template_id", "origin"))))
    docs, anns = gates.select_with_metadata(_in(spark, d, "docs").withColumn("metadata", F.map_from_entries(pairs)), _in(spark, d, "anns"), ["source", " template_id"])
    return docs.select("document_id").join(anns, "document_id", "left").groupBy("document_id").agg(F.count("annotation_id").alias("annotations"))


@query("relation_issues", f"""{_with("docs", "anns")}, own AS (SELECT annotation_id, min(document_id) AS doc FROM anns GROUP BY annotation_id HAVING count(*) = 1),
rels AS (SELECT 'r' || CAST(o_orderkey % 5000 AS STRING) AS relation_id, CAST(o_custkey AS STRING) AS document_id, CAST(o_custkey AS STRING) AS head_id, CAST(o_orderkey % 1500 AS STRING) AS tail_id FROM orders)
SELECT issue, count(*) AS n FROM (
  SELECT 'duplicate_relation:' || relation_id AS issue FROM rels GROUP BY relation_id HAVING count(*) > 1
  UNION ALL SELECT 'missing_relation_document:' || relation_id FROM rels WHERE document_id NOT IN (SELECT document_id FROM docs)
  UNION ALL SELECT 'missing_head:' || relation_id FROM rels LEFT JOIN own ON annotation_id = head_id WHERE doc IS NULL
  UNION ALL SELECT 'foreign_head:' || relation_id FROM rels JOIN own ON annotation_id = head_id WHERE doc <> document_id
  UNION ALL SELECT 'missing_tail:' || relation_id FROM rels LEFT JOIN own ON annotation_id = tail_id WHERE doc IS NULL
  UNION ALL SELECT 'foreign_tail:' || relation_id FROM rels JOIN own ON annotation_id = tail_id WHERE doc <> document_id) GROUP BY issue""")
def relation_issues(spark, d):
    anns = _in(spark, d, "anns")
    once = anns.groupBy("annotation_id").agg(F.min("document_id").alias("document_id"), F.count("*").alias("n")).where("n = 1")
    rels = spark.read.parquet(f"{d}/orders.parquet").selectExpr(
        "'r' || cast(o_orderkey % 5000 as string) as relation_id", "cast(o_custkey as string) as document_id", "cast(o_custkey as string) as head_id", "cast(o_orderkey % 1500 as string) as tail_id"
    )
    return gates.relation_issues(_in(spark, d, "docs"), once, rels).groupBy("issue").agg(F.count("*").alias("n"))


_RULES = "SELECT * FROM (VALUES ('r1', 'DRUG', '^[a-f]', 'text'), ('r2', NULL, 'steel', 'context'), ('r3', 'DISEASE', 'o', 'text')) AS r(rule_id, entity_type, pattern, field)"


@query("suppressed_mentions", f"""WITH m AS (SELECT p_partkey AS mention_id, lower(p_name) AS text, lower(p_type) AS context, CASE WHEN p_size % 2 = 0 THEN 'DRUG' ELSE 'DISEASE' END AS entity_type FROM part), r AS ({_RULES})
SELECT mention_id, min(rule_id) AS rule_id FROM m LEFT JOIN r ON (r.entity_type IS NULL OR r.entity_type = m.entity_type) AND regexp_matches(CASE WHEN field = 'context' THEN context ELSE text END, pattern) GROUP BY mention_id""")
def suppressed_mentions(spark, d):
    m = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as mention_id", "lower(p_name) as text", "lower(p_type) as context", "case when p_size % 2 = 0 then 'DRUG' else 'DISEASE' end as entity_type")
    return gates.suppressed(m, spark.sql(_RULES)).select("mention_id", "rule_id")


_SYSTEMS = "SELECT * FROM (VALUES ('DRUG', 'S0'), ('DRUG', 'S1'), ('DISEASE', 'S2')) AS s(entity_type, code_system)"


@query("prediction_issues", f"""{_with("docs", "anns", "concepts")}, {_ANNS}, e AS (SELECT *, CASE WHEN layer = 'gold' THEN 'DRUG' ELSE 'DISEASE' END AS entity_type, CAST(code AS BIGINT) % 5 = 0 AS uncoded FROM held),
s AS ({_SYSTEMS}), known AS (SELECT DISTINCT code_system, code FROM concepts WHERE code IS NOT NULL)
SELECT kind, path, count(*) AS n FROM (
  SELECT 'duplicate_entity_id' AS kind, annotation_id AS path FROM e GROUP BY document_id, annotation_id HAVING count(*) > 1
  UNION ALL SELECT 'offset', annotation_id FROM e WHERE doc IS NOT NULL AND NOT coalesce(stop <= length(doc_text) AND substr(doc_text, 1, CAST(stop AS BIGINT)) = text, false)
  UNION ALL SELECT 'invalid_code_assignment', annotation_id FROM e WHERE uncoded
  UNION ALL SELECT 'invalid_code_system', annotation_id FROM e ANTI JOIN s USING (entity_type, code_system)
  UNION ALL SELECT 'unknown_dictionary_code', annotation_id FROM e ANTI JOIN known USING (code_system, code) WHERE NOT uncoded
  UNION ALL SELECT 'invalid_candidate_code_system', annotation_id || '/0' FROM e ANTI JOIN s USING (entity_type, code_system)
  UNION ALL SELECT CASE WHEN layer = 'gold' THEN 'unknown_dictionary_code' ELSE 'unknown_unqualified_candidate_code' END, annotation_id || '/0' FROM e ANTI JOIN known USING (code_system, code))
GROUP BY kind, path""")
def prediction_issues(spark, d):
    e = _anns(spark, d).withColumn("entity_type", F.when(F.col("layer") == "gold", "DRUG").otherwise("DISEASE"))
    one = F.struct(F.lit("x").alias("concept_id"), "code_system", "code", (F.col("layer") == "gold").alias("qualified"))
    e = e.withColumn("candidates", F.array(one)).withColumn("code", F.when(F.col("code").cast("long") % 5 != 0, F.col("code"))).withColumnRenamed("annotation_id", "entity_id")
    found = gates.prediction_issues(_in(spark, d, "docs"), e, spark.sql(_SYSTEMS), _in(spark, d, "concepts").where("code is not null"))
    return found.groupBy("kind", "path").agg(F.count("*").alias("n"))


_ASKED = "SELECT 'S' || CAST(o_orderkey % 4 AS STRING) AS code_system, CAST(o_custkey AS STRING) AS code, o_orderkey FROM"


@query("codes_known", f"""{_with("concepts")} SELECT a.o_orderkey, min(c.concept_id) AS concept_id, count(c.concept_id) > 0 AS known FROM ({_ASKED} orders) a
LEFT JOIN concepts c ON c.code_system = a.code_system AND c.code = a.code GROUP BY a.o_orderkey""")
def codes_known(spark, d):
    spark.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("_orders_raw")
    asked, concepts = spark.sql(f"{_ASKED} _orders_raw"), _in(spark, d, "concepts")
    return terminology.by_code(concepts, terminology.contains(concepts, asked)).select("o_orderkey", "concept_id", "known")


def _rank(names, other):
    return "CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.items()) + f" ELSE {other} END"


_LOOKUP = f"""SELECT norm, concept_id, alias_rank, row_number() OVER (PARTITION BY norm ORDER BY alias_rank, {_rank(terminology.TTY_RANK, 20).format(c='tty')}, code_system, coalesce(code, ''), concept_id) AS rank
  FROM (SELECT norm, concept_id, min({_rank(terminology.ALIAS_RANK, 2).format(c='alias_source')}) AS alias_rank FROM aliases GROUP BY ALL) JOIN concepts USING (concept_id)"""


@query("ordered_lookup", f"{_with('aliases', 'concepts')} SELECT * FROM ({_LOOKUP} WHERE semantic_type = 'DRUG' AND code_system IN ('S0', 'S1')) WHERE rank <= 20")
def ordered_lookup(spark, d):
    aliases, concepts = _in(spark, d, "aliases"), _in(spark, d, "concepts")
    some = concepts.where(terminology.concept_filter("DRUG", ["S0", "S1"]))
    return terminology.ordered_lookup(aliases, aliases, some).withColumn("rank", F.col("rank").cast("long")).withColumn("alias_rank", F.col("alias_rank").cast("int"))


@query("composite_lookup", f"""{_with('aliases', 'brands', 'concepts')}, one AS (SELECT * FROM ({_LOOKUP} WHERE semantic_type = 'DRUG') WHERE rank <= 5), two AS (SELECT * FROM ({_LOOKUP}) WHERE rank <= 10),
best AS (SELECT norm, concept_id, min(store * 100 + rank) AS pos FROM (SELECT norm, concept_id, rank, 0 AS store FROM one UNION ALL SELECT norm, concept_id, rank, 1 FROM two) GROUP BY ALL)
SELECT norm, concept_id, CAST(pos // 100 AS INTEGER) AS store, rank FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY pos, concept_id) AS rank FROM best) WHERE rank <= 8""")
def composite_lookup(spark, d):
    aliases, concepts = _in(spark, d, "aliases"), _in(spark, d, "concepts")
    one = terminology.ordered_lookup(aliases, aliases, concepts.where(terminology.concept_filter("DRUG")), limit=5)
    two = terminology.ordered_lookup(aliases, aliases, concepts, limit=10)
    return terminology.composite([one, two], limit=8).withColumn("rank", F.col("rank").cast("long"))


@query("composite_scored", """WITH hits AS (SELECT CAST(ps AS INTEGER) AS store, CAST(c_nationkey AS STRING) AS norm, 'c' || CAST(o_custkey % 40 AS STRING) AS concept_id, round(o_totalprice / 600000, 6) AS score
  FROM orders JOIN customer ON c_custkey = o_custkey CROSS JOIN (SELECT 0 AS ps) WHERE o_orderkey % 2 = 0 UNION ALL
  SELECT 1, CAST(c_nationkey AS STRING), 'c' || CAST(o_custkey % 40 AS STRING), round(o_totalprice / 600000, 6) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 2 = 1),
best AS (SELECT norm, concept_id, score, store FROM hits QUALIFY row_number() OVER (PARTITION BY norm, concept_id ORDER BY score DESC, store) = 1)
SELECT norm, concept_id, score, store, rank FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, store, concept_id) AS rank FROM best) WHERE rank <= 5""")
def composite_scored(spark, d):
    orders, customer = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer"))
    hits = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).selectExpr("o_orderkey", "cast(c_nationkey as string) as norm", "'c' || cast(o_custkey % 40 as string) as concept_id", "round(o_totalprice / 600000, 6) as score")
    return terminology.composite_scored([hits.where("o_orderkey % 2 = 0"), hits.where("o_orderkey % 2 = 1")], limit=5).withColumn("rank", F.col("rank").cast("long"))


_TOKENS = r"list_filter(regexp_split_to_array({c}, '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_TOK_ALIAS, _TOK_ASK = _TOKENS.format(c="p_name_l"), _TOKENS.format(c="norm")


@query("fallback_search", rf"""WITH al AS (SELECT 'c' || CAST(p_partkey AS STRING) AS concept_id, lower(p_type) AS alias FROM part),
asked AS (SELECT DISTINCT norm, list_distinct(list_filter({_TOK_ASK}, lambda t: length(t) >= 3)) AS tokens FROM (SELECT DISTINCT lower(p_type || ' ' || p_name) AS norm FROM part)
  WHERE len(list_filter({_TOK_ASK}, lambda t: regexp_matches(t, '^[0-9]{{1,2}}$'))) = 0 AND len(list_distinct(list_filter({_TOK_ASK}, lambda t: length(t) >= 3))) >= 2),
idx AS (SELECT DISTINCT alias, unnest(list_distinct({_TOKENS.format(c='alias')})) AS token FROM al),
met AS (SELECT norm, alias, len(any_value(tokens)) AS need, count(*) AS n FROM (SELECT norm, tokens, unnest(tokens) AS token FROM asked) JOIN idx USING (token) GROUP BY norm, alias)
SELECT kind, count(*) AS n FROM (SELECT norm, concept_id, CASE min(CASE WHEN contains(alias, norm) THEN 0 WHEN n = need THEN 1 ELSE 2 END) WHEN 0 THEN 'phrase' WHEN 1 THEN 'all_tokens' ELSE 'partial_tokens' END AS kind
  FROM met JOIN al USING (alias) GROUP BY norm, concept_id) GROUP BY kind""")
def fallback_search(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    aliases = part.selectExpr("'c' || cast(p_partkey as string) as concept_id", "lower(p_type) as norm")
    asked = part.selectExpr("lower(p_type || ' ' || p_name) as norm").distinct()
    return terminology.fallback_search(asked, aliases).groupBy("kind").agg(F.count("*").alias("n"))


_NODES = "SELECT 'c' || CAST(p_partkey AS STRING) AS node_id, CAST(p_size AS BIGINT) AS occurrence_count, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey AS STRING) END AS code, 'S' AS code_system, 'DRUG' AS entity_type, lower(p_name) AS norm, substr(lower(p_name), 1, 5) AS toneless FROM"


@query("graph_concepts", f"""WITH n AS ({_NODES} part), m AS (SELECT * FROM n WHERE code IS NOT NULL), asked AS (SELECT DISTINCT norm, toneless FROM n),
f AS (SELECT norm, node_id, min(stage) AS stage FROM (SELECT a.norm, m.node_id, 0 AS stage FROM asked a JOIN m ON m.norm = a.norm UNION ALL SELECT a.norm, m.node_id, 1 FROM asked a JOIN m ON m.toneless = a.toneless WHERE length(a.norm) >= 2) GROUP BY ALL),
r AS (SELECT f.norm, node_id, stage, code, row_number() OVER (PARTITION BY f.norm ORDER BY stage, occurrence_count DESC, node_id) AS rank FROM f JOIN m USING (node_id))
SELECT norm, node_id, stage, rank, code, CASE WHEN stage = 0 THEN 1.0 ELSE 0.92 END::DOUBLE AS score FROM r WHERE rank <= 5""")
def graph_concepts(spark, d):
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("_nodes_raw")
    n = spark.sql(f"{_NODES} _nodes_raw")
    return terminology.graph_concepts(n, n.drop("norm", "toneless"), n, "DRUG", 5).select("norm", "node_id", "stage", F.col("rank").cast("long").alias("rank"), "code", "score")


@query("edge_evidence", """SELECT o_custkey AS edge_id, o_orderkey AS evidence_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)) WHERE rank <= 6""")
def edge_evidence(spark, d):
    edges = spark.read.parquet(f"{d}/customer.parquet").where("c_nationkey < 12").select(F.col("c_custkey").alias("edge_id"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("edge_id"), F.col("o_orderkey").alias("evidence_id"))
    return terminology.edge_evidence(edges, rows, 6).withColumn("rank", F.col("rank").cast("long"))


_MEMORY = "SELECT lower(p_brand) AS norm, CASE WHEN p_size % 2 = 0 THEN 'DRUG' ELSE 'DISEASE' END AS entity_type, 'S' || CAST(p_partkey % 3 AS STRING) AS code_system, CAST(p_partkey % 700 AS STRING) AS code, CASE WHEN p_partkey % 40 = 0 THEN 'reviewed' ELSE 'proposed' END AS review_status FROM"


@query("reviewed_matches", f"""{_with("concepts")}, mem AS ({_MEMORY} part), one AS (SELECT norm, entity_type, min(code_system) AS code_system, min(code) AS code FROM mem WHERE review_status = 'reviewed' GROUP BY norm, entity_type HAVING count(DISTINCT code_system || ':' || code) = 1),
best AS (SELECT code_system, code, min(concept_id) AS concept_id FROM concepts WHERE code IS NOT NULL GROUP BY ALL)
SELECT p_partkey, concept_id FROM part JOIN one ON one.norm = lower(p_brand) AND one.entity_type = CASE WHEN p_size % 2 = 0 THEN 'DRUG' ELSE 'DISEASE' END JOIN best USING (code_system, code)""")
def reviewed_matches(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    part.createOrReplaceTempView("_memory_raw")
    asked = part.selectExpr("p_partkey", "lower(p_brand) as norm", "case when p_size % 2 = 0 then 'DRUG' else 'DISEASE' end as entity_type")
    return terminology.reviewed_matches(asked, spark.sql(f"{_MEMORY} _memory_raw"), _in(spark, d, "concepts")).select("p_partkey", "concept_id")


_ENTRIES = """SELECT CAST(c_custkey AS STRING) AS term_id, CASE c_custkey % 3 WHEN 0 THEN 'DRUG' WHEN 1 THEN 'DISEASE' ELSE 'OTHER' END AS entity_type, CASE WHEN c_custkey % 5 = 0 THEN 'L' ELSE 'M' END AS source_label,
  lower(p_name) AS norm FROM customer_in JOIN part_in ON p_partkey = c_custkey % 190 + 1"""
_POLICIES = "SELECT * FROM (VALUES ('p1', 'DRUG', 'L', 'DRUG', 'S0'), ('p2', 'DRUG', NULL, 'DRUG,DISEASE', 'S0,S1'), ('p3', 'DISEASE', NULL, 'DISEASE', 'S2')) AS p(policy_id, source_entity_type, source_label, types, systems)"
_ENTRIES_SQL = _ENTRIES.replace("customer_in", "customer").replace("part_in", "part")


def _entries(spark, d):
    for t in ("customer", "part"):
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(f"_{t}_raw")
    return spark.sql(_ENTRIES.replace("customer_in", "_customer_raw").replace("part_in", "_part_raw"))


_CROSSWALK = f"""{_with("concepts", "aliases")}, e AS ({_ENTRIES_SQL}), p AS ({_POLICIES}),
asked AS (SELECT e.*, coalesce(p1.policy_id, p2.policy_id) AS policy_id, coalesce(p1.types, p2.types) AS types, coalesce(p1.systems, p2.systems) AS systems FROM e
  LEFT JOIN p p1 ON p1.source_entity_type = e.entity_type AND p1.source_label = e.source_label LEFT JOIN p p2 ON p2.source_entity_type = e.entity_type AND p2.source_label IS NULL),
met AS (SELECT a.term_id, c.* FROM asked a JOIN (SELECT DISTINCT norm, concept_id FROM aliases) USING (norm) JOIN concepts c USING (concept_id) WHERE contains(',' || types || ',', ',' || semantic_type || ',') AND contains(',' || systems || ',', ',' || code_system || ',')),
tally AS (SELECT term_id, count(*) AS concepts, count(DISTINCT CASE WHEN code IS NOT NULL THEN code_system || ':' || code END) AS codes, count(*) - count(code) AS uncoded,
  max(CASE WHEN semantic_type = 'DRUG' THEN d ELSE s END) AS most, list(concept_id ORDER BY code_system, coalesce(code, ''), concept_id)[1:20] AS ids
  FROM (SELECT *, count(*) FILTER (semantic_type = 'DRUG') OVER (PARTITION BY term_id) AS d, count(*) FILTER (semantic_type <> 'DRUG') OVER (PARTITION BY term_id) AS s FROM met) GROUP BY term_id)
SELECT term_id, policy_id, CASE WHEN policy_id IS NULL THEN 'skipped_no_policy' WHEN most >= 60 THEN 'ambiguous_truncated' WHEN concepts IS NULL THEN 'unmatched' WHEN codes = 0 THEN 'concept_only_exact' WHEN concepts = 1 THEN 'unique_concept_exact'
  WHEN codes = 1 AND uncoded = 0 THEN 'unique_code_exact' ELSE 'ambiguous_code_exact' END AS status, coalesce(concepts, 0) AS concepts, array_to_string(ids, ',') AS candidates FROM asked LEFT JOIN tally USING (term_id)"""


@query("mention_crosswalk", _CROSSWALK)
def mention_crosswalk(spark, d):
    policies = spark.sql(_POLICIES).withColumn("target_types", F.split("types", ",")).withColumn("code_systems", F.split("systems", ","))
    found = crosswalk.crosswalk(_entries(spark, d), _in(spark, d, "concepts"), _in(spark, d, "aliases"), policies, limit=60)
    return found.select("term_id", "policy_id", "status", "concepts", F.array_join("candidates", ",").alias("candidates"))


_LINKS = "SELECT lower(p_name) AS norm, 'S' || CAST(min(p_partkey) % 3 AS STRING) AS code_system, CAST(min(p_partkey) AS STRING) AS code FROM {t} GROUP BY lower(p_name) HAVING min(p_partkey) % 4 > 0"


@query("attached_links", f"""WITH a AS ({_ENTRIES_SQL}), l AS ({_LINKS.format(t='part')}), x AS (SELECT a.*, CAST(term_id AS BIGINT) % 6 AS k, l.code_system AS s, l.code AS c FROM a LEFT JOIN l ON l.norm = a.norm AND entity_type = 'DRUG')
SELECT term_id, CASE WHEN c IS NULL THEN 'no_eligible_crosswalk' WHEN k = 0 AND s = 'S0' AND c = '1' THEN 'already_linked' WHEN k = 0 AND s = 'S0' THEN 'existing_code_system_conflict' WHEN k = 0 THEN 'linked_additional_code_system' ELSE 'linked' END AS decision,
  (CASE WHEN k = 0 THEN 1 ELSE 0 END) + (CASE WHEN c IS NOT NULL AND NOT (k = 0 AND s = 'S0') THEN 1 ELSE 0 END) AS concepts FROM x""")
def attached_links(spark, d):
    a = _entries(spark, d)
    one = F.array(F.struct(F.lit("S0").alias("code_system"), F.lit("1").alias("code")))
    a = a.withColumn("concepts", F.when(F.col("term_id").cast("long") % 6 == 0, one).otherwise(F.filter(one, lambda c: F.lit(False))))
    links = spark.sql(_LINKS.format(t="_part_raw"))
    labels = spark.createDataFrame([("DRUG", "L"), ("DRUG", "M")], "entity_type string, source_label string")
    found = crosswalk.attach_links(a, links.join(F.broadcast(labels)), append=True)
    return found.select("term_id", "decision", F.size("concepts").alias("concepts"))


@query("harmonized_labels", f"""{_with("concepts")}, a AS (SELECT c_custkey AS annotation_id, CASE c_custkey % 3 WHEN 0 THEN 'DRUG' WHEN 1 THEN 'DISEASE' ELSE 'OTHER' END AS entity_type, CASE WHEN c_nationkey < 12 THEN 'one' ELSE 'two' END AS source_id, CAST(c_custkey % 800 AS STRING) AS code FROM customer),
r AS (SELECT * FROM (VALUES ('r1', 'one', 'DRUG', 'DISEASE'), ('r2', 'two', 'DISEASE', 'DRUG')) AS v(rule_id, source_id, entity_type, target_type)),
least AS (SELECT code, arg_min(semantic_type, concept_id) AS ty FROM concepts WHERE code IS NOT NULL AND code_system = 'S1' GROUP BY code)
SELECT annotation_id, coalesce(target_type, a.entity_type) AS entity_type, rule_id, CASE WHEN rule_id IS NULL THEN 'A:' || a.code || ',B:7' WHEN ty = target_type THEN 'S1:' || a.code || ',B:7' ELSE 'B:7' END AS concepts,
  CASE WHEN rule_id IS NULL OR ty = target_type THEN '' WHEN ty IS NULL THEN 'unknown_target_code' ELSE 'target_semantic_type_mismatch' END AS unmapped
FROM a LEFT JOIN r ON r.source_id = a.source_id AND r.entity_type = a.entity_type LEFT JOIN least USING (code)""")
def harmonized_labels(spark, d):
    a = spark.read.parquet(f"{d}/customer.parquet").selectExpr(
        "c_custkey as annotation_id", "case c_custkey % 3 when 0 then 'DRUG' when 1 then 'DISEASE' else 'OTHER' end as entity_type", "case when c_nationkey < 12 then 'one' else 'two' end as source_id", "cast(null as string) as source_label",
        "array(named_struct('code_system', 'A', 'code', cast(c_custkey % 800 as string)), named_struct('code_system', 'B', 'code', '7')) as concepts",
    )
    rules = spark.createDataFrame([("r1", "one", "DRUG", "", "DISEASE", {"A": "S1"}), ("r2", "two", "DISEASE", "", "DRUG", {"A": "S1"})], "rule_id string, source_id string, entity_type string, source_label string, target_type string, systems map<string,string>")
    found = crosswalk.harmonize(a, rules, _in(spark, d, "concepts"))
    show = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    return found.select("annotation_id", "entity_type", "rule_id", show("concepts", lambda x: F.concat_ws(":", x["code_system"], x["code"])), show("unmapped", lambda x: x["reason"]))


@query("product_links", """WITH p AS (SELECT o_orderkey AS document_id, o_custkey AS set_id, o_orderkey % 97 AS ndc, o_orderkey % 50 > 0 AS valid FROM orders),
l AS (SELECT DISTINCT c_custkey AS set_id, c_custkey % 40 + x AS rxcui FROM customer CROSS JOIN (VALUES (0), (1)) AS v(x) WHERE c_custkey % 3 > 0), c AS (SELECT DISTINCT p_partkey % 110 AS ndc, p_size AS rxcui FROM part WHERE p_partkey <= 150),
e AS (SELECT document_id, rxcui, max(l) AS l, max(c) AS c FROM (SELECT document_id, rxcui, 1 AS l, 0 AS c FROM p JOIN l USING (set_id) UNION ALL SELECT document_id, rxcui, 0, 1 FROM p JOIN c USING (ndc)) GROUP BY ALL),
t AS (SELECT document_id, sum(l) AS ls, sum(c) AS cs, sum(l * c) AS both_, min(CASE WHEN l + c = 2 THEN rxcui END) AS one FROM e GROUP BY document_id)
SELECT document_id, CASE WHEN NOT valid THEN 'invalid_product_record' WHEN both_ = 1 THEN 'exact_unique_intersection' WHEN both_ > 1 THEN 'ambiguous_intersection' WHEN ls > 0 AND cs > 0 THEN 'source_disagreement' WHEN ls > 0 THEN 'spl_only' WHEN cs > 0 THEN 'ndc_only' ELSE 'unmapped' END AS status,
  CAST(CASE WHEN both_ = 1 THEN one END AS BIGINT) AS selected FROM p LEFT JOIN t USING (document_id)""")
def product_links(spark, d):
    p = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as document_id", "o_custkey as set_id", "'1' as spl_version", "o_orderkey % 97 as ndc_prefix", "o_orderkey % 50 > 0 as valid")
    label = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 3 > 0").selectExpr("c_custkey as set_id", "'1' as spl_version", "explode(array(c_custkey % 40, c_custkey % 40 + 1)) as rxcui")
    code = spark.read.parquet(f"{d}/part.parquet").where("p_partkey <= 150").selectExpr("p_partkey % 110 as ndc_prefix", "cast(p_size as bigint) as rxcui")
    return crosswalk.link_products(p, label, code).withColumn("selected", F.col("selected").cast("long"))


_MAPPING = "SELECT CAST(l_partkey % 900 AS STRING) AS code, lower(l_returnflag) AS norm, l_returnflag || l_linestatus AS surface, l_orderkey % 300 AS record FROM"
_KNOWN = "SELECT 'c' || CAST(p_partkey AS STRING) AS concept_id, CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'n' ELSE 'x' END AS norm FROM"


def _mapping(spark, d):
    for t in ("lineitem", "part"):
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(f"_{t}_raw")
    return spark.sql(f"{_MAPPING} _lineitem_raw"), _in(spark, d, "concepts"), spark.sql(f"{_KNOWN} _part_raw")


_MAPPED = f"{_with('concepts')}, m AS ({_MAPPING} lineitem), known AS (SELECT DISTINCT code FROM concepts WHERE code IS NOT NULL), named AS (SELECT DISTINCT code, norm FROM ({_KNOWN} part) JOIN concepts USING (concept_id) WHERE code IS NOT NULL)"


@query("mapping_counts", f"""{_MAPPED}, a AS (SELECT count(*) AS codes, count(k.code) AS known_codes FROM (SELECT DISTINCT code FROM m) m LEFT JOIN known k ON k.code = m.code),
b AS (SELECT count(*) AS pairs, count(n.code) AS existing_pairs, count(*) FILTER (k.code IS NOT NULL AND n.code IS NULL) AS proposals FROM (SELECT DISTINCT code, norm FROM m) m LEFT JOIN known k ON k.code = m.code LEFT JOIN named n ON n.code = m.code AND n.norm = m.norm)
SELECT *, codes - known_codes AS unknown_codes FROM a CROSS JOIN b""")
def mapping_counts(spark, d):
    return crosswalk.mapping_counts(*_mapping(spark, d))


@query("alias_proposals", f"""{_MAPPED}, s AS (SELECT m.code, m.norm, surface, count(DISTINCT record) AS n FROM m SEMI JOIN known k ON k.code = m.code ANTI JOIN named n ON n.code = m.code AND n.norm = m.norm GROUP BY ALL)
SELECT code, norm, max(n) AS support, string_agg(DISTINCT surface, ',' ORDER BY surface) AS surfaces FROM s GROUP BY code, norm""")
def alias_proposals(spark, d):
    return crosswalk.alias_proposals(*_mapping(spark, d)).select("code", "norm", "support", F.array_join("surfaces", ",").alias("surfaces"))


_SQUEEZED = "lower(regexp_replace(trim(text), '[ \\t\\n]+', ' '{g}))"


@query("document_groups", f"""WITH RECURSIVE h AS (SELECT doc_id, sha256(text) AS raw, sha256({_SQUEEZED.format(g=", 'g'")}) AS norm FROM documents WHERE text IS NOT NULL),
links AS (SELECT min(doc_id) AS b, unnest(list(doc_id)) AS a FROM h GROUP BY norm UNION ALL SELECT doc_id, doc_id + 7 FROM h WHERE doc_id % 50 = 0 AND doc_id + 7 IN (SELECT doc_id FROM h)),
e AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
up(doc_id, root) AS (SELECT doc_id, doc_id FROM h UNION SELECT u.doc_id, e.b FROM up u JOIN e ON e.a = u.root),
r AS (SELECT doc_id, min(root) AS root FROM up GROUP BY doc_id),
k AS (SELECT root, CASE WHEN count(*) = 1 THEN 'singleton' WHEN count(DISTINCT raw) = 1 THEN 'raw_exact' WHEN count(DISTINCT norm) = 1 THEN 'normalized_exact' ELSE 'near' END AS kind, count(*) AS size FROM r JOIN h USING (doc_id) GROUP BY root)
SELECT doc_id, root, kind, size FROM r JOIN k USING (root)""")
def document_groups(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    h = docs.select("doc_id", F.sha2("text", 256).alias("raw_hash"), F.sha2(F.expr(_SQUEEZED.format(g="").replace("\\", "\\\\")), 256).alias("norm_hash"))
    near = h.where("doc_id % 50 = 0").selectExpr("doc_id + 7 as a", "doc_id as b").join(h.select(F.col("doc_id").alias("a")), "a", "left_semi")
    return corpora.describe_groups(h, near, "doc_id").select("doc_id", "root", "kind", "size")


@query("connected_groups", """WITH RECURSIVE k AS (SELECT o_orderkey AS doc, 'c' || CAST(o_custkey AS STRING) AS key FROM orders WHERE o_custkey % 4 > 0 UNION ALL SELECT o_orderkey, 'p' || CAST(o_orderkey // 3 AS STRING) FROM orders WHERE o_orderkey % 9 < 3),
l AS (SELECT min(doc) AS b, unnest(list(doc)) AS a FROM k GROUP BY key), e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
up(doc, root) AS (SELECT o_orderkey, o_orderkey FROM orders UNION SELECT u.doc, e.b FROM up u JOIN e ON e.a = u.root)
SELECT root, count(*) AS members, sum(doc) AS total FROM (SELECT doc, min(root) AS root FROM up GROUP BY doc) GROUP BY root""")
def connected_groups(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_orderkey", "document_id")
    keys = orders.where("o_custkey % 4 > 0").selectExpr("document_id", "'c' || cast(o_custkey as string) as key").union(orders.where("document_id % 9 < 3").selectExpr("document_id", "'p' || cast(document_id div 3 as string)"))
    return corpora.connected_groups(orders, keys).groupBy("root").agg(F.count("*").alias("members"), F.sum("document_id").alias("total"))


_ACCESS = "CASE {a} WHEN 'quarantine' THEN 1 WHEN 'dua' THEN 3 ELSE 7 END"
_FUSED = f"""{_with("docs", "anns")}, g AS (SELECT sha256(text) AS h, min(document_id) AS canonical, count(DISTINCT document_id) AS copies, min({_ACCESS.format(a='access_class')}) AS acc,
  min(CASE redistribution WHEN 'unknown' THEN 2 WHEN 'non_commercial' THEN 3 ELSE 5 END) AS red, bool_and(hosted_processing_allowed) AS hosted FROM docs WHERE text IS NOT NULL GROUP BY 1),
m AS (SELECT document_id, canonical, copies FROM docs JOIN g ON h = sha256(text))"""


@query("fused_documents", f"""{_FUSED} SELECT canonical AS document_id, copies, CASE acc WHEN 1 THEN 'quarantine' WHEN 3 THEN 'dua' ELSE 'open' END AS access_class, CASE red WHEN 2 THEN 'unknown' WHEN 3 THEN 'non_commercial' ELSE 'allowed' END AS redistribution, hosted AS hosted_processing_allowed FROM g""")
def fused_documents(spark, d):
    return corpora.fuse(_in(spark, d, "docs").where("text is not null"), _in(spark, d, "anns"))[0].drop("text")


@query("fused_annotations", f"""{_FUSED} SELECT canonical AS document_id, start, stop, layer, count(DISTINCT document_id) AS votes, CASE WHEN count(DISTINCT document_id) = any_value(copies) THEN 'training' ELSE 'review' END AS tier
FROM anns JOIN m USING (document_id) GROUP BY canonical, start, stop, layer""")
def fused_annotations(spark, d):
    anns = _in(spark, d, "anns").select("annotation_id", "document_id", "start", "stop", "layer")
    return corpora.fuse(_in(spark, d, "docs").where("text is not null"), anns)[2].select("document_id", "start", "stop", "layer", "votes", "tier")


@query("retained_relations", f"""{_FUSED}, rels AS (SELECT o_orderkey AS relation_id, CAST(o_custkey AS STRING) AS document_id, CAST(o_custkey AS STRING) AS head_id, CAST(o_orderkey % 1500 AS STRING) AS tail_id FROM orders)
SELECT relation_id, CASE WHEN canonical IS NULL OR canonical <> document_id THEN 'document_collapsed' WHEN head_id NOT IN (SELECT annotation_id FROM anns) OR tail_id NOT IN (SELECT annotation_id FROM anns) THEN 'endpoint_not_materialized' END AS rejection FROM rels LEFT JOIN m USING (document_id)""")
def retained_relations(spark, d):
    docs, anns = _in(spark, d, "docs").where("text is not null"), _in(spark, d, "anns")
    rels = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as relation_id", "cast(o_custkey as string) as document_id", "cast(o_custkey as string) as head_id", "cast(o_orderkey % 1500 as string) as tail_id")
    return corpora.retain_relations(rels, corpora.fuse(docs, anns)[1], anns).select("relation_id", "rejection")


@query("frozen_splits", "SELECT o_orderkey AS document_id, CASE o_orderstatus WHEN 'O' THEN 'train' WHEN 'F' THEN 'test' END AS split, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'unmapped_split' END AS issue FROM orders")
def frozen_splits(spark, d):
    return corpora.freeze_splits(spark.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_orderkey", "document_id"), "o_orderstatus", {"O": "train", "F": "test"})


_SPANS = "SELECT l_orderkey AS document_id, l_returnflag AS entity_type, l_linenumber * 10 AS start, l_linenumber * 10 + CAST(l_quantity AS INTEGER) % 17 + 1 AS stop, l_suppkey % 2 AS half FROM"
_CLEAR = "SELECT * FROM {a} x WHERE entity_type = '{t}' AND NOT EXISTS (SELECT 1 FROM {b} y WHERE y.document_id = x.document_id AND y.entity_type = x.entity_type AND x.start < y.stop AND y.start < x.stop)"


@query("merged_outputs", f"""WITH a AS (SELECT DISTINCT document_id, entity_type, start, stop FROM ({_SPANS} lineitem) WHERE half = 0 OR start > 40), b AS (SELECT DISTINCT document_id, entity_type, start, stop FROM ({_SPANS} lineitem) WHERE half = 1 OR start > 50)
SELECT DISTINCT * FROM (SELECT * FROM a WHERE entity_type = 'A' UNION ALL {_CLEAR.format(a='b', b='a', t='A')} UNION ALL SELECT * FROM a WHERE entity_type = 'N' INTERSECT SELECT * FROM b WHERE entity_type = 'N'
  UNION ALL SELECT * FROM b WHERE entity_type = 'R')""".replace("UNION ALL SELECT * FROM a WHERE entity_type = 'N' INTERSECT SELECT * FROM b WHERE entity_type = 'N'", "UNION ALL (SELECT * FROM a WHERE entity_type = 'N' INTERSECT SELECT * FROM b WHERE entity_type = 'N')"))
def merged_outputs(spark, d):
    spark.read.parquet(f"{d}/lineitem.parquet").createOrReplaceTempView("_spans_raw")
    s = spark.sql(f"{_SPANS} _spans_raw").withColumnRenamed("stop", "end")
    found = corpora.merge_outputs(s.where("half = 0 or start > 40"), s.where("half = 1 or start > 50"), {"A": "primary_preferred_union", "N": "intersection", "R": "secondary"})
    return found.withColumnRenamed("end", "stop")
