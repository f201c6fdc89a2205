"""Queries of dataset operators and scores over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundmill.operators import datasets, linking, mining, proposals
from groundmill.plans.registry import query


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("accuracy_at_1", """WITH g AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 7 END AS code FROM orders), p AS (SELECT l_orderkey AS k, max(l_partkey % 7) AS code FROM lineitem GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (p.code = g.code) AS correct, count(*) FILTER (p.code = g.code) / count(*) AS accuracy FROM g LEFT JOIN p USING (k) WHERE g.code IS NOT NULL""")
def accuracy_at_1(spark, d):
    gold = _t(spark, d, "orders").selectExpr("o_orderkey as k", "case when o_orderkey % 5 > 0 then o_custkey % 7 end as code")
    return datasets.accuracy_at_1(gold, _t(spark, d, "lineitem").selectExpr("l_orderkey as k", "l_partkey % 7 as code"), ["k"])


_MET = " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM (SELECT o_custkey % {m} < 1 AS g, o_orderkey % {m} = 0 AS p FROM orders)"
    for a, m in (("NEGATED", 2), ("FAMILY", 3))
)


@query("attribute_metrics", f"""SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM ({_MET}))""")
def attribute_metrics(spark, d):
    rows = _t(spark, d, "orders").selectExpr("o_orderkey", "o_custkey as q", "o_orderkey as p")
    statuses = lambda c, test: F.array_compact(F.array(*[F.when(F.expr(test.format(c=c, m=m)), F.lit(a)) for a, m in (("NEGATED", 2), ("FAMILY", 3))]))
    key = ["o_orderkey"]
    return datasets.attribute_metrics(rows.select(*key, statuses("q", "{c} % {m} < 1").alias("statuses")), rows.select(*key, statuses("p", "{c} % {m} = 0").alias("statuses")), key, ["NEGATED", "FAMILY"])


@query("run_comparison", """WITH r AS (SELECT event_type AS name, round(avg(value), 6) AS rate, count(*) % 3 AS sha FROM events GROUP BY 1), s AS (SELECT event_type AS name, CAST(user_id % 4 AS STRING) AS stage, sum(value) AS ms FROM events GROUP BY ALL), b AS (SELECT * FROM r WHERE name = 'click')
SELECT r.name, r.rate AS documents_per_second, round(r.rate / b.rate, 6) AS throughput_ratio, r.sha = b.sha AS same_output, (SELECT stage FROM s WHERE s.name = r.name ORDER BY ms DESC, stage LIMIT 1) AS bottleneck FROM r CROSS JOIN b""")
def run_comparison(spark, d):
    e = _t(spark, d, "events")
    runs = e.groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 6).alias("documents_per_second"), (F.count("*") % 3).alias("output_sha256"))
    return datasets.compare_runs(runs, e.groupBy(F.col("event_type").alias("name"), (F.col("user_id") % 4).cast("string").alias("stage")).agg(F.sum("value").alias("total_ms")), "click")


@query("flat_metrics", "SELECT event_type AS run__name, count(*) AS run__counts__rows, count(DISTINCT user_id) AS run__counts__users FROM events GROUP BY event_type")
def flat_metrics(spark, d):
    per = _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"))
    return datasets.flatten_metrics(per.select(F.struct(F.col("event_type").alias("name"), F.struct("rows", "users").alias("counts")).alias("run")), "__")


@query("terminology_report", """WITH a AS (SELECT l_orderkey AS q, l_partkey % 40 AS code, min(l_linenumber) AS r FROM lineitem GROUP BY ALL), c AS (SELECT q, code, row_number() OVER (PARTITION BY q ORDER BY r, code) AS rank FROM a),
e AS (SELECT o_orderkey AS q, o_custkey % 40 AS code, o_orderstatus AS slice FROM orders UNION ALL SELECT o_orderkey, (o_custkey + 1) % 40, o_orderstatus FROM orders), f AS (SELECT q, min(rank) AS first FROM e JOIN c USING (q, code) GROUP BY q)
SELECT slice, count(*) AS queries, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(CASE WHEN first <= 1 THEN 1 ELSE 0 END), 6) AS recall_at_1, round(avg(CASE WHEN first <= 5 THEN 1 ELSE 0 END), 6) AS recall_at_5, round(avg(CASE WHEN first <= 20 THEN 1 ELSE 0 END), 6) AS recall_at_20
FROM (SELECT DISTINCT q, slice FROM e) LEFT JOIN f USING (q) GROUP BY slice""")
def terminology_report(spark, d):
    answers = _t(spark, d, "lineitem").selectExpr("l_orderkey as query_id", "l_partkey % 40 as code", "l_linenumber as rank")
    expected = _t(spark, d, "orders").selectExpr("o_orderkey as query_id", "explode(array(o_custkey % 40, (o_custkey + 1) % 40)) as code", "o_orderstatus as slice")
    return datasets.rank_report(answers, expected, ["slice"])


@query("candidate_orders", """WITH c AS (SELECT o_custkey AS q, o_orderkey AS r, CAST(o_orderkey AS STRING) AS c FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r) AS rank, count(*) OVER (PARTITION BY q) AS n,
  row_number() OVER (PARTITION BY q ORDER BY sha256('7' || chr(0) || CAST(q AS STRING) || chr(0) || c)) AS s FROM c)
SELECT q AS query_id, 'retrieval' AS "order", CAST(rank AS INTEGER) AS place, c AS candidate FROM n UNION ALL SELECT q, 'reverse', CAST(n + 1 - rank AS INTEGER), c FROM n UNION ALL SELECT q, 'shuffled', CAST(s AS INTEGER), c FROM n""")
def candidate_orders(spark, d):
    c = _t(spark, d, "orders").selectExpr("o_custkey as query_id", "row_number() over (partition by o_custkey order by o_orderkey) as rank", "cast(o_orderkey as string) as candidate")
    return datasets.candidate_orders(c, 7)


@query("listwise_report", """WITH s AS (SELECT l_orderkey AS q, l_linenumber AS c, round(l_extendedprice, 2) AS score, l_partkey % 4 = 0 AS pos FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM s),
p AS (SELECT q, min(CASE WHEN pos THEN rank END) AS best, count(*) FILTER (pos) AS k, q % 6 = 0 AS out_ FROM r GROUP BY q)
SELECT count(*) AS queries, round(avg(coalesce(1.0 / best, 0)), 6) AS mrr, round(avg(CASE WHEN k = 0 AND out_ THEN 1.0 WHEN best = 1 AND NOT out_ THEN 1.0 / k ELSE 0 END), 6) AS jaccard, count(*) FILTER (out_) AS abstained, count(*) FILTER (out_ AND coalesce(best, 2) > 1) AS errors_caught FROM p""")
def listwise_report(spark, d):
    s = _t(spark, d, "lineitem").selectExpr("l_orderkey as query_id", "l_linenumber as candidate", "round(l_extendedprice, 2) as score", "l_partkey % 4 = 0 as positive")
    return datasets.listwise_report(s, s.where("query_id % 6 = 0"))


@query("merged_abbreviations", """WITH b AS (SELECT 'baseline' AS layer, p_brand AS surface, lower(p_brand) AS norm, p_name AS e, lower(p_name) AS en FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'mined', upper(p_brand), lower(p_brand), upper(p_name), lower(p_name) FROM part WHERE p_partkey % 2 = 0),
one AS (SELECT norm, en, arg_min(e, layer || e) AS e FROM b GROUP BY ALL)
SELECT b.norm, (SELECT x.surface FROM b x WHERE x.norm = b.norm ORDER BY layer, surface LIMIT 1) AS surface, (SELECT string_agg(e, ',' ORDER BY en) FROM one o WHERE o.norm = b.norm) AS expansions, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers FROM b GROUP BY b.norm""")
def merged_abbreviations(spark, d):
    p = _t(spark, d, "part")
    base = p.where("p_partkey % 3 = 0").selectExpr("p_brand as surface", "lower(p_brand) as norm", "p_name as expansion", "lower(p_name) as expansion_norm")
    mined = p.where("p_partkey % 2 = 0").selectExpr("upper(p_brand) as surface", "lower(p_brand) as norm", "upper(p_name) as expansion", "lower(p_name) as expansion_norm")
    return datasets.merge_abbreviations(base, mined).withColumn("expansions", F.array_join("expansions", ",")).withColumn("layers", F.array_join("layers", ","))


_PROPOSED = "SELECT lower(p_name) AS norm, CASE WHEN p_size % 2 = 0 THEN 'DRUG' ELSE 'DISEASE' END AS entity_type, p_mfgr_c AS code_system, CAST(p_size AS STRING) AS code, p_partkey FROM (SELECT *, 'S' || CAST(p_partkey % 2 AS STRING) AS p_mfgr_c FROM {t})"


@query("proposal_queries", f"""WITH a AS ({_PROPOSED.format(t='part')}), k AS (SELECT * FROM a WHERE p_partkey % 9 = 0), q AS (SELECT * FROM a WHERE p_partkey % 2 = 1)
SELECT norm, entity_type, code_system, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, CASE WHEN count(DISTINCT code) > 1 THEN 'ambiguous' ELSE 'unique' END || ',' ||
  CASE WHEN bool_or(EXISTS (SELECT 1 FROM k WHERE k.norm = q.norm AND k.code_system = q.code_system)) THEN 'seen_alias' WHEN bool_or(EXISTS (SELECT 1 FROM k WHERE k.code = q.code AND k.code_system = q.code_system)) THEN 'seen_code' ELSE 'unseen' END AS slices FROM q GROUP BY ALL""")
def proposal_queries(spark, d):
    _t(spark, d, "part").createOrReplaceTempView("_part_proposed")
    a = spark.sql(_PROPOSED.format(t="_part_proposed"))
    found = datasets.proposal_queries(a.where("p_partkey % 2 = 1"), a.where("p_partkey % 9 = 0"))
    return found.select("norm", "entity_type", "code_system", F.array_join("codes", ",").alias("codes"), F.array_join("slices", ",").alias("slices"))


@query("hard_negatives", """WITH c AS (SELECT p_partkey AS id, p_name AS name, p_size % 3 AS ty FROM part), n AS (SELECT name, ty, min(id) AS id, list_distinct(string_split(lower(name), ' ')) AS w FROM c GROUP BY name, ty),
p AS (SELECT id AS pair_id, id AS own, ty, name, list_distinct(string_split(lower(name), ' ')) AS w FROM c),
s AS (SELECT pair_id, n.name, n.id, round(3.0 * len(list_intersect(p.w, n.w)) / len(list_distinct(list_concat(p.w, n.w))) + CASE WHEN n.ty = p.ty THEN 0.5 ELSE 0 END, 9) AS score FROM p JOIN n ON len(list_intersect(p.w, n.w)) > 0 AND n.name <> p.name)
SELECT pair_id, string_agg(name, ',' ORDER BY score DESC, lower(name), id) AS negatives FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, lower(name), id) AS r FROM s) WHERE r <= 8 GROUP BY pair_id""")
def hard_negatives(spark, d):
    c = _t(spark, d, "part").selectExpr("p_partkey as concept_id", "p_name as name", "p_size % 3 as semantic_type")
    pairs = c.select(F.col("concept_id").alias("pair_id"), "concept_id", "semantic_type", F.col("name").alias("left"))
    return datasets.synonym_examples(pairs, c).withColumn("negatives", F.array_join("negatives", ","))


@query("annotation_manifest", "SELECT o_custkey AS annotation_id, min(o_orderpriority) AS label, count(DISTINCT o_orderpriority) > 1 AS conflict FROM orders GROUP BY 1")
def annotation_manifest(spark, d):
    return datasets.annotation_manifest(_t(spark, d, "orders").selectExpr("o_custkey as annotation_id", "o_orderpriority as label"))


@query("review_round_trip", "SELECT o_custkey % 300 AS annotation_id, CAST(o_custkey AS STRING) AS document_id, o_orderkey AS start, CASE WHEN count(*) OVER (PARTITION BY o_custkey % 300) > 1 THEN 'duplicate_annotation' END AS issue FROM orders")
def review_round_trip(spark, d):
    docs = _t(spark, d, "orders").selectExpr("cast(o_custkey as string) as document_id", "'text' as text").distinct()
    anns = _t(spark, d, "orders").selectExpr("cast(o_custkey as string) as document_id", "o_custkey % 300 as annotation_id", "o_orderkey as start", "o_orderkey + 1 as end")
    return datasets.import_review(datasets.export_review(docs, anns), "struct<start:bigint,end:bigint,annotation_id:bigint>").drop("end")


@query("vector_records", "SELECT DISTINCT p_partkey AS concept_id, n AS norm, 'DRUG' AS entity_type, 'S' AS code_system FROM (SELECT p_partkey, unnest([lower(p_name), lower(p_type), lower(p_name)]) AS n FROM part)")
def vector_records(spark, d):
    p = _t(spark, d, "part")
    aliases = p.selectExpr("p_partkey as concept_id", "explode(array(lower(p_name), lower(p_type), lower(p_name))) as norm")
    return datasets.vector_records(aliases, p.selectExpr("p_partkey as concept_id", "'DRUG' as semantic_type", "'S' as code_system")).drop("record_id")


@query("best_per_concept", """SELECT query_id, concept_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept_id) AS rank FROM
  (SELECT l_orderkey AS query_id, l_partkey % 10 AS concept_id, max(l_discount) AS score FROM lineitem GROUP BY ALL)) WHERE rank <= 3""")
def best_per_concept(spark, d):
    return datasets.best_per_concept(_t(spark, d, "lineitem").selectExpr("l_orderkey as query_id", "l_partkey % 10 as concept_id", "l_discount as score"), limit=3)


_NAMES = "SELECT CAST(p_partkey % 60 AS STRING) AS code, p_name AS name, CASE p_size % 4 WHEN 0 THEN 'IN' WHEN 1 THEN 'SCD' WHEN 2 THEN 'BN' ELSE 'XX' END AS tty, p_partkey % 7 = 0 AS suppressed FROM"


@query("release_rows", f"""WITH n AS ({_NAMES} part), k AS (SELECT code, name, min(CASE tty WHEN 'IN' THEN '0IN' WHEN 'BN' THEN '1BN' ELSE '2SCD' END) AS t FROM n WHERE tty <> 'XX' AND NOT suppressed GROUP BY ALL),
b AS (SELECT code, arg_min(name, t || '|' || name) AS canonical_name, substr(min(t), 2) AS tty FROM k GROUP BY code) SELECT b.*, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM k WHERE k.code = b.code AND k.name <> canonical_name), '') AS aliases FROM b""")
def release_rows(spark, d):
    _t(spark, d, "part").createOrReplaceTempView("_part_names")
    found = datasets.release_rows(spark.sql(f"{_NAMES} _part_names"), ["IN", "BN", "SCD"], {"IN": 0, "BN": 1, "SCD": 2})
    return found.withColumn("aliases", F.array_join("aliases", ","))


@query("release_profile", f"SELECT tty, count(*) AS rows, count(DISTINCT code) AS codes, count(*) FILTER (suppressed) AS suppressed, count(DISTINCT lower(name)) AS names FROM ({_NAMES} part) GROUP BY tty")
def release_profile(spark, d):
    _t(spark, d, "part").createOrReplaceTempView("_part_names")
    return datasets.release_profile(spark.sql(f"{_NAMES} _part_names"))


@query("dataset_audit", """WITH d AS (SELECT doc_id, text FROM documents), a AS (SELECT l_orderkey AS doc_id, l_linenumber AS s, l_linenumber + l_suppkey % 3 AS e FROM lineitem), h AS (SELECT a.*, text, max(e) OVER (PARTITION BY a.doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s AS o FROM a LEFT JOIN d USING (doc_id))
SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) - count(DISTINCT doc_id) FROM d) AS repeated_ids, (SELECT count(text) - count(DISTINCT text) FROM d) AS repeated_texts, (SELECT count(*) FROM d WHERE trim(text) = '') AS empty_texts,
  (SELECT count(*) FROM h) AS annotations, (SELECT count(*) FROM h WHERE text IS NULL) AS orphans, (SELECT count(*) FROM h WHERE text IS NOT NULL AND (s >= e OR e > length(text))) AS bad_offsets, (SELECT count(*) FROM h WHERE o) AS overlaps""")
def dataset_audit(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    a = _t(spark, d, "lineitem").selectExpr("l_orderkey as document_id", "l_linenumber as start", "cast(l_linenumber + l_suppkey % 3 as int) as end")
    a = a.join(docs.select("document_id", F.col("text").alias("t")), "document_id", "left").withColumn("text", F.coalesce(F.substr("t", F.col("start") + 1, F.col("end") - F.col("start")), F.lit(""))).drop("t")
    return datasets.dataset_audit(docs, a)


@query("learned_edits", """WITH o AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'DRUG' ELSE 'DISEASE' END AS ty, string_split(lower(p_type), ' ') AS m, CASE WHEN p_partkey % 8 = 0 THEN string_split(replace(lower(p_type), split_part(lower(p_type), ' ', 1), 'x'), ' ') ELSE string_split(replace(lower(p_type), split_part(lower(p_type), ' ', 1), 'y'), ' ') END AS a FROM part),
r AS (SELECT DISTINCT ty, m[i] AS s, a[i] AS t FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM o WHERE len(m) = len(a) AND len(list_filter(generate_series(1, len(m)), lambda i: m[i] <> a[i])) = 1) WHERE m[i] <> a[i]),
x AS (SELECT r.*, array_to_string(list_transform(m, lambda w: CASE WHEN w = s THEN t ELSE w END), ' ') = array_to_string(a, ' ') AS ok FROM o JOIN r ON r.ty = o.ty AND list_contains(m, s))
SELECT ty AS entity_type, s AS source, t AS target, count(*) AS support, count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) / count(*), 6) AS precision FROM x GROUP BY ty, s, t HAVING count(*) >= 3 AND round(count(*) FILTER (ok) / count(*), 6) >= 0.7""")
def learned_edits(spark, d):
    o = _t(spark, d, "part").selectExpr("case when p_size % 2 = 0 then 'DRUG' else 'DISEASE' end as entity_type", "lower(p_type) as mention", "replace(lower(p_type), split_part(lower(p_type), ' ', 1), case when p_partkey % 8 = 0 then 'x' else 'y' end) as alias")
    return datasets.learned_edits(o, 3, 0.7)


@query("alias_candidates", """WITH s AS (SELECT DISTINCT lower(w) AS norm FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM benchmark) WHERE length(w) >= 5),
t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS norm FROM documents) SELECT norm, norm AS concept_id, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM t JOIN s USING (norm) WHERE norm NOT LIKE 'a%' GROUP BY norm""")
def alias_candidates(spark, d):
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    s = _t(spark, d, "benchmark").select(words.alias("norm")).where("length(norm) >= 5").distinct().withColumn("concept_id", F.col("norm"))
    return datasets.alias_candidates(_t(spark, d, "documents").select("doc_id", "text"), s, s.where("norm like 'a%'"), most_words=2)


@query("quote_curriculum", """WITH w AS (SELECT doc_id, text, regexp_extract(text, '^[^ ]+') AS a FROM documents WHERE text LIKE '_% _%') SELECT doc_id AS document_id, 'Quote the word' AS instruction, a AS answer, 0 AS occurrence FROM w WHERE length(a) > 0
UNION ALL SELECT doc_id, 'Quote the word', ' ', 0 FROM w WHERE length(a) > 0""")
def quote_curriculum(spark, d):
    docs = _t(spark, d, "documents").where("text like '_% _%'").select(F.col("doc_id").alias("document_id"), "text")
    first = F.regexp_extract("text", "^[^ ]+", 0)
    n = F.length(first)
    spans = F.explode(F.array(F.struct(F.lit(0).alias("start"), n.alias("end"), first.alias("text")), F.struct(n.alias("start"), (n + 1).alias("end"), F.lit(" ").alias("text"))))
    a = docs.where(n > 0).select("document_id", spans.alias("s")).select("document_id", "s.*", F.lit("WORD").alias("entity_type"))
    return datasets.quote_curriculum(docs, a).drop("start", "end")


@query("pipeline_report", """WITH a AS (SELECT event_type AS name, count(*) AS now FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS name, count(*) AS before FROM events WHERE user_id % 3 = 0 GROUP BY 1)
SELECT name, coalesce(now, 0) AS now, coalesce(before, 0) AS before, coalesce(now, 0) - coalesce(before, 0) AS change, round((now - before) / before, 6) AS share FROM a FULL JOIN b USING (name)""")
def pipeline_report(spark, d):
    e = _t(spark, d, "events")
    count = lambda df: df.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value"))
    return datasets.pipeline_report(count(e.where("user_id % 2 = 0")), count(e.where("user_id % 3 = 0")))


@query("second_pass", """WITH c AS (SELECT o_custkey AS doc, o_orderkey AS m, l_partkey % 60 AS code, round(max(l_discount) * 5, 4) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
a AS (SELECT doc, m, code FROM c QUALIFY row_number() OVER (PARTITION BY m ORDER BY score DESC, code) = 1), e AS (SELECT p_partkey % 60 AS h, p_size AS t, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT h, t, n FROM e UNION ALL SELECT t, h, n FROM e), x AS (SELECT DISTINCT c.m, a.code AS k FROM c JOIN a ON a.doc = c.doc AND a.m <> c.m),
s AS (SELECT c.m, c.code, x.k, max(least(1, ln(1 + n) / ln(11)) * 0.9) AS s FROM (SELECT DISTINCT m, code FROM c) c JOIN x ON x.m = c.m JOIN b ON b.h = c.code AND b.t = x.k GROUP BY ALL),
g AS (SELECT m, code, round(0.04 * (1 - exp(sum(ln(greatest(1 - s, 1e-12))))), 6) AS bonus FROM s GROUP BY ALL)
SELECT c.m AS mention_id, c.code, round(least(1, score + coalesce(bonus, 0)), 4) AS score FROM c LEFT JOIN g ON g.m = c.m AND g.code = c.code""")
def second_pass(spark, d):
    j = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    c = j.groupBy(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("mention_id"), (F.col("l_partkey") % 60).alias("code")).agg(F.round(F.max("l_discount") * 5, 4).alias("score"))
    first = proposals.deduplicate(c, ["mention_id"], F.desc("score"), F.col("code"))
    edges = _t(spark, d, "part").groupBy((F.col("p_partkey") % 60).alias("head"), F.col("p_size").cast("long").alias("tail")).agg(F.count("*").alias("support")).withColumn("confidence", F.lit(0.9))
    return linking.second_pass(c, first, edges).select("mention_id", "code", F.round("score", 4).alias("score"))


@query("recognition_knowledge", """WITH m AS (SELECT lower(p_name) AS norm, CASE WHEN p_size % 10 = 0 THEN 'DRUG' ELSE 'DISEASE' END AS ty, p_brand AS doc FROM part), p AS (SELECT norm, ty, count(*) AS o, count(DISTINCT doc) AS d FROM m GROUP BY ALL),
t AS (SELECT norm, sum(o) AS a, max((o, d, ty)) AS t FROM p GROUP BY norm), h AS (SELECT norm, t[1] AS o, t[2] AS d, t[3] AS ty, round(t[1] / a, 6) AS share FROM t)
SELECT norm, ty AS entity_type, o AS occurrences, d AS documents, share, CASE WHEN norm LIKE 'red%' THEN 'already_known' WHEN share < 0.8 THEN 'ambiguous_type' WHEN o < 2 OR d < 2 THEN 'low_support' ELSE 'accepted' END AS decision FROM h""")
def recognition_knowledge(spark, d):
    m = _t(spark, d, "part").selectExpr("lower(p_name) as norm", "case when p_size % 10 = 0 then 'DRUG' else 'DISEASE' end as entity_type", "p_brand as doc")
    return mining.recognition_knowledge(m, m.where("norm like 'red%'"), share=0.8)
