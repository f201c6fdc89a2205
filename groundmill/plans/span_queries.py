"""Queries of span operators.  The tables hold no clinical prose, so sentences are set from their names and numbers by
expressions that Spark and DuckDB read alike; the SQL then says where each span must be."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundmill.functions.text import span_slice
from groundmill.operators import assertions, offsets, proposals
from groundmill.plans.registry import query


def _from(spark, d, table, columns):
    spark.read.parquet(f"{d}/{table}.parquet").createOrReplaceTempView(f"_{table}_spans")
    return spark.sql(f"SELECT {columns} FROM _{table}_spans")


_NORM = "trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))"


@query("collapsed_whitespace", f"SELECT doc_id, sha256({_NORM}) AS norm, length({_NORM}) AS size, 0 AS issues, CASE WHEN {_NORM} LIKE '% % %' THEN split_part({_NORM}, ' ', 3) END AS third FROM documents")
def collapsed_whitespace(spark, d):
    m = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", offsets.collapse_whitespace(F.col("text")).alias("m"))
    third = F.regexp_extract("m.norm", r"^([^ ]* [^ ]* )([^ ]+)", 2)
    start = F.length(F.regexp_extract("m.norm", r"^[^ ]* [^ ]* ", 0))
    m = m.withColumn("span", offsets.original_span(F.col("m"), start, start + F.length(third)))
    return m.select(
        "doc_id", F.sha2("m.norm", 256).alias("norm"), F.length("m.norm").cast("long").alias("size"), F.size(offsets.contract_issues(F.col("m"), F.col("text"))).alias("issues"),
        F.when(F.col("m.norm").rlike("^[^ ]* [^ ]* "), span_slice(F.col("text"), F.col("span.start"), F.col("span.end"))).alias("third"),
    )


@query("pattern_spans", """SELECT doc_id, rule_id, len(hits) AS n, sha256(array_to_string(hits, '|')) AS digest, true AS holds FROM (
  SELECT doc_id, 'number' AS rule_id, regexp_extract_all(text, '[0-9]+') AS hits FROM documents UNION ALL SELECT doc_id, 'name', regexp_extract_all(text, '[A-Z][a-z]+') FROM documents) WHERE len(hits) > 0""")
def pattern_spans(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = proposals.pattern_spans(docs, {"number": "[0-9]+", "name": "[A-Z][a-z]+"}, "doc_id", "text").join(docs.select("doc_id", "text"), "doc_id")
    held = found.withColumn("ok", span_slice(F.col("text"), F.col("start"), F.col("end")) == F.col("value"))
    each = held.groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("start", "value"))).alias("v"), F.min("ok").alias("holds"))
    return each.select("doc_id", "rule_id", "n", F.sha2(F.array_join(F.transform("v", lambda x: x["value"]), "|"), 256).alias("digest"), "holds")


_PAIR = "p_partkey AS doc, p_name || ' = ' || CAST(p_size AS STRING) || '%, level ' || CAST(p_size AS STRING) AS line, length(p_name) AS n, length(CAST(p_size AS STRING)) AS k"


@query("lab_pairs", f"""WITH p AS (SELECT {_PAIR} FROM part) SELECT doc, s + 0 AS start, s + n AS "end", s + n + 3 AS result_start, s + n + 4 + k AS result_end, doc % 2 = 0 AS in_section FROM (SELECT *, CASE WHEN doc % 2 = 0 THEN 6 ELSE 0 END AS s FROM p)
UNION ALL SELECT doc, 6 + n + k + 6, 6 + n + k + 11, 6 + n + k + 12, 6 + n + k + k + 12, true FROM p WHERE doc % 2 = 0""")
def lab_pairs(spark, d):
    docs = _from(spark, d, "part", _PAIR).withColumn("text", F.when(F.col("doc") % 2 == 0, F.concat(F.lit("Labs:\n"), "line")).otherwise(F.col("line")))
    return proposals.lab_pairs(docs, "doc", "text")


_SIG = "o_orderkey AS doc, 'take drug ' || CAST(o_orderkey % 300 AS STRING) || ' mg po ' || CASE WHEN o_custkey % 2 = 0 THEN 'bid' ELSE 'q12h' END || '; then rest 3 days' AS text, length(CAST(o_orderkey % 300 AS STRING)) AS k, CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE 4 END AS f"


@query("drug_attributes", f"""WITH o AS (SELECT {_SIG} FROM orders) SELECT doc, 'STRENGTH' AS rule_id, 10 AS start, 13 + k AS "end" FROM o UNION ALL SELECT doc, 'ROUTE', 14 + k, 16 + k FROM o UNION ALL SELECT doc, 'FREQUENCY', 17 + k, 17 + k + f FROM o""")
def drug_attributes(spark, d):
    docs = _from(spark, d, "orders", _SIG)
    anchors = docs.select("doc", F.lit(5).alias("start"), F.lit(9).alias("end"))
    return proposals.around(docs, anchors, proposals.ATTRIBUTE_PATTERNS, "doc", "text").select("doc", "rule_id", "start", "end")


@query("grown_mentions", f"""WITH o AS (SELECT {_SIG} FROM orders) SELECT doc, 17 + k + f AS full_end, 'administered_dose,route,frequency' AS kinds FROM o""")
def grown_mentions(spark, d):
    docs = _from(spark, d, "orders", _SIG)
    found = proposals.grow_mentions(docs, docs.select("doc", F.lit(5).alias("start"), F.lit(9).alias("end")), "doc", "text")
    return found.select("doc", "full_end", F.array_join(F.transform("components", lambda c: c["kind"]), ",").alias("kinds"))


_LIST = "p_partkey AS doc, 'Home drugs' || chr(10) || CAST(p_size AS STRING) || '. ' || p_name || ' for ' || p_brand || chr(10) || '- ' || p_type AS text, length(CAST(p_size AS STRING)) AS k, length(p_name) AS n, length(p_brand) AS b, length(p_type) AS t"


@query("list_items", f"""WITH p AS (SELECT {_LIST} FROM part) SELECT doc, 1 AS item, 13 + k AS start, 13 + k + n AS "end", 18 + k + n AS indication_start, 18 + k + n + b AS indication_end FROM p
UNION ALL SELECT doc, 2, 21 + k + n + b, 21 + k + n + b + t, NULL, NULL FROM p""")
def list_items(spark, d):
    return proposals.list_items(_from(spark, d, "part", _LIST), "doc", "text")


@query("lab_results", f"""WITH p AS (SELECT {_PAIR} FROM part) SELECT doc, 0 AS anchor_start, 4 AS start, 5 + k AS "end" FROM (SELECT doc, k FROM p) UNION ALL SELECT doc, 7 + k, 19 + k, 25 + k FROM p""")
def lab_results(spark, d):
    docs = _from(spark, d, "part", "p_partkey AS doc, 'Na: ' || CAST(p_size AS STRING) || '%, urine shows normal' AS text, length(CAST(p_size AS STRING)) AS k")
    anchors = docs.select("doc", F.lit(0).alias("start"), F.lit(2).alias("end")).union(docs.select("doc", F.col("k") + 7, F.col("k") + 12))
    return proposals.lab_results(docs, anchors, "doc", "text").select("doc", "anchor_start", "start", "end")


_TOKENS = "l_orderkey AS k, l_linenumber * 1000000 + l_partkey AS s, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS ty, CASE WHEN l_linestatus = 'O' OR l_quantity < 20 THEN 'B' ELSE 'I' END AS tag, round(l_discount * 10, 2) AS score"


@query("projected_labels", f"""WITH t AS (SELECT * FROM (SELECT {_TOKENS} FROM lineitem) QUALIFY row_number() OVER (PARTITION BY k, s ORDER BY score DESC, coalesce(tag || '-' || ty, 'O')) = 1),
p AS (SELECT *, lag(ty) OVER (PARTITION BY k ORDER BY s) AS pt FROM t), g AS (SELECT *, sum(CASE WHEN ty IS NOT NULL AND (tag = 'B' OR pt IS NULL OR pt <> ty) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s) AS g FROM p)
SELECT k, ty AS type, min(s) AS start, max(s) + 1 AS "end", round(avg(score), 6) AS score FROM g WHERE ty IS NOT NULL GROUP BY k, g, ty HAVING avg(score) >= CASE ty WHEN 'A' THEN 0.4 ELSE 0.6 END""")
def projected_labels(spark, d):
    t = _from(spark, d, "lineitem", _TOKENS).select("k", F.col("s").alias("start"), (F.col("s") + 1).alias("end"), F.coalesce(F.concat_ws("-", "tag", F.when(F.col("ty").isNotNull(), F.col("ty"))), F.lit("O")).alias("label"), "score", "ty")
    t = t.withColumn("label", F.when(F.col("ty").isNull(), "O").otherwise(F.col("label"))).drop("ty")
    return proposals.project_labels(t, "k", {"A": 0.4}, 0.6).withColumn("score", F.round("score", 6))


_SPANS = "l_orderkey AS doc, l_linenumber * 10 AS start, l_linenumber * 10 + CAST(l_quantity AS INTEGER) % 17 + 1 AS stop, l_returnflag AS type, round(0.3 + l_discount * 6, 3) AS score, l_suppkey % 2 AS half"


@query("hybrid_spans", f"""WITH l AS (SELECT {_SPANS} FROM lineitem), r AS (SELECT DISTINCT doc, start, stop, type, max(score) AS score FROM l WHERE half = 0 GROUP BY ALL), m AS (SELECT doc, start, stop, type, max(score) AS score FROM l WHERE half = 1 AND score >= 0.5 GROUP BY ALL)
SELECT doc, start, stop, type, greatest(r.score, coalesce(m.score, r.score)) AS score, CASE WHEN m.doc IS NULL THEN 'rule' ELSE 'model,rule' END AS sources FROM r LEFT JOIN m USING (doc, start, stop, type)
UNION ALL SELECT doc, start, stop, type, score, 'model' FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc = m.doc AND r.start < m.stop AND m.start < r.stop)""")
def hybrid_spans(spark, d):
    s = _from(spark, d, "lineitem", _SPANS).withColumnRenamed("stop", "end")
    return proposals.hybrid(s.where("half = 0"), s.where("half = 1"), "doc").withColumn("sources", F.array_join("sources", ",")).withColumnRenamed("end", "stop")


@query("distinct_spans", f"SELECT doc, start, type, max(score) AS score FROM (SELECT {_SPANS} FROM lineitem) GROUP BY ALL")
def distinct_spans(spark, d):
    s = _from(spark, d, "lineitem", _SPANS)
    return proposals.deduplicate(s, ["doc", "start", "type"], F.desc("score"), F.col("stop"), F.col("half")).select("doc", "start", "type", "score")


@query("span_decisions")
def span_decisions(spark, d):
    """Selected and rejected proposals with the reason; the selection is held against brute force in the tests."""
    s = _from(spark, d, "lineitem", _SPANS).withColumnRenamed("stop", "end").withColumn("source", F.col("half").cast("string"))
    s = s.withColumn("type", F.when(F.col("type") != "N", F.col("type"))).withColumn("atomic", F.col("score") > 0.8).withColumn("nested", F.lit(0))
    return proposals.resolve(s, "doc")


_SAID = """c_custkey AS id, CASE WHEN c_nationkey < 20 THEN 'DISEASE' ELSE 'DRUG' END AS entity_type, c_name AS name,
  CASE c_custkey % 10 WHEN 0 THEN 'Denies fever, chills, ' WHEN 1 THEN 'His mother diagnosed with ' WHEN 2 THEN 'No fever but there is ' WHEN 3 THEN 'Possible ' WHEN 4 THEN 'Seen by his mother. ' WHEN 5 THEN 'Denies pain; '
    WHEN 6 THEN 'Rule out and treat ' WHEN 7 THEN 'Old history of ' WHEN 8 THEN 'Denies all except ' ELSE 'Today ' END AS before,
  CASE WHEN c_nationkey % 4 = 0 THEN ' was ruled out' WHEN c_nationkey % 4 = 1 THEN '. Not this' ELSE ' today' END AS after, CASE WHEN c_custkey % 7 = 0 THEN 'Past History' END AS section"""
CUES = [
    ("n1", "denies", "NEGATED", "left", 10, 60, ["except"], None), ("n2", "no", "NEGATED", "left", 10, 40, None, None), ("n3", "was ruled out", "NEGATED", "right", 10, 20, None, None),
    ("f1", "mother", "FAMILY", "left", 20, 40, None, None), ("p1", "possible", "POSSIBLE", "bidirectional", 5, 30, None, ["DISEASE"]), ("p2", "rule out", "POSSIBLE", "left", 5, 6, None, None),
    ("h1", "history of", "HISTORICAL", "left", 8, 30, None, None), ("s1", "past history", "HISTORICAL", "section_prior", 1, 0, None, None),
]
CUE_TYPE = "rule_id string, cue string, assertion string, scope string, priority int, most int, termination array<string>, types array<string>"


@query("assertion_status", f"""WITH s AS (SELECT {_SAID} FROM customer), h AS (SELECT *, id % 10 AS k, after = ' was ruled out' AS out_ FROM s),
r AS (SELECT *, list_filter([CASE WHEN k = 1 THEN 'f1' END, CASE WHEN k = 7 THEN 'h1' END, CASE WHEN k = 0 THEN 'n1' END, CASE WHEN k = 2 THEN 'n2' END, CASE WHEN out_ THEN 'n3' END, CASE WHEN k = 3 AND entity_type = 'DISEASE' THEN 'p1' END, CASE WHEN section IS NOT NULL THEN 's1' END], lambda x: x IS NOT NULL) AS rules FROM h)
SELECT id, array_to_string(rules, ',') AS rules, CASE WHEN list_contains(rules, 'f1') THEN 'FAMILY' WHEN list_has_any(rules, ['n1', 'n2', 'n3']) THEN 'NEGATED' WHEN list_contains(rules, 'h1') OR list_contains(rules, 's1') THEN 'HISTORICAL' WHEN list_contains(rules, 'p1') THEN 'POSSIBLE' ELSE 'PRESENT' END AS assertion FROM r""")
def assertion_status(spark, d):
    s = _from(spark, d, "customer", _SAID)
    m = s.select("id", "entity_type", F.concat("before", "name", "after").alias("sentence"), F.length("before").alias("start"), (F.length("before") + F.length("name")).alias("end"), "section")
    cues = spark.createDataFrame(CUES, CUE_TYPE)
    return assertions.classify(m, cues).select("id", F.array_join("rules", ",").alias("rules"), "assertion")
