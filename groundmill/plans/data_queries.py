"""Queries over structured tables: metrics, memories, splits, coverage, co-occurrence, graphs and fusion."""

from __future__ import annotations


from pyspark.sql import functions as F

from groundmill.functions import text as T
from groundmill.operators import evaluate, graph, linking, mining, relations, retrieval
from groundmill.plans.registry import query
from groundmill.sources.writers import review_pack as pack_reviews


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _long(df):
    """Counts and ranks as 64-bit numbers, as the SQL gives them."""
    return df.select(*[F.col(c).cast("long").alias(c) if k in ("int", "smallint") else F.col(c) for c, k in df.dtypes])


_RULE = "CASE WHEN regexp_matches(d.text, '[*&%$#!]{2}') OR length(d.text) < 200 THEN 0 ELSE 1 END"
_PAIRS = f"SELECT l.quality AS gold, {_RULE} AS pred FROM labels l JOIN documents d USING (doc_id)"


def _pairs(spark, d):
    rule = F.when(F.col("text").rlike("[*&%$#!]{2}") | (F.length("text") < 200), 0).otherwise(1)
    return _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", rule.alias("pred")), "doc_id").select(F.col("quality").alias("gold"), "pred")


@query("confusion_matrix", f"SELECT gold, pred, count(*) AS count FROM ({_PAIRS}) GROUP BY ALL")
def confusion_matrix(spark, d):
    return evaluate.confusion(_pairs(spark, d))


@query(
    "macro_f1",
    f"""WITH p AS ({_PAIRS}), l AS (SELECT gold AS label, sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) AS tp, count(*) AS support FROM p GROUP BY gold), q AS (SELECT pred AS label, count(*) AS n FROM p GROUP BY pred)
    SELECT count(*) AS labels, round(avg(2.0 * tp / (support + coalesce(n, 0))), 6) AS macro_f1 FROM l LEFT JOIN q USING (label)""",
)
def macro_f1(spark, d):
    return evaluate.macro_f1(_pairs(spark, d)).withColumn("macro_f1", F.round("macro_f1", 6))


@query(
    "exact_set_f1",
    f"""WITH g AS (SELECT doc_id FROM labels WHERE quality = 1), p AS (SELECT d.doc_id FROM documents d JOIN labels USING (doc_id) WHERE {_RULE} = 1),
    c AS (SELECT (SELECT count(*) FROM g JOIN p USING (doc_id)) AS tp, (SELECT count(*) FROM p ANTI JOIN g USING (doc_id)) AS fp, (SELECT count(*) FROM g ANTI JOIN p USING (doc_id)) AS fn)
    SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
)
def exact_set_f1(spark, d):
    rule = ~(F.col("text").rlike("[*&%$#!]{2}") | (F.length("text") < 200))
    labels = _t(spark, d, "labels")
    pred = _t(spark, d, "documents").where(rule).join(labels.select("doc_id"), "doc_id", "left_semi")
    r = evaluate.set_prf(labels.where("quality = 1"), pred, ["doc_id"])
    return r.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_P = "SELECT event_id, event_type, least(1.0, value / 100.0) AS p, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events"


def _scored(spark, d):
    return _t(spark, d, "events").select("event_id", "event_type", F.least(F.lit(1.0), F.col("value") / 100.0).alias("p"), (F.col("event_type") == "purchase").cast("int").alias("y"))


@query(
    "binary_metrics",
    f"""WITH r AS ({_P}), b AS (SELECT least(9, floor(p * 10)) AS bin, sum(CASE WHEN y = 1 AND p >= 0.5 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p >= 0.5 THEN 1 ELSE 0 END) AS fp,
      sum(CASE WHEN y = 1 AND p < 0.5 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 0 AND p < 0.5 THEN 1 ELSE 0 END) AS tn,
      sum(CASE WHEN y = 1 THEN -ln(greatest(least(p, 1 - 1e-12), 1e-12)) ELSE -ln(1 - greatest(least(p, 1 - 1e-12), 1e-12)) END) AS loss, sum((p - y) * (p - y)) AS sq, count(*) AS n, sum(p) AS ps, sum(y) AS ys FROM r GROUP BY bin),
    t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, sum(loss) AS loss, sum(sq) AS sq, sum(n) AS n, sum(abs(ps - ys)) AS gap FROM b)
    SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp / (tp + fp), 5) AS precision, round(tp / (tp + fn), 5) AS recall, round(2 * tp / (2 * tp + fp + fn), 5) AS f1,
      round(loss / n, 4) AS log_loss, round(sq / n, 5) AS brier, round(gap / n, 5) AS ece FROM t""",
)
def binary_metrics(spark, d):
    r = evaluate.binary_metrics(_scored(spark, d))
    places = {"precision": 5, "recall": 5, "f1": 5, "log_loss": 4, "brier": 5, "ece": 5}
    return r.select(*[F.round(c, places[c]).alias(c) if c in places else c for c in r.columns])


@query(
    "coverage_curve",
    f"""WITH r AS ({_P}), t AS (SELECT unnest([0.0, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95]::DOUBLE[]) AS threshold)
    SELECT threshold, round(avg(CASE WHEN p >= threshold THEN 1.0 ELSE 0.0 END), 5) AS coverage, round(coalesce(avg(CASE WHEN p >= threshold THEN y END), 0), 5) AS accuracy FROM r, t GROUP BY threshold""",
)
def coverage_curve(spark, d):
    c = evaluate.coverage_curve(_scored(spark, d).select(F.col("p").alias("score"), F.col("y").alias("correct")))
    return c.select("threshold", F.round("coverage", 5).alias("coverage"), F.round("accuracy", 5).alias("accuracy"))


@query(
    "index_percentiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(n) AS n, round(avg(CASE WHEN r = floor((n - 1) / 2.0) OR r = floor(n / 2.0) THEN value END), 6) AS p50, max(CASE WHEN r = least(n - 1, floor(n * 0.95)) THEN value END) AS p95,
      max(CASE WHEN r = least(n - 1, floor(n * 0.99)) THEN value END) AS p99 FROM r GROUP BY event_type""",
)
def index_percentiles(spark, d):
    return evaluate.index_percentiles(_t(spark, d, "events"), "value", ["event_type"]).withColumn("p50", F.round("p50", 6))


@query(
    "stage_totals",
    """WITH g AS (SELECT event_type, count(*) AS calls, round(sum(value), 2) AS total_ms, round(avg(value), 4) AS avg_ms, max(value) AS max_ms, min(event_id) AS first FROM events GROUP BY event_type)
    SELECT event_type, calls, total_ms, avg_ms, max_ms, row_number() OVER (ORDER BY first, event_type) AS position FROM g""",
)
def stage_totals(spark, d):
    s = evaluate.stage_totals(_t(spark, d, "events"), "event_type", "value", "event_id")
    return _long(s.withColumn("total_ms", F.round("total_ms", 2)).withColumn("avg_ms", F.round("avg_ms", 4)))


@query(
    "bottlenecks",
    "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type DESC) AS r FROM events) SELECT event_type, count(*) AS documents FROM r WHERE r = 1 GROUP BY event_type",
)
def bottlenecks(spark, d):
    return evaluate.bottlenecks(_t(spark, d, "events"), "user_id", "event_type", "value")


@query(
    "slice_counts",
    """SELECT 'status' AS slice, o_orderstatus AS value, count(*) AS count FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority
    UNION ALL SELECT 'size', CASE WHEN o_totalprice <= 40 THEN '0-40' WHEN o_totalprice <= 160 THEN '41-160' ELSE '161+' END, count(*) FROM orders GROUP BY ALL""",
)
def slice_counts(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), evaluate.distance_bucket(F.col("o_totalprice")).alias("size"))
    return evaluate.relation_slices(o, ["status", "priority", "size"])


_UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"


@query(
    "dense_top",
    """WITH s AS (SELECT a.vec_id AS mention_id, b.vec_id AS concept_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.label = b.label AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, concept_id) AS rank FROM s)
    SELECT mention_id, concept_id, round(score, 4) AS score, rank FROM r WHERE rank <= 5""",
)
def dense_top(spark, d):
    """Every 20th vector as a query against all vectors of its label."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("concept_id"), F.col("embedding").alias("v"), "label")
    q = v.where("concept_id % 20 = 0").withColumnRenamed("concept_id", "mention_id")
    got = retrieval.dense(q, v, 6, ["label"]).where("mention_id <> concept_id").drop("rank")
    return _long(retrieval.top_k(got, 5).withColumn("score", F.round("score", 4)))


@query(
    "recall_at_k",
    """WITH s AS (SELECT a.vec_id AS q, b.label = a.label AS hit, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, b.vec_id FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT q, hit, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s), h AS (SELECT q, min(CASE WHEN hit AND rank <= 10 THEN rank END) AS hit_rank FROM r GROUP BY q)
    SELECT count(*) AS queries, round(avg(CASE WHEN hit_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN hit_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / hit_rank, 0)), 6) AS mrr FROM h""",
)
def recall_at_k(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("concept_id"), F.col("embedding").alias("v"), "label")
    q = v.where("concept_id % 20 = 0").withColumnRenamed("concept_id", "mention_id")
    got = retrieval.dense(q, v, 11).where("mention_id <> concept_id").drop("rank")
    ranked = retrieval.top_k(got, 10).join(v.select("concept_id", F.col("label").alias("found")), "concept_id").join(q.select("mention_id", "label"), "mention_id")
    hits = q.select("mention_id").join(ranked.groupBy("mention_id").agg(F.min(F.when(F.col("label") == F.col("found"), F.col("rank"))).alias("hit_rank")), "mention_id", "left")
    r = evaluate.recall_at_k(hits, [1, 5, 10])
    return r.select("queries", *[F.round(c, 6).alias(c) for c in r.columns[1:]])


_CAND = """SELECT o_custkey AS mention_id, l_partkey AS code, CASE WHEN l_quantity > 25 THEN 'exact' ELSE 'bm25' END AS source, round(l_discount * 8 + 0.1, 4) AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""


def _candidates(spark, d):
    j = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.col("o_custkey").alias("mention_id"), F.col("l_partkey").alias("code"), F.when(F.col("l_quantity") > 25, "exact").otherwise("bm25").alias("source"), F.round(F.col("l_discount") * 8 + 0.1, 4).alias("score"))


_FUSED = f"""c AS ({_CAND}), b AS (SELECT mention_id, code, source, max(score) AS score FROM c GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY mention_id, source ORDER BY score DESC, code) AS r, CASE source WHEN 'exact' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM b),
    g AS (SELECT mention_id, code, max(score) AS p, count(*) AS sources, sum(w * score / (60 + r)) AS a, sum(w) / 61 AS b FROM r GROUP BY ALL),
    f AS (SELECT mention_id, code, sources, round(CASE WHEN sources >= 2 THEN least(1.0, p + (1 - p) * 0.1 * a / b) ELSE p END, 6) AS score FROM g)"""


@query("rank_fusion", f"WITH {_FUSED} SELECT mention_id, code, sources, round(score + 1e-7, 5) AS score FROM f")
def rank_fusion(spark, d):
    return retrieval.fuse(_candidates(spark, d)).select("mention_id", "code", "sources", F.round(F.col("score") + 1e-7, 5).alias("score"))  # sums of floats: the sixth digit may differ, and a half must not fall either way


@query(
    "qualified_candidates",
    f"""WITH {_FUSED}, k AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, code) AS rank FROM f), l AS (SELECT *, max(score) OVER (PARTITION BY mention_id) AS top FROM k WHERE rank <= 10),
    q AS (SELECT *, CASE WHEN score < 0.5 THEN 'below_absolute_threshold' WHEN score < top * 0.75 THEN 'outside_relative_margin' END AS first FROM l),
    n AS (SELECT *, sum(CASE WHEN first IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY mention_id ORDER BY rank) AS n FROM q)
    SELECT mention_id, code, rank, coalesce(first, CASE WHEN n > 5 THEN 'beyond_max_candidates' END, 'qualified') AS reason FROM n""",
)
def qualified_candidates(spark, d):
    ranked = retrieval.top_k(retrieval.fuse(_candidates(spark, d)), 10, order=[F.desc("score"), F.asc("code")])
    return _long(linking.qualify(ranked).select("mention_id", "code", "rank", "reason"))


@query(
    "assigned_codes",
    f"""WITH {_FUSED}, k AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, code) AS rank FROM f), s AS (SELECT *, lead(score) OVER (PARTITION BY mention_id ORDER BY rank) AS second FROM k WHERE rank <= 10)
    SELECT mention_id, code, score >= 0.75 AND round(score - coalesce(second, 0), 9) >= 0.05 AS assigned FROM s WHERE rank = 1""",
)
def assigned_codes(spark, d):
    ranked = retrieval.top_k(retrieval.fuse(_candidates(spark, d)), 10, order=[F.desc("score"), F.asc("code")])
    return linking.assign(linking.qualify(ranked)).select("mention_id", "code", "assigned")


@query("emitted_sets")
def emitted_sets(spark, d):
    return linking.emission(retrieval.top_k(retrieval.fuse(_candidates(spark, d)), 5, order=[F.desc("score"), F.asc("code")]), 0.3)


_OBS = "SELECT split_part(p_name, ' ', 1) AS mention, p_type AS code, p_brand AS doc, p_partkey % 5 AS fold FROM part"


def _observed(spark, d):
    return _t(spark, d, "part").select(F.get(F.split("p_name", " "), 0).alias("mention"), F.col("p_type").alias("code"), F.col("p_brand").alias("doc"), (F.col("p_partkey") % 5).cast("int").alias("fold"))


@query(
    "code_memory",
    f"""WITH o AS ({_OBS}), c AS (SELECT mention, code, count(*) AS n FROM o GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY mention) AS p, row_number() OVER (PARTITION BY mention ORDER BY n DESC, code DESC) AS r FROM c)
    SELECT p.mention, CAST(sum(n) AS BIGINT) AS observations, count(*) AS codes, round(sum(-p * log2(p)), 6) AS entropy, max(CASE WHEN r = 1 THEN code END) AS top_code, round(max(p), 6) AS top_probability, any_value(d.documents) AS documents
    FROM p JOIN (SELECT mention, count(DISTINCT doc) AS documents FROM o GROUP BY mention) d ON d.mention = p.mention GROUP BY p.mention""",
)
def code_memory(spark, d):
    m = linking.code_memory(_observed(spark, d), ["mention"], "code", "doc")
    return m.withColumn("entropy", F.round("entropy", 6)).withColumn("top_probability", F.round("top_probability", 6))


@query(
    "cross_fitted_memory",
    f"""WITH o AS ({_OBS}), h AS (SELECT unnest(range(0, 5)) AS held), c AS (SELECT held, mention, code, count(*) AS n FROM o, h WHERE fold <> held GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY held, mention) AS t, row_number() OVER (PARTITION BY held, mention ORDER BY n DESC, code DESC) AS r FROM c)
    SELECT held, mention, code AS top_code, n, round(n / t, 6) AS share FROM r WHERE r = 1""",
)
def cross_fitted_memory(spark, d):
    return _long(linking.cross_fitted_memory(_observed(spark, d), ["mention"], "code", "fold", 5).withColumn("share", F.round("share", 6)))


@query(
    "listwise_ranking",
    """WITH o AS (SELECT o_custkey AS query_id, o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
    u AS (SELECT query_id, len(c) AS n, unnest(c) AS candidate, unnest(range(0, len(c))) AS pos FROM o), k AS (SELECT query_id, count(*) AS orders FROM o GROUP BY query_id),
    s AS (SELECT query_id, candidate, round(sum(1 - pos::DOUBLE / n) / any_value(orders), 6) AS score, sum(CASE WHEN pos = 0 THEN 1 ELSE 0 END) / any_value(orders) AS f FROM u JOIN k USING (query_id) GROUP BY ALL)
    SELECT query_id, candidate, score, false AS abstain, round(f, 6) AS first_share FROM s""",
)
def listwise_ranking(spark, d):
    j = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    o = j.groupBy(F.col("o_custkey").alias("query_id"), "o_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("candidates"))
    r = linking.listwise(o)
    return r.select("query_id", "candidate", "score", "abstain", F.round("first_share", 6).alias("first_share"))


@query("review_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('s' || chr(0) || o_orderpriority || chr(0) || o_orderkey), o_orderkey) AS position FROM orders")
def review_order(spark, d):
    return _long(linking.seeded_order(_t(spark, d, "orders"), "s", "o_orderpriority", "o_orderkey").select("o_orderkey", "position"))


@query(
    "review_pack",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents), s AS (SELECT *, ceil(n * 0.1) AS sh FROM r)
    SELECT doc_id, unnest(CASE WHEN r < sh THEN ['a', 'b', 'c'] ELSE [['a', 'b', 'c'][CAST((r - sh) % 3 AS INT) + 1]] END) AS reviewer, r < sh AS shared FROM s""",
)
def review_pack(spark, d):
    return pack_reviews(_t(spark, d, "documents"), ["a", "b", "c"], 0.1, "doc_id")


@query(
    "split_assignment",
    "SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256('v1' || chr(0) || doc_id), 1, 8) AS BIGINT) / 4294967295.0 < 0.1 THEN 'development' ELSE 'train' END AS split FROM documents",
)
def split_assignment(spark, d):
    return _t(spark, d, "documents").select("doc_id", mining.split_of(F.col("doc_id"), "v1").alias("split"))


@query(
    "component_splits",
    """WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS component, coalesce(toxic, 0) AS c FROM documents LEFT JOIN labels USING (doc_id)), g AS (SELECT component, max(c) AS c FROM k GROUP BY component)
    SELECT doc_id, component, CASE WHEN g.c = 1 THEN 'challenge' WHEN CAST('0x' || substr(sha256('v1' || chr(0) || component), 1, 8) AS BIGINT) / 4294967295.0 < 0.1 THEN 'development' ELSE 'train' END AS split FROM k JOIN g USING (component)""",
)
def component_splits(spark, d):
    g = mining.duplicate_groups(_t(spark, d, "documents"), "doc_id", F.col("text")).select("doc_id", F.col("canonical").alias("component"))
    g = g.join(_t(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left").fillna(0, ["toxic"])
    return mining.component_splits(g, "component", "toxic", "v1").select("doc_id", "component", "split")


@query(
    "split_leakage",
    """WITH s AS (SELECT DISTINCT sha256(text) AS h, CASE WHEN CAST('0x' || substr(sha256('v1' || chr(0) || doc_id), 1, 8) AS BIGINT) / 4294967295.0 < 0.1 THEN 'development' ELSE 'train' END AS split FROM documents)
    SELECT h, list_sort(list(split)) AS splits FROM s GROUP BY h HAVING count(*) > 1""",
)
def split_leakage(spark, d):
    rows = _t(spark, d, "documents").select(F.sha2("text", 256).alias("h"), mining.split_of(F.col("doc_id"), "v1").alias("split"))
    return mining.cross_split_overlap(rows, "h", "split")


@query(
    "coverage_cells",
    """WITH t AS (SELECT l.lang, s.source, 10 AS target FROM (SELECT DISTINCT lang FROM documents) l, (SELECT DISTINCT source FROM documents) s), o AS (SELECT lang, source, count(*) AS observed FROM documents GROUP BY ALL)
    SELECT lang, source, coalesce(observed, 0) AS observed, round(greatest(0, 1 - least(1.0, coalesce(observed, 0) / 10.0)), 6) AS gap FROM t LEFT JOIN o USING (lang, source)""",
)
def coverage_cells(spark, d):
    docs = _t(spark, d, "documents")
    targets = docs.select("lang").distinct().join(docs.select("source").distinct()).withColumn("target", F.lit(10))  # configured cells: languages by sources
    c = mining.coverage(docs, targets, ["lang", "source"])
    return c.select("lang", "source", "observed", F.round("gap", 6).alias("gap"))


@query(
    "cooccurring_parts",
    """WITH i AS (SELECT l_orderkey, l_partkey % 200 AS node, l_linenumber FROM lineitem), p AS (SELECT a.node AS head, b.node AS tail, a.l_orderkey FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.node < b.node AND abs(a.l_linenumber - b.l_linenumber) <= 3)
    SELECT head, tail, count(DISTINCT l_orderkey) AS support, count(*) AS occurrences FROM p GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 2""",
)
def cooccurring_parts(spark, d):
    i = _t(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 200).alias("node"), "l_linenumber", F.col("l_orderkey").alias("doc"))
    return mining.cooccurrence(i, "l_orderkey", "doc", "node", "l_linenumber", support=2, gap=3)


@query(
    "event_consensus",
    """WITH v AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, event_id % 7 AS labeler, max(value) AS c FROM events GROUP BY ALL)
    SELECT user_id, CAST(day AS VARCHAR) AS day, event_type, count(*) AS votes, round(avg(c), 4) AS confidence, CASE WHEN count(*) >= 2 THEN 'silver' ELSE 'bronze' END AS tier FROM v GROUP BY ALL""",
)
def event_consensus(spark, d):
    e = _t(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type", (F.col("event_id") % 7).alias("labeler"), "value")
    return mining.consensus(e, ["user_id", "day", "event_type"], "labeler", "value").withColumn("confidence", F.round("confidence", 4))


@query(
    "promoted_aliases",
    f"""WITH o AS ({_OBS}), g AS (SELECT mention AS alias, code, count(*) AS occurrences, count(DISTINCT doc) AS documents FROM o GROUP BY ALL), t AS (SELECT *, count(*) OVER (PARTITION BY alias) AS targets FROM g)
    SELECT alias, code, occurrences, documents, targets, CASE WHEN targets > 1 THEN 'target_conflict' WHEN occurrences < 2 OR documents < 2 THEN 'low_support' ELSE 'promoted' END AS decision FROM t""",
)
def promoted_aliases(spark, d):
    o = _observed(spark, d).select(F.col("mention").alias("alias"), "code", F.col("doc").alias("document"))
    return mining.promote_aliases(o, o.select("alias", "code").limit(0))


@query(
    "annotation_gates",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'status' WHEN o_totalprice < 1000 THEN 'length' WHEN o_orderpriority = '1-URGENT' THEN 'layer' END AS reason,
      list_filter([CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN o_totalprice < 1000 THEN 'length' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'layer' END], lambda x: x IS NOT NULL) AS reasons FROM orders""",
)
def annotation_gates(spark, d):
    rules = {"status": F.col("o_orderstatus") == "P", "length": F.col("o_totalprice") < 1000, "layer": F.col("o_orderpriority") == "1-URGENT"}
    return _t(spark, d, "orders").select("o_orderkey", mining.first_reason(rules).alias("reason"), mining.reasons(rules).alias("reasons"))


@query(
    "compiled_edges",
    """SELECT o_custkey AS head, l_returnflag AS relation, l_partkey % 100 AS tail, count(*) AS support, count(DISTINCT o_orderkey) AS documents, round(avg(l_discount), 6) AS confidence_mean, min(l_discount) AS confidence_min, max(l_discount) AS confidence_max, list_sort(list(DISTINCT l_linestatus)) AS sources
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
)
def compiled_edges(spark, d):
    j = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("head"), F.col("l_returnflag").alias("relation"), (F.col("l_partkey") % 100).alias("tail"), "o_orderkey", "l_discount", "l_linestatus")
    return graph.compile_edges(j, "head", "relation", "tail", "o_orderkey", "l_discount", "l_linestatus").withColumn("confidence_mean", F.round("confidence_mean", 6))


@query(
    "graph_neighbors",
    """WITH e AS (SELECT o_custkey AS head, l_partkey % 50 + 100000 AS tail, l_returnflag AS relation, count(*) AS support FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
    b AS (SELECT head AS node, tail AS other, relation, support, 'out' AS side FROM e UNION ALL SELECT tail, head, relation, support, 'in' FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY support DESC, other, relation, side) AS rank FROM b) SELECT * FROM r WHERE rank <= 10""",
)
def graph_neighbors(spark, d):
    j = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = j.groupBy(F.col("o_custkey").alias("head"), (F.col("l_partkey") % 50 + 100000).alias("tail"), F.col("l_returnflag").alias("relation")).agg(F.count("*").alias("support"))
    return _long(graph.neighbors(e))


_ISA = "SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1"


@query(
    "is_a_closure",
    f"""WITH RECURSIVE e AS ({_ISA}), up(node, ancestor, distance) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT u.node, e.parent, u.distance + 1 FROM up u JOIN e ON u.ancestor = e.child WHERE u.distance < 20)
    SELECT node, ancestor, min(distance) AS distance FROM up GROUP BY node, ancestor""",
)
def is_a_closure(spark, d):
    return _long(graph.ancestors(_t(spark, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))))


@query(
    "shortest_paths",
    f"""WITH RECURSIVE e AS ({_ISA}), up(node, ancestor, path) AS (SELECT child, parent, [child, parent] FROM e UNION ALL SELECT u.node, e.parent, list_append(u.path, e.parent) FROM up u JOIN e ON u.ancestor = e.child WHERE len(u.path) <= 20)
    SELECT node, ancestor, path FROM up""",
)
def shortest_paths(spark, d):
    return graph.shortest_paths(_t(spark, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent")))


@query(
    "overlap_islands",
    """WITH s AS (SELECT user_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value) AS BIGINT) * 600 + 1 AS e FROM events),
    b AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s), i AS (SELECT k, s, e, sum(CASE WHEN s < m THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM b)
    SELECT k, CAST(i AS BIGINT) AS island, count(*) AS spans, min(s) AS first, max(e) AS last FROM i GROUP BY ALL""",
)
def overlap_islands(spark, d):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    s = _t(spark, d, "events").select(F.col("user_id").alias("k"), at.alias("start"), (at + F.floor("value") * 600 + 1).alias("end"))
    return relations.overlap_islands(s, ["k"]).groupBy("k", "island").agg(F.count("*").alias("spans"), F.min("start").alias("first"), F.max("end").alias("last"))


@query(
    "bio_spans",
    """WITH t AS (SELECT l_orderkey AS k, l_linenumber * 1000000 + l_partkey AS i, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS ty, CASE WHEN l_linestatus = 'O' OR l_quantity < 20 THEN 'B' ELSE 'I' END AS tag FROM lineitem),
    p AS (SELECT *, lag(ty) OVER w AS pt FROM t WINDOW w AS (PARTITION BY k ORDER BY i)),
    s AS (SELECT *, sum(CASE WHEN ty IS NOT NULL AND (tag = 'B' OR pt IS NULL OR pt <> ty) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS g FROM p)
    SELECT k, ty AS type, min(i) AS first, max(i) AS last FROM s WHERE ty IS NOT NULL GROUP BY k, g, ty""",
)
def bio_spans(spark, d):
    from groundmill.operators.extract import decode_bio

    tag = F.when((F.col("l_linestatus") == "O") | (F.col("l_quantity") < 20), "B-").otherwise("I-")
    t = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("i"), F.when(F.col("l_returnflag") == "N", "O").otherwise(F.concat(tag, "l_returnflag")).alias("label"))
    return decode_bio(t, "k", "i", "label")


@query(
    "merged_concepts",
    """SELECT p_brand, min_by(p_type, p_partkey) AS p_type, list_sort(list(DISTINCT split_part(p_name, ' ', 1))) AS words, count(DISTINCT p_type) > 1 AS conflict FROM part GROUP BY p_brand""",
)
def merged_concepts(spark, d):
    p = _t(spark, d, "part").select("p_brand", "p_partkey", "p_type", F.array(F.get(F.split("p_name", " "), 0)).alias("words"))
    return mining.merge_concepts(p, "p_brand", "p_partkey", ["p_type"], ["words"]).withColumn("words", F.array_sort("words"))


@query(
    "synonym_pairs",
    """WITH a AS (SELECT DISTINCT p_brand, p_name FROM part), i AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS i FROM a), f AS (SELECT * FROM i WHERE i <= 8),
    p AS (SELECT x.p_brand, x.p_name AS l, y.p_name AS r, row_number() OVER (PARTITION BY x.p_brand ORDER BY x.i, y.i) AS n FROM f x JOIN f y ON x.p_brand = y.p_brand AND x.i < y.i) SELECT p_brand, l AS left, r AS right FROM p WHERE n <= 12""",
)
def synonym_pairs(spark, d):
    return mining.synonym_pairs(_t(spark, d, "part"), "p_brand", "p_name")


@query("lane_corpus", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1")
def lane_corpus(spark, d):
    return mining.first_lane(_t(spark, d, "documents"), "text", "source", "doc_id").select("doc_id", "source")


@query(
    "restrictive_policy",
    "SELECT c_mktsegment AS segment, CASE max(CASE WHEN c_acctbal < 0 THEN 3 WHEN c_acctbal < 9000 THEN 2 ELSE 1 END) WHEN 3 THEN 'closed' WHEN 2 THEN 'limited' ELSE 'open' END AS access FROM customer GROUP BY c_mktsegment",
)
def restrictive_policy(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") < 0, "closed").when(F.col("c_acctbal") < 9000, "limited").otherwise("open").alias("access"))
    return mining.most_restrictive(c, "segment", "access", ["open", "limited", "closed"])


@query("document_manifest", "SELECT o_custkey, min_by(o_orderstatus, o_orderkey) AS content, list_sort(list(DISTINCT o_orderkey)) AS origins, count(DISTINCT o_orderstatus) > 1 AS conflict FROM orders GROUP BY o_custkey")
def document_manifest(spark, d):
    return mining.upsert_documents(_t(spark, d, "orders").withColumnRenamed("o_orderstatus", "content"), "o_custkey", "content", "o_orderkey")


@query(
    "drug_codes",
    """SELECT p_partkey, lpad(CAST(p_partkey % 90000 AS VARCHAR), 5, '0') || lpad(CAST(p_size AS VARCHAR), 4, '0') || '07' AS ndc11, lpad(CAST(p_partkey % 90000 AS VARCHAR), 5, '0') || lpad(CAST(p_size AS VARCHAR), 4, '0') AS product FROM part""",
)
def drug_codes(spark, d):
    v = F.concat_ws("-", F.lpad((F.col("p_partkey") % 90000).cast("string"), 5, "0"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("07"))
    return _t(spark, d, "part").select("p_partkey", T.ndc11(v).alias("ndc11"), T.ndc_product(v).alias("product"))


@query(
    "short_circuit",
    f"""WITH c AS ({_CAND}), s AS (SELECT *, CASE WHEN source = 'exact' THEN 0 ELSE 1 END AS stage FROM c), m AS (SELECT *, min(CASE WHEN source = 'exact' THEN stage END) OVER (PARTITION BY mention_id) AS stop FROM s)
    SELECT mention_id, count(*) AS kept FROM m WHERE stop IS NULL OR stage <= stop GROUP BY mention_id""",
)
def short_circuit(spark, d):
    c = _candidates(spark, d).withColumn("stage", F.when(F.col("source") == "exact", 0).otherwise(1))
    return retrieval.short_circuit(c, ["exact"]).groupBy("mention_id").agg(F.count("*").alias("kept"))


@query("dataset_profile", "SELECT lang, source, count(*) AS documents, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 3) AS mean, count(DISTINCT text) AS texts FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def dataset_profile(spark, d):
    docs = _t(spark, d, "documents")
    docs.select("lang", "source", F.length("text").alias("n"), F.sha2("text", 256).alias("h")).createOrReplaceTempView("groundmill_profile")
    r = spark.sql("SELECT lang, source, count(*) AS documents, min(n) AS least, max(n) AS most, round(avg(n), 3) AS mean, count(DISTINCT h) AS texts FROM groundmill_profile GROUP BY GROUPING SETS ((lang), (source), ())")
    return _long(r)


@query("pruned_scan", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pruned_scan(spark, d):
    """Two-column grouping with a pushed filter: the scan reads four columns."""
    x = _t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"))



