"""Queries over text: keys, segments, inventories, matches and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundmill.functions import text as T
from groundmill.operators import evaluate, mining, relations, retrieval, segment
from groundmill.plans.registry import query

TOK = r"[^\p{L}\p{N}]+"
SQL_TOK = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_ACC = "lower(translate(text, '%s', '%s'))" % (T.ACCENTED, T.PLAIN)


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _mentions(spark, d, least=6):
    docs = _t(spark, d, "documents").select("doc_id", "lang", F.explode(T.tokens(F.col("text"))).alias("token"))
    return docs.where(F.length("token") >= least)


_MENTIONS = f"SELECT doc_id, lang, token FROM (SELECT doc_id, lang, unnest({SQL_TOK}) AS token FROM documents) WHERE length(token) >= 6"


@query(
    "mention_inventory",
    f"""WITH m AS ({_MENTIONS}),
    per AS (SELECT token, lang, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM m GROUP BY ALL),
    l AS (SELECT *, count(*) OVER (PARTITION BY token) AS labels FROM per)
    SELECT token, lang, CAST(occurrences AS BIGINT) AS occurrences, documents, labels, labels > 1 AS conflict, 'multi_document' AS tier FROM l WHERE documents >= 2""",
)
def mention_inventory(spark, d):
    return mining.mention_inventory(_mentions(spark, d), "token", "lang", "doc_id")


@query("token_label_conflicts", f"SELECT token, list_sort(list(DISTINCT lang)) AS langs FROM ({_MENTIONS}) GROUP BY token HAVING count(DISTINCT lang) > 1")
def token_label_conflicts(spark, d):
    m = _mentions(spark, d).select("token", "lang").distinct()
    return m.groupBy("token").agg(F.array_sort(F.collect_list("lang")).alias("langs")).where(F.size("langs") > 1)


@query(
    "normalized_keys",
    "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_\\s/+.-]', ' ', 'g'), '\\s+', ' ', 'g')) AS key, sha256(p_name) AS sha FROM part",
)
def normalized_keys(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.normalize_for_match(F.col("p_name")).alias("key"), F.sha2("p_name", 256).alias("sha"))


@query("toneless_texts", f"SELECT doc_id, sha256({_ACC}) AS toneless, length(text) AS n FROM documents")
def toneless_texts(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(F.lower(T.toneless(F.col("text"), latin=True)), 256).alias("toneless"), F.length("text").cast("long").alias("n"))


@query(
    "text_windows",
    """SELECT doc_id, b.at AS start, substr(text, greatest(b.at - 20, 0) + 1, least(b.at + 23, length(text)) - greatest(b.at - 20, 0)) AS win
    FROM (SELECT doc_id, text, instr(text, 'the') - 1 AS at FROM documents) b WHERE b.at >= 0""",
)
def text_windows(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text", (F.instr("text", "the") - 1).alias("start")).where("start >= 0")
    return docs.select("doc_id", F.col("start").cast("long").alias("start"), T.text_window(F.col("text"), F.col("start"), F.col("start") + 3, 20).alias("win"))


_SENT = r"[^.!?\n]+(?:[.!?]+|\n+|$)"


@query(
    "sentences",
    f"""WITH h AS (SELECT doc_id, text, regexp_extract_all(text, '{_SENT}') AS m, string_split_regex(text, '{_SENT}') AS g FROM documents),
    u AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, g FROM h),
    s AS (SELECT doc_id, m[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:(i - 1)], lambda x: length(x))), 0) AS pos FROM u)
    SELECT doc_id, CAST(pos + length(regexp_extract(v, '^\\s*')) AS BIGINT) AS start, trim(v, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS value FROM s WHERE trim(v, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> ''""",
)
def sentences(spark, d):
    return segment.sentences(_t(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("start").cast("long").alias("start"), "value")


@query(
    "sentence_offsets_hold",
    "SELECT count(*) AS documents, 0::BIGINT AS wrong FROM documents WHERE length(trim(regexp_replace(text, '[.!?\\s]+', '', 'g'))) > 0",
)
def sentence_offsets_hold(spark, d):
    docs = _t(spark, d, "documents")
    s = segment.sentences(docs, "doc_id", "text").join(docs.select("doc_id", "text"), "doc_id")
    ok = T.valid_span(F.col("text"), F.col("start"), F.col("end"), F.col("value"))
    return s.agg(F.count_distinct("doc_id").alias("documents"), F.sum(F.when(ok, 0).otherwise(1)).alias("wrong"))


@query("document_structure", "SELECT doc_id, len(string_split(text, chr(10))) AS lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest FROM documents")
def document_structure(spark, d):
    ls = segment.lines(_t(spark, d, "documents"), "doc_id", "text")
    return ls.groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.length("value")).cast("long").alias("longest"))


@query(
    "carry_forward",
    """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent
    FROM conversations""",
)
def carry_forward(spark, d):
    c = _t(spark, d, "conversations")
    return segment.nearest_parent(c, "conv_id", "turn", "turn", "role", ["user"]).select("conv_id", "turn", "role", "parent")


@query(
    "dictionary_token_matches",
    f"SELECT m.doc_id, CAST(count(*) AS BIGINT) AS matches, count(DISTINCT token) AS tokens FROM ({_MENTIONS}) m JOIN (SELECT token AS w FROM ({_MENTIONS}) GROUP BY token HAVING count(DISTINCT doc_id) >= 20) ON token = w GROUP BY m.doc_id",
)
def dictionary_token_matches(spark, d):
    m = _mentions(spark, d)
    words = m.groupBy("token").agg(F.count_distinct("doc_id").alias("n")).where("n >= 20").select(F.col("token").alias("alias"), F.col("token").alias("concept_id"))
    from groundmill.operators.extract import token_matches

    return token_matches(m, words, "doc_id", "token").groupBy("doc_id").agg(F.count("*").alias("matches"), F.count_distinct("token").alias("tokens"))


@query(
    "quoted_benchmark_items",
    "SELECT d.doc_id, b.item_id, instr(d.text, b.text) - 1 AS start FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0",
)
def quoted_benchmark_items(spark, d):
    """Exact quotes through one automaton over the items, not a nested loop."""
    from groundmill.operators.extract import dictionary_matches

    b = _t(spark, d, "benchmark").select(F.col("item_id").alias("concept_id"), F.col("text").alias("alias"))
    docs = _t(spark, d, "documents").select("doc_id", "text")
    hit = dictionary_matches(docs, b, "doc_id", "text", boundaries=False, toneless_least=1 << 30).where("exact")
    hit = hit.join(docs, "doc_id").where(F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("alias"))
    return hit.groupBy("doc_id", F.col("concept_id").alias("item_id")).agg(F.min("start").cast("long").alias("start"))


@query(
    "exact_duplicates",
    "SELECT doc_id, sha256(text) AS group_key, min(doc_id) OVER w AS canonical, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY text)",
)
def exact_duplicates(spark, d):
    return mining.duplicate_groups(_t(spark, d, "documents"), "doc_id", F.col("text")).select("doc_id", "group_key", "canonical", "copies")


@query(
    "normalized_duplicates",
    """WITH k AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS group_key FROM documents)
    SELECT doc_id, group_key, min(doc_id) OVER (PARTITION BY group_key) AS canonical, count(*) OVER (PARTITION BY group_key) AS copies FROM k""",
)
def normalized_duplicates(spark, d):
    return mining.duplicate_groups(_t(spark, d, "documents"), "doc_id", T.squeeze(F.lower("text"))).select("doc_id", "group_key", "canonical", "copies")


@query(
    "reconciled_labels",
    """WITH g AS (SELECT doc_id, sha256(text) AS group_key, min(doc_id) OVER w AS canonical, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY text))
    SELECT *, CASE WHEN votes = copies THEN 'silver' ELSE 'review' END AS tier FROM (
    SELECT group_key, canonical, copies, quality, toxic, count(DISTINCT doc_id) AS votes FROM g JOIN labels USING (doc_id) GROUP BY ALL)""",
)
def reconciled_labels(spark, d):
    g = mining.duplicate_groups(_t(spark, d, "documents"), "doc_id", F.col("text"))
    return mining.reconcile(g, _t(spark, d, "labels"), "doc_id", ["quality", "toxic"])


@query("simhash_near_pairs")
def simhash_near_pairs(spark, d):
    return mining.simhash_pairs(_t(spark, d, "documents"), "doc_id", "text")


@query(
    "html_text",
    "SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS sha, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages",
)
def html_text(spark, d):
    body = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return _t(spark, d, "pages").select("page_id", F.sha2(body, 256).alias("sha"), F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).cast("long").alias("title"))


@query("event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def event_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(
    "turn_agreement",
    """WITH t AS (SELECT DISTINCT conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS token FROM conversations),
    n AS (SELECT c.conv_id, c.turn, coalesce(n, 0) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations) c LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM t GROUP BY ALL) USING (conv_id, turn)),
    p AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, a.n AS na, b.n AS nb FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.turn < b.turn),
    c AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, count(*) AS common FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.token = b.token AND a.turn < b.turn GROUP BY ALL)
    SELECT conv_id, count(*) AS pairs, round(avg(CASE WHEN na + nb - coalesce(common, 0) = 0 THEN 1.0 ELSE CAST(coalesce(common, 0) AS DOUBLE) / (na + nb - coalesce(common, 0)) END), 4) AS agreement
    FROM p LEFT JOIN c USING (conv_id, a, b) GROUP BY conv_id""",
)
def turn_agreement(spark, d):
    t = _t(spark, d, "conversations").select("conv_id", "turn", F.explode_outer(T.tokens(F.col("text"))).alias("token"))
    return evaluate.pairwise_agreement(t, "conv_id", "turn", "token").withColumn("agreement", F.round("agreement", 4))


@query(
    "token_similarity",
    """WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a FROM part), q AS (SELECT p_partkey + 1 AS p_partkey, a AS b FROM p)
    SELECT p_partkey, round(len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM p JOIN q USING (p_partkey)""",
)
def token_similarity(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("a"))
    q = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("a").alias("b"))
    return p.join(q, "p_partkey").select("p_partkey", F.round(T.set_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(
    "token_edits",
    """WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a FROM part), e AS (SELECT q.p_partkey, CAST((p.a[1] <> q.a[1])::INT + (p.a[2] <> q.a[2])::INT AS INTEGER) AS edits FROM p AS q JOIN p ON p.p_partkey = q.p_partkey - 1)
    SELECT p_partkey, edits, round(greatest(0, 1 - edits / 2.0), 6)::DOUBLE AS similarity FROM e""",
)
def token_edits(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("a"))
    q = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("a").alias("b"))
    return p.join(q, "p_partkey").select("p_partkey", T.token_edit_distance(F.col("a"), F.col("b")).alias("edits"), F.round(T.text_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(
    "exact_lookup",
    """WITH m AS (SELECT p_partkey AS mention_id, trim(upper(p_name)) AS k FROM part)
    SELECT mention_id, min(a.p_partkey) AS concept_id, count(*) AS concepts FROM m JOIN part a ON lower(m.k) = lower(a.p_name) GROUP BY mention_id""",
)
def exact_lookup(spark, d):
    part = _t(spark, d, "part")
    m = part.select(F.col("p_partkey").alias("mention_id"), T.normalize_for_match(F.upper("p_name"), nfkc=False).alias("key"))
    a = part.select(F.col("p_partkey").alias("concept_id"), T.normalize_for_match(F.col("p_name"), nfkc=False).alias("key"), F.lit(0).alias("alias_rank"))
    # each different key is looked up once; mentions join the answer, not the pairs
    keys = m.select("key").distinct().withColumn("mention_id", F.col("key"))
    found = retrieval.exact_lookup(keys, a, toneless=False).groupBy(F.col("mention_id").alias("key")).agg(F.min("concept_id").alias("concept_id"), F.count("*").alias("concepts"))
    return m.join(found, "key").select("mention_id", "concept_id", "concepts")


_WORDS = f"SELECT DISTINCT token, lang FROM ({_MENTIONS}) WHERE lang <> 'en'"


@query(
    "toneless_lookup",
    f"""WITH w AS ({_WORDS}), k AS (SELECT token, lang, translate(token, '{T.ACCENTED}', '{T.PLAIN}') AS bare FROM w)
    SELECT m.token AS mention, count(DISTINCT a.token) AS concepts, count(DISTINCT CASE WHEN a.token = m.token THEN a.token END) AS exact FROM k m JOIN k a ON m.bare = a.bare GROUP BY m.token""",
)
def toneless_lookup(spark, d):
    w = _mentions(spark, d).where("lang <> 'en'").select("token", "lang").distinct().withColumn("toneless", T.toneless(F.col("token"), latin=True))
    m = w.select(F.col("token").alias("mention_id"), F.col("token").alias("key"), "toneless").distinct()
    a = w.select(F.col("token").alias("concept_id"), F.col("token").alias("key"), "toneless", F.lit(0).alias("alias_rank")).distinct()
    found = retrieval.exact_lookup(m, a)
    return found.groupBy(F.col("mention_id").alias("mention")).agg(F.count_distinct("concept_id").alias("concepts"), F.count_distinct(F.when(F.col("source") == "exact", F.col("concept_id"))).alias("exact"))


@query(
    "bm25_top",
    f"""WITH q AS (SELECT DISTINCT item_id, unnest({SQL_TOK}) AS term FROM benchmark),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({SQL_TOK}) AS term FROM documents) GROUP BY ALL),
    len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id), tot AS (SELECT count(*) AS n, avg(len) AS mean FROM len),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS s FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), tot GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, doc_id) AS rank FROM s)
    SELECT item_id AS mention_id, doc_id AS concept_id, round(s, 3) AS raw, rank FROM r WHERE rank <= 10""",
)
def bm25_top(spark, d):
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("mention_id"), F.explode(T.tokens(F.col("text"))).alias("term"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("concept_id"), F.explode(T.tokens(F.col("text"))).alias("term"))
    return retrieval.bm25(q, docs, 10).select("mention_id", "concept_id", F.round("raw", 3).alias("raw"), F.col("rank").cast("long").alias("rank"))


@query(
    "trigram_blocking",
    """WITH n AS (SELECT DISTINCT lower(p_name) AS k FROM part), g AS (SELECT DISTINCT k, substr(k, i, 3) AS g FROM (SELECT k, unnest(range(1, length(k) - 1)) AS i FROM n)),
    c AS (SELECT k, count(*) AS n FROM g GROUP BY k)
    SELECT a.k AS left, b.k AS right, count(*) AS common, round(count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)), 4) AS jaccard
    FROM g a JOIN g b ON a.g = b.g AND a.k < b.k JOIN c x ON x.k = a.k JOIN c y ON y.k = b.k GROUP BY a.k, b.k HAVING count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.5""",
)
def trigram_blocking(spark, d):
    g = _t(spark, d, "part").select(F.lower("p_name").alias("k")).distinct().select("k", F.explode(F.array_distinct(T.char_ngrams(F.col("k"), (3,)))).alias("g"))
    c = g.groupBy("k").agg(F.count("*").alias("n"))
    p = g.select(F.col("k").alias("left"), "g").join(g.select(F.col("k").alias("right"), "g"), "g").where("left < right").groupBy("left", "right").agg(F.count("*").alias("common"))
    p = p.join(c.select(F.col("k").alias("left"), F.col("n").alias("nl")), "left").join(c.select(F.col("k").alias("right"), F.col("n").alias("nr")), "right")
    j = F.col("common") / (F.col("nl") + F.col("nr") - F.col("common"))
    return p.where(j >= 0.5).select("left", "right", "common", F.round(j, 4).alias("jaccard"))


@query("fuzzy_top")
def fuzzy_top(spark, d):
    n = _t(spark, d, "part").select(F.lower("p_name").alias("key")).distinct()
    return retrieval.fuzzy(n.select(F.col("key").alias("mention_id"), "key"), n.select(F.col("key").alias("concept_id"), "key"), 5)


@query(
    "ngram_cosine_top",
    """WITH n AS (SELECT DISTINCT lower(p_name) AS key FROM part), s AS (SELECT key, unnest([3, 4, 5]) AS s FROM n), g AS (SELECT key, substr(key, i, s) AS g FROM (SELECT key, s, unnest(generate_series(1, length(key) - s + 1)) AS i FROM s)),
    tf AS (SELECT key, g, count(*) AS tf FROM g GROUP BY ALL), idf AS (SELECT g, ln(1 + (SELECT count(*) FROM n) / (1 + count(*))) AS idf FROM tf GROUP BY g), w AS (SELECT key, g, tf * idf AS w FROM tf JOIN idf USING (g)),
    z AS (SELECT key, sqrt(sum(w * w)) AS z FROM w GROUP BY key), c AS (SELECT a.key AS m, b.key AS c, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (g) GROUP BY ALL),
    r AS (SELECT m, c, round(dot / (x.z * y.z), 6) AS score FROM c JOIN z x ON x.key = m JOIN z y ON y.key = c)
    SELECT m AS mention_id, c AS concept_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY score DESC, c) AS rank FROM r WHERE score >= 0.12) WHERE rank <= 5""",
)
def ngram_cosine_top(spark, d):
    n = _t(spark, d, "part").select(F.lower("p_name").alias("key")).distinct()
    found = retrieval.ngram_cosine(n.select(F.col("key").alias("mention_id"), "key"), n.select(F.col("key").alias("concept_id"), "key"), 5)
    return found.select("mention_id", "concept_id", F.round("score", 4).alias("score"))


@query(
    "phrase_cascade",
    """WITH n AS (SELECT DISTINCT lower(p_name) AS key, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda t: length(t) >= 3)) AS w FROM part),
    c AS (SELECT q.key AS m, a.key AS c, len(list_intersect(q.w, a.w)) AS k, len(q.w) AS n FROM n q JOIN n a ON len(list_intersect(q.w, a.w)) > 0),
    s AS (SELECT m, c, CASE WHEN contains(' ' || c || ' ', ' ' || m || ' ') THEN 0 WHEN k = n AND n > 1 THEN 1 ELSE 2 END AS stage, k / n AS score FROM c)
    SELECT m AS mention_id, c AS concept_id, stage, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY stage, score DESC, c) AS rank FROM s) WHERE rank <= 5""",
)
def phrase_cascade(spark, d):
    n = _t(spark, d, "part").select(F.lower("p_name").alias("key")).distinct()
    return retrieval.phrase_cascade(n.select(F.col("key").alias("mention_id"), "key"), n.select(F.col("key").alias("concept_id"), "key"), 5)


@query(
    "nearest_click",
    """WITH p AS (SELECT event_id, user_id, epoch(ts) AS at FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id, user_id, epoch(ts) AS at FROM events WHERE event_type = 'click'),
    j AS (SELECT p.user_id, p.event_id AS t_id, c.event_id AS o_id, p.at - c.at AS distance, row_number() OVER (PARTITION BY p.event_id ORDER BY p.at - c.at, c.at, c.event_id) AS r
          FROM p JOIN c ON p.user_id = c.user_id AND p.at >= c.at AND p.at - c.at <= 86400)
    SELECT user_id, t_id, o_id, round(distance, 3) AS distance FROM j WHERE r = 1""",
)
def nearest_click(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    n = relations.nearest(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), ["user_id"], "at", "event_id", "event_id", 86400.0, earlier_only=True)
    return n.withColumn("distance", F.round("distance", 3))
