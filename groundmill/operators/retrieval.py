"""Mention to concept retrieval as joins: exact, toneless, abbreviation, n-gram, BM25, fuzzy and dense, then fusion.

Tables: mentions (mention_id, key[, toneless]), aliases (concept_id, key, toneless, alias_rank,
semantic_type, code_system, code).  Each retriever returns (mention_id, concept_id, score) ranked by a
total order, so nothing depends on partitioning.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmill.functions.text import char_ngrams, sequence_ratio, set_jaccard

#: Alias rows up to this many are broadcast to exact lookups; more are joined by a shuffle.
BROADCAST_ALIASES = 2_000_000
#: Code systems that each semantic type may be linked to (fixed values).
TYPE_SYSTEMS = {
    "DRUG": ["RXNORM"], "DISEASE": ["ICD10", "MONDO", "UMLS", "SNOMED"], "SYMPTOM": ["HPO", "UMLS", "SNOMED", "LOCAL"],
    "FINDING": ["HPO", "UMLS", "SNOMED", "LOCAL"], "LAB_TEST": ["LOCAL"],
}
#: Rank of an alias's source; any other ranks 2 (fixed values).
ALIAS_RANK = {"canonical": 0, "official_vi": 1, "official_en": 1, "alias": 2, "synonym": 2, "abbreviation": 2, "generic": 3, "brand": 3, "ingredient": 4}
#: Weight of a retriever in fusion; any other weighs 0 (fixed values).
SOURCE_WEIGHT = {
    "mention_memory": 1.0, "mention_memory_prior": 0.84, "exact": 1.0, "toneless": 0.92, "abbreviation": 0.92, "learned_edit": 0.88,
    "fuzzy": 0.72, "char_ngram": 0.62, "dense": 0.58, "bm25": 0.5,
}


def lookup(values: dict, key: Column, default=None) -> Column:
    """A small fixed mapping as an expression."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def top_k(df: DataFrame, k: int, by: str = "mention_id", order: list[Column] | None = None) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``."""
    order = order or [F.desc("score"), F.asc("concept_id")]
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def allowed(rows: DataFrame, type_col: str = "semantic_type", system_col: str = "code_system", systems: dict[str, list[str]] = TYPE_SYSTEMS) -> DataFrame:
    """Rows whose code system suits their type."""
    ok = F.lit(False)
    for kind, names in systems.items():
        ok = ok | ((F.col(type_col) == kind) & F.col(system_col).isin(names))
    return rows.where(ok)


def _small(df: DataFrame, rows: int | None) -> DataFrame:
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ALIASES else df


def exact_lookup(mentions: DataFrame, aliases: DataFrame, alias_rows: int | None = None, toneless: bool = True) -> DataFrame:
    """Exact key 1.0; then, for concepts not found so, equal toneless key 0.92."""
    exact = mentions.join(_small(aliases.select("concept_id", "key", "alias_rank"), alias_rows), "key").groupBy("mention_id", "concept_id").agg(F.min("alias_rank").alias("alias_rank"))
    out = exact.select("mention_id", "concept_id", F.lit(1.0).alias("score"), F.lit("exact").alias("source"), "alias_rank")
    if toneless:
        bare = mentions.join(_small(aliases.select("concept_id", "toneless", "alias_rank"), alias_rows), "toneless").groupBy("mention_id", "concept_id").agg(F.min("alias_rank").alias("alias_rank"))
        more = bare.join(exact.select("mention_id", "concept_id"), ["mention_id", "concept_id"], "left_anti")
        out = out.unionByName(more.select("mention_id", "concept_id", F.lit(0.92).alias("score"), F.lit("toneless").alias("source"), "alias_rank"))
    return out


def abbreviation_lookup(mentions: DataFrame, abbreviations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mention to expansions to exact aliases, 0.9."""
    found = mentions.select("mention_id", "key").join(abbreviations.select(F.col("abbreviation").alias("key"), F.explode("expansions").alias("expansion")), "key")
    return found.join(aliases.select("concept_id", F.col("key").alias("expansion")), "expansion").select("mention_id", "concept_id").distinct().withColumn("score", F.lit(0.9)).withColumn("source", F.lit("abbreviation"))


def phrase_cascade(mentions: DataFrame, aliases: DataFrame, k: int) -> DataFrame:
    """Phrase, then all tokens, then any token, filled up to ``k``: (mention_id, concept_id, stage, score, rank).

    Candidates come from an inverted index of tokens with three characters or more; all stages are read
    off one join by how many tokens match and whether the phrase does.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda t: F.length(t) >= 3))
    q = mentions.select("mention_id", F.col("key").alias("q"), words(F.col("key")).alias("words")).withColumn("n", F.size("words"))
    a = aliases.select("concept_id", "key").distinct()
    posted = a.select("concept_id", "key", F.explode(words(F.col("key"))).alias("word"))
    hit = q.select("mention_id", "q", "n", F.explode("words").alias("word")).join(posted, "word").groupBy("mention_id", "q", "n", "concept_id", "key").agg(F.count("*").alias("m"))
    stage = F.when(F.contains(F.concat(F.lit(" "), F.col("key"), F.lit(" ")), F.concat(F.lit(" "), F.col("q"), F.lit(" "))), 0).when((F.col("m") == F.col("n")) & (F.col("n") > 1), 1).otherwise(2)
    best = hit.select("mention_id", "concept_id", stage.alias("stage"), (F.col("m") / F.col("n")).alias("score")).groupBy("mention_id", "concept_id").agg(F.min(F.struct("stage", (-F.col("score")).alias("minus"))).alias("b"))
    best = best.select("mention_id", "concept_id", "b.stage", (-F.col("b.minus")).alias("score"))
    return top_k(best, k, order=[F.asc("stage"), F.desc("score"), F.asc("concept_id")])


#: Distinct query terms up to this many are broadcast.
BROADCAST_TERMS = 500_000


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over distinct query terms: queries (mention_id, term), docs (concept_id, term), one row per token.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); the calibrated score is s / (s + 4 x the query's terms).
    Tokens are filtered to query terms before anything is shuffled (the terms are counted, and broadcast only up to
    BROADCAST_TERMS), so only what can score moves; a text's length is one sum over its rows.
    """
    q = queries.select("mention_id", "term").distinct()
    n_terms = q.groupBy("mention_id").agg(F.count("*").alias("terms"))
    lens = docs.groupBy("concept_id").agg(F.count("*").alias("len"))
    total = lens.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    wanted = q.select("term").distinct()
    post = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted, "term", "left_semi").groupBy("concept_id", "term").agg(F.count("*").alias("tf"))
    df_ = post.groupBy("term").agg(F.count("*").alias("df"))
    weighed = post.join(df_, "term").join(lens, "concept_id").crossJoin(F.broadcast(total))  # one row of totals
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = weighed.select("term", "concept_id", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))).alias("w"))
    s = q.join(weighed, "term").groupBy("mention_id", "concept_id").agg(F.sum("w").alias("s")).join(n_terms, "mention_id")
    s = s.select("mention_id", "concept_id", F.round("s", 6).alias("raw"), F.round(F.col("s") / (F.col("s") + 4 * F.col("terms")), 6).alias("score"))
    return top_k(s, k, order=[F.desc("raw"), F.asc("concept_id")])


def ngram_cosine(queries: DataFrame, docs: DataFrame, k: int, sizes: tuple[int, ...] = (3, 4, 5), least: float = 0.12) -> DataFrame:
    """TF-IDF cosine of character n-grams: queries (mention_id, key), docs (concept_id, key)."""
    grams = docs.select("concept_id", F.explode(char_ngrams(F.col("key"), sizes)).alias("g")).groupBy("concept_id", "g").agg(F.count("*").alias("tf"))
    n = docs.select("concept_id").distinct().agg(F.count("*").alias("n"))
    df_ = grams.groupBy("g").agg(F.count("*").alias("df"))
    idf = df_.crossJoin(F.broadcast(n)).select("g", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"), "n")
    d = grams.join(idf, "g").select("concept_id", "g", (F.col("tf") * F.col("idf")).alias("w"))
    dn = d.groupBy("concept_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    qg = queries.select("mention_id", F.explode(char_ngrams(F.col("key"), sizes)).alias("g")).groupBy("mention_id", "g").agg(F.count("*").alias("tf"))
    q = qg.join(idf, "g").select("mention_id", "g", (F.col("tf") * F.col("idf")).alias("qw"))
    qn = q.groupBy("mention_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dot = q.join(d, "g").groupBy("mention_id", "concept_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    s = dot.join(dn, "concept_id").join(qn, "mention_id").select("mention_id", "concept_id", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 6).alias("score"))
    return top_k(s.where(F.col("score") >= least), k)


def fuzzy(queries: DataFrame, docs: DataFrame, k: int, least: float = 0.72, shared: int = 1) -> DataFrame:
    """Trigram blocking, then the larger of sequence ratio and token Jaccard.

    Trigrams are those of the key between blanks, and one shared trigram is enough, so a key always meets itself.
    """
    padded = F.concat(F.lit(" "), F.trim("key"), F.lit(" "))
    g = lambda df, i: df.select(i, F.explode(F.array_distinct(char_ngrams(padded, (3,)))).alias("g"))
    near = g(queries, "mention_id").join(g(docs, "concept_id"), "g").groupBy("mention_id", "concept_id").agg(F.count("*").alias("m")).where(F.col("m") >= shared)
    near = near.join(queries.select("mention_id", F.col("key").alias("q")), "mention_id").join(docs.select("concept_id", "key"), "concept_id")
    score = F.greatest(sequence_ratio(F.col("q"), F.col("key")), set_jaccard(F.split("q", " "), F.split("key", " ")))
    near = near.select("mention_id", "concept_id", F.round(score, 6).alias("score")).where(F.col("score") >= least)
    return top_k(near.groupBy("mention_id", "concept_id").agg(F.max("score").alias("score")), k)


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


#: Query vectors of one pass.
QUERIES = 65_536


def dense(queries: DataFrame, vectors: DataFrame, k: int, by: list[str] | None = None, rows: int = 4096) -> DataFrame:
    """Cosine top-k of a query set against all vectors: queries (mention_id, v), vectors (concept_id, v), both with ``by``.

    Queries are a stated set, counted first: up to QUERIES are sent to each batch of vectors in blocks of ``rows``, more in
    several passes; a batch keeps its own best ``k`` per query, and a window merges these, so only k rows per batch and
    query move.
    """
    by = by or []
    passes = max(1, -(-queries.count() // QUERIES))
    if passes > 1:
        parts = [dense(queries.where(F.pmod(F.xxhash64("mention_id"), F.lit(passes)) == p), vectors, k, by, rows) for p in range(passes)]
        return reduce(DataFrame.unionByName, parts)
    sent = queries.select("mention_id", "v", *by).collect()
    qv = np.array([r["v"] for r in sent], np.float64).reshape(len(sent), -1)
    qv = qv / np.maximum(np.linalg.norm(qv, axis=1, keepdims=True), 1e-12) if len(sent) else qv
    ids = np.array([r["mention_id"] for r in sent], object)
    group = np.array(["\0".join(str(r[c]) for c in by) for r in sent], object)

    def run(batches):
        for b in batches:
            x = np.stack(b["v"].to_list()).astype(np.float64) if len(b) else np.zeros((0, 1))
            if not len(b) or not len(ids):
                continue
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            own = b[by].astype(str).agg("\0".join, axis=1).to_numpy() if by else np.full(len(b), "")
            out = []
            for lo in range(0, len(ids), rows):
                s = qv[lo : lo + rows] @ x.T
                if by:
                    s[group[lo : lo + rows, None] != own[None, :]] = -2
                keep = min(k, s.shape[1])
                at = np.argsort(-np.round(s, 6), axis=1, kind="stable")[:, :keep] if keep else np.zeros((len(s), 0), int)
                q = np.repeat(np.arange(len(s)), keep)
                out.append(pd.DataFrame({"mention_id": ids[lo : lo + rows][q], "concept_id": b["concept_id"].to_numpy()[at.ravel()], "score": np.round(s[q, at.ravel()], 6)}))
            got = pd.concat(out)
            yield got[got["score"] >= -1]

    kind = f"mention_id {queries.schema['mention_id'].dataType.simpleString()}, concept_id {vectors.schema['concept_id'].dataType.simpleString()}, score double"
    ordered = vectors.select("concept_id", "v", *by)
    return top_k(ordered.sortWithinPartitions("concept_id").mapInPandas(run, kind), k)


def fuse(candidates: DataFrame, rrf_k: int = 60, bonus: float = 0.1) -> DataFrame:
    """Rank fusion of (mention_id, code, source, score): one row per mention and code.

    Per source the best row of a code counts, at its rank among the source's rows.  With p the largest
    score and two sources or more, the result is min(1, p + (1 - p) x bonus x c), c the weighted
    reciprocal ranks over what first ranks everywhere would give.
    """
    w = SOURCE_WEIGHT
    best = candidates.groupBy("mention_id", "code", "source").agg(F.max("score").alias("score"))
    ranked = best.withColumn("r", F.row_number().over(W.partitionBy("mention_id", "source").orderBy(F.desc("score"), "code")))
    ranked = ranked.withColumn("w", F.coalesce(*[F.when(F.col("source") == s, F.lit(float(v))) for s, v in w.items()], F.lit(0.0)))
    g = ranked.groupBy("mention_id", "code").agg(
        F.max("score").alias("p"), F.count("*").alias("sources"), F.sum(F.col("w") * F.col("score") / (rrf_k + F.col("r"))).alias("a"), (F.sum("w") / (rrf_k + 1)).alias("b"),
        F.max_by("source", F.struct(F.round(F.col("w") * F.col("score"), 9), -F.col("r"), "source")).alias("primary"),
    )
    c = F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0)
    fused = F.when(F.col("sources") >= 2, F.least(F.lit(1.0), F.col("p") + (1 - F.col("p")) * bonus * c)).otherwise(F.col("p"))
    return g.select("mention_id", "code", "sources", "primary", F.round(fused, 6).alias("score"))


def short_circuit(candidates: DataFrame, terminal: list[str]) -> DataFrame:
    """Candidates of a mention up to its first terminal source that has any (sources tried in the order of ``stage``)."""
    stop = F.min(F.when(F.col("source").isin(terminal), F.col("stage"))).over(W.partitionBy("mention_id"))
    return candidates.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("stage") <= F.col("_stop"))).drop("_stop")


def unique_exact(candidates: DataFrame) -> DataFrame:
    """Mentions whose exact hits are all coded and share one code: further retrieval is not needed."""
    g = candidates.where("source = 'exact'").groupBy("mention_id").agg(F.count_distinct("code").alias("codes"), F.bool_and(F.col("code").isNotNull()).alias("coded"), F.min("code").alias("code"))
    return g.where("coded and codes = 1").select("mention_id", "code")
