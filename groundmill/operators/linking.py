"""From ranked candidates to assigned codes: qualification, assignment, memories and list ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def qualify(ranked: DataFrame, threshold: float = 0.5, margin: float = 0.25, most: int = 5) -> DataFrame:
    """``ranked`` (mention_id, code, score, rank) with ``reason``: the first rule that a candidate fails, or ``qualified``."""
    top = F.max("score").over(W.partitionBy("mention_id"))
    first = F.when(F.col("code").isNull(), "missing_code").when(F.col("score") < threshold, "below_absolute_threshold").when(F.col("score") < F.col("top") * (1 - margin), "outside_relative_margin")
    df = ranked.withColumn("top", top).withColumn("first", first)
    so_far = F.sum(F.when(F.col("first").isNull(), 1).otherwise(0)).over(W.partitionBy("mention_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("n", so_far).withColumn("reason", F.coalesce("first", F.when(F.col("n") > most, "beyond_max_candidates"), F.lit("qualified"))).drop("top", "first", "n")


def assign(qualified: DataFrame, threshold: float = 0.75, margin: float = 0.05) -> DataFrame:
    """The first candidate of each mention, assigned if it is qualified, high enough and clear of the second."""
    second = F.lead("score").over(W.partitionBy("mention_id").orderBy("rank"))
    top = qualified.withColumn("second", second).where("rank = 1")
    clear = F.round(F.col("score") - F.coalesce("second", F.lit(0.0)), 9) >= margin
    return top.withColumn("assigned", (F.col("reason") == "qualified") & (F.col("score") >= threshold) & clear).drop("second")


def code_memory(observed: DataFrame, keys: list[str], code: str, doc: str) -> DataFrame:
    """Per key: observations, documents, different codes, entropy (bits) of the codes, the top code and its share."""
    per = observed.groupBy(*keys, code).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys))
    per = per.withColumn("p", F.col("n") / total)
    g = per.groupBy(*keys).agg(
        F.sum("n").alias("observations"), F.count("*").alias("codes"), F.sum(-F.col("p") * F.log2("p")).alias("entropy"),
        F.max_by(code, F.struct("n", F.col(code))).alias("top_code"), F.max("p").alias("top_probability"),
    )
    docs = observed.groupBy(*keys).agg(F.count_distinct(doc).alias("documents"))
    return g.join(docs, keys)


def cross_fitted_memory(observed: DataFrame, keys: list[str], code: str, fold: str, folds: int) -> DataFrame:
    """For each fold the top code of each key over all other folds: (held, key, code, n, share).

    Counts per fold are aggregated once; a held-out fold's counts are the total's less its own.
    """
    per = observed.groupBy(*keys, code, fold).agg(F.count("*").alias("own"))
    every = per.groupBy(*keys, code).agg(F.sum("own").alias("n"))
    held = every.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rest = held.join(per.withColumnRenamed(fold, "held"), [*keys, code, "held"], "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).where("n > 0")
    return rest.groupBy("held", *keys).agg(F.max_by(code, F.struct("n", F.col(code))).alias("top_code"), F.max("n").alias("n"), (F.max("n") / F.sum("n")).alias("share"))


def memory_score(memory: DataFrame) -> DataFrame:
    """Terminal if two documents or more agree at 0.95; otherwise half the probability counts."""
    sure = (F.col("documents") >= 2) & (F.col("top_probability") >= 0.95)
    return memory.withColumn("terminal", sure).withColumn("score", F.when(sure, F.col("top_probability")).otherwise(F.col("top_probability") / 2))


def listwise(orders: DataFrame) -> DataFrame:
    """Aggregate ranked lists (query_id, candidates array; null: an abstention): sums of 1 - position / n.

    One row per query and candidate with its mean score, rank, whether the query abstains (abstentions
    are half of the orders or more) and how often the winner came first.
    """
    n = orders.groupBy("query_id").agg(F.count("*").alias("orders"), F.sum(F.when(F.col("candidates").isNull() | (F.size("candidates") == 0), 1).otherwise(0)).alias("abstained"))
    at = orders.where("size(candidates) > 0").select("query_id", F.size("candidates").alias("n"), F.posexplode("candidates").alias("pos", "candidate"))
    s = at.groupBy("query_id", "candidate").agg(F.sum(1 - F.col("pos") / F.col("n")).alias("total"), F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("firsts"))
    s = s.join(n, "query_id").withColumn("score", F.round(F.col("total") / (F.col("orders") - F.col("abstained")), 6))
    s = s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "candidate")))
    return s.select("query_id", "candidate", "score", "rank", (2 * F.col("abstained") >= F.col("orders") + 1).alias("abstain"), (F.col("firsts") / (F.col("orders") - F.col("abstained"))).alias("first_share"))


def seeded_order(rows: DataFrame, seed: str, by: str, item: str) -> DataFrame:
    """A reproducible shuffle within each group: the order of the hash of seed, group and item."""
    key = F.sha2(F.concat_ws("\0", F.lit(seed), F.col(by).cast("string"), F.col(item).cast("string")), 256)
    return rows.withColumn("position", F.row_number().over(W.partitionBy(by).orderBy(key, item)))


def graph_evidence(candidates: DataFrame, context: DataFrame, edges: DataFrame, most: float = 0.04, support: int = 2, saturation: int = 10) -> DataFrame:
    """Bonus for candidates (mention_id, code) with edges to codes of their context (mention_id, context_code).

    A match's strength is min(1, log1p(support) / log1p(saturation)) x confidence; the bonus is
    most x (1 - product of 1 - strength).
    """
    e = edges.where(F.col("support") >= support).select("head", "tail", "support", "confidence")
    both = e.unionByName(e.select(F.col("tail").alias("head"), F.col("head").alias("tail"), "support", "confidence"))
    hit = candidates.join(context, "mention_id").join(both, (F.col("code") == F.col("head")) & (F.col("context_code") == F.col("tail")))
    strength = F.least(F.lit(1.0), F.log1p("support") / F.log1p(F.lit(float(saturation)))) * F.col("confidence")
    best = hit.groupBy("mention_id", "code", "context_code").agg(F.max(strength).alias("s"))
    lost = F.exp(F.sum(F.log(F.greatest(1 - F.col("s"), F.lit(1e-12)))))
    return best.groupBy("mention_id", "code").agg(F.round(most * (1 - lost), 6).alias("bonus"))


def expected_jaccard(p: list[float]) -> list[float]:
    """Expected Jaccard of each prefix of candidates that are right independently with probabilities ``p``.

    Outside a prefix the number of missed ones follows a Poisson-binomial distribution.
    """
    tails = [np.array([1.0])]
    for x in reversed(p):
        tails.append(np.convolve(tails[-1], [1 - x, x]))
    tails = tails[::-1]
    out, head = [], np.array([1.0])
    for k in range(1, len(p) + 1):
        head = np.convolve(head, [1 - p[k - 1], p[k - 1]])
        miss = tails[k]
        out.append(float(sum(head[i] * miss[j] * i / (k + j) for i in range(len(head)) for j in range(len(miss)))))
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def expected_jaccard_prefix(p: pd.Series) -> pd.Series:
    """``expected_jaccard`` over arrays of probabilities."""
    return p.map(lambda x: expected_jaccard([float(v) for v in x]) if x is not None else None)


def emission(candidates: DataFrame, p_none: float = 0.0, most: int = 5) -> DataFrame:
    """The prefix of each mention's ranked candidates that maximises expected Jaccard, empty if none beats ``p_none``."""
    g = candidates.groupBy("mention_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "code"))), 1, most).alias("c"))
    g = g.withColumn("e", expected_jaccard_prefix(F.transform("c", lambda x: -x["minus"])))
    best = F.array_max("e")
    return g.select("mention_id", F.when(best > p_none, F.transform(F.slice("c", F.lit(1), F.array_position("e", best).cast("int")), lambda x: x["code"])).otherwise(F.array().cast("array<string>")).alias("codes"), F.round(best, 6).alias("expected"))


def clamp(x: Column) -> Column:
    """Into [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def heuristic_rerank(candidates: DataFrame) -> DataFrame:
    """Adjusted scores of drug candidates from boolean columns of what mention and concept share.

    A clash of product strengths leaves a tenth and ends it; other adjustments follow in a fixed order.
    """
    s = F.col("score")
    s = s * F.when(F.col("strength_role") == "ambiguous", 0.7).when(F.col("strength_role") == "administered", 0.85).otherwise(1.0)
    s = s - F.when(F.col("structured_product"), 0.24).otherwise(0.0) - F.when(F.col("ingredient_only"), 0.08).otherwise(0.0) - F.when(F.col("form_clash"), 0.12).otherwise(0.0)
    s = s + F.when(F.col("ingredient_in_mention"), 0.06).otherwise(0.0) + F.when(F.col("brand_in_mention"), 0.04).otherwise(0.0) + F.least(F.lit(0.04), 0.04 * F.col("context_overlap"))
    s = F.when(F.col("strength_disjoint"), F.col("score") * 0.1).otherwise(s)
    out = candidates.withColumn("reranked", F.round(clamp(s), 6))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("mention_id").orderBy(F.desc("reranked"), "code")))


def second_pass(candidates: DataFrame, assigned: DataFrame, edges: DataFrame, most: float = 0.04, support: int = 2, saturation: int = 10) -> DataFrame:
    """``candidates`` (doc, mention_id, code, score) ranked anew by what the document's other mentions were assigned.

    ``assigned``: doc, mention_id, code of the first pass.  Each mention's context are the codes assigned to others of its
    document; identities never change, only scores and ranks.
    """
    context = candidates.select("doc", "mention_id").distinct().join(assigned.select("doc", F.col("mention_id").alias("_other"), F.col("code").alias("context_code")), "doc")
    context = context.where("_other <> mention_id").select("mention_id", "context_code").distinct()
    bonus = graph_evidence(candidates.select("mention_id", "code").distinct(), context, edges, most, support, saturation)
    held = candidates.join(bonus, ["mention_id", "code"], "left").withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + F.coalesce("bonus", F.lit(0.0))), 6)).drop("bonus")
    return held.withColumn("rank", F.row_number().over(W.partitionBy("mention_id").orderBy(F.desc("score"), "code")))


def generate_candidates(mentions: DataFrame, retrievers: list, rerank=None, limit: int = 20, threshold: float = 0.5, margin: float = 0.25) -> DataFrame:
    """Retrievers in turn, fused, reranked and qualified: (mention_id, code, score, rank, reason).

    A retriever is a function of mentions to (mention_id, code, source, score); ``rerank`` of candidates to candidates.
    """
    from groundmill.operators import retrieval

    found = retrievers[0](mentions)
    for r in retrievers[1:]:
        found = found.unionByName(r(mentions))
    fused = retrieval.fuse(found)
    fused = rerank(fused) if rerank else fused
    return qualify(retrieval.top_k(fused, limit, order=[F.desc("score"), F.asc("code")]), threshold, margin)
