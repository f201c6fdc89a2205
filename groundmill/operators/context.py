"""Assertion context of a span: cues left and right of it within its clause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statuses in order of precedence; PRESENT where no cue holds (fixed values).
PRECEDENCE = ["FAMILY", "NEGATED", "HISTORICAL", "PLANNED", "RESOLVED", "CONDITIONAL", "POSSIBLE"]


def cue_occurrences(clauses: DataFrame, cues: DataFrame, key: list[str], text: str) -> DataFrame:
    """Each cue's places in each clause: (key, rule_id, assertion, scope, priority, most, cue_start, cue_end).

    ``cues`` is a rule table (rule_id, cue, assertion, scope, priority, most); places are code points of the clause.
    """
    c = clauses.select(*key, F.lower(text).alias("_t")).join(F.broadcast(cues), F.contains(F.col("_t"), F.lower("cue")))  # a rule list, not data
    parts = F.split("_t", F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower("cue"), F.lit(r"\E(?![\p{L}\p{N}])")), -1)
    places = F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + F.length(x) + F.length("cue")).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(x)).alias("out")), lambda a: a["out"],
    )
    c = c.withColumn("cue_start", F.explode(places))
    return c.select(*key, "rule_id", "assertion", "scope", "priority", "most", "cue_start", (F.col("cue_start") + F.length("cue")).alias("cue_end"), F.length("cue").alias("cue_length"))


def classify(entities: DataFrame, clauses: DataFrame, cues: DataFrame, key: list[str], text: str) -> DataFrame:
    """``entities`` (key, id, start, end in the clause) with the assertion of their best cue.

    A cue left of an entity needs scope left or bidirectional, one right of it right or bidirectional;
    within its largest distance, by priority, distance, length and rule; statuses by precedence.
    """
    found = cue_occurrences(clauses, cues, key, text)
    e = entities.join(found, key)
    left, right = F.col("cue_end") <= F.col("start"), F.col("cue_start") >= F.col("end")
    gap = F.when(left, F.col("start") - F.col("cue_end")).when(right, F.col("cue_start") - F.col("end"))
    fits = (left & F.col("scope").isin("left", "bidirectional")) | (right & F.col("scope").isin("right", "bidirectional"))
    e = e.withColumn("gap", gap).where(fits & (F.col("gap") <= F.col("most")))
    w = W.partitionBy(*key, "id").orderBy(F.desc("priority"), "gap", F.desc("cue_length"), "rule_id")
    rank = F.array_position(F.array(*[F.lit(x) for x in PRECEDENCE]), F.col("assertion"))
    best = e.withColumn("_r", F.row_number().over(w)).groupBy(*key, "id").agg(F.min_by("assertion", F.struct("_r", rank)).alias("assertion"), F.min_by("rule_id", F.struct("_r", rank)).alias("rule_id"))
    return entities.join(best, [*key, "id"], "left").fillna("PRESENT", ["assertion"])


def window_cue(text: str, cue: str):
    """Whether a cue word stands in a text column, as a whole word."""
    return F.col(text).rlike(rf"(?i)(?<![\p{{L}}\p{{N}}]){cue}(?![\p{{L}}\p{{N}}])")
