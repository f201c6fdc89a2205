"""Range and nearest joins between spans of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Signs of a stretch of a document that spans are met in.
STRETCH = 512


def contained(inner: DataFrame, outer: DataFrame, key: list[str], name: str) -> DataFrame:
    """Each inner span with the first outer span that holds it; ``outer`` has start, end and ``name``.

    Documents are cut into stretches of STRETCH signs: an outer span stands in each that it touches, an inner one in that
    of its start, so the join is an equality and a long document makes no pairs of all its spans.
    """
    at = lambda c: F.floor(c / STRETCH).cast("long")
    o = outer.select(*key, F.col("start").alias("o_start"), F.col("end").alias("o_end"), name)
    o = o.withColumn("_b", F.explode(F.sequence(at(F.col("o_start")), at(F.greatest(F.col("o_start"), F.col("o_end"))))))
    hit = inner.withColumn("_b", at(F.col("start"))).join(o, [*key, "_b"]).where("o_start <= start and end <= o_end").drop("_b")
    first = F.row_number().over(W.partitionBy(*key, "start", "end").orderBy("o_start", "o_end"))
    return hit.withColumn("_r", first).where("_r = 1").drop("_r")


def nearest(targets: DataFrame, others: DataFrame, key: list[str], at: str, target_id: str, other_id: str, most: float, earlier_only: bool = False) -> DataFrame:
    """Each target's nearest other row within ``most``, the earlier one at ties.

    The order column is cut into buckets as wide as ``most``, so the join is an equality on key and
    bucket with at most three buckets a target, never all pairs of a key.
    """
    bucket = lambda c: F.floor(c / F.lit(most)).cast("long")
    t = targets.select(*key, F.col(target_id).alias("t_id"), F.col(at).alias("t_at"))
    near = [-1, 0] if earlier_only else [-1, 0, 1]
    t = t.withColumn("b", F.explode(F.transform(F.array(*[F.lit(i) for i in near]), lambda i: bucket(F.col("t_at")) + i)))
    o = others.select(*key, F.col(other_id).alias("o_id"), F.col(at).alias("o_at")).withColumn("b", bucket(F.col("o_at")))
    gap = F.col("t_at") - F.col("o_at")
    hit = t.join(o, [*key, "b"]).where((F.abs(gap) <= most) & ((gap >= 0) if earlier_only else F.lit(True)) & (F.col("t_id") != F.col("o_id")))
    return hit.groupBy(*key, "t_id", "t_at").agg(F.min(F.struct(F.abs(gap).alias("distance"), "o_at", "o_id")).alias("n")).select(*key, "t_id", F.col("n.o_id").alias("o_id"), F.col("n.distance").alias("distance"))


def in_same_clause(head: Column, tail: Column) -> Column:
    """Whether two clause numbers are equal and known."""
    return head.isNotNull() & (head == tail)


def window_relations(entities: DataFrame, key: list[str], heads: list[str], tails: list[str], relation: str, most: int, score: float, blocked: tuple[str, ...] = ("NEGATED", "FAMILY", "POSSIBLE", "CONDITIONAL", "PLANNED", "RESOLVED")) -> DataFrame:
    """Relations from heads to tails of the same clause within ``most`` signs, unless an end is blocked.

    ``entities`` has key, id, start, end, type, assertion and clause; a clause bounds the join.
    """
    e = entities.where(~F.col("assertion").isin(*blocked))
    h = e.where(F.col("type").isin(*heads)).select(*key, "clause", F.col("id").alias("head"), F.col("start").alias("hs"), F.col("end").alias("he"))
    t = e.where(F.col("type").isin(*tails)).select(*key, "clause", F.col("id").alias("tail"), F.col("start").alias("ts"), F.col("end").alias("te"))
    gap = F.greatest(F.lit(0), F.col("ts") - F.col("he"), F.col("hs") - F.col("te"))
    return h.join(t, [*key, "clause"]).where((F.col("head") != F.col("tail")) & (gap <= most)).select(*key, "head", "tail", F.lit(relation).alias("type"), F.lit(score).alias("score"), gap.alias("distance")).dropDuplicates([*key, "head", "tail", "type"])


def known_pairs(entities: DataFrame, known: DataFrame, key: list[str], score: float = 1.0) -> DataFrame:
    """Relations between entities of a document whose codes are a reviewed pair."""
    s = entities.select(*key, F.col("id").alias("head"), F.col("code_system").alias("subject_code_system"), F.col("code").alias("subject_code"))
    o = entities.select(*key, F.col("id").alias("tail"), F.col("code_system").alias("object_code_system"), F.col("code").alias("object_code"))
    hit = s.join(known, ["subject_code_system", "subject_code"]).join(o, [*key, "object_code_system", "object_code"])
    return hit.where("head <> tail").select(*key, "head", "tail", F.col("relation_type").alias("type"), F.lit(score).alias("score")).distinct()


def overlap_islands(spans: DataFrame, key: list[str]) -> DataFrame:
    """The connected groups of overlapping spans, numbered by place: a running maximum of ends."""
    w = W.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    s = spans.withColumn("_new", F.when(F.col("start") < before, 0).otherwise(1))
    return s.withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
