"""The document pipeline as one plan: match, resolve, place in a sentence, classify, link, relate.

Documents in, rows out; each stage is a DataFrame function, so a caller can replace one by passing another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmill.operators import context, extract, relations, segment

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """``aliases`` (concept_id, alias, code, semantic_type) and ``cues`` (see context.cue_occurrences).

    ``extra`` stages run on the entities at the end, in order.
    """

    aliases: DataFrame
    cues: DataFrame
    doc: str = "doc_id"
    text: str = "text"
    extra: list[Stage] = field(default_factory=list)

    def predict(self, docs: DataFrame) -> DataFrame:
        """(document_id, id, start, end, mention, type, code, assertion, sentence): ids E1, E2, ... in text order."""
        docs = docs.select(F.col(self.doc).alias("document_id"), F.col(self.text).alias("text"))
        found = extract.dictionary_matches(docs, self.aliases, "document_id", "text")
        found = found.withColumn("weight", extract.match_weight(F.col("end") - F.col("start"), F.lit(False), F.col("exact")).cast("double"))
        one = found.groupBy("document_id", "start", "end").agg(F.min_by(F.struct("concept_id", "alias", "exact"), F.struct(~F.col("exact"), "concept_id")).alias("c"), F.max("weight").alias("weight"))
        kept = extract.resolve_weighted(one.select("document_id", "start", "end", "c.*", "weight"), "document_id")
        s = segment.sentences(docs, "document_id", "text").withColumn("sentence", F.col("start"))
        e = relations.contained(kept, s.select("document_id", "start", "end", "sentence"), ["document_id"], "sentence")
        e = e.withColumn("id", F.concat(F.lit("E"), F.row_number().over(W.partitionBy("document_id").orderBy("start", "end", "concept_id"))))
        local = e.select("document_id", "sentence", "id", (F.col("start") - F.col("sentence")).alias("start"), (F.col("end") - F.col("sentence")).alias("end"))
        status = context.classify(local, s.select("document_id", "sentence", "value"), self.cues, ["document_id", "sentence"], "value").select("document_id", "id", "assertion")
        linked = e.join(self.aliases.select("concept_id", "code", F.col("semantic_type").alias("type")).distinct(), "concept_id", "left").join(status, ["document_id", "id"])
        out = linked.select("document_id", "id", "start", "end", F.col("alias").alias("mention"), "type", "code", "assertion", "sentence")
        for stage in self.extra:
            out = stage(out)
        return out

    def relate(self, entities: DataFrame, heads: list[str], tails: list[str], relation: str, most: int = 160) -> DataFrame:
        """Relations within a sentence, numbered R1, R2, ... in a document."""
        r = relations.window_relations(entities.withColumnRenamed("sentence", "clause"), ["document_id"], heads, tails, relation, most, 0.7)
        return r.withColumn("id", F.concat(F.lit("R"), F.row_number().over(W.partitionBy("document_id").orderBy("head", "tail", "type"))))
