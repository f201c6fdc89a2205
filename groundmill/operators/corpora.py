"""Fusing corpora: groups of duplicates, components over shared keys, canonical records, relations that survive, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmill.operators.mining import content_id
from groundmill.operators.rounds import components


def group_members(members: DataFrame, group: str, item: str, prefix: str) -> DataFrame:
    """``members`` with ``group_id``: a digest of the group's items that does not depend on their order.

    Each item's own digest is summed per group (a sum of fixed-width numbers, so no group meets in one value list).
    """
    part = F.conv(F.substring(F.sha2(F.col(item).cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    sums = members.groupBy(group).agg(F.sum(part).alias("_s"), F.count("*").alias("_n"), F.min(item).alias("_first"))
    named = sums.select(group, content_id(prefix, F.col("_s"), F.col("_n"), F.col("_first")).alias("group_id"))
    return members.join(named, group)


def describe_groups(docs: DataFrame, links: DataFrame, doc: str = "document_id", raw: str = "raw_hash", norm: str = "norm_hash") -> DataFrame:
    """(doc, root, kind): groups of documents linked by equal texts or by ``links`` (a, b) between them.

    ``kind``: raw_exact if all texts of the group are equal (only those may be collapsed), normalized_exact if their
    normalised ones are, near if links joined more, singleton otherwise.  Equal texts are linked to the least id of
    their hash, so a group of copies gives no pairs.
    """
    least = docs.groupBy(norm).agg(F.min(doc).alias("_lead"))
    same = docs.join(least, norm).where(F.col(doc) != F.col("_lead")).select(F.col(doc).alias("a"), F.col("_lead").alias("b"))
    roots = components(same.unionByName(links.select("a", "b")))
    held = docs.join(roots.withColumnRenamed("node", doc), doc, "left").withColumn("root", F.coalesce("root", doc))
    per = held.groupBy("root").agg(F.count("*").alias("n"), F.min(raw).alias("r1"), F.max(raw).alias("r2"), F.min(norm).alias("n1"), F.max(norm).alias("n2"))
    kind = F.when(F.col("n") == 1, "singleton").when(F.col("r1") == F.col("r2"), "raw_exact").when(F.col("n1") == F.col("n2"), "normalized_exact").otherwise("near")
    return held.select(doc, "root").join(per.select("root", kind.alias("kind"), F.col("n").alias("size")), "root")


def connected_groups(docs: DataFrame, keys: DataFrame, doc: str = "document_id") -> DataFrame:
    """(doc, root): documents that share any key, directly or through others; ``keys`` has (doc, key) rows.

    Each key's documents are linked to the least of them: as many links as rows, whatever the key's share.
    """
    rows = keys.where("key is not null").select(doc, "key").distinct()
    least = rows.groupBy("key").agg(F.min(doc).alias("_lead"))
    links = rows.join(least, "key").where(F.col(doc) != F.col("_lead")).select(F.col(doc).alias("a"), F.col("_lead").alias("b"))
    roots = components(links)
    return docs.select(doc).distinct().join(roots.withColumnRenamed("node", doc), doc, "left").withColumn("root", F.coalesce("root", doc))


#: From most to least restrictive (fixed values).
ACCESS_ORDER = ("quarantine", "local_private", "dua", "credentialled", "authorized_private", "open_with_terms", "open")
REDISTRIBUTION_ORDER = ("prohibited", "unknown", "non_commercial", "attribution", "allowed")


def fuse(docs: DataFrame, annotations: DataFrame, doc: str = "document_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, mapping, annotations): copies of one text collapsed into the least id, with merged policy.

    The most restrictive access and redistribution hold, hosted processing only if all copies allow it.  Annotations of
    all copies (equal offsets, type and text) are kept once with their votes; those that all copies agree on, or that
    stand alone, are ``training``, the others ``review``.
    """
    order = lambda c, names: F.min(F.array_position(F.array(*map(F.lit, names)), F.col(c))).alias(f"_{c}")
    keyed = docs.withColumn("_hash", F.sha2("text", 256))
    group = keyed.groupBy("_hash").agg(
        F.min(doc).alias("canonical"), F.count_distinct(doc).alias("copies"), order("access_class", ACCESS_ORDER), order("redistribution", REDISTRIBUTION_ORDER),
        F.min("hosted_processing_allowed").alias("_hosted"),
    )
    mapping = keyed.select(doc, "_hash").join(group.select("_hash", "canonical", "copies"), "_hash").select(doc, "canonical", "copies")
    merged = keyed.join(group, (keyed["_hash"] == group["_hash"]) & (keyed[doc] == group["canonical"])).select(
        keyed[doc], keyed["text"], F.element_at(F.array(*map(F.lit, ACCESS_ORDER)), F.col("_access_class").cast("int")).alias("access_class"),
        F.element_at(F.array(*map(F.lit, REDISTRIBUTION_ORDER)), F.col("_redistribution").cast("int")).alias("redistribution"), F.col("_hosted").alias("hosted_processing_allowed"), "copies",
    )
    items = [c for c in annotations.columns if c not in (doc, "annotation_id")]
    votes = annotations.join(mapping, doc).groupBy("canonical", "copies", *items).agg(F.count_distinct(doc).alias("votes"), F.min("annotation_id").alias("annotation_id"))
    return merged, mapping, votes.withColumn("tier", F.when(F.col("votes") == F.col("copies"), "training").otherwise("review")).withColumnRenamed("canonical", doc)


def retain_relations(relations: DataFrame, mapping: DataFrame, annotations: DataFrame, doc: str = "document_id") -> DataFrame:
    """``relations`` with ``rejection``: document_collapsed, endpoint_not_materialized or null."""
    have = annotations.select("annotation_id").distinct().withColumn("_have", F.lit(1))
    held = relations.join(mapping.select(doc, "canonical"), doc, "left")
    for end in ("head_id", "tail_id"):
        held = held.join(have.withColumnsRenamed({"annotation_id": end, "_have": f"_{end}"}), end, "left")
    lost = F.col("_head_id").isNull() | F.col("_tail_id").isNull()
    why = F.when(~F.col("canonical").eqNullSafe(F.col(doc)), "document_collapsed").when(lost, "endpoint_not_materialized")
    return held.withColumn("rejection", why).select(*relations.columns, "rejection")


def freeze_splits(docs: DataFrame, source_split: str, split_map: dict[str, str], doc: str = "document_id") -> DataFrame:
    """(doc, split, issue): the source's own splits renamed; an unmapped split or a repeated id is an issue."""
    if not split_map or not all(k.strip() and v.strip() for k, v in split_map.items()):
        raise ValueError("the split map needs names")
    names = F.create_map(*[F.lit(x) for kv in split_map.items() for x in kv])
    per = docs.groupBy(doc).agg(F.min(source_split).alias("_s"), F.count("*").alias("_n"))
    split = F.element_at(names, F.col("_s"))
    issue = F.when(F.col("_n") > 1, "duplicate_document").when(split.isNull(), "unmapped_split")
    return per.select(doc, split.alias("split"), issue.alias("issue"))


def merge_outputs(primary: DataFrame, secondary: DataFrame, strategy: dict[str, str], doc: str = "document_id") -> DataFrame:
    """Spans of two systems merged by a strategy per type, without changing text, type or offsets.

    ``primary``, ``secondary``, ``union``, ``intersection`` (spans of the first that the second has too), and
    ``primary_preferred_union`` / ``secondary_preferred_union``: all of the preferred, and the other's spans that overlap
    none of it.
    """
    key = [doc, "entity_type", "start", "end"]
    names = F.create_map(*[F.lit(x) for kv in strategy.items() for x in kv])
    way = F.element_at(names, F.col("entity_type"))
    p, s = (df.select(*key).distinct().withColumn("way", way) for df in (primary, secondary))
    first = p.where("way in ('primary', 'union', 'primary_preferred_union')").unionByName(s.where("way in ('secondary', 'union', 'secondary_preferred_union')"))
    common = p.where("way = 'intersection'").join(s.select(*key), key, "left_semi")
    out = [first, common]
    for own, other, name in ((p, s, "primary_preferred_union"), (s, p, "secondary_preferred_union")):
        free = uncovered(other.where(F.col("way") == name), own.where(F.col("way") == name), doc)
        out.append(free.select(*key, "way"))
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    return done.select(*key).distinct()


def uncovered(spans: DataFrame, others: DataFrame, doc: str = "document_id", by: str = "entity_type") -> DataFrame:
    """``spans`` that overlap none of ``others`` of the same document and type: one sort of both, no pairs.

    The greatest end of the others that start before a span, and the least start of those after it, decide.
    """
    tagged = spans.withColumn("_o", F.lit(0)).unionByName(others.select(*spans.columns).withColumn("_o", F.lit(1)))
    w = W.partitionBy(doc, by).orderBy("start", F.desc("_o"))
    other = lambda c: F.when(F.col("_o") == 1, F.col(c))
    seen = F.max(other("end")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.min(other("start")).over(w.rowsBetween(1, W.unboundedFollowing))
    held = tagged.withColumn("_seen", seen).withColumn("_after", after)
    return held.where("_o = 0 and coalesce(_seen <= start, true) and coalesce(_after >= end, true)").select(*spans.columns)
