"""Gates over mined records: policy, quality, selection and prediction checks, each as rows of findings.

Documents have ``document_id, text, origin, access_class, redistribution, hosted_processing_allowed`` and a map
``metadata``; annotations ``annotation_id, document_id, start, end, text, layer, review_status`` and a list ``concepts``
of (code_system, code, terminology_version).  Nothing is collected: a gate is a union of anti joins and grouped counts,
and ``require_none`` turns its rows into an error at the sink.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmill.functions.text import valid_span

#: Classes that may not leave (fixed values).
RESTRICTED_ACCESS = ("credentialled", "dua", "local_private", "quarantine")
CLOSED_REDISTRIBUTION = ("non_commercial", "prohibited", "unknown")
REVIEWED_LAYERS = ("gold", "challenge")


def reasons(*found: tuple[Column, Column | str]) -> Column:
    """The reasons whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(r) if isinstance(r, str) else r) for c, r in found]))


def _issue(kind: str, *parts: Column | str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[F.col(p) if isinstance(p, str) else p for p in parts]).alias("issue")


def _repeated(df: DataFrame, key: str, kind: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1").select(_issue(kind, key))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def quality_issues(documents: DataFrame, annotations: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(issue): repeated ids, missing documents, wrong offsets, unreviewed gold, synthetic challenges, unknown concepts.

    ``known`` has the (code_system, code, terminology_version) of the releases in use.
    """
    found = [_repeated(documents, "document_id", "duplicate_document"), _repeated(annotations, "annotation_id", "duplicate_annotation")]
    found.append(annotations.join(documents.select("document_id").distinct(), "document_id", "left_anti").select(_issue("missing_document", "annotation_id")))
    held = annotations.join(documents.select("document_id", F.col("text").alias("_text")), "document_id")
    found.append(held.where(~F.coalesce(valid_span(F.col("_text"), F.col("start"), F.col("end"), F.col("text")), F.lit(False))).select(_issue("offset", "annotation_id")))
    reviewed = F.col("layer").isin(*REVIEWED_LAYERS) & (F.col("review_status") != "accepted")
    found.append(held.where(reviewed).select(_issue("unreviewed", "layer", "annotation_id")))
    found.append(held.where("layer = 'challenge' and origin = 'synthetic'").select(_issue("synthetic_challenge", "annotation_id")))
    if known is not None:
        key = ["code_system", "code", "terminology_version"]
        links = held.select("annotation_id", F.explode("concepts").alias("c")).select("annotation_id", "c.*")
        found.append(links.join(known.select(*key).distinct(), key, "left_anti").select(_issue("unknown_concept", "annotation_id", "code_system", "code")))
    return union(found)


def require_none(issues: DataFrame, what: str) -> None:
    """Raise with the first few issues, if there is any."""
    some = [r[0] for r in issues.orderBy("issue").limit(5).collect()]
    if some:
        raise ValueError(f"{what}: " + "; ".join(some))


def artifact_decisions(artifacts: DataFrame, registry: DataFrame) -> DataFrame:
    """``artifacts`` with (allowed, reasons): what differs from the registered source."""
    own = artifacts.join(registry.select([F.col(c).alias(c if c == "source_id" else f"_{c}") for c in registry.columns]).withColumn("_known", F.lit(True)), "source_id", "left")
    fixed = F.col("_license_mode") == "fixed"
    known = reasons(
        ((F.col("_version_policy") == "pinned") & ~F.col("source_version").eqNullSafe(F.col("_version")), "source_version_mismatch"),
        (F.col("access_class") != F.col("_access_class"), "access_class_mismatch"),
        (fixed & ~F.col("license_id").eqNullSafe(F.col("_license_id")), "license_mismatch"),
        (fixed & (F.col("redistribution") != F.col("_redistribution")), "redistribution_mismatch"),
        (F.col("hosted_processing_allowed") != F.col("_hosted_processing_allowed"), "hosted_processing_mismatch"),
    )
    found = F.when(F.col("_known").isNull(), F.array(F.concat(F.lit("unregistered_source:"), "source_id"))).otherwise(known)
    return own.withColumn("reasons", found).withColumn("allowed", F.size("reasons") == 0).select(*artifacts.columns, "allowed", "reasons")


def hosted_decisions(documents: DataFrame) -> DataFrame:
    """(document_id, allowed, reasons): may a hosted service read it?"""
    found = reasons(
        (~F.col("hosted_processing_allowed"), "document_disallows_hosted_processing"),
        (F.col("access_class").isin(*RESTRICTED_ACCESS), F.concat(F.lit("restricted_access:"), "access_class")),
    )
    return documents.select("document_id", found.alias("reasons")).withColumn("allowed", F.size("reasons") == 0)


def redistribution_reasons(documents: DataFrame) -> DataFrame:
    """(document_id, reason): what forbids passing it on."""
    found = reasons((F.col("redistribution").isin(*CLOSED_REDISTRIBUTION), F.col("redistribution")), (F.col("access_class").isin(*RESTRICTED_ACCESS), F.col("access_class")))
    return documents.select("document_id", F.explode(found).alias("reason")).distinct()


def storage_reasons(retention: Column, access_class: Column, store_uri: Column, encrypted: Column) -> Column:
    """Why a source's bytes may not be put there."""
    remote = store_uri.contains("://") & ~store_uri.startswith("file://")
    return reasons(
        ((retention == "local_only") & remote, "local_only_source_requires_local_store"),
        (access_class.isin("dua", "local_private") & ~encrypted, "restricted_source_requires_encryption_at_rest"),
    )


def restricted_reasons(documents: DataFrame) -> DataFrame:
    """(reason): distinct restricted classes of all documents; two groups at most meet per class."""
    found = reasons(
        (F.col("access_class").isin(*RESTRICTED_ACCESS), F.concat(F.lit("access:"), "access_class")),
        (F.col("redistribution").isin(*CLOSED_REDISTRIBUTION), F.concat(F.lit("redistribution:"), "redistribution")),
    )
    return documents.select(F.explode(found).alias("reason")).distinct()


def document_rejections(documents: DataFrame, sources: list[str], filters: dict[str, list[str]], selected: DataFrame | None = None) -> DataFrame:
    """``documents`` with ``rejection``: snapshot_split, source_id, metadata or null."""
    wrong = reduce(lambda a, b: a | b, [~F.coalesce(F.element_at("metadata", F.lit(k)).isin(v), F.lit(False)) for k, v in filters.items()], F.lit(False))
    parser = F.coalesce(F.element_at("metadata", F.lit("parser_id")), F.lit(""))
    rest = F.when(~parser.isin(sources), "source_id").when(wrong, "metadata")
    if selected is None:
        return documents.withColumn("rejection", rest)
    held = documents.join(selected.select("document_id").distinct().withColumn("_in", F.lit(True)), "document_id", "left")
    return held.withColumn("rejection", F.when(F.col("_in").isNull(), "snapshot_split").otherwise(rest)).drop("_in")


def selection_issues(documents: DataFrame, annotations: DataFrame, ids: DataFrame) -> DataFrame:
    """(issue): selected ids and annotations' documents that do not exist."""
    have = documents.select("document_id").distinct()
    stale = ids.select("document_id").distinct().join(have, "document_id", "left_anti").select(_issue("unknown_document", "document_id"))
    lost = annotations.select("document_id").distinct().join(have, "document_id", "left_anti").select(_issue("unknown_annotation_document", "document_id"))
    return stale.unionByName(lost)


def select_records(documents: DataFrame, annotations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents of ``ids`` and their annotations; ``selection_issues`` tells what is amiss."""
    some = ids.select("document_id").distinct()
    return documents.join(some, "document_id", "left_semi"), annotations.join(some, "document_id", "left_semi")


def select_with_metadata(documents: DataFrame, annotations: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents whose metadata have all of ``keys``, and their annotations."""
    kept = list(dict.fromkeys(k.strip() for k in keys))
    if not kept or not all(kept):
        raise ValueError("metadata keys must not be empty")
    held = documents.where(reduce(lambda a, b: a & b, [F.map_contains_key("metadata", k) for k in kept]))
    return held, annotations.join(held.select("document_id").distinct(), "document_id", "left_semi")


def synthetic_share(splits: DataFrame, documents: DataFrame, most: float) -> DataFrame:
    """(share): the synthetic share of the training split, if it is over ``most``."""
    share = F.avg((F.col("origin") == "synthetic").cast("int"))
    return splits.where("split = 'train'").join(documents.select("document_id", "origin"), "document_id").agg(F.round(share, 6).alias("share")).where(F.col("share") > most)


def challenge_issues(splits: DataFrame, annotations: DataFrame, documents: DataFrame) -> DataFrame:
    """(issue): challenge items that are not gold, not reviewed or synthetic."""
    ids = splits.where("split = 'challenge'").select("document_id")
    held = annotations.join(ids, "document_id", "left_semi")
    return union([
        held.where(~F.col("layer").isin(*REVIEWED_LAYERS)).select(_issue("non_gold_challenge", "annotation_id")),
        held.where("review_status <> 'accepted'").select(_issue("unreviewed_challenge", "annotation_id")),
        documents.where("origin = 'synthetic'").join(ids, "document_id", "left_semi").select(_issue("synthetic_challenge_document", "document_id")),
    ])


def relation_issues(documents: DataFrame, annotations: DataFrame, relations: DataFrame) -> DataFrame:
    """(issue): repeated relations, missing documents or ends, ends in another document."""
    found = [_repeated(relations, "relation_id", "duplicate_relation")]
    found.append(relations.join(documents.select("document_id").distinct(), "document_id", "left_anti").select(_issue("missing_relation_document", "relation_id")))
    own = annotations.select("annotation_id", F.col("document_id").alias("_doc")).dropDuplicates(["annotation_id"])
    for end in ("head", "tail"):
        held = relations.join(own.withColumnRenamed("annotation_id", f"{end}_id"), f"{end}_id", "left")
        found.append(held.where("_doc is null").select(_issue(f"missing_{end}", "relation_id")))
        found.append(held.where("_doc <> document_id").select(_issue(f"foreign_{end}", "relation_id")))
    return union(found)


def suppressed(mentions: DataFrame, rules: DataFrame, types: list[str] | None = None) -> DataFrame:
    """``mentions`` with ``rule_id`` of the first matching false-positive rule, or null.

    ``rules`` has rule_id, entity_type (null: any), pattern and field (text or context); the list is short and
    broadcast.  ``types`` narrows it to a profile's entity types.
    """
    rules = rules if types is None else rules.where(F.col("entity_type").isNull() | F.col("entity_type").isin(types))
    short = F.broadcast(rules.select("rule_id", F.col("entity_type").alias("_type"), "pattern", "field"))
    hit = (F.col("_type").isNull() | (F.col("_type") == F.col("entity_type"))) & F.expr("case field when 'context' then context else text end rlike pattern")
    found = mentions.join(short, hit).groupBy("mention_id").agg(F.min("rule_id").alias("rule_id"))
    return mentions.join(found, "mention_id", "left")


def prediction_issues(documents: DataFrame, entities: DataFrame, valid_systems: DataFrame, codes: DataFrame, relations: DataFrame | None = None, signatures: DataFrame | None = None) -> DataFrame:
    """(document_id, kind, path): what is wrong with predictions.

    ``entities``: document_id, entity_id, start, end, text, entity_type, code_system, code, candidates (array of
    concept_id, code_system, code, qualified); ``valid_systems``: (entity_type, code_system) pairs that may meet;
    ``codes``: (code_system, code) of the active release; ``signatures``: (relation_type, head_type, tail_type).
    """
    row = lambda kind, path: (F.col("document_id"), F.lit(kind).alias("kind"), path.alias("path"))
    own = F.col("entity_id")
    found = [entities.groupBy("document_id", "entity_id").count().where("count > 1").select(*row("duplicate_entity_id", own))]
    ids = F.transform("candidates", lambda c: c["concept_id"])
    found.append(entities.where(F.size(ids) > F.size(F.array_distinct(ids))).select(*row("duplicate_candidate_concept_id", own)))
    held = entities.join(documents.select("document_id", F.col("text").alias("_text")), "document_id")
    found.append(held.where(~F.coalesce(valid_span(F.col("_text"), F.col("start"), F.col("end"), F.col("text")), F.lit(False))).select(*row("offset", own)))
    uncoded = F.col("code_system") == "NONE"
    consistent = uncoded == F.col("code").isNull()
    found.append(entities.where(~consistent).select(*row("invalid_code_assignment", own)))
    pair = ["entity_type", "code_system"]
    small = F.broadcast(valid_systems.select(*pair).distinct())
    found.append(entities.where(~uncoded).join(small, pair, "left_anti").select(*row("invalid_code_system", own)))
    known = codes.select("code_system", "code").distinct()
    found.append(entities.where(consistent & F.col("code").isNotNull()).join(known, ["code_system", "code"], "left_anti").select(*row("unknown_dictionary_code", own)))
    each = entities.select("document_id", "entity_id", "entity_type", F.posexplode("candidates").alias("pos", "c")).select("document_id", "entity_type", F.concat_ws("/", "entity_id", "pos").alias("path"), "c.*")
    found.append(each.where(~uncoded).join(small, pair, "left_anti").select(*row("invalid_candidate_code_system", F.col("path"))))
    lost = each.where(~uncoded & F.col("code").isNotNull()).join(known, ["code_system", "code"], "left_anti")
    found.append(lost.select("document_id", F.when(F.col("qualified"), "unknown_dictionary_code").otherwise("unknown_unqualified_candidate_code").alias("kind"), "path"))
    if relations is not None:
        found.append(relations.groupBy("document_id", "relation_id").count().where("count > 1").select(*row("duplicate_relation_id", F.col("relation_id"))))
        ends = entities.select("document_id", "entity_id", "entity_type").dropDuplicates(["document_id", "entity_id"])
        typed = relations
        for end in ("head", "tail"):
            typed = typed.join(ends.select("document_id", F.col("entity_id").alias(end), F.col("entity_type").alias(f"{end}_type")), ["document_id", end], "left")
        found.append(typed.join(F.broadcast(signatures.distinct()), ["relation_type", "head_type", "tail_type"], "left_anti").select(*row("invalid_relation", F.col("relation_id"))))
    return union(found)
