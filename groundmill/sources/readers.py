"""Scans: JSON lines with fixed schemas, whole texts, archives, release files and markup."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "document_id string, text string, text_sha256 string, language string, note_type string, source_artifact_id string, access_class string, redistribution string, hosted_processing_allowed boolean, parent_document_id string, group_ids array<string>, metadata map<string,string>"
ANNOTATION = "annotation_id string, document_id string, span array<int>, text string, entity_type string, assertions array<string>, concepts array<struct<code_system:string,code:string,terminology_version:string,confidence:double>>, confidence double, layer string, label_source string, labeler_id string, review_status string, source_label string, metadata map<string,string>"
RELATION = "relation_id string, document_id string, head_annotation_id string, tail_annotation_id string, relation_type string, confidence double, layer string, label_source string, evidence_span array<int>, labeler_id string, review_status string, metadata map<string,string>"
CONCEPT = "concept_id string, code string, code_system string, canonical_name string, semantic_type string, aliases array<string>, synonyms array<string>, abbreviations array<string>, parents array<string>, parent_code string, blocked_aliases array<string>"
ARTIFACT = "artifact_id string, source_id string, source_version string, source_uri string, object struct<sha256:string,uri:string,byte_size:bigint>, media_type string, license_id string, access_class string, redistribution string, hosted_processing_allowed boolean, retrieved_at string, metadata map<string,string>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a fixed schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def concepts(spark: SparkSession, path: str) -> DataFrame:
    """Concepts; a parent code joins the parents."""
    df = json_lines(spark, path, CONCEPT)
    more = F.when(F.col("parent_code").isNotNull(), F.array("parent_code")).otherwise(F.array().cast("array<string>"))
    return df.withColumn("parents", F.array_union(F.coalesce("parents", F.array().cast("array<string>")), more))


def alias_table(concept_rows: DataFrame) -> DataFrame:
    """One row per alias of a concept and its source, blocked ones left out."""
    kinds = {"canonical": F.array("canonical_name"), "alias": F.col("aliases"), "synonym": F.col("synonyms"), "abbreviation": F.col("abbreviations")}
    parts = [F.transform(F.coalesce(v, F.array().cast("array<string>")), _tag(k)) for k, v in kinds.items()]
    t = concept_rows.select("concept_id", "code", "code_system", "semantic_type", F.coalesce("blocked_aliases", F.array().cast("array<string>")).alias("_b"), F.explode(F.concat(*parts)).alias("a"))
    return t.where("a.alias is not null and not array_contains(_b, a.alias)").select("concept_id", "code", "code_system", "semantic_type", "a.alias", "a.alias_source").distinct()


def _tag(kind: str):
    return lambda x: F.struct(x.alias("alias"), F.lit(kind).alias("alias_source"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as it is but for a byte order mark; line ends are kept, so offsets hold."""
    t = F.decode("content", "UTF-8")
    return spark.read.format("binaryFile").load(path).select("path", F.regexp_replace(t, "^﻿", "").alias("text"))


def archives(spark: SparkSession, path: str, suffix: str = ".txt", members: int = 100_000, member_bytes: int = 1 << 26) -> DataFrame:
    """(path, member, text) of the archives' members; too many or too large members are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    own = [i for i in z.infolist() if i.filename.endswith(suffix) and not i.is_dir()]
                    if len(own) > members or any(i.file_size > member_bytes for i in own):
                        raise ValueError(f"{p}: the archive exceeds its limits")
                    for i in own:
                        yield pd.DataFrame({"path": [p], "member": [i.filename], "text": [z.read(i).decode("utf-8-sig")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, text string")


def brat(rows: DataFrame, payload: str = "payload", text: str = "text") -> DataFrame:
    """Text-bound annotations of standoff files: (id, type, segments, mention, valid), one row per ``T`` line."""
    line = F.explode(F.split(payload, "\n")).alias("line")
    t = rows.select("*", line).where("line rlike '^T[0-9]+\\t'")
    head = F.split(F.get(F.split("line", "\t"), 1), " ", 2)
    segments = F.transform(F.split(F.get(head, 1), ";"), lambda s: F.struct(F.get(F.split(s, " "), 0).cast("int").alias("start"), F.get(F.split(s, " "), 1).cast("int").alias("end")))
    mention = F.get(F.split("line", "\t"), 2)
    t = t.select("*", F.get(F.split("line", "\t"), 0).alias("id"), F.get(head, 0).alias("type"), segments.alias("segments"), mention.alias("mention"))
    read = F.array_join(F.transform("segments", lambda s: F.substr(F.col(text), s["start"] + 1, s["end"] - s["start"])), " ")
    return t.withColumn("valid", F.regexp_replace(read, r"\s+", " ") == F.regexp_replace("mention", r"\s+", " ")).drop("line")


def pipe_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A release file of pipe-separated rows without quotes; the trailing separator adds no column."""
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_end"])
    return spark.read.schema(schema).option("sep", "|").option("quote", "").csv(path).drop("_end")


def code_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a code, blanks and a description."""
    t = spark.read.text(path).where("trim(value) <> ''")
    return t.select(F.regexp_extract("value", r"^(\S+)\s+(.*)$", 1).alias("code"), F.trim(F.regexp_extract("value", r"^(\S+)\s+(.*)$", 2)).alias("description"))


def obo_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, synonyms, obsolete) and is_a edges (child, parent) of a graph file."""
    kind = "graphs array<struct<nodes:array<struct<id:string,lbl:string,meta:struct<deprecated:boolean,synonyms:array<struct<val:string>>>>>,edges:array<struct<sub:string,pred:string,obj:string>>>>"
    g = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("graphs").alias("g"))
    n = g.select(F.explode("g.nodes").alias("n")).select("n.id", F.col("n.lbl").alias("label"), F.col("n.meta.synonyms.val").alias("synonyms"), F.coalesce("n.meta.deprecated", F.lit(False)).alias("obsolete"))
    e = g.select(F.explode("g.edges").alias("e")).where("e.pred = 'is_a'").select(F.col("e.sub").alias("child"), F.col("e.obj").alias("parent"))
    return n, e


def phenotype_edges(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Disease to phenotype edges with support: qualifier NOT negates, an empty one asserts, others and unknown ids are left out."""
    rel = F.when(F.upper(F.coalesce("qualifier", F.lit(""))) == "NOT", "NOT_HAS_PHENOTYPE").when(F.coalesce("qualifier", F.lit("")) == "", "HAS_PHENOTYPE")
    r = rows.withColumn("relation", rel).where("relation is not null").join(known.select("hpo_id").distinct(), "hpo_id", "left_semi")
    return r.groupBy(F.col("database_id").alias("head"), "relation", F.col("hpo_id").alias("tail")).agg(F.count("*").alias("support"))


def xml_text(rows: DataFrame, payload: str, tags: list[str]) -> DataFrame:
    """``rows`` with ``blocks``: text of the elements of these tags in order, as array<struct<tag,start,end>>, and their ``rendered`` text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text, blocks = [], []
            for x in b[payload]:
                out, own, at = [], [], 0
                for e in ET.fromstring(x).iter():
                    name = e.tag.rpartition("}")[2]
                    if name in tags:
                        t = " ".join("".join(e.itertext()).split())
                        own.append({"tag": name, "start": at, "end": at + len(t)})
                        out.append(t)
                        at += len(t) + 1
                text.append("\n".join(out))
                blocks.append(own)
            yield b.assign(rendered=text, blocks=blocks)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", rendered string, blocks array<struct<tag:string,start:int,end:int>>"
    return rows.mapInPandas(run, schema)


def rendered_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` with ``rendered``: the non-empty fields as lines, and ``blocks`` with each field's offsets."""
    items = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<field:string,start:int,end:int>>").alias("out"))

    def step(acc, x):
        end = acc["at"] + F.length(x["value"])
        return F.struct((end + 1).alias("at"), F.array_append(acc["out"], F.struct(x["field"].alias("field"), acc["at"].alias("start"), end.alias("end"))).alias("out"))

    return rows.withColumn("blocks", F.aggregate(items, begin, step, lambda a: a["out"])).withColumn("rendered", F.array_join(F.transform(items, lambda x: x["value"]), "\n"))


def passages_at_offsets(rows: DataFrame, passages: str) -> DataFrame:
    """``rows`` with ``rendered``: passages (offset, text) put at their offsets, blanks between them."""
    return rows.withColumn("rendered", F.aggregate(F.array_sort(passages), F.lit(""), lambda acc, x: F.concat(F.rpad(acc, x["offset"], " "), x["text"])))


def snapshot_views(spark: SparkSession, root: str, prefix: str = "") -> list[str]:
    """Register a snapshot's tables as views; a table that was never written is empty with its schema."""
    out = []
    for name, schema in (("documents", DOCUMENT), ("annotations", ANNOTATION), ("relations", RELATION)):
        spark.read.schema(schema).parquet(f"{root}/{name}").createOrReplaceTempView(prefix + name)
        out.append(prefix + name)
    return out
