"""Parsers of corpus formats: token transcripts, clinical bundles, product labels, case archives, code books and lexica."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmill.sources.readers import json_lines

#: Bounds of archives: members, bytes of one, bytes of all.
MEMBERS, MEMBER_BYTES, TOTAL_BYTES = 100_000, 64 << 20, 1 << 32


def align_tokens(text: Column, words: Column) -> Column:
    """(spans, problem): each word's place, one after another; only blanks may lie between and after them.

    ``problem`` names the first word that is empty, missing or behind other signs (``word:3``), or ``suffix``.
    """
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("string").alias("problem"))

    def step(acc: Column, w: Column) -> Column:
        start = F.position(w, text, acc["at"] + 1) - 1
        gap = F.substr(text, acc["at"] + 1, start - acc["at"])
        bad = (F.length(w) == 0) | (start < 0) | (F.length(F.trim(F.regexp_replace(gap, r"(?U)\s+", ""))) > 0)
        wrong = F.coalesce(acc["problem"], F.when(F.coalesce(bad, F.lit(True)), F.concat(F.lit("word:"), F.size(acc["spans"]).cast("string"))))
        return F.struct(
            F.when(wrong.isNull(), start + F.length(w)).otherwise(acc["at"]).alias("at"),
            F.when(wrong.isNull(), F.array_append(acc["spans"], F.struct(start.alias("start"), (start + F.length(w)).alias("end")))).otherwise(acc["spans"]).alias("spans"), wrong.alias("problem"),
        )

    def last(acc: Column) -> Column:
        rest = F.regexp_replace(F.substr(text, acc["at"] + 1), r"(?U)\s+", "")
        return F.struct(acc["spans"].alias("spans"), F.coalesce(acc["problem"], F.when(F.length(rest) > 0, "suffix")).alias("problem"))

    return F.aggregate(words, begin, step, last)


def transcripts(rows: DataFrame, split: str) -> DataFrame:
    """Documents of a token-labelled transcript table (text, words, labels): spans, labels and what is wrong with a row."""
    held = rows.select("text", "words", "labels", align_tokens(F.col("text"), F.col("words")).alias("a"))
    problem = F.when(F.size("words") != F.size("labels"), "length").otherwise(F.col("a.problem"))
    return held.select("text", F.lit(split).alias("source_split"), F.col("a.spans").alias("spans"), "labels", problem.alias("problem"), F.sha2("text", 256).alias("text_sha256"))


BUNDLE = """resourceType string, id string, entry array<struct<resource:struct<resourceType:string,id:string,status:string,effectiveDateTime:string,onsetDateTime:string,authoredOn:string,
  code:struct<text:string,coding:array<struct<display:string,code:string>>>,medicationCodeableConcept:struct<text:string,coding:array<struct<display:string,code:string>>>,
  valueQuantity:struct<value:string,unit:string>,valueString:string>>>"""


def bundles(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """One document per bundle: resources as blocks in order, grouped by its patients, else by the bundle."""
    b = rows.withColumn("b", F.from_json(payload, BUNDLE)).where("b.resourceType = 'Bundle'")
    name = lambda c: F.coalesce(c["text"], F.get(c["coding"], 0)["display"], F.get(c["coding"], 0)["code"])

    def block(e: Column) -> Column:
        r = e["resource"]
        when = F.coalesce(r["effectiveDateTime"], r["onsetDateTime"], r["authoredOn"])
        value = F.coalesce(F.concat_ws(" ", r["valueQuantity"]["value"], r["valueQuantity"]["unit"]), r["valueString"])
        parts = F.array(name(r["code"]), name(r["medicationCodeableConcept"]), F.when(F.length(value) > 0, value), r["valueString"], r["status"], when)
        return F.concat(r["resourceType"], F.lit(": "), F.array_join(F.array_distinct(F.array_compact(parts)), "; "))

    patients = F.array_sort(F.transform(F.filter("b.entry", lambda e: (e["resource"]["resourceType"] == "Patient") & e["resource"]["id"].isNotNull()), lambda e: F.concat(F.lit("patient:"), e["resource"]["id"])))
    own = F.coalesce(F.col("b.id"), F.substring(F.sha2(payload, 256), 1, 16))
    return b.select(
        own.alias("external_id"), F.array_join(F.transform("b.entry", block), "\n\n").alias("text"),
        F.when(F.size(patients) > 0, patients).otherwise(F.array(F.concat(F.lit("bundle:"), own))).alias("group_ids"),
    )


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ET.Element | None) -> str:
    return "" if e is None else " ".join("".join(e.itertext()).split())


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in e if _name(c) == name), None)


def _label(payload: bytes) -> dict:
    root = ET.fromstring(payload)
    first = lambda n: next((e for e in root.iter() if _name(e) == n), None)
    sid, version, when = first("setId"), first("versionNumber"), first("effectiveTime")
    blocks = [_text(first("title"))]
    for s in (e for e in root.iter() if _name(e) == "section"):
        blocks.append("\n".join(t for t in (_text(_child(s, "title")), _text(_child(s, "text"))) if t))
    kept: list[str] = []
    for b in blocks:
        if b and (not kept or kept[-1] != b):
            kept.append(b)
    products = []
    for p in (e for e in root.iter() if _name(e) == "manufacturedProduct"):
        inner = next((e for e in p.iter() if e is not p and _name(e) == "manufacturedProduct"), p)
        code = _child(inner, "code")
        names = [_text(e) for e in inner if _name(e) == "name"]
        if names:
            products.append({"name": names[0], "ndc": "" if code is None else code.get("code", "")})
    unique = list({(p["name"], p["ndc"]): p for p in products}.values())
    return {
        "set_id": "" if sid is None else (sid.get("root") or _text(sid)).strip(), "version": "" if version is None else version.get("value", ""),
        "effective_time": "" if when is None else when.get("value", ""), "text": "\n\n".join(kept), "products": unique,
    }


def _members(content: bytes, suffix: str, depth: int = 1) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > MEMBERS or sum(i.file_size for i in infos) > TOTAL_BYTES or any(i.file_size > MEMBER_BYTES for i in infos):
            raise ValueError("the archive exceeds its limits")
        if len({i.filename for i in infos}) < len(infos) or any(i.flag_bits & 1 for i in infos):
            raise ValueError("the archive has repeated or encrypted members")
        for i in infos:
            if i.filename.lower().endswith(suffix):
                yield i.filename, z.read(i)
            elif depth and i.filename.lower().endswith(".zip"):
                yield from _members(z.read(i), suffix, depth - 1)


def product_labels(files: DataFrame) -> DataFrame:
    """(path, member, set_id, version, effective_time, text, products) of label files (path, content): XML or nested archives.

    Equal payloads count once: they are dropped by their digest after parsing, over all files.
    """
    kind = "path string, member string, digest string, set_id string, version string, effective_time string, text string, products array<struct<name:string,ndc:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                content = bytes(content)
                for member, payload in _members(content, ".xml") if content[:2] == b"PK" else [("", content)]:
                    yield pd.DataFrame([{"path": path, "member": member, "digest": hashlib.sha256(payload).hexdigest(), **_label(payload)}])

    found = files.select("path", "content").mapInPandas(run, kind)
    keep = F.row_number().over(W.partitionBy("digest").orderBy("path", "member"))
    return found.withColumn("_r", keep).where("_r = 1").drop("_r", "digest")


def case_archives(files: DataFrame, text_pattern: str = r"(?:^|/)(train|dev|test)/text_files/([^/]+)\.txt$") -> tuple[DataFrame, DataFrame]:
    """Cases (split, case_id, text) and their labels (split, case_id, type, code, mention, segments, valid) of archives.

    A label's segments must read as its mention; rows of unknown cases are kept with ``valid`` false.
    """
    kind = "split string, case_id string, text string, labels string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                for name, payload in [*_members(bytes(content), ".txt", 0), *_members(bytes(content), ".tsv", 0)]:
                    text, label = re.search(text_pattern, name), re.search(r"(?:^|/)(train|dev|test)/[^/]+\.tsv$", name)
                    body = payload.decode("utf-8-sig")
                    if text:
                        yield pd.DataFrame([{"split": text[1], "case_id": text[2], "text": body, "labels": None}])
                    elif label:
                        yield pd.DataFrame([{"split": label[1], "case_id": None, "text": None, "labels": body}])

    every = files.select("content").mapInPandas(run, kind)
    cases = every.where("case_id is not null").select("split", "case_id", "text")
    line = every.where("labels is not null").select("split", F.explode(F.split("labels", "\r?\n")).alias("line")).where("line <> ''")
    f = F.split("line", "\t", -1)
    rows = line.select("split", F.get(f, 0).alias("case_id"), F.get(f, 1).alias("type"), F.get(f, 2).alias("code"), F.get(f, 3).alias("mention"), F.get(f, 4).alias("places"))
    segments = F.transform(F.split("places", ";"), lambda s: F.struct(F.get(F.split(F.trim(s), " "), 0).cast("int").alias("start"), F.get(F.split(F.trim(s), " "), 1).cast("int").alias("end")))
    held = rows.withColumn("segments", segments).join(cases, ["split", "case_id"], "left")
    read = F.array_join(F.transform("segments", lambda s: F.substr("text", s["start"] + 1, s["end"] - s["start"])), " ")
    same = F.coalesce(F.lower(F.regexp_replace(read, r"\s+", " ")) == F.lower(F.regexp_replace("mention", r"\s+", " ")), F.lit(False))
    return cases, held.select("split", "case_id", "type", "code", "mention", "segments", same.alias("valid"))


def code_book(files: DataFrame) -> DataFrame:
    """(code, name, parent, aliases) of the classes of a code book in XML (path, content): preferred labels, inclusions."""
    kind = "code string, name string, parent string, aliases array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                content, out = bytes(content), []
                for payload in ([p for _, p in _members(content, ".xml")] if content[:2] == b"PK" else [content]):
                    for c in (e for e in ET.fromstring(payload).iter() if _name(e) == "Class"):
                        code = c.get("code", "").strip()
                        labels: dict[str, list[str]] = {}
                        for r in (e for e in c if _name(e) == "Rubric"):
                            labels.setdefault(r.get("kind", ""), []).extend(t for e in r.iter() if _name(e) == "Label" and (t := _text(e)))
                        above = _child(c, "SuperClass")
                        if re.fullmatch(r"[A-Z]\d\d(?:\.[0-9A-Z]{1,4})?", code) and labels.get("preferred"):
                            out.append((code, labels["preferred"][0], None if above is None else above.get("code"), list(dict.fromkeys(labels.get("inclusion", [])))))
                yield pd.DataFrame(out, columns=["code", "name", "parent", "aliases"])

    return files.select("content").mapInPandas(run, kind).groupBy("code").agg(F.max(F.struct("name", "parent", "aliases")).alias("c")).select("code", "c.*")


def lexicon(spark: SparkSession, path: str, required: tuple[str, ...] = ("concept_id", "canonical_name", "semantic_type"), lists: tuple[str, ...] = ("aliases", "synonyms", "abbreviations")) -> DataFrame:
    """A reviewed lexicon with a header, tab or comma separated: lists split at ``|``, and ``problem`` per row.

    ``problem``: missing:<column>, duplicate_concept or null.
    """
    df = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    for c in lists:
        if c in df.columns:
            df = df.withColumn(c, F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")))
    missing = F.coalesce(*[F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(f"missing:{c}")) for c in required])
    n = F.count("*").over(W.partitionBy(required[0]))
    return df.withColumn("problem", F.coalesce(missing, F.when(n > 1, "duplicate_concept")))


def boxed_rows(boxes: DataFrame, code_x: tuple[float, float], columns: dict[str, tuple[float, float]], pattern: str = r"^[A-Z]\d\d(?:\.\d+)?[*+]?$") -> DataFrame:
    """Table rows from word boxes (page, y, x, word): a code in its column begins a row, which runs to the next code.

    Words of a column's range are joined in reading order.  Rows are numbered by a running count over the pages' lines,
    per page, and a page's first lines without a code go on with the last row of the page before.
    """
    is_code = (F.col("x").between(*code_x)) & F.col("word").rlike(pattern)
    order = W.partitionBy("page").orderBy("y", F.desc(is_code), "x")
    b = boxes.withColumn("_n", F.sum(is_code.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_is", is_code)
    line = W.partitionBy("page", "y")
    b = b.withColumn("_n", F.max("_n").over(line))
    per = b.groupBy("page").agg(F.max("_n").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per page
    b = b.join(F.broadcast(per.select("page", before.alias("_b"))), "page").withColumn("row", F.col("_b") + F.col("_n")).where("row > 0")
    text = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("x").between(*r) & ~F.col("_is"), F.struct("page", "y", "x", "word")))), lambda w: w["word"]), " ").alias(c) for c, r in columns.items()]
    return b.groupBy("row").agg(F.min(F.when(F.col("_is"), F.col("word"))).alias("code"), F.min(F.when(F.col("_is"), F.col("page"))).alias("page"), *text).where("code is not null")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Mention inventory rows with ``repeated``: whether the term id occurs more than once."""
    df = json_lines(spark, path, "term_id string, normalized_mention string, entity_type string, source_label string, occurrence_count bigint, document_count bigint")
    return df.withColumn("repeated", F.count("*").over(W.partitionBy("term_id")) > 1)


def gold_dataset(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents, entities) of a synthetic benchmark folder: documents.jsonl and gold.jsonl, one entity per row."""
    docs = json_lines(spark, f"{root}/documents.jsonl", "document_id string, text string, metadata map<string,string>")
    gold = json_lines(spark, f"{root}/gold.jsonl", "document_id string, entities array<struct<id:string,span:array<int>,text:string,type:string,code_system:string,code:string,assertion:string>>")
    e = gold.select("document_id", F.explode("entities").alias("e")).select("document_id", "e.*")
    return docs, e.withColumn("start", F.col("span")[0]).withColumn("end", F.col("span")[1]).drop("span")
