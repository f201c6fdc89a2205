"""Stages as functions of tables, their ports, a plan that can go on where it stopped, and a trace of it."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EntityExtractor(Protocol):
    """Documents to spans."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


class ProposalExtractor(Protocol):
    """Documents and what was found before to proposals."""

    def __call__(self, docs: DataFrame, found: DataFrame) -> DataFrame: ...


class AssertionClassifier(Protocol):
    """Mentions to mentions with a status."""

    def __call__(self, mentions: DataFrame) -> DataFrame: ...


class CandidateRetriever(Protocol):
    """Mentions to candidates."""

    def __call__(self, mentions: DataFrame) -> DataFrame: ...


class CandidateReranker(Protocol):
    """Candidates to candidates with another score."""

    def __call__(self, candidates: DataFrame) -> DataFrame: ...


class RelationExtractor(Protocol):
    """Entities and sentences to relations."""

    def __call__(self, entities: DataFrame, sentences: DataFrame) -> DataFrame: ...


class Labeler(Protocol):
    """Documents to labelled proposals."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


def label_in_batches(docs: DataFrame, label: Callable, schema: str, rows: int = 256) -> DataFrame:
    """A labeler over pandas batches of at most ``rows`` documents, in their order within a partition."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), rows):
                yield label(b.iloc[at : at + rows])

    return docs.mapInPandas(run, schema)


def with_errors(docs: DataFrame, work: Callable, schema: str, key: str) -> DataFrame:
    """``work`` (one row as a dict to a dict) over all rows: its columns and ``error``, so one bad row fails no batch."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                try:
                    out.append({key: row[key], **work(row), "error": None})
                except Exception as e:  # the row keeps its place, and says what went wrong
                    out.append({key: row[key], **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[key, *names, "error"])

    return docs.mapInPandas(run, f"`{key}` {kind}, {schema}, error string")


@dataclass
class Trace:
    """Seconds and rows of each stage, in order."""

    rows: list[tuple[str, float, int]] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "stage string, seconds double, rows long")


def run_plan(spark: SparkSession, root: str, stages: list[tuple[str, Callable[[DataFrame | None], DataFrame]]], trace: Trace | None = None) -> DataFrame | None:
    """Stages in turn, each a table under ``root``: a table that is complete is read, not made again.

    Parquet's own success mark tells completeness, so a run that was stopped goes on with the first stage without one.
    """
    out = None
    for name, stage in stages:
        path, began = f"{root.rstrip('/')}/{name}", time.time()
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            stage(out).write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = spark.read.parquet(path)
        if trace is not None:
            trace.rows.append((name, round(time.time() - began, 3), out.count()))
    return out


def document_trace(docs: DataFrame, counters: dict[str, str], key: str = "document_id") -> DataFrame:
    """(document, counters): a hashed id and each counter's value per document, from expressions on the results."""
    return docs.select(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 16).alias("document"), *[F.expr(e).cast("long").alias(n) for n, e in counters.items()])
