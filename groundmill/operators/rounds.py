"""Loops of joins: each round is a table in the shared folder, so neither plans nor lost executors reach back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only in local mode (tests), where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="groundmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/groundmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._groundmill_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table written by ``cut`` that nothing reads any more."""
    path = getattr(df, "_groundmill_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def _equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of distinct rows are equal: by digests, and, where these agree, exactly."""
    return _mark(a) == _mark(b) and a.exceptAll(b).isEmpty()


#: Tasks that one node's links are dealt over.
SALTS = 16


def _with_least(links: DataFrame, key: str, value: str) -> DataFrame:
    """``links`` with ``m``, the least ``value`` of their ``key``: a hub's links stay dealt over SALTS tasks.

    Each of a key's parts has its least value first; the least of these goes back to the parts, and from there to the links.
    """
    dealt = links.withColumn("_s", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    parts = dealt.groupBy(key, "_s").agg(F.min(value).alias("m"))
    least = parts.groupBy(key).agg(F.min("m").alias("m"))
    return dealt.join(parts.select(key, "_s").join(least, key), [key, "_s"]).drop("_s")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node on an edge and the least node it reaches, by alternating star contraction.

    Links stay in tables; the rounds grow with the logarithm of the longest path.  A node with very many links (a hub)
    has them dealt over several tasks.
    """
    e = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        large = _with_least(both, "u", "v").where("v > u").withColumn("m", F.least("m", "u")).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        found = cut(small.union(low.select("a", "m")).distinct(), "edges")
        done = _equal(found, e)
        release(e)
        e = found
        if done:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def closure(edges: DataFrame, depth: int, paths: bool = False) -> DataFrame:
    """(node, ancestor, distance[, path]): least distances along (child, parent) up to ``depth``, a step a round.

    A round joins the known steps with the pairs found last (frontier), keeps the least distance of each new pair and
    stops when there is none: a cycle ends there, and a pair once found is not walked again.  With ``paths`` the least
    path (by its nodes) of the least distance is kept.
    """
    step = cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node <> ancestor").distinct(), "steps")
    last = step.select("node", "ancestor", F.array("node", "ancestor").alias("path")) if paths else step
    parts = [last.withColumn("distance", F.lit(1))]
    seen, old = step, None
    up = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    for n in range(2, depth + 1):
        new = last.join(up, "ancestor").where("next <> node")
        if paths:
            new = new.groupBy("node", "next").agg(F.min(F.array_append("path", F.col("next"))).alias("path"))
        else:
            new = new.select("node", "next").distinct()
        new = new.withColumnRenamed("next", "ancestor").join(seen.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
        last = cut(new, "frontier")
        if last.isEmpty():
            release(last)
            break
        parts.append(last.withColumn("distance", F.lit(n)))
        whole = cut(seen.select("node", "ancestor").unionByName(last.select("node", "ancestor")), "closure")
        release(old)
        seen = old = whole
    release(old)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
