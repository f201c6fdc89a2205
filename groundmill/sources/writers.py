"""Sinks: JSON lines with a digest, snapshots in Parquet, error tables, training chunks and review packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def json_row(df: DataFrame) -> Column:
    """Each row as JSON with its keys in alphabetical order, nulls kept."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str) -> str:
    """Write rows as JSON lines and return a digest of them that doesn't depend on their order.

    The digest is the hash of count and sums of the rows' hashes, so nothing is sorted or collected.
    """
    out = df.select(json_row(df).alias("value"))
    out.write.mode("overwrite").text(path)
    return digest(df)


def digest(df: DataFrame) -> str:
    """An order-independent digest of a table."""
    h = F.sha2(json_row(df), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)"))
    return df.agg(F.sha2(F.concat_ws(":", F.count("*"), *[F.coalesce(part(i), F.lit(0)).cast("string") for i in range(5)]), 256)).first()[0]


def write_snapshot(df: DataFrame, path: str, key: str, shard_rows: int = 50_000) -> None:
    """Parquet sorted by key, compressed with zstd, at most ``shard_rows`` rows a file."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").option("maxRecordsPerFile", shard_rows).option("compression", "zstd").parquet(path)


def publish(df: DataFrame, path: str, key: str) -> bool:
    """Publish a snapshot once: the same content again is no change, another content is an error."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        if digest(spark.read.parquet(path).select(*df.columns)) != digest(df):
            raise ValueError(f"{path} holds another snapshot")
        return False
    staging = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".staging")
    fs.delete(staging, True)
    write_snapshot(df, staging.toString(), key)
    return bool(fs.rename(staging, p))


def review_pack(docs: DataFrame, reviewers: list[str], fraction: float, key: str) -> DataFrame:
    """Who reviews which document: by hash order the first ceil(fraction x n) go to all, the rest in turn.

    A document's place is the number of rows in the hash ranges before its own, at most 4096 of them, and its place there:
    no window holds all documents.
    """
    hashed = docs.select(key, F.sha2(F.col(key).cast("string"), 256).alias("h")).withColumn("range", F.substring("h", 1, 3))
    counts = hashed.groupBy("range").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))  # a row per range
    starts = counts.select("range", F.coalesce(before, F.lit(0)).alias("at"))
    n = docs.agg(F.count("*").alias("n"))
    place = F.col("at") + F.row_number().over(W.partitionBy("range").orderBy("h", key)) - 1
    ranked = hashed.join(F.broadcast(starts), "range").withColumn("r", place).crossJoin(F.broadcast(n))  # one row
    names = F.array(*[F.lit(r) for r in reviewers])
    shared = F.ceil(F.col("n") * fraction)
    to = F.when(F.col("r") < shared, names).otherwise(F.array(F.element_at(names, (F.pmod(F.col("r") - shared, F.lit(len(reviewers))) + 1).cast("int"))))
    return ranked.select(key, F.explode(to).alias("reviewer"), (F.col("r") < shared).alias("shared"))


def partitioned(df: DataFrame, path: str, by: list[str], kind: str = "parquet") -> None:
    """Write by partition columns, each partition's rows together first."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).format(kind).save(path)
