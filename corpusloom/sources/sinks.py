"""Writers: one JSON document, an appended log, resumable results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import remaining


def overwrite_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows; Spark's committer makes them appear as a whole, also when several jobs append."""
    df.write.mode("append").json(path)


def resume(todo: DataFrame, path: str, key: str, schema: str) -> DataFrame:
    """Rows that earlier runs have not written below ``path``."""
    spark = todo.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return todo
    return remaining(todo, spark.read.schema(schema).parquet(path), key)


def checkpointed_write(todo: DataFrame, path: str, key: str, schema: str) -> DataFrame:
    """Write what is still missing and read all results."""
    resume(todo, path, key, schema).write.mode("append").parquet(path)
    return todo.sparkSession.read.schema(schema).parquet(path)


def merge_shards(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[int]]:
    """Results of shards in id order, and the ids of those that are missing."""
    out, missing = None, []
    for k, p in enumerate(paths):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            missing.append(k)
            continue
        part = spark.read.parquet(p).withColumn("shard", F.lit(k).cast("long"))
        out = part if out is None else out.unionByName(part)
    return (None if out is None else out.orderBy("shard")), missing
