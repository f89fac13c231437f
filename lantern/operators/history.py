"""History of assessments: an append-only table, read newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHOWN = 50


def entries(assessed: DataFrame, source: str) -> DataFrame:
    """What is remembered of assessments with findings; no values of findings."""
    return assessed.where("finding_count > 0").select(
        F.expr("uuid()").alias("id"), F.current_timestamp().alias("timestamp"), F.lit(source).alias("source"), "score", "level", "finding_count", "finding_types", "breakdown", F.lit(0).cast("long").alias("compute_time_ms"),
    )


def append(assessed: DataFrame, path: str, source: str = "manual") -> None:
    entries(assessed, source).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, n: int = SHOWN) -> DataFrame:
    return newest(spark.read.parquet(path), n)


def newest(history: DataFrame, n: int = SHOWN, *ties: str) -> DataFrame:
    return history.orderBy(F.desc("timestamp"), *ties).limit(n)


def clear(spark: SparkSession, path: str) -> None:
    spark.read.parquet(path).limit(0).write.mode("overwrite").parquet(f"{path}.cleared")
    empty = spark.read.parquet(f"{path}.cleared")
    empty.write.mode("overwrite").parquet(path)
