"""Jobs, engines and pixels read from the driver's tables, which hold none of their own.

Each function says which columns stand in for what; the SQL text beside it says the same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("jpeg", "png", "webp", "heic", "heif", "avif", "jxl")
STATUSES = ("pending", "running", "completed", "failed", "cancelled")
#: events.event_type, in the order of its name, stands for the status at the same place.
EVENT_STATUS = {"click": "pending", "error": "failed", "purchase": "completed", "signup": "cancelled", "view": "running"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the job table: sizes, engine scale, target, format and quality are arithmetic on its keys."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        F.col("p_name").alias("name"),
        (40 + (k * 37) % 9000).cast("int").alias("w"),
        (30 + (k * 53) % 7000).cast("int").alias("h"),
        (k % 4 + 1).cast("int").alias("base"),
        (F.col("p_size") % 16 + 1).cast("int").alias("target"),
        (k % 3 != 0).alias("allow"),
        F.element_at(F.array(*map(F.lit, FORMATS)), (k % 7 + 1).cast("int")).alias("fmt"),
        (F.col("p_size") * 3 - 20).cast("int").alias("q"),
        F.concat(F.lit("e"), (k % 11).cast("string")).alias("engine"),
    )


JOBS = """jobs AS (SELECT p_partkey AS id, p_name AS name, (40 + (p_partkey * 37) % 9000)::INT AS w, (30 + (p_partkey * 53) % 7000)::INT AS h,
  (p_partkey % 4 + 1)::INT AS base, (p_size % 16 + 1)::INT AS target, p_partkey % 3 <> 0 AS allow,
  (['jpeg', 'png', 'webp', 'heic', 'heif', 'avif', 'jxl'])[(p_partkey % 7 + 1)::INT] AS fmt, (p_size * 3 - 20)::INT AS q,
  'e' || (p_partkey % 11) AS engine FROM part)"""


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the queue's rows in insertion order (event_id), event_type standing for a status."""
    pairs = [F.lit(x) for kv in EVENT_STATUS.items() for x in kv]
    status = F.coalesce(F.create_map(*pairs)[F.col("event_type")], F.lit("retry_wait"))
    return table(spark, sf_dir, "events").withColumn("status", status)


EVENTS = (
    "ev AS (SELECT *, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_STATUS.items())
    + " ELSE 'retry_wait' END AS status FROM events)"
)
