"""Registry queries on more rows than the small tables have."""

from pyspark.sql import functions as F

from tessera import registry


def test_image_files_are_all_listed(spark, tmp_path):
    spark.range(100_000).select(F.col("id").alias("p_partkey"), F.lit("a.b").alias("p_name")).write.parquet(str(tmp_path / "part.parquet"))
    got = registry.queries()["image_files"](spark, str(tmp_path))
    assert got.count() == sum(k % 7 in (0, 1, 3, 5) for k in range(100_000)) > 50_000
