"""Helpers shared by the corpus operators: written tables, lambda bindings, links to classes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.shared import delete, shared_folder

#: ASCII white space, as every contract on words here means it.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Folders that ``written`` made, for the Scratch that is open.
_made: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.

    Unlike a local checkpoint the files outlive any executor, and unlike a cached
    table they are columnar, so later passes read only the columns they use.
    """
    return _placed(df, name)[0]


def _placed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Deletes what was written while it was open, but for the tables that were ``kept``; those go with ``delete``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _made.append([])
        return self

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        table, path = _placed(df, name)
        self.paths.append(path)
        return table

    def __exit__(self, *_) -> None:
        for path in _made.pop():
            if path not in self.paths:
                delete(self.spark, path)

    def delete(self) -> None:
        for path in self.paths:
            delete(self.spark, path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, even if ``body`` uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def hex_number(text: Column, digits: int = 15) -> Column:
    """A non-negative long from the first hexadecimal digits of an MD5; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of undirected ``edges``: (id, component_id = smallest id).

    Alternating large-star and small-star steps; every step is a map-side combined
    minimum per node and an equi join on that node, so no component is ever gathered
    in one task, and adaptive execution may split the join of a hot node. Each round is
    written to the shared folder, so lost executors cost one round at most. Rows with a
    null end are ignored; loops give their node to its own component.
    """
    pairs = edges.select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    ).where(F.col("u").isNotNull() & F.col("v").isNotNull() & F.col(left).isNotNull() & F.col(right).isNotNull())
    pairs = written(pairs.distinct(), "links")  # whatever makes the edges runs once
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("id"))
    links, before = pairs.where("u <> v"), None
    state = None
    for _ in range(rounds):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, path = _placed(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        if before:
            delete(links.sparkSession, before)
        before = path
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.groupBy("u").agg(F.min("v").alias("v"))
    return (
        nodes.distinct()
        .join(roots, F.col("id") == F.col("u"), "left")
        .select("id", F.coalesce("v", "id").alias("component_id"))
    )


def map_texts(docs: DataFrame, column: str, fields: dict, make: Callable[[list[str]], list[list]], step: int = 256) -> DataFrame:
    """doc_id and the ``fields`` (name: Arrow type) that ``make`` gives for lists of at most ``step`` whole texts.

    Works on Arrow batches, so ids stay exact beside null ids. Null texts are handed on as empty ones.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = pa.schema([("doc_id", pa.int64()), *fields.items()])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                made = make([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(made, list(schema)[1:], strict=True))], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    return slim.mapInArrow(run, from_arrow_schema(schema))
