"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by hash. A copy of a document gets the virtual finish
time (cumulative words of its source) / (target of its source); all copies are served in the
order of their finish times until the total budget is used up. A source is offered twice at
most, so no document is repeated more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import hex_number, read, words, written

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (3, 1, 2)
#: Hash buckets in which a source's running sums are made, and steps per unit of virtual time.
BUCKETS = 4096
#: Virtual times from this on share one step at first.
LAST_UNIT = 4
#: The step in which the budget ends is cut again while it has more rows, so often at most.
ONE_BY_ONE, DEEPEST = 1 << 16, 6
#: Equal rows that one row is made into at once.
STRETCH = 1 << 16
#: All sources together are to give this share of their words; none more than COPIES times its words.
SHARE = 1.5
COPIES = 2


def source_targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: sk, source_size, target.

    Water filling in closed form: sorted by cap / weight, a source is capped if the level left after
    the caps before it reaches its own cap. The windows run over one row per source.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", weight.cast("double")).withColumn("cap", F.lit(float(COPIES)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(whole)).alias("budget"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("caps"),
    ).withColumn("level", (F.col("budget") - F.col("caps")) / F.col("w_left"))
    level = level.withColumn("capped", F.col("level") * F.col("w") >= F.col("cap"))
    return level.withColumn("free_level", F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)).select(
        "sk",
        "source_size",
        "budget",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("free_level") * F.col("w")).alias("target"),
    )


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def _row_key() -> Column:
    """What tells documents apart that the mix must tell apart: id, source and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.sha2(F.concat_ws("\x00", F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")), _key(F.col("source")), text), 256)


def _spot(seed: str, place: Column) -> Column:
    """The hash by which a document stands in its source's queue: of its id, or where it has none of its text; the second and further
    ones of equal rows are hashed with their number."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.col("digest")))
    return hex_number(F.concat(F.lit(f"{seed}:"), name, F.when(place > 0, F.concat(F.lit(":"), place.cast("string"))).otherwise("")))


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, key (see ``_row_key``), place.

    Null texts have size 0; a null source is a source of its own, after all others. Rows without words are
    taken 0 times. Ties in the hash are broken by id, size and place. Rows of one id, source and text are numbered by ``place``; they are
    counted before anything is shuffled and get hashes of their own, so no group of equal rows meets in one task. An empty table
    gives an empty result. Only doc_id, source and text are read, and the text only once: what follows runs on
    a slim written table. Running sums are made per source and hash bucket, so a hot source is spread.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", _key(F.col("source")).alias("sk"), F.size(words(F.col("text"))).cast("long").alias("size"),
        F.when(F.col("doc_id").isNull(), F.sha2(text, 256)).alias("digest"), _row_key().alias("key"),
    )
    counted = slim.groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("doc_id", "source", "sk", "size", "digest")], F.count("*").alias("rows"))
    # equal rows are made again from their number; stretches of a large group go to other tasks
    columns = ["key", "doc_id", "source", "sk", "size", "digest"]
    long = lambda n: F.lit(n).cast("long")
    few = counted.where(F.col("rows") <= STRETCH).select(*columns, F.explode(F.sequence(long(0), F.col("rows") - 1)).alias("place"))
    many = counted.where(F.col("rows") > STRETCH).select(*columns, "rows", F.explode(F.sequence(long(0), F.col("rows") - 1, long(STRETCH))).alias("start")).repartition("key", "start")
    slim = few.unionByName(many.select(*columns, F.explode(F.sequence(F.col("start"), F.least(F.col("start") + STRETCH, F.col("rows")) - 1)).alias("place")))
    slim = slim.select("key", "doc_id", "source", "sk", "size", "place", _spot(seed, F.col("place")).alias("h"))
    slim = written(slim.withColumn("hb", F.floor(F.col("h") / F.lit((1 << 60) // BUCKETS)).cast("int")), "mix-sizes")
    parts = written(slim.groupBy("sk", "source", "hb").agg(F.sum("size").alias("n")), "mix-parts")
    targets = source_targets(parts.groupBy("sk", "source").agg(F.sum("n").alias("source_size")), share, weights)
    budget = share * (parts.agg(F.sum("n")).first()[0] or 0)
    earlier = Window.partitionBy("sk").orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("sk", "hb", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")).join(targets, "sk")
    inside = Window.partitionBy("sk", "hb").orderBy("h", "doc_id", "size", "place").rowsBetween(Window.unboundedPreceding, 0)
    queue = slim.withColumn("inside", F.sum("size").over(inside)).join(offsets, ["sk", "hb"])
    queue = queue.select("doc_id", "key", "place", "size", "sk", "h", "source_size", "target", (F.col("offset") + F.col("inside")).alias("cum"))
    queue = written(queue, "mix-queue")

    def finish(copy: int) -> Column:
        return F.when(F.col("target") > 0, (F.lit(copy) * F.col("source_size") + F.col("cum")) / F.col("target"))

    def order(time: Column) -> Column:
        return F.struct(
            time.alias("t"), F.col("sk").alias("sk"), F.col("h").alias("h"),
            F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("cum").alias("c"),
        )

    served = queue.where("size > 0").select("size", "sk", "h", "doc_id", "cum", F.explode(F.array(*[finish(k) for k in range(COPIES)])).alias("time"))
    mark = _last_served(served, order, budget)

    def taken_copy(time: Column) -> Column:
        if mark is None:
            return F.lit(False)
        if mark is ALL:
            return F.lit(True)
        return order(time) <= F.struct(F.lit(mark.t), F.lit(mark.sk), *(F.lit(x).cast("long") for x in (mark.h, mark.d, mark.c)))

    copies = sum((F.when((F.col("size") > 0) & taken_copy(finish(k)), 1).otherwise(0) for k in range(COPIES)), F.lit(0))
    return queue.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies"), "key", "place")


ALL = "all"


def _last_served(served: DataFrame, order, budget: float):
    """The last place in the order up to which sizes sum to ``budget`` at most; None if not even the first fits, ALL if all do.

    Virtual time is cut into steps, whose sums are made map-side; the step in which the budget ends is cut again, until so
    few rows are left in it that they can be served one by one.
    """
    low, high, spent = 0.0, float(LAST_UNIT), 0
    served = served.where("time IS NOT NULL")
    rest = served
    for _ in range(DEEPEST):
        step = F.least(F.greatest(F.floor((F.col("time") - F.lit(low)) / F.lit((high - low) / BUCKETS)), F.lit(0)), F.lit(BUCKETS)).cast("long")
        steps = rest.groupBy(step.alias("step")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.max("time").alias("latest"), F.min("time").alias("earliest"))
        running = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # BUCKETS + 1 rows
        over = steps.withColumn("cum", F.sum("n").over(running) + F.lit(spent)).where(F.col("cum") > budget).orderBy("step").first()
        if over is None:
            return ALL  # of the first steps only: a step that is cut again holds the end of the budget
        spent = over.cum - over.n
        rest = served.where(F.col("time").between(over.earliest, over.latest))
        low, high = over.earliest, over.latest
        if over.rows <= ONE_BY_ONE or low == high:
            break
    line = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    last = rest.select("size", order(F.col("time")).alias("place")).withColumn("cum", F.sum("size").over(line) + F.lit(spent)).where(F.col("cum") <= budget).agg(F.max("place")).first()[0]
    if last is None and spent:  # the step's first row is already too much: all before it is served
        last = served.where(F.col("time") < F.lit(low)).agg(F.max(order(F.col("time")))).first()[0]
    return last


def mixed(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: the rows of ``docs`` that it takes, each as often as it is taken.

    Every row is served by itself. Rows of one id, source and text that differ in other columns are numbered in the order of
    these, so that each has a place in the queue; no row stands for another.
    """
    taken = written(mix(docs, share, weights).select("key", "place", "copies"), "mix-taken")
    again = written(taken.where("place = 1").select("key"), "mix-again")
    rows = docs.select(_row_key().alias("_key"), F.struct(*docs.columns).alias("_row"))
    if again.isEmpty():
        served = rows.join(taken.where("copies > 0"), F.col("_key") == F.col("key"))
        return served.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
    single = rows.join(again, F.col("_key") == F.col("key"), "left_anti").join(taken.where("copies > 0"), F.col("_key") == F.col("key")).select("_row", "copies")
    # rows that share a key: equal ones are counted, different ones numbered behind each other
    shared = rows.join(again, F.col("_key") == F.col("key"), "left_semi").groupBy("_key", F.sha2(F.to_json("_row"), 256).alias("_kind")).agg(F.any_value("_row").alias("_row"), F.count("*").alias("n"))
    before = Window.partitionBy("_key").orderBy("_kind").rowsBetween(Window.unboundedPreceding, -1)
    shared = shared.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    places = shared.select("_key", "_row", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("place"))
    several = places.join(taken.where("copies > 0").withColumnRenamed("key", "_key"), ["_key", "place"]).select("_row", "copies")
    return single.unionByName(several).select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("copies", "key", "place")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'null') AS sk,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(doc_id::VARCHAR, 't' || sha256(coalesce(text, ''))) AS name,
         row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS place
  FROM documents),
s AS (SELECT sk, source, sum(size)::BIGINT AS source_size FROM d GROUP BY sk, source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, ([3, 1, 2])[((rank - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT
             - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM w),
t AS (SELECT sk, source_size, CASE WHEN level * w >= cap THEN cap
        ELSE (max(CASE WHEN level * w < cap THEN level END) OVER ()) * w END AS target FROM l),
h AS (SELECT row_number() OVER () AS rid, *, ('0x' || substr(md5('mix:' || name || CASE WHEN place > 0 THEN ':' || place ELSE '' END), 1, 15))::BIGINT AS h FROM d),
q AS (SELECT h.rid, h.doc_id, h.size, h.sk, h.h, t.source_size, t.target,
        (sum(size) OVER (PARTITION BY h.sk ORDER BY h, doc_id, size, place ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM h JOIN t USING (sk)),
c AS (SELECT q.*, copy, (copy * source_size + cum)::DOUBLE / target AS f FROM q, (VALUES (0), (1)) v(copy) WHERE size > 0),
o AS (SELECT rid, sum(size) OVER (ORDER BY f, sk, h, doc_id, cum ROWS UNBOUNDED PRECEDING) AS total FROM c),
k AS (SELECT rid, count(*) AS copies FROM o WHERE total <= 1.5 * (SELECT sum(size) FROM d) GROUP BY rid)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(k.copies, 0))::BIGINT AS taken
FROM q LEFT JOIN k USING (rid)
"""

QUERIES = {"op10_mixing": query}
ORACLE_SQL = {"op10_mixing": SQL}
