"""Queries over pixels, tensors and codec blocks.

lineitem's keys stand for packed pixels and embeddings for tensors and coefficient blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import rasters as R
from tessera.plans.standin import table

c = F.col


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = (c("l_orderkey") * 2654435761 + c("l_linenumber") * 40503 + c("l_partkey") * 131) % 4294967296
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", mixed.alias("p64"))
    return p.withColumn("p", F.when(c("p64") >= 2147483648, c("p64") - 4294967296).otherwise(c("p64")).cast("int"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8x8 blocks of small integers, in place order."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 40 + F.lit(0.5)).cast("int")).alias("q"))


def pixel_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of a packed pixel, its grey value, and the pixel put together again with red and blue exchanged."""
    p = _pixels(spark, sf_dir)
    a, r, g, b = (R.channel(c("p"), s) for s in (24, 16, 8, 0))
    return p.select("l_orderkey", "l_linenumber", a.alias("a"), r.alias("r"), g.alias("g"), b.alias("b"), R.grey(r, g, b).alias("grey"), R.packed(a, b, g, r).alias("swapped"))


def tensor_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised input, and the output as bytes: truncated, rounded, as a residual on top of the input, and of a network on 0..255."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", c("x").cast("double"))
    v = F.floor(F.abs(c("x")) * 255)
    return e.select(
        "vec_id", "i", F.round(R.normalised(v, 0.5, 0.25), 6).alias("input"), R.normalised(v, 0.5, 0.25, wide=True).alias("wide_input"), R.to_byte(R.denormalised(c("x"), 0.5, 2.0)).alias("truncated"),
        R.to_byte(R.denormalised(c("x"), 0.5, 2.0), rounded=True).alias("rounded"), R.to_byte(R.denormalised(c("x"), 0.0, 1.0, source=v / 255)).alias("residual"),
        R.to_byte(R.denormalised(c("x") * 400, 0.0, 1.0, wide=True)).alias("wide"),
    )


def tensor_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tensor of 16 x 4 or 21 x 3 (the rest cut), by whether its last dimension is the channel, as its planes; clamped neighbours,
    sizes brought to a multiple, and the border of tiles."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(c("vec_id") % 2 == 0, 3).otherwise(4).alias("last"))
    rows = F.floor(F.lit(64) / c("last")).cast("int")
    nested = F.transform(F.sequence(F.lit(0), rows - 1), lambda k: F.slice("embedding", k * c("last") + 1, c("last")))
    e = e.withColumn("flat", R.flattened(nested, rows * c("last"))).select("*", F.posexplode("flat").alias("i", "x"))
    plane = F.when(R.interleaved(c("last")), (c("i") % 3) * 21 + F.floor(c("i") / 3)).otherwise(c("i"))
    ch, y, x = F.floor(c("i") / 16).cast("int"), F.floor(c("i") % 16 / 4).cast("int"), c("i") % 4
    right = ch * 16 + y * 4 + R.edge_clamped(x + 1, F.lit(4))
    scale, probed, asked = c("vec_id") % 4 + 1, F.when(c("i") % 3 == 0, c("i")), c("i") % 17
    return e.select(
        "vec_id", "i", plane.cast("int").alias("planar"), F.get("embedding", right).cast("double").alias("right"),
        R.aligned(c("i") + c("vec_id"), 4).alias("aligned4"), R.aligned(c("i") + c("vec_id"), 2).alias("aligned2"), R.tile_padding(scale, probed, asked).alias("padding"),
    )


def abs_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of |v * s + m| over a tensor, mean and largest |v| of its first three planes, and the domain they imply.

    The tensor is brought to a size by vec_id, as outputs of different kinds of networks would have."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    mean = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(f(v.cast("double")))) / F.size(a)
    size = F.element_at(F.array(F.lit(2.0), F.lit(0.01), F.lit(0.001)), (c("vec_id") % 3 + 1).cast("int"))
    half, wide = mean(c("embedding"), lambda v: v * size * 0.5 + 0.001), mean(c("embedding"), lambda v: v * size * 1000)
    planes = F.slice("embedding", 1, 48)
    return e.select(
        "vec_id", F.round(half, 6).alias("mean_denorm"), F.round(mean(planes, lambda v: v), 6).alias("mean_abs"),
        F.round(F.array_max(F.transform(planes, lambda v: F.abs(v.cast("double")))), 6).alias("max_abs"), R.domain_probe(half, wide).alias("domain"),
    )


def size_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and crop of a model from two probe runs, by the rules of both runtimes; part's keys stand for the sizes that came out.

    One works with whole crops only and without tiles where there are any. The other keeps every crop, as pixels of the input, and
    half of it as a border."""
    k = c("id")
    runs = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.explode(F.array(F.lit(64), F.lit(96))).alias("t"))
    true_scale, crop = (k % 5), (k % 4) * (k % 5) + F.when(k % 7 == 0, 5).otherwise(0)
    runs = runs.withColumn("out", (c("t") * true_scale - crop).cast("int"))
    w = Window.partitionBy("id").orderBy("t")
    two = runs.select("id", "t", "out", F.lag("t").over(w).alias("t1"), F.lag("out").over(w).alias("o1")).where(c("t1").isNotNull())
    est = (c("out") - c("o1")) / (c("t") - c("t1"))
    two = two.withColumn("est", est).withColumn("valid", c("est").between(1, 16))
    scale = F.when(c("valid"), c("est").cast("int")).otherwise(4)
    rest = F.greatest(F.lit(0), c("t1") * scale - c("o1"))
    crop = F.when(c("valid") & (rest % scale == 0), rest).otherwise(0).cast("int")
    native = lambda v: F.when(c("valid"), F.greatest(F.lit(0), F.round(v).cast("int"))).otherwise(0)
    lost = c("t1") * c("est") - c("o1")
    return two.select(
        "id", F.round("est", 6).alias("estimate"), scale.cast("int").alias("scale"), crop.alias("k"), (~c("valid") | (crop > 0)).alias("whole_image"),
        native(lost).alias("native_k"), native(lost / c("est")).alias("native_crop"), F.floor(native(lost / c("est")) / 2).cast("int").alias("native_pad"),
    )


def ycbcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, cb, cr = R.luma(*(R.channel(c("p"), s).cast("double") for s in (16, 8, 0)))
    return _pixels(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(y, 4).alias("y"), F.round(cb, 4).alias("cb"), F.round(cr, 4).alias("cr"))


def quant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scaled quantisation tables for every quality of part.p_size times two."""
    q = table(spark, sf_dir, "part").select(F.least(F.lit(100), F.greatest(F.lit(1), c("p_size") * 2)).cast("int").alias("quality")).distinct()
    rows = q.select("quality", F.posexplode(F.arrays_zip(F.array(*map(F.lit, R.LUMINANCE)).alias("l"), F.array(*map(F.lit, R.CHROMINANCE)).alias("k"))).alias("place", "t"))
    return rows.select("quality", "place", R.quant_step(c("t.l"), c("quality")).alias("luminance"), R.quant_step(c("t.k"), c("quality")).alias("chrominance"))


def block_dct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 transform of every block, quantised by half-up rounding, in zigzag order: one row per place."""
    m = R.dct_matrix()
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    # both passes are sums of products written out as SQL text: one expression a value, the array before it bound once
    across = ", ".join(" + ".join(f"{m[u][x]!r}D * a[{y * 8 + x}]" for x in range(8)) for y in range(8) for u in range(8))
    down = ", ".join(" + ".join(f"{m[v][y]!r}D * a[{y * 8 + u}]" for y in range(8)) for v in range(8) for u in range(8))
    zigzag = ", ".join(f"struct({z} AS z, a[{z}] AS v)" for z in R.zigzag())
    e = e.select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 255).alias("b"))
    passes = "array(b)"
    for step in (across, down, zigzag):
        passes = f"transform({passes}, a -> array({step}))"
    e = e.select("vec_id", F.expr(f"{passes}[0]").alias("f"))
    zig = e.select("vec_id", F.posexplode("f").alias("k", "s"))
    return zig.select("vec_id", "k", c("s.z").alias("place"), F.round("s.v", 3).alias("coefficient"), R.half_up(F.round(c("s.v") / 16, 6)).cast("int").alias("quantised"))


def differences(blocks: DataFrame, stretch: int = 1 << 16) -> DataFrame:
    """(comp, number, diff): DC coefficients less the one before, 0 before the first, of blocks (comp, number, dc).

    A component is as long as its image, so it is cut into stretches by number: blocks look back within their stretch, and the
    first of each takes the last of the stretch before from a table with one row per stretch."""
    cut = blocks.withColumn("part", F.floor(c("number") / stretch))
    lasts = cut.groupBy("comp", "part").agg(F.max_by("dc", "number").alias("dc"))
    lasts = lasts.select("comp", "part", F.lag("dc", 1, 0).over(Window.partitionBy("comp").orderBy("part")).alias("before"))
    inner = F.lag("dc").over(Window.partitionBy("comp", "part").orderBy("number"))
    return cut.withColumn("inner", inner).join(lasts, ["comp", "part"]).select("comp", "number", (c("dc") - F.coalesce("inner", "before")).alias("diff"))


def dc_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC differences over the blocks of a component (label), with their magnitude categories."""
    e = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("number"), c("label").alias("comp"), F.floor(F.get("embedding", F.lit(0)).cast("double") * 100).cast("int").alias("dc"))
    d = differences(e, 256)
    return d.select(c("number").alias("vec_id"), "diff", R.magnitude(c("diff")).cast("int").alias("bits"))


def ac_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nonzero AC coefficients with the zeros before them, as (zrl, run, bits) symbols; k = 64 marks an end of block."""
    z = _levels(spark, sf_dir).select("vec_id", F.posexplode("q").alias("k", "v")).where("k > 0")
    w = Window.partitionBy("vec_id").orderBy("k")
    before = F.coalesce(F.max(F.when(c("v") != 0, c("k"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nonzero = z.withColumn("run", c("k") - before - 1).where("v <> 0")
    symbols = nonzero.select("vec_id", "k", "v", F.floor(c("run") / 16).cast("int").alias("zrl"), (c("run") % 16).cast("int").alias("run"), R.magnitude(c("v")).cast("int").alias("bits"))
    ends = z.groupBy("vec_id").agg(F.coalesce(F.max(F.when(c("v") != 0, c("k"))), F.lit(0)).alias("last")).where("last < 63")
    return symbols.unionByName(ends.select("vec_id", F.lit(64).alias("k"), F.lit(0).alias("v"), F.lit(0).alias("zrl"), F.lit(0).alias("run"), F.lit(0).alias("bits")))


def row_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of documents' UTF-8 bytes, as the chunks of an image file carry it (no SQL: the oracle has no CRC)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.crc32(F.coalesce(c("text"), F.lit("")).cast("binary")).alias("crc"))


QUERIES = {
    "pixel_pack": pixel_pack, "tensor_scaling": tensor_scaling, "tensor_layout": tensor_layout, "abs_statistics": abs_statistics, "size_probe": size_probe,
    "ycbcr": ycbcr, "quant_tables": quant_tables, "block_dct": block_dct, "dc_differences": dc_differences, "ac_runs": ac_runs, "row_checksums": row_checksums,
}

_P = "p AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 2654435761 + l_linenumber * 40503 + l_partkey * 131) % 4294967296 AS p FROM lineitem), " \
     "x AS (SELECT l_orderkey, l_linenumber, p, (p >> 24)::INT AS a, ((p >> 16) & 255)::INT AS r, ((p >> 8) & 255)::INT AS g, (p & 255)::INT AS b FROM p)"
_BYTE = "greatest(0, least(255, trunc(({v}) * 255)))::INT"
_CATEGORY = "CASE WHEN {v} = 0 THEN 0 ELSE length(ltrim(bin(abs({v})::BIGINT), '0')) END"

ORACLE_SQL = {
    "pixel_pack": f"WITH {_P}, s AS (SELECT *, a::BIGINT * 16777216 + b * 65536 + g * 256 + r AS s FROM x) SELECT l_orderkey, l_linenumber, a, r, g, b, ((r + g + b) // 3)::INT AS grey, (CASE WHEN s >= 2147483648 THEN s - 4294967296 ELSE s END)::INT AS swapped FROM s",
    "tensor_scaling": f"""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), v AS (SELECT *, floor(abs(x) * 255) AS v FROM e)
SELECT vec_id, i::INT AS i, round((v / 255.0::DOUBLE - 0.5::DOUBLE) / 0.25::DOUBLE, 6) AS input, v::DOUBLE AS wide_input, {_BYTE.format(v="x * 2 + 0.5::DOUBLE")} AS truncated,
  greatest(0, least(255, round((x * 2 + 0.5::DOUBLE) * 255)))::INT AS rounded, {_BYTE.format(v="v / 255 + x")} AS residual, {_BYTE.format(v="x * 400 / 255.0::DOUBLE")} AS wide FROM v""",
    "tensor_layout": """WITH e AS (SELECT vec_id, embedding, unnest(range(CASE WHEN vec_id % 2 = 0 THEN 63 ELSE 64 END))::INT AS i FROM embeddings)
SELECT vec_id, i, (CASE WHEN vec_id % 2 = 0 THEN i % 3 * 21 + i // 3 ELSE i END)::INT AS planar, embedding[i // 4 * 4 + least(3, i % 4 + 1) + 1]::DOUBLE AS "right",
  ((i + vec_id + 3) // 4 * 4)::INT AS aligned4, ((i + vec_id + 1) // 2 * 2)::INT AS aligned2,
  greatest(CASE vec_id % 4 WHEN 1 THEN 18 WHEN 2 THEN 14 WHEN 3 THEN 19 ELSE 18 END, CASE WHEN i % 3 = 0 THEN i ELSE 0 END, i % 17)::INT AS padding FROM e""",
    "abs_statistics": """WITH e AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0.01 ELSE 0.001 END::DOUBLE AS f, [x::DOUBLE for x in embedding] AS e FROM embeddings WHERE len(embedding) = 64),
s AS (SELECT vec_id, list_avg([abs(x * f * 0.5::DOUBLE + 0.001::DOUBLE) for x in e]) AS d, list_avg([abs(x * f * 1000) for x in e]) AS w, [abs(x) for x in e[1:48]] AS p FROM e)
SELECT vec_id, round(d, 6) AS mean_denorm, round(list_avg(p), 6) AS mean_abs, round(list_max(p), 6) AS max_abs, CASE WHEN d >= 0.05 THEN 'full 0..1' WHEN w >= 1 THEN 'full 0..255' ELSE 'residual' END AS domain FROM s""",
    "size_probe": """WITH b AS (SELECT p_partkey AS id, (p_partkey % 4) * (p_partkey % 5) + CASE WHEN p_partkey % 7 = 0 THEN 5 ELSE 0 END AS crop FROM part), o AS (SELECT id, 64 * (id % 5) - crop AS o1, 96 * (id % 5) - crop AS o2 FROM b),
e AS (SELECT *, (o2 - o1) / 32.0::DOUBLE AS est FROM o), s AS (SELECT *, est BETWEEN 1 AND 16 AS ok, (CASE WHEN est BETWEEN 1 AND 16 THEN trunc(est) ELSE 4 END)::INT AS scale FROM e),
k AS (SELECT *, (CASE WHEN ok AND greatest(0, 64 * scale - o1) % scale = 0 THEN greatest(0, 64 * scale - o1) ELSE 0 END)::INT AS k, (CASE WHEN ok THEN greatest(0, round((64 * est - o1) / est)) ELSE 0 END)::INT AS nc FROM s)
SELECT id, round(est, 6) AS estimate, scale, k, NOT ok OR k > 0 AS whole_image, (CASE WHEN ok THEN greatest(0, round(64 * est - o1)) ELSE 0 END)::INT AS native_k, nc AS native_crop, nc // 2 AS native_pad FROM k""",
    "ycbcr": f"""WITH {_P} SELECT l_orderkey, l_linenumber, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b - 128, 4) AS y,
  round(-0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b, 4) AS cb, round(0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b, 4) AS cr FROM x""",
    "quant_tables": f"""WITH q AS (SELECT DISTINCT least(100, greatest(1, p_size * 2))::INT AS quality FROM part), s AS (SELECT quality, CASE WHEN quality < 50 THEN 5000 // quality ELSE 200 - 2 * quality END AS s FROM q)
SELECT quality, i::INT AS place, greatest(1, least(255, (({list(R.LUMINANCE)})[i + 1] * s + 50) // 100))::INT AS luminance, greatest(1, least(255, (({list(R.CHROMINANCE)})[i + 1] * s + 50) // 100))::INT AS chrominance FROM s, range(64) r(i)""",
    "block_dct": f"""WITH m(u, x, a) AS (SELECT u, x, (CASE WHEN u = 0 THEN sqrt(0.125::DOUBLE) ELSE 0.5 END) * cos((2 * x + 1) * u * pi() / 16) FROM range(8) a(u), range(8) b(x)),
e AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1) AS i, unnest(embedding)::DOUBLE * 255 AS v FROM embeddings),
t AS (SELECT vec_id, i // 8 AS y, u, sum(v * a) AS v FROM e JOIN m ON x = i % 8 GROUP BY 1, 2, 3),
f AS (SELECT vec_id, m.u AS v, t.u AS u, sum(t.v * a) AS c FROM t JOIN m ON m.x = t.y GROUP BY 1, 2, 3),
z AS (SELECT (row_number() OVER (ORDER BY v + u, CASE WHEN (v + u) % 2 = 1 THEN v ELSE -v END) - 1)::INT AS k, v, u FROM range(8) a(v), range(8) b(u))
SELECT vec_id, k, (v * 8 + u)::INT AS place, round(c, 3) AS coefficient, floor(round(c / 16, 6) + 0.5)::INT AS quantised FROM f JOIN z USING (v, u)""",
    "dc_differences": f"""WITH e AS (SELECT vec_id, label, floor(embedding[1]::DOUBLE * 100)::INT AS dc FROM embeddings), d AS (SELECT vec_id, dc - lag(dc, 1, 0) OVER (PARTITION BY label ORDER BY vec_id) AS diff FROM e)
SELECT vec_id, diff, ({_CATEGORY.format(v="diff")})::INT AS bits FROM d""",
    "ac_runs": f"""WITH e AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS k, floor(unnest(embedding)::DOUBLE * 40 + 0.5::DOUBLE)::INT AS v FROM embeddings), z AS (SELECT * FROM e WHERE k > 0),
r AS (SELECT vec_id, k, v, k - 1 - coalesce(max(CASE WHEN v <> 0 THEN k END) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM z)
SELECT vec_id, k, v, (run // 16)::INT AS zrl, (run % 16)::INT AS run, ({_CATEGORY.format(v="v")})::INT AS bits FROM r WHERE v <> 0
UNION ALL SELECT vec_id, 64, 0, 0, 0, 0 FROM z GROUP BY vec_id HAVING coalesce(max(CASE WHEN v <> 0 THEN k END), 0) < 63""",
}
