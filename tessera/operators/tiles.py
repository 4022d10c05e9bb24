"""Tile geometry, overlap blending and row assembly.

Jobs (see plans.standin) stand for images; a pixel's value is arithmetic on its place, as there is no image data.
Tiles are made by exploding two sequences per image, so every tile is a row of its own and images never meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import planning as P
from tessera.functions import rasters as R
from tessera.operators.planning import CHAINS
from tessera.plans.standin import JOBS, jobs, table

c = F.col
TILE = 256


def dealt(images: DataFrame) -> DataFrame:
    """Images dealt over tasks before they are cut. A table of images is so small that one task may read it, and tiles stay where their
    image is."""
    return images.repartition(max(32, 4 * images.sparkSession.sparkContext.defaultParallelism), "id")


def overlapping(images: DataFrame, tile: int, overlap: int = P.OVERLAP, keep: Sequence[str] = ()) -> DataFrame:
    """One row per tile of images (id, w, h): tile_no in row-major order, x, y, tw, th. An image that fits is one tile.

    ``keep``: columns of the image that its tiles have too, so that they need not be joined with it."""
    t = F.lit(tile)
    fits = (c("w") <= tile) & (c("h") <= tile)
    starts = lambda n: F.when(fits, F.array(F.lit(0))).otherwise(P.axis_starts(c(n), t, overlap))
    whole = dict.fromkeys(("id", "w", "h", *keep))
    rows = images.select(*whole, F.posexplode(starts("h")).alias("row", "y"), starts("w").alias("xs"))
    cells = rows.select(*whole, "row", "y", F.size("xs").alias("cols"), F.posexplode("xs").alias("col", "x"))
    return cells.select(
        "id", (c("row") * c("cols") + c("col")).alias("tile_no"), "x", "y",
        F.least(F.lit(tile), c("w") - c("x")).cast("int").alias("tw"), F.least(F.lit(tile), c("h") - c("y")).cast("int").alias("th"), *keep,
    )


def grid(images: DataFrame, tile: int = TILE, keep: Sequence[str] = ()) -> DataFrame:
    """Tiles without overlap: band, col, x, y, tw, th, and the columns of the image in ``keep``."""
    whole = dict.fromkeys(("id", "w", "h", *keep))
    rows = images.select(*whole, F.posexplode(F.sequence(F.lit(0), c("h") - 1, F.lit(tile))).alias("band", "y"))
    cells = rows.select(*whole, "band", "y", F.posexplode(F.sequence(F.lit(0), c("w") - 1, F.lit(tile))).alias("col", "x"))
    return cells.select("id", "band", "col", "x", "y", F.least(F.lit(tile), c("w") - c("x")).cast("int").alias("tw"), F.least(F.lit(tile), c("h") - c("y")).cast("int").alias("th"), *keep)


def tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapping(jobs(spark, sf_dir), 1376)


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles, columns and height of every band, and the share of tiles done when the band is finished."""
    g = grid(jobs(spark, sf_dir))
    bands = g.groupBy("id", "band").agg(F.count("*").alias("tiles"), F.max("th").alias("band_h"), F.sum(c("tw").cast("long") * c("th")).alias("pixels"))
    w = Window.partitionBy("id")
    done = F.sum("tiles").over(w.orderBy("band").rowsBetween(Window.unboundedPreceding, 0))
    return bands.select("id", "band", "tiles", "band_h", "pixels", F.round(done / F.sum("tiles").over(w), 6).alias("progress"))


def job_tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs joined to their engines: path, chain length, and tiles by path and engine. supplier stands for the engines."""
    engines = table(spark, sf_dir, "supplier").select(F.concat(F.lit("e"), c("s_suppkey").cast("string")).alias("engine"), c("s_name").alias("engine_name"))
    j = jobs(spark, sf_dir).join(engines, "engine", "left")
    j = j.withColumn("path", P.select_path(c("base"), c("target"), c("allow"))).withColumn("chain", P.chain_count(c("base"), c("target")))
    j = j.withColumn("tiles", F.ceil(c("w") / TILE) * F.ceil(c("h") / TILE))
    name = F.coalesce("engine_name", F.lit("missing"))
    return j.groupBy(name.alias("engine"), "path").agg(F.count("*").alias("jobs"), F.sum("tiles").alias("tiles"), F.sum(c("tiles") * c("chain")).cast("long").alias("inferences"))


def owned(tiles: DataFrame, tile: int, overlap: int = P.OVERLAP) -> DataFrame:
    """Tiles of ``overlapping`` with the part of each that no later one covers (own_w, own_h), as tiles are painted in order.

    Tiles to the right and below are painted later, so a tile keeps what lies before the next column and the next row: a rectangle.
    Every pixel of an image belongs to one tile, and painting needs no exchange of pixels."""
    step = tile - overlap
    own = lambda at, length, whole: F.when(c(at) + c(length) < c(whole), F.least(F.lit(step), c(length))).otherwise(c(length)).cast("int")
    return tiles.withColumns({"own_w": own("x", "tw", "w"), "own_h": own("y", "th", "h")})


def _small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few pixels per image: 3..9 wide and high."""
    return jobs(spark, sf_dir).select("id", (c("w") % 7 + 3).alias("w"), (c("h") % 7 + 3).alias("h"))


def _tile_lines(small: DataFrame) -> DataFrame:
    """Lines of the tiles of small images: id, w, tile_no, x, py and the values of the line. An image of unknown size is one tile."""
    sized = small.select("id", *(F.coalesce(x, F.lit(4)).alias(x) for x in ("w", "h"))).where("w > 0 AND h > 0")
    t = owned(overlapping(sized, 4, 2, ("w", "h")), 4, 2)
    lines = t.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), c("th") - 1), lambda dy: F.transform(F.sequence(F.lit(0), c("tw") - 1), lambda dx: (c("tile_no") * 37 + dx * 11 + dy * 5) % 256))).alias("dy", "line"))
    return lines.withColumn("py", c("y") + c("dy"))


def tile_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles painted in order: per pixel the last one stays. Each tile is cut to what it owns, so nothing is shuffled by pixel. Images of
    one id are the same and painted once."""
    lines = _tile_lines(dealt(_small(spark, sf_dir)).distinct()).where("dy < own_h")
    cells = lines.select("id", "x", "py", F.posexplode(F.slice("line", 1, c("own_w"))).alias("dx", "v"))
    return cells.select("id", (c("x") + c("dx")).alias("px"), "py", c("v").cast("int").alias("v"))


def blended_lines(lines: DataFrame) -> DataFrame:
    """(id, py, totals, counts) of overlapping lines (id, w, py, x, line): sum and number of values per pixel of an image line.

    A line is exchanged as one row per tile that meets it, not per pixel, and is gathered per image line: the tiles of a row of
    tiles and those of the row below."""
    parts = lines.groupBy("id", "py").agg(F.any_value("w").alias("w"), F.collect_list(F.struct("x", "line")).alias("parts"))
    at = lambda p, px: F.get(p["line"], (px - p["x"]).cast("int"))
    pixels = F.sequence(F.lit(0).cast("long"), c("w").cast("long") - 1)
    totals = F.transform(pixels, lambda px: F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.when(px >= p["x"], F.coalesce(at(p, px), F.lit(0))).otherwise(0)))
    counts = F.transform(pixels, lambda px: F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + ((px >= p["x"]) & (px < p["x"] + F.size(p["line"]))).cast("long")))
    return parts.select("id", "py", totals.alias("totals"), counts.alias("counts"))


def tile_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping tiles blended: sum and count per pixel, divided as integers."""
    b = blended_lines(_tile_lines(_small(spark, sf_dir))).select("id", "py", F.posexplode(F.arrays_zip("totals", "counts")).alias("px", "p"))
    return b.select("id", "px", "py", F.floor(c("p.totals") / F.greatest(c("p.counts"), F.lit(1))).cast("int").alias("v"), c("p.counts").alias("n"))


def parts_met(length: Column, part: Column, n: Column, tile: int = TILE) -> tuple[Column, Column]:
    """Of an axis of ``length`` that is cut into parts and into tiles: how many tiles the n-th part meets, and its length. Tiles lie one
    after the other from 0, so integer division gives the first and the last one."""
    start, end = n * part, F.least((n + 1) * part, length)
    return F.floor((end - 1) / tile) - F.floor(start / tile) + 1, end - start


def subcanvas_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4x4 sub-canvases, the grid tiles that overlap them, and the pixels they share. Tiles and sub-canvases are both products of their
    axes, so the range join is done axis by axis and no tile is made, shuffled or joined. Equal ids meet each other, as a join by id
    has it."""
    j = jobs(spark, sf_dir).where("w > 0 AND h > 0").select("id", "w", "h", F.ceil(c("w") / 4).cast("int").alias("sw"), F.ceil(c("h") / 4).cast("int").alias("sh"))
    j = dealt(j).groupBy("id", "w", "h", "sw", "sh").agg(F.count("*").alias("copies"))
    four = F.sequence(F.lit(0), F.lit(3))
    places = j.select("*", F.explode(four).alias("sx")).select("*", F.explode(four).alias("sy"))
    (columns, width), (rows, height) = parts_met(c("w"), c("sw"), c("sx")), parts_met(c("h"), c("sh"), c("sy"))
    met, times = places.where((width > 0) & (height > 0)), c("copies") * c("copies")
    return met.select("id", "sx", "sy", (columns * rows * times).alias("tiles"), (width.cast("long") * height * times).alias("pixels"))


def region_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles a rectangle needs: a filter on places, which reaches the scan of a table laid out by them."""
    g = grid(jobs(spark, sf_dir))
    hit = (c("x") < 1100) & (c("x") + c("tw") > 300) & (c("y") < 900) & (c("y") + c("th") > 200)
    return g.where(hit).select("id", "band", "col", (F.least(c("x") + c("tw"), F.lit(1100)) - F.greatest(c("x"), F.lit(300))).alias("cut_w"), (F.least(c("y") + c("th"), F.lit(900)) - F.greatest(c("y"), F.lit(200))).alias("cut_h"))


def tile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded read windows clamped to the image, aligned sizes, and where the result is written at the engine's scale.

    Tiles carry their image's columns. Equal ids meet each other, as a join of tiles with their images by id has it."""
    j = dealt(jobs(spark, sf_dir).where("w > 0 AND h > 0").select("id", "w", "h", "base")).groupBy("id", "w", "h", "base").agg(F.count("*").alias("copies"))
    j = j.withColumn("pad", R.tile_padding(c("base"), F.lit(0), F.lit(0)))
    for _ in range(2):
        j = j.select("*", F.explode(F.sequence(F.lit(1).cast("long"), c("copies"))).alias("copy")).drop("copy")
    g = grid(j, 192, ("w", "h", "base", "pad"))
    left, top = F.greatest(F.lit(0), c("x") - c("pad")), F.greatest(F.lit(0), c("y") - c("pad"))
    right, bottom = F.least(c("w"), c("x") + c("tw") + c("pad")), F.least(c("h"), c("y") + c("th") + c("pad"))
    return g.select(
        "id", "band", "col", left.alias("left"), top.alias("top"), R.aligned(right - left, 4).alias("in_w"), R.aligned(bottom - top, 4).alias("in_h"),
        (c("x") * c("base")).alias("out_x"), ((c("x") - left) * c("base")).alias("crop_x"), R.edge_clamped(c("x") + c("tw") + c("pad"), c("w")).alias("last_x"),
    )


def residual_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each output pixel at twice the size gets the input pixel it came from."""
    s = _small(spark, sf_dir).withColumn("row", F.sequence(F.lit(0), c("w") - 1))
    pixels = s.select("id", "w", "h", F.explode(F.sequence(F.lit(0), c("h") * 2 - 1)).alias("oy"), F.transform("row", lambda x: (x * 13 + 7) % 100).alias("line"))
    out = pixels.select("id", "oy", "line", F.explode(F.sequence(F.lit(0), c("w") * 2 - 1)).alias("ox"))
    return out.select("id", "ox", "oy", (F.get("line", F.floor(c("ox") / 2).cast("int")) + F.floor(c("oy") / 2).cast("int") + c("ox") % 3).cast("int").alias("v"))


def row_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows put together of parts that arrive in any order: a row is ready once its width is filled, and rows leave in order.

    lineitem stands for the parts: l_orderkey is the row, l_quantity the bytes."""
    parts = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("y")).agg(F.sum("l_quantity").cast("long").alias("filled"), F.count("*").alias("parts"), F.max("l_linenumber").alias("last_part"))
    return parts.where("filled >= 90").select("y", "filled", "parts", "last_part")


def stitched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per image row: its pieces by their offset, joined to a text of widths; a missing piece leaves its place empty."""
    g = grid(jobs(spark, sf_dir)).where("NOT (band = 1 AND col = 1)")
    bands = g.groupBy("id", "band").agg(F.array_sort(F.collect_list(F.struct("x", "tw"))).alias("p"), F.max("th").alias("rows"))
    text = F.array_join(F.transform("p", lambda s: F.concat_ws("+", s["x"].cast("string"), s["tw"].cast("string"))), ",")
    return bands.select("id", "band", "rows", text.alias("line"), F.aggregate("p", F.lit(0), lambda a, s: a + s["tw"]).alias("filled"))


QUERIES = {
    "tile_plan": tile_plan, "tile_grid": tile_grid, "job_tile_plan": job_tile_plan, "tile_last_writer": tile_last_writer, "tile_blend": tile_blend,
    "subcanvas_overlap": subcanvas_overlap, "region_read": region_read, "tile_windows": tile_windows, "residual_add": residual_add,
    "row_assembly": row_assembly, "stitched_rows": stitched_rows,
}


def _grid_sql(source: str, tile: int = TILE) -> str:
    return f"g AS (SELECT id, w, h, (y // {tile})::INT AS band, (x // {tile})::INT AS col, x::INT AS x, y::INT AS y, least({tile}, w - x)::INT AS tw, least({tile}, h - y)::INT AS th FROM {source}, generate_series(0, w - 1, {tile}) a(x), generate_series(0, h - 1, {tile}) b(y))"


def _overlap_sql(source: str, tile: int, overlap: int) -> str:
    s = tile - overlap
    n = lambda v: f"CASE WHEN w <= {tile} AND h <= {tile} THEN 0 ELSE greatest(0, ceil(({v} - {tile}) / {s}.0)) END::INT"
    return f"t AS (SELECT id, (j * ({n('w')} + 1) + i)::INT AS tile_no, (i * {s})::INT AS x, (j * {s})::INT AS y, least({tile}, w - i * {s})::INT AS tw, least({tile}, h - j * {s})::INT AS th FROM {source}, generate_series(0, {n('w')}) a(i), generate_series(0, {n('h')}) b(j))"


_SMALL = "s AS (SELECT id, w % 7 + 3 AS w, h % 7 + 3 AS h FROM jobs)"
_PIX = f"{JOBS}, {_SMALL}, {_overlap_sql('s', 4, 2)}, p AS (SELECT id, tile_no, (x + dx)::INT AS px, (y + dy)::INT AS py, (tile_no * 37 + dx * 11 + dy * 5) % 256 AS v FROM t, generate_series(0, tw - 1) a(dx), generate_series(0, th - 1) b(dy))"

ORACLE_SQL = {
    "tile_plan": f"WITH {JOBS}, {_overlap_sql('jobs', 1376, 32)} SELECT * FROM t",
    "tile_grid": f"""WITH {JOBS}, {_grid_sql('jobs')}, b AS (SELECT id, band, count(*) AS tiles, max(th) AS band_h, sum(tw::BIGINT * th)::BIGINT AS pixels FROM g GROUP BY 1, 2)
SELECT id, band, tiles, band_h, pixels, round((sum(tiles) OVER (PARTITION BY id ORDER BY band))::DOUBLE / sum(tiles) OVER (PARTITION BY id), 6) AS progress FROM b""",
    "job_tile_plan": f"""WITH {JOBS}, p AS (SELECT coalesce(s_name, 'missing') AS engine, CASE WHEN target = base THEN 'BASIC' WHEN target > base THEN 'CHAIN' WHEN allow THEN 'BASIC_DOWNSCALE' ELSE 'BASIC' END AS path,
  ceil(w / 256.0)::BIGINT * ceil(h / 256.0)::BIGINT AS tiles, {CHAINS} AS chain
  FROM jobs LEFT JOIN supplier ON engine = 'e' || s_suppkey)
SELECT engine, path, count(*) AS jobs, sum(tiles)::BIGINT AS tiles, sum(tiles * chain)::BIGINT AS inferences FROM p GROUP BY 1, 2""",
    "tile_last_writer": f"WITH {_PIX} SELECT id, px, py, arg_max(v, tile_no)::INT AS v FROM p GROUP BY 1, 2, 3",
    "tile_blend": f"WITH {_PIX} SELECT id, px, py, (sum(v) // count(*))::INT AS v, count(*) AS n FROM p GROUP BY 1, 2, 3",
    "subcanvas_overlap": f"""WITH {JOBS}, j AS (SELECT id, w, h, ceil(w / 4.0)::INT AS sw, ceil(h / 4.0)::INT AS sh FROM jobs), {_grid_sql('j')}
SELECT id, sx::INT AS sx, sy::INT AS sy, count(*) AS tiles, sum((least(x + tw, (sx + 1) * sw) - greatest(x, sx * sw))::BIGINT * (least(y + th, (sy + 1) * sh) - greatest(y, sy * sh)))::BIGINT AS pixels
FROM g JOIN j USING (id), range(4) a(sx), range(4) b(sy) WHERE x < (sx + 1) * sw AND x + tw > sx * sw AND y < (sy + 1) * sh AND y + th > sy * sh GROUP BY 1, 2, 3""",
    "region_read": f"WITH {JOBS}, {_grid_sql('jobs')} SELECT id, band, col, least(x + tw, 1100) - greatest(x, 300) AS cut_w, least(y + th, 900) - greatest(y, 200) AS cut_h FROM g WHERE x < 1100 AND x + tw > 300 AND y < 900 AND y + th > 200",
    "tile_windows": f"""WITH {JOBS}, j AS (SELECT id, w, h, base, CASE base WHEN 3 THEN 14 WHEN 4 THEN 19 ELSE 18 END AS pad FROM jobs), {_grid_sql('jobs', 192)},
p AS (SELECT g.*, base, pad, greatest(0, x - pad) AS l, greatest(0, y - pad) AS t, least(g.w, x + tw + pad) AS r, least(g.h, y + th + pad) AS b FROM g JOIN j USING (id))
SELECT id, band, col, l AS "left", t AS top, ((r - l + 3) // 4 * 4)::INT AS in_w, ((b - t + 3) // 4 * 4)::INT AS in_h, x * base AS out_x, (x - l) * base AS crop_x, greatest(0, least(w - 1, x + tw + pad)) AS last_x FROM p""",
    "residual_add": f"WITH {JOBS}, {_SMALL} SELECT id, ox::INT AS ox, oy::INT AS oy, ((ox // 2 * 13 + 7) % 100 + oy // 2 + ox % 3)::INT AS v FROM s, generate_series(0, w * 2 - 1) a(ox), generate_series(0, h * 2 - 1) b(oy)",
    "row_assembly": "SELECT l_orderkey AS y, sum(l_quantity)::BIGINT AS filled, count(*) AS parts, max(l_linenumber) AS last_part FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 90",
    "stitched_rows": f"""WITH {JOBS}, {_grid_sql('jobs')} SELECT id, band, max(th) AS rows, string_agg(x || '+' || tw, ',' ORDER BY x) AS line, sum(tw)::INT AS filled FROM g WHERE NOT (band = 1 AND col = 1) GROUP BY 1, 2""",
}
