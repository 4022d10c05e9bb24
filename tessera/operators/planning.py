"""Queries over the planning functions; part stands in for the job table (see plans.standin)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import planning as P
from tessera.plans.standin import JOBS, jobs, table

c = F.col


def path_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, power test, chain length, factor and the corrected final size of every job."""
    j = jobs(spark, sf_dir)
    args = (c("base"), c("target"), c("allow"))
    return j.select(
        "id", P.select_path(*args).alias("path"), P.is_power_of(c("base"), c("target")).alias("is_power"),
        P.chain_count(c("base"), c("target")).cast("int").alias("chain"), P.factor(*args).cast("int").alias("factor"),
        (c("w") * c("target")).alias("final_w"), (c("h") * c("target")).alias("final_h"),
        (P.factor(*args) != c("target")).alias("resized"),
    )


def quality_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    return j.select(
        "id", P.direct_quality(c("q")).alias("direct"), P.png_level(c("q")).alias("png"), P.heic_crf(c("q")).alias("crf"),
        P.avif_cq(c("q")).alias("cq"), F.round(P.jxl_distance(c("q")), 6).alias("distance"),
        F.round(P.estimate_output_mb(c("fmt"), c("q"), c("w").cast("long") * c("h")), 6).alias("size_mb"),
    )


def format_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoder limits, the format that is written, its MIME type and whether an API level supports it."""
    j = jobs(spark, sf_dir).withColumn("api", (26 + c("id") % 6).cast("int"))
    written = P.written_format(c("w"), c("h"), c("target"), c("fmt"))
    return j.select(
        "id", P.over_encoder_limit(c("w"), c("h"), c("target"), c("fmt")).alias("over_limit"), written.alias("written"),
        P.lookup(P.MIME, written).alias("mime"), (~c("fmt").isin("heic", "heif") | (c("api") >= 28)).alias("supported"),
        F.when(c("fmt").isin("jpeg", "png", "webp"), F.upper("fmt")).alias("platform_format"),
    )


def memory_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device budget, tile edge, estimated peak and decode strategy; the engine number stands for the device."""
    j = jobs(spark, sf_dir).withColumn("heap", (c("id") % 11) * 64 + 96).withColumn("large", c("heap") * 2 + 128)
    j = j.withColumn("budget", P.device_budget_mb(c("heap"), c("large"))).withColumn("tile", P.max_tile_edge(c("budget")))
    unknown = F.when(c("id") % 13 == 0, 0)
    return j.select(
        "id", "budget", "tile",
        P.estimate_peak_mb(F.coalesce(unknown, c("w")), F.coalesce(unknown, c("h")), c("target"), c("tile")).alias("peak_mb"),
        P.decode_strategy(F.when(c("id") % 17 != 0, c("w")), c("h"), c("tile")).alias("strategy"),
    )


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale, domain, limits and normalisation read off file names made of part's columns."""
    kinds = ("up2x-no-denoise.param", "realesrgan-x4plus.onnx", "up3x-denoise3x.param", "scale2.0x_model.bin", "gfpgan-v1.4.param", "waifu2x_anime_8x.param", "mystery.param", "up2x-denoise3x.param", "4x-ultrasharp.onnx", "model_x1.bin")
    name = F.concat("p_name", F.lit("_"), F.element_at(F.array(*map(F.lit, kinds)), (c("p_partkey") % len(kinds) + 1).cast("int")))
    t = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), name.alias("name"), (c("p_size") * 2).alias("mb"))
    scale = P.probe_scale(c("name"))
    half = F.lower("name").rlike("gfpgan|codeformer")
    return t.select(
        "id", scale.cast("int").alias("scale"), P.probe_domain(c("name")).alias("domain"), P.probe_max_edge(scale, c("mb")).cast("int").alias("max_edge"),
        P.probe_max_pixels(scale, c("mb")).alias("max_pixels"), P.probe_note(scale, c("mb")).alias("probe_note"),
        F.when(half, 0.5).otherwise(0.0).alias("mean"), F.when(half, 0.5).otherwise(1.0).alias("std"), F.lower("name").contains("gfpgan").alias("fixed"),
        P.noise_file(c("name"), (c("id") % 6 - 1).cast("int")).alias("noise_file"), P.model_route(c("name")).alias("route"),
    )


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem, last segment, cuts, safe name and size text; addresses are made of supplier's columns."""
    s = table(spark, sf_dir, "supplier")
    exts = ("jpg", "PNG", "webp", "tar.gz", "heic", "txt", "jxl")
    uri = F.concat(F.lit("content://a/b c/"), "s_name", F.lit("."), F.element_at(F.array(*map(F.lit, exts)), (c("s_suppkey") % len(exts) + 1).cast("int")))
    s = s.select(c("s_suppkey").alias("id"), F.when(c("s_suppkey") % 9 == 0, F.lit("plain")).otherwise(uri).alias("uri"), F.floor(F.abs("s_acctbal") * (c("s_suppkey") % 3 * 900 + 1)).cast("long").alias("size"))
    name = P.last_segment(c("uri"))
    return s.select(
        "id", name.alias("name"), P.stem(name).alias("stem"), P.extension(name).alias("ext"), P.is_image(name).alias("image"), P.guess_mime(c("uri")).alias("mime"),
        P.safe_name(name).alias("safe"), F.substring("uri", 1, 6).alias("cut"), P.format_size(c("size")).alias("size_text"),
    )


def clock_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with clock text, and the workers of a profile."""
    e = table(spark, sf_dir, "events")
    profiles = F.element_at(F.array(*map(F.lit, P.WORKERS)), (c("user_id") % 4 + 1).cast("int"))
    line = F.concat_ws(" ", P.clock_text(c("ts")), F.upper(F.substring("event_type", 1, 1)), "event_type")
    return e.select("event_id", line.alias("line"), P.lookup(P.WORKERS, profiles).cast("int").alias("workers"))


def fitted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = P.fit_edge(c("w"), c("h"), 1024)
    return jobs(spark, sf_dir).select("id", w.cast("int").alias("fit_w"), h.cast("int").alias("fit_h"))


QUERIES = {
    "path_selection": path_selection, "quality_maps": quality_maps, "format_rules": format_rules, "memory_plan": memory_plan,
    "model_names": model_names, "text_helpers": text_helpers, "clock_lines": clock_lines, "fitted_edges": fitted_edges,
}

_PATH = "CASE WHEN target = base THEN 'BASIC' WHEN target > base THEN 'CHAIN' WHEN allow THEN 'BASIC_DOWNSCALE' ELSE 'BASIC' END"
# every chain of a base up to 4 and a target up to 16 that is longer than one, worked out by hand
CHAINS = """CASE WHEN base = 2 AND target IN (4, 6, 10, 14) THEN 2 WHEN base = 2 AND target IN (8, 12) THEN 3 WHEN base = 2 AND target = 16 THEN 4
  WHEN base = 3 AND target IN (6, 9, 12, 15) THEN 2 WHEN base = 4 AND target IN (8, 12, 16) THEN 2 ELSE 1 END"""
_OUT = "w::BIGINT * target * h::BIGINT * target * 4"
_BIG = 180 * 1024 * 1024
_FORMAT = f"CASE WHEN {_OUT} > {_BIG} AND fmt NOT IN ('jxl', 'png', 'jpeg') THEN 'jpeg' ELSE fmt END"
_NAMES = "['up2x-no-denoise.param', 'realesrgan-x4plus.onnx', 'up3x-denoise3x.param', 'scale2.0x_model.bin', 'gfpgan-v1.4.param', 'waifu2x_anime_8x.param', 'mystery.param', 'up2x-denoise3x.param', '4x-ultrasharp.onnx', 'model_x1.bin']"

ORACLE_SQL = {
    "path_selection": f"""WITH {JOBS}, p AS (SELECT *, {_PATH} AS path FROM jobs)
SELECT id, path, CASE WHEN base = 1 THEN target = 1 ELSE target IN (base, base ** 2, base ** 3, base ** 4) END AS is_power, ({CHAINS})::INT AS chain,
  CASE WHEN path = 'CHAIN' THEN target ELSE base END AS factor, w * target AS final_w, h * target AS final_h, (CASE WHEN path = 'CHAIN' THEN target ELSE base END) <> target AS resized FROM p""",
    "quality_maps": f"""WITH {JOBS}, p AS (SELECT *, greatest(1, least(100, q)) AS d FROM jobs)
SELECT id, d AS direct, ((100 - d) * 9 // 99)::INT AS png, floor(18 + 33 * (100 - d) / 99.0::DOUBLE)::INT AS crf, floor(18 + 45 * (100 - d) / 99.0::DOUBLE)::INT AS cq,
  round((100 - d) * 15.0::DOUBLE / 99.0::DOUBLE, 6) AS distance,
  round(w::BIGINT * h * CASE fmt WHEN 'png' THEN 1.5::DOUBLE ELSE (CASE fmt WHEN 'jpeg' THEN 0.35 WHEN 'webp' THEN 0.30 WHEN 'avif' THEN 0.18 WHEN 'jxl' THEN 0.22 ELSE 0.20 END)::DOUBLE * (100.0::DOUBLE / greatest(q, 10)) END / 8.0::DOUBLE / 1024 / 1024, 6) AS size_mb FROM p""",
    "format_rules": f"""WITH {JOBS} SELECT id, w::BIGINT * h > 32000000 OR {_OUT} > {_BIG} OR (fmt IN ('heic', 'heif', 'avif') AND greatest(w, h) * target > 8192) AS over_limit,
  {_FORMAT} AS written, 'image/' || {_FORMAT} AS mime, fmt NOT IN ('heic', 'heif') OR 26 + id % 6 >= 28 AS supported, CASE WHEN fmt IN ('jpeg', 'png', 'webp') THEN upper(fmt) END AS platform_format FROM jobs""",
    "memory_plan": f"""WITH {JOBS}, a AS (SELECT *, (id % 11) * 64 + 96 AS heap FROM jobs), b AS (SELECT *, least(greatest(heap - 120, 64), heap * 2 + 8)::BIGINT AS budget FROM a),
u AS (SELECT *, floor(sqrt((floor(greatest(budget - 60, 64) * 0.7::DOUBLE)::BIGINT * 1048576) // 24))::BIGINT AS edge FROM b),
t AS (SELECT *, edge - edge % 32 AS tile, CASE WHEN id % 13 = 0 THEN 3456 ELSE w END AS pw, CASE WHEN id % 13 = 0 THEN 3456 ELSE h END AS ph FROM u)
SELECT id, budget, tile, (CASE WHEN pw::BIGINT * target * ph * target * 4 > {_BIG} THEN 160 ELSE 60 + tile * tile * 16 // 1048576 + pw::BIGINT * target * ph * target * 4 // 1048576 + 30 END)::BIGINT AS peak_mb,
  CASE WHEN id % 17 = 0 THEN 'ERROR' WHEN w::BIGINT * h > 32000000 OR greatest(w, h) > tile THEN 'REGION_DECODE' ELSE 'DIRECT_DECODE' END AS strategy FROM t""",
    "model_names": f"""WITH n AS (SELECT p_partkey AS id, p_name || '_' || ({_NAMES})[(p_partkey % 10 + 1)::INT] AS name, p_size * 2 AS mb, p_partkey % 6 - 1 AS noise FROM part),
s AS (SELECT *, CASE WHEN regexp_matches(name, 'x8|8x|8\\.0x') THEN 8 WHEN regexp_matches(name, 'x4|4x|4\\.0x') THEN 4 WHEN regexp_matches(name, 'x3|3x|3\\.0x') THEN 3 WHEN regexp_matches(name, 'x2|2x|2\\.0x') THEN 2 WHEN regexp_matches(name, 'x1|1x') THEN 1 ELSE 4 END AS scale FROM n)
SELECT id, scale::INT AS scale, CASE WHEN regexp_matches(name, 'anime|waifu') THEN 'anime' WHEN regexp_matches(name, 'face|gfpgan|codeformer') THEN 'face' WHEN regexp_matches(name, 'ultrasharp|remacri|photo') THEN 'photo' ELSE 'general' END AS domain,
  (CASE WHEN scale >= 4 THEN CASE WHEN mb > 50 THEN 192 WHEN mb > 20 THEN 256 ELSE 512 END WHEN scale >= 2 AND mb > 10 THEN 512 ELSE 1024 END)::INT AS max_edge,
  CASE WHEN scale < 2 OR (scale < 4 AND mb <= 10) THEN 1048576 WHEN scale < 4 OR mb <= 20 THEN 262144 WHEN mb <= 50 THEN 65536 ELSE 36864 END::BIGINT AS max_pixels,
  'Auto-Probe · ' || scale || 'x · ' || mb || 'MB' AS probe_note,
  CASE WHEN name LIKE '%gfpgan%' THEN 0.5 ELSE 0.0 END::DOUBLE AS mean, CASE WHEN name LIKE '%gfpgan%' THEN 0.5 ELSE 1.0 END::DOUBLE AS std, name LIKE '%gfpgan%' AS fixed,
  CASE WHEN noise >= 0 THEN split_part(regexp_replace(name, '\\.param$', ''), '-', 1) || '-' || CASE noise WHEN 0 THEN 'conservative' WHEN 1 THEN 'denoise1x' WHEN 2 THEN 'denoise2x' WHEN 3 THEN 'denoise3x' ELSE 'no-denoise' END || '.param' ELSE name END AS noise_file,
  CASE WHEN name LIKE '%.param' THEN 'native-file' WHEN name LIKE '%.bin' THEN 'missing' WHEN name LIKE '%.onnx' THEN 'onnx' ELSE 'unknown' END AS route FROM s""",
    "text_helpers": """WITH u AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN 'plain' ELSE 'content://a/b c/' || s_name || '.' || (['jpg', 'PNG', 'webp', 'tar.gz', 'heic', 'txt', 'jxl'])[(s_suppkey % 7 + 1)::INT] END AS uri, floor(abs(s_acctbal) * (s_suppkey % 3 * 900 + 1))::BIGINT AS size FROM supplier),
n AS (SELECT *, split_part(uri, '/', -1) AS name FROM u), e AS (SELECT *, CASE WHEN name LIKE '%.%' THEN lower(split_part(name, '.', -1)) ELSE '' END AS ext FROM n)
SELECT id, name, regexp_replace(name, '\\.[^.]*$', '') AS stem, ext, ext IN ('jpg', 'jpeg', 'png', 'webp', 'heic', 'heif', 'avif', 'jxl', 'bmp', 'gif', 'tif', 'tiff') AS image,
  CASE WHEN ext IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN ext IN ('png', 'webp', 'heic', 'heif', 'avif', 'jxl') THEN 'image/' || ext ELSE 'image/*' END AS mime,
  regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS safe, substr(uri, 1, 6) AS cut,
  CASE WHEN size >= 1048576 THEN ((size + 524288) // 1048576) || 'MB' WHEN size >= 1024 THEN ((size + 512) // 1024) || 'KB' ELSE size || 'B' END AS size_text FROM e""",
    "clock_lines": "SELECT event_id, strftime(ts, '%H:%M:%S.%g') || ' ' || upper(substr(event_type, 1, 1)) || ' ' || event_type AS line, (user_id % 4 + 1)::INT AS workers FROM events",
    "fitted_edges": f"""WITH {JOBS} SELECT id, (CASE WHEN greatest(w, h) <= 1024 THEN w ELSE greatest(1, floor(w * 1024.0::DOUBLE / greatest(w, h))) END)::INT AS fit_w,
  (CASE WHEN greatest(w, h) <= 1024 THEN h ELSE greatest(1, floor(h * 1024.0::DOUBLE / greatest(w, h))) END)::INT AS fit_h FROM jobs""",
}
