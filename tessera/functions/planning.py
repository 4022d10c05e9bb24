"""Planning and naming functions as columns: paths, chains, tiles, budgets, quality maps, model names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the planner.
WHOLE_IMAGE_BYTES = 180 * 1024 * 1024
STREAMING_PEAK_MB = 160
ENGINE_MB = 60
SYSTEM_MB = 120
OVERHEAD_MB = 30
LOWEST_BUDGET_MB = 64
TENSOR_BYTES = 24  # two float32 tensors of three channels
UNKNOWN_EDGE = 3456
DIRECT_PIXELS = 32_000_000
ENCODER_EDGE = 8192
OVERLAP = 32
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "heic", "heif", "avif", "jxl", "bmp", "gif", "tif", "tiff")
MIME = {"jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "heic": "image/heic", "heif": "image/heif", "avif": "image/avif", "jxl": "image/jxl"}
#: Estimated megabits a megapixel at quality 100; png does not depend on quality.
BITS_PER_PIXEL = {"jpeg": 0.35, "webp": 0.30, "heic": 0.20, "heif": 0.20, "avif": 0.18, "jxl": 0.22}
NOISE_SUFFIX = {0: "conservative", 1: "denoise1x", 2: "denoise2x", 3: "denoise3x"}
WORKERS = {"saver": 1, "balanced": 2, "performance": 3, "ultra": 4}
DOMAINS = {"anime": ("anime", "waifu"), "face": ("face", "gfpgan", "codeformer"), "photo": ("ultrasharp", "remacri", "photo")}


def lookup(pairs: dict, key: Column, default: Column | None = None) -> Column:
    """A fixed table as a CASE."""
    out = None
    for k, v in pairs.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out if default is None else out.otherwise(default)


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def whole(value: Column, by) -> Column:
    """Integer quotient, truncated, in long arithmetic."""
    by = by if isinstance(by, Column) else F.lit(by)
    return F.floor(F.abs(value) / F.abs(by)).cast("long") * F.signum(value).cast("long") * F.signum(by).cast("long")


def is_power_of(base: Column, target: Column) -> Column:
    """Whether target is base, base**2, ... base**8; for base 1 only target 1 is."""
    power = F.exists(F.sequence(F.lit(1), F.lit(8)), lambda n: F.pow(base, n) == target)
    return F.when(base > 1, power).otherwise(target == base)


def select_path(base: Column, target: Column, allow: Column) -> Column:
    return (
        F.when(target == base, "BASIC")
        .when(target > base, "CHAIN")
        .when(allow, "BASIC_DOWNSCALE")
        .otherwise("BASIC")
    )


def chain_count(base: Column, target: Column) -> Column:
    """Inferences in a row: 1, and one more for every exact division of what is left while that exceeds base.

    A target below base counts once. A base of 1 would never end and counts once, too.
    """
    folded = F.aggregate(
        F.sequence(F.lit(1), F.lit(31)),
        F.struct(target.cast("int").alias("left"), F.lit(1).alias("n")),
        lambda a, _: F.when((a["left"] > base) & (a["left"] % base == 0), F.struct((a["left"] / base).cast("int").alias("left"), (a["n"] + 1).alias("n"))).otherwise(a),
        lambda a: a["n"],
    )
    return F.when(base > 1, folded).otherwise(1)


def factor(base: Column, target: Column, allow: Column) -> Column:
    return F.when(select_path(base, target, allow) == "CHAIN", target).otherwise(base)


def output_bytes(w: Column, h: Column, scale: Column) -> Column:
    return w.cast("long") * scale * h.cast("long") * scale * 4


def device_budget_mb(heap: Column, large: Column) -> Column:
    return F.least(F.greatest(heap - SYSTEM_MB, F.lit(LOWEST_BUDGET_MB)), large - SYSTEM_MB)


def max_tile_edge(budget: Column) -> Column:
    usable = F.floor(F.greatest(budget - ENGINE_MB, F.lit(LOWEST_BUDGET_MB)) * F.lit(0.7)).cast("long")
    edge = F.floor(F.sqrt(F.floor(usable * 1048576 / TENSOR_BYTES))).cast("long")
    return edge - edge % 32


def estimate_peak_mb(w: Column, h: Column, target: Column, tile: Column) -> Column:
    known = lambda x: F.when(x > 0, x).otherwise(UNKNOWN_EDGE)
    out = output_bytes(known(w), known(h), target)
    table = ENGINE_MB + F.floor(tile.cast("long") * tile * 16 / 1048576) + F.floor(out / 1048576) + OVERHEAD_MB
    return F.when(out > WHOLE_IMAGE_BYTES, F.lit(STREAMING_PEAK_MB)).otherwise(table).cast("long")


def over_encoder_limit(w: Column, h: Column, scale: Column, fmt: Column) -> Column:
    edge = fmt.isin("heic", "heif", "avif") & (F.greatest(w, h) * scale > ENCODER_EDGE)
    return (w.cast("long") * h > DIRECT_PIXELS) | (output_bytes(w, h, scale) > WHOLE_IMAGE_BYTES) | edge


def written_format(w: Column, h: Column, scale: Column, fmt: Column) -> Column:
    """jxl, png and jpeg can be streamed; other formats of large outputs become jpeg."""
    large = output_bytes(w, h, scale) > WHOLE_IMAGE_BYTES
    return F.when(large & ~fmt.isin("jxl", "png", "jpeg"), "jpeg").otherwise(fmt)


def decode_strategy(w: Column, h: Column, tile: Column) -> Column:
    region = (w.cast("long") * h > DIRECT_PIXELS) | (F.greatest(w, h) > tile)
    return F.when(w.isNull() | h.isNull(), "ERROR").when(region, "REGION_DECODE").otherwise("DIRECT_DECODE")


def axis_starts(length: Column, tile: Column, overlap: int = OVERLAP) -> Column:
    """Starts of overlapping tiles along one axis; the last one reaches the end."""
    steps = F.ceil((length - tile) / (tile - overlap)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), steps)), lambda i: i * (tile - overlap).cast("int"))


def direct_quality(q: Column) -> Column:
    return clamp(q, 1, 100)


def png_level(q: Column) -> Column:
    return F.floor((100 - direct_quality(q)) * 9 / 99).cast("int")


def heic_crf(q: Column) -> Column:
    return F.floor(18 + (100 - direct_quality(q)) * 33 / F.lit(99.0)).cast("int")


def avif_cq(q: Column) -> Column:
    return F.floor(18 + (100 - direct_quality(q)) * 45 / F.lit(99.0)).cast("int")


def jxl_distance(q: Column) -> Column:
    return (100 - direct_quality(q)) * F.lit(15.0) / F.lit(99.0)


def estimate_output_mb(fmt: Column, q: Column, pixels: Column) -> Column:
    bits = lookup(BITS_PER_PIXEL, fmt, F.lit(None).cast("double")) * (F.lit(100.0) / F.greatest(q, F.lit(10)))
    return pixels * F.when(fmt == "png", F.lit(1.5)).otherwise(bits) / 8.0 / 1024.0 / 1024.0


def probe_scale(name: Column) -> Column:
    """The first scale that the name mentions, tried from 8 down; 4 if none."""
    name, out = F.lower(name), None
    for n in (8, 4, 3, 2, 1):
        hit = name.contains(f"x{n}") | name.contains(f"{n}x") | (name.contains(f"{n}.0x") if n > 1 else F.lit(False))
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out.otherwise(4)


def probe_domain(name: Column) -> Column:
    out = None
    for domain, marks in DOMAINS.items():
        hit = F.lower(name).rlike("|".join(marks))
        out = F.when(hit, domain) if out is None else out.when(hit, domain)
    return out.otherwise("general")


def probe_max_edge(scale: Column, mb: Column) -> Column:
    return F.when((scale >= 4) & (mb > 50), 192).when((scale >= 4) & (mb > 20), 256).when(scale >= 4, 512).when((scale >= 2) & (mb > 10), 512).otherwise(1024)


def probe_max_pixels(scale: Column, mb: Column) -> Column:
    edge = probe_max_edge(scale, mb).cast("long")
    return edge * edge


def probe_note(scale: Column, mb: Column) -> Column:
    return F.concat(F.lit("Auto-Probe · "), scale.cast("string"), F.lit("x · "), mb.cast("string"), F.lit("MB"))


def format_size(size: Column) -> Column:
    mb = F.floor((size + 524288) / 1048576).cast("string")
    kb = F.floor((size + 512) / 1024).cast("string")
    return F.when(size >= 1048576, F.concat(mb, F.lit("MB"))).when(size >= 1024, F.concat(kb, F.lit("KB"))).otherwise(F.concat(size.cast("string"), F.lit("B")))


def noise_file(param: Column, noise: Column) -> Column:
    """The graph file for a noise level: the part before the dash, and the level's suffix."""
    prefix = F.substring_index(F.regexp_replace(param, r"\.param$", ""), "-", 1)
    return F.when(noise >= 0, F.concat(prefix, F.lit("-"), lookup(NOISE_SUFFIX, noise, F.lit("no-denoise")), F.lit(".param"))).otherwise(param)


def stem(name: Column) -> Column:
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def last_segment(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def is_image(name: Column) -> Column:
    return extension(name).isin(*IMAGE_EXTENSIONS)


def guess_mime(uri: Column) -> Column:
    ext = extension(last_segment(uri))
    return lookup({"jpg": "image/jpeg"} | {k: v for k, v in MIME.items()}, ext, F.lit("image/*"))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def model_route(uri: Column) -> Column:
    """Which engine a model's address leads to."""
    return (
        F.when(uri.startswith("ncnn:"), "native")
        .when(uri.endswith(".param"), "native-file")
        .when(uri.endswith(".bin"), "missing")
        .when(uri.endswith(".onnx"), "onnx")
        .when(uri.startswith("asset:models/"), "missing")
        .otherwise("unknown")
    )


def fit_edge(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """Width and height scaled so that the longer one is ``most``; smaller images stay."""
    longer = F.greatest(w, h)
    scaled = lambda x: F.when(longer <= most, x).otherwise(F.greatest(F.lit(1), F.floor(x * F.lit(float(most)) / longer).cast("int")))
    return scaled(w), scaled(h)


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss.SSS")
