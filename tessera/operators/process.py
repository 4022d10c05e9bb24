"""The whole job: probe, route, decode, engine, size correction, encode, publish, for every image of a folder.

Small images go through in one row each. Large ones are cut into tiles, upscaled as tiles, stitched into lines and written
by a row-wise encoder, so that nobody holds the output. Both branches are filters on what the probe found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import codecs
from tessera.functions import planning as P
from tessera.operators.engine import chain_length, chained, engine
from tessera.operators.networks import resized
from tessera.operators.tiles import TILE, grid
from tessera.sources import images

c = F.col
JOB = "path string, engine string, base int, target int, allow boolean, fmt string, quality int"
LINES = "id long, fmt string, quality int, width int, height int, y int, rgb binary, name string"


def routed(files: DataFrame, jobs: DataFrame, direct_pixels: int = P.DIRECT_PIXELS, whole_bytes: int = P.WHOLE_IMAGE_BYTES) -> DataFrame:
    """Jobs (JOB) with what the probe of their file found, their path, factor, branch (direct, tiled or failed) and file name.

    A job whose file is missing or cannot be read fails. ``direct_pixels`` and ``whole_bytes`` are what one row may hold.
    """
    j = jobs.join(images.probe(files).select("path", "width", "height"), "path", "left")
    j = j.withColumn("step", P.select_path(c("base"), c("target"), c("allow"))).withColumn("factor", P.factor(c("base"), c("target"), c("allow")))
    edge = c("fmt").isin("heic", "heif", "avif") & (F.greatest("width", "height") * c("factor") > P.ENCODER_EDGE)
    large = (c("width").cast("long") * c("height") > direct_pixels) | (P.output_bytes(c("width"), c("height"), c("factor")) > whole_bytes) | edge
    name = F.concat(P.safe_name(P.stem(P.last_segment(c("path")))), F.lit("_"), F.when(large, c("factor")).otherwise(c("base")).cast("string"), F.lit("x_"), F.substring(F.sha2(F.concat_ws("|", "path", "engine", "target", "fmt"), 256), 1, 8))
    return j.select("*", F.xxhash64("path", "engine", "target", "fmt").alias("id"), name.alias("name"), F.when(c("width").isNull(), "failed").when(large, "tiled").otherwise("direct").alias("branch"))


def _direct_lines(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of small images: decoded, through the engine as often as the target needs, brought to the exact size."""
    schema = pa.schema([("id", pa.int64()), ("fmt", pa.string()), *((n, pa.int32()) for n in ("quality", "width", "height", "y")), ("rgb", pa.binary()), ("name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in batch.to_pylist():
                w, h = j["width"] * j["target"], j["height"] * j["target"]
                head = (j["id"], j["fmt"], j["quality"], w, h)
                try:
                    pixels = _decoded(j["content"])
                    pixels = resized(chained(engine(j["engine"], j["base"]), pixels, chain_length(j["base"], j["target"])).astype(np.uint8), w, h)
                except (ValueError, KeyError) as problem:
                    # a line that no encoder takes: the message becomes the error of the file
                    yield _table([(*head, -1, str(problem)[:200].encode(), j["name"])], schema)
                    continue
                for y in range(0, h, 64):
                    yield _table([(*head, y + k, line.tobytes(), j["name"]) for k, line in enumerate(pixels[y : y + 64])], schema)

    joined = jobs.where("branch = 'direct'").join(files.select("path", "content"), "path")
    return joined.select("id", "fmt", "quality", "width", "height", "engine", "base", "target", "name", "content").mapInArrow(run, LINES)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _decoded(content: bytes) -> np.ndarray:
    kind = images._format(bytes(content[: images.HEAD_BYTES]))
    if kind not in codecs.DECODERS:
        raise ValueError(f"no decoder for {kind}")
    return codecs.DECODERS[kind](bytes(content))


def stitched(pieces: DataFrame) -> DataFrame:
    """Lines (id, y, rgb) of pieces (id, y, x, width, rgb): side by side by their offset, black where there is none. The pieces of a
    line are as many as an image has columns of tiles."""
    lines = pieces.groupBy("id", "y").agg(F.any_value("width").alias("width"), F.array_sort(F.collect_list(F.struct("x", "rgb"))).alias("parts"))
    black = F.lit(b"\0")
    # what is held so far is filled or cut up to a piece's place, then the piece is put behind it
    held = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(F.rpad(a, p["x"] * 3, black), p["rgb"]))
    return lines.select("id", "y", F.rpad(held, c("width") * 3, black).alias("rgb"))


def _tiled_lines(jobs: DataFrame, files: DataFrame, tile: int) -> DataFrame:
    """Lines of large images: tiles are decoded, upscaled each by the job's factor, cut into pieces of lines and stitched. A tile that
    fails leaves black, if any tile of its image succeeds."""
    large = jobs.where("branch = 'tiled'")
    cells = grid(large.select("id", c("width").alias("w"), c("height").alias("h")), tile).join(large.select("id", "path", "engine", "base", "target", "factor", "width"), "id")
    tiles = cells.select("path", F.struct("id", "engine", "base", "target", "factor", "width").alias("job"), (c("band") * 65536 + c("col")).cast("int").alias("tile_no"), "x", "y", "tw", "th")
    made = images.decoded_tiles(files, tiles.select("path", "tile_no", "x", "y", "tw", "th").distinct())
    work = made.join(tiles.select("path", "tile_no", "job"), ["path", "tile_no"]).select("job.*", "x", "y", "tw", "th", "rgb", "error")

    @F.pandas_udf("array<struct<y:int,rgb:binary>>")
    def lines(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for name, base, target, factor, tw, th, rgb, error in batches:
            answers = []
            for one in zip(name, base, target, factor, tw, th, rgb, error, strict=True):
                name_, base_, target_, factor_, tw_, th_, rgb_, error_ = one
                try:
                    if error_:
                        raise ValueError(error_)
                    pixels = np.frombuffer(rgb_, np.uint8).reshape(th_, tw_, 3)
                    grown = resized(chained(engine(name_, base_), pixels, chain_length(base_, target_)).astype(np.uint8), tw_ * factor_, th_ * factor_)
                    answers.append([{"y": k, "rgb": line.tobytes()} for k, line in enumerate(grown)])
                except (ValueError, KeyError):
                    answers.append([])
            yield pd.Series(answers)

    rows = work.select("id", "x", "y", "factor", "width", F.explode(lines("engine", "base", "target", "factor", "tw", "th", "rgb", "error")).alias("line"))
    pieces = rows.select("id", (c("y") * c("factor") + c("line.y")).alias("y"), (c("x") * c("factor")).alias("x"), (c("width") * c("factor")).alias("width"), c("line.rgb").alias("rgb"))
    return stitched(pieces).join(large.select("id", "fmt", "quality", (c("width") * c("factor")).alias("width"), (c("height") * c("factor")).alias("height"), "name"), "id").select(*[f.split()[0] for f in LINES.split(", ")])


def processed(files: DataFrame, jobs: DataFrame, folder: str, tile: int = TILE, direct_pixels: int = P.DIRECT_PIXELS, whole_bytes: int = P.WHOLE_IMAGE_BYTES) -> DataFrame:
    """Every job (JOB) of files (path, content) done: path, engine, target, fmt, branch, status, progress, output, length and error.

    Outputs are whole files in ``folder``, which driver and executors share. Jobs must differ in path, engine, target or format.
    """
    plan = routed(files, jobs, direct_pixels, whole_bytes)
    lines = _direct_lines(plan, files).unionByName(_tiled_lines(plan, files, tile))
    done = images.saved(lines, folder)
    result = plan.join(done.select("id", c("path").alias("output"), "length", "error"), "id", "left")
    error = F.when(c("branch") == "failed", F.lit("unreadable image")).otherwise(F.coalesce("error", F.lit("nothing decoded")))
    good = c("output").isNotNull()
    return result.select(
        "path", "engine", "target", "fmt", "branch", F.when(good, "completed").otherwise("failed").alias("status"), F.when(good, 1.0).when(c("branch") == "failed", 0.05).otherwise(0.1).alias("progress"),
        "output", F.coalesce("length", F.lit(0).cast("long")).alias("length"), F.when(good, "").otherwise(error).alias("error"),
    )


def subcanvases(lines: DataFrame, parts: int = 4) -> DataFrame:
    """Lines (LINES) of images as lines of ``parts`` x ``parts`` smaller ones, named after their row and column, for ``images.saved``:
    cut by position, so lines need not meet. Canvases beyond a small image's end do not exist."""
    size = lambda n: F.ceil(c(n) / parts).cast("int")
    cut = lines.withColumns({"sw": size("width"), "sh": size("height")}).withColumn("sy", F.floor(c("y") / c("sh")).cast("int"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("sx")).where("sx * sw < width")
    w, h = F.least(c("sw"), c("width") - c("sx") * c("sw")), F.least(c("sh"), c("height") - c("sy") * c("sh"))
    return cut.select(
        F.xxhash64("id", "sy", "sx").alias("id"), "fmt", "quality", w.alias("width"), h.alias("height"), (c("y") - c("sy") * c("sh")).alias("y"),
        F.substring("rgb", c("sx") * c("sw") * 3 + 1, w * 3).alias("rgb"), F.concat_ws("_", "name", "sy", "sx").alias("name"),
    )


@F.udtf(returnType="y: int, rgb: binary")
class ImageRows:
    """Rows of an image file, one after the other: SELECT ... FROM files, LATERAL image_rows(content)."""

    def eval(self, content: bytes):
        if content is None:
            return
        try:
            pixels = _decoded(content)
        except ValueError:
            return
        for y, line in enumerate(pixels):
            yield y, line.tobytes()


def register_rows(spark: SparkSession, name: str = "image_rows") -> None:
    spark.udtf.register(name, ImageRows)
