"""Upscaling engines as pluggable functions over tiles, and the drivers that run them.

The reference's networks cannot be shipped (their weights are not public with it), so the engine here is a
deterministic stand-in; an engine backed by a model runtime registers the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessera.operators.tiles import dealt, overlapping, owned
from tessera.plans.standin import JOBS, jobs

PAD = 18
#: Output pixels of tiles that a worker gathers before it hands them on.
HELD = 1 << 22


class Engine(Protocol):
    scale: int

    def upscale(self, pixels: np.ndarray) -> np.ndarray:
        """(h, w, channels) to (h * scale, w * scale, channels)."""


class Nearest:
    """Repeats pixels: exact, so results of any tiling are known."""

    def __init__(self, scale: int):
        self.scale = scale

    def upscale(self, pixels: np.ndarray) -> np.ndarray:
        n, (h, w, *channels) = self.scale, pixels.shape
        out = np.empty((h, n, w, n, *channels), pixels.dtype)
        for i in range(n):
            out[:, 0, :, i] = pixels
        out[:, 1:] = out[:, :1]
        return out.reshape(h * n, w * n, *channels)


FACTORIES: dict[str, Callable[[int], Engine]] = {"nearest": Nearest}
_running: dict[tuple[str, int], Engine] = {}


def engine(name: str, scale: int) -> Engine:
    """One instance per worker process."""
    if (name, scale) not in _running:
        _running[name, scale] = FACTORIES[name](scale)
    return _running[name, scale]


def register_engine(spark: SparkSession, name: str, factory: Callable[[int], Engine]) -> None:
    """Add an engine, and an SQL function of its name over (pixels array<int>, width, scale)."""
    FACTORIES[name] = factory

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(pixels: pd.Series, width: pd.Series, scale: pd.Series) -> pd.Series:
        made = (factory(int(s)).upscale(np.array(p, int).reshape(-1, int(w), 1)).ravel().tolist() for p, w, s in zip(pixels, width, scale, strict=True))
        return pd.Series(list(made))

    spark.udf.register(name, run)


def padded(pixels: np.ndarray, x: int, y: int, w: int, h: int, pad: int) -> np.ndarray:
    """A tile with a border, the image's edge repeated where there is none."""
    rows = np.clip(np.arange(y - pad, y + h + pad), 0, pixels.shape[0] - 1)
    columns = np.clip(np.arange(x - pad, x + w + pad), 0, pixels.shape[1] - 1)
    return pixels[np.ix_(rows, columns)]


class Noisy:
    """An engine per noise level: a change of level loads the model of the new one, the old one is dropped."""

    def __init__(self, load: Callable[[int], Engine]):
        self.load, self.level, self.made = load, None, None

    def at(self, level: int) -> Engine:
        if self.made is None or level != self.level:
            self.made, self.level = self.load(level), level
        return self.made


class Throttle:
    """Passes progress on that is at least a hundredth above the last one passed on, or the end."""

    def __init__(self, listen: Callable[[float], None]):
        self.listen, self.sent = listen, -1.0

    def __call__(self, share: float) -> None:
        share = min(1.0, max(0.0, share))
        if share - self.sent >= 0.01 or share >= 1.0:
            self.sent = share
            self.listen(share)


def chained(made: Engine, pixels: np.ndarray, times: int, progress: Callable[[float], None] = lambda share: None) -> np.ndarray:
    """An image through an engine so many times. An engine that fails is closed, if it can be, and the error goes on."""
    tell = Throttle(progress)
    tell(0.02)
    try:
        for n in range(times):
            pixels = made.upscale(pixels)
            tell((n + 1) / times)
    except Exception:
        getattr(made, "close", lambda: None)()
        raise
    return pixels


def chain_length(base: int, target: int) -> int:
    """As functions.planning.chain_count."""
    n = 1
    while base > 1 and target > base and target % base == 0:
        target, n = target // base, n + 1
    return n


def pixels_of(row: dict) -> np.ndarray:
    return np.array(row["pixels"], int).reshape(row["th"] + 2 * PAD, row["tw"] + 2 * PAD, 1)


def upscaled(tiles: DataFrame, name: str = "nearest", read: Callable[[dict], np.ndarray] = pixels_of, pixels: bool = True) -> DataFrame:
    """Tiles (id, tile_no, x, y, tw, th, own_w, own_h, base, chain and what ``read`` needs) through the engine, chained as often as
    planned: id, tile_no, x, y, w, h, pixels, total. ``read`` gives a tile with a border of PAD. A tile keeps what it owns (see
    tiles.owned), so the results of an image do not overlap. A tile that fails has an error and no pixels. Without ``pixels`` that column is null, for
    those who read the totals: a worker then holds one tile's pixels at a time, and else up to HELD of them."""
    schema = pa.schema([("id", pa.int64()), *((n, pa.int32()) for n in ("tile_no", "x", "y", "w", "h")), ("pixels", pa.list_(pa.int32())), ("total", pa.int64()), ("error", pa.string())])
    table = lambda out: pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for t in batch.to_pylist():
                place = {"id": t["id"], "tile_no": t["tile_no"], "x": 0, "y": 0, "w": 0, "h": 0, "pixels": np.zeros(0, np.int32) if pixels else None, "total": 0, "error": ""}
                try:
                    factor = t["base"] ** t["chain"]
                    made = chained(engine(name, t["base"]), read(t), t["chain"])
                    w, h = t["own_w"] * factor, t["own_h"] * factor
                    cut = made[PAD * factor : PAD * factor + h, PAD * factor : PAD * factor + w]
                    if cut.shape[:2] != (h, w):
                        raise ValueError("the engine's output is too small")
                    place |= {"x": t["x"] * factor, "y": t["y"] * factor, "w": w, "h": h, "pixels": cut.astype(np.int32).ravel() if pixels else None, "total": int(cut.sum())}
                    held += cut.size if pixels else 0
                except (ValueError, KeyError) as problem:
                    place["error"] = str(problem)[:200]
                out.append(place)
                if held >= HELD:
                    yield table(out)
                    out, held = [], 0
            yield table(out)

    return tiles.mapInArrow(run, "id long, tile_no int, x int, y int, w int, h int, pixels array<int>, total long, error string")


def watched(df: DataFrame, total: str = "tiles") -> tuple[DataFrame, Observation]:
    """Rows counted as they pass, for a progress listener."""
    seen = Observation(total)
    return df.observe(seen, F.count("*").alias("done")), seen


def drawn(row: dict) -> np.ndarray:
    """A tile of an image whose pixels are arithmetic on their place, as a decoder would give it."""
    clip = lambda at, n, whole: np.clip(np.arange(at - PAD, at + n + PAD), 0, whole - 1)
    ys, xs = clip(row["y"], row["th"], row["h"]), clip(row["x"], row["tw"], row["w"])
    return ((xs[None] * 7 + ys[:, None] * 13) % 256).astype(np.uint8)[:, :, None]


def upscaled_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small images in overlapping tiles through the stand-in engine: number and sum of output pixels.

    Tiles are painted in order; each is cut to what it owns, so sums of tiles are summed and no pixel is exchanged."""
    size = lambda name, n: (F.col(name) % n + 20).cast("int").alias(name)
    j = jobs(spark, sf_dir).select("id", size("w", 29), size("h", 23), F.lit(2).alias("base"), F.when(F.col("id") % 2 == 0, 1).otherwise(2).alias("chain"))
    tiles = overlapping(dealt(j.where("w > 0 AND h > 0")), 24, 8, ("w", "h", "base", "chain"))
    made = upscaled(owned(tiles, 24, 8), read=drawn, pixels=False)
    return made.groupBy("id").agg(F.sum(F.col("w").cast("long") * F.col("h")).alias("pixels"), F.sum("total").alias("total"))


QUERIES = {"upscaled_images": upscaled_images}
ORACLE_SQL = {
    "upscaled_images": f"""WITH {JOBS}, j AS (SELECT id, w % 29 + 20 AS w, h % 23 + 20 AS h, CASE WHEN id % 2 = 0 THEN 2 ELSE 4 END AS f FROM jobs),
i AS (SELECT id, w, h, f, x, y, ((x * 7 + y * 13) % 256) * f * f AS v FROM j, generate_series(0, w - 1) a(x), generate_series(0, h - 1) b(y))
SELECT id, sum(f * f)::BIGINT AS pixels, sum(v)::BIGINT AS total FROM i GROUP BY 1""",
}
