"""Table-driven cases of the planning functions."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import planning as P
from tessera.functions import rasters as R
from tessera.operators.tiles import grid, overlapping

PATHS = [(2, 2, True, "BASIC"), (4, 4, True, "BASIC"), (2, 4, True, "CHAIN"), (2, 8, True, "CHAIN"), (4, 16, True, "CHAIN"), (2, 6, True, "CHAIN"), (3, 4, True, "CHAIN"), (4, 2, True, "BASIC_DOWNSCALE"), (4, 2, False, "BASIC")]
NAMES = [
    ("up2x-no-denoise.param", 2, "general"), ("up2x-conservative.param", 2, "general"), ("up3x-denoise3x.param", 3, "general"), ("up4x-conservative.param", 4, "general"),
    ("noise0_scale2.0x_model.param", 2, "general"), ("scale2.0x_model.bin", 2, "general"), ("realesrgan-x4plus.onnx", 4, "general"), ("realesrgan-x2plus.onnx", 2, "general"),
    ("mystery-model.param", 4, "general"), ("waifu2x_anime.param", 2, "anime"), ("up2x-anime.param", 2, "anime"), ("gfpgan-v1.4.param", 4, "face"), ("up4x-photo.param", 4, "photo"), ("up2x-denoise3x.param", 3, "general"),
]


def test_paths_and_chains(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PATHS)], "i int, b int, t int, a boolean, want string")
    got = df.select("want", P.select_path(F.col("b"), F.col("t"), F.col("a")).alias("path")).collect()
    assert all(r.want == r.path for r in got)
    chains = spark.createDataFrame([
        (2, 4, 2), (2, 6, 2), (2, 8, 3), (2, 10, 2), (2, 12, 3), (2, 14, 2), (2, 16, 4), (3, 6, 2), (3, 9, 2), (3, 12, 2), (3, 15, 2), (3, 4, 1), (4, 8, 2), (4, 12, 2),
        (4, 16, 2), (4, 6, 1), (4, 2, 1), (4, 4, 1), (1, 5, 1), (2, 2, 1), (2, 1, 1), (2, 7, 1),
    ], "b int, t int, want int")
    assert all(r.want == r.n for r in chains.select("want", P.chain_count(F.col("b"), F.col("t")).alias("n")).collect())


def test_names(spark):
    df = spark.createDataFrame(NAMES, "name string, scale int, domain string")
    for r in df.select("*", P.probe_scale(F.col("name")).alias("s"), P.probe_domain(F.col("name")).alias("d")).collect():
        assert (r.s, r.d) == (r.scale, r.domain), r.name


def test_quality(spark):
    q = spark.createDataFrame([(150, 100, 0), (0, 1, 9), (95, 95, 0), (100, 100, 0), (1, 1, 9), (50, 50, 4)], "q int, direct int, png int")
    for r in q.select("*", P.direct_quality(F.col("q")).alias("d"), P.png_level(F.col("q")).alias("p")).collect():
        assert (r.d, r.p) == (r.direct, r.png)
    sizes = spark.range(1).select(*[P.estimate_output_mb(F.lit(f), F.lit(90), F.lit(1_000_000)).alias(f) for f in P.MIME]).first()
    assert all(v > 0 for v in sizes) and sizes["png"] > sizes["jpeg"]


def test_rounding(spark):
    r = spark.range(1).select(R.half_up(F.lit(-2.5)), R.half_up(F.lit(2.5)), R.to_byte(F.lit(0.9999)), R.to_byte(F.lit(0.9999), True), P.whole(F.lit(-7), 2), R.magnitude(F.lit(-8))).first()
    assert tuple(r) == (-2, 3, 254, 255, -3, 4)


@pytest.mark.parametrize("tile", [64, 100])
def test_tiles_cover_their_image(spark, tile):
    sizes = [(1, 1), (64, 64), (65, 10), (200, 131), (96, 97), (333, 100)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(sizes)], "id int, w int, h int")
    for made, step in ((overlapping(df, tile), tile - P.OVERLAP), (grid(df, tile), tile)):
        tiles = {}
        for t in made.collect():
            tiles.setdefault(t.id, []).append(t)
        for i, (w, h) in enumerate(sizes):
            covered = {(x, y) for t in tiles[i] for x in range(t.x, t.x + t.tw) for y in range(t.y, t.y + t.th)}
            assert len(covered) == w * h
            assert all(t.x % step == 0 and t.y % step == 0 and t.x + t.tw <= w and t.y + t.th <= h for t in tiles[i])


def test_plans_read_only_what_they_use(spark, sf_dir):
    from tessera import registry

    plan = registry.queries()["job_status_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string>" in plan
    plan = registry.queries()["pending_fifo"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
    for name in ("tile_grid", "queue_groups", "profile_lookup", "pixel_pack", "admission"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan, name
