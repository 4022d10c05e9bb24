"""Queries over tiles on odd and repeated keys against their SQL, and without a join of tiles with their images."""

import duckdb
import pyarrow as pa
import pytest

from tessera import registry
from tessera.operators import engine

KEYS = [None, -1, -7, -8000, -123456, 0, 1, 2, 2, 3, 3, 3, 4, 6998, 8999]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    rows = [(k, f"n{i}", i % 5 + 1) for i, k in enumerate(KEYS)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def check(spark, folder, name):
    """The query gives the rows of its SQL, and joins nothing."""
    df = registry.queries()[name](spark, folder)
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{folder}/part.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    columns = want.columns
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*(f"`{x}`" for x in columns)).collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_subcanvas_overlap(spark, parts):
    check(spark, parts, "subcanvas_overlap")


def test_tile_last_writer(spark, parts):
    check(spark, parts, "tile_last_writer")


def test_tile_blend(spark, parts):
    check(spark, parts, "tile_blend")


def test_tile_windows(spark, parts):
    check(spark, parts, "tile_windows")


def test_upscaled_images(spark, parts):
    check(spark, parts, "upscaled_images")


def test_upscaled_tiles_are_handed_on_by_size():
    """Batches out of a worker are bounded by pixels, and none has pixels where only totals are read."""
    row = {"id": 1, "tile_no": 0, "x": 0, "y": 0, "w": 24, "h": 24, "tw": 24, "th": 24, "own_w": 24, "own_h": 24, "base": 2, "chain": 2}
    batch = pa.RecordBatch.from_pylist([row | {"tile_no": n} for n in range(2000)])

    class Tiles:
        def mapInArrow(self, run, schema):
            return list(run(iter([batch])))

    made = engine.upscaled(Tiles(), read=engine.drawn)
    assert sum(b.num_rows for b in made) == 2000 and max(b.nbytes for b in made) < 1 << 25
    bare = engine.upscaled(Tiles(), read=engine.drawn, pixels=False)
    assert [b.column("total").to_pylist() for b in bare] == [[t for b in made for t in b.column("total").to_pylist()]] and bare[0].column("pixels").null_count == 2000
