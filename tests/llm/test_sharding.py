import zlib

from pyspark.sql import functions as F

from tessera.llm import sharding


def test_permutation_is_exact_for_many_sizes(spark):
    for total in (1, 2, 3, 7, 10, 101, 1000, 4099):
        got = [r[0] for r in spark.range(total).select(sharding.permuted(F.col("id"), total, 3)).collect()]
        assert sorted(got) == list(range(total))
    assert got != sorted(got)


def test_law_slots_and_contents(spark):
    rows = [(i, None if i % 50 == 0 else "é" * (i % 7), "x") for i in range(503)] + [(None, "a", "y"), (None, None, "y"), (3, "ééé", "x"), (3, "ééé", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard(df, 40).collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert set(shards) == set(range(40))
    sizes = [len(v) for v in shards.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == want
    again = {(r.doc_id, r.row): (r.shard, r.slot) for r in sharding.shard(df.repartition(5), 40).collect()}
    assert again == {(r.doc_id, r.row): (r.shard, r.slot) for r in got}


def test_hot_rows_and_ids(spark, monkeypatch):
    """A third of the rows equal, a third under one id, and a very long text."""
    monkeypatch.setattr(sharding, "STRETCH", 9)
    monkeypatch.setattr(sharding, "BUCKETS", 8)
    long = "é" * 2_000_000
    rows = [(None, "a")] * 200 + [(7, f"t{i}") for i in range(200)] + [(i, f"u{i % 3}") for i in range(200)] + [(8, long)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted((i or 0, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows)
    assert sorted(r.row for r in got) == list(range(601))
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert {len(v) for v in shards.values()} == {15, 16} and all(sorted(v) == list(range(len(v))) for v in shards.values())


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 40).collect() == []
